import random

import numpy as np
import pytest

from rillgrid.llm import suffix


def brute(rows, least):
    key = lambda d: suffix.NO_ID if d is None else d
    first, out = {}, []
    for r in rows:
        raw = (r[1] or "").encode()
        for p in range(len(raw) - least + 1):
            s = raw[p : p + least]
            first[s] = min(first.get(s, suffix.NO_ID), key(r[0]))
    for r in rows:
        raw = (r[1] or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - least + 1):
            if first[raw[p : p + least]] < key(r[0]):
                gone[p : p + least] = b"\1" * least
        spans, p = [], 0
        while (p := gone.find(1, p)) >= 0:
            q = gone.find(0, p)
            q = len(raw) if q < 0 else q
            spans.append((p, q))
            p = q
        out.append((r[0], len(raw), tuple(spans), bytes(x for x, g in zip(raw, gone, strict=True) if not g)))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [50, 32])
def test_removed_bytes_against_all_strings(documents, rows, least):
    got = suffix.deduplicate(documents, least=least).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], tuple((s["start"], s["stop"]) for s in r["spans"]), bytes(r["kept"])) for r in got), key=str) == brute(rows, least)


def test_columns_go_along_and_texts_stay_whole_characters(documents, rows, nothing):
    got = suffix.deduplicated_documents(documents)
    assert got.columns == documents.columns
    kept = got.collect()
    assert len(kept) == len(rows)
    assert all(r["n_chars"] == len(r["text"]) and r["size"] == "x" for r in kept)
    assert suffix.deduplicated_documents(nothing).count() == 0


def test_runs_of_one_letter(spark):
    rows = [(1, "a" * 120), (2, "a" * 60 + "b" * 70), (3, "ab" * 80), (4, "a" * 49), (5, "b" * 75 + "a" * 55)]
    got = suffix.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], tuple((s["start"], s["stop"]) for s in r["spans"]), bytes(r["kept"])) for r in got), key=str) == brute(rows, 50)


def test_run_index_against_all_places():
    rng = random.Random(4)
    for _ in range(30):
        strings = [bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randint(9, 30))) for _ in range(rng.randint(1, 12))]
        strings += strings[:2]
        docs = np.array([rng.randint(0, 9) for _ in strings])
        index = suffix.RunIndex(np.frombuffer(b"".join(strings), dtype=np.uint8), np.array([len(s) for s in strings]), docs, 9)
        assert len(index.run_start) <= sum(map(len, strings)) + len(strings)
        want = [min(d for t, d in zip(strings, docs, strict=True) if s[p : p + 9] in t) for s in strings for p in range(len(s) - 8)]
        assert index.stream().tolist() == want


@pytest.mark.parametrize("letters", [b"ab", b"abcd", bytes(range(256))])
def test_run_index_on_near_copies(letters):
    """Strings cut from one text with single edits share tails that different strings follow."""
    rng = random.Random(1)
    for _ in range(30):
        base = bytes(rng.choice(letters) for _ in range(90))
        strings = []
        for _ in range(rng.randint(20, 150)):
            size = rng.randint(50, 81)
            start = rng.randrange(90 - size)
            cut = bytearray(base[start : start + size])
            if rng.random() < 0.7:
                cut[rng.randrange(size)] = rng.choice(letters)
            strings.append(bytes(cut))
        docs = np.array([rng.randint(0, 1000) for _ in strings])
        index = suffix.RunIndex(np.frombuffer(b"".join(strings), dtype=np.uint8), np.array([len(s) for s in strings]), docs, 50)
        want = [min(d for t, d in zip(strings, docs, strict=True) if s[p : p + 50] in t) for s in strings for p in range(len(s) - 49)]
        assert index.stream().tolist() == want


def test_whole_table_against_all_strings(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in table.collect()]
    got = suffix.deduplicate(table).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], tuple((s["start"], s["stop"]) for s in r["spans"]), bytes(r["kept"])) for r in got), key=str) == brute(rows, 50)
