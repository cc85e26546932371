import re
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from rillgrid.llm import fingerprint


def edited(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    out = []
    for k, r in enumerate(order):
        text, after = r[1] or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        out.append((r[0], len(text), text[: len(text) - half] + after[:half]))
    return sorted(out, key=str)


def test_edited_texts_and_likeness(documents, rows, nothing):
    got = fingerprint.edited_against_next(documents).collect()
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_text"]) for r in got), key=str) == edited(rows)
    marks = {}
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        marks.setdefault(r["edited_text"], set()).add(r["edited_fingerprint"])
    assert all(len(m) == 1 for m in marks.values())
    assert fingerprint.edited_against_next(nothing).count() == 0


def test_equal_texts_are_alike_and_a_large_lexicon_gives_the_same(documents, monkeypatch):
    rows = documents.select("doc_id", "text")
    lex = fingerprint.lexicon(rows, "text")
    made = fingerprint.with_fingerprint(rows, lex, "text", "mark")
    want = {(r["text"] or "", str(r["mark"])) for r in made.collect()}
    assert len({t for t, _ in want}) == len(want)
    same = made.select(fingerprint.likeness(F.col("mark"), F.col("mark")).alias("x")).distinct().collect()
    assert [r["x"] for r in same] == [1.0]
    monkeypatch.setattr(fingerprint, "LEXICON", 0)
    big = fingerprint.lexicon(rows, "text")
    assert big.flat is None and big.size == lex.size
    assert {(r["text"] or "", str(r["mark"])) for r in fingerprint.with_fingerprint(rows, big, "text", "mark").collect()} == want


def test_half_a_text_is_nearer_than_another(spark):
    import random

    rng = random.Random(1)
    words = [f"w{k}" for k in range(3000)]
    rows = [(k, " ".join(rng.choices(words, k=150))) for k in range(200)]
    got = fingerprint.edited_against_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r["near_edited"] > r["near_next"] for r in got) >= 190


def test_copies_and_texts_outside_the_band(spark):
    import random

    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    text = lambda: " ".join(rng.choices(words, k=60))
    copy, own = text(), " ".join(f"u{k}" for k in range(60))
    rows = [(k, copy if k % 2 else text()) for k in range(100)] + [(101, own)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    alone = spark.createDataFrame([r for r in rows if r[1] != copy] + [(1, copy)], "doc_id long, text string")
    terms = lambda df: {r["term"] for r in fingerprint.lexicon(df, "text").rows.collect()}
    assert terms(docs) == terms(alone)
    got = {r["doc_id"]: r for r in fingerprint.edited_against_next(docs).collect()}
    assert all(got[k]["near_edited"] > max(0.1, got[k]["near_next"]) for k in range(1, 100, 2))
    assert got[101]["near_edited"] > max(0.1, got[101]["near_next"])


def brute_likeness(texts):
    """Likeness of any two of the texts, from the terms themselves instead of marks."""
    word = re.compile(r"[^\W_]+")
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    terms = {t: {signed(xxhash.xxh64(w.encode(), seed=42).intdigest()) for w in word.findall(t.lower())} for t in texts[0] + texts[1]}
    different = set(texts[0])
    df = Counter(h for t in different for h in terms[t])
    n = len(different)
    band = {h for h, k in df.items() if max(2, n / fingerprint.RARE) <= k <= max(2, n / fingerprint.COMMON)}

    def cells(hashes):
        part = lambda h, bit: (h & (1 << 64) - 1) >> bit & 7
        first = [[h for h in hashes if part(h, 40) == k] for k in range(8)]
        second = [[h for h in x if part(h, 43) == k] for x in first for k in range(8)]
        third = [[h for h in x if part(h, 46) == k] for x in second[:8] for k in range(8)]
        fourth = [[h for h in x if part(h, 49) == k] for x in third[:8] for k in range(8)]
        return [frozenset(x) for x in [hashes, hashes, *first, *second, *third, *fourth]]

    def like(a, b):
        x, y = terms[a], terms[b]
        one, two = cells(x & band), cells(y & band)
        if not (one[0] and two[0]):
            one, two = one + cells(x - band), two + cells(y - band)
        some = [(p, q) for p, q in zip(one, two, strict=True) if p or q]
        return sum(p == q for p, q in some) / len(some) if some else 1.0

    return like


def test_likeness_against_the_terms_themselves(spark):
    """Marks have 16 bits: two different cells agree by chance once in 65,536 times."""
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    order = sorted(((r["doc_id"], r["text"] or "") for r in table.collect()), reverse=True)
    after = {d: order[(k + 1) % len(order)][1] for k, (d, _) in enumerate(order)}
    made = {r["doc_id"]: r for r in fingerprint.edited_against_next(table).collect()}
    assert len(made) == len(order)
    like = brute_likeness(([t for _, t in order], [r["edited_text"] for r in made.values()]))
    far = [d for d, t in order if abs(made[d]["near_edited"] - like(t, made[d]["edited_text"])) > 1e-9 or abs(made[d]["near_next"] - like(t, after[d])) > 1e-9]
    assert len(far) <= 2, far


def test_ranges_of_many_cuts(spark):
    cuts = [7 * k for k in range(1, 1000)]
    got = spark.range(-3, 7100, 5).select("id", fingerprint._range_of(F.col("id"), cuts).alias("range")).collect()
    assert all(r["range"] == sum(c < r["id"] for c in cuts) for r in got)
