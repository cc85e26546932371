import random
import re

import numpy as np
import pytest

from rillgrid.llm import ngram_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    """(class id, links) by row, from all pairs."""
    sets = []
    for r in rows:
        w = WORD.findall(r[1] or "")
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    part, links = list(range(len(rows))), [0] * len(rows)

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and (n := len(sets[a] & sets[b])) >= 0.8 * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
                links[a] += 1
                links[b] += 1
                part[root(a)] = root(b)
    out = []
    for a, r in enumerate(rows):
        ids = [rows[b][0] for b in range(len(rows)) if root(b) == root(a) and rows[b][0] is not None]
        out.append((r[0], len(sets[a]), min(ids, default=None) if sets[a] else r[0], links[a]))
    return sorted(out, key=str)


def near_copies(n):
    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    out = []
    for k in range(n):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        out.append((k, " ".join(words)))
    return out


def found(df, **options):
    got = ngram_join.near_duplicates(df, **options)
    return sorted(((r["doc_id"], r["n_grams"], r["class_id"], r["n_links"]) for r in got.collect()), key=str)


def test_bands_reach_the_recall():
    bands, rows = ngram_join.choose_bands(0.8, 0.9999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 and bands * rows <= 256


def test_links_and_classes_against_all_pairs(documents, rows, nothing):
    assert found(documents) == brute(rows)
    assert ngram_join.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("members", [256, 40, 7])
def test_a_large_group_in_blocks(spark, monkeypatch, members):
    monkeypatch.setattr(ngram_join, "MEMBERS", members)
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", members)
    monkeypatch.setattr(ngram_join, "PAIRS", 100)
    rows = near_copies(60) + [(100 + k, t) for k, t in near_copies(9)] + [(200, "a b c"), (201, "a b c"), (202, "d e f g h i"), (203, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(df) == brute(rows)


def test_sets_beyond_the_grams_of_a_block(spark, monkeypatch, documents, rows):
    monkeypatch.setattr(ngram_join, "GRAMS", 50)
    assert found(documents) == brute(rows)


def test_links_of_random_sets_against_all_pairs():
    rng = random.Random(9)
    for _ in range(40):
        sets = [{rng.randrange(12) for _ in range(rng.randint(1, 9))} for _ in range(rng.randint(2, 25))]
        base = rng.choice([set(), rng.choice(sets)])
        apart = [np.array(sorted(s ^ base), dtype=np.uint64) for s in sets]
        copies = np.array([rng.randint(1, 3) for _ in sets])
        cut = rng.choice([0, len(sets) // 2])
        left, right = (np.arange(cut), np.arange(cut, len(sets))) if cut else (np.arange(len(sets)), None)
        made = ngram_join.Links(apart, np.array([len(s) for s in sets]), copies, left, right, 0.8)
        near = lambda a, b: a != b and (not cut or (a < cut) != (b < cut)) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9
        assert made.links.tolist() == [sum(copies[b] for b in range(len(sets)) if near(a, b)) for a in range(len(sets))]
        root = list(range(len(sets)))
        for _ in sets:
            root = [min([root[a], *(root[b] for b in range(len(sets)) if near(a, b))]) for a in range(len(sets))]
        assert made.root.tolist() == root


def test_edges_of_a_group_of_near_copies(spark):
    """About one edge a member, whatever the group's size, and the same components."""
    signer = ngram_join._signer(*ngram_join.choose_bands(0.8, 0.9999), 5)
    rows = near_copies(400)
    v, _, bands = signer([t.encode() for _, t in rows])
    banded = spark.createDataFrame([(a, int(b)) for a, x in zip(v, bands, strict=True) for b in x], "v long, band long").distinct()
    edges = [tuple(r) for r in ngram_join._stars(banded).collect()]
    assert len(edges) <= 1.5 * len(set(v))
    hubs = {}
    for a, x in zip(v, bands, strict=True):
        for b in x:
            hubs.setdefault(int(b), set()).add(a)

    def parts(groups):
        root = {x: x for x in v}
        while True:
            new = dict(root)
            for g in groups:
                low = min(new[x] for x in g)
                new.update({x: low for x in g})
            if new == root:
                return root
            root = new

    assert parts([set(e) for e in edges]) == parts(hubs.values())


def test_one_of_each_class_stays(documents, rows):
    got = ngram_join.one_of_each(documents)
    assert got.columns == documents.columns
    classes = {}
    for r, (doc, n, cls, _) in zip(sorted(rows, key=lambda r: str((r[0], 0))), brute(rows), strict=True):
        classes.setdefault((cls, doc if n == 0 else None), []).append(doc)
    want = sum(len(v) if k[1] is not None or all(d is None for d in v) else 1 for k, v in classes.items())
    kept = got.collect()
    assert len(kept) == want
    worded = [r["doc_id"] for r in kept if WORD.search(r["text"] or "")]
    assert len({d for d in worded}) == len(worded) or None in worded
