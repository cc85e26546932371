import re
from collections import Counter, defaultdict

from rillgrid.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fill(sizes, weights, epochs):
    """Targets by rounds: whoever is above its cap stops there and the rest is shared again."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, target, free = sum(sizes.values()), {}, set(order)
    while True:
        share = {s: total * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if share[s] > epochs * sizes[s]}
        if not over:
            return {**target, **share}
        for s in over:
            target[s] = epochs * sizes[s]
            total -= target[s]
        free -= over


def test_mix_meets_targets_to_the_word(documents, rows):
    made = mixing.mix(documents, seed=1)
    assert made.columns[: len(documents.columns)] == documents.columns and "_size" in made.columns
    got = made.collect()
    assert len(got) == len(rows)
    sizes, taken = Counter(), defaultdict(int)
    for r in got:
        assert r["_size"] == len(WORD.findall(r["text"] or ""))
        assert r["taken"] <= 3 * r["_size"]
        sizes[r["source"]] += r["_size"]
        taken[r["source"]] += r["taken"]
    want = fill(sizes, (5, 2, 1), 3)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - want[r["source"]]) < 1e-6
    for s in sizes:  # rows that draw alike share a cut, rounded down
        assert abs(taken[s] - want[s]) <= 3
    again = mixing.mix(documents.repartition(5), seed=1).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_caps_and_nothing(spark, nothing):
    rows = [(k, "a b c d" if s == "a" else "w " * 100, s) for k, s in enumerate("abbbb")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r["source"]: r["target"] for r in got} == {"a": 12.0, "b": 392.0}
    assert [r["taken"] for r in got if r["source"] == "a"] == [12]
    assert mixing.mix(nothing).count() == 0


def test_mixed_documents_repeat_and_cut_texts(documents):
    plan = mixing.mix(documents).collect()
    got = mixing.mixed_documents(documents).collect()
    words = sum(len(WORD.findall(r["text"])) for r in got)
    assert words == sum(r["taken"] for r in plan)
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_large_tables_of_sources_are_joined_by_shuffle(documents, monkeypatch):
    from rillgrid.llm import common

    want = sorted(map(str, mixing.mix(documents).collect()))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    assert sorted(map(str, mixing.mix(documents).collect())) == want
