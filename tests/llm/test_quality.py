import math
from collections import Counter, defaultdict

import pytest

from rillgrid.llm import quality


def model(texts, order):
    """Modified Kneser-Ney by dictionaries."""
    counts = {order: Counter()}
    for t in texts:
        padded = b"\0" * (order - 1) + t
        counts[order].update(padded[k : k + order] for k in range(len(t)))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    tables = {}
    for k in range(1, order + 1):
        n1, n2, n3, n4 = (sum(v == j for v in counts[k].values()) for j in (1, 2, 3, 4))
        if n1 and n2 and n3:
            y = n1 / (n1 + 2 * n2)
            raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
            d = [0.0, *(min(max(x, 0.05), j) for j, x in enumerate(raw, 1))]
        else:
            d = [0.0, 0.5, 0.75, 0.9]
        total, off = Counter(), defaultdict(float)
        for g, n in counts[k].items():
            total[g[:-1]] += n
            off[g[:-1]] += d[min(n, 3)]
        tables[k] = (counts[k], d, total, off)

    def p(g):
        if not g:
            return 1 / 256
        c, d, total, off = tables[len(g)]
        below = p(g[1:])
        if not total[g[:-1]]:
            return below
        n = c[g]
        return max(n - d[min(n, 3)], 0) / total[g[:-1]] + off[g[:-1]] / total[g[:-1]] * below

    return p


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, int(k % 3 != 0)) for k in range(60)] + [(None, 1), (1, 1), (999, 1)], "doc_id long, quality int")


def test_perplexity_against_dictionaries(documents, labels):
    order = 4
    got = quality.score(documents, labels, order=order).collect()
    p = model([(r["text"] or "").encode() for r in documents.join(documents.sparkSession.createDataFrame([(r["doc_id"],) for r in got if r["train"]], "doc_id long").distinct(), "doc_id").collect()], order)
    texts = defaultdict(list)
    for r in documents.collect():
        texts[r["doc_id"]].append((r["text"] or "").encode())
    assert any(r["train"] for r in got) and any(r["trusted"] and not r["train"] for r in got)
    for r in got:
        want = []
        for t in texts[r["doc_id"]]:
            padded = b"\0" * (order - 1) + t
            want.append(-sum(math.log(p(padded[k : k + order])) for k in range(len(t))) / len(t) if t else None)
        if r["log_perplexity"] is None:
            assert None in want
        else:
            assert any(w is not None and abs(w - r["log_perplexity"]) < 1e-5 for w in want)


def test_probabilities_sum_to_one():
    p = model([b"abracadabra", b"abba", b"cabbage"], 3)
    for context in (b"ab", b"ra", b"zz", b"\0a"):
        assert abs(sum(p(context + bytes([w])) for w in range(256)) - 1) < 1e-9


def test_junk_goes_and_clean_text_stays(spark):
    import random

    rng = random.Random(2)
    words = ["river", "stone", "cloud", "winter", "garden", "letter", "window"]
    clean = lambda: " ".join(rng.choices(words, k=40))
    rows = [(k, clean(), "en") for k in range(150)] + [(1000 + k, "".join(rng.choices("#$%&@!xqzk", k=200)), "en") for k in range(10)]
    rows += [(2000, "", "en"), (2001, None, None), (2002, clean(), "xx")]
    labels = spark.createDataFrame([(k, 1) for k in range(100)], "doc_id long, quality int")
    got = {r["doc_id"]: r["keep"] for r in quality.classify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), labels).collect()}
    assert not any(got[1000 + k] for k in range(10))
    assert sum(got[k] for k in range(150)) >= 147 and got[2000] and got[2001] and got[2002]


def test_without_labels_or_documents(documents, labels, nothing, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert all(r["keep"] for r in quality.classify(documents, none).collect())
    assert quality.classify(nothing, labels).count() == 0


def test_short_junk_goes_too(spark):
    import random

    rng = random.Random(5)
    words = ["river", "stone", "cloud", "winter", "garden", "letter", "window"]
    clean = lambda n: " ".join(rng.choices(words, k=n))
    rows = [(k, clean(rng.randint(4, 40)), "en") for k in range(600)] + [(1000 + k, clean(3) + "".join(rng.sample("#$%&@!", 3)), "en") for k in range(40)]
    labels = spark.createDataFrame([(k, 1) for k in range(500)], "doc_id long, quality int")
    got = {r["doc_id"]: r["keep"] for r in quality.classify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), labels).collect()}
    assert not any(got[1000 + k] for k in range(40))
    assert sum(got[k] for k in range(600)) >= 580
