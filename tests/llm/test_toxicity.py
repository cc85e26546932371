import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillgrid.llm import toxicity


@pytest.fixture(scope="module")
def corpus(spark):
    """Two lexicons: a known insult, and words that start with a stem nobody else uses."""
    rng = random.Random(9)
    words = [f"{a}{b}{c}" for a in ("ba", "lo", "mi", "ter") for b in ("ran", "sto", "vel") for c in ("do", "ki", "nu", "sa")]
    rows, labels = [], []
    for k in range(1500):
        text = rng.choices(words, k=rng.randint(5, 60))
        toxic = k % 6 == 0
        if toxic:
            text.insert(rng.randrange(len(text)), rng.choice(["Idiot!", "worthless", f"grubz{rng.choice(words)}", f"Grubz{rng.choice(words)}."]))
        rows.append((k, " ".join(text), "zz" if toxic else "yy"))
        if k % 10:
            labels.append((k, 1, int(toxic)))
    rows += [(5000, None, None), (5001, "", "q"), (None, "idiot", "q"), (3, rows[3][1], "q")]
    labels += [(None, 1, 1), (3, 0, None), (777777, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(corpus):
    docs, labels = corpus
    model = toxicity.fit(docs, labels)
    made = toxicity.score(docs, model, "s").select("doc_id", "text", "s", toxicity.held_out(F.col("doc_id")).alias("held")).collect()
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = [r for r in made if r["held"]]
    assert all(r["held"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in made)
    right = [(r["s"] >= 0.5) == truth[r["doc_id"]] for r in held if truth.get(r["doc_id"]) is not None]
    assert np.mean(right) >= 0.98
    assert all(0 <= r["s"] <= 1 for r in made)
    by = {r["doc_id"]: r["s"] for r in made}
    assert by[5000] == by[5001] < 0.5 and by[None] >= 0.5


def test_fit_is_repeatable_and_ignores_held_out_labels(corpus, spark):
    docs, labels = corpus
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs.repartition(5), flipped)
    assert a.voters == b.voters and np.allclose(a.weights, b.weights) and a.bias == b.bias


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.2
    votes = np.column_stack([np.where(y, rng.random(4000) < p, rng.random(4000) < q) for p, q in ((0.6, 0.01), (0.5, 0.02), (0.4, 0.3))]).astype(np.float32)
    votes = np.column_stack([votes, votes[:, 0]])  # a copy of a voter adds nothing
    belief, accuracy, corr = toxicity.label_model(votes, (rng.random(4000) < 0.9) == y, 0.2)
    assert ((belief >= 0.5) == y).mean() > 0.93
    assert accuracy[0] > accuracy[2] and corr[0, 3] > 0.9


def test_no_labels_and_no_documents(corpus, nothing, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit(corpus[0], none)
    assert model.scores(["you idiot", "hello"])[0] >= 0.5 > model.scores(["", "hello"])[1]
    assert toxicity.score(nothing, toxicity.fit(nothing, corpus[1]), "s").count() == 0


def test_a_capped_sample_means_what_all_labels_mean(spark):
    """A word that is toxic four times in five is no voter, however the classes are sampled."""
    rng = random.Random(4)
    words = [f"{a}{b}{c}" for a in ("ba", "lo", "mi", "ter") for b in ("ran", "sto", "vel") for c in ("do", "ki", "nu", "sa")]
    rows, labels = [], []
    for k in range(4000):
        toxic = k % 10 == 0
        text = rng.choices(words, k=20) + ["grubzen"] * (toxic and rng.random() < 0.6) + ["quorx"] * (rng.random() < (0.4 if toxic else 0.01))
        rows.append((k, " ".join(text)))
        labels.append((k, 1, int(toxic)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    every, capped = toxicity.fit(docs, known), toxicity.fit(docs, known, sample_clean=800)
    for model in (every, capped):
        assert any(v[1:4] == "gru" for v in model.voters) and not any(v[1:4] == "quo" for v in model.voters)
    assert abs(every.bias - capped.bias) < 0.3
    assert np.allclose(every.scores(["grubzen", "idiot", "batter"]), capped.scores(["grubzen", "idiot", "batter"]), atol=0.05)


def test_weights_stand_for_rows():
    rng = np.random.default_rng(1)
    y = rng.random(300) < 0.3
    votes = np.column_stack([np.where(y, rng.random(300) < 0.6, rng.random(300) < 0.05) for _ in range(3)]).astype(np.float32)
    times = np.where(y, 1, 4)
    a = toxicity.label_model(votes, y, 0.1, weight=times.astype(float))
    b = toxicity.label_model(np.repeat(votes, times, axis=0), np.repeat(y, times), 0.1)
    assert np.allclose(np.repeat(a[0], times), b[0], atol=1e-6) and np.allclose(a[1], b[1], atol=1e-6)
    x, z = toxicity.logistic(votes, a[0], ridge=0, weight=times.astype(float)), toxicity.logistic(np.repeat(votes, times, axis=0), np.repeat(a[0], times), ridge=0)
    assert np.allclose(x[0], z[0], atol=1e-4) and abs(x[1] - z[1]) < 1e-4


def test_repeated_ids_and_a_column_named_score(corpus, spark):
    docs, labels = corpus
    twice = docs.unionByName(docs).unionByName(docs.where("doc_id < 50"))
    a, b = toxicity.fit(docs, labels), toxicity.fit(twice, labels.unionByName(labels))
    assert a.voters == b.voters and np.allclose(a.weights, b.weights)
    made = toxicity.score(docs, a)
    assert made.columns == ["doc_id", "text", "score", "_score"]
    assert {r["score"] for r in made.collect()} == {"zz", "yy", None, "q"}


def test_votes_are_the_terms_of_a_text():
    rng = random.Random(6)
    words = ["grubzen", "grubzes", "Grubzal", "grub", "stone", "STONES", "mill", "millet", "été", "x1grubzen"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 30))) + rng.choice(["", ".", " pad" * 900]) for _ in range(200)] + ["", "grubzen" * 3]
    voters = sorted({t for x in texts for t in toxicity.terms(x)})
    assert any(v[0] == "+" for v in voters)
    votes = toxicity._votes(voters, texts)
    for row, text in zip(votes, texts, strict=True):
        assert {v for v, fired in zip(voters, row, strict=True) if fired} == toxicity.terms(text)


def test_a_start_that_only_repeats_in_toxic_text(spark):
    """Clean text has the start too, once in a while; long clean text has it often but thinly."""
    rng = random.Random(8)
    words = [f"{a}{b}{c}" for a in ("ba", "lo", "mi", "ter") for b in ("ran", "sto", "vel") for c in ("do", "ki", "nu", "sa")]
    rows, labels = [], []
    for k in range(1200):
        toxic, size = k % 8 == 0, 2500 if k % 40 == 1 else rng.randint(20, 200)
        text = rng.choices(words, k=size)
        for _ in range(rng.randint(2, 4) if toxic else 4 if size == 2500 else rng.random() < 0.15):
            text.insert(rng.randrange(len(text)), f"grubzen{rng.choice(words)}")
        rows.append((k, " ".join(text)))
        labels.append((k, 1, int(toxic)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, known)
    assert any(v.startswith("+grub") for v in model.voters) and not any(v.startswith("^grub") for v in model.voters)
    right = (model.scores([r[1] for r in rows]) >= 0.5) == np.array([r[2] == 1 for r in labels])
    assert right.mean() >= 0.98
