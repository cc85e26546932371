"""Toxicity by weak supervision: voters, a generative label model, a linear classifier."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, new_names

#: At most so many labelled rows, clean and toxic, are learned from; a seeded hash picks them.
SAMPLE_CLEAN, SAMPLE_TOXIC = 16_000, 4_000
#: At most so many voters; the least evidence (a likelihood ratio statistic) and precision of one.
VOTERS, EVIDENCE, PRECISION = 400, 18.0, 0.9
#: How often the label model takes a given label to be right.
TRUST = 0.9
#: Lengths of the word starts that are tried as patterns.
STARTS = (4, 5, 6, 7)
#: A start repeats in a text that has it in so many words at least, and in one word of so many.
REPEATS, ONE_IN = 2, 200

# Common insults, as voters that need no labelled rows.
INSULTS = (
    "bastard", "clown", "crap", "cretin", "cunt", "disgusting", "dumb", "filth", "filthy", "fool", "fuck", "fucking", "idiot", "imbecile",
    "jerk", "loser", "moron", "pathetic", "pig", "scum", "shit", "shut up", "stupid", "sucker", "trash", "ugly", "vermin", "worthless",
    "abschaum", "arschloch", "dreck", "dummkopf", "idioten", "scheisse", "scheiße", "schwachkopf", "trottel", "widerlich",
    "abruti", "connard", "crétin", "débile", "imbécile", "merde", "minable", "ordure", "pourriture", "salaud",
    "asqueroso", "basura", "cabrón", "escoria", "estúpido", "gilipollas", "imbécil", "mierda", "patético", "payaso",
)

_WORD = re.compile(r"[^\W\d_]+")


def terms(text: str) -> set[str]:
    """``=word`` for each word of a text in lower case, ``^start`` for the starts of words, ``+start`` for those that repeat.

    A start that clean text has now and then, by chance, may still mark a text that has
    it again and again; the rate that is asked for keeps long texts from having it by length.
    """
    words = Counter(_WORD.findall(text.lower()))
    out = {f"={w}" for w in words}
    for n in STARTS:
        starts: Counter = Counter()
        for w, k in words.items():
            if len(w) > n:
                starts[w[:n]] += k
        out.update(f"^{x}" for x in starts)
        out.update(f"+{x}" for x, k in starts.items() if _repeats(k, words.total()))
    return out


def _repeats(k: int, words: int) -> bool:
    return k >= REPEATS and k * ONE_IN >= words


@dataclass
class Model:
    """Voters with the weights of the linear classifier."""

    voters: list[str]
    weights: np.ndarray
    bias: float
    accuracy: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def votes(self, texts: list[str]) -> np.ndarray:
        return _votes(self.voters, texts)

    def scores(self, texts: list[str]) -> np.ndarray:
        return _sigmoid(_features(self.votes(texts)) @ self.weights + self.bias)


_machines: dict[tuple, object] = {}


def _machine(voters: list[str]):
    import ahocorasick

    key = tuple(voters)
    if key not in _machines:
        _machines.clear()
        machine = ahocorasick.Automaton()
        by_text: dict[str, list] = {}
        for k, v in enumerate(voters):
            by_text.setdefault(v[1:], []).append((k, v[0]))
        for text, marks in by_text.items():
            machine.add_word(text, (len(text), marks))
        if by_text:
            machine.make_automaton()
        _machines[key] = machine
    return _machines[key]


def _letter(c: str) -> bool:
    return c.isalpha()


def _votes(voters: list[str], texts: list[str]) -> np.ndarray:
    """Which voters find their word, or start of a word, once or repeated, in each text; the others abstain."""
    out = np.zeros((len(texts), len(voters)), dtype=np.float32)
    machine = _machine(voters)
    if not len(machine):
        return out
    for row, text in enumerate(texts):
        low = text.lower()
        seen: Counter = Counter()
        for stop, (size, marks) in machine.iter(low):
            start = stop - size + 1
            if start and _letter(low[start - 1]):
                continue
            whole = stop + 1 >= len(low) or not _letter(low[stop + 1])
            for k, kind in marks:
                if whole == (kind == "="):
                    if kind == "+":
                        seen[k] += 1
                    else:
                        out[row, k] = 1
        if seen and max(seen.values()) >= REPEATS:
            words = len(_WORD.findall(low))
            for k, times in seen.items():
                out[row, k] = _repeats(times, words)
    return out


def _features(votes: np.ndarray) -> np.ndarray:
    """The votes, and whether there is any."""
    return np.column_stack([votes, votes.any(axis=1)])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def label_model(votes: np.ndarray, given: np.ndarray, prior: float, rounds: int = 30, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of each row's label, each voter's accuracy, and the voters' correlations.

    A label drawn with ``prior`` makes each voter fire with a probability of its own for
    either value. ``given``, the label that came with the row, is one more voter, taken
    to be right ``TRUST`` of the time: voters that all speak for toxic text leave open how
    often they are wrong. Expectation maximisation starts from "any vote means toxic".
    Votes that are correlated within a label count less: each voter's log odds are divided by
    the sum of its correlations with all voters, so a group of voters that always fire
    together weighs as one. ``weight`` is how many rows each row stands for.
    """
    n, m = votes.shape
    weight = np.ones(n) if weight is None else weight
    fired = votes.any(axis=1)
    belief = np.where(fired, 0.9, 0.02)
    trusted = np.where(given > 0, 1, -1) * math.log(TRUST / (1 - TRUST))
    corr = np.eye(m)
    hit = np.full(m, 0.5)
    for _ in range(rounds):
        b1, b0 = weight * belief, weight * (1 - belief)
        w1, w0 = b1.sum(), b0.sum()
        p1 = (b1 @ votes + 0.5) / (w1 + 1)
        p0 = (b0 @ votes + 0.05) / (w0 + 1)
        p0 = np.minimum(p0, p1 / 2)  # a voter speaks for toxic text, never against it
        centred = votes - np.outer(belief, p1) - np.outer(1 - belief, p0)
        cov = centred.T @ (centred * weight[:, None]) / max(1, weight.sum())
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        corr = np.clip(cov / np.outer(sd, sd), -1, 1)
        np.fill_diagonal(corr, 1)
        share = 1 / np.maximum(np.where(corr > 0.5, corr, 0).sum(axis=1), 1)
        # A voter that abstains says nothing; that none votes is a vote for clean text.
        none = math.log(((b1 @ ~fired) + 0.5) / (w1 + 1)) - math.log((b0 @ ~fired + 0.5) / (w0 + 1))
        odds = math.log(prior / (1 - prior)) + trusted + votes @ (share * np.log(p1 / p0)) + np.where(fired, 0, none)
        new = _sigmoid(odds)
        hit = (b1 @ votes) / np.maximum(weight @ votes, 1)
        if np.abs(new - belief).max(initial=0) < 1e-4:
            belief = new
            break
        belief = new
    return belief, hit, corr


def logistic(x: np.ndarray, target: np.ndarray, rounds: int = 30, ridge: float = 1e-5, weight: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Newton's method; ``ridge`` is per row, ``weight`` how many rows each stands for."""
    n, m = x.shape
    weight = np.ones(n) if weight is None else weight
    x1 = np.column_stack([x, np.ones(n)]).astype(np.float64)
    w, penalty = np.zeros(m + 1), n * np.append(np.full(m, ridge), 1e-9)
    for _ in range(rounds):
        p = _sigmoid(x1 @ w)
        slope = x1.T @ (weight * (target - p)) - penalty * w
        step = np.linalg.solve((x1 * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x1 + np.diag(penalty), slope)
        step *= min(1, 5 / max(1e-9, np.abs(step).max()))
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w[:m], float(w[m])


def held_out(doc_id: Column) -> Column:
    """True for ids whose CRC-32, as text, is divisible by five; a null id is not held out."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def fit(
    documents: DataFrame,
    labels: DataFrame,
    *,
    sample_clean: int = SAMPLE_CLEAN,
    sample_toxic: int = SAMPLE_TOXIC,
    seed: int = 20240229,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
) -> Model:
    """Learn from labelled rows that are not held out, ``sample_clean`` and ``sample_toxic`` at most.

    The sampled ids (their number is the bound, so they are broadcast) pick their texts;
    tasks count in how many toxic and clean texts each word and start of a word occurs.
    Terms with enough evidence for toxic text are pattern voters beside the fixed
    lexicon. Only their votes on the sample, one byte each, reach the driver, where the
    label model and the classifier are fitted.

    The classes are sampled apart, so each sampled row stands for as many labelled rows as
    its class has for each one sampled: precision, prior, label model and classifier are
    those of all labels at every size. Evidence is that of the rows really read.

    A null id or label teaches nothing; an id labelled both ways counts as toxic; of the
    rows of a repeated id one text, the least, is read, so the sample keeps its bound. A
    null text is empty; texts are read whole; further columns are not read. Where no label
    meets a text, the fixed lexicon votes with equal weights.
    """
    known = labels.select(F.col(doc_id).cast("long").alias("id"), F.col(label).cast("int").alias("y")).dropna().where(~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.max("y").alias("y")).withColumn("draw", F.xxhash64(F.lit(seed), "id"))
    size = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    stands = [max(1.0, size.get(y, 0) / max(1, most)) for y, most in ((0, sample_clean), (1, sample_toxic))]
    clean = known.where("y = 0").orderBy("draw", "id").limit(sample_clean)
    toxic = known.where("y = 1").orderBy("draw", "id").limit(sample_toxic)
    picked = clean.unionByName(toxic).select("id", "y")
    texts = documents.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sample = texts.join(F.broadcast(picked), "id").groupBy("id").agg(F.first("y").alias("y"), F.min("text").alias("text")).select("y", "text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: tuple[Counter, Counter] = (Counter(), Counter())
        n = [0, 0]
        for batch in batches:
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by[y > 0].update(terms(t))
                n[y > 0] += 1
        both = ["", *(by[1] | by[0])]
        yield pa.RecordBatch.from_arrays(
            [pa.array(both), pa.array([n[1], *[by[1][k] for k in both[1:]]], pa.int64()), pa.array([n[0], *[by[0][k] for k in both[1:]]], pa.int64())],
            names=["term", "toxic", "clean"],
        )

    counts = checkpointed(sample.mapInArrow(counted, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    totals = counts.where("term = ''").first()
    n1, n0 = (totals["toxic"], totals["clean"]) if totals else (0, 0)
    voters = [f"={w}" for w in INSULTS]
    if n1 and n0:
        k1, k0 = F.col("toxic").cast("double"), F.col("clean").cast("double")
        part = lambda k, n, r: F.when(k > 0, k * F.log(k / (n * r))).otherwise(0.0)
        rate = (k1 + k0) / float(n1 + n0)
        gain = 2 * (
            part(k1, float(n1), rate) + part(k0, float(n0), rate) + part(n1 - k1, float(n1), 1 - rate) + part(n0 - k0, float(n0), 1 - rate)
        )
        precision = k1 * stands[1] / (k1 * stands[1] + (k0 + 1) * stands[0])
        good = counts.where((F.col("term") != "") & (k1 >= 3) & (precision >= PRECISION) & (rate < 1)).withColumn("gain", gain).where(F.col("gain") >= EVIDENCE)
        # A voter whose word has a start that votes already would never vote alone.
        starts: dict[str, set[str]] = {"^": set(), "+": set()}
        for row in good.orderBy(F.desc("gain"), F.length("term"), "term").limit(20 * VOTERS).collect():
            kind, word = row["term"][0], row["term"][1:]
            known = starts["^"] | starts["+"] if kind == "+" else starts["^"]
            if len(voters) < VOTERS and not any(word[:n] in known for n in STARTS if n < len(word) or kind != "="):
                voters.append(row["term"])
                if kind != "=":
                    starts[kind].add(word)
    voters = list(dict.fromkeys(voters))

    def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes = _votes(voters, batch.column(1).to_pylist()).astype(bool)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.packbits(v).tobytes() for v in votes], pa.binary())], names=["y", "votes"])

    # Sorted: the fit is the same whatever order the tasks end in.
    rows = sorted((r["y"], bytes(r["votes"])) for r in sample.mapInArrow(voted, "y int, votes binary").collect())
    if not rows:
        return Model(voters, np.append(np.full(len(voters), 2.0), 4.0), -4.0)
    votes = np.array([np.unpackbits(np.frombuffer(r[1], dtype=np.uint8), count=len(voters)) for r in rows], dtype=np.float32)
    given = np.array([r[0] for r in rows])
    weight = np.where(given > 0, stands[1], stands[0])
    prior = min(0.5, max(0.01, float(weight[given > 0].sum() / weight.sum())))
    weight = weight / weight.mean()  # the constants of the fits are meant for so many rows
    belief, accuracy, _ = label_model(votes, given, prior, weight=weight)
    weights, bias = logistic(_features(votes), belief, weight=weight)
    return Model(voters, weights, bias, accuracy)


def score(documents: DataFrame, model: Model, name: str = "score", text: str = "text") -> DataFrame:
    """``documents`` and the score of each whole text, from 0 to 1.

    A null text is an empty one: it scores by the classifier's bias alone. Nothing but
    the text is read, so equal texts, repeated rows among them, have equal scores; long
    texts are read whole. An empty table gives no rows. Where ``documents`` has a column
    ``name`` already, the score's name gets a leading underscore.
    """
    (name,) = new_names(documents, name)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores([t or "" for t in texts]), dtype="float64")

    return documents.withColumn(name, scored(F.col(text)))
