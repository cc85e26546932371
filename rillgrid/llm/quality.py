"""Quality by perplexity under an interpolated modified Kneser-Ney model of bytes.

Counts come from trusted text but what is kept out. Every block of texts sends its different n-grams
to shards of the hash space, where they meet the model's probabilities, and gets those
back; so the model is never in one place and a frequent n-gram is one entry per block.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Block, checkpointed, packed_blocks, shards, total_bytes

#: Bytes of an n-gram (5 at most fit the lists), and of the alphabet.
ORDER, BYTES = 5, 256
#: Trusted ids are broadcast up to so many; more are joined by shuffle.
TRUSTED_IDS = 1_000_000
#: One trusted document in so many is not trained on but sets the thresholds.
KEPT_OUT = 5
#: The quantile of the trusted documents' perplexity above which a document goes, and the
#: standard errors by which a text must be above it.
QUANTILE, ERRORS = 0.99, 0.0
#: Bytes from which a text is of the next length class: a short text's perplexity strays more.
LENGTHS = (100, 300)


def grams(block: Block, order: int, docs: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each byte of a block's texts, and the bytes of each text.

    A gram is its bytes as one number, the last byte lowest; before a text come zeros.
    ``docs`` picks texts by place.
    """
    starts, ends = block.starts, block.ends
    if docs is not None:
        starts, ends = starts[docs], ends[docs]
    size = ends - starts
    total = int(size.sum())
    place = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
    at = np.repeat(starts, size) + place
    key = np.zeros(total, dtype=np.int64)
    for back in range(order):
        byte = block.data[np.maximum(at - back, 0)].astype(np.int64)
        byte[place < back] = 0
        key |= byte << (8 * back)
    return key, size


def _press(values: np.ndarray) -> bytes:
    """Numbers compressed with their bytes sorted by place, as high bytes are much alike."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes).tobytes())


def _unpress(data: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys, sorted, and which of them each key is. Hashing beats sorting all keys."""
    code, some = pd.factorize(keys)
    order = np.argsort(some)
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    return some[order], rank[code]


def _shard(gram, n: int):
    """Alike for a Column and a numpy array."""
    if isinstance(gram, Column):
        return (gram.bitwiseXOR(F.shiftright(gram, 17)) % n).cast("int")
    return (gram ^ (gram >> 17)) % n


def _counted(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                train = np.array(pa.ipc.open_stream(block.rest).read_all().column(0).to_pylist(), dtype=bool)
                key, at = distinct(grams(block, order, np.flatnonzero(train))[0])
                n = np.bincount(at, minlength=len(key))
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(n, pa.int64())], names=["gram", "n"])

    return run


def _asked(order: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                key = distinct(grams(block, order)[0])[0]
                where = _shard(key, n)
                by = np.argsort(where, kind="stable")
                there, first = np.unique(where[by], return_index=True)
                lists = np.split(key[by], first[1:]) if len(there) else []
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(there, pa.int32()),
                        pa.array([block.block_id] * len(lists), pa.int64()),
                        pa.array([_press(np.diff(x, prepend=0)) for x in lists], pa.binary()),
                    ],
                    names=["shard", "block_id", "list"],
                )

    return run


def _needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different grams of the lists of one task."""
    for batch in batches:
        seen = [np.cumsum(_unpress(x, "<i8")) for x in batch.column(0).to_pylist()]
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(seen)), pa.int64())], names=["gram"])


def _answered(left: pa.Table, right: pa.Table) -> pa.Table:
    key, logp = right.column("gram").to_numpy(), right.column("logp").to_numpy().astype("<f4")
    order = np.argsort(key)
    key, logp = key[order], logp[order]
    rows = left.to_pylist()
    lists = [np.cumsum(_unpress(r["list"], "<i8")) for r in rows]
    return pa.table({
        "block_id": pa.array([r["block_id"] for r in rows], pa.int64()),
        "shard": pa.array([r["shard"] for r in rows], pa.int32()),
        "logp": pa.array([_press(logp[np.searchsorted(key, x)]) for x in lists], pa.binary()),
    })


def _scored(order: int, n: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        by_shard = dict(zip(right.column("shard").to_pylist(), right.column("logp").to_pylist(), strict=True))
        out = []
        for row in left.to_pylist():
            block = Block(row)
            key, size = grams(block, order)
            known, at = distinct(key)
            where = _shard(known, n)
            logp = np.empty(len(known))
            for s in np.unique(where):
                logp[where == s] = _unpress(by_shard[int(s)], "<f4")
            each = logp[at]
            stop = np.cumsum(size)
            sums = np.concatenate([[0.0], np.cumsum(each)])
            squares = np.concatenate([[0.0], np.cumsum(each * each)])
            some = np.maximum(size, 1)
            mean = (sums[stop] - sums[stop - size]) / some
            spread = np.sqrt(np.maximum((squares[stop] - squares[stop - size]) / some - mean * mean, 0))
            empty = size == 0
            rest = pa.ipc.open_stream(block.rest).read_all()
            ids = pa.array([int(i) if k else None for i, k in zip(block.ids, block.known, strict=True)], pa.int64())
            out.append(pa.table({
                "doc_id": ids, "lang": rest.column(1), "trusted": rest.column(2), "train": rest.column(0), "n_bytes": pa.array(size, pa.int64()),
                "log_perplexity": pa.array(-mean, pa.float64(), mask=empty), "error": pa.array(spread / np.sqrt(some), pa.float64(), mask=empty),
            }))
        return pa.concat_tables(out)

    return run


SCORED = "doc_id long, lang string, trusted boolean, train boolean, n_bytes long, log_perplexity double, error double"


def _discounts(counts: DataFrame) -> list[float]:
    """What is taken off counts of 0, 1, 2, and 3 or more, from how many n-grams have 1 to 4."""
    a = F.col("a")
    n1, n2, n3, n4 = counts.agg(*[F.count_if(a == k) for k in (1, 2, 3, 4)]).first()
    if not (n1 and n2 and n3):
        return [0.0, 0.5, 0.75, 0.9]
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return [0.0, *(min(max(d, 0.05), k) for k, d in enumerate(raw, 1))]


def log_probabilities(counts: DataFrame, wanted: DataFrame, order: int) -> DataFrame:
    """``gram, logp`` for every gram of ``wanted``, by modified Kneser-Ney with interpolation.

    ``counts(gram, n)`` are the n-grams of trusted text. The highest order uses counts,
    each lower one the number of different bytes before an n-gram; discounts depend
    on the count (1, 2, more). What a context gives away goes to the next lower order,
    the last to all bytes alike; a context that was never seen gives all away.
    """
    a, mask = F.col("a"), lambda k: (1 << 8 * k) - 1
    have = {order: counts.select(F.col("gram"), F.col("n").alias("a"))}
    for k in range(order - 1, 0, -1):
        have[k] = checkpointed(have[k + 1].groupBy(F.col("gram").bitwiseAND(F.lit(mask(k))).alias("gram")).agg(F.count("*").alias("a")), small=True)
    lower = None
    for k in range(1, order + 1):
        d = _discounts(have[k])
        less = F.element_at(F.array(*[F.lit(x) for x in d]), F.least(a, F.lit(3)).cast("int") + 1)
        context = have[k].groupBy(F.shiftright("gram", 8).alias("context")).agg(F.sum("a").cast("double").alias("all"), F.sum(less).alias("off"))
        need = wanted if k == order else wanted.select(F.col("gram").bitwiseAND(F.lit(mask(k))).alias("gram")).distinct()
        rows = need.join(have[k], "gram", "left").withColumns({"context": F.shiftright("gram", 8), "a": F.coalesce("a", F.lit(0))}).join(context, "context", "left")
        own = F.greatest(a - less, F.lit(0.0)) / F.col("all")
        if lower is None:
            rows = rows.withColumn("below", F.lit(1 / BYTES))
        else:
            below = lower.select(F.col("gram").alias("tail"), F.col("p").alias("below"))
            rows = rows.withColumn("tail", F.col("gram").bitwiseAND(F.lit(mask(k - 1)))).join(below, "tail")
        p = F.when(F.col("all").isNull(), F.col("below")).otherwise(own + F.col("off") / F.col("all") * F.col("below"))
        lower = rows.select("gram", p.alias("p"))
    return lower.select("gram", F.log("p").alias("logp"))


def score(
    documents: DataFrame, labels: DataFrame, *, order: int = ORDER, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", quality: str = "quality"
) -> DataFrame:
    """One row per document: ``doc_id, lang, trusted, train, n_bytes, log_perplexity, error``.

    Documents whose label says quality 1 are trusted; all but one in ``KEPT_OUT`` of
    them, by a hash of the id, are trained on. ``log_perplexity`` is the mean of minus
    the log of a byte's probability over the whole text, ``error`` its standard error;
    both are null for an empty text. A null or unlabelled id is not trusted. Blocks are
    made afresh in each of three passes over the table, which must read alike each time.
    """
    spark = documents.sparkSession
    good = labels.where(F.col(quality) == 1).select(F.col(doc_id).cast("long").alias("doc_id")).dropna().distinct().withColumn("good", F.lit(True))
    if good.count() <= TRUSTED_IDS:
        good = F.broadcast(good)
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).join(good, "doc_id", "left")
    trusted = F.coalesce("good", F.lit(False))
    train = trusted & (F.pmod(F.xxhash64("doc_id"), F.lit(KEPT_OUT)) != 0)
    rows = rows.select("doc_id", "text", train.alias("train"), "lang", trusted.alias("trusted"))
    blocks = functools.partial(packed_blocks, rows, "doc_id", "text", "train", "lang", "trusted", size=4 << 20)
    n = shards(spark, total_bytes(rows, "text") // 8)
    counts = checkpointed(blocks(then=_counted(order), schema="gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")), small=True)
    asked = checkpointed(blocks(then=_asked(order, n), schema="shard int, block_id long, list binary"))
    wanted = checkpointed(asked.select("list").mapInArrow(_needed, "gram long").distinct(), small=True)
    model = log_probabilities(counts, wanted, order).withColumn("shard", _shard(F.col("gram"), n))
    answers = asked.groupBy("shard").cogroup(model.groupBy("shard")).applyInArrow(_answered, "block_id long, shard int, logp binary")
    return blocks().groupBy("block_id").cogroup(answers.groupBy("block_id")).applyInArrow(_scored(order, n), SCORED)


def classify(documents: DataFrame, labels: DataFrame, *, quantile: float = QUANTILE, errors: float = ERRORS, **options) -> DataFrame:
    """The columns of ``score`` but ``train``, with ``threshold`` and ``keep``.

    Texts are judged by language and length class (``LENGTHS``). The threshold is the
    quantile of the perplexity of the trusted documents of both that were not trained on;
    where there are none, of those of the language, then of all; without labels there is
    no threshold. It is never below the quantile over all trusted documents of that
    language and class, as a few kept out say little of a tail. A text goes if its
    perplexity, less ``errors`` standard errors, is above the threshold; empty texts
    stay. A null language is a language of its own; an empty table gives no rows.
    """
    rows = checkpointed(score(documents, labels, **options))
    length = F.size(F.filter(F.array(*[F.lit(n) for n in LENGTHS]), lambda n: n <= F.col("n_bytes")))
    rows = rows.withColumn("length", length)
    judged = rows.where("trusted and log_perplexity is not null")
    at = lambda x: F.percentile_approx(x, F.lit(quantile), F.lit(10_000))
    kept_out = F.when(~F.col("train"), F.col("log_perplexity"))
    by_class = judged.groupBy(F.col("lang").alias("of"), F.col("length").alias("long")).agg(at(kept_out).alias("own"), at(F.col("log_perplexity")).alias("least"))
    by_lang = judged.groupBy(F.col("lang").alias("of_any")).agg(at(kept_out).alias("any"))
    every = judged.agg(at(kept_out).alias("every")).first()["every"]
    whole = rows.join(by_class, rows.lang.eqNullSafe(by_class.of) & (F.col("length") == F.col("long")), "left")
    whole = whole.join(by_lang, rows.lang.eqNullSafe(by_lang.of_any), "left")
    threshold = F.greatest(F.coalesce("own", "any", F.lit(every).cast("double")), "least")
    keep = F.coalesce(F.col("log_perplexity") - F.lit(errors) * F.col("error") <= threshold, F.lit(True))
    return whole.select("doc_id", "lang", "trusted", "n_bytes", "log_perplexity", "error", threshold.alias("threshold"), keep.alias("keep"))
