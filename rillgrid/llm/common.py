"""What the corpus operators share: checkpoints, sized joins, components, byte blocks."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: A table is broadcast only if it has been counted and has at most so many rows.
BROADCAST_ROWS = 100_000


#: Rows of whole texts are large: batches of fewer rows keep a task's buffers at a few MB.
LONG_ROWS = {"spark.sql.parquet.columnarReaderBatchSize": ("4096", "256"), "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000")}


def long_rows(spark: SparkSession) -> None:
    """Set the sizes of LONG_ROWS where they are still Spark's own."""
    for key, (usual, own) in LONG_ROWS.items():
        if spark.conf.get(key, usual) == usual:
            spark.conf.set(key, own)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    long_rows(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Rows of a checkpoint file, where their number is known beforehand.
FILE_ROWS = 50_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``.

    A local one is made only where that is unset and the session runs on this machine
    alone, as in tests; on a cluster executors would not see it, so that is refused.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = sc.getConf().get("spark.checkpoint.dir", None)
        if where is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            where = tempfile.mkdtemp(prefix="rillgrid-checkpoint-")
        sc.setCheckpointDir(where)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame, small: bool = False, rows: int | None = None, spread: bool = False) -> DataFrame:
    """``df`` computed once, its lineage cut, in the folder that all executors share.

    A ``small`` table, of sums over much larger ones, is kept in fewer files; so is one
    of about ``rows`` rows, in as many as they need. ``spread`` shuffles the rows to
    these files, so that the work above keeps all its tasks. Spark removes the files
    when nothing refers to them any more.
    """
    checkpoint_dir(df.sparkSession)
    most = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    files = max(8, most // 16) if small else most if rows is None else min(most, rows // FILE_ROWS + 1)
    if small or rows is not None:
        df = df.repartition(files) if spread else df.coalesce(files)
    return df.checkpoint(eager=True)


def new_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def shards(spark: SparkSession, n_bytes: int, target: int = 32 << 20) -> int:
    """How many shards to deal ``n_bytes`` to, so that each stays near ``target`` bytes."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(n_bytes) // target))


def total_bytes(df: DataFrame, text: str) -> int:
    return df.agg(F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0)).alias("n")).first()["n"]


def join_sized(left: DataFrame, small: DataFrame, key: str, spread: Column, ways: int = 32) -> DataFrame:
    """Inner join on ``key`` of a large side with a table of one row per key.

    ``small`` is counted: up to ``BROADCAST_ROWS`` it is broadcast; beyond that each
    of its rows is repeated for ``ways`` salts and the large side, salted by
    ``spread``, is shuffled, so that a key with a third of the rows still spreads.
    """
    if small.count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(small), key)
    salt = f"_salt_{uuid.uuid4().hex[:8]}"
    wide = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(ways - 1))))
    return left.withColumn(salt, F.pmod(spread, F.lit(ways)).cast("int")).join(wide, [key, salt]).drop(salt)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``: rows ``(v, root)``, ``root`` the least member.

    Minimum labels pass along the edges and then jump to the label's own label; each
    round is checkpointed, and the rounds end when no label changes. Nothing but one
    count per round reaches the driver. Loops are allowed; an empty table gives none.
    """
    both = checkpointed(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    )
    rows = both.count()
    labels = checkpointed(both.groupBy(F.col("a").alias("v")).agg(F.least(F.first("a"), F.min("b")).alias("root")), rows=rows)
    while True:
        heard = (
            both.join(labels, both.b == labels.v)
            .groupBy("a")
            .agg(F.min("root").alias("near"))
            .select(F.col("a").alias("v"), "near")
        )
        step = labels.join(heard, "v", "left").select(
            "v", F.col("root").alias("old"), F.least("root", F.coalesce("near", "root")).alias("root")
        )
        step = checkpointed(step, rows=rows)
        jump = step.select(F.col("v").alias("root"), F.col("root").alias("far"))
        new = checkpointed(
            step.join(jump, "root", "left").select("v", "old", F.least("root", F.coalesce("far", "root")).alias("root")), rows=rows
        )
        moved = new.where(F.col("root") != F.col("old")).limit(1).count()
        labels = new.select("v", "root")
        if not moved:
            return labels


def tidy() -> None:
    """Give back to the system what a task has freed: workers live on and share an executor's memory."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidied(run: Callable) -> Callable:
    """A task's function that tidies up after its last batch."""

    @functools.wraps(run)
    def then_tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        tidy()

    return then_tidy


# --- byte blocks -----------------------------------------------------------------------------

#: A block holds about so many bytes of whole texts.
BLOCK_BYTES = 1 << 20

BLOCK_SCHEMA = "block_id long, n_docs int, ids binary, known binary, ends binary, data binary, rest binary"


def _pack(batches: Iterator[pa.RecordBatch], size: int, level: int = 5) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    first, n = TaskContext.get().partitionId() << 32, 0
    pressed = zstandard.ZstdCompressor(level=level)

    def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        nonlocal n
        ids = [i for p in parts for i in p.column(0).to_pylist()]
        texts = [t or b"" for p in parts for t in p.column(1).cast(pa.binary()).to_pylist()]
        known = np.array([i is not None for i in ids], dtype=np.uint8)
        raw = np.array([0 if i is None else i for i in ids], dtype=np.int64)
        ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        rest = pa.BufferOutputStream()
        if parts[0].num_columns > 2:
            kept = pa.Table.from_batches([p.select(range(2, p.num_columns)) for p in parts])
            with pa.ipc.new_stream(rest, kept.schema) as out:
                out.write_table(kept)
        n += 1
        return pa.RecordBatch.from_pydict({
            "block_id": pa.array([first + n - 1], pa.int64()),
            "n_docs": pa.array([len(ids)], pa.int32()),
            "ids": pa.array([raw.tobytes()], pa.binary()),
            "known": pa.array([known.tobytes()], pa.binary()),
            "ends": pa.array([ends.tobytes()], pa.binary()),
            "data": pa.array([pressed.compress(b"".join(texts))], pa.binary()),
            "rest": pa.array([rest.getvalue().to_pybytes()], pa.binary()),
        })

    parts, held = [], 0
    for batch in batches:
        sizes = np.cumsum(np.array(pc.fill_null(pc.binary_length(batch.column(1)), 0), dtype=np.int64))
        start = 0
        while start < batch.num_rows:
            done = int(sizes[start - 1]) if start else 0
            stop = min(batch.num_rows, int(np.searchsorted(sizes, done + size - held)) + 1)
            parts.append(batch.slice(start, stop - start))
            held += int(sizes[stop - 1]) - done
            start = stop
            if held >= size:
                yield block(parts)
                parts, held = [], 0
    if parts:
        yield block(parts)


def packed_blocks(documents: DataFrame, doc_id: str, text: str, *rest: str, size: int = BLOCK_BYTES, then: Callable | None = None, schema: str = BLOCK_SCHEMA) -> DataFrame:
    """``documents`` as rows of about ``size`` bytes of whole texts, compressed (``BLOCK_SCHEMA``).

    A null text is an empty one. ``known`` marks the ids that are not null. Columns
    ``rest`` go along unread. Blocks are numbered by input partition, so a table that
    reads alike twice makes the same blocks twice. ``then`` takes the blocks to rows of
    another ``schema`` in the same task, without a way through the JVM.
    """
    columns = [F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"), *[F.col(f"`{c}`") for c in rest]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _pack(batches, size) if then is None else then(_pack(batches, size, level=1))

    return documents.select(*columns).mapInArrow(tidied(run), schema)


class Block:
    """One row of ``blocks`` unpacked: ``data`` as uint8, ``ends`` and ``starts`` by document."""

    def __init__(self, row: dict):
        self.block_id = row["block_id"]
        self.ids = np.frombuffer(row["ids"], dtype=np.int64)
        self.known = np.frombuffer(row["known"], dtype=np.uint8).astype(bool)
        self.ends = np.frombuffer(row["ends"], dtype=np.int64)
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        size = int(self.ends[-1])
        self.rest = row["rest"]
        raw = zstandard.ZstdDecompressor().decompress(row["data"], max_output_size=max(1, size)) if size else b""
        self.data = np.frombuffer(raw, dtype=np.uint8)


# --- hashing of byte spans -------------------------------------------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def each_block(table: pa.Table) -> Iterator["Block"]:
    for row in table.to_pylist():
        yield Block(row)


def _power(base: np.uint64, n: int) -> np.ndarray:
    key = str(base)
    if key not in _powers or len(_powers[key]) < n:
        size = max(n, 1 << 16)
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        _powers[key] = np.multiply.accumulate(steps)
    return _powers[key][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """``p`` with ``span_hash(p, s, e)`` a 64-bit polynomial hash of ``data[s:e]``."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * _power(_BASE, len(data)), out=out[1:])
    return out


def power_back(n: int) -> np.ndarray:
    """What takes the place of a span out of its hash, for the first ``n`` places."""
    return _power(_INVERSE, n)


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mixed((prefix[end] - prefix[start]) * _power(_INVERSE, len(prefix))[start])


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share; it goes when the session's JVM ends."""
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path
