"""Near duplicates: a Jaccard join on word n-grams by MinHash banding."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, checkpointed, components, join_sized, mixed, new_names, prefix_hash, shards, span_hash, tidied, tidy

#: Members, and n-grams of all members, of a block of a candidate group.
MEMBERS, GRAMS = 1 << 14, 1 << 21
#: Pairs that are compared in step.
PAIRS = 1 << 21
#: Bytes of text hashed in step.
STEP = 2 << 20
#: Parts that the members of a large group are dealt to where they meet its base.
SALTS = 32

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def choose_bands(threshold: float, recall: float, most: int = 256) -> tuple[int, int]:
    """(bands, rows): the most rows a band can have, and the bands that then find a pair
    at the threshold with probability ``recall``, in ``most`` hashes or fewer.

    More rows mean fewer candidates below the threshold.
    """
    best = (1, 1)
    for rows in range(1, most + 1):
        hit = threshold**rows
        bands = 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - hit))
        if rows * bands > most:
            break
        best = (bands, rows)
    return best


def gram_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """The sorted 64-bit hashes of each text's different word n-grams.

    Words are runs of anything but ASCII white space. A text of fewer words than ``n``
    is one n-gram of all of them; one without words has none.
    """
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    if not len(data):
        return [np.zeros(0, dtype=np.uint64)] * len(texts)
    ends = np.cumsum(sizes)
    word = ~_SPACE[data]
    fresh = np.zeros(len(data) + 1, dtype=bool)  # a text starts or ends here
    fresh[ends] = True
    fresh[0] = True
    start = np.flatnonzero(word & (np.concatenate([[True], ~word[:-1]]) | fresh[:-1]))
    stop = np.flatnonzero(word & (np.concatenate([~word[1:], [True]]) | fresh[1:])) + 1
    hashes = span_hash(prefix_hash(data), start, stop)
    last = np.searchsorted(start, ends)
    out, first = [], 0
    odd = [np.uint64(2 * (0x9E3779B97F4A7C15 * (k + 1) % (1 << 63)) + 1) for k in range(n)]
    for stop_at in last:
        words = hashes[first:stop_at]
        first = stop_at
        if not len(words):
            out.append(np.zeros(0, dtype=np.uint64))
            continue
        m = min(n, len(words))
        total = words[: len(words) - m + 1] * odd[0]
        for k in range(1, m):
            total = total + words[k : len(words) - m + 1 + k] * odd[k]
        out.append(np.unique(mixed(total + np.uint64(m))))
    return out


def _signer(bands: int, rows: int, n: int):
    rng = np.random.default_rng(20240229)
    count = bands * rows
    xor = rng.integers(0, 1 << 32, count, dtype=np.uint32)
    odd = rng.integers(0, 1 << 31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    weight = rng.integers(0, 1 << 63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def signed(texts: list[bytes]) -> tuple[list, list, list]:
        sets = gram_sets(texts, n)
        size = np.array([len(s) for s in sets])
        full = np.flatnonzero(size)
        bandsets: list = [None] * len(sets)
        if len(full):
            x = (np.concatenate([sets[k] for k in full]) >> np.uint64(32)).astype(np.uint32)
            at = np.concatenate([[0], np.cumsum(size[full])[:-1]])
            least = np.empty((len(full), count), dtype=np.uint64)
            y, z = np.empty_like(x), np.empty_like(x)
            for k in range(count):
                np.bitwise_xor(x, xor[k], out=y)
                np.multiply(y, odd[k], out=y)
                np.right_shift(y, np.uint32(15), out=z)
                np.bitwise_xor(y, z, out=y)
                np.multiply(y, np.uint32(0x2C1B3C6D), out=y)
                np.right_shift(y, np.uint32(12), out=z)
                np.bitwise_xor(y, z, out=y)
                least[:, k] = np.minimum.reduceat(y, at)
            band = (least.reshape(len(full), bands, rows) * weight).sum(axis=2, dtype=np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
            for k, b in zip(full, mixed(band).view(np.int64), strict=True):
                bandsets[k] = b
        digests = [int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) if len(s) else None for s in sets]
        return digests, size.tolist(), bandsets

    return signed


def _stepped(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in batches of about STEP bytes of text."""
    for batch in batches:
        sizes = np.cumsum(np.array(pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0), dtype=np.int64))
        start = 0
        while start < batch.num_rows:
            done = int(sizes[start - 1]) if start else 0
            stop = min(batch.num_rows, int(np.searchsorted(sizes, done + STEP)) + 1)
            yield batch.slice(start, stop - start)
            start = stop


def signatures(documents: DataFrame, doc_id: str, text: str, bands: int, rows: int, n: int) -> DataFrame:
    """``row_key, doc_id, v, n_grams, bands`` of each row.

    ``v`` is a 64-bit digest of the whole n-gram set, so copies share it; it is null
    where there are no n-grams. ``row_key`` is a hash of id and text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signed = _signer(bands, rows, n)
        for batch in _stepped(batches, 2):
            v, size, band = signed([t or b"" for t in batch.column(2).cast(pa.binary()).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(v, pa.int64()), pa.array(size, pa.int32()), pa.array(band, pa.list_(pa.int64()))],
                names=["row_key", "doc_id", "v", "n_grams", "bands"],
            )

    light = documents.select(F.xxhash64(doc_id, text).alias("row_key"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return light.mapInArrow(tidied(run), "row_key long, doc_id long, v long, n_grams int, bands array<long>")


def _grams(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _stepped(batches, 1):
            sets = gram_sets([t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()], n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["v", "grams"])

    return run


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members and their group's base to the n-grams that only one of the two has."""
    for batch in batches:
        own, base = (batch.column(c).to_pylist() for c in ("grams", "base"))
        read = lambda x: np.frombuffer(x, dtype=np.uint64)
        apart = [np.setxor1d(read(x), read(y), assume_unique=True) for x, y in zip(own, base, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("grp", "v", "copies", "n_grams")), pa.array([len(x) for x in apart], pa.int32()), pa.array([x.tobytes() for x in apart], pa.binary())],
            names=["grp", "v", "copies", "n_grams", "n_apart", "grams"],
        )


class Links:
    """Which members of two blocks, or of one, reach the threshold on their whole sets.

    A set is given as its difference to a base that all members share (the empty set, or
    one of them); what two sets have in common follows from their sizes and differences.
    ``PAIRS`` pairs are looked at at a time. ``links`` counts the copies that each member is
    linked with; members linked directly or through others have one ``root``.
    """

    def __init__(self, apart: list[np.ndarray], size: np.ndarray, copies: np.ndarray, left: np.ndarray, right: np.ndarray | None, threshold: float):
        self.size, self.copies, self.threshold = size.astype(np.float64), copies.astype(np.float64), threshold
        own = np.array([len(x) for x in apart])
        self.inside = self.size - own
        _, gram, times = np.unique(np.concatenate(apart), return_inverse=True, return_counts=True)
        shared = np.cumsum(times > 1) - 1
        owner = np.repeat(np.arange(len(apart)), own)[times[gram] > 1]
        column = shared[gram[times[gram] > 1]]
        order = np.argsort(column, kind="stable")
        self.owner, self.column = owner[order], column[order]
        self.links = np.zeros(len(apart))
        self.root = np.arange(len(apart))
        step = max(1, PAIRS // max(1, len(left if right is None else right)))
        for k in range(0, len(left), step):
            rows = left[k : k + step]
            columns = left[k:] if right is None else right
            yes = self._reach(rows, columns)
            if right is None:
                yes[:, : len(rows)] &= np.triu(np.ones((len(rows), len(rows)), dtype=bool), 1)
            self.links[rows] += yes @ self.copies[columns]
            self.links[columns] += yes.T @ self.copies[rows]
            self._merge(rows, columns, yes)

    def _reach(self, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        common = (self.inside[rows][:, None] + self.inside[columns][None, :]) / 2
        wide = max(64, 4 * PAIRS // len(self.size))
        end = int(self.column[-1]) + 1 if len(self.column) else 0
        for low in range(0, end, wide):
            a, b = np.searchsorted(self.column, [low, low + wide])
            part = np.zeros((len(self.size), min(wide, end - low)), dtype=np.float32)
            part[self.owner[a:b], self.column[a:b] - low] = 1
            common += part[rows] @ part[columns].T
        union = self.size[rows][:, None] + self.size[columns][None, :] - common
        return common >= self.threshold * union - 1e-9

    def _merge(self, rows: np.ndarray, columns: np.ndarray, yes: np.ndarray) -> None:
        """Roots become the least of the roots that the links connect, until none changes."""
        some_rows, some_columns = yes.any(axis=1), yes.any(axis=0)
        rows, columns, yes = rows[some_rows], columns[some_columns], yes[some_rows][:, some_columns]
        top = len(self.root)
        while len(rows):
            here, there = self.root[rows], self.root[columns]
            if min(here.min(), there.min()) == max(here.max(), there.max()):
                return
            near = np.minimum(here, np.where(yes, there[None, :], top).min(axis=1))
            back = np.minimum(there, np.where(yes, near[:, None], top).min(axis=0))
            to = np.arange(top)
            np.minimum.at(to, here, near)
            np.minimum.at(to, there, back)
            if (to[here] == here).all() and (to[there] == there).all():
                return
            while (to[to] != to).any():
                to = to[to]
            self.root = to[self.root]


def _verified(threshold: float):
    """Groups of candidates to each member's links and one edge to a member it is linked with."""

    def run(table: pa.Table) -> pa.Table:
        group, i, j, b, v, copies, size = (table.column(c).to_numpy() for c in ("grp", "i", "j", "block", "v", "copies", "n_grams"))
        sets = [np.frombuffer(x, dtype=np.uint64) for x in table.column("grams").to_pylist()]
        out_v, out_links, out_root = [], [], []
        order = np.lexsort((j, i, group))
        key = np.rec.fromarrays([group[order], i[order], j[order]])
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else []
        for a, z in zip(cut, [*cut[1:], len(order)], strict=True):
            rows = order[a:z]
            same = i[rows[0]] == j[rows[0]]
            left = np.arange(len(rows)) if same else np.flatnonzero(b[rows] == i[rows])
            right = None if same else np.flatnonzero(b[rows] == j[rows])
            if not len(left) or (right is not None and not len(right)):
                continue
            made = Links([sets[k] for k in rows], size[rows], copies[rows], left, right, threshold)
            some = np.flatnonzero(made.links)
            out_v.append(v[rows][some])
            out_links.append(made.links[some].astype(np.int64))
            out_root.append(v[rows][made.root[some]])
        tidy()
        join = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, dtype=np.int64), pa.int64())
        return pa.table({"v": join(out_v), "links": join(out_links), "root": join(out_root)})

    return run


def _stars(banded: DataFrame) -> DataFrame:
    """Edges between texts that share a band, with the same components as all such pairs.

    In each band all meet at the least, their hub. A member keeps one edge, to its least
    hub; that hub gets one to each of the others, which members of a group mostly share.
    """
    meet = banded.groupBy("band").agg(F.min("v").alias("hub"), F.max("v").alias("most")).where("hub < most").select("band", "hub")
    hubs = banded.join(meet, "band").groupBy("v").agg(F.sort_array(F.collect_set("hub")).alias("hubs"))
    ends = F.array_union(F.array(F.col("v")), F.slice("hubs", 2, F.size("hubs")))
    return hubs.select(F.col("hubs")[0].alias("a"), F.explode(ends).alias("b")).where("a <> b").distinct()


def _blocks(members: DataFrame, sets: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, int]:
    """Rows ``grp, i, j, block, v, copies, n_grams, grams`` of what each task compares, and their bytes.

    A group within ``MEMBERS`` and ``GRAMS`` is one block of whole sets. Of a larger one
    the sets go once to a base, the member of median size, and what differs is kept:
    near copies differ little, so most such groups are one block then too. Only what is
    larger still is cut into blocks, and each meets each.
    """
    sizes = members.groupBy("grp").agg(F.count("*").alias("m"), F.sum("n_grams").alias("g"))
    large = checkpointed(sizes.where((F.col("m") > MEMBERS) | (F.col("g") > GRAMS)), rows=1)
    n_large = large.count()
    spot = [F.lit(0).alias(c) for c in ("i", "j", "block")]
    columns = ("grp", "i", "j", "block", "v", "copies", "n_grams", "grams")
    small = members
    if n_large:
        key = large.select("grp")
        small = members.join(F.broadcast(key) if n_large <= BROADCAST_ROWS else key, "grp", "left_anti")
    work = small.join(sets(small), "v").select("grp", *spot, "v", "copies", "n_grams", "grams")
    n_bytes = small.agg(F.coalesce(F.sum("n_grams"), F.lit(0)).alias("g")).first()["g"] * 8
    if not n_large:
        return work, n_bytes
    among = checkpointed(join_sized(members, large.select("grp"), "grp", F.xxhash64("v")))
    whole = among.join(sets(among), "v")
    middle = among.groupBy("grp").agg(F.percentile_approx("n_grams", 0.5).alias("middle"))
    chosen = join_sized(among, middle, "grp", F.xxhash64("v")).groupBy("grp").agg(F.min_by("v", F.struct(F.abs(F.col("n_grams") - F.col("middle")), "v")).alias("v"))
    base = whole.join(chosen, ["grp", "v"]).select("grp", F.col("grams").alias("base"))
    # A base can be long, so it is never broadcast; its rows are repeated for the salts instead.
    wide = base.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = whole.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(wide, ["grp", "salt"])
    salted = salted.select("grp", "v", "copies", "n_grams", "grams", "base")
    apart = checkpointed(salted.mapInArrow(tidied(_differences), "grp long, v long, copies long, n_grams int, n_apart int, grams binary"))
    of_groups = apart.groupBy("grp").agg(F.greatest(F.ceil(F.count("*") / MEMBERS), F.ceil(F.sum("n_apart") / GRAMS)).cast("int").alias("cut"))
    cut = join_sized(apart, of_groups, "grp", F.xxhash64("v")).withColumn("block", F.pmod(F.xxhash64("v"), F.col("cut")).cast("int"))
    n_bytes += cut.agg(F.coalesce(F.sum(F.col("n_apart") * F.col("cut")), F.lit(0)).alias("g")).first()["g"] * 8
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)))
    cut = cut.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    return work.unionByName(cut.select(*columns)), n_bytes


def near_duplicates(
    documents: DataFrame, *, threshold: float = 0.8, n: int = 5, recall: float = 0.9999, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per row of ``documents``: ``row_key, doc_id, n_grams, class_id, n_links, kept``.

    Rows are linked whose sets of word n-grams have a Jaccard similarity of
    ``threshold`` or more. ``n_links`` counts a row's links, copies included; rows linked
    directly or through others have one ``class_id``, their least id; ``kept`` is true
    for one row of each class, the one with the least id.

    Each text is signed once. Band hashes are shuffled; texts that share one are
    candidates of one another, and candidates of candidates form a group. Copies, known
    by the digest of their set, count as one member. Each member's full set goes to its
    group once, and all pairs in it are counted, as numbers and never as rows. A group of
    more than ``MEMBERS`` members or ``GRAMS`` n-grams is compared by what its members
    differ in from one of them, and only one that is too large even so is cut into
    blocks; then every pair of blocks is a task, so no group is collected. The classes
    come from the verified links by label passing. Digests and keys have 64 bits.

    A text without words is linked to nothing and is a class by itself, null id or not;
    a text of fewer than ``n`` words is one n-gram. In a class, a null id is above all
    others; repeated rows are copies. An empty table gives no rows.
    """
    spark = documents.sparkSession
    bands, rows = choose_bands(threshold, recall)
    signed = checkpointed(signatures(documents, doc_id, text, bands, rows, n))
    classes = signed.where("v is not null").groupBy("v").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least"))
    banded = signed.where("v is not null").select("v", F.explode("bands").alias("band"))
    groups = components(_stars(banded)).select("v", F.col("root").alias("grp"))
    # One row of documents stands for each member.
    stand = signed.where("v is not null").groupBy("v").agg(F.min("row_key").alias("row_key"), F.count("*").alias("copies"), F.first("n_grams").alias("n_grams"))
    n_members = groups.count()
    members = checkpointed(groups.join(stand, "v"), rows=n_members)
    texts = documents.select(F.xxhash64(doc_id, text).alias("row_key"), F.col(text).alias("text"))
    repeats = _repeats(signed)

    def sets(of: DataFrame) -> DataFrame:
        chosen = of.select("row_key", "v")
        made = texts.join(F.broadcast(chosen) if n_members <= BROADCAST_ROWS else chosen, "row_key").select("v", "text")
        made = made.mapInArrow(tidied(_grams(n)), "v long, grams binary")
        return made.dropDuplicates(["v"]) if repeats else made

    work, n_bytes = _blocks(members, sets)
    parts = 4 * shards(spark, n_bytes)
    work = work.withColumn("part", F.pmod(F.xxhash64("grp", "i", "j"), F.lit(parts)).cast("int"))
    found = checkpointed(work.groupBy("part").applyInArrow(_verified(threshold), "v long, links long, root long"), rows=8 * n_members, spread=True)
    roots = components(found.select(F.col("v").alias("a"), F.col("root").alias("b"))).select("v", "root")
    links = found.groupBy("v").agg(F.sum("links").alias("links"))
    known = checkpointed(
        classes.join(links, "v", "left")
        .join(roots, "v", "left")
        .select("v", "copies", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "v").alias("root")),
        rows=signed.count(),
    )
    firsts = known.groupBy("root").agg(F.min("least").alias("class_id"), F.min_by("v", F.struct(F.col("least").isNull(), "least", "v")).alias("first"))
    known = known.join(firsts, "root").select("v", "copies", "links", "class_id", (F.col("v") == F.col("first")).alias("holds"), "least")
    # Of the copies with the least id, one row: the least key, and among equal rows any one.
    whole = signed.select("row_key", "doc_id", "v", "n_grams").join(known, "v", "left")
    first = F.col("holds") & F.col("doc_id").eqNullSafe(F.col("least"))
    return whole.select(
        "row_key",
        "doc_id",
        F.col("n_grams").cast("long").alias("n_grams"),
        F.when(F.col("v").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(F.col("v").isNull(), F.lit(0)).otherwise(F.col("links") + F.col("copies") - 1).cast("long").alias("n_links"),
        F.coalesce(first, F.lit(True)).alias("kept"),
    )


def _repeats(signed: DataFrame) -> bool:
    """Are there rows alike in id and text?"""
    return signed.groupBy("row_key").agg(F.count("*").alias("n")).where("n > 1").limit(1).count() > 0


def one_of_each(documents: DataFrame, **options) -> DataFrame:
    """``documents`` with one row of each class of near duplicates.

    Only the keys of the rows that go are joined to the texts: broadcast if counted and
    few, else by shuffle. Where rows repeat in full, or share the least id of a class,
    one of them stays.
    """
    doc_id, text = options.get("doc_id", "doc_id"), options.get("text", "text")
    (key,) = new_names(documents, "row_key")
    found = checkpointed(near_duplicates(documents, **options))
    linked = found.where("n_grams > 0")
    stays = linked.where("kept").groupBy("class_id").agg(F.min("row_key").alias("row_key"))
    gone = checkpointed(linked.select("row_key", "class_id").distinct().join(stays.select("row_key").distinct(), "row_key", "left_anti").select("row_key").distinct())
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    keyed = documents.withColumn(key, F.xxhash64(doc_id, text))
    left = keyed.join(gone.withColumnRenamed("row_key", key), key, "left_anti")
    if _repeats(found.where("n_grams > 0")):
        # Rows alike in id and text: the first of each stays; wordless texts are not merged.
        lone = left.join(found.where("n_grams = 0").select(F.col("row_key").alias(key)).distinct(), key, "left_semi")
        left = left.join(found.where("n_grams > 0").select(F.col("row_key").alias(key)).distinct(), key, "left_semi").dropDuplicates([key]).unionByName(lone)
    return left.select(*documents.columns)
