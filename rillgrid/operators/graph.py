"""Masks as graphs of pixels that touch at a side or corner."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.affine import step_orientation
from ..functions.axial import axial_mean
from ..storage import checkpointed

#: Half of the eight neighbours: each pair of pixels is found from one side.
OFFSETS = ((0, 1), (1, -1), (1, 0), (1, 1))

#: A mask of at most so many pixels is one group of one task.
MASK_PIXELS = 8_000_000


def nodes(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pixels numbered from 0 in each mask, by row and column."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("r", "c")) - 1
    return pixels.select(*keys, "r", "c").withColumn("node_id", rank.cast("long"))


def neighbours(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pairs of touching pixels, once each: ``r, c, nr, nc``.

    Every pixel looks for four places by equality, which hashes, instead of comparing
    places within a distance.
    """
    offsets = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc in OFFSETS])
    asked = pixels.select(*keys, "r", "c", F.explode(offsets).alias("o")).select(
        *keys, "r", "c", (F.col("r") + F.col("o.dr")).alias("nr"), (F.col("c") + F.col("o.dc")).alias("nc")
    )
    there = pixels.select(*keys, F.col("r").alias("nr"), F.col("c").alias("nc"))
    return asked.join(there, [*keys, "nr", "nc"])


def pixel_graph(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Edges ``src < dst`` between node numbers."""
    n = nodes(pixels, keys)
    to = n.select(*keys, F.col("r").alias("nr"), F.col("c").alias("nc"), F.col("node_id").alias("b"))
    e = neighbours(pixels, keys).join(n, [*keys, "r", "c"]).join(to, [*keys, "nr", "nc"])
    return e.select(*keys, F.least("node_id", "b").alias("src"), F.greatest("node_id", "b").alias("dst"))


def both_ways(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    return edges.select(*keys, "src", "dst").union(edges.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst")))


def degrees(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Nodes with their degree, 0 for those alone."""
    pairs = neighbours(pixels, keys)
    ends = pairs.select(*keys, "r", "c").unionAll(pairs.select(*keys, F.col("nr").alias("r"), F.col("nc").alias("c")))
    counted = ends.groupBy(*keys, "r", "c").agg(F.count("*").alias("degree"))
    return nodes(pixels, keys).join(counted, [*keys, "r", "c"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def _roots(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The least node of each node's component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[src], root[dst])
        new = root.copy()
        np.minimum.at(new, src, low)
        np.minimum.at(new, dst, low)
        np.minimum.at(new, root[src], low)
        np.minimum.at(new, root[dst], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _links(r: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of touching pixels, of pixels sorted by row and column."""
    width = int(c.max()) + 3 if len(c) else 3
    place = r * width + c + 1
    src, dst = [], []
    for dr, dc in OFFSETS:
        want = place + dr * width + dc
        at = np.searchsorted(place, want)
        at[at == len(place)] = 0
        hit = np.flatnonzero(place[at] == want)
        src.append(hit)
        dst.append(at[hit])
    return np.concatenate(src), np.concatenate(dst)


def _placed(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    return pixels.select(*keys, F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"))


def _grouped(pixels: DataFrame, keys: Sequence[str]):
    """Masks as groups, dealt to all partitions: they are few bytes and much work, so none are merged."""
    n = int(pixels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _placed(pixels, keys).repartition(n, *keys).groupBy(*keys)


def _schema(df: DataFrame, keys: Sequence[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"{k} {kinds[k]}" for k in keys)


def large_masks(pixels: DataFrame, keys: Sequence[str]) -> DataFrame | None:
    """The masks of more than ``MASK_PIXELS`` pixels, or None if there are none."""
    found = checkpointed(pixels.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > MASK_PIXELS).select(*keys))
    return found if found.limit(1).count() else None


def _by_size(pixels: DataFrame, keys: Sequence[str], whole: Callable, cut: Callable) -> DataFrame:
    """``whole`` for masks that fit a task, ``cut`` for the larger ones."""
    large = large_masks(pixels, keys)
    if large is None:
        return whole(pixels, keys)
    return whole(pixels.join(large, list(keys), "left_anti"), keys).unionByName(cut(pixels.join(large, list(keys), "left_semi"), keys))


class Mask:
    """A mask's pixels by row and column, its graph, components and key nodes."""

    def __init__(self, table: pa.Table):
        r, c = (table.column(x).to_numpy().astype(np.int64) for x in ("r", "c"))
        order = np.lexsort((c, r))
        self.r, self.c = r[order], c[order]
        src, dst = _links(self.r - self.r.min(), self.c - self.c.min())
        self.root = _roots(len(r), src, dst)
        a, b = np.concatenate([src, dst]), np.concatenate([dst, src])
        by = np.lexsort((b, a))
        self.a, self.b = a[by], b[by]
        self.degree = np.bincount(a, minlength=len(r))
        self.part = np.unique(self.root, return_inverse=True)[1]
        other = np.zeros(len(r), dtype=bool)
        np.logical_or.at(other, self.root, self.degree != 2)
        self.key = (self.degree != 2) | (~other[self.root] & (self.root == np.arange(len(r))))


def _labelled_whole(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    def label(table: pa.Table) -> pa.Table:
        m = Mask(table)
        columns = {"r": m.r, "c": m.c, "node_id": np.arange(len(m.r)), "degree": m.degree, "root": m.root, "component_id": m.part, "is_key": m.key}
        return pa.table({**{k: table.column(k) for k in keys}, **{k: pa.array(v) for k, v in columns.items()}})

    schema = f"{_schema(pixels, keys)}, r long, c long, node_id long, degree long, root long, component_id long, is_key boolean"
    return _grouped(pixels, keys).applyInArrow(label, schema)


def _labelled_cut(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    pixels = _placed(pixels, keys)
    n = degrees(pixels, keys)
    labels = components_distributed(pixel_graph(pixels, keys), keys)
    whole = n.join(labels, [*keys, "node_id"], "left").withColumn("root", F.coalesce("root", "node_id"))
    group = [*keys, "root"]
    rings = whole.groupBy(*group).agg(F.min("degree").alias("low"), F.max("degree").alias("high"))
    number = F.dense_rank().over(Window.partitionBy(*keys).orderBy("root")) - 1
    parts = rings.withColumn("component_id", number.cast("long")).withColumn("ring", (F.col("low") == 2) & (F.col("high") == 2))
    out = whole.join(parts.select(*group, "component_id", "ring"), group)
    key = (F.col("degree") != 2) | (F.col("ring") & (F.col("node_id") == F.col("root")))
    return out.select(*keys, "r", "c", "node_id", F.col("degree").cast("long").alias("degree"), "root", "component_id", key.alias("is_key"))


def labelled(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Nodes ``r, c, node_id, degree, root, component_id, is_key``.

    Components are numbered by their least node, the root. Key nodes end or join
    branches: all whose degree is not 2, and the least node of a component in which every
    degree is 2, a ring. Masks share no pixels, so each is one group of one task and one
    pass of numpy; a mask of more than ``MASK_PIXELS`` is labelled by joins instead.
    """
    return _by_size(pixels, keys, _labelled_whole, _labelled_cut)


def components(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Nodes with the number of their component in the mask, counted by least node."""
    return labelled(pixels, keys).select(*keys, "r", "c", "node_id", "root", "component_id")


def components_distributed(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``src`` of ``edges`` with the least node of its component, by label passing over joins."""
    both = checkpointed(both_ways(edges, keys).distinct())
    labels = checkpointed(both.groupBy(*keys, F.col("src").alias("node_id")).agg(F.least(F.first("src"), F.min("dst")).alias("root")))
    while True:
        heard = both.join(labels.withColumnRenamed("node_id", "dst"), [*keys, "dst"]).groupBy(*keys, F.col("src").alias("node_id")).agg(F.min("root").alias("near"))
        step = checkpointed(labels.join(heard, [*keys, "node_id"]).select(*keys, "node_id", F.col("root").alias("old"), F.least("root", "near").alias("root")))
        jump = step.select(*keys, F.col("node_id").alias("root"), F.col("root").alias("far"))
        new = checkpointed(step.join(jump, [*keys, "root"]).select(*keys, "node_id", "old", F.least("root", "far").alias("root")))
        labels = new.select(*keys, "node_id", "root")
        if not new.where("root <> old").limit(1).count():
            return labels


def key_nodes(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key nodes with flags as the layers have them, and a running number."""
    found = labelled(pixels, keys).where("is_key")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("r", "c")) - 1
    return found.select(
        *keys, "r", "c", "node_id", "component_id", "degree",
        (F.col("degree") == 1).cast("int").alias("is_endpoint"),
        (F.col("degree") >= 2).cast("int").alias("is_junction"),
        rank.cast("long").alias("key_id"),
    )


def _chains(a: np.ndarray, b: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Branches of a graph given by both directions ``a -> b`` of its edges, sorted.

    Returns the steps of all branches in order, as indices of edges, and where each
    branch starts and stops in them. A branch starts at the end and step that come first.
    Chains are followed by pointer doubling, so a long one costs few rounds.
    """
    n, here = len(a), np.arange(len(a))
    twin = np.lexsort((a, b))  # the same edge the other way: edges sorted by (b, a)
    first = np.searchsorted(a, b)  # of the two steps on from a node that is no key, the one that does not go back
    last = np.minimum(first + 1, n - 1)
    ends = key[b]
    onward = np.where(ends, here, np.where(b[np.minimum(first, n - 1)] == a, last, np.minimum(first, n - 1)))
    to, far = onward.copy(), np.where(ends, 0, 1)
    while True:
        far, new = far + far[to], to[to]
        if (new == to).all():
            break
        to = new
    # An edge's branch starts where the way back from it ends.
    start, place = twin[to[twin]], far[twin]
    kept = key[a[start]] & (start < twin[to[start]])
    steps = np.flatnonzero(kept)
    steps = steps[np.lexsort((place[steps], start[steps]))]
    cut = np.flatnonzero(np.concatenate([[True], start[steps][1:] != start[steps][:-1]])) if len(steps) else steps
    return steps, cut, np.append(cut, len(steps))[1:] if len(cut) else cut


def _lines(a: np.ndarray, b: np.ndarray, key: np.ndarray, r: np.ndarray, c: np.ndarray) -> dict[str, np.ndarray | pa.Array]:
    """The branches as columns: ends, first step, number of pixels, points."""
    steps, start, stop = _chains(a, b, key) if len(a) else (np.zeros(0, dtype=np.int64),) * 3
    size = stop - start + 1
    offsets = np.concatenate([[0], np.cumsum(size)])
    nodes = np.empty(int(offsets[-1]), dtype=np.int64)
    inner = np.ones(len(nodes), dtype=bool)
    inner[offsets[1:] - 1] = False
    nodes[inner], nodes[~inner] = a[steps], b[steps[stop - 1]] if len(stop) else steps
    points = pa.StructArray.from_arrays([pa.array(r[nodes]), pa.array(c[nodes])], names=["r", "c"])
    return {
        "a": a[steps[start]] if len(start) else steps, "step": b[steps[start]] if len(start) else steps, "b": b[steps[stop - 1]] if len(stop) else steps,
        "n_pixels": size, "points": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), points),
    }


BRANCH = "node_id_a long, node_id_b long, component_id long, n_pixels long, is_open_edge int, points array<struct<r: long, c: long>>"


def _branches_whole(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    def trace(table: pa.Table) -> pa.Table:
        m = Mask(table)
        x = _lines(m.a, m.b, m.key, m.r, m.c)
        n = len(x["a"])
        return pa.table({
            **{k: pa.array([table.column(k)[0].as_py()] * n, table.column(k).type) for k in keys},
            "edge_id": pa.array(np.arange(n)), "node_id_a": pa.array(x["a"]), "node_id_b": pa.array(x["b"]), "component_id": pa.array(m.part[x["a"]], pa.int64()),
            "n_pixels": pa.array(x["n_pixels"], pa.int64()), "is_open_edge": pa.array((~m.key[x["b"]]).astype(np.int32)), "points": x["points"],
        })

    return _grouped(pixels, keys).applyInArrow(trace, f"{_schema(pixels, keys)}, edge_id long, {BRANCH}")


def _branches_cut(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Branches of masks that no task holds: pass-through pixels that touch make paths, and each path is one group."""
    n = checkpointed(_labelled_cut(pixels, keys))
    side = lambda end: n.select(*keys, F.col("node_id").alias(end), *[F.col(x).alias(f"{end}_{x}") for x in ("r", "c", "is_key", "component_id")])
    steps = both_ways(pixel_graph(_placed(pixels, keys), keys), keys).join(side("src"), [*keys, "src"]).join(side("dst"), [*keys, "dst"])
    steps = checkpointed(steps)
    paths = components_distributed(steps.where("NOT src_is_key AND NOT dst_is_key").select(*keys, "src", "dst"), keys)
    owner = F.when(F.col("src_is_key"), F.when(F.col("dst_is_key"), F.lit(None)).otherwise(F.col("dst"))).otherwise(F.col("src"))
    steps = steps.withColumn("owner", owner)
    found = steps.where("owner IS NOT NULL").join(paths.withColumnsRenamed({"node_id": "owner", "root": "path"}), [*keys, "owner"], "left")
    found = found.withColumn("path", F.coalesce("path", "owner"))

    def trace(table: pa.Table) -> pa.Table:
        src, dst = table.column("src").to_numpy(), table.column("dst").to_numpy()
        ids, at = np.unique(src, return_index=True)
        r, c, key, part = (table.column(f"src_{x}").to_numpy(zero_copy_only=False)[at] for x in ("r", "c", "is_key", "component_id"))
        a, b = np.searchsorted(ids, src), np.searchsorted(ids, dst)
        by = np.lexsort((b, a))
        x = _lines(a[by], b[by], key, r, c)
        size = len(x["a"])
        return pa.table({
            **{k: pa.array([table.column(k)[0].as_py()] * size, table.column(k).type) for k in keys},
            "step": pa.array(ids[x["step"]]), "node_id_a": pa.array(ids[x["a"]]), "node_id_b": pa.array(ids[x["b"]]), "component_id": pa.array(part[x["a"]]),
            "n_pixels": pa.array(x["n_pixels"], pa.int64()), "is_open_edge": pa.array(np.zeros(size, dtype=np.int32)), "points": x["points"],
        })

    long = found.groupBy(*keys, "path").applyInArrow(trace, f"{_schema(pixels, keys)}, step long, {BRANCH}")
    points = F.array(*[F.struct(F.col(f"{x}_r").alias("r"), F.col(f"{x}_c").alias("c")) for x in ("src", "dst")])
    short = steps.where("owner IS NULL AND src < dst").select(
        *keys, F.col("dst").alias("step"), F.col("src").alias("node_id_a"), F.col("dst").alias("node_id_b"), F.col("src_component_id").alias("component_id"),
        F.lit(2).cast("long").alias("n_pixels"), F.lit(0).alias("is_open_edge"), points.alias("points"),
    )
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("node_id_a", "step")) - 1
    return long.unionByName(short).withColumn("edge_id", rank.cast("long")).drop("step")


def branches(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Branches ``edge_id, node_id_a, node_id_b, component_id, n_pixels, is_open_edge, points``.

    ``points`` are the pixels along the branch, both ends included; a ring starts and
    ends at its seed. ``edge_id`` follows the key node and neighbour a branch starts by. A
    mask of more than ``MASK_PIXELS`` is traced path by path instead of whole.
    """
    return _by_size(pixels, keys, _branches_whole, _branches_cut)


def measured(edges: DataFrame, keys: Sequence[str], step: float = 0.5) -> DataFrame:
    """Branches with ``length_m``, pixels times the pixel size, and ``orientation_deg_axial``.

    The direction is the axial mean of the branch's steps, each of weight one; a step
    pairs a pixel with the next one along the branch.
    """
    place = F.posexplode("points").alias("k", "p")
    steps = edges.select(*keys, "edge_id", place)
    ahead = Window.partitionBy(*keys, "edge_id").orderBy("k")
    steps = steps.withColumn("q", F.lead("p").over(ahead)).where("q is not null")
    angle = step_orientation(F.col("q.r") - F.col("p.r"), F.col("q.c") - F.col("p.c"))
    mean = steps.groupBy(*keys, "edge_id").agg(axial_mean(angle).alias("orientation_deg_axial"))
    out = edges.withColumn("length_m", F.col("n_pixels") * F.lit(float(step))).join(mean, [*keys, "edge_id"], "left")
    return out.withColumn("orientation_deg_axial", F.coalesce("orientation_deg_axial", F.lit(-1.0)))


def component_counts(pixels: DataFrame, keys: Sequence[str], step: float = 0.5) -> DataFrame:
    """Nodes, ends, pass-through and junction pixels, degree and length of each component."""
    n = F.count("*")
    return (
        labelled(pixels, keys)
        .groupBy(*keys, "component_id")
        .agg(
            n.alias("num_nodes"),
            F.count_if(F.col("degree") == 1).alias("num_endnodes"),
            F.count_if(F.col("degree") >= 2).alias("num_junctions"),
            (F.sum("degree") / n).alias("avg_degree"),
            (n * F.lit(float(step))).alias("total_length_m"),
        )
    )


def not_isolated(counts: DataFrame) -> DataFrame:
    """Components but for single pixels, which have no branch."""
    return counts.where("NOT (num_nodes = 1 AND num_endnodes = 0 AND num_junctions = 0)")
