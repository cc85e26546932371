"""Masks as sparse pixels ``(keys..., r, c, v)`` or as dense blocks of bytes."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def threshold(pixels: DataFrame, value: str = "v") -> DataFrame:
    return pixels.where(F.col(value) > 0)


def non_empty(pixels: DataFrame, keys: Sequence[str], value: str = "v") -> DataFrame:
    """The masks with any pixel set."""
    return pixels.groupBy(*keys).agg(F.bool_or(F.col(value) > 0).alias("any")).where("any").select(*keys)


def valid(value: Column, nodata: Column) -> Column:
    """Is a pixel data? All are without a nodata value, which may be NaN."""
    number = value.cast("double")
    return F.when(nodata.isNull(), F.lit(True)).when(F.isnan(nodata), ~F.isnan(number)).otherwise(number != nodata)


def in_boxes(pixels: DataFrame, boxes: DataFrame, name: str = "ocean") -> DataFrame:
    """``pixels`` and whether a pixel lies in any box ``(r0, c0, r1, c1)``, ends exclusive.

    Boxes become their cells, so the join is by equality and a pixel joins once; the
    cells are only as many as the boxes cover.
    """
    rows = F.explode(F.sequence(F.col("r0"), F.col("r1") - 1))
    cells = boxes.where("r1 > r0 AND c1 > c0").select(rows.alias("r"), "c0", "c1")
    cells = cells.select("r", F.explode(F.sequence(F.col("c0"), F.col("c1") - 1)).alias("c")).distinct()
    return pixels.join(cells.withColumn(name, F.lit(True)), ["r", "c"], "left").withColumn(name, F.coalesce(name, F.lit(False)))


def rasterize(boxes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cells that each box of map coordinates ``(minx, miny, maxx, maxy)`` touches."""
    floor = lambda x: F.floor(x).cast("long")
    last = lambda x: (F.ceil(x) - 1).cast("long")
    some = boxes.where("maxx > minx AND maxy > miny")
    rows = some.select(*keys, "minx", "maxx", F.explode(F.sequence(floor(F.col("miny")), last(F.col("maxy")))).alias("r"))
    return rows.select(*keys, "r", F.explode(F.sequence(floor(F.col("minx")), last(F.col("maxx")))).alias("c"))


def clean(value: Column, is_valid: Column, ocean: Column, nodata: Column) -> Column:
    """A mask value with the ocean set to 0 and nodata kept."""
    return F.when(~is_valid, nodata.cast("int")).when(~ocean, value.cast("int")).otherwise(F.lit(0))


def overview(pixels: DataFrame, keys: Sequence[str], factor: int, value: str = "v") -> DataFrame:
    """A pyramid level: of each ``factor`` x ``factor`` cell the top-left pixel that is there."""
    cell = [F.floor(F.col(x) / factor).cast("long").alias(x) for x in ("r", "c")]
    return pixels.groupBy(*keys, *cell).agg(F.min_by(value, F.struct(pixels["r"], pixels["c"])).alias(value))


def overviews(pixels: DataFrame, keys: Sequence[str], factors: Sequence[int] = (2, 4, 8, 16), value: str = "v") -> DataFrame:
    """All levels in one pass: pixels go to a cell of every level, summed per task first."""
    levels = F.explode(F.array(*[F.lit(k) for k in factors]))
    wide = pixels.withColumn("level", levels)
    cell = [F.floor(F.col(x) / F.col("level")).cast("long").alias(x) for x in ("r", "c")]
    return wide.groupBy(*keys, "level", *cell).agg(F.min_by(value, F.struct(wide["r"], wide["c"])).alias(value))


def null_mask(bands: DataFrame, keys: Sequence[str], value: str = "v") -> DataFrame:
    """Is a pixel 0 in all its bands?"""
    return bands.groupBy(*keys).agg(F.bool_and(F.col(value) == 0).alias("is_null"))


def reflected(index: Column, size: Column | int) -> Column:
    """The index that stands at ``index`` when an axis of ``size`` is mirrored at its ends."""
    n = size if isinstance(size, Column) else F.lit(size)
    period = F.greatest(2 * (n - 1), F.lit(1))
    k = F.pmod(index, period)
    return F.when(n == 1, F.lit(0)).otherwise(F.least(k, period - k)).cast("long")


def reflect_pad(pixels: DataFrame, keys: Sequence[str], height: int, width: int, pad: int) -> DataFrame:
    """A mask with a mirrored margin of ``pad`` pixels, by place in the padded frame."""
    spots = lambda size, old, new: pixels.sparkSession.range(size + 2 * pad).select(
        F.col("id").alias(new), reflected(F.col("id") - pad, size).alias(old)
    )
    out = pixels.join(F.broadcast(spots(height, "r", "pr")), "r").join(F.broadcast(spots(width, "c", "pc")), "c")
    values = [x for x in pixels.columns if x not in (*keys, "r", "c")]
    return out.select(*keys, F.col("pr").alias("r"), F.col("pc").alias("c"), *values)


def chip_grid(frames: DataFrame, keys: Sequence[str], chip: int = 1024, overlap: int = 128) -> DataFrame:
    """Corners ``(y, x)`` of the chips that cover a frame of ``height`` and ``width``."""
    step = chip - overlap
    ys = F.explode(F.sequence(F.lit(0), F.greatest(F.col("height") - 1, F.lit(0)).cast("int"), F.lit(step)))
    xs = F.explode(F.sequence(F.lit(0), F.greatest(F.col("width") - 1, F.lit(0)).cast("int"), F.lit(step)))
    return frames.select(*keys, "height", "width", ys.alias("y")).select(*keys, "y", xs.alias("x"), "height", "width")


def chip_average(chips: DataFrame, keys: Sequence[str], value: str = "p", cut: float = 0.01) -> DataFrame:
    """Mean of what overlapping chips say of a pixel, and whether it is above ``cut``."""
    mean = F.sum(value) / F.greatest(F.count(value), F.lit(1))
    out = chips.groupBy(*keys, "r", "c").agg(F.coalesce(mean, F.lit(0.0)).alias("mean"), F.count(value).alias("n"))
    return out.withColumn("v", (F.col("mean") > cut).cast("int"))


def to_blocks(pixels: DataFrame, keys: Sequence[str], size: int = 256, value: str = "v") -> DataFrame:
    """Sparse pixels as dense blocks ``(br, bc, size, data)``, rows of bytes."""
    import numpy as np

    schema = ", ".join(f"{k} {t}" for k, t in pixels.dtypes if k in keys)
    rows = pixels.withColumns({"br": F.floor(F.col("r") / size).cast("int"), "bc": F.floor(F.col("c") / size).cast("int")})

    def dense(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        block = np.zeros((size, size), dtype=np.uint8)
        block[pdf["r"] % size, pdf["c"] % size] = pdf[value]
        return pd.DataFrame([[*key, size, block.tobytes()]], columns=[*keys, "br", "bc", "size", "data"])

    return rows.groupBy(*keys, "br", "bc").applyInPandas(dense, f"{schema}, br int, bc int, size int, data binary")


def from_blocks(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The pixels of blocks that are not 0."""
    import numpy as np

    schema = ", ".join(f"{k} {t}" for k, t in blocks.dtypes if k in keys)

    def sparse(frames):
        for pdf in frames:
            for row in pdf.to_dict("records"):
                r, c = np.nonzero(block := np.frombuffer(row["data"], dtype=np.uint8).reshape(-1, row["size"]))
                out = {k: [row[k]] * len(r) for k in keys}
                yield pd.DataFrame({**out, "r": r + row["br"] * row["size"], "c": c + row["bc"] * row["size"], "v": block[r, c].astype("int32")})

    return blocks.mapInPandas(sparse, f"{schema}, r long, c long, v int")


def infer(chips: DataFrame, scorer, schema: str) -> DataFrame:
    """Chips through a scorer of pandas frames: the place for a model."""
    return chips.mapInPandas(lambda frames: (scorer(f) for f in frames), schema)


def _covering(size: int, chip: int, step: int, place: str) -> Column:
    """The starts of the chips along an axis that hold a place, or its mirror image beyond the end."""
    starts = F.sequence(F.lit(0), F.lit(max(size - 1, 0)), F.lit(step))
    held = lambda at: F.transform(F.filter(starts, lambda s: (s <= at) & (at < s + chip)), lambda s: F.struct(s.cast("long").alias("start"), (at - s).cast("long").alias("at")))
    own, mirrored = F.col(place), F.lit(2 * (size - 1)) - F.col(place)
    return F.concat(held(own), F.when(mirrored > own, F.filter(held(mirrored), lambda x: x["start"] + x["at"] >= size)).otherwise(F.slice(held(own), 1, 0)))


def infer_overlapping(
    pixels: DataFrame, keys: Sequence[str], height: int, width: int, scorer: Callable, *, chip: int = 1024, overlap: int = 128, value: str = "v", cut: float = 0.01
) -> DataFrame:
    """Chips that overlap, cut from frames mirrored at their ends, scored, and averaged per pixel.

    ``pixels`` are sparse, ``(keys..., r, c, value)``; ``scorer`` takes an array of chips
    ``(n, chip, chip)`` to scores from 0 to 1 of the same shape. Rows ``r, c, mean, n, v``
    of the pixels with a score above 0 anywhere: the mean over the ``n`` chips that hold
    the pixel, and whether it is above ``cut``. A chip is one group, whatever the frame's
    size; only scores above 0 are shuffled, and ``n`` follows from the grid.
    """
    import numpy as np

    step = chip - overlap
    schema = ", ".join(f"{k} {t}" for k, t in pixels.dtypes if k in keys)
    rows = pixels.select(*keys, "r", "c", F.col(value).cast("double").alias("v"))
    rows = rows.withColumn("ys", F.explode(_covering(height, chip, step, "r"))).withColumn("xs", F.explode(_covering(width, chip, step, "c")))
    rows = rows.select(*keys, F.col("ys.start").alias("y"), F.col("xs.start").alias("x"), F.col("ys.at").alias("i"), F.col("xs.at").alias("j"), "v")

    def scored(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        block = np.zeros((1, chip, chip))
        block[0, pdf["i"], pdf["j"]] = pdf["v"]
        y, x = int(key[-2]), int(key[-1])
        score = np.asarray(scorer(block))[0, : height - y, : width - x]
        i, j = np.nonzero(score)
        return pd.DataFrame({**{k: [v] * len(i) for k, v in zip(keys, key, strict=False)}, "r": i + y, "c": j + x, "p": score[i, j]})

    found = rows.groupBy(*keys, "y", "x").applyInPandas(scored, f"{schema}, r long, c long, p double")
    # Chips along an axis that hold a place: those that start in the chip before it, but for starts below 0.
    holding = lambda at: (F.floor(F.col(at) / step) - F.greatest(F.ceil((F.col(at) - chip + 1) / step), F.lit(0)) + 1).cast("long")
    n = holding("r") * holding("c")
    out = found.groupBy(*keys, "r", "c").agg((F.sum("p") / F.first(n)).alias("mean"), F.first(n).alias("n"))
    return out.withColumn("v", (F.col("mean") > cut).cast("int"))


def thinned(block) -> object:
    """A mask one pixel wide with the same parts and holes (Zhang and Suen 1984)."""
    import numpy as np

    img = np.pad(np.asarray(block) > 0, 1)
    while True:
        changed = False
        for first in (True, False):
            p = [np.roll(img, s, (0, 1)) for s in ((1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1))]
            around = sum(x.astype(int) for x in p)
            rises = sum((~p[k] & p[(k + 1) % 8]).astype(int) for k in range(8))
            n, e, s, w = p[0], p[2], p[4], p[6]
            sides = ~(n & e & s) & ~(e & s & w) if first else ~(n & e & w) & ~(n & s & w)
            gone = img & (around >= 2) & (around <= 6) & (rises == 1) & sides
            if gone.any():
                img, changed = img & ~gone, True
        if not changed:
            return img[1:-1, 1:-1]


def skeletonize(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each mask thinned, one mask a task."""
    import numpy as np

    schema = ", ".join(f"{k} {t}" for k, t in pixels.dtypes if k in keys)

    def thin(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = pdf["r"].min(), pdf["c"].min()
        frame = np.zeros((pdf["r"].max() - r0 + 1, pdf["c"].max() - c0 + 1), dtype=bool)
        frame[pdf["r"] - r0, pdf["c"] - c0] = True
        r, c = np.nonzero(thinned(frame))
        return pd.DataFrame({**{k: [v] * len(r) for k, v in zip(keys, key, strict=True)}, "r": r + r0, "c": c + c0})

    return pixels.groupBy(*keys).applyInPandas(thin, f"{schema}, r long, c long")
