"""Mixing sources to target weights by capped water-filling, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, WORD, checkpointed, join_sized, new_names

#: Seeded order is cut into so many buckets per source before any sort.
BUCKETS = 4096


def words(text: Column) -> Column:
    """Number of words of a text; a null text has none.

    Each word becomes one character and the white space goes: no list of words is made.
    """
    return F.char_length(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x"), "[^x]+", "")).cast("long")


def draw(seed: int, doc_id: Column) -> Column:
    """A seeded 60-bit draw from a document's id, alike on every run and engine."""
    named = F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(named), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], max_epochs: float) -> DataFrame:
    """Targets of ``sizes(key, source, source_size)`` (one row per source, key unique).

    Sources in code point order, null last, take ``weights`` in turn. A target stops
    at ``max_epochs`` times its source's size and the excess goes to the others by
    weight. The sources that stop are those with the least cap per weight, so one
    pass over them in that order gives the water level; no rounds are needed.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(in_order) - 1, F.lit(len(weights))) + 1
    by_cap = Window.orderBy("fill", F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.col("all_weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    ranked = (
        sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int")))
        .withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
        .withColumn("total", F.sum("source_size").over(whole).cast("double"))
        .withColumn("all_weights", F.sum("weight").over(whole))
        .withColumn("fill", F.col("cap") / F.col("weight"))
        .withColumn("level", level)
        .withColumn("open", F.col("level") <= F.col("fill"))
    )
    # The level rises while sources stop and is final at the first that does not.
    first = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(
        by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    return ranked.withColumn("at", first).select(
        "key", "source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("at") * F.col("weight"), F.col("cap"))).alias("target")
    )


def mix(
    documents: DataFrame,
    *,
    weights: Sequence[float] = (5, 2, 1),
    max_epochs: float = 3,
    seed: int = 20240229,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """The columns of ``documents`` and ``size, source_size, target, taken`` (words).

    A source whose target is ``t`` words is taken ``floor(t / source_size)`` times
    whole; the rest comes from its documents in a seeded order, the last of them in
    part, so that the source meets its target to the word. ``taken`` counts a
    document's words with all repetitions. Only sizes and draws are shuffled: sums by
    source and bucket of the order find the bucket that holds the cut, and only that
    bucket's rows are sorted, so a source with a third of all rows is no hot task.

    A null text has size 0 and is taken 0 times; a null source is a source of its
    own; a null id draws as the word null. Rows that draw alike (repeated ids) share
    what is left at the cut in proportion, rounded down. An empty table gives no
    rows. Where ``documents`` has a column of a result's name, the result's name gets
    a leading underscore.
    """
    size, source_size, target, taken, key, at, salt = new_names(
        documents, "size", "source_size", "target", "taken", "mix_key", "mix_draw", "mix_salt"
    )
    keyed = F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n"))
    sized = documents.withColumns({size: words(F.col(text)), key: keyed, at: draw(seed, F.col(doc_id))})
    width = (1 << 60) // BUCKETS
    bucket = F.floor(F.col("at") / F.lit(width)).cast("int")
    light = sized.select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(size).alias("size"), F.col(at).alias("at"))
    summed = light.groupBy("key", bucket.alias("bucket")).agg(F.first("source").alias("source"), F.sum("size").alias("words"))
    summed = checkpointed(summed, small=True)
    sizes = summed.groupBy("key").agg(F.first("source").alias("source"), F.sum("words").alias("source_size"))
    plan = source_targets(sizes, weights, max_epochs)
    wanted = F.floor(F.col("target") + 0.5).cast("long")
    plan = plan.withColumn("times", F.when(F.col("source_size") > 0, F.floor(wanted / F.col("source_size"))).otherwise(0))
    plan = plan.withColumn("rest", wanted - F.col("times") * F.col("source_size"))
    # The bucket, and then the draw, at which the rest of the target is used up.
    running = Window.partitionBy("key").orderBy("bucket")
    reached = summed.withColumn("upto", F.sum("words").over(running)).join(plan.select("key", "rest"), "key")
    cut_bucket = checkpointed(reached.where((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("words") < F.col("rest"))).select(
        "key", "bucket", "rest", (F.col("upto") - F.col("words")).alias("passed")
    ), small=True)
    # Only the rows of those buckets are counted again.
    near = documents.select(keyed.alias("key"), draw(seed, F.col(doc_id)).alias("at"), F.col(text).alias("text")).withColumn("bucket", bucket)
    near = near.join(F.broadcast(cut_bucket) if cut_bucket.count() <= BROADCAST_ROWS else cut_bucket, ["key", "bucket"])
    inside = near.withColumn("size", words(F.col("text"))).groupBy("key", "at", "rest", "passed").agg(F.sum("size").alias("words"))
    upto = F.col("passed") + F.sum("words").over(Window.partitionBy("key").orderBy("at"))
    cut = (
        inside.withColumn("upto", upto)
        .where((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("words") < F.col("rest")))
        .select("key", F.col("at").alias("cut"), (F.col("rest") - F.col("upto") + F.col("words")).alias("part"), F.col("words").alias("shared"))
    )
    small = checkpointed(plan.join(cut, "key", "left"), small=True).select(
        F.col("key").alias(key),
        F.col("source_size").alias(source_size),
        F.col("target").alias(target),
        *[F.col(c).alias(f"{salt}_{c}") for c in ("times", "cut", "part", "shared")],
    )
    extra = {c: F.col(f"{salt}_{c}") for c in ("times", "cut", "part", "shared")}
    share = (
        F.when(F.col(at) < extra["cut"], F.col(size))
        .when(F.col(at) == extra["cut"], F.floor(extra["part"] * F.col(size) / extra["shared"]))
        .otherwise(F.lit(0))
    )
    joined = join_sized(sized, small, key, F.col(at))
    joined = joined.withColumn(taken, (extra["times"] * F.col(size) + F.coalesce(share, F.lit(0))).cast("long"))
    return joined.select(*[documents[c] for c in documents.columns], size, source_size, target, taken)


def mixed_documents(documents: DataFrame, **options) -> DataFrame:
    """``documents`` as the mix takes them: whole repetitions, and one part at a cut.

    A document taken in part keeps its first words with the white space before them;
    ``n_chars`` is the length of the text that is kept. A document taken 0 times goes.
    """
    text = options.get("text", "text")
    plan = mix(documents, **options)
    size, _, _, taken = plan.columns[len(documents.columns) :]
    copy, _ = new_names(plan, "mix_copy", "mix_rest")
    times = F.floor(F.col(taken) / F.col(size))
    rest = F.col(taken) - times * F.col(size)
    kept = plan.where(F.col(taken) > 0).withColumn(
        copy, F.explode(F.concat(F.when(times > 0, F.array_repeat(F.col(size), times.cast("int"))).otherwise(F.array().cast("array<bigint>")), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>"))))
    )
    pieces = F.split(F.col(text), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    start = F.array_join(F.slice(pieces, F.lit(1), F.col(copy).cast("int")), "")
    kept = kept.withColumn(text, F.when(F.col(copy) < F.col(size), start).otherwise(F.col(text)))
    if "n_chars" in documents.columns:
        kept = kept.withColumn("n_chars", F.char_length(text).cast("long"))
    return kept.select(*documents.columns)
