"""I-Match document fingerprints over randomised lexicons, in DataFrame functions only."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, new_names, shards, total_bytes

#: A term is in the band if between one in RARE and one in COMMON documents has it.
RARE, COMMON = 1024, 4

#: Lexicons: the whole band (twice, by two hashes), the 8 parts that three bits of a
#: term's hash make of it, the 8 parts of each, and twice more 64 parts, of the first 8
#: before: one term in 8, 64, 512 and 4,096, so that any text has parts of a few terms.
PARTS, BITS = 8, 3
#: Marks of the band's terms; as many follow for the terms outside it.
MARKS = 2 + PARTS + 3 * PARTS * PARTS

#: The band goes to all tasks up to so many terms; a larger one is joined by shuffle.
LEXICON = 300_000


def terms(text: Column) -> Column:
    """64-bit hashes of the distinct words (runs of letters and digits, lower case) of a text."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    hashes = F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))
    return F.array_remove(hashes, F.xxhash64(F.lit("")))  # what lies outside the first and last word


@dataclass
class Lexicon:
    """The terms of the band: ``rows(term)``, and as a table of slots if they are few enough."""

    rows: DataFrame
    size: int
    slots: int
    flat: str | None = None
    starts: str | None = None

    def release(self) -> None:
        """Drop the look-up table; plans made before have its values and stay as they are."""
        for name in (self.flat, self.starts):
            if name is not None:
                self.rows.sparkSession.sql(f"DROP TEMPORARY VARIABLE IF EXISTS {name}")
        self.flat = self.starts = None


def _variable(one: DataFrame, kind: str) -> str:
    """A session variable with the one value of ``one``: in plans, a literal known by its name."""
    spark, name = one.sparkSession, f"rillgrid_{uuid.uuid4().hex}"
    one.createOrReplaceTempView(name)
    spark.sql(f"DECLARE VARIABLE {name} {kind}")
    spark.sql(f"SET VAR {name} = (SELECT * FROM {name})")
    spark.catalog.dropTempView(name)
    return name


def lexicon(documents: DataFrame, text: str) -> Lexicon:
    """Terms whose document frequency, over all different texts, lies in the band.

    Copies count once (texts meet by digest), so they move no term out of the band.
    One in RARE documents at least means at most RARE times the mean number of
    distinct terms, however many documents there are; the size is checked all the same.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    different = documents.groupBy(F.sha2(whole, 256)).agg(F.first(whole).alias(text))
    n = different.count()
    counts = different.select(F.explode(terms(F.col(text))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    # In a small table one document in RARE is no frequency at all: two at least.
    rows = checkpointed(counts.where((F.col("df") >= max(2, n / RARE)) & (F.col("df") <= max(2, n / COMMON))).select("term"), small=True)
    size = rows.count()
    lex = Lexicon(rows, size, 1 << max(1, size).bit_length())
    if size <= LEXICON:
        # The terms by slot, and where each slot's terms start: a table for look-ups by place.
        slot = F.pmod("term", F.lit(lex.slots)).cast("int")
        flat = rows.agg(F.transform(F.sort_array(F.collect_list(F.struct(slot.alias("slot"), "term"))), lambda x: x["term"]).alias("flat"))
        counted = rows.groupBy(slot.alias("slot")).agg(F.count("*").alias("n"))
        every = rows.sparkSession.range(lex.slots + 1).select(F.col("id").cast("int").alias("slot")).join(counted, "slot", "left")
        upto = F.coalesce(F.sum("n").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1
        starts = every.select("slot", upto.cast("int").alias("start")).agg(
            F.transform(F.sort_array(F.collect_list(F.struct("slot", "start"))), lambda x: x["start"]).alias("starts")
        )
        lex.flat, lex.starts = _variable(flat, "ARRAY<BIGINT>"), _variable(starts, "ARRAY<INT>")
    return lex


def _split(kept: Column, bit: int) -> Column:
    every = F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))
    return F.transform(every, lambda c: F.filter(kept, lambda h: F.shiftrightunsigned(h, bit).bitwiseAND(F.lit(PARTS - 1)) == c))


def _with_marks(df: DataFrame, kept: str, name: str) -> DataFrame:
    """``name``: MARKS 16-bit hashes of a text's sorted terms in each lexicon; null where there are none."""
    a, b, c, d = parts = new_names(df, "imatch_a", "imatch_b", "imatch_c", "imatch_d")
    out = df.withColumn(a, _split(F.col(kept), 40))
    out = out.withColumn(b, F.flatten(F.transform(a, lambda x: _split(x, 40 + BITS))))
    out = out.withColumn(c, F.flatten(F.transform(F.slice(b, 1, PARTS), lambda x: _split(x, 40 + 2 * BITS))))
    out = out.withColumn(d, F.flatten(F.transform(F.slice(c, 1, PARTS), lambda x: _split(x, 40 + 3 * BITS))))
    mark = lambda x: F.when(F.size(x) > 0, F.hash(x).bitwiseAND(F.lit(0xFFFF)))
    whole = F.when(F.size(kept) > 0, F.xxhash64(kept).bitwiseAND(F.lit(0xFFFF)).cast("int"))
    every = F.concat(F.array(F.col(kept)), *[F.col(x) for x in parts])
    return out.withColumn(name, F.concat(F.array(whole), F.transform(every, mark))).drop(*parts)


def shown(marks: Column) -> Column:
    """Marks as a string: four hex digits for each lexicon, dashes where there are no terms."""
    return F.array_join(F.transform(marks, lambda m: F.coalesce(F.lower(F.lpad(F.hex(m), 4, "0")), F.lit("----"))), "")


def with_fingerprint(df: DataFrame, lex: Lexicon, text: str, name: str) -> DataFrame:
    """``df`` and the fingerprint of ``text``, an array of marks, as column ``name``.

    Terms in the band, sorted, are hashed for every lexicon; a lexicon that holds none
    of them gives null. Terms outside the band follow in lexicons of their own.
    """
    found, kept, rest, outside = new_names(df, "imatch_terms", "imatch_kept", "imatch_rest", "imatch_outside")
    if lex.flat is not None:
        flat, starts = F.expr(lex.flat), F.expr(lex.starts)

        def known(h: Column) -> Column:
            slot = F.pmod(h, F.lit(lex.slots)).cast("int")
            start = F.get(starts, slot)
            return F.array_contains(F.slice(flat, start, F.get(starts, slot + 1) - start), h)

        out = df.withColumn(found, terms(F.col(text)))
        out = out.withColumn(kept, F.filter(F.col(found), known))
    else:
        # Equal texts have equal terms, so the terms of each different text are joined once.
        key, term = new_names(df, "imatch_key", "imatch_term")
        out = df.withColumn(key, F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).withColumn(found, terms(F.col(text)))
        each = out.select(key, F.explode(found).alias(term)).distinct()
        each = each.join(lex.rows.withColumnRenamed("term", term), term).groupBy(key).agg(F.collect_list(term).alias(kept))
        out = out.join(each, key, "left").withColumn(kept, F.coalesce(kept, F.array().cast("array<bigint>"))).drop(key)
    out = out.withColumns({kept: F.sort_array(kept), rest: F.sort_array(F.array_except(found, kept))})
    out = _with_marks(_with_marks(out, kept, name), rest, outside)
    return out.withColumn(name, F.concat(name, outside)).select(*df.columns, name)


def likeness(a: Column, b: Column) -> Column:
    """The share of equal marks among the lexicons of which either text has a term.

    Only the band's lexicons count, unless a text has no term there: then all count, for both.
    """
    band = F.get(a, F.lit(0)).isNotNull() & F.get(b, F.lit(0)).isNotNull()
    a, b = (F.when(band, F.slice(x, 1, MARKS)).otherwise(x) for x in (a, b))
    pairs = F.zip_with(a, b, lambda x, y: F.when(x.isNull() & y.isNull(), F.lit(None)).otherwise(x.eqNullSafe(y)))
    some, same = F.size(F.filter(pairs, lambda p: p.isNotNull())), F.size(F.filter(pairs, lambda p: p))
    return F.when(some == 0, F.lit(1.0)).otherwise(same / some).cast("double")


def _range_of(at: Column, cuts: list[int], wide: int = 64) -> Column:
    """How many of the sorted ``cuts`` lie below a value: first among each ``wide``-th, then within its stretch."""
    as_array = lambda x: F.array(*[F.lit(c) for c in x]).cast("array<bigint>")
    below = lambda x: F.size(F.filter(x, lambda c: c < at))
    if len(cuts) <= wide:
        return below(as_array(cuts))
    coarse = below(as_array(cuts[wide - 1 :: wide]))
    stretches = F.array(*[as_array(cuts[k : k + wide]) for k in range(0, len(cuts) + 1, wide)])
    return coarse * wide + below(F.get(stretches, coarse))


def edited_against_next(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of all texts, of their edited texts, and their likeness.

    ``doc_id, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited,
    near_next``: the edited text has its last half replaced by the start of the next
    document by descending id, and after the last comes the first. Documents are dealt
    to ranges of ids, and each range gets a copy of the first document of the next, so
    every range finds its neighbours by itself and texts are shuffled once.

    A null text is empty; null ids come last; documents of one id are ordered by text,
    descending; repeated rows are documents of their own; a single document is its own
    neighbour; an empty table gives no rows; texts are read whole and further columns not
    at all. Rows of one id are one range, so ids should not repeat by the million.
    """
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    lex = lexicon(rows, "text")
    lowest = -(1 << 63)
    rows = rows.withColumn("at", F.coalesce("doc_id", F.lit(lowest)))
    spark = documents.sparkSession
    n = shards(spark, total_bytes(rows, "text"))
    cuts = rows.agg(F.percentile_approx("at", [k / n for k in range(1, n)], max(10_000, 8 * n)).alias("cuts")).first()["cuts"] or []
    rows = rows.withColumn("range", _range_of(F.col("at"), sorted(set(cuts))))
    # The first document of each range, handed to the range above it; the topmost wraps.
    tops = rows.groupBy("range").agg(F.max("at").alias("at"))
    above = F.coalesce(F.lead("range").over(Window.orderBy("range")), F.min("range").over(Window.orderBy("range")))
    handed = rows.drop("range").join(F.broadcast(tops.select("at", above.alias("range"))), "at").groupBy("range").agg(F.max("text").alias("text"))
    whole = rows.select("range", "doc_id", "at", "text", F.lit(False).alias("copy")).unionByName(
        handed.select("range", F.lit(None).cast("long").alias("doc_id"), F.lit(lowest).alias("at"), "text", F.lit(True).alias("copy"))
    )
    whole = with_fingerprint(whole, lex, "text", "fingerprint")
    order = Window.partitionBy("range").orderBy("copy", F.col("at").desc(), F.col("text").desc())
    pair = whole.withColumns({"next_text": F.lead("text").over(order), "next_mark": F.lead("fingerprint").over(order)}).where(~F.col("copy"))
    n_chars = F.char_length("text")
    half = F.floor(n_chars / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n_chars - half), F.substring(F.col("next_text"), F.lit(1), half))
    made = pair.select("doc_id", n_chars.cast("long").alias("n_chars"), edited.alias("edited_text"), "fingerprint", "next_mark")
    made = with_fingerprint(made, lex, "edited_text", "edited_fingerprint")
    lex.release()
    return made.select(
        "doc_id",
        "n_chars",
        "edited_text",
        shown(F.col("fingerprint")).alias("fingerprint"),
        shown(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_mark")).alias("near_next"),
    )
