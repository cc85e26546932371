"""The corpus operators as registered queries, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, fingerprint, media, mixing, ngram_join, packing, quality, suffix, toxicity, warc
from .common import read, shared_folder


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(read(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "n_grams", "class_id", "n_links")


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    rows = read(spark, sf_dir, "conversations").select(*[F.col(c).cast(t) for c, t in more.dtypes])
    made = chat.format_chats(rows.unionByName(more))
    turns, loss = chat.parse(F.col("formatted")), chat.masked(F.col("formatted"), F.col("loss_spans"))
    back = made.select("conv_id", "formatted", "identical", turns.alias("turns"), loss.alias("loss"))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(chat.joined(F.col("turns")), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "identical",
    )


def op5_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fingerprint.edited_against_next(read(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next"
    )


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "warc")
    warc.write_archive(read(spark, sf_dir, "pages"), path)
    return warc.read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = suffix.deduplicate(read(spark, sf_dir, "documents"))
    n_kept, n_spans = F.octet_length("kept").cast("long"), F.size("spans").cast("long")
    return made.select("doc_id", "n_bytes", (F.col("n_bytes") - n_kept).alias("n_removed"), n_spans.alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    made = quality.classify(docs, read(spark, sf_dir, "labels"))
    return made.select("doc_id", "lang", "n_bytes", "log_perplexity", F.exp("log_perplexity").alias("perplexity"), "threshold", "keep")


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = media.store(read(spark, sf_dir, "documents"), keep_bytes=False)
    feature = F.concat_ws(":", F.concat_ws("x", "width", "height"), "images", "thumbnail_hash")
    return made.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    made = toxicity.score(docs, model)
    return made.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_mixing, op2_packing, op3_ngram_join, op4_chat, op5_imatch, op6_warc, op7_suffix, op8_kneser_ney, op9_media, op10_toxicity)
}

ORACLES: dict[str, str] = {
    "op1_mixing": r"""
        WITH sized AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                   CAST('0x' || substr(md5('20240229|' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS draw
            FROM documents),
        sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
        weighed AS (
            SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
                   3.0::DOUBLE * source_size AS cap, (sum(source_size) OVER ())::DOUBLE AS total
            FROM sources),
        filled AS (
            SELECT *, (total - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
            FROM weighed
            WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        aims AS (
            SELECT source, source_size, least(cap, (SELECT level FROM filled WHERE level <= cap / weight ORDER BY cap / weight, source NULLS LAST LIMIT 1) * weight) AS target
            FROM filled),
        plan AS (
            SELECT *, floor(target + 0.5)::BIGINT AS words,
                   CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS times FROM aims),
        ordered AS (
            SELECT s.*, p.source_size, p.target, p.times, p.words - p.times * p.source_size AS rest,
                   sum(s.size) OVER (PARTITION BY s.source ORDER BY s.draw, s.doc_id) - s.size AS passed
            FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source)
        SELECT doc_id, size, source_size, target, (times * size + least(greatest(rest - passed, 0), size))::BIGINT AS taken FROM ordered
    """,
    "op3_ngram_join": r"""
        WITH RECURSIVE worded AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        gram AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))
                                                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM worded),
        size AS (SELECT doc_id, count(*) AS n FROM gram GROUP BY doc_id),
        pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM gram a JOIN gram b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        link AS (SELECT a, b FROM pair JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE c >= 0.8::DOUBLE * (x.n + y.n - c) - 1e-9),
        reach AS (SELECT doc_id AS v, doc_id AS root FROM documents UNION SELECT l.b, r.root FROM reach r JOIN link l ON l.a = r.v)
        SELECT d.doc_id, coalesce(any_value(s.n), 0)::BIGINT AS n_grams, min(r.root) AS class_id, coalesce(any_value(k.n), 0)::BIGINT AS n_links
        FROM documents d LEFT JOIN size s USING (doc_id) JOIN reach r ON r.v = d.doc_id LEFT JOIN (SELECT a, count(*) AS n FROM link GROUP BY a) k ON k.a = d.doc_id
        GROUP BY d.doc_id
    """,
    "op4_chat": r"""
        WITH rows AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        coded AS (
            SELECT *, regexp_replace(regexp_replace(text, '(<)(\\*(?:\|im_start\|>|\|im_end\|>|\|endoftext\|>|\|startoftext\|>|s>|/s>|<SYS>>|</SYS>>))', '\1\\\2', 'g'),
                                     '(\[)(\\*(?:INST\]|/INST\]))', '\1\\\2', 'g') AS body
            FROM rows)
        SELECT conv_id, count(*)::BIGINT AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               length(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), ''))::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(length(role) + length(body) + 24)::BIGINT AS formatted_chars, true AS identical
        FROM coded GROUP BY conv_id
    """,
    "op7_suffix": r"""
        WITH raw AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        spot AS (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS p FROM raw),
        str AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM spot),
        first AS (SELECT s, min(doc_id) AS least FROM str GROUP BY s HAVING count(*) > 1),
        gone AS (SELECT doc_id, p FROM str JOIN first USING (s) WHERE least < doc_id),
        step AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER w + 50 THEN 0 ELSE 1 END AS fresh FROM gone WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
        run AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM step) t GROUP BY doc_id, k),
        kept AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS start FROM run),
        cut AS (SELECT k.doc_id, sum(b - a) AS n, count(*) AS spans, string_agg(substr(h, 2 * start + 1, 2 * (a - start)), '' ORDER BY a) AS head, max(b) AS stop FROM kept k JOIN raw USING (doc_id) GROUP BY k.doc_id)
        SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
               sha256(unhex(CASE WHEN n IS NULL THEN h ELSE head || substr(h, 2 * stop + 1) END)) AS kept_sha256
        FROM raw LEFT JOIN cut USING (doc_id)
    """,
    "op6_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
        s AS (SELECT page_id, octet_length(payload)::BIGINT AS n, sha1(payload) AS digest FROM p),
        r AS (SELECT *, max(page_id) OVER (PARTITION BY digest, n) AS chosen FROM s)
        SELECT page_id, n AS payload_bytes, digest AS payload_digest,
               CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM chosen AND chosen IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM chosen THEN chosen END AS refers_to
        FROM r
    """,
}
