"""The registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calltide.llm import (
    bpe,
    chat,
    decontaminate,
    jaccard,
    lexical,
    licenses,
    periodic,
    quality,
    suffixes,
    tokens,
    toxicity,
    vptree,
    warc,
)
from calltide.llm.common import crc_mod3, table
from calltide.session import materialise

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


@query("op1_byte_bpe")
def byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every text and the bytes that they decode to, as digests."""
    vocabulary = (public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return bpe.encode(docs, *vocabulary, decoded="decoded").select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op2_warc")
def warc_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Pages written as archives with revisits, and read back."""
    marked = warc.record_types(table(spark, folder, "pages"))
    archives = materialise(warc.write_archives(marked), "warc")
    return warc.read_archives(archives).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


ESCAPES = r"\### Assistant: </turn> ok"


@query("op5_chat_format")
def chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations and one made of control strings, formatted and read back."""
    hard = [(-7, 0, "user", ESCAPES), (-7, 1, "assistant", ESCAPES)]
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(hard, "conv_id long, turn long, role string, text string")
    return chat.digest_conversations(chat.format_conversations(rows.unionByName(extra)))


def _decided(scored: DataFrame, least: float) -> DataFrame:
    return scored.select(
        "doc_id",
        F.coalesce(crc_mod3() == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= least).cast("int").alias("predicted"),
    )


@query("op4_quality")
def quality_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every text, by embeddings learned from the labelled rows."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return _decided(quality.score(docs, quality.train(docs, table(spark, folder, "labels"))), 0.5)


TOXIC = 0.7


@query("op10_toxicity")
def toxicity_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every text, by votes of its nearest labelled examples."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return _decided(toxicity.score(docs, toxicity.train(docs, table(spark, folder, "labels"))), TOXIC)


@query("op3_decontaminate")
def contaminated(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark windows in every document, by suffix arrays."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda total, x: total + x["stop"] - x["start"])
    return decontaminate.matches(docs, table(spark, folder, "benchmark")).select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


END_OF_DOCUMENT = 2


@query("op7_token_files")
def token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every text written as token files in document order, and read back."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    files = tokens.write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), END_OF_DOCUMENT)
    return tokens.read_tokens(materialise(files, "tokens")).select(
        "doc_id",
        "start",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )


@query(
    "op6_vptree",
    """WITH v AS (
      SELECT vec_id, list_transform(embedding, x -> CAST(x AS DOUBLE)) AS e FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, x -> x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, x -> x <> 0)) > 0
    ), s AS (
      SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
    ), r AS (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
    )
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20""",
)
def nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest of every twentieth vector, by vantage-point trees."""
    vectors = vptree.usable(table(spark, folder, "embeddings"), "vec_id", "embedding")
    trees = materialise(vptree.build(vectors), "trees")
    return vptree.search(trees, vectors.where("_id % 20 = 0"))


@query("op9_ngram_jaccard")
def jaccard_components(spark: SparkSession, folder: str) -> DataFrame:
    """Documents connected by shingle sets that are nearly the same."""
    return jaccard.join(table(spark, folder, "documents").select("doc_id", "text"))


@query("op8_suffix_dedup")
def repeated_bytes(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every text without the strings of 100 bytes that start earlier."""
    size = F.octet_length(F.coalesce("text", F.lit("")))
    docs = table(spark, folder, "documents").select("doc_id", "text", size.cast("long").alias("n_bytes"))
    return suffixes.remove(docs).select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op11_license_scan")
def license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Licence phrases, tags and expressions in every text."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = licenses.scan(docs).withColumn("_base", F.filter("phrases", lambda x: x["base"]))
    labels = F.array_sort(F.array_distinct(F.col("_base.label")))
    return found.select(
        "doc_id",
        "n_words",
        F.size("_base").cast("long").alias("n_base"),
        F.array_min("_base.word").alias("first_word"),
        F.array_max("_base.word").alias("last_word"),
        F.array_join(labels, ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op12_ranked_search",
    f"""WITH occurrences AS (
      SELECT doc_id, unnest(regexp_extract_all({_LOWERED}, '{_TERM}')) AS term FROM documents
    ), sizes AS (
      SELECT doc_id, CAST(count(*) AS BIGINT) AS n FROM occurrences GROUP BY doc_id
    ), whole AS (
      SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS total FROM sizes
    ), asked AS (
      SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWERED}, '{_TERM}')) AS term FROM benchmark
    ), postings AS (
      SELECT term, doc_id, CAST(count(*) AS BIGINT) AS tf FROM occurrences
      WHERE term IN (SELECT term FROM asked) GROUP BY term, doc_id
    ), weights AS (
      SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
      FROM postings, whole GROUP BY term
    ), scored AS (
      SELECT a.item_id, p.doc_id,
        CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // total))))) AS BIGINT) AS score
      FROM asked a JOIN postings p USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id), whole
      GROUP BY a.item_id, p.doc_id
    ), ranked AS (
      SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0
    )
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 50""",
)
def ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    """The 50 best documents of every benchmark item, by range-maximum tables."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return lexical.search(docs, table(spark, folder, "benchmark").select("item_id", "text"), 50)


def planted_order(doc_id: int | None, n: int) -> np.ndarray | None:
    """For every tenth document by hash: its words up to a place, then a stretch of them over and over."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([np.arange(a), a + np.arange(n - a) % p])


@query("op13_periodic_runs")
def periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Periodic runs of the words of every text, and the texts without their repetitions."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = periodic.mark_runs(docs, key="doc_id", order=planted_order)
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.withColumn("_top", periodic.strongest("runs")).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "_top.start",
        "_top.length",
        "_top.period",
        F.expr("_top.length * 1000 div _top.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
