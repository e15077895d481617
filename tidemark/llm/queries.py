"""One query per operator over its whole table, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    bytebpe,
    decontaminate,
    exact,
    language,
    lines,
    near,
    packing,
    periodic,
    secrets,
    shards,
    tokencount,
    toxicity,
    whitening,
)
from tidemark.operators.once import with_once

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_groups(table(spark, sf_dir, "documents"))


@query("""
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
           doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents
    WINDOW g AS (PARTITION BY coalesce(text, ''))
""")
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = exact.exact_groups(table(spark, sf_dir, "documents"))
    return judged.withColumn("text_sha256", F.lower(F.hex("digest"))).drop("digest")


@query()
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", 512)


@query("""
    WITH lines AS (
        SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
    ), keyed AS (
        SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
        FROM lines
    ), repeated AS (
        SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20
        GROUP BY key HAVING count(DISTINCT doc_id) >= 3
    ), judged AS (
        SELECT doc_id, pos, line, last IS NOT NULL AND last <> doc_id AS dropped
        FROM keyed LEFT JOIN repeated USING (key)
    )
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
    FROM judged GROUP BY doc_id
""")
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = lines.drop_repeated_lines(table(spark, sf_dir, "documents"))
    return left.withColumn("kept_sha256", F.sha2("text", 256)).drop("text")


@query()
def op9_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    manifest = shards.write_shards(docs, "word_bpe_49k.json", end_id=2)
    return shards.read_documents(docs, manifest)


@query()
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents")).pieces.drop("row")


@query()
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted", "spans")


@query()
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


@query()
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(table(spark, sf_dir, "documents")).drop("value")


@query()
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id, text: in about a tenth of the documents the words repeat from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = docs.select("doc_id", "text", F.coalesce(h % 10 == 0, F.lit(False)).alias("chosen"), F.floor(h / 10).alias("g"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    docs = with_once(docs, "words", F.when(F.col("chosen"), words))
    n, a, g = F.size("words"), F.col("a"), F.col("g")
    docs = docs.withColumn("a", F.when(n > 0, g % n)).withColumn("p", F.floor((n - a) / (3 + g % 8)) + 1)
    again = F.transform("words", lambda w, i: F.when(i < a, w).otherwise(F.get("words", (a + (i - a) % F.col("p")).cast("int"))))
    return docs.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


@query()
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(with_planted_periods(table(spark, sf_dir, "documents")))
    order = F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p")))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(line, "\n"), F.lit("\n"))).otherwise(F.lit(""))
    return found.withColumn("longest", F.array_max(order)).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest.s")).alias("start"),
        F.col("longest.n").alias("length"),
        (-F.col("longest.p")).alias("period"),
        F.floor(F.col("longest.n") * 1000 / -F.col("longest.p")).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query()
def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = bytebpe.decode(bytebpe.encode(table(spark, sf_dir, "documents")))
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(bytebpe.ids_text("ids"), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )
