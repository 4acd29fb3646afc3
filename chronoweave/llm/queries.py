"""The queries of this package over the driver's tables, and SQL where it can express one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.llm import bpe, html_extract, mixing, quality_classifier, quality_rules, sharding, simhash, simhash_dedup, substring_dedup, toxicity
from chronoweave.llm.common import read, words


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality_rules.learn(documents, read(spark, sf_dir, "labels"))
    judged = quality_rules.judge(documents, rules)
    return judged.select(
        "doc_id",
        *[F.col(f"stats.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        quality_rules.base_failed(F.col("stats")).alias("base_failed"),
        F.col("reason").isNull().alias("kept"),
        "reason",
    )


def _remainder(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, held = read(spark, sf_dir, "documents").select("doc_id", "text"), _remainder(5) == 0
    model = toxicity.train(documents, read(spark, sf_dir, "labels"), allowed=~held)
    scored = toxicity.score(documents, model)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, held = read(spark, sf_dir, "documents").select("doc_id", "text"), _remainder(4) == 2
    model = quality_classifier.train(documents, read(spark, sf_dir, "labels"), allowed=~held)
    scored = quality_classifier.score(documents, model)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents").select("doc_id", "text", "source"), max_repetition=2.0)
    n_tokens = F.size(words(F.col("text"))).cast("long")
    return mixed.select("doc_id", "source", n_tokens.alias("n_tokens"), "epoch", "block", F.col("draw.block").alias("block_draw"), F.col("draw.row").alias("row_draw"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(read(spark, sf_dir, "documents").select("doc_id", "text"), 8)
    return placed.select(
        "doc_id",
        "size",
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_bpe(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    encoded = bpe.encode(read(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary_text(tokenizer))
    return encoded.select(
        "doc_id",
        F.size("tokens").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("tokens").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.fingerprints(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumns({c: simhash.as_hex(F.col(c)) for c in ("fingerprint", "edited_fingerprint")})


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH spoken AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), placed AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos, len(w) AS n FROM spoken
), runs AS (
  SELECT doc_id, i AS pos, md5(array_to_string(w[i + 1:i + 13], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(len(w) - 12)) AS i FROM spoken WHERE len(w) >= 13)
), later AS (
  SELECT r.doc_id, r.pos FROM runs r JOIN (SELECT h, min(doc_id) AS source FROM runs GROUP BY h) s USING (h) WHERE s.source < r.doc_id
), gone AS (
  SELECT DISTINCT doc_id, pos + k AS pos FROM later, range(13) t(k)
), kept AS (
  SELECT p.doc_id, p.pos, p.word, g.pos IS NOT NULL AS removed FROM placed p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.pos = g.pos
), texts AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE removed) AS n_removed,
         coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT removed), '') AS kept
  FROM kept GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(t.n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(t.n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN texts t ON d.doc_id = t.doc_id
"""


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.groups(read(spark, sf_dir, "documents").select("doc_id", "text"), width=3, radius=3)
    return found.withColumn("fingerprint", simhash.as_hex(F.col("fingerprint")))


def vocabulary_text(path: str | None = None) -> str:
    """The content of a tokenizer file; by default that of the public byte-level vocabulary."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        return file.read()


QUERIES = {"op1_quality_rules": op1_quality_rules, "op2_toxicity": op2_toxicity, "op3_quality_classifier": op3_quality_classifier, "op4_mixing": op4_mixing, "op5_sharding": op5_sharding, "op6_bpe": op6_bpe, "op7_html_extract": op7_html_extract, "op8_fingerprints": op8_fingerprints, "op9_substring_dedup": op9_substring_dedup, "op10_simhash_dedup": op10_simhash_dedup}
ORACLE_SQL: dict[str, str] = {"op9_substring_dedup": OP9_SQL}
