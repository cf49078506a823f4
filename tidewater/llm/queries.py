"""One registered query per operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import alignment, ann, langid, mixing, neardup, packing, periodic, quality, secrets, substrings, tokenfile, toxicity, urlfilter
from tidewater.llm.common import WORD, table

# The rules of the url query.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"),
             ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return neardup.near_duplicates(docs, shingle=4, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicated(table(spark, sf_dir, "documents")).drop("factors")


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.nearest(rows.where(F.col("vec_id") % 20 == 0), rows)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_cut_words")


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlfilter.judge(pages, rules)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sizes(table(spark, sf_dir, "documents"))


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """The contract's input of the run query: in a text whose h % 10 is 0, the
    words from a on become copies of the p words there."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.select("doc_id", "text", h.alias("h"),
                         F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("w"))
    sized = chosen.select("*", F.when(F.size("w") > 0, F.size("w")).alias("n"), F.expr("h div 10").alias("g"))
    cut = sized.select("*", F.expr("cast(g % n as int)").alias("a"))
    dealt = cut.select("*", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)").alias("p"))
    made = F.expr("array_join(concat(slice(w, 1, a), slice(flatten(array_repeat(slice(w, a + 1, p), cast((n - a + p - 1) div p as int))), 1, n - a)), ' ')")
    return dealt.select("doc_id", F.when(F.col("n").isNotNull(), made).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.find(with_planted_periods(table(spark, sf_dir, "documents"))))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.score(table(spark, sf_dir, "documents"))


def op13_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = tokenfile.write(table(spark, sf_dir, "documents"), tokenfile.new_folder(spark))
    return tokenfile.digests(tokenfile.read(spark, folder))


QUERIES = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_secret_scan": op2_secret_scan,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_nearest": op4_nearest,
    "op5_language": op5_language,
    "op6_toxicity": op6_toxicity,
    "op7_packing": op7_packing,
    "op8_quality_rules": op8_quality_rules,
    "op9_url_filters": op9_url_filters,
    "op10_mixing": op10_mixing,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_alignment": op12_alignment,
    "op13_token_output": op13_token_output,
}
