"""The queries of the operators over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, dac, decontam, lm, neardup, negatives, outliers, phrases, quality, tokcount, urlfilter, warc
from .common import keep, new_path, table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 50 = 0"))


def op4_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages have no time; it is page_id seconds after the start of 2024."""
    at = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("page_id")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    captures = table(spark, sf_dir, "pages").select("page_id", "url", at.alias("captured_at"), "html")
    index = warc.merge_index(warc.write_archives(captures, new_path(spark, "warc")))
    return warc.read_archives(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = bpe.read_ranks(tokenizer_file("byte_bpe_multi_50k.tiktoken"))
    coded = bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return bpe.digests(bpe.decode(coded, ranks))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokcount.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    files = dac.write_ids(docs, tokenizer_file("byte_bpe_50k.json"), dac.new_folder(spark))
    return dac.read_checks(files)


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urlfilter.evaluate(urlfilter.page_times(pages), urlfilter.host_list(pages))


def op11_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.quality_rules(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", label)
    return negatives.hard_negatives(vectors, vectors.where("vec_id % 100 = 0"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_dart_minhash": op2_dart_minhash,
    "op3_collision_counting": op3_collision_counting,
    "op4_warc_index": op4_warc_index,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_decontamination": op6_decontamination,
    "op7_deleted_interpolation": op7_deleted_interpolation,
    "op8_token_counts": op8_token_counts,
    "op9_token_ids": op9_token_ids,
    "op10_url_filters": op10_url_filters,
    "op11_quality_outliers": op11_quality_outliers,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_collocations": op13_collocations,
}

ORACLE: dict[str, str] = {
    "op4_warc_index": warc.ORACLE,
    "op6_decontamination": decontam.ORACLE,
    "op10_url_filters": urlfilter.ORACLE,
    "op12_hard_negatives": negatives.ORACLE,
    "op13_collocations": phrases.ORACLE,
}



# Stages of the corpus pipeline.  Each takes the documents that the stage before it kept; the query's rows decide.


ROW = "_stage_row"


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a key of each row, ROW: the id, where ids are whole numbers, none null and none twice; else a number
    that is written out once with the rows."""
    if dict(docs.dtypes)["doc_id"] in ("int", "bigint"):
        if not docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count():
            return docs.withColumn(ROW, F.col("doc_id").cast("long"))
    return keep(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")


def _kept(keyed: DataFrame, rejected: DataFrame) -> DataFrame:
    """The documents without the rows whose keys are in the first column of ``rejected``."""
    return keyed.join(rejected.toDF(ROW), ROW, "left_anti").drop(ROW)


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without those that the quality rules reject."""
    keyed = _keyed(docs)
    scored = quality.score_quality(keyed, table(spark, sf_dir, "labels"), row_col=ROW)
    return _kept(keyed, scored.where("predicted = 0").select(ROW))


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, one of the least id, of each group of near duplicates; null ids come last.  Rows whose texts have no
    words are in no group and stay."""
    keyed = _keyed(docs)
    classes = neardup.near_duplicates(keyed, id_col=ROW).select(F.col("doc_id").alias(ROW), "class_id")
    classes = keep(classes.join(keyed.select(ROW, "doc_id"), ROW), "classes")
    least = classes.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", ROW)).alias("least"))
    return _kept(keyed, classes.select(ROW).join(least.select(F.col(f"least.{ROW}").alias(ROW)), ROW, "left_anti"))


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without those in which a window of a benchmark item occurs."""
    keyed = _keyed(docs)
    found = decontam.contamination(keyed.select(F.col(ROW).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return _kept(keyed, found.where("contaminated").select("doc_id"))


def stage_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and decoded_sha256, the digest of the bytes that the ids decode to, of every document left."""
    import public_tokenizers

    ranks = bpe.read_ranks(tokenizer_file("byte_bpe_multi_50k.tiktoken"))
    decoded = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks)
    return decoded.select("doc_id", "ids", F.sha2("bytes", 256).alias("decoded_sha256"))
