"""A training corpus from ``documents``: quality rules, line dedup, near dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the
next stage's docs. All but the last return the columns of ``documents``.

In every stage a verdict holds for the rows with its doc_id and its text, so rows that share a doc_id have their own; a
null doc_id is an id like any other. Other columns than those of ``documents`` are left out. Null, empty and blank texts
fail the quality rules; the later stages keep such rows, once each, and packing gives each the end id. An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytecarve.llm import bagminhash, line_templates, mixing, packing, quality
from bytecarve.llm.shared import materialise, table, work_dir
from bytecarve.sources.work import mark, release, remove

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Some stages need the classifier's labels beside the documents.
LABELS = "labels"


#: Texts without a word, which have neither shingles nor a size.
BLANK = r"^[\x20\x09-\x0D]*$"
#: A line that line dedup judges: of three words (its MIN_WORDS) or more.
JUDGED = r"(?:[^\x20\x09-\x0D]++[\x20\x09\x0B-\x0D]++){2}[^\x20\x09-\x0D]"


def _keep(docs: DataFrame, verdict: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id and text (xxhash64) are in ``verdict`` (doc_id, text_key)."""
    verdict = verdict.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    on = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__key"))
    return docs.select(*COLUMNS).join(verdict.hint("merge"), on, "left_semi")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the trees reject go."""
    judged = quality.judge(docs, table(spark, sf_dir, LABELS))
    return _keep(docs, judged.where("kept"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go; a document of which no line is left that was judged, if any, goes as well: a copy in all but
    lines of one or two words. n_chars follows the text."""
    out = line_templates.drop_recurring_lines(docs.select(*COLUMNS))
    out = out.where((F.col("n_dropped") == 0) | F.col("text").rlike(JUDGED))
    chars = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", chars).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates stays: that with the least doc_id, null last, of several texts under it
    the one with the least hash. Blank texts have no class and stay."""
    docs = docs.select(*COLUMNS)
    classes = bagminhash.near_duplicates(docs).where("class_key is not null")
    stay = classes.groupBy("class_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")).alias("s"))
    stay = materialise(stay.select("s.doc_id", "s.text_key"), work_dir(spark, "stay"))
    row = stay.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).hint("merge")
    words = docs.where(~F.col("text").rlike(BLANK)).withColumn("__md5", F.unhex(F.md5(F.col("text").cast("binary"))))
    on = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__md5") == F.col("__key"))
    kept = words.join(row, on, "left_semi")
    rows = classes.join(row, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_key") == F.col("__key")), "left_semi")
    if rows.groupBy("doc_id", "text_key").count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates(["doc_id", "__md5"])  # the same row more than once
    return kept.select(*COLUMNS).unionByName(docs.where(F.col("text").isNull() | F.col("text").rlike(BLANK)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a row stands as often as the mix takes it (one without words once; equal rows
    each as often as the most taken of them)."""
    docs = docs.select(*COLUMNS)
    drawn = mixing.mix(docs).select("doc_id", "source", "text_key", F.when(F.col("size") > 0, F.col("copies")).otherwise(1).alias("copies"))
    drawn = drawn.groupBy(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("text_key").alias("__key")).agg(F.max("copies").alias("__copies"))
    on = F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__source")) & (F.xxhash64("text") == F.col("__key"))
    out = docs.join(drawn.hint("merge"), on).where("__copies > 0")
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 ids."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is a table in the shared work folder.

    A stage's work folders, and its input if a stage wrote it, go when its result is written.
    """
    docs = table(spark, sf_dir, "documents")
    base = work_dir(spark, "pipeline")
    since = mark()
    for k, (_, stage) in enumerate(STAGES):
        docs = materialise(stage(spark, docs, sf_dir), f"{base}/{k}")
        release(spark, since)
        if k:
            remove(spark, f"{base}/{k - 1}")
    return docs


#: The trees, the template tree and BagMinHash cannot be said in SQL; tests/llm holds the brute-force versions.
ORACLE_SQL = None
