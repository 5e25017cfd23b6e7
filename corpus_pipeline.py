"""From raw documents to packed token sequences: five stages over whole tables.

Each stage takes (spark, docs, folder of the tables) and returns a DataFrame that is
written as Parquet and read again as the next stage's documents.  All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm.common import stored
from pageloom.llm.mixing import mixed_copies
from pageloom.llm.neardup import near_duplicates
from pageloom.llm.packing import packed
from pageloom.llm.quality import quality_verdicts
from pageloom.llm.substrings import without_repeats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep; each is judged against its own language.

    Null, empty and blank texts fail and go; a null language is one of its own; ids and sources play no part, so equal rows share
    their fate and ties do not arise.  Texts of any length are judged whole.  No rows in, none out; further columns go.
    """
    return _documents(quality_verdicts(docs, carry=COLUMNS).where("kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id.

    Rows that repeat an id count once, with the smallest row; a document without an id stays, and so does one without
    words, which is like no other.  Other columns may be null.  Of equally near copies the smallest id stays, whatever the texts.  No rows in,
    none out; further columns go.  Only ids to drop and repeated ids are joined, so texts move only where those are many.
    """
    rows = _documents(docs)
    dropped = near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    repeated = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    kept = rows.join(dropped, "doc_id", "left_anti").select(*COLUMNS)
    least = F.min(F.struct("text", "lang", "source", "n_chars")).alias("row")
    once = kept.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(least).select("doc_id", "row.*")
    return kept.join(repeated, "doc_id", "left_anti").select(*COLUMNS).unionByName(once)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that a smaller id holds; one of which nothing is left goes.

    A null text becomes the empty one, and a document without words stays; ``n_chars`` counts what is left.  Null ids rank
    last; rows of one id do not take passages from each other, so of equal ids all stay.  No rows in, none out; further columns go.
    """
    kept = without_repeats(docs, carry=("lang", "source"))
    return kept.where("n_removed < n_words OR n_words = 0").select(
        "doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; not at all if it takes none.

    A null source is a source of its own, a null or empty text has no words and goes with the others of its hash; one of a
    source without any words goes.  Rows of one id, null ids among them, are taken together, as ties are.  No rows in, none out;
    further columns go.
    """
    mix = mixed_copies(docs, carry=COLUMNS).where("copies > 0")
    return _documents(mix.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token ids: ``doc_id, start, length, doc_tokens, sequence_id, offset, ids``.

    A null or empty text is its end id alone; repeated rows are documents of their own, null ids stay null, and texts of any
    length are cut into pieces.  No rows in, none out; only ids and texts are read.
    """
    return packed(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("source mixing", source_mixing),
    ("packing", packing),
]

#: No SQL: rules, forest and packing are beyond it; ``tests/llm`` holds the stages against plain models.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
