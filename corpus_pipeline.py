"""The corpus pipeline: toxicity, exact dedup, n-gram Jaccard, mixing, packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from findoc.llm.common import join_counted, maybe_in, release, releasing, table, without, written
from findoc.llm.exact_dedup import exact_dedup
from findoc.llm.jaccard import jaccard_join
from findoc.llm.mixing import mix
from findoc.llm.packing import pack
from findoc.llm.tokens import vocabulary
from findoc.llm.toxicity import clean_rows, train_toxicity

#: Columns of documents; every stage but the last returns them.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: SQL cannot express a trained classifier, seeded draws or packing; the stages are tested against brute force.
ORACLE_SQL = None


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a written ``row`` key: ids may be null or repeat, rows are dropped by their own key."""
    return written(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "keyed")


def _first() -> Column:
    """What orders the rows of a group: the least doc_id stays, a null one only among nulls, and one row of equal ids."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row").alias("row"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the toxicity classifier scores under its threshold, each row by its own whole text.

    A null or empty text is scored as the empty one. Ids may be null or repeat; no rows give no rows.
    """
    with releasing(spark):
        model = train_toxicity(docs, table(spark, sf_dir, "labels"))
    return clean_rows(docs.select(*COLUMNS), model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text stays: the least doc_id, a null one only among nulls, one row of equal ids.

    A null text counts as the empty one. No rows give no rows.
    """
    rows, keep = _keyed(docs), []
    with releasing(spark, keep):
        verdicts = exact_dedup(rows.select(_first().alias("first"), "text"), id_col="first")
        keep.append(written(verdicts.where("not kept").select("doc_id.row"), "copies"))
    return without(rows, keep[0], "row").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies stays: the least doc_id, a null one only among nulls, one row of equal ids.

    Texts without words link with nothing and stay. No rows give no rows.
    """
    rows, keep = _keyed(docs), []
    with releasing(spark, keep):
        linked = jaccard_join(rows, id_col="row").where("component_id <> doc_id").select(F.col("doc_id").alias("row"), "component_id")
        linked = written(linked, "linked")
        members = linked.union(linked.select("component_id", "component_id").distinct())
        named = written(maybe_in(rows.select("row", "doc_id"), members, "row").join(members, "row"), "members")
        best = named.groupBy("component_id").agg(F.min(_first())["row"].alias("keep"), F.count(F.lit(1)).alias("_n"))
        verdicts = join_counted(named, written(best, "heads"), "component_id", "_n", "inner").where("row <> keep").select("row")
        keep.append(written(verdicts, "near-copies"))
    return without(rows, keep[0], "row").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix draws it, by shard and in the shard's shuffled order.

    Documents without words are never drawn; a null source is a source of its own. No rows give no rows.
    """
    shards = 64
    drawn = mix(docs, shards=shards, keep=COLUMNS).select("doc_id", *[F.col(c) for c in COLUMNS if c != "doc_id"], F.explode("draws").alias("draw"))
    placed = drawn.repartition(shards, "draw.shard").sortWithinPartitions("draw.shard", "draw.position", "doc_id")
    return placed.select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document with its sequence and offset; a document drawn several times is packed as often."""
    return pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard", drop_near_copies),
    ("mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage kept is written to the shared folder and read by the next.

    A stage's other tables go once its output is written, its input too; the result alone is left.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with releasing(spark, keep := []):
            keep.append(written(stage(spark, docs, sf_dir), name))
        release(docs)
        docs = keep[0]
    return docs
