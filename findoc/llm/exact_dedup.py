"""Exact deduplication through a log-structured merge index of digests, in DataFrame operations only.

Every input split fills a memtable (a partial aggregation by digest); the memtables are flushed as runs sorted by digest.
Compaction merges ``fan_in`` runs of a level into one of the next, level by level until one run is left, and keeps for each
digest the smallest identifier in the order asked for and the number of rows. The last run carries a filter of the digests
that came more than once. Documents whose digest passes the filter look it up in the run; the texts of those hits are
compared byte by byte, and digests under which texts differ are resolved by the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findoc.llm.common import filter_of, join_counted, passing, release, written

#: Memtables of a flush.
MEMTABLES = 16


class DigestIndex:
    """Runs of (digest, keep_id, n), sorted by digest, in the shared folder.

    ``levels`` holds for each level its table and how many runs that has. A table takes the place of another only once its
    write is complete, so a lost executor or a repeated task leaves the index as it was.
    """

    def __init__(self, spark, keep: str = "smallest", fan_in: int = 4):
        if keep not in ("smallest", "largest"):
            raise ValueError("keep is 'smallest' or 'largest'")
        self.spark, self.fan_in = spark, max(2, fan_in)
        self.best = F.min if keep == "smallest" else F.max
        self.levels: list[tuple[list[DataFrame], int]] = [([], 0)]
        self.history: list[int] = []  # runs that compactions took in
        self.filter: DataFrame | None = None

    def _merged(self, rows: DataFrame, *keys: Column | str) -> DataFrame:
        return rows.groupBy(*keys).agg(self.best("keep_id").alias("keep_id"), F.sum("n").alias("n"))

    def _put(self, level: int, tables: list[DataFrame], runs: int) -> None:
        self.levels += [([], 0)] * (level + 1 - len(self.levels))
        self.levels[level] = (tables, runs)

    def flush(self, entries: DataFrame, memtables: int = MEMTABLES) -> None:
        """``entries``: (digest, id). Each memtable takes every memtables-th input split and becomes one sorted run of level 0."""
        tables, runs = self.levels[0]
        run = F.pmod(F.spark_partition_id(), F.lit(memtables)) + runs
        filled = self._merged(entries.select(run.alias("run"), "digest", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("n")), "run", "digest")
        self._put(0, [*tables, written(filled.sortWithinPartitions("run", "digest"), "level-0")], runs + memtables)
        if self.filter is not None:
            release(self.filter)
            self.filter = None

    def compact(self) -> DataFrame:
        """Merge level after level, ``fan_in`` runs into one, until a single run is left; its repeated digests become the filter."""
        level = 0
        while level < len(self.levels) - 1 or self.levels[level][1] > 1:
            tables, runs = self.levels[level]
            if runs:
                there, own = self.levels[level + 1] if level + 1 < len(self.levels) else ([], 0)
                groups = -(-runs // self.fan_in)
                merged = self._merged(self._union(tables), F.floor(F.col("run") / self.fan_in).cast("int").alias("run"), "digest")
                if own:  # runs that are there already keep their numbers
                    merged = merged.withColumn("run", F.col("run") + own)
                new = written(merged.sortWithinPartitions("run", "digest"), f"level-{level + 1}")
                self.history.append(runs)
                self._put(level + 1, [*there, new], own + groups)
                self._put(level, [], 0)
                release(*tables)
            level += 1
        if self.filter is not None:
            release(self.filter)
        self.filter = written(filter_of(self.view().where("n > 1"), "digest").coalesce(4), "filter")
        return self.view()

    def _union(self, tables: list[DataFrame]) -> DataFrame:
        out = tables[0]
        for table in tables[1:]:
            out = out.unionByName(table)
        return out

    def view(self) -> DataFrame:
        """(digest, keep_id, n) over all runs; an index of one run is read as it is."""
        tables = [t for held, _ in self.levels for t in held]
        rows = self._union(tables).select("digest", "keep_id", "n")
        return rows if sum(n for _, n in self.levels) == 1 else self._merged(rows, "digest")

    def hits(self, rows: DataFrame) -> DataFrame:
        """The ``rows`` (with a digest) that may be of a repeated digest, by the filter of the last compaction."""
        return passing(rows, self.filter, "digest")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", digest_bits: int = 256, normalise: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the smallest (or largest) id stays. A null text counts as the empty text. A null id
    stays only where all ids of its texts are null. Rows that repeat both id and text all count in group_size and all
    carry the verdict of that id. No rows give no rows. Other columns of ``docs`` are ignored, whatever their names.
    ``normalise`` maps the text before it is compared; ``digest_bits`` under 256 shortens the index's key.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")) if normalise is None else F.coalesce(normalise, F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("sha", F.sha2("text", 256))
    rows = rows.withColumn("digest", F.substring("sha", 1, digest_bits // 4))
    index = DigestIndex(spark, keep)
    index.flush(rows.select("digest", "id"))
    view = index.compact()
    shared = view.where("n > 1").withColumnsRenamed({"keep_id": "_keep", "n": "_n"})
    hits = index.hits(rows.select("digest", "text", "id"))
    # the bytes decide: texts of one digest that are equal fold into one row before they are shuffled
    classes = hits.groupBy("digest", "text").agg(index.best("id").alias("_text_keep"), F.count(F.lit(1)).alias("_text_n"))
    clash = classes.groupBy("digest").count().where("count > 1").select("digest")
    found = join_counted(rows.select("id", "sha", "digest"), shared, "digest", "_n")
    keep_id, size = F.when(F.col("_n").isNull(), F.col("id")).otherwise(F.col("_keep")), F.coalesce("_n", F.lit(1))
    if not clash.isEmpty():
        texts = classes.join(clash, "digest").select("text", "_text_keep", "_text_n")
        found = join_counted(rows, shared, "digest", "_n").join(texts, "text", "left")
        keep_id, size = F.when(F.col("_text_n").isNull(), keep_id).otherwise(F.col("_text_keep")), F.coalesce("_text_n", size)
    out = found.select(F.col("id").alias("doc_id"), keep_id.alias("keep_id"), size.cast("long").alias("group_size"), F.col("sha").alias("text_sha256"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
