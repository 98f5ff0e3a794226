"""Saving and loading: an index as Parquet tables with a manifest, a corpus as JSON lines, cache entries, reports.

Paths may be in any store that Spark reaches; manifests and reports are written and read by Spark as well.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findoc.operators.lexical import LexicalIndex

VERSION = 1


def checksum(table: DataFrame) -> str:
    """A digest of a table that does not depend on the order of its rows."""
    row = F.xxhash64(*[F.to_json(F.struct(*table.columns))])
    found = table.agg(F.count(F.lit(1)).alias("n"), F.sum(row.cast("decimal(38,0)")).alias("h")).first()
    return f"{found['n']}-{found['h'] or 0}"


def _write_text(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path, lineSep="\0")


def _read_text(spark: SparkSession, path: str) -> str:
    return "".join(r[0] for r in spark.read.text(path, wholetext=True).collect()).rstrip("\0")


def save_index(index: LexicalIndex, chunks: DataFrame, vectors: DataFrame | None, path: str, documents: DataFrame | None = None) -> dict:
    """Write chunks, postings, lengths, vectors and documents, each as Parquet, and last the manifest, which makes them an index."""
    spark, index = chunks.sparkSession, index.kept()
    tables = {"chunks": chunks, "postings": index.postings, "lengths": index.lengths} | {name: table for name, table in (("vectors", vectors), ("documents", documents)) if table is not None}
    manifest = {"version": VERSION, "k1": index.k1, "b": index.b, "saved_at": time.time(), "tables": {}}
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")
        manifest["tables"][name] = checksum(spark.read.parquet(f"{path}/{name}"))
    _write_text(spark, json.dumps(manifest), f"{path}/manifest")
    return manifest


def load_index(spark: SparkSession, path: str, verify: bool = True) -> tuple[LexicalIndex, DataFrame, DataFrame | None, dict]:
    """(index, chunks, vectors, manifest); a missing manifest or, if asked, a changed table is a ValueError."""
    try:
        manifest = json.loads(_read_text(spark, f"{path}/manifest"))
    except Exception as e:
        raise ValueError(f"no index at {path}") from e
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in manifest["tables"]}
    if verify:
        for name, kept in manifest["tables"].items():
            if checksum(tables[name]) != kept:
                raise ValueError(f"table {name} of the index at {path} has changed")
    return LexicalIndex(tables["lengths"], tables["postings"], manifest["k1"], manifest["b"]), tables["chunks"], tables.get("vectors"), manifest


def load_documents(spark: SparkSession, path: str) -> DataFrame:
    """The documents that were saved with an index; without any it is a ValueError."""
    if "documents" not in json.loads(_read_text(spark, f"{path}/manifest"))["tables"]:
        raise ValueError(f"the index at {path} holds no documents")
    return spark.read.parquet(f"{path}/documents")


def _store(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    return at, at.getFileSystem(conf), conf


def archive(spark: SparkSession, path: str, target: str) -> None:
    """All files below ``path`` in one zip file, for carrying an index elsewhere. Files stream through; none is held as a whole."""
    (source, files, conf), (out, store, _) = _store(spark, path), _store(spark, target)
    root = files.getFileStatus(source).getPath().toUri().getPath()
    packed = spark._jvm.java.util.zip.ZipOutputStream(store.create(out, True))
    found = files.listFiles(source, True)
    while found.hasNext():
        at = found.next().getPath()
        packed.putNextEntry(spark._jvm.java.util.zip.ZipEntry(at.toUri().getPath()[len(root) :].lstrip("/")))
        stream = files.open(at)
        spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, packed, conf, False)
        stream.close()
        packed.closeEntry()
    packed.close()


def unarchive(spark: SparkSession, source: str, path: str) -> None:
    """What ``archive`` packed, below ``path`` again; names that lead out of it are a ValueError."""
    (zipped, files, conf), (_, store, _) = _store(spark, source), _store(spark, path)
    packed = spark._jvm.java.util.zip.ZipInputStream(files.open(zipped))
    while (entry := packed.getNextEntry()) is not None:
        name = entry.getName()
        if name.startswith("/") or ".." in name.split("/"):
            raise ValueError(f"{name!r} leads out of the archive")
        out = store.create(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"), True)
        spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(packed, out, conf, False)
        out.close()
    packed.close()


def rebuild(documents: DataFrame) -> tuple[LexicalIndex, DataFrame, DataFrame]:
    """(index, chunks, vectors) of (doc_id, text), as an import makes them anew."""
    from findoc.operators import dense, lexical, parse

    chunks = parse.chunk_documents(documents).select("doc_id", "chunk_id", F.col("content").alias("text"), "modal_type")
    return lexical.fit(chunks), chunks, dense.embed(chunks)


def export_corpus(documents: DataFrame, path: str) -> None:
    """One JSON object a document, in as many files as there are partitions."""
    documents.write.mode("overwrite").json(path)


def import_corpus(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def save_entries(entries: DataFrame, path: str) -> None:
    """Cache entries; what is loaded again is what had not expired."""
    entries.write.mode("overwrite").parquet(path)


def load_entries(spark: SparkSession, path: str, now_s: float, ttl_s: float) -> DataFrame:
    return spark.read.parquet(path).where(F.lit(now_s) - F.col("created_at").cast("double") <= ttl_s)


def export_report(batch: DataFrame, path: str) -> None:
    """An audit row as JSON if the path ends so, else as Markdown."""
    from findoc.operators.grounding import report_markdown

    if path.endswith(".json"):
        batch.coalesce(1).write.mode("overwrite").json(path)
    else:
        _write_text(batch.sparkSession, report_markdown(batch).first()[0], path)
