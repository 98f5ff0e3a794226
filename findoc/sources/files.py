"""Files as sources: texts, JSON documents and pages, with metadata from their names; one bad file does not stop the others."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from findoc.functions.cleaning import clean_document

NAME = r"^([A-Za-z]{1,5})[_-]([A-Za-z0-9]+)[_-](20[0-9][0-9])[_-]?([Qq][1-4]|[Ff][Yy][0-9][0-9]?)?"
SUPPORTED = ("txt", "md", "csv", "json", "pdf")


def filename_metadata(name: Column) -> dict[str, Column]:
    """ticker, doc_type, year and period of names such as AAPL_10Q_2025_Q3.txt."""
    stem = F.regexp_replace(F.regexp_extract(name, r"([^/]*)$", 1), r"\.[^.]*$", "")
    part = lambda k: F.nullif(F.regexp_extract(stem, NAME, k), F.lit(""))
    return {"ticker": F.upper(part(1)), "doc_type": F.coalesce(F.upper(part(2)), F.lit("FILING")), "year": part(3).cast("int"), "period": F.upper(part(4))}


def read_texts(spark: SparkSession, path: str, recursive: bool = True, clean: bool = True) -> DataFrame:
    """(path, doc_id, text and the name's metadata) of the text files under ``path``; bytes that are no UTF-8 are replaced."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*.{txt,md,csv}").load(path)
    return _described(raw.select("path", F.col("content").cast("string").alias("text")), clean)


#: Whether a JSON object is a document that was parsed before: it has an id and chunks.
_CHUNKED = "get_json_object(value, '$.doc_id') IS NOT NULL AND get_json_object(value, '$.chunks') IS NOT NULL"
_DOCUMENT = "doc_id string, chunks array<struct<chunk_id:string,modal_type:string,content:string,page_number:int,section_title:string>>"


def _json_files(spark: SparkSession, path: str, recursive: bool) -> DataFrame:
    return spark.read.text(path, wholetext=True, recursiveFileLookup=recursive, pathGlobFilter="*.json").select(F.input_file_name().alias("path"), F.col("value"))


def read_json_chunks(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(path, doc_id, chunk_id, modal_type, content, page_number, section_title) of the JSON documents that hold their chunks; unknown fields are dropped."""
    rows = _json_files(spark, path, recursive).where(_CHUNKED).select("path", F.from_json("value", _DOCUMENT).alias("d"))
    chunks = rows.select("path", "d.doc_id", F.explode("d.chunks").alias("c")).select("path", "doc_id", "c.*")
    return chunks.withColumns({"page_number": F.greatest(F.lit(1), F.coalesce("page_number", F.lit(1))), "modal_type": F.coalesce("modal_type", F.lit("text"))})


def read_directory(spark: SparkSession, path: str, recursive: bool = True, clean: bool = True) -> tuple[DataFrame, DataFrame]:
    """(documents, errors) of all supported files under ``path``: texts, JSON and PDF; a bad file is an error row (path, error) and no document."""
    every = read_texts(spark, path, recursive, clean).unionByName(read_json(spark, path, recursive, clean))
    pages = read_pages(spark, path, recursive)
    every = every.unionByName(_described(join_pages(pages), clean))
    empty = F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "no text")
    errors = pages.where("error is not null").select("path", "error").unionByName(every.select("path", empty.alias("error")).where("error is not null"))
    return every.where(F.trim(F.coalesce("text", F.lit(""))) != ""), errors


def read_json(spark: SparkSession, path: str, recursive: bool = True, clean: bool = True) -> DataFrame:
    """As ``read_texts``, of one JSON object a file: its content, else its text, else the object itself."""
    raw = _json_files(spark, path, recursive).where(f"NOT ({_CHUNKED})")
    text = F.coalesce(F.get_json_object("value", "$.content"), F.get_json_object("value", "$.text"), F.get_json_object("value", "$.raw_text"), F.col("value"))
    return _described(raw.select("path", text.alias("text")), clean)


def read_pages(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(path, page_number, text, error) of PDF files; needs the optional library pypdf on the workers, else error says so."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*.pdf").load(path).select("path", "content")

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for name, content in zip(rows["path"], rows["content"], strict=True):
                try:
                    from pypdf import PdfReader

                    out += [(name, n, page.extract_text() or "", None) for n, page in enumerate(PdfReader(io.BytesIO(content)).pages, 1)]
                except Exception as e:  # a broken file is a row with its error
                    out.append((name, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "page_number", "text", "error"]).astype({"page_number": "Int32"})

    return raw.mapInPandas(pages, "path string, page_number int, text string, error string")


def join_pages(pages: DataFrame) -> DataFrame:
    """(path, text): the pages of a file in order, with a mark between them."""
    held = F.transform(F.array_sort(F.collect_list(F.struct("page_number", "text"))), lambda p: p["text"])
    return pages.where("error is null").groupBy("path").agg(F.array_join(held, "\n\n--- PAGE BREAK ---\n\n").alias("text"))


def _described(raw: DataFrame, clean: bool) -> DataFrame:
    text = clean_document(F.col("text")) if clean else F.col("text")
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"\.[^.]*$", "")
    return raw.select("path", stem.alias("doc_id"), text.alias("text"), *[c.alias(name) for name, c in filename_metadata(F.col("path")).items()])
