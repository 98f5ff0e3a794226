"""A property graph as two relations: nodes (id, node_type, label, properties) and edges (source, target, relation, weight, seq)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """One row an id: type (upper case) and label of its first row by ``seq``, properties merged, later ones first.

    Properties are (key, value) of their own rows until then, so no map of an unbounded number of rows is built up.
    """
    first = nodes.groupBy("id").agg(F.min_by(F.struct(F.upper("node_type").alias("node_type"), "label"), "seq").alias("n")).select("id", "n.node_type", "n.label")
    last = nodes.select("id", "seq", F.explode("properties").alias("key", "value")).groupBy("id", "key").agg(F.max_by("value", "seq").alias("value"))
    merged = last.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("properties"))
    empty = F.create_map().cast("map<string,string>")
    return first.join(merged, "id", "left").withColumn("properties", F.coalesce("properties", empty))


def complete_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes`` and an ENTITY for each end of an edge that is none of them."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct().join(nodes.select("id"), "id", "left_anti")
    return nodes.unionByName(ends.select("id", F.lit("ENTITY").alias("node_type"), F.col("id").alias("label"), F.create_map().cast("map<string,string>").alias("properties")))


def neighbours(edges: DataFrame, starts: DataFrame, relation: str | None = None, direction: str = "out") -> DataFrame:
    """(start, id) for each edge from (to) a start; parallel edges count each."""
    kept = edges if relation is None else edges.where(F.upper("relation") == relation.upper())
    out = kept.select(F.col("source").alias("start"), F.col("target").alias("id"))
    back = kept.select(F.col("target").alias("start"), F.col("source").alias("id"))
    both = {"out": out, "in": back, "both": out.unionByName(back)}[direction]
    return both.join(starts.select(F.col("id").alias("start")).distinct(), "start", "left_semi")


def multi_hop(edges: DataFrame, starts: DataFrame, path: list[str]) -> DataFrame:
    """(start, id): what a path of relations leads to, each once a start."""
    reached = starts.select(F.col("id").alias("start"), "id").distinct()
    for relation in path:
        step = edges.where(F.upper("relation") == relation.upper()).select(F.col("source").alias("id"), F.col("target").alias("next"))
        reached = reached.join(step, "id").select("start", F.col("next").alias("id")).distinct()
    return reached


def from_documents(metadata: DataFrame, metrics: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of filings: tickers report periods, periods have metrics and are exposed to risks.

    ``metadata``: (doc_id, ticker, year, period); ``metrics``: (doc_id, name, normalized, unit, scale);
    ``chunks``: (doc_id, chunk_id, section_title, content).
    """
    ticker, period = F.coalesce("ticker", F.lit("UNKNOWN")), F.concat_ws("_", F.coalesce(F.col("year").cast("string"), F.lit("2025")), F.coalesce("period", F.lit("FY")))
    m = metadata.select("doc_id", ticker.alias("t"), period.alias("p"), "year", "period")
    m = m.withColumns({"tid": F.concat(F.lit("TICKER_"), "t"), "pid": F.concat_ws("_", F.lit("PERIOD"), "t", "p")})
    x = metrics.join(m, "doc_id").withColumn("id", F.concat_ws("_", F.lit("METRIC"), "t", "p", "name"))
    r = chunks.where(F.contains(F.lower("section_title"), F.lit("risk"))).join(m, "doc_id").withColumn("id", F.concat(F.lit("RISK_"), F.col("chunk_id").cast("string")))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    node = lambda rows, key, kind, label, properties: rows.select(F.col(key).alias("id"), F.lit(kind).alias("node_type"), label.alias("label"), properties.alias("properties"), F.col("doc_id").cast("long").alias("seq"))
    nodes = node(m, "tid", "TICKER", F.col("t"), F.create_map(F.lit("ticker"), F.col("t")))
    nodes = nodes.unionByName(node(m, "pid", "PERIOD", F.concat_ws(" ", "t", "p"), F.create_map(F.lit("year"), text("year"), F.lit("period"), text("period"))))
    nodes = nodes.unionByName(node(x, "id", "METRIC", F.col("name"), F.create_map(F.lit("value"), text("normalized"), F.lit("unit"), text("unit"), F.lit("scale"), text("scale"))))
    nodes = nodes.unionByName(node(r, "id", "RISK_FACTOR", F.concat(F.trim(F.substring("content", 1, 80)), F.lit("...")), F.create_map(F.lit("chunk_id"), text("chunk_id"))))
    edge = lambda rows, source, target, relation: rows.select(F.col(source).alias("source"), F.col(target).alias("target"), F.lit(relation).alias("relation"), F.lit(1.0).alias("weight"))
    edges = edge(m, "tid", "pid", "REPORTED_IN").unionByName(edge(x, "pid", "id", "HAS_METRIC")).unionByName(edge(r, "pid", "id", "EXPOSED_TO_RISK"))
    return merge_nodes(nodes), edges


def to_dot(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(line) in Graphviz's language, one row a node or edge; a caller adds the frame around them."""
    quoted = lambda c: F.replace(F.col(c), F.lit('"'), F.lit('\\"'))
    n = nodes.select(F.format_string('  "%s" [label="%s\\n(%s)"];', quoted("id"), quoted("label"), "node_type").alias("line"))
    return n.unionByName(edges.select(F.format_string('  "%s" -> "%s" [label="%s"];', quoted("source"), quoted("target"), F.upper("relation")).alias("line")))
