"""Secret scan with corpus-wide ownership frequency.

A pass over every whole text finds base spans (assignments, access keys, long hex runs) and candidate tokens that no
base span covers. Values are hashed and counted by distinct repositories and distinct owners over the whole corpus. A value
that many owners hold, or many repositories, is a copied example; one that looks random and that few hold is treated as
live; the rest (a weak password, say) is neither. Live candidates are added to the spans. Base spans are always kept; the
counts only classify them.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findoc.llm.common import BATCH_ROWS, join_counted, map_batches, written

KINDS = ("assign", "access", "hex", "token")

ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # a run is taken whole, so a shorter run holds no match either
HEX = re.compile(r"[0-9a-f]{32,}")
#: Candidates of the method: long runs of token characters.
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")


def entropy(value: str) -> float:
    """Bits a character, from the value's own character counts."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def looks_random(value: str, least_bits: float = 3.0) -> bool:
    """Digits and letters mixed, with at least ``least_bits`` bits of entropy a character."""
    return any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and entropy(value) >= least_bits


def base_spans(text: str) -> list[tuple[int, str, int, str]]:
    """(start, kind number, end, value), by start and then kind; code points, end exclusive."""
    found = [(m.start(), "0", m.end(), m[1]) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    found += [(m.start(), "1", m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [(m.start(), "2", m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def extra_spans(text: str, base: list[tuple[int, str, int, str]]) -> list[tuple[int, str, int, str]]:
    """Candidate tokens that touch no base span (``base`` is by start) and look random."""
    out, at, reach = [], 0, 0
    for m in TOKEN.finditer(text):
        while at < len(base) and base[at][0] < m.end():
            reach = max(reach, base[at][2])
            at += 1
        if reach <= m.start() and looks_random(m[0]):
            out.append((m.start(), "3", m.end(), m[0]))
    return out


_FOUND = "array<struct<start:bigint,kind:int,end:bigint,hash:string,random:boolean>>"


def scan_texts(docs: DataFrame, id_col: str, text_col: str, repo_col: str, owner_col: str) -> DataFrame:
    """Per row: doc_id, repo, owner, the base counts and digest, and found spans with the hash of each value."""
    kind = dict(docs.dtypes)[id_col]
    kind = kind if kind in ("bigint", "int", "string") else "string"
    item = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("hash", pa.string()), ("random", pa.bool_())])

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, digests, found = [[], [], []], [], []
            for text in batch.column(3).to_pylist():
                base = base_spans(text or "")
                for k in range(3):
                    counts[k].append(sum(s[1] == str(k) for s in base))
                digests.append(hashlib.sha256(",".join(f"{KINDS[int(s[1])]}:{s[0]}:{s[2]}" for s in base).encode()).hexdigest())
                both = sorted(base + extra_spans(text or "", base))
                found.append([{"start": s[0], "kind": int(s[1]), "end": s[2], "hash": hashlib.sha256(s[3].encode()).hexdigest()[:32], "random": looks_random(s[3])} for s in both])
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests), pa.array(found, pa.list_(item))], ["doc_id", "repo", "owner", "n_assign", "n_access", "n_hex", "base_sha256", "found"])

        return each

    rows = docs.select(F.col(id_col).cast(kind).alias("doc_id"), F.col(repo_col).cast("string").alias("repo"), F.col(owner_col).cast("string").alias("owner"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, make, f"doc_id {kind}, repo string, owner string, n_assign long, n_access long, n_hex long, base_sha256 string, found {_FOUND}")


def ownership(spans: DataFrame) -> DataFrame:
    """(hash, n_spans, n_repos, n_owners) of (hash, repo, owner) rows. A null repository or owner counts as one of its own.

    Each step folds equal rows before they are shuffled, so a value that a third of the corpus holds costs a row a task.
    """
    some = spans.select("hash", F.coalesce("repo", F.lit("\0")).alias("repo"), F.coalesce("owner", F.lit("\0")).alias("owner"))
    repos = some.groupBy("hash", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    owners = repos.groupBy("hash", "owner").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("repos"))
    return owners.groupBy("hash").agg(F.sum("n").alias("n_spans"), F.sum("repos").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"))


def judgement(max_owners: int, max_repos: int) -> Column:
    """live, example or other, from random, n_owners and n_repos."""
    few = (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos)
    return F.when(~few, "example").when(F.col("random"), "live").otherwise("other")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", max_owners: int = 3, max_repos: int = 100) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, n_other, most_owners, most_repos.

    ``spans`` lists kind:start:end of the base spans and of the live candidate tokens. A value is an example where over
    ``max_owners`` owners or ``max_repos`` repositories hold it; else it is live if it looks random. The three counts add up
    to the spans; most_owners and most_repos are the greatest counts among the row's values, 0 without any. A null text is
    empty: no spans; a null repository or owner is one of its own; ids may be null. Found spans are written once and
    joined with their counts, so no text is shuffled; rows repeat as they come, and repeats count as one repository.
    """
    scanned = scan_texts(docs, id_col, text_col, repo_col, owner_col).withColumn("row", F.monotonically_increasing_id())
    scanned = written(scanned, "secret-spans", BATCH_ROWS)
    spans = scanned.select("row", "repo", "owner", F.explode("found").alias("s")).select("row", "repo", "owner", "s.*")
    owned = written(ownership(spans).withColumnRenamed("n_spans", "_n"), "owned")
    judged = join_counted(spans.select("row", "hash", "start", "kind", "end", "random"), owned, "hash", "_n", "inner").withColumn("verdict", judgement(max_owners, max_repos))
    judged = judged.where((F.col("kind") < 3) | (F.col("verdict") == "live"))
    one = F.struct("start", "kind", "end", "verdict")
    per_row = judged.groupBy("row").agg(F.array_sort(F.collect_list(one)).alias("all"), F.max("n_owners").alias("most_owners"), F.max("n_repos").alias("most_repos"))
    joined = scanned.drop("found", "repo", "owner").join(per_row, "row", "left").withColumn("all", F.coalesce("all", F.array().cast("array<struct<start:bigint,kind:int,end:bigint,verdict:string>>")))
    text = F.transform("all", lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")))
    counts = [(F.size("all") - F.size(F.array_remove(F.transform("all", lambda s: s["verdict"]), v))).cast("long").alias(f"n_{v}") for v in ("live", "example", "other")]
    most = [F.coalesce(c, F.lit(0)).alias(c) for c in ("most_owners", "most_repos")]
    return joined.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.array_join(text, ",").alias("spans"), *counts, *most)
