"""N-gram Jaccard self-join with adaptive multi-match prefixes.

Every text is a set of distinct word shingles, held as 64-bit hashes. Sets are sorted by a global order, rare shingles
first, that follows counts over all documents in a sketch of fixed size (the order decides the work, never the result).
If two sets of sizes x and y link, the first ``x - ceil(t x) + l`` and ``y - ceil(t y) + l`` shingles of theirs share at
least l. Each document picks its own l: a longer prefix costs more postings but asks for more shared shingles before a
pair is verified; the choice that costs least by the sketch's estimate of candidates is taken. A pair of sizes x and y needs an overlap of
o = ceil(t (x + y) / (1 + t)), so of its shared shingles only those count that stand among the first x - o + l and
y - o + l, and with the smaller l of the two there must be l of them.

Equal sets fold into one class first. Pairs are then found in two phases, so that a group of n near copies costs about n
verifications, not n squared: first each member of a shingle's list is paired with one head of the list, the member
whose own prefix holds the largest share of shingles that others hold too, the pairs that share l of them are verified and
components are formed; then the lists that still hold two components or more give every pair of different components that
shares l. The second phase is exact: a link between components is a pair that it verifies. Long lists are dealt into salted
parts, and two parts of a list meet in a task of their own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findoc.llm.common import BATCH_ROWS, few, join_counted, map_batches, maybe_in, release, written
from findoc.llm.components import components
from findoc.llm.shingles import mixed, shingles

#: Counters of the sketch that orders shingles (8 MB), its bits, and how many counters make a row.
BITS = 21
COUNTERS, CHUNK = 1 << BITS, 1 << 13
#: The most matches that a prefix asks for, and what a verification costs in postings.
MOST_MATCHES, VERIFY = 4, 10
#: Signatures that a task remembers, so that copies count once; forgetting them costs work, never a result.
REMEMBERED = 1 << 16
#: A shingle's list is dealt into salted parts of about this many rows, or 1 / 512 of all documents.
PART = 1000


def signature(tokens: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums over a set's shingles."""
    with np.errstate(over="ignore"):
        one, two = mixed(tokens ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64), mixed(tokens * np.uint64(0xD1342543DE82EF95)).sum(dtype=np.uint64)
    return int(np.int64(one)), int(np.int64(two))


def _id_kind(docs: DataFrame, id_col: str) -> str:
    kind = dict(docs.dtypes)[id_col]
    return kind if kind in ("bigint", "int", "string") else "string"


def _packed(counts: np.ndarray) -> bytes:
    """A part of a sketch: places and counts where most are zero, else all counts, compressed."""
    at = np.flatnonzero(counts)
    kind = "<u1" if counts.max() < 1 << 8 else "<u4"
    if 4 * len(at) < len(counts):
        return b"s" + kind[-1].encode() + zlib.compress(at.astype("<u2").tobytes() + counts[at].astype(kind).tobytes(), 1)
    return b"d" + kind[-1].encode() + zlib.compress(counts.astype(kind).tobytes(), 1)


def _add_packed(sums: np.ndarray, part: bytes) -> None:
    raw, width = zlib.decompress(part[2:]), int(part[1:2])
    if part[:1] == b"d":
        sums += np.frombuffer(raw, dtype=f"<u{width}")
    else:
        n = len(raw) // (2 + width)
        sums[np.frombuffer(raw[: 2 * n], dtype="<u2")] += np.frombuffer(raw[2 * n :], dtype=f"<u{width}")


def describe(docs: DataFrame, width: int) -> DataFrame:
    """Rows of two sorts in one pass: (doc_id, n, s1, s2) for each document, (chunk, counts) for parts of each task's sketch."""
    kind = _id_kind(docs, "doc_id")
    names = ["doc_id", "n", "s1", "s2", "chunk", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, id_type, seen = np.zeros(COUNTERS, dtype=np.uint32), None, set()
        for batch in (whole.slice(at, BATCH_ROWS) for whole in batches for at in range(0, whole.num_rows, BATCH_ROWS)):
            n, one, two = [], [], []
            if len(seen) > REMEMBERED:
                seen.clear()
            for text in batch.column(1).to_pylist():
                tokens = shingles(text, width)
                n.append(len(tokens))
                s = signature(tokens)
                if s not in seen:
                    seen.add(s)
                    np.add.at(counts, (tokens >> np.uint64(64 - BITS)).astype(np.int64), np.uint32(1))
                one.append(s[0])
                two.append(s[1])
            id_type = batch.column(0).type
            empty = pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), *empty], names)
        for k in np.flatnonzero(counts.reshape(-1, CHUNK).any(axis=1)):
            part = _packed(counts[k * CHUNK : (k + 1) * CHUNK])
            yield pa.RecordBatch.from_arrays([pa.nulls(1, id_type), *(pa.nulls(1, pa.int64()) for _ in range(3)), pa.array([k], pa.int32()), pa.array([part], pa.binary())], names)

    return docs.mapInArrow(run, f"doc_id {kind}, n long, s1 long, s2 long, chunk int, counts binary")


def sketch(described: DataFrame) -> np.ndarray:
    """The tasks' sketches added up; only its fixed size reaches the driver. Parts stream, so no group is gathered."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums.setdefault(k, np.zeros(CHUNK, dtype=np.uint64))
                _add_packed(sums[k], part)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.astype("<u8").tobytes() for v in sums.values()], pa.binary())], ["chunk", "counts"])

    parts = described.where("chunk is not null").select("chunk", "counts")
    counts = np.zeros(COUNTERS, dtype=np.uint64)
    for row in parts.repartition("chunk").mapInArrow(add, "chunk int, counts binary").collect():
        counts[row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] += np.frombuffer(row["counts"], dtype="<u8")
    return np.minimum(counts, 0xFFFFFFFF).astype(np.uint32)


def choose_matches(frequency: np.ndarray, base: int, most: int, n_docs: int, verify: float = VERIFY) -> int:
    """The l whose prefix, the first ``base + l - 1`` shingles, costs least: its postings, and ``verify`` for each candidate.

    ``frequency`` holds how many other documents have each shingle. As if shingles fell independently, about
    e_l(frequency) / n_docs ** (l - 1) documents share l of them (e_l: the elementary symmetric polynomial); and no more than
    1 / l of all postings, for each such document takes l.
    """
    f = frequency[: base + most - 1].astype(np.float64)
    reached, lists = np.ones(len(f)), np.cumsum(f)
    best, cost = 1, None
    for l in range(1, most + 1):
        # reached[i]: documents estimated to share l of the first i + 1
        reached = np.cumsum(f * (reached if l == 1 else np.concatenate(([0.0], reached[:-1])) / max(n_docs, 1)))
        at = min(base + l - 1, len(f)) - 1
        total = lists[at] + verify * min(reached[at], lists[at] / l)
        if cost is None or total < cost:
            best, cost = l, total
    return best


def postings(docs: DataFrame, counts: np.ndarray, width: int, percent: int, n_docs: int) -> DataFrame:
    """(token, salt, s1, n, pos, l, share) of every class's prefix: the set's size, the shingle's place in the order, the l
    chosen, and how many 255ths of the set the sketch shows to be common."""
    noise = float(counts.sum()) / COUNTERS
    part, common, most = max(PART, n_docs / 512), noise + 4 * noise**0.5 + 4, MOST_MATCHES

    def make():
        seen: set[int] = set()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            token, salt, one, size, place, chosen, share = [], [], [], [], [], [], []
            if len(seen) > REMEMBERED:
                seen.clear()
            for text in batch.column(0).to_pylist():
                tokens = shingles(text, width)
                n = len(tokens)
                if not n:
                    continue
                s = signature(tokens)
                if s in seen:
                    continue
                seen.add(s)
                count = counts[(tokens >> np.uint64(64 - BITS)).astype(np.int64)]
                least = -(-percent * n // 100)
                base = n - least + 1
                take = min(n, base + most - 1)
                order = np.lexsort((tokens, count)) if take == n else np.argpartition(count, take - 1)
                if take < n:  # ties at the border must be cut by the same order everywhere
                    edge = count[order[take - 1]]
                    sure = np.flatnonzero(count <= edge)
                    order = sure[np.lexsort((tokens[sure], count[sure]))]
                order = order[:take]
                rare = np.maximum(count[order].astype(np.float64) - noise, 0)
                # what a pair of equal sizes reads, which is what most candidates are
                equal = n - -(-2 * percent * n // (100 + percent)) + 1
                l = choose_matches(np.maximum(count[order] - common, 0), equal, min(most, least, take - base + 1), n_docs)
                order, rare = order[: base + l - 1], rare[: base + l - 1]
                parts = np.ceil(rare / part).astype(np.int64)
                token.append(tokens[order].view(np.int64))
                salt.append(np.where(parts > 1, 1 + (s[0] & 0x7FFFFFFF) % np.maximum(parts, 1), 0))
                one.append(np.full(len(order), s[0], dtype=np.int64))
                size.append(np.full(len(order), n, dtype=np.int32))
                place.append(np.arange(len(order), dtype=np.int32))
                chosen.append(np.full(len(order), l, dtype=np.int8))
                share.append(np.full(len(order), int(255 * (count > common).mean()), dtype=np.int16))
            columns = [(np.concatenate(x) if x else np.zeros(0)).astype(kind) for x, kind in ((token, np.int64), (salt, np.int16), (one, np.int64), (size, np.int32), (place, np.int32), (chosen, np.int8), (share, np.int16))]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["token", "salt", "s1", "n", "pos", "l", "share"])

        return each

    return map_batches(docs.select("text"), make, "token long, salt smallint, s1 long, n int, pos int, l tinyint, share smallint")


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The (a, b) whose whole sets overlap enough; ``texts`` has (node, text). Nothing is grouped, so a node with many pairs is no hot group."""
    kind = dict(pairs.dtypes)["a"]
    left, right = texts.toDF("a", "ta"), texts.toDF("b", "tb")
    rows = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "ta", "tb")

    def make():
        last: dict[str, np.ndarray] = {}

        def of(text: str) -> np.ndarray:
            if text not in last:
                if len(last) >= 32:
                    last.pop(next(iter(last)))
                last[text] = shingles(text, width)
            return last[text]

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            keep = []
            for ta, tb in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = of(ta), of(tb)
                if percent * max(len(x), len(y)) > 100 * min(len(x), len(y)):
                    keep.append(False)
                    continue
                shared = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

        return each

    return map_batches(rows, make, f"a {kind}, b {kind}")


def _counts(x: str, y: str, percent: int) -> Column:
    """Whether a shingle that x and y share counts for the pair: the sizes can link and it stands within both prefixes."""
    nx, ny = F.col(f"{x}n"), F.col(f"{y}n")
    overlap = F.ceil(percent * (nx + ny) / (100 + percent) - 1e-9)
    extra = F.least(f"{x}l", f"{y}l") - 1
    sizes = (100 * nx >= percent * ny) & (100 * ny >= percent * nx)
    return sizes & (F.col(f"{x}pos") <= nx - overlap + extra) & (F.col(f"{y}pos") <= ny - overlap + extra)


def _star_pairs(live: DataFrame, percent: int) -> DataFrame:
    """(x, y) of s1: each member with the heads of its parts of lists, the best two of those that share enough with it.

    The heads of a list's parts, one for some PART members, are paired with the list's head as they are: without that a group
    that fills several parts would fall apart and meet again member by member.
    """
    near = live.where("s1 <> h.s1").where(_counts("", "h.", percent)).select(F.col("s1").alias("x"), F.col("h.s1").alias("y"), F.least("l", "h.l").alias("l"))
    shared = near.groupBy("x", "y").agg(F.count(F.lit(1)).alias("shared"), F.max("l").alias("l")).where("shared >= l")
    best = shared.groupBy("x").agg(F.max(F.struct("shared", "y")).alias("one"), F.max_by("y", F.struct(F.col("shared") >= 3, "y")).alias("two"))
    best = best.select("x", F.explode(F.array_distinct(F.array("one.y", "two"))).alias("y"))
    parted = live.where("salt > 0").groupBy("token", "salt").agg(F.max("h").alias("h"))
    tops = parted.groupBy("token").agg(F.max("h").alias("t"))
    across = parted.join(tops, "token").where("h.s1 <> t.s1").select(F.col("h.s1").alias("x"), F.col("t.s1").alias("y"))
    return best.union(across).distinct()


def _mixed_lists(named: DataFrame) -> DataFrame:
    """(list, s1, n, pos, l, part, major, parts, m): the lists that hold several components, equal ones folded into one.

    Texts that share much are together in many lists of the same members: such a list stands for its ``m`` shingles, each
    member with the least place that it has in one of them. ``major`` is the list's largest component, ``parts`` how many
    parts it is joined in. Short lists are decided by windows over one shuffle; salted ones, of any length, by aggregates.
    """
    of_part, of_list = Window.partitionBy("token", "part"), Window.partitionBy("token")
    marks = {"f1": F.bit_xor(F.xxhash64("s1")), "f2": F.bit_xor(F.xxhash64("s1", F.lit(1))), "k": F.count(F.lit(1))}
    short = named.where("salt = 0").repartition("token").withColumn("own", F.count(F.lit(1)).over(of_part))
    short = short.withColumns({"major": F.max(F.struct("own", "part")).over(of_list)["part"], "low": F.min("part").over(of_list), "high": F.max("part").over(of_list)} | {name: f.over(of_list) for name, f in marks.items()}).where("low <> high").drop("own", "low", "high")
    long = named.where("salt > 0")
    sizes = long.groupBy("token", "part").agg(F.count(F.lit(1)).alias("own"), F.bit_xor(F.xxhash64("s1")).alias("f1"), F.bit_xor(F.xxhash64("s1", F.lit(1))).alias("f2"))
    majors = sizes.groupBy("token").agg(F.count(F.lit(1)).alias("several"), F.max_by("part", F.struct("own", "part")).alias("major"), F.bit_xor("f1").alias("f1"), F.bit_xor("f2").alias("f2"), F.sum("own").alias("k")).where("several > 1").drop("several")
    every = short.unionByName(long.join(majors, "token"))
    folded = every.groupBy(F.struct("f1", "f2", "k").alias("list"), "s1").agg(F.max("n").alias("n"), F.min("pos").alias("pos"), F.max("l").alias("l"), F.max("part").alias("part"), F.max("major").alias("major"), F.count(F.lit(1)).alias("m"))
    return folded.withColumn("parts", F.ceil(F.col("list.k") / PART).cast("int"))


def _rest_pairs(live: DataFrame, parts: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(x, y) of s1 in different components that share enough prefix shingles, and the table they come from. ``parts``: (s1, part) where it is known.

    A list of p parts is p times p tiles: one side's rows go to a row of tiles, the other's to a column, so that no task
    joins a whole long list with itself.
    """
    named = live.select("token", "salt", "s1", "n", "pos", "l").join(parts, "s1", "left").withColumn("part", F.coalesce("part", "s1"))
    rest = written(_mixed_lists(named), "mixed-lists")
    own, every = F.pmod(F.xxhash64("s1", F.lit(3)), F.col("parts")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    # one side is never of the list's largest component, so a large component is not joined with itself
    o = rest.where("part <> major").withColumn("one", own).withColumn("two", every).alias("o")
    r = rest.withColumn("two", own).withColumn("one", every).alias("r")
    tile = (F.col("o.list") == F.col("r.list")) & (F.col("o.one") == F.col("r.one")) & (F.col("o.two") == F.col("r.two"))
    fits = tile & (F.col("o.part") != F.col("r.part")) & ((F.col("r.part") == F.col("r.major")) | (F.col("o.s1") < F.col("r.s1")))
    pairs = o.join(r, fits & _counts("o.", "r.", percent)).select(F.least("o.s1", "r.s1").alias("x"), F.greatest("o.s1", "r.s1").alias("y"), F.least("o.l", "r.l").alias("l"), F.col("o.m").alias("m"))
    return pairs.groupBy("x", "y").agg(F.sum("m").alias("shared"), F.max("l").alias("l")).where("shared >= l").select("x", "y"), rest


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the least id reachable by links, its own included).

    Two documents link when 100 times their sets' intersection is at least ``percent`` times the union. A text with
    fewer than ``width`` words is one shingle; null texts and texts without words have none and link with nothing. Rows
    may repeat, but rows of one id must have one text. A row with a null id has a null component. No rows give no rows.
    """
    kind = _id_kind(docs, id_col)
    rows = docs.select(F.col(id_col).cast(kind).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    both = written(describe(rows, width), "described", BATCH_ROWS)
    sets = both.where("chunk is null").select("doc_id", "n", "s1", "s2")
    n_docs = sets.count()
    whole = postings(rows.where("doc_id is not null"), sketch(both), width, percent, n_docs)
    span = Window.partitionBy("token", "salt")
    head = F.max(F.struct("share", "s1", "n", "pos", "l")).over(span)
    live = whole.withColumns({"least": F.min("s1").over(span), "most": F.max("s1").over(span), "h": head}).where("salt > 0 or least <> most")
    # a class that several tasks met has equal rows, which are in one partition by now
    live = written(live.select("token", "salt", "s1", "n", "pos", "l", F.struct("h.s1", "h.n", "h.pos", "h.l").alias("h")).dropDuplicates(["token", "salt", "s1"]), "live-postings", BATCH_ROWS)
    n_live = live.count()
    classes = sets.where("n > 0 and doc_id is not null").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("members"))
    nodes = written(few(few(classes, n_docs).select("s1", "node").join(few(live.select("s1").distinct(), n_live), "s1"), n_docs), "live-classes")
    known = rows.where("doc_id is not null").withColumnRenamed("doc_id", "node")

    def check(pairs: DataFrame) -> DataFrame:
        named = few(few(pairs, n_live).join(nodes.toDF("x", "a"), "x"), n_live).join(nodes.toDF("y", "b"), "y")
        named = written(few(named.where("a <> b").select("a", "b"), n_live), "pairs")
        asked = written(few(named.select(F.explode(F.array("a", "b")).alias("node")).distinct(), n_docs), "asked")
        texts = written(maybe_in(known, asked, "node").join(asked, "node", "left_semi").dropDuplicates(["node"]), "texts")
        links = written(verified(named, texts, width, percent), "links", BATCH_ROWS)
        release(named, asked, texts)
        return links

    links = check(_star_pairs(live, percent))
    first = components(links, "a", "b")
    # labels in terms of s1; an s1 of several classes stays by itself, so that no pair of it is passed over
    single = nodes.groupBy("s1").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("k")).where("k = 1").select("s1", "node")
    parts = few(single, n_docs).join(first, "node").select("s1", F.col("component").alias("node")).join(nodes.select("node", F.col("s1").alias("part")), "node").select("s1", "part")
    parts = written(few(parts, n_docs), "parts")
    pairs, rest = _rest_pairs(live, parts, percent)
    more = check(pairs)
    label = components(first.toDF("a", "b").union(more), "a", "b")
    release(live, nodes, links, parts, rest, more, first)
    named = classes.join(label.withColumnRenamed("component", "c"), "node", "left").select(F.struct("s1", "s2", "n").alias("class"), F.coalesce("c", "node").alias("component_id"), "members")
    named = written(named, "classes")
    release(label)
    # a class may hold a third of all rows
    out = join_counted(sets.withColumn("class", F.struct("s1", "s2", "n")), named, "class", "members")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).otherwise(F.col("doc_id")).alias("component_id"))
