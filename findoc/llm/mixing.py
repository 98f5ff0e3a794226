"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree over block quotas.

Each source's documents are dealt by a hash into blocks. The mix takes every source's blocks ``floor(target / size)``
times in whole passes and, in a last pass, those of its permuted blocks that still fit; the first that does not is cut into
smaller blocks in the same way until few documents are left, which are taken one by one, so that the words taken come
nearer to the target than half a document of these. The draws of each source are its
exact quota of blocks. A tree splits the quotas among the output shards: at each node the left half's counts are drawn
from the multivariate hypergeometric distribution, so every shard is a simple random sample of the whole mix and the
quotas hold exactly. A shard's blocks are consecutive in the source's permuted order, hence disjoint, and documents are
shuffled within a shard by a seeded hash. The driver holds numbers per source and per block only.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findoc.llm.common import release, written

#: Blocks of all sources together, at most one more for each source; a source has blocks in proportion to its words.
BLOCKS = 4096
#: A border block of more documents is cut into blocks of about this many, again and again.
BORDER = 2048
#: Sources whose numbers the driver holds and broadcasts (under 100 bytes each).
MAX_SOURCES = 100_000
#: Words as the contract counts them.
WORD = r"[^\x20\x09-\x0D]+"


def weights_by_order(names: list[str | None], cycle: tuple[float, ...] = (5, 2, 1)) -> dict[str | None, float]:
    """Weights repeat over the sources by code point; null comes last."""
    order = sorted((n for n in names if n is not None), key=lambda n: [ord(c) for c in n]) + [None] * (None in names)
    return {n: cycle[k % len(cycle)] for k, n in enumerate(order)}


def water_fill(sizes: dict, weights: dict, total: float, most: float = 3.0) -> dict:
    """Targets by weight that sum to ``total``, none above ``most`` times its source's size; the excess is shared again."""
    target, left, free = {k: 0.0 for k in sizes}, float(total), [k for k in sizes if sizes[k] > 0]
    while free:
        share = sum(weights[k] for k in free)
        over = [k for k in free if left * weights[k] / share > most * sizes[k]]
        if not over:
            return target | {k: left * weights[k] / share for k in free}
        for k in over:
            target[k] = float(most * sizes[k])
        left -= sum(target[k] for k in over)
        free = [k for k in free if k not in over]
    return target


def splitting_tree(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """(shards, sources) counts that sum to ``quotas``; shard totals differ by one at most."""
    out = np.zeros((shards, len(quotas)), dtype=np.int64)

    def split(counts: np.ndarray, first: int, end: int) -> None:
        if end - first == 1:
            out[first] = counts
            return
        middle = (first + end) // 2
        n = int(counts.sum())
        take = n * (middle - first) // (end - first)
        rng = np.random.default_rng([seed, first, end])
        left = np.zeros_like(counts)
        rest = n
        for k, c in enumerate(counts):  # one hypergeometric draw after the other gives the multivariate one
            rest -= int(c)
            left[k] = rng.hypergeometric(int(c), rest, take) if take else 0
            take -= int(left[k])
        split(left, first, middle)
        split(counts - left, middle, end)

    if shards:
        split(np.asarray(quotas, dtype=np.int64), 0, shards)
    return out


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int = 64, seed: int = 8, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, draws, and the columns named in ``keep``.

    ``draws`` is an array of (pass, shard, position), one for each time that the mix takes the document; it is empty for
    one that is left out, so taken words are size * size(draws). A null text has size 0 and is never drawn; a null source is a source of
    its own. Rows that repeat id, source and size are drawn together; ids may be null. Whole texts are counted. No rows give no
    rows. Equal inputs give equal draws. Other columns of ``docs`` do not matter, whatever their names.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("_source"), size.alias("size"), *[F.col(c).alias(f"_keep_{c}") for c in keep])
    sizes = written(rows.select("doc_id", "_source", "size"), "sizes")
    sources = sizes.groupBy("_source").agg(F.sum("size").alias("words"))
    found = sources.limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    words = {r["_source"]: int(r["words"]) for r in found}
    total = sum(words.values())
    target = water_fill(words, weights_by_order(list(words)), total)
    names = sorted(words, key=lambda n: (n is None, n or ""))
    blocks = {n: max(1, -(-BLOCKS * words[n] // max(total, 1))) for n in names}
    passes = {n: int(target[n] // words[n]) if words[n] else 0 for n in names}
    schema = "_source string, _words long, _target double, _blocks int, _passes int, _rest double"
    facts = spark.createDataFrame([(n, words[n], target[n], blocks[n], passes[n], target[n] - passes[n] * words[n]) for n in names], schema)
    # a document's block, and its place in it
    block = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id").cast("string")), F.col("_blocks")).cast("int")
    dealt = sizes.join(F.broadcast(facts), sizes["_source"].eqNullSafe(facts["_source"])).drop(facts["_source"]).withColumn("block", block)
    sums: dict = {}
    for r in dealt.groupBy("_source", "block").agg(F.sum("size").alias("n")).collect():  # at most BLOCKS and one for each source
        sums.setdefault(r["_source"], {})[r["block"]] = int(r["n"])
    whole, border, quotas = {}, {}, []
    for n in names:
        order = np.random.default_rng([seed, names.index(n), 1]).permutation(blocks[n])
        rest, taken = target[n] - passes[n] * words[n], 0
        for b in order:
            own = sums.get(n, {}).get(int(b), 0)
            if taken + own <= rest:
                taken += own
                whole.setdefault(n, []).append(int(b))
            else:
                border.setdefault(n, (int(b), 0.0))
        if n in border:
            border[n] = (border[n][0], rest - taken)
        quotas.append(passes[n] * blocks[n] + len(whole.get(n, [])) + (n in border))
    tree = splitting_tree(np.array(quotas, dtype=np.int64), shards, seed)
    draws = []  # (source, block, pass, shard); the draw numbers of a source go to the shards in turn
    for k, n in enumerate(names):
        owner = np.repeat(np.arange(shards), tree[:, k])
        at = 0
        for p in range(passes[n] + 1):
            order = np.random.default_rng([seed, k, 2, p]).permutation(blocks[n]) if p < passes[n] else [*whole.get(n, []), *([border[n][0]] if n in border else [])]
            for b in order:
                draws.append((n, int(b), p, int(owner[at])))
                at += 1
    plan = spark.createDataFrame(draws, "_source string, block int, pass int, shard int")
    plan = plan.groupBy("_source", "block").agg(F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("_draws"))
    edges = spark.createDataFrame([(n, b) for n, (b, _) in border.items()], "_source string, block int")
    chosen = _border(dealt, edges, {n: float(left) for n, (_, left) in border.items()}, names, seed)
    both = rows.join(F.broadcast(facts), rows["_source"].eqNullSafe(facts["_source"])).drop(facts["_source"]).withColumn("block", block)
    both = both.join(F.broadcast(plan.withColumnsRenamed({"_source": "_s", "block": "_b"})), F.col("_source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")), "left")
    both = both.join(F.broadcast(edges.select(F.col("_source").alias("_es"), F.col("block").alias("_eb"))), F.col("_source").eqNullSafe(F.col("_es")) & (F.col("block") == F.col("_eb")), "left")
    # documents of a border block are drawn in the last pass only if they are chosen
    edge = both.where(F.col("_eb").isNotNull())
    picked = chosen.select(F.col("_source").alias("_ps"), F.col("doc_id").alias("_pd"), F.col("size").alias("_pn"), F.lit(True).alias("_chosen"))
    edge = edge.join(picked, F.col("_source").eqNullSafe(F.col("_ps")) & F.col("doc_id").eqNullSafe(F.col("_pd")) & (F.col("size") == F.col("_pn")), "left").drop("_ps", "_pd", "_pn")
    rest = both.where(F.col("_eb").isNull()).withColumn("_chosen", F.lit(True))
    last = F.filter("_draws", lambda d: (d["pass"] < F.col("_passes")) | F.coalesce("_chosen", F.lit(False)))
    place = F.transform(last, lambda d: F.struct(d["pass"].alias("pass"), d["shard"].alias("shard"), F.xxhash64(F.lit(seed), d["pass"], F.col("doc_id").cast("string")).alias("position")))
    empty = F.array().cast("array<struct<pass:int,shard:int,position:bigint>>")
    out = edge.unionByName(rest).withColumn("draws", F.when(F.col("size") > 0, F.coalesce(place, empty)).otherwise(empty))
    return out.select("doc_id", "size", F.col("_words").alias("source_size"), F.col("_target").alias("target"), "draws", *[F.col(f"_keep_{c}").alias(c) for c in keep if c not in ("doc_id", "size")])


def fit_one_by_one(sizes: list[int], left: float) -> list[bool]:
    """Which of ``sizes`` (descending) to take towards ``left``: those that still fit, then one more if that comes nearer."""
    kept = []
    for size in sizes:
        kept.append(size <= left)
        left -= size if kept[-1] else 0
    over = [(size, k) for k, size in enumerate(sizes) if not kept[k] and size < 2 * left]
    if over:
        kept[min(over)[1]] = True
    return kept


def _border(dealt: DataFrame, edges: DataFrame, left: dict, names: list, seed: int) -> DataFrame:
    """A table (_source, doc_id, size) of the border blocks' documents to draw; ``left`` holds the words that each source still wants.

    Each level cuts a source's border block of more than BORDER documents into blocks of about so many, takes those that fit and
    goes on with the first that does not. The driver holds a number for each of these blocks; a group is never above about
    twice BORDER documents. Rows that repeat id, source and size stand together.
    """
    spark = dealt.sparkSession
    edges = edges.withColumnsRenamed({"_source": "_es", "block": "_eb"})
    near = dealt.join(F.broadcast(edges), F.col("_source").eqNullSafe(F.col("_es")) & (F.col("block") == F.col("_eb")))
    near = written(near.where("size > 0").groupBy("_source", "doc_id", "size").agg(F.count(F.lit(1)).alias("copies")).withColumn("words", F.col("size") * F.col("copies")), "border")
    taken, tables = [], [near]
    for level in range(64):
        counts = {r["_source"]: r["n"] for r in near.groupBy("_source").agg(F.count(F.lit(1)).alias("n")).collect()}
        if max(counts.values(), default=0) <= 2 * BORDER:
            break
        cuts = spark.createDataFrame([(n, -(-k // BORDER) if k > 2 * BORDER else 1) for n, k in counts.items()], "_cs string, cuts long")
        key = F.xxhash64(F.lit(seed), F.lit(100 + level), F.col("doc_id").cast("string"), "size")
        cut = near.drop("cut").join(F.broadcast(cuts), F.col("_source").eqNullSafe(F.col("_cs"))).withColumn("cut", F.pmod(key, F.col("cuts"))).drop("_cs", "cuts")
        sums: dict = {}
        for r in cut.groupBy("_source", "cut").agg(F.sum("words").alias("n")).collect():
            sums.setdefault(r["_source"], {})[r["cut"]] = int(r["n"])
        verdicts = []
        for n, own in sums.items():
            edge = None
            for k in np.random.default_rng([seed, names.index(n), 3, level]).permutation(sorted(own)):
                if len(own) == 1 or own[k] > left[n]:
                    if edge is None:
                        edge = int(k)
                        verdicts.append((n, edge, False))
                else:
                    left[n] -= own[k]
                    verdicts.append((n, int(k), True))
        marks = spark.createDataFrame(verdicts, "_vs string, _vc long, whole boolean").withColumn("there", F.lit(True))
        cut = cut.join(F.broadcast(marks), F.col("_source").eqNullSafe(F.col("_vs")) & (F.col("cut") == F.col("_vc"))).drop("_vs", "_vc", "there")
        cut = written(cut, "border")
        tables.append(cut)
        taken.append(cut.where("whole"))
        near = cut.where("not whole").drop("whole")
    wants = spark.createDataFrame(list(left.items()), "_ws string, want double")
    group = near.join(F.broadcast(wants), F.col("_source").eqNullSafe(F.col("_ws"))).select("_source", "doc_id", "size", "words", "want")

    def fit(rows):
        rows = rows.sort_values(["words", "doc_id"], ascending=[False, True])
        return rows[fit_one_by_one(rows["words"].tolist(), float(rows["want"].iloc[0]))][["_source", "doc_id", "size"]]

    out = group.groupBy("_source").applyInPandas(fit, f"_source string, doc_id {dict(dealt.dtypes)['doc_id']}, size long")
    for part in taken:
        out = out.unionByName(part.select("_source", "doc_id", "size"))
    out = written(out, "chosen")
    release(*tables)
    return out
