"""Mixing sources to target weights with a multivariate-hypergeometric tree.

Every source is cut into blocks by a hash of its rows; blocks stand in a seeded
permuted order.  A source's target in words becomes an exact quota of block
draws: whole passes over all blocks, then a prefix of the order, then one block
more, made of single rows from anywhere in the source that fill what is left.  A
binary tree over the output shards splits the quotas: at each node the draws of
the left half are multivariate hypergeometric, so each shard gets its disjoint
run of every source's draws, and inside a shard rows are shuffled by a hash.

A source so misses its target by less than one block, a 256th of it or less, or by
part of a document where blocks are of a few dozen rows.

To the driver come one row per source, one sum per block (at most `MOST_BLOCKS`
and `BLOCKS_EACH` more per source) and about `FILL_ROWS` rows of each source and size class
(powers of two); so much is broadcast, too.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loopwise.llm import _store, _text

#: Blocks of all sources together, beside BLOCKS_EACH for each small source.
MOST_BLOCKS, BLOCKS_EACH = 65_536, 256
#: Documents that a block holds at least on average, while blocks are few.
BLOCK_ROWS = 16
#: Rows of a source and size class that may fill the last gap, about.
FILL_ROWS = 32
#: Words of a shard; of more than MOST_BLOCKS shards each holds more.
SHARD_WORDS = 1 << 22
#: However few the words, so many shards take them.
LEAST_SHARDS = 8


@F.arrow_udf(T.LongType())
def word_count(text: pa.Array) -> pa.Array:
    """Number of `[^\\x20\\x09-\\x0D]+`; null and empty texts have 0."""
    counts = [np.diff(part.words()[2]) for part in _text.slices(text)]
    return pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64), pa.int64())


def capped_targets(sizes: dict[str | None, int], weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0) -> dict[str | None, float]:
    """Shares of the total size by weights that repeat over the sources in code
    point order, null last; none above cap times its source's size, the excess
    shared anew by weight."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(names)}
    total, held = float(sum(sizes.values())), {}
    while open_ := [s for s in names if s not in held]:
        rest, share = total - sum(held.values()), sum(weight[s] for s in open_)
        above = [s for s in open_ if rest * weight[s] / share > cap * sizes[s]]
        if not above:
            return held | {s: rest * weight[s] / share for s in open_}
        held |= {s: cap * sizes[s] for s in above}
    return held


def split_quotas(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """(shards + 1) x sources: shard i takes the draws [row i, row i + 1) of each
    source.  Every node of the tree has its own random stream."""
    out = np.zeros((shards + 1, len(quotas)), dtype=np.int64)

    def node(first: int, last: int, at: np.ndarray, have: np.ndarray) -> None:
        if last - first == 1:
            out[last] = at + have
            return
        middle = (first + last) // 2
        digest = hashlib.blake2b(f"{seed}/{first}/{last}".encode(), digest_size=8).digest()
        total = int(have.sum())
        left = np.random.default_rng(int.from_bytes(digest)).multivariate_hypergeometric(have, total * (middle - first) // (last - first), method="marginals") if total else have * 0
        node(first, middle, at, left)
        node(middle, last, at + left, have - left)

    if len(quotas):
        node(0, shards, out[0].copy(), np.array(quotas, dtype=np.int64))
    return out


@dataclass
class Plan:
    """sources: size, target and blocks of each; draws: the shards of each block's
    draws; fills: the shard of each row that fills a gap, by the row's hash."""

    sources: DataFrame
    draws: DataFrame
    fills: DataFrame
    shards: int
    seed: int


def _row_hash(seed: int) -> Column:
    """Rows without an id differ by their texts; only equal rows have one hash."""
    return F.xxhash64(F.col("doc_id").cast("string"), "source", "size", "text_hash", F.lit(seed))


def _fill(gap: float, rows: list[tuple[int, int]]) -> list[int]:
    """Hashes of rows (size, hash) whose sizes add up to about `gap`: the largest
    that fit first, and one more if that comes nearer."""
    taken, rest = [], sorted(rows, reverse=True)
    left = []
    for size, h in rest:
        if size <= gap:
            taken.append(h)
            gap -= size
        else:
            left.append((size, h))
    if left and left[-1][0] - gap < gap:
        taken.append(left[-1][1])
    return taken


def plan(sized: DataFrame, shards: int | None = None, seed: int = 7, weights: tuple[float, ...] = (5, 2, 1), cap: int = 3) -> Plan:
    """Quotas and the tree for the written `sized(doc_id, source, size, text_hash)`; without
    `shards` there is one for each SHARD_WORDS words, LEAST_SHARDS at least.  Rows
    with and without an id are dealt out one by one; equal rows go together."""
    spark = sized.sparkSession
    stats = {r.source: (r.words or 0, r.n) for r in sized.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("n")).collect()}
    targets = capped_targets({s: w for s, (w, _) in stats.items()}, weights, float(cap))
    rows = max(1, sum(n for _, n in stats.values()))
    blocks = {s: max(1, min(-(-n // BLOCK_ROWS), max(BLOCKS_EACH, MOST_BLOCKS * n // rows))) for s, (_, n) in stats.items()}
    shards = shards or max(LEAST_SHARDS, min(MOST_BLOCKS, sum(w for w, _ in stats.values()) // SHARD_WORDS))
    sources = spark.createDataFrame([(s, stats[s][0], targets[s], blocks[s]) for s in targets], "source string, source_size long, target double, blocks int")
    placed = sized.join(F.broadcast(sources), sized.source.eqNullSafe(sources.source)).select(sized["*"], "blocks").withColumn("block", F.pmod(_row_hash(seed), F.col("blocks")).cast("int"))
    of_block = {(r.source, r.block): r.words for r in placed.groupBy("source", "block").agg(F.sum("size").alias("words")).collect()}
    orders, whole, gaps = {}, {}, {}
    for s in targets:
        digest = hashlib.blake2b(f"{seed}/{s!r}".encode(), digest_size=8).digest()
        orders[s] = np.random.default_rng(int.from_bytes(digest)).permutation(blocks[s])
        size, target = stats[s][0], targets[s]
        passes = int(target // size) if size else 0
        gaps[s], n = target - passes * size, passes * blocks[s] * (size > 0)
        for b in orders[s] if size else []:
            words = of_block.get((s, int(b)), 0)
            if words > gaps[s]:
                break
            gaps[s] -= words
            n += 1
        whole[s] = n
    # Any row of the source that has room for one copy more may fill its gap.
    table = [(s, int(b), len(range(p, whole[s], blocks[s]))) for s in targets if gaps[s] >= 1 for p, b in enumerate(orders[s])]
    room = spark.createDataFrame([t for t in table if t[2] < cap], "s string, b int, n int")
    able = placed.join(F.broadcast(room), F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))).where("size > 0")
    able = able.select("source", "size", F.floor(F.log2("size")).alias("class"), _row_hash(seed + 1).alias("h"))
    classes = able.groupBy("source", "class").agg(F.count("*").alias("n")).withColumnRenamed("source", "s").withColumnRenamed("class", "c")
    # As many rows as sources times size classes, twenty or thirty.
    some = able.join(F.broadcast(classes), F.col("source").eqNullSafe(F.col("s")) & (F.col("class") == F.col("c"))).where(F.pmod("h", "n") < FILL_ROWS)
    found: dict[str | None, list[tuple[int, int]]] = {s: [] for s in targets}
    # Rows of one hash are taken together.
    for r in some.groupBy("source", "h").agg(F.sum("size").alias("size")).collect():
        found[r.source].append((r["size"], r.h))
    fills = {s: _fill(gaps[s], found[s]) for s in targets}
    quotas = [whole[s] + bool(fills[s]) for s in targets]
    bounds = split_quotas(quotas, shards, seed)
    drawn, filled = [], []
    for i, s in enumerate(targets):
        ends = bounds[1:, i]
        for place, b in enumerate(orders[s]):
            at = np.searchsorted(ends, np.arange(place, whole[s], blocks[s]), side="right")
            drawn.append((s, int(b), at.tolist()))
        if fills[s]:
            last = int(np.searchsorted(ends, quotas[i] - 1, side="right"))
            filled += [(s, h, last) for h in fills[s]]
    draws = spark.createDataFrame(drawn, "s string, b int, draws array<int>")
    return Plan(sources, draws, spark.createDataFrame(filled, "sf string, hf long, fill int"), shards, seed)


def copies(sized: DataFrame, how: Plan) -> DataFrame:
    """The rows of `sized(doc_id, source, size, text_hash, ...)` with source_size, target and
    copies: an array of (shard, place), one for each time the mix takes the row."""
    sources = how.sources.withColumnRenamed("source", "s0")
    at = sized.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("s0"))).withColumn("block", F.pmod(_row_hash(how.seed), F.col("blocks")).cast("int"))
    at = at.join(F.broadcast(how.draws), F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    at = at.withColumn("h1", _row_hash(how.seed + 1)).join(F.broadcast(how.fills), F.col("source").eqNullSafe(F.col("sf")) & (F.col("h1") == F.col("hf")), "left")
    shards = F.concat("draws", F.when(F.col("fill").isNull(), F.array().cast("array<int>")).otherwise(F.array("fill")))
    place = F.transform(shards, lambda s, i: F.struct(s.alias("shard"), F.xxhash64(F.col("doc_id").cast("string"), "size", "text_hash", s, i, F.lit(how.seed)).alias("place")))
    return at.withColumn("copies", place).drop("s0", "s", "b", "draws", "blocks", "block", "h1", "sf", "hf", "fill")


def sized_documents(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", word_count("text").alias("size"), F.xxhash64("text").alias("text_hash"))


def mix(docs: DataFrame, shards: int | None = None, seed: int = 7, weights: tuple[float, ...] = (5, 2, 1), cap: int = 3, into: str | None = "__shard") -> DataFrame:
    """The mixture of `docs(doc_id, text, source, ...)`: its rows with all their
    columns, as often as drawn, and the shard as column `into` (a column of that
    name is replaced; None: no such column).  Each shard is one partition, in
    shuffled order, and one file if written.

    Null source is a source; null, empty and other texts without words weigh
    nothing and are in as often as their block is drawn; a text longer than its
    source's target may be left out.  Rows that repeat an id are rows like others,
    and equal rows are drawn together; columns of any other name pass through; an
    empty table gives an empty mix."""
    spark = docs.sparkSession
    sized, sized_at = _store.written(sized_documents(docs), "sizes")
    how = plan(sized, shards, seed, weights, cap)
    _store.drop(spark, sized_at)
    whole = docs.select(F.struct("*").alias("row"))
    # Counted again: cheaper than another copy of the texts.
    keys = whole.select(F.col("row").getField("doc_id").alias("doc_id"), F.col("row").getField("source").alias("source"), word_count(F.col("row").getField("text")).alias("size"), F.xxhash64(F.col("row").getField("text")).alias("text_hash"), "row")
    drawn = copies(keys, how).select("row", F.explode("copies").alias("copy"))
    shuffled = drawn.repartitionById(how.shards, F.col("copy.shard")).sortWithinPartitions("copy.place")
    columns = [F.col("row").getField(c).alias(c) for c in docs.columns if c != into]
    return shuffled.select(*columns, *([F.col("copy.shard").alias(into)] if into else []))


def op1(spark, sf_dir: str) -> DataFrame:
    sized, _ = _store.written(sized_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")), "sizes")
    out = copies(sized, plan(sized))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.size("copies")).alias("taken"), F.array_sort("copies.shard").alias("shards"))
