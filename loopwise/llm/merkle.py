"""A Merkle manifest of a dataset, from a monoid of sparse forests.

A forest holds nodes of trees by (tree, level, index) that still wait for their
siblings.  As the number of leaves of every tree is known, so is the number of
children of every node; a run of siblings that is complete becomes its parent, and a
tree that has come down to one node becomes a leaf of the tree over all trees.
Joining two forests is their union, followed by this: the operation is associative
and commutative, and the empty forest is its unit.  Rows in tree order, dealt out by
ranges, leave a few open nodes for each partition (at most two runs a level), its
fragment.  RDD.treeReduce joins the fragments; a joined forest keeps the runs that
joining completed, so the last one holds the root and whatever stands above a
partition's open nodes.  It is broadcast, and each partition proves its rows with its
own runs and those.

Null values are `-`.  Null ids come first, rows of one id in the order of their
leaves; equal rows are leaves like others.  Texts of any length are hashed whole in
the JVM.  An empty table has no rows and no root.  Columns beyond the five are not
read."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loopwise.llm import _learn, _store

ARITY = 8
#: Leaves of a partition, about; forests that meet in one task of the reduction, about.
LEAVES, FAN = 1 << 15, 16
#: Number of the tree over all trees.
TOP = -1

Key = tuple[int, int, int]
#: A node's run and its place there; None where a root becomes a leaf.
Step = tuple[list[str], int] | None


def field(value: Column) -> Column:
    """`-` for null, else the length in bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column) -> Column:
    row = F.concat(*[field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], field(text))
    return F.sha2(row.cast("binary"), 256)


def digest(*hexes: str) -> str:
    return hashlib.sha256("".join(hexes).encode()).hexdigest()


class Forest:
    """Open nodes of trees with `leaves(tree)` leaves each.  `runs` holds every run
    that was completed, by its parent, and `subroots` every tree that came down to one
    node and became a leaf of the tree over all."""

    def __init__(self, leaves: Callable[[int], int], nodes: Iterable[tuple[Key, str]] = ()):
        self.sizes, self._waiting = {TOP: leaves(TOP)}, {}
        self.root: str | None = None
        self.runs: dict[Key, list[str]] = {}
        self.subroots: dict[int, str] = {}
        for key, value in nodes:
            if key[0] not in self.sizes:
                self.sizes[key[0]] = leaves(key[0])
            self.add(key, value)

    def open(self) -> Iterator[tuple[Key, str]]:
        for (tree, level, _), run in self._waiting.items():
            for i, value in run.items():
                yield (tree, level - 1, i), value
        if self.root is not None:
            yield self._at, self.root

    def add(self, key: Key, value: str) -> None:
        while True:
            tree, level, i = key
            width = -(-self.sizes[tree] // ARITY**level)
            if width == 1:
                if tree == TOP:
                    self.root, self._at = value, key
                    return
                self.subroots[tree] = value
                key = (TOP, 0, tree)
                continue
            parent = (tree, level + 1, i // ARITY)
            run = self._waiting.setdefault(parent, {})
            run[i] = value
            first = parent[2] * ARITY
            if len(run) < min(ARITY, width - first):
                return
            del self._waiting[parent]
            self.runs[parent] = [run[j] for j in range(first, first + len(run))]
            key, value = parent, digest(*self.runs[parent])

    def joined(self, other: Forest) -> Forest:
        both = Forest((self.sizes | other.sizes).__getitem__, [*self.open(), *other.open()])
        both.runs = self.runs | other.runs | both.runs
        both.subroots = self.subroots | other.subroots | both.subroots
        return both

    def above(self, key: Key) -> tuple[Key, Step] | None:
        """What a node became and its step there; None for an open node."""
        tree, level, i = key
        parent = (tree, level + 1, i // ARITY)
        if (run := self.runs.get(parent)) is not None:
            return parent, (run, i % ARITY)
        return ((TOP, 0, tree), None) if tree in self.subroots else None

    def path(self, key: Key) -> tuple[Key, list[Step]]:
        """The open node above `key` and the steps to it."""
        steps = []
        while (up := self.above(key)) is not None:
            key, step = up
            steps.append(step)
        return key, steps


def _sizes(frame: pd.DataFrame, trees: int) -> Callable[[int], int]:
    known = dict(zip(frame["tree"].tolist(), frame["n"].tolist(), strict=True))
    known[TOP] = trees
    return known.__getitem__


def _nodes(frame: pd.DataFrame, value: str) -> Iterator[tuple[Key, str]]:
    return zip(zip(frame["tree"].tolist(), frame["level"].tolist(), frame["idx"].tolist(), strict=True), frame[value].tolist(), strict=True)


def leaves_of(docs: DataFrame) -> DataFrame:
    """doc_id, lang, leaf and tampered: the leaf of the row with A-Z lower-cased in
    its text where 3 divides the crc32 of the id, else null."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(_learn.remainder(F.col("doc_id"), 3) == 0, leaf(lower))
    return docs.select("doc_id", "lang", leaf(F.col("text")).alias("leaf"), tampered.alias("tampered"))


def placed(leaves: DataFrame) -> tuple[DataFrame, int]:
    """Each row of `leaves` with p (partition), tree (rank of its lang), n (the
    tree's leaves), level 0 and idx in the tree; how many trees."""
    rows, first_at = _store.written(leaves.withColumn("tie", F.monotonically_increasing_id()), "leaves")
    order = [F.col("lang").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("tie")]
    parts = max(1, -(-rows.count() // LEAVES))
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ordered = ordered.select("doc_id", "lang", "leaf", "tampered", F.spark_partition_id().cast("long").alias("p"), (F.monotonically_increasing_id() % (1 << 33)).alias("pos"))
    ordered, _ = _store.written(ordered, "ordered-leaves")
    _store.drop(leaves.sparkSession, first_at)
    runs = ordered.groupBy("p", "lang").agg(F.count("*").alias("here"), F.min("pos").alias("pos0"))
    by_lang = Window.partitionBy("lang")
    before = F.sum("here").over(by_lang.orderBy("p").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("before", F.coalesce(before, F.lit(0))).withColumn("n", F.sum("here").over(by_lang))
    # Trees are numbered by the partition they start in (one row for each) and their order there.
    starts = runs.where("before = 0").withColumn("nth", F.row_number().over(Window.partitionBy("p").orderBy(F.col("lang").asc_nulls_first())))
    starts, _ = _store.written(starts, "tree-starts")
    new = starts.groupBy("p").agg(F.count("*").alias("new"))
    new = new.withColumn("trees", F.coalesce(F.sum("new").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranks = starts.join(new, "p").select(F.col("lang").alias("name"), (F.col("trees") + F.col("nth") - 1).alias("tree"))
    runs = runs.join(ranks, runs["lang"].eqNullSafe(ranks["name"])).select(F.col("p").alias("q"), F.col("lang").alias("in"), "tree", "n", (F.col("before") - F.col("pos0")).alias("shift"))
    runs, _ = _store.written(runs, "tree-runs")
    runs = _store.small(runs)
    met = ordered.join(runs, (F.col("p") == F.col("q")) & ordered["lang"].eqNullSafe(runs["in"]))
    out = met.select("doc_id", "leaf", "tampered", "p", "tree", "n", F.lit(0).cast("long").alias("level"), (F.col("pos") + F.col("shift")).alias("idx"))
    return out, starts.count()


def fragments(rows: DataFrame, trees: int) -> DataFrame:
    """The open nodes of each partition's rows, and the leaves of their trees: p,
    nodes."""

    def grown(frame: pd.DataFrame) -> pd.DataFrame:
        forest = Forest(_sizes(frame, trees), _nodes(frame, "leaf"))
        nodes = [{"tree": t, "level": level, "idx": i, "n": forest.sizes[t], "value": value} for (t, level, i), value in forest.open()]
        return pd.DataFrame({"p": [frame["p"].iloc[0]], "nodes": [nodes]})

    schema = "p long, nodes array<struct<tree:long,level:long,idx:long,n:long,value:string>>"
    return rows.select("p", "tree", "n", "level", "idx", "leaf").groupBy("p").applyInPandas(grown, schema)


def tree_reduced(parts: DataFrame, trees: int) -> Forest:
    """The fragments of all partitions (one at least) joined by RDD.treeReduce: the
    root, and the runs and subroots that no partition completes alone."""

    def planted(part: Row) -> Forest:
        sizes = {node.tree: node.n for node in part.nodes} | {TOP: trees}
        return Forest(sizes.__getitem__, [((node.tree, node.level, node.idx), node.value) for node in part.nodes])

    forests = parts.rdd.map(planted)
    return forests.treeReduce(Forest.joined, max(2, math.ceil(math.log(forests.getNumPartitions(), FAN))))


def beside(step: Step) -> str:
    """The siblings of a step."""
    return "" if step is None else "".join(step[0][: step[1]] + step[0][step[1] + 1 :])


def folded(value: str, steps: Iterable[Step]) -> str:
    """The root above a node of this value."""
    for run, at in filter(None, steps):
        value = digest(*run[:at], value, *run[at + 1 :])
    return value


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot (of its lang), root, proof_sha256 (hash of the siblings
    from leaf to root), folded_root (from the tampered leaf, else the original) and
    verified, for each row of `docs`."""
    rows, trees = placed(leaves_of(docs))
    whole = docs.sparkSession.sparkContext.broadcast(tree_reduced(fragments(rows, trees), trees) if trees else None)

    def proven(mine: pd.DataFrame) -> pd.DataFrame:
        forest, rest = Forest(_sizes(mine, trees), _nodes(mine, "leaf")), whole.value
        subroots = rest.subroots | forest.subroots
        ways = {key: rest.path(key)[1] for key, _ in forest.open()}
        sides = {key: "".join(map(beside, steps)) for key, steps in ways.items()}

        def siblings(key: Key) -> str:
            """All siblings above a node, kept for inner nodes."""
            if (have := sides.get(key)) is None:
                to, step = forest.above(key)
                have = beside(step) + siblings(to)
                if key[1]:
                    sides[key] = have
            return have

        out = []
        for key, row in zip(zip(mine["tree"].tolist(), mine["level"].tolist(), mine["idx"].tolist(), strict=True), mine[["doc_id", "leaf", "tampered"]].itertuples(index=False), strict=True):
            end, steps = forest.path(key)
            again = folded(row.tampered if isinstance(row.tampered, str) else row.leaf, [*steps, *ways[end]])
            out.append((row.doc_id, row.leaf, subroots[key[0]], rest.root, digest(siblings(key)), again, again == rest.root))
        return pd.DataFrame(out, columns=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    schema = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    kind = dict(docs.dtypes)["doc_id"]
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("string"))  # pandas has no null integers
    return rows.groupBy("p").applyInPandas(proven, schema).withColumn("doc_id", F.col("doc_id").cast(kind))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_CRC = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda ch: ascii(ch)::bigint)), lambda c, b: list_reduce(list_prepend(xor(c, b), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295)"
_ROW = "sha256(concat(" + ", ".join(f"coalesce(octet_length(encode({c}::varchar)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars")) + ", coalesce(octet_length(encode({0})) || ':' || {0}, '-')))"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE = f"""
with recursive d as materialized (select doc_id, lang, {_ROW.format("text")} leaf, case when {_CRC} % 3 = 0 then {_ROW.format(_LOWER)} end tampered from documents),
lf as materialized (select *, dense_rank() over (order by lang nulls first) - 1 t, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 i, count(*) over (partition by lang) n from d),
inner_nodes as (select t, 0::bigint lv, i, n, leaf h from lf
  union all select t, lv + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' order by i)) from inner_nodes where n > 1 group by t, lv, i // 8, n),
sub as materialized (select t, h from inner_nodes where n = 1),
top_nodes as (select -1::bigint t, 0::bigint lv, t::bigint i, (select count(*) from sub)::bigint n, h from sub
  union all select -1::bigint, lv + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' order by i)) from top_nodes where n > 1 group by lv, i // 8, n),
every as (select * from inner_nodes where n > 1 union all select * from top_nodes where n > 1),
step as materialized (select t, lv, i, case when t >= 0 and n <= 8 then -1 else t end t2, case when t >= 0 and n <= 8 then 0 else lv + 1 end lv2, case when t >= 0 and n <= 8 then t else i // 8 end i2,
  coalesce(string_agg(h, '') over (w rows between unbounded preceding and 1 preceding), '') l, coalesce(string_agg(h, '') over (w rows between 1 following and unbounded following), '') r from every window w as (partition by t, lv, i // 8 order by i)),
walk as (select row_number() over () id, doc_id, leaf, lf.t tree, case when n = 1 then -1 else t end t, 0::bigint lv, case when n = 1 then t else i end i, coalesce(tampered, leaf) h, '' proof, 0 k from lf
  union all select id, doc_id, leaf, tree, s.t2, s.lv2, s.i2, sha256(s.l || h || s.r), proof || s.l || s.r, k + 1 from walk w join step s on s.t = w.t and s.lv = w.lv and s.i = w.i),
ends as (select id, any_value(doc_id) doc_id, any_value(leaf) leaf, any_value(tree) tree, arg_max(h, k) folded_root, arg_max(proof, k) proof from walk group by id)
select doc_id, leaf, sub.h subroot, root.h root, sha256(proof) proof_sha256, folded_root, folded_root = root.h verified
from ends join sub on sub.t = ends.tree, (select h from top_nodes where n = 1) root
"""
