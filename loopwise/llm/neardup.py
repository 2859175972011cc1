"""MinHash near-duplicate detection with bottom-k sketches.

One hash function maps every word shingle to 64 bits; a document's sketch is
the k smallest distinct values.  Steps, all on Spark:

1. `sketches`: shingle sets of whole texts, their sizes, a 128-bit fingerprint
   of the whole set and the sketch.
2. Equal sets form a class; only class representatives go on.
3. Inverted lists of retained values.  A value that one class holds is in no
   pair.  Each class indexes its rarest values only: sketches of two sets at the
   threshold share at least half of 64 values (six standard deviations below
   what is expected; sets that fit into a sketch: exactly their share), so the
   two share one of the rarest 33.  Values of passages that many documents quote
   sort last and index nothing unless they make up half of a sketch.
4. Each list links its members to a leader; pairs whose union sketch estimates
   enough similarity are verified on the full sets, components are formed, and
   the lists are read again: pairs whose ends lie in one component already are
   done.  A first leader is the member with the fewest values of its own: the
   original of its near copies.  A group of n copies so costs n pairs, not n
   squared.  Rounds end when leaders link few of those they meet.
5. Classes of lists that still span components are compared by their whole
   sets: under their rarest fifth, with the overlaps of each pair counted and
   bounded and parity bits that bound the difference, none of which loses a
   link; what remains is verified on the full sets.
6. Components by alternating large-star and small-star steps.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopwise.llm import _store, _text

#: Parity bits that whole sets carry into the last comparison.
BITS = 512
#: Another round of leaders follows if one of so many pairs was a link.
PAY = 8

SKETCH_SCHEMA = "doc_id long, n_shingles long, set_hi long, set_lo long, sketch array<long>"


def _sets(texts: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and sorted distinct shingle hashes of each document; a text
    of fewer words is one shingle, one without words has none."""
    for part in _text.slices(texts):
        starts, ends, first = part.words()
        words = part.word_hashes(starts, ends)
        grams = _text.shingle_hashes(words, size)
        counts = np.diff(first)
        for i in range(part.n):
            a, n = first[i], counts[i]
            if n >= size:
                found = np.sort(grams[a : a + n - size + 1])
                if len(found) > 1:
                    found = found[np.concatenate(([True], found[1:] != found[:-1]))]
            elif n:
                found = _text.shingle_hashes(words[a : a + n], int(n))
            else:
                found = grams[:0]
            yield part.first + i, found.view(np.int64)


def _fingerprint(found: np.ndarray) -> np.ndarray:
    return np.frombuffer(hashlib.blake2b(found.tobytes(), digest_size=16).digest(), np.int64)


def sketches(docs: DataFrame, size: int = 5, k: int = 64) -> DataFrame:
    """Per row: doc_id, n_shingles, 128-bit set fingerprint and bottom-k sketch
    (values in unsigned order)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, hi, lo, flat, ends = [], [], [], [], [0]
            for _, found in _sets(batch.column(1), size):
                n.append(len(found))
                digest = _fingerprint(found)
                hi.append(digest[0])
                lo.append(digest[1])
                flat.append(found[:k])
                ends.append(ends[-1] + len(flat[-1]))
            values = np.concatenate(flat) if flat else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))],
                names=["doc_id", "n_shingles", "set_hi", "set_lo", "sketch"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SKETCH_SCHEMA)


def full_sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """Per class of the written `ids(node, doc_id, set_hi)`: its whole set, taken
    from its document (another text under the same doc_id is passed by), and
    bits: BITS parities, one for each part of the hash space, of how many of its
    values lie there.  Two sets differ in at least as many values as their
    parities do in bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(nodes: list, found: list, bits: list) -> pa.RecordBatch:
            ends = np.concatenate(([0], np.cumsum([len(x) for x in found])))
            fixed = np.arange(len(nodes) + 1) * (BITS // 64)
            return pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found))), pa.ListArray.from_arrays(pa.array(fixed, pa.int32()), pa.array(np.concatenate(bits)))],
                names=["node", "shingles", "bits"],
            )

        for batch in batches:
            node, hi = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            nodes, sets, bits, held = [], [], [], 0
            for i, found in _sets(batch.column(0), size):
                if _fingerprint(found)[0] != hi[i]:
                    continue
                part = (found.view(np.uint64) >> np.uint64(20)) % np.uint64(BITS)
                odd = np.bincount(part.astype(np.int64), minlength=BITS) & 1
                nodes.append(node[i])
                sets.append(found)
                bits.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
                held += len(found)
                if held > 1 << 19:
                    yield out(nodes, sets, bits)
                    nodes, sets, bits, held = [], [], [], 0
            if nodes:
                yield out(nodes, sets, bits)

    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(_store.small(ids), "doc_id")
    rows = wanted.select("text", "node", "set_hi").mapInArrow(run, "node long, shingles array<long>, bits array<long>")
    # Rows that repeat a document give its set as often.
    return rows.dropDuplicates(["node"])


def components(edges: DataFrame) -> tuple[DataFrame, str]:
    """(node, component) of the undirected `edges(a, b)` as a written table, and
    its path: the smallest node reachable, for every node but the smallest
    itself.  Alternates large-star and small-star steps, each written to the
    shared folder, until the edges form stars."""
    spark = edges.sparkSession
    current, path = edges.select("a", "b").where("a <> b"), None
    while True:
        both = current.select(F.col("a").alias("u"), F.col("b").alias("v")).union(current.select(F.col("b").alias("u"), F.col("a").alias("v")))
        # The minima are written so that both sides of the join are plain
        # exchanges, of which AQE splits the partition of a node with many edges.
        low, low_at = _store.written(both.groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.col("v") < F.col("u")).alias("below"), F.count_if(F.col("v") > F.col("u")).alias("above")), "low")
        # In stars a node has one smaller neighbour and no other, or none.
        if low.where("below > 1 or (below = 1 and above > 0)").isEmpty():
            _store.drop(spark, *([path] if path else []))
            return low.where("m < u").select(F.col("u").alias("node"), F.col("m").alias("component")), low_at
        # Large star: larger neighbours hang on the smallest of the neighbourhood.
        least = low.select("u", F.least("u", "m").alias("m"))
        down, down_at = _store.written(both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")), "large")
        # Small star: a node's smaller neighbours and itself hang on the smallest.
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        joined = down.join(least, "u")
        star = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()
        current, star_at = _store.written(star, "edges")
        _store.drop(spark, low_at, down_at, *([path] if path else []))
        path = star_at


def _with(pairs: DataFrame, table: DataFrame, value: str) -> DataFrame:
    """Adds the table's `value` for both ends of the pairs as va and vb."""
    left = table.select(F.col("node").alias("a"), F.col(value).alias("va"))
    right = table.select(F.col("node").alias("b"), F.col(value).alias("vb"))
    return pairs.join(left, "a").join(right, "b")


def _slack(percent: int, k: int) -> float:
    """Six standard deviations of the share of k sketch values that two sets at
    the threshold have in common."""
    return 6 * (percent / 100 * (1 - percent / 100) / k) ** 0.5


def _estimated(pairs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs whose union sketch (the k smallest values of both) holds enough
    values that are in both; sizes filter first."""
    sized = _with(pairs, classes.select("node", F.struct("n_shingles", "sketch").alias("s")), "s")
    sized = sized.where(F.least("va.n_shingles", "vb.n_shingles") * 100 >= F.greatest("va.n_shingles", "vb.n_shingles") * percent)
    # Signed order serves as well as unsigned for a set of hash values, as long
    # as the sketch was cut in the order used here: flip the sign bit.
    flip = lambda c: F.transform(c, lambda x: x.bitwiseXOR(F.lit(-(1 << 63))))
    union = F.slice(F.array_sort(F.array_union(flip(F.col("va.sketch")), flip(F.col("vb.sketch")))), 1, k)
    both = F.array_intersect(flip(F.col("va.sketch")), flip(F.col("vb.sketch")))
    sized = sized.withColumn("u", union)
    return sized.where(F.size(F.array_intersect("u", both)) >= F.size("u") * (percent / 100 - _slack(percent, k))).select("a", "b")


def _verified(likely: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union of `sets(node, shingles)`."""
    both = _with(likely, sets, "shingles").withColumn("both", F.size(F.array_intersect("va", "vb")))
    return both.where(F.col("both") * 100 >= (F.size("va") + F.size("vb") - F.col("both")) * percent).select("a", "b")


def _rare_lists(sets: DataFrame, spare, *more: str) -> tuple[DataFrame, str]:
    """Inverted lists (node, n_shingles, *more, alone, v, before) of `sets(node,
    n_shingles, sketch, *more)` as a written table, and its path: a set is under
    its rarest size - spare + 1 values, where the column `spare` says how many it
    shares with any partner at least.  alone counts its values that no other set
    holds, which fill places but no list, and before its values rarer than v,
    alone ones included."""
    spark = sets.sparkSession
    entries = sets.select("node", F.explode("sketch").alias("v"))
    # Written, so that both sides of the join are plain exchanges, of which AQE
    # splits the partition of a value that many sets hold.
    shared, shared_at = _store.written(entries.groupBy("v").agg(F.count("*").alias("df")).where("df > 1"), "shared")
    held = entries.join(shared, "v").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("held"))
    rows = sets.withColumn("m", F.size("sketch")).withColumn("need", F.col("m") - spare + 1).drop("sketch").join(held, "node")
    rows = rows.withColumn("alone", F.col("m") - F.size("held")).withColumn("room", F.col("need") - F.col("alone")).where("room > 0")
    rows = rows.select("node", "n_shingles", *more, "alone", F.posexplode(F.slice("held", F.lit(1), F.col("room").cast("int"))["v"]).alias("at", "v"))
    lists, path = _store.written(rows.select("node", "n_shingles", *more, "alone", "v", (F.col("alone") + F.col("at")).alias("before")), "lists")
    _store.drop(spark, shared_at)
    return lists, path


def _spanning(lists: DataFrame, *keys) -> tuple[DataFrame, str]:
    """The values of `lists(v, component, ...)` whose members lie in several
    components, with the aggregates `keys`, as a written table."""
    spans = lists.groupBy("v").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), *keys).where("c0 <> c1")
    return _store.written(spans.drop("c0", "c1"), "open")


def _open_pairs(sets: DataFrame, left: DataFrame, percent: int) -> tuple[DataFrame, list[str]]:
    """Pairs across components among `left(node, component)` that may link by
    their whole `sets(node, shingles, bits)`.

    Each set is under its rarest fifth.  Two sets meet under the rarest value
    that both hold and share nothing of what stands before it in either; of each
    pair the values that both are under are counted, and what stands after the
    last of them bounds the rest of the overlap."""
    spark = sets.sparkSession
    n = F.size("shingles")
    rows = sets.select("node", n.cast("long").alias("n_shingles"), F.col("shingles").alias("sketch"), "bits")
    lists, lists_at = _rare_lists(rows, F.ceil(F.col("n_shingles") * percent / 100).cast("int"), "bits")
    lists, placed_at = _store.written(lists.drop("alone").join(left, "node"), "placed")
    spans, spans_at = _spanning(lists, F.min("n_shingles").alias("n_least"))
    # A set that is too poor for the smallest partner of a list leaves it.
    most = F.col("n_shingles") - F.col("before")
    able = lists.join(spans, "v").where(most * (100 + percent) - F.col("n_shingles") * percent >= F.col("n_least") * percent).drop("n_least")
    able, able_at = _store.written(able, "able")
    x, y = able, able.select("v", *[F.col(c).alias(f"{c}2") for c in ("node", "component", "n_shingles", "before", "bits")])
    # Overlap, and values in which two linked sets differ: at least, at most.
    both, apart = (F.col("n_shingles") + F.col("n_shingles2")) * percent, (F.col("n_shingles") + F.col("n_shingles2")) * (100 - percent)
    near = F.least(F.col("n_shingles") - F.col("before"), F.col("n_shingles2") - F.col("before2")) * (100 + percent) >= both
    bits = sum((F.bit_count(F.get("bits", i).bitwiseXOR(F.get("bits2", i))) for i in range(1, BITS // 64)), F.bit_count(F.get("bits", 0).bitwiseXOR(F.get("bits2", 0))))
    met = x.join(y, "v").where(F.expr("node < node2 and component <> component2") & near & (bits * (100 + percent) <= apart))
    counted = met.groupBy(F.col("node").alias("a"), F.col("node2").alias("b"), "n_shingles", "n_shingles2").agg(F.count("*").alias("shared"), F.max("before").alias("last"), F.max("before2").alias("last2"))
    rest = F.least(F.col("n_shingles") - F.col("last"), F.col("n_shingles2") - F.col("last2")) - 1
    return counted.where((F.col("shared") + rest) * (100 + percent) >= both).select("a", "b"), [lists_at, placed_at, spans_at, able_at]


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, k: int = 64) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of `docs(doc_id, text)`.

    component_id is the smallest doc_id reachable over pairs of documents whose
    shingle sets have 100 * intersection >= percent * union; kept marks the row
    whose doc_id that is.  Null or word-less texts have an empty set, link with
    nothing and are kept.  Rows that share a doc_id are one document.  A null
    doc_id links with nothing: component_id null, kept true.  Ids are whole
    numbers; a text id must hold one, or Spark's cast fails.  Extra columns,
    whatever their names, are ignored; an empty table gives an empty result."""
    spark = docs.sparkSession
    with _store.arrow_bytes(spark):
        marks, _ = _store.written(sketches(docs, size, k), "sketches")
    some = marks.where("n_shingles > 0 and doc_id is not null")
    key = F.xxhash64("set_hi", "set_lo")
    # node: a class of equal sets, named by its smallest document; equal sets
    # have the same sketch, so any of theirs serves.
    one = some.groupBy("set_hi", "set_lo").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    classes, classes_at = _store.written(one.select(key.alias("node"), "*"), "classes")
    n = F.col("n_shingles")
    share = F.floor(F.size("sketch") * (percent / 100 - _slack(percent, k)))
    spare = F.when(n * 100 <= k * percent, F.ceil(n * percent / 100)).otherwise(share).cast("int")
    lists, lists_at = _rare_lists(classes.select("node", "n_shingles", "sketch"), spare)
    # A doc_id of several rows is one document: its classes are linked.
    several = some.select("doc_id", key.alias("node"))
    firsts = several.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("c")).where("a <> c").select("doc_id", "a")
    found, found_at = _store.written(several.join(firsts, "doc_id").select("a", F.col("node").alias("b")).where("a <> b"), "links")
    paths, comp, turn, pay = [lists_at, found_at], None, 0, True
    while True:
        # Values whose members lie in several components still have pairs to try.
        if comp is None:
            at = lists.withColumn("component", F.col("node"))
        else:
            at = lists.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
        at, at_path = _store.written(at, "at")
        order = F.struct((F.col("alone") if turn == 0 else F.lit(0)).alias("first"), F.xxhash64("node", F.lit(turn)).alias("order"), "node", "component")
        open_lists, open_path = _spanning(at, F.min(order).alias("leader"))
        paths += [at_path, open_path]
        if open_lists.isEmpty():
            if comp is None:
                comp, comp_at = components(found)
                paths.append(comp_at)
            break
        if pay:
            pairs = at.join(open_lists, "v").where("component <> leader.component").select(F.least("node", "leader.node").alias("a"), F.greatest("node", "leader.node").alias("b"))
            pairs, pairs_at = _store.written(pairs.distinct(), "pairs")
            likely, likely_at = _store.written(_estimated(pairs, classes, k, percent), "likely")
            # A class's own row: the set of one of its documents.
            ends = likely.select(F.col("a").alias("node")).union(likely.select("b")).distinct()
            ids, ids_at = _store.written(classes.select("doc_id", "node", "set_hi").join(ends, "node"), "ids")
            sets = full_sets(docs, ids, size)
            paths += [pairs_at, likely_at, ids_at]
        else:
            left = at.join(open_lists.select("v"), "v").select("node", "component").distinct()
            left, left_at = _store.written(classes.select("doc_id", "node", "set_hi").join(left, "node"), "left")
            with _store.arrow_bytes(spark):
                sets, sets_at = _store.written(full_sets(docs, left.drop("component"), size), "sets")
            likely, fine_at = _open_pairs(sets, left.select("node", "component"), percent)
            likely, likely_at = _store.written(likely, "likely")
            paths += [left_at, sets_at, likely_at, *fine_at]
        with _store.arrow_bytes(spark):
            fresh, path = _store.written(_verified(likely, sets, percent), "links")
        paths.append(path)
        if comp is None or not fresh.isEmpty():
            # Stars found so far say all that the earlier links said.
            known = found if comp is None else comp.select(F.col("node").alias("a"), F.col("component").alias("b"))
            comp, comp_at = components(known.union(fresh))
            paths.append(comp_at)
        if not pay:
            break
        # Leaders go on as long as they link a good part of those they meet.
        turn, pay = turn + 1, fresh.count() * PAY >= pairs.count()
    # From classes to documents: the smallest document of the component.
    reps = classes.select("node", "doc_id").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    low = reps.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_set = reps.join(low, "component").select("node", "component_id")
    by_set, _ = _store.written(by_set, "by_set")
    _store.drop(spark, classes_at, *paths)
    rows = marks.select("doc_id", "n_shingles", key.alias("node")).join(by_set, "node", "left")
    empty = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    rows = rows.select("doc_id", "n_shingles", F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op9(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), size=4)


ORACLE = r"""
with recursive d as materialized (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
s as materialized (select distinct doc_id, array_to_string(w[i : i + least(len(w), 4) - 1], ' ') g from (select doc_id, w, unnest(range(1, len(w) - least(len(w), 4) + 2)) i from d where len(w) > 0)),
n as materialized (select doc_id, count(*) n from s group by 1),
p as materialized (select a.doc_id a, b.doc_id b, count(*) shared from s a join s b using (g) where a.doc_id <> b.doc_id group by 1, 2),
e as materialized (select a, b from p join n x on a = x.doc_id join n y on b = y.doc_id where 100 * shared >= 80 * (x.n + y.n - shared)),
c(v, low) using key (v) as (
  select doc_id, doc_id from d union all
  select e.b, min(c.low) from c join e on e.a = c.v join recurring.c o on o.v = e.b where c.low < o.low group by e.b)
select d.doc_id, coalesce(n, 0)::bigint n_shingles, low component_id, low = d.doc_id kept
from d join c on c.v = d.doc_id left join n on n.doc_id = d.doc_id
"""
