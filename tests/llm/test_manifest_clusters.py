"""Merkle manifests and Delta Lloyd against plain Python."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark import RDD
from pyspark.sql import functions as F

from loopwise.llm import centroids, merkle

DOCS = "doc_id long, source string, lang string, n_chars long, text string, p string, leaf int"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]])


def plain_levels(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def plain_proof(levels, i):
    """Left and right siblings of a leaf, level by level."""
    out = []
    for nodes in levels[:-1]:
        first = i // 8 * 8
        out.append(("".join(nodes[first:i]), "".join(nodes[i + 1 : first + 8])))
        i //= 8
    return out


def plain_manifest(rows):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, plain_leaf(row), row))
    names = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    levels = {k: plain_levels([x[2] for x in sorted(trees[k], key=lambda x: x[:3])]) for k in names}
    top = plain_levels([levels[k][-1][0] for k in names])
    out = []
    for t, k in enumerate(names):
        for i, (_, _, own, row) in enumerate(sorted(trees[k], key=lambda x: x[:3])):
            steps = plain_proof(levels[k], i) + plain_proof(top, t)
            h = own
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0:
                h = plain_leaf((*row[:4], row[4] and row[4].translate(lower)))
            for l, r in steps:
                h = sha(l, h, r)
            out.append((row[0], own, levels[k][-1][0], top[-1][0], sha(*[l + r for l, r in steps]), h, h == top[-1][0]))
    return out


def docs_rows():
    draw = random.Random(5)
    langs = [None, "en", "de", "", "zh-é", *[f"x{i}" for i in range(20)]]
    rows = [(i, draw.choice([None, "web", "s"]), langs[0 if i % 3 == 0 else 1 if i % 3 == 1 else draw.randrange(len(langs))], i * 7 if i % 5 else None, draw.choice([None, "", "Abc", "lower", "ÄÖ Text " * (i % 9), "X" * 70_000]), "p", 1) for i in range(700)]
    rows += [rows[30]] * 40 + [(None, "a", "en", 1, f"Null {i}", "p", 1) for i in range(25)] + [(2**60 + i, None, None, None, None, "p", None) for i in range(3)]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("leaves, fan", [(1 << 15, 16), (20, 2), (90, 3)])
def test_manifest_equals_plain_trees(spark, monkeypatch, leaves, fan):
    """One partition and many, with repeated rows and ids, null values and langs."""
    monkeypatch.setattr(merkle, "LEAVES", leaves)
    monkeypatch.setattr(merkle, "FAN", fan)
    rows = docs_rows()
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")  # partitions stay apart, so that both sides of a join must agree on them
    found = [tuple(r) for r in merkle.manifest(spark.createDataFrame(rows, DOCS)).collect()]
    spark.conf.unset(key)
    key = lambda r: tuple((v is None, v if v is not None else 0) for v in r)
    assert sorted(found, key=key) == sorted(plain_manifest(rows), key=key)
    assert len({r[3] for r in found}) == 1 and 0 < sum(not r[6] for r in found) < len(found)


def test_manifest_of_little(spark):
    one = spark.createDataFrame([(1, "s", "en", 1, "A", "p", 1)], DOCS)
    row = merkle.manifest(one).first()
    assert row.leaf == row.subroot == row.root and row.proof_sha256 == sha()
    assert merkle.manifest(one.limit(0)).collect() == []
    many = spark.createDataFrame([(i, "s", f"l{i:03}", 1, "A", "p", 1) for i in range(70)], DOCS)
    rows = merkle.manifest(many).collect()
    assert len(rows) == 70 and len({r.root for r in rows}) == 1


def test_forests_join_in_any_order():
    """Joining is associative and commutative and leaves one node of all leaves."""
    sizes = {0: 77, 1: 1, 2: 9, merkle.TOP: 3}
    leaves = [((t, 0, i), sha(str((t, i)))) for t in (0, 1, 2) for i in range(sizes[t])]
    roots = set()
    for seed in range(6):
        random.Random(seed).shuffle(leaves)
        parts = [merkle.Forest(sizes.__getitem__, leaves[i::5]) for i in range(5)]
        left = parts[0].joined(parts[1]).joined(parts[2].joined(parts[3].joined(parts[4])))
        right = parts[4].joined(parts[2]).joined(parts[0]).joined(parts[3]).joined(parts[1])
        assert dict(left.open()) == dict(right.open())
        assert dict(left.joined(merkle.Forest(sizes.__getitem__)).open()) == dict(left.open())
        assert list(left.open()) == [((merkle.TOP, 1, 0), left.root)]
        roots.add(left.root)
    assert len(roots) == 1


def test_fragments_are_joined_by_tree_reduce(spark, monkeypatch):
    """One RDD.treeReduce over the fragments of all partitions gives the root and
    every way to it that a partition does not have itself; merging happens nowhere else."""
    monkeypatch.setattr(merkle, "LEAVES", 20)
    monkeypatch.setattr(merkle, "FAN", 2)
    plain, calls = RDD.treeReduce, []
    monkeypatch.setattr(RDD, "treeReduce", lambda rdd, f, depth=2: calls.append((rdd, f, depth, plain(rdd, f, depth))) or calls[-1][3])
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    rows = merkle.manifest(spark.createDataFrame(docs_rows(), DOCS)).collect()
    spark.conf.unset(key)
    assert len(calls) == 1
    rdd, joined, depth, whole = calls[0]
    parts = rdd.collect()
    assert len(parts) > 20 and rdd.getNumPartitions() > 2 and depth == 2 and joined is merkle.Forest.joined
    assert {r.root for r in rows} == {whole.root} and len(list(whole.open())) == 1
    top = next(whole.open())[0]
    for part in parts:
        for node, value in part.open():
            end, steps = whole.path(node)
            assert end == top and merkle.folded(value, steps) == whole.root


def test_every_row_is_folded_to_the_reduced_root(spark, monkeypatch):
    """Rows as they were are recomputed from their leaves too, so a wrong root shows in all."""
    reduced = merkle.tree_reduced

    def wrong(*args):
        whole = reduced(*args)
        whole.root = "0" * 64
        return whole

    monkeypatch.setattr(merkle, "tree_reduced", wrong)
    monkeypatch.setattr(merkle, "LEAVES", 20)
    docs = spark.createDataFrame([(i, "s", "en" if i % 3 else None, 1, "text", "p", 1) for i in range(90)], DOCS)
    rows = merkle.manifest(docs).collect()
    assert len(rows) == 90 and len({r.folded_root for r in rows}) == 1
    assert all(r.root == "0" * 64 and r.folded_root != r.root and not r.verified for r in rows)


def plain_lloyd(rows, k, rounds, salt="3"):
    limit = 1 << 27
    kept = [(i, [math.floor(max(-limit, min(limit, float(x) * 1024))) for x in v]) for i, v in rows if v is not None and len(v) == 3 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, sha(f"{salt}:{r[0]}"), r[1]))[:k]
    cents = [v for _, v in first]
    assign = lambda: [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cents)) for _, v in kept]
    for _ in range(rounds):
        own = assign()
        for j in range(len(cents)):
            mine = [v for (_, v), (_, o) in zip(kept, own, strict=True) if o == j]
            if mine:
                cents[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return sorted((-1 if i is None else i, j, d) for (i, _), (d, j) in zip(kept, assign(), strict=True)), cents


def vector_rows():
    draw = random.Random(9)
    rows = [(i, [draw.gauss(c, 1) for c in draw.choice([(0, 0, 0), (4, 0, -3), (-5, 2, 2), (0, 9, 1)])]) for i in range(400)]
    rows += [rows[7]] * 5 + [(7, [1.0, 1.0, 1.0]), (None, [0.5, 0.5, 0.5]), (500, None), (501, []), (502, [1.0, 2.0]), (503, [1.0, None, 2.0]), (504, [1.0, math.nan, 2.0]), (505, [math.inf, 1.0, 2.0]), (506, [1e30, -1e30, 0.0]), (507, [1.0, 2.0, 3.0, 4.0])]
    return rows


@pytest.mark.parametrize("k, rounds", [(8, 10), (5, 1), (3, 40)])
def test_delta_lloyd_equals_plain_lloyd(spark, k, rounds):
    df = spark.createDataFrame([(*r, 1) for r in vector_rows()], "vec_id long, embedding array<double>, cluster int")
    kept = centroids.kept_vectors(df, 3)
    found = centroids.delta_lloyd(kept, centroids.first_centroids(kept, k, "3"), rounds)
    rows, cents = plain_lloyd(vector_rows(), k, rounds)
    got = sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance) for r in found.assigned.collect())
    assert got == rows
    assert found.centroids.tolist() == cents
    n = len(rows)
    assert found.compared[0] == n * k and all(c <= n * k for c in found.compared)
    if rounds == 40:  # it comes to rest, and then compares and moves little
        assert len(found.moved) < 40 and found.moved[-1] == 0 and sum(found.moved[1:]) < n * 4


def test_clusters_of_little(spark):
    few = spark.createDataFrame([(1, [0.5] * 64), (2, [1.5] * 64), (2, [1.5] * 64)], "vec_id long, embedding array<float>")
    kept = centroids.kept_vectors(few, 64)
    found = centroids.delta_lloyd(kept, centroids.first_centroids(kept, 8, "3"), 10)
    assert {r.distance for r in found.assigned.collect()} == {0}
    none = centroids.kept_vectors(few.limit(0), 64)
    assert len(centroids.first_centroids(none, 8, "3")) == 0


def test_unchanged_owner_compares_changed_only():
    v = np.array([[0, 0], [10, 0], [4, 0]])
    cents = np.array([[0, 0], [9, 0], [4, 1]])
    own, d, n = centroids._nearest(v, np.array([0, 1, 0], np.int32), np.array([0, 1, 16]), cents, np.array([False, False, True]))
    assert own.tolist() == [0, 1, 2] and d.tolist() == [0, 1, 1] and n == 3
