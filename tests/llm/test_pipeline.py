"""Every stage of the pipeline on its own input, and the whole."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from loopwise.llm import _learn, mixing, quality, token_files
from tests.llm.test_brute_force import components, contaminated
from tests.llm.test_operators import LONG

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `row` string, text_hash long"


def fixture():
    rng = np.random.default_rng(12)
    words = [f"word{i}" for i in range(300)]
    text = lambda n: " ".join(words[x] for x in rng.integers(0, 300, n)) + "."
    rows = [(i, text(int(rng.integers(20, 80)))) for i in range(60)]
    rows += [(60 + i, rows[i][1]) for i in range(10)] + [(70 + i, rows[i][1] + " more") for i in range(10)]
    rows += [(80 + i, text(5) + " " + " ".join(words[:30])) for i in range(5)] + [(90 + i, "$$$ ### %%% " * 20) for i in range(10)]
    rows += [(100, None), (101, ""), (None, "a row without an id of its own"), (5, rows[5][1]), (6, "another text of the same id, with some words"), (102, LONG)]
    return [(i, t, "en", [None, "s1", "s2"][k % 3], len(t or ""), "x", 1) for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    rows = fixture()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i < 90), 0) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"word{i}" for i in range(30))), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def same(df, rows):
    return Counter(map(tuple, df.collect())) == Counter(rows)


def test_quality_stage(spark, folder, docs):
    model = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    scores = {(r.doc_id, r.text): r["__score"] for r in quality.scored(docs.select("doc_id", "text"), model).collect()}
    kept = P.keep_quality(spark, docs, folder)
    assert kept.columns == docs.columns and same(kept, [r for r in fixture() if scores[r[0], r[1]] >= 0.3])
    left = {r.doc_id for r in kept.collect()}
    assert not left & set(range(90, 100)) and len(left & set(range(60))) >= 58
    assert _learn.labelled(docs, spark.read.parquet(f"{folder}/labels.parquet"), "quality", 10_000, 5).count() < 100


def test_copies_stage(spark, folder, docs):
    _, low = components([(i, t) for i, t, *_ in fixture() if i is not None and i not in (5, 6)], 5, 80)
    kept = P.keep_one_of_copies(spark, docs, folder)
    got = kept.collect()
    assert kept.columns == docs.columns and Counter(r.doc_id for r in got if r.doc_id not in (5, 6, 65, 66, 75, 76)) == Counter([i for i, c in low.items() if i == c and i not in (65, 66, 75, 76)] + [None])
    assert [r.doc_id for r in got].count(5) == [r.doc_id for r in got].count(6) == 1


def test_decontamination_stage(spark, folder, docs):
    judged = contaminated([r[:2] for r in fixture()], [(1, " ".join(f"word{i}" for i in range(30)))])
    rows = fixture()
    bad = {(i, n) for i, n, hit, _ in judged if hit and 20 * hit >= n}
    kept = P.keep_uncontaminated(spark, docs, folder)
    assert kept.columns == docs.columns and {i for i, _ in bad} >= {80, 81, 82, 83, 84}
    gone = Counter(rows) - Counter(map(tuple, kept.collect()))
    assert {r[0] for r in gone} == {i for i, _ in bad}


def test_mixing_stage(spark, folder, docs):
    mixed = P.mix_sources(spark, docs, folder)
    rows = mixed.collect()
    sizes, taken = Counter(), Counter()
    for r in fixture():
        sizes[r[3]] += len((r[1] or "").split())
    for r in rows:
        taken[r.source] += len((r.text or "").split())
    targets = mixing.capped_targets(dict(sizes))
    assert mixed.columns == docs.columns and set(map(tuple, rows)) <= set(fixture())
    assert all(abs(taken[s] - targets[s]) <= 100 or s == [r[3] for r in fixture() if r[0] == 102][0] for s in sizes)


def test_token_stage_keeps_the_order(spark, folder, docs):
    shuffled = docs.where("doc_id <> 102 or doc_id is null").orderBy(F.xxhash64("doc_id", "text")).coalesce(1)
    order = [(r.doc_id, r.text) for r in shuffled.collect()]
    got = P.to_token_files(spark, shuffled, folder).orderBy("start").collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_files.vocabulary())
    assert [(r.doc_id, r.ids) for r in got] == [(i, [*t.encode(x or "", add_special_tokens=False).ids, 2]) for i, x in order]


def test_whole_pipeline(spark, folder, docs):
    got = P.run(spark, folder).collect()
    ids = {r.doc_id for r in got}
    assert ids and not ids & ({*range(60, 80)} | {*range(80, 85)} | {*range(90, 100)}) and max(Counter(r.doc_id for r in got).values()) <= 3
    assert sorted(r.start for r in got) == np.cumsum([0] + [r.n_tokens for r in sorted(got, key=lambda r: r.start)])[:-1].tolist()


def test_stages_take_an_empty_table(spark, folder, docs):
    rows = docs.limit(0)
    for name, stage in P.STAGES:
        rows = stage(spark, rows, folder)
        assert rows.count() == 0, name
        rows = docs.limit(0)
