"""Token files of any vocabulary, mixing without ids, and the queries themselves."""

import json
import zlib

import pytest
from pyspark.sql import functions as F

from loopwise.llm import media, mixing, pii, token_files, toxicity

SF = "/root/testdata/sf0.001"
TEXTS = [None, "", "Hello  World's naïve co-op, 12 ½ <|endoftext|> x", " \n\tTABS and CAFÉ ", "İstanbul ß ﬁ", "日本語 text", "don't we'll I'D", "a" * 300, "…!!?? --", "́x é"]


def small_table(tmp_path):
    """A vocabulary of single letters that splits at white space only."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    spec = {"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "decoder": None,
            "model": {"type": "BPE", "dropout": None, "unk_token": "?", "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False, "vocab": {c: i for i, c in enumerate("?" + letters)} | {"he": 27}, "merges": [["h", "e"]]}}
    path = tmp_path / "small.json"
    path.write_text(json.dumps(spec))
    return str(path)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "small"])
def test_ids_of_any_vocabulary(spark, tmp_path, name):
    from tokenizers import Tokenizer

    path = small_table(tmp_path) if name == "small" else token_files.vocabulary(name)
    plain = Tokenizer.from_file(path)
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens int")
    at = f"file://{tmp_path}/tokens"
    token_files.write_tokens(docs, at, path, end_id=3)
    got = {r.doc_id: list(r.ids) for r in token_files.read_tokens(spark, at).collect()}
    assert got == {i: [*plain.encode(t or "", add_special_tokens=False).ids, 3] for i, t in enumerate(TEXTS)}
    assert token_files.by_words(json.loads(plain.to_str())) == (name == "word_bpe_49k.json")


def test_rows_without_ids_meet_their_targets(spark):
    """A third of all rows has no id and one size; targets are met all the same."""
    rows = [(None, f"word{i} and four more words", "a", "x") for i in range(3000)] + [(i, " ".join(["w"] * (i % 40)), "b" if i % 2 else None, "x") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    sized = mixing.sized_documents(docs)
    how = mixing.plan(sized)
    taken = mixing.copies(sized, how).groupBy("source").agg(F.sum(F.col("size") * F.size("copies")).alias("taken"), F.first("target").alias("target"), F.max(F.size("copies")).alias("most")).collect()
    assert len(taken) == 3 and all(abs(r.taken - r.target) <= 0.01 * r.target and r.most <= 3 for r in taken)
    shards = mixing.mix(docs).groupBy("__shard").count().collect()
    assert len(shards) == mixing.LEAST_SHARDS == how.shards


def test_source_mix_deals_out_many_shards(spark):
    rows = mixing.op1(spark, SF).collect()
    assert {s for r in rows for s in r.shards} == set(range(mixing.LEAST_SHARDS))
    assert all(r.taken == r.size * len(r.shards) and r.taken <= 3 * r.size for r in rows)


def test_token_query(spark):
    """The query's digests are those of the plain tokenizer."""
    from tokenizers import Tokenizer

    plain, start = Tokenizer.from_file(token_files.vocabulary()), 0
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.op6(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect():
        ids = [*plain.encode(r.text or "", add_special_tokens=False).ids, 2]
        assert got[r.doc_id] == (start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)))
        start += len(ids)


def test_queries_cover_their_tables(spark):
    """One row for each row of the table, and the same again."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    for query, rows in ((pii.op3, docs), (toxicity.op5, docs), (media.op2, spark.read.parquet(f"{SF}/embeddings.parquet").count())):
        first, again = (sorted(map(str, query(spark, SF).collect())) for _ in range(2))
        assert len(first) == rows and first == again
