"""Benchmark decontamination by winnowing, in DataFrame functions only.

Every run of K words gives a k-gram hash; of each window of WINDOW words the
smallest one is its fingerprint, and of neighbouring windows with the same
fingerprint only the first is kept, with the place where it changes.  Texts that
share WINDOW words share a kept fingerprint, so fingerprints of documents are
joined with those of benchmark items, and each hit is extended, word by word, to
the windows around it that have this fingerprint.  Items shorter than a window
are windows of their own length, for which documents are winnowed as well, in
the same scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loopwise.llm import _store

WINDOW = 13
#: Words of a k-gram: a window holds WINDOW - K + 1 of them.
K = 6

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Lower-cases A-Z and takes the words; null has none."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _BETWEEN)
    return F.filter(parts, lambda x: x != "")


def _grams(hashes: Column, k: int) -> Column:
    """Hashes of the runs of k word hashes that start at each word."""
    return F.transform(hashes, lambda x, i: F.xxhash64(x, *[F.get(hashes, i + j) for j in range(1, k)]))


def _word_hashes(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def item_windows(items: DataFrame) -> DataFrame:
    """length, f (fingerprint), win (its words), items (ids) per distinct
    window of `items(item_id, text)`; an item of fewer words than a window, but
    not none, is one window."""
    w = items.select("item_id", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(WINDOW))
    each = w.select("item_id", length.alias("length"), F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - length + 1), lambda i: F.slice("w", i, length))).alias("win"))
    each = each.groupBy("length", "win").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    h = _word_hashes(F.col("win"))
    f = F.array_min(F.slice(_grams(h, K), 1, F.col("length") - K + 1))
    for n in range(1, K):
        f = F.when(F.col("length") == n, F.get(_grams(h, n), 0)).otherwise(f)
    return each.withColumn("f", f)


def _kept(rows: DataFrame, length: int) -> tuple[DataFrame, str]:
    """`rows(w, h, g<k>)` with a column, and its name: the kept fingerprints of
    windows of `length` words as structs (length, at, end, f): the windows that
    start at at to end - 1 have the fingerprint f.  The minimum over a window's
    k-grams is built from minima over 2, 4, ... of them."""
    k, name = min(K, length), f"m{length}"
    grams, have = length - k + 1, 1
    rows = rows.withColumn(name, F.col(f"g{k}"))
    while have < grams:
        step = min(have, grams - have)
        rows = rows.withColumn(name, F.zip_with(name, F.slice(name, step + 1, F.greatest(F.size(name), F.lit(1))), lambda x, y: F.least(x, y)))
        have += step
    rows = rows.withColumn(name, F.slice(name, 1, F.greatest(F.size("w") - length + 1, F.lit(0))))
    runs = F.transform(name, lambda x, i: F.struct(F.lit(length).alias("length"), i.alias("at"), x.alias("f")))
    rows = rows.withColumn(f"r{length}", F.filter(runs, lambda r: (r["at"] == 0) | (r["f"] != F.get(name, r["at"] - 1))))
    ends = lambda r, i: F.coalesce(F.get(f"r{length}", i + 1)["at"], F.size(name))
    return rows.withColumn(f"k{length}", F.transform(f"r{length}", lambda r, i: F.struct(r["length"].alias("length"), r["at"].alias("at"), ends(r, i).alias("end"), r["f"].alias("f")))), f"k{length}"


def hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per row of `docs(doc_id, text)`: doc_id, text_hash, n_words, spans
    (disjoint sorted [start, end) word spans inside windows that occur),
    item_ids (sorted).

    Null or word-less texts have no words and no hits.  Rows that repeat a
    doc_id, with the same text or another, give one row each.  Null ids are kept;
    extra columns, whatever their names, are ignored; with an empty benchmark
    nothing is hit."""
    spark = docs.sparkSession
    windows, windows_at = _store.written(item_windows(items), "windows")
    lengths = [r[0] for r in windows.select("length").distinct().orderBy("length").collect()]  # WINDOW at most
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("w")).withColumn("h", _word_hashes(F.col("w")))
    for k in sorted({min(K, n) for n in lengths}):
        rows = rows.withColumn(f"g{k}", _grams(F.col("h"), k))
    kept = []
    for n in lengths:
        rows, name = _kept(rows, n)
        kept.append(F.col(name))
    # One row for each document itself, under a length that no window has and a
    # value that spreads, and one for each kept fingerprint.
    own = F.array(F.struct(F.lit(0).alias("length"), F.lit(-1).alias("at"), F.size("w").alias("end"), F.col("text_hash").alias("f")))
    rows = rows.select("doc_id", "text_hash", F.inline(F.concat(own, *kept)))
    met = rows.join(_store.small(windows), ["length", "f"], "left").where("length = 0 or win is not null")
    met, _ = _store.written(met.select("doc_id", "text_hash", "at", "end", "win", "items"), "fingerprint-hits")
    _store.drop(spark, windows_at)
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_hash"] == b["text_hash"])
    # The words of the documents with hits, fetched for them alone.
    per_doc = met.where("at >= 0").groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("at", "end", "win", "items")).alias("met"))
    per_doc, per_doc_at = _store.written(per_doc, "hits-by-document")
    keys = _store.small(per_doc.select("doc_id", "text_hash"))
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    texts = texts.join(keys, same(texts, keys), "left_semi").dropDuplicates(["doc_id", "text_hash"]).withColumn("w", words_of(F.col("text"))).drop("text")
    both = texts.join(per_doc, same(texts, per_doc)).select(texts["doc_id"], texts["text_hash"], "w", "met")
    # Extended: the windows of a run that are the item's, word by word.
    at = lambda m: F.filter(F.sequence(m["at"], m["end"] - 1), lambda a: F.slice("w", a + 1, F.size(m["win"])) == m["win"])
    found = F.transform("met", lambda m: F.struct(F.transform(at(m), lambda a: F.struct(a.alias("at"), (a + F.size(m["win"])).alias("end"))).alias("spans"), m["items"].alias("items")))
    both = both.select("doc_id", "text_hash", F.filter(found, lambda x: F.size(x["spans"]) > 0).alias("found")).where(F.size("found") > 0)
    both = both.select("doc_id", "text_hash", F.array_sort(F.array_distinct(F.flatten("found.spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten("found.items"))).alias("item_ids"))
    # Sorted spans become disjoint ones in a fold: those done and the open one.
    span = "struct<at:int,end:int>"
    start = F.struct(F.array().cast(f"array<{span}>").alias("done"), F.element_at("spans", 1).alias("open"))
    joined = F.aggregate(
        "spans",
        start,
        lambda acc, x: F.when(acc["open"]["end"] >= x["at"], F.struct(acc["done"].alias("done"), F.struct(acc["open"]["at"].alias("at"), F.greatest(acc["open"]["end"], x["end"]).alias("end")).alias("open"))).otherwise(
            F.struct(F.concat(acc["done"], F.array(acc["open"])).alias("done"), x.alias("open"))
        ),
        lambda acc: F.concat(acc["done"], F.array(acc["open"])),
    )
    spans, spans_at = _store.written(both.select("doc_id", "text_hash", joined.alias("spans"), "item_ids"), "spans")
    _store.drop(spark, per_doc_at)
    own = met.where("at = -1").select("doc_id", "text_hash", F.col("end").cast("long").alias("n_words"))
    out = own.join(spans, same(own, spans), "left")
    return out.select(own["doc_id"], own["text_hash"], "n_words", F.coalesce("spans", F.array().cast(f"array<{span}>")).alias("spans"), F.coalesce("item_ids", F.array().cast(spans.schema["item_ids"].dataType)).alias("item_ids"))


def contamination(docs: DataFrame, items: DataFrame, share: int = 20) -> DataFrame:
    """`hits` with n_hit (words inside spans), n_items and contaminated:
    n_hit > 0 and share * n_hit >= n_words."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["at"])
    out = hits(docs, items).withColumn("n_hit", n_hit).withColumn("n_items", F.size("item_ids").cast("long"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


def op8(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    ids = F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    return contamination(docs, items).select("doc_id", "n_words", "n_hit", "n_items", F.sha2(ids, 256).alias("items_sha256"), "contaminated")


ORACLE = r"""
with d as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') w from documents),
b as (select item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') w from benchmark),
bw as (select distinct item_id, least(len(w), 13) n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') win from (select item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) i from b where len(w) > 0)),
ns as (select distinct n from bw),
dw as (select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') win from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) i from d, ns where len(w) >= n)),
m as (select doc_id, item_id, i, dw.n from dw join bw on dw.win = bw.win and dw.n = bw.n),
hit as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + n)) p from m) group by 1),
it as (select doc_id, count(distinct item_id) n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) ids from m group by 1)
select d.doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from d left join hit using (doc_id) left join it using (doc_id)
"""
