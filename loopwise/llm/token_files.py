"""Token ids as Parquet list columns.

Documents are dealt by ranges of doc_id and sorted, or left as they lie, encoded,
and written by Spark's Parquet writer: dictionary-coded id lists, delta-coded
counts and offsets (format version 2), row groups of a set size and page indexes,
so that readers fetch some documents or the metadata columns alone.
"""

from __future__ import annotations

import gc
import json
import zlib
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loopwise.llm import _store

#: Distinct words whose ids a worker keeps, twice over: the words of late and,
#: until as many new ones have come, those before them.
CACHE_WORDS = 120_000

#: A run of these after letters is a piece of its own.
_TAIL = b"!#$%&*+,-./:;=?@^_~"

# The rules of vocabularies whose words may be encoded one by one.
_NORMAL = ["NFC", "Replace", "Lowercase"]
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_encoders: dict[tuple[str, int], _Encoder] = {}


def by_words(rules: dict) -> bool:
    """Whether a vocabulary file drops white space, lower-cases, parts letters from
    the rest and ends words as `_Encoder` takes for granted."""
    normal, cut, model = rules.get("normalizer") or {}, rules.get("pre_tokenizer") or {}, rules.get("model") or {}
    kinds = [x.get("type") for x in normal.get("normalizers", [])]
    blank = [(x["pattern"], x["content"]) for x in normal.get("normalizers", []) if x.get("type") == "Replace"]
    parts = cut.get("pretokenizers", [])
    same = kinds == _NORMAL and blank == [({"Regex": r"\s+"}, " ")] and [x.get("type") for x in parts] == ["Split", "ByteLevel"]
    if not same or model.get("type") != "BPE" or model.get("end_of_word_suffix") != "</w>" or model.get("dropout"):
        return False
    split, level = parts
    return split["pattern"] == {"Regex": _PATTERN} and split["behavior"] == "Removed" and split["invert"] is True and not level["add_prefix_space"] and not level["use_regex"]


def _visible() -> dict[int, int]:
    """The vocabulary's letter for each byte: bytes that print stand for
    themselves, the others for what follows 255."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [x for x in range(256) if x not in shown]
    return {x: 256 + i for i, x in enumerate(hidden)}


class _Encoder:
    """Ids of whole texts as little-endian bytes.

    The vocabulary's pattern never spans white space and parts letters from
    punctuation, so the ids of a text are those of its words, those of a word of
    letters with punctuation behind it are theirs one after the other, and each is
    found once while it stays in memory.  Lower-case words of Latin letters, which
    normalisation leaves alone, go to the library's model directly.  Files with other
    rules are told by `by_words`; their texts are encoded whole."""

    def __init__(self, path: str, end_id: int, words_part: bool = True):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark keeps the cores busy
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words_part = words_part
        self.model = self.tokenizer.model
        self.visible = _visible()
        self.end = array("I", [end_id]).tobytes()
        # Of lower-case words without the punctuation behind them, False if they are
        # more than letters, and of those that are.
        self.young: dict[bytes, bytes | bool] = {b"": b""}
        self.old: dict[bytes, bytes | bool] = {}
        self.odd: dict[bytes, bytes] = {}
        self.tails: dict[bytes, bytes] = {b"": b""}

    def _one(self, word: str) -> bytes:
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def _letters(self, bare: bytes) -> bytes | bool:
        word = bare.decode()
        if not word.isalpha():
            return False
        if not word.isascii():
            low = word.lower()
            # One capital letter maps to a letter and a mark, which binds to what follows.
            if not low.isalpha():
                return False
            if max(low) >= "\u0250":
                return self._one(word)
            word = low.encode().decode("latin-1").translate(self.visible)
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def _coded(self, words: set[bytes]) -> dict[bytes, bytes]:
        young, old, odd, tails, out = self.young, self.old, self.odd, self.tails, {}
        for w in words:
            bare = w.rstrip(_TAIL)
            key = bare.lower()
            ids = young.get(key)
            if ids is None:
                ids = old.get(key)
                young[key] = ids = self._letters(key) if ids is None else ids
            if ids is False:
                if w not in odd:
                    odd[w] = self._one(w.decode())
                out[w] = odd[w]
            elif len(bare) == len(w):
                out[w] = ids
            else:
                tail = w[len(bare) :]
                if tail not in tails:
                    tails[tail] = self._one(tail.decode())
                out[w] = ids + tails[tail]
        if len(young) > CACHE_WORDS:
            self.old, self.young = young, {b"": b""}
        if len(odd) > CACHE_WORDS:
            self.odd = {}
        if len(tails) > CACHE_WORDS:
            self.tails = {b"": b""}
        return out

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        if not self.words_part:
            found = self.tokenizer.encode_batch([t.decode() for t in texts], add_special_tokens=False)
            return [array("I", x.ids).tobytes() + self.end for x in found]
        gc.disable()  # millions of short-lived strings, no cycles
        try:
            split = [t.split() for t in texts]
            get, end = self._coded(set().union(*split)).__getitem__, self.end
            return [b"".join([*map(get, words), end]) for words in split]
        finally:
            gc.enable()


def _encoder(path: str, end_id: int, words_part: bool) -> _Encoder:
    """One per worker process: later tasks find the words of earlier ones."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = _Encoder(path, end_id, words_part)
    return _encoders[path, end_id]


def _batched(texts: pa.Array, most: int = 4 << 20) -> Iterator[list[bytes]]:
    """Texts (null: empty) in lists of bounded bytes."""
    part, size = [], 0
    for t in texts.cast(pa.binary()):
        t = t.as_py() or b""
        if part and size + len(t) > most:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def file_schema(id_type: str = "bigint") -> str:
    return f"doc_id {id_type}, n_tokens long, local_start long, ids array<int>"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, partitions: int | None = None, by_id: bool = True, row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10) -> None:
    """Writes `docs(doc_id, text)` as token files at `path`: in ascending doc_id
    order over the sorted file names (null ids first; rows of one id by a hash of
    the text, then the text), or with by_id=False as the rows lie, a file for each
    partition of `docs`.

    Null and empty texts have only the end id.  Every row is written, repeated
    ones as often; columns of any other name are ignored; an empty table gives
    files without rows.  A file's rows carry doc_id, n_tokens (with the end id),
    local_start (ids before it in the file) and ids."""
    schema = docs.select("doc_id").schema
    # Read here and once: a vocabulary as Python objects would stay in every worker's memory.
    words_part = by_words(json.loads(Path(tokenizer).read_text()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, start = _encoder(tokenizer, end_id, words_part), 0
        for batch in batches:
            at = 0
            for part in _batched(batch.column(1)):
                coded = encode(part)
                n = np.array([len(c) // 4 for c in coded], dtype=np.int64)
                ends = np.concatenate(([0], np.cumsum(n)))
                ids = np.frombuffer(b"".join(coded), dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(part)), pa.array(n), pa.array(start + ends[:-1]), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))],
                    names=["doc_id", "n_tokens", "local_start", "ids"],
                )
                start += int(ends[-1])
                at += len(part)

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    if by_id:
        # The hash parts rows that share one id, or none, over several files.
        by = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
        rows = rows.repartitionByRange(partitions, *by) if partitions else rows.repartitionByRange(*by)
        rows = rows.sortWithinPartitions(*by, "text")
    rows = rows.mapInArrow(run, file_schema(schema[0].dataType.simpleString()))
    writer = rows.write.option("parquet.block.size", row_group_bytes).option("parquet.page.size", page_bytes).option("parquet.writer.version", "PARQUET_2_0")
    for column in ("doc_id", "n_tokens", "local_start"):
        writer = writer.option(f"parquet.enable.dictionary#{column}", "false")
    writer.option("compression", "zstd").mode("overwrite").parquet(path)


def read_tokens(spark: SparkSession, path: str, ids: bool = True, id_type: str = "bigint") -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and, unless a
    metadata read is enough, ids.  Filters on doc_id reach the row groups and
    page indexes."""
    files = spark.read.schema(file_schema(id_type)).parquet(path).withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    # One row per file: how many ids the files before it hold.
    per_file = files.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(_before()), F.lit(0))
    starts = per_file.select("file", before.alias("file_start"))
    columns = ["doc_id", (F.col("file_start") + F.col("local_start")).alias("start"), "n_tokens", *(["ids"] if ids else [])]
    # One row for each file, of which the driver has the list anyway.
    return files.join(F.broadcast(starts), "file").select(*columns)


def _before():
    from pyspark.sql import Window

    return Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)


def tokens_of(spark: SparkSession, path: str, low: int, high: int) -> DataFrame:
    """The documents low <= doc_id <= high, read selectively."""
    return read_tokens(spark, path).where(F.col("doc_id").between(low, high))


def checksums(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32: unsigned crc32 of the ids as
    little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(3)
            offsets = lists.offsets.to_numpy().astype(np.int64)
            flat = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), dtype="<i4")).cast("B")
            crc = [zlib.crc32(flat[a:b]) for a, b in zip((4 * offsets[:-1]).tolist(), (4 * offsets[1:]).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _store.new_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, vocabulary())
    return checksums(read_tokens(spark, path))
