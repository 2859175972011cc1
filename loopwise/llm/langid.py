"""Language identification with spans.

Each word gets a log likelihood per language from byte-trigram counts; the
script of its first letter, known from the byte ranges of UTF-8 leads, narrows
the languages that are tried.  A Viterbi pass over the words, with a penalty
for each switch, labels spans; long texts are cut into blocks whose transfer
matrices are chained, so that many blocks advance together.  Any number of
languages will do: what is worked on at once shrinks as they grow (`CELLS`).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loopwise.llm import _learn, _text

#: Labelled documents that trigram counts come from, at most.
SAMPLE = 20_000
#: Log-likelihood price of one switch of language.
SWITCH = 12.0
BLOCK = 128
_GRAMS = 1 << 18
#: Numbers that one step works on at once, whatever the languages; only a single
#: long document may need more, 5 bytes for each of its words and languages.
CELLS = 1 << 21

# 6-bit byte classes: 0 for what is between words, letters, then other bytes.
_CLASS = np.zeros(256, dtype=np.int32)
_CLASS[65:91] = _CLASS[97:123] = np.arange(1, 27)
_CLASS[128:] = 27 + np.arange(128) % 37

#: Script by lead byte: 0 Latin, 1 Greek, 2 Cyrillic and Armenian, 3 Hebrew,
#: 4 Arabic and neighbours, 5 Indic and South-East Asian, 6 kana and Han,
#: 7 Hangul, 8 others.
_SCRIPT = np.zeros(256, dtype=np.int8)
_SCRIPT[0xCE:0xD0] = 1
_SCRIPT[0xD0:0xD6] = 2
_SCRIPT[0xD6:0xD8] = 3
_SCRIPT[0xD8:0xE0] = 4
_SCRIPT[0xE0:0xE2] = 5
_SCRIPT[0xE2] = 8
_SCRIPT[0xE3:0xEA] = 6
_SCRIPT[0xEA:0xEE] = 7
_SCRIPT[0xEE:] = 8
SCRIPTS = 9


def _trigrams(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Trigram codes of the words, with a boundary on either side, and each
    word's first position among them: a word of n bytes has n of them."""
    code = _CLASS[raw]
    n, lengths = len(code), ends - starts
    at = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    inside = np.repeat(starts - at, lengths) + np.arange(int(lengths.sum()))
    before, after = np.zeros(n, np.int32), np.zeros(n, np.int32)
    before[1:], after[:-1] = code[:-1], code[1:]
    before[starts], after[ends - 1] = 0, 0
    return (before[inside] << 12) | (code[inside] << 6) | after[inside], at


@dataclass
class Model:
    """Languages by name; `logs` has a row for each of the known trigram `codes`
    and one for all others; `allowed` says which languages use a script."""

    langs: list[str]
    codes: np.ndarray
    logs: np.ndarray
    allowed: np.ndarray

    def rows(self) -> np.ndarray:
        """The row of `logs` of every trigram code."""
        out = np.full(_GRAMS, len(self.codes), dtype=np.int32)
        out[self.codes] = np.arange(len(self.codes))
        return out


def _word_scores(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, model: Model, rows: np.ndarray, use: np.ndarray) -> np.ndarray:
    """Words x the languages `use`: log likelihoods less the best one's."""
    out = np.empty((len(starts), len(use)), np.float32)
    logs, allowed, i = model.logs[:, use], model.allowed[:, use], 0
    while i < len(starts):
        first = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, first + CELLS // len(use), side="right")))
        grams, at = _trigrams(raw[first : ends[j - 1]], starts[i:j] - first, ends[i:j] - first)
        scores = np.add.reduceat(logs[rows[grams]], at, axis=0)
        scores[~allowed[_SCRIPT[raw[starts[i:j]]]]] -= 1000
        out[i:j] = scores - scores.max(axis=1, keepdims=True)
        i = j
    return out


def train(docs: DataFrame, sample: int = SAMPLE, held_out: tuple[int, int] | None = (4, 2)) -> Model:
    """Trigram counts per language, summed by Spark, from at most `sample`
    documents with a language; those whose crc32 remainder is held out are
    never read for it."""
    rows = docs.where("lang is not null and text is not null and doc_id is not null")
    if held_out:
        rows = rows.where(_learn.remainder(F.col("doc_id"), held_out[0]) != held_out[1])
    chosen = rows.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).distinct()
    rows = rows.join(F.broadcast(chosen), "doc_id").select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, at = np.unique(np.array(b.column(0).to_pylist(), dtype=object).astype(str), return_inverse=True)
            for part in _text.slices(b.column(1)):
                starts, ends, first = part.words(_text.LETTERS)
                if not len(starts):
                    continue
                grams, _ = _trigrams(part.raw, starts, ends)
                lang = np.repeat(at[part.first : part.first + part.n], np.diff(first))
                key, n = np.unique(np.repeat(lang, ends - starts).astype(np.int64) * _GRAMS + grams, return_counts=True)
                # Negative codes count words by script.
                script = -1 - _SCRIPT[part.raw[starts]].astype(np.int64)
                key2, n2 = np.unique(lang * SCRIPTS - script - 1, return_counts=True)
                code = np.concatenate((key % _GRAMS, -1 - key2 % SCRIPTS))
                name = langs[np.concatenate((key // _GRAMS, key2 // SCRIPTS))]
                yield pa.RecordBatch.from_arrays([pa.array(name.astype(str)), pa.array(code), pa.array(np.concatenate((n, n2)))], names=["lang", "code", "n"])

    counts = rows.mapInArrow(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique())
    grams = counts[counts.code >= 0]
    codes = np.sort(grams["code"].unique())
    logs = np.zeros((len(codes) + 1, len(langs)), dtype=np.float32)
    allowed = np.zeros((SCRIPTS, len(langs)), dtype=bool)
    for i, lang in enumerate(langs):
        own = grams[grams.lang == lang]
        n = np.full(len(codes) + 1, 0.5)
        n[np.searchsorted(codes, own["code"])] += own["n"]
        logs[:, i] = np.log(n / n.sum())
        by_script = counts[(counts.lang == lang) & (counts.code < 0)]
        for code, k in zip(by_script["code"], by_script["n"], strict=True):
            allowed[-1 - code, i] = k >= 0.01 * by_script["n"].sum()
    allowed[~allowed.any(axis=1)] = True
    return Model(langs, codes, logs, allowed)


def viterbi(scores: np.ndarray, first: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best label per word for texts `first[i]` to `first[i + 1]`."""
    total, k = scores.shape
    if not total or k == 1:
        return np.zeros(total, dtype=np.int64)
    counts = np.diff(first)
    blocks = -(-counts // BLOCK)
    owner = np.repeat(np.arange(len(counts)), blocks)
    begin_of = np.concatenate(([0], np.cumsum(blocks)))
    rank = np.arange(len(owner)) - begin_of[owner]
    begin = first[:-1][owner] + rank * BLOCK
    length = np.minimum(counts[owner] - rank * BLOCK, BLOCK)
    follows = np.append(owner[1:] == owner[:-1], False)
    # The value of each label before every block, from the block before it; all
    # blocks but the last of a text are full.
    enter = np.zeros((len(owner), k))
    inner = np.flatnonzero(follows)
    for part in (inner[g : g + max(1, CELLS // (k * k))] for g in range(0, len(inner), max(1, CELLS // (k * k)))):
        # best[b, s, t]: entering block b after label s and leaving it with t.
        best = np.where(np.eye(k, dtype=bool), 0.0, -np.inf)[None].repeat(len(part), axis=0)
        for i in range(BLOCK):
            best = np.maximum(best, best.max(axis=2, keepdims=True) - switch) + scores[begin[part] + i][:, None, :]
        for r in np.unique(rank[part]):
            at = np.flatnonzero(rank[part] == r)
            enter[part[at] + 1] = (enter[part[at]][:, :, None] + best[at]).max(axis=1)
    # All blocks forward, from their true entry values: which labels come from
    # the best one before, and which that is.
    value = enter
    jumped = np.zeros((len(owner), BLOCK, k), dtype=bool)
    top = np.zeros((len(owner), BLOCK), dtype=np.int32)
    for i in range(int(length.max())):
        on = np.flatnonzero(length > i)
        now = value[on]
        jump = now.max(axis=1, keepdims=True) - switch
        top[on, i] = now.argmax(axis=1)
        jumped[on, i] = now < jump
        value[on] = np.maximum(now, jump) + scores[begin[on] + i]
    # From the last block of each text to its first.
    labels = np.zeros(total, dtype=np.int64)
    state = value.argmax(axis=1)
    for r in range(int(rank.max()), -1, -1):
        at = np.flatnonzero(rank == r)
        before = at[follows[at]]
        state[before] = state[before + 1]
        for i in range(int(length[at].max()) - 1, -1, -1):
            on = at[length[at] > i]
            labels[begin[on] + i] = state[on]
            state[on] = np.where(jumped[on, i, state[on]], top[on, i], state[on])
    return labels


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType()), T.StructField("bytes", T.LongType())]))
FOUND = T.StructType([T.StructField("spans", SPANS), T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])


def _words(part: _text.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with a letter in them: runs of multi-byte signs alone are no words."""
    starts, ends, first = part.words(_text.LETTERS)
    ascii_letters = np.concatenate(([0], np.cumsum((part.raw < 128) & _text.LETTERS[part.raw], dtype=np.int32)))
    odd = np.flatnonzero(ascii_letters[ends] == ascii_letters[starts])
    drop = [i for i in odd if not any(c.isalpha() for c in part.raw[starts[i] : ends[i]].tobytes().decode("utf-8", "ignore"))]
    if drop:
        keep = np.ones(len(starts), bool)
        keep[drop] = False
        starts, ends = starts[keep], ends[keep]
        first = np.searchsorted(starts, part.offsets)
    return starts, ends, first


def identified(docs: DataFrame, model: Model, into: str = "__found") -> DataFrame:
    """`docs` with a struct `into` (a column of that name is replaced): spans,
    runs of words (maximal runs of letters, counted from 0, [start, end)) of one
    language and how many bytes they have; lang, the language with the most bytes
    (ties: the last by name); score, its share of all of them.

    Null and empty texts and those without a letter have no span, lang `und` and
    score 0.  Each row is judged by its own text: repeated rows alike, other
    columns stay as they are, an empty table gives an empty result.  Without a
    learned language all is `und`."""
    held: dict[str, np.ndarray] = {}
    k = len(model.langs)

    @F.arrow_udf(FOUND)
    def find(text: pa.Array) -> pa.Array:
        if "rows" not in held:
            held["rows"] = model.rows()
        start_of, end_of, lang_of, bytes_of, ends_of, best_of, share_of = [], [], [], [], [np.zeros(1, np.int64)], [], []
        done = 0
        for part in _text.slices(text, min(_text.SLICE_BYTES, 8 * CELLS // max(k, 1))):
            starts, ends, first = _words(part)
            if not k:
                starts, ends, first = starts[:0], ends[:0], first * 0
            # Scripts narrow the languages to those that any word may be in.
            labels = np.zeros(0, np.int64)
            if len(starts):
                use = np.flatnonzero(model.allowed[np.unique(_SCRIPT[part.raw[starts]])].any(axis=0))
                labels = use[viterbi(_word_scores(part.raw, starts, ends, model, held["rows"], use), first)]
            new = np.ones(len(labels), bool)
            new[1:] = labels[1:] != labels[:-1]
            new[first[:-1][first[:-1] < len(labels)]] = True
            at = np.flatnonzero(new)
            word_end = np.append(at[1:], len(labels))
            text_of = np.searchsorted(first, at, side="right") - 1
            start_of.append(at - first[text_of])
            end_of.append(word_end - first[text_of])
            lang_of.append(labels[at])
            size = np.concatenate(([0], np.cumsum(ends - starts)))
            size = size[word_end] - size[at]
            bytes_of.append(size)
            counts = np.bincount(text_of, minlength=part.n) if len(at) else np.zeros(part.n, np.int64)
            ends_of.append(done + np.cumsum(counts))
            done += len(at)
            per = np.bincount(text_of * max(k, 1) + labels[at], weights=size, minlength=part.n * max(k, 1)).reshape(part.n, -1)
            best = per.shape[1] - 1 - per[:, ::-1].argmax(axis=1)
            best_of.append(best)
            share_of.append(per[np.arange(part.n), best] / np.maximum(per.sum(axis=1), 1))
        join = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
        names = np.array([*model.langs, "und"], dtype=object)
        body = pa.StructArray.from_arrays([pa.array(join(start_of, np.int32)), pa.array(join(end_of, np.int32)), pa.array(names[join(lang_of, np.int64)], pa.string()), pa.array(join(bytes_of, np.int64))], names=["start", "end", "lang", "bytes"])
        spans = pa.ListArray.from_arrays(pa.array(np.concatenate(ends_of), pa.int32()), body)
        share = join(share_of, np.float64)
        lang = names[np.where(share > 0, join(best_of, np.int64), k)]
        return pa.StructArray.from_arrays([spans, pa.array(lang, pa.string()), pa.array(share)], names=["spans", "lang", "score"])

    return docs.withColumn(into, find("text"))


def op10(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs)
    rows = identified(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", (_learn.remainder(F.col("doc_id"), 4) == 2).alias("held_out"), F.col("__found.lang").alias("lang_pred"), F.col("__found.score").alias("score"))
