"""Probability of a document as the sum over all ways to write it in subwords.

A document is a run of words (split at white space, A-Z lower-cased) and an end.
Every word is a lattice: arcs are the pieces of an existing subword vocabulary,
weighed by a unigram model, and one arc over the whole word, weighed by how often
training has seen it.  A forward recursion in log space sums over all ways through it:

    P_k(word) = (max(c_k - d, 0) + (d * V_k + 1/2) * L_k(word)) / (N_k + 1)
    P(text) = sum over k of share_k * P_k(end) * product of P_k(word)

with c_k how often training texts of language k have the word, N_k their tokens, V_k
their distinct words, d = DISCOUNT and L_k the lattice of pieces.  Over all words and
the end every P_k sums to one: piece weights do, as pieces that begin a word carry
its blank.  The vocabulary's scores weigh the pieces at first; ROUNDS of
expected counts over the distinct training words of each language, with PRIOR times
the first weights added, adapt them.  The vocabulary itself and its pieces stay as
they are.  The language of the scored text is never an input.

All training words are counted and all distinct words enter the expected counts.  The
most frequent words (at most HEAVY, by a threshold on the exact counts) meet the
texts' words by broadcast, all others by a shuffled join, so no word is a hot key.

Null texts are empty, and have the end only; null ids are training rows; repeated rows
count as often.  Words and texts of any length are whole: words of one length go
through together, in blocks of bounded size.  Without training rows N and V are 0 and
the first weights count.  Columns beyond doc_id, lang and text are not read."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loopwise.llm import _learn, _store, _text

DISCOUNT, PRIOR, ROUNDS = 0.75, 1000.0, 3
#: Languages with weights of their own, by training documents; all others share one set.
LANGUAGES = 8
#: Words that a broadcast may hold.
HEAVY = 200_000
#: Cells (word bytes) of a block inside a task.
CELLS = 1 << 16

_SPREAD = np.uint64(0xD6E8FEB86659FD93)
_MANY = np.uint64(0x9E3779B97F4A7C15)


def vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces as bytes, a blank before those that begin a word, and their weights,
    which sum to one.  Scores that are whole numbers are ranks, and weigh by Zipf's
    law; others are log probabilities.  Pieces that differ in case are one, and so
    are a byte and the letter that it is; those with blanks elsewhere never occur."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i))]
    scores = [model.get_score(i) for i in ids]
    ranks = all(s == int(s) for s in scores)
    weights: dict[bytes, float] = {bytes([i]): 0.0 for i in range(256)}
    for i, score in zip(ids, scores, strict=True):
        name = model.id_to_piece(i)
        piece = bytes([int(name[3:5], 16)]) if model.is_byte(i) else name.replace("▁", " ").encode().lower()
        if b" " not in piece[1:]:
            weights[piece] = weights.get(piece, 0.0) + (1 / (10 - score) if ranks else math.exp(score))
    pieces = sorted(weights, key=lambda p: (len(p), p))
    w = np.array([weights[p] for p in pieces])
    w = np.maximum(w, w[w > 0].min() / 2)  # bytes that the vocabulary has not
    return pieces, w / w.sum()


def _packed(data: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """A number for each run of 1, 2, ... `most` bytes, up to eight bytes their own
    bits."""
    out = np.zeros(len(data) + 1, np.uint64)
    for n in range(1, min(most, len(data)) + 1):
        last = data[n - 1 :].astype(np.uint64)
        out = out[: len(last)]
        out = out | last << np.uint64(8 * n - 8) if n <= 8 else out * _MANY ^ last
        yield out


class Lattices:
    """Finds pieces in words and sums over the ways through them."""

    def __init__(self, pieces: list[bytes]):
        self.n, self._by_length = len(pieces), {}
        lengths = np.array([len(p) for p in pieces])
        for n in sorted(set(lengths.tolist())):
            ids = np.flatnonzero(lengths == n)
            data = np.frombuffer(b"".join(pieces[i] for i in ids), np.uint8).reshape(-1, n)
            *_, keys = _packed(data.reshape(-1), n)
            keys = keys[::n]
            order = np.argsort(keys)
            maybe = np.zeros(1 << 20, bool)
            maybe[(keys * _SPREAD) >> np.uint64(44)] = True
            self._by_length[n] = (keys[order], ids[order].astype(np.int32), data[order], maybe)

    def arcs(self, words: np.ndarray) -> dict[int, np.ndarray]:
        """For words (rows of bytes, all of one width) per length the piece that
        begins at each place, by place and word; -1 is none."""
        rows, width = words.shape
        flat, found = words.reshape(-1), {}
        for n, packed in enumerate(_packed(flat, min(width, max(self._by_length))), 1):
            if n not in self._by_length:
                continue
            keys, ids, data, maybe = self._by_length[n]
            at = np.flatnonzero(maybe[(packed * _SPREAD) >> np.uint64(44)])
            at = at[at % width <= width - n]
            place = np.minimum(np.searchsorted(keys, packed[at]), len(keys) - 1)
            same = keys[place] == packed[at]
            at, place = at[same], place[same]
            if n > 8:
                same = (flat[at[:, None] + np.arange(n)] == data[place]).all(axis=1)
                at, place = at[same], place[same]
            if len(at):
                hit = np.full(rows * width, -1, np.int32)
                hit[at] = ids[place]
                found[n] = np.ascontiguousarray(hit.reshape(rows, width).T)
        return found

    @staticmethod
    def _sum(terms: list[np.ndarray]) -> np.ndarray:
        if len(terms) == 1:
            return terms[0]
        terms = np.stack(terms)
        most = terms.max(axis=0)
        return most + np.log(np.exp(terms - most).sum(axis=0))

    def forward(self, arcs: dict[int, np.ndarray], width: int, log_weights: np.ndarray) -> np.ndarray:
        """Log of the summed weight of all ways to each place (rows) of each word."""
        first = next(iter(arcs.values()))
        out = np.full((width + 1, first.shape[1]), -np.inf)
        out[0] = 0
        for t in range(1, width + 1):
            out[t] = self._sum([out[t - n] + log_weights[hit[t - n]] for n, hit in arcs.items() if n <= t])
        return out

    def expected(self, arcs: dict[int, np.ndarray], width: int, log_weights: np.ndarray) -> np.ndarray:
        """How often each piece is expected, summed over the words."""
        ahead = self.forward(arcs, width, log_weights)
        behind = np.full_like(ahead, -np.inf)
        behind[width] = 0
        for t in range(width - 1, -1, -1):
            behind[t] = self._sum([behind[t + n] + log_weights[hit[t]] for n, hit in arcs.items() if t + n <= width])
        counts = np.zeros(self.n)
        for n, hit in arcs.items():
            at, word = np.nonzero(hit >= 0)
            piece = hit[at, word]
            x = np.exp(ahead[at, word] + log_weights[piece] + behind[at + n, word] - ahead[width, word])
            counts += np.bincount(piece, weights=x, minlength=self.n)
        return counts


_lattices: dict[int, Lattices] = {}


def lattices(pieces: list[bytes]) -> Lattices:
    """Tables of a vocabulary, made once in each process."""
    key = hash(tuple(pieces))
    if key not in _lattices:
        _lattices.clear()
        _lattices[key] = Lattices(pieces)
    return _lattices[key]


def _logs(weights: np.ndarray) -> np.ndarray:
    """Logs of the weights; the one behind the last, for no piece, is of zero."""
    return np.append(np.log(weights), -np.inf)


def _gathered(batches: Iterator[pa.RecordBatch], rows: int = 40_000, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of so many words or bytes: small ones would leave few words of each
    length to go through together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows or sum(b.nbytes for b in held) >= most:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _blocks(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, bytes) of the words of each length, a blank before each, in blocks of
    bounded size."""
    wide = pa.types.is_large_string(words.type)
    offsets = np.frombuffer(words.buffers()[1], np.int64 if wide else np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    body = words.buffers()[2]
    body = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    length = np.diff(offsets)
    for n in np.unique(length[length > 0]).tolist():
        rows = np.flatnonzero(length == n)
        step = max(1, CELLS // (n + 1))
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            out = np.full((len(part), n + 1), 32, np.uint8)
            out[:, 1:] = body[offsets[part][:, None] + np.arange(n)]
            yield part, out


def _words(texts: pa.Array) -> Iterator[tuple[_text.Slice, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of texts with start, end, 64-bit hash (of the word with A-Z
    lower-cased) and text of each word.  Hashes stand for words only where they are
    compared within a slice or with HEAVY words."""
    for part in _text.slices(texts, 1 << 22):
        starts, ends, first = part.words()
        yield part, starts, ends, part.word_hashes(starts, ends), np.repeat(np.arange(part.n), np.diff(first))


def _cut(part: _text.Slice, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The words from each start to its end, A-Z lower-cased."""
    length = ends - starts
    offsets = np.concatenate([[0], np.cumsum(length)])
    at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], length)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(_text.LOWER[part.raw[at]])).cast(pa.string())


@dataclass
class Model:
    """share of training documents, tokens, distinct words and ends of each
    language; piece weights of each; tokens and distinct tokens of all training."""

    pieces: list[bytes]
    weights: np.ndarray
    share: list[float]
    tokens: list[int]
    distinct: list[int]
    ends: list[int]
    all_tokens: int
    all_distinct: int


def languages(docs: DataFrame) -> tuple[Column, list[int]]:
    """Number of each training row's language (null for others), and how many
    documents each has; all beyond the most frequent LANGUAGES share the last."""
    rows = docs.where("train").groupBy("lang").count()
    top = rows.where("lang is not null").orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    rest = (rows.agg(F.sum("count")).first()[0] or 0) - sum(r["count"] for r in top)
    number = F.lit(len(top))
    for i, r in enumerate(top):
        number = F.when(F.col("lang") == r.lang, i).otherwise(number)
    counts = [r["count"] for r in top] + ([rest] if rest or not top else [])
    return F.when(F.col("train"), number), counts


def counted(docs: DataFrame, k: Column, n: int) -> DataFrame:
    """word, everywhere (its count in all texts) and c0, c1, ... (in the training
    texts of each language); words of a slice of texts are counted before they are
    shuffled."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.column("k").fill_null(-1).to_numpy(zero_copy_only=False)
            for part, starts, ends, hashes, doc in _words(batch.column("text")):
                if not len(starts):
                    continue
                order = np.argsort(hashes)
                first = np.flatnonzero(np.concatenate([[True], np.diff(hashes[order]) != 0]))
                of = kind[part.first + doc[order]]
                counts = [np.diff(np.append(first, len(order)))] + [np.add.reduceat((of == i).astype(np.int64), first) for i in range(n)]
                at = order[first]
                yield pa.RecordBatch.from_arrays([_cut(part, starts[at], ends[at]), *[pa.array(c.astype(np.int64)) for c in counts]], names=names)

    names = ["word", "everywhere", *[f"c{i}" for i in range(n)]]
    rows = docs.select(k.alias("k"), "text").mapInArrow(step, "word string, everywhere long, " + ", ".join(f"c{i} long" for i in range(n)))
    return rows.groupBy("word").agg(*[F.sum(c).alias(c) for c in names[1:]])


def _expected(words: DataFrame, pieces: list[bytes], weights: np.ndarray) -> np.ndarray:
    """Expected counts of the pieces per language over its distinct words: a row for
    each task, language and piece goes through a sum."""
    n = len(weights)
    logs = [_logs(w) for w in weights]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, sums = lattices(pieces), np.zeros((n, len(pieces)))
        for batch in _gathered(batches):
            counts = [batch.column(f"c{i}").to_numpy(zero_copy_only=False) for i in range(n)]
            for rows, data in _blocks(batch.column("word")):
                arcs = found.arcs(data)
                for i in range(n):
                    mine = np.flatnonzero(counts[i][rows] > 0)
                    if len(mine):
                        part = arcs if len(mine) == len(rows) else {m: hit[:, mine] for m, hit in arcs.items()}
                        sums[i] += found.expected(part, data.shape[1], logs[i])
        k, piece = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(sums[k, piece])], names=["k", "piece", "x"])

    rows = words.select("word", *[f"c{i}" for i in range(n)]).mapInArrow(step, "k int, piece int, x double")
    out = np.zeros((n, len(pieces)))
    for r in rows.groupBy("k", "piece").agg(F.sum("x").alias("x")).toLocalIterator():  # the vocabulary, for each language
        out[r.k, r.piece] = r.x
    return out


def trained(words: DataFrame, documents: list[int], path: str, rounds: int = ROUNDS) -> Model:
    """The model of `counted` words, of training texts as many as `documents`."""
    pieces, first = vocabulary(path)
    n, total = len(documents), sum(documents)
    sums = [F.sum(f"c{i}").alias(f"t{i}") for i in range(n)] + [F.count_if(F.col(f"c{i}") > 0).alias(f"v{i}") for i in range(n)]
    own = sum((F.col(f"c{i}") for i in range(n)), F.lit(0))
    facts = words.agg(*sums, F.sum(own).alias("all"), F.count_if(own > 0).alias("distinct")).first()
    weights = np.tile(first, (n, 1))
    seen = words.where(own > 0)
    for _ in range(rounds if total else 0):
        weights = _expected(seen, pieces, weights) + PRIOR * first
        weights /= weights.sum(axis=1, keepdims=True)
    tokens = [(facts[f"t{i}"] or 0) + documents[i] for i in range(n)]
    return Model(pieces, weights, [d / total if total else 1.0 for d in documents], tokens, [facts[f"v{i}"] for i in range(n)], documents, (facts["all"] or 0) + total, facts["distinct"] + bool(total))


def scored_words(words: DataFrame, m: Model) -> DataFrame:
    """word, everywhere, known (seen in training), base (log10 of its smoothed share
    of all training tokens), s0, s1, ...: log10 P_k of the word."""
    n = len(m.weights)
    logs = [_logs(w) for w in m.weights]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = lattices(m.pieces)
        for batch in _gathered(batches):
            counts = np.stack([batch.column(f"c{i}").to_numpy(zero_copy_only=False) for i in range(n)])
            ways = np.zeros((n, batch.num_rows))
            ways[:] = -np.inf
            for rows, data in _blocks(batch.column("word")):
                arcs = found.arcs(data)
                for i in range(n):
                    ways[i, rows] = found.forward(arcs, data.shape[1], logs[i])[data.shape[1]]
            out = []
            for i in range(n):
                own, rest = np.maximum(counts[i] - DISCOUNT, 0), DISCOUNT * m.distinct[i] + 0.5
                with np.errstate(divide="ignore"):
                    p = np.logaddexp(np.log(own), math.log(rest) + ways[i])
                out.append((p - math.log(m.tokens[i] + 1)) / math.log(10))
            total = counts.sum(axis=0)
            base = np.log10((total + 1) / (m.all_tokens + m.all_distinct + 1))
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("everywhere"), pa.array((total > 0).astype(np.int64)), pa.array(base), *map(pa.array, out)], names=["word", "everywhere", "known", "base", *[f"s{i}" for i in range(n)]])

    return words.mapInArrow(step, "word string, everywhere long, known long, base double, " + ", ".join(f"s{i} double" for i in range(n)))


def _frequent(words: DataFrame, most: int) -> Column:
    """Words above a count that at most `most` words reach."""
    steps = sorted({math.ceil(1.25**j) for j in range(190)})
    row = words.agg(*[F.count_if(F.col("everywhere") >= t).alias(str(t)) for t in steps]).first()
    least = next((t for t in steps if (row[str(t)] or 0) <= most), steps[-1] + 1)
    return F.col("everywhere") >= least


def _said(docs: DataFrame, often: DataFrame, n: int) -> DataFrame:
    """Rows of two kinds: for each text h1, h2, copies = 1 and the sums over its
    words that are in `often` (HEAVY words at most); for each other word of it h1, h2
    and the word."""
    table = often.toPandas()  # HEAVY rows at most
    data = " ".join(table["word"]).encode()
    whole = _text.Slice(0, np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    hashes = whole.word_hashes(*whole.words()[:2])
    order = np.argsort(hashes)
    hashes, values = hashes[order], table.drop(columns="word").to_numpy(np.float64)[order]
    names = ["h1", "h2", "word", "copies", "n", "known", "base", *[f"s{i}" for i in range(n)]]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2 = (batch.column(c).to_numpy() for c in ("h1", "h2"))
            for part, starts, ends, own, doc in _words(batch.column("text")):
                rows = slice(part.first, part.first + part.n)
                at = np.minimum(np.searchsorted(hashes, own), max(len(hashes) - 1, 0))
                here = hashes[at] == own if len(hashes) else np.zeros(len(own), bool)
                of, hit = doc[here], values[at[here]] if len(hashes) else np.zeros((0, n + 2))
                count = np.bincount(of, minlength=part.n).astype(np.int64)
                sums = [np.bincount(of, weights=hit[:, i], minlength=part.n).astype(np.float64) for i in range(n + 2)]
                known = np.round(sums[0]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h1[rows]), pa.array(h2[rows]), pa.nulls(part.n, pa.string()), pa.array(np.ones(part.n, np.int64)), pa.array(count), pa.array(known), *map(pa.array, sums[1:])], names=names)
                rare = np.flatnonzero(~here)
                for i in range(0, len(rare), 1 << 16):
                    some = rare[i : i + (1 << 16)]
                    none = [pa.nulls(len(some), pa.int64())] * 3 + [pa.nulls(len(some), pa.float64())] * (n + 1)
                    text = part.first + doc[some]
                    yield pa.RecordBatch.from_arrays([pa.array(h1[text]), pa.array(h2[text]), _cut(part, starts[some], ends[some]), *none], names=names)

    schema = "h1 long, h2 int, word string, copies long, n long, known long, base double, " + ", ".join(f"s{i} double" for i in range(n))
    return docs.select(*keys(F.col("text")), "text").mapInArrow(step, schema)


def likelihood(docs: DataFrame, path: str, rounds: int = ROUNDS) -> DataFrame:
    """Per distinct text of `docs(text, lang, train)`: h1, h2 (hashes of 96 bits),
    n_tokens, n_known, train_tokens, base_score and score."""
    spark = docs.sparkSession
    k, documents = languages(docs)
    words, words_at = _store.written(counted(docs, k, len(documents)), "counted-words")
    m = trained(words, documents, path, rounds)
    scored, scored_at = _store.written(scored_words(words, m), "scored-words")
    _store.drop(spark, words_at)
    n = len(documents)
    often = _frequent(scored, HEAVY)
    parts, _ = _store.written(_said(docs, scored.where(often).drop("everywhere"), n), "words-of-texts")
    values = ["n", "known", "base", *[f"s{i}" for i in range(n)]]
    many = parts.where("word is null").groupBy("h1", "h2").agg(F.sum("copies").alias("copies"), *[F.sum(c).alias(c) for c in values])
    rare = parts.where("word is not null").select("h1", "h2", "word").join(scored.where(~often).drop("everywhere"), "word")
    few = rare.groupBy("h1", "h2").agg(F.lit(0).cast("long").alias("copies"), F.count("*").alias("n"), *[F.sum(c).alias(c) for c in values[1:]])
    both = many.unionByName(few).groupBy("h1", "h2").agg(*[F.sum(c).alias(c) for c in ["copies", *values]])
    # Copies of a text have met in one row; the end is a token of each.
    total, ends = m.all_tokens, sum(m.ends)
    end = [math.log10(s) + math.log10((m.ends[i] + 0.5) / (m.tokens[i] + 1)) for i, s in enumerate(m.share)]
    share = [F.lit(e) + F.col(f"s{i}") / F.col("copies") for i, e in enumerate(end)]
    most = F.greatest(*share) if n > 1 else share[0]
    score = most + F.log10(sum((F.pow(F.lit(10.0), x - most) for x in share), F.lit(0.0)))
    per = lambda c: F.floor(F.col(c) / F.col("copies") + 0.5).cast("long")
    base = F.col("base") / F.col("copies") + math.log10((ends + 1) / (total + m.all_distinct + 1))
    return both.select("h1", "h2", (per("n") + 1).alias("n_tokens"), (per("known") + int(ends > 0)).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"))


def keys(text: Column) -> list[Column]:
    """Two hashes that name a text: of ten billion texts two share both with a
    chance below one in a hundred million."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("h1"), F.hash(text).alias("h2")]


def scored(docs: DataFrame, path: str, modulus: int = 7, held: int = 2, rounds: int = ROUNDS) -> DataFrame:
    """Per row of `docs(doc_id, lang, text)`: doc_id, held_out (crc32 of the id modulo
    `modulus` is `held`; such rows are not learnt from) and what `likelihood` gives."""
    held_out = F.coalesce(_learn.remainder(F.col("doc_id"), modulus) == held, F.lit(False))
    found, _ = _store.written(likelihood(docs.select("text", "lang", (~held_out).alias("train")), path, rounds), "text-scores")
    rows = docs.select("doc_id", held_out.alias("held_out"), *keys(F.col("text")))
    return rows.join(found, ["h1", "h2"]).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with _store.arrow_bytes(spark):
        return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
