"""The lattice language model against plain Python over all segmentations."""

import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from loopwise.llm import lattice_lm as L

PATH = public_tokenizers.path("piece_bpe_32k.model")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def split(text):
    out, word = [], ""
    for ch in (text or "").translate(LOWER):
        if ch in " \t\n\x0b\x0c\r":
            out, word = out + [word] * bool(word), ""
        else:
            word += ch
    return out + [word] * bool(word)


def ways(word, pieces, at=0):
    """All segmentations of the bytes of a word into pieces."""
    if at == len(word):
        yield []
    for end in range(at + 1, len(word) + 1):
        if word[at:end] in pieces:
            for rest in ways(word, pieces, end):
                yield [word[at:end], *rest]


def plain(rows, rounds):
    """(held_out, n_tokens, n_known, N, base, score) per row, by counting and by
    adding up all segmentations."""
    names, first = L.vocabulary(PATH)
    first = dict(zip(names, first, strict=True))
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    train = [r for r in rows if not held(r[0])]
    langs = Counter(r[2] for r in train if r[2] is not None)
    top = [k for k, _ in sorted(langs.items(), key=lambda x: (-x[1], x[0]))[: L.LANGUAGES]]
    number = lambda lang: top.index(lang) if lang in top else len(top)
    n = len(top) + (any(r[2] not in top for r in train) or not top)
    docs, counts = [0] * n, [Counter() for _ in range(n)]
    for r in train:
        docs[number(r[2])] += 1
        counts[number(r[2])].update(split(r[1]))
    every = {w: list(ways(b" " + w.encode(), first)) for r in rows for w in split(r[1])}
    summed = lambda w, q: math.fsum(math.prod(q[p] for p in way) for way in every[w])
    weights = [dict(first) for _ in range(n)]
    for _ in range(rounds if train else 0):
        for k in range(n):
            new = {p: L.PRIOR * x for p, x in first.items()}
            for w in counts[k]:
                z = summed(w, weights[k])
                for way in every[w]:
                    share = math.prod(weights[k][p] for p in way) / z
                    for p in way:
                        new[p] += share
            total = math.fsum(new.values())
            weights[k] = {p: x / total for p, x in new.items()}
    tokens = [sum(c.values()) + d for c, d in zip(counts, docs, strict=True)]
    together = sum(counts, Counter())
    big_n, v = sum(tokens), len(together) + bool(train)

    def chance(k, w):
        return (max(counts[k][w] - L.DISCOUNT, 0) + (L.DISCOUNT * len(counts[k]) + 0.5) * summed(w, weights[k])) / (tokens[k] + 1)

    out = []
    for i, text, _ in rows:
        words = split(text)
        base = sum(math.log10((together[w] + 1) / (big_n + v + 1)) for w in words) + math.log10((len(train) + 1) / (big_n + v + 1))
        each = [math.log10(docs[k] / len(train) if train else 1) + math.log10((docs[k] + 0.5) / (tokens[k] + 1)) + sum(math.log10(chance(k, w)) for w in words) for k in range(n)]
        most = max(each)
        out.append((i, held(i), len(words) + 1, sum(together[w] > 0 for w in words) + bool(train), big_n, round(base, 6), round(most + math.log10(sum(10 ** (x - most) for x in each)), 6)))
    return out


def rows_of_docs():
    texts = ["The cat sat", "the CAT ran away", "ein Hund läuft", "Der Hund, der Hund!", None, "", " \n\t ", "the cat sat", "日本 the", "xqzt", "a\x0bb\x0cc\rd", "naïve été", "0123 4,5", "dog dog dog dog"]
    langs = ["en", "en", "de", "de", None, "en", None, "fr", None, "en", "de", "fr", "en", "en"]
    rows = [(i, t, x) for i, (t, x) in enumerate(zip(texts * 3, langs * 3, strict=True))]
    return rows + [(None, "the null cat", "en"), (3, "der Hund", "de"), (3, "der Hund", "de")]


def as_frame(spark, rows):
    return spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, lang string, h1 int, word string")


def found(df):
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in df.collect()), key=str)


@pytest.mark.parametrize("heavy, languages", [(200_000, 8), (3, 2)])
def test_scores_equal_all_segmentations(spark, monkeypatch, heavy, languages):
    """Words by broadcast and by shuffle, languages alone and together."""
    monkeypatch.setattr(L, "HEAVY", heavy)
    monkeypatch.setattr(L, "LANGUAGES", languages)
    rows = rows_of_docs()
    assert found(L.scored(as_frame(spark, rows), PATH, rounds=2)) == sorted(plain(rows, 2), key=str)


def test_little_to_learn_from(spark):
    empty = as_frame(spark, rows_of_docs()[:1]).limit(0)
    assert L.scored(empty, PATH, rounds=1).collect() == []
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    rows = [(held, "only held out", "en"), (held, None, None)]
    got = found(L.scored(as_frame(spark, rows), PATH, rounds=1))
    assert got == sorted(plain(rows, 1), key=str)
    assert {r[4] for r in got} == {0} and {r[5] for r in got} == {0.0}


def test_held_out_rows_teach_nothing(spark):
    rows = [(i, f"word{i % 5} and more", "en") for i in range(30)]
    held = {i for i in range(30) if zlib.crc32(str(i).encode()) % 7 == 2}
    other = [(i, "entirely different words" if i in held else t, x) for i, t, x in rows]
    mine, its = (found(L.scored(as_frame(spark, r), PATH, rounds=1)) for r in (rows, other))
    same = lambda x: [r for r in x if r[0] not in held]
    assert held and same(mine) == same(its)


def test_words_of_any_length():
    """A word of many thousand bytes goes through whole; log space holds it."""
    pieces, weights = L.vocabulary(PATH)
    lattice, logs = L.Lattices(pieces), L._logs(weights)
    long = np.frombuffer(b" " + b"tion" * 5000, np.uint8)[None, :]
    z = lattice.forward(lattice.arcs(long), long.shape[1], logs)[-1]
    assert np.isfinite(z).all() and -200_000 < z[0] < -10_000
    words = [b" station", b" xylopho", b" \xc3\xa9t\xc3\xa9\xf0\x9f"]
    known = dict(zip(pieces, weights, strict=True))
    data = np.frombuffer(b"".join(w for w in words), np.uint8).reshape(3, 8)
    arcs = lattice.arcs(data)
    z = lattice.forward(arcs, 8, logs)[-1]
    assert np.allclose(z, [math.log(sum(math.prod(known[p] for p in way) for way in ways(w, known))) for w in words])
    counts = lattice.expected(arcs, 8, logs)
    assert math.isclose(sum(c * len(p) for c, p in zip(counts, pieces, strict=True)), 24)


def test_weights_are_a_distribution():
    """Over pieces, and so over words: those that begin a word carry its blank."""
    pieces, weights = L.vocabulary(PATH)
    assert math.isclose(weights.sum(), 1) and (weights > 0).all() and len(set(pieces)) == len(pieces)
    assert all(b" " not in p[1:] for p in pieces)
    assert {bytes([i]) for i in range(256)} <= set(pieces)
