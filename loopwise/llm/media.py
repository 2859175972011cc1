"""Chroma fingerprints of audio columns, and their alignment.

A recording becomes frames of twelve pitch-class energies; sixteen rectangle
filters over the integral image of a window of frames each give two bits, so a
window is one packed 32-bit integer.  Recordings with the same integers form a
class.  Equal integers of a query and a recording vote for an offset, and the
best offset of each pair is accepted by its bit errors over the whole overlap.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loopwise.llm import _store

RATE, FRAME, HOP = 8000, 2048, 512
#: Frames that one packed integer looks at.
SPAN = 16
#: Recordings worked on at once.
SLICE = 32
#: Least votes for an offset, least overlap as a share of the shorter recording
#: and most wrong bits as a share of the overlap's.
VOTES, OVERLAP, ERRORS = 4, 0.5, 0.25

#: Filters: (first frame, frames, first pitch class, classes, kind).  Kinds: 0
#: all against nothing, 1 early against late, 2 low against high, 3 diagonal
#: quarters against the others, 4 middle third of time against the rest.
FILTERS = [((3 * i) % (4 * (i % 3) + 1), SPAN - 4 * (i % 3), (5 * i) % 9, 4 if i % 2 else 3, i % 5) for i in range(16)]
#: A filter's value falls below, between or above -CUT, 0 and CUT.
CUT = 0.25
_GRAY = np.array([0, 1, 3, 2], dtype=np.uint32)


def pcm16(column: pa.Array) -> Iterator[np.ndarray]:
    """Samples of little-endian 16-bit mono audio; null and cut-off bytes give none."""
    for value in column:
        raw = value.as_py() or b""
        yield np.frombuffer(raw[: len(raw) // 2 * 2], "<i2").astype(np.float32) / 32768


def melody(column: pa.Array, note: int = 1024) -> Iterator[np.ndarray]:
    """A recording made of numbers: each is one note of `note` samples on three
    octaves of semitones.  Null or missing numbers are silent."""
    time = np.arange(note, dtype=np.float32) / RATE
    for value in column:
        x = np.array([np.nan if v is None else v for v in (value.as_py() or [])], dtype=float)
        heard = np.isfinite(x)
        step = np.floor(np.where(heard, np.clip(x, -1e6, 1e6), 0) * 40).astype(np.int64) % 36
        tones = 0.5 * np.sin(2 * np.pi * (220 * 2 ** (step / 12))[:, None] * time[None, :]) * heard[:, None]
        yield tones.reshape(-1).astype(np.float32)


def _pitch_classes() -> np.ndarray:
    """Spectrum bins x 12: the class of each bin between 100 Hz and 2 kHz."""
    hertz = np.arange(FRAME // 2 + 1) * RATE / FRAME
    out = np.zeros((len(hertz), 12), dtype=np.float32)
    used = np.flatnonzero((hertz >= 100) & (hertz <= 2000))
    out[used, np.round(12 * np.log2(hertz[used] / 440)).astype(int) % 12] = 1
    return out


def chroma(samples: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """Frames x 12 energies of unit length; silent frames are 0."""
    if len(samples) < FRAME:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    out = np.empty((len(frames), 12))
    window = np.hanning(FRAME).astype(np.float32)
    for at in range(0, len(frames), 512):
        spectrum = np.abs(np.fft.rfft(frames[at : at + 512] * window, axis=1)) ** 2
        out[at : at + 512] = spectrum.astype(np.float32) @ fold
    norm = np.sqrt((out**2).sum(axis=1, keepdims=True))
    return np.where(norm > 1e-3, out / np.maximum(norm, 1e-3), 0)


def packed(frames: np.ndarray) -> np.ndarray:
    """One unsigned 32-bit integer for each run of SPAN frames."""
    n = len(frames) - SPAN + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    image = np.zeros((len(frames) + 1, 13))
    image[1:, 1:] = frames.cumsum(axis=0).cumsum(axis=1)
    at = np.arange(n)

    def box(t: int, dt: int, c: int, dc: int) -> np.ndarray:
        a, b = at + t, at + t + dt
        return image[b, c + dc] - image[a, c + dc] - image[b, c] + image[a, c]

    out = np.zeros(n, dtype=np.uint32)
    for k, (t, dt, c, dc, kind) in enumerate(FILTERS):
        whole, half_t, half_c = box(t, dt, c, dc), dt // 2, dc // 2
        if kind == 0:
            up, down = whole, np.full(n, dt * dc / 12)
        elif kind == 1:
            up, down = box(t, half_t, c, dc), box(t + half_t, half_t, c, dc)
        elif kind == 2:
            up, down = box(t, dt, c, half_c), box(t, dt, c + half_c, half_c)
        elif kind == 3:
            up = box(t, half_t, c, half_c) + box(t + half_t, half_t, c + half_c, half_c)
            down = box(t + half_t, half_t, c, half_c) + box(t, half_t, c + half_c, half_c)
        else:
            third = dt // 3
            up = box(t + third, third, c, dc)
            down = (whole - up) / 2
        value = np.log((1 + np.maximum(up, 0)) / (1 + np.maximum(down, 0)))
        level = (value > -CUT).astype(int) + (value > 0) + (value > CUT)
        out |= _GRAY[level] << np.uint32(2 * k)
    return out.astype(np.int64)


def fingerprints(recordings: DataFrame, id: str, media: str, decode: Callable[[pa.Array], Iterator[np.ndarray]] = pcm16) -> DataFrame:
    """Per row: rec_id and prints (packed integers, one per hop of time).

    `decode` turns a slice of the media column into samples at RATE.  Null,
    empty or too short media give no prints; a very long recording is one row of
    prints, four bytes for each hop; repeated rows give equal prints; columns
    beside the two are not read, whatever their names; an empty table gives an
    empty result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = _pitch_classes()
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE):
                part = batch.slice(first, SLICE)
                lists = [packed(chroma(x, fold)) for x in decode(part.column(1))]
                ends = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
                flat = np.concatenate(lists) if lists else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))], names=["rec_id", "prints"])

    rows = recordings.select(F.col(id).cast("long").alias("rec_id"), F.col(media).alias("media"))
    return rows.mapInArrow(run, "rec_id long, prints array<long>")


def wrong_bits(a, b, offset):
    """Columns: wrong bits and length of the overlap of prints `a` with `b` when
    b starts `offset` places into a."""
    start_a, start_b = F.greatest(offset, F.lit(0)), F.greatest(-offset, F.lit(0))
    n = F.least(F.size(a) - start_a, F.size(b) - start_b)
    pairs = F.zip_with(F.slice(a, start_a + 1, n), F.slice(b, start_b + 1, n), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(pairs, F.lit(0), lambda s, x: s + x), n


def aligned(prints: DataFrame, wanted, votes: int = VOTES, overlap: float = OVERLAP, errors: float = ERRORS) -> tuple[DataFrame, DataFrame]:
    """(members, pairs) of `prints(rec_id, prints)`.

    members: rec_id, n_prints and class_id (the smallest rec_id with the same
    prints; without prints or id, its own id).  pairs: query, class_id, offset
    (places by which the recording starts after the query; negative: before),
    votes, bit_error, for every two different classes of which the query holds a
    row that `wanted` (a condition on rec_id) selects; one row for each pair that
    passes, at the offset with the fewest wrong bits among those with enough votes
    (ties: more votes, then the smallest).  Only equal integers propose pairs, one
    vote for each run of an integer in either recording; nothing is capped.

    Rows that repeat an id are recordings like others; an empty table gives empty
    results."""
    key = F.xxhash64("prints")
    some = prints.where("size(prints) > 0 and rec_id is not null")
    classes = some.groupBy(key.alias("k"), "prints").agg(F.min("rec_id").alias("class_id"), F.max(wanted.cast("int")).alias("asked"))
    classes, _ = _store.written(classes, "classes")
    posts = classes.select("class_id", "asked", F.posexplode("prints").alias("at", "v"))
    # Of a run of one integer in one recording the first place votes.
    before = F.lag("v").over(Window.partitionBy("class_id").orderBy("at"))
    posts = posts.withColumn("before", before).where("before is null or before <> v").drop("before")
    queries = posts.where("asked = 1").select(F.col("class_id").alias("query"), "v", F.col("at").alias("q_at"))
    found = queries.join(posts.select("class_id", "v", "at"), "v").where("query <> class_id")
    cast = found.groupBy("query", "class_id", (F.col("q_at") - F.col("at")).alias("offset")).agg(F.count("*").alias("votes"))
    some = cast.where(F.col("votes") >= votes)
    both = some.join(classes.select(F.col("class_id").alias("query"), F.col("prints").alias("a")), "query").join(classes.select("class_id", F.col("prints").alias("b")), "class_id")
    wrong, n = wrong_bits(F.col("a"), F.col("b"), F.col("offset"))
    both = both.withColumn("n", n).where(F.col("n") >= F.least(F.size("a"), F.size("b")) * overlap).withColumn("bit_error", wrong / (F.col("n") * 32)).where(F.col("bit_error") <= errors)
    best = F.min_by(F.struct("offset", "votes", "bit_error"), F.struct("bit_error", -F.col("votes"), "offset")).alias("s")
    pairs = both.groupBy("query", "class_id").agg(best).select("query", "class_id", "s.*")
    low = classes.select(F.col("k").alias("k2"), F.col("prints").alias("p2"), "class_id")
    members = prints.withColumn("k", key).join(low, (F.col("k") == F.col("k2")) & (F.col("prints") == F.col("p2")), "left")
    members = members.select("rec_id", F.coalesce(F.size("prints"), F.lit(0)).cast("long").alias("n_prints"), F.coalesce("class_id", "rec_id").alias("class_id"))
    return members, pairs.select("query", "class_id", "offset", "votes", "bit_error")


def op2(spark, sf_dir: str) -> DataFrame:
    """Every vector of `embeddings`, played as a melody, is a recording; those
    whose id is divisible by 100 are queries against all.  One row per
    recording: its class, how many query classes align with it and the best."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    prints, _ = _store.written(fingerprints(rows, "vec_id", "embedding", melody), "prints")
    members, pairs = aligned(prints, F.col("rec_id") % 100 == 0)
    best = pairs.groupBy("class_id").agg(F.count("*").alias("n_aligned"), F.min(F.struct("bit_error", "query", "offset")).alias("best"))
    out = members.join(best, "class_id", "left")
    return out.select(F.col("rec_id").alias("vec_id"), "n_prints", "class_id", F.coalesce("n_aligned", F.lit(0)).cast("long").alias("n_aligned"), F.col("best.query").alias("best_query"), F.col("best.offset").cast("long").alias("offset"), F.col("best.bit_error").alias("bit_error"))
