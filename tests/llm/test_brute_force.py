"""Operators and their queries against plain Python on small tables."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from loopwise.llm import _text, decontam, langid, media, mixing, neardup, pii, quality, token_files, toxicity
from tests.llm.test_operators import DOCS, odd_rows

WORDS = [f"w{i}" for i in range(400)]


def family(rng, n, base, edits):
    """A text and copies of it with so many words replaced."""
    return [" ".join(base)] + [" ".join(w if i not in at else f"e{rng.integers(1 << 40)}" for i, w in enumerate(base)) for at in (set(rng.integers(0, len(base), rng.integers(0, edits)).tolist()) for _ in range(n - 1))]


def components(texts, size, percent):
    sets = {}
    for i, t in texts:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[j : j + size]) for j in range(max(1, len(w) - size + 1))} if w else set()
    low = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    for _ in sets:
        before = dict(low)
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
        if low == before:
            break
    return sets, low


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_of_many_edits(spark, seed):
    """Families about the threshold, a passage in a third of all texts, long sets."""
    rng = np.random.default_rng(seed)
    texts = []
    for length, n, edits in ((60, 40, 9), (120, 30, 14), (900, 12, 90), (8, 10, 2)):
        texts += family(rng, n, [WORDS[x] for x in rng.integers(0, 400, length)], edits)
    passage = " ".join(WORDS[x] for x in rng.integers(0, 400, 40))
    texts += [passage + " " + " ".join(WORDS[x] for x in rng.integers(0, 400, rng.integers(3, 60))) for _ in range(40)]
    rows = list(enumerate(texts))
    sets, low = components(rows, 4, 80)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=4).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(i, len(s), low[i]) for i, s in sets.items()}


def test_last_comparison_finds_all(spark):
    """Every pair across components, from whole sets alone."""
    rng = np.random.default_rng(5)
    rows = list(enumerate(family(rng, 60, [WORDS[x] for x in rng.integers(0, 400, 80)], 10)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = neardup.sketches(docs, 4, 64).select(F.col("doc_id").alias("node"), "doc_id", "set_hi")
    sets = neardup.full_sets(docs, marks, 4)
    likely, _ = neardup._open_pairs(sets, marks.select("node", F.col("node").alias("component")), 80)
    got = {(r.a, r.b) for r in neardup._verified(likely, sets, 80).collect()}
    plain, _ = components(rows, 4, 80)
    assert got == {(a, b) for a in plain for b in plain if a < b and 100 * len(plain[a] & plain[b]) >= 80 * len(plain[a] | plain[b])}


def contaminated(docs, items):
    words = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for item, text in items:
            b = words(text)
            n = min(13, len(b))
            windows = {tuple(b[j : j + n]) for j in range(len(b) - n + 1)} if n else set()
            for j in range(len(w) - n + 1 if n else 0):
                if tuple(w[j : j + n]) in windows:
                    hit.update(range(j, j + n))
                    found.add(item)
        out.append((i, len(w), len(hit), tuple(sorted(found))))
    return Counter(out)


@pytest.mark.parametrize("broadcast", [True, False])
def test_contamination_by_items_of_all_lengths(spark, broadcast):
    rng = np.random.default_rng(3)
    few = ["a", "b", "c", "dé", "e1"]
    text = lambda n, of=few: " ".join(of[x] for x in rng.integers(0, len(of), n))
    items = [(n, text(n)) for n in range(1, 20)] + [(30, " ".join(WORDS[:40])), (31, None), (32, "!!"), (33, "a a a a a a a a a a a a a a a")]
    docs = [(i, text(int(n))) for i, n in enumerate(rng.integers(0, 90, 25))] + [(50, " ".join(WORDS[5:30]) + " x " + " ".join(WORDS[10:23])), (51, None), (51, "a"), (None, "a " * 300), (52, "A-B.c"), (52, "A-B.c")]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), decontam._store.small
    try:
        if not broadcast:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
            decontam._store.small = lambda df, rows=0: df
        got = decontam.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before[0])
        decontam._store.small = before[1]
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in got) == contaminated(docs, items)


def test_kept_fingerprints_are_where_the_minimum_changes(spark):
    w = [f"w{i % 17}" for i in range(60)]
    rows = spark.createDataFrame([(w,)], "w array<string>").withColumn("h", decontam._word_hashes(F.col("w"))).withColumn("g6", decontam._grams(F.col("h"), 6))
    rows, name = decontam._kept(rows, 13)
    r = rows.select("g6", name).first()
    lows = [min(r.g6[i : i + 8]) for i in range(48)]
    want = [(i, lows[i]) for i in range(48) if i == 0 or lows[i] != lows[i - 1]]
    assert [(x.at, x.f) for x in r[name]] == want and [x.end for x in r[name]] == [i for i, _ in want[1:]] + [48] and len(want) < 30


def test_quotas_are_split_without_loss():
    quotas = [100, 37, 0, 5]
    out = mixing.split_quotas(quotas, 7, 1)
    assert (out[0] == 0).all() and (out[-1] == quotas).all() and (np.diff(out, axis=0) >= 0).all()
    sizes = np.diff(out, axis=0).sum(axis=1)
    assert sizes.max() - sizes.min() <= 7 and (mixing.split_quotas(quotas, 7, 1) == out).all()
    # Marginals of the first of two shards: hypergeometric, with these moments.
    draws = np.array([mixing.split_quotas(quotas, 2, seed)[1] for seed in range(2000)])
    mean = np.array(quotas) * 71 / 142
    spread = np.sqrt(71 * np.array(quotas) / 142 * (1 - np.array(quotas) / 142) * 71 / 141)
    assert (draws.sum(axis=1) == 71).all() and (np.abs(draws.mean(axis=0) - mean) <= 5 * spread / np.sqrt(2000) + 1e-9).all()
    assert np.allclose(draws.std(axis=0), spread, rtol=0.1, atol=1e-9)


def table(spark, tmp_path, docs, schema="doc_id long, text string, source string, lang string", **more):
    spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/documents.parquet")
    for name, (rows, columns) in more.items():
        spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_mix_query_against_its_contract(spark, tmp_path):
    rng = np.random.default_rng(2)
    docs = [(i, "w " * int(rng.integers(0, 90)), [None, "s0", "s1", "s2", "s3"][min(4, int(rng.integers(0, 9)))], "en") for i in range(1500)] + [(7, "w w", "s0", "en"), (7, "w w", "s0", "en"), (None, "", "s9", None), (2000, None, "s9", None)]
    d = table(spark, tmp_path, docs)
    got = mixing.op1(spark, d).collect()
    sizes = Counter()
    for _, t, s, _ in docs:
        sizes[s] += len((t or "").split())
    # Targets by plain repetition: shares by weight, those above the cap held there.
    names = [*sorted(s for s in sizes if s), None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, held = {}, set()
    while True:
        rest = sum(sizes.values()) - sum(target[s] for s in held)
        target |= {s: rest * weight[s] / sum(weight[x] for x in names if x not in held) for s in names if s not in held}
        over = {s for s in names if s not in held and target[s] > 3 * sizes[s]}
        if not over:
            break
        target |= {s: 3 * sizes[s] for s in over}
        held |= over
    assert len(got) == len(docs) and Counter((r.doc_id, r.source, r["size"]) for r in got) == Counter((i, s, len((t or "").split())) for i, t, s, _ in docs)
    assert all(r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source]) for r in got)
    assert all(r.taken == r["size"] * len(r.shards) <= 3 * r["size"] for r in got if r["size"])
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 45 for s in sizes)
    assert Counter(map(str, mixing.op1(spark, d).collect())) == Counter(map(str, got))


def test_shards_hold_their_draws(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 40), f"s{i % 5}", "a", 1, 2) for i in range(3000)], "doc_id long, text string, source string, row string, __size int, __shard int")
    mixed = mixing.mix(docs, shards=6)
    sized = mixing.sized_documents(docs)
    drawn = Counter()
    for r in mixing.copies(sized, mixing.plan(sized, shards=6)).collect():
        drawn.update((r.doc_id, c.shard) for c in r.copies)
    assert Counter((r.doc_id, r["__shard"]) for r in mixed.collect()) == drawn and mixed.columns == docs.columns
    places = mixed.select("__shard", F.spark_partition_id().alias("p")).distinct().collect()
    assert len(places) == len({r.p for r in places}) == 6
    words = mixed.groupBy("__shard").agg(F.sum(mixing.word_count("text")).alias("n")).collect()
    assert max(r.n for r in words) < 1.5 * min(r.n for r in words)


def test_statistics_and_scores_equal_plain_ones(spark, tmp_path):
    texts = [t for _, t, *_ in odd_rows()] + ["One, two. Two!\nThree 3\n\nThree 3", "A B " * 300 + "\n", "$$ ## x"]
    got = quality.statistics(pa.array(texts, pa.string()))
    for t, row in zip(texts, got, strict=True):
        b = (t or "").encode()
        low = bytes(c + 32 if 65 <= c <= 90 else c for c in b)
        w, lines = low.split(), [x for x in low.split(b"\n") if x]
        share = lambda n, m: n / max(m, 1)
        letters = sum(chr(c).isalpha() and c < 128 or c >= 128 for c in b)
        sizes = [len(x) for x in w]
        triples = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        stop = b".,;:?'\"-()"
        want = [
            np.log1p(len(w)), np.log1p(np.mean(sizes) if w else 0), np.log1p(np.std(sizes) if w else 0),
            np.sqrt(share(sum(65 <= c <= 90 for c in b), letters)), np.sqrt(share(sum(48 <= c <= 57 for c in b), len(b))), np.sqrt(share(sum(c in stop for c in b), len(b))),
            np.sqrt(share(sum(33 <= c < 127 and not chr(c).isalnum() and c not in stop for c in b), len(b))), np.log1p(share(len(lines), len(w)) * 100),
            np.log1p(len(set(w)) / np.sqrt(len(w)) if w else 0), np.sqrt(1 - len(set(triples)) / len(triples) if len(w) > 3 else 0),
            np.sqrt(1 - len(set(lines)) / len(lines) if lines else 0), np.sqrt(max(Counter(w).values()) / len(w) if w else 0),
        ]
        assert row == pytest.approx(want, abs=1e-6)
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(300, 12)) * 2, (np.arange(300) % 3 > 0).astype(int)
    x[y == 1] += 1
    model = quality.fit(x, y)
    z = np.clip((x - x.mean(0)) / x.std(0), -8, 8)
    pooled = sum(np.cov(z[y == k].T, bias=True) * (y == k).sum() for k in (0, 1)) / 300
    log = []
    for k in (0, 1):
        g = z[y == k]
        own = np.cov(g.T, bias=True)
        c = (1 - quality.TO_POOLED - quality.TO_IDENTITY) * own + quality.TO_POOLED * pooled + quality.TO_IDENTITY * np.trace(own) / 12 * np.eye(12) + 1e-4 * np.eye(12)
        d = z - g.mean(0)
        log.append(np.log(len(g) / 300) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d))
    assert model.scores(x) == pytest.approx(1 / (1 + np.exp(log[0] - log[1])), abs=1e-9)


def test_quality_query_never_sees_held_out_labels(spark, tmp_path):
    rng = np.random.default_rng(4)
    good = lambda: " ".join(rng.choice(["the", "house", "stands", "near", "river,", "and", "people", "walk."], 40))
    bad = lambda: " ".join(rng.choice(["$$$", "###", "buy"], 30))
    docs = [(i, good() if i % 2 else bad(), "s", "en") for i in range(200)]
    held = {i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0}
    # Labels of held-out rows are wrong: they must have no effect.
    labels = [(i, (i % 2) ^ (i in held), 0) for i in range(200)]
    got = quality.op4(spark, table(spark, tmp_path, docs, labels=(labels, "doc_id long, quality int, toxic int"))).collect()
    assert {r.doc_id for r in got if r.held_out} == held and all(r.predicted == r.doc_id % 2 == (r.score >= 0.3) for r in got)


def plain_language(text, model):
    """Words, one Viterbi over all of them, bytes by language."""
    words, scores, rows = [], [], model.rows()
    for m in re.finditer(rb"[A-Za-z\x80-\xff]+", (text or "").encode()):
        if not any(c.isalpha() for c in m[0].decode("utf-8", "ignore")):
            continue
        raw = np.frombuffer(m[0], np.uint8)
        codes = [0, *langid._CLASS[raw].tolist(), 0]
        own = sum(model.logs[rows[(a << 12) | (b << 6) | c]].astype(float) for a, b, c in zip(codes, codes[1:], codes[2:], strict=False))
        own = np.where(model.allowed[langid._SCRIPT[raw[0]]], own, own - 1000)
        words.append(m[0])
        scores.append(own - own.max())
    if not words:
        return "und", 0.0
    best, back = scores[0], []
    for s in scores[1:]:
        top = int(best.argmax())
        back.append(np.where(best >= best[top] - langid.SWITCH, np.arange(len(best)), top))
        best = np.maximum(best, best[top] - langid.SWITCH) + s
    label = [int(best.argmax())]
    for b in reversed(back):
        label.append(int(b[label[-1]]))
    total = Counter()
    for lang, w in zip(reversed(label), words, strict=True):
        total[model.langs[lang]] += len(w)
    n, lang = max((n, lang) for lang, n in total.items())
    return lang, n / sum(total.values())


@pytest.mark.parametrize("k", [4, 200])
def test_languages_equal_a_plain_viterbi(spark, k):
    rng = np.random.default_rng(6)
    tongue = {f"l{i:03d}": ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 4)) for _ in range(5)] for i in range(k)}
    rows = [(i * 3 + j, " ".join(rng.choice(tongue[lang], 30)), lang) for i, lang in enumerate(tongue) for j in range(3)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), held_out=None)
    assert len(model.langs) == k
    names = list(tongue)
    texts = [" ".join(" ".join(rng.choice(tongue[names[x]], int(n))) for x, n in zip(rng.integers(0, k, 3), rng.integers(1, 200, 3), strict=True)) for _ in range(20)]
    texts += [None, "", "12", "— “”", "Ünï çöd", "кириллица abcd"]
    got = langid.identified(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        lang, score = plain_language(t, model)
        assert (r["__found"].lang, r["__found"].score) == (lang, pytest.approx(score))


def test_language_query_learns_only_from_its_part(spark, tmp_path):
    out = {i for i in range(120) if zlib.crc32(str(i).encode()) % 4 == 2}
    say = {"en": "the house and the garden are old", "de": "das haus und der garten sind alt"}
    rows = [(i, say["en" if i % 2 else "de"], "s", "xx" if i in out else ("en" if i % 2 else "de")) for i in range(120)]
    got = langid.op10(spark, table(spark, tmp_path, rows + [(None, None, None, None)])).collect()
    assert {r.doc_id for r in got if r.held_out} == out and all(r.lang_pred == ("und" if r.doc_id is None else "en" if r.doc_id % 2 else "de") for r in got)


def test_severity_equals_plain_sums(spark):
    rows = [(i, f"hello friend number {'abcdefgh'[i % 8]} nice day", 0) for i in range(80)] + [(80 + i, f"hello vile scum number {'abcdefgh'[i % 8]}", 1) for i in range(40)] + [(120 + i, "vile scum awful murder", 2) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df.drop("toxic"), df.select("doc_id", "toxic"))
    weight = dict(zip(model.buckets.tolist(), model.weights.tolist(), strict=True))

    def plain(text):
        x = 0.0
        for w in {m[0] for m in re.finditer(rb"[a-z\x80-\xff]+", (text or "").lower().encode())}:
            part = next(_text.slices(pa.array([w.decode()])))
            x += weight.get(int(part.word_hashes(np.array([0]), np.array([len(w)]))[0] % np.uint64(toxicity.BUCKETS)), 0.0)
        return sum(1 / (1 + np.exp(t - x)) for t in model.thresholds)

    texts = [t for _, t, _ in rows[::15]] + [None, "", "vile vile vile", "Friend, SCUM!"]
    got = toxicity.graded(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model, into="s", grade="g").orderBy("doc_id").collect()
    assert [r.s for r in got] == pytest.approx([plain(t) for t in texts]) and [r.g for r in got] == [int(np.floor(r.s + 0.5)) for r in got]


def test_rewritten_texts_equal_plain_replacement(spark):
    key = hashlib.blake2b(b"k", digest_size=32).digest()
    kinds = {"ssn": "123-45-6789", "ipv4": "10.0.0.7", "date": "2024-02-29", "card": "4111 1111 1111 1111", "email": "Jo.Doe7@example.com", "phone": "+49 30 1234567", "secret": "0123456789abcdef" * 20}
    rows, want = [], []
    for i, order in enumerate((list(kinds), list(reversed(kinds)), ["ssn"] * 3, [])):
        rows.append((i, "é " + " and ".join(kinds[k] for k in order)))
        want.append("é " + " and ".join(pii.pseudonym(k, kinds[k], key) for k in order))
    rows += [(9, "not 999.1.1.1, 2024-02-31, 000-12-3456, 4111111111111112, +0 30 1234567, " + "0" * 40), (10, "")]
    want += [rows[-2][1], ""]
    got = pii.pseudonymised(spark.createDataFrame(rows, "doc_id long, text string"), "k").orderBy("doc_id").collect()
    assert [r.text for r in got] == want
    assert all(r.text[s.start : s.end] in r.text and len(r["__spans"]) == n for r, n in zip(got, (7, 7, 3, 0, 0, 0), strict=True) for s in r["__spans"])


def test_alignments_equal_plain_ones(spark):
    rng = np.random.default_rng(8)
    base = [rng.integers(0, 1 << 31, 60) for _ in range(4)]
    prints = [*base, base[0][10:], np.concatenate([base[1], base[1][:20]]), base[2] ^ (1 << rng.integers(0, 31, 60)), np.full(40, 7), np.concatenate([np.full(20, 7), base[3][:30]]), base[0]]
    rows = [(i, [int(x) for x in p]) for i, p in enumerate(prints)] + [(20, []), (None, [1, 2])]
    _, pairs = media.aligned(spark.createDataFrame(rows, "rec_id long, prints array<long>"), F.col("rec_id") < 4)
    starts = lambda p: [(i, x) for i, x in enumerate(p) if i == 0 or p[i - 1] != x]
    want, reps = {}, {i: p for i, p in enumerate(prints) if i != 9}
    for q in range(4):
        for c, p in reps.items():
            if c == q:
                continue
            votes = Counter(i - j for i, x in starts(reps[q]) for j, y in starts(p) if x == y)
            for off, n in votes.items():
                a, b = reps[q][max(off, 0) :], p[max(-off, 0) :]
                m = min(len(a), len(b))
                bad = sum(bin(int(x) ^ int(y)).count("1") for x, y in zip(a[:m], b[:m], strict=True)) / (32 * m) if m else 1
                if n >= media.VOTES and m >= media.OVERLAP * min(len(reps[q]), len(p)) and bad <= media.ERRORS:
                    want[q, c] = min(want.get((q, c), (9,)), (bad, -n, off))
    assert {(r["query"], r.class_id): (pytest.approx(r.bit_error), -r.votes, r.offset) for r in pairs.collect()} == want and (0, 4) in want


@pytest.mark.parametrize(("noise", "least"), [(0.0, 10), (0.05, 9)])
def test_recordings_are_found_in_noise(spark, noise, least):
    """Ten tunes of twelve seconds against copies that start later, with noise."""
    rng = np.random.default_rng(9)
    tunes = [next(media.melody(pa.array([rng.normal(size=96).tolist()]))) for _ in range(10)]
    pcm = lambda x: (np.clip(x, -1, 1) * 30000).astype("<i2").tobytes()
    rows = [(i, pcm(t)) for i, t in enumerate(tunes)] + [(100 + i, pcm(t[5 * media.HOP :] + rng.normal(size=len(t) - 5 * media.HOP) * noise)) for i, t in enumerate(tunes)]
    prints = media.fingerprints(spark.createDataFrame(rows, "id long, audio binary"), "id", "audio")
    _, pairs = media.aligned(prints, F.col("rec_id") < 10)
    found = {(r["query"], r.class_id) for r in pairs.collect()}
    assert sum((i, 100 + i) in found for i in range(10)) >= least and all(b in (a, a + 100) for a, b in found)


def test_token_files_have_their_encodings_and_indexes(spark, tmp_path):
    path = f"{tmp_path}/tokens"
    docs = spark.createDataFrame([r for r in odd_rows()] + [(None, "lost", None, None, None, None), (None, None, None, None, None, None)], DOCS)
    token_files.write_tokens(docs, "file://" + path, token_files.vocabulary(), partitions=2)
    import glob

    for f in glob.glob(path + "/part-*"):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            kinds = {meta.row_group(g).column(i).path_in_schema: meta.row_group(g).column(i) for i in range(meta.row_group(g).num_columns)}
            assert all("DELTA_BINARY_PACKED" in kinds[c].encodings for c in ("doc_id", "n_tokens", "local_start"))
            assert any("RLE_DICTIONARY" in c.encodings for n, c in kinds.items() if n.startswith("ids")) and all(c.has_column_index and c.has_offset_index for c in kinds.values())
    got = token_files.read_tokens(spark, "file://" + path).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted([r[0] for r in odd_rows()] + [None, None], key=lambda x: (x is not None, x or 0)) and [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    assert token_files.read_tokens(spark, "file://" + path, ids=False).columns == ["doc_id", "start", "n_tokens"]


def test_capital_with_a_mark_before_punctuation():
    from tokenizers import Tokenizer

    path = token_files.vocabulary()
    t, encode = Tokenizer.from_file(path), token_files._Encoder(path, 2)
    texts = ["İ- İ", "aİ!? x", "ß-ﬁ, İİ."]
    assert [np.frombuffer(c, "<u4").tolist() for c in encode([x.encode() for x in texts])] == [[*t.encode(x, add_special_tokens=False).ids, 2] for x in texts]


def test_columns_of_any_name_stay(spark):
    """Names that the operators use inside."""
    names = ["doc_id", "text", "source", "__score", "__severity", "__grade", "__spans", "__found", "__top", "__hash", "__size", "copies", "row", "found", "rows"]
    df = spark.createDataFrame([(i, "the 123-45-6789 day " * (i % 4), "s", *["u"] * 12) for i in range(30)], ", ".join(f"`{n}` {'long' if n == 'doc_id' else 'string'}" for n in names))
    rows = df.select("doc_id", "text")
    labels = rows.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), (F.col("doc_id") % 2).cast("int").alias("toxic"))
    outs = [
        (quality.scored(df, quality.train(rows, labels), into="x"), ["x"]),
        (toxicity.graded(df, toxicity.train(rows, labels), into="x", grade="y"), ["x", "y"]),
        (pii.pseudonymised(df, "k", into="x"), ["x"]),
        (langid.identified(df, langid.train(rows.withColumn("lang", F.lit("en"))), into="x"), ["x"]),
        (mixing.mix(df, into="x"), ["x"]),
    ]
    for out, more in outs:
        assert out.columns == [*names, *more] and {r["__hash"] for r in out.collect()} == {"u"}
    assert neardup.near_duplicates(df).count() == 30 and decontam.contamination(df, spark.createDataFrame([(1, "the day", "x")], "item_id long, text string, w string")).count() == 30
