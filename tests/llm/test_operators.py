"""The training-data operators against brute force, with odd rows."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loopwise.llm import chat, decontam, langid, media, mixing, neardup, pii, quality, token_files, toxicity

DOCS = "doc_id long, text string, source string, lang string, quality int, row string"
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))


def odd_rows():
    """Null and empty texts, one very long, ties, repeated rows, clashing names."""
    base = " ".join(f"alpha{i} beta" for i in range(40))
    texts = [None, "", " \t\n", "one", "one two", base, base, base + " gamma", base.upper(), LONG, LONG + " end", "héllo wörld çava", "!!! 123"]
    return [(i, t, None if i % 4 == 0 else f"s{i % 3}", "en" if i % 2 else None, None, "x") for i, t in enumerate(texts)] + [(6, base, "s0", "en", None, "x")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_near_duplicates(spark, docs, empty):
    sets = {}
    for i, t, *_ in odd_rows():
        w = (t or "").lower().split()
        sets[i] = {tuple(w[j : j + 4]) for j in range(max(1, len(w) - 3))} if w else set()
    low = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    low[a] = low[b] = min(low[a], low[b])
    got = neardup.near_duplicates(docs, size=4).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == {(i, len(s), low[i], low[i] == i) for i, s in sets.items()}
    assert len(got) == len(odd_rows()) and neardup.near_duplicates(empty).count() == 0


def test_components_equal_brute_force(spark):
    chance = np.random.default_rng(7)
    edges = [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(180, 260)] + [(3, 3), (5, 4), (4, 5), (4, 5)]
    edges += [tuple(map(int, x)) for x in chance.integers(300, 400, (70, 2))]
    low = {v: v for e in edges for v in e}
    for _ in low:
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    table = spark.createDataFrame(edges, "a long, b long")
    got = [tuple(r) for r in neardup.components(table)[0].collect()]
    assert sorted(got) == sorted((v, c) for v, c in low.items() if v != c)
    assert neardup.components(table.limit(0))[0].isEmpty()


def test_contamination(spark, docs, empty):
    items = spark.createDataFrame([(1, " ".join(f"alpha{i} beta" for i in range(9))), (2, "one two"), (3, None), (4, "..."), (1, "one two")], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontam.contamination(docs, items).collect()}
    assert got[4] == (2, 2, 2, True) and got[5] == (80, 18, 1, True) and got[0] == got[1] == (0, 0, 0, False) and got[3] == (1, 0, 0, False)
    assert decontam.contamination(docs, items).count() == len(odd_rows())
    assert decontam.contamination(docs, items.limit(0)).where("n_hit > 0").count() == 0 and decontam.contamination(empty, items).count() == 0


def test_mixture_takes_near_the_target(spark):
    rows = [(i, "w " * (1 + i % 50), f"s{i % 4}" if i % 5 else None) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sized = mixing.sized_documents(df)
    got = mixing.copies(sized, mixing.plan(sized, shards=5)).select("source", "size", "target", (F.col("size") * F.size("copies")).alias("taken"))
    per = got.groupBy("source").agg(F.max("target").alias("t"), F.sum("taken").alias("n")).collect()
    assert all(abs(r.n - r.t) <= max(50, 0.001 * r.t) for r in per)
    assert got.where("taken > 3 * size").isEmpty()
    first = mixing.mix(df).collect()
    assert sum(len(r.text.split()) for r in first) == sum(r.n for r in per) and Counter(first) == Counter(mixing.mix(df).collect())


def test_targets_are_capped():
    assert mixing.capped_targets({"a": 10, "b": 1000, None: 1000}) == {"a": 30.0, "b": pytest.approx(1980 * 2 / 3), None: pytest.approx(1980 / 3)}


def test_mixture_of_odd_rows(docs, empty):
    assert set(mixing.mix(docs).columns) == {*docs.columns, "__shard"}
    assert mixing.mix(docs).count() > 0 and mixing.mix(empty).count() == 0


def test_token_files_round_trip(spark, docs, empty, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_files.vocabulary())
    want, start = {}, 0
    path = f"file://{tmp_path}/tokens"
    one_each = docs.dropDuplicates(["doc_id"])
    token_files.write_tokens(one_each, path, token_files.vocabulary(), partitions=3)
    for i, text in sorted({r[0]: r[1] for r in odd_rows()}.items()):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.checksums(token_files.read_tokens(spark, path)).collect()}
    assert got == want
    assert [r.doc_id for r in token_files.tokens_of(spark, path, 3, 4).orderBy("doc_id").collect()] == [3, 4]
    token_files.write_tokens(empty, path + "0", token_files.vocabulary())
    assert token_files.read_tokens(spark, path + "0").count() == 0


def test_quality_learns_and_scores_all(spark, docs, empty):
    good = [(i, f"The house number stands there, and people {i} walk by. It was a long day." * (1 + i % 3), 1) for i in range(60)]
    bad = [(i, "$$$ ### buy buy buy %%% @@@ " * (1 + i % 5), 0) for i in range(60, 120)]
    rows = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    model = quality.train(rows.drop("quality"), rows.select("doc_id", "quality"), held_out=None)
    got = {r.doc_id: r["__score"] for r in quality.scored(rows, model).collect()}
    assert all(got[i] > 0.5 for i in range(60)) and all(got[i] < 0.5 for i in range(60, 120))
    assert quality.scored(docs, model).where("__score between 0 and 1").count() == len(odd_rows()) and quality.scored(empty, model).count() == 0
    assert quality.train(docs, rows.limit(0).select("doc_id", "quality")).scores(np.zeros((1, 12))) == [1.0]


def test_language_spans(spark, docs, empty):
    rows = [(i, "the house and the garden are old", "en") for i in range(20)] + [(20 + i, "das haus und der garten sind schön", "de") for i in range(20)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), held_out=None)
    text = "the house and the garden are old " * 4 + "das haus und der garten sind schön " * 3
    r = langid.identified(spark.createDataFrame([(1, text), (2, None), (3, "12 ?!")], "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [x["__found"].lang for x in r] == ["en", "und", "und"] and [(s.start, s.end, s.lang) for s in r[0]["__found"].spans] == [(0, 28, "en"), (28, 49, "de")]
    assert langid.identified(docs, model).count() == len(odd_rows()) and langid.identified(empty, model).count() == 0
    assert {x["__found"].lang for x in langid.identified(docs, langid.train(empty)).collect()} == {"und"}


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(1)
    scores = rng.normal(size=(700, 3)) * 4
    first = np.array([0, 300, 300, 700])
    labels = langid.viterbi(scores, first, 5.0)
    value = lambda x, a: sum(scores[a + i, s] for i, s in enumerate(x)) - 5.0 * (np.diff(x) != 0).sum()
    for a, b in ((0, 300), (300, 700)):
        best = scores[a].copy()
        for i in range(a + 1, b):
            best = np.maximum(best, best.max() - 5.0) + scores[i]
        assert value(labels[a:b], a) == pytest.approx(best.max())


def test_chat_round_trip(spark):
    said = [(1, 1, "user", "a\\n<|im_end|>\nb"), (1, 2, "assistant", "<\\|x"), (1, 2, "assistant", None), (2, 1, None, "ok"), (None, 1, "assistant", "lost"), (3, 1, "assistant", "y" * 3_000_000)]
    df = spark.createDataFrame(said, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.rendered(df)).collect()}
    one = hashlib.sha256(b"user\na\\n<|im_end|>\nb\nassistant\n\nassistant\n<\\|x\n").hexdigest()
    assert (got[1].n_turns, got[1].turns_sha256, got[1].loss_chars) == (3, one, 4) and got[3].loss_chars == 3_000_000 and set(got) == {1, 2, 3, None}
    assert chat.read_back(chat.rendered(df.limit(0))).count() == 0


def test_template_language():
    render = lambda t, m=(): "".join(p for p, _ in chat.compiled(t)(list(m)))
    assert render("{{ ('a' + 'b') | upper }}") == "AB" and render("{% if not x %}n{% else %}y{% endif %}") == "n"
    assert render("{% for m in messages %}{{ m.role }}{% if loop.first %}!{% endif %}{% endfor %}", [{"role": "a"}, {"role": "b"}]) == "a!b"
    for wrong in ("{{ m.__class__ }}", "{{ f() }}", "{% for x in y %}", "{{ 'a' | open }}", "{% endif %}"):
        with pytest.raises(chat.TemplateError):
            chat.compiled(wrong)
    assert all(chat.unescape(chat.escape(t)) == t for t in ("\\", "\\n", "<|", "<\\|", "\n<|\\"))


@pytest.mark.parametrize(("kind", "value"), [("card", "4111 1111 1111 1111"), ("ipv4", "10.0.0.7"), ("date", "2024-02-29"), ("ssn", "123-45-6789"), ("phone", "+49 30 1234567"), ("email", "Jo.Doe7@example.com")])
def test_pseudonyms_keep_the_format_and_go_back(kind, value):
    key = b"k" * 32
    new = pii.pseudonym(kind, value, key)
    assert new != value and pii.pseudonym(kind, new, key, backwards=True) == value
    shape = lambda t: "".join("9" if c.isdigit() else c for c in t)
    assert kind in ("email", "ipv4") or shape(new) == shape(value)


def test_feistel_is_a_permutation():
    assert sorted(pii.permute(v, 1000, b"x", "t") for v in range(1000)) == list(range(1000))


def test_pseudonymised_rows(docs, empty, spark):
    text = "call 123-45-6789 or 10.0.0.7, not 999.1.1.1"
    r = pii.pseudonymised(spark.createDataFrame([(1, text), (2, "x 123-45-6789"), (3, None)], "doc_id long, text string"), "k").orderBy("doc_id").collect()
    assert [[s.kind for s in x["__spans"]] for x in r] == [["ssn", "ipv4"], ["ssn"], []] and r[2].text is None and "999.1.1.1" in r[0].text
    s, t = r[0]["__spans"][0], r[1]["__spans"][0]
    assert r[0].text[s.start : s.end] == r[1].text[t.start : t.end] != "123-45-6789"
    assert pii.pseudonymised(docs, "k").columns == [*docs.columns, "__spans"] and pii.pseudonymised(empty, "k").count() == 0


@pytest.mark.parametrize("text", ["4111 1111 1111 1111 123", "4111111111111111 12/27", "no 7 4111 1111 1111 1111", "no 12-7 4111-1111-1111-1111 99", "4111 1111 1111 1111 5500 0000 0000 0004", "4111111111111111 123-45-6789"])
def test_cards_beside_other_numbers(text):
    """The same digits with the card's pseudonym, the other numbers as they are."""
    got = list(pii.found(text, lambda kind, value: pii.pseudonym(kind, value, b"k" * 32)))
    values = [text[a:b] for _, a, b, _ in got]
    assert values[0].replace(" ", "").replace("-", "") == "4111111111111111"
    assert values[1:] == (["5500 0000 0000 0004"] if "5500" in text else ["123-45-6789"] if "6789" in text else [])


def test_toxicity_grades(spark, docs, empty):
    rows = [(i, f"hello friend number {i} nice day", 0) for i in range(80)] + [(80 + i, f"hello vile scum number {i}", 1) for i in range(40)] + [(120 + i, f"vile scum awful murder {i}", 2) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df.drop("toxic"), df.select("doc_id", "toxic"))
    got = {r.doc_id: r["__severity"] for r in toxicity.graded(df, model).collect()}
    assert max(got[i] for i in range(80)) < min(got[i] for i in range(80, 120)) < got[130] and model.thresholds[0] <= model.thresholds[1]
    assert toxicity.graded(docs, model).count() == len(odd_rows()) and toxicity.graded(empty, model).count() == 0


def test_rare_toxic_words_count():
    """Words of six toxic documents each, beside one of a hundred and fifty."""
    rng = np.random.default_rng(11)
    plain = lambda: " ".join("w" + "abcdefghij"[a] + "abcdefghij"[b] for a, b in rng.integers(0, 10, (20, 2)))
    rare = ["rara", "mala", "fea", "sucia"]
    rows = [(plain(), 0) for _ in range(1842)] + [(plain() + " scum", 1) for _ in range(150)]
    rows += [(" ".join([plain(), *(w for j, w in enumerate(rare) if j != i % 4)]), 1) for i in range(8)]
    texts = __import__("pyarrow").array([t for t, _ in rows])
    lists = [np.unique(words[first[i] : first[i + 1]]) for words, first, n in toxicity._features(texts) for i in range(n)]
    model = toxicity.fit(lists, np.array([y for _, y in rows]))
    unseen = __import__("pyarrow").array([plain() + " rara sucia", plain() + " scum", plain(), plain()])
    assert (model.severity(unseen) >= 0.5).tolist() == [True, True, False, False]


def test_prints_align_shifted_recordings(spark):
    rng = np.random.default_rng(3)
    tune = rng.normal(size=64)
    whole = next(media.melody(__import__("pyarrow").array([tune.tolist()])))
    pcm = lambda x: (np.clip(x, -1, 1) * 30000).astype("<i2").tobytes()
    other = next(media.melody(__import__("pyarrow").array([rng.normal(size=64).tolist()])))
    rows = [(100, pcm(whole)), (1, pcm(whole)), (2, pcm(whole[8 * media.HOP :])), (3, pcm(whole + rng.normal(size=len(whole)) * 0.01)), (4, pcm(other)), (5, None), (6, b"ab")]
    prints = media.fingerprints(spark.createDataFrame(rows, "id long, audio binary"), "id", "audio")
    members, pairs = media.aligned(prints, F.col("rec_id") == 100)
    assert {r.rec_id: r.class_id for r in members.collect()} == {100: 1, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6}
    got = {r.class_id: (r.offset, r.bit_error) for r in pairs.collect()}
    assert set(got) == {2, 3} and got[2] == (8, 0.0) and got[3][0] == 0 and got[3][1] < 0.1
    assert media.fingerprints(spark.createDataFrame(rows, "id long, audio binary").limit(0), "id", "audio").count() == 0


def test_packed_equals_plain_sums():
    frames = np.random.default_rng(5).random((20, 12))
    got = media.packed(frames)
    assert len(got) == 5
    t, dt, c, dc, kind = media.FILTERS[0]
    up = frames[t : t + dt, c : c + dc].sum()
    value = np.log((1 + up) / (1 + dt * dc / 12))
    level = int(value > -media.CUT) + int(value > 0) + int(value > media.CUT)
    assert kind == 0 and got[0] & 3 == [0, 1, 3, 2][level]
