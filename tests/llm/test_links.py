"""Near copies of texts and vectors, repeated strings, language ID, toxicity and the pipeline, on small inputs."""

import hashlib
import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spacerlake.llm import embedding_dedup, language_id, linkage, ngram_join, suffix_dedup, toxicity
from spacerlake.llm.registry import ORACLE_SQL, QUERIES
from spacerlake.llm.shared import scratch, table
from tests.conftest import DATA

DOC = "doc_id long, text string, lang string, source string, n_chars long, id long, key long, side int, root long, copies long"


def docs_of(spark, texts):
    return spark.createDataFrame([(k, t, "en", "s", None, 1, 2, 3, 4, 5) for k, t in enumerate(texts)], DOC)


def components(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_short_texts_together():
    """Anchors, units and word hashes of texts looked at together are those of each text, for odd ones and at all sizes of the runs."""
    rng = random.Random(3)
    texts = ["".join(rng.choices("abcd ", k=rng.randrange(900))) for _ in range(60)] + ["", "a" * 3000, "ab " * 700, "\u03a3\u03c3\u03c2 \u0391\u03a3", " ", "x"]
    texts += [texts[3] * 3, "y" + texts[3]]
    for together in (1, 700, 1 << 16):
        words = ngram_join.word_hashes_of_all(texts, together)
        assert [x.tolist() for x in words] == [ngram_join.word_hashes(x).tolist() for x in texts]
        for data, length, gram, step in (([suffix_dedup.bytes_of(x) for x in texts], 100, 16, 16), (words, 20, 4, 4)):
            alone = [suffix_dedup.anchors(x, length, gram) for x in data]
            for a, b in zip(alone, suffix_dedup.anchors_of_all(data, length, gram, together), strict=True):
                assert a[4] == b[4] and all(x.dtype == y.dtype and x.tolist() == y.tolist() for x, y in zip(a[:4], b[:4], strict=True))
            rows = [x for x in range(len(data)) if len(data[x]) >= length]
            begins = np.cumsum([len(data[x]) for x in rows]) - [len(data[x]) for x in rows]
            every = [suffix_dedup.units_of(data[x], *alone[x][:4], length, step) for x in rows]
            joined = [np.concatenate([alone[x][k] + (at if k else np.uint64(0)) for x, at in zip(rows, begins, strict=True)]) for k in range(4)]
            found = suffix_dedup.units_of(np.concatenate([data[x] for x in rows]), *joined, length, step)
            shifted = [np.concatenate([y[k] + (at if k == 2 else y[k].dtype.type(0)) for y, at in zip(every, begins, strict=True)]) for k in range(4)]
            assert all((x == y).all() for x, y in zip(found, shifted, strict=True))
    values = np.array([rng.randrange(1000) for _ in range(300)], np.uint64)
    for width in (1, 2, 3, 7, 64, 300):
        assert suffix_dedup._sliding_least(values, width).tolist() == [min(values[k : k + width]) for k in range(301 - width)]


def test_connected_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(300, 340)] + [(7, 7)]
    want = components(341, pairs)
    got = {r["id"]: r["root"] for r in linkage.connected_components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    assert got == {x: want[x] for a, b in pairs if a != b for x in (a, b)}
    assert linkage.connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


# n-gram join


def shingles(text):
    words = "".join(c if c.isascii() and c.isalnum() or ord(c) >= 128 else " " for c in (text or "").lower()).split()
    n = min(5, len(words))
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if n else set()


@pytest.mark.parametrize("block", [512, 4])
def test_similar_texts(spark, monkeypatch, block):
    monkeypatch.setattr(linkage.in_blocks, "__defaults__", (None, block))
    rng = random.Random(2)
    words = [f"w{k}" for k in range(500)]
    texts = []
    for _ in range(12):
        base = rng.choices(words, k=rng.randint(5, 150))
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    hub = rng.choices(words, k=400)
    for k in range(30):
        texts.append(" ".join([*hub[:k], "other", *hub[k + 1 :]]))
    texts += [None, "", "...", "one two", "One, two!", texts[0], texts[0], "w1 " * 20_000]
    got = {r["doc_id"]: r for r in ngram_join.join_similar(docs_of(spark, texts)).collect()}
    sets = [shingles(x) for x in texts]
    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root = components(len(texts), pairs)
    for k in range(len(texts)):
        assert got[k]["n_links"] == sum(k in p for p in pairs), k
        assert got[k]["class_id"] == root[k] and got[k]["kept"] == (root[k] == k)
        assert got[k]["copy_id"] == min([j for j in range(len(texts)) if sets[j] and sets[j] == sets[k]], default=k)


def test_similar_texts_odd_rows(spark):
    docs = docs_of(spark, ["a b c d e f g", "a b c d e f g", "x"])
    assert ngram_join.join_similar(docs.limit(0)).count() == 0
    assert ngram_join.join_similar(docs.where("doc_id = 0").union(docs.where("doc_id = 0"))).select("n_links").distinct().collect() == [(1,)]
    nulls = docs.withColumn("doc_id", F.when(F.col("doc_id") > 0, F.col("doc_id")))
    assert {(r["doc_id"], r["class_id"], r["n_links"]) for r in ngram_join.join_similar(nulls).collect()} == {(None, 1, 1), (1, 1, 1), (2, 2, 0)}
    assert ngram_join.prefix_length(0.8) == 5 and ngram_join.prefix_length(0.8, trees=1) == 1


def test_forest_recall(spark):
    """Of the pairs at and just above the threshold, at least 0.99 are found; also with a single value below the root, or none."""
    rng = random.Random(13)
    words = [f"w{k}" for k in range(5000)]
    texts = []
    for _ in range(300):
        base = rng.choices(words, k=104)
        texts += [" ".join(base), " ".join([*base[:50], "other", "word", *base[52:98]])]
    pairs = [(k, k + 1) for k in range(0, 600, 2) if len(shingles(texts[k]) & shingles(texts[k + 1])) >= 0.8 * len(shingles(texts[k]) | shingles(texts[k + 1]))]
    assert len(pairs) > 250
    for longest in (8, 6, 5):
        got = {r["doc_id"]: r["class_id"] for r in ngram_join.join_similar(docs_of(spark, texts), longest=longest).collect()}
        assert sum(got[a] == got[b] for a, b in pairs) >= 0.99 * len(pairs)


def test_sketch_edges_in_tries(spark):
    """Forests of groups of any shape connect what comparing all pairs connects, in one block or several."""
    rng = random.Random(14)
    rows = [(rng.randrange(6), rng.randrange(40)) for _ in range(400)]
    for levels in (0, 2):
        data = [(g, 0, k, bytes([x]), (x // 8 << linkage.LEVEL_BITS) + x % 8) for k, (g, x) in enumerate(rows)]
        df = spark.createDataFrame(data, "group long, side int, id long, sketch binary, path long")
        edges = linkage.sketch_edges(df, lambda a, b: np.abs(a[:, 0].astype(int) - b[:, 0]) <= 1, levels).collect()
        want = components(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if rows[a][0] == rows[b][0] and abs(rows[a][1] - rows[b][1]) <= 1])
        assert components(len(rows), [(r["id"], r["other"]) for r in edges]) == want


def near_texts(n):
    rng = random.Random(12)
    words = [f"w{k}" for k in range(500)]
    bases = [rng.choices(words, k=100) for _ in range(n)]
    return [" ".join(x) for x in bases], [" ".join([*x[:40], "other", *x[41:]]) for x in bases]


def test_similar_texts_shared_ids(spark):
    """Documents without a doc_id, and several under one, keep their own texts and links."""
    texts, near = near_texts(12)
    rows = [(None, x) for x in texts[:10] + near[:10]] + [(5, texts[10]), (5, texts[11]), (7, near[10]), (3, near[11])]
    got = Counter(tuple(r) for r in ngram_join.join_similar(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "class_id", "n_links", "kept").collect())
    assert got == {(None, None, 1, True): 20, (5, 5, 1, True): 1, (5, 3, 1, False): 1, (7, 5, 1, False): 1, (3, 3, 1, True): 1}


# embeddings


@pytest.mark.parametrize("block", [512, 4])
def test_similar_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(linkage.in_blocks, "__defaults__", (None, block))
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(30):
        base = rng.standard_normal(16)
        for _ in range(rng.integers(1, 8)):
            v = base + rng.standard_normal(16) * rng.choice([0.0, 0.1, 0.25, 0.3])
            rows.append((v.astype(np.float32).tolist(), int(rng.integers(0, 2))))
    rows += [(rows[0][0], rows[0][1]), ([2 * x for x in rows[0][0]], rows[0][1]), (rows[0][0][:8], rows[0][1]), (rows[0][0], None), (None, 0), ([], 0), ([0.0] * 16, 0), ([float("nan")] * 16, 0), ([1.0] * 15 + [float("inf")], 0), ([1.0] * 15 + [None], 0)]
    order = list(range(len(rows)))
    random.Random(4).shuffle(order)
    df = spark.createDataFrame([(k, rows[j][0], rows[j][1], 1, 2) for k, j in enumerate(order)], "vec_id long, embedding array<float>, label int, id int, key int")
    vectors = [(np.array(rows[j][0], np.float64) if rows[j][0] and rows[j][1] is not None and None not in rows[j][0] else None, rows[j][1]) for j in order]
    ok = [v is not None and np.isfinite(v).all() and v.any() for v, _ in vectors]
    pairs = []
    for a in range(len(order)):
        for b in range(a):
            (x, i), (y, j) = vectors[a], vectors[b]
            if ok[a] and ok[b] and i == j and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.93:
                pairs.append((a, b))
    root = components(len(order), pairs)
    got = {r["vec_id"]: r for r in embedding_dedup.link_vectors(df).collect()}
    assert len(got) == len(order)
    for k in range(len(order)):
        assert (got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == (sum(k in p for p in pairs), root[k], root[k] == k)
    assert embedding_dedup.link_vectors(df.limit(0)).count() == 0
    assert embedding_dedup.link_vectors(df.limit(3).union(df.limit(3))).count() == 6


def test_key_bits():
    assert embedding_dedup.key_bits(0) == embedding_dedup.key_bits(500) == embedding_dedup.LEAST_BITS and embedding_dedup.key_bits(1 << 20) == 20 + embedding_dedup.SPARE
    for bits in (10, 14, 21, 30):
        p = 1 - math.acos(0.93) / math.pi
        assert (1 - p**bits) ** embedding_dedup.key_tables(bits) <= 4e-5


# repeated strings


def repeated_bytes(texts, length):
    where = {}
    for k, t in enumerate(texts):
        for s in range(len(t) - length + 1):
            where.setdefault(t[s : s + length], []).append((k, s))
    gone = [np.zeros(len(t), bool) for t in texts]
    for places in where.values():
        if len(places) > 1:
            for k, s in places:
                gone[k][s : s + length] = True
    return gone


@pytest.mark.parametrize("options", [{}, {"length": 100, "gram": 16, "step": 16, "index_units": 3}])
def test_repeats(spark, options):
    rng = random.Random(6)
    letters = "abcdefg hijé "
    base = "".join(rng.choices(letters, k=3000))
    texts = []
    for _ in range(40):
        a = rng.randint(0, 2000)
        text = "".join(rng.choices(letters, k=rng.randint(0, 300))) + base[a : a + rng.randint(0, 900)] + "".join(rng.choices(letters, k=rng.randint(0, 200)))
        if rng.random() < 0.3 and text:
            at = rng.randrange(len(text))
            text = text[:at] + "#" + text[at + 1 :]
        texts.append(text)
    texts += ["a" * 1000, "ab" * 600, "x" * 399, "y" * 400, "", None, texts[0], texts[1], base]
    got = {r["doc_id"]: r for r in suffix_dedup.find_repeats(docs_of(spark, texts), **options).collect()}
    data = [(x or "").encode() for x in texts]
    for k, (text, gone) in enumerate(zip(data, repeated_bytes(data, options.get("length", 400)), strict=True)):
        r = got[k]
        assert (r["n_bytes"], r["n_removed"]) == (len(text), gone.sum()), k
        assert r["kept_sha256"] == hashlib.sha256(bytes(np.frombuffer(text, np.uint8)[~gone])).hexdigest()
        marks = np.zeros(len(text), bool)
        for s in r["spans"]:
            marks[s["start"] : s["end"]] = True
        assert (marks == gone).all() and len(r["spans"]) == (np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()


def test_repeats_odd_rows(spark):
    docs = docs_of(spark, ["q" * 10, "z" * 399 + "y"])
    assert suffix_dedup.find_repeats(docs.limit(0)).count() == 0
    assert [r["n_removed"] for r in suffix_dedup.find_repeats(docs).collect()] == [0, 0]
    assert {(r["n_bytes"], r["n_removed"]) for r in suffix_dedup.find_repeats(docs.union(docs)).collect()} == {(10, 0), (400, 400)}
    text = "".join(random.Random(7).choices("abcdef", k=700)).encode()
    data = np.frombuffer(text, np.uint8)
    a, b = suffix_dedup.anchors(data, 100, 16), suffix_dedup.anchors(data, 100, 16, piece=64)
    assert {(h, p) for h, p in zip(a[0], a[1], strict=True)} == {(h, p) for h, p in zip(b[0], b[1], strict=True)}


def test_run_length_index():
    """Match statistics against all pairs of suffixes."""
    rng = random.Random(3)
    for kind in (np.uint8, np.uint64) * 40:
        base = [bytes(rng.choices(b"ab\xc3\xff", k=rng.randint(1, 30))) for _ in range(4)]
        texts = [b"".join(rng.choices(base, k=rng.randint(0, 4))) for _ in range(rng.randint(1, 6))]
        index = suffix_dedup.RunLengthIndex([np.frombuffer(x, np.uint8).astype(kind) for x in texts])
        found = index.match_lengths()
        ends = [(k, text[at:]) for k, text in enumerate(texts) for at in range(len(text))]
        for n, (k, own) in enumerate(ends):
            best = max((len(os.path.commonprefix([own, other])) for m, (_, other) in enumerate(ends) if m != n), default=0)
            assert found[index.starts[k] + len(texts[k]) - len(own)] == best


def test_repeats_long_texts(spark, monkeypatch):
    """Texts of one byte, of short periods, and longer than a piece."""
    rng = random.Random(8)
    monkeypatch.setattr(suffix_dedup.anchors, "__defaults__", (5000,))
    words = "".join(rng.choices("abcdefgh ", k=14_000))
    texts = ["a" * 20_000, "x" + "a" * 450 + "y", "b" * 401, "ab" * 3000 + "c" * 390, "xyz" * 2000 + words[:800], words, "q" + words[9000:9900], words[4800:5300] + "ab" * 210, None]
    got = {r["doc_id"]: r for r in suffix_dedup.find_repeats(docs_of(spark, texts)).collect()}
    data = [(x or "").encode() for x in texts]
    for k, gone in enumerate(repeated_bytes(data, 400)):
        assert got[k]["n_removed"] == gone.sum(), k
        assert got[k]["kept_sha256"] == hashlib.sha256(bytes(np.frombuffer(data[k], np.uint8)[~gone])).hexdigest()
    hashes, *_ = suffix_dedup.anchors(np.zeros(10_000_000, np.uint8), 400, 32)
    assert len(hashes) < 10_000


def test_passages(spark):
    """Words of passages of over 50 words that start more than once."""
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(400)]
    base = rng.choices(vocabulary, k=300)
    texts = [" ".join([*rng.choices(vocabulary, k=rng.randint(0, 40)), *base[a : a + n], *rng.choices(vocabulary, k=rng.randint(0, 40))]) for a, n in [(0, 50), (0, 51), (10, 70), (30, 200), (100, 51), (249, 51), (5, 60)]]
    texts += [texts[3].upper().replace(" ", ", "), "", None, "w1 " * 200, "one two"]
    got = {r["doc_id"]: r for r in suffix_dedup.find_passages(docs_of(spark, texts)).collect()}
    assert len(got) == len(texts)
    own = ["".join(c if c.isalnum() else " " for c in (x or "").lower()).split() for x in texts]
    for k, gone in enumerate(repeated_bytes([tuple(x) for x in own], 51)):
        assert (got[k]["n_words"], got[k]["n_repeated"]) == (len(own[k]), gone.sum()), k


# language ID


def test_languages(spark):
    docs = table(spark, DATA, "documents")
    model = language_id.learn_likelihoods(docs)
    rows = docs.select("doc_id", "text", F.lit(None).cast("string").alias("declared"), F.col("source").alias("host"), F.lit("").alias("domain"), F.lit(None).cast("string").alias("suffix"), "lang")
    found = language_id.identify(rows, model, ["doc_id", "lang"])
    assert found.where("rejected OR language <> lang").count() <= 2
    odd = [(k, x, "zz-ZZ", None, None, None) for k, x in enumerate([None, "", "123 ... !!", "漢字漢字漢字" * 9, "qzxj vkqz jxqv zqkx " * 9])]
    odd = spark.createDataFrame(odd, "doc_id long, text string, declared string, host string, domain string, suffix string")
    got = {r["doc_id"]: r for r in language_id.identify(odd.union(odd), model, ["doc_id"]).collect()}
    assert all(r["rejected"] for r in got.values()) and got[0]["language"] is None and got[3]["language"] == "other"
    assert language_id.identify(odd.limit(0), model, ["doc_id"]).count() == 0
    assert language_id.identify(odd, language_id.learn_likelihoods(docs.limit(0)), ["doc_id"]).where("rejected").count() == 5


def test_language_fusion_by_hand(spark):
    """Against the same sums in plain Python; unclear texts follow their host and declaration."""
    docs = table(spark, DATA, "documents")
    languages, logs = language_id.learn_likelihoods(docs)
    texts = [(r["text"][:200], r["lang"]) for r in docs.orderBy("doc_id").limit(40).collect()] + [("a", None)] * 4
    rows = [(k, x, lang if k % 5 else None, f"h{k % 3}.{lang}", f"d.{lang}", "com" if k % 2 else "net") for k, (x, lang) in enumerate(texts)]
    df = spark.createDataFrame(rows, "k long, text string, declared string, host string, domain string, suffix string")
    got = {r["k"]: r for r in language_id.identify(df, (languages, logs), ["k"]).collect()}
    n = len(languages)
    full = np.vstack([logs, np.full(language_id.BUCKETS, -np.log(language_id.BUCKETS))]).astype(np.float32)
    flat = np.array([(1 - language_id.OTHER_PRIOR) / n] * n + [language_id.OTHER_PRIOR])
    evidence = []
    for _, x, *_ in rows:
        g = language_id.trigrams(x)
        evidence.append(full[:, g].mean(axis=1, dtype=np.float64) * min(len(g), language_id.EVIDENCE))
    soft = np.array([np.exp(e - e.max()) * flat / (np.exp(e - e.max()) * flat).sum() for e in evidence])
    codes = [r[2] if r[2] in languages else "none" for r in rows]
    for k, r in enumerate(rows):
        prior = flat
        for same in (lambda o: True, lambda o: o[5] == r[5], lambda o: o[4:] == r[4:], lambda o: o[3:] == r[3:]):  # noqa: B023
            counts = sum(soft[j] for j, o in enumerate(rows) if same(o) and j != k) + np.zeros(n + 1)
            prior = (counts + language_id.KAPPA * prior) / (counts.sum() + language_id.KAPPA)
        told = (sum((soft[j] for j in range(len(rows)) if codes[j] == codes[k] and j != k), np.zeros(n + 1)) + 1) / (soft.sum(axis=0) - soft[k] + n + 2)
        log = evidence[k] + np.log(prior) + np.log(told)
        posterior = np.exp(log - log.max()) / np.exp(log - log.max()).sum()
        assert got[k]["probability"] == pytest.approx(posterior.max(), rel=1e-4)
        assert got[k]["language"] == [*languages, "other"][posterior.argmax()]


def test_page_text():
    html = '<html lang="en"><head><style>p{}</style><SCRIPT>var t="<p>";</SCRIPT></head><body><!-- no -->Some&amp;text<br>here</body>'
    assert language_id.page_text(language_id.shown_markup(html)).split() == ["Some", "text", "here"]


def test_pages_of_any_length():
    """Tags, scripts and comments without an end, over and over, take time in proportion."""
    for part in ("<script", "<!-- ", "<", "<html ", "<style>x", "&", "</script"):
        page = part * 200_000
        assert isinstance(language_id.page_text(language_id.shown_markup(page)), str) and language_id.declared_language(page) == ""
    assert language_id.shown_markup("a<script>b<!--c</script>d<!--e").split() == ["a", "d<!--e"]


def test_many_languages(spark):
    """Every label is a language, however many there are."""
    rng = random.Random(15)
    rows = []
    for k in range(70):
        own = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=5)) for _ in range(12)]
        rows += [(100 * k + n, " ".join(rng.choices(own, k=40)), f"l{chr(97 + k // 26)}{chr(97 + k % 26)}") for n in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn_likelihoods(docs)
    assert len(model[0]) == 70
    asked = docs.select("doc_id", "text", "lang", F.lit(None).cast("string").alias("declared"), F.lit("h").alias("host"), F.lit("").alias("domain"), F.lit("").alias("suffix"))
    assert language_id.identify(asked, model, ["doc_id", "lang"]).where("language = lang").count() >= 275


# toxicity


def test_lexicon_by_hand(spark):
    """The lexicon against the same counts in plain Python, counted in one part and in many."""
    rng = random.Random(16)
    words = [f"w{k}" for k in range(60)]
    rows = [(" ".join([*rng.choices(words, k=20), *(["rotten", "vile"] if k % 4 == 0 and rng.random() < 0.9 else [])]), int(k % 4 == 0)) for k in range(400)] + [(None, 0), ("", 1)]
    held = [({x for w in set(toxicity._words((t or "").lower().encode())) for x in toxicity.entries(w)}, y) for t, y in rows]
    n = [sum(y == k for _, y in held) for k in (0, 1)]
    want = {}
    for x in set().union(*(e for e, _ in held)):
        m, a = (sum(x in e and y == k for e, y in held) for k in (0, 1))
        p = (m + a + 1) / (sum(n) + 2)
        z = (a / n[1] - m / n[0]) / math.sqrt(p * (1 - p) * (1 / n[0] + 1 / n[1]))
        odds = math.log((a + 0.5) / (n[1] + 1)) - math.log((m + 0.5) / (n[0] + 1))
        if a >= toxicity.LEAST_TEXTS and z >= toxicity.LEAST_Z and odds > 1:
            want[x] = odds
    got = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"))
    assert b"rotten " in got and got.keys() == want.keys() and all(got[x] == pytest.approx(want[x]) for x in want)


def test_isotonic_calibration(spark):
    """Scores never fall as the trees' chance rises, and among calibration rows of one step the mean is the share of toxic ones."""
    docs = spark.createDataFrame([(k, f"awful thing {k % 7} " * (k % 3) + f"word{k % 11} other{k % 5}", int(k % 3 > 0 and k % 4 > 0)) for k in range(600)], "doc_id long, text string, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, docs.select("doc_id", "toxic")).collect()}
    steps = {}
    for r in docs.collect():
        if zlib.crc32(str(r["doc_id"]).encode()) % 5 == toxicity.CALIBRATION:
            steps.setdefault(round(got[r["doc_id"]], 2), []).append(r["toxic"])
    for score, toxic in steps.items():
        if len(toxic) > 30:
            assert abs(score - sum(toxic) / len(toxic)) < 0.1


def test_toxicity_long_text():
    scorer = toxicity.Scorer({b"idiot ": 3.0})
    found = dict(zip(toxicity.FEATURES, scorer.features("you idiot! " * 300_000), strict=True))
    assert found["density"] == 50 and found["near_you"] == 50


def test_toxicity_learns(spark):
    rng = random.Random(8)
    words = [f"word{k}" for k in range(300)]
    docs, labels = [], []
    for k in range(800):
        bad = k % 6 == 0
        text = rng.choices(words, k=rng.randint(10, 80))
        if bad:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(["nasty", "awful", "you"]))
        docs.append((k, " ".join(text), "en", "s", None, 1, 2, 3, 4, 5))
        labels.append((k, 1, int(bad)))
    docs += [(1000, None, None, None, None, 1, 2, 3, 4, 5), (1001, "", None, None, None, 1, 2, 3, 4, 5), (1002, "n4sty n@sty you", None, None, None, 1, 2, 3, 4, 5), (None, "nasty", None, None, None, 1, 2, 3, 4, 5)]
    docs, known = spark.createDataFrame(docs, DOC), spark.createDataFrame([*labels, (1001, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, known.union(known.limit(5))).collect()}
    assert len(got) == 804
    assert all(r["held_out"] == (k is not None and zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for k, r in got.items())
    right = [got[k]["predicted"] == bad for k, _, bad in labels if got[k]["held_out"]]
    assert sum(right) >= 0.97 * len(right)
    assert got[1000]["score"] == got[1001]["score"] < 0.5
    assert toxicity.score_toxicity(docs.limit(0), known).count() == 0
    assert [r["score"] for r in toxicity.score_toxicity(docs.limit(2), known.limit(0)).collect()] == [0, 0]


def test_toxicity_features():
    scorer = toxicity.Scorer({b"idiot ": 3.0})
    plain, hidden = (dict(zip(toxicity.FEATURES, scorer.features(x), strict=True)) for x in ("YOU idiot!", "1d10t"))
    assert plain["density"] == 50 and plain["near_you"] == 50 and plain["strongest"] == 3 and plain["capitals"] == 30
    assert hidden["hits"] == 0 and hidden["obfuscated"] > 0
    assert toxicity._near([10], [16]) == 0 and toxicity._near([10, 40], [15, 36, 100]) == 2


# pipeline


def shared_tables(spark):
    folder = os.path.dirname(scratch(spark, "x")).removeprefix("file://")
    return [f"{folder}/{x}" for x in os.listdir(folder)]


def test_pipeline_stages(spark):
    docs = table(spark, DATA, "documents")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language id", "n-gram Jaccard join", "benchmark decontamination", "mixing sources", "token ids"]
    rows = {r["doc_id"]: r for r in docs.collect()}
    language = corpus_pipeline.identify_language(spark, docs, DATA)
    assert language.columns == docs.columns and language.count() >= len(rows) - 2
    near = corpus_pipeline.drop_near_copies(spark, language, DATA)
    sets = {r["doc_id"]: shingles(r["text"]) for r in language.collect()}
    ids = sorted(sets)
    pairs = [(a, b) for a in range(len(ids)) for b in range(a) if sets[ids[a]] and len(sets[ids[a]] & sets[ids[b]]) >= 0.8 * len(sets[ids[a]] | sets[ids[b]])]
    assert {r["doc_id"] for r in near.collect()} == {ids[x] for x in components(len(ids), pairs)}
    clean = corpus_pipeline.drop_contaminated(spark, near, DATA)
    assert 0 < clean.count() < near.count()
    mixed = corpus_pipeline.mix(spark, clean, DATA)
    assert mixed.columns == docs.columns and 0 < mixed.count() <= clean.count()
    out = corpus_pipeline.write_token_ids(spark, mixed, DATA).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in out] == sorted(r["doc_id"] for r in mixed.collect())
    assert [r["start"] for r in out] == [sum(x["n_tokens"] for x in out[:k]) for k in range(len(out))]
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, DATA).count() == 0


def test_pipeline_shared_ids(spark):
    """Different documents under one doc_id, or none, are decided on one by one."""
    texts, near = near_texts(6)
    rows = [(5, texts[0]), (3, near[0]), (5, texts[1]), (None, texts[2]), (None, near[2]), (None, texts[3]), (None, texts[3]), (7, "..."), (7, "")]

    def docs_with(rows):
        return spark.createDataFrame([(k, x, "en", f"s{n % 2}", 1) for n, (k, x) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")

    found = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_copies(spark, docs_with(rows), DATA).collect())
    one = found[None, texts[2]] + found[None, near[2]]
    assert one == 1 and found - Counter([(None, texts[2]), (None, near[2])]) == Counter([(3, near[0]), (5, texts[1]), (None, texts[3]), (7, "..."), (7, "")])
    item = table(spark, DATA, "benchmark").where("length(text) > 40").first()["text"]
    clean = corpus_pipeline.drop_contaminated(spark, docs_with([*rows, (5, item), (None, item)]), DATA)
    assert Counter((r["doc_id"], r["text"]) for r in clean.collect()) == Counter(rows)


def test_pipeline_leaves_little(spark):
    """Language ID and the near-copy stage leave neither texts nor paths and sketches in the shared folder."""
    docs = table(spark, DATA, "documents")
    before = set(shared_tables(spark))
    corpus_pipeline.drop_near_copies(spark, corpus_pipeline.identify_language(spark, docs, DATA), DATA).count()
    for path in set(shared_tables(spark)) - before:
        assert not {"text", "nodes", "sketch"} & set(spark.read.parquet(path).columns), path


def test_pipeline_mix_keeps_all(spark):
    """One source with most of the letters, and a source without any, lose no document."""
    texts = ["x" * 9000] * 60 + ["y" * 9000] * 2 + ["", None]
    docs = spark.createDataFrame([(k if k % 9 else None, f"{x}{k}" if x else x, "en", "hot" if k < 60 else "cold" if k < 62 else "empty", 1) for k, x in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    mixed = corpus_pipeline.mix(spark, docs, DATA).collect()
    assert Counter(mixed) == Counter(docs.collect())
    assert max(k for k, r in enumerate(mixed) if r["source"] == "cold") < 30


def test_pipeline_mix_orders_token_files(spark, tmp_path):
    """The token files hold the documents in the order of their slots, also when the mixed table was written and read; start stays that of doc_id."""
    rows = [(k if k % 5 else None, f"{'word ' * (700 + 40 * k)}{k}", "en", f"s{k % 3}" if k < 45 else None, k) for k in range(60)] + [(61, None, "en", "empty", 0), (62, "", "en", "empty", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    mixed = corpus_pipeline.mix(spark, docs, DATA)
    mixed.write.parquet(str(tmp_path / "mixed"))
    plain = corpus_pipeline.write_token_ids(spark, docs, DATA).collect()
    for table_ in (mixed, spark.read.parquet(str(tmp_path / "mixed"))):
        out = corpus_pipeline.write_token_ids(spark, table_, DATA).collect()
        in_files = sorted(out, key=lambda r: r["mixed_start"])
        assert [r["doc_id"] for r in in_files] == [r["doc_id"] for r in mixed.collect()]
        assert [r["mixed_start"] for r in in_files] == [sum(x["n_tokens"] for x in in_files[:k]) for k in range(len(rows))]
        by_id = sorted(out, key=lambda r: r["start"])
        ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in by_id]
        assert ids == sorted(ids) and [r["start"] for r in by_id] == [sum(x["n_tokens"] for x in by_id[:k]) for k in range(len(rows))]
        assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in out) == Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in plain)
        assert [r["doc_id"] for r in in_files] != [r["doc_id"] for r in by_id]
    assert all(r["mixed_start"] == r["start"] for r in plain)


def test_pipeline_language_decides_each_row(spark):
    """Rows of one doc_id and text, but of different declared languages or hosts, are decided on one by one, and equal rows alike."""
    docs = table(spark, DATA, "documents")
    some = docs.limit(40).collect()
    odd = [(r["doc_id"], r["text"], lang, source, r["n_chars"]) for r in some[:5] for lang, source in ((None, None), ("zz", r["source"]), (r["lang"], ""), (r["lang"], r["source"]))]
    odd += [(None, "", "en", "s", 0), (None, None, None, None, None), (None, None, None, None, None)]
    both = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    rows = both.withColumns({"declared": F.col("lang"), "host": F.col("source"), "domain": F.lit(""), "suffix": F.lit("")})
    model = language_id.learn_likelihoods(both.select("doc_id", "text", "lang"))
    want = language_id.identify(rows, model, docs.columns).where(~F.col("rejected")).select(docs.columns)
    assert Counter(corpus_pipeline.identify_language(spark, both, DATA).collect()) == Counter(want.collect())


def test_registry():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert set(ORACLE_SQL) < set(QUERIES)
