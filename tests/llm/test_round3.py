"""Whitening, fill-in-middle and quality rules against brute force, with nulls, empties, ties, repeats, long texts, empty tables and clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spacerlake.llm import fill_middle, quality_rules, whitening
from spacerlake.llm.registry import QUERIES
from tests.conftest import DATA

DOC = "doc_id long, text string, lang string, n long, form string, output string, n_words long, vote_0 int, kept boolean, low long, quality int"


def docs_of(spark, rows):
    return spark.createDataFrame([(k, t, "en", 1, "x", "y", 2, 3, True, 4, 5) for k, t in rows], DOC)


# whitening


def reference(vectors, wanted=32):
    """What whitening is to give, from the covariance itself: (n, deviations, e, u, whitened)."""
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    numerators = x * n - sums
    z = numerators.astype(float) / n
    e, u = np.linalg.eigh(z.T @ z / n)
    e, u = e[::-1][:wanted], u[:, ::-1][:, :wanted]
    return n, (numerators**2).sum(axis=1), e, u, z @ u / np.sqrt(e), z


def test_whitening_equals_eigenvectors(spark):
    rows = [r for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect() if r["embedding"] is not None]
    got = QUERIES["op11_whitening"](spark, DATA).collect()
    n, deviations, e, u, want, z = reference([r["embedding"] for r in rows])
    assert len(got) == len(rows) * 32 and {r["n"] for r in got} == {n}
    by = {(r["vec_id"], r["component"]): r for r in got}
    place = {r["vec_id"]: k for k, r in enumerate(rows)}
    assert all(r["deviation"] == deviations[place[r["vec_id"]]] for r in got)
    w = np.array([[by[r["vec_id"], c]["whitened"] for c in range(1, 33)] for r in rows])
    sign = np.sign((w * want).sum(axis=0))
    assert np.abs(w * sign - want).max() < 1e-8
    assert np.abs(np.array([by[rows[0]["vec_id"], c]["explained"] for c in range(1, 33)]) * (z * z).sum() / n / e - 1).max() < 1e-10
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9


def test_whitening_edge_cases(spark):
    rng = np.random.default_rng(1)
    good = [(k, [float(x) for x in rng.standard_normal(6) * [5, 4, 3, 2, 1, 0]], 9, 7) for k in range(40)]
    odd = [(100, None, 1, 1), (101, [], 1, 1), (102, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1, 1), (103, [float("nan")] + [0.0] * 5, 1, 1), (104, [float("inf")] + [0.0] * 5, 1, 1), (105, [1.0] * 5, 1, 1), (106, [1e300] + [0.0] * 5, 1, 1)]
    schema = "vec_id long, embedding array<double>, component int, n long"
    own = [*good, (None, *good[0][1:]), good[1]]
    got = whitening.whiten(spark.createDataFrame([*own, *odd], schema)).collect()
    n, deviations, e, _, want, _ = reference([r[1] for r in own])
    assert {r["component"] for r in got} == set(range(1, 6)), "a constant entry has no component"
    assert len(got) == 5 * len(own) and {r["n"] for r in got} == {42}
    assert sorted(r["deviation"] for r in got) == sorted(5 * [*deviations])
    assert sum(r["vec_id"] is None for r in got) == 5
    assert sorted(round(abs(r["whitened"]), 8) for r in got if r["component"] == 1) == sorted(round(abs(x), 8) for x in want[:, 0])
    empty = spark.createDataFrame([], schema)
    assert whitening.whiten(empty).count() == 0 and whitening.whiten(empty).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.whiten(spark.createDataFrame([good[0]], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([good[0]] * 9, schema)).count() == 0


def test_whitening_beyond_longs(spark):
    """n x - S no longer fits a long once entries are near 2^46: exact all the same, and null where the result itself doesn't fit."""
    rows = [(k, [float((k * 7919 % 31) << 40), float(k % 5)], 1, 1) for k in range(30)]
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>, component int, n long"), wanted=1).collect()}
    _, deviations, *_ = reference([r[1] for r in rows])
    assert got == {k: d if d < 1 << 63 else None for k, d in enumerate(deviations)} and None in got.values()


@pytest.mark.parametrize("spectrum", [np.linspace(1, 1.5, 150), 1 / np.arange(1, 301.0), np.r_[5, 5, 5, np.linspace(0, 1, 120)], np.r_[1e6, np.linspace(1, 2, 100)], np.ones(40), np.r_[np.linspace(1, 2, 20), np.zeros(80)]])
def test_leading_pairs(spectrum):
    d, calls = len(spectrum), []
    q = np.linalg.qr(np.random.default_rng(2).standard_normal((d, d)))[0]
    v = (q * spectrum) @ q.T
    v = (v + v.T) / 2

    def product(t):
        calls.append(t.shape[1])
        return v @ t

    e, u = whitening.leading_pairs(product, d, 24)
    want = np.sort(spectrum)[::-1][:24]
    want = want[want > 0]
    assert len(e) == len(want) and np.abs(e - want).max() < 1e-12 * want[0]
    assert np.linalg.norm(v @ u - u * e, axis=0).max() <= 1e-12 * want[0] and np.abs(u.T @ u - np.eye(len(e))).max() < 1e-12
    assert max(calls) < d or d <= 40, "never a product with as many columns as the covariance has"


def test_minres_solves():
    rng = np.random.default_rng(3)
    a = rng.standard_normal((30, 30))
    a = a + a.T
    b = rng.standard_normal((30, 4))
    x = whitening.minres(lambda v: a @ v, b, 60, 1e-13)
    assert np.abs(a @ x - b).max() < 1e-8


# fill-in-middle


def formatted(doc_id, text):
    text = text or ""
    n = len(text)
    h = [int(hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    form = "spm" if h[3] % 100 < 20 else "psm"
    return n, form, a, b - a, f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark):
    rng = random.Random(4)
    letters = ["a", "é", "Ж", "中", "🙂", "<", "P", ">", "\n", "é", "S", "M"]
    texts = [None, "", "x", "<P>", "a<S>b", "<<S", "中", "🙂🙂"] + ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 400))) for _ in range(300)]
    texts += ["ab" * 1_200_000 + "é" * 700_000 + "z", "中a" * 300_000]
    rows = [(k if k != 12 else None, t) for k, t in enumerate(texts)] + [(3, "again"), (3, "again"), (-5, "minus five")]
    got = fill_middle.fill_in_middle(docs_of(spark, rows), keep=("lang", "low")).withColumn("back", fill_middle.restored()).collect()
    want = sorted(((k, *formatted(k, t), t or "") for k, t in rows), key=str)
    assert sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"]) for r in got), key=str) == want
    assert {r["form"] for r in got} == {"plain", "psm", "spm"} and {(r["lang"], r["low"]) for r in got} == {("en", 4)}
    assert fill_middle.fill_in_middle(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("error,piece", [(120, 1 << 20), (1, 64), (3, 7)])
def test_rank_index_is_exact(error, piece):
    rng = random.Random(5)
    for size in (0, 1, 50, 3000):
        text = "".join(rng.choice("aé中🙂") * rng.randrange(1, 30) for _ in range(size))
        index = fill_middle.rank_index(text.encode(), error, piece)
        want = np.concatenate([[0], np.cumsum([len(c.encode()) for c in text])]).astype(int)
        assert (index.offsets(np.arange(len(text) + 1)) == want).all()
        assert len(index.residuals) == len(text) + 1 and np.abs(index.residuals.astype(int)).max() <= error + 1
    assert len(fill_middle.rank_index(b"a" * 100_000).first) == 2, "a text of one width is one segment and its end"


# quality rules


def counts_of(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    often = Counter(windows)
    repeated = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(8)}
    plain = lambda c: c.isascii() and c.isalnum() or ord(c) >= 128
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(repeated),
        "n_lines": len(lines), "n_different": len(set(words)), "n_capitals": sum("A" <= c <= "Z" for c in text), "n_letters": sum(c.isascii() and c.isalpha() for c in text), "n_plain": sum(map(plain, text)),
        "n_odd": sum(not plain(w[-1]) and w[-1] not in ".,;:!?)\"'-" for w in words), "n_ends": sum(w[-1] in ".!?" for w in words), "n_exclaims": sum(w[-1] == "!" for w in words),
        "n_same": sum(a == b for a, b in zip(words, words[1:], strict=False)),
    }


def test_counts_of_texts(spark):
    rng = random.Random(6)
    vocabulary = ["the", "Über", "中文", "a", "###", "END!", "x.", " ", "é", "?", "|", "<b>", "3"]
    texts = [None, "", " \t\n\v\f\r", "one", "\n\n", "a\nb\na\n a\n"]
    texts += ["".join(rng.choice(vocabulary) + rng.choice([" ", "\n", "  ", "\t", " \n", "\v"]) for _ in range(rng.randrange(1, 300))) for _ in range(400)]
    texts += [" ".join(["w"] * 9), " ".join("abcdefgh") + " " + " ".join("abcdefgh"), "long " * 300_000]
    rows = [(k if k else None, t) for k, t in enumerate(texts)] + [(7, texts[7])]
    got = quality_rules.text_counts(docs_of(spark, rows)).collect()
    key = lambda r: [-1 if v is None else v for v in r]
    assert sorted(([r[c] for c in ["doc_id", *quality_rules.COUNTS]] for r in got), key=key) == sorted(([k, *(counts_of(t)[c] for c in quality_rules.COUNTS)] for k, t in rows), key=key)


def posteriors(patterns):
    """Expectation-maximisation text by text, as in the textbook."""
    k = len(patterns[0])
    share, good, bad = quality_rules.START["share"], [quality_rules.START["good"]] * k, [quality_rules.START["bad"]] * k
    right, wrong = quality_rules.RIGHT, quality_rules.WRONG

    def chance(p):
        a, b = share, 1 - share
        for j, v in enumerate(p):
            a *= {1: good[j], -1: 1 - good[j], 0: 1}[v]
            b *= {1: bad[j], -1: 1 - bad[j], 0: 1}[v]
        return a / (a + b)

    for _ in range(quality_rules.ROUNDS):
        q = [chance(p) for p in patterns]
        share, good, bad = (
            (sum(q) + right) / (len(q) + right + wrong),
            [(sum(x for x, p in zip(q, patterns, strict=True) if p[j] == 1) + right) / (sum(x for x, p in zip(q, patterns, strict=True) if p[j]) + right + wrong) for j in range(k)],
            [(sum(1 - x for x, p in zip(q, patterns, strict=True) if p[j] == 1) + wrong) / (sum(1 - x for x, p in zip(q, patterns, strict=True) if p[j]) + right + wrong) for j in range(k)],
        )
    return chance


def test_verdicts_equal_the_textbook(spark):
    rng = random.Random(7)
    words = ["alpha", "beta", "gamma.", "delta", "of", "the", "epsilon", "zeta."]
    clean = [" ".join(rng.choice(words) + str(rng.randrange(99)) for _ in range(60)) + "." for _ in range(150)]
    noisy = [" ".join(rng.choice(words) + "###" for _ in range(60)) for _ in range(20)] + [" ".join(rng.choice(words).upper() + "!!" for _ in range(60)) for _ in range(20)]
    rows = list(enumerate([*clean, *noisy, "short", None, clean[0]]))
    got = quality_rules.judge(docs_of(spark, rows)).collect()
    votes = [f"vote_{k}" for k in range(len(quality_rules.RULES))]
    chance = posteriors([tuple(r[v] for v in votes) for r in got if not r["base_failed"]])
    for r in got:
        q = chance(tuple(r[v] for v in votes))
        assert abs(r["quality"] - q) < 1e-9 and r["kept"] == (not r["base_failed"] and q >= 0.5)
    kept = {r["doc_id"] for r in got if r["kept"]}
    assert kept == {*range(150), 192}, "clean texts stay, noisy ones go"
    assert quality_rules.judge(docs_of(spark, [])).count() == 0
    assert quality_rules.judge(docs_of(spark, [(1, None), (None, "")])).where("kept OR NOT base_failed").count() == 0


def test_planted_quality(spark):
    """Of the labelled texts, good ones that pass the base conditions are kept."""
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    found = quality_rules.judge(spark.read.parquet(f"{DATA}/documents.parquet")).join(labels.select("doc_id", F.col("quality").alias("label")), "doc_id")
    assert found.where("label = 1 AND NOT base_failed AND NOT kept").count() == 0


# line dedup of long lines


def test_long_lines_take_time_by_their_length(spark):
    """Lines of 250,000 characters, with one edit and with two; in seconds, as the check no longer takes the square of their length."""
    import time

    from spacerlake.llm import line_dedup

    rng = random.Random(9)
    line = "".join(rng.choices("abcdé ", k=250_000)).strip()
    middle = len(line) // 2
    other = lambda k, c: line[:k] + c + line[k + 1 :]
    texts = [line, other(middle, "#"), line[:middle] + line[middle + 1 :], line[:9] + "#" + line[9:], other(5, "#")[:-3] + "##" + line[-1]]
    start = time.time()
    got = {r["doc_id"]: (r["n_near"], r["n_repeated"]) for r in line_dedup.dedup_lines(docs_of(spark, list(enumerate(texts)))).collect()}
    assert got == {0: (0, 0), 1: (1, 0), 2: (1, 0), 3: (1, 0), 4: (0, 0)}
    assert time.time() - start < 90


def test_within_one_edit(spark):
    from spacerlake.llm import line_dedup

    rng = random.Random(10)
    rows = []
    for _ in range(300):
        a = "".join(rng.choices("abé", k=rng.randrange(0, 12)))
        b, k = list(a), rng.randrange(len(a) + 1)
        b[k : k + rng.choice([0, 1, 2])] = rng.choice(["", "a", "bé"])
        rows.append((a, "".join(b)))
    found = spark.createDataFrame(rows, "a string, b string")
    short = found.select((F.levenshtein("a", "b") <= 1).alias("want"), line_dedup._within_one(F.col("a"), F.col("b")).alias("got")).collect()
    pad = F.lit("x" * 3000)
    long_ = found.select((F.levenshtein("a", "b") <= 1).alias("want"), line_dedup._within_one(F.concat(pad, "a"), F.concat(pad, "b")).alias("got"), line_dedup._within_one(F.concat("a", pad), F.concat("b", pad)).alias("ahead")).collect()
    assert all(r["want"] == r["got"] for r in [*short, *long_]) and all(r["want"] == r["ahead"] for r in long_)
