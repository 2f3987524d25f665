"""Operators on small inputs worked out by hand or by brute force."""

import random

import pytest
from pyspark.sql import functions as F

from spacerlake.functions import sequence as S
from spacerlake.operators import arrays as A
from spacerlake.operators import clusters, columns, intervals, kernel, pairs, refine, routing, scoring, search
from spacerlake.plans import arrays as plan


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_sequences(spark):
    seqs = spark.createDataFrame([("ACGTN-RY",), ("",)], ["s"])
    assert [r[0] for r in seqs.select(S.reverse_complement(F.col("s"))).collect()] == ["RY-NACGT", ""]
    assert seqs.select(S.reverse_complement(S.reverse_complement(F.col("s")))).collect() == seqs.collect()
    assert one(spark, S.to_rna(F.lit("ATT"))) == "AUU"
    assert one(spark, S.canonical(F.lit("ACXG-"))) == "ACNGN"
    assert one(spark, S.accession_name(F.lit("NC_0001.12 some thing"))) == "NC_0001" and one(spark, S.full_name(F.lit("a b.c,d|e"))) == "a_b_c_d_e"
    assert one(spark, S.end_trims(F.lit("abcd"), 1)) == ["abc", "abcd", "bc", "bcd"]
    assert sorted(one(spark, S.substrings_around(F.lit("abcde"), F.lit(2), F.lit(2)))) == ["abc", "abcd", "abcde", "bcd", "bcde"]
    assert one(spark, S.rendered_with_dots(F.lit("A C-"), F.lit("A CT"))) == ". .-" and one(spark, S.rendered_with_dots(F.lit("A"), F.lit("AC"))) is None
    assert one(spark, S.interleaved(F.array(F.lit("R1"), F.lit("R2")), F.array(F.lit("s")))) == "R1sR2"
    assert one(spark, S.longest_run(F.split(F.lit("a,a,b,b,b,a"), ","))) == 3
    assert one(spark, S.evenness(F.array(F.lit(30), F.lit(30)))) == 0 and one(spark, S.evenness(F.array(*map(F.lit, (10, 20, 30, 40, 60, 90))))) == pytest.approx(1, abs=1e-5)
    assert one(spark, S.one_hot(F.lit("AG"), 3)) == [[1, 0, 0], [0, 0, 0], [0, 1, 0], [0, 0, 0]]


def test_pairs_agree_with_each_other_and_brute_force(spark):
    rng = random.Random(1)
    seqs = ["".join(rng.choices("ACGT", k=400)) for _ in range(3)] + ["ACGTACGTAC" * 30, "", "ACGN" * 40, None, "A" * 5]
    seqs[0] = seqs[0][:100] + seqs[0][60:100] + seqs[0][100:]
    df = spark.createDataFrame(list(enumerate(seqs)), "contig_id long, seq string")
    want = set()
    for k, s in enumerate(seqs):
        last = {}
        for b in range(len(s or "") - 20):
            w = s[b : b + 21]
            if w in last and 11 <= b - last[w] <= 121 and set(w) <= set("ACGT"):
                want.add((k, last[w], b))
            last[w] = b
    assert {tuple(r) for r in pairs.repeat_pairs(df).collect()} == want == {tuple(r) for r in pairs.repeat_pairs_by_window(df).collect()}
    near = set()
    for k, s in enumerate(seqs):
        s = s or ""
        for a in range(len(s) - 20):
            for b in range(a + 11, min(a + 121, len(s) - 21) + 1):
                x, y = s[a : a + 21], s[b : b + 21]
                if set(x + y) <= set("ACGT") and sum(p != q for p, q in zip(x, y, strict=True)) <= 1:
                    near.add((k, a, b))
                    break
    assert {tuple(r) for r in pairs.near_repeat_pairs(df).collect()} == near


def test_clusters(spark):
    starts = [0, 99, 199, 298, 500]
    found = clusters.number_pairs(spark.createDataFrame([(1, b, b + 30) for b in starts], pairs.PAIRS)).orderBy("begin_first").collect()
    assert [r["cluster_id"] for r in found] == [1, 1, 2, 2, 3]
    seq = "T" * 100 + "ACGTTGCA" * 5 + "C" * 600
    contig = spark.createDataFrame([(1, seq)], "contig_id long, seq string")
    rows = [(1, 1, 0, 50, 3, ["A" * 30]), (1, 2, 120, 160, 2, ["A" * 30]), (1, 3, 261, 300, 2, ["G" * 30]), (1, 4, 290, 320, 2, ["T" * 30])]
    merged = clusters.merge_neighbours(spark.createDataFrame(rows, "contig_id long, cluster_id long, begin long, end long, n_pairs long, repeats array<string>"), contig)
    assert [(r["begin"], r["end"], r["n_pairs"]) for r in merged.orderBy("begin").collect()] == [(0, 160, 5), (261, 320, 4)]


def test_columns(spark):
    rows = spark.createDataFrame([(1, 0, "AC-T"), (1, 1, "AG-T"), (1, 2, "AGC "), (2, 0, "TT")], "k int, row int, aligned string")
    found = {r["k"]: r for r in columns.consensus(rows, ["k"]).collect()}
    assert (found[1]["gapped"], found[1]["consensus"], found[2]["gapped"]) == ("AGCT", "AGCT", "TT")
    wrong = {(r["k"], r["row"]): tuple(r)[2:] for r in columns.mismatches(rows, columns.consensus(rows, ["k"]), ["k"]).collect()}
    assert wrong[1, 0] == (1, 0, 1) and wrong[1, 2] == (0, 0, 1) and wrong[2, 0] == (0, 0, 0)
    edges = {r["k"]: r["passes"] for r in columns.edge_dominance(rows, ["k"]).collect()}
    assert edges == {1: True, 2: False}
    assert {r["k"]: r["n_bad"] for r in columns.consistency(rows, ["k"]).collect()} == {1: 0, 2: 0}


@pytest.mark.parametrize(
    ("repeats", "spacers", "failed"),
    [
        (["A" * 21] * 3, ["C" + "G" * 17 + "T", "G" + "A" * 19 + "C"], set()),
        (["A" * 55] * 3, ["CA" + "G" * 16 + "A", "GA" + "A" * 19 + "C"], set()),
        (["A" * 20] * 3, ["C" * 20 + "T", "G" * 21], {"repeat_min"}),
        (["A" * 56] * 3, ["C" * 20 + "T", "G" * 21], {"repeat_max"}),
        (["A" * 30] * 2, ["C" * 20], {"min_repeats"}),
        (["A" * 30] * 3, ["C" * 18, "G" * 18], {"spacer_min"}),
        (["A" * 30] * 3, ["C" * 141, "G" * 20], {"spacer_max", "long_spacers"}),
        (["A" * 30] * 5, ["C" * 30, "C" * 30, "C" * 30, "G" * 30], set()),
        (["A" * 30] * 6, ["C" * 30, "C" * 30, "C" * 30, "C" * 30, "G" * 30], {"equal_spacers"}),
        (["A" * 30] * 3, ["C" * 30, "C" * 31], {"spacer_edges"}),
    ],
)
def test_array_filters(spark, repeats, spacers, failed):
    row = spark.createDataFrame([(repeats, spacers)], "repeats array<string>, spacers array<string>").select(*(c.alias(k) for k, c in A.checks().items())).first().asDict()
    assert {k for k, ok in row.items() if not ok} == failed


def test_routing(spark):
    rows = [(1, s, p, k) for k, (s, p) in enumerate([(0.9, True), (0.8, True), (0.8, False), (0.7, True), (0.65, False), (0.55, True), (0.4, True)])]
    rows += [(2, 0.74, True, 10), (2, 0.5, True, 11), (2, 0.49, True, 12), (3, 0.74, False, 20), (3, 0.6, True, 21)]
    df = spark.createDataFrame(rows, "region int, score double, passes boolean, k int")
    got = {r["k"]: r["category"] for r in routing.route(df, ["region"], "score", "passes", "k").collect()}
    assert got == {0: "bona_fide", 1: "alternative", 2: "low_score", 3: "alternative", 4: "low_score", 6: "low_score", 10: "possible", 11: "possible_discarded", 12: "low_score", 20: "low_score", 21: "possible_discarded"}
    assert routing.route(df, ["region"], "score", "passes", "k", keep_all=True).count() == 12
    kept = routing.filter_or_best(df, ["region"], F.col("score") >= 0.75, [F.desc("score"), F.col("k")]).collect()
    assert {r["k"] for r in kept} == {0, 1, 2, 10, 20}


def test_intervals_in_levels_of_bins(spark):
    rng = random.Random(12)
    spans = [(rng.choice("abc"), s, s + rng.choice([-3, 0, 5, 40, 3000, 10**6, 10**9])) for s in (rng.randrange(-2000, 5000) for _ in range(300))] + [("d", -(10**15), 10**15), ("a", 0, 10**9)]
    spots = [(k, rng.choice("abcde"), rng.randrange(-3000, 9000)) for k in range(400)] + [(400, "d", 10**14), (401, "d", -(10**16)), (402, "a", 10**9), (403, None, 5), (404, "a", None)]
    points = spark.createDataFrame(spots, "pid long, key string, pos long")
    ranges = spark.createDataFrame([(n, *x) for n, x in enumerate(spans)] + [(900, "a", None, 5), (901, None, 0, 9)], "iid long, key string, start long, end long")
    want = {(p, i) for p, k, at in spots for i, (key, s, e) in enumerate(spans) if k == key and at is not None and s <= at <= e}
    got = intervals.points_in_intervals(points, ranges, "key", "pos", "start", "end", 16).collect()
    assert len(got) == len(want) and {(r["pid"], r["iid"]) for r in got} == want
    for how, inside in (("left_semi", True), ("left_anti", False)):
        ids = [r["pid"] for r in intervals.points_in_intervals(points, ranges, "key", "pos", "start", "end", 16, how).collect()]
        assert sorted(ids) == sorted(p for p, *_ in spots if (p in {x for x, _ in want}) == inside)
    placed = intervals._placed(ranges, "start", "end", 16)
    assert placed.count() == sum(e >= s for _, s, e in spans) + 1, "an interval is one row, however long"
    none = ranges.limit(0)
    assert intervals.points_in_intervals(points, none, "key", "pos", "start", "end", 16).count() == 0 and intervals.points_in_intervals(points, none, "key", "pos", "start", "end", 16, "left_anti").count() == len(spots)


def test_intervals(spark):
    spans = spark.createDataFrame([("a", 10, 20), ("a", 100, 250), ("b", 0, 5)], "key string, start long, end long")
    points = spark.createDataFrame([("a", 9), ("a", 10), ("a", 20), ("a", 21), ("a", 180), ("b", 20)], "key string, pos long")
    inside = intervals.points_in_intervals(points, spans, "key", "pos", "start", "end", 16)
    assert {(r["key"], r["pos"], r["start"]) for r in inside.collect()} == {("a", 10, 10), ("a", 20, 10), ("a", 180, 100)}
    assert {(r["key"], r["pos"]) for r in intervals.points_in_intervals(points, spans, "key", "pos", "start", "end", 16, "left_anti").collect()} == {("a", 9), ("a", 21), ("b", 20)}
    assert {tuple(r) for r in intervals.gaps_between(spans, "key", "start", "end").collect()} == {("a", 1, None, 10), ("a", 2, 20, 100), ("a", 3, 250, None), ("b", 1, None, 0), ("b", 2, 5, None)}
    right = spark.createDataFrame([("a", 10_009, 1), ("a", -9_992, 2), ("a", 30_000, 3), ("c", 9, 4)], "key string, place long, rid long")
    near = {r["pos"]: (r["near"] and (r["near"]["rid"], r["near"]["distance"])) for r in intervals.nearest_within(points.where("key = 'a'"), right, "key", "pos", "place", "rid", 10_000).collect()}
    assert near == {9: (1, 10_000), 10: (1, 9_999), 20: (1, 9_989), 21: (1, 9_988), 180: (1, 9_829)}
    bounds = {r["start"]: (r["left_bound"], r["right_bound"]) for r in intervals.flanks(spans, "key", "start", "end", F.lit(50), F.lit(70)).collect()}
    assert bounds == {10: (-40, 70), 100: (50, 300), 0: (-50, 55)}


def test_nearest_interval_and_scores(spark):
    rng = random.Random(11)
    left = [(rng.choice("ab"), k, a := rng.randrange(2000), a + rng.randrange(300)) for k in range(40)]
    right = [(rng.choice("abc"), k, a := rng.randrange(2000), a + rng.randrange(300)) for k in range(30)]
    near = intervals.nearest_interval(spark.createDataFrame(left, "key string, n int, start long, end long"), spark.createDataFrame(right, "key string, rid int, s long, e long"), "key", ("start", "end"), ("s", "e"), "rid", 100)
    got = {r["n"]: r["near"] and (r["near"]["distance"], r["near"]["rid"]) for r in near.collect()}
    assert got == {n: min(((d, r) for c, r, s, e in right if c == key and (d := min(abs(a - e), abs(b - s))) <= 100), default=None) for key, n, a, b in left}
    rows = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "region int, n int")
    tables = {"orf": spark.createDataFrame([(1, 1, 0.5), (1, 1, 0.7)], "region int, n int, score double"), "hmm": spark.createDataFrame([(2, 1, 3.0), (9, 9, 1.0)], "region int, n int, score double")}
    assert {tuple(r) for r in intervals.with_scores(rows, ["region", "n"], tables).collect()} == {(1, 1, 0.7, 0.0), (1, 2, 0.0, 0.0), (2, 1, 0.0, 3.0)}
    turned = intervals.from_end(spark.createDataFrame([(3, 10, True), (3, 10, False)], "start int, end int, c boolean"), "start", "end", F.lit(100), F.col("c"))
    assert {tuple(r)[:2] for r in turned.collect()} == {(90, 97), (3, 10)}


def test_gaps_and_columns(spark):
    ints = lambda *xs: F.array(*map(F.lit, xs))
    assert one(spark, S.relative_places(ints(12, 15), F.lit(10))) == [2, 5]
    assert one(spark, S.unique_ends(ints(3, 3, 4, 3))) == [3, 4, 5, 6]
    assert one(spark, S.missing_gaps(ints(1, 2, 5), ints(2))) == [1, 5]
    assert one(spark, S.with_gaps(F.lit("ACGT"), ints(5, 2, -3))) == "-A-CG-T"[:5] + "-T"
    assert one(spark, S.with_gaps(F.lit("ACGT"), ints(2))) == "AC-GT"
    assert one(spark, S.without_empty_columns(F.array(F.lit("A -C- "), F.lit("AG-  -")))) == ["A C- ", "AG  -"]
    assert one(spark, S.mode_share(F.array(*map(F.lit, "abab" "b")))) == 0.6
    rows = spark.createDataFrame([(1, 1), (0, 1), (0, 0), (1, 1)], "p int, y int")
    assert tuple(scoring.accuracy(rows, "p", "y").first()) == (0.75, 4)
    near = scoring.adjacent_similarity(spark.createDataFrame([(1, 1, "A" * 20), (1, 2, "A" * 18)], "c int, o int, s string"), "c", "o", "s").first()
    assert (near["similarity"], near["coverage"]) == (pytest.approx(0.9), pytest.approx(0.9))


def test_kmer_codes():
    rng = random.Random(12)
    for k in (1, 2, 5, 21, 31):
        for n in (0, k - 1, k, 70):
            seq = "".join(rng.choices("ACGTACGTACGTN", k=n))
            want = [int("".join(str("ACGT".index(c)) for c in seq[a : a + k]), 4) if "N" not in seq[a : a + k] else -1 for a in range(n - k + 1)]
            assert pairs.kmer_codes(seq, k).tolist() == want


def test_kernel(spark):
    rows = spark.createDataFrame([("g", "ACGTAC"), ("g", "CATGCA"), ("one", "ACGT"), ("two", "AAAAAA"), ("two", "CCCCCC"), ("none", "")], "k string, s string")
    got = {r["k"]: r["similarity"] for r in kernel.mean_similarity(rows, ["k"], "s").collect()}
    assert got["g"] == pytest.approx(1) and got["one"] == 1 and got["two"] == pytest.approx(0) and "none" not in got  # a reversal is the same


def test_search_finds_planted_array(spark):
    rng = random.Random(3)
    repeat = "GTTTTAGAGCTATGCTGTTTTGAATGGTCC"
    spacers = ["".join(rng.choices("ACGT", k=32)) for _ in range(4)]
    body = "".join(repeat + s for s in spacers) + repeat
    body = body[:40] + body[40:].replace(repeat, repeat[:12] + "C" + repeat[13:], 1)
    left = "".join(rng.choices("ACGT", k=300))
    contig = left + body + "".join(rng.choices("ACGT", k=300))
    df = spark.createDataFrame([(1, contig)], "contig_id long, seq string")
    found = plan.array_report(df).collect()
    assert len(found) == 1 and found[0]["category"] == "bona_fide" and found[0]["number_of_spacers"] == 4
    assert abs(found[0]["start"] - 301) <= 3 and abs(found[0]["end"] - (300 + len(body))) <= 3
    hits = search.find_hits(contig, repeat)["hits"]
    assert [h["start"] for h in hits] == [300 + 62 * k for k in range(5)] and [h["s"] for h in hits] == [0, 1, 0, 0, 0]
    assert search.find_hits("", repeat)["hits"] == []
    assert search.align_all(["ACGT", "ACT", "AACGT"], "ACGT") in (["A CGT", "A C-T", "AACGT"], [" ACGT", " AC-T", "AACGT"])


def test_refinement():
    rng = random.Random(4)
    repeat, spacers = "GTTTTAGAGCTATGCTGTTTTGAATGGTCC", ["".join(rng.choices("ACGT", k=30)) for _ in range(4)]
    seq = "C" * 50 + "".join(repeat + s for s in spacers) + repeat + "C" * 50
    inner = refine.extend(seq, repeat, [repeat] * 2, [spacers[1]], [110, 170], 0, len(seq))
    assert inner == ([repeat] * 5, spacers, [50, 110, 170, 230, 290])
    assert refine.settle(repeat, [repeat + "A", "G" + repeat], ["CCC"], [0, 34]) == ([repeat, repeat], ["ACCCG"], [0, 35])


def test_scoring(spark):
    rows = spark.createDataFrame([("a", 0.8, 1), ("a", 0.2, 0), ("b", 0.5, 1), ("b", 0.5, 0), ("c", 0.1, 1), ("c", 0.3, 0)], "id string, p double, label int")
    assert {r["id"]: (r["strand"], r["confidence"]) for r in scoring.orientation(rows, "id", "p").collect()} == {"a": ("Forward", "High"), "b": ("Reverse", "Medium"), "c": ("Reverse", "Low")}
    left, right = (spark.createDataFrame([(x,) for x in xs], ["consensus"]) for xs in ("AB", "BC"))
    assert scoring.without_conflicts(left, right, "consensus").collect() == [("A",)]
    assert [r[0] for r in spark.createDataFrame([("CCATGAAATAGCC",), ("CTATTTCAT",), ("ACG",)], ["s"]).select(scoring.longest_orf(F.col("s"))).collect()] == [2, 2, 0]
    near = scoring.adjacent_similarity(spark.createDataFrame([(1, 1, "A" * 20), (1, 2, "A" * 19 + "C"), (1, 3, "G" * 20), (2, 1, "G" * 20)], "c int, o int, s string"), "c", "o", "s").collect()
    assert [(r["c"], r["o"], round(r["similarity"], 6)) for r in near] == [(1, 1, 0.95)]


def test_outliers(spark):
    rows = spark.createDataFrame([(1, k, n) for k, n in enumerate((30, 30, 31, 30, 30, 30))] + [(2, 0, 5), (2, 1, 9)], "a int, k int, n int")
    assert {(r["a"], r["k"]) for r in A.neighbour_outliers(rows, ["a"], "k", "n").where("suspicious").collect()} == {(1, 2), (2, 0), (2, 1)}


def test_more_repeats(spark):
    from spacerlake.operators import approximate

    rows = spark.createDataFrame([(1, ["GACGTACG", "ACGTACG", "ACGTAC"]), (2, ["AAAA", "CCC"])], "k int, repeats array<string>")
    found = {r["k"]: r for r in approximate.consensus_repeats(rows, ["k"]).collect()}
    assert set(found) == {1} and (found[1]["longest"], found[1]["shortest"]) == ("GACGTACG", "ACGTAC")
    more = {r["k"]: set(r["repeats"]) for r in approximate.with_consensus(rows, ["k"]).collect()}
    assert more[1] == {"GACGTACG", "ACGTACG", "ACGTAC", "GACGTAC"} and more[2] == {"AAAA", "CCC"}
    assert {r["k"]: set(r["repeats"]) for r in approximate.trimmed(rows, 1).collect()}[2] == {"AAAA", "AAA", "AA", "CCC", "CC", "C"}
    groups = rows.select("k", approximate.groups_by_containment(F.col("repeats")).alias("g")).collect()
    assert {r["k"]: r["g"] for r in groups} == {1: [["GACGTACG", "ACGTACG", "ACGTAC"]], 2: [["AAAA"], ["CCC"]]}
    assert {r["k"]: set(r["repeats"]) for r in approximate.completed(rows).collect()}[1] == {"GACGTACG", "ACGTACG", "ACGTAC", "GACGTAC"}


def test_surroundings_and_scores(spark):
    contig = spark.createDataFrame([(1, "AAACCCGGGT")], "contig_id long, seq string")
    rows = spark.createDataFrame([(1, 3, 6, "Forward"), (1, 1, 8, "Reverse"), (1, 0, 10, "Forward")], "contig_id long, start long, end long, strand string")
    assert {(r["start"], r["leader"], r["downstream"]) for r in A.surroundings(rows, contig, 3).collect()} == {(3, "AAA", "GGG"), (1, "AC", "T"), (0, "", "")}
    parts = spark.createDataFrame([(1, 0, "AAA", "CC"), (1, 1, "AA", None), (2, 0, None, "C")], "k int, n int, r string, s string")
    assert {tuple(r) for r in A.repeat_intervals(parts, ["k"], "n", "r", "s").collect()} == {(1, 0, 0, 3), (1, 1, 5, 7), (2, 0, 0, 0)}
    rng = random.Random(9)
    scored = [(rng.choice([0.1, 0.2, 0.3, 0.4]), rng.randrange(2)) for _ in range(60)]
    pairs_ = [(a > b) + (a == b) / 2 for a, x in scored for b, y in scored if x == 1 and y == 0]
    assert scoring.ranking_auc(spark.createDataFrame(scored, "s double, y int"), "s", "y").first()["auc"] == pytest.approx(sum(pairs_) / len(pairs_))
    halves = scoring.split(spark.range(4000), "id", 0.25)
    assert 850 < halves.where("train").count() < 1150
    aligned = spark.createDataFrame([(1, 0, "AAC"), (1, 1, "AGC"), (1, 2, "AGT")], "k int, row int, aligned string")
    assert columns.ambiguous_consensus(aligned, ["k"]).first()["consensus"] == "ARY"
    asked, known = spark.createDataFrame([("q", "ACGTACGTTT"), ("none", "CCCCCCCC")], "query string, seq string"), spark.createDataFrame([("k", "GGACGTACGT"), ("l", "ACGTACAAAA")], "known string, seq string")
    assert {tuple(r) for r in scoring.seed_scores(asked, known, "query", "known").collect()} == {("q", 11, "k"), ("none", 0, None)}


def test_searches_find_all(spark):
    repeat = "GTTTTAGAGCTATGCTGTTTTGAATGGTCC"
    window = "".join(repeat + "ACGT" * k for k in range(5, 60))
    assert len(search.find_hits(window, repeat)["hits"]) == 55
    found = search.fuzzy_search(spark.createDataFrame([(window, repeat), (None, repeat), ("A", "")], "window string, pattern string"))
    assert found.columns == ["window", "pattern", "hits"] and sorted(len(r["hits"]) for r in found.collect()) == [0, 0, 55]
    rows = spark.createDataFrame([(1, window, [repeat] + [repeat[:-1] + c for c in "AGT"] + ["ACGTACGT" + str(k) for k in range(200)]), (2, None, [repeat]), (3, "A", []), (4, "A", None)], "k int, window string, repeats array<string>")
    got = search.search_strings(rows).collect()
    assert len(got) == 205 and {(r["k"], r["pattern"]): len(r["hits"]) for r in got}[1, repeat] == 55


def test_regions_merge_and_expand(spark):
    rng = random.Random(11)
    repeat, other = "GTTTTAGAGCTATGCTGTTTTGAATGGTCC", "".join(rng.choices("ACGT", k=150))
    spacers = ["".join(rng.choices("ACGT", k=32)) for _ in range(4)]
    half = repeat + spacers[0] + repeat
    contig = other + half + spacers[1] + half[:20] + spacers[2] + repeat + spacers[3] + repeat + other[::-1]
    df = spark.createDataFrame([(1, contig), (2, ""), (3, None)], "contig_id long, seq string")
    found = plan.regions(df).collect()
    assert len(found) == 1 and abs(found[0]["begin"] - 150) <= 2  # a letter put in may be followed by a chance letter
    assert {repeat[1:-2], repeat[3:-3], repeat[:-1]} <= set(found[0]["repeats"])  # trims of the pattern
    rows = plan.searches(df).collect()
    assert sorted(r["pattern"] for r in rows) == found[0]["repeats"]
    assert all(r["window"] == contig[r["window_start"] : r["window_end"]] for r in rows)
    few = plan.regions(df, expanded=False).collect()
    assert set(few[0]["repeats"]) < set(found[0]["repeats"])


def test_copies_are_not_aligned(monkeypatch):
    """Texts equal to their pattern aren't aligned, others once; and blanks stand where another has letters put in."""
    import pandas as pd

    pattern, asked, make = "ACGTTGCAAC", [], search.align_pairs
    texts = [[pattern, "ACGTTTGCAAC", "ACGTGCAAC", "GACGTTGCAACT"], [pattern] * 3, ["ACGTGCAAC", "TTTTTTTTTT"], []]
    cells = [make(xs, [pattern] * len(xs)) for xs in texts]
    want = []
    for rows in cells:
        widths = [max(len(r[k]) for r in rows) for k in range(2 * len(pattern) + 1)] if rows else []
        want.append(["".join(r[k].ljust(w) for k, w in enumerate(widths)) for r in rows])

    def counting(xs, ps):
        asked.extend(zip(xs, ps, strict=True))
        return make(xs, ps)

    monkeypatch.setattr(search, "align_pairs", counting)
    assert search._aligned(pd.Series(texts), pd.Series([pattern] * 4)).tolist() == want
    assert len(asked) == len(set(asked)) == 4 and all(x != p for x, p in asked)


def test_letters_are_counted_without_regular_expressions(spark):
    from spacerlake.functions import sequence

    rows = ["", None, "AATTCG", "NNAN", "aA-T\n", "GGGG", "ÄA€T"]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(rows)], "k long, s string").repartition(2)
    told = df.select("k", sequence.base_count(F.col("s"), "AT").alias("n"), sequence.at_richness(F.col("s")).alias("r"))
    got = {r["k"]: (r["n"], r["r"]) for r in told.collect()}
    for k, x in enumerate(rows):
        known = sum((x or "").count(c) for c in "ACGT")
        assert got[k] == (None if x is None else sum(x.count(c) for c in "AT"), sum(x.count(c) for c in "AT") / known if known else 0.0)
    assert "regexp" not in told._jdf.queryExecution().executedPlan().toString().lower()
