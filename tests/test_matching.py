"""Approximate matching and maximal repeats against dynamic programmes and brute force; bounds of the extension."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spacerlake.operators import matching, pairs, refine, search
from spacerlake.plans import arrays as plan
from spacerlake.plans import queries
from tests.conftest import DATA


def beginnings(text, string, most=matching.MOST):
    """{begin: (end, insertions, deletions, substitutions)} of the best match at each place.

    A table over (letters of the string, letters of the text) for all places at once; a cell is the set of reachable counts, the bit 16 i + 4 d + s for each.
    """
    ins, dels, subs, total = most
    n, m = len(text), len(string)
    counts = [(i, d, s) for i in range(4) for d in range(4) for s in range(4)]
    may = lambda test: np.uint64(sum(1 << k for k, c in enumerate(counts) if test(*c)))
    more = [may(lambda i, d, s: i < ins), may(lambda i, d, s: d < dels), may(lambda i, d, s: s < subs)]
    letters = np.array([*text, *"." * (m + ins + 1)])
    table = np.zeros((m + 1, m + ins + 2, n), np.uint64)
    table[0, 0] = 1
    for o in range(m + ins + 1):
        there = np.arange(n) + o < n
        for j in range(m + 1):
            here = table[j, o]
            if j < m:
                table[j + 1, o] |= (here & more[1]) << np.uint64(4)
                same = letters[o : o + n] == string[j]
                table[j + 1, o + 1] |= np.where(there, np.where(same, here, (here & more[2]) << np.uint64(1)), np.uint64(0))
                if j:
                    table[j, o + 1] |= np.where(there, (here & more[0]) << np.uint64(16), np.uint64(0))
    found = {}
    for p in np.flatnonzero(table[m, 1:].any(axis=0)).tolist():
        ends = [(sum(c), *c, p + o) for o in range(1, m + ins + 2) for k, c in enumerate(counts) if int(table[m, o, p]) >> k & 1 and sum(c) <= total]
        if ends:
            _, i, d, s, end = min(ends)
            found[p] = (end, i, d, s)
    return found


def told(x):
    return {int(a): (int(b), *map(int, c)) for a, b, c in zip(x.starts, x.ends, x.counts, strict=True)}


@pytest.mark.parametrize("most", [(3, 3, 3, 6), (1, 1, 1, 1), (0, 2, 1, 2), (2, 0, 3, 4)])
def test_matches_equal_a_dynamic_programme(most):
    rng = random.Random(sum(most))
    for _ in range(12):
        m = rng.choice([5, 9, 21])
        string = "".join(rng.choices("ACGT", k=m))
        near = string[: m // 2] + rng.choice(["", "A", "TT"]) + string[m // 2 + rng.choice([0, 1]) :]
        text = "".join(rng.choices("ACGTN", k=rng.randrange(0, 40))) + string + "".join(rng.choices("ACGT", k=9)) + near
        strings = [string, string[1:], string[:-1], "N" + string[2:], string]
        got = matching.match_all([text, text[:20], ""], [strings, [string], [string]], most)
        for s, x in zip(strings, got[0], strict=True):
            assert told(x) == (beginnings(text, s, most) if len(s) > most[1] else {})
        assert told(got[1][0]) == beginnings(text[:20], string, most) and told(got[2][0]) == {}


def test_long_strings_and_many_lanes(monkeypatch):
    monkeypatch.setattr(matching, "LANES", 5)
    rng = random.Random(2)
    strings = ["".join(rng.choices("ACGT", k=k)) for k in (64, 65, 128, 140, 30, 7)]
    text = "".join(s[: len(s) // 2] + "T" + s[len(s) // 2 :] for s in strings)
    got = matching.match_all([text] * 3, [strings[:k] for k in (6, 2, 4)])
    for xs in got:
        for s, x in zip(strings, xs, strict=False):
            best = x.best()
            assert x.counts[best].sum() <= 1 and text[x.starts[best] : x.ends[best]].replace("T", "").startswith(s[:5].replace("T", ""))
    assert [len(x) for x in got] == [6, 2, 4] and (got[0][1].starts == got[1][1].starts).all()


def test_hits_dont_overlap_and_give_way():
    repeat = "GTTTTAGAGCTATGCTGTTTTGAATGGTCC"
    text = "GG" + repeat[4:] + "A" + repeat + "CC" + repeat[:10] + "A" + repeat[10:]
    hits = search.find_hits(text, repeat)["hits"]
    assert (29, 59, 0) in [(h["start"], h["end"], h["s"] + h["i"] + h["d"]) for h in hits], "the exact copy wins over what overlaps it"
    assert all(a["end"] <= b["start"] for a, b in zip(hits, hits[1:], strict=False)) and (hits[-1]["i"], hits[-1]["text"]) == (1, text[61:])


def test_all_hits_of_the_query(spark):
    """Every hit of fuzzy_hits at the smallest size, told again by the dynamic programme."""
    contigs = {r["contig_id"]: r["seq"] for r in queries.contigs(spark, DATA).collect()}
    rows = plan.searches(queries.contigs(spark, DATA), expanded=False).collect()
    assert rows
    for r in rows:
        assert r["window"] == contigs[r["contig_id"]][r["window_start"] : r["window_end"]]
        want = beginnings(r["window"], r["pattern"])
        places, at, hits = sorted(want), 0, []
        while at < len(places):
            cost = lambda k: sum(want[places[k]][1:])
            while inside := [k for k in range(at + 1, len(places)) if places[k] < want[places[at]][0] and cost(k) < cost(at)]:
                at = min(inside, key=lambda k: (cost(k), k))
            p, (end, i, d, s) = places[at], want[places[at]]
            hits.append((p, end, r["window"][p:end], s, i, d))
            at = next((k for k in range(len(places)) if places[k] >= end), len(places))
        assert [tuple(h) for h in r["hits"]] == hits


# maximal repeats


def by_hand(seq, least, gap, reach):
    n, size, found = len(seq), (least - 1) // 2, set()

    def alike(x, y, step):
        k = 0
        while x < y and 0 <= x + step * k - (step < 0) and y + step * k - (step < 0) < n and seq[x + step * k - (step < 0)] == seq[y + step * k - (step < 0)] != "N":
            k += 1
        return k

    for d in range(1, reach + 2):
        s = 0
        while s + d < n:
            length = alike(s, s + d, 1)
            if length >= size:
                e, ways = s + length, [(s, s + d, length, length, 0, 1)]
                for a, b in ((1, 1), (0, 1), (1, 0)):
                    k = alike(e + a, e + d + b, 1)
                    ways.append((s, s + d, length + a + k, length + b + k, 1, k))
                    k = alike(s - a, s + d - b, -1) if s >= a else 0
                    ways.append((s - a - k, s + d - b - k, length + a + k, length + b + k, 1, k))
                good = [w for w in ways if w[5] and min(w[2:4]) >= least and gap[0] <= w[1] - w[0] - w[2] <= gap[1] and 1 <= w[1] - w[0] <= reach]
                if good:
                    found.add(max(good, key=lambda w: w[2] + w[3])[:5])
            s += length + 1
    return sorted(found)


def test_maximal_pairs_equal_brute_force():
    rng = random.Random(3)
    for _ in range(150):
        least, reach, kind = rng.choice([5, 7, 21]), rng.choice([20, 60, 300]), rng.random()
        seq = "".join(rng.choices("AC" if kind < 0.3 else "ACGTN", k=rng.randrange(0, 120)))
        repeat = rng.choices("ACGT", k=30)
        for _ in range(3 if kind > 0.4 else 0):
            own, at = list(repeat), rng.randrange(30)
            own[at : at + rng.choice([0, 1])] = rng.choice(["", "A", "C"])
            seq += "".join(own) + "".join(rng.choices("ACGT", k=rng.randrange(0, 40)))
        assert sorted(map(tuple, pairs.grown_pairs(seq, least, (-10, 100), reach).tolist())) == by_hand(seq, least, (-10, 100), reach)


def test_contigs_looked_at_together_stay_apart(spark):
    rng = random.Random(8)
    repeat = "".join(rng.choices("ACGT", k=30))
    seqs = [(k, rng.choice(["", repeat[3:], repeat[:-4], "ACGT" * 9, repeat + "A" + repeat[:22]]) + "".join(rng.choices("AC", k=rng.randrange(30)))) for k in range(200)]
    got = {}
    for r in pairs.maximal_pairs(spark.createDataFrame(seqs, "contig_id long, seq string")).collect():
        got.setdefault(r["contig_id"], []).append((r["begin_first"], r["begin_second"], r["length_first"], r["length_second"], r["edits"]))
    assert all(sorted(got.get(k, [])) == by_hand(s, pairs.K, pairs.GAP, pairs.REACH) for k, s in seqs) and got


def test_planted_insertions_are_found(spark):
    rng = random.Random(4)
    repeat = "GTTTTAGAGCTATGCTGTTTTGAATGGTCC"
    copies = [repeat, repeat[:14] + "A" + repeat[14:], repeat[:20] + repeat[21:], repeat[:9] + "T" + repeat[10:]]
    seq = "".join(c + "".join(rng.choices("ACGT", k=32)) for c in copies)
    rows = pairs.maximal_pairs(spark.createDataFrame([(1, seq), (2, None), (3, ""), (4, "ACGT")], "contig_id long, seq string")).collect()
    assert (0, 62, 30, 31, 1) in {(r["begin_first"], r["begin_second"], min(r["length_first"], 30), min(r["length_second"], 31), r["edits"]) for r in rows}
    assert {r["contig_id"] for r in rows} == {1} and all(seq[r["begin_first"] :].startswith(r["repeat"]) for r in rows)
    exact = pairs.repeat_pairs(spark.createDataFrame([(1, seq)], "contig_id long, seq string")).count()
    assert exact == 0, "no two copies have 21 equal letters: seeds without edits would find nothing"
    found = plan.detect(spark.createDataFrame([(1, seq)], "contig_id long, seq string")).where(F.size("repeats") == 4)
    assert found.count() > 0


# refinement


def test_array_is_matched_again():
    repeat, spacer = "GTTTTAGAGCTATGCTGTTTTGAATGGTCC", "ACGGATCCATTGCAAGCTTACGGATATCGC"
    seq = "C" * 20 + repeat + spacer + repeat + "C" * 20
    found = matching.match_all([seq], [[repeat]])[0][0]
    assert refine.rematched(found, seq, [repeat[3:], repeat[:-4]], [spacer], [23, 80]) == ([repeat] * 2, [spacer], [20, 80])
    assert refine.rematched(matching.match_all([seq], [["A" * 30]])[0][0], seq, [repeat], [], [20]) == ([repeat], [], [20])


def test_suspicious_spacers():
    assert refine.suspicious([30, 30, 31, 30, 30, 30]) == [2] and refine.suspicious([5, 9]) == [0, 1] and refine.suspicious([]) == []
    assert refine.suspicious([29, 30, 30, 30]) == [0] and refine.suspicious([30, 30, 30, 29]) == [3] and refine.suspicious([30, 31, 30]) == [1]


def test_neighbours_share_no_repeat(spark):
    """Two arrays of one repeat 300 letters apart, with a stray copy between them: each grows up to the middle of the gap at most."""
    rng = random.Random(5)
    other = lambda k: "".join(rng.choices("ACGT", k=k))
    repeat = "GTTTTAGAGCTATGCTGTTTTGAATGGTCC"
    array = lambda: "".join(repeat + other(32) for _ in range(4)) + repeat
    first, second = array(), array()
    gap = other(35) + repeat + other(170) + repeat + other(35)
    seq = other(200) + first + gap + second + other(200)
    contigs = spark.createDataFrame([(1, seq)], "contig_id long, seq string")
    begins = [200 + 62 * k for k in range(5)], [200 + len(first) + len(gap) + 62 * k for k in range(5)]
    rows = [(1, c, repeat, [repeat] * 5, [seq[b + 30 : b + 62] for b in at[:-1]], at, "k", 0, at[0], at[-1] + 30, 0.9, True, "bona_fide") for c, at in enumerate(begins)]
    schema = "contig_id long, cluster_id long, pattern string, repeats array<string>, spacers array<string>, starts array<int>, key string, edits int, start long, end long, score double, passes boolean, category string"
    routed = plan.A.features(spark.createDataFrame(rows, schema))
    done = {r["cluster_id"]: r for r in plan.refined(routed, contigs, plan.A.Limits()).collect()}
    assert len(done[0]["starts"]) == 6 and len(done[1]["starts"]) == 6, "each takes the stray copy on its own side"
    assert not set(done[0]["starts"]) & set(done[1]["starts"]) and done[0]["end"] <= done[1]["start"]
    middle = begins[0][-1] + 30 + len(gap) // 2
    assert done[0]["end"] <= middle <= done[1]["start"]
    near = seq[: 200 + len(first)] + other(20) + seq[-200 - len(second) :]
    second_at = 200 + len(first) + 20
    rows[1] = (*rows[1][:5], [second_at + 62 * k for k in range(5)], "k", 0, second_at, second_at + 278, 0.9, True, "bona_fide")
    alone = plan.refined(plan.A.features(spark.createDataFrame(rows, schema)), spark.createDataFrame([(1, near)], "contig_id long, seq string"), plan.A.Limits()).collect()
    assert [len(r["starts"]) for r in alone] == [5, 5]


# alignment


def test_alignments_have_least_edits():
    rng = random.Random(6)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
        return row[-1]

    pairs_ = [("".join(rng.choices("ACG", k=rng.randrange(0, 12))), "".join(rng.choices("ACG", k=rng.randrange(0, 12)))) for _ in range(300)] + [("", ""), ("A", ""), ("", "AC")]
    for (text, pattern), cells in zip(pairs_, search.align_pairs(*map(list, zip(*pairs_, strict=True))), strict=True):
        assert len(cells) == 2 * len(pattern) + 1 and "".join(cells).replace("-", "") == text and all(len(c) == 1 for c in cells[1::2])
        assert sum(len(c) if k % 2 == 0 else c != pattern[k // 2] for k, c in enumerate(cells)) == distance(text, pattern)


def test_families_with_shifted_insertions(spark):
    """Where each member has an insertion of its own, an alignment around one member makes a column for each; together they agree on the planted string."""
    from spacerlake.operators import approximate, multiple

    rng = random.Random(7)
    for _ in range(10):
        planted = "".join(rng.choices("ACGT", k=36))
        long = planted[:12] + "TTGACA" + planted[12:]  # two families: with six letters more, and without
        family = [planted[:k] + rng.choice("ACGT") + planted[k:] for k in (5, 20, 30)] + [planted] * 3 + [planted[3:], planted[:-2]]
        rows = multiple.align_together(family)
        assert len({len(r) for r in rows}) == 1 and [r.replace("-", "") for r in rows] == family
        columns_ = ["".join(c) for c in zip(*rows, strict=True)]
        agreed = "".join(max("ACGT-", key=c.count) for c in columns_).replace("-", "")
        assert agreed == planted
        both = multiple.align_together([*family, long, long[:-1], long[1:]])
        assert [r.replace("-", "") for r in both] == [*family, long, long[:-1], long[1:]] and max(map(len, both)) <= len(long) + 4
    assert multiple.align_together([]) == [] and multiple.align_together(["A", "A"]) == ["A", "A"] and multiple.align_together(["", "AC", "GG"])[1].replace("-", "") == "AC"
    rows = spark.createDataFrame([(1, family), (2, ["AC", "AC"])], "k int, repeats array<string>")
    found = approximate.consensus_repeats(rows, ["k"]).collect()
    assert [(r["k"], r["shortest"] in r["longest"]) for r in found] == [(1, True)]


# segment scores


def test_segments_equal_a_search_of_each_diagonal(spark):
    import math

    from spacerlake.operators import scoring

    scale, factor = scoring.score_statistics(0.25)
    assert abs(scale - 1.33) < 0.005 and abs(factor - 0.62) < 0.005, "the known values of equal letter frequencies"
    rng = random.Random(11)
    known = [(f"k{n}", "".join(rng.choices("ACGT", k=rng.randrange(0, 60)))) for n in range(12)] + [("kz", None)]
    queries_ = []
    for n in range(25):
        t = rng.choice(known[:12])[1]
        at = rng.randrange(len(t) + 1)
        own = list("".join(rng.choices("ACGT", k=5)) + t[at : at + 25] + "".join(rng.choices("ACGT", k=4)))
        own[rng.randrange(len(own))] = rng.choice("ACGT")
        queries_.append((f"q{n}", "".join(own)))
    queries_ += [("short", "ACG"), ("none", None)]
    got = {r["query"]: r for r in scoring.segment_scores(spark.createDataFrame(queries_, "query string, seq string"), spark.createDataFrame(known, "item string, seq string"), "query", "item").collect()}
    whole = "".join(t or "" for _, t in known)
    same = sum((whole.count(c) / len(whole)) ** 2 for c in "ACGT")
    scale, factor = scoring.score_statistics(same)
    assert abs(same * math.exp(scale) + (1 - same) * math.exp(-2 * scale) - 1) < 1e-12
    for q, text in queries_:
        best = None
        for k, t in known:
            if not text or not t:
                continue
            for d in range(-len(text) + 1, len(t)):
                places = [i for i in range(len(text)) if 0 <= i + d < len(t)]
                if not any(text[i : i + 6] == t[i + d : i + d + 6] and i + 6 <= len(text) and i + d + 6 <= len(t) for i in places):
                    continue
                own = None
                for x, a in enumerate(places):
                    score = 0
                    for b in places[x:]:
                        score += 1 if text[b] == t[b + d] else -2
                        key = (-score, b, -a)
                        own = key if own is None or key < own else own
                score, b, a = -own[0], own[1], -own[2]
                bits = (scale * score - math.log(factor)) / math.log(2)
                if len(text) * len(whole) * 2.0**-bits < 10:
                    key = (-score, k, a + 1, a + d + 1, b + 1, b + d + 1, bits)
                    best = key if best is None or key < best else best
        r = got[q]
        if best is None:
            assert (r["item"], r["score"], r["bits"], r["q_start"]) == (None, 0, 0.0, None)
        else:
            assert (-r["score"], r["item"], r["q_start"], r["k_start"], r["q_end"], r["k_end"]) == best[:6] and abs(r["bits"] - best[6]) < 1e-9
    assert sum(r["score"] > 0 for r in got.values()) > 15
    empty = spark.createDataFrame([], "item string, seq string")
    assert scoring.segment_scores(spark.createDataFrame(queries_, "query string, seq string"), empty, "query", "item").where("score = 0").count() == len(queries_)


def test_kinds_of_edits_are_counted_only_near_matches(monkeypatch):
    """The automaton with a state for each kind of edits passes over few of the letters: those that a plainer one finds near a match."""
    rng = random.Random(11)
    string = "".join(rng.choices("ACGT", k=48))
    copies = [string, string[:20] + string[23:], string[:5] + "TTT" + string[5:30] + string[31:], "A" + string[1:-1] + "C"]
    text = "".join("".join(rng.choices("ACGT", k=1500)) + x for x in copies)
    short = text[1400:1700]
    counted, scan = [], matching._scan

    def counting(block, codes, lanes, begins, sizes, *rest):
        counted.append(int(sizes.sum()))
        return scan(block, codes, lanes, begins, sizes, *rest)

    monkeypatch.setattr(matching, "_scan", counting)
    strings = [string, string[1:], string[2:-1], string[:-3]]
    got = matching.match_all([text, short], [strings, strings[:2]])
    assert sum(counted) < 0.1 * 3 * len(text)
    for w, own, found in ((text, strings, got[0]), (short, strings[:2], got[1])):
        for s, x in zip(own, found, strict=True):
            assert told(x) == beginnings(w, s)
    for x in matching.in_blocks([text, short], [strings, strings[:2]]):
        many, chosen = x.apart()
        at = 0
        for (w, k), a, n in zip(x.told, x.cuts.tolist(), many.tolist(), strict=False):
            assert (chosen[at : at + n] - a).tolist() == got[w][k].apart()
            at += n


def test_every_letter_replaced_or_left_out():
    """Matches of which little is there: of strings of four to seven letters at the ends of windows, with bounds of all kinds."""
    rng = random.Random(12)
    for most in [(3, 3, 3, 6), (0, 0, 0, 0), (0, 3, 3, 6), (3, 0, 1, 2), (2, 1, 0, 3)]:
        for _ in range(20):
            text = "".join(rng.choices("AC", k=rng.randrange(1, 25)))
            strings = ["".join(rng.choices("AC", k=rng.randrange(4, 8))) for _ in range(6)]
            for s, x in zip(strings, matching.match_all([text], [strings], most)[0], strict=True):
                assert told(x) == (beginnings(text, s, most) if len(s) > most[1] else {})


def test_parts_of_matches_without_copies(monkeypatch):
    """What refinement asks of matches in a part of a window is told from their lists, no part is copied."""
    rng = random.Random(21)
    cases = []
    for _ in range(300):
        starts = np.array(sorted(rng.sample(range(60), rng.randrange(0, 25))), np.int64)
        counts = np.array([[rng.randrange(2), rng.randrange(2), rng.randrange(4)] for _ in starts], np.int64).reshape(-1, 3)
        x = matching.Matches(starts, starts + 9 + counts[:, 0] - counts[:, 1], counts)
        low, high = sorted(rng.sample(range(-5, 80), 2))
        part = x.within(low, high)
        cases.append((x, low, high, part.starts[part.apart()].tolist(), None if part.best() is None else int(part.starts[part.best()])))
    flank = "".join(rng.choices("ACGT", k=900))
    consensus = flank[300:330]
    flank = flank[:380] + consensus + flank[410:500] + consensus[:12] + "G" + consensus[12:] + flank[530:]
    want = refine.extend(flank, consensus, [consensus], [], [300], 0, len(flank), margin=120)
    monkeypatch.setattr(matching.Matches, "within", None)
    for x, low, high, apart, best in cases:
        assert x.starts[x.apart(low, high)].tolist() == apart
        k = x.best_within(low, high)
        assert (None if k is None else int(x.starts[k])) == best
    assert refine.extend(flank, consensus, [consensus], [], [300], 0, len(flank), margin=120) == want and len(want[0]) == 3
    found = matching.match_all([flank], [[consensus]])[0][0]
    assert refine.rematched(found, flank, [consensus, consensus], [flank[330:380]], [300, 380])[2] == [300, 380]
