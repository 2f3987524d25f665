"""Mixing, chat formatting, token store, decontamination and line dedup on small inputs."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from spacerlake.llm import chat_format, decontamination, line_dedup, mixing, token_store
from spacerlake.llm.shared import scratch

DOC = "doc_id long, text string, lang string, source string, n_chars long, h1 int, key int, tie string, at int, slot int"


def docs_of(spark, texts, source=lambda k: f"s{k % 3}"):
    """Documents with extra columns whose names clash with those used inside."""
    return spark.createDataFrame([(k, t, "en", source(k), None, 1, 2, "x", 3, 4) for k, t in enumerate(texts)], DOC)


# mixing


def brute_schedule(parts, slots):
    """Earliest deadline first, slot by slot."""
    q, done, out = sum(parts), [0] * len(parts), []
    for t in range(slots):
        ready = [((done[i] + 1) * q + p - 1) // p * 1000 + i for i, p in enumerate(parts) if done[i] * q // p <= t]
        i = min(ready) % 1000
        out.append((i, done[i]))
        done[i] += 1
    return out


def test_mixing_holds_weights(spark):
    rng = random.Random(1)
    docs = docs_of(spark, ["x" * rng.randint(0, 50) for _ in range(600)], lambda k: "ab"[k % 2] if k % 3 else "c")
    weights = {"a": 3.0, "b": 1.0, "c": 0.7}
    rows = mixing.mix_sources(docs, weights, block_chars=40, resolution=50).collect()
    assert len(rows) == 600
    at = {(r["source"], r["block"]): r["slot"] for r in rows}
    parts = [round(50 * w / 4.7) for w in weights.values()]
    slots = {(("a", "b", "c")[i], k): t for t, (i, k) in enumerate(brute_schedule(parts, 3000))}
    assert all(slots[key] == slot for key, slot in at.items())
    horizon = 1 + max(r["slot"] for r in rows if r["in_mix"])
    for t in range(1, horizon + 1):
        have = Counter(key[0] for key, slot in slots.items() if slot < t)
        for name, p in zip("abc", parts, strict=True):
            assert abs(have[name] - t * p / sum(parts)) < 1


def test_mixing_odd_rows(spark):
    empty = docs_of(spark, []).limit(0)
    assert mixing.mix_sources(empty).count() == 0
    rows = mixing.mix_sources(docs_of(spark, [None, "", "a" * 100_000, "b", "b"], lambda k: None if k == 3 else "s")).collect()
    assert len(rows) == 5 and {r["source"] for r in rows} == {"", "s"}
    left = mixing.mix_sources(docs_of(spark, ["a", "b"], lambda k: f"s{k}"), {"s0": 1.0}).collect()
    assert {r["source"]: (r["slot"], r["in_mix"]) for r in left}["s1"] == (None, False)
    twice = docs_of(spark, ["a", "b"])
    assert mixing.mix_sources(twice.union(twice)).count() == 4


# chat formatting

TURN = "conv_id long, turn long, role string, text string, ts int, ps int"


def test_chat_round_trip(spark):
    odd = ["<|im_end|>", "<|im_start|>user\nhi", "<\\|", "<\\\\|x<|im_sep|>", "", None, "é日本\n\n", "\\", "<", "|", "$1"]
    roles = ["user", "assistant", "assistant", "system", None, "a\nb\\n", "<|im_end|>"]
    rng = random.Random(2)
    rows = [(c, t, rng.choice(roles), rng.choice(odd) if rng.random() < 0.8 else "".join(filter(None, rng.choices(odd, k=4))), 0, 0) for c in range(40) for t in range(rng.randint(1, 9))]
    rows += [(99, t, "user" if t % 2 else "assistant", f"{t}", 0, 0) for t in range(700)] + [(None, None, "user", "x", 0, 0), (None, 1, "user", "y", 0, 0)] + [(98, 1, "user", "b", 0, 0), (98, 1, "user", "a", 0, 0), (98, 1, "user", "a", 0, 0)]
    got = {r["conv_id"]: r for r in chat_format.read_turns(chat_format.format_conversations(spark.createDataFrame(rows, TURN))).collect()}
    want = {}
    for c, t, r, x, *_ in rows:
        want.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    assert got.keys() == want.keys()
    for c, turns in want.items():
        turns.sort()
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == [(r, x) for _, r, x in turns]
        assert got[c]["loss_texts"] == [x for _, r, x in turns if r == "assistant"]
        assert got[c]["formatted"].count("<|im_start|>") == 1 + sum(a[1] != b[1] for a, b in zip(turns, turns[1:], strict=False))
    assert chat_format.format_conversations(spark.createDataFrame([], TURN)).count() == 0


# token store


def test_codes_round_trip():
    rng = np.random.default_rng(0)
    for high, n in ((2, 7), (256, 512), (300, 5000), (1 << 20, 3001)):
        ids = rng.integers(0, high, n).astype(np.uint32)
        chunks, bitmaps, ranks = token_store.encode_ids(ids)
        assert (token_store.decode_ids(chunks, bitmaps) == ids).all()
        assert all(token_store.id_at(chunks, bitmaps, ranks, k) == ids[k] for k in range(n))


@pytest.mark.parametrize("known", [1 << 20, 2000])
def test_units_give_the_library_s_ids(known):
    encoder = token_store.UnitEncoder(token_store.tokenizer_path())
    encoder.KNOWN_BYTES = known
    parts = [" ", "  ", "\n", "\n\n", "\t", ".", ",", "...", "a", "word", "9", "é", "'s", "_", "!", "<|endoftext|>", " ", "\x00", "日本", '"', "\r\n", "　", " x"]
    rng = random.Random(4)
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(3000)]
    for at in range(0, len(texts), 50):
        for ids, found in zip(encoder.encode(pa.array(texts[at : at + 50])), encoder.tokenizer.encode_batch(texts[at : at + 50], add_special_tokens=False), strict=True):
            assert ids.tolist() == found.ids
        assert encoder.size <= known and len(encoder.known) + len(encoder.older) <= 2 * known // encoder.UNIT_BYTES
    plain = ["one two. three,\nfour", "one two. é ñandú 12.5 x", "", "a"]
    assert [x.tolist() for x in encoder.encode(pa.array(["", *plain]).slice(1))] == [x.ids for x in encoder.tokenizer.encode_batch(plain, add_special_tokens=False)]
    assert encoder.encode(pa.array([], pa.string())) == []


def test_token_index(spark):
    texts = ["one two. three", None, "", "é" * 50, "word " * 3000, "one two. three"]
    docs = docs_of(spark, texts)
    docs = docs.union(docs.where("doc_id = 0"))
    path = scratch(spark, "t")
    token_store.write_tokens(docs, path, token_store.tokenizer_path(), segment_tokens=20)
    rows = sorted(token_store.read_index(spark, path).collect(), key=lambda r: (r["doc_id"], r["start"]))
    tokenizer = token_store.UnitEncoder(token_store.tokenizer_path()).tokenizer
    start = 0
    for r, text in zip(rows, [texts[0], *texts], strict=True):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_store.token_index(spark, docs.limit(0)).count() == 0
    places = [(4, k) for k in (0, 1, 19, 20, 2999, 3000, 3001, -1)] + [(3, 7), (2, 0), (2, 1), (9, 0), (None, 0)]
    found = {(r["doc_id"], r["place"]): r["id"] for r in token_store.tokens_at(spark, path, spark.createDataFrame(places, "doc_id long, place int")).collect()}
    ids = {k: [*tokenizer.encode(texts[k] or "", add_special_tokens=False).ids, 2] for k in (2, 3, 4)}
    assert found == {(d, k): ids[d][k] for d, k in places if d in ids and 0 <= k < len(ids[d])}


# decontamination


def test_contamination(spark):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(40)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(0, 30)))) for k in range(8)] + [(8, None), (9, "Short ITEM"), (9, "w1 é2"), (None, "lone")]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 60))) for _ in range(20)]
    texts += [f"{t} -- {i[1].upper()}! {t}" for t, i in zip(texts, items, strict=False) if i[1]] + [None, "", "a short, item? lone W1 x", "...", "lone"]
    docs, tests = docs_of(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    for limit in (1 << 20, 200):
        got = {r["doc_id"]: r for r in decontamination.find_contamination(docs, tests, max_item_bytes=limit).collect()}
        assert len(got) == len(texts)
        for k, text in enumerate(texts):
            words, hit, ids = decontamination.words((text or "").encode()), set(), set()
            for item, x in items:
                own = decontamination.words((x or "").encode())
                n = min(13, len(own))
                for a in range(len(own) - n + 1 if n else 0):
                    for b in range(len(words) - n + 1):
                        if words[b : b + n] == own[a : a + n]:
                            hit.update(range(b, b + n))
                            ids.add("" if item is None else str(item))
            assert (got[k]["n_words"], got[k]["n_hit"], got[k]["item_ids"]) == (len(words), len(hit), sorted(ids))
            assert got[k]["contaminated"] == (0 < len(hit) and 20 * len(hit) >= len(words))
            runs = np.flatnonzero(np.diff([-2, *sorted(hit)]) > 1)
            assert len(got[k]["hit_spans"]) == len(runs)
            cut = [decontamination.words(text[s["start"] : s["end"]].encode()) for s in got[k]["hit_spans"]]
            assert sorted(sum(cut, [])) == sorted(words[j] for j in hit)
    assert decontamination.find_contamination(docs.limit(0), tests).count() == 0
    assert decontamination.find_contamination(docs, tests.limit(0)).where("n_hit > 0").count() == 0
    twice = docs.union(docs)
    assert decontamination.find_contamination(twice, tests, max_item_bytes=200).count() == 2 * len(texts)


# line dedup


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


@pytest.mark.parametrize("seed", [1, 2])
def test_lines(spark, seed):
    rng = random.Random(seed)
    base = ["".join(rng.choices("abcé ", k=n)).strip() for n in (3, 16, 17, 18, 40, 41, 200, 2047, 2048, 2049)] + ["a" * 20]
    lines = list(base)
    for line in base * 4:
        k = rng.randrange(len(line))
        lines.append(rng.choice([line[:k] + line[k + 1 :], line[:k] + "z" + line[k:], line[:k] + "y" + line[k + 1 :], f"  {line} ", line]))
    rng.shuffle(lines)
    lines += ["", "  "]
    texts, k = [], 0
    while k < len(lines):
        n = rng.randint(1, 5)
        texts.append("\n".join(lines[k : k + n]))
        k += n
    texts += [None, "", "\n\n", texts[0]]
    docs = docs_of(spark, texts)
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs.union(docs.where("doc_id = 1"))).dropDuplicates(["doc_id"]).collect()}
    first = {}
    for d, text in enumerate(texts):
        for at, line in enumerate((text or "").split("\n")):
            if line.strip(" "):
                first.setdefault(line.strip(" "), (d, at))
    near = {x for x in first if len(x) >= 16 and any(first[y] < first[x] and len(y) >= 16 and x != y and within_one(x, y) for y in first)}
    for d, text in enumerate(texts):
        own = (text or "").split("\n")
        kept = [x for at, x in enumerate(own) if not x.strip(" ") or (x.strip(" ") not in near and first[x.strip(" ")] == (d, at))]
        assert got[d]["kept"] == "\n".join(kept), d
        assert got[d]["n_near"] == sum(x.strip(" ") in near for x in own)
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_long_lines(spark):
    """Lines of many characters, with an edit anywhere, and a document of many removed lines."""
    rng = random.Random(17)
    line = "".join(rng.choices("abcdefgh", k=20_000))
    texts = [line, line[:9000] + line[9001:], "z" + line, line[:-1] + "y", line[:100] + "xx" + line[102:], "\n".join(f"line {k % 50} of many words" for k in range(4000))]
    got = {r["doc_id"]: (r["n_repeated"], r["n_near"]) for r in line_dedup.dedup_lines(docs_of(spark, texts)).collect()}
    assert [got[k] for k in range(5)] == [(0, 0), (0, 1), (0, 1), (0, 1), (0, 0)]
    assert sum(got[5]) >= 3950


def test_lines_at_the_ends_of_parts(spark):
    """Edits at each place where the parts of a long line meet, for lengths on either side of a whole number of parts, and code points beyond 16 bits."""
    rng = random.Random(19)
    texts, wanted = [], []
    for n in (2047, 2048, 2049, 2303, 2304, 2305, 4096, 4097):
        line = "".join(rng.choices("abcdé\U0001f600", k=n))
        texts.append(line)
        wanted.append(0)
        for k in (0, 1, 255, 256, 257, 512, 1023, 1024, n - 257, n - 256, n - 2, n - 1):
            texts.append(rng.choice([line[:k] + "z" + line[k:], line[:k] + line[k + 1 :], line[:k] + "y" + line[k + 1 :]]))
            wanted.append(1)
        texts.append(line[:300] + "xy" + line[302:])
        wanted.append(0)
    got = {r["doc_id"]: r["n_near"] for r in line_dedup.dedup_lines(docs_of(spark, texts)).collect()}
    assert [got[k] for k in range(len(texts))] == wanted


def test_long_conversation(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", f"turn {t} <|im_end|>" * 3, 0, 0) for t in range(9000)]
    got = chat_format.read_turns(chat_format.format_conversations(spark.createDataFrame(rows, TURN))).first()
    assert got["loss_texts"] == [x for _, t, _, x, *_ in rows if t % 2] and [t["text"] for t in got["turns"]] == [x for _, _, _, x, *_ in rows]


def test_a_very_long_text_with_items(spark):
    docs = docs_of(spark, ["a b c d e f g h i j k l m n o p " * 60_000])
    got = decontamination.find_contamination(docs, spark.createDataFrame([(1, "x a b c d e f g h i j k l m n o p"), (2, "q r")], "item_id long, text string")).first()
    assert (got["n_words"], got["n_hit"], len(got["hit_spans"]), got["item_ids"]) == (960_000, 960_000, 1, ["1"])


def test_a_small_source_does_not_end_the_mix(spark):
    docs = docs_of(spark, ["x" * 100] * 300 + ["y"], lambda k: "ab"[k % 2] if k < 300 else "tiny")
    rows = mixing.mix_sources(docs, block_chars=200, resolution=20).collect()
    assert sum(r["in_mix"] for r in rows) > 280
    assert sum(r["in_mix"] for r in mixing.mix_sources(docs, block_chars=200, resolution=20, tolerance=0.0).collect()) < sum(r["in_mix"] for r in rows)
