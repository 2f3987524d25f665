"""Quality rules by weak supervision: rules vote or abstain, expectation-maximisation estimates their accuracies, a posterior decides.

A text's counts (words, lines, marks, repeated windows of words) come from one pass. Each rule of RULES votes good, bad, or abstains on
them. Texts are grouped by their votes: with K rules there are at most 3^K patterns whatever the number of texts, and only these and how
often each occurs go to the driver. Expectation-maximisation over them estimates the share of good texts and, for each rule, how often it votes good
on good and on bad texts when it votes; an abstention says nothing. Texts that fail the base conditions are decided already and aren't learnt from. Votes being independent given the class, the posterior's log odds are a
sum of one weight for each vote, which Spark adds up as an expression. A text is kept where the base conditions hold and its posterior is
at least KEEP, so no rule alone drops a text.

Words are runs of characters other than space and U+0009 to U+000D, lines are cut at \\n. n_repeat_words counts words in windows of WINDOW words that stand
twice or more in the text, told by exact ranks (pairs of pairs of pairs of words), not by hashes.

Defined results: a null or empty text has no words, so it fails the base conditions; doc_id may be null or repeat, rows are judged one by one, and repeated
rows get the same verdict; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import slices, stored, table

WINDOW = 8
KEEP = 0.5
#: Rounds of expectation-maximisation, and counts that stand for what is believed of a rule beforehand: right votes and wrong ones.
ROUNDS, RIGHT, WRONG = 60, 8, 2
START = {"share": 0.8, "good": 0.9, "bad": 0.4}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_different", "n_capitals", "n_letters", "n_plain", "n_odd", "n_ends", "n_exclaims", "n_same"]
#: Conditions that are not left to votes.
BASE_FAILED = "n_words < 20 OR 100 * n_repeat_words > 30 * n_words"


@dataclass(frozen=True)
class Rule:
    """Votes bad or good where the condition (SQL over the counts) holds, and abstains elsewhere."""

    name: str
    bad: str
    good: str


RULES = [
    Rule("symbols", "10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    Rule("letters", "100 * n_plain < 85 * word_chars", "100 * n_plain >= 93 * word_chars"),
    Rule("endings", "10 * n_odd > n_words", "50 * n_odd <= n_words"),
    Rule("capitals", "10 * n_capitals > 3 * n_letters", "10 * n_capitals <= n_letters"),
    Rule("exclamations", "10 * n_exclaims > 2 * n_words", "50 * n_exclaims <= n_words"),
    Rule("repeats", "100 * n_repeat_words > 20 * n_words", "100 * n_repeat_words <= 5 * n_words"),
    Rule("lines", "n_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines", "n_lines >= 3 AND 20 * n_dup_lines <= n_lines"),
    Rule("word length", "word_chars < 2 * n_words OR word_chars > 12 * n_words", "word_chars >= 3 * n_words AND word_chars <= 10 * n_words"),
    Rule("variety", "n_words < 500 AND 4 * n_different < n_words", "5 * n_different >= 2 * n_words"),
    Rule("stutter", "10 * n_same > 2 * n_words", "20 * n_same <= n_words"),
    Rule("sentences", "n_words >= 60 AND 60 * n_ends < n_words", "30 * n_ends >= n_words"),
]


def _bytes_of(letters: bytes) -> np.ndarray:
    found = np.zeros(256, bool)
    found[np.frombuffer(letters, np.uint8)] = True
    return found


_SPACE, _SYMBOL, _CAPITAL = _bytes_of(b" \t\n\v\f\r"), _bytes_of(b"#*$%&|<>"), _bytes_of(bytes(range(65, 91)))
_LETTER, _END = _CAPITAL | _bytes_of(bytes(range(97, 123))), _bytes_of(b".!?")
#: Letters and digits of any script; and what words may end in besides.
_PLAIN = _LETTER | _bytes_of(b"0123456789") | _bytes_of(bytes(range(128, 256)))
_USUAL_END = _PLAIN | _bytes_of(b".,;:!?)\"'-")


def _pieces(lists: pa.ListArray, kept) -> tuple[np.ndarray, np.ndarray]:
    """(row, number) of the pieces that kept() takes: equal strings have equal numbers."""
    flat, row = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
    keep = kept(flat)
    numbers = flat.filter(keep).dictionary_encode().indices.to_numpy()
    return row[keep.to_numpy(zero_copy_only=False)].astype(np.int64), numbers.astype(np.int64)


def repeat_words(row: np.ndarray, words: np.ndarray, rows: int, window: int = WINDOW) -> np.ndarray:
    """Words of each row in windows of so many words (a power of two) that stand twice or more in it; words are numbers, sorted by row."""
    n, ranks, size = len(words), words, 1
    while size < window and len(ranks) > size:  # ranks of runs of 1, 2, 4, ... words from each place on
        ranks = np.unique(ranks[:-size] * (n + 1) + ranks[size:], return_inverse=True)[1]
        size *= 2
    places = np.arange(max(0, n - window + 1))
    places = places[row[places] == row[places + window - 1]] if size == window else places[:0]
    _, which, often = np.unique(ranks[places] * rows + row[places], return_inverse=True, return_counts=True)
    found = places[often[which] > 1]
    edges = np.zeros(n + window + 1, np.int64)
    np.add.at(edges, found, 1)
    np.add.at(edges, found + window, -1)
    return np.bincount(row[np.cumsum(edges)[:n] > 0], minlength=rows)


def count_texts(texts: pa.StringArray) -> dict[str, np.ndarray]:
    """COUNTS of each text; none is null."""
    rows = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + rows + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    space = _SPACE[data]
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    ends = ~space & np.append(space[1:], True) | ~space & border[1:]  # the last byte of each word

    def counted(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask)])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    row, words = _pieces(pc.ascii_split_whitespace(texts), lambda x: pc.not_equal(x, ""))
    line_row, lines = _pieces(pc.split_pattern(texts, "\n"), lambda x: pc.not_equal(pc.ascii_trim_whitespace(x), ""))
    n_lines = np.bincount(line_row, minlength=rows)

    def different(row: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        pairs = np.unique(row * (numbers.max(initial=0) + 1) + numbers)
        return np.bincount(pairs // (numbers.max(initial=0) + 1), minlength=rows)

    return {
        "n_words": np.bincount(row, minlength=rows), "word_chars": counted(~space & ((data & 0xC0) != 0x80)), "n_symbols": counted(_SYMBOL[data]),
        "n_dup_lines": n_lines - different(line_row, lines), "n_repeat_words": repeat_words(row, words, rows), "n_lines": n_lines, "n_different": different(row, words),
        "n_capitals": counted(_CAPITAL[data]), "n_letters": counted(_LETTER[data]), "n_plain": counted(_PLAIN[data] & ((data & 0xC0) != 0x80)), "n_odd": counted(ends & ~_USUAL_END[data]), "n_ends": counted(ends & _END[data]), "n_exclaims": counted(ends & (data == ord("!"))),
        "n_same": np.bincount(row[1:][(words[1:] == words[:-1]) & (row[1:] == row[:-1])], minlength=rows),
    }


def text_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, COUNTS) of every row of (doc_id, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = count_texts(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[c].astype(np.int64)) for c in COUNTS)], names=["doc_id", *COUNTS])

    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return own.mapInArrow(count, ", ".join(f"{c} bigint" for c in ["doc_id", *COUNTS]))


def votes(rules: list[Rule]) -> list[Column]:
    """1 good, -1 bad, 0 abstains; bad goes first."""
    return [F.when(F.expr(r.bad), -1).when(F.expr(r.good), 1).otherwise(0).cast("int").alias(f"vote_{k}") for k, r in enumerate(rules)]


@dataclass
class Accuracies:
    """The share of good texts, and each rule's chance to vote good on good and on bad texts when it votes."""

    share: float
    good: np.ndarray
    bad: np.ndarray

    @property
    def bias(self) -> float:
        return math.log(self.share / (1 - self.share))

    @property
    def weights(self) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of each rule's vote: good, bad."""
        return np.log(self.good / self.bad), np.log((1 - self.good) / (1 - self.bad))


def estimate(patterns: np.ndarray, often: np.ndarray, rounds: int = ROUNDS) -> Accuracies:
    """Expectation-maximisation over vote patterns (a row each, votes 1, -1, 0) and how often each occurs."""
    k = patterns.shape[1]
    now = Accuracies(START["share"], np.full(k, START["good"]), np.full(k, START["bad"]))
    up, down = (patterns == 1).astype(float), (patterns == -1).astype(float)
    for _ in range(rounds):
        for_good, for_bad = now.weights
        good = often / (1 + np.exp(-(now.bias + up @ for_good + down @ for_bad)))
        bad = often - good
        now = Accuracies(
            (good.sum() + RIGHT) / (often.sum() + RIGHT + WRONG), (good @ up + RIGHT) / (good @ (up + down) + RIGHT + WRONG), (bad @ up + WRONG) / (bad @ (up + down) + RIGHT + WRONG)
        )
    return now


def posterior(accuracies: Accuracies, rules: list[Rule]) -> Column:
    """The chance that a text with the columns vote_k is good."""
    odds = F.lit(accuracies.bias)
    for k, (up, down) in enumerate(zip(*accuracies.weights, strict=True)):
        vote = F.col(f"vote_{k}")
        odds = odds + F.when(vote == 1, float(up)).when(vote == -1, float(down)).otherwise(0.0)
    assert len(rules) == len(accuracies.good)
    return 1 / (1 + F.exp(-odds))


def judge(docs: DataFrame, rules: list[Rule] = RULES, keep: float = KEEP) -> DataFrame:
    """(doc_id, COUNTS, vote_0, ..., base_failed, quality, kept) of every row of (doc_id, text)."""
    counted = stored(text_counts(docs), "text-counts")
    voted = counted.select("*", *votes(rules))
    names = [f"vote_{k}" for k in range(len(rules))]
    # at most 3^K rows
    found = voted.where(f"NOT ({BASE_FAILED})").groupBy(*names).agg(F.count("*").alias("n")).orderBy(*names).collect()
    accuracies = estimate(np.array([[r[c] for c in names] for r in found]).reshape(-1, len(rules)), np.array([float(r["n"]) for r in found]))
    judged = voted.withColumns({"base_failed": F.expr(BASE_FAILED), "quality": posterior(accuracies, rules)})
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= keep))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("quality", 6).alias("quality"))


def _em_sql() -> str:
    """The same rounds as a recursive query: one row of parameters, and the patterns."""
    k = range(len(RULES))
    odds = " + ".join(f"CASE vote_{j} WHEN 1 THEN ln(g{j} / b{j}) WHEN -1 THEN ln((1 - g{j}) / (1 - b{j})) ELSE 0 END" for j in k)
    start = ", ".join(f"CAST({START['good']} AS DOUBLE) AS g{j}, CAST({START['bad']} AS DOUBLE) AS b{j}" for j in k)
    step = ", ".join(
        f"(coalesce(sum(r) FILTER (vote_{j} = 1), 0) + {RIGHT}) / (coalesce(sum(r) FILTER (vote_{j} <> 0), 0) + {RIGHT + WRONG}), (coalesce(sum(n - r) FILTER (vote_{j} = 1), 0) + {WRONG}) / (coalesce(sum(n - r) FILTER (vote_{j} <> 0), 0) + {RIGHT + WRONG})" for j in k
    )
    cast = ", ".join(f"CASE WHEN {r.bad} THEN -1 WHEN {r.good} THEN 1 ELSE 0 END AS vote_{j}" for j, r in enumerate(RULES))
    names = ", ".join(f"vote_{j}" for j in k)
    return f"""voted AS (SELECT *, {cast} FROM counted), pats AS (SELECT {names}, CAST(count(*) AS DOUBLE) AS n FROM voted WHERE NOT ({BASE_FAILED}) GROUP BY ALL),
em AS (SELECT 0 AS round, CAST({START['share']} AS DOUBLE) AS s, {start} UNION ALL
  SELECT round + 1, (sum(r) + {RIGHT}) / (sum(n) + {RIGHT + WRONG}), {step}
  FROM (SELECT *, n / (1 + exp(-(ln(s / (1 - s)) + {odds}))) AS r FROM em, pats WHERE round < {ROUNDS}) GROUP BY round),
judged AS (SELECT *, 1 / (1 + exp(-(ln(s / (1 - s)) + {odds}))) AS q FROM voted, (SELECT * FROM em WHERE round = {ROUNDS}))"""


_SPACES = r"\x20\x09-\x0D"
OP13_SQL = rf"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^{_SPACES}]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{_SPACES}]')) AS ls FROM d),
win AS (SELECT rid, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS x FROM (SELECT rid, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w)),
rep AS (SELECT rid, count(DISTINCT i + o) AS n FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, x) AS c FROM win), range({WINDOW}) t(o) WHERE c > 1 GROUP BY rid),
counted AS (SELECT doc_id, len(ws) AS n_words, len(regexp_replace(t, '[{_SPACES}]', '', 'g')) AS word_chars, len(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(ls) AS n_lines, len(list_distinct(ws)) AS n_different,
  len(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_capitals, len(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS n_letters,
  len(regexp_replace(t, '[^A-Za-z0-9\x{{80}}-\x{{10FFFF}}]', '', 'g')) AS n_plain, len(list_filter(ws, lambda x: regexp_matches(x, '[\x21-\x7E\x00-\x1F\x7F]$') AND NOT regexp_matches(x, '[A-Za-z0-9.,;:!?)"''-]$'))) AS n_odd,
  len(list_filter(ws, lambda x: regexp_matches(x, '[.!?]$'))) AS n_ends, len(list_filter(ws, lambda x: ends_with(x, '!'))) AS n_exclaims, len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS n_same FROM w LEFT JOIN rep USING (rid)),
{_em_sql()}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {BASE_FAILED} AS base_failed, NOT ({BASE_FAILED}) AND q >= {KEEP} AS kept, round(q, 6) AS quality FROM judged
"""
