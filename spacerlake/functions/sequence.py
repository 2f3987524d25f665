"""Expressions over sequences, and over arrays of repeats and spacers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The IUPAC letters and their complements, and the letters that stand for two bases.
IUPAC, COMPLEMENTS = "ACGTUMRWSYKVHDBN", "TGCAAKYWSRMBDHVN"
TRANSITIONS = {"AT": "W", "CG": "S", "AC": "M", "GT": "K", "AG": "R", "CT": "Y"}
LETTERS, BASES = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGTACGTACGTACGTACGTACGTAC"


def dna_of(text: Column) -> Column:
    """The letters A-Z of a text, read cyclically as A, C, G, T; a null text is empty."""
    return F.translate(F.upper(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z]", "")), LETTERS, BASES)


def reverse_complement(seq: Column) -> Column:
    """Other characters, such as gaps, stay as they are."""
    return F.reverse(F.translate(seq, IUPAC, COMPLEMENTS))


def to_rna(seq: Column) -> Column:
    return F.translate(seq, "Tt", "Uu")


def canonical(seq: Column) -> Column:
    return F.regexp_replace(seq, "[^ACGT]", "N")


def base_count(seq: Column, letters: str) -> Column:
    left = seq
    for letter in letters:  # some times faster than a regular expression
        left = F.replace(left, F.lit(letter), F.lit(""))
    return F.length(seq) - F.length(left)


def at_richness(seq: Column) -> Column:
    """Share of A and T among A, C, G and T; 0 if there are none."""
    known = base_count(seq, "ACGT")
    return F.when(known > 0, base_count(seq, "AT") / known).otherwise(0.0)


def accession_name(header: Column) -> Column:
    """Header up to the first blank, without a version number; `, . |` become `-`."""
    return F.translate(F.regexp_replace(F.substring_index(header, " ", 1), r"\.[0-9]+$", ""), ",.|", "---")


def full_name(header: Column) -> Column:
    return F.translate(header, ",.| ", "____")


def end_trims(seq: Column, most: int = 3) -> Column:
    """The different strings left after dropping 0 to `most` characters at either end, themselves not empty."""
    ends = F.sequence(F.lit(0), F.lit(most))
    cut = F.transform(ends, lambda i: F.transform(ends, lambda j: F.substring(seq, i + 1, F.greatest(F.length(seq) - i - j, F.lit(0)))))
    return F.array_sort(F.filter(F.array_distinct(F.flatten(cut)), lambda x: F.length(x) > 0))


def substrings_around(seq: Column, at: Column, size: Column) -> Column:
    """The different substrings of more than `size` characters that hold the `size` characters at the 1-based place `at`."""
    firsts = F.sequence(F.lit(1), at)
    lasts = F.sequence(at + size - 1, F.length(seq))
    cut = F.transform(firsts, lambda i: F.transform(lasts, lambda j: F.substring(seq, i, j - i + 1)))
    return F.when(F.length(seq) >= at + size - 1, F.array_distinct(F.filter(F.flatten(cut), lambda x: F.length(x) > size))).otherwise(F.array().cast("array<string>"))


def characters(seq: Column) -> Column:
    return F.filter(F.split(seq, ""), lambda c: c != "")


def rendered_with_dots(seq: Column, consensus: Column) -> Column:
    """`.` where both agree, a blank where both are blank, else the sequence's own character. Null if the lengths differ."""
    shown = F.zip_with(characters(seq), characters(consensus), lambda a, b: F.when((a == b) & (a == " "), " ").when(a == b, ".").otherwise(a))
    return F.when(F.length(seq) == F.length(consensus), F.array_join(shown, ""))


def mean_length(xs: Column) -> Column:
    return F.when(F.size(xs) > 0, F.aggregate(xs, F.lit(0).cast("bigint"), lambda a, x: a + F.length(x)) / F.size(xs))


def interleaved(repeats: Column, spacers: Column) -> Column:
    """repeat, spacer, repeat, ..., last repeat."""
    return F.array_join(F.zip_with(repeats, spacers, lambda r, s: F.concat(F.coalesce(r, F.lit("")), F.coalesce(s, F.lit("")))), "")


def mode_share(xs: Column) -> Column:
    """Share of the most frequent value of an array; null if it is empty."""
    return F.when(F.size(xs) > 0, longest_run(F.array_sort(xs)) / F.size(xs))  # equal values stand together


def longest_run(xs: Column) -> Column:
    """Length of the longest run of equal neighbours."""
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most"))

    def step(a: Column, x: Column) -> Column:
        run = F.when(a["last"].eqNullSafe(x), a["run"] + 1).otherwise(1)
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(a["most"], run).alias("most"))

    return F.aggregate(xs, start, step, lambda a: a["most"])


def relative_places(places: Column, start: Column) -> Column:
    """Places of errors in a sequence, counted from a match's start."""
    return F.transform(places, lambda x: x - start)


def unique_ends(ends: Column) -> Column:
    """Each end, raised by 1 until no end before it has the value."""
    none = F.array().cast("array<int>")
    return F.aggregate(ends.cast("array<int>"), none, lambda a, x: F.concat(a, F.array(F.array_min(F.array_except(F.sequence(x, x + F.size(a)), a)))))


def missing_gaps(all_gaps: Column, own: Column) -> Column:
    """The gaps of the whole alignment that a row doesn't have itself."""
    return F.array_except(all_gaps, own)


def with_gaps(seq: Column, places: Column) -> Column:
    """The sequence with a "-" put in before each of the 0-based places, which count letters of the result; places below 0 count as 0."""
    ordered = F.array_sort(F.transform(places, lambda x: F.greatest(x, F.lit(0))))
    return F.aggregate(ordered, seq, lambda a, x: F.concat(F.substring(a, F.lit(1), x), F.lit("-"), F.substring(a, x + 1, F.length(a))))


def without_empty_columns(rows: Column) -> Column:
    """The rows of one alignment (array<string> of equal lengths) without columns that are all blanks or all "-"."""
    cells = F.transform(rows, characters)
    places = F.sequence(F.lit(0), F.greatest(F.length(rows[0]) - 1, F.lit(0)))
    kept = F.filter(places, lambda k: F.exists(cells, lambda r: F.get(r, k) != " ") & F.exists(cells, lambda r: F.get(r, k) != "-"))
    return F.transform(cells, lambda r: F.array_join(F.transform(kept, lambda k: F.get(r, k)), ""))


def evenness(lengths: Column) -> Column:
    """Entropy of lengths in bins with right-closed bounds 15, 25, 36, 52, 72 and above, as a share of ln 6, rounded to 6."""
    bins = F.transform(lengths, lambda n: F.when(n <= 15, 0).when(n <= 25, 1).when(n <= 36, 2).when(n <= 52, 3).when(n <= 72, 4).otherwise(5))
    shares = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda b: F.size(F.filter(bins, lambda x: x == b)) / F.size(lengths))
    return F.when(F.size(lengths) > 0, F.round(-F.aggregate(shares, F.lit(0.0), lambda a, p: a + p * F.log(p + F.lit(1e-8))) / F.log(F.lit(6.0)), 6)).otherwise(0.0)


def one_hot(seq: Column, length: int) -> Column:
    """Rows A, T, G, C of zeros and ones, padded or cut to a length; other characters are zero."""
    padded = characters(F.rpad(seq, length, "N"))

    def row(base: str) -> Column:
        return F.transform(padded, lambda c: (c == base).cast("tinyint"))

    return F.array(*map(row, "ATGC"))
