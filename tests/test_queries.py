"""Queries' inner steps on small inputs."""

from spacerlake.plans import more_queries


def test_lines_are_whole(spark):
    docs = spark.createDataFrame([(1, "a" * 200 + "\n\n" + "b" * 100)], "doc_id long, text string")
    assert more_queries.line_shapes(docs).first()["avg_spacer_len"] == 150


def test_table_functions(spark):
    from spacerlake.functions import tables
    from spacerlake.operators import search

    tables.register(spark)
    repeat = "GTTTTAGAGCTATGCTGTTTTGAATGGTCC"
    window = "ACGTACGTAA".join([repeat, repeat[:9] + "A" + repeat[10:], repeat])
    rows = [(1, 1, window, repeat), (1, 1, window, repeat[2:]), (2, 1, None, repeat), (2, 2, window, None)]
    spark.createDataFrame(rows, "contig_id long, cluster_id long, window string, pattern string").createOrReplaceTempView("asked")
    got = spark.sql("SELECT * FROM hits_in_windows(TABLE(asked) PARTITION BY (contig_id, cluster_id))").collect()
    want = {(1, 1, p, n, h["start"], h["end"], h["text"], h["s"], h["i"], h["d"]) for p in (repeat, repeat[2:]) for n, h in enumerate(search.find_hits(window, p)["hits"])}
    assert {tuple(r) for r in got} == want and len(got) == 6
    one = spark.sql("SELECT reverse_complement('AACg') AS r, base_share('AATG', 'AT') AS s, base_share('', 'A') AS e, base_share(NULL, 'A') AS n").first()
    assert (one["r"], one["s"], one["e"]) == ("cGTT", 0.75, 0.0)
    assert [r["w"] for r in spark.sql("SELECT w FROM substrings_holding('ABCDE', 2, 2)").collect()] == ["ABC", "ABCD", "ABCDE", "BCD", "BCDE"]
    assert spark.sql("SELECT w FROM substrings_holding(NULL, 2, 2)").count() == 0
