"""Readers, reports and the stream, on files made here."""

import json

from pyspark.sql import functions as F

from spacerlake.functions import sequence as S
from spacerlake.sources import fasta, writers
from spacerlake.streaming import ingest


def test_fasta(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.fa").write_text(">X.1 first\nacgt\nAC\n\n>X.2 second\r\nGG\r\n>Y\n\n")
    (tmp_path / "in/b.fa").write_text(">Z z\nTT")
    rows = fasta.read_fasta(spark, str(tmp_path / "in"))
    assert {(r["file"], r["header"], r["seq"]) for r in rows.collect()} == {("a.fa", "X.1 first", "ACGTAC"), ("a.fa", "X.2 second", "GG"), ("a.fa", "Y", ""), ("b.fa", "Z z", "TT")}
    assert sorted(r["name"] for r in fasta.named(rows).collect()) == ["X_1", "X_2", "Y", "Z"]
    assert sorted((r["name"], r["seq"]) for r in fasta.named(rows, keep="last").collect()) == [("X", "GG"), ("Y", ""), ("Z", "TT")]
    assert {r["file"]: r["is_multi"] for r in fasta.record_counts(rows).collect()} == {"a.fa": True, "b.fa": False}
    assert {r["file"]: r["seq"] for r in fasta.single_record(rows).collect()} == {"a.fa": "ACGTACGG", "b.fa": "TT"}


def test_tool_outputs(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    pairs = put("p.txt", "> 60 10 x y 95\n" + "A" * 60 + "\n> 21 7 x y 80\n" + "C" * 21 + "\n")
    assert [(r["begin_first"], r["begin_second"], r["length"], len(r["sequence"])) for r in fasta.read_pairs(spark, pairs).orderBy("begin_first").collect()] == [(7, 80, 21, 21), (10, 95, 55, 55)]
    orfs = put("o.txt", 'DEFINITION  seqnum=1;seqlen=9;seqhdr="1_9_0";x\nFEATURES\n     CDS             complement(3..50)\n                     /note="ID=1;conf=77.5;score=1"\n     CDS             60..90\n                     /note="conf=10;"\n')
    assert [tuple(r)[1:] for r in fasta.read_orfs(spark, orfs).orderBy("start").collect()] == [("1_9_0", 3, 50, True, 77.5), ("1_9_0", 60, 90, False, 10.0)]
    hmm = put("h.txt", "# x\n# y\nt1 - q - 1e-5 20.5 0\nt1 - q - 1e-9 33.0 0\nt2 - q - 0.1 5 0\n#\n")
    assert {tuple(r) for r in fasta.read_hmm_scores(spark, hmm).collect()} == {("t1", 33.0, 1e-9), ("t2", 5.0, 0.1)}
    scores = put("b.txt", "1\tx\t50.5\n1\ty\t99\n3\tz\t7\n")
    queries = spark.createDataFrame([("1",), ("2",), ("3",)], ["query"])
    assert {tuple(r) for r in fasta.read_alignment_scores(spark, scores, queries).collect()} == {("1", 50.5), ("2", 0.0), ("3", 7.0)}
    folds = put("f.txt", ">a\nACGU\n(..) ( -1.20)\n>b\nGG\n.. (0.00)\n")
    assert {tuple(r) for r in fasta.read_folds(spark, folds).collect()} == {("a", "ACGU", -1.2), ("b", "GG", 0.0)}
    genes = put("g.csv", "n,start,end,x,y,note\n0,5,90,.,.,Cas9_1\n1,100,120,.,.,other\n")
    assert {tuple(r) for r in fasta.read_genes(spark, genes).collect()} == {(5, 90, "Cas9_1")}
    cassettes, labels = put("c.csv", "n,5,90,a,b,c,k1\nn,100,150,a,b,c,k1\nn,7,9,a,b,c,k2\n"), put("l.csv", "n,k1,x,y,CAS-I\n")
    assert {tuple(r) for r in fasta.read_cassettes(spark, cassettes, labels).collect()} == {("k1", 5, 150, "CAS-I")}
    assert sorted(tuple(r) for r in fasta.read_repeats(spark, put("s.txt", "ACG\n\nTT\n")).collect()) == [("SAMPLE_1", "ACG"), ("SAMPLE_2", "TT")]
    assert {tuple(r) for r in fasta.read_repeats(spark, put("s.fa", ">a b\nacg\nTT\n>c\nGG\n")).collect()} == {("a b", "ACG"), ("c", "GG")}
    assert [tuple(r) for r in fasta.read_repeats(spark, put("s.tsv", "q\tACC\n")).collect()] == [("q", "ACC")]
    sample = spark.createDataFrame([("NC_1-prog_5_90-F",)], ["s"]).select(fasta.parse_id(F.col("s")).alias("p")).first()["p"]
    assert (sample["program"], sample["start"], sample["end"], sample["strand"]) == ("prog", 5, 90, "F")
    line = spark.createDataFrame([('{"repeat_begins":[1],"repeats":["A"],"repeats_gaped":["A"],"spacers":[]}',)], ["value"])
    assert fasta.read_candidates(line).first()["repeats"] == ["A"]


ARRAY = "contig_id string, id int, region_index int, category string, start long, end long, strand string, score double, consensus string, repeats array<string>, spacers array<string>, starts array<int>, cas_type string"


def arrays(spark):
    rows = [("c", 1, 1, "bona_fide", 10, 19, "Reverse", 0.9, "AAC", ["AAC", "AAT"], ["GGG"], [10, 16], "I"), ("c", 2, 2, "possible", 40, 49, "Forward", 0.6, "TTT", ["TTT", "TTT"], ["CCC"], [40, 46], None), ("d", 1, 1, "low_score", 0, 3, None, 0.1, "A", ["A"], [], [0], None)]
    return spark.createDataFrame(rows, ARRAY)


def test_reports(spark, tmp_path):
    df = arrays(spark)
    writers.write_summary(df, str(tmp_path / "summary"))
    back = spark.read.csv(str(tmp_path / "summary"), header=True)
    assert back.columns == ["Name", *writers.SUMMARY]
    assert [(r["ID"], r["Start"], r["End"], r["Length"], r["Consensus repeat"]) for r in back.orderBy("ID").collect()] == [("1", "11", "19", "9", "GTT"), ("2", "41", "49", "9", "TTT")]
    writers.write_fasta(writers.fasta_records(df), str(tmp_path / "spacers"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "spacers")).collect())[:2] == [">c_bona_fide_11_19_AAC_1", ">c_possible_41_49_TTT_1"]
    assert {r["seq"] for r in writers.fasta_records(df, "arrays").collect()} == {"AACGGGAAT", "TTTCCCTTT", "A"}
    documents = {r["contig_id"]: json.loads(r["document"]) for r in writers.array_json(df).collect()}
    one = documents["c"]["Arrays"]["bona_fide"]["1"]
    assert (one["start"], one["end"], one["length"], one["list_repeat_starts"]) == (11, 19, 9, [11, 17]) and "..T" in one["dot_representation"]
    lines = {r["value"].split("\t")[8]: r["value"].split("\t")[3:7] for r in writers.gff_lines(df).where("value LIKE 'c%'").collect()}
    assert lines["ID=array_c_1"] == ["11", "19", "0.9", "-"] and lines["ID=array_c_1_binding_site_1;Parent=array_c_1"][:2] == ["14", "16"] and len(lines) == 8
    writers.write_text_reports(df, str(tmp_path / "text"))
    writers.write_categories(df, str(tmp_path / "all"))
    writers.write_json(df, str(tmp_path / "json"))
    writers.write_by_cassette(df, str(tmp_path / "cas"))
    assert spark.read.parquet(str(tmp_path / "all")).count() == 3 and spark.read.csv(str(tmp_path / "cas"), header=True).count() == 1
    writers.write_strands(spark.createDataFrame([("a", "AAC", "Reverse", "High")], "id string, consensus string, strand string, confidence string"), str(tmp_path / "strand"))
    assert spark.read.csv(str(tmp_path / "strand"), sep="\t", header=True).first()["Predicted Sequence"] == "GTT"
    writers.write_genes(spark.createDataFrame([(1, 5, 9, "cas9")], "id int, start int, end int, kind string"), str(tmp_path / "genes"))
    assert spark.read.csv(str(tmp_path / "genes"), header=True).first()["Length"] == "5"


def test_rollups(spark, tmp_path):
    df = arrays(spark)
    writers.write_json_rollup(df, str(tmp_path / "all"))
    rows = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "all")).collect()]
    assert {k for r in rows for k in r} == {"c", "d"} and next(r["c"] for r in rows if "c" in r)["Arrays"]["possible"]["2"]["consensus_repeat"] == "TTT"
    writers.write_rollup(writers.summary(df), str(tmp_path / "summary"), ["ID"])
    back = spark.read.csv(str(tmp_path / "summary"), header=True)
    assert back.columns == ["Name", "Global ID", *writers.SUMMARY] and sorted((r["Name"], r["Global ID"], r["ID"]) for r in back.collect()) == [("c", "1", "1"), ("c", "2", "2")]
    writers.write_rollup(writers.summary(df.limit(0)), str(tmp_path / "none"), ["ID"])
    assert [r["value"] for r in spark.read.text(str(tmp_path / "none")).collect()] == ["Nothing was found"]
    rows = spark.createDataFrame([(x, k) for k, x in enumerate("bacabca")], "name string, k int")
    assert [(r["name"], r["Global ID"]) for r in writers.rollup(rows, "name", ["k"]).orderBy("name", "k").collect()] == list(zip("aaabbcc", range(1, 8), strict=True))
    more = df.selectExpr("*", "array(named_struct('kind', 'cas9', 'start', 5, 'end', 9)) AS genes", "'LEAD' AS leader", "'DOWN' AS downstream", "map('b', 2.0D, 'a', 1.0D) AS features", "cast(null AS string) AS element")
    writers.write_bona_fide(more, str(tmp_path / "bona"))
    text = "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "bona")).collect())
    assert text.count("Array: ") == 1 and all(x in text for x in ("cas9: 5 - 9", "Leader: LEAD", "Downstream: DOWN", "Strand: Reverse", "Features: a: 1.0000, b: 2.0000", "Score: 0.900000", "..T"))
    records = spark.createDataFrame([("c", "h", "AC")], "contig_id string, header string, seq string")
    assert writers.prefixed(records, separator="_-_").collect() == [("c_-_h", "AC")]


def test_letters(spark):
    texts = spark.createDataFrame([(1, "Zé a-b\nXYZ"), (2, None), (3, "")], "doc_id long, text string")
    got = {r["contig_id"]: r["seq"] for r in fasta.letters_as_bases(texts, "doc_id", "text").collect()}
    assert got == {r["doc_id"]: r["s"] for r in texts.select("doc_id", S.dna_of(F.col("text")).alias("s")).collect()}


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.fa").write_text(">a\nACGT\n>b\nGG\n")
    query = ingest.run_available(ingest.stream_fasta(spark, str(tmp_path / "in")), lambda df: df.withColumn("n", F.length("seq")), str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination(60)
    assert {(r["header"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("a", 4), ("b", 2)}


def test_long_tables_are_read_in_blocks(spark, tmp_path):
    """A table of pairs cut into many blocks, and lines that refer to others far before them."""
    from pyspark.sql import functions as F

    from spacerlake.sources import fasta

    many = 3000
    (tmp_path / "p").mkdir()
    for name in ("b", "a"):
        (tmp_path / "p" / f"{name}.txt").write_text("\r\n".join(f"> {20 + k % 50} {k} + 0 {k + 60} x\n{'ACGT' * 15}\n" for k in range(many)))
    orfs = tmp_path / "o.txt"
    orfs.write_text("".join(f'DEFINITION x;seqhdr="c{k // 1000}";\n' if k % 1000 == 0 else f"     CDS   {k}..{k + 9}\n /note=conf={k % 100}.5;\n" for k in range(4000)))
    lines = tmp_path / "r.txt"
    lines.write_text("\n".join("ACGT" + "A" * (k % 9) for k in range(2000)))
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        fasta_chunk, fasta.CHUNK = fasta.CHUNK, 700
        numbered = fasta._numbered_lines(spark, str(tmp_path / "p"))
        assert numbered.select(F.spark_partition_id()).rdd.getNumPartitions() >= 1 and spark.read.text(str(tmp_path / "p")).rdd.getNumPartitions() > 20
        got = {(r["file"], r["n"]): r["m"] for r in numbered.collect()}
        assert got == {(f, n): n + 2 * many * (f == "b.txt") for f in ("a.txt", "b.txt") for n in range(1, 2 * many + 1)}
        rows = fasta.read_pairs(spark, str(tmp_path / "p")).collect()
        assert len(rows) == 2 * many and {(r["begin_first"], r["begin_second"], r["length"]) for r in rows} == {(k, k + 60, min(55, 20 + k % 50)) for k in range(many)} and {r["sequence"] for r in rows} == {("ACGT" * 15)[:55]}
        found = fasta.read_orfs(spark, str(orfs)).collect()
        assert {(r["id"], r["start"], r["confidence"]) for r in found} == {(f"c{k // 1000}", k, k % 100 + 0.5) for k in range(4000) if k % 1000}
        ids = fasta.read_repeats(spark, str(lines)).collect()
        assert {(r["id"], r["consensus"]) for r in ids} == {(f"SAMPLE_{k + 1}", "ACGT" + "A" * (k % 9)) for k in range(2000)}
    finally:
        fasta.CHUNK = fasta_chunk
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
