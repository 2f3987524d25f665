"""Reports of arrays, by Spark's writers: every report is a folder of parts, written by all tasks and safe from repeated ones.

Arrays are rows (contig_id, id, region_index, category, start, end, strand, score, consensus, repeats, spacers, starts), with starts
and start from 0 and end behind the last base; reports count from 1, both ends included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequence as S

#: The columns of the summary.
SUMMARY = ["ID", "Region index", "Start", "End", "Length", "Consensus repeat", "Repeat Length", "Average Spacer Length", "Number of spacers", "Strand", "Category", "Score"]


def _forward() -> Column:
    return F.coalesce(F.col("strand"), F.lit("Forward")) == "Forward"


def _shown_consensus() -> Column:
    return F.when(_forward(), F.col("consensus")).otherwise(S.reverse_complement(F.col("consensus")))


def summary(arrays: DataFrame) -> DataFrame:
    """Bona fide and possible arrays as the summary's columns, after the contig's name."""
    return arrays.where(F.col("category").isin("bona_fide", "possible")).select(
        F.col("contig_id").alias("Name"), F.col("id").alias("ID"), F.col("region_index").alias("Region index"), (F.col("start") + 1).alias("Start"), F.col("end").alias("End"), (F.col("end") - F.col("start")).alias("Length"),
        _shown_consensus().alias("Consensus repeat"), F.length("consensus").alias("Repeat Length"), F.coalesce(F.floor(S.mean_length(F.col("spacers"))), F.lit(0)).alias("Average Spacer Length"),
        F.size("spacers").alias("Number of spacers"), F.col("strand").alias("Strand"), F.col("category").alias("Category"), F.col("score").alias("Score"),
    )


def write_summary(arrays: DataFrame, path: str) -> None:
    """CSV of the summary of all contigs, in the order of contig and id."""
    summary(arrays).orderBy("Name", "ID").write.csv(path, header=True)


def dot_rows() -> Column:
    """Each repeat against the consensus, with its start and the spacer behind it."""
    rows = F.arrays_zip(F.col("repeats"), F.col("starts"), F.concat("spacers", F.array(F.lit(""))).alias("gaps"))
    shown = F.transform(rows, lambda r: F.concat_ws("  ", F.lpad((r["starts"] + 1).cast("string"), 10, " "), F.coalesce(S.rendered_with_dots(r["repeats"], F.col("consensus")), r["repeats"]), r["gaps"]))
    return F.concat(F.array_join(shown, "\n"), F.lit("\n"), F.repeat(F.lit("_"), 100), F.lit("\n"), F.repeat(F.lit(" "), 12), F.col("consensus"))


def write_text_reports(arrays: DataFrame, path: str) -> None:
    """One block of text an array, in a folder for each category."""
    head = F.format_string("Array: %s %s, region %s\nPlace: %d - %d, strand %s\n", F.col("contig_id").cast("string"), F.col("id").cast("string"), F.col("region_index").cast("string"), F.col("start") + 1, F.col("end"), "strand")
    tail = F.format_string("\n\nScore: %.6f\n%s\n", "score", F.repeat(F.lit("="), 100))
    arrays.select("category", F.concat(head, F.lit("\n"), dot_rows(), tail).alias("value")).write.partitionBy("category").text(path)


def _features_line() -> Column:
    """The features of an array (a map of names and numbers), each once, by name."""
    entries = F.array_sort(F.map_entries("features"))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(": "), F.format_number(e["value"], 4))), ", ")


def write_bona_fide(arrays: DataFrame, path: str) -> None:
    """The whole report of bona fide arrays: head, genes around, rows, leader, downstream, strand, features, score, and the element found beside.

    Besides an array's columns: genes array<struct<kind,start,end>>, leader, downstream, features map<string,double>, element (null: none).
    """
    gene = F.transform(F.array_sort(F.transform("genes", lambda g: F.struct(g["start"].alias("start"), g["end"].alias("end"), g["kind"].alias("kind")))), lambda g: F.format_string("%s: %d - %d", g["kind"], g["start"], g["end"]))
    genes = F.when(F.size("genes") > 0, F.concat(F.lit("\nGenes\n"), F.array_join(gene, "\n"), F.lit("\n"))).otherwise("")
    head = F.format_string("Array: %s %s, region %s, place %d - %d, length %d\n", F.col("contig_id").cast("string"), F.col("id").cast("string"), F.col("region_index").cast("string"), F.col("start") + 1, F.col("end"), F.col("end") - F.col("start"))
    around = F.format_string("\n\nLeader: %s\nDownstream: %s\nStrand: %s\nFeatures: %s\nScore: %.6f\n", F.coalesce("leader", F.lit("")), F.coalesce("downstream", F.lit("")), F.coalesce("strand", F.lit("Forward")), F.coalesce(_features_line(), F.lit("")), "score")
    element = F.coalesce(F.concat(F.lit("Element: "), "element", F.lit("\n")), F.lit(""))
    arrays.where("category = 'bona_fide'").select(F.concat(head, genes, F.lit("\n"), dot_rows(), around, element, F.repeat(F.lit("="), 100), F.lit("\n")).alias("value")).write.text(path)


def rollup(rows: DataFrame, name: str, order: list[str]) -> DataFrame:
    """The rows of all contigs with "Global ID", counting through contigs by name and rows in order.

    Rows are numbered within their contig; only one row a contig, its count, is put in one order to add up what stands before it.
    """
    before = F.coalesce(F.sum("_n").over(Window.orderBy(name).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = rows.groupBy(name).agg(F.count("*").alias("_n")).select(name, before.alias("_before"))
    numbered = rows.withColumn("_at", F.row_number().over(Window.partitionBy(name).orderBy(*order)))
    return numbered.join(sizes, name).withColumn("Global ID", F.col("_before") + F.col("_at")).drop("_before", "_at")


def write_rollup(rows: DataFrame, path: str, order: list[str], none: str = "Nothing was found") -> None:
    """CSV of a roll-up (summary, genes or cassettes), Name and Global ID first; one line of text if there are no rows."""
    numbered = rollup(rows, "Name", order)
    if rows.isEmpty():
        rows.sparkSession.createDataFrame([(none,)], "value string").write.text(path)
    else:
        numbered.select("Name", "Global ID", *(c for c in rows.columns if c != "Name")).write.csv(path, header=True)


def prefixed(records: DataFrame, contig: str = "contig_id", separator: str = "_") -> DataFrame:
    """(header, seq) of (contig, header, seq), each header after its contig's name: a folder's records in one list."""
    return records.select(F.concat_ws(separator, F.col(contig).cast("string"), "header").alias("header"), "seq")


def fasta_records(arrays: DataFrame, what: str = "spacers") -> DataFrame:
    """(header, seq) of every spacer or repeat, or of whole arrays, numbered from 1 within the array."""
    name = F.concat_ws("_", F.col("contig_id").cast("string"), "category", (F.col("start") + 1).cast("string"), F.col("end").cast("string"), "consensus")
    if what == "arrays":
        return arrays.select(name.alias("header"), S.interleaved(F.col("repeats"), F.col("spacers")).alias("seq"))
    return arrays.select(name.alias("name"), F.posexplode(what).alias("n", "seq")).select(F.concat_ws("_", "name", F.col("n") + 1).alias("header"), "seq")


def write_fasta(records: DataFrame, path: str) -> None:
    records.select(F.concat(F.lit(">"), "header", F.lit("\n"), "seq").alias("value")).write.text(path)


def array_json(arrays: DataFrame) -> DataFrame:
    """(contig_id, document): category -> id -> array, as one nested object. The names of its fields."""
    one = F.struct(
        F.col("repeats").alias("list_repeats"), F.col("spacers").alias("list_spacers"), F.transform("starts", lambda x: x + 1).alias("list_repeat_starts"), F.col("consensus").alias("consensus_repeat"), dot_rows().alias("dot_representation"),
        "strand", (F.col("start") + 1).alias("start"), F.col("end").alias("end"), (F.col("end") - F.col("start")).alias("length"), F.col("region_index").alias("array_index"), F.col("score").alias("certainty_score"),
    )
    by_category = arrays.groupBy("contig_id", "category").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("id").cast("string"), one)))).alias("arrays"))
    return by_category.groupBy("contig_id").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("category", "arrays"))).alias("Arrays"))).alias("document"))


def write_json_rollup(arrays: DataFrame, path: str) -> None:
    """All contigs' documents under their names: one line of JSON a contig, {name: document}, so that no task holds all."""
    named = array_json(arrays).select(F.concat(F.lit("{"), F.to_json(F.struct(F.col("contig_id").cast("string").alias("k"))), F.lit("}")).alias("k"), "contig_id", "document")
    key = F.regexp_extract("k", r'^\{\{"k":(.*)\}\}$', 1)  # the name as a JSON string
    named.select(F.concat(F.lit("{"), key, F.lit(": "), "document", F.lit("}")).alias("value")).write.text(path)


def write_json(arrays: DataFrame, path: str) -> None:
    """A line of JSON for each contig."""
    array_json(arrays).select(F.col("document").alias("value")).write.text(path)


def gff_lines(arrays: DataFrame) -> DataFrame:
    """GFF3 lines of arrays, their repeats and their spacers, from 1, both ends included."""
    sign = F.when(_forward(), "+").otherwise("-")
    parent = F.concat(F.lit("array_"), F.col("contig_id").cast("string"), F.lit("_"), F.col("id").cast("string"))
    own = arrays.select("contig_id", F.lit("repeat_region").alias("kind"), (F.col("start") + 1).cast("bigint").alias("a"), F.col("end").cast("bigint").alias("b"), "score", sign.alias("sign"), F.concat(F.lit("ID="), parent).alias("more"))

    def parts(kind: str, places: Column) -> DataFrame:
        return arrays.select("contig_id", "score", sign.alias("sign"), parent.alias("parent"), F.posexplode(places).alias("n", "p")).select(
            "contig_id", F.lit(kind).alias("kind"), (F.col("p.a") + 1).cast("bigint").alias("a"), F.col("p.b").cast("bigint").alias("b"), "score", "sign", F.concat(F.lit("ID="), "parent", F.lit(f"_{kind}_"), (F.col("n") + 1).cast("string"), F.lit(";Parent="), "parent").alias("more")
        )

    repeats = F.zip_with("starts", "repeats", lambda s, r: F.struct(s.alias("a"), (s + F.length(r)).alias("b")))
    spacers = F.transform(F.arrays_zip(F.slice("starts", 1, F.size("spacers")).alias("s"), F.slice("repeats", 1, F.size("spacers")).alias("r"), "spacers"), lambda x: F.struct((x["s"] + F.length(x["r"])).alias("a"), (x["s"] + F.length(x["r"]) + F.length(x["spacers"])).alias("b")))
    lines = own.unionByName(parts("direct_repeat", repeats)).unionByName(parts("binding_site", spacers))
    return lines.select(F.concat_ws("\t", F.col("contig_id").cast("string"), F.lit("spacerlake"), "kind", "a", "b", F.col("score").cast("string"), "sign", F.lit("."), "more").alias("value"))


def write_genes(genes: DataFrame, path: str) -> None:
    """CSV of genes or cassettes: ID, Start, End, Length and their kind."""
    genes.select(F.col("id").alias("ID"), F.col("start").alias("Start"), F.col("end").alias("End"), (F.col("end") - F.col("start") + 1).alias("Length"), F.col("kind").alias("Type")).write.csv(path, header=True)


def write_strands(samples: DataFrame, path: str) -> None:
    """Tab-separated id, sequence given, sequence as decided, strand, confidence."""
    turned = F.when(F.col("strand") == "Forward", F.col("consensus")).otherwise(S.reverse_complement(F.col("consensus")))
    samples.select(F.col("id").alias("ID"), F.col("consensus").alias("Input Sequence"), turned.alias("Predicted Sequence"), F.col("strand").alias("Strand"), F.col("confidence").alias("Confidence")).write.csv(path, sep="\t", header=True)


def write_by_cassette(arrays: DataFrame, path: str) -> None:
    """Spacers with their nearest cassette's kind, in a folder for each kind and consensus; arrays without one are left out."""
    rows = arrays.where("cas_type IS NOT NULL").select("contig_id", "category", "start", "end", "consensus", "cas_type", F.posexplode("spacers").alias("n", "spacer"))
    rows.withColumn("n", F.col("n") + 1).write.partitionBy("cas_type", "consensus").csv(path, header=True)


def write_categories(arrays: DataFrame, path: str) -> None:
    """Everything, nested, as Parquet by category."""
    arrays.write.partitionBy("category").parquet(path)
