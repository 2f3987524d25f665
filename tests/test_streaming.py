"""Contigs in pieces: the stream, begun anew from its checkpoint for each file, against whole contigs."""

import random
from datetime import datetime, timedelta

from spacerlake.operators import pairs
from spacerlake.streaming import assemble, ingest

PIECES = "contig_id long, piece int, n_pieces int, seq string, at timestamp"
START = datetime(2024, 1, 1)


def test_contigs_in_pieces(spark, tmp_path):
    rng = random.Random(4)
    letters = lambda n: "".join(rng.choices("ACGT", k=n))
    repeat = letters(30)
    whole = {k: letters(60) + "".join(repeat + letters(32) for _ in range(4)) + letters(50) for k in (1, 2)}
    cut = {k: [s[:75], s[75:140], s[140:]] for k, s in whole.items()}  # both cuts are inside repeats
    at = lambda minutes: START + timedelta(minutes=minutes)
    files = [
        [(1, 2, 3, cut[1][2], at(0)), (1, 0, 3, cut[1][0], at(1)), (3, 0, 3, "ACGT", at(1)), (3, 2, 3, None, at(2)), (None, 0, 1, "A", at(1)), (4, 5, 3, "A", at(1)), (5, None, 1, "A", at(1)), (6, 0, 1, "A", None)],
        [(1, 1, 3, cut[1][1], at(3)), (1, 0, 3, "TTTT", at(3)), *((2, k, 3, x, at(4)) for k, x in enumerate(cut[2]))],
        [(1, 1, 3, "GGGG", at(5)), (2, 0, 3, cut[2][0], at(5))],  # sent again
        [(7, 0, 1, "CC", at(200))],
        [(3, 1, 3, "TT", at(6)), (8, 0, 2, "A", at(201))],  # the first is later than the watermark
    ]
    found = []
    for rows in files:
        spark.createDataFrame(rows, PIECES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = assemble.assembled(spark.readStream.schema(PIECES).parquet(str(tmp_path / "in")))
        ingest.run_available(stream, lambda df: df, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
        found.append(sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("contig_id", "seq", "n_pieces", "complete").collect()))
    complete = [(1, whole[1], 3, True), (2, whole[2], 3, True)]
    closed = [*complete, (3, "ACGTN", 3, False), (7, "CC", 1, True)]
    assert found == [[], complete, complete, closed, closed]
    batch = spark.createDataFrame(list(whole.items()), "contig_id long, seq string")
    streamed = spark.createDataFrame([r[:2] for r in found[-1] if r[0] < 3], "contig_id long, seq string")
    arrays = [sorted(map(tuple, pairs.maximal_pairs(df).collect())) for df in (batch, streamed)]
    assert arrays[0] == arrays[1] and len(arrays[0]) >= 6
