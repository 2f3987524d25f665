"""Contigs that arrive in pieces: state keeps a contig's pieces until all are there, or until none comes any more."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CONTIGS = "contig_id bigint, seq string, n_pieces int, complete boolean"
_STATE = "done boolean, n_pieces int, numbers array<int>, seqs array<string>, last bigint"


def assembled(pieces: DataFrame, late: str = "1 hour") -> DataFrame:
    """(contig_id, seq, n_pieces, complete), once for each contig, of a stream of (contig_id, piece, n_pieces, seq, at): piece counts from 0, at is the event time.

    A contig is given out when its n_pieces pieces (the greatest number that was told) are there. If none has come for `late` of event time it is closed: what is there is given out, not complete, with an N for each
    missing piece. Of pieces of one number the first counts. A contig that was given out stays known, without its letters, until it would be closed, so that pieces sent again are ignored; pieces later than the
    watermark are dropped. Rows with a null in contig_id, piece, n_pieces or at, or a piece outside 0 to n_pieces - 1, are left out; a null seq is empty. State holds one contig's letters a key, and is in the checkpoint.
    """
    good = pieces.where("contig_id IS NOT NULL AND at IS NOT NULL AND piece >= 0 AND piece < n_pieces")
    marked = good.select("contig_id", "at", F.col("piece").cast("int").alias("piece"), F.col("n_pieces").cast("int").alias("n_pieces"), F.coalesce("seq", F.lit("")).alias("seq"), F.unix_millis("at").alias("ms")).withWatermark("at", late)

    def row(contig: int, n: int, own: dict[int, str]) -> pd.DataFrame:
        return pd.DataFrame({"contig_id": [contig], "seq": ["".join(own.get(k, "N") for k in range(n))], "n_pieces": [n], "complete": [len(own) == n]})

    def join(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, n, numbers, seqs, last = state.get if state.exists else (False, 0, [], [], 0)
        own = dict(zip(numbers, seqs, strict=True))
        if state.hasTimedOut:
            state.remove()
            if not done:
                yield row(key[0], n, own)
            return
        for rows in batches:
            for piece, of, seq, ms in zip(rows["piece"].tolist(), rows["n_pieces"].tolist(), rows["seq"].tolist(), rows["ms"].tolist(), strict=True):
                last = max(last, ms)
                if not done:
                    n = max(n, of)
                    own.setdefault(piece, seq)
        if not done and len(own) == n:
            yield row(key[0], n, own)
            done, own = True, {}
        state.update((done, n, list(own), list(own.values()), last))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + 1)

    return marked.groupBy("contig_id").applyInPandasWithState(join, CONTIGS, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
