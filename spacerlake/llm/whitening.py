"""Embedding whitening: leading eigenvectors of a covariance by block Jacobi-Davidson, without the covariance.

An entry c becomes the long x = floor(64 c) + 1000000. With n vectors and sums S, a vector is centred as (n x - S) / n, the numerator being exact. The covariance V is
never formed: a product V T is one pass over the vectors, each task adding up Z' (Z T) / n over its centred rows Z, and Spark adding up the tasks' sums
by place. Only matrices of d rows (d: entries of a vector) and at most SPACE * wanted columns are on the driver and in the tasks.

Search space: an orthonormal basis Q with V Q. Rayleigh-Ritz gives pairs (e, u); a pair is locked once its residual |V u - e u| is at most
TOLERANCE * d * eps * e1, in falling order. For those still open the correction equation (I - U U') (V - e I) (I - U U') t = -r is solved by some steps of
MINRES, all pairs side by side, so that a step is one pass; U holds the locked vectors and all open Ritz vectors. The corrections widen Q, which
is restarted from its best Ritz vectors when full. A run that isn't done after MOST_ROUNDS raises an error; it never returns pairs that aren't exact.

Vectors are stored once, packed in rows of up to PACK vectors, which a pass reads as they are.

Defined results: vectors that are null, empty, or hold null or non-finite entries are left out, and so are those whose length is not the usual one (the most frequent; of
equally frequent ones the longest), as they have no place in the covariance; an entry whose x is beyond +-2^52 counts as non-finite, as x would not be exact; vec_id may be null or repeat; there are as many
components as wanted, or as the covariance has eigenvalues above RANK_LEFT * e1, so a table of equal vectors, of one or of none gives no rows; deviation is null where it is
beyond a long; eigenvectors of equal eigenvalues are some orthonormal basis; each component's entry of largest size is positive; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import slices, stored, table

WANTED = 32
SCALE, SHIFT, LARGEST = 64, 1_000_000, 1 << 52
PACK = 1024
#: Residuals in units of d * eps * e1.
TOLERANCE = 2.0
MOST_ROUNDS, STEPS, SPARE = 40, 6, 8
#: Most columns of the search space, in wanted ones.
SPACE = 3
#: Eigenvalues below this share of the first are none.
RANK_LEFT = 1e-12
SEED = 11


def quantised(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x) of the rows whose vector has finite entries only."""
    x = F.transform(F.col(vector), lambda c: F.floor(c.cast("double") * SCALE))
    good = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * SCALE) <= LARGEST))
    return rows.where(F.coalesce(good & (F.size(vector) > 0), F.lit(False))).select(F.col(vec_id).cast("bigint").alias("vec_id"), F.transform(x, lambda c: (c + SHIFT).cast("bigint")).alias("x"))


def _packed(vectors: DataFrame, d: int) -> DataFrame:
    """(ids, block): rows of up to PACK vectors, as little-endian longs."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows=PACK):
            x = batch.column(1).flatten().to_numpy().astype("<i8")
            ids = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(0))
            yield pa.RecordBatch.from_arrays([ids, pa.array([x.tobytes()], pa.binary())], names=["ids", "block"])

    return vectors.where(F.size("x") == d).select("vec_id", "x").mapInArrow(pack, "ids array<bigint>, block binary")


class Centred:
    """The packed vectors, centred: numerators n x - S are longs, or Python integers where longs could overflow."""

    def __init__(self, packed: DataFrame, n: int, sums: list[int], most: int):
        self.packed, self.n, self.d = packed, n, len(sums)
        # |n x - S| is at most n times the span of x
        self.kind = np.int64 if 2 * n * most < 1 << 62 else object
        self.sums = np.array(sums, object).astype(self.kind)
        self.squares_fit = (2 * n * most) ** 2 * self.d < 1 << 62

    def numerators(self, block: pa.Scalar) -> np.ndarray:
        x = np.frombuffer(block.as_buffer(), "<i8").reshape(-1, self.d).astype(self.kind)
        return x * self.n - self.sums

    def rows(self, block: pa.Scalar) -> np.ndarray:
        return self.numerators(block).astype(np.float64) / self.n

    def sum_over(self, work: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
        """The sum of work(centred rows of a block), an array of so many doubles: one pass; tasks hand on one sum for each place."""
        blocks = self.rows

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for block in batch.column(0):
                    found = work(blocks(block)).ravel()
                    total = found if total is None else total + found
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["place", "part"])

        own = Centred.__new__(Centred)  # tasks get the numbers without the table
        own.__dict__ = {k: v for k, v in self.__dict__.items() if k != "packed"}
        blocks = own.rows
        found = self.packed.select("block").mapInArrow(add, "place int, part double").groupBy("place").agg(F.sum("part").alias("total"))
        out = np.zeros(size)
        for place, total in found.collect():  # size rows
            out[place] = total
        return out

    def product(self, t: np.ndarray) -> np.ndarray:
        """V t for d rows and any columns, in one pass."""
        return self.sum_over(lambda z: z.T @ (z @ t), t.size).reshape(t.shape) / self.n


def _orthonormal(q: np.ndarray, t: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what t has outside q; directions that are hardly there go."""
    sizes = np.linalg.norm(t, axis=0)
    t = t[:, sizes > 0] / sizes[sizes > 0]  # corrections get as small as the residuals
    for _ in range(3):
        t = t - q @ (q.T @ t)
        norms = np.linalg.norm(t, axis=0)
        t = t[:, norms > 1e-8] / norms[norms > 1e-8]
        if not t.shape[1]:
            return t
        u, s, _ = np.linalg.svd(t, full_matrices=False)
        t = u[:, s > 1e-8]
    return t


def minres(apply: Callable[[np.ndarray], np.ndarray], b: np.ndarray, steps: int, enough: float = 0.05) -> np.ndarray:
    """Approximate solutions of symmetric systems, a column each, side by side: at most so many products, fewer if all residuals are below enough of |b|."""
    beta1 = np.linalg.norm(b, axis=0)
    safe = lambda v: np.where(v > 0, v, 1.0)
    x, w, w2 = np.zeros_like(b), np.zeros_like(b), np.zeros_like(b)
    r1, r2, y = b, b, b
    old_beta, beta, dbar, epsln, phibar, cs, sn = 0 * beta1, beta1, 0 * beta1, 0 * beta1, beta1, 0 * beta1 - 1, 0 * beta1
    for step in range(steps):
        v = y / safe(beta)
        y = apply(v)
        if step:
            y = y - beta / safe(old_beta) * r1
        alpha = (v * y).sum(axis=0)
        y = y - alpha / safe(beta) * r2
        r1, r2 = r2, y
        old_beta, beta = beta, np.linalg.norm(y, axis=0)
        old_eps, delta = epsln, cs * dbar + sn * alpha
        gbar, epsln, dbar = sn * dbar - cs * alpha, sn * beta, -cs * beta
        gamma = safe(np.hypot(gbar, beta))
        cs, sn = gbar / gamma, beta / gamma
        phi, phibar = cs * phibar, sn * phibar
        w1, w2 = w2, w
        w = (v - old_eps * w1 - delta * w2) / gamma
        x = x + phi * w
        if (phibar <= enough * beta1).all():
            break
    return x


def leading_pairs(product: Callable[[np.ndarray], np.ndarray], d: int, wanted: int = WANTED) -> tuple[np.ndarray, np.ndarray]:
    """(e, U): the largest eigenvalues of a symmetric operator without negative ones, falling, and unit eigenvectors as columns.

    product(T) gives V T; it is the only way to V. Pairs with e below RANK_LEFT * e1 are left out.
    """
    wanted = min(wanted, d)
    most = min(d, SPACE * wanted + SPARE)
    q = np.linalg.qr(np.random.default_rng(SEED).standard_normal((d, min(d, wanted + SPARE))))[0]
    vq = product(q)
    for _ in range(MOST_ROUNDS):
        h = q.T @ vq
        e, s = np.linalg.eigh((h + h.T) / 2)
        e, s = e[::-1], s[:, ::-1]
        # as many as there are to find: what is nothing beside the first is no component
        k = min(wanted, int((e > RANK_LEFT * e[0]).sum()) if e[0] > 0 else 0)
        if not k:
            return e[:0], q[:, :0]
        u, vu = q @ s[:, :wanted], vq @ s[:, :wanted]
        residuals = vu - u * e[:wanted]
        sizes = np.linalg.norm(residuals, axis=0)
        done = sizes <= TOLERANCE * d * np.finfo(float).eps * e[0]
        locked = int(np.argmin(done)) if not done.all() else len(done)  # in order, so that none is passed over
        if locked >= k:
            u = u[:, :k]
            sign = np.sign(u[np.abs(u).argmax(axis=0), np.arange(k)])
            return e[:k], u * sign
        if q.shape[1] + wanted - locked > most and q.shape[1] < d and most < d:
            keep = min(q.shape[1], wanted + SPARE)  # restart from the best Ritz vectors, with their products
            q, vq = q @ s[:, :keep], vq @ s[:, :keep]
        left = slice(locked, wanted)
        theta, r = e[left], residuals[:, left]
        away = lambda t: t - u @ (u.T @ t)
        if q.shape[1] < d:
            t = minres(lambda v: away(product(away(v)) - theta * away(v)), -away(r), STEPS)
            t = _orthonormal(q, np.hstack([t, r]))[:, : d - q.shape[1]]
        else:
            t = np.zeros((d, 0))
        if not t.shape[1]:  # all directions are there: products are taken anew, as rounding is all that is left
            q = np.linalg.qr(u if q.shape[1] < d else q @ s)[0]
            vq = product(q)
            continue
        q, vq = np.hstack([q, t]), np.hstack([vq, product(t)])
    raise RuntimeError(f"{wanted - locked} of {wanted} eigenpairs still open after {MOST_ROUNDS} rounds, with residuals up to {sizes.max() / e[0]:.2e} of the first eigenvalue")


OUT = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, wanted: int = WANTED, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each remaining row and component from 1."""
    vectors = quantised(rows, vec_id, vector)
    none = rows.sparkSession.createDataFrame([], OUT)
    usual = vectors.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if usual is None:
        return none
    d = usual["d"]
    packed = stored(_packed(vectors, d), "packed-vectors")

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(0):
                x = np.frombuffer(block.as_buffer(), "<i8").reshape(-1, d)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(d, dtype=np.int32)), pa.array(x.sum(axis=0)), pa.array(np.abs(x - SHIFT).max(axis=0)), pa.array(np.full(d, len(x))),
                ], names=["place", "total", "most", "n"])

    # a row for each entry of a vector; the sums of blocks are longs, those of all blocks need not be
    found = packed.select("block").mapInArrow(totals, "place int, total bigint, most bigint, n bigint").groupBy("place").agg(
        F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.max("most").alias("most"), F.sum("n").alias("n")
    ).orderBy("place").collect()
    n, most = found[0]["n"], max(1, max(r["most"] for r in found))
    centred = Centred(packed, n, [int(r["total"]) for r in found], most)
    e, u = leading_pairs(centred.product, d, wanted)
    if not len(e):
        return none
    trace = centred.sum_over(lambda z: (z * z).sum(), 1)[0] / n
    turn = u / np.sqrt(e)
    means = centred.sum_over(lambda z: (z @ turn).sum(axis=0), len(e)) / n

    def spread(z: np.ndarray) -> np.ndarray:
        w = z @ turn - means
        return w.T @ w

    covariance = centred.sum_over(spread, len(e) ** 2).reshape(len(e), len(e)) / n
    error = float(np.abs(covariance - np.eye(len(e))).max())
    share, parts = e / trace, len(e)
    own = Centred.__new__(Centred)
    own.__dict__ = {k: v for k, v in centred.__dict__.items() if k != "packed"}

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, block in zip(batch.column(0), batch.column(1), strict=True):
                numerators = own.numerators(block)
                if own.squares_fit:
                    deviation = pa.array((numerators * numerators).sum(axis=1))
                else:
                    exact = [sum(int(v) ** 2 for v in r) for r in numerators]
                    deviation = pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())
                w = numerators.astype(np.float64) / own.n @ turn
                each = pa.array(np.repeat(np.arange(len(w)), parts))
                yield pa.RecordBatch.from_arrays([
                    ids.values.take(each), pa.array(np.tile(np.arange(1, parts + 1, dtype=np.int32), len(w))), pa.array(np.full(w.size, own.n)), deviation.take(each),
                    pa.array(w.ravel()), pa.array(np.tile(share, len(w))), pa.array(np.full(w.size, error)),
                ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return packed.select("ids", "block").mapInArrow(project, OUT)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
