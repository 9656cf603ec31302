"""Approximate nearest neighbours by a permutation index.

Pivots are vectors drawn by a hash of their ids, about the square root of the
table in number and 64 at least. A vector is represented by the order of its
`posted` nearest pivots and posted in the inverted file of each. A query meets
the vectors of its pivots' files, each once, in the file of the first pivot that
both have. There their footrule distance is added up over the files of the tile
from the orders alone,

    sum over pivots of |rank in one - rank in the other|, ranks ending at `posted`,

and the vectors within the radius, nearest first, are reranked by their exact
cosine; each query keeps its best `k`. No list of candidates is cut by number.

Queries are the rows whose id is divisible by `every`; all rows are posted.

The more pivots, the fewer true neighbours share one of a fixed number. So
`posted` and the radius are measured: `queries` vectors drawn by a hash meet the
whole table, `posted` is the least number of pivots, POSTED at least, at which
the share (1 + `recall`) / 2 of their true neighbours shares one, and the radius
the least within which the share `recall` of them shares one.

An inverted file is worked on in tiles of about `tile` vectors and QUERY_TILE
queries, so that a crowded pivot is many tasks and none holds more than two
tiles. The pivots, which grow as the square root of the table, and the drawn
queries are all that is broadcast; the check is in `pivots_of`.

Result: (vec_id, neighbour_id, rank, cosine); cosines are rounded to 6 decimals
and ties go to the lower neighbour_id.

Defined cases: rows of a NULL vec_id, of a NULL, empty or zero vector, of a
vector with a NULL, NaN or infinite item, or of another length than the most
common (the longest of those), are neither queries nor neighbours; of rows that
repeat a vec_id one counts, the first by its items; tables of one vector or none
give no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, ranges, staged

K, POSTED, TILE, QUERY_TILE, LEAST_PIVOTS, EVERY = 10, 16, 8192, 32_768, 64, 50
RECALL, QUERIES = 0.98, 256
PIVOT_BYTES = 256 << 20


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part, v of unit length."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND size(v) > 0")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    top = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1)
    rows = rows.join(F.broadcast(top.select("n")), F.size("v") == F.col("n")).groupBy("vec_id").agg(F.min("v").alias("v"))
    scale = F.array_max(F.transform("v", lambda x: F.abs(x)))
    rows = rows.withColumn("v", F.transform("v", lambda x: x / scale))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return rows.select("vec_id", F.transform("v", lambda x: (x / norm).cast("float")).alias("v"))


def pivots_of(rows: DataFrame, n: int) -> np.ndarray:
    """About sqrt(n) vectors, by a hash of their ids."""
    count = min(n, max(LEAST_PIVOTS, 1 << round(math.log2(max(n, 1)) / 2)))
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(count).toArrow().column("v")
    out = np.array(picked.to_pylist(), np.float32)
    if out.nbytes > PIVOT_BYTES:
        raise ValueError(f"{out.nbytes} bytes of pivots; at most {PIVOT_BYTES} are broadcast")
    return out


def orders(x: np.ndarray, pivots: np.ndarray, posted: int) -> np.ndarray:
    """The nearest `posted` pivots of each row, nearest first."""
    parts = [np.argsort(-np.round(x[at : at + 2048] @ pivots.T, 6), axis=1, kind="stable")[:, :posted] for at in range(0, len(x), 2048)]
    return np.concatenate(parts) if parts else np.zeros((0, posted), np.int64)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, width)


def _orders(shared, posted: int):
    def run(batches):
        pivots = shared.value
        for b in batches:
            if b.num_rows:
                v = _matrix(b.column("v"), pivots.shape[1])
                order = orders(v, pivots, posted).astype(np.int32)
                yield pa.record_batch(
                    [b.column("vec_id"), pa.array([x.tobytes() for x in v], pa.binary()), pa.array([x.tobytes() for x in order], pa.binary()), pa.array(list(order), pa.list_(pa.int32()))],
                    ["vec_id", "v", "ranks", "pivots"],
                )

    return run


def _meet(shared, k: int):
    def run(batches):
        ids, queries = shared.value
        for b in batches:
            v, own = _matrix(b.column("v"), queries.shape[1]), b.column("vec_id").to_numpy()
            cosines = queries @ v.T
            cosines[ids[:, None] == own] = -2
            near = np.argsort(-cosines, axis=1, kind="stable")[:, :k]
            q = np.repeat(np.arange(len(ids)), near.shape[1])
            near = near.ravel()
            yield pa.record_batch([pa.array(q.astype(np.int32)), b.column("vec_id").take(pa.array(near)), b.column("v").take(pa.array(near)), pa.array(cosines[q, near].astype(float))], ["q", "vec_id", "v", "cosine"])

    return run


def ranks_of(x: np.ndarray, y: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many nearest pivots rows of x and y need to share one, and the larger
    of both ranks of each pivot, the least first."""
    need, ranks = [], []  # the best ranks: a closeness of fewer is no larger, so that the radius is no smaller
    for at in range(0, len(x), 512):
        both = [orders(side[at : at + 512], pivots, len(pivots)).argsort(1) for side in (x, y)]
        least = np.maximum(*both)
        need.append(least.min(1) + 1)
        ranks.append(np.sort(least, axis=1)[:, : 8 * POSTED])
    return np.concatenate(need), np.concatenate(ranks)


def closeness(ranks: np.ndarray, posted: int) -> np.ndarray:
    """Half of the largest footrule distance, posted * (posted + 1) / 2 each, less
    half of the distance: a pivot at ranks i and j adds posted - max(i, j)."""
    return np.maximum(posted - ranks, 0).sum(1)


def measured(rows: DataFrame, pivots: np.ndarray, k: int, recall: float, queries: int, posted: int | None) -> tuple[int, int]:
    """The number of pivots to post a vector at and the least closeness; see the module."""
    drawn = rows.orderBy(F.xxhash64("vec_id", F.lit("query")), "vec_id").limit(queries).toArrow()
    ids, q = drawn.column("vec_id").to_numpy(), np.array(drawn.column("v").to_pylist(), np.float32)
    met = rows.mapInArrow(_meet(rows.sparkSession.sparkContext.broadcast((ids, q)), k), "q int, vec_id bigint, v array<float>, cosine double").where("cosine > -2")
    by = Window.partitionBy("q").orderBy(F.desc("cosine"), "vec_id")
    best = met.withColumn("nth", F.row_number().over(by)).where(F.col("nth") <= k).select("q", "v").toArrow()
    if not best.num_rows:
        return posted or POSTED, 1
    need, ranks = ranks_of(q[best.column("q").to_numpy()], np.array(best.column("v").to_pylist(), np.float32), pivots)
    if posted is None:
        posted = max(POSTED, int(np.sort(need)[math.ceil((1 + recall) / 2 * len(need)) - 1]))
    posted = min(posted, len(pivots))
    close = np.sort(closeness(ranks, posted))[::-1]
    return posted, max(1, int(close[math.ceil(recall * len(close)) - 1]))


class Files:
    """The inverted files of a tile of vectors."""

    def __init__(self, ranks: np.ndarray):
        self.n, self.posted = ranks.shape
        flat = ranks.ravel()
        by = np.argsort(flat, kind="stable")
        self.row, self.weight = by // self.posted, self.posted - by % self.posted
        self.pivot, self.start = np.unique(flat[by], return_index=True)
        self.end = np.append(self.start[1:], len(flat))

    def close(self, order: np.ndarray, pivot: int) -> np.ndarray:
        """The closeness of each vector's order to a query's, 0 where an earlier
        pivot of the query than `pivot` is shared."""
        at = np.minimum(np.searchsorted(self.pivot, order), len(self.pivot) - 1)
        size = np.where(self.pivot[at] == order, self.end[at] - self.start[at], 0)
        entry = ranges(self.start[at], size)
        mine = np.repeat(self.posted - np.arange(self.posted), size)
        total = np.bincount(self.row[entry], np.minimum(self.weight[entry], mine), self.n)
        before = int(size[: int(np.flatnonzero(order == pivot)[0])].sum())
        total[self.row[entry[:before]]] = 0
        return total


def _tile(k: int, least: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pivot, asks = int(pdf["pivot"].iloc[0]), pdf["ask"].to_numpy()
        read = lambda some, c, kind: np.frombuffer(b"".join(pdf[c].to_numpy()[some]), kind).reshape(int(some.sum()), -1)
        x, q = (read(some, "v", np.float32).astype(float) for some in (~asks, asks))
        if not len(x) or not len(q):
            return _NONE
        files, asked = Files(read(~asks, "ranks", np.int32)), read(asks, "ranks", np.int32)
        xid, qid = (pdf["vec_id"].to_numpy()[some] for some in (~asks, asks))
        out = []
        for i in range(len(q)):
            close = files.close(asked[i], pivot)
            j = np.flatnonzero((close >= least) & (xid != qid[i]))
            j = j[np.argsort(-close[j], kind="stable")]
            cosine = np.round(x[j] @ q[i], 6)
            j = j[np.lexsort((xid[j], -cosine))[:k]]
            out.append((np.full(len(j), qid[i]), xid[j], np.round(x[j] @ q[i], 6)))
        return pd.DataFrame({c: np.concatenate([o[n] for o in out]) for n, c in enumerate(("vec_id", "neighbour_id", "cosine"))})

    return run


_NONE = pd.DataFrame({"vec_id": np.zeros(0, np.int64), "neighbour_id": np.zeros(0, np.int64), "cosine": np.zeros(0)})


def neighbours(vectors: DataFrame, k: int = K, posted: int | None = None, recall: float = RECALL, tile: int = TILE, queries: int = QUERIES, every: int = EVERY) -> DataFrame:
    """(vec_id, neighbour_id, rank, cosine) of the vectors whose id `every` divides; see the module."""
    spark = vectors.sparkSession
    rows = staged(usable(vectors), "ann-rows")
    n = rows.count()
    pivots = pivots_of(rows, n) if n else np.zeros((0, 1), np.float32)
    posted, least = measured(rows, pivots, k, recall, queries, posted) if n else (POSTED, 1)
    posted = min(posted, max(len(pivots), 1))
    ranked = rows.mapInArrow(_orders(spark.sparkContext.broadcast(pivots), posted), "vec_id bigint, v binary, ranks binary, pivots array<int>")
    ranked = staged(ranked, "ann-orders")
    discard(rows)
    asked = F.pmod("vec_id", F.lit(every)) == 0
    files = ranked.select(F.explode("pivots").alias("pivot"), asked.cast("int").alias("ask")).groupBy("pivot").agg(F.count("*").alias("n"), F.sum("ask").alias("asks")).where("asks > 0")
    # A row for each pivot.
    files = F.broadcast(files.select("pivot", F.ceil(F.col("n") / tile).cast("int").alias("tiles"), F.ceil(F.col("asks") / QUERY_TILE).cast("int").alias("blocks")))
    own = lambda c: F.pmod(F.xxhash64("vec_id"), F.col(c)).cast("int")
    every_one = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    columns = ("pivot", "tile", "block", "ask", "vec_id", "v", "ranks")
    posts = ranked.select("vec_id", "v", "ranks", F.explode("pivots").alias("pivot"))
    there = posts.join(files, "pivot").withColumn("tile", own("tiles")).withColumn("block", every_one("blocks")).withColumn("ask", F.lit(False)).select(*columns)
    asks = posts.where(asked).join(files, "pivot").withColumn("block", own("blocks")).withColumn("tile", every_one("tiles")).withColumn("ask", F.lit(True)).select(*columns)
    met = there.union(asks).groupBy("pivot", "tile", "block").applyInPandas(_tile(k, least), "vec_id bigint, neighbour_id bigint, cosine double")
    by = Window.partitionBy("vec_id").orderBy(F.desc("cosine"), "neighbour_id")
    return met.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("vec_id", "neighbour_id", "rank", "cosine")
