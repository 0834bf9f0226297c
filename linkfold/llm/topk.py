"""Exact top-k search by distributed histogram selection.

Queries go out in blocks of bounded size, and every task scores its vectors against a block with one matrix
product. Scores are whole numbers. For every query a histogram of scores over all rows narrows the range
that holds the k-th score, round by round, until it is one value; then the rows at or above it are kept, and
ties at it go to the smaller id. A task reports no bin below its own k-th score: those bins cannot hold the
k-th score of all rows, as k rows above them are known. So a task sends at most k bins a query.

Vectors that are null, empty, or hold a null or non-finite component take no part; nor do rows with a null id.
Only vectors of equal length are compared. Repeated ids are rows of their own: each may be listed. Fewer than
k candidates are all listed. Scores are exact whatever the components: where the product of the two lengths leaves
floating point's whole numbers, they are computed modulo 2**64, and beyond 2**62 in whole numbers of any size; a score
that does not fit into a long is the nearest long.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from linkfold.llm.common import shared_folder, written

#: Queries that go out together: the bound of what is broadcast, at 8 bytes a component.
BLOCK = 2048
BINS = 1024
#: Rows that a task scores at once.
ROWS = 4096
#: Scores go by as unsigned numbers of the same order; 0 stands for no candidate.
_SIGN = np.uint64(1 << 63)


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(id, v) of usable rows, with components ``floor(scale * x)`` as doubles."""
    v = F.col(vector_col)
    usable = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.filter(F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.coalesce(usable, F.lit(False))).select(
        F.col(id_col).cast("long").alias("id"),
        # From 2**53 on every double is whole.
        F.transform(v, lambda x: F.when(F.abs(x.cast("double") * F.lit(scale)) < F.lit(2.0**53), F.floor(x.cast("double") * F.lit(scale)).cast("double")).otherwise(x.cast("double") * F.lit(scale))).alias("v"),
    )


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _modulo(x: np.ndarray) -> np.ndarray:
    """Whole doubles modulo 2**64."""
    rest = np.fmod(x, 2.0**64)
    size = np.abs(rest).astype(np.uint64)
    return np.where(rest < 0, np.uint64(0) - size, size)


def scores_of(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products (queries by rows) as unsigned numbers in the order of the scores, at least 1."""
    with np.errstate(all="ignore"):
        q, r = np.sqrt((queries * queries).sum(axis=1)), np.sqrt((rows * rows).sum(axis=1))
        largest = float(q.max(initial=0))
        out = (queries @ rows.T).astype(np.int64).view(np.uint64)
        # By the Cauchy-Schwarz inequality no partial sum leaves the whole numbers of a double below this.
        big = np.flatnonzero(~(r * largest < 2.0**53))
        if len(big):
            out[:, big] = _modulo(queries) @ _modulo(rows[big]).T
        out ^= _SIGN
        for k in np.flatnonzero(~(r * largest < 2.0**62)):
            for i in np.flatnonzero(~(q * r[k] < 2.0**62)):
                exact = sum(int(a) * int(b) for a, b in zip(queries[i].tolist(), rows[k].tolist()))
                out[i, k] = min(max(exact, 1 - (1 << 63)), (1 << 63) - 1) + (1 << 63)
    return out


def _scored(batches, groups: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
    """For stretches of rows: positions of the queries of their length, the rows' ids, and scores (queries by rows)."""
    for batch in batches:
        sizes = pc.list_value_length(batch.column("v")).to_numpy(zero_copy_only=False)
        for size in np.unique(sizes):
            if int(size) not in groups:
                continue
            at, query_ids, queries = groups[int(size)]
            rows = np.flatnonzero(sizes == size)
            for k in range(0, len(rows), ROWS):
                part = batch.take(pa.array(rows[k : k + ROWS]))
                ids = part.column("id").to_numpy()
                scores = scores_of(queries, _matrix(part.column("v")))
                # A query is no candidate of its own.
                scores[query_ids[:, None] == ids[None, :]] = 0
                yield at, ids, scores


def _grouped(block: list) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Queries by length: their positions in the block, ids and matrix."""
    ids, sizes = np.array([r["id"] for r in block], np.int64), np.array([len(r["v"]) for r in block])
    return {int(n): (at, ids[at], np.array([block[i]["v"] for i in at], float)) for n in np.unique(sizes) for at in [np.flatnonzero(sizes == n)]}


def kth_scores(rows: DataFrame, groups, n: int, k: int, reach: float) -> np.ndarray:
    """The k-th highest score of each of n queries; the lowest where there are fewer than k, the highest number where there is none."""
    context = rows.sparkSession.sparkContext
    far = min(int(min(reach, 2.0**63)) + 1, (1 << 63) - 1)
    # The score sought is above low and not above high.
    low, high = np.full(n, (1 << 63) - far, np.uint64), np.full(n, (1 << 63) + far, np.uint64)
    low -= np.uint64(1)
    above = np.zeros(n, np.int64)  # rows above high
    while (high - low > 1).any():
        width = (high - low) // np.uint64(BINS) + np.uint64(1)
        sent = context.broadcast((groups, low, high, width, k - above))

        def histogram(batches):
            groups, low, high, width, need = sent.value
            counts = np.zeros(len(low) * BINS, np.int64)
            for at, _, scores in _scored(batches, groups):
                # Bin 0 is the highest. Scores above the range are counted already, scores below it are out.
                q, c = np.nonzero((scores > low[at, None]) & (scores <= high[at, None]))
                bins = ((high[at[q]] - scores[q, c]) // width[at[q]]).astype(np.int64)
                counts += np.bincount(at[q] * BINS + bins, minlength=len(counts))
            counts = counts.reshape(-1, BINS)
            q, b = np.nonzero((counts > 0) & (np.cumsum(counts, axis=1) - counts < need[:, None]))
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(b), pa.array(counts[q, b]), pa.array(need[q])], names=["q", "bin", "n", "need"])

        found = rows.mapInArrow(histogram, "q long, bin long, n long, need long").groupBy("q", "bin", "need").agg(F.sum("n").alias("n"))
        # A query has at most k bins of each task here. Its bin is the first whose running count is enough, or its last.
        upto = F.sum("n").over(Window.partitionBy("q").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
        place = F.struct("bin", (F.col("upto") - F.col("n")).alias("before"))
        hit = found.withColumn("upto", upto).groupBy("q").agg(
            F.coalesce(F.min(F.when(F.col("upto") >= F.col("need"), place)), F.max(place)).alias("hit")
        )
        got = hit.select("q", "hit.*").collect()  # one row a query
        none = np.ones(n, bool)
        for r in got:
            q = r["q"]
            none[q] = False
            top, wide = int(high[q]) - int(r["bin"]) * int(width[q]), int(width[q])
            above[q] += r["before"]
            low[q], high[q] = max(int(low[q]), top - wide), top
        low[none] = high[none] = 2**64 - 1  # no candidate: nothing scores as high
        sent.unpersist()
    return high


def search(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k highest inner products over all rows but its own.

    Both frames are (id, v) of whole numbers, stable when read again. A repeated query id is asked once.
    """
    spark = vectors.sparkSession
    asked = written(queries.groupBy("id").agg(F.min("v").alias("v")), "topk-queries")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    bound = vectors.agg(F.max(square).alias("s")).first()["s"]
    wide = asked.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not wide["n"] or bound is None:
        return spark.createDataFrame([], schema)
    # By the Cauchy-Schwarz inequality no score is larger; queries are vectors too.
    reach = float(np.ceil(max(bound, asked.agg(F.max(square).alias("s")).first()["s"]) * (1 + 1e-12)))
    size = max(64, min(BLOCK, (1 << 24) // (8 * wide["d"])))
    blocks = -(-wide["n"] // size)
    out = f"{shared_folder(spark)}/topk-{uuid.uuid4().hex}"
    paths = []
    for b in range(blocks):
        block = asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).orderBy("id").collect()  # about ``size`` queries
        if block:
            paths.append(f"{out}/{b}")
            _answers(vectors, block, k, reach).write.parquet(paths[-1])
    return spark.read.schema(schema).parquet(*paths)


def _answers(vectors: DataFrame, block: list, k: int, reach: float) -> DataFrame:
    groups = _grouped(block)
    least = kth_scores(vectors, groups, len(block), k, reach)
    sent = vectors.sparkSession.sparkContext.broadcast((groups, least, np.array([r["id"] for r in block], np.int64)))

    def keep(batches):
        groups, least, query_ids = sent.value
        best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)]
        for at, ids, scores in _scored(batches, groups):
            q, c = np.nonzero((scores >= least[at, None]) & (scores > 0))
            best = [np.concatenate(x) for x in zip(best, (at[q], ids[c], scores[q, c]))]
            # Of a query's rows in this task only the k best by score and id can be among the k best of all.
            order = np.lexsort((best[1], ~best[2], best[0]))
            best = [x[order] for x in best]
            start = np.searchsorted(best[0], best[0], side="left")
            best = [x[np.arange(len(start)) - start < k] for x in best]
        yield pa.RecordBatch.from_arrays(
            [pa.array(query_ids[best[0]]), pa.array(best[1]), pa.array((best[2] ^ _SIGN).view(np.int64))], names=["query_id", "vec_id", "score"]
        )

    found = vectors.mapInArrow(keep, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
