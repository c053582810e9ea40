"""Exact top-k inner-product search by distributed histogram selection."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scenarium.plans.materialize import materialize

#: Rows of one block of candidates and of queries; a task scores one block against the other.
CANDIDATE_ROWS, QUERY_ROWS = 4096, 2048
BINS = 256
#: Queries of a block that are scored at once.
TILE = 128
#: Components and scores beyond this stop the job: the sums of larger ones wouldn't be exact.
LARGEST = 2.0**61


def integer_vectors(vectors: DataFrame, scale: int) -> DataFrame:
    """``(vec_id, v array<long>)``: floor(scale * x) of each component, for every row.

    Vectors null, or holding null or non-finite components, and rows without a vec_id are left out.
    """
    v = F.transform("embedding", lambda x: x.cast("double"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(good)
    whole = lambda x: F.when(F.abs(x * scale) < LARGEST, F.floor(x * scale).cast("long")).otherwise(F.raise_error(F.lit("a component is beyond 2**61")).cast("long"))
    return rows.select("vec_id", F.transform("v", whole).alias("v"))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of a list column; shorter ones are filled with zeros."""
    lists = column.combine_chunks()
    size = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), width), np.int64)
    out[np.arange(width) < size[:, None]] = lists.flatten().to_numpy()
    return out


def _scores(left: pa.Table, right: pa.Table):
    """For each tile of queries: its rows, the candidates' ids in order, the integer scores, and which candidates aren't the query's own."""
    ids = left.column("vec_id").to_numpy()
    order = np.argsort(ids, kind="stable")
    width = max([1, *(int(np.diff(t.column("v").combine_chunks().offsets.to_numpy()).max(initial=0)) for t in (left, right))])
    c, q = _matrix(left.column("v"), width)[order], _matrix(right.column("v"), width)
    ids = ids[order]
    own = right.column("query_id").to_numpy()
    most = [float(np.abs(x.astype(np.float64)).max(initial=0)) for x in (c, q)]
    exact = most[0] * most[1] * width < 2**53  # then doubles hold every sum
    c = np.ascontiguousarray(c.T)
    near = c.astype(np.float64)
    for at in range(0, len(q), TILE):
        part = slice(at, at + TILE)
        s = q[part].astype(np.float64) @ near
        if not exact:  # whole numbers wrap around on the way, but not in the end if the sum is small enough
            if np.abs(s).max(initial=0) > LARGEST:
                raise ArithmeticError("a score is beyond 2**61")
            s = q[part] @ c
        yield part, ids, s.astype(np.int64), ids != own[part][:, None]


def _histogram(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        query, bins, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if left.num_rows and right.num_rows:
            low, span, width, above, own = (right.column(c).to_numpy() for c in ("low", "span", "width", "above", "row"))
            for part, _, s, other in _scores(left, right):
                slot = (s - low[part][:, None]) // width[part][:, None]
                good = (slot >= 0) & (s - low[part][:, None] < span[part][:, None]) & other
                flat = (slot + BINS * np.arange(len(s))[:, None])[good]
                table = np.bincount(flat, minlength=BINS * len(s)).reshape(len(s), BINS)
                # bins below the k-th score of this block alone can't hold the k-th of all
                higher = np.cumsum(table[:, ::-1], 1)[:, ::-1] - table
                row, col = np.nonzero((table > 0) & (higher + above[part][:, None] < k))
                query.append(own[part][row])
                bins.append(col)
                counts.append(table[row, col])
        return pa.table({"row": np.concatenate(query), "bin": np.concatenate(bins), "n": np.concatenate(counts)})

    return run


def _selected(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        query, vec, score = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if left.num_rows and right.num_rows:
            low, above, own = (right.column(c).to_numpy() for c in ("low", "above", "query_id"))
            for part, ids, s, other in _scores(left, right):
                tie = (s == low[part][:, None]) & other
                tie &= np.cumsum(tie, 1) <= (k - above[part])[:, None]  # candidates are in vec_id order
                row, col = np.nonzero(((s > low[part][:, None]) & other) | tie)
                query.append(own[part][row])
                vec.append(ids[col])
                score.append(s[row, col])
        return pa.table({"query_id": np.concatenate(query), "vec_id": np.concatenate(vec), "score": np.concatenate(score)})

    return run


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's k highest integer inner products with the vectors of other ids.

    Ties go to the smaller vec_id; a query with fewer candidates gets them all. Blocks of queries meet
    blocks of candidates, so that no task holds more than one block of each. Every round scores everything
    and adds up one histogram a query over all blocks; the bin with the k-th score becomes the next round's
    range, until it is one value wide. Then scores above it are kept, and of those equal to it the smallest
    ids. Every row is a candidate, also those that repeat a vec_id, and may be listed beside each other; rows
    that repeat a query's vec_id are queries of one list of k. Null, non-finite and overlarge vectors: see
    ``integer_vectors``; vectors of unlike length are filled with zeros; an empty table gives an empty result.
    """
    rows = integer_vectors(vectors, scale).select("*", F.monotonically_increasing_id().alias("row"))
    rows = materialize(rows, "vectors")  # so that the numbers of the rows stay
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    sized = rows.withColumn("norm", norm).withColumn("is_query", is_query)
    facts = sized.agg(F.count("*").alias("n"), F.sum(F.col("is_query").cast("long")).alias("q"), F.max("norm").alias("norm")).first()
    a, b = max(1, -(-(facts["n"] or 0) // CANDIDATE_ROWS)), max(1, -(-(facts["q"] or 0) // QUERY_ROWS))
    reach = F.ceil(F.least(F.col("norm") * F.lit(float(facts["norm"] or 0)) * (1 + 1e-9) + 1, F.lit(LARGEST)))
    shard = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    candidates = rows.select("vec_id", "v", shard(a).alias("c"), F.explode(F.sequence(F.lit(0), F.lit(b - 1))).alias("q"))
    queries = sized.where("is_query").select("row", F.col("vec_id").alias("query_id"), "v", shard(b).alias("q"), (-reach).cast("long").alias("low"), (2 * reach + 1).cast("long").alias("span"), F.ceil((2 * reach + 1) / BINS).cast("long").alias("width"), F.lit(0).cast("long").alias("above"))
    state = materialize(queries, "state")
    while True:
        cells = state.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(a - 1)))).groupBy("c", "q")
        if not state.where("width > 0").limit(1).count():
            found = candidates.groupBy("c", "q").cogroup(cells).applyInArrow(_selected(k), "query_id long, vec_id long, score long")
            rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
            return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
        counts = candidates.groupBy("c", "q").cogroup(cells).applyInArrow(_histogram(k), "row long, bin long, n long")
        counts = counts.groupBy("row", "bin").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(W.partitionBy("row").orderBy(F.desc("bin")))
        counts = counts.withColumn("upto", upto).join(state.select("row", F.col("above").alias("before")), "row")
        # the first bin from above that reaches k, or the last one if all candidates are fewer
        reached = counts.where((F.col("upto") - F.col("n") + F.col("before")) < k).groupBy("row").agg(F.min_by(F.struct("bin", (F.col("upto") - F.col("n")).alias("higher")), "bin").alias("b"))
        next_ = state.join(reached, "row", "left")
        bin_, higher = F.coalesce("b.bin", F.lit(0)), F.coalesce("b.higher", F.lit(0))
        done = F.col("width") <= 1
        state = materialize(
            next_.select("row", "query_id", "v", "q", F.when(F.col("width") > 0, F.col("low") + bin_ * F.col("width")).otherwise(F.col("low")).alias("low"), F.col("width").alias("span"), F.when(done, 0).otherwise(F.ceil(F.col("width") / BINS)).cast("long").alias("width"), F.when(F.col("width") > 0, F.col("above") + higher).otherwise(F.col("above")).alias("above")),
            "state",
        )
