"""Exact top-k search by a Voronoi join (operator 4).

Inner products are turned into distances: with M the largest norm, a vector x is extended by
sqrt(M^2 - |x|^2) and a query by 0, and then nearer means a higher product. All vectors go to
the cell of their nearest pivot. From summaries of the cells (largest distance of a query, and
the k smallest distances of data to the pivot) follows, for each query cell, a distance within
which every query has its k answers. Cells are taken near to far: queries first meet one chunk of
the nearest cell, and the k-th score found there limits each query's own distance. A query then goes
to a cell only if neither the bisecting plane of the pivots nor the cell's ring of distances rules it
out, and a vector only to query cells whose limits reach it. Cells are cut into chunks, so that every
pair of a query chunk and a data chunk is solved by itself in bounded memory, and the local answers
that reach the known score are merged.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - as pa.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starpipe.llm.common import bounded_sample, merge_lookup, python_tasks, stored

CELLS = ("vec_id long, query boolean, cell int, chunk int, distance double, vector binary")
REACH = ("vec_id long, cell int, vector binary, kth long, data_cell array<int>, low array<double>, high array<double>")
SCORES = "query_id long, vec_id long, score long"
SCORE_TYPES = pa.schema([(c, pa.int64()) for c in ("query_id", "vec_id", "score")])


@dataclass(frozen=True)
class Search:
    """`most_pivots` and `sample` bound what is broadcast and what pivots are chosen from.

    There are as many pivots as chunks of queries, but at least `pivots`: cells of fewer queries than a
    chunk would be sent the data more often.
    """

    k: int = 10
    scale: int = 1024
    every: int = 100
    pivots: int = 12
    most_pivots: int = 128
    sample: int = 2000
    chunk: int = 4096
    queries: int = 4096


def whole_numbers(values: list, scale: int) -> np.ndarray | None:
    """floor(scale * x) of each component, within 2^62 of 0; None if any is null or not finite."""
    if values is None or any(v is None for v in values):
        return None
    x = np.asarray(values, np.float64)
    if not np.isfinite(x).all():
        return None
    most = 2.0 ** 62
    return np.floor(np.clip(x, -most / scale, most / scale) * scale).astype(np.int64)


def _vectors(batch: pa.RecordBatch, scale: int, width: int) -> tuple[list[int], np.ndarray]:
    ids, rows = [], []
    for vec_id, values in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist()):
        x = whole_numbers(values, scale)
        if x is not None and vec_id is not None:
            ids.append(vec_id)
            rows.append(np.pad(x, (0, width - len(x))))
    return ids, np.array(rows, np.int64).reshape(len(rows), width)


def _norms(search: Search):
    schema = pa.schema([("width", pa.int32()), ("norm", pa.float64()), ("asked", pa.int64())])

    def rows(batches):
        width, norm, asked = 0, 0.0, 0
        for batch in batches:
            for vec_id, values in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist()):
                x = whole_numbers(values, search.scale)
                if x is not None:
                    width, norm = max(width, len(x)), max(norm, float((x.astype(np.float64) ** 2).sum()))
                    asked += vec_id is not None and vec_id % search.every == 0
        yield pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), pa.array([norm]), pa.array([asked])], schema=schema)

    return rows


def distances(x: np.ndarray, tail: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of extended vectors to the pivots, which are extended already."""
    whole = np.hstack([x.astype(np.float64), tail[:, None]])
    square = (whole ** 2).sum(1)[:, None] + (pivots ** 2).sum(1)[None] - 2 * whole @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def _assign(search: Search, width: int, norm: float, pivots: np.ndarray):
    schema = pa.schema([("vec_id", pa.int64()), ("query", pa.bool_()), ("cell", pa.int32()), ("chunk", pa.int32()),
                        ("distance", pa.float64()), ("vector", pa.binary())])

    def rows(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, search.chunk):
                ids, x = _vectors(batch.slice(at, search.chunk), search.scale, width)
                if not ids:
                    continue
                square = (x.astype(np.float64) ** 2).sum(1)
                sides = [(np.arange(len(ids)), np.sqrt(np.maximum(norm - square, 0)), False)]
                asked = np.flatnonzero(np.array(ids) % search.every == 0)
                sides.append((asked, np.zeros(len(asked)), True))
                for rows_, tail, query in sides:
                    if not len(rows_):
                        continue
                    far = distances(x[rows_], tail, pivots)
                    cell = far.argmin(1)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([ids[r] for r in rows_], pa.int64()), pa.array([query] * len(rows_)),
                        pa.array(cell.astype(np.int32)), pa.array(np.zeros(len(rows_), np.int32)),
                        pa.array(far[np.arange(len(rows_)), cell]),
                        pa.array([x[r].tobytes() for r in rows_], pa.binary())], schema=schema)

    return rows


def _slack(norm: float) -> float:
    """More than the rounding of any distance between vectors of at most this squared norm."""
    return 1e-6 * (1 + np.sqrt(norm))


def _matrix(vectors: pa.ChunkedArray | pa.Array, width: int = -1) -> np.ndarray:
    return np.frombuffer(b"".join(vectors.to_pylist()), np.int64).reshape(len(vectors), width) \
        if len(vectors) else np.zeros((0, 0), np.int64)


def _reach(search: Search, width: int, norm: float, pivots: np.ndarray, rings: dict[int, tuple[float, float]]):
    """The cells in which each query may have an answer, with the distances to their pivots that it can have."""
    cells = np.array(sorted(rings), np.int32)
    near, far = np.array([rings[c] for c in cells], np.float64).reshape(-1, 2).T
    slack = _slack(norm)
    apart = np.sqrt(((pivots[:, None] - pivots[None]) ** 2).sum(-1))

    def rows(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, search.chunk):
                part = batch.slice(at, search.chunk)
                x, own = _matrix(part.column("vector"), width), part.column("cell").to_numpy()
                kth = np.array([-np.inf if k is None else k for k in part.column("kth").to_pylist()], np.float64)
                to = distances(x, np.zeros(len(x)), pivots)
                square = (x.astype(np.float64) ** 2).sum(1) + norm
                limit = (np.sqrt(np.maximum(square - 2 * kth, 0)) + slack)[:, None]
                low, high, between = to[:, cells] - limit, to[:, cells] + limit, apart[own][:, cells]
                # What lies beyond the bisecting plane of two pivots; planes of close pivots are not exact enough.
                plane = np.where(between > 1e-3 * np.sqrt(norm), to[:, cells] ** 2 - to[np.arange(len(x)), own][:, None] ** 2,
                                 -np.inf) / (2 * np.maximum(between, 1e-300))
                keep = (low <= far) & (high >= near) & (plane <= limit)
                yield pa.RecordBatch.from_arrays([
                    *(part.column(c) for c in ("vec_id", "cell", "vector", "kth")),
                    *(pa.array([list(v[k]) for v, k in zip(values, keep)], pa.list_(kind)) for values, kind in (
                        (np.broadcast_to(cells, keep.shape), pa.int32()), (low, pa.float64()), (high, pa.float64())))],
                    names=["vec_id", "cell", "vector", "kth", "data_cell", "low", "high"])

    return rows


def bounds(cells: DataFrame, asked: DataFrame, search: Search, pivots: np.ndarray) -> dict[tuple[int, int], float]:
    """Least distance to its pivot that data of a cell needs to be replicated to a query cell.

    Read from at most one row per cell and its `k + 1` nearest vec_ids: however many rows share the
    vec_id of a query, k of those are answers to it. A missing pair is not joined.
    """
    farthest = {r["cell"]: r["far"] for r in asked.groupBy("cell").agg(F.max("distance").alias("far")).collect()}
    once = cells.where("NOT query").groupBy("cell", "vec_id").agg(F.min("distance").alias("distance"))
    near = once.groupBy("cell", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("part")).agg(
        F.slice(F.sort_array(F.collect_list(F.struct("distance", "vec_id"))), 1, search.k + 1).alias("near"))
    kept = near.groupBy("cell").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, search.k + 1).alias("near"))
    nearest = {r["cell"]: r["near"] for r in kept.collect()}
    apart = np.sqrt(((pivots[:, None] - pivots[None]) ** 2).sum(-1))
    slack = _slack((pivots ** 2).sum(1).max())
    out = {}
    for i, reach in farthest.items():
        first: dict[int, float] = {}
        for within, vec_id in sorted((apart[i, j] + d, vec_id) for j, ds in nearest.items() for d, vec_id in ds):
            first.setdefault(vec_id, within)
        limit = reach + list(first.values())[search.k] if len(first) > search.k else np.inf
        for j in nearest:
            # |q - x| >= |p_i - p_j| - |q - p_i| - |x - p_j|; the slack is for rounding.
            out[i, j] = apart[i, j] - reach - limit - slack
    return out


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, smaller ids first among equals."""
    if len(ids) > 4 * k:
        least = np.partition(scores, -k)[-k]
        held = np.flatnonzero(scores >= least)
    else:
        held = np.arange(len(ids))
    return held[np.lexsort((ids[held], -scores[held]))[:k]]


def products(queries: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Exact integer inner products; in floating point only where no sum can be rounded."""
    if not queries.size or not data.size:
        return np.zeros((len(queries), len(data)), np.int64)
    if float(np.abs(queries).max()) * float(np.abs(data).max()) * queries.shape[1] < 2.0 ** 53:
        return (queries.astype(np.float64) @ data.astype(np.float64).T).astype(np.int64)
    return queries @ data.T


def _solve(search: Search):
    def solve(work: pa.Table) -> pa.Table:
        mine = work.column("query")
        queries, data = work.filter(mine), work.filter(pa.compute.invert(mine))
        out: list[tuple[np.ndarray, ...]] = []
        if queries.num_rows and data.num_rows:
            query_ids, ids = (t.column("vec_id").to_numpy() for t in (queries, data))
            least = pa.compute.fill_null(queries.column("kth"), -(1 << 63)).to_numpy()
            x = _matrix(data.column("vector"))
            for at in range(0, queries.num_rows, 128):
                scored = products(_matrix(queries.column("vector").slice(at, 128)), x)
                for query, enough, scores in zip(query_ids[at:at + 128], least[at:at + 128], scored):
                    other = np.flatnonzero((ids != query) & (scores >= enough))
                    best = other[best_of(ids[other], scores[other], search.k)]
                    out.append((np.full(len(best), query), ids[best], scores[best]))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=SCORE_TYPES)

    return solve


def _each(count: str):
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col(count).cast("long") - 1))


def _chunk(count: str):
    return F.pmod(F.xxhash64("vec_id"), F.col(count))


UNIT = ["query_cell", "data_cell", "query_chunk", "data_chunk"]
ROW = [*UNIT, "query", "vec_id", "vector", "kth"]


def _met(asked: DataFrame, data: DataFrame, search: Search) -> DataFrame:
    """query_id, vec_id, score of the best answers of each unit; both sides have the columns ROW."""
    return asked.select(*ROW).unionByName(data.select(*ROW)).groupBy(*UNIT).applyInArrow(_solve(search), SCORES)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query_id, ranked; every task drops what is not among its own k best."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(embeddings: DataFrame, search: Search = Search()) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of each query.

    `embeddings` has vec_id and embedding (other columns are not read). Vectors that are null or
    hold null or non-finite components take no part, nor do rows without vec_id; shorter vectors
    are filled up with zeros. Ties go to the smaller vec_id. A row is no answer to rows of its own
    vec_id; rows sharing a vec_id are answers of their own, and queries only once if equal (in whole
    numbers); different queries of one vec_id have the k best of all their answers together.
    Whole numbers end at 2^62 either side of 0; inner products of more than 63 bits are not defined. No
    rows, or no query, give no rows.
    """
    session = embeddings.sparkSession
    python_tasks(session)
    rows = embeddings.selectExpr("CAST(vec_id AS BIGINT) AS vec_id", "CAST(embedding AS ARRAY<DOUBLE>) AS embedding")
    about = rows.mapInArrow(_norms(search), "width int, norm double, asked long").agg(
        F.max("width").alias("width"), F.max("norm").alias("norm"), F.sum("asked").alias("asked")).first()
    width, norm = about["width"] or 0, about["norm"] or 0.0
    wanted = max(search.pivots, min(search.most_pivots, (about["asked"] or 0) // search.queries))
    picked = [r for r in (whole_numbers(r["embedding"], search.scale) for r in bounded_sample(
        rows, search.sample, "vec_id").orderBy(F.xxhash64("vec_id"), "vec_id").limit(wanted).collect()) if r is not None]
    ends = [np.pad(p, (0, width - len(p))).astype(np.float64) for p in picked] or [np.zeros(width)]
    pivots = np.array([np.append(p, np.sqrt(max(norm - (p ** 2).sum(), 0.0))) for p in ends])
    cells = stored(rows.mapInArrow(_assign(search, width, norm, pivots), CELLS), "knn-cells")
    data = cells.where("NOT query").withColumn("kth", F.lit(None).cast("long"))

    asked = stored(cells.where("query").groupBy("vec_id", "vector").agg(F.min(F.struct("cell", "distance")).alias("at")).select(
        "vec_id", F.lit(True).alias("query"), "at.cell", "at.distance", "vector"), "knn-queries")
    held = {r["cell"]: r for r in data.groupBy("cell").agg(
        F.count("cell").alias("n"), F.min("distance").alias("near"), F.max("distance").alias("far")).collect()}
    asking = {r["cell"]: r["n"] for r in asked.groupBy("cell").agg(F.count("cell").alias("n")).collect()}
    limits = bounds(cells, asked, search, pivots)

    def pairs(found):
        """At most one row per pair of cells."""
        return F.broadcast(session.createDataFrame(
            [(i, j, float(low), float(high), -(-n // search.queries), -(-held[j]["n"] // search.chunk)) for i, j, low, high, n in found],
            "query_cell int, data_cell int, low double, high double, query_chunks int, data_chunks int"))

    # One chunk of the cell nearest to a query's own gives a first k-th score.
    nearest = {i: min((low, j) for (at, j), low in limits.items() if at == i)[1] for i in asking} if held else {}
    first = pairs([(i, j, 0.0, 0.0, asking[i]) for i, j in nearest.items()])
    some = data.join(first, F.col("cell") == F.col("data_cell")).where(_chunk("data_chunks") == 0).withColumn(
        "query_chunk", _each("query_chunks")).withColumn("data_chunk", F.lit(0).cast("long"))
    tried = asked.join(first, F.col("cell") == F.col("query_cell")).withColumn("query_chunk", _chunk("query_chunks")).withColumns(
        {"data_chunk": F.lit(0).cast("long"), "kth": F.lit(None).cast("long")})
    kth = _ranked(_met(tried, some, search), search.k).groupBy(F.col("query_id").alias("vec_id")).agg(
        F.min("score").alias("kth"), F.count("score").alias("n")).where(F.col("n") == search.k).drop("n")

    rings = {j: (r["near"], r["far"]) for j, r in held.items()}
    known = merge_lookup(asked, kth, ["vec_id"], "left").select("vec_id", "cell", "vector", "kth")
    reach = stored(known.mapInArrow(_reach(search, width, norm, pivots, rings), REACH), "knn-reach")
    goes = reach.select("vec_id", F.col("cell").alias("query_cell"), "vector", "kth", F.explode(
        F.arrays_zip("data_cell", "low", "high")).alias("to")).select("*", "to.data_cell", "to.low", "to.high").drop("to")
    second = pairs([(r["query_cell"], r["data_cell"], max(r["low"], limits[r["query_cell"], r["data_cell"]]), r["high"], r["n"])
                    for r in goes.groupBy("query_cell", "data_cell").agg(
                        F.min("low").alias("low"), F.max("high").alias("high"), F.count("low").alias("n")).collect()])
    moved = data.join(second, F.col("cell") == F.col("data_cell")).where(F.col("distance").between(F.col("low"), F.col("high"))) \
        .withColumn("query_chunk", _each("query_chunks")).withColumn("data_chunk", _chunk("data_chunks"))
    asks = goes.drop("low", "high").withColumn("query", F.lit(True)).join(second, ["query_cell", "data_cell"]).withColumn(
        "query_chunk", _chunk("query_chunks")).withColumn("data_chunk", _each("data_chunks"))
    return _ranked(_met(asks, moved, search), search.k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, list_dot_product(q.v, d.v)::BIGINT AS score
      FROM v q JOIN v d ON q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id)
SELECT query_id, (ROW_NUMBER() OVER w)::INTEGER AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY ROW_NUMBER() OVER w <= 10
"""
