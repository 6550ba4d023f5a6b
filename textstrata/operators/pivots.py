"""Exact nearest neighbours without comparing all: pivots, blocks, and the triangle inequality.

Unit vectors have the distance d with d * d = 2 - 2 cos, which is a metric. A few pivots are picked from the table by a seeded hash; each vector
stores its distances from them and belongs to the block of its nearest pivot and of the ring that it lies in about that pivot. A block keeps the
least and greatest distance of its vectors from every pivot: from |d(q, p) - d(p, v)| <= d(q, v) follows how near to a query any vector of it
can be. A first pass compares each query with its most promising blocks, which bounds the distance of its k-th neighbour; a second pass leaves out
every block that lies beyond that bound. Both passes read the vectors where they lie, a block at a time as one matrix product, and each task
keeps its own k best; nothing is left out but what cannot be among the k. How much that is depends on the vectors (``compared`` tells).

Vectors that are null, zero, of another length, or hold null or non-finite parts are nobody's neighbours, and as queries find nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Pivots, rings about each, queries in a pass; all that tasks hold of the table is bounded by them.
PIVOTS, RINGS, QUERIES = 24, 8, 1000
#: What floating-point distances may be off by.
SLACK = 1e-7


def _matrix(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows of those vectors that have a direction and ``size`` parts, and their places."""
    rows = [np.array(v, np.float64) if v is not None and None not in v else None for v in column.to_pylist()]
    fit = [i for i, v in enumerate(rows) if v is not None and len(v) == size and np.isfinite(v).all() and v.any()]
    made = np.array([rows[i] for i in fit]).reshape(len(fit), size)
    # scaled first: squares of very small or large parts leave the range
    made /= np.abs(made).max(axis=1, keepdims=True) if len(fit) else 1
    return made / np.linalg.norm(made, axis=1, keepdims=True) if len(fit) else made, np.array(fit, np.int64)


@dataclass
class PivotIndex:
    """Blocked vectors (key, unit, block), the pivots, and per block its number of vectors and its least and greatest distance from each pivot."""

    rows: DataFrame
    pivots: np.ndarray
    blocks: np.ndarray
    counts: np.ndarray
    low: np.ndarray
    high: np.ndarray
    kind: str

    @property
    def size(self) -> int:
        return int(self.counts.sum())


def _ties(away):
    """As far as what rounds to the same cosine distance may be."""
    return np.sqrt(away * away + 4e-9)


def _away(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * a @ b.T))


def pivot_index(vectors: DataFrame, stage, key: str = "vec_id", vector: str = "embedding", pivots: int = PIVOTS, rings: int = RINGS, seed: int = 11) -> PivotIndex:
    """Index a table of vectors; ``stage`` writes a frame to shared storage and reads it back. Two scans: the pivots, then the rows; pivots * rings blocks at most."""
    fits = F.filter(F.coalesce(F.col(vector), F.array().cast("array<double>")), lambda x: (x.isNotNull()) & (x != 0))
    chosen = vectors.filter(F.size(fits) > 0).select(F.col(vector).cast("array<double>").alias("v")).orderBy(F.xxhash64("v", F.lit(seed))).limit(4 * pivots).collect()
    lengths = [len(r["v"]) for r in chosen]
    size = max(set(lengths), key=lengths.count) if lengths else 0
    points = _matrix(pa.array([r["v"] for r in chosen], pa.list_(pa.float64())), size)[0]
    # of the sample, points far from each other: each next one is the farthest from those before
    picked = [0] if len(points) else []
    while len(picked) < min(pivots, len(points)):
        gap = _away(points, points[picked]).min(axis=1)
        if gap.max() <= SLACK:
            break
        picked.append(int(gap.argmax()))
    points = points[picked]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit, fit = _matrix(batch.column("vector"), size)
            away = _away(unit, points) if len(points) else np.zeros((len(unit), 0))
            near = away.argmin(axis=1) if len(points) and len(unit) else np.zeros(len(unit), np.int64)
            # distances of unit vectors are 2 at most
            ring = np.minimum(rings - 1, (away[np.arange(len(unit)), near] * rings / 2).astype(np.int64)) if len(points) and len(unit) else near
            yield pa.record_batch([batch.column("key").take(pa.array(fit)), pa.array(list(unit), pa.list_(pa.float64())), pa.array(near * rings + ring, pa.int64()), pa.array(list(away), pa.list_(pa.float64()))], ["key", "unit", "block", "away"])

    plain = vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    kind = plain.schema["key"].dataType.simpleString()
    rows = stage(plain.mapInArrow(place, f"key {kind}, unit array<double>, block bigint, away array<double>"))
    sides = [f(F.get("away", F.lit(i))).alias(f"{name}{i}") for i in range(len(points)) for name, f in (("low", F.min), ("high", F.max))]
    made = rows.groupBy("block").agg(F.count(F.lit(1)).alias("n"), *sides).orderBy("block").collect()
    side = lambda name: np.array([[r[f"{name}{i}"] for i in range(len(points))] for r in made], np.float64).reshape(len(made), len(points))
    return PivotIndex(rows, points, np.array([r["block"] for r in made], np.int64), np.array([r["n"] for r in made], np.int64), side("low"), side("high"), kind)


def _pass(index: PivotIndex, ids: np.ndarray, units: np.ndarray, wanted: np.ndarray, k: int, name: str) -> DataFrame:
    """Each task's k nearest of every query among the vectors of its wanted blocks, with the number of vectors compared (query_id, key, away, compared)."""
    order = {int(b): i for i, b in enumerate(index.blocks)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, list]] = {}
        compared = np.zeros(len(ids), np.int64)
        kind = None
        for batch in batches:
            kind = batch.schema.field("key").type
            block = batch.column("block").to_numpy()
            for b in np.unique(block):
                asked = np.flatnonzero(wanted[:, order[int(b)]])
                if not len(asked):
                    continue
                own = np.flatnonzero(block == b)
                unit = np.array(batch.column("unit").take(pa.array(own)).values.to_numpy()).reshape(len(own), -1)
                away = _away(units[asked], unit)
                keys = batch.column("key").take(pa.array(own)).to_pylist()
                compared[asked] += len(own)
                cut = min(k, len(own))
                # ties at the k-th distance are kept for the order by key
                edge = np.partition(away, cut - 1, axis=1)[:, cut - 1]
                for row, q in enumerate(asked.tolist()):
                    near = np.flatnonzero(away[row] <= _ties(edge[row]))
                    was = best.get(q, (np.zeros(0), []))
                    d, names = np.concatenate([was[0], away[row, near]]), was[1] + [keys[i] for i in near.tolist()]
                    if len(d) > 4 * k:
                        keep = np.flatnonzero(d <= _ties(np.partition(d, k - 1)[k - 1]))
                        d, names = d[keep], [names[i] for i in keep.tolist()]
                    best[q] = d, names
        if kind is not None:
            q = [i for i, (d, _) in best.items() for _ in range(len(d))]
            out = [pa.array(ids[q], pa.int64()), pa.array([n for _, names in best.values() for n in names], kind), pa.array(np.concatenate([d for d, _ in best.values()]) if best else [], pa.float64()), pa.nulls(len(q), pa.int64())]
            some = np.flatnonzero(compared)
            told = [pa.array(ids[some], pa.int64()), pa.nulls(len(some), kind), pa.nulls(len(some), pa.float64()), pa.array(compared[some], pa.int64())]
            for columns in (out, told):
                yield pa.record_batch(columns, ["query_id", "key", "away", "compared"])

    return index.rows.select("key", "unit", "block").mapInArrow(run, f"query_id bigint, key {index.kind}, away double, compared bigint").withColumn("pass", F.lit(name))


def nearest_by_pivots(index: PivotIndex, queries: DataFrame, k: int, stage, key: str = "vec_id", farthest: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Exact k nearest vectors of a stated table of queries (query_id long, query): (query_id, key, distance, rank), and (query_id, compared).

    Distances are cosine distances to nine decimals, ties by key. Queries are taken in blocks of ``QUERIES``.
    """
    asked = [(r["query_id"], r["query"]) for r in queries.select(F.col("query_id").cast("long"), F.col("query").cast("array<double>")).collect()]
    dims = index.pivots.shape[1] if len(index.pivots) else 0
    found, counted = [], []
    for at in range(0, max(1, len(asked)), QUERIES):
        part = asked[at : at + QUERIES]
        units, fit = _matrix(pa.array([v for _, v in part], pa.list_(pa.float64())), dims)
        ids = np.array([part[i][0] for i in fit.tolist()], np.int64)
        to_pivot = _away(units, index.pivots) if dims else np.zeros((len(units), 0))
        # the nearest that any vector of a block can be
        gap = np.maximum(index.low[None] - to_pivot[:, None], to_pivot[:, None] - index.high[None])
        least = np.maximum(0, gap.max(axis=2)) if dims else np.zeros((len(units), len(index.blocks)))
        order = least.argsort(axis=1, kind="stable")
        filled = np.cumsum(index.counts[order], axis=1)
        first = np.zeros(least.shape, bool)
        np.put_along_axis(first, order, (filled - index.counts[order]) < 4 * k, axis=1)
        near = stage(_pass(index, ids, units, first, k, "first"))
        place = Window.partitionBy("query_id").orderBy("away")
        ends = near.filter("away IS NOT NULL").withColumn("n", F.row_number().over(place)).filter(F.col("n") <= k).filter(F.col("n") == k).select("query_id", "away")
        bound = dict.fromkeys(ids.tolist(), np.inf) | {r["query_id"]: r["away"] for r in ends.collect()}
        limit = np.array([bound[i] for i in ids.tolist()]).reshape(-1, 1)
        if farthest is not None:
            limit = np.minimum(limit, np.sqrt(2 * farthest) + SLACK)
        rest = (least <= _ties(limit) + SLACK) & ~first
        found.append(near.unionAll(_pass(index, ids, units, rest, k, "second")))
        counted.append(found[-1])
    both = stage(reduce(DataFrame.unionAll, found))
    hits = both.filter("away IS NOT NULL").select("query_id", F.col("key").alias(key), (F.round(F.col("away") * F.col("away") / 2, 9) + 0.0).alias("distance"))
    if farthest is not None:
        hits = hits.filter(F.col("distance") <= farthest)
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", key))).filter(F.col("rank") <= k)
    return ranked, both.filter("compared IS NOT NULL").groupBy("query_id").agg(F.sum("compared").alias("compared"))
