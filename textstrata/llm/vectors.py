"""Operator 10, embedding near-duplicates through a pivot-permutation index.

Reference points are vectors chosen by a hash of their components (the square
root of their number, so that lists keep their length as the table grows; every
vector is indexed), no two of them at cosine ``APART`` or more. A vector is
described by its ordered nearest points (``nearest_of``), and is entered in the
inverted list of each pair of them, so vectors that meet in a list share two
points at least: their shared-pivot count. The vectors of a list are then
verified by cosine in double precision; a pair that meets in several lists
counts in the list of its two least shared points only.

Inside a dense group, nearest points would be decided by noise. So a point that
stands for ``CROWD`` or more sampled vectors leads a crowd, and all links of
the vectors about it are found exactly: they are compared with each other and
with every vector that the triangle inequality lets link with one of them.
Only links between vectors outside all crowds rest on shared points.

Equal vectors are one entry with a count and a number of its own; ids take no
part in the search, so an id that repeats with other vectors mixes nothing up.
Long lists are dealt in pairs of
blocks. Lists give the numbers of links and a spanning subset of them; pairs
are never listed.

Defined results: null and empty vectors, zero vectors, and vectors with a null
or non-finite component link with nothing, as do vectors of a dimension that
differs (dimensions are indexed apart); rows with a null vec_id link with
nothing and have no component; repeated rows are other vectors and link; rows
of one id with different vectors are vectors of their own; a vector's own component is its vec_id if nothing else is reachable; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import batches_of, by_group, components, drop_stage, stage

COSINE = 0.9
#: Sampled vectors: the square root of the number of vectors, so many at least; nearest points that describe a vector, up to about 100 points.
POINTS_LEAST, NEAREST = 32, 6
#: Sampled vectors at this cosine of a reference point are none themselves; a point with so many of them (itself included) leads a crowd.
APART, CROWD = 0.7, 3
#: Vectors of a list that are verified in one task: blocks of so many at least and at most; pairs that are held at a time.
BLOCK_LEAST, BLOCK_MOST, CELLS = 128, 8192, 1 << 21


def usable(c: str):
    """Whether a vector can link at all."""
    value = F.col(c)
    return F.coalesce((F.size(value) > 0) & F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(value, lambda x: x != 0), F.lit(False))


@dataclass(frozen=True)
class Points:
    """Reference points of one dimension, no two of them at cosine ``APART`` or more, and which of them lead a crowd."""

    at: np.ndarray
    crowd: np.ndarray


def spread_points(sample: np.ndarray) -> Points:
    """Points kept in the sample's order where none before is near; those with ``CROWD`` sampled vectors at least lead a crowd."""
    at = np.empty_like(sample)
    kept = 0
    for row in sample:
        if not (at[:kept] @ row >= APART).any():
            at[kept] = row
            kept += 1
    at = at[:kept].copy()
    close = np.concatenate([(sample[i : i + 512] @ at.T).argmax(axis=1) for i in range(0, len(sample), 512)])
    return Points(at, np.bincount(close, minlength=kept) >= CROWD)


def gaps(one: np.ndarray, other: np.ndarray, cosine: float = COSINE) -> np.ndarray:
    """Per pair of points: how much nearer the second may be to a vector that links with a vector whose nearest point is the first."""
    return np.sqrt(np.maximum(2 - 2 * np.einsum("ij,ij->i", one, other), 0)) * math.sqrt(2 - 2 * cosine) + 1e-6


def reference_points(unique: DataFrame) -> dict[int, Points]:
    """Per dimension, its reference points, from a sample by a hash of the vector."""
    counts = {r["d"]: r["count"] for r in unique.groupBy(F.size("v").alias("d")).count().collect()}
    out = {}
    for d, n in counts.items():
        rows = unique.filter(F.size("v") == d).select("v").orderBy(F.xxhash64("v", F.lit(10)), "v").limit(max(POINTS_LEAST, math.isqrt(n))).collect()
        m = np.array([r["v"] for r in rows], np.float64)
        out[d] = spread_points(unit(m))
    return out


def nearest_of(points: int) -> int:
    """How many nearest points describe a vector: one more for each doubling of a hundred points."""
    return NEAREST + max(0, round(math.log2(max(points, 1) / 100)))


def nearest_points(v: np.ndarray, points: np.ndarray, k: int | None = None) -> np.ndarray:
    """The permutation's head: each vector's k nearest points in order; ties by the point's number."""
    near = v @ points.T
    k = min(k or nearest_of(len(points)), len(points))
    return np.argsort(-near, axis=1, kind="stable")[:, :k]


def crowd_places(v: np.ndarray, points: Points, cosine: float = COSINE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each vector's own crowd (-1 without one), and the rows and crowds (row, crowd) where a link of a member may end.

    A member's nearest point leads the crowd, at cosine ``APART`` at least. Vectors that link with a member lie within
    the sum of both angles, and no other point is much nearer to them. Of two crowds the lesser one holds their links.
    """
    near = v @ points.at.T
    first = near.argmax(axis=1)
    best = near[np.arange(len(v)), first]
    home = np.where(points.crowd[first] & (best >= APART), first, -1)
    leads = np.flatnonzero(points.crowd)
    reach = math.cos(min(math.pi, math.acos(APART) + math.acos(cosine))) - 1e-6
    row, which = np.nonzero((near[:, leads] >= reach) & ((home[:, None] < 0) | (home[:, None] >= leads)))
    c = leads[which]
    fits = (home[row] == c) | (near[row, c] >= best[row] - gaps(points.at[c], points.at[first[row]], cosine))
    return home, row[fits], c[fits]


def index_lists(unique: DataFrame, points: dict[int, Points], cosine: float = COSINE) -> DataFrame:
    """Rows (d, p, q, home, node, copies, near, v): with q = -1 for each crowd p that a vector may link into; for vectors outside crowds, also one for each pair p < q of the nearest points."""
    spark = unique.sparkSession
    shared = spark.sparkContext.broadcast(points)
    kind = number_type(unique)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(sizes):
                rows = batch.filter(pa.array(sizes == d))
                stored = np.asarray(rows.column("v").flatten().to_numpy(zero_copy_only=False), kind).reshape(rows.num_rows, d)
                m = unit(stored)
                own = shared.value[int(d)]
                near = nearest_points(m, own.at)
                home, guest, crowd = crowd_places(m, own, cosine)
                lone = np.flatnonzero(home < 0)
                k = near.shape[1]
                a, b = np.triu_indices(k, 1) if k > 1 else (np.zeros(1, int), np.zeros(1, int))
                p, q = np.minimum(near[lone][:, a], near[lone][:, b]), np.maximum(near[lone][:, a], near[lone][:, b])
                row = np.concatenate((np.repeat(lone, len(a)), guest))
                p, q = np.concatenate((p.ravel(), crowd)), np.concatenate((q.ravel(), np.full(len(crowd), -1)))
                packed = [near[i].astype("<i4").tobytes() for i in range(rows.num_rows)]
                raw = [stored[i].tobytes() for i in range(rows.num_rows)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(row), d, np.int32)), pa.array(p.astype(np.int32)), pa.array(q.astype(np.int32)), pa.array(home[row].astype(np.int32)), rows.column("node").take(pa.array(row)), rows.column("copies").take(pa.array(row)), pa.array([packed[i] for i in row], pa.binary()), pa.array([raw[i] for i in row], pa.binary())],
                    names=["d", "p", "q", "home", "node", "copies", "near", "v"],
                )

    return unique.select("node", "copies", "v").mapInArrow(run, "d int, p int, q int, home int, node long, copies long, near binary, v binary")


def number_type(unique: DataFrame) -> type:
    """How the vectors' components are stored: as floats where they came as such, else as doubles."""
    return np.float32 if isinstance(unique.schema["v"].dataType.elementType, FloatType) else np.float64


def unit(stored: np.ndarray) -> np.ndarray:
    m = stored.astype(np.float64)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def merge_labels(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Labels (the least number of each set; roots label themselves) after joining the sets of x[i] and y[i]."""
    while True:
        a, b = label[x], label[y]
        differ = a != b
        if not differ.any():
            return label
        x, y, a, b = x[differ], y[differ], a[differ], b[differ]
        label = label.copy()
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := label[label], label):
            label = up


def list_links(lists: DataFrame, cosine: float = COSINE, kind: type = np.float64) -> DataFrame:
    """Rows (a, b, n): with b null, vector a has n more links (copies counted); else a link of a spanning subset."""
    sizes = lists.groupBy("d", "p", "q").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > 2 * BLOCK_LEAST)
    block = F.least(F.greatest(F.ceil(F.col("m") / 8), F.lit(BLOCK_LEAST)), F.lit(BLOCK_MOST))
    long = sizes.select("d", "p", "q", F.ceil(F.col("m") / block).cast("int").alias("nb"))
    cut = lists.join(long, ["d", "p", "q"], "left").withColumn("nb", F.coalesce("nb", F.lit(1)))
    own = F.pmod(F.xxhash64("node", F.lit(3)), F.col("nb")).cast("int")
    dealt = cut.withColumn("own", own).select("d", "p", "q", "home", "node", "copies", "near", "v", "own", F.explode(F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("j")))).alias("k"))
    dealt = dealt.select("d", "p", "q", F.col("k.i").alias("i"), F.col("k.j").alias("j"), "own", "home", "node", "copies", "near", "v")

    def run(table: pa.Table) -> Iterable[pa.RecordBatch]:
        p, q, i, j = (table[c][0].as_py() for c in ("p", "q", "i", "j"))
        v = unit(np.frombuffer(b"".join(table["v"].to_pylist()), kind).reshape(table.num_rows, -1))
        near = np.frombuffer(b"".join(table["near"].to_pylist()), "<i4").reshape(table.num_rows, -1)
        node, copies, own, home = (table[c].to_numpy() for c in ("node", "copies", "own", "home"))
        one, other = (np.flatnonzero(own == x) for x in (i, j))
        n, label = np.zeros(len(node)), np.arange(len(node))
        step = max(1, CELLS // max(1, len(other)))
        for s in range(0, len(one), step):
            x = one[s : s + step]
            y = other if i != j else other[s:]
            links = v[x] @ v[y].T >= cosine
            if i == j:
                links &= x[:, None] < y
            if q < 0:
                links &= (home[x] == p)[:, None] | (home[y] == p)
            else:
                # counted here only if p and q are the two least points that both have
                r, c = np.nonzero(links)
                shared = np.zeros(len(r), np.int64)
                for a in range(near.shape[1]):
                    point = near[x[r], a]
                    shared += (point <= q) & (near[y[c]] == point[:, None]).any(axis=1)
                drop = shared != (2 if p != q else 1)
                links[r[drop], c[drop]] = False
            n[x] += links @ copies[y].astype(np.float64)
            n[y] += copies[x].astype(np.float64) @ links
            r, c = np.nonzero(links & (label[x][:, None] != label[y]))
            label = merge_labels(label, x[r], y[c])
        some = np.flatnonzero(n)
        tied = some[label[some] != some]
        yield pa.RecordBatch.from_pydict({
            "a": pa.array(np.concatenate((node[some], node[tied]))), "b": pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(node[label[tied]])]),
            "n": pa.array(np.concatenate((n[some].astype(np.int64), np.zeros(len(tied), np.int64)))),
        })

    with batches_of(lists.sparkSession, 256):
        return stage(by_group(dealt, ["d", "p", "q", "i", "j"], run, "a long, b long, n long"), "vector_links")


def near_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Per row: key, n_links, component_id, kept."""
    rows = df.select(F.col(key).alias("id"), F.col(vector).alias("v"), (usable(vector) & F.col(key).isNotNull()).alias("ok"))
    # written once, the numbers stay as they are
    unique = stage(rows.filter("ok").groupBy("v").agg(F.min("id").cast("long").alias("least"), F.count(F.lit(1)).alias("copies")).withColumn("node", F.monotonically_increasing_id()), "vectors")
    with batches_of(df.sparkSession, 2000):
        lists = stage(index_lists(unique, reference_points(unique)), "lists")
    found = list_links(lists, kind=number_type(unique))
    drop_stage(lists)
    roots = components(found.filter("b IS NOT NULL")).withColumnRenamed("root", "r")
    counts = found.filter("b IS NULL").groupBy("a").agg(F.sum("n").alias("n"))
    known = unique.join(counts, unique.node == counts.a, "left").join(roots.withColumnRenamed("node", "x"), F.col("node") == F.col("x"), "left").withColumn("root", F.coalesce("r", "node"))
    named = known.groupBy("root").agg(F.min("least").alias("component_id"))
    heads = stage(known.join(named, "root").select(F.col("v").alias("hv"), F.xxhash64("v").alias("hh"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"), "heads")
    drop_stage(unique, found)
    out = rows.withColumn("h", F.when(F.col("ok"), F.xxhash64("v"))).join(heads, (F.col("h") == F.col("hh")) & (F.col("v") == F.col("hv")), "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def op10_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = f"""
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM e a JOIN e b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= {COSINE}),
r AS (WITH RECURSIVE c(x, y) AS (SELECT vec_id, vec_id FROM e UNION SELECT c.x, p.y FROM c JOIN p ON c.y = p.x) SELECT x, min(y) AS m FROM c GROUP BY x)
SELECT vec_id, (SELECT count(*) FROM p WHERE p.x = e.vec_id)::BIGINT AS n_links, m AS component_id, vec_id = m AS kept FROM e JOIN r ON r.x = e.vec_id"""
