"""Search: exact fields, keywords, vectors, cascades and fusion, for one query or for a table of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text as X
from ..functions.numerals import article_number, document_number
from ..sources.commits import staged
from .access import effective_on

INSTRUMENT_TYPES = {"constitution", "law", "administrative_regulation", "judicial_interpretation", "local_regulation", "department_rule", "other"}
REVIEW_STATES = {"pending", "approved", "rejected"}
FARTHEST = 0.5


@dataclass(frozen=True)
class Query:
    """Exact fields, and at most one of keyword and semantic. Unknown enumeration values are errors, not empty results."""

    title: str | None = None
    document_number: str | None = None
    stable_id: str | None = None
    jurisdiction: str | None = None
    article: str | None = None
    instrument_types: tuple[str, ...] = ()
    review_states: tuple[str, ...] = ()
    include_not_yet_effective: bool = False
    effective_on: str | None = None
    keyword: str | None = None
    semantic: str | None = None
    limit: int = 20
    unknown: tuple[str, ...] = field(default=(), init=False)

    def __post_init__(self):
        if self.keyword and self.semantic:
            raise ValueError("keyword and semantic exclude each other")
        odd = [*(set(self.instrument_types) - INSTRUMENT_TYPES), *(set(self.review_states) - REVIEW_STATES)]
        if odd:
            raise ValueError(f"unknown values: {sorted(odd)}")


def exact_filters(q: Query) -> list[Column]:
    """The same predicates for every arm of a search. An article number that can't be read matches nothing."""
    from ..functions.legal import title

    out: list[Column] = []
    same = lambda c, value: F.col(c) == value
    if q.title:
        out.append(same("title", title(F.lit(q.title))))
    if q.document_number:
        out.append(same("document_number_normalized", document_number(F.lit(q.document_number))))
    if q.stable_id:
        out.append(same("stable_id", F.lit(q.stable_id)))
    if q.jurisdiction:
        out.append(same("jurisdiction", F.lit(q.jurisdiction)))
    if q.article:
        out.append(F.coalesce(same("provision_number", article_number(F.lit(q.article))), F.lit(False)))
    if q.instrument_types:
        out.append(F.col("instrument_type").isin(*q.instrument_types))
    if q.review_states:
        out.append(F.col("review_status").isin(*q.review_states))
    if not q.include_not_yet_effective:
        out.append(F.col("legal_status") != "not_yet_effective")
    if q.effective_on:
        out.append(effective_on(F.lit(q.effective_on).cast("date")))
    return out


def filtered(df: DataFrame, q: Query) -> DataFrame:
    return reduce(DataFrame.filter, exact_filters(q), df)


# Keyword strategies: a match on the text column, and an order of relevance.
def raw_substring(c: Column, query: str) -> Column:
    """LIKE as written: % and _ of the query are wildcards."""
    return c.like(f"%{query}%")


def flat_substring(c: Column, query: str) -> Column:
    return X.flatten_stored(c).like("%" + "".join(query.split()) + "%")


def all_terms(c: Column, query: str) -> Column:
    """Every term occurs, white space aside; no terms match nothing."""
    found = [X.flatten_stored(c).like(f"%{t}%") for t in X.split_terms(query)]
    return reduce(lambda a, b: a & b, found) if found else F.lit(False)


def trigram_match(c: Column, query: str, least: float = 0.3) -> Column:
    return X.jaccard(X.trigrams(c), X.trigrams(F.lit(query))) >= least


def word_match(c: Column, query: str, least: float = 0.6) -> Column:
    return X.word_similarity(F.lit(query), c) >= least


def shortest_first(c: Column, query: str) -> Column:
    return F.length(X.flatten_stored(c)).asc()


def most_similar(c: Column, query: str) -> Column:
    return X.jaccard(X.trigrams(c), X.trigrams(F.lit(query))).desc()


def most_word_similar(c: Column, query: str) -> Column:
    return X.word_similarity(F.lit(query), c).desc()


Match = Callable[[Column, str], Column]
STRATEGIES: dict[str, tuple[Match, Match]] = {
    "substring_raw": (raw_substring, shortest_first),
    "substring_flat": (flat_substring, shortest_first),
    "all_terms_flat": (all_terms, shortest_first),
    "trigram": (trigram_match, most_similar),
    "word_trigram": (word_match, most_word_similar),
}


def keyword(df: DataFrame, query: str, strategy: str = "all_terms_flat", text: str = "text", ties: tuple[str, ...] = ("doc_id",), limit: int | None = None) -> DataFrame:
    """Matching rows in order of relevance; with a limit one row more is returned, so that the caller sees truncation."""
    match, order = STRATEGIES[strategy]
    out = df.filter(match(F.col(text), query))
    return out.orderBy(order(F.col(text), query), *ties).limit(limit + 1) if limit is not None else out


def keyword_many(df: DataFrame, queries: DataFrame, text: str = "text", key: str = "doc_id", limit: int | None = None) -> DataFrame:
    """All-terms search for a stated table of queries (query_id, terms), which is broadcast in blocks of a bounded size.

    Rows (query_id, key, n_flat, rank); rank orders by length, then key. With a limit, each partition keeps its own best rows before the shuffle.
    Without one, a hit's rank is the number of its query's shorter hits and its place among those of its length, so no task orders a whole query.
    """
    flat = df.select(key, X.flatten_stored(F.col(text)).alias("_flat"))
    asked = queries.filter(F.size("terms") > 0)
    blocks = max(1, -(-asked.count() // 1000))
    parts = [asked.filter(F.pmod(F.hash("query_id"), F.lit(blocks)) == b) for b in range(blocks)] if blocks > 1 else [asked]
    found = [flat.join(F.broadcast(p), F.forall("terms", lambda t: F.contains(F.col("_flat"), t))) for p in parts]
    hits = reduce(DataFrame.unionAll, found).select("query_id", key, F.length("_flat").alias("n_flat"))
    if limit is not None:
        by_length = Window.partitionBy("query_id").orderBy("n_flat", key)
        return hits.withColumn("rank", F.row_number().over(by_length)).filter(F.col("rank") <= limit)
    hits = staged(hits, "hits")
    shorter = F.coalesce(F.sum("n").over(Window.partitionBy("query_id").orderBy("n_flat").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lengths = hits.groupBy("query_id", "n_flat").agg(F.count(F.lit(1)).alias("n")).withColumn("shorter", shorter).drop("n")
    place = F.row_number().over(Window.partitionBy("query_id", "n_flat").orderBy(key))
    return hits.withColumn("place", place).join(lengths, ["query_id", "n_flat"]).select("query_id", key, "n_flat", (F.col("shorter") + F.col("place")).cast("long").alias("rank"))


def merge_variants(hits: DataFrame, key: str = "doc_id", limit: int = 20) -> DataFrame:
    """Hits of query variants (query_id, variant, rank, key) as one list: first seen wins, variants in order, limit + 1 rows."""
    first = Window.partitionBy("query_id", key).orderBy("variant", "rank")
    kept = hits.filter(F.col("rank") <= limit + 1).withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    place = Window.partitionBy("query_id").orderBy("variant", "rank", key)
    return kept.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= limit + 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def nearest(vectors: DataFrame, query: list[float], k: int, key: str = "vec_id", vector: str = "embedding", farthest: float | None = None) -> DataFrame:
    """Exact nearest neighbours of one vector: (key, distance), ties by key; a top-k without a full sort."""
    asked = F.array(*[F.lit(float(x)) for x in query])
    out = vectors.select(key, cosine_distance(F.col(vector), asked).alias("distance"))
    if farthest is not None:
        out = out.filter(F.col("distance") <= farthest)
    return out.orderBy("distance", key).limit(k)


#: Queries and vectors that one comparison of blocks holds, and what its distances may be off before they are computed singly.
QUERY_BLOCK, VECTOR_BLOCK, SLACK = 256, 4096, 2e-9
#: Queries that one broadcast holds.
ASKED_AT_ONCE = 20_000


def _packed(rows: DataFrame, key: str, vector: str, block: int) -> DataFrame:
    """Rows as blocks (keys, vectors, norms): a partition's rows in order, so many at a time; those without a whole vector are left out."""
    kind = rows.schema[key].dataType.simpleString()
    values = F.col(vector).cast("array<double>")
    whole = rows.select(F.col(key).alias("key"), values.alias("v")).filter(F.col("key").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                sizes = pc.list_value_length(part["v"])
                for size in pc.unique(sizes).to_pylist():
                    own = part.filter(pc.equal(sizes, size))
                    flat = own["v"].flatten().to_numpy(zero_copy_only=False).astype("float64")
                    yield pa.RecordBatch.from_arrays([pa.array([own["key"].to_pylist()], pa.list_(own["key"].type)), pa.array([size], pa.int32()), pa.array([flat.tobytes()], pa.binary())], ["keys", "size", "packed"])

    return whole.mapInArrow(run, f"keys array<{kind}>, size int, packed binary")


def exact_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine distances of rows, summed in order of the places, so that equal vectors have equal ones wherever they stand."""
    dot = aa = bb = np.zeros(len(a))
    for x, y in zip(a.T, b.T, strict=True):
        dot, aa, bb = dot + x * y, aa + x * x, bb + y * y
    with np.errstate(divide="ignore", invalid="ignore"):
        return 1 - dot / np.sqrt(aa * bb)


def near_in_block(asked: np.ndarray, vectors: np.ndarray, keys: np.ndarray, k: int | None, farthest: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, distance) of two blocks: all pairs within ``farthest``, of each query the k nearest. A matrix product finds candidates."""
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        unit = lambda m: m / np.sqrt((m * m).sum(axis=1))[:, None]
        rough = 1 - unit(asked) @ unit(vectors).T
    # what has no angle has no distance
    rough[np.isnan(rough)] = np.inf
    most = np.full(len(asked), 3.0 if farthest is None else farthest + SLACK)
    if k is not None and k < len(vectors):
        most = np.minimum(most, np.partition(rough, k - 1, axis=1)[:, k - 1] + SLACK)
    q, v = np.nonzero(rough <= most[:, None])
    away = np.concatenate([np.empty(0), *[exact_distances(asked[q[i : i + 65_536]], vectors[v[i : i + 65_536]]) for i in range(0, len(q), 65_536)]])
    kept = np.isfinite(away) if farthest is None else away <= farthest
    q, v, away = q[kept], v[kept], away[kept]
    if k is not None:
        order = np.lexsort((keys[v], away, q))
        q, v, away = q[order], v[order], away[order]
        first = np.searchsorted(q, np.arange(len(asked)))
        kept = np.arange(len(q)) - first[q] < k
        q, v, away = q[kept], v[kept], away[kept]
    return q, v, away


def _near_pairs(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int | None, farthest: float | None) -> DataFrame:
    """(query_id, key, distance) of a stated table of queries and all vectors, each block of queries with each block of vectors.

    Of each pair of blocks only what is near comes out. Vectors that are null, or hold null or no number, or have no length, are near nothing.
    """
    own = _packed(vectors, key, vector, VECTOR_BLOCK)
    shares = max(1, -(-queries.count() // ASKED_AT_ONCE))
    parts = [_packed(queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(shares)) == s), "query_id", "query", QUERY_BLOCK) for s in range(shares)]
    ids, kind = queries.schema["query_id"].dataType.simpleString(), vectors.schema[key].dataType.simpleString()
    # tasks as many as blocks of vectors allow: small tables have few partitions
    spread = own.repartition(4 * vectors.sparkSession.sparkContext.defaultParallelism)
    named = [p.select(F.col("keys").alias("ids"), F.col("size").alias("asked_size"), F.col("packed").alias("asked")) for p in parts]
    pairs = reduce(DataFrame.unionAll, [spread.crossJoin(F.broadcast(p)).filter("size = asked_size").drop("asked_size") for p in named])
    out_schema = pa.schema([("query_id", to_arrow_type(queries.schema["query_id"].dataType)), (key, to_arrow_type(vectors.schema[key].dataType)), ("distance", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                size = batch["size"][i].as_py()
                matrix = lambda c: np.frombuffer(batch[c][i].as_buffer(), dtype="float64").reshape(-1, size)  # noqa: B023, E731
                keys, names = batch["keys"][i].values, batch["ids"][i].values
                order = pc.sort_indices(keys)
                place = np.empty(len(keys), dtype="int64")
                place[order.to_numpy()] = np.arange(len(keys))
                q, v, away = near_in_block(matrix("asked"), matrix("packed"), place, k, farthest)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(q)).cast(out_schema.field(0).type), keys.take(pa.array(v)).cast(out_schema.field(1).type), pa.array(away)], schema=out_schema)

    return pairs.select("keys", "size", "packed", "ids", "asked").mapInArrow(run, f"query_id {ids}, `{key}` {kind}, distance double")


def within_many(vectors: DataFrame, queries: DataFrame, farthest: float, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """All vectors within a distance of a stated table of queries (query_id, query): (query_id, key, distance)."""
    return _near_pairs(vectors, queries, key, vector, None, farthest)


def nearest_many(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", farthest: float | None = None) -> DataFrame:
    """Exact nearest neighbours of a stated table of queries (query_id, query): (query_id, key, distance, rank).

    Each pair of blocks gives its own k per query, and each partition keeps its k before the shuffle (the rank filter is pushed below it).
    """
    order = Window.partitionBy("query_id").orderBy("distance", key)
    return _near_pairs(vectors, queries, key, vector, k, farthest).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


#: Where all vectors are asked: queries of one block and of one matrix product, vectors that a task compares a block with, digits of a distance.
EACH_BLOCK, TILE, EACH_SHARE, DIGITS = 4096, 128, 65_536, 9


def _whole_blocks(rows: DataFrame, block: int, kind: str) -> DataFrame:
    """Rows (key, v) as blocks (no, size, keys, packed), of all rows of a partition, whatever batches they come in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (got := list(batches)):
            return
        table, no = pa.Table.from_batches(got), 0
        sizes = pc.list_value_length(table["v"])
        for size in pc.unique(sizes).to_pylist():
            own = table.filter(pc.equal(sizes, size))
            for at in range(0, own.num_rows, block):
                part = own.slice(at, block)
                flat = pc.list_flatten(part["v"]).to_numpy().astype(kind)
                yield pa.RecordBatch.from_pydict({"no": pa.array([no], pa.int32()), "size": pa.array([size], pa.int32()), "keys": pa.array([part["key"].to_numpy().tobytes()]), "packed": pa.array([flat.tobytes()])})
                no += 1

    return rows.mapInArrow(run, "no int, size int, keys binary, packed binary")


def _firsts(k: int, group: np.ndarray, *order: np.ndarray) -> np.ndarray:
    """Places of the first k of each group in an order, groups ascending."""
    at = np.lexsort((*reversed(order), group))
    own = group[at]
    return at[np.arange(len(at)) - np.searchsorted(own, own) < k]


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.sqrt((m * m).sum(axis=1))[:, None]


def _copies(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each different row, and of each row the number of its like."""
    _, first, like = np.unique(np.ascontiguousarray(m).view(f"V{m.itemsize * m.shape[1]}").ravel(), return_index=True, return_inverse=True)
    return first, like.ravel()


class _Nearest:
    """The k nearest to each of a block's queries in the blocks of vectors seen so far, by rounded distance, then key. Copies are asked once."""

    def __init__(self, keys: np.ndarray, asked: np.ndarray, k: int) -> None:
        first, self.like = _copies(asked)
        self.ids, self.asked, self.k = keys, asked[first].astype("float64"), k
        self.unit, self.far = _unit(self.asked), np.full(len(first), np.inf)
        self.q, self.key, self.away = np.empty(0, "int64"), np.empty(0, "int64"), np.empty(0)

    def see(self, keys: np.ndarray, vectors: np.ndarray) -> None:
        # of equal vectors, which have equal distances, only the k first can be among the k nearest
        kept = _firsts(self.k, _copies(vectors)[1], keys)
        keys, vectors = keys[kept], vectors[kept].astype("float64")
        unit, found = _unit(vectors).T, [(self.q, self.key, self.away)]
        like, near = np.empty((TILE, len(vectors))), np.empty((TILE, len(vectors)), "bool")
        for at in range(0, len(self.asked), TILE):
            n = len(least := 1 - self.far[at : at + TILE])
            np.matmul(self.unit[at : at + TILE], unit, out=like[:n])
            if self.k < len(vectors) and np.isinf(least).any():
                least = np.maximum(least, np.partition(like[:n], -self.k, axis=1)[:, -self.k])
            np.greater_equal(like[:n], (least - SLACK)[:, None], out=near[:n])
            q, v = np.divmod(np.flatnonzero(near[:n]), len(vectors))
            for i in range(0, len(q), 65_536):
                own, other = at + q[i : i + 65_536], v[i : i + 65_536]
                found.append((own, keys[other], np.round(exact_distances(self.asked[own], vectors[other]), DIGITS) + 0.0))
        q, key, away = (np.concatenate(x) for x in zip(*found, strict=True))
        kept = _firsts(self.k, q, away, key)
        self.q, self.key, self.away = q[kept], key[kept], away[kept]
        count = np.bincount(self.q, minlength=len(self.asked))
        full = count == self.k
        self.far[full] = self.away[np.cumsum(count)[full] - 1]

    def rows(self) -> pa.RecordBatch:
        """(query_id, key, distance) of all queries, copies too."""
        count = np.bincount(self.q, minlength=len(self.asked))
        start, n = (np.cumsum(count) - count)[self.like], count[self.like]
        at = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids, n)), pa.array(self.key[at]), pa.array(self.away[at])], ["query_id", "key", "distance"])


def nearest_each(vectors: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Of every vector the k nearest others, exact: (query_id, key, distance, rank) by the distance in 9 digits, then key, a whole number.

    All vectors are compared, so work grows with their square; what is sent and kept grows with the vectors. A task has one block of queries and
    goes through a share of the blocks of vectors, neither of which is broadcast. As in SQL, vectors without an angle to any (zero, no numbers)
    come after the others, those that are null or empty last, each in order of the keys and with a null distance.
    """
    elements = "float" if vectors.schema[vector].dataType.elementType.simpleString() == "float" else "double"
    values, code = F.col(vector).cast(f"array<{elements}>"), {"float": "float32", "double": "float64"}[elements]
    square = F.aggregate(values, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    blank = F.when((F.size(values) < 1) | square.isNull(), 2).when((square > 0) & (square < float("inf")), 0).otherwise(1)
    rows = vectors.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), values.alias("v"), F.coalesce(blank, F.lit(2)).alias("blank"))
    whole = rows.filter("blank = 0").select("key", "v")
    n = whole.count()
    some = min(EACH_BLOCK, max(-(-n // (4 * vectors.sparkSession.sparkContext.defaultParallelism)), EACH_BLOCK // 16, 1))
    dealt = lambda size, per: max(1, -(-size // per))
    asked = _whole_blocks(whole.repartition(dealt(n, some)), EACH_BLOCK, code).select("no", F.col("size").alias("asked_size"), F.col("keys").alias("ids"), F.col("packed").alias("asked"))
    own = _whole_blocks(whole.repartition(dealt(n, EACH_BLOCK)), EACH_BLOCK, code).drop("no").repartition(dealt(n, EACH_SHARE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no, near = None, None
        for batch in batches:
            for r in range(batch.num_rows):
                keys = lambda c: np.frombuffer(batch[c][r].as_buffer(), dtype="int64")  # noqa: B023, E731
                matrix = lambda c, size: np.frombuffer(batch[c][r].as_buffer(), dtype=code).reshape(-1, batch[size][r].as_py())  # noqa: B023, E731
                if (now := batch["no"][r].as_py()) != no:
                    if near is not None:
                        yield near.rows()
                    no, near = now, _Nearest(keys("ids"), matrix("asked", "asked_size"), k + 1)
                if batch["size"][r] == batch["asked_size"][r]:
                    near.see(keys("keys"), matrix("packed", "size"))
        if near is not None:
            yield near.rows()

    # each task pairs its block of queries with all blocks of its share in turn
    near = asked.crossJoin(own.hint("shuffle_replicate_nl")).mapInArrow(run, "query_id long, key long, distance double").withColumn("blank", F.lit(0))
    least = rows.select("key", "blank").withColumn("n", F.row_number().over(Window.partitionBy("blank").orderBy("key"))).filter(F.col("n") <= k + 1).select("key", F.col("blank").alias("other"))
    # at most k + 1 rows of each of three kinds
    rest = rows.select(F.col("key").alias("query_id"), "blank").join(F.broadcast(least), F.greatest("blank", "other") > 0)
    rest = rest.select("query_id", "key", F.lit(None).cast("double").alias("distance"), F.greatest("blank", "other").alias("blank"))
    order = Window.partitionBy("query_id").orderBy("blank", "distance", "key")
    ranked = near.unionByName(rest).filter("query_id <> key").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("key").alias(key), "distance", "rank")


def cascade(primary: DataFrame, fallback: DataFrame, query: str = "query_id") -> DataFrame:
    """The primary's rows, and the fallback's for queries without any; ``arm`` tells which."""
    rest = fallback.join(primary.select(query).distinct(), query, "left_anti")
    return primary.withColumn("arm", F.lit("primary")).unionByName(rest.withColumn("arm", F.lit("fallback")))


def fuse(arms: list[DataFrame], key: str = "doc_id", query: str = "query_id", k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (query_id, key, rank): score, and rank by score, then key."""
    every = reduce(DataFrame.unionByName, [a.select(query, key, "rank") for a in arms])
    scored = every.groupBy(query, key).agg(F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.round("score", 12).desc(), key)))


def page_before(df: DataFrame, before: int | None, size: int, key: str = "doc_id") -> DataFrame:
    """Keyset page: the ``size`` greatest keys below ``before``."""
    rows = df if before is None else df.filter(F.col(key) < before)
    return rows.orderBy(F.col(key).desc()).limit(size)


HIT = ["provision_version_id", "provision_number", "text", "structure_path"]
CITATION = ["instrument_title", "document_number", "version_label", "legal_status", "effective_from", "provision_number", "artifact_id", "filename"]


def star(provisions: DataFrame, identities: DataFrame, versions: DataFrame, instruments: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Provisions with everything a hit shows. Inner joins: a version without artifact has no hits."""
    return provisions.join(identities, "identity_id").join(versions, "version_id").join(instruments, "instrument_id").join(artifacts, "artifact_id")


def default_order(rows: DataFrame, ties: tuple[str, ...]) -> DataFrame:
    """Hits by title, version label and article, each as far as the rows have it; articles by their leading digits, then as text."""
    have = [c for c in ("instrument_title", "version_label", "provision_number") if c in rows.columns]
    order = [x for c in have for x in ([X.article_sort_key(F.col(c)).asc_nulls_last(), F.col(c)] if c == "provision_number" else [F.col(c)])]
    return rows.orderBy(*order, *ties)


def as_hits(rows: DataFrame, fields: list[str], citation: list[str]) -> DataFrame:
    """Rows as hits: some fields, and the source as one struct."""
    return rows.select(*fields, F.struct(*citation).alias("citation"))


def search_one(corpus: DataFrame, q: Query, vectors: DataFrame | None = None, encode: Callable[[str], list[float]] | None = None, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, str]:
    """One search: exact filters on every arm; keywords by query variants, and the vector arm only if they find nothing.

    Returns the rows (at most limit + 1) and the path taken: exact, keyword, vector or none. The variants are
    a handful of strings, evaluated on the driver; the emptiness check reads one row.
    """
    rows = filtered(corpus, q)
    if q.keyword:
        return keyword(rows, q.keyword, text=text, ties=(key,), limit=q.limit), "keyword"
    if not q.semantic:
        return default_order(rows, (key,)).limit(q.limit + 1), "exact"
    asked = corpus.sparkSession.range(1).select(X.query_variants(F.lit(q.semantic)).alias("v")).first()["v"]
    flat = rows.withColumn("_flat", X.flatten_stored(F.col(text)))
    which = F.coalesce(*[F.when(reduce(lambda a, b: a & b, [F.col("_flat").like(f"%{t}%") for t in X.split_terms(v)]), F.lit(i)) for i, v in enumerate(asked) if X.split_terms(v)], F.lit(None).cast("int"))
    found = flat.withColumn("_variant", which).filter("_variant IS NOT NULL").orderBy("_variant", F.length("_flat"), key).limit(q.limit + 1).drop("_flat", "_variant")
    if not found.isEmpty():
        return found, "keyword"
    if vectors is None or encode is None:
        return found, "none"
    near = nearest(vectors.join(rows.select(key), key, "left_semi"), encode(q.semantic), q.limit + 1, key, farthest=FARTHEST)
    return near.join(rows, key).orderBy("distance", key), "vector"
