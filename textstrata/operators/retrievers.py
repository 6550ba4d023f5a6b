"""The retriever matrix: every way of finding texts for a stated table of queries, as ranked lists that the same metrics compare.

Lists have (query_id, key, rank). Queries are few and stated; they are broadcast in blocks of a bounded size, texts are read in place, and each
partition cuts its own lists before the shuffle.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.files import reranked
from .search import FARTHEST, cascade, fuse, merge_variants, nearest_many
from .wordsearch import ranked_word_search

#: Queries that one broadcast holds, and the depth that fused and reranked lists look into.
BLOCK, DEPTH = 1000, 60
LEAST_TRIGRAM = 0.3


def _top(rows: DataFrame, order: list[Column], k: int, key: str, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    place = Window.partitionBy(*by).orderBy(*order, key)
    return rows.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k).select(*by, key, "rank")


def _matches(docs: DataFrame, queries: DataFrame, condition: Column) -> DataFrame:
    """Rows of docs with each query that they match; queries are broadcast in blocks."""
    blocks = max(1, -(-queries.count() // BLOCK))
    parts = [queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) for b in range(blocks)]
    return reduce(DataFrame.unionAll, [docs.join(F.broadcast(p), condition) for p in parts])


def by_substring(docs: DataFrame, queries: DataFrame, k: int, key: str, text: str, flat: bool) -> DataFrame:
    """Texts that hold the query as it is, or white space aside; the shortest first. Blank queries find nothing."""
    own = docs.select(key, F.col(text).alias("_text"), X.flatten_stored(F.col(text)).alias("_flat"))
    asked = queries.select("query_id", (X.flatten(F.col("q")) if flat else F.col("q")).alias("_q")).filter(F.trim("_q") != "")
    found = _matches(own, asked, F.contains(F.col("_flat" if flat else "_text"), F.col("_q")))
    return _top(found.select("query_id", key, F.length("_flat").alias("_n")), [F.col("_n")], k, key)


def by_terms(docs: DataFrame, queries: DataFrame, k: int, key: str, text: str, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Texts that hold every term of the query, white space aside; the shortest first."""
    own = docs.select(key, X.flatten_stored(F.col(text)).alias("_flat"))
    asked = queries.select(*by, X.terms(F.col("q")).alias("_terms")).filter(F.size("_terms") > 0)
    found = _matches(own, asked, F.forall("_terms", lambda t: F.contains(F.col("_flat"), t)))
    return _top(found.select(*by, key, F.length("_flat").alias("_n")), [F.col("_n")], k, key, by)


def by_trigrams(docs: DataFrame, queries: DataFrame, k: int, key: str, text: str, least: float = LEAST_TRIGRAM) -> DataFrame:
    """Texts whose trigrams are like the query's as a whole, the most similar first."""
    own = docs.select(key, X.trigrams(F.col(text)).alias("_grams"))
    asked = queries.select("query_id", X.trigrams(F.col("q")).alias("_asked")).filter(F.size("_asked") > 0)
    likeness = X.jaccard(F.col("_grams"), F.col("_asked"))
    return _top(_matches(own, asked, likeness >= least).select("query_id", key, likeness.alias("_s")), [F.col("_s").desc()], k, key)


STRATEGIES: dict[str, Callable[..., DataFrame]] = {
    "substring_raw": lambda *a: by_substring(*a, flat=False),
    "substring_flat": lambda *a: by_substring(*a, flat=True),
    "all_terms_flat": by_terms,
    "trigram": by_trigrams,
    "word_trigram": lambda docs, queries, k, key, text: ranked_word_search(docs, queries, k - 1, text=text, key=key).select("query_id", key, "rank"),
}


def rewritings(q: Column) -> dict[str, Column]:
    """The variants that each depth of rewriting searches for: distinct, none blank, in order."""
    normal = X.normalize_query(q)
    some = lambda *v: F.array_distinct(F.filter(F.array(*v), lambda x: x.rlike(r"(?U)\S")))
    return {"norm": some(q, normal), "strip": some(q, normal, X.strip_phrases(normal)), "expand": X.query_variants(q)}


def by_rewriting(docs: DataFrame, queries: DataFrame, variants: Column, k: int, key: str, text: str) -> DataFrame:
    """All-terms lists of each query's variants, one after the other, first seen first."""
    each = queries.select("query_id", F.posexplode(variants).alias("variant", "q"))
    lists = by_terms(docs, each, k, key, text, ("query_id", "variant"))
    merged = merge_variants(lists, key, k - 1)
    return merged.select("query_id", key, F.col("place").alias("rank"))


def with_neighbours(seeds: DataFrame, edges: DataFrame, k: int, key: str) -> DataFrame:
    """The seeds' lists, and after them what they cite (edges: source, target), by the seed's rank, up to k rows a query."""
    cited = seeds.select("query_id", F.col(key).alias("source"), "rank").join(edges.select("source", F.col("target").alias(key)).distinct(), "source")
    near = cited.groupBy("query_id", key).agg(F.min("rank").alias("rank"))
    both = seeds.select("query_id", key, F.lit(0).alias("_hop"), "rank").unionByName(near.withColumn("_hop", F.lit(1)).select("query_id", key, "_hop", "rank"))
    first = both.groupBy("query_id", key).agg(F.min(F.struct("_hop", "rank")).alias("_at"))
    return _top(first, [F.col("_at")], k, key)


def by_reranking(lists: DataFrame, docs: DataFrame, queries: DataFrame, score: Callable[[list[tuple[str, str]]], list[float]], k: int, key: str, text: str) -> DataFrame:
    """The lists ordered anew by an injected scorer of (query, text) pairs; equal scores keep their order. Only listed texts are fetched."""
    pairs = lists.join(F.broadcast(queries.select("query_id", F.col("q").alias("query"))), "query_id").join(docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("text")), key)
    scored = reranked(pairs.select("query_id", key, "rank", "query", "text"), score).withColumnRenamed("rank", "_was")
    return _top(scored, [F.col("score").desc(), F.col("_was")], k, key)


def matrix(
    docs: DataFrame, queries: DataFrame, k: int = 20, vectors: DataFrame | None = None, edges: DataFrame | None = None,
    score: Callable[[list[tuple[str, str]]], list[float]] | None = None, key: str = "doc_id", text: str = "text", farthest: float = FARTHEST,
) -> dict[str, DataFrame]:
    """Lists of at most k per query by every retriever that the inputs allow.

    queries: query_id, q, and query (a vector) where there are ``vectors``. Keyword strategies and three depths of rewriting always; vector, hybrid
    (fused from deeper lists) and cascade (rewriting first, vectors where it finds nothing) with vectors; graph (the cascade's, then what they
    cite) with edges, too; and hybrid and cascade reranked with a scorer.
    """
    out = {f"keyword:{name}": run(docs, queries, k, key, text) for name, run in STRATEGIES.items()}
    deep = {name: by_rewriting(docs, queries, v, max(k, DEPTH), key, text) for name, v in rewritings(F.col("q")).items()}
    cut = lambda df: df.filter(F.col("rank") <= k).select("query_id", key, "rank")
    out |= {f"keyword:all_terms_flat+{name}": cut(df) for name, df in deep.items()}
    if vectors is None:
        return out
    depth = max(k, DEPTH)
    near = nearest_many(vectors, queries.select("query_id", "query"), depth, key, farthest=farthest).select("query_id", key, "rank")
    fused = fuse([by_terms(docs, queries, depth, key, text), near], key).select("query_id", key, "rank").filter(F.col("rank") <= depth)
    stepped = cascade(deep["expand"].select("query_id", key, "rank"), near).select("query_id", key, "rank")
    out |= {"vector": cut(near), "hybrid": cut(fused), "cascade": cut(stepped)}
    if edges is not None:
        out["graph"] = with_neighbours(cut(stepped), edges, k, key)
    if score is not None:
        out["hybrid+rerank"] = by_reranking(fused, docs, queries, score, k, key, text)
        out["cascade+rerank"] = by_reranking(stepped, docs, queries, score, k, key, text)
    return out


def measured(retrieve: Callable[[int, str], DataFrame], queries: list[tuple[int, str]], k: int, key: str = "doc_id") -> tuple[list[tuple], list[tuple]]:
    """One query at a time, as its user would wait for it: hits (query_id, key, rank) and runs (query_id, elapsed_ms, error).

    The queries are stated and the lists cut at k. A query that fails has no hits, and an error that ``retrieval_metrics`` counts.
    """
    hits, runs = [], []
    for query_id, q in queries:
        begun, failed, rows = time.perf_counter(), False, []
        try:
            rows = [r[key] for r in retrieve(query_id, q).limit(k).collect()]
        except Exception:  # a failing query is a result of the evaluation
            failed = True
        runs.append((query_id, (time.perf_counter() - begun) * 1000, failed))
        hits += [(query_id, row, i) for i, row in enumerate(rows, 1)]
    return hits, runs
