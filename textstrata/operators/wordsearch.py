"""Search by word trigrams: which texts have a stretch that is like a query, and in what order.

A query with m trigrams matches a text if the best stretch's likeness is ``least`` or more (see ``functions.wordgrams``). For that the text must
share ceil(least * m) of them, so the texts' trigrams are looked up in the postings of the queries (trigram to queries, sorted codes that each task
holds), a count filter leaves the pairs that share enough, and only those are scanned. Texts are read once for all queries, and not shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.wordgrams import best_stretch, ordered_grams

#: The likeness from which a text matches, and the queries that one pass over the texts looks for.
LEAST, BLOCK = 0.6, 1000


class Postings:
    """Trigrams of a block of queries, and for each the queries that have it."""

    def __init__(self, queries: list[tuple[int, str]]) -> None:
        self.ids = [i for i, _ in queries]
        self.grams = [np.unique(ordered_grams(q)) for _, q in queries]
        codes = np.concatenate(self.grams) if self.grams else np.zeros(0, np.int64)
        owners = np.repeat(np.arange(len(self.grams)), [len(g) for g in self.grams])
        order = np.lexsort((owners, codes))
        self.codes, self.first = np.unique(codes[order], return_index=True)
        self.owners, self.ends = owners[order], np.append(self.first[1:], len(codes))

    def likely(self, seen: np.ndarray, least: float) -> np.ndarray:
        """Queries that share enough trigrams with a text."""
        distinct = np.unique(seen)
        at = np.searchsorted(self.codes, distinct).clip(max=max(0, len(self.codes) - 1))
        hit = at[self.codes[at] == distinct] if len(self.codes) else at[:0]
        shared = np.zeros(len(self.ids), np.int64)
        sizes = self.ends[hit] - self.first[hit]
        rows = np.repeat(self.first[hit] - np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(hit) else hit, sizes) + np.arange(int(sizes.sum()))
        np.add.at(shared, self.owners[rows], 1)
        need = np.array([max(1, math.ceil(least * len(g) - 1e-9)) for g in self.grams], np.int64)
        return np.flatnonzero(shared >= need)


def word_search(df: DataFrame, queries: DataFrame, least: float = LEAST, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(query_id, key, similarity) of every matching pair of a stated table of queries (query_id long, q) and all texts.

    Null texts and queries, and those without letters or digits, match nothing. Queries are looked for in blocks of ``BLOCK``, whose strings
    the driver hands to the tasks; a key that repeats gives its rows each.
    """
    asked = queries.filter("q IS NOT NULL").select(F.col("query_id").cast("long"), "q")
    blocks = max(1, -(-asked.count() // BLOCK))
    parts = [asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect() for b in range(blocks)]
    plain = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = plain.schema["key"].dataType.simpleString()

    def search(block: list[tuple[int, str]]) -> DataFrame:
        postings = Postings(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, which, likeness = [], [], []
                for row, value in enumerate(batch.column("text")):
                    seen = ordered_grams(value.as_py())
                    for q in postings.likely(seen, least).tolist():
                        found = best_stretch(seen, postings.grams[q], least)
                        if found >= least:
                            rows.append(row)
                            which.append(postings.ids[q])
                            likeness.append(found)
                yield pa.record_batch([pa.array(which, pa.int64()), batch.column("key").take(pa.array(rows, pa.int64())), pa.array(likeness, pa.float64())], ["query_id", "key", "similarity"])

        return plain.mapInArrow(run, f"query_id bigint, key {kind}, similarity double")

    return reduce(DataFrame.unionAll, [search([tuple(r) for r in p]) for p in parts]).withColumnRenamed("key", key)


def ranked_word_search(df: DataFrame, queries: DataFrame, limit: int, least: float = LEAST, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The ``limit`` most similar texts of each query and one more, which tells truncation, with their rank; ties by key. Each partition cuts its own list before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), key)
    return word_search(df, queries, least, text, key).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit + 1)
