"""Operator 13, periodic run detection by an online sparse diagonal recurrence, and the collapse of the runs.

A match of word i with word i - q lies on diagonal q. While a diagonal goes on matching, its length grows by one for each word; when it
ends, it is a run of period q if it is long enough. Following every earlier occurrence of a word takes the square of a word's frequency, so
only those diagonals are followed that can hold a run. Occurrences are told apart by the ``k`` words from i on, for k = 1, 2, 4, ...; at step
k the periods k/2 < q <= k are looked for, and of a k-gram's earlier occurrences the last one alone can lie q back inside a run of smallest
period q (were a nearer one r < q back, the run would also have period gcd(q, r), by Fine and Wilf's theorem). So each word has one active
diagonal a step, a step costs a sort, and words whose k-gram occurs once in their document leave for good: natural text is gone after two or
three steps. All documents of an Arrow slice go through the steps together; a text of n words takes about log2(n) steps of n at most.

Defined results: a null or empty text has no words, no runs and an empty collapsed text; repeated rows each get their result; other columns
of the input are ignored; an empty table gives an empty result. A null id is an id like any other (the query never rewrites its words).
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound, crc_sql, slices_of, small_batches

#: A run has at least so many words, and so many of its periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: A word is a maximal run of other characters than blank and \t to \r.
WORD = r"[^\x20\x09-\x0D]+"

RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def diagonal_runs(ids: np.ndarray, longest: int, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> np.ndarray:
    """Maximal runs of ``ids`` as rows (start, length, period), by start, then period.

    ``ids`` are the words of several documents after each other, numbered below ``len(ids)``, no number in two documents;
    ``longest`` is the number of words of the longest document. ``periods`` is 4 or more (the steps rely on it).
    """
    found = [np.empty((0, 3), np.int64)]
    size = len(ids)
    place, gram = np.arange(size, dtype=np.int64), np.asarray(ids, np.int64)
    dense = np.empty(size, np.int64)
    k = 1
    # the least period of step k is k // 2 + 1
    while len(place) and periods * (k // 2 + 1) <= longest:
        order = np.argsort(gram, kind="stable")
        same = gram[order[1:]] == gram[order[:-1]]
        lag = np.zeros(len(place), np.int64)
        lag[order[1:][same]] = (place[order[1:]] - place[order[:-1]])[same]
        # an active diagonal grows while the next word has the same lag
        active = (lag > k // 2) & (lag <= k)
        grows = np.zeros(len(place), bool)
        grows[1:] = active[1:] & active[:-1] & (lag[1:] == lag[:-1]) & (place[1:] == place[:-1] + 1)
        begin = np.flatnonzero(active & ~grows)
        if len(begin):
            grown = np.add.reduceat(grows.astype(np.int64), begin)  # what follows a diagonal before the next one begins is not grown
            period = lag[begin]
            length = grown + k + period
            enough = length >= np.maximum(least, periods * period)
            found.append(np.stack([place[begin] - period, length, period], 1)[enough])
        # k-grams that occur twice go on, named by their first place
        twice = np.zeros(len(place), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        head = np.ones(len(place), bool)
        head[1:] = ~same
        name = np.empty(len(place), np.int64)
        name[order] = place[order][np.flatnonzero(head)][np.cumsum(head) - 1]
        dense.fill(-1)
        dense[place[twice]] = name[twice]
        place = place[twice]
        place = place[place + k < size]
        place = place[dense[place + k] >= 0]
        gram = dense[place] * size + dense[place + k]
        k *= 2
    runs = np.concatenate(found)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _slice_runs(texts: list[bytes | None]) -> Iterator[tuple[list[tuple[int, int, int]], bytes]]:
    """Per text: its runs and its collapsed text."""
    words = [t.split() if t else [] for t in texts]  # bytes split at just the blanks of WORD
    sizes = [len(w) for w in words]
    ends = np.cumsum(sizes, dtype=np.int64) if sizes else np.zeros(0, np.int64)
    ids = np.empty(int(ends[-1]) if sizes else 0, np.int64)
    for own, end in zip(words, ends.tolist()):
        first: dict[bytes, int] = {}
        ids[end - len(own) : end] = np.fromiter(map(first.setdefault, own, range(end - len(own), end)), np.int64, len(own))
    runs = diagonal_runs(ids, max(sizes, default=0))
    # a word goes if a run holds it after that run's first period
    edges = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(edges[:-1]) == 0
    cuts = np.searchsorted(runs[:, 0], np.concatenate([[0], ends]))
    for n, (own, end) in enumerate(zip(words, ends.tolist())):
        mine = runs[cuts[n] : cuts[n + 1]]
        begin = end - len(own)
        text = b" ".join(itertools.compress(own, kept[begin:end].tolist()) if len(mine) else own)
        yield [(s - begin, length, q) for s, length, q in mine.tolist()], text


def periodic_runs(df: DataFrame, key: str, text: str) -> DataFrame:
    """Per row: the key, runs (start, length, period in words, by start, then period) and collapsed, the text without the repeated periods.

    Words are kept in their order with one blank between them. No shuffle; a task holds about half a megabyte of texts, or one longer text, at a time.
    """
    small_batches(df.sparkSession)
    plain = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = plain.schema["key"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices_of(batches, "text"):
            texts = part.column("text").cast(pa.binary()).to_pylist()
            runs, collapsed = [], []
            for found, kept in _slice_runs(texts):
                runs.append([dict(zip(("start", "length", "period"), r)) for r in found])
                collapsed.append(kept)
            yield pa.record_batch([part.column("key"), pa.array(runs, RUNS), pa.array(collapsed, pa.binary()).cast(pa.string())], ["key", "runs", "collapsed"])

    out = plain.mapInArrow(work, f"key {kind}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")
    return out.withColumnRenamed("key", key)


def strongest(runs: Column) -> Column:
    """The run of greatest length / period, compared as fractions; of equal ones the first. Null without runs."""
    better = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    return F.aggregate(runs, F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>"), lambda best, r: F.when(better(best, r), r).otherwise(best))


def replayed(doc_id: Column, text: Column) -> Column:
    """The text that op13's contract reads: of a tenth of the ids (by CRC) the words from one place on repeat from there."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10).cast("long")

    def turned(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        return F.array_join(F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + (i - a) % p).cast("int")))), " ")

    some = bound(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda words: F.when(F.size(words) > 0, turned(words)))
    return F.when(h % 10 == 0, some).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    told = periodic_runs(docs.select("doc_id", replayed(F.col("doc_id"), F.col("text")).alias("text")), "doc_id", "text")
    lines = F.concat(F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"])), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    best = told.select("doc_id", F.size("runs").cast("long").alias("n_runs"), strongest(F.col("runs")).alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return best.select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period", F.floor(F.col("best.length") * 1000 / F.col("best.period")).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256"
    )


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words, {crc_sql("doc_id::VARCHAR")} AS h FROM documents),
e AS (SELECT rid, doc_id, words, len(words) AS n, h, CASE WHEN len(words) > 0 THEN (h // 10) % len(words) END AS a, (h // 10) % 8 AS m FROM d),
f AS (SELECT rid, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: words[(CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + m)) END + 1)::INT]) ELSE words END AS words FROM e),
w AS (SELECT rid, n, unnest(words) AS w, generate_subscripts(words, 1) - 1 AS i FROM f),
g AS (SELECT rid, n, i, concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o) AS g FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)),
p AS (SELECT x.rid, x.i, x.i - y.i AS q FROM g AS x JOIN g AS y ON x.rid = y.rid AND x.g = y.g AND x.i > y.i AND 4 * (x.i - y.i) <= x.n AND x.i + 5 <= x.n),
s AS (SELECT rid, q, i, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island FROM p),
c AS (SELECT rid, q, min(i) - q AS start, max(i) + 5 - min(i) + q AS length FROM s GROUP BY rid, q, island HAVING max(i) + 5 - min(i) + q >= greatest(6, 4 * q)),
r AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c AS z WHERE z.rid = c.rid AND z.q < c.q AND z.start <= c.start AND z.start + z.length >= c.start + c.length)),
k AS (SELECT rid, string_agg(w, ' ' ORDER BY i) AS kept FROM w WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.rid = w.rid AND w.i >= r.start + r.q AND w.i < r.start + r.length) GROUP BY rid),
l AS (SELECT rid, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS lines FROM r GROUP BY rid),
b AS (SELECT rid, start, length, q FROM r QUALIFY row_number() OVER (PARTITION BY rid ORDER BY length::DOUBLE / q DESC, start, q) = 1)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, q::BIGINT AS period, (1000 * length // q)::BIGINT AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM f LEFT JOIN l USING (rid) LEFT JOIN b USING (rid) LEFT JOIN k USING (rid)"""
