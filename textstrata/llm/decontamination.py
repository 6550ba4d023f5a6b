"""Operator 1, benchmark decontamination by a prefix-filtered set join [native].

Items are cut into windows of ``WINDOW`` words (a shorter item is one window).
A document contains a window only if it contains all of its shingles of
``SHINGLE`` words, so one shingle per window is a sufficient prefix: the rarest
one, by its number of occurrences in all documents. A window with a shingle
that no document has cannot occur and is left out.

The documents' words and shingles (as 32-bit hashes, in their order) are written
to the shared folder. A first pass over the hashes counts the items' shingles in
all documents; a second one joins the prefixes alone. What meets must fit between the document's
ends (length and position bounds), and then its words are compared one by one
with the document's. Hashes are broadcast in blocks of at most ``BLOCK``; a
larger benchmark takes more passes, and no row is left out.

Defined results: null or empty text has no words; a null item, or one without
words, has no window; repeated document rows give a row each; repeated items
count by their ids; an empty documents table gives an empty result, an empty
benchmark gives rows without hits; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower, bound, drop_stage, stage

WINDOW, SHINGLE = 10, 5
#: Hashes that are broadcast at once.
BLOCK = 500_000
#: What separates words, after A-Z are lower-cased.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAPS), "")


def _shingles(words: Column, size: int) -> Column:
    """Hashes (int) of the shingles of ``size`` words, by their places: each is hashed from two shorter ones, so no word is hashed twice. Null if there are fewer words."""
    def step(one: Column, other: Column, of: int) -> Column:
        n = F.least(F.size(one), F.size(other))
        return F.zip_with(F.slice(one, F.lit(1), n), F.slice(other, F.lit(1), n), lambda x, y: (F.hash if of == size else F.xxhash64)(F.lit(of), x, y))

    def later(h: Column, k: int) -> Column:
        return F.slice(h, F.lit(k + 1), F.greatest(F.size(h) - k, F.lit(0)))

    def of(one: Column) -> Column:
        if size == 1:
            return one
        return bound(step(one, later(one, 1), 2), lambda two: two if size == 2 else step(two, later(one, 2), 3) if size == 3 else bound(
            step(two, later(two, 2), 4), lambda four: four if size == 4 else step(four, later(one, 4), 5)))

    return F.when(F.size(words) >= size, bound(F.transform(words, lambda x: (F.hash if size == 1 else F.xxhash64)(F.lit(1), x)), of))


def windows(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct item windows: (wid, words, items)."""
    cut = items.select(F.col(key).alias("item"), words_of(F.col(text)).alias("w")).filter(F.size("w") > 0)
    last = F.greatest(F.size("w") - WINDOW, F.lit(0))
    each = cut.select("item", F.explode(F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("w", i + 1, WINDOW))).alias("words"))
    return each.groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("items")).withColumn("wid", F.xxhash64("words"))


def _blocks(df: DataFrame, key: str, most: int) -> list[DataFrame]:
    n = max(1, -(-df.count() // most))
    return [df.filter(F.pmod(F.hash(key), F.lit(n)) == b) for b in range(n)] if n > 1 else [df]


def window_shingles(found: DataFrame) -> DataFrame:
    """Each window's shingles: (wid, words, items, at, h)."""
    size = F.least(F.size("words"), F.lit(SHINGLE))
    of_window = F.when(size == SHINGLE, _shingles(F.col("words"), SHINGLE))
    for s in range(1, SHINGLE):
        of_window = of_window.when(size == s, _shingles(F.col("words"), s))
    return found.select("wid", "words", "items", size.alias("size"), F.posexplode(of_window).alias("at", "h"))


def shingle_counts(words: DataFrame, tokens: DataFrame, sizes: list[int], block: int = BLOCK) -> DataFrame:
    """Occurrences in all documents (h, count) of the shingles ``tokens`` (h)."""
    told = reduce(DataFrame.unionAll, [words.select(F.explode_outer(f"h{s}").alias("h")) for s in sizes])
    return reduce(DataFrame.unionAll, [told.join(F.broadcast(b), "h").groupBy("h").count() for b in _blocks(tokens, "h", block)])


def prefixes(parts: DataFrame, counts: DataFrame) -> DataFrame:
    """Each window's prefix: (wid, words, items, h, at), its rarest shingle by occurrences in all documents; windows with an absent shingle are left out."""
    rare = parts.join(counts, "h", "left").groupBy("wid").agg(
        F.first("words").alias("words"), F.first("items").alias("items"), F.min_by(F.struct("h", "at"), F.struct(F.coalesce("count", F.lit(0)), "h", "at")).alias("p"), F.count_if(F.col("count").isNull()).alias("absent")
    )
    return rare.filter("absent = 0").select("wid", "words", "items", "p.h", "p.at")


def meetings(words: DataFrame, rare: DataFrame, sizes: list[int], block: int = BLOCK) -> DataFrame:
    """Where a window may begin in a document, by its prefix and within the document's bounds: (rid, start, wid, n)."""
    told = reduce(DataFrame.unionAll, [words.select("rid", "n_words", F.posexplode_outer(f"h{s}").alias("place", "h")) for s in sizes])
    met = reduce(DataFrame.unionAll, [told.join(F.broadcast(b), "h") for b in _blocks(rare.select("h").distinct(), "h", block)])
    start, n = F.col("place") - F.col("at"), F.size("words")
    placed = met.join(rare.select("h", "at", "words", "wid"), "h").filter((start >= 0) & (start + n <= F.col("n_words")))
    return placed.select("rid", start.alias("start"), "wid", n.alias("n"))


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """Per document row: key, n_words, spans (array<struct<start,stop>>, hit word ranges), n_hit, items (sorted ids)."""
    parts = stage(window_shingles(windows(items, item_key, item_text)), "windows")
    sizes = sorted(r["size"] for r in parts.select("size").distinct().collect())
    cut = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(key).alias("key"), words_of(F.col(text)).alias("w"))
    words = stage(cut.select("*", F.size("w").cast("long").alias("n_words"), *[_shingles(F.col("w"), s).alias(f"h{s}") for s in sizes]), "words")
    if not sizes:
        none = F.array().cast("array<struct<start:int,stop:int>>")
        return words.select(F.col("key").alias(key), "n_words", none.alias("spans"), F.lit(0).cast("long").alias("n_hit"), F.array().cast(T.ArrayType(items.schema[item_key].dataType)).alias("items"))
    rare = stage(prefixes(parts, shingle_counts(words, parts.select("h").distinct(), sizes, block)), "prefixes")
    met = stage(meetings(words, rare, sizes, block), "meetings")
    # a broadcast row takes about 110 bytes: so many are broadcast, more are sorted and merged with the words
    few = F.broadcast(met) if met.count() <= block else met
    read = words.select("rid", "w").join(few, "rid").select("rid", "wid", "start", "n", F.slice("w", F.col("start") + 1, F.col("n")).alias("read"))
    same = read.join(rare.select("wid", "words", "items"), "wid").filter("read = words")
    found = same.groupBy("rid").agg(F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("stop")))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    hits = stage(found, "hits")
    drop_stage(parts, rare, met)
    none = lambda c: F.coalesce(c, F.array().cast(hits.schema[c].dataType)).alias(c)
    return words.select("rid", F.col("key").alias(key), "n_words").join(hits, "rid", "left").select(key, "n_words", none("spans"), F.coalesce(_covered(F.col("spans")), F.lit(0).cast("long")).alias("n_hit"), none("items"))


def _covered(spans: Column) -> Column:
    """Words covered by spans that are sorted by start."""
    start = F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(spans, start, lambda a, s: F.struct(F.greatest(a["to"], s["stop"]).alias("to"), (a["n"] + F.greatest(F.lit(0), s["stop"] - F.greatest(s["start"], a["to"]))).alias("n")))["n"]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    out = decontaminate(docs, items)
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

SQL = f"""
WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
w AS (SELECT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[i + 1 : i + {WINDOW}], ' ') AS win FROM (SELECT *, unnest(range(greatest(len(w) - {WINDOW}, 0) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT n FROM w),
p AS (SELECT rid, i, s.n, array_to_string(w[i + 1 : i + s.n], ' ') AS win FROM (SELECT rid, w, unnest(range(len(w))) AS i FROM d), s WHERE i + s.n <= len(w)),
h AS (SELECT DISTINCT rid, i, p.n, item_id FROM p JOIN w USING (win)),
k AS (SELECT rid, count(DISTINCT x) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS x FROM h) GROUP BY 1),
t AS (SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT rid, item_id::VARCHAR AS id FROM h) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN k USING (rid) LEFT JOIN t USING (rid)"""
