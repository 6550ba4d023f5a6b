"""Operator 11, spelling variants: words one edit apart, found by dense prefix-suffix tiles.

Two words, the longer of L code points, differ by one inserted, deleted or replaced code point exactly when their common prefix and common
suffix together reach L - 1. A tile holds words as rows of a padded code-point matrix, aligned left and right, and compares its rows with each
other at once: the first column that differs on the left gives the prefix, the last one on the right the suffix.

Which words meet in a tile: a pair with a common prefix of p code points, lo <= p < hi, shares its first lo and its last L - hi code points.
So the words that share these are a tile (L, lo, hi), a word of l code points being in those of L = l and of L = l + 1, and the intervals
[0, L/2) and [L/2, L) together miss no pair. A tile of more than ``BLOCK`` words is cut again, its interval in ``PARTS``, as often as it takes;
at an interval of one place its words differ in that place alone, so they are all near, and no more than the alphabet has letters. A pair is
counted only in the tile whose interval holds its prefix, hence once. No tile grows with the table, and no word is left out.

Defined results: words are the distinct non-null values; a word with no near word has n_near 0 and no form; an empty table gives an empty
result; repeated rows of one word add their counts; a null text has no words, and a null doc_id counts as the empty string.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, bound, crc_sql, drop_stage, partitions, stage

#: Words of a tile, beyond which it is cut into so many parts.
BLOCK, PARTS = 128, 4
#: Cells that one comparison of matrix rows holds.
CELLS = 1 << 21
#: A form has at least so many times its variant's occurrences.
FACTOR = 10

NODE = ["long", "lo", "hi", "key"]


def _parts(lo: Column, hi: Column, parts: int) -> Column:
    """The interval [lo, hi) cut into ``parts``, without empty ones."""
    at = lambda k: lo + F.floor((hi - lo) * k / parts).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda k: F.struct(at(k).alias("lo"), at(k + 1).alias("hi")))
    return F.filter(cut, lambda x: x["lo"] < x["hi"])


def _cut(words: DataFrame, parts: int) -> DataFrame:
    """Each (word, n, long, lo, hi) in the tiles that its interval is cut into."""
    out = words.withColumn("part", F.explode(_parts(F.col("lo"), F.col("hi"), parts))).select("word", "n", "long", F.col("part.lo").alias("lo"), F.col("part.hi").alias("hi"))
    ends = [F.substring("word", F.lit(1), F.col("lo")), F.substring("word", F.length("word") - F.col("long") + F.col("hi") + 1, F.col("long") - F.col("hi"))]
    return out.withColumn("key", F.xxhash64("long", "lo", "hi", *ends))


def _sized(nodes: DataFrame, name: str) -> tuple[DataFrame, int]:
    """Those that aren't alone in their tile, with the tile's size, staged; and the greatest size of a tile that can be cut."""
    sizes = nodes.groupBy(*NODE).agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    watch = Observation()
    out = nodes.join(sizes, NODE).observe(watch, F.max(F.when(F.col("hi") - F.col("lo") > 1, F.col("size"))).alias("most"))
    return stage(out, name), watch.get["most"] or 0


def _near_rows(words: list[str], n: list[int], sizes: np.ndarray, lo: np.ndarray, hi: np.ndarray, long: int) -> Iterator[tuple[int, int]]:
    """Near pairs of rows, within groups of consecutive rows of the given sizes, longer words first in each group."""
    lengths = np.array([len(w) for w in words])
    left = np.array(words, dtype=f"<U{long}").view(np.uint32).reshape(len(words), long)
    if left.max(initial=0) < 256:
        left = left.astype(np.uint8)
    right = left.copy()
    short = lengths < long
    right[short, 1:], right[short, 0] = left[short, :-1], 0
    ends = np.repeat(np.cumsum(sizes), sizes)
    partners = np.where(short, 0, ends - np.arange(len(words)) - 1)
    ahead = np.concatenate([[0], np.cumsum(partners)])
    at = 0
    while at < len(words):
        stop = max(at + 1, int(np.searchsorted(ahead, ahead[at] + max(1, CELLS // long), "right")) - 1)
        a = np.repeat(np.arange(at, stop), partners[at:stop])
        b = a + 1 + np.arange(len(a)) - (ahead[a] - ahead[at])
        prefix = (left[a] != left[b]).argmax(1)
        suffix = (right[a] != right[b])[:, ::-1].argmax(1)
        near = (prefix + suffix >= long - 1) & (prefix >= lo[a]) & (prefix < hi[a])
        yield from zip(a[near].tolist(), b[near].tolist())
        at = stop


def _tile(table: pa.Table) -> pa.RecordBatch | None:
    """Of whole tiles: per word its near words in them, their number, and the most frequent one."""
    long = table.column("long").to_numpy()
    node = np.stack([table.column(k).to_numpy() for k in NODE])
    change = np.flatnonzero((node[:, 1:] != node[:, :-1]).any(0)) + 1
    starts = np.concatenate([[0], change, [table.num_rows]])
    words, n = table.column("word").to_pylist(), table.column("n").to_pylist()
    best: dict[str, tuple[int, int, str]] = {}
    # tiles of one length share a matrix
    cuts = [0, *(np.flatnonzero(long[1:] != long[:-1]) + 1).tolist(), table.num_rows]
    for begin, end in zip(cuts, cuts[1:]):
        if begin == end:
            continue
        own = starts[(starts >= begin) & (starts <= end)]
        for i, j in _near_rows(words[begin:end], n[begin:end], np.diff(own), node[1, begin:end], node[2, begin:end], int(long[begin])):
            i, j = i + begin, j + begin
            for x, y in ((i, j), (j, i)):
                seen = best.get(words[x])
                best[words[x]] = (1, -n[y], words[y]) if seen is None else (seen[0] + 1, *min(seen[1:], (-n[y], words[y])))
    if not best:
        return None
    found = list(best.values())
    return pa.record_batch([pa.array(list(best), pa.string()), pa.array([f[0] for f in found], pa.int64()), pa.array([-f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.string())], ["word", "n_near", "near_n", "near"])


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tiles of sorted batches; the last tile of a batch waits for the rest of its rows."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        node = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in NODE])
        change = np.flatnonzero((node[:, 1:] != node[:, :-1]).any(0)) + 1
        # where a tile begins: within the batch, or at its start if it doesn't go on with what is kept
        if kept and any(kept[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in NODE):
            out = _tile(pa.Table.from_batches(kept))
            kept = []
            if out is not None:
                yield out
        if len(change):
            out = _tile(pa.Table.from_batches([*kept, batch.slice(0, int(change[-1]))]))
            kept = []
            if out is not None:
                yield out
            batch = batch.slice(int(change[-1]))
        kept.append(batch)
    if kept and (out := _tile(pa.Table.from_batches(kept))) is not None:
        yield out


def near_words(counts: DataFrame) -> DataFrame:
    """Of distinct words with counts (word, n): those with a near word, n_near, and near, the near word of largest n (ties: the least), with near_n."""
    length = F.length("word")
    both = counts.withColumn("long", F.explode(F.array(length, length + 1))).withColumns({"lo": F.lit(0), "hi": F.col("long")})
    nodes, staged, level = _cut(both, 2), [], 0
    while True:
        sized, most = _sized(nodes, f"tiles_{level}")
        staged.append(sized)
        if most <= BLOCK:
            break
        nodes, level = _cut(sized.filter(F.col("size") > BLOCK).filter("hi - lo > 1").select("word", "n", "long", "lo", "hi"), PARTS), level + 1
    small = staged[0].filter((F.col("size") <= BLOCK) | (F.col("hi") - F.col("lo") == 1))
    for more in staged[1:]:
        small = small.unionByName(more.filter((F.col("size") <= BLOCK) | (F.col("hi") - F.col("lo") == 1)))
    sorted_ = small.repartition(partitions(counts.sparkSession), *NODE).sortWithinPartitions(*NODE, F.length("word").desc())
    told = sorted_.select("word", "n", *NODE).mapInArrow(_tiles, "word string, n_near bigint, near_n bigint, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"), F.col("near_n").alias("near_n")))
    out = stage(told.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", "best.near", "best.near_n"), "near_words")
    drop_stage(*staged)
    return out


def last_forms(forms: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Of links (word, form) without cycles: (word, root), the end of the chain. Chains are halved in each round, which is staged."""
    current = stage(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(max_rounds):
        watch = Observation()
        onward = current.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = current.join(onward, "root", "left").observe(watch, F.count("next").alias("moved")).select("word", F.coalesce("next", "root").alias("root"))
        after = stage(moved, "roots")
        drop_stage(current)
        current = after
        if not watch.get["moved"]:
            return current
    raise RuntimeError(f"chains of forms did not end in {max_rounds} rounds")


def spelling_variants(counts: DataFrame, factor: int = FACTOR) -> DataFrame:
    """Per distinct word of (word, n): word, form, root, n, n_near, form_n.

    form is the near word of largest n (ties: smallest by code points) if that n is ``factor`` times the word's at least, else null; root is
    the last of the forms' forms, the word itself without a form.
    """
    words = stage(counts.filter("word IS NOT NULL").groupBy("word").agg(F.sum("n").cast("long").alias("n")), "words")
    told = words.join(near_words(words), "word", "left")
    fits = F.col("near_n") >= F.col("n") * factor
    formed = stage(told.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("near")).alias("form"), F.when(fits, F.col("near_n")).alias("form_n")), "forms")
    roots = last_forms(formed.filter("form IS NOT NULL"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: op11's words: so many code points and occurrences at least.
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: In one of so many cases (by CRC) the contract deletes a code point of the run.
SLIP = 31


def slipped_words(docs: DataFrame) -> DataFrame:
    """The words of op11's contract with their counts: lower-cased letter runs, some of them short of one letter."""
    run = F.explode(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{LEAST_LENGTH},}}"), F.lit(0)))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), run.alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run"))

    def without(p: Column) -> Column:
        return F.concat(F.substring("run", F.lit(1), p), F.substring("run", p + 2, F.length("run")))

    word = bound(h, lambda h: F.when(h % SLIP == 0, without((h % F.length("run")).cast("int"))).otherwise(F.col("run")))
    words = runs.select(word.alias("word")).filter(F.length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_COUNT)


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(slipped_words(spark.read.parquet(f"{sf_dir}/documents.parquet")))


SQL = f"""
WITH RECURSIVE x AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}}')) AS run FROM documents),
c AS (SELECT id, run, count(*) AS c FROM x GROUP BY ALL),
h AS (SELECT run, c, {crc_sql("id || ':' || run")} AS h FROM c),
s AS (SELECT CASE WHEN h % {SLIP} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM h),
v AS (SELECT word, sum(c)::BIGINT AS n FROM s WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(c) >= {LEAST_COUNT}),
d AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS less FROM (SELECT word, unnest(range(length(word))) AS i FROM v)),
e AS (SELECT a.word AS a, b.word AS b FROM d AS a JOIN d AS b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
  UNION SELECT d.word, v.word FROM d JOIN v ON d.less = v.word UNION SELECT v.word, d.word FROM d JOIN v ON d.less = v.word),
b AS (SELECT a AS word, count(*) AS n_near, arg_min(b, (-n, b)) AS near, max(n) AS near_n FROM e JOIN v ON v.word = e.b GROUP BY a),
f AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= {FACTOR} * v.n THEN near END AS form, CASE WHEN near_n >= {FACTOR} * v.n THEN near_n END AS form_n FROM v LEFT JOIN b USING (word)),
r AS (SELECT word, word AS root FROM f UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = r.root WHERE f.form IS NOT NULL),
z AS (SELECT r.word, r.root FROM r JOIN f ON f.word = r.root WHERE f.form IS NULL)
SELECT f.word, f.form, z.root, f.n, f.n_near, f.form_n FROM f JOIN z USING (word)"""
