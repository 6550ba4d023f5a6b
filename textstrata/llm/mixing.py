"""Operator 12, mixing sources to target weights by capped water-filling [native].

Each source has a weight and shares the words of the mix by it. A source stands at ``epochs`` times its own words at most: those above are
clamped there, and their excess goes to the others by weight, round after round, until none is above. A round is one aggregate over the table
of sources, and what it hands on is two sums, however many sources there are.

A target of e epochs is taken as floor(e) whole repetitions of each document and, for the rest, a seeded sample of the documents: in the order
of a seeded MD5 of key and text, each one that still fits is taken, until less than ``TOLERANCE`` of the target is open; what then is open is
closed by the smallest document left, if that comes nearer. The place in that order where the sample ends is found digit by digit (sums per
next two hex digits, ``DIGITS`` buckets a source), so no task sorts or holds a source, and a hot source costs no more than its share.

Defined results: a null or blank text has no words, is taken 0 times and gives its source nothing; a null source is a source, the last in
order; repeated rows are each their own and equal ones interchangeable; a source without words has the target 0; an empty table gives an empty
result; other columns are ignored. The same rows and seed give the same result, however they are partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_stage, partitions, stage

WEIGHTS = (1, 2, 3)
EPOCHS = 3
SEED = 13
#: A source whose open rest is at most this share of its target is filled.
TOLERANCE = 0.001
#: Hex digits of the order that one step of the search looks at.
DIGITS = 2
WORD = r"[^\x20\x09-\x0D]+"
_EXACT = "decimal(38,0)"


def mix_rows(df: DataFrame, key: str, source: str, text: str, seed: int = SEED) -> DataFrame:
    """Per row: doc_id (the key), name (the source, not null), source, size in words, draw (its place in the seeded order), rid and part."""
    whole = F.coalesce(F.col(text), F.lit(""))
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(key).cast("string"), F.lit("")), whole))
    name = F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit(""))
    return df.select(
        F.col(key).alias("doc_id"), name.alias("name"), F.col(source).alias("source"), F.regexp_count(whole, F.lit(WORD)).cast("long").alias("size"),
        draw.alias("draw"), F.monotonically_increasing_id().alias("rid"), F.spark_partition_id().alias("part"),
    )


def source_weights(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Per source: name, words, weight. Weights repeat over the sources by code point, null last; the ranks are counted per range, not in one task."""
    sums = rows.groupBy("name", "source").agg(F.sum("size").alias("words"))
    order = [F.col("source").asc_nulls_last()]
    ranged = stage(sums.repartitionByRange(partitions(rows.sparkSession), *order).withColumn("range", F.spark_partition_id()), "sources")
    before = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("here")).withColumn("before", F.coalesce(F.sum("here").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy(*order)) - 1
    weight = F.get(F.array(*map(F.lit, weights)), (rank % len(weights)).cast("int"))
    return ranged.join(before, "range").select("name", "words", weight.cast("long").alias("weight"))


def fill(sources: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """``sources`` (name, words, weight) with their target: capped water-filling of all their words."""
    cap = (F.col("words") * epochs).cast(_EXACT)
    weight = F.col("weight").cast(_EXACT)
    words, weights = sources.agg(F.sum("words"), F.sum("weight")).first()
    open_words, open_weight, clamped = words or 0, weights or 0, 0
    while True:
        # above its cap at the present level of open_words / open_weight a unit of weight
        above = cap * F.lit(str(open_weight)).cast(_EXACT) < weight * F.lit(str(open_words)).cast(_EXACT)
        if not open_weight:
            break
        caps, heavy, n = sources.filter(above).agg(F.sum(cap), F.sum(weight), F.count(F.lit(1))).first()
        if n == clamped:
            break
        open_words, open_weight, clamped = (words or 0) - int(caps), weights - int(heavy), n
    level = F.lit(float(open_words)) * F.col("weight") / F.lit(float(open_weight or 1))
    return sources.withColumn("target", F.when(above, cap.cast("double")).otherwise(level) if open_weight else cap.cast("double"))


def _in_rounds(size: Column, draw: Column) -> Column:
    """Whether a row is before the end of any round of its source that it could fit in."""
    return (size > 0) & F.exists("rounds", lambda r: (size <= r["limit"]) & (draw < r["edge"]))


def _step(rows: DataFrame, state: DataFrame) -> DataFrame:
    """One search step of each open source: two digits further into its order, or the end of a round."""
    at = F.length("prefix")
    fits = (F.col("size") > 0) & (F.col("size") <= F.col("limit")) & F.col("draw").startswith(F.col("prefix")) & ~_in_rounds(F.col("size"), F.col("draw"))
    inside = rows.join(state.filter("open"), "name").filter(fits)
    sums = inside.groupBy("name", "rest", F.substring("draw", at + 1, F.lit(DIGITS)).alias("digit")).agg(
        F.sum("size").alias("words"), F.min("draw").alias("first"), F.max("draw").alias("last"), F.min("size").alias("one")
    )
    ahead = F.coalesce(F.sum("words").over(Window.partitionBy("name").orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    beyond = F.when(F.col("before") + F.col("words") > F.col("rest"), F.struct("digit", "before", "first", "last", "one"))
    found = state.join(sums.withColumn("before", ahead).groupBy("name").agg(F.sum("words").alias("all"), F.min(beyond).alias("end")), "name", "left")
    # without an end (at the start of a round only) all that fits is taken, and nothing is left to fit
    end, ended = F.col("end"), F.col("end").isNotNull()
    single = F.coalesce(end["first"] == end["last"], F.lit(False))
    copies = F.floor((F.col("rest") - end["before"]) / end["one"]).cast("long")
    rest = F.when(ended, F.col("rest") - end["before"] - F.when(single, copies * end["one"]).otherwise(0)).otherwise(F.col("rest") - F.coalesce("all", F.lit(0)))
    limit = F.col("limit").alias("limit")
    closed = F.when(ended, F.struct(limit, end["first"].alias("edge"), copies.alias("copies"))).otherwise(F.struct(limit, F.lit("g").alias("edge"), F.lit(0).cast("long").alias("copies")))
    moved = lambda new, column: F.when(F.col("open"), new).otherwise(F.col(column)).alias(column)
    deeper = ended & ~single
    return found.select(
        "name", "target", moved(rest, "rest"), moved(F.when(deeper, F.col("limit")).otherwise(rest), "limit"),
        moved(F.when(deeper, F.concat("prefix", end["digit"])).otherwise(F.lit("")), "prefix"),
        moved(F.when(deeper, F.col("rounds")).otherwise(F.concat("rounds", F.array(closed))), "rounds"),
        moved(deeper | (single & (rest > F.col("target") * TOLERANCE)), "open"),
    )


def _staged_state(state: DataFrame) -> tuple[DataFrame, int]:
    watch = Observation()
    out = stage(state.observe(watch, F.count_if("open").alias("open")), "mix_state")
    return out, watch.get["open"]


def sample_ends(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Per source: rounds, each with the limit of what may fit, the draw at which it ends and how many copies of that one are in."""
    none = F.array().cast("array<struct<limit: bigint, edge: string, copies: bigint>>")
    quota = F.floor(F.col("target") - F.col("whole") * F.col("words")).cast("long")
    begun = plan.select("name", "target", quota.alias("rest"), quota.alias("limit"), F.lit("").alias("prefix"), none.alias("rounds"), (quota > 0).alias("open"))
    state, left = _staged_state(begun)
    while left:
        before = state
        state, left = _staged_state(_step(rows, state))
        drop_stage(before)
    # the smallest document left, where it comes nearer to the target
    unfilled = state.filter(F.col("rest") > F.col("target") * TOLERANCE)
    out = ~_in_rounds(F.col("size"), F.col("draw")) & ~F.exists("rounds", lambda r: (F.col("draw") == r["edge"]) & (r["copies"] > 0))
    least = rows.join(unfilled, "name").filter("size > 0").filter(out).groupBy("name", "rest").agg(F.min(F.struct("size", "draw")).alias("least")).filter(F.col("least.size") < 2 * F.col("rest"))
    more = F.array(F.struct(F.col("least.size").alias("limit"), F.col("least.draw").alias("edge"), F.lit(1).cast("long").alias("copies")))
    return state.join(least.drop("rest"), "name", "left").select("name", F.when(F.col("least").isNull(), F.col("rounds")).otherwise(F.concat("rounds", more)).alias("rounds"))


def mix(df: DataFrame, key: str, source: str, text: str, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """Per row: doc_id (the key), size, source_size, target (both its source's), repetitions and taken (words the mix takes of it)."""
    rows = stage(mix_rows(df, key, source, text, seed), "mix_rows")
    whole = F.when(F.col("words") > 0, F.least(F.lit(epochs), F.floor(F.col("target") / F.col("words")))).otherwise(0).cast("long")
    plan = stage(fill(source_weights(rows, weights), epochs).withColumn("whole", whole), "mix_plan")
    # a draw may end one round without being in, and close the source after all
    ends = stage(plan.join(sample_ends(rows, plan), "name").select("name", F.col("words").alias("source_size"), "target", "whole", "rounds"), "mix_ends")
    placed = rows.join(ends, "name").withColumn("copies", F.array_max(F.expr("filter(rounds, r -> r.edge = draw).copies"))).withColumn("sampled", _in_rounds(F.col("size"), F.col("draw")).cast("long"))
    shown = lambda extra: ["doc_id", "size", "source_size", "target", (F.col("whole") + extra).alias("repetitions"), (F.col("size") * (F.col("whole") + extra)).alias("taken")]
    at_edge = (F.coalesce("copies", F.lit(0)) > 0) & (F.col("sampled") == 0)
    # of equal rows at the end of a round so many are in; they are numbered within the partitions they were read in
    edge = placed.filter(at_edge)
    heads = edge.groupBy("name", "draw", "part").agg(F.count(F.lit(1)).alias("here"))
    heads = heads.withColumn("earlier", F.coalesce(F.sum("here").over(Window.partitionBy("name", "draw").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("here")
    number = F.col("earlier") + F.row_number().over(Window.partitionBy("name", "draw", "part").orderBy("rid"))
    return placed.filter(~at_edge).select(*shown(F.col("sampled"))).unionByName(edge.join(heads, ["name", "draw", "part"]).withColumn("number", number).select(*shown((F.col("number") <= F.col("copies")).cast("long"))))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "source", "text")


SQL = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS draw FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS words, [{', '.join(map(str, WEIGHTS))}][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1)::INT]::BIGINT AS w FROM d GROUP BY source),
o AS (SELECT *, sum(words) OVER () AS t, sum(w) OVER () AS tw, coalesce(sum(words * {EPOCHS}) OVER (ORDER BY words::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c,
  coalesce(sum(w) OVER (ORDER BY words::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cw FROM s),
f AS (SELECT *, words * {EPOCHS} * (tw - cw) < (t - c) * w AS above FROM o),
l AS (SELECT *, (t - sum(CASE WHEN above THEN words * {EPOCHS} ELSE 0 END) OVER ())::DOUBLE * w / (tw - sum(CASE WHEN above THEN w ELSE 0 END) OVER ())::DOUBLE AS level FROM f),
p AS (SELECT source, words, CASE WHEN above THEN (words * {EPOCHS})::DOUBLE ELSE level END AS target FROM l),
q AS (SELECT *, CASE WHEN words > 0 THEN least({EPOCHS}, floor(target / words)) ELSE 0 END::BIGINT AS whole FROM p),
z AS (SELECT source, words, target, whole, floor(target - whole * words)::BIGINT AS quota FROM q),
i AS (SELECT d.*, row_number() OVER (PARTITION BY d.source ORDER BY draw, rid) AS i FROM d),
g AS (SELECT source, 0::BIGINT AS i, NULL::BIGINT AS rid, FALSE AS taken, quota AS rest, quota AS lim, quota > 0 AS act, target FROM z
  UNION ALL
  SELECT g.source, i.i, i.rid, g.act AND i.size > 0 AND i.size <= g.lim AND i.size <= g.rest,
    CASE WHEN g.act AND i.size <= g.lim AND i.size <= g.rest THEN g.rest - i.size ELSE g.rest END,
    CASE WHEN g.act AND i.size <= g.lim AND i.size > g.rest THEN g.rest ELSE g.lim END,
    CASE WHEN g.act AND i.size <= g.lim AND i.size > g.rest THEN g.rest > g.target * {TOLERANCE} ELSE g.act END, g.target
  FROM g JOIN i ON i.source IS NOT DISTINCT FROM g.source AND i.i = g.i + 1),
e AS (SELECT source, arg_max(rest, i) AS rest FROM g GROUP BY source HAVING arg_max(rest, i) > any_value(target) * {TOLERANCE}),
m AS (SELECT e.source, arg_min(i.rid, (i.size, i.draw, i.rid)) AS rid FROM e JOIN g ON g.source IS NOT DISTINCT FROM e.source AND NOT g.taken JOIN i ON i.rid = g.rid WHERE i.size > 0
  GROUP BY e.source HAVING min(i.size) < 2 * any_value(e.rest))
SELECT d.doc_id, d.size, z.words AS source_size, z.target, (z.whole + extra)::BIGINT AS repetitions, (d.size * (z.whole + extra))::BIGINT AS taken
FROM (SELECT d.*, (coalesce(g.taken, FALSE) OR d.rid IN (SELECT rid FROM m))::INT AS extra FROM d LEFT JOIN g ON g.rid = d.rid) AS d JOIN z ON z.source IS NOT DISTINCT FROM d.source"""
