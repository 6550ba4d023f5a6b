"""Changes of tables as plans: each returns the rows to write; Parquet is replaced, not edited."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key ``old`` lacks, one per key."""
    return new.join(old.select(*keys), keys, "left_anti").dropDuplicates(keys)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The table after ``new`` rows replace old ones; of several new rows of a key the last by ``order`` wins."""
    both = old.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)))
    last = Window.partitionBy(*keys).orderBy(F.col("_age").desc(), *[F.col(o).desc() for o in order])
    return both.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n", "_age")


def sync(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, action): what makes ``old`` equal to ``new``: insert, update or delete; equal rows have no row."""
    values = [c for c in new.columns if c not in keys]
    digest = lambda df: df.select(*keys, F.xxhash64(*values).alias("_h"))
    both = digest(old).withColumnRenamed("_h", "_was").join(digest(new).withColumnRenamed("_h", "_is"), keys, "full")
    action = F.when(F.col("_was").isNull(), "insert").when(F.col("_is").isNull(), "delete").when(F.col("_was") != F.col("_is"), "update")
    return both.select(*keys, action.alias("action")).filter("action IS NOT NULL")


def audited_changes(old: DataFrame, new: DataFrame, key: str, fields: list[str], required: tuple[str, ...] = ()) -> DataFrame:
    """(key, field, before, after): changed fields only. A required field that would be cleared is left out, with its row marked rejected."""
    pairs = old.alias("o").join(new.alias("n"), key)
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"o.{f}").cast("string").alias("before"), F.col(f"n.{f}").cast("string").alias("after"), F.lit(f in required).alias("required")) for f in fields])
    rows = pairs.select(key, F.explode(each).alias("c")).select(key, "c.*").filter(~F.col("before").eqNullSafe(F.col("after")))
    return rows.select(key, "field", "before", "after", (F.col("required") & F.col("after").isNull()).alias("rejected"))


def compare_and_set(rows: DataFrame, updates: DataFrame, key: str, revision: str = "revision") -> DataFrame:
    """Updates with ``applied``: whether the expected revision is still the current one."""
    return updates.join(rows.select(key, revision), key, "left").withColumn("applied", F.coalesce(F.col("expected_revision") == F.col(revision), F.lit(False))).drop(revision)


def grant_changes(grants: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Requests (keys, request) with ``outcome``: grant → added or audit_only, revoke → removed or missing."""
    there = grants.select(*keys).distinct().withColumn("_there", F.lit(True))
    out = wanted.join(there, keys, "left")
    outcome = F.when(F.col("request") == "grant", F.when(F.col("_there"), "audit_only").otherwise("added")).otherwise(F.when(F.col("_there"), "removed").otherwise("missing"))
    return out.withColumn("outcome", outcome).drop("_there")


def grant_transaction(grants: DataFrame, wanted: DataFrame, keys: list[str], actor: int) -> dict[str, DataFrame]:
    """What one transaction writes for requests (keys, request): the grants after them, an audit row each, and an outbox event for each change.

    Requests are audited whether or not they change anything; only changes are events. Of several requests of one grant the least text counts.
    """
    once = wanted.groupBy(*keys).agg(F.min("request").alias("request"))
    told = grant_changes(grants, once, keys)
    left = grants.select(*keys).join(told.filter("outcome = 'removed'").select(*keys), keys, "left_anti")
    payload = F.to_json(F.struct(*keys, "outcome"))
    return {
        "grants": left.unionByName(told.filter("outcome = 'added'").select(*keys)),
        "audit": told.select(F.concat(F.lit("grant."), "request").alias("action"), F.lit(actor).cast("long").alias("actor"), payload.alias("payload")),
        "outbox": told.filter(F.col("outcome").isin("added", "removed")).select(F.concat(F.lit("grant."), "outcome").alias("event_type"), payload.alias("payload")),
    }


def manifest(files: DataFrame, key: str = "object_key", content: str = "content") -> DataFrame:
    """Backup manifest: (key, sha256, size)."""
    return files.select(key, F.sha2(content, 256).alias("sha256"), F.octet_length(content).cast("long").alias("size"))


def restore_problems(listed: DataFrame, archive: DataFrame, present: DataFrame, key: str = "object_key") -> DataFrame:
    """What forbids a restore, before anything is written: entries missing from the archive, altered, or in conflict with present ones."""
    there = archive.select(key, F.col("sha256").alias("_a"), F.col("size").alias("_s"))
    now = present.select(key, F.col("sha256").alias("_p"))
    both = listed.join(there, key, "left").join(now, key, "left")
    problem = F.when(F.col("_a").isNull(), "missing").when((F.col("_a") != F.col("sha256")) | (F.col("_s") != F.col("size")), "altered").when(F.col("_p") != F.col("sha256"), "conflict")
    return both.select(key, problem.alias("problem")).filter("problem IS NOT NULL")
