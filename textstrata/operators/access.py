"""Row-level access: document and page scope, role permissions, lock-out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import ROLES


def document_scope(docs: DataFrame, grants: DataFrame, user, key: str = "doc_id", scope: str = "access_scope") -> DataFrame:
    """Documents that are open to the organisation or granted to ``user``. ``grants``: resource_id, user_id."""
    own = grants.filter(F.col("user_id") == user).select(F.col("resource_id").alias(key)).distinct().withColumn("_granted", F.lit(True))
    return docs.join(own, key, "left").filter((F.col(scope) == "organization") | F.col("_granted")).drop("_granted")


def page_scope(pages: DataFrame, grants: DataFrame, cited: DataFrame, visible: DataFrame, user, organisation) -> DataFrame:
    """Pages of the organisation, open or granted, without a published citation to a document that isn't visible. ``cited``: page_id, doc_id."""
    hidden = cited.join(visible.select("doc_id").distinct(), "doc_id", "left_anti").select("page_id").distinct()
    scoped = document_scope(pages.filter(F.col("org_id") == organisation), grants, user, "page_id")
    return scoped.join(hidden, "page_id", "left_anti")


def visible_or_missing(scoped: DataFrame, key: str, value) -> DataFrame:
    """One resource of a scoped view; missing and forbidden ones look the same: no row."""
    return scoped.filter(F.col(key) == value)


def permissions(user_roles: DataFrame) -> DataFrame:
    """(user_id, permissions): the union over a user's roles; unknown roles grant nothing."""
    table = F.create_map(*[x for role, granted in ROLES.items() for x in (F.lit(role), F.array(*map(F.lit, granted)))])
    each = user_roles.select("user_id", F.explode_outer(F.try_element_at(table, F.col("role"))).alias("p"))
    return each.groupBy("user_id").agg(F.array_sort(F.collect_set("p")).alias("permissions"))


def failures_within(events: DataFrame, key: str, seconds: int = 900, ts: str = "ts") -> DataFrame:
    """Each failure with the number of failures of its key in the trailing span, itself included."""
    trailing = Window.partitionBy(key).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("n_failures", F.count(F.lit(1)).over(trailing))


def effective_on(day: Column | str, start: str = "effective_from", stop: str = "effective_to") -> Column:
    """In force on a day: half open, unknown bounds don't exclude."""
    d = F.lit(day) if isinstance(day, str) else day
    return (F.col(start).isNull() | (F.col(start) <= d)) & (F.col(stop).isNull() | (F.col(stop) > d))


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)
