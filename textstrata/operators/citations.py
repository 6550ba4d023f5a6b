"""Citations between articles, and the graph that they make."""

from __future__ import annotations

import functools
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import arrow_udf
from ..functions.values import CITATION_REACH, COUNTRY, LOCAL_NAMES
from .structure import value_of

NUMBER, SUB = "[一二三四五六七八九十百零〇两0-9]{1,8}", "[一二三四五六七八九十百零〇两0-9]{1,3}"
CONVERTS = "[零一二三四五六七八九十百千]"
#: A mention of an article; or, where 至 stands between two mentions without sub-numbers and no third one, a range of them.
MENTIONS = re.compile(
    f"第(?P<from>{CONVERTS}+)条(?!之{SUB})(?:(?!第{NUMBER}条)(?!至).)*至(?:(?!第{NUMBER}条).)*第(?P<to>{CONVERTS}+)条(?!之{CONVERTS})"
    f"|第(?P<one>{NUMBER})条(?:之(?P<sub>{SUB}))?", re.S
)
RESULT = "array<struct<target:string,alias:string,evidence:string>>"


def targets(m: re.Match) -> list[str]:
    """Article numbers that a match names; none if its numeral doesn't convert. A sub-number is read as far as it converts."""
    if m["to"]:
        return [str(n) for n in range(value_of(m["from"]), value_of(m["to"]) + 1)]
    if not re.fullmatch(f"{CONVERTS}+", m["one"]):
        return []
    sub = re.match(f"{CONVERTS}+", m["sub"] or "")
    return [str(value_of(m["one"])) + (f"之{value_of(sub[0])}" if sub else "")]


@functools.lru_cache(4096)
def following(name: str, longer: tuple[str, ...], marks: str) -> re.Pattern:
    """A name where no longer one begins, and, as group 1, the words after it up to a mark."""
    none = f"(?!{'|'.join(map(re.escape, longer))})" if longer else ""
    return re.compile(f"{none}{re.escape(name)}(?=((?:(?!{marks}).){{0,{CITATION_REACH}}}))", re.S)


def extract(text: str | None, article: str | None, titles: list[str]) -> list[dict]:
    """Distinct citations of a provision's text: to its own law, to the article before, to named laws."""
    flat = re.sub(r"\s+", "", text or "")
    aliases = sorted({t.removeprefix(COUNTRY): None for t in titles if t.removeprefix(COUNTRY)}, key=len, reverse=True)
    marks = "|".join(["[。；;《]", *map(re.escape, aliases)])
    cited = [(name, None, following(name, (), marks)) for name in LOCAL_NAMES]
    named = [(a, a, following(a, tuple(aliases[:i]), marks)) for i, a in enumerate(aliases)]

    def found(names) -> list[tuple[str, str | None, str]]:
        return [(target, alias, name + m[0]) for name, alias, pattern in names for window in pattern.finditer(flat) for m in MENTIONS.finditer(window[1]) for target in targets(m)]

    before = [(str(int(article) - 1), None, "前条")] if article and article.isdigit() and int(article) > 1 and "前条" in flat else []
    first: dict[tuple[str, str | None], str] = {}
    for target, alias, evidence in [*found(cited), *before, *found(named)]:
        first.setdefault((target, alias), evidence)
    return [{"target": target, "alias": alias, "evidence": evidence} for (target, alias), evidence in first.items()]


@arrow_udf(RESULT)
def citations(text: pd.Series, article: pd.Series, titles: pd.Series) -> pd.Series:
    """Arrow UDF of ``extract``; ``titles`` is a bounded list of law titles."""
    return pd.Series([extract(t, a, list(n) if n is not None else []) for t, a, n in zip(text, article, titles, strict=True)])


def linked(cites: DataFrame, identities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges and unresolved citations. ``cites``: source, instrument, target; ``identities``: identity, instrument, number."""
    named = identities.select(F.col("identity").alias("target_identity"), "instrument", F.col("number").alias("target"))
    edges = cites.join(named, ["instrument", "target"]).filter(F.col("source") != F.col("target_identity")).select("source", "target_identity", F.lit("cite").alias("relation")).distinct()
    return edges, cites.join(named, ["instrument", "target"], "left_anti")


def one_hop(edges: DataFrame, seeds: DataFrame, versions: DataFrame) -> DataFrame:
    """Provisions that the seeds cite, in the seed's own legal version. ``seeds`` and ``versions``: identity, version."""
    start = seeds.select(F.col("identity").alias("source"), "version").distinct()
    near = edges.join(start, "source").select(F.col("target_identity").alias("identity"), "version").distinct()
    return near.join(versions, ["identity", "version"]).join(seeds.select("identity", "version").distinct(), ["identity", "version"], "left_anti")
