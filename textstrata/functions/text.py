"""Text functions as columns. Null in, null out, unless a docstring says otherwise."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrow import arrow_udf
from .values import EMPTY_WORDS, FORMAL_TERMS, LEAST_SUBSTANCE, QUESTION_PHRASES
from .wordgrams import best_stretch, ordered_grams

#: Any Unicode white space; the ideographic space is one.
BLANK = r"(?U)\s+"
TERM_BREAK = r"(?U)[\s，、；;]+"
FULL_WIDTH = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
HALF_WIDTH = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once a row; a column that an expression names twice is else computed twice."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def clean_text(c: Column) -> Column:
    """Line breaks as LF, no white space at the ends of lines or of the text."""
    lf = F.regexp_replace(c, r"\r\n?", "\n")
    return F.regexp_replace(F.regexp_replace(lf, r"(?U)[\s&&[^\n]]+(?=\n|\z)", ""), r"(?U)\A\s+|\s+\z", "")


def flatten(c: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(c, BLANK, "")


def flatten_stored(c: Column) -> Column:
    """Without ASCII white space and ideographic spaces: how stored text is compared in keyword search."""
    return F.regexp_replace(c, "[\\s　]+", "")


def split_terms(query: str) -> list[str]:
    """Search terms of a query: cut at white space and enumeration commas first, then flattened."""
    import re

    return [t for t in (re.sub(r"\s+", "", part) for part in re.split(r"[\s，、；;]+", query)) if t]


def terms(c: Column) -> Column:
    """``split_terms`` as an array column."""
    return F.filter(F.transform(F.split(c, TERM_BREAK), flatten), lambda t: t != "")


def normalize_query(c: Column) -> Column:
    """Half-width, without white space and sentence marks."""
    return F.regexp_replace(flatten(F.translate(c, FULL_WIDTH, HALF_WIDTH)), "[？?！!。，,；;：:、]+", "")


def strip_phrases(c: Column) -> Column:
    """Without question phrases; what is left is separated by single blanks."""
    for phrase in QUESTION_PHRASES:
        c = F.replace(c, F.lit(phrase), F.lit(" "))
    return F.trim(F.regexp_replace(c, BLANK, " "))


def formal_variants(c: Column) -> Column:
    """One variant per colloquial term that occurs, all its occurrences replaced."""
    table = F.array(*[F.struct(F.lit(a).alias("said"), F.lit(b).alias("meant")) for a, b in FORMAL_TERMS])
    return F.array_distinct(F.transform(F.filter(table, lambda t: F.contains(c, t["said"])), lambda t: F.replace(c, t["said"], t["meant"])))


def query_variants(c: Column) -> Column:
    """The query, normalised, stripped and with formal terms: distinct, not blank, in that order."""

    def of(normal: Column, bare: Column) -> Column:
        formal = F.array_distinct(F.concat(formal_variants(normal), F.when(bare != "", formal_variants(bare)).otherwise(F.array().cast("array<string>"))))
        return F.array_distinct(F.filter(F.concat(F.array(c, normal, bare), formal), lambda v: v.rlike(r"(?U)\S")))

    return let(normalize_query(c), lambda normal: let(strip_phrases(normal), lambda bare: of(normal, bare)))


def substance(c: Column) -> Column:
    """What a question holds beyond phrases and empty words."""
    bare = strip_phrases(normalize_query(c))
    for word in EMPTY_WORDS:
        bare = F.replace(bare, F.lit(word), F.lit(" "))
    return flatten(bare)


def is_vague(c: Column) -> Column:
    return F.length(substance(c)) < LEAST_SUBSTANCE


def split_questions(c: Column) -> Column:
    """The separate questions of a text; the text itself if fewer than two have substance; empty if blank."""
    text = F.trim(F.coalesce(c, F.lit("")))
    parts = F.filter(F.transform(F.split(text, "[？?；;]+"), lambda p: F.trim(p)), lambda p: F.length(substance(p)) >= LEAST_SUBSTANCE)
    return F.when(text == "", F.array().cast("array<string>")).when(F.size(parts) <= 1, F.array(text)).otherwise(parts)


def first_of(c: Column, words: list[str]) -> Column:
    """The first word of the list that the text contains, else null."""
    return F.get(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(c, w)), F.lit(0))


def article_sort_key(c: Column) -> Column:
    """Leading digits as a number, else null."""
    return F.regexp_extract(c, "^([0-9]+)", 1).try_cast("int")


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def backoff(attempt: Column, base: int, most: int) -> Column:
    """Seconds before a retry: doubled per attempt, bounded."""
    return F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2), F.greatest(attempt - 1, F.lit(0)))).cast("long")


def trigrams(c: Column) -> Column:
    """Distinct trigrams of the lower-cased words, each padded with two blanks before and one after."""
    words = F.array_distinct(F.filter(F.split(F.lower(c), r"(?U)[^\p{L}\p{N}]+"), lambda w: w != ""))
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))

    def of(word: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(word) - 2), lambda i: F.substr(word, i, F.lit(3)))

    return F.array_distinct(F.flatten(F.transform(padded, of)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements of two arrays of distinct elements; 0 if both are empty."""
    sizes = lambda p: F.struct(F.size(p["a"]).alias("a"), F.size(p["b"]).alias("b"), F.size(F.array_intersect(p["a"], p["b"])).alias("both"))
    share = lambda n: F.when(n["a"] + n["b"] == 0, 0.0).otherwise(n["both"] / (n["a"] + n["b"] - n["both"]))
    return let(let(F.struct(a.alias("a"), b.alias("b")), sizes), share)


def best_extent(needle: str, text: str) -> float:
    """The needle's greatest trigram similarity to any run of the text's trigrams."""
    return best_stretch(ordered_grams(text), np.unique(ordered_grams(needle)))


@arrow_udf("double")
def word_similarity(needle: pd.Series, text: pd.Series) -> pd.Series:
    """Arrow UDF of ``best_extent``; null counts as empty."""
    return pd.Series([best_extent(a or "", b or "") for a, b in zip(needle, text, strict=True)], dtype="float64")


def short_title(c: Column) -> Column:
    return F.replace(F.coalesce(c, F.lit("")), F.lit("中华人民共和国"), F.lit(""))


def alias_of(c: Column) -> Column:
    return F.regexp_replace(c, "^中华人民共和国", "")


def difference_ratio(a: Column, b: Column) -> Column:
    """Share of places at which two texts differ, the shorter one's missing end counted."""
    size = F.greatest(F.length(a), F.length(b))
    both = F.least(F.length(a), F.length(b))
    chars = lambda t: F.split(F.left(t, both), "")
    differs = F.size(F.filter(F.zip_with(chars(a), chars(b), lambda x, y: x != y), lambda x: x))
    return F.when((a == b) | (size == 0), 0.0).otherwise(differs / size + F.abs(F.length(a) - F.length(b)) / size)


def box_on_page(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """[left, top, right, bottom] as shares of the page, clamped; null for a page without size."""
    clamp = lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))
    xs, ys = (x0 / width, x1 / width), (y0 / height, y1 / height)
    box = F.array(clamp(F.least(*xs)), clamp(F.least(*ys)), clamp(F.greatest(*xs)), clamp(F.greatest(*ys)))
    return F.when((width > 0) & (height > 0), box)


def box_overlap(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes; 0 for boxes without area."""
    span = lambda lo, hi: F.greatest(F.lit(0.0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]))
    area = lambda r: (r[2] - r[0]) * (r[3] - r[1])
    both = span(0, 2) * span(1, 3)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)
