"""Numerals and article numbers as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import flatten
from .values import DIGITS, UNITS

NUMERAL = "[零一二三四五六七八九十百千]"
ARTICLE = rf"^第({NUMERAL}+)条(?:之({NUMERAL}+))?"
MENTION = r"第([零一二三四五六七八九十百千0-9]{1,8})条(?:之([零一二三四五六七八九十0-9]{1,4}))?"


def numeral(c: Column) -> Column:
    """Value of a numeral up to thousands; null if empty or with any other character. Of adjoining digits the last counts."""
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    unit = lambda x: F.coalesce(*[F.when(x == sign, F.lit(v)) for sign, v in UNITS])
    digit = lambda x: F.instr(F.lit(DIGITS), x) - 1
    start = F.struct(F.lit(0).alias("done"), F.lit(0).alias("last"))
    value = F.aggregate(
        chars, start,
        lambda a, x: F.when(unit(x).isNull(), F.struct(a["done"].alias("done"), digit(x).alias("last")))
        .otherwise(F.struct((a["done"] + F.when(a["last"] == 0, 1).otherwise(a["last"]) * unit(x)).alias("done"), F.lit(0).alias("last"))),
        lambda a: a["done"] + a["last"],
    )
    return F.when(c.rlike(rf"^{NUMERAL}+\z"), value)


def article_number(c: Column) -> Column:
    """Canonical article number (87 or 87之1) of 第八十七条, 第八十七条之一, 87 or 87之1; else null."""
    flat = flatten(c)
    main, sub = (F.regexp_extract(flat, ARTICLE, g) for g in (1, 2))
    named = F.when(sub == "", numeral(main).cast("string")).otherwise(F.concat(numeral(main).cast("string"), F.lit("之"), numeral(sub).cast("string")))
    return F.when(flat.startswith("第"), named).when(flat.rlike(r"^\p{Nd}+(之\p{Nd}+)?\z"), flat)


def mentioned_articles(c: Column) -> Column:
    """Article numbers that a text mentions, in order, repeated ones included; not convertible ones are left out."""

    def one(mention: Column) -> Column:
        part = lambda g: F.regexp_extract(mention, MENTION, g)
        number = lambda t: F.when(t.rlike("^[0-9]+$"), t.cast("long").cast("string")).otherwise(numeral(t).cast("string"))
        return F.when(part(2) == "", number(part(1))).otherwise(F.concat(number(part(1)), F.lit("之"), number(part(2))))

    return F.filter(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(MENTION), F.lit(0)), one), lambda n: n.isNotNull())


def document_number(c: Column) -> Column:
    """Canonical document number: no white space, ASCII digits, the order number in digits."""
    flat = F.translate(flatten(c), "０１２３４５６７８９", "0123456789")
    order = rf"第({NUMERAL}+)号"
    pieces, marks = F.split(flat, order, -1), F.regexp_extract_all(flat, F.lit(order), F.lit(1))
    shown = F.transform(marks, lambda m: F.concat(F.lit("第"), F.coalesce(numeral(m).cast("string"), m), F.lit("号")))
    return F.array_join(F.zip_with(pieces, shown, lambda p, s: F.concat(p, F.coalesce(s, F.lit("")))), "")
