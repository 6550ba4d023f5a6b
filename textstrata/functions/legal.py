"""Legal metadata of a document from its file name and the texts before its first article."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import flatten, let
from .values import STATE_ORGANS, TITLE_ENDS, UNKNOWN_TEXT, UNLABELLED

DATE = r"([0-9]{4})年([0-9]{1,2})月([0-9]{1,2})日"
EDITION = r"[（(][^（()）]{0,30}(?:年|修正|修订|文本|草案)[^（()）]{0,30}[)）]"
REMARK = r"[（(][^（()）]*[)）]$"
NUMBER = r"(?:中华人民共和国主席令|国务院令)第[零一二三四五六七八九十百千〇0-9]+号"
ENDS = "|".join(end for end, _ in TITLE_ENDS)


def date_of(year: Column, month: Column, day: Column) -> Column:
    """A date, or null if there is no such day."""
    return F.try_to_date(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")


def title(c: Column) -> Column:
    """Without white space, title marks at the ends and edition remarks at the end."""
    bare = F.regexp_replace(flatten(c), "^[《》〈〉]+|[《》〈〉]+$", "")
    return F.regexp_replace(bare, f"(?:{EDITION})+$", "")


def file_stem(c: Column) -> Column:
    base = F.regexp_extract(F.replace(c, F.lit("\\"), F.lit("/")), "([^/]*)/*$", 1)
    return F.regexp_replace(base, r"(?<=.)\.[^.]+$", "")


def file_title(c: Column) -> Column:
    return title(F.regexp_replace(file_stem(c), "_[0-9]{8}$", ""))


def file_date(c: Column) -> Column:
    part = lambda g: F.regexp_extract(file_stem(c), "_([0-9]{4})([0-9]{2})([0-9]{2})$", g)
    return date_of(part(1), part(2), part(3))


def is_title(c: Column) -> Column:
    """Whether a text can be the title of a law."""
    shape = (F.length(c) > 0) & (F.length(c) <= 80) & ~c.rlike("[，。；：、！？]") & ~F.contains(c, F.lit("关于"))
    return shape & F.regexp_replace(c, REMARK, "").rlike(f"(?:{ENDS})$")


def title_candidates(preamble: Column) -> Column:
    """Titles that the texts give, in order: those in title marks first, then a text that is one."""

    def of(text: Column) -> Column:
        named = lambda flat: F.filter(F.regexp_extract_all(flat, F.lit("《([^《》〈〉]{2,80})》"), F.lit(1)), is_title)
        return let(flatten(text), lambda flat: F.transform(F.concat(named(flat), F.filter(F.array(flat), is_title)), title))

    return F.flatten(F.transform(preamble, of))


def chosen_title(filename: Column, preamble: Column) -> Column:
    """Struct (title, unsure): the candidate that the file name confirms, else the first one, else the file name."""

    def of(known: Column) -> Column:
        from_file, found = known["file"], known["found"]
        sure = (from_file != "") & F.array_contains(found, from_file)
        text = F.when(sure, from_file).when(F.size(found) > 0, F.get(found, F.lit(0))).when(from_file != "", from_file).otherwise(UNKNOWN_TEXT)
        return F.struct(text.alias("title"), (~sure).alias("unsure"))

    return let(F.struct(file_title(filename).alias("file"), title_candidates(preamble).alias("found")), of)


def issuer(preamble: Column) -> Column:
    heads = F.filter(F.transform(preamble, lambda t: F.regexp_extract(flatten(t), "^(.{2,40}?)(?=关于|印发|发布|制定)", 1)), lambda h: h != "")

    def of(whole: Column) -> Column:
        has = lambda w: F.contains(whole, F.lit(w))
        return F.when(has(STATE_ORGANS[2]), STATE_ORGANS[2]).when(has(STATE_ORGANS[1]), STATE_ORGANS[1]).when(has("国务院令"), STATE_ORGANS[0]).otherwise(F.coalesce(F.get(heads, F.lit(0)), F.lit(UNKNOWN_TEXT)))

    return let(flatten(F.array_join(preamble, "")), of)


def promulgation(filename: Column, preamble: Column) -> Column:
    """Struct (label, day, reason): the last amendment clause, else the last date, else the file's date, else unlabelled."""
    reach = rf"(?s){DATE}(?=(.{{0,60}}))"

    def real(whole: Column) -> Column:
        part = [F.regexp_extract_all(whole, F.lit(reach), F.lit(g)) for g in (1, 2, 3, 4)]
        dated = F.zip_with(F.zip_with(part[0], part[1], lambda y, m: F.struct(y.alias("y"), m.alias("m"))), F.zip_with(part[2], part[3], lambda d, w: F.struct(d.alias("d"), w.alias("w"))), lambda a, b: F.struct(date_of(a["y"], a["m"], b["d"]).alias("day"), act(b["w"]).alias("act")))
        return F.filter(dated, lambda x: x["day"].isNotNull())

    act = lambda w: F.coalesce(*[F.when(F.contains(w, F.lit(k)), F.lit(k)) for k in ("修订", "修正", "通过")])
    year = lambda d: F.concat(F.year(d).cast("string"), F.lit("年"))
    made = lambda label, day, reason: F.struct(label.alias("label"), day.alias("day"), F.lit(reason).cast("string").alias("reason"))

    def of(found: Column) -> Column:
        clause, last, of_file = found["clause"], found["last"], found["file"]
        labelled = F.when(clause["act"] == "通过", year(clause["day"])).otherwise(F.concat(year(clause["day"]), clause["act"]))
        return (
            F.when(clause.isNotNull(), made(labelled, clause["day"], None))
            .when(last.isNotNull(), made(year(last["day"]), last["day"], "version_label_from_bare_date"))
            .when(of_file.isNotNull(), made(of_file.cast("string"), of_file, "version_label_from_filename"))
            .otherwise(made(F.lit(UNLABELLED), F.lit(None).cast("date"), "version_label_unlabelled"))
        )

    def chosen(dates: Column) -> Column:
        clause = F.try_element_at(F.filter(dates, lambda x: x["act"].isNotNull()), F.lit(-1))
        return let(F.struct(clause.alias("clause"), F.try_element_at(dates, F.lit(-1)).alias("last"), file_date(filename).alias("file")), of)

    return let(let(flatten(F.array_join(preamble, "")), real), chosen)


def instrument_type(named: Column, issued_by: Column) -> Column:
    def of(base: Column) -> Column:
        kind = F.when(F.contains(base, F.lit("宪法")), "constitution")
        for end, value in TITLE_ENDS:
            own = F.lit(value) if value else F.when(issued_by.isin(STATE_ORGANS), "administrative_regulation").otherwise("department_rule")
            kind = kind.when(base.endswith(end), own)
        return kind.when(issued_by == STATE_ORGANS[0], "administrative_regulation").otherwise("other")

    return let(F.regexp_replace(named, REMARK, ""), of)


def effective_day(preamble: Column) -> Column:
    whole = flatten(F.array_join(preamble, ""))
    part = lambda g: F.regexp_extract(whole, f"自{DATE}起施行", g)
    return date_of(part(1), part(2), part(3))


def legal_status(effective: Column, today: Column) -> Column:
    return F.when(effective.isNull(), "unknown").when(effective > today, "not_yet_effective").otherwise("effective")


def metadata(filename: Column, preamble: Column, today: Column) -> Column:
    """All of it as one struct."""

    def of(found: Column) -> Column:
        named, version, body, day = (found[c] for c in ("named", "version", "body", "day"))
        reasons = F.array_compact(F.array(version["reason"], F.when(named["unsure"], "title_from_filename")))
        return F.struct(
            named["title"].alias("title"), instrument_type(named["title"], body).alias("instrument_type"), F.lit("中国").alias("jurisdiction"), body.alias("issuing_body"),
            found["number"].alias("document_number"), version["label"].alias("version_label"),
            version["day"].alias("promulgated_on"), day.alias("effective_from"), legal_status(day, today).alias("legal_status"), reasons.alias("low_confidence_reasons"),
        )

    number = F.try_element_at(F.regexp_extract_all(flatten(F.array_join(preamble, "")), F.lit(NUMBER), F.lit(0)), F.lit(-1))
    found = {"named": chosen_title(filename, preamble), "version": promulgation(filename, preamble), "body": issuer(preamble), "day": effective_day(preamble), "number": number}
    return let(F.struct(*[c.alias(name) for name, c in found.items()]), of)
