"""Model output: tolerant JSON of claims, all-or-nothing judge batches, single verdicts, prompts and rendered answers."""

from __future__ import annotations

import json
import re
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrow import arrow_udf
from .values import STATUS_LABELS

CLAIMS = "struct<claims:array<struct<text:string,evidence_ids:array<string>>>,missing_facts:array<string>,conflicts:array<string>,repaired:boolean,error:string>"


#: A whole in a code fence: the fence's first line, and the closing fence if there is one. A first line without an end leaves nothing.
FENCED = re.compile(r"\A\s*```[^\n]*(?:\n|\Z)(.*?)(?:```)?\s*\Z", re.DOTALL)


def unfenced(raw: str | None) -> str:
    """Without a code fence around the whole."""
    fenced = FENCED.match(raw or "")
    return (fenced[1] if fenced else raw or "").strip()


def objects_in(text: str) -> list[dict]:
    """Every JSON object that stands in a text, outermost ones, in order."""
    decoder, out, at = json.JSONDecoder(), [], 0
    while (at := text.find("{", at)) >= 0:
        try:
            value, at = decoder.raw_decode(text, at)
        except json.JSONDecodeError:
            at += 1
            continue
        out.append(value)
    return out


def strings(value: Any) -> list[str] | None:
    """A list of strings: null is empty, one value is a list of one, numbers become text; None if it can't be read so."""
    if value is None:
        return []
    items = value if isinstance(value, list) else [value]
    if any(isinstance(x, (dict, list)) for x in items):
        return None
    return [x if isinstance(x, str) else json.dumps(x) for x in items if x is not None]


def parse_claims(raw: str | None) -> dict:
    """Claims of a model's answer; several objects are merged in order. ``error`` tells why there are none."""
    empty = {"claims": None, "missing_facts": None, "conflicts": None, "repaired": False}
    text = unfenced(raw)
    repaired = False
    try:
        loaded = json.loads(text or "[]")
        found = [x for x in (loaded if isinstance(loaded, list) else [loaded]) if isinstance(x, dict)]
    except json.JSONDecodeError:
        found, repaired = objects_in(text), True
    if not found:
        return empty | {"repaired": repaired, "error": "no_object" if text else "empty"}
    merged = {k: [x for f in found if isinstance(f.get(k), list) for x in f[k]] for k in ("claims", "missing_facts", "conflicts")}
    claims = [{"text": c["text"], "evidence_ids": strings(c.get("evidence_ids"))} if isinstance(c, dict) and isinstance(c.get("text"), str) else None for c in merged["claims"]]
    lists = [strings(merged[k]) for k in ("missing_facts", "conflicts")]
    if None in lists or any(c is None or c["evidence_ids"] is None for c in claims):
        return empty | {"repaired": repaired, "error": "bad_structure"}
    return {"claims": claims, "missing_facts": lists[0], "conflicts": lists[1], "repaired": repaired, "error": None}


@arrow_udf(CLAIMS)
def claims_of(raw: pd.Series) -> pd.DataFrame:
    """Arrow UDF of ``parse_claims``."""
    return pd.DataFrame([parse_claims(r) for r in raw], columns=["claims", "missing_facts", "conflicts", "repaired", "error"])


@arrow_udf("array<string>")
def string_list(raw: pd.Series) -> pd.Series:
    """A JSON value as a list of strings; null if it isn't JSON or nested."""

    def one(text: str | None):
        try:
            return strings(json.loads(text)) if text is not None else []
        except json.JSONDecodeError:
            return None

    return raw.map(one)


VERDICT = "supported boolean, evidence_quote string, issues array<struct<kind:string,detail:string>>"


def _bare(raw: Column) -> Column:
    return F.regexp_replace(F.trim(F.coalesce(raw, F.lit(""))), r"(?s)^```[^\n]*\n?|\s*```\s*$", "")


def verdict(raw: Column) -> Column:
    """A single judge's verdict; null if it can't be read."""
    got = F.from_json(_bare(raw), VERDICT)
    return F.when(got["supported"].isNotNull(), got)


def verdict_batch(raw: Column, expected: Column) -> Column:
    """A judge's verdicts in order of their index; null as a whole unless there is exactly one for each of 1..expected."""
    got = F.from_json(_bare(raw), f"reviews array<struct<index:int,{VERDICT.replace(' ', ':', 1).replace(', evidence_quote ', ',evidence_quote:').replace(', issues ', ',issues:')}>>")["reviews"]
    numbers = F.array_sort(F.transform(got, lambda r: r["index"]))
    whole = (F.size(got) == expected) & (numbers == F.sequence(F.lit(1), expected)) & F.forall(got, lambda r: r["supported"].isNotNull())
    return F.when((expected > 0) & whole, F.array_sort(got))


def evidence_block(hits: Column) -> Column:
    """[n] title article（status）and text of each hit, blank lines between. Fields: title, display, number, legal_status, text."""
    labels = F.create_map(*[x for k, v in STATUS_LABELS.items() for x in (F.lit(k), F.lit(v))])
    one = lambda h, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), h["title"], F.lit(" "), F.coalesce(h["display"], h["number"]), F.lit("（"), F.coalesce(F.try_element_at(labels, h["legal_status"]), h["legal_status"]), F.lit("）\n"), h["text"])
    return F.array_join(F.transform(hits, one), "\n\n")


def prompt(instructions: Column, evidence: Column, question: Column) -> Column:
    return F.concat_ws("\n\n", instructions, evidence, question)


def rendered(claims: Column, shown: Column) -> Column:
    """Numbered claims with the names of their evidence, from a map of id to name."""
    cites = lambda c: F.array_join(F.transform(c["evidence_ids"], lambda i: F.coalesce(F.try_element_at(shown, i), i)), "、")
    one = lambda c, i: F.concat((i + 1).cast("string"), F.lit(". "), c["text"], F.when(F.size(c["evidence_ids"]) > 0, F.concat(F.lit("（"), cites(c), F.lit("）"))).otherwise(""))
    return F.array_join(F.transform(claims, one), "\n")


def options_of(parts: Column) -> Column:
    """A clarifying question that lists the separate questions of a text."""
    shown = F.array_join(F.transform(parts, lambda p, i: F.concat((i + 1).cast("string"), F.lit(". "), p)), "\n")
    return F.concat(F.lit("请一次问一个问题，选择其中之一：\n"), shown)


def generated(rows, generate, prompt_column: str = "prompt"):
    """Rows with ``output`` from an injected generator of a list of prompts; null where it fails for a batch."""

    def run(frames):
        for pdf in frames:
            try:
                said = generate(pdf[prompt_column].tolist())
            except Exception:  # noqa: BLE001  an unavailable model is a result: the gates turn null into a state
                said = [None] * len(pdf)
            yield pdf.assign(output=said)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", output string"
    return rows.mapInPandas(run, schema)
