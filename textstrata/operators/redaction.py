"""Reversible redaction of identifiers: detection, placeholders, slices, restoring.

Positions and first appearances are kept per document, which SQL regular
expressions do not give; one Arrow UDF returns text, entities and spans together.
"""

from __future__ import annotations

import collections
import itertools
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F

from ..functions.arrow import arrow_udf
from ..functions.values import IDENTIFIERS

Detector = Callable[[str], list[tuple[int, int, str]]]
RESULT = "struct<redacted:string,entities:array<struct<type:string,plaintext:string,placeholder:string>>,spans:array<struct<start:int,stop:int,placeholder:string>>>"
LABELS = {name: label for name, label, _ in IDENTIFIERS} | {"person": "当事人"}


def pattern_detector(patterns: dict[str, str]) -> Detector:
    """Matches (start, end, type) of all patterns, by place."""
    compiled = [(name, re.compile(p)) for name, p in patterns.items()]
    return lambda text: sorted(((m.start(), m.end(), name) for name, p in compiled for m in p.finditer(text)), key=lambda x: x[:2])


identifiers = pattern_detector({name: p for name, _, p in IDENTIFIERS})


def apart(found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Of matches in order, those that begin where no kept one before reaches."""
    kept: list[tuple[int, int, str]] = []
    for match in found:
        if not kept or kept[-1][1] <= match[0]:
            kept.append(match)
    return kept


def placeholders(entities: list[tuple[str, str]], labels: dict[str, str]) -> list[str]:
    """A placeholder for each distinct (type, value), numbered within its type in the given order."""
    numbers = collections.defaultdict(lambda: itertools.count(1))
    return [f"[{labels.get(kind, kind)}_{next(numbers[kind])}]" for kind, _ in entities]


def redact_text(text: str | None, detect: Detector = identifiers, labels: dict[str, str] = LABELS) -> dict:
    """Spans first, then a placeholder for each distinct value by its first span, then the text with its spans exchanged."""
    text = text or ""
    spans = apart(detect(text))
    values = [(kind, text[a:b]) for a, b, kind in spans]
    entities = list(dict.fromkeys(values))
    mark = dict(zip(entities, placeholders(entities, labels), strict=True))
    borders = [0, *itertools.chain.from_iterable(s[:2] for s in spans), len(text)]
    between = [text[a:b] for a, b in zip(borders[::2], borders[1::2], strict=True)]
    whole = itertools.chain.from_iterable(itertools.zip_longest(between, map(mark.get, values), fillvalue=""))
    return {
        "redacted": "".join(whole),
        "entities": [{"type": kind, "plaintext": value, "placeholder": mark[kind, value]} for kind, value in entities],
        "spans": [{"start": a, "stop": b, "placeholder": mark[v]} for (a, b, _), v in zip(spans, values, strict=True)],
    }


def redact_udf(detect: Detector = identifiers, labels: dict[str, str] = LABELS):
    """Arrow UDF of ``redact_text`` for a detector."""

    @arrow_udf(RESULT)
    def run(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([redact_text(t, detect, labels) for t in text], columns=["redacted", "entities", "spans"])

    return run


redact = redact_udf()


def slice_text(text: str, spans: list[dict], start: int, stop: int) -> str:
    """Redacted form of text[start:stop]: a placeholder belongs to the slice in which it starts, and no part of a value shows."""
    inside = [s for s in spans if start < s["stop"] and s["start"] < stop]
    clipped = [(max(start, s["start"]), min(stop, s["stop"])) for s in inside]
    marks = [s["placeholder"] * (s["start"] >= start) for s in inside]
    borders = [start, *itertools.chain.from_iterable(clipped), max(start, stop)]
    between = [text[a:b] for a, b in itertools.batched(borders, 2)]
    return "".join(itertools.chain.from_iterable(itertools.zip_longest(between, marks, fillvalue="")))


@arrow_udf("string")
def redacted_slice(text: pd.Series, spans: pd.Series, start: pd.Series, stop: pd.Series) -> pd.Series:
    return pd.Series([slice_text(t or "", [dict(x) for x in (s if s is not None else [])], a, b) for t, s, a, b in zip(text, spans, start, stop, strict=True)])


def restore_text(text: str, entities: list[dict]) -> str:
    """The longest placeholder first, so that none is taken for the head of another."""
    for e in sorted(entities, key=lambda e: -len(e["placeholder"])):
        text = text.replace(e["placeholder"], e["plaintext"])
    return text


@arrow_udf("string")
def restore(text: pd.Series, entities: pd.Series) -> pd.Series:
    return pd.Series([restore_text(t or "", [dict(x) for x in (e if e is not None else [])]) for t, e in zip(text, entities, strict=True)])
