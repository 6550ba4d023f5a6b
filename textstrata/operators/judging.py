"""Review of claims by an injected judge: many claims a call, and no claim lost by another one's fault."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.output import FENCED

#: Claims of a call.
SIZE = 16
VERDICT = "supported boolean, evidence_quote string, issues string, calls int"


def read_batch(raw: str | None, n: int) -> list[dict] | None:
    """A judge's verdicts in the order of their claims, or none of them unless there is exactly one readable verdict for each of 1..n."""
    fenced = FENCED.match(raw or "")
    try:
        told = json.loads(fenced[1] if fenced else raw or "")
        by = {r["index"]: r for r in told["reviews"]}
    except (json.JSONDecodeError, TypeError, KeyError):
        return None
    whole = len(told["reviews"]) == n and set(by) == set(range(1, n + 1)) and all(isinstance(r.get("supported"), bool) for r in by.values())
    return [by[i] for i in range(1, n + 1)] if whole else None


def reviewed(claims: DataFrame, judge: Callable[[list[str]], str], size: int = SIZE, key: str = "claim_id", text: str = "claim") -> DataFrame:
    """Per claim: the key, supported, evidence_quote, issues (JSON), and calls, the number of calls it took part in.

    ``judge`` gets up to ``size`` claims and answers for all of them. If it fails, or its answer isn't whole, the claims are halved and each half
    is judged by itself, down to a single claim; one that fails alone has a null verdict, which ``review_outcome`` makes unavailable, and takes
    no other claim with it. One bad claim among n costs about 2 log2 n calls. Claims are judged where they are, without a shuffle.
    """
    names = [key, "supported", "evidence_quote", "issues", "calls"]

    def ask(rows: list[tuple], calls: int) -> Iterator[tuple]:
        try:
            told = read_batch(judge([claim for _, claim in rows]), len(rows))
        except Exception:  # an unavailable judge is a result
            told = None
        if told is not None:
            for (k, _), v in zip(rows, told):
                yield k, v["supported"], v.get("evidence_quote"), json.dumps(v.get("issues") or [], ensure_ascii=False), calls
        elif len(rows) == 1:
            yield rows[0][0], None, None, None, calls
        else:
            half = len(rows) // 2
            yield from ask(rows[:half], calls + 1)
            yield from ask(rows[half:], calls + 1)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = list(zip(frame[key].tolist(), frame[text].tolist()))
            yield pd.DataFrame([v for at in range(0, len(rows), size) for v in ask(rows[at : at + size], 1)], columns=names)

    kind = dict(claims.dtypes)[key]
    return claims.select(key, F.coalesce(F.col(text), F.lit("")).alias(text)).mapInPandas(run, f"{key} {kind}, {VERDICT}")
