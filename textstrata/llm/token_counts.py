"""Operator 3, token counts by offset-mapped attribution.

Each document is encoded once, whole: its fields joined by the separator, or a
single text. Token character spans are interval-joined to the spans of the
sections (here: lines, each with its line break) by binary search. A token that
crosses a boundary is allocated by an explicit rule:

* ``start``: to the section that holds its first character (default);
* ``end``: to the section that holds its last character;
* ``most``: to the section that holds most of its characters, the earlier one on a tie.

Every token goes to exactly one section, so section counts add up to the
document's count. Tokens of one character split over several tokens count in
that character's section.

Defined results: null and empty text has no token and no section; repeated rows
give repeated results; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import codec, steps, vocabulary
from .common import small_batches

RULES = ("start", "end", "most")


def line_starts(text: str) -> np.ndarray:
    """Code-point starts of the lines of a text; a break belongs to the line that it ends."""
    if not text:
        return np.zeros(0, np.int64)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    breaks = np.flatnonzero(points == 10) + 1
    return np.concatenate(([0], breaks[breaks < len(points)])).astype(np.int64)


def allocate(starts: np.ndarray, ends: np.ndarray, sections: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """Tokens per section, and the number of tokens that cross a boundary."""
    first = np.searchsorted(sections, starts, "right") - 1
    last = np.searchsorted(sections, np.maximum(starts, ends - 1), "right") - 1
    own = last if rule == "end" else first.copy()
    crossing = np.flatnonzero(first != last)
    if rule == "most":
        for i in crossing:
            edges = np.concatenate(([starts[i]], sections[first[i] + 1 : last[i] + 1], [ends[i]]))
            own[i] = first[i] + int(np.argmax(np.diff(edges)))
    return np.bincount(own, minlength=len(sections)).astype(np.int64), len(crossing)


def section_tokens(df: DataFrame, key: str = "doc_id", fields: tuple[str, ...] = ("text",), separator: str = "\n", path: str | None = None, rule: str = "start") -> DataFrame:
    """Per row: key, n_tokens, n_sections, n_crossing, section_starts and section_tokens (arrays, in order of the text)."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = path or vocabulary()
    small_batches(df.sparkSession)
    whole = F.concat_ws(separator, *[F.col(f) for f in fields])
    rows = df.select(F.col(key), whole.alias("_text"))
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, n_tokens long, n_sections long, n_crossing long, section_starts array<long>, section_tokens array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            at = 0
            for texts in steps(batch.column("_text").to_pylist()):
                keys = batch.column(key).slice(at, len(texts))
                at += len(texts)
                counts, crossed, cuts, total = [], [], [], []
                for text, ids in zip(texts, own.encode(texts), strict=True):
                    starts, ends, _ = own.spans(text.encode(), ids)
                    sections = line_starts(text)
                    got, over = allocate(starts, ends, sections, rule)
                    counts.append(got), crossed.append(over), cuts.append(sections), total.append(len(ids))
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array(total, pa.int64()), pa.array([len(c) for c in cuts], pa.int64()), pa.array(crossed, pa.int64()), pa.array(cuts, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int64()))],
                    names=[key, "n_tokens", "n_sections", "n_crossing", "section_starts", "section_tokens"],
                )

    return rows.mapInArrow(run, schema)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
