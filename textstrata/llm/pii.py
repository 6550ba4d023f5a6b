"""Operator 8, personal data by weak supervision [native].

Base spans come from four exact patterns with their checks (part sizes, digit
counts, Luhn) and always stay. Wider patterns propose more candidates. Every
candidate is judged by labelers that vote 1, -1 or 0 (abstain):

* ``strict``: the base pattern with its check (-1: pattern without check);
* ``gazetteer``: top-level domains, area and country codes, issuer prefixes, routable first parts;
* ``context``: cue words in the 40 characters before;
* ``edge``: no letter or digit touches the span.

Candidates are counted per kind, vote pattern and shape (length, separators,
repeated digits, words around, all in a few classes) over all documents: at most 4 * 81 * 144
rows reach the driver. Expectation-maximisation estimates each labeler's
reliability and the candidates' posteriors from the votes; a logistic span
classifier is trained on the posteriors, from votes and shape. It scores
candidates as a plain expression; those at ``ACCEPT`` or more that overlap no
base span are added.

The texts are read once: spans and votes are written to the shared folder.

Defined results: null text is the empty text and has no spans; offsets are code
points, end exclusive; repeated rows give repeated results; an empty table gives
an empty result and a classifier from the priors alone; other columns are
carried through, the added ones win a clash.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound, running, stage

KINDS = ("email", "ip", "card", "phone")
ACCEPT = 0.9
LABELERS = ("strict", "gazetteer", "context", "edge")
#: What the span classifier sees besides the votes, and the number of its classes: the match's length (by eights), its
#: separators (none, one kind, more kinds), whether a digit comes four times in a row, whether a letter stands before it and whether a line begins there.
SHAPES = {"size": 6, "marks": 3, "same": 2, "worded": 2, "leads": 2}

#: The base patterns, made linear: a match can only begin where a run begins or the last match ended, and runs are possessive.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Wider forms of the same kinds.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[\[({<]\x20?(?:at|AT|@)\x20?[\])}>]\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:[\[({<]\x20?(?:dot|DOT)\x20?[\])}>]|\.)\x20?[A-Za-z0-9-]{1,63}+)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "phone": r"(?<![0-9+.()-])(?<![0-9+]\x20)(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])(?![\x20.-][0-9])",
}
#: What a text must hold for a pattern to be tried at all.
NEEDS = {"email": "@", "phone": "+"}

#: Gazetteers.
TOP_DOMAINS = "com org net edu gov mil int info biz io co me de fr es uk us eu ch at it nl be pl pt se no dk fi ie ca au nz jp cn in br mx ar cl ru test example".split()
COUNTRY_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 351 352 353 358 420 421".split()
ISSUERS = "34 37 4 51 52 53 54 55 6011 65 22 23 24 25 26 27 30 36 38 35".split()
CUES = {
    "email": "mail|contact|write to|kontakt|contacter|correo|courriel",
    "ip": r"\bip\b|address|host|server|adresse|direcci|login from",
    "card": r"card|visa|mastercard|amex|credit|karte|carte|tarjeta|payment",
    "phone": r"phone|call|tel\b|tel\.|telefon|mobile|cell|fax|whatsapp|llam|appel|anruf",
}


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def value(i: Column) -> Column:
        d = F.substr(digits, -i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(x, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.right(p, F.lit(3)).cast("int") <= 255))
    if kind == "card":
        return F.when(F.length(_digits(x)).between(14, 19), _luhn(_digits(x))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(x)).between(10, 15)
    return F.lit(True)


def _gazetteer(kind: str, x: Column) -> Column:
    yes = lambda c, other=-1: F.when(c, 1).otherwise(other)
    if kind == "email":
        return yes(F.lower(F.regexp_extract(x, "([A-Za-z0-9-]+)$", 1)).isin(TOP_DOMAINS))
    if kind == "ip":
        first = F.regexp_extract(x, "^0*([0-9]{1,3})[.]", 1).try_cast("int")
        return F.coalesce(F.when(first.between(1, 223), 1).when(first.isNotNull(), -1), F.lit(0))
    if kind == "card":
        return yes(_digits(x).rlike("^(" + "|".join(ISSUERS) + ")"))
    plus = x.startswith("+")
    return F.when(plus, yes(_digits(x).rlike("^(" + "|".join(COUNTRY_CODES) + ")"))).otherwise(yes(_digits(x).rlike("^[2-9](?!11)[0-9]{2}[2-9]")))


def _matches(text: Column, kind: str, pattern: str, wide: bool) -> Column:
    """Array of structs (start, k, stop, base, votes...) of the non-overlapping matches, leftmost first."""
    k = KINDS.index(kind)
    kind_of = "array<struct<start:int,k:int,stop:int,base:boolean,strict:int,gazetteer:int,context:int,edge:int,size:int,marks:int,same:int,worded:int,leads:int>>"

    def found(text: Column) -> Column:
        hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

        def spans(hits: Column, parts: Column) -> Column:
            ends = running(F.zip_with(F.slice(parts, F.lit(1), F.size(hits)), hits, lambda p, x: F.length(p) + F.length(x)), lambda a, v: a + v)
            return bound(ends, lambda ends: F.transform(hits, lambda x, i: one(F.get(parts, i), x, F.get(ends, i + 1))))

        def one(p: Column, x: Column, stop: Column) -> Column:
            ok = F.lit(False) if wide else _valid(kind, x)
            before = F.right(p, F.lit(40))
            touching = F.right(p, F.lit(1)).rlike(r"[\p{L}\p{N}]")
            marks = F.size(F.array_distinct(F.split(F.regexp_replace(x, r"[^\x20().:@-]", ""), "")))
            return F.struct(
                (stop - F.length(x)).alias("start"), F.lit(k).alias("k"), stop.alias("stop"), ok.alias("base"),
                (F.lit(0) if wide else F.when(ok, 1).otherwise(-1)).alias("strict"), _gazetteer(kind, x).alias("gazetteer"),
                F.when(F.lower(before).rlike(CUES[kind]), 1).otherwise(0).alias("context"), F.when(touching, -1).otherwise(1).alias("edge"),
                F.least(F.floor(F.length(x) / 8), F.lit(SHAPES["size"] - 1)).cast("int").alias("size"),
                F.when(F.length(F.regexp_replace(x, r"[^\x20().:@-]", "")) == 0, 0).when(marks == 1, 1).otherwise(2).alias("marks"),
                x.rlike(r"([0-9])\1\1\1").cast("int").alias("same"), before.rlike(r"\p{L}[^\p{L}]{0,3}$").cast("int").alias("worded"),
                ((F.length(p) == 0) | F.right(p, F.lit(1)).isin("\n", "\t", "|")).cast("int").alias("leads"),
            )

        return bound(hits, lambda h: F.when(F.size(h) > 0, bound(F.split(text, pattern, -1), lambda p: spans(h, p))).otherwise(F.array().cast(kind_of)))

    need = None if wide else NEEDS.get(kind)
    return F.when(F.contains(text, F.lit(need)), found(text)).otherwise(F.array().cast(kind_of)) if need else found(text)


def candidates(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``found``: every base match and wide candidate with its votes, sorted by start, then kind."""
    t = F.coalesce(F.col(text), F.lit(""))
    parts = [_matches(t, k, p, False) for k, p in BASE.items()] + [_matches(t, k, p, True) for k, p in WIDE.items()]
    return df.withColumn("found", F.array_sort(F.concat(*parts)))


#: Pseudo-counts of votes (-1, 0, 1) before any data: for non-spans, for spans.
PRIOR = {
    "strict": ((8.0, 8.0, 0.5), (0.5, 4.0, 12.0)),
    "gazetteer": ((8.0, 6.0, 4.0), (1.0, 3.0, 12.0)),
    "context": ((1.0, 18.0, 1.0), (0.1, 10.0, 8.0)),
    "edge": ((8.0, 1.0, 8.0), (1.0, 1.0, 16.0)),
}


def expectation_maximisation(patterns: list[tuple[tuple[int, ...], float]], rounds: int = 30) -> tuple[float, dict, list[float]]:
    """Binary latent-class model over vote patterns with counts: prior of a span, P(vote | class), and posteriors in order."""
    prior, theta = 0.5, {name: tuple(tuple(c / sum(row) for c in row) for row in PRIOR[name]) for name in LABELERS}
    post: list[float] = []
    for _ in range(rounds):
        post = []
        for votes, _n in patterns:
            logs = [math.log(1 - prior), math.log(prior)]
            for name, v in zip(LABELERS, votes, strict=True):
                for y in (0, 1):
                    logs[y] += math.log(theta[name][y][v + 1])
            post.append(1 / (1 + math.exp(max(-500.0, min(500.0, logs[0] - logs[1])))))
        total = sum(n for _, n in patterns)
        prior = (5 + sum(n * p for (_, n), p in zip(patterns, post, strict=True))) / (10 + total)
        counts = {name: [list(row) for row in PRIOR[name]] for name in LABELERS}
        for (votes, n), p in zip(patterns, post, strict=True):
            for name, v in zip(LABELERS, votes, strict=True):
                counts[name][0][v + 1] += n * (1 - p)
                counts[name][1][v + 1] += n * p
        theta = {name: tuple(tuple(c / sum(row) for c in row) for row in rows) for name, rows in counts.items()}
    return prior, theta, post


def _row(votes: tuple[int, ...], shape: tuple[int, ...]) -> list[float]:
    """A candidate as the classifier sees it: a bias, each labeler's votes for and against, each class of its shape."""
    return [1.0, *[float(v == s) for v in votes for s in (1, -1)], *[float(c == k) for c, n in zip(shape, SHAPES.values(), strict=True) for k in range(n)]]


def span_classifier(rows: list[tuple[tuple[int, ...], tuple[int, ...], float]], posteriors: dict[tuple[int, ...], float], steps: int = 400, l2: float = 0.01) -> list[float]:
    """Logistic regression on votes and shapes with counts, fitted to the posteriors of the votes; rows weigh log(1 + count)."""
    x = np.array([_row(votes, shape) for votes, shape, _ in rows])
    target, weight = np.array([posteriors[votes] for votes, _, _ in rows]), np.log1p([n for _, _, n in rows])
    weight /= weight.sum()
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        w -= l2 * w + x.T @ (weight * (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - target))
    return w.tolist()


def fit(found: DataFrame) -> dict[int, list[float]]:
    """Weights per kind from the candidates of all documents: one aggregation to votes and shapes, whose number is bounded."""
    counted = found.select(F.explode("found").alias("c")).groupBy("c.k", *[f"c.{n}" for n in (*LABELERS, *SHAPES)]).count().collect()
    model = {}
    for k in range(len(KINDS)):
        # Each pattern of strict and gazetteer votes is there at least as a trace, so that the classifier is defined everywhere.
        traces = {((s, g, c, e), (2, 1, 0, 1, 0)): 0.01 for s in (-1, 0, 1) for g in (-1, 0, 1) for c in (0, 1) for e in (-1, 1)}
        own = traces | {(tuple(r[n] for n in LABELERS), tuple(r[n] for n in SHAPES)): float(r["count"]) for r in counted if r["k"] == k}
        by_votes: dict[tuple[int, ...], float] = {}
        for (votes, _), n in sorted(own.items()):
            by_votes[votes] = by_votes.get(votes, 0.0) + n
        patterns = sorted(by_votes.items())
        _, _, post = expectation_maximisation(patterns)
        model[k] = span_classifier([(*key, n) for key, n in sorted(own.items())], dict(zip([v for v, _ in patterns], post, strict=True)))
    return model


def _score(c: Column, weights: list[float]) -> Column:
    z, at = F.lit(weights[0]), 1
    for name in LABELERS:
        z = z + F.when(c[name] == 1, weights[at]).when(c[name] == -1, weights[at + 1]).otherwise(0.0)
        at += 2
    for name, n in SHAPES.items():
        z = z + F.element_at(F.array(*map(F.lit, weights[at : at + n])), c[name] + 1)
        at += n
    return 1 / (1 + F.exp(-z))


def detect(df: DataFrame, text: str = "text", accept: float = ACCEPT, keep_text: bool = True) -> DataFrame:
    """Adds base and spans: arrays of struct (start, k, stop), sorted by start, then kind; k indexes KINDS. Without ``keep_text`` the text isn't stored or returned."""
    told = candidates(df, text)
    found = stage(told if keep_text else told.drop(text), "pii")
    model = fit(found)

    def score(c: Column) -> Column:
        out = F.lit(0.0)
        for k, w in model.items():
            out = F.when(c["k"] == k, _score(c, w)).otherwise(out)
        return out

    plain = lambda c: F.struct(c["start"].alias("start"), c["k"].alias("k"), c["stop"].alias("stop"))
    out = found.withColumn("base", F.transform(F.filter("found", lambda c: c["base"]), plain))
    # found is sorted by start: a candidate overlaps a base span if one before it stops after its start, or the next one starts before its end
    far = 2**31 - 1
    behind = running(F.transform("found", lambda c: F.when(c["base"], c["stop"]).otherwise(0)), F.greatest)
    ahead = running(F.reverse(F.transform("found", lambda c: F.when(c["base"], c["start"]).otherwise(far))), F.least, far)

    def more(behind: Column, ahead: Column) -> Column:
        free = lambda c, i: ~c["base"] & (F.get(behind, i) <= c["start"]) & (F.get(ahead, F.size("found") - 1 - i) >= c["stop"]) & (score(c) >= accept)
        return F.transform(F.filter("found", free), plain)

    added = bound(behind, lambda x: bound(ahead, lambda y: more(x, y)))
    return out.withColumn("spans", F.when(F.forall("found", lambda c: c["base"]), F.col("base")).otherwise(F.array_sort(F.concat("base", added)))).drop("found")


#: Code points of a block of text that pieces are cut from.
TEXT_BLOCK = 1024


def _piece(blocks: Column, a: Column, b: Column) -> Column:
    """The code points a to b of a text in blocks."""
    i, j = F.floor(a / TEXT_BLOCK).cast("int"), F.floor(b / TEXT_BLOCK).cast("int")
    first = F.coalesce(F.get(blocks, i), F.lit(""))
    inside = F.substr(first, a - i * TEXT_BLOCK + 1, b - a)
    across = F.concat(F.substr(first, a - i * TEXT_BLOCK + 1, F.lit(TEXT_BLOCK)), F.array_join(F.slice(blocks, i + 2, j - i - 1), ""), F.substr(F.coalesce(F.get(blocks, j), F.lit("")), F.lit(1), b - j * TEXT_BLOCK))
    return F.when(i == j, inside).otherwise(across)


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """``detect`` with the text's spans replaced by [KIND]; overlapping spans are replaced as one, under the first one's kind."""
    kept = df.columns
    found = detect(df, text)
    tags = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    # a span that starts before an earlier one ends belongs to the same replacement
    def clean(reach: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(0), F.size("spans") - 1), lambda i: F.get(F.col("spans"), i)["start"] >= F.get(reach, i))

        def cut(heads: Column, blocks: Column) -> Column:
            def replaced(i: Column, at: Column) -> Column:
                s = F.get(F.col("spans"), i)
                return F.concat(_piece(blocks, F.get(reach, i), s["start"]), F.get(tags, s["k"]))

            rest = _piece(blocks, F.element_at(reach, -1), F.length(text))
            return F.concat(F.array_join(F.transform(heads, replaced), ""), rest)

        return bound(heads, lambda h: bound(F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{TEXT_BLOCK}}}"), F.lit(0)), lambda b: cut(h, b)))

    out = F.when(F.size("spans") > 0, bound(running(F.transform("spans", lambda s: s["stop"]), F.greatest), clean)).otherwise(F.col(text))
    return found.withColumn(text, out).select(*kept)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), keep_text=False)
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.get(F.array(*map(F.lit, KINDS)), s["k"]), s["start"], s["stop"])), ",")
    number = lambda k: F.size(F.filter("base", lambda s: s["k"] == k)).cast("long")
    counts = [number(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
