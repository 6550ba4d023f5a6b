"""Operator 6, toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of a fixed and of a learned lexicon, hits
near a second person, capitals, punctuation, and obfuscation (letters mixed
with digits or signs, spelled-out and stretched words). The trees are fitted
here, in numpy, to logistic loss; an isotonic step turns their margin into a
probability.

Labels are learned only from rows outside the held-out fold, from a bounded
sample chosen by a hash of doc_id: about ``TRAIN_ROWS`` rows of either label,
weighted back to the labels' real shares. Nothing is learned and judged on the
same rows: each of the four learning folds gets its lexicon features from a
lexicon of the other three, and its margins, which fit the calibration, from
trees of the other three. The lexicon and trees that score are then fitted on
all of them. labels, lang, source and doc_id are never inputs of a score.

Defined results: null text scores as the empty text; rows with null labels
teach nothing, repeated labels of a document count once (the highest),
and of repeated documents the least text teaches;
repeated rows get equal scores; without labels of both kinds the score is the
share of label 1 (0 if there is none); an empty table gives an empty result;
other columns are carried through, the added ones win a clash.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import FOLDS, fold_col, fold_of, slices_of, small_batches

#: Bounds of the fit.
TRAIN_ROWS, TREES, DEPTH, BINS, RATE = 3000, 60, 3, 32, 0.2
#: A learned word, or head of words of so many letters, is in at least so many label-1 documents, at so large a log-odds ratio.
HEADS, WORD_DOCS, WORD_ODDS = (4, 5, 6), 5, 2.5

#: Plain insults, in four languages.
LEXICON = frozenset(
    """arsehole ass asshole bastard bitch bullshit clown coward creep crap cretin cunt damn degenerate disgusting douche dumb dumbass fool freak
    fuck fucking garbage idiot idiotic idiots imbecile jackass jerk liar loser losers lowlife maggot moron morons moronic nazi pathetic pig prick
    rat retard retarded scum scumbag shit shut slut stupid subhuman sucker trash ugly useless vermin vile whore worthless
    arschloch dreck dumm dummkopf idioten mistkerl schlampe schwachkopf trottel versager wichser widerlich
    abruti connard connasse cretin debile degoutant idiote imbecile merde minable ordure pute salaud salope stupide
    asco basura cabron cerdo escoria estupido gilipollas imbecil inutil mierda patetico perdedor puta puto tonto""".split()
)
#: Second persons.
SECOND = frozenset("you your yours yourself ya u du dich dir dein deine ihr euch tu toi te ton ta tes vous votre vos ti tus usted ustedes vosotros vos".split())
#: Signs that stand for letters.
SIGNS = str.maketrans({"4": "a", "@": "a", "3": "e", "1": "i", "!": "i", "0": "o", "5": "s", "$": "s", "7": "t", "8": "b", "*": None, ".": None, "-": None, "_": None, "​": None, "‌": None, "‍": None})

WORD = re.compile(r"[^\W\d_]+")
#: A run of signs that begins with letters, or none, and then has a digit or sign.
MIXED = re.compile(r"(?<!\S)[^\w\s@$*]*+[^\W\d_]*+[0-9@$!*_\u200b-\u200d]\S*")
SPELLED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ .\-_*]){3,}[^\W\d_](?![^\W_])")
STRETCHED = re.compile(r"([^\W\d_])\1\1")
NAMES = ("lexicon", "lexicon_log", "learned", "learned_max", "learned_kinds", "near_second", "second", "capitals", "shouted", "exclaims", "questions", "piled", "mixed", "hidden", "stretched", "log_words", "word_length")


def _squeeze(word: str) -> str:
    return re.sub(r"(.)\1+", r"\1", word)


def units(word: str) -> list[str]:
    """What a word is looked up by: itself, and its heads, marked by a star."""
    return [word, *[word[:k] + "*" for k in HEADS if len(word) > k]]


class Features:
    """Dense features, given the learned lexicon (word or head to log-odds)."""

    def __init__(self, learned: dict[str, float]):
        self.learned = learned
        self.all = LEXICON | learned.keys()
        self.squeezed = {_squeeze(w) for w in self.all if len(w) > 3}
        self.starred = {w[:i] + "*" + w[i + 1 :] for w in self.all if len(w) > 3 and "*" not in w for i in range(len(w))}

    def row(self, text: str | None) -> list[float]:
        text = text or ""
        low = text.lower()
        words = WORD.findall(low)
        n = max(1, len(words))
        counts = Counter(words)
        told = {w: max(found) for w in counts if (found := [known[u] for u in units(w) if u in known])} if (known := self.learned) else {}
        hits = (counts.keys() & LEXICON) | told.keys()
        fixed = sum(counts[w] for w in hits if w in LEXICON)
        odds = list(told.values())
        learned = sum(v * counts[w] for w, v in told.items())
        second = sum(counts[w] for w in SECOND & counts.keys())
        near = 0
        if hits and second:
            at, found = (np.array([i for i, w in enumerate(words) if w in kind]) for kind in (SECOND, hits))
            near = int((np.searchsorted(at, found + 3, "right") > np.searchsorted(at, found - 3)).sum())
        mixed = [m for m in (m.strip(_EDGES) for m in MIXED.findall(low)) if not m.isalpha() and any(map(str.isalpha, m))]
        hidden = sum(m in self.starred or any(w in self.all for w in WORD.findall(m.translate(SIGNS))) for m in mixed)
        hidden += sum(re.sub(r"[ .\-_*]", "", m) in self.all for m in SPELLED.findall(low))
        stretched = [w for w in counts if STRETCHED.search(w)] if STRETCHED.search(low) else []
        hidden += sum(counts[w] for w in stretched if _squeeze(w) in self.squeezed)
        letters = sum(map(len, words))
        capitals = sum(map(str.isupper, text)) if not text.isascii() else len(text) - len(text.translate(_NO_CAPITALS))
        shouted = len(re.findall(r"\b[A-Z]{3,}\b", text)) if capitals > 2 else 0
        return [
            fixed / n, math.log1p(fixed), learned / n, max(odds, default=0.0), float(len(odds)), near / n, second / n, capitals / max(1, letters), shouted / n,
            text.count("!") / n, text.count("?") / n, (low.count("!!") + low.count("??")) / n, len(mixed) / n, math.log1p(hidden), sum(counts[w] for w in stretched) / n, math.log1p(len(words)), letters / n,
        ]

    def matrix(self, texts: list[str | None]) -> np.ndarray:
        return np.array([self.row(t) for t in texts], np.float64).reshape(len(texts), len(NAMES))


#: Signs at the ends of a run that hide nothing.
_EDGES = "!?.,;:()[]{}\"'*_-%&#"
_NO_CAPITALS = str.maketrans("", "", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def learn_words(texts: list[str], y: np.ndarray) -> dict[str, float]:
    """Words and heads whose document frequency tells the labels apart, with their log-odds ratios."""
    have: tuple[Counter, Counter] = (Counter(), Counter())
    for text, label in zip(texts, y, strict=True):
        have[int(label)].update({u for w in set(WORD.findall(text.lower())) for u in units(w)})
    n0, n1 = (y == 0).sum(), (y == 1).sum()
    out = {}
    for w, a in have[1].items():
        odds = math.log((a + 0.5) / (n1 - a + 0.5)) - math.log((have[0][w] + 0.5) / (n0 - have[0][w] + 0.5))
        if a >= WORD_DOCS and odds >= WORD_ODDS:
            out[w] = odds
    return out


class Boosted:
    """Gradient-boosted trees of fixed depth over binned features; a tree is a complete array of splits and leaves."""

    def __init__(self, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE):
        self.trees, self.depth, self.bins, self.rate = trees, depth, bins, rate
        self.base, self.model, self.edges = 0.0, [], []

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], axis=1) if len(x) else np.zeros((0, len(self.edges)), int)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(c[c != 0], np.linspace(0, 1, self.bins - 1)) if (c != 0).any() else np.zeros(0)) for c in x.T]
        b = self._binned(x)
        share = float((weight * y).sum() / weight.sum()) if len(y) else 0.5
        self.base = math.log(max(share, 1e-6) / max(1 - share, 1e-6))
        margin = np.full(len(x), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = weight * (p - y), np.maximum(weight * p * (1 - p), 1e-9)
            tree, node = {}, np.zeros(len(x), int)
            for level in range(self.depth):
                for k in range(2**level - 1, 2 ** (level + 1) - 1):
                    mine = np.flatnonzero(node == k)
                    split = self._split(b[mine], g[mine], h[mine]) if len(mine) > 1 else None
                    if split:
                        tree[k] = split
                        node[mine] = 2 * k + 1 + (b[mine, split[0]] > split[1])
            leaf = {k: -self.rate * g[node == k].sum() / (h[node == k].sum() + 1.0) for k in np.unique(node)}
            self.model.append((tree, {int(k): float(v) for k, v in leaf.items()}))
            margin += np.array([leaf[k] for k in node])
        return self

    def _split(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, int] | None:
        best, found = 1e-3, None
        total_g, total_h = g.sum(), h.sum()
        for j in range(b.shape[1]):
            gs, hs = np.bincount(b[:, j], g, self.bins + 1).cumsum()[:-1], np.bincount(b[:, j], h, self.bins + 1).cumsum()[:-1]
            gain = gs**2 / (hs + 1) + (total_g - gs) ** 2 / (total_h - hs + 1) - total_g**2 / (total_h + 1)
            k = int(gain.argmax())
            if gain[k] > best:
                best, found = float(gain[k]), (j, k)
        return found

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, out = self._binned(x), np.full(len(x), self.base)
        for tree, leaf in self.model:
            node = np.zeros(len(x), int)
            for level in range(self.depth):
                for k in range(2**level - 1, 2 ** (level + 1) - 1):
                    if k in tree:
                        mine = node == k
                        node[mine] = 2 * k + 1 + (b[mine, tree[k][0]] > tree[k][1])
            for k, v in leaf.items():
                out[node == k] += v
        return out


def isotonic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators fit; knots for linear interpolation. One row of either label is added at the ends, so that scores stay inside 0 to 1."""
    order = np.argsort(margin, kind="stable")
    spread = 1.0 + float(np.ptp(margin)) * 0.01 if len(margin) else 1.0
    low, high = (float(margin.min()), float(margin.max())) if len(margin) else (0.0, 0.0)
    rows = [(low - spread, 0.0, 0.5), *((float(margin[i]), float(y[i]), float(weight[i])) for i in order), (high + spread, 1.0, 0.5)]
    blocks: list[list[float]] = []
    for m, v, w in rows:
        blocks.append([m * w, v * w, w])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


class Model:
    """Features, trees and calibration; ``share`` alone if there was nothing to learn from."""

    def __init__(self, rows: list[tuple[int, str | None, int]], shares: tuple[float, float]):
        total = sum(shares)
        self.share, self.trees = (shares[1] / total if total else 0.0), None
        y_all = np.array([y for _, _, y in rows], float)
        if not (y_all == 0).any() or not (y_all == 1).any():
            return
        texts = [t or "" for _, t, _ in rows]
        fold = np.array([fold_of(d) for d, _, _ in rows])
        weight = np.where(y_all == 1, shares[1] / max(1, (y_all == 1).sum()), shares[0] / max(1, (y_all == 0).sum()))
        weight = weight / weight.mean()
        x, margin = np.zeros((len(rows), len(NAMES))), np.zeros(len(rows))
        for own, rest in ((np.flatnonzero(fold == f), np.flatnonzero(fold != f)) for f in range(1, FOLDS)):
            x[own] = Features(learn_words([texts[i] for i in rest], y_all[rest])).matrix([texts[i] for i in own])
        for own, rest in ((np.flatnonzero(fold == f), np.flatnonzero(fold != f)) for f in range(1, FOLDS)):
            margin[own] = Boosted().fit(x[rest], y_all[rest], weight[rest]).margin(x[own])
        self.features = Features(learn_words(texts, y_all))
        self.trees = Boosted().fit(x, y_all, weight)
        self.knots = isotonic(margin, y_all, weight)

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.share)
        return np.clip(np.interp(self.trees.margin(self.features.matrix(texts)), *self.knots), 0.0, 1.0)


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> tuple[list[tuple[int, str | None, int]], tuple[float, float]]:
    """Sampled (doc_id, text, label) rows, about ``most`` of either label, and the labels' real numbers."""
    usable = labels.select("doc_id", "toxic").filter((fold_col() != 0) & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    share = F.lit(0)
    for label, n in counts.items():
        share = F.when(F.col("toxic") == label, F.lit(min(1_000_000, -(-1_000_000 * most // n)))).otherwise(share)
    chosen = usable.filter(F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(1_000_000)) < share)
    # about 2 * most rows: each document of the labels once, as equal rows are one
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    rows = sorted({(r["doc_id"], r["text"] or "", int(r["toxic"])) for r in found})
    return rows, (float(counts.get(0, 0)), float(counts.get(1, 0)))


def rate(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds score and predicted to every row."""
    small_batches(df.sparkSession)
    kept = [f for f in df.schema.fields if f.name.lower() not in {"score", "predicted"}]
    schema = T.StructType([*kept, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices_of(batches, text, 1 << 22):
            score = model.score(rows.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([*[rows.column(f.name) for f in kept], pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32), pa.int32())], names=[f.name for f in schema.fields])

    return df.mapInArrow(run, schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = Model(*training_rows(docs, labels))
    return rate(docs.select("doc_id", "text"), model).select("doc_id", (fold_col() == 0).alias("held_out"), "score", "predicted")
