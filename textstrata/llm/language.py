"""Operator 5, language ID by a bidirectional gated recurrent network over bytes.

The network reads bytes in both directions, across words and lines, and gives
every position a distribution over the learned languages and one class more,
``no language``. It is trained in numpy by backpropagation through time, with
the document's language as the label of each of its positions; what stands for
``no language`` is made up: random letters, characters of other scripts, and
training texts with their characters in random order.

Texts are read as their letters (and the marks on them), with one blank for
whatever stands between: signs, digits and emoji are neither read nor pooled,
so that quotes, bullets or dashes do not make a text look like no language.
A text is read whole, in windows of ``WINDOW`` bytes. Each direction starts
``CONTEXT`` bytes outside its window, so that the window's positions are read
with their surroundings (blanks beyond the text's ends). A document's
probabilities are the means of its letters' probabilities: the score is the
mean probability of its best language, whatever the text's length, and is low
for text in no learned language.

The network is fitted on a bounded sample of labelled rows: about
``TRAIN_DOCS`` documents a language, chosen by a hash of doc_id and text, of
those outside the held-out fold. lang, source and doc_id are never inputs.

Defined results: null text, and text without any letter, is ``und`` with score
0; repeated rows give repeated results; ties go to the language that sorts
first; an empty table, or one without labels, gives ``und``; other columns are
carried through, the added ones win a clash.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold_col, slices_of, small_batches
from .shingles import text_buffers

#: Bounds of the fit: documents a language (expected), hidden units a direction, steps, windows a step, bytes a window.
TRAIN_DOCS, HIDDEN, STEPS, BATCH, TRAIN_WINDOW = 250, 12, 450, 96, 64
#: Bytes of a window, bytes read around it, windows read at once.
WINDOW, CONTEXT, TOGETHER = 256, 16, 512
UNKNOWN = "und"
#: A-Z count as a-z; positions that are pooled: ASCII letters and all bytes of other letters (``letters_only`` leaves no other characters).
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
LETTER = np.zeros(256, bool)
LETTER[97:123] = LETTER[65:91] = LETTER[128:] = True
BLANK = 32
#: First and last letters of other scripts, for made-up text in no learned language.
SCRIPTS = ((0x0391, 0x03C9), (0x0410, 0x044F), (0x05D0, 0x05EA), (0x0621, 0x064A), (0x0905, 0x0939), (0x0E01, 0x0E30), (0x3041, 0x30FA), (0x4E00, 0x9FA0), (0xAC00, 0xD7A3))


def _code_points(raw: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """Code points of the characters of two bytes or more that begin at ``lead``; valid UTF-8 is assumed, as Arrow strings have it."""
    b = np.concatenate([raw, np.zeros(3, np.uint8)]).astype(np.int32)
    first, tail = b[lead], [b[lead + k] & 0x3F for k in (1, 2, 3)]
    two, three = (first & 0x1F) << 6 | tail[0], (first & 0x0F) << 12 | tail[0] << 6 | tail[1]
    return np.where(first < 0xE0, two, np.where(first < 0xF0, three, (first & 0x07) << 18 | tail[0] << 12 | tail[1] << 6 | tail[2]))


def letters_only(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts with A-Z folded and each stretch of other characters than letters and marks as one blank; and whether a row has a letter."""
    kept = LETTER[raw] & (raw < 128)
    letter = kept.copy()
    lead = np.flatnonzero(raw >= 0xC0)
    if len(lead):
        points, which = np.unique(_code_points(raw, lead), return_inverse=True)
        kinds = np.array([unicodedata.category(chr(c))[0] for c in points.tolist()])
        size = np.where(raw[lead] < 0xE0, 2, np.where(raw[lead] < 0xF0, 3, 4))
        letter[lead] = (kinds == "L")[which]
        read = (kinds == "L") | (kinds == "M")
        for k in range(4):
            own = size > k
            kept[lead[own] + k] = read[which][own]
    row_starts = np.zeros(len(raw) + 1, bool)
    row_starts[offsets] = True
    # the first of a stretch of others stays, as a blank
    before = np.concatenate([[True], kept[:-1]]) | row_starts[:-1]
    stays = kept | before
    ahead = np.concatenate([[0], np.cumsum(stays)])
    seen = np.concatenate([[0], np.cumsum(letter)])[offsets]
    return np.where(kept, FOLD[raw], np.uint8(BLANK))[stays], ahead[offsets], np.diff(seen) > 0


def _letters_of(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return letters_only(raw, np.array([0, len(raw)]))[0]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class ByteGru:
    """Bidirectional GRU over bytes with a softmax layer at every position; its last class is no language."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels, self.hidden = labels, hidden
        draw = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
        # in: gate inputs for each byte and direction; rec: recurrent weights of reset, update and candidate
        self.p = {
            "in": draw(512, 3 * hidden), "rec": draw(2, hidden, 3 * hidden), "nb": np.zeros((2, 1, hidden), np.float32),
            "out": draw(2, hidden, len(labels) + 1), "bias": np.zeros(len(labels) + 1, np.float32),
        }

    def _states(self, x: np.ndarray, keep: bool = False):
        """States of both directions at every position (time, direction, row, unit), the second direction in its own time."""
        h3, p = self.hidden, self.p
        seq = np.stack((x.T, x.T[::-1]), axis=1).astype(np.intp)
        seq[:, 1] += 256
        h = np.zeros((2, len(x), h3), p["rec"].dtype)
        states, saved = np.empty((x.shape[1], *h.shape), h.dtype), []
        for t in range(x.shape[1]):
            gx, gh = p["in"][seq[t]], h @ p["rec"]
            gates = _sigmoid(gx[..., : 2 * h3] + gh[..., : 2 * h3])
            r, z = gates[..., :h3], gates[..., h3:]
            u = gh[..., 2 * h3 :] + p["nb"]
            c = np.tanh(gx[..., 2 * h3 :] + r * u)
            if keep:
                saved.append((h, r, z, u, c))
            h = c + z * (h - c)
            states[t] = h
        return states, seq, saved

    def _probabilities(self, f: np.ndarray, b: np.ndarray) -> np.ndarray:
        z = f @ self.p["out"][0] + b @ self.p["out"][1] + self.p["bias"]
        z -= z.max(axis=-1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(axis=-1, keepdims=True)
        return z

    def read(self, x: np.ndarray, context: int) -> np.ndarray:
        """Probabilities (position, class, row) of the positions that are ``context`` or more away from both ends.

        The recurrence of ``_states`` with units first and in place, which is faster; the second direction is turned back to the text's order.
        """
        h3, p, n = self.hidden, self.p, x.shape[1]
        enter = np.ascontiguousarray(p["in"].reshape(2, 256, 3 * h3).transpose(0, 2, 1))
        rec, nb = np.ascontiguousarray(p["rec"].transpose(0, 2, 1)), p["nb"].transpose(0, 2, 1)
        seq = np.ascontiguousarray(x.T).astype(np.intp)
        h, gx, gh = (np.zeros((2, k, len(x)), np.float32) for k in (h3, 3 * h3, 3 * h3))
        states = np.empty((2, n - 2 * context, h3, len(x)), np.float32)
        for t in range(n - context):
            np.take(enter[0], seq[t], axis=1, out=gx[0], mode="clip")
            np.take(enter[1], seq[n - 1 - t], axis=1, out=gx[1], mode="clip")
            np.matmul(rec, h, out=gh)
            gates, c = gx[:, : 2 * h3], gh[:, 2 * h3 :]
            gates += gh[:, : 2 * h3]
            np.negative(gates, out=gates)
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            c += nb
            c *= gates[:, :h3]
            c += gx[:, 2 * h3 :]
            np.tanh(c, out=c)
            h -= c
            h *= gates[:, h3:]
            h += c
            if t >= context:
                states[:, t - context] = h
        z = p["out"][0].T @ states[0]
        z += p["out"][1].T @ states[1, ::-1]
        z += p["bias"][:, None]
        z -= z.max(axis=1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(axis=1, keepdims=True)
        return z

    def step(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss over the positions in ``mask`` and gradients of a batch by backpropagation through time."""
        states, seq, saved = self._states(x, keep=True)
        f, b = states[:, 0], states[::-1, 1]
        err = self._probabilities(f, b)
        weight = (mask.T / max(1, mask.sum())).astype(err.dtype)
        rows = np.arange(len(x))
        loss = float(-(np.log(err[:, rows, y] + 1e-9) * weight).sum())
        err[:, rows, y] -= 1
        err *= weight[:, :, None]
        flat = err.reshape(-1, err.shape[2])
        grad = {"out": np.stack([s.reshape(-1, self.hidden).T @ flat for s in (f, b)]), "bias": flat.sum(axis=0)}
        up = np.stack((err @ self.p["out"][0].T, (err @ self.p["out"][1].T)[::-1]), axis=1)
        g_rec, g_nb = np.zeros_like(self.p["rec"]), np.zeros_like(self.p["nb"])
        g_x = np.empty((*seq.shape, 3 * self.hidden), err.dtype)
        dh = np.zeros_like(states[0])
        back = self.p["rec"].transpose(0, 2, 1)
        for t in range(len(seq) - 1, -1, -1):
            h, r, z, u, c = saved[t]
            dh = dh + up[t]
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (h - c) * z * (1 - z)
            dr = dc * u * r * (1 - r)
            du = dc * r
            g_x[t] = np.concatenate((dr, dz, dc), axis=2)
            g_h = np.concatenate((dr, dz, du), axis=2)
            g_rec += h.transpose(0, 2, 1) @ g_h
            g_nb += du.sum(axis=1, keepdims=True)
            dh = dh * z + g_h @ back
        at = seq.ravel()
        order = np.argsort(at, kind="stable")
        kinds, first = np.unique(at[order], return_index=True)
        g_in = np.zeros_like(self.p["in"])
        g_in[kinds] = np.add.reduceat(g_x.reshape(-1, 3 * self.hidden)[order], first, axis=0)
        return loss, grad | {"in": g_in, "rec": g_rec, "nb": g_nb}

    def fit(self, draw, steps: int = STEPS, rate: float = 0.02) -> list[float]:
        """Adam with a falling rate over the batches (x, mask, y) that ``draw`` gives; returns the losses."""
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        losses = []
        for i in range(1, steps + 1):
            loss, grad = self.step(*draw())
            losses.append(loss)
            size = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            lr = rate * (1 - 0.95 * i / steps)
            for k, g in grad.items():
                g = g * min(1.0, 1.0 / (size + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                self.p[k] -= (lr * (first[k] / (1 - 0.9**i)) / (np.sqrt(second[k] / (1 - 0.99**i)) + 1e-7)).astype(np.float32)
        return losses


def training_rows(docs: DataFrame, per_label: int = TRAIN_DOCS) -> list[tuple[str, str]]:
    """About ``per_label`` distinct (text, lang) rows a language, outside the held-out fold, by a hash of doc_id and text."""
    usable = docs.filter((fold_col() != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not counts:
        return []
    share = F.lit(0)
    for lang, n in sorted(counts.items()):
        share = F.when(F.col("lang") == lang, F.lit(min(1_000_000, -(-1_000_000 * per_label // n)))).otherwise(share)
    chosen = usable.filter(F.pmod(F.xxhash64("doc_id", "text", F.lit(5)), F.lit(1_000_000)) < share).select("text", "lang").distinct()
    return [(text, lang) for lang, text in sorted((r["lang"], r["text"]) for r in chosen.collect())]


def _no_language(rng: np.random.Generator, texts: list[str]) -> str:
    """A made-up passage: random letters, another script, or a text's characters in random order."""
    kind = int(rng.integers(0, 3))
    if kind == 2:
        text = texts[int(rng.integers(0, len(texts)))]
        at = int(rng.integers(0, max(1, len(text) - 200)))
        return "".join(rng.permutation(list(text[at : at + 200]))) or " "
    low, high = (97, 122) if kind == 0 else SCRIPTS[int(rng.integers(0, len(SCRIPTS)))]
    words = ["".join(map(chr, rng.integers(low, high + 1, int(n)))) for n in rng.integers(2, 10, 30)]
    return (" " if rng.random() < 0.7 else "").join(words)


def train(rows: list[tuple[str, str]], steps: int = STEPS, batch: int = BATCH, window: int = TRAIN_WINDOW) -> ByteGru | None:
    """A network fitted on windows of the rows' texts, the languages in equal shares; None without rows."""
    labels = sorted({lang for _, lang in rows})
    if not labels:
        return None
    rng = np.random.default_rng(3)
    texts = [text for text, _ in rows]
    made_up = " ".join(_no_language(rng, texts) for _ in range(400))
    joined = ["\n".join(dict.fromkeys(text for text, lang in rows if lang == label)) for label in labels]
    # blanks on both sides: a window may begin before the first text, as in reading; every third window is a short text between blanks
    streams = [np.pad(_letters_of(t), window, constant_values=BLANK) for t in [*joined, made_up]]

    def draw():
        y = rng.integers(0, len(streams), batch)
        starts = [int(rng.integers(0, len(streams[k]) - window + 1)) for k in y]
        x = np.stack([streams[k][s : s + window] for k, s in zip(y, starts, strict=True)])
        short, begin, size = rng.random(batch) < 1 / 3, rng.integers(0, window // 2, batch), rng.integers(4, window // 2 + 1, batch)
        place = np.arange(window)
        x[short[:, None] & ((place < begin[:, None]) | (place >= (begin + size)[:, None]))] = 32
        return x, LETTER[x], y

    model = ByteGru(labels)
    model.fit(draw, steps)
    return model


def document_scores(model: ByteGru, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per row, the mean probability of each class over its letters. Rows are raw[offsets[i]:offsets[i + 1]], as ``letters_only`` gives them."""
    size = np.diff(offsets)
    windows = -(-size // WINDOW)
    row = np.repeat(np.arange(len(size)), windows)
    start = offsets[:-1][row] + WINDOW * (np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows))
    total, letters = np.zeros((len(size), len(model.labels) + 1)), np.zeros(len(size))
    for at in range(0, len(row), TOGETHER):
        r, s = row[at : at + TOGETHER], start[at : at + TOGETHER]
        place = s[:, None] + np.arange(-CONTEXT, WINDOW + CONTEXT)
        inside = (place >= offsets[r][:, None]) & (place < offsets[r + 1][:, None])
        x = np.where(inside, raw[np.clip(place, 0, len(raw) - 1)], np.uint8(BLANK))
        mask = LETTER[x[:, CONTEXT : CONTEXT + WINDOW]].T
        sums = (model.read(x, CONTEXT) * mask[:, None]).sum(axis=0, dtype=np.float64).T
        np.add.at(total, r, sums)
        np.add.at(letters, r, mask.sum(axis=0))
    return total / np.maximum(letters, 1)[:, None]


def predict(model: ByteGru, texts: pa.Array) -> tuple[list[str], list[float]]:
    raw, offsets, seen = letters_only(*text_buffers(texts))
    mean = document_scores(model, raw, offsets)
    known = mean[:, : len(model.labels)]
    best = known.argmax(axis=1)
    return [model.labels[b] if s else UNKNOWN for b, s in zip(best, seen, strict=True)], [float(min(1.0, known[i, b])) if seen[i] else 0.0 for i, b in enumerate(best)]


def identify(df: DataFrame, model: ByteGru | None, text: str = "text") -> DataFrame:
    """Adds lang_pred and score to every row."""
    small_batches(df.sparkSession)
    kept = [f for f in df.schema.fields if f.name.lower() not in {"lang_pred", "score"}]
    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices_of(batches, text):
            names, scores = predict(model, rows.column(text)) if model else ([UNKNOWN] * rows.num_rows, [0.0] * rows.num_rows)
            yield pa.RecordBatch.from_arrays([*[rows.column(f.name) for f in kept], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[f.name for f in schema.fields])

    return df.mapInArrow(run, schema)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(training_rows(docs))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", (fold_col() == 0).alias("held_out"), "lang_pred", "score")
