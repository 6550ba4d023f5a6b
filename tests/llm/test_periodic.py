"""Periodic runs against a slow search over all periods, on documents and on edge rows."""

import hashlib
import itertools
import random
import zlib

import numpy as np
from compare import compare

from textstrata.llm import periodic


def all_runs(w):
    """Every maximal run (start, length, period), by trying each period at each place."""
    found = []
    for q in range(1, len(w) // 4 + 1):
        i = q
        while i < len(w):
            j = i
            while j < len(w) and w[j] == w[j - q]:
                j += 1
            s, n = i - q, j - i + q
            if j > i and n >= max(6, 4 * q) and not any(all(w[x] == w[x - r] for x in range(s + r, s + n)) for r in range(1, q)):
                found.append((s, n, q))
            i = max(i + 1, j)
    return sorted(found, key=lambda r: (r[0], r[2]))


def random_words(r, most):
    w = []
    while len(w) < most:
        w += [r.randrange(r.choice([1, 2, 3, 9])) for _ in range(r.randint(1, 9))] * r.randint(1, 7)
    return w


def test_diagonals_find_every_run():
    r = random.Random(3)
    for _ in range(1500):
        docs = [random_words(r, r.randint(0, 80)) for _ in range(r.randint(1, 4))]
        ids, want = [], []
        for w in docs:
            base, first = len(ids), {}
            ids += [first.setdefault(x, base + k) for k, x in enumerate(w)]
            want += [(s + base, n, q) for s, n, q in all_runs(w)]
        assert [tuple(x) for x in periodic.diagonal_runs(np.array(ids, np.int64), max(map(len, docs))).tolist()] == want


def row_of(doc_id, text):
    w = (text or "").encode().split()
    w = [x.decode() for x in w]
    n = len(w)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = all_runs(w)
    kept = [x for i, x in enumerate(w) if not any(s + q <= i < s + m for s, m, q in runs)]
    best = (None,) * 4
    for s, m, q in runs:
        if best[0] is None or m * best[2] > best[1] * q:
            best = (s, m, q, 1000 * m // q)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *best, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(kept)))


def test_query_by_brute_force(spark, folder):
    r = random.Random(5)
    vocabulary = ["a", "é", "the", "cat dog", "A", "1", "x" * 300, "日本", "-"]
    rows = []
    for i in range(150):
        words = [vocabulary[x] for x in random_words(r, r.randint(0, 120))]
        rows.append((i, "".join(w + r.choice([" ", "\n", "\t\r", "  "]) for w in words)))
    planted = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 10 == 0][:40]
    rows += [(i, " ".join(f"w{r.randrange(9)}" for _ in range(r.randint(0, 60)))) for i in planted]
    rows += [(planted[0], None), (planted[1], ""), (None, "a a a a a a a"), (None, None), (7, "a a a a a a a"), (7, "a a a a a a a"), (8, " \n\t "), (9, "a b " * 5 + "c d e " * 4 + "c")]
    d = folder(documents=([(*x, 1, "s") for x in rows], "doc_id long, text string, key long, runs string"))
    out = periodic.op13_periodic_runs(spark, d)
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = sorted((tuple(x) for x in out.collect()), key=str)
    assert got == sorted((row_of(*x) for x in rows), key=str)
    assert compare(spark, d, "op13", periodic.op13_periodic_runs, periodic.SQL).startswith("ok")
    assert periodic.periodic_runs(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0


def test_long_texts_take_time_in_proportion():
    """A word repeated a million times, and a passage repeated, are no square of anything."""
    same = np.zeros(1_000_000, np.int64)
    assert periodic.diagonal_runs(same, len(same)).tolist() == [[0, 1_000_000, 1]]
    loop = np.tile(np.arange(1000, dtype=np.int64), 300)
    assert periodic.diagonal_runs(loop, len(loop)).tolist() == [[0, 300_000, 1000]]
    common = np.array([x for x, i in itertools.product((0, 1), range(200_000)) for x in (0, i + 1)], np.int64)
    assert len(periodic.diagonal_runs(common, len(common))) == 0
