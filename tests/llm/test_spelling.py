"""Spelling variants against a comparison of all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest
from compare import compare

from textstrata.llm import spelling


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(counts):
    out = {}
    for w, n in counts.items():
        near = [x for x in counts if abs(len(x) - len(w)) < 2 and one_edit(w, x)]
        best = min(near, key=lambda x: (-counts[x], x), default=None)
        fits = best is not None and counts[best] >= 10 * n
        out[w] = [best if fits else None, w, n, len(near), counts[best] if fits else None]
    for w in out:
        while out[out[w][1]][0]:
            out[w][1] = out[out[w][1]][0]
    return sorted((w, *v) for w, v in out.items())


@pytest.mark.parametrize("block", [2, 8, 128])
def test_tiles_miss_no_pair(spark, monkeypatch, block):
    monkeypatch.setattr(spelling, "BLOCK", block)
    r = random.Random(block)
    counts = Counter()
    for _ in range(250):
        w = "".join(r.choice("abé日") for _ in range(r.choice([1, 2, 3, 5, 9, 9])))
        for _ in range(4):
            counts[w] += r.choice([1, 3, 40, 1000])
            i = r.randrange(len(w))
            w = r.choice([w[:i] + w[i + 1 :], w[:i] + "x" + w[i:], w[:i] + "y" + w[i + 1 :]]) or "q"
    counts["a" * 3000], counts["a" * 2999], counts["a" * 1500 + "b" + "a" * 1499] = 500, 50, 5
    rows = list(counts.items()) + [(None, 5)]
    got = spelling.spelling_variants(spark.createDataFrame(rows, "word string, n long")).collect()
    assert sorted(map(tuple, got)) == variants(counts)


def test_one_hot_prefix_is_cut_until_tiles_are_small(spark):
    """All words share their first and last letters; tiles are cut to single places, and only there they meet."""
    r = random.Random(1)
    counts = {"common" + "".join(r.choice("ab") for _ in range(10)) + "ending": r.randint(1, 2000) for _ in range(700)}
    got = spelling.spelling_variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()
    assert sorted(map(tuple, got)) == variants(counts)


def words_of(rows):
    counts = Counter()
    for doc_id, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def test_query_by_brute_force(spark, folder):
    r = random.Random(2)
    base = ["".join(r.choice("abcdeÉé÷×ß") for _ in range(r.randint(6, 12))) for _ in range(60)]
    rows = [(r.choice([i, None]), r.choice([" ", "-", "1"]).join(r.choice(base[: 1 + int(r.expovariate(0.1)) % 60]) for _ in range(r.randint(0, 80)))) for i in range(400)]
    rows += [(1, None), (2, ""), (3, "Z" * 5000 + " " + "z" * 5000), (3, "x" * 9), (3, "x" * 9)]
    d = folder(documents=([(*x, "w", 1) for x in rows], "doc_id long, text string, word string, n long"))
    out = spelling.op11_spelling(spark, d)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, out.collect())) == variants(words_of(rows))
    assert compare(spark, d, "op11", spelling.op11_spelling, spelling.SQL).startswith("ok")


def test_empty_and_chains(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], "word string, n long")).count() == 0
    chain = {"a" * k: 10**k for k in range(1, 9)}
    got = {r.word: r.root for r in spelling.spelling_variants(spark.createDataFrame(list(chain.items()), "word string, n long")).collect()}
    assert set(got.values()) == {"a" * 8}
