"""Word-trigram search against a search of every stretch."""

import random
import re
import time

import numpy as np
import pytest

from textstrata.catalogue import queries
from textstrata.functions.wordgrams import best_stretch, ordered_grams
from textstrata.operators import wordsearch


def plain_grams(text):
    return [p[i : i + 3] for w in re.findall(r"[^\W_]+", (text or "").lower()) for p in [f"  {w} "] for i in range(len(p) - 2)]


def code(gram):
    a, b, c = map(ord, gram)
    return a << 42 | b << 21 | c


def plain_best(needle, text):
    wanted, seen = set(plain_grams(needle)), plain_grams(text)
    best = 0.0
    for i in range(len(seen)):
        run = set()
        for g in seen[i:]:
            run.add(g)
            both = len(run & wanted)
            best = max(best, both / (len(wanted) + len(run) - both))
    return best if wanted else 0.0


def words(r, n, letters):
    return r.choice([" ", "_", "-  "]).join("".join(r.choice(letters) for _ in range(r.randint(1, 5))) for _ in range(n))


def test_grams_in_order():
    for t in ["", None, "a", "Ab_c  de", "日本 x", "İstanbul ß", "\U0001f600 a1", "--"]:
        assert ordered_grams(t).tolist() == [code(g) for g in plain_grams(t)]


@pytest.mark.parametrize("least", [0.0, 0.3, 0.6, 1.0])
def test_best_stretch_is_the_best_of_all(least):
    r = random.Random(int(least * 10))
    for _ in range(400):
        letters = r.choice(["a", "ab", "abcde"])
        needle, text = words(r, r.randint(0, 3), letters), words(r, r.randint(0, 14), letters)
        want = plain_best(needle, text)
        got = best_stretch(ordered_grams(text), np.unique(ordered_grams(needle)), least)
        assert got == pytest.approx(want if want >= least else 0.0), (needle, text)


def test_time_grows_with_the_text():
    """Texts of one repeated word, of one common trigram, and of plain words: twice the text, about twice the time."""
    r = random.Random(1)
    needle = np.unique(ordered_grams("abcab the where"))
    for make in (lambda n: "the " * n, lambda n: "abc " + "a" * (4 * n), lambda n: words(r, n, "abcdefghij")):
        took = []
        for n in (20_000, 40_000):
            seen = ordered_grams(make(n))
            begun = time.perf_counter()
            best_stretch(seen, needle, 0.6)
            took.append(time.perf_counter() - begun)
        assert took[1] < 3.5 * took[0] + 0.05, took


def test_search_by_brute_force(spark):
    r = random.Random(2)
    texts = [(i, words(r, r.randint(0, 30), "abc")) for i in range(150)] + [(7, "abc abc"), (None, "abc cab"), (900, None), (901, ""), (902, "x" * 3000 + " abc cab")]
    asked = [(1, "abc cab"), (2, "a b"), (3, ""), (4, None), (5, "zzz")]
    df = spark.createDataFrame([(*t, "q", 1) for t in texts], "doc_id long, text string, q string, query_id long")
    got = wordsearch.word_search(df, spark.createDataFrame(asked, "query_id long, q string")).collect()
    want = [(q, i, plain_best(n, t)) for q, n in asked if n for i, t in texts if t and plain_best(n, t) >= 0.6]
    assert sorted(((x.query_id, x.doc_id, round(x.similarity, 9)) for x in got), key=str) == sorted(((q, i, round(s, 9)) for q, i, s in want), key=str)
    assert {x.query_id for x in got} == {1, 2}
    top = wordsearch.ranked_word_search(df, spark.createDataFrame(asked, "query_id long, q string"), 3).filter("query_id = 1").orderBy("rank").collect()
    assert [x.rank for x in top] == [1, 2, 3, 4] and [x.similarity for x in top] == sorted((s for q, _, s in want if q == 1), reverse=True)[:4]
    assert wordsearch.word_search(df.limit(0), spark.createDataFrame(asked, "query_id long, q string")).count() == 0
    assert wordsearch.word_search(df, spark.createDataFrame([], "query_id long, q string")).count() == 0


def test_queries_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(wordsearch, "BLOCK", 2)
    asked = spark.createDataFrame([(i, f"word{i}") for i in range(7)], "query_id long, q string")
    df = spark.createDataFrame([(i, f"the word{i} here") for i in range(7)], "doc_id long, text string")
    got = wordsearch.word_search(df, asked, 1.0).collect()
    assert sorted((x.query_id, x.doc_id) for x in got) == [(i, i) for i in range(7)]


def test_query_by_brute_force(spark, sf):
    found = queries()["word_search"](spark, sf).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").filter("n_chars < 400").collect()}
    from textstrata.plans.retrieval import PHRASES

    want = {(q, i) for q, n in PHRASES for i, t in docs.items() if plain_best(n, t) >= 0.6}
    assert {(x.query_id, x.doc_id) for x in found if x.doc_id in docs} == want
