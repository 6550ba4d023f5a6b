"""Language ID and toxicity: gradients, held-out accuracy, edge cases."""

import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textstrata.llm import language, toxicity
from textstrata.llm.common import fold_of


def test_backpropagation_is_the_numeric_gradient():
    net = language.ByteGru(["a", "b"], hidden=3, seed=1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = np.frombuffer(b"ab xyzw qqab", np.uint8).reshape(3, 4)
    mask, y = language.LETTER[x], np.array([0, 2, 1])
    _, grad = net.step(x, mask, y)
    rng = np.random.default_rng(0)
    for name, g in grad.items():
        flat = np.abs(g).ravel()
        for i in rng.choice(np.flatnonzero(flat > flat.max() * 0.05), 3):
            at = np.unravel_index(i, g.shape)
            old, ends = net.p[name][at], []
            for e in (1e-3, -1e-3):
                net.p[name][at] = old + e
                ends.append(net.step(x, mask, y)[0])
            net.p[name][at] = old
            assert abs((ends[0] - ends[1]) / 2e-3 - g[at]) < 2e-3 * max(1, abs(g[at])) + 2e-4, name


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.op5_language(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id")
    assert got.filter("score < 0.5").count() <= 0.01 * docs.count()
    held = got.filter("held_out AND lang IS NOT NULL").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert held >= 0.97 and got.filter("score < 0 OR score > 1").count() == 0 and got.count() == docs.count()


def test_language_edges(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 20)]
    train = spark.createDataFrame(rows + [(None, "x", "en"), (900, None, "en"), (901, "y", None)], "doc_id long, text string, lang string")
    model = language.train(language.training_rows(train), steps=60)
    asked = spark.createDataFrame([(1, None, "s"), (2, "", "s"), (3, "12 !? \n", "s"), (4, "the dog", "s"), (5, "und die " * 20_000, "s"), (6, "x" * 50_000, "s"), (4, "the dog", "s"), (7, "\u00a1 \U0001f600 \u2026", "s")], "doc_id long, text string, score string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(asked, model).collect()}
    assert [got[i] for i in (1, 2, 3, 7)] == [("und", 0.0)] * 4 and got[4][0] == "en" and got[5][0] == "de" and got[6][0] in ("en", "de")
    assert language.identify(asked.limit(0), model).count() == 0
    assert {r.lang_pred for r in language.identify(asked, language.train([])).collect()} == {"und"}


def test_only_rows_outside_the_held_out_fold_are_learned_from(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    held = {r.text for r in docs.collect() if fold_of(r.doc_id) == 0} - {r.text for r in docs.collect() if fold_of(r.doc_id)}
    assert held and not held & {text for text, _ in language.training_rows(docs)}
    assert not [i for i, _, _ in toxicity.training_rows(docs, labels)[0] if fold_of(i) == 0]


def test_text_in_no_learned_language_scores_low(spark):
    model = language.train(language.training_rows(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")))
    odd = ["今日はとても良い天気ですね。散歩に行きましょう。", "Сегодня очень хорошая погода, пойдём гулять.", "xqzv wkjp zzzz", "qwrt plmk njbh vgfc xxzq", "ωραία μέρα σήμερα"]
    _, scores = language.predict(model, pa.array(odd))
    assert max(scores) < 0.5, scores


def test_windows_and_slices_change_no_result(monkeypatch):
    net = language.ByteGru(["a", "b"], hidden=4)
    texts = ["one two three " * 60, "four five", None, "é" * 400, "x"]
    want = language.predict(net, pa.array(texts))[1]
    assert np.allclose([language.predict(net, pa.array([t], pa.string()))[1][0] for t in texts], want, atol=1e-5)
    monkeypatch.setattr(language, "TOGETHER", 2)
    assert np.allclose(language.predict(net, pa.array(texts))[1], want, atol=1e-5)
    # one window, read by both forms of the recurrence
    x = np.random.default_rng(0).integers(0, 256, (5, 40)).astype(np.uint8)
    states, _, _ = net._states(x)
    assert np.allclose(net._probabilities(states[:, 0], states[::-1, 1])[6:34], net.read(x, 6).transpose(0, 2, 1), atol=1e-5)


def test_ties_go_to_the_first_language():
    net = language.ByteGru(["a", "b"], hidden=2)
    net.p = {k: np.zeros_like(v) for k, v in net.p.items()}
    assert language.predict(net, pa.array(["some text"])) == (["a"], [pytest.approx(1 / 3)])


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    got = toxicity.op6_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    hit = ((got.predicted == 1) & (got.toxic == 1)).sum()
    # about a fifth of the label-1 rows hold nothing that tells them from label-0 ones (junk, plain prose): recall can't reach 1
    assert hit / (got.toxic == 1).sum() >= 0.75 and hit / (got.predicted == 1).sum() >= 0.9 and got.score.between(0, 1).all()


def test_toxicity_edges(spark):
    docs = [(i, ("you are such a stupid idiot, moron " if i % 3 == 0 else "what a lovely day it was ") * (1 + i % 3)) for i in range(300)]
    labels = [(i, int(i % 3 == 0)) for i in range(300)] + [(1, None), (None, 1), (3, 1), (99999, 0)]
    model = toxicity.Model(*toxicity.training_rows(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")))
    asked = spark.createDataFrame([(1, None), (2, ""), (3, "You stupid idiot! moron"), (4, "a nice day"), (5, "fine " * 30_000), (3, "You stupid idiot! moron")], "doc_id long, text string").withColumn("predicted", F.lit("x"))
    got = {r.doc_id: (r.score, r.predicted) for r in toxicity.rate(asked, model).collect()}
    assert got[3][1] == 1 and got[4][1] == got[5][1] == 0 and got[1] == got[2] and all(0 <= s <= 1 for s, _ in got.values())
    assert toxicity.rate(asked.limit(0), model).count() == 0
    for none in (toxicity.Model([], (0.0, 0.0)), toxicity.Model([(1, "a", 1)], (0.0, 5.0))):
        assert {r.score for r in toxicity.rate(asked, none).collect()} == {none.share}


def test_hidden_words_are_features():
    f = toxicity.Features({})
    plain, hidden = toxicity.NAMES.index("lexicon_log"), toxicity.NAMES.index("hidden")
    assert f.row("you idiot")[plain] > 0 and f.row("you idiot")[hidden] == 0
    for t in ("1d10t", "you st*pid", "st*pid!", "5tupid", "i d i o t", "mor0n", "idiooooot", "(1d10t),", "a$$hole", "id!ot"):
        assert f.row(f"well {t} there")[hidden] > 0, t
    for t in ("1999", "a1", "x_y", "hello!", "10:30", "$5", "st*", "e-mail", "really?!", "***", "no.1"):
        assert f.row(f"well {t} there")[hidden] == 0, t


def test_features_take_long_texts_in_linear_time():
    import time

    f = toxicity.Features({})
    for text in ("you idiot ", "x", "1", "a1", "*", "i d i o t ", "aaa!"):
        took = []
        for times in (40_000, 160_000):
            began = time.perf_counter()
            f.row(text * times)
            took.append(time.perf_counter() - began)
        assert took[1] < 10 * took[0] + 0.5, (text, took)


def test_isotonic_is_monotone():
    rng = np.random.default_rng(0)
    m = rng.standard_normal(300)
    y = (rng.random(300) < 1 / (1 + np.exp(-2 * m))).astype(float)
    knots = toxicity.isotonic(m, y, np.ones(300))
    got = np.interp(np.sort(m), *knots)
    assert (np.diff(got) >= -1e-12).all() and 0 <= got.min() and got.max() <= 1


@pytest.mark.parametrize("n", [0, 1])
def test_trees_on_little(n):
    b = toxicity.Boosted(trees=2).fit(np.zeros((2, 3)), np.array([0.0, 1.0]), np.ones(2))
    assert len(b.margin(np.zeros((n, 3)))) == n


def test_letters_only_by_brute_force():
    r = random.Random(3)
    signs = "aZé日–“”•…\U0001f600ไม้ि् 12-\n\t'ß́\U00020000"
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 30))) for _ in range(300)] + ["", None, "…", "a"]
    raw, offsets, seen = language.letters_only(*language.text_buffers(pa.array(texts, pa.string())))
    for i, t in enumerate(texts):
        kept = "".join(c.lower() if c.isascii() else c if unicodedata.category(c)[0] in "LM" else "\0" for c in (t or ""))
        want = "".join(c if c.isalpha() or unicodedata.category(c)[0] == "M" else " " for c in kept)
        while "  " in want:
            want = want.replace("  ", " ")
        assert raw[offsets[i] : offsets[i + 1]].tobytes().decode() == want
        assert seen[i] == any(map(str.isalpha, t or ""))


def test_signs_do_not_make_a_text_no_language(spark):
    """Quotes, bullets, dashes, ellipses and emoji about the words of a clean text leave its score where it was."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train(language.training_rows(docs))
    rows = docs.filter("doc_id % 50 = 0 AND n_chars > 300").orderBy("doc_id").collect()
    plain = [r.text[:300] for r in rows]
    labels, scores = language.predict(model, pa.array(plain))
    changes = [
        str.upper, lambda t: " ".join(f"“{w}”" for w in t.split()), lambda t: "\n".join(f"• {w}" for w in t.split()), lambda t: "—" * 100 + t, lambda t: t + "\U0001f600" * 80,
        lambda t: "…".join(t.split()), lambda t: " ".join(f"*{w}* 12345" for w in t.split()), lambda t: "\n".join(f"- {w}" for w in t.split()),
    ]
    for change in changes:
        told, marks = language.predict(model, pa.array([change(t) for t in plain]))
        assert told == labels and np.abs(np.array(marks) - scores).max() < 0.15, marks
        assert all(m >= 0.5 for m, s in zip(marks, scores) if s >= 0.6)
