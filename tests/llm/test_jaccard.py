import random

import numpy as np
import pytest
from brute import groups, shingle_set

from textstrata.llm import jaccard


def texts(seed, n=160):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(3))
    passage = " ".join(word() for _ in range(60))
    base = [[word() for _ in range(r.choice([1, 3, 5, 30, 90, 200]))] for _ in range(12)]
    out = []
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 4, 9])):
            w[r.randrange(len(w))] = word()
        t = " ".join(w)
        if r.random() < 0.2:
            t = passage + " " + t
        out.append((i, t.upper() if r.random() < 0.2 else t))
    big = [word() for _ in range(120)]
    for i in range(n, n + 90):
        w = list(big)
        for _ in range(r.choice([0, 1, 2, 3])):
            w[r.randrange(len(w))] = word()
        out.append((i, " \t".join(w)))
    return out + [(9001, None), (9002, ""), (9003, " \n\t"), (9004, "x"), (9005, "X"), (9006, "a b"), (9007, "z " * 30_000)]


@pytest.mark.parametrize("seed", [1])
def test_groups_are_brute_force(spark, folder, seed):
    rows = texts(seed)
    d = folder(documents=([(*r, 0) for r in rows], "doc_id long, text string, sig int"))
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.op4_jaccard(spark, d).collect())
    assert got == groups(rows)


def test_small_blocks_change_nothing(spark, folder, monkeypatch):
    rows = texts(5)
    monkeypatch.setattr(jaccard, "BLOCK_LEAST", 8)
    d = folder(documents=(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.op4_jaccard(spark, d).collect()) == groups(rows)


def test_few_common_shingles_change_nothing(spark, folder, monkeypatch):
    """With a tiny broadcast bound hardly any shingle is common, and large groups are paired whole."""
    rows = texts(6)
    monkeypatch.setattr(jaccard, "BROADCAST", 40)
    d = folder(documents=(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.op4_jaccard(spark, d).collect()) == groups(rows)


def test_nulls_repeats_and_empty(spark):
    df = spark.createDataFrame([(5, "a b c d e"), (5, "a b c d e"), (None, "a b c d e"), (3, "A b c d e")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in jaccard.near_groups(df).collect()) == [("3", 2, 3), ("5", 2, 3), ("5", 2, 3), ("None", 2, None)]
    assert jaccard.near_groups(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_region_join_is_exact(seed):
    r = random.Random(seed)
    base = [set(r.sample(range(3000), r.choice([10, 60, 200]))) for _ in range(4)]
    sets = []
    for _ in range(220):
        s = set(r.choice(base))
        for _ in range(r.randint(0, max(1, len(s) // 6))):
            s.discard(r.choice(sorted(s))) if len(s) > 1 else None
            s.add(r.randrange(4000))
        sets.append(s)
    off = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    region = jaccard.Region(np.concatenate([np.array(sorted(s), np.uint64) for s in sets]), off)
    region.join(np.arange(len(sets)))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    assert [find(i) for i in range(len(sets))] == region._roots().tolist()


def test_shingle_counts(spark):
    import pyarrow as pa

    from textstrata.llm.shingles import shingle_sets

    rows = [t for _, t in texts(9)]
    h, off = shingle_sets(pa.array(rows), 4)
    assert [len(shingle_set(t)) for t in rows] == np.diff(off).tolist()


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_words_of_regular_structure_do_not_meet(spark):
    """Words of equal letter counts at every power of two: hashes that are polynomials modulo 2^64 can't tell them apart."""
    one = thue_morse(1024)
    other = one.translate(str.maketrans("ab", "ba"))
    df = spark.createDataFrame([(1, one), (2, other), (3, f"{one} x y z"), (4, f"{other} x y z"), (5, one)], "doc_id long, text string")
    assert sorted(tuple(r) for r in jaccard.near_groups(df).collect()) == [(1, 1, 1), (2, 1, 2), (3, 1, 3), (4, 1, 4), (5, 1, 1)]


def test_one_id_may_have_many_texts(spark):
    w = lambda s: " ".join(f"{s}{i}" for i in range(60))
    rows = [(1, w(f"t{i}")) for i in range(30)] + [(1, w("t0") + " more"), (2, w("t7") + " more"), (3, w("t9") + " other")] + [(4, w("q"))] * 20
    got = jaccard.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted({(r.doc_id, r.component_id) for r in got}) == [(1, 1), (2, 1), (3, 1), (4, 4)] and len(got) == len(rows)


def test_large_groups_of_uncommon_shingles_hang_on_a_leader(spark, folder, monkeypatch):
    rows = texts(8)
    monkeypatch.setattr(jaccard, "GROUP", 3)
    monkeypatch.setattr(jaccard, "COMMON", 1 << 40)
    d = folder(documents=(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.op4_jaccard(spark, d).collect()) == groups(rows)
