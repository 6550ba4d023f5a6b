"""Capped water-filling and the seeded sample, against plain loops."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from compare import compare

from textstrata.llm import mixing

SCHEMA = "doc_id long, text string, source string, size long, name string"


def targets(sizes):
    """Rounds of sharing: clamp those above, share the rest anew."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    left, free, fixed = sum(sizes.values()), set(sizes), {}
    while free:
        total = sum(weight[s] for s in free)
        above = {s for s in free if weight[s] * left > 3 * sizes[s] * total}
        if not above:
            return fixed | {s: left * weight[s] / total for s in free}
        fixed |= {s: 3.0 * sizes[s] for s in above}
        left, free = left - sum(3 * sizes[s] for s in above), free - above
    return fixed


def taken(rows, target, words):
    """(doc_id, size, taken) of one source's rows."""
    whole = min(3, int(target // words)) if words else 0
    open_ = limit = int(target - whole * words)
    draw = lambda r: hashlib.md5(f"{mixing.SEED}:{'' if r[0] is None else r[0]}:{r[1] or ''}".encode()).hexdigest()
    order = sorted(((draw(r), r[0], len((r[1] or "").split())) for r in rows), key=lambda x: (x[0], x[2]))
    extra, active = [0] * len(order), open_ > 0
    for i, (_, _, n) in enumerate(order):
        if not (active and 0 < n <= limit):
            continue
        if n <= open_:
            extra[i], open_ = 1, open_ - n
        else:
            limit, active = open_, open_ > target * mixing.TOLERANCE
    if open_ > target * mixing.TOLERANCE:
        least = min(((n, d, i) for i, (d, _, n) in enumerate(order) if n and not extra[i]), default=None)
        if least and least[0] < 2 * open_:
            extra[least[2]] = 1
    return [(i, n, n * (whole + e)) for (_, i, n), e in zip(order, extra)]


def documents(seed):
    r = random.Random(seed)
    sources = [None, "a", "b", "é", "\U0001f600", "￿", "Z", ""][: r.randint(1, 8)]
    rows = []
    for i in range(r.randint(1, 150)):
        n = r.choice([0, 1, 2, 5, 40, 400])
        rows.append((r.choice([i, i, 7, None]), r.choice([" ", "\n"]).join(["wé"] * r.randint(0, n)) if r.random() < 0.95 else None, sources[min(int(r.expovariate(0.7)), len(sources) - 1)]))
    return rows + [(5, "same text here", sources[0])] * 40 + [(8, "x " * 5000, sources[-1])]


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_mix_by_plain_loops(spark, folder, seed):
    rows = documents(seed)
    d = folder(documents=([(*x, 0, "n") for x in rows], SCHEMA))
    out = mixing.op12_mixing(spark, d)
    got = out.collect()
    by = defaultdict(list)
    for x in rows:
        by[x[2]].append(x)
    sizes = {s: sum(len((t or "").split()) for _, t, _ in v) for s, v in by.items()}
    target = targets(sizes)
    want = Counter((i, n, sizes[s], round(target[s], 6), k) for s, v in by.items() for i, n, k in taken(v, target[s], sizes[s]))
    assert Counter((x.doc_id, x.size, x.source_size, round(x.target, 6), x.taken) for x in got) == want
    assert all(x.taken <= 3 * x.size for x in got)
    assert compare(spark, d, "op12", mixing.op12_mixing, mixing.SQL).startswith("ok")


def test_same_however_partitioned(spark, folder):
    rows = documents(9)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one, many = (sorted(map(tuple, mixing.mix(x, "doc_id", "source", "text").collect()), key=str) for x in (df.coalesce(1), df.repartition(13)))
    assert one == many


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(empty, "doc_id", "source", "text").count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in mixing.mix(blank, "doc_id", "source", "text").collect()] == [(0, 0.0, 0)] * 2
    lone = spark.createDataFrame([(1, "w " * 10, "a")] * 3, "doc_id long, text string, source string")
    assert [r.taken for r in mixing.mix(lone, "doc_id", "source", "text").collect()] == [10] * 3
    # one epoch at most: all are clamped at once
    assert {r.taken for r in mixing.mix(lone.unionByName(blank), "doc_id", "source", "text", epochs=1).filter("size > 0").collect()} == {10}


def test_equal_rows_at_the_end_of_a_sample(spark):
    """A third of all rows are one row; the end of the sample falls among them."""
    rows = [(1, "a b c", "hot")] * 300 + [(i, "a b c d", "hot") for i in range(50)] + [(i, "w " * 40, "z") for i in range(5)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7), "doc_id", "source", "text").collect()
    for source in (3, 4), (40,):
        some = [r for r in out if r.size in source]
        assert abs(sum(r.taken for r in some) - some[0].target) <= 4 and max(r.repetitions for r in some) <= 3
