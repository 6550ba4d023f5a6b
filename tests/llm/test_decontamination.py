import random

from compare import compare
from pyspark.sql import functions as F

from textstrata.llm import decontamination as D

WORDS = "a b c d é ff the 12 ñ".split()


def tables(seed=2):
    r = random.Random(seed)
    docs = [(i if i % 9 else None, " ".join(r.choice(WORDS) for _ in range(r.randint(0, 60)))) for i in range(120)]
    items = [(i, " ".join(r.choice(WORDS) for _ in range(r.randint(0, 14)))) for i in range(50)]
    items += [(100, None), (101, "..."), (102, "a b c d"), (102, "a b c d"), (103, "A-b-C d!")]
    docs += [(6000 + i, "x " * r.randint(0, 9) + (items[i][1] or "") + " é") for i in range(50)]
    docs += [(5000, None), (5001, ""), (5002, "--- ..."), (7, "a b c"), (7, "a b c"), (8000, "the " * 400)]
    return docs, items


def test_long_texts_by_brute_force(spark):
    """Long texts, also ones that are one benchmark passage over and over; SQL would copy the words once per place."""
    w = [f"w{i % 997}" for i in range(60_000)]
    item = [f"w{i}" for i in range(100, 130)]
    docs = [(1, " ".join(w)), (2, " ".join(item * 2000)), (3, "the " * 40_000)]
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in D.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item)), (8, "the the")], "item_id long, text string")).collect()}
    assert got == {1: (60_000, 30 * (60_000 // 997 + 1) - (0 if 60_000 % 997 >= 130 else 30), [7]), 2: (60_000, 60_000, [7]), 3: (40_000, 40_000, [8])}


def test_short_items_nulls_repeats_and_long_texts(spark, folder):
    docs, items = tables()
    d = folder(documents=([(*r, 1) for r in docs], "doc_id long, text string, n_hit int"), benchmark=([(*r, 1) for r in items], "item_id long, text string, words int"))
    assert compare(spark, d, "op1", D.op1_decontamination, D.SQL).startswith("ok")


def test_blocks_change_nothing(spark, folder):
    docs, items = tables(3)
    d = folder(documents=(docs, "doc_id long, text string"), benchmark=(items, "item_id long, text string"))
    read = lambda: (spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet"))
    rows = lambda block: sorted(map(str, D.decontaminate(*read(), block=block).withColumn("items", F.col("items").cast("string")).collect()))
    assert rows(30) == rows(D.BLOCK)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert D.decontaminate(docs, items).count() == 0
    some = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert [(r.n_words, r.n_hit, r["items"]) for r in D.decontaminate(some, items.limit(0)).collect()] == [(3, 0, [])]
