"""Sharding, chat formatting, components, pipeline."""

import random
import time
import zlib
from collections import Counter

import corpus_pipeline
import pytest
from brute import base_spans, groups
from compare import compare
from pyspark.sql import functions as F

from textstrata.llm import chat, sharding
from textstrata.llm.common import components

ROWS = [(i, "é" * (i % 7)) for i in range(500)] + [(None, None), (None, "x"), (7, "same"), (7, "same"), (8, "long " * 30_000)]


def test_sharding_law(spark, folder):
    d = folder(documents=([(*r, "s") for r in ROWS], "doc_id long, text string, shard string"))
    got = sharding.op9_sharding(spark, d).collect()
    assert len(got) == len(ROWS) and {r.law for r in got} == {"key"}
    sizes = Counter((r.doc_id, r.size, r.text_crc32) for r in got)
    assert sizes == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in ROWS)
    for s in range(sharding.SHARDS):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert all(r.grown_shard in (r.shard, sharding.SHARDS) for r in got)
    some = sharding.shard_by_key(spark.createDataFrame(ROWS[:50], "doc_id long, text string"), "doc_id", "text", sharding.SHARDS)
    shard = {r.doc_id: r.shard for r in got}
    assert all(shard[r.doc_id] == r.shard for r in some.collect())
    more = sharding.shard_by_key(spark.createDataFrame(ROWS, "doc_id long, text string"), "doc_id", "text", sharding.SHARDS + 1)
    grown = {r.doc_id: r.grown_shard for r in got}
    assert all(grown[r.doc_id] == r.shard for r in more.collect())
    assert sharding.shard_by_key(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text", 40).count() == 0


def test_slot_maps():
    a = sharding.first_map(40)
    sizes = Counter(a)
    assert len(a) == sharding.SLOTS and max(sizes.values()) - min(sizes.values()) <= 1
    b = sharding.grow(a, 40)
    assert all(x == y or y == 40 for x, y in zip(a, b)) and 0 < sum(x != y for x, y in zip(a, b)) <= sharding.SLOTS // 41 + 1
    r = random.Random(0)
    load = {s: r.randint(1, 1000) * (20 if s % 40 == 0 else 1) for s in range(sharding.SLOTS)}
    even = sharding.rebalance(a, load)
    by = Counter()
    for s, shard in enumerate(even):
        by[shard] += load[s]
    assert max(by.values()) <= 1.03 * sum(by.values()) / 40 and sum(x != y for x, y in zip(a, even)) < sharding.SLOTS // 4


def test_maps_are_stored_and_edited(spark, tmp_path):
    path, df = f"{tmp_path}/maps", spark.createDataFrame(ROWS, "doc_id long, text string")
    sharding.shard_by_key(df, "doc_id", "text", 40, path)
    version, grown = sharding.stored_map(spark, path)
    assert version == 2 and grown == sharding.grow(sharding.stored_map(spark, path, 1)[1], 40)
    loads = sharding.slot_bytes(df, "doc_id", "text")
    assert sum(loads.values()) == sum(len((t or "").encode()) + 16 for _, t in ROWS)
    assert sharding.edit_map(spark, path, lambda a: sharding.rebalance(a, loads)) == 3
    assert sharding.stored_map(spark, path)[1] == sharding.rebalance(grown, loads) and sharding.stored_map(spark, path, 2)[1] == grown
    with pytest.raises(Exception, match="exists"):
        sharding.store_map(spark, path, grown, 3)
    shards = {r.doc_id: r.shard for r in sharding.shard_by_map(df, "doc_id", "text", sharding.map_versions(spark, path), 3).collect()}
    assert shards[8] == sharding.stored_map(spark, path)[1][next(r.vslot for r in sharding.placed_rows(df.filter("doc_id = 8"), "doc_id", "text").collect())]


def test_chat_by_brute_force(spark, folder):
    r = random.Random(0)
    rows = []
    for c in range(40):
        first = r.choice(["hi", "hello", "é"])
        rows += [(c, t, ("user", "assistant", "system")[t % 3] if r.random() < 0.9 else None, first if t == 0 else r.choice(["a", "b", None])) for t in range(r.randint(1, 5))]
    rows = [x for x in rows if x[0] not in (7, 12)] + [(3, 0, "user", "again"), (50, 0, "user", "x" * 50_000)]
    d = folder(conversations=([(*x, "p") for x in rows], "conv_id long, turn long, role string, text string, pair_id string"))
    got = {x.pair_id: x for x in chat.op7_chat(spark, d).collect()}
    assert set(got) == {c // 2 for c, *_ in rows}
    for k, x in got.items():
        side = [sorted((t, role or "unknown", text or "") for c, t, role, text in rows if c == 2 * k + s) for s in (0, 1)]
        a, b = [[(role, text) for _, role, text in s] for s in side]
        n = next((i for i, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))
        show = lambda ts: "".join(f"<|{role}|>\n{text}<|end|>\n" for role, text in ts)
        assert (x.n_prompt_turns, x.prompt, x.chosen, x.rejected) == (n, show(a[:n]), show(a[n:]), show(b[n:]))
        for mask, text, turns in ((x.chosen_mask, x.chosen, a[n:]), (x.rejected_mask, x.rejected, b[n:])):
            cut = [text[int(s.split(":")[0]) : int(s.split(":")[1])] for s in mask.split(",") if s]
            assert cut == [f"{t}<|end|>\n" for role, t in turns if role == "assistant"]
    lone = [(None, t, "user", "n") for t in range(300)] + [(None, None, None, None), (4, 0, "user", "m")]
    d = folder(conversations=(lone, "conv_id long, turn long, role string, text string"))
    assert compare(spark, d, "op7", chat.op7_chat, chat.SQL).startswith("ok")
    alone = chat.op7_chat(spark, d).filter("pair_id IS NULL").collect()
    assert len(alone) == 301 and {x.status for x in alone} == {"no rejected"} and {x.chosen for x in alone} == {"<|user|>\nn<|end|>\n", "<|unknown|>\n<|end|>\n"}
    odd = [(2**60, 0, "user", "x"), (2**60 + 1, 0, "user", "x"), (2**60 + 2, 0, "user", "y"), (None, 0, "user", "n"), (-1, 0, "user", "m"), (-2, 0, "user", "m")]
    d = folder(conversations=(odd, "conv_id long, turn long, role string, text string"))
    assert compare(spark, d, "op7", chat.op7_chat, chat.SQL).startswith("ok")
    assert {x.pair_id: x.status for x in chat.op7_chat(spark, d).collect()} == {2**59: "equal", 2**59 + 1: "no rejected", None: "no rejected", -1: "equal"}
    assert chat.format_preferences(chat.paired(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_long_conversations_take_time_in_proportion(spark):
    took = []
    for n in (2_000, 20_000, 40_000):
        turns = spark.range(n).select(F.lit(0).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 1, "assistant").otherwise("user").alias("role"), F.concat(F.lit("t"), "id").alias("text"))
        begun = time.perf_counter()
        row = chat.format_preferences(chat.paired(turns)).first()
        took.append(time.perf_counter() - begun)
        assert len(row.chosen_mask) == n // 2 and row.chosen[row.chosen_mask[-1].start : row.chosen_mask[-1].end] == f"t{n - 1}<|end|>\n"
    assert took[2] < 2.5 * took[1] + 2, took


@pytest.mark.parametrize("edges", [[], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 200)] + [(500, 500)], [(random.Random(1).randrange(300), random.Random(i).randrange(300)) for i in range(200)], [(None, 1), (2, 3), (3, 2), (2, 3)]])
def test_components(spark, edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        return x if root[x] == x else find(root[x])

    for a, b in edges:
        if a is not None and b is not None and a != b:
            root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(root)}


def test_pipeline_by_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = corpus_pipeline.keep_languages(spark, docs, sf)
    assert kept.columns == corpus_pipeline.COLUMNS and kept.count() >= 0.98 * docs.count()
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    one = corpus_pipeline.drop_near_copies(spark, kept, sf)
    assert sorted(r.doc_id for r in one.collect()) == sorted(i for i, _, c in groups(rows) if i == c)
    clean = corpus_pipeline.drop_contaminated(spark, one, sf)
    words = lambda t: spark_words(t)
    wins = {tuple(w[i : i + 10]) for w in map(words, items) for i in range(max(1, len(w) - 9)) if w}
    hit = lambda t: any(tuple(w[i : i + n]) in wins for w in [words(t)] for n in {len(x) for x in wins} for i in range(len(w) - n + 1))
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r.doc_id for r in one.collect() if not hit(r.text))
    safe = corpus_pipeline.redact_personal_data(spark, clean, sf)
    for r in safe.collect():
        assert not base_spans(r.text) and r.n_chars == len(r.text)
    out = corpus_pipeline.tokenize(spark, safe, sf)
    assert sorted((r.doc_id, r.n_bytes) for r in out.collect()) == sorted((r.doc_id, len(r.text.encode())) for r in safe.collect())


def spark_words(t):
    import re

    low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def test_pipeline_stages_take_odd_rows(spark, sf):
    rows = [(1, None, "en", "s", 0), (2, "", None, None, None), (None, "the the of and " * 20, "en", "s", 1), (3, "the cat and the dog ran away", "en", "s", 28), (3, "the cat and the dog ran away", "en", "s", 28), (4, "mail a@b.co the end of it", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0, name
        out = stage(spark, docs, sf)
        assert out.count() <= len(rows), name
    assert corpus_pipeline.drop_near_copies(spark, docs, sf).filter("doc_id = 3").count() == 1
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_copies", "decontamination", "personal_data", "bpe"]


def test_pipeline_near_copies_by_five_words_and_four_fifths(spark, sf):
    words = [f"w{i}" for i in range(104)]
    cut = words[:86]  # 82 of 100 shingles of five words, 83 of 101 of four
    far = [f"v{i}" for i in range(104)]
    rows = [(1, " ".join(words)), (2, " ".join(cut)), (3, " ".join(far)), (4, " ".join(far[:83]))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, sf).collect()) == [1, 3, 4]


def test_pipeline_near_copies_go_by_text_not_by_id(spark, sf):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (2, b), (2, a), (None, c), (None, c + " more"), (3, c), (None, "alone " + " ".join("xyz")), (2, None), (5, ""), (4, b), (4, b)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, sf).collect()]
    assert sorted(got, key=str) == sorted([(1, a), (2, b), (3, c), (None, "alone x y z"), (2, None), (5, "")], key=str)
