"""Functions against brute force and known results."""

import io
import re
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textstrata.functions import legal, numerals, output
from textstrata.functions import text as X
from textstrata.functions.values import DIGITS
from textstrata.operators import citations, corpus, gates, redaction, search, structure
from textstrata.sources import files


def test_numerals_agree_up_to_9999(spark):
    def written(n):
        out, gap = "", False
        for unit, sign in ((1000, "千"), (100, "百"), (10, "十"), (1, "")):
            d, n = divmod(n, unit)
            if d:
                out += ("零" if gap and out else "") + DIGITS[d] + sign
                gap = False
            else:
                gap = True
        return out

    rows = [(n, written(n)) for n in range(1, 10000, 7)]
    got = spark.createDataFrame(rows, "n int, t string").select("n", numerals.numeral(F.col("t")).alias("v")).collect()
    assert all(r.n == r.v for r in got)
    assert all(structure.value_of(t) == n for n, t in rows)


def brute_extent(needle, text):
    grams = lambda t: [p[i : i + 3] for w in re.findall(r"[^\W_]+", t.lower()) for p in [f"  {w} "] for i in range(len(p) - 2)]
    a, b = set(grams(needle)), grams(text)
    best = 0.0
    for i in range(len(b)):
        for j in range(i + 1, len(b) + 1):
            run = set(b[i:j])
            best = max(best, len(a & run) / len(a | run))
    return best


@settings(max_examples=100, deadline=None)
@given(st.text("ab c", max_size=12), st.text("abc d", max_size=18))
def test_best_extent_is_brute_force(needle, text):
    assert abs(X.best_extent(needle, text) - brute_extent(needle, text)) < 1e-12


@settings(max_examples=200, deadline=None)
@given(st.text("1380（）2023京1号[] ab\n", max_size=60))
def test_redaction_restores_and_slices_join(text):
    r = redaction.redact_text(text)
    if "[" not in text:
        assert redaction.restore_text(r["redacted"], r["entities"]) == text
    for cut in range(len(text) + 1):
        assert redaction.slice_text(text, r["spans"], 0, cut) + redaction.slice_text(text, r["spans"], cut, len(text)) == r["redacted"]


def test_redaction_longest_placeholder_first():
    numbers = [f"138{n:08d}" for n in range(12)]
    r = redaction.redact_text(" ".join(numbers))
    assert "[电话_11]" in r["redacted"] and redaction.restore_text(r["redacted"], r["entities"]) == " ".join(numbers)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["第一章 总则", "第一条 甲。", "第二条 乙。", "第三条 丙", "正文。", "第二章 附则", "第五条、第六条"]), max_size=12))
def test_segments_cover_the_body(texts):
    o = structure.outline_of(texts)
    if o["segments"]:
        assert [s["first"] for s in o["segments"]][0] >= o["body_start"] and o["segments"][-1]["stop"] == len(texts)
        assert all(a["stop"] == b["first"] for a, b in zip(o["segments"], o["segments"][1:]))


@given(st.lists(st.integers(0, 1000), max_size=30))
def test_chunks_are_greedy(sizes):
    numbers = structure.chunk_numbers(sizes)
    assert numbers == sorted(numbers)
    for k in set(numbers):
        own = [s for s, n in zip(sizes, numbers) if n == k]
        assert sum(own) <= 800 or len([s for s in own if s]) == 1 or sum(own[:-1]) == 0


def test_blocks_keep_offsets(spark):
    rows = spark.createDataFrame([(1, " a \r\n\n b\rc"), (2, None), (3, "")], "k int, t string").select("k", structure.text_blocks("t").alias("b")).collect()
    got = {r.k: r.b for r in rows}
    text = "a\nb\nc"
    assert [(b.text, b.block_id) for b in got[1]] == [("a", "l0"), ("b", "l2"), ("c", "l3")]
    assert all(text[b.char_start : b.char_end] == b.text for b in got[1]) and got[2] == got[3] == []


def test_html_leaves():
    page = "<html><body>x<div><p>a<p>b &amp; <b>c</b></div><table><tr><td>1<td>2</table><h2>T</h2><script>no</script><pre>p</pre></body></html>"
    blocks = files.html_as_blocks(page)
    assert [(b["kind"], b["text"], b["level"]) for b in blocks] == [("paragraph", "a", None), ("paragraph", "b & c", None), ("table_cell", "1", None), ("table_cell", "2", None), ("heading", "T", 2), ("preformatted", "p", None)]
    assert files.html_as_blocks("a\0b") == [] and files.html_as_blocks(None) == []


def docx(body, extra=()):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
        z.writestr("word/styles.xml", f'<w:styles xmlns:w="{w}"><w:style w:styleId="h"><w:name w:val="heading 2"/></w:style></w:styles>')
        for name in extra:
            z.writestr(name, "x")
    return out.getvalue()


def test_docx_blocks_and_safety():
    p = lambda t, s="": f"<w:p>{s}<w:r><w:t>{t}</w:t></w:r></w:p>"
    content = docx(p("T", '<w:pPr><w:pStyle w:val="h"/></w:pPr>') + p("a") + p(" ") + f"<w:tbl><w:tr><w:tc>{p('1')}</w:tc><w:tc>{p('2')}</w:tc></w:tr></w:tbl>")
    assert [(b["kind"], b["text"], b["block_id"], b["level"]) for b in files.docx_as_blocks(content)] == [("heading", "T", "p0", 2), ("paragraph", "a", "p1", None), ("table_cell", "1", "t0r0c0", None), ("table_cell", "2", "t0r0c1", None)]
    assert files.docx_problem(content) is None
    assert files.docx_problem(docx("", ["word/vbaProject.bin"])) == "active_content"
    assert files.docx_problem(docx("", ["a0" + str(i) for i in range(1001)])) == "too_many_entries"
    assert files.docx_problem(b"PK\x03\x04") == "not_docx"


def test_import_rules(spark):
    rows = [("a.txt", b"hello"), ("a.html", b"<!DOCTYPE html><p>x"), ("a.pdf", b"%PDF-1.7 /JavaScript x"), ("b.pdf", b"%PDF-1.7 ok"), ("a.docx", docx("")), ("c.txt", b"\xff"), ("d.txt", b"a\0"), ("e.exe", b"x"), ("f.txt", b""), ("...", b"x"), ("g.txt", b"<html >")]
    got = {r.path: r.reason for r in files.accepted(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got == {"a.txt": None, "a.html": None, "a.pdf": "active_content", "b.pdf": None, "a.docx": None, "c.txt": "not_utf8", "d.txt": "not_utf8", "e.exe": "unknown_extension", "f.txt": "empty", "...": "no_name", "g.txt": "type_differs"}


def test_parse_dispatch(spark):
    rows = [("a.txt", b"x\ny", files.TEXT), ("b.html", b"<p>z", files.HTML), ("c.pdf", b"%PDF-", files.PDF), ("d.docx", b"no zip", files.DOCX)]
    got = {r.path: (len(r.blocks), r.error) for r in files.parsed(spark.createDataFrame(rows, "path string, content binary, media_type string")).collect()}
    assert got == {"a.txt": (2, None), "b.html": (1, None), "c.pdf": (0, "no_parser"), "d.docx": (0, "unreadable")}


def test_directory_and_sets(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("abc")
    (tmp_path / "in" / "b.txt").write_text("x" * 100)
    got = {r.path.rsplit("/", 1)[1]: (r.content is None, r.reason) for r in files.directory(spark, str(tmp_path / "in"), most_bytes=50).collect()}
    assert got == {"a.txt": (False, None), "b.txt": (True, "too_large")}
    (tmp_path / "g.json").write_text('{"version": 1,\n "queries": [{"id": "q1", "terms": ["a"]}]}')
    gold = files.json_set(spark, str(tmp_path / "g.json"), "queries")
    assert gold.collect()[0].id == "q1"
    files.report(gold, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_encoder_and_reranker_are_injected(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None)], "k long, text string")
    got = {r.k: (r.dimensions, list(r.embedding)) for r in files.embedded(df, lambda texts: [[3.0 * len(t), 4.0 * len(t)] for t in texts], "k").collect()}
    assert got[1][0] == 2 and abs(got[1][1][0] - 0.6) < 1e-6 and got[2] == (2, [0.0, 0.0])
    scored = files.reranked(df.selectExpr("'q' AS query", "coalesce(text, '') AS text"), lambda pairs: [float(len(t)) for _, t in pairs])
    assert sorted(r.score for r in scored.collect()) == [0.0, 2.0]


def test_search_query_rules():
    with pytest.raises(ValueError):
        search.Query(keyword="a", semantic="b")
    with pytest.raises(ValueError):
        search.Query(instrument_types=("odd",))


def test_like_metacharacters_stay_wildcards(spark):
    df = spark.createDataFrame([(1, "abc"), (2, "a%c")], "doc_id int, text string")
    assert [r.doc_id for r in search.keyword(df, "a_c", "substring_raw").orderBy("doc_id").collect()] == [1, 2]
    assert search.keyword(df, "  ", "all_terms_flat").count() == 0
    assert [r.doc_id for r in search.keyword(df, "a", "all_terms_flat", limit=1).collect()] == [1, 2]


def test_json_answers():
    assert output.parse_claims('```json\n[{"claims":[{"text":"a","evidence_ids":[1]}]},{"claims":[{"text":"b"}]}]\n```')["claims"] == [{"text": "a", "evidence_ids": ["1"]}, {"text": "b", "evidence_ids": []}]
    assert output.parse_claims(None)["error"] == "empty"


def test_verdict_batches_are_all_or_nothing(spark):
    raw = [('{"reviews":[{"index":2,"supported":true},{"index":1,"supported":false}]}', 2), ('{"reviews":[{"index":1,"supported":true}]}', 2), ('{"reviews":[{"index":1,"supported":true},{"index":1,"supported":true}]}', 2), ("no", 1)]
    got = [r.v for r in spark.createDataFrame(raw, "t string, n int").select(output.verdict_batch(F.col("t"), F.col("n")).alias("v")).collect()]
    assert [x.supported for x in got[0]] == [False, True] and got[1:] == [None, None, None]


def test_transitions_close():
    known = set(gates.TRANSITIONS)
    ends = {"ANSWERED", "PARTIAL", "NEEDS_REVIEW", "FAILED", "INSUFFICIENT_EVIDENCE"}
    assert {x for after in gates.TRANSITIONS.values() for x in after} <= known | ends


def test_greedy_budget():
    assert gates.take_greedily([5, 10, 3], 9) == [True, False, True] and gates.take_greedily([0], -1) == [False]


def test_quotes(spark):
    held = "社会救助 分为若干种类。"
    rows = [
        (1, "《法》第十五条 社会救助分为若干种", [held], True), (2, "工资", ["工资"], False), (3, "从未出现的一句话", ["别的文字"], False),
        (4, "别的；社会救助分为若干；别的", [None, held], True), (5, "别的；社会救助分；别的", [held], False), (6, "《法》第十五条第一条", [held], True), (7, "《法》第十五条", [], False),
        (8, None, [held], False), (9, "社会救助分为", None, False), (10, "《法》短。句", ["前《法》短。句后"], True), (11, "（第五条）《法》第五条之1分为若干种类", [held], True),
    ]
    df = spark.createDataFrame([r[:3] for r in rows], "id int, quote string, texts array<string>")
    got = {r.id: r.found for r in df.select("id", gates.quote_in_evidence(F.col("quote"), F.col("texts")).alias("found")).collect()}
    assert got == {r[0]: r[3] for r in rows}


def test_slices_show_no_value():
    text = "电话13800138000，又13900139000完"
    r = redaction.redact_text(text)
    for a in range(len(text) + 1):
        for b in range(a, len(text) + 1):
            part = redaction.slice_text(text, r["spans"], a, b)
            assert not any(c.isdigit() for c in part.replace("_1]", "").replace("_2]", "")), part
            assert part.count("[") == sum(a <= s["start"] < b for s in r["spans"])
    assert redaction.slice_text(text, r["spans"], 5, 5) == ""


def test_citation_window_stops():
    assert citations.extract("本法。第十条", None, []) == []
    assert [c["target"] for c in citations.extract("本法第十条、第十二条", None, [])] == ["10", "12"]
    assert citations.extract("前条", "1", []) == [] and citations.extract(None, None, ["法"]) == []


def test_dates_that_do_not_exist(spark):
    got = spark.createDataFrame([("x_20230229.txt",), ("x_20240229.txt",)], "f string").select(legal.file_date(F.col("f")).alias("d")).collect()
    assert [str(r.d) for r in got] == ["None", "2024-02-29"]


def test_same_day_versions_do_not_supersede(spark):
    rows = [(1, 1, "effective", "2020-01-01", "2020-01-01"), (2, 1, "not_yet_effective", "2020-01-01", "2021-01-01"), (3, 1, "effective", None, None), (4, 2, "effective", "2000-01-01", None), (5, 2, "effective", "2010-01-01", None)]
    v = spark.createDataFrame(rows, "version_id int, instrument_id int, legal_status string, p string, e string").selectExpr("version_id", "instrument_id", "legal_status", "cast(p AS date) AS promulgated_on", "cast(e AS date) AS effective_from")
    got = {r.version_id: r.new_status for r in corpus.recomputed(v, F.lit("2022-01-01").cast("date")).collect()}
    assert got == {1: "effective", 2: "effective", 3: "effective", 4: "effective", 5: "effective"}


def test_gate_columns(spark):
    """Claims in order, foreign laws and articles, quotes, review outcomes, references, settings, publication."""
    from textstrata.operators import evaluation

    one = spark.range(1)
    claims = F.array(F.struct(F.lit("a").alias("text"), F.array(F.lit("1"), F.lit("2")).alias("evidence_ids")))
    got = one.select(
        gates.claims_in_order(claims, F.lit(2)).alias("ok"), gates.claims_in_order(claims, F.lit(1)).alias("beyond"), gates.claims_in_order(claims, F.lit(0)).alias("none"),
        gates.foreign_articles(F.lit("第八十七条、第九条、第三条"), F.array(F.lit("9")), F.lit("见第3条")).alias("articles"),
        gates.foreign_laws(F.lit("依《刑法》第十条；见《刑法》。《中华人民共和国民法典》第一条"), F.array(F.lit("民法典"))).alias("laws"),
        gates.unsupported_quotes(F.lit("「这是一句原文里没有的话啊」「短」「原文里有的这一句话在此」「有省略…号的一句很长的话」"), F.lit("原文里有的这一句话在此")).alias("quotes"),
        F.array(*[gates.review_outcome(F.array(*[F.lit(v).cast("boolean") for v in vs]) if vs else F.array().cast("array<boolean>")) for vs in ([], [True], [True, False], [True, None])]).alias("reviews"),
        gates.evidence_refs(F.array(F.struct(F.lit("x").alias("id"), F.lit("effective").alias("legal_status")), F.struct(F.lit("y").alias("id"), F.lit("unknown").alias("legal_status"))), F.array(F.lit("2"))).alias("refs"),
        gates.merged_config(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("1")), F.create_map(F.lit("b"), F.lit("2"))).alias("config"),
        F.array(gates.published(F.lit("m"), F.lit(None)), gates.published(F.lit("m"), F.lit("scope")), gates.published(F.lit(None), F.lit(None))).alias("published"),
    ).first()
    assert (got.ok, got.beyond, got.none) == (True, False, False)
    assert got.articles == ["87"] and got.laws == ["刑法"] and got.quotes == ["这是一句原文里没有的话啊"]
    assert got.reviews == ["passed", "passed", "failed", "unavailable"] and [r.cited for r in got.refs] == [False, True]
    assert got.config == {"a": "1", "b": "2"} and got.published == [True, False, False]
    groups = spark.createDataFrame([("g", [("c1", True), ("c2", False)])], "id string, claims array<struct<claim:string,expect_supported:boolean>>")
    assert [(r.id, r.position, r.claim) for r in evaluation.flattened_groups(groups).collect()] == [("g", 0, "c1"), ("g", 1, "c2")]


def test_span_of_article(spark):
    df = spark.createDataFrame([("第一章\n第一条 甲\n乙", "第一条", 3), ("x", "第二条", 3), ("a\nb\n第三条", "第三条", 1)], "t string, l string, n int")
    assert [r.s for r in df.select(structure.span_of_article(F.col("t"), F.col("l"), F.col("n")).alias("s")).collect()] == [1, 0, 0]


def test_evidence_merges_only_unknowns(spark):
    df = spark.createDataFrame([("unknown", "effective"), ("effective", "repealed"), (None, None)], "old string, new string")
    assert [r.v for r in df.select(corpus.merged_evidence("old", "new").alias("v")).collect()] == ["effective", "effective", None]


def test_metadata_reads_a_text_a_fixed_number_of_times(spark):
    """Values that the rules name several times are computed once: the plan's text would else hold them thousands of times."""
    m = spark.createDataFrame([("a", ["b"])], "f string, p array<string>").select(legal.metadata(F.col("f"), F.col("p"), F.current_date()).alias("m"))
    plan = m._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract_all(") <= 10


def test_first_label_of_a_page_with_ties(spark):
    """Of blocks that begin at the same place the last in the table gives the label; blocks without a label or place give none."""
    rows = [(1, 1, 5, 9, "a", 0), (1, 1, 5, 7, "b", 2), (1, 1, 5, 8, "c", 1), (1, 1, 4, 6, None, 3), (1, 1, None, 6, "d", 4), (1, 2, 3, 4, None, 5)]
    blocks = spark.createDataFrame(rows, "doc int, page int, char_start int, char_end int, label string, place int")
    pages = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "doc int, page int")
    got = structure.page_geometry(blocks, pages).orderBy("page").collect()
    assert [tuple(r) for r in got] == [(1, 1, 4, 9, "b"), (1, 2, 3, 4, None), (1, 3, None, None, None)]


def test_a_batch_is_seen_in_bounded_slices(spark, monkeypatch):
    """A function over long texts has few of them as Python objects at a time; results are those of the whole batch, nulls included."""
    from textstrata.functions import arrow

    @arrow.arrow_udf("struct<n:int,seen:int,p:map<string,string>>")
    def told(text, parts):
        return arrow.pd.DataFrame([(len(t or "") + len(p if p is not None else []), len(text), {"a": t}) for t, p in zip(text, parts, strict=True)], columns=["n", "seen", "p"])

    rows = spark.range(40).repartition(1).select("id", F.when(F.col("id") % 7 != 0, F.repeat(F.lit("x"), 100_000)).alias("t"), F.when(F.col("id") % 5 != 0, F.array(F.lit("a"), F.lit("b"))).alias("p"))
    got = rows.select("id", told("t", "p").alias("r")).collect()
    assert {r.id: r.r.n for r in got} == {i: (100_000 if i % 7 else 0) + (2 if i % 5 else 0) for i in range(40)}
    assert all(r.r.p == {"a": "x" * 100_000 if r.id % 7 else None} for r in got)
    assert max(r.r.seen for r in got) <= 7


def test_trigrams_are_made_once_a_text(spark):
    likeness = X.jaccard(X.trigrams(F.col("t")), X.trigrams(F.lit("ab")))
    rows = spark.createDataFrame([("ab ab abc",), ("",), (None,)], "t string")
    assert rows.select(likeness.alias("s"))._jdf.queryExecution().analyzed().toString().count("lower(t") == 1
    # ab: two blanks and a, blank and ab, ab and blank; abc shares the first two
    assert [r.s for r in rows.select(likeness.alias("s")).collect()][:2] == [3 / 5, 0.0]


def test_variants_normalise_a_query_once(spark):
    v = spark.createDataFrame([("社保 怎么办？",)], "q string").select(X.query_variants(F.col("q")).alias("v"))
    assert v._jdf.queryExecution().analyzed().toString().count("translate(") == 1
