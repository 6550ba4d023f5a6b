"""Known cases: language-specific operators on fixed rows, with their known results. Tests hold the operators against them; the registered
queries of the same names (``computed``) run over whole tables."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..functions import legal, numerals, output
from ..functions import text as X
from ..operators import citations, evaluation, gates, redaction, structure
from .base import Query, spark_rows, values

#: Case by name: the query on fixed rows, and its known rows as SQL.
CASES_OF: dict[str, tuple[Query, str]] = {}


def query(sql: str, name: str | None = None):
    def keep(f: Query) -> Query:
        CASES_OF[name or f.__name__] = (f, sql)
        return f

    return keep



def golden(name: str, rows: list[tuple], column):
    """Query ``name``: ``column`` of each input text (rows: input, result as text)."""

    def run(spark, d):
        return spark_rows(spark, [(a,) for a, _ in rows], "input string").select("input", column(F.col("input")).alias("result"))

    query(values(rows, "input, result"), name)(run)


def joined(c):
    return F.array_join(c, "|")


golden("numerals", [("一", "1"), ("十一", "11"), ("一百零一", "101"), ("一千二百四十二", "1242"), ("二三", "3"), ("", None), ("〇", None), ("两", None), ("甲", None)], lambda c: numerals.numeral(c).cast("string"))
golden("article_numbers", [("第八十七条", "87"), ("87", "87"), ("第八十七条之一", "87之1"), ("87之1", "87之1"), ("第87条", None), ("第 八十七　条", "87"), ("八十七", None), ("", None)], numerals.article_number)
golden("mentioned_articles", [("第一百条与第100条", "100|100"), ("第八十七条之一、第一款", "87之1"), ("没有", "")], lambda c: joined(numerals.mentioned_articles(c)))
golden("doc_number_norm", [("中华人民共和国主席令第七十七号", "中华人民共和国主席令第77号"), ("国务院令 第７２２号", "国务院令第722号"), ("国发〔2020〕5号", "国发〔2020〕5号")], numerals.document_number)
golden("title_norm", [("《中华人民共和国劳动法》", "中华人民共和国劳动法"), ("中华人民共和国劳动法（2018年修正）（草案）", "中华人民共和国劳动法"), ("公司登记办法（试行）", "公司登记办法（试行）"), ("民 法典", "民法典")], legal.title)
golden("file_dates", [("中国法_20181229.docx", "2018-12-29"), ("a/b_20260231.pdf", None), ("无日期.txt", None)], lambda c: legal.file_date(c).cast("string"))
golden("rewrite_variants", [("社保欠缴怎么办？", "社保欠缴怎么办？|社保欠缴怎么办|社保欠缴|社会保险欠缴怎么办|社保不缴纳怎么办|社保拖欠怎么办|社会保险欠缴|社保不缴纳|社保拖欠"), ("怎么办", "怎么办"), ("ＡＢ　c", "ＡＢ　c|ABc")], lambda c: joined(X.query_variants(c)))
golden("query_terms", [("社会保险　缴费，基数；上限", "社会保险|缴费|基数|上限"), ("  ", ""), ("一", "一")], lambda c: joined(X.terms(c)))
golden("split_questions", [("工资怎么算？工伤谁来负责？", "工资怎么算？工伤谁来负责？"), ("劳动合同期限多长？社会保险费用多少", "劳动合同期限多长|社会保险费用多少"), ("怎么办？然后呢？", "怎么办？然后呢？"), ("", "")], lambda c: joined(X.split_questions(c)))
golden("vague_questions", [("怎么办", "true"), ("这个事情怎么处理", "true"), ("用人单位拖欠工资怎么办", "false")], lambda c: X.is_vague(c).cast("string"))
golden("personal_scope", [("我能不能领失业金", "我|能不能"), ("失业人员能不能领失业金", None), ("本人 有没有资格 申请", "本人|有没有资格")], lambda c: F.when(gates.personal_scope(c).isNotNull(), F.concat_ws("|", gates.personal_scope(c)["person"], gates.personal_scope(c)["judgement"])))
golden("aliases", [("中华人民共和国劳动法", "劳动法"), ("劳动法", "劳动法"), ("实施《中华人民共和国劳动法》办法", "实施《中华人民共和国劳动法》办法")], X.alias_of)
golden("clean_text", [("a \r\nb\t\r c  ", "a\nb\n c"), ("", ""), ("\n x \n", "x")], X.clean_text)
golden("string_lists", [("null", ""), ('"a"', "a"), ("[1, \"b\", null]", "1|b"), ("{\"a\": 1}", None)], lambda c: joined(output.string_list(c)))
golden("unsupported_numbers", [("期限5年、12个月", "12"), ("第100条 … 12.", "00|1"), ("3.5倍", "3.5")], lambda c: joined(gates.unsupported_numbers(c, F.lit("期限5年"))))

STATUTE = ["中华人民共和国某法", "目录", "第一章 总则", "第二章 附则", "第一章 总则", "第一条 为了规范。", "第二条 本法所称", "第十条规定的情形。", "第二章 附则", "第三条之一 另有。", "第三条 自公布之日起施行。"]


@query(values([(4, "chapter:1@4,article:1@5,article:2@6,chapter:2@8,article:3之1@9,article:3@10", "4-6,6-8,8-10,10-11", "")], "body_start, headings, segments, issues"))
def structure_outline(spark, d):
    o = spark_rows(spark, [(STATUTE,)], "t array<string>").select(structure.outline("t").alias("o"))
    return o.select("o.body_start", F.array_join(F.transform("o.headings", lambda h: F.concat(h["kind"], F.lit(":"), h["number"], F.lit("@"), h["block"])), ",").alias("headings"), F.array_join(F.transform("o.segments", lambda s: F.concat(s["first"], F.lit("-"), s["stop"])), ",").alias("segments"), F.array_join("o.issues", ",").alias("issues"))


@query(values([(0, 4, None), (1, 2, "第一章>第一条"), (2, 2, "第一章>第二条"), (3, 2, "第二章>第三条之一"), (4, 1, "第二章>第三条")], "ordinal, n_blocks, path"))
def structure_chunks(spark, d):
    c = spark_rows(spark, [(STATUTE,)], "t array<string>").select(F.explode(structure.structured_chunks("t")).alias("c"))
    path = lambda p: F.concat_ws(">", *[F.try_element_at(p, F.lit(k)) for k in ("part", "chapter", "section", "article")])
    return c.select("c.ordinal", (F.col("c.stop") - F.col("c.first")).alias("n_blocks"), F.when(F.col("c.path").isNotNull(), path(F.col("c.path"))).alias("path"))


@query("""SELECT '中华人民共和国社会保险法' AS title, 'law' AS instrument_type, '全国人民代表大会常务委员会' AS issuing_body, '中华人民共和国主席令第三十五号' AS document_number, '2018年修正' AS version_label, DATE '2018-12-29' AS promulgated_on, DATE '2011-07-01' AS effective_from, 'effective' AS legal_status, '' AS reasons
UNION ALL SELECT '某某登记办法', 'department_rule', '某部', NULL, '2020-01-02', DATE '2020-01-02', NULL, 'unknown', 'version_label_from_filename,title_from_filename'""")
def metadata_extract(spark, d):
    rows = [
        ("中华人民共和国社会保险法_20181229.docx", ["中华人民共和国社会保险法", "（2010年10月28日第十一届全国人民代表大会常务委员会第十七次会议通过　根据2018年12月29日决定修正）", "中华人民共和国主席令第三十五号", "自2011年7月1日起施行"]),
        ("某某登记办法_20200102.txt", ["某部关于印发通知"]),
    ]
    m = spark_rows(spark, rows, "f string, p array<string>").select(legal.metadata(F.col("f"), F.col("p"), F.lit(datetime.date(2026, 1, 1))).alias("m"))
    return m.select(*[f"m.{c}" for c in ("title", "instrument_type", "issuing_body", "document_number", "version_label", "promulgated_on", "effective_from", "legal_status")], F.array_join("m.low_confidence_reasons", ",").alias("reasons"))


@query(values([("10", None, "本法第十条至第十二条"), ("11", None, "本法第十条至第十二条"), ("12", None, "本法第十条至第十二条"), ("4", None, "前条"), ("87", "劳动合同法", "劳动合同法第八十七条"), ("87", "合同法", "合同法第八十七条")], "target, alias, evidence"))
def citations_extract(spark, d):
    rows = [("依照本法第十条至 第十二条、前条和劳动合同法第八十七条、第100条的规定", "5", ["中华人民共和国劳动合同法", "中华人民共和国合同法"])]
    c = spark_rows(spark, rows, "t string, n string, l array<string>").select(F.explode(citations.citations("t", "n", "l")).alias("c"))
    return c.select("c.*")


@query(values([("身份证[身份证_1]电话[电话_1]，[案号_1]，再[电话_1]", 3, 4)], "redacted, n_entities, n_spans"))
def redact_identifiers(spark, d):
    r = spark_rows(spark, [("身份证11010119900101123X电话13800138000，（2023）京01民终1234号，再13800138000",)], "t string").select(redaction.redact("t").alias("r"))
    return r.select("r.redacted", F.size("r.entities").alias("n_entities"), F.size("r.spans").alias("n_spans"))


RUNS = [
    (1, "劳动合同期限多长？社会保险费用多少", ["effective"], True, 1, 0, True, True, "passed"),
    (2, "怎么办", ["effective"], True, 1, 0, True, True, "passed"),
    (3, "劳动合同期限多长", [], True, 0, 0, True, True, "passed"),
    (4, "劳动合同期限多长", ["repealed", "not_yet_effective"], True, 1, 0, True, True, "passed"),
    (5, "我能不能领失业保险金", ["effective"], True, 1, 0, True, True, "passed"),
    (6, "劳动合同期限多长", ["effective"], False, 1, 0, True, True, "passed"),
    (7, "劳动合同期限多长", ["effective"], True, 0, 1, True, True, "passed"),
    (8, "劳动合同期限多长", ["effective"], True, 1, 0, False, True, "passed"),
    (9, "劳动合同期限多长", ["effective"], True, 1, 0, True, False, "passed"),
    (10, "劳动合同期限多长", ["effective"], True, 1, 0, True, True, "unavailable"),
    (11, "劳动合同期限多长", ["effective", "repealed"], True, 1, 1, True, True, "passed"),
    (12, "劳动合同期限多长", ["unknown"], True, 1, 0, True, True, "passed"),
]


@query(values([(1, "CLARIFYING", "clarifying"), (2, "CLARIFYING", "clarifying"), (3, "INSUFFICIENT_EVIDENCE", None), (4, "NEEDS_REVIEW", "status"), (5, "NEEDS_REVIEW", "scope"), (6, "FAILED", None), (7, "NEEDS_REVIEW", "budget"), (8, "NEEDS_REVIEW", "format"), (9, "NEEDS_REVIEW", "verification"), (10, "NEEDS_REVIEW", "semantics"), (11, "PARTIAL", None), (12, "ANSWERED", None)], "run_id, state, blocked_by"))
def gate_states(spark, d):
    rows = spark_rows(spark, RUNS, "run_id int, question string, statuses array<string>, model_up boolean, n_included int, n_excluded int, format_ok boolean, verified_ok boolean, review string")
    return gates.gate_states(rows).select("run_id", "state", "blocked_by")


@query(values([(1, None), (2, "over_generalized"), (3, "over_generalized"), (4, "unverifiable_quote"), (5, None)], "id, downgrade"))
def modal_overreach(spark, d):
    rows = [
        (1, True, "用人单位可以加收滞纳金", "可以加收滞纳金", ["逾期的，可以加收滞纳金。"]),
        (2, True, "应当加收滞纳金", "可以加收滞纳金", ["逾期的，可以加收滞纳金。"]),
        (3, True, "所有患者都能申请救助基金", "患者能申请救助基金", ["符合规定的患者能申请救助基金。"]),
        (4, True, "工资按月支付给本人", "每周支付一次工资", ["工资按月支付。"]),
        (5, False, "x", "y", ["z"]),
    ]
    r = spark_rows(spark, rows, "id int, supported boolean, claim string, quote string, cited array<string>")
    return r.select("id", gates.downgraded(F.col("supported"), F.col("claim"), F.col("quote"), F.col("cited")).alias("downgrade"))


@query(values([(1, 1, False, None), (2, 2, True, None), (3, None, False, "empty"), (4, None, True, "no_object"), (5, None, False, "bad_structure")], "id, n_claims, repaired, error"))
def claims_verify(spark, d):
    rows = [(1, '```json\n{"claims": [{"text": "a", "evidence_ids": [1]}], "missing_facts": null}\n```'), (2, 'so {"claims": [{"text": "a", "evidence_ids": "1"}]} and {"claims": [{"text": "b", "evidence_ids": []}]}'), (3, " "), (4, "none"), (5, '{"claims": [{"evidence_ids": [1]}]}')]
    c = spark_rows(spark, rows, "id int, raw string").select("id", output.claims_of("raw").alias("c"))
    return c.select("id", F.when(F.col("c.claims").isNotNull(), F.size("c.claims")).alias("n_claims"), "c.repaired", "c.error")


CASES = "id string, answer string, evidence array<struct<law:string,article:string>>, expect array<struct<law:string,article:string>>, required array<string>, forbidden array<string>, expect_abstain boolean, status_flag_required boolean, cited_ids array<string>, abstained boolean"
L = ("劳动法", "36")


def _cases(spark):
    rows = [
        ("a", "依据第三十六条，每日工作 八小时。", [L, ("劳动法", "44")], [L], ["八小时"], ["十小时"], False, False, None, None),
        ("b", "见第九十九条", [L], [L], ["八小时", "平均"], [], False, True, ["2", "9"], False),
        ("c", "依据不足，尚未生效", [], [], [], [], True, True, None, None),
    ]
    return evaluation.answer_scores(spark_rows(spark, rows, CASES))


@query(values([("a", 1.0, "", "", 1.0, False, True), ("b", 0.0, "99", "2,9", 0.0, False, True), ("c", None, "", "", None, True, True)], "id, citation_recall, unwarranted, unwarranted_ids, fact_coverage, abstained, abstain_correct"))
def answer_scores(spark, d):
    s = _cases(spark)
    return s.select("id", "citation_recall", F.array_join("unwarranted", ",").alias("unwarranted"), F.array_join("unwarranted_ids", ",").alias("unwarranted_ids"), "fact_coverage", "abstained", "abstain_correct")


@query(values([("abstain_accuracy", 1.0, 1.0, True), ("citation_recall", 0.5, 0.9, False), ("fact_coverage", 0.5, 0.8, False), ("forbidden_rate", 0.0, 0.1, True), ("no_fabrication_rate", 0.666667, 0.95, False), ("over_abstain_rate", 0.0, 0.15, True)], "metric, value, threshold, ok"))
def answer_summary(spark, d):
    limits = {"citation_recall": 0.9, "no_fabrication_rate": 0.95, "fact_coverage": 0.8, "forbidden_rate": 0.1, "abstain_accuracy": 1.0, "over_abstain_rate": 0.15}
    return evaluation.against_thresholds(evaluation.answer_summary(_cases(spark)), limits).withColumn("value", F.round("value", 6))


@query(values([("first", 3, 0.5, 1.0), ("second", 2, 1.0, 0.0)], "batch, n, defect_detection, acceptance"))
def judge_rates(spark, d):
    rows = [("first", False, False), ("first", False, True), ("first", True, True), ("second", False, None), ("second", True, None)]
    return evaluation.judge_rates(spark_rows(spark, rows, "batch string, expect_supported boolean, supported boolean"), "batch")


@query(values([("x", "repeated_id"), ("x", "repeated_id,unknown_category,expected_outside_evidence"), ("y", "abstain_with_citations,unknown_abstain_kind")], "id, problems"))
def gold_set_problems(spark, d):
    rows = [("x", "grounded", "q", ["e"], ["e"], False, None), ("x", "odd", "q", ["e"], ["f"], False, None), ("y", "abstain", "q", ["e"], ["e"], True, None), ("z", "abstain", "q", [], [], True, "irrelevant")]
    return evaluation.case_problems(spark_rows(spark, rows, "id string, category string, question string, evidence array<string>, expect array<string>, expect_abstain boolean, abstain_kind string")).select("id", F.array_join("problems", ",").alias("problems"))


@query(values([("b",)], "backend"))
def parser_choice(spark, d):
    rows = [("a", True, True, 1.0, 9.0, 10.0), ("b", True, True, 0.9, 2.0, 20.0), ("c", True, False, 1.0, 1.0, 5.0)]
    return evaluation.recommended(evaluation.parser_checks(spark_rows(spark, rows, "backend string, contiguous boolean, round_trip boolean, coverage double, seconds double, memory_mb double")))


@query(values([(1, 0.142857, 0.1)], "id, iou, left_edge"))
def page_boxes(spark, d):
    a = X.box_on_page(*[F.lit(float(v)) for v in (10, 10, 30, 30, 100, 100)])
    b = X.box_on_page(*[F.lit(float(v)) for v in (40, 40, 20, 20, 100, 100)])
    return spark.range(1).select(F.lit(1).alias("id"), F.round(X.box_overlap(a, b), 6).alias("iou"), F.round(a[0], 6).alias("left_edge"))


@query(values([("[1] 劳动法 第三十六条（现行有效）\n正文\n\n[2] 旧法 9（已被取代）\n旧文", "1. 主张（劳动法第三十六条、2）\n2. 无据")], "evidence, answer"))
def rendered_answer(spark, d):
    hits = [(("劳动法", "第三十六条", "36", "effective", "正文"), ("旧法", None, "9", "repealed", "旧文"))]
    h = spark_rows(spark, [(list(hits[0]), [("主张", ["1", "2"]), ("无据", [])])], "h array<struct<title:string,display:string,number:string,legal_status:string,text:string>>, c array<struct<text:string,evidence_ids:array<string>>>")
    return h.select(output.evidence_block(F.col("h")).alias("evidence"), output.rendered(F.col("c"), F.create_map(F.lit("1"), F.lit("劳动法第三十六条"))).alias("answer"))
