"""Language-specific operators over whole tables: texts are built from a table's columns, and SQL computes what the operators find in them."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import legal, numerals, output
from ..functions import text as X
from ..functions.values import DIGITS
from ..operators import citations, evaluation, gates, redaction, structure
from .base import query, spread, table


def said(n: Column) -> Column:
    """A number of 1 to 999 as a numeral."""
    digit = lambda x: F.substr(F.lit(DIGITS), x.cast("int") + 1, F.lit(1))
    hundreds, tens, ones = F.floor(n / 100), F.floor(n / 10) % 10, n % 10
    return F.concat(
        F.when(hundreds > 0, F.concat(digit(hundreds), F.lit("百"))).otherwise(""),
        F.when(tens > 0, F.concat(digit(tens), F.lit("十"))).when((hundreds > 0) & (ones > 0), "零").otherwise(""),
        F.when(ones > 0, digit(ones)).otherwise(""),
    )


def text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def piped(c: Column) -> Column:
    return F.array_join(c, "|")


def order() -> Column:
    return F.col("o_orderkey")


def part() -> Column:
    return F.col("p_partkey")


def name_of() -> Column:
    """The part's name without blanks."""
    return F.replace(F.col("p_name"), F.lit(" "), F.lit(""))


@query("SELECT p_partkey, (p_partkey % 999 + 1)::INT AS value FROM part", "numerals")
def numerals_of(spark, d):
    return table(spark, d, "part").select("p_partkey", numerals.numeral(said(part() % 999 + 1)).cast("int").alias("value"))


@query("SELECT o_orderkey, (o_orderkey % 300 + 1) || CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE '之' || o_orderkey % 4 END AS number FROM orders", "article_numbers")
def article_numbers(spark, d):
    named = text("第 ", said(order() % 300 + 1), "条", F.when(order() % 4 > 0, text("之", said(order() % 4))).otherwise(""))
    plain = text((order() % 300 + 1).cast("string"), F.when(order() % 4 > 0, text("之", (order() % 4).cast("string"))).otherwise(""))
    return table(spark, d, "orders").select("o_orderkey", numerals.article_number(F.when(order() % 3 == 0, plain).otherwise(named)).alias("number"))


@query("SELECT o_orderkey, (o_orderkey % 500 + 1) || '|' || (o_orderkey % 700 + 1) || '之' || (o_orderkey % 9 + 1) AS numbers FROM orders", "mentioned_articles")
def mentioned_articles(spark, d):
    t = text("依照第", said(order() % 500 + 1), "条与第", (order() % 700 + 1).cast("string"), "条之", said(order() % 9 + 1), "，以及第甲条。")
    return table(spark, d, "orders").select("o_orderkey", piped(numerals.mentioned_articles(t)).alias("numbers"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '国务院令第' || (p_partkey % 999 + 1) || '号' ELSE '国发〔2020〕' || p_partkey || '号' END AS number FROM part", "doc_number_norm")
def doc_number_norm(spark, d):
    t = F.when(part() % 2 == 0, text("国务院令 第", said(part() % 999 + 1), "号")).otherwise(text("国发〔２０２０〕 ", part().cast("string"), "号"))
    return table(spark, d, "part").select("p_partkey", numerals.document_number(t).alias("number"))


@query("SELECT p_partkey, '中华人民共和国' || replace(p_name, ' ', '') || '法' || CASE WHEN p_partkey % 3 = 1 THEN '（试行）' ELSE '' END AS title FROM part", "title_norm")
def title_norm(spark, d):
    end = F.when(part() % 3 == 0, "（2018年修正）（草案）").when(part() % 3 == 1, "（试行）").otherwise("")
    return table(spark, d, "part").select("p_partkey", legal.title(text("《中华人民共和国", F.col("p_name"), "法", end, "》")).alias("title"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders", "file_dates")
def file_dates(spark, d):
    name = F.when(order() % 10 == 0, "a/法_20260231.pdf").when(order() % 5 == 0, "无日期.txt").otherwise(text("a/法_", F.date_format("o_orderdate", "yyyyMMdd"), ".docx"))
    return table(spark, d, "orders").select("o_orderkey", legal.file_date(name).cast("string").alias("day"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE '实施《中华人民共和国' || p_name || '》办法' END AS alias FROM part", "aliases")
def aliases(spark, d):
    law = text("中华人民共和国", F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", X.alias_of(F.when(part() % 2 == 0, law).otherwise(text("实施《", law, "》办法"))).alias("alias"))


@query("SELECT doc_id, sha256(trim(array_to_string(list_transform(string_split(text, chr(10)), lambda x: rtrim(x)), chr(10)), ' ' || chr(10))) AS text_sha256 FROM documents", "clean_text")
def clean_text(spark, d):
    """Documents with other line ends and blanks before them."""
    return table(spark, d, "documents").select("doc_id", F.sha2(X.clean_text(F.replace("text", F.lit("\n"), F.lit(" \t\r\n"))), 256).alias("text_sha256"))


@query("SELECT p_partkey, replace(p_name, ' ', '|') || '|' || replace(p_type, ' ', '|') || '|' || p_brand AS terms FROM part", "query_terms")
def query_terms(spark, d):
    t = text(" ", F.replace(F.col("p_name"), F.lit(" "), F.lit("，")), "；", F.replace(F.col("p_type"), F.lit(" "), F.lit("　")), " 、", F.col("p_brand"), "，")
    return table(spark, d, "part").select("p_partkey", piped(X.terms(t)).alias("terms"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN p_name WHEN 2 THEN p_partkey || '|' || p_name END AS items FROM part", "string_lists")
def string_lists(spark, d):
    raw = F.when(part() % 4 == 0, "null").when(part() % 4 == 1, text('"', F.col("p_name"), '"')).when(part() % 4 == 2, text("[", part().cast("string"), ', "', F.col("p_name"), '", null]')).otherwise(text('{"a": "', F.col("p_name"), '"}'))
    return table(spark, d, "part").select("p_partkey", piped(output.string_list(raw)).alias("items"))


@query("SELECT o_orderkey, CASE WHEN contains('期限' || (o_orderkey % 50 + 1) || '年', (o_orderkey % 70 + 1)::VARCHAR) THEN '' ELSE (o_orderkey % 70 + 1)::VARCHAR END AS numbers FROM orders", "unsupported_numbers")
def unsupported_numbers(spark, d):
    known = text("期限", (order() % 50 + 1).cast("string"), "年")
    return table(spark, d, "orders").select("o_orderkey", piped(gates.unsupported_numbers(text(known, "、", (order() % 70 + 1).cast("string"), "个月"), known)).alias("numbers"))


# Questions about parts.
@query("SELECT p_partkey, p_partkey % 3 = 0 AS vague FROM part", "vague_questions")
def vague_questions(spark, d):
    return table(spark, d, "part").select("p_partkey", X.is_vague(F.when(part() % 3 == 0, "这个事情怎么处理？").otherwise(text(F.col("p_name"), "怎么办"))).alias("vague"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name || '期限多长|' || p_type || '费用多少' ELSE p_name || '怎么算？谁来负责？' END AS questions FROM part", "split_questions")
def split_questions(spark, d):
    q = F.when(part() % 2 == 0, text(F.col("p_name"), "期限多长？ ", F.col("p_type"), "费用多少；怎么办")).otherwise(text(F.col("p_name"), "怎么算？谁来负责？"))
    return table(spark, d, "part").select("p_partkey", piped(X.split_questions(q)).alias("questions"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '我|能不能' WHEN 1 THEN '本人|有没有资格' END AS scope FROM part", "personal_scope")
def personal_scope(spark, d):
    q = F.when(part() % 3 == 0, text("我能不能领", F.col("p_name"))).when(part() % 3 == 1, text("本人 有没有资格 申请", F.col("p_name"))).otherwise(text(F.col("p_name"), "人员能不能领"))
    s = gates.personal_scope(q)
    return table(spark, d, "part").select("p_partkey", F.when(s.isNotNull(), F.concat_ws("|", s["person"], s["judgement"])).alias("scope"))


@query("""WITH p AS (SELECT p_partkey, replace(p_name, ' ', '') AS n FROM part)
SELECT p_partkey, '社保' || n || '怎么办？|社保' || n || '怎么办|社保' || n || '|社会保险' || n || '怎么办|社会保险' || n AS variants FROM p""", "rewrite_variants")
def rewrite_variants(spark, d):
    return table(spark, d, "part").select("p_partkey", piped(X.query_variants(text("社保", name_of(), "怎么办？"))).alias("variants"))


# Statutes built from parts: a title, two chapters, p_size % 6 + 1 articles and a last one, whose number leaves one out for each third part.
def _statutes(spark, d):
    k = F.col("p_size") % 6 + 1
    middle = F.transform(F.sequence(F.lit(1), k), lambda i: text("第", said(i), "条 为了", F.col("p_name"), "。"))
    last = text("第", said(k + F.when(part() % 3 == 0, 2).otherwise(1)), "条 自公布之日起施行。")
    blocks = F.concat(F.array(text("中华人民共和国", name_of(), "法"), F.lit("第一章 总则")), middle, F.array(F.lit("第二章 附则"), last))
    # parsing costs far more than reading
    return spread(table(spark, d, "part").select("p_partkey", "p_name", "p_size")).select("p_partkey", blocks.alias("blocks"))


_STATUTES = "WITH s AS (SELECT p_partkey, (p_size % 6 + 1)::INT AS k, (p_size % 6 + 1 + CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END)::INT AS m FROM part)"


@query(_STATUTES + """, c AS (SELECT *, list_concat([1], range(3, k + 3)) AS a, list_concat(range(3, k + 3), [k + 4]) AS b FROM s)
SELECT p_partkey, 1 AS body_start, 'chapter:1@1,' || array_to_string(list_transform(range(1, k + 1), lambda i: 'article:' || i || '@' || (i + 1)), ',') || ',chapter:2@' || (k + 2) || ',article:' || m || '@' || (k + 3) AS headings,
  array_to_string(list_transform(range(1, len(a) + 1), lambda i: a[i] || '-' || b[i]), ',') AS segments, CASE WHEN m > k + 1 THEN '条号不连续：期望 ' || (k + 1) || '，实际 ' || m ELSE '' END AS issues FROM c""", "structure_outline")
def structure_outline(spark, d):
    o = _statutes(spark, d).select("p_partkey", structure.outline("blocks").alias("o"))
    return o.select("p_partkey", "o.body_start", F.array_join(F.transform("o.headings", lambda h: F.concat(h["kind"], F.lit(":"), h["number"], F.lit("@"), h["block"])), ",").alias("headings"), F.array_join(F.transform("o.segments", lambda s: F.concat(s["first"], F.lit("-"), s["stop"])), ",").alias("segments"), F.array_join("o.issues", ",").alias("issues"))


@query(_STATUTES + """, r AS (SELECT p_partkey, k, m, unnest(range(0, k + 2)) AS ordinal FROM s)
SELECT p_partkey, ordinal::INT AS ordinal, CASE WHEN ordinal IN (1, k + 1) THEN 2 ELSE 1 END AS n_blocks,
  CASE WHEN ordinal = 0 THEN NULL WHEN ordinal <= k THEN '第一章>第' || substr('零一二三四五六七八九', ordinal::INT + 1, 1) || '条' ELSE '第二章>第' || substr('零一二三四五六七八九', m + 1, 1) || '条' END AS path FROM r""", "structure_chunks")
def structure_chunks(spark, d):
    c = _statutes(spark, d).select("p_partkey", F.explode(structure.structured_chunks("blocks")).alias("c"))
    path = lambda p: F.concat_ws(">", *[F.try_element_at(p, F.lit(k)) for k in ("part", "chapter", "section", "article")])
    return c.select("p_partkey", "c.ordinal", (F.col("c.stop") - F.col("c.first")).alias("n_blocks"), F.when(F.col("c.path").isNotNull(), path(F.col("c.path"))).alias("path"))


@query("""SELECT o_orderkey, (o_orderkey % 300 + 1 + unnest([0, 1, 2]))::VARCHAR AS target, NULL::VARCHAR AS alias FROM orders
UNION ALL SELECT o_orderkey, (o_orderkey % 90 + 1)::VARCHAR, '合同法' FROM orders
UNION ALL SELECT o_orderkey, (o_orderkey % 90 + 1)::VARCHAR, '劳动合同法' FROM orders WHERE o_orderkey % 2 = 0
UNION ALL SELECT o_orderkey, (o_orderkey % 40 + 1)::VARCHAR, NULL FROM orders WHERE o_orderkey % 40 > 0 AND o_orderkey % 40 + 1 NOT BETWEEN o_orderkey % 300 + 1 AND o_orderkey % 300 + 3""", "citations_extract")
def citations_extract(spark, d):
    law = F.when(order() % 2 == 0, "劳动合同法").otherwise("合同法")
    t = text("依照本法第", said(order() % 300 + 1), "条至 第", said(order() % 300 + 3), "条、前条和", law, "第", said(order() % 90 + 1), "条、第100甲条的规定")
    titles = F.array(F.lit("中华人民共和国劳动合同法"), F.lit("中华人民共和国合同法"))
    c = spread(table(spark, d, "orders").select("o_orderkey")).select("o_orderkey", F.explode(citations.citations(t, F.when(order() % 40 > 0, (order() % 40 + 2).cast("string")), titles)).alias("c"))
    return c.select("o_orderkey", "c.target", "c.alias")


@query("""SELECT c_custkey, c_name || '电话[电话_1]，[案号_1]，再[电话_1]，另[电话_2]身份证[身份证_1]' AS redacted, 4 AS n_entities, 5 AS n_spans FROM customer""", "redact_identifiers")
def redact_identifiers(spark, d):
    digits = F.lpad((F.col("c_custkey") % 100_000_000).cast("string"), 8, "0")
    t = text(F.col("c_name"), "电话138", digits, "，（2023）京01民终", digits, "号，再138", digits, "，另139", digits, "身份证110101199", digits, "X")
    r = spread(table(spark, d, "customer").select("c_custkey", "c_name")).select("c_custkey", redaction.redact(text(t)).alias("r"))
    return r.select("c_custkey", "r.redacted", F.size("r.entities").alias("n_entities"), F.size("r.spans").alias("n_spans"))


@query("""SELECT (doc_id % 3)::BIGINT AS batch, count(*) AS n, round(avg(CASE WHEN quality = 0 THEN (doc_id % 7 = 0 OR toxic <> 0)::INT END), 9) AS defect_detection,
round(avg(CASE WHEN quality = 1 THEN (doc_id % 7 <> 0 AND toxic = 0)::INT END), 9) AS acceptance FROM labels GROUP BY 1""", "judge_rates")
def judge_rates(spark, d):
    rows = table(spark, d, "labels").select((F.col("doc_id") % 3).alias("batch"), (F.col("quality") == 1).alias("expect_supported"), F.when(F.col("doc_id") % 7 != 0, F.col("toxic") == 0).alias("supported"))
    return evaluation.judge_rates(rows, "batch").select("batch", "n", F.round("defect_detection", 9).alias("defect_detection"), F.round("acceptance", 9).alias("acceptance"))


@query("""WITH p AS (SELECT p_partkey, p_size::DOUBLE AS s, (p_partkey % 50)::DOUBLE AS k FROM part), i AS (SELECT *, greatest(0, least(s, k + 30) - k) ** 2 AS shared FROM p)
SELECT p_partkey, round(shared / (s * s + 900 - shared), 9) AS iou, round(k / 100, 9) AS left_edge FROM i""", "page_boxes")
def page_boxes(spark, d):
    s, k = F.col("p_size").cast("double"), (part() % 50).cast("double")
    page = [F.lit(100.0)] * 2
    a, b = X.box_on_page(s, s, F.lit(0.0), F.lit(0.0), *page), X.box_on_page(k, k, k + 30, k + 30, *page)
    return table(spark, d, "part").select("p_partkey", F.round(X.box_overlap(a, b), 9).alias("iou"), F.round(b[0], 9).alias("left_edge"))


@query("""WITH c AS (SELECT l_returnflag || l_linestatus AS backend, bool_and(l_quantity > 0 AND l_returnflag <> 'R') AS ok, sum(l_quantity) AS seconds, max(l_extendedprice) AS memory FROM lineitem GROUP BY 1)
SELECT backend FROM c WHERE ok ORDER BY seconds, memory, backend LIMIT 1""", "parser_choice")
def parser_choice(spark, d):
    rows = table(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("backend"), (F.col("l_quantity") > 0).alias("contiguous"), (F.col("l_returnflag") != "R").alias("round_trip"), F.col("l_tax").alias("coverage"), F.col("l_quantity").alias("seconds"), F.col("l_extendedprice").alias("memory_mb"))
    return evaluation.recommended(evaluation.parser_checks(rows))


# Answers built from orders: article o_orderkey % 90 + 1 and the next one are the evidence, each second expects the next one, each tenth abstains.
def _answers(spark, d):
    a = order() % 90 + 1
    pair = lambda n: F.struct(F.lit("劳动法").alias("law"), n.cast("string").alias("article"))
    fact = text("金额", F.col("o_custkey").cast("string"), "元")
    answer = F.when(order() % 10 == 0, "依据不足。").when(order() % 4 == 1, text("见第九百条，", fact)).otherwise(text("依据第", said(a), "条，", fact, "，尚未生效。"))
    return table(spark, d, "orders").select(
        order().cast("string").alias("id"), answer.alias("answer"), F.array(pair(a), pair(a + 1)).alias("evidence"), F.array(pair(F.when(order() % 2 == 0, a).otherwise(a + 1))).alias("expect"), F.array(fact, F.lit(" ")).alias("required"),
        F.array(F.lit("十小时"), F.lit("见第")).alias("forbidden"), (order() % 5 == 0).alias("expect_abstain"), (order() % 3 == 0).alias("status_flag_required"), F.lit(None).cast("array<string>").alias("cited_ids"), F.lit(None).cast("boolean").alias("abstained"),
    )


_ANSWERS = """WITH s AS (SELECT o_orderkey AS k, o_orderkey % 10 = 0 AS gone, o_orderkey % 10 <> 0 AND o_orderkey % 4 = 1 AS wrong FROM orders),
a AS (SELECT k, gone, wrong, CASE WHEN NOT gone AND NOT wrong AND k % 2 = 0 THEN 1.0 ELSE 0.0 END AS citation_recall, CASE WHEN gone THEN 0.0 ELSE 1.0 END AS fact_coverage FROM s)"""


@query(_ANSWERS + """ SELECT k::VARCHAR AS id, citation_recall::DOUBLE AS citation_recall, CASE WHEN wrong THEN '900' ELSE '' END AS unwarranted, fact_coverage::DOUBLE AS fact_coverage, CASE WHEN wrong THEN '见第' ELSE '' END AS forbidden,
gone AS abstained, gone = (k % 5 = 0) AS abstain_correct, NOT gone AND NOT wrong AS status_flagged FROM a""", "answer_scores")
def answer_scores(spark, d):
    s = evaluation.answer_scores(_answers(spark, d))
    return s.select("id", "citation_recall", F.array_join("unwarranted", ",").alias("unwarranted"), "fact_coverage", F.array_join("forbidden_hits", ",").alias("forbidden"), "abstained", "abstain_correct", "status_flagged")


LIMITS = {"citation_recall": 0.9, "no_fabrication_rate": 0.95, "fact_coverage": 0.8, "forbidden_rate": 0.1, "abstain_accuracy": 1.0, "over_abstain_rate": 0.15, "status_flag_rate": 0.5}


@query(_ANSWERS + """, m AS (SELECT avg(citation_recall) AS r, avg((NOT wrong)::INT) AS f, avg(fact_coverage) AS c, avg(wrong::INT) AS b, avg(CASE WHEN k % 5 = 0 THEN gone::INT END) AS a, avg(CASE WHEN k % 5 <> 0 THEN gone::INT END) AS o, avg(CASE WHEN k % 3 = 0 THEN (NOT gone AND NOT wrong)::INT END) AS s FROM a)
SELECT metric, round(value, 9) AS value, threshold::DOUBLE AS threshold, CASE WHEN lower THEN value <= threshold ELSE value >= threshold END AS ok FROM (
SELECT 'citation_recall' AS metric, r AS value, 0.9 AS threshold, false AS lower FROM m UNION ALL SELECT 'no_fabrication_rate', f, 0.95, false FROM m UNION ALL SELECT 'fact_coverage', c, 0.8, false FROM m UNION ALL SELECT 'forbidden_rate', b, 0.1, true FROM m
UNION ALL SELECT 'abstain_accuracy', a, 1.0, false FROM m UNION ALL SELECT 'over_abstain_rate', o, 0.15, true FROM m UNION ALL SELECT 'status_flag_rate', s, 0.5, false FROM m)""", "answer_summary")
def answer_summary(spark, d):
    return evaluation.against_thresholds(evaluation.answer_summary(evaluation.answer_scores(_answers(spark, d))), LIMITS).withColumn("value", F.round("value", 9))


@query("""WITH c AS (SELECT o_orderkey AS k, (o_orderkey - CASE WHEN o_orderkey % 100 = 1 THEN 1 ELSE 0 END)::VARCHAR AS id, o_orderkey % 17 = 0 AS gone, o_orderkey % 19 = 0 AS bare FROM orders),
p AS (SELECT id, list_filter([CASE WHEN count(*) OVER (PARTITION BY id) > 1 THEN 'repeated_id' END, CASE WHEN k % 7 = 0 THEN 'unknown_category' END, CASE WHEN k % 11 = 0 THEN 'no_question' END, CASE WHEN NOT bare AND k % 13 = 0 THEN 'expected_outside_evidence' END,
 CASE WHEN gone AND NOT bare THEN 'abstain_with_citations' END, CASE WHEN gone AND k % 2 = 0 THEN 'unknown_abstain_kind' END, CASE WHEN NOT gone AND bare THEN 'nothing_expected' END], lambda x: x IS NOT NULL) AS ps FROM c)
SELECT id, array_to_string(ps, ',') AS problems FROM p WHERE len(ps) > 0""", "gold_set_problems")
def gold_set_problems(spark, d):
    rows = table(spark, d, "orders").select(
        (order() - F.when(order() % 100 == 1, 1).otherwise(0)).cast("string").alias("id"), F.when(order() % 7 == 0, "odd").otherwise("grounded").alias("category"), F.when(order() % 11 == 0, " ").otherwise("q").alias("question"), F.array(F.lit("e")).alias("evidence"),
        F.when(order() % 19 == 0, F.array().cast("array<string>")).when(order() % 13 == 0, F.array(F.lit("f"))).otherwise(F.array(F.lit("e"))).alias("expect"), (order() % 17 == 0).alias("expect_abstain"), F.when(order() % 2 == 1, "irrelevant").alias("abstain_kind"),
    )
    return evaluation.case_problems(rows).select("id", F.array_join("problems", ",").alias("problems"))


@query("""WITH r AS (SELECT o_orderkey AS k FROM orders), g AS (SELECT k, CASE WHEN k % 8 = 0 THEN 1 WHEN k % 9 = 0 THEN 2 WHEN k % 5 = 0 THEN 3 WHEN k % 6 = 0 THEN 4 WHEN k % 7 = 0 THEN 5 WHEN k % 10 = 3 THEN 6 WHEN k % 12 = 5 THEN 7 WHEN k % 13 = 0 THEN 8 WHEN k % 14 = 1 THEN 9 WHEN k % 15 = 1 THEN 10 WHEN k % 12 = 7 THEN 11 ELSE 12 END AS g FROM r)
SELECT k AS run_id, ['CLARIFYING', 'CLARIFYING', 'INSUFFICIENT_EVIDENCE', 'NEEDS_REVIEW', 'NEEDS_REVIEW', 'FAILED', 'NEEDS_REVIEW', 'NEEDS_REVIEW', 'NEEDS_REVIEW', 'NEEDS_REVIEW', 'PARTIAL', 'ANSWERED'][g] AS state,
['clarifying', 'clarifying', NULL, 'status', 'scope', NULL, 'budget', 'format', 'verification', 'semantics', NULL, NULL][g] AS blocked_by FROM g""", "gate_states")
def gate_states(spark, d):
    words = lambda *w: F.array(*map(F.lit, w)).cast("array<string>")
    runs = table(spark, d, "orders").select(
        order().alias("run_id"), F.when(order() % 8 == 0, "劳动合同期限多长？社会保险费用多少").when(order() % 9 == 0, "怎么办").when(order() % 7 == 0, "我能不能领失业保险金").otherwise("劳动合同期限多长").alias("question"),
        F.when(order() % 5 == 0, words()).when(order() % 6 == 0, words("repealed", "not_yet_effective")).when(order() % 4 == 0, words("effective", "repealed")).otherwise(words("unknown")).alias("statuses"), (order() % 10 != 3).alias("model_up"),
        F.when(order() % 12 == 5, 0).otherwise(1).alias("n_included"), F.when(order() % 12 == 7, 1).otherwise(0).alias("n_excluded"), (order() % 13 != 0).alias("format_ok"), (order() % 14 != 1).alias("verified_ok"), F.when(order() % 15 == 1, "unavailable").otherwise("passed").alias("review"),
    )
    return gates.gate_states(runs).select("run_id", "state", "blocked_by")


@query("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 1 THEN 'over_generalized' WHEN 2 THEN 'over_generalized' WHEN 3 THEN 'unverifiable_quote' END AS downgrade FROM orders", "modal_overreach")
def modal_overreach(spark, d):
    of = F.col("o_orderpriority")
    kind = order() % 5
    claim = F.when(kind == 1, text("应当加收", of, "滞纳金")).when(kind == 2, text("所有患者都能申请", of, "救助基金")).otherwise(text("可以加收", of, "滞纳金"))
    quote = F.when(kind == 2, text("患者能申请", of, "救助基金")).when(kind == 3, text("每周支付", of, "一次工资")).otherwise(text("可以加收", of, "滞纳金"))
    cited = F.array(F.when(kind == 2, text("符合规定的患者能申请", of, "救助基金。")).otherwise(text("逾期的，可以加收", of, " 滞纳金。")))
    return table(spark, d, "orders").select("o_orderkey", gates.downgraded(kind != 4, claim, quote, cited).alias("downgrade"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 2 THEN (o_orderkey % 3 + 1)::INT END AS n_claims, o_orderkey % 5 IN (1, 3) AS repaired, CASE o_orderkey % 5 WHEN 2 THEN 'empty' WHEN 3 THEN 'no_object' WHEN 4 THEN 'bad_structure' END AS error FROM orders", "claims_verify")
def claims_verify(spark, d):
    one = text('{"text": "', F.col("o_orderpriority"), '", "evidence_ids": [', order().cast("string"), "]}")
    whole = text('{"claims": [', F.array_join(F.array_repeat(one, (order() % 3 + 1).cast("int")), ", "), '], "missing_facts": null}')
    raw = F.when(order() % 5 == 0, text("```json\n", whole, "\n```")).when(order() % 5 == 1, text("so ", whole, " done")).when(order() % 5 == 2, " \n").when(order() % 5 == 3, F.col("o_orderpriority")).otherwise('{"claims": [{"evidence_ids": [1]}]}')
    c = table(spark, d, "orders").select("o_orderkey", output.claims_of(raw).alias("c"))
    return c.select("o_orderkey", F.when(F.col("c.claims").isNotNull(), F.size("c.claims")).alias("n_claims"), "c.repaired", "c.error")


@query("""SELECT p_partkey, '[1] ' || p_name || ' 第' || p_size || '条（' || CASE WHEN p_partkey % 2 = 0 THEN '现行有效' ELSE '已被取代' END || '）' || chr(10) || p_type || chr(10) || chr(10) || '[2] ' || p_brand || ' ' || p_size || '（施行日期未知）' || chr(10) || '文' AS evidence,
'1. ' || p_type || '（' || p_name || '、2）' || chr(10) || '2. 无据' AS answer FROM part""", "rendered_answer")
def rendered_answer(spark, d):
    hit = lambda *v: F.struct(*[(x if isinstance(x, Column) else F.lit(x)).cast("string").alias(n) for n, x in zip(("title", "display", "number", "legal_status", "text"), v, strict=True)])
    hits = F.array(hit(F.col("p_name"), text("第", F.col("p_size").cast("string"), "条"), F.col("p_size"), F.when(part() % 2 == 0, "effective").otherwise("repealed"), F.col("p_type")), hit(F.col("p_brand"), None, F.col("p_size"), "unknown", "文"))
    claims = F.array(F.struct(F.col("p_type").alias("text"), F.array(F.lit("1"), F.lit("2")).alias("evidence_ids")), F.struct(F.lit("无据").alias("text"), F.array().cast("array<string>").alias("evidence_ids")))
    return table(spark, d, "part").select("p_partkey", output.evidence_block(hits).alias("evidence"), output.rendered(claims, F.create_map(F.lit("1"), F.col("p_name"))).alias("answer"))


@query("""SELECT o_orderkey, '中华人民共和国社会保险法' AS title, 'law' AS instrument_type, '全国人民代表大会常务委员会' AS issuing_body, '中华人民共和国主席令第' || (o_orderkey % 99 + 1) || '号' AS document_number, year(o_orderdate) || '年修正' AS version_label, o_orderdate::DATE AS promulgated_on,
(o_orderdate + INTERVAL 90 DAY)::DATE AS effective_from, CASE WHEN (o_orderdate + INTERVAL 90 DAY)::DATE > DATE '2000-01-01' THEN 'not_yet_effective' ELSE 'effective' END AS legal_status, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'title_from_filename' END AS reasons FROM orders""", "metadata_extract")
def metadata_extract(spark, d):
    day = lambda c: F.date_format(c, "yyyy年M月d日")
    name = F.when(order() % 2 == 0, "中华人民共和国社会保险法_20101028.docx").otherwise("a/扫描件.docx")
    preamble = F.array(
        F.lit("中华人民共和国社会保险法"), text("（1990年10月28日第十一届全国人民代表大会常务委员会第十七次会议通过　根据", day("o_orderdate"), "决定修正）"),
        text("中华人民共和国主席令第", (order() % 99 + 1).cast("string"), "号"), text("自", day(F.date_add("o_orderdate", 90)), "起施行"),
    )
    m = table(spark, d, "orders").select("o_orderkey", legal.metadata(name, preamble, F.lit(datetime.date(2000, 1, 1))).alias("m"))
    return m.select("o_orderkey", *[f"m.{c}" for c in ("title", "instrument_type", "issuing_body", "document_number", "version_label", "promulgated_on", "effective_from", "legal_status")], F.array_join("m.low_confidence_reasons", ",").alias("reasons"))
