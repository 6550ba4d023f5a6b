"""Gates, parses, runs and injected models over the standard tables; the SQL states each rule in its own way."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import output
from ..functions.values import JOB_ERRORS
from ..operators import access, conversation, evaluation, gates, mutation, structure
from ..sources import files
from ..sources.commits import Store, shared_dir
from ..streaming import jobs as streams
from .base import literal, query, table

FLAT = r"regexp_replace({}, '[\s\x{{3000}}]+', '', 'g')"


def _lines(spark, d):
    return table(spark, d, "lineitem")


@query("""SELECT l_orderkey AS answer_id, bool_and(l_partkey % 50 <> 0 AND l_linenumber <= l_orderkey % 5 + 2 AND (l_suppkey % 9 <> 0 OR l_orderkey % 5 >= 1)) AS in_order FROM lineitem GROUP BY 1""")
def claims_in_order(spark, d):
    """Orders as answers, line items as claims: each names its number (some also 3, some nothing) of the order's few pieces of evidence."""
    number = F.col("l_linenumber").cast("string")
    ids = F.when(F.col("l_partkey") % 50 == 0, F.array().cast("array<string>")).when(F.col("l_suppkey") % 9 == 0, F.array(number, F.lit("3"))).otherwise(F.array(number))
    own = _lines(spark, d).groupBy("l_orderkey").agg(F.collect_list(F.struct(F.lit("c").alias("text"), ids.alias("evidence_ids"))).alias("claims"))
    return own.select(F.col("l_orderkey").alias("answer_id"), gates.claims_in_order(F.col("claims"), (F.col("l_orderkey") % 5 + 2).cast("int")).alias("in_order"))


@query("""SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_partkey % 2 = 1 THEN p_brand END, CASE WHEN p_partkey % 3 = 0 THEN p_type END], lambda x: x IS NOT NULL), ',') AS laws,
  array_to_string(list_sort(list_transform(list_filter(list_distinct([p_size, p_partkey % 7 + 60]), lambda x: NOT (x = p_size AND p_partkey % 5 = 0) AND NOT (x = p_partkey % 7 + 60 AND p_partkey % 4 = 0)), lambda x: x::VARCHAR)), ',') AS articles FROM part""")
def foreign_references(spark, d):
    """Laws and articles that an answer names and its evidence does not have; a law without an article in its sentence is no reference."""
    p = F.col("p_partkey")
    other = F.when(p % 3 == 0, F.lit("第")).otherwise(F.lit("。第"))
    answer = F.concat(F.lit("依《"), "p_brand", F.lit("》第"), F.col("p_size").cast("string"), F.lit("条；《"), "p_type", F.lit("》"), other, (p % 7 + 60).cast("string"), F.lit("条。"))
    titles = F.array(F.when(p % 2 == 0, F.col("p_brand")).otherwise(F.lit("别的")))
    numbers = F.when(p % 5 == 0, F.array(F.col("p_size").cast("string"))).otherwise(F.array().cast("array<string>"))
    evidence = F.when(p % 4 == 0, F.concat(F.lit("见第"), (p % 7 + 60).cast("string"), F.lit("条"))).otherwise(F.lit("无"))
    return table(spark, d, "part").select("p_partkey", F.array_join(gates.foreign_laws(answer, titles), ",").alias("laws"), F.array_join(F.array_sort(gates.foreign_articles(answer, numbers, evidence)), ",").alias("articles"))


@query(f"""WITH q AS (SELECT doc_id, {FLAT.format('text')} AS f, {FLAT.format("substr(text, 11, 30)")} AS a, {FLAT.format("substr(text, 21, 12) || CASE WHEN doc_id % 3 = 1 THEN 'qq' ELSE '' END")} AS b,
  CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'zzzzzz。' WHEN 2 THEN '《某法》第十五条' ELSE 'zz' END || {FLAT.format("substr(text, 31, 25)")} AS c FROM documents)
SELECT doc_id, (length(a) >= 10 AND NOT contains(f, a))::INT + (length(b) >= 10 AND NOT contains(f, b))::INT AS unsupported,
  length(c) >= 6 AND CASE doc_id % 4 WHEN 0 THEN contains(f, c) WHEN 1 THEN (length(c) >= 13 AND contains(f, substr(c, 8))) WHEN 2 THEN contains(f, substr(c, 9)) ELSE contains(f, c) END AS found FROM q""")
def quote_checks(spark, d):
    """Quotes cut from documents, some changed, some behind a source or another sentence."""
    k = F.col("doc_id")
    cut = lambda a, n: F.substring("text", a, n)
    answer = F.concat(F.lit("「"), cut(11, 30), F.lit("」与「"), cut(21, 12), F.when(k % 3 == 1, "qq").otherwise(""), F.lit("」"))
    quote = F.concat(F.when(k % 4 == 0, "").when(k % 4 == 1, "zzzzzz。").when(k % 4 == 2, "《某法》第十五条").otherwise("zz"), cut(31, 25))
    from ..functions.text import flatten

    told = F.size(gates.unsupported_quotes(answer, flatten(F.col("text"))))
    return table(spark, d, "documents").select("doc_id", told.alias("unsupported"), gates.quote_in_evidence(quote, F.array("text")).alias("found"))


@query("""SELECT o_orderkey, string_agg(l_partkey || ':' || l_returnflag || ':' || (l_linenumber % 2 = 0), ',' ORDER BY i) AS refs, 'a=' || any_value(o_orderpriority) || ',b=' || any_value(CASE WHEN o_orderkey % 2 = 0 THEN 'own' ELSE o_orderstatus END) || CASE WHEN o_orderkey % 3 = 0 THEN ',c=1' ELSE '' END AS config,
  o_orderkey % 4 <> 0 AND o_orderkey % 6 <> 1 AS published
FROM orders JOIN (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag) AS i FROM lineitem) ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def run_records(spark, d):
    """What a run keeps: its evidence with what is cited, its configuration with what it overrides, and whether it is published."""
    hit = F.struct("l_linenumber", F.col("l_partkey").alias("id"), F.col("l_returnflag").alias("legal_status"))
    hits = _lines(spark, d).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(hit)).alias("hits"))
    cited = F.filter(F.transform("hits", lambda h, i: F.when(h["l_linenumber"] % 2 == 0, (i + 1).cast("string"))), lambda x: x.isNotNull())
    refs = F.transform(gates.evidence_refs(F.col("hits"), cited), lambda r: F.concat_ws(":", r["id"], r["legal_status"], r["cited"]))
    base = F.create_map(F.lit("a"), F.col("o_orderpriority"), F.lit("b"), F.col("o_orderstatus"))
    key = F.col("o_orderkey")
    own = F.map_filter(F.create_map(F.lit("b"), F.lit("own"), F.lit("c"), F.lit("1")), lambda n, _: F.when(n == "b", key % 2 == 0).otherwise(key % 3 == 0))
    config = F.transform(F.array_sort(F.map_entries(gates.merged_config(base, own))), lambda e: F.concat_ws("=", e["key"], e["value"]))
    shown = gates.published(F.when(key % 4 != 0, "m"), F.when(key % 6 == 1, "scope"))
    return table(spark, d, "orders").join(hits, "o_orderkey").select("o_orderkey", F.array_join(refs, ",").alias("refs"), F.array_join(config, ",").alias("config"), shown.alias("published"))


@query("""WITH a AS (SELECT unnest([7, 40, 60, 1000000007]) AS asked), g AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
v AS (SELECT doc_id FROM documents d WHERE source <> 'src0' OR EXISTS (SELECT 1 FROM g WHERE g.doc_id = d.doc_id))
SELECT asked::BIGINT AS asked, count(doc_id) AS n FROM a LEFT JOIN v ON doc_id = asked GROUP BY 1""")
def visible_or_missing(spark, d):
    """Four documents asked for by id: one that isn't there and one that is out of scope look the same."""
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("source") != "src0", "organization").otherwise("restricted").alias("access_scope"))
    grants = table(spark, d, "labels").filter("quality = 1").select(F.col("doc_id").alias("resource_id"), F.lit(1).alias("user_id"))
    scoped = access.document_scope(docs, grants, 1).select("doc_id")
    counts = [access.visible_or_missing(scoped, "doc_id", i).agg(F.count(F.lit(1)).alias("n")).select(F.lit(i).cast("long").alias("asked"), "n") for i in (7, 40, 60, 1_000_000_007)]
    return counts[0].unionAll(counts[1]).unionAll(counts[2]).unionAll(counts[3])


STATUSES = [404, 413, 422, 503, 507, 500, None]


@query(f"""WITH c(status, code, retry) AS (VALUES {', '.join(f"({s}, '{c}', {r})" for s, (c, r) in JOB_ERRORS.items())}), e AS (SELECT event_id, [{', '.join(map(literal, STATUSES))}][(event_id % 7 + 1)::INT] AS status FROM events)
SELECT event_id, coalesce(code, 'internal_error') AS code, coalesce(retry, true) AS retry FROM e LEFT JOIN c USING (status)""")
def error_classes(spark, d):
    status = F.get(F.array(*map(F.lit, STATUSES)), (F.col("event_id") % 7).cast("int"))
    return table(spark, d, "events").select("event_id", conversation.error_class(status).alias("e")).select("event_id", "e.code", "e.retry")


@query("""WITH s AS (SELECT o_orderkey + CASE WHEN o_custkey % 11 = 0 THEN 1000000000 ELSE 0 END AS run_id, o_orderpriority AS more FROM orders), j AS (SELECT DISTINCT l_orderkey AS run_id FROM lineitem WHERE l_quantity < 3)
SELECT s.run_id, CASE WHEN o_orderstatus IS NULL OR o_orderstatus <> 'O' THEN 'not_suspended' WHEN j.run_id IS NOT NULL THEN 'in_flight' ELSE 'resumed' END AS outcome, CASE WHEN o_orderstatus = 'O' AND j.run_id IS NULL THEN 'q' || s.run_id || chr(10) || more END AS question
FROM s LEFT JOIN orders ON o_orderkey = s.run_id LEFT JOIN j ON j.run_id = s.run_id""")
def resumed_runs(spark, d):
    """Supplements to orders as runs: only suspended ones without a job under way are resumed."""
    o = table(spark, d, "orders")
    runs = o.select(F.col("o_orderkey").alias("run_id"), F.concat(F.lit("q"), "o_orderkey").alias("question"), F.when(F.col("o_orderstatus") == "O", "CLARIFYING").otherwise("ANSWERED").alias("state"))
    more = o.select((F.col("o_orderkey") + F.when(F.col("o_custkey") % 11 == 0, 1_000_000_000).otherwise(0)).alias("run_id"), F.col("o_orderpriority").alias("supplement"))
    return conversation.resumed(runs, more, _lines(spark, d).filter("l_quantity < 3").select(F.col("l_orderkey").alias("run_id")))


@query("""WITH n AS (SELECT l_orderkey AS id, count(*) AS n, count(*) FILTER (l_partkey % 2 = 0) AS good, bool_or(l_partkey % 60 = 0) AS unread FROM lineitem GROUP BY 1)
SELECT id, CASE WHEN unread OR id % 5 = 0 OR id % 7 = 0 THEN NULL ELSE n END AS n, CASE WHEN unread OR id % 5 = 0 OR id % 7 = 0 THEN NULL ELSE good END AS good, CASE WHEN id % 3 = 0 THEN NULL ELSE id % 2 = 0 END AS one FROM n""")
def verdict_parses(spark, d):
    """Judges' answers of line items: a batch counts if it has just one readable verdict for each, in any order, fenced or not; a single one if it can be read."""
    i = F.col("l_orderkey")
    verdicts = F.transform(F.reverse("parts"), lambda p: p)
    rows = _lines(spark, d).groupBy("l_orderkey").agg(F.collect_list(F.struct(F.when(F.col("l_partkey") % 60 != 0, F.col("l_partkey") % 2 == 0).alias("supported"))).alias("v"))
    numbered = rows.withColumn("parts", F.transform("v", lambda x, n: F.struct((n + 1).alias("index"), x["supported"].alias("supported"))))
    raw = F.to_json(F.struct(verdicts.alias("reviews")))
    raw = F.when(i % 4 == 1, F.concat(F.lit("```json\n"), raw, F.lit("\n```"))).when(i % 7 == 0, F.substring(raw, 1, 20)).otherwise(raw)
    raw = F.when(i % 7 == 0, F.substring(raw, 1, 12)).otherwise(raw)
    batch = output.verdict_batch(raw, F.size("v") + F.when(i % 5 == 0, 1).otherwise(0))
    single = output.verdict(F.when(i % 3 == 0, F.lit('{"issues": []}')).otherwise(F.to_json(F.struct((i % 2 == 0).alias("supported")))))
    told = numbered.select(i.alias("id"), batch.alias("b"), single["supported"].alias("one"))
    return told.select("id", F.when(F.col("b").isNotNull(), F.size("b").cast("long")).alias("n"), F.when(F.col("b").isNotNull(), F.size(F.filter("b", lambda x: x["supported"])).cast("long")).alias("good"), "one")


@query("""SELECT p_partkey, '请一次问一个问题，选择其中之一：' || chr(10) || '1. ' || p_name || CASE WHEN p_partkey % 2 = 0 THEN chr(10) || '2. ' || p_type ELSE '' END AS options,
  array_to_string(list_filter([p_brand, CASE WHEN p_partkey % 3 > 0 THEN p_name END, p_type], lambda x: x IS NOT NULL), chr(10) || chr(10)) AS prompt FROM part""")
def prompts_and_options(spark, d):
    p = F.col("p_partkey")
    parts = F.when(p % 2 == 0, F.array("p_name", "p_type")).otherwise(F.array("p_name"))
    return table(spark, d, "part").select("p_partkey", output.options_of(parts).alias("options"), output.prompt(F.col("p_brand"), F.when(p % 3 > 0, F.col("p_name")), F.col("p_type")).alias("prompt"))


@query("""WITH t AS (SELECT doc_id, text, CASE WHEN doc_id % 10 = 0 THEN 'not in there §' ELSE substr(text, (length(text) // 2 + 1)::INT, 12) END AS label FROM documents),
b AS (SELECT doc_id, instr(text, label) AS p, substr(text, 1, (instr(text, label) - 1)::INT) AS before FROM t)
SELECT doc_id, CASE WHEN p > 0 AND length(before) - length(replace(before, chr(10), '')) < 9 THEN length(before) - length(replace(before, chr(10), '')) ELSE 0 END AS span FROM b""")
def article_spans(spark, d):
    """The line of each document in which a passage first stands, of nine at most."""
    half = F.substring("text", F.floor(F.length("text") / 2).cast("int") + 1, F.lit(12))
    label = F.when(F.col("doc_id") % 10 == 0, "not in there §").otherwise(half)
    return table(spark, d, "documents").withColumn("label", label).select("doc_id", structure.span_of_article(F.col("text"), F.col("label"), F.lit(9)).cast("long").alias("span"))


@query("SELECT l_orderkey AS id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) - 1)::INT AS position, 'c' || l_partkey AS claim, l_quantity > 10 AS expect_supported FROM lineitem")
def flattened_groups(spark, d):
    one = F.struct("l_linenumber", "l_partkey", "l_quantity", F.concat(F.lit("c"), "l_partkey").alias("claim"), (F.col("l_quantity") > 10).alias("expect_supported"))
    groups = _lines(spark, d).groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(one)).alias("c"))
    claims = F.transform("c", lambda x: F.struct(x["claim"].alias("claim"), x["expect_supported"].alias("expect_supported")))
    return evaluation.flattened_groups(groups.select("id", claims.alias("claims")))


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS texts FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 5 GROUP BY 1")
def conversation_memory_streaming(spark, d):
    """The last five texts of each conversation, as a stream keeps them."""
    turns = table(spark, d, "conversations")
    stream = streams.event_stream(spark, f"{d}/conversations.parque[t]", turns.schema)
    return streams.drained(streams.conversation_memory(stream), "memory", idle_batches=False).select("conv_id", F.array_join("texts", "\n").alias("texts"))


@query("""WITH v AS (SELECT doc_id, length(text)::DOUBLE AS a, (length(text) - length(replace(text, 'e', '')) + 1)::DOUBLE AS b FROM documents)
SELECT doc_id, 2 AS dimensions, round(a / sqrt(a * a + b * b), 4) AS x, round(b / sqrt(a * a + b * b), 4) AS y FROM v""")
def embedded_texts(spark, d):
    """Vectors of an injected encoder, upserted into a store in two commits and read back."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    made = lambda rows, shift: files.embedded(rows, lambda texts: [[len(t) + shift, t.count("e") + 1] for t in texts], "doc_id")
    store = Store(spark, f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}").delete_on_exit()
    first = store.commit(replace={"vectors": made(docs.filter("doc_id % 3 > 0"), 5)})
    new = made(docs, 0).withColumn("v", F.lit(1))
    both = mutation.upsert(store.table("vectors", first).withColumn("v", F.lit(0)), new, ["doc_id"], ["v"]).drop("v")
    done = store.commit(replace={"vectors": both}, expected=first)
    return store.table("vectors", done).select("doc_id", "dimensions", F.round(F.col("embedding")[0].cast("double"), 4).alias("x"), F.round(F.col("embedding")[1].cast("double"), 4).alias("y"))


@query("""SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT item_id AS query_id, doc_id, (length(d.text) % 97 - length(b.text) % 89)::DOUBLE AS score FROM documents AS d JOIN benchmark AS b ON doc_id % 200 = item_id) QUALIFY rank <= 3""")
def reranked_hits(spark, d):
    """Candidate documents of each benchmark item, scored by an injected reranker: a top-three report."""
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    pairs = table(spark, d, "documents").join(items, F.col("doc_id") % 200 == F.col("query_id")).select("query_id", "doc_id", "query", "text")
    scored = files.reranked(pairs, lambda both: [float(len(t) % 97 - len(q) % 89) for q, t in both])
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id"))
    return scored.select("query_id", "doc_id", "score", place.cast("long").alias("rank")).filter("rank <= 3")


@query("SELECT o_orderkey, 'A:' || upper(o_orderpriority) AS output FROM orders")
def generated_answers(spark, d):
    """An injected generator's output for a prompt per order."""
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("prompt"))
    return output.generated(rows, lambda prompts: [f"A:{p.upper()}" for p in prompts]).select("o_orderkey", "output")
