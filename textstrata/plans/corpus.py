"""Corpus queries; orders, customers and line items stand for versions, instruments and provisions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.values import ROLES
from ..operators import access, citations, conversation, corpus, evaluation, gates, mutation, search
from .base import query, table, values

STATUS = "CASE o_orderstatus WHEN 'F' THEN 'effective' WHEN 'O' THEN 'not_yet_effective' ELSE 'unknown' END"


def _versions(spark, d):
    o = table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "effective").when(F.col("o_orderstatus") == "O", "not_yet_effective").otherwise("unknown")
    day = F.col("o_orderdate").cast("date")
    return o.select(F.col("o_orderkey").alias("version_id"), F.col("o_custkey").alias("instrument_id"), status.alias("legal_status"), day.alias("promulgated_on"), F.date_add(day, 30).alias("effective_from"), F.when(F.col("o_orderkey") % 5 == 0, F.date_add(day, 400)).alias("effective_to"), "o_orderpriority", "o_totalprice")


VERSIONS = f"v AS (SELECT o_orderkey AS version_id, o_custkey AS instrument_id, {STATUS} AS legal_status, o_orderdate::DATE AS promulgated_on, o_orderdate::DATE + 30 AS effective_from, CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate::DATE + 400 END AS effective_to, o_orderpriority, o_totalprice FROM orders)"


@query(f"""WITH {VERSIONS} SELECT version_id, instrument_id, c_name AS title, legal_status FROM v JOIN customer ON c_custkey = instrument_id JOIN nation ON n_nationkey = c_nationkey
WHERE n_name = (SELECT min(n_name) FROM nation) AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND legal_status <> 'not_yet_effective'""")
def search_exact(spark, d):
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation").orderBy("n_name").limit(1)), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("instrument_id"), F.col("c_name").alias("title"))
    found = search.filtered(_versions(spark, d).filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")), search.Query())
    return found.join(c, "instrument_id").select("version_id", "instrument_id", "title", "legal_status")


@query(f"WITH {VERSIONS} SELECT version_id, legal_status FROM v WHERE (effective_from IS NULL OR effective_from <= DATE '1997-06-01') AND (effective_to IS NULL OR effective_to > DATE '1997-06-01')")
def search_effective_on(spark, d):
    return search.filtered(_versions(spark, d), search.Query(include_not_yet_effective=True, effective_on="1997-06-01")).select("version_id", "legal_status")


@query("SELECT version_id, legal_status FROM (SELECT o_orderkey AS version_id, 'x' AS legal_status FROM orders WHERE false)")
def search_unreadable_article(spark, d):
    """An article number that can't be read gives no result, never all."""
    rows = _versions(spark, d).withColumn("provision_number", F.col("version_id").cast("string"))
    return search.filtered(rows, search.Query(article="第87条")).select("version_id", "legal_status")


@query(f"WITH {VERSIONS} SELECT version_id, legal_status FROM v WHERE version_id % 100 = 87 AND legal_status <> 'not_yet_effective'")
def search_readable_article(spark, d):
    """The same search with an article number that can be read, in either script."""
    rows = _versions(spark, d).withColumn("provision_number", (F.col("version_id") % 100).cast("string"))
    return search.filtered(rows, search.Query(article="第八十七条")).select("version_id", "legal_status")


@query("""WITH g AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1)
SELECT doc_id FROM documents d WHERE source <> 'src0' OR EXISTS (SELECT 1 FROM g WHERE g.doc_id = d.doc_id)""")
def search_scoped(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("source") != "src0", "organization").otherwise("restricted").alias("access_scope"))
    grants = table(spark, d, "labels").filter("quality = 1").select(F.col("doc_id").alias("resource_id"), F.lit(1).alias("user_id"))
    return access.document_scope(docs, grants, 1).select("doc_id")


@query("""WITH p AS (SELECT DISTINCT o_custkey AS page_id, o_custkey % 3 AS org_id FROM orders), c AS (SELECT o_custkey AS page_id, o_orderkey AS doc_id FROM orders),
v AS (SELECT o_orderkey AS doc_id FROM orders WHERE o_orderpriority <> '5-LOW')
SELECT page_id FROM p WHERE org_id = 1 AND (page_id % 2 = 0 OR page_id % 5 = 0) AND NOT EXISTS (SELECT 1 FROM c WHERE c.page_id = p.page_id AND NOT EXISTS (SELECT 1 FROM v WHERE v.doc_id = c.doc_id))""")
def page_scope(spark, d):
    o = table(spark, d, "orders")
    pages = o.select(F.col("o_custkey").alias("page_id"), (F.col("o_custkey") % 3).alias("org_id"), F.when(F.col("o_custkey") % 2 == 0, "organization").otherwise("restricted").alias("access_scope")).distinct()
    grants = pages.filter("page_id % 5 = 0").select(F.col("page_id").alias("resource_id"), F.lit(1).alias("user_id"))
    cited = o.select(F.col("o_custkey").alias("page_id"), F.col("o_orderkey").alias("doc_id"))
    return access.page_scope(pages, grants, cited, o.filter("o_orderpriority <> '5-LOW'").select(F.col("o_orderkey").alias("doc_id")), 1, 1).select("page_id")


@query("""SELECT event_id, user_id, n_failures FROM (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 15 MINUTES PRECEDING AND CURRENT ROW) AS n_failures FROM events WHERE event_type = 'error')""")
def lockout_failures_15m(spark, d):
    return access.failures_within(table(spark, d, "events").filter("event_type = 'error'"), "user_id").select("event_id", "user_id", "n_failures")


@query("""SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTES AS stop, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM
 (SELECT *, (coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 30 MINUTES, true))::INT AS fresh FROM events)) GROUP BY user_id, s""")
def session_windows(spark, d):
    return conversation.sessions(table(spark, d, "events"))


FACTS = """f AS (SELECT d.doc_id, CASE WHEN d.doc_id % 50 = 0 THEN NULL ELSE d.source END AS source_name, CASE WHEN d.source = 'src3' THEN '  ' ELSE 'ok' END AS license_note,
 CASE WHEN d.doc_id % 41 = 0 THEN NULL WHEN d.doc_id % 37 = 0 THEN 0 ELSE n_chars / 800 + 1 END AS chunk_count, d.doc_id % 11 <> 0 AS landed, CASE WHEN d.lang = 'es' THEN '未标注版本' ELSE '2020年' END AS version_label,
 CASE quality WHEN 1 THEN 'approved' WHEN 0 THEN 'rejected' END AS review_status, (d.doc_id % 9)::INT AS provision_count FROM documents d LEFT JOIN labels l USING (doc_id)),
h AS (SELECT *, list_filter([CASE WHEN source_name IS NULL THEN 'source_missing' WHEN trim(license_note) = '' THEN 'license_note_missing' END, CASE WHEN chunk_count IS NULL THEN 'parse_missing' WHEN chunk_count = 0 THEN 'parse_empty' END, CASE WHEN NOT landed THEN 'not_landed' END], lambda x: x IS NOT NULL) AS hard,
 list_filter([CASE WHEN review_status IS DISTINCT FROM 'approved' THEN 'review_pending' END, CASE WHEN version_label = '未标注版本' THEN 'version_unlabelled' END, CASE WHEN provision_count <= 0 THEN 'no_provisions' END], lambda x: x IS NOT NULL) AS soft FROM f),
q AS (SELECT doc_id, CASE WHEN len(hard) > 0 THEN 'failed' WHEN len(soft) > 0 THEN 'degraded' ELSE 'passed' END AS status, array_to_string(CASE WHEN len(hard) > 0 THEN hard ELSE soft END, ',') AS reasons FROM h)"""


def _verdicts(spark, d):
    l = table(spark, d, "labels").select("doc_id", "quality")  # noqa: E741
    k = F.col("doc_id")
    facts = table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars").join(l, "doc_id", "left").select(
        "doc_id", F.when(k % 50 != 0, F.col("source")).alias("source_name"), F.when(F.col("source") == "src3", "  ").otherwise("ok").alias("license_note"),
        F.when(k % 41 == 0, F.lit(None)).when(k % 37 == 0, 0).otherwise(F.col("n_chars") / 800 + 1).alias("chunk_count"), (k % 11 != 0).alias("landed"), F.when(F.col("lang") == "es", "未标注版本").otherwise("2020年").alias("version_label"),
        F.when(F.col("quality") == 1, "approved").when(F.col("quality") == 0, "rejected").alias("review_status"), (k % 9).alias("provision_count"),
    )
    return corpus.verdicts(facts)


@query(f"WITH {FACTS} SELECT * FROM q")
def quality_gate(spark, d):
    return _verdicts(spark, d).select("doc_id", "status", F.array_join("reasons", ",").alias("reasons"))


@query(f"WITH {FACTS} SELECT status, count(*) AS n FROM q GROUP BY 1")
def quality_counts(spark, d):
    return _verdicts(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


DAY = "1997-01-01"


@query(f"""WITH {VERSIONS}, m AS (SELECT *, coalesce(legal_status = 'not_yet_effective' AND effective_from <= DATE '{DAY}', false) AS due FROM v),
n AS (SELECT *, bool_or(due) OVER (PARTITION BY instrument_id) AS has_due, CASE WHEN legal_status = 'effective' OR due THEN promulgated_on END AS force FROM m),
x AS (SELECT *, max(force) OVER (PARTITION BY instrument_id) AS newest FROM n)
SELECT version_id, CASE WHEN has_due AND force < newest THEN 'repealed' WHEN due THEN 'effective' ELSE legal_status END AS new_status FROM x""")
def supersession_asof(spark, d):
    return corpus.recomputed(_versions(spark, d), F.lit(DAY).cast("date")).select("version_id", "new_status")


@query(f"""WITH {VERSIONS} SELECT instrument_id, version_id FROM (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY CASE legal_status WHEN 'effective' THEN 0 WHEN 'not_yet_effective' THEN 1 WHEN 'repealed' THEN 2 ELSE 3 END,
 promulgated_on DESC NULLS LAST, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 9 END, o_totalprice DESC, version_id) AS n FROM v) WHERE n = 1""")
def best_artifact(spark, d):
    media = F.when(F.col("o_orderpriority") == "1-URGENT", corpus.MEDIA_ORDER[0]).when(F.col("o_orderpriority") == "2-HIGH", corpus.MEDIA_ORDER[1]).otherwise("text/plain")
    return corpus.best_artifact(_versions(spark, d).withColumn("media_type", media), "instrument_id", imported="o_totalprice", tie="version_id").select("instrument_id", "version_id")


@query("SELECT o_orderkey AS version_id, count(l_orderkey) AS n_provisions FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def version_provision_counts(spark, d):
    return table(spark, d, "orders").select("o_orderkey").join(table(spark, d, "lineitem").select("l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy(F.col("o_orderkey").alias("version_id")).agg(F.count("l_orderkey").alias("n_provisions"))


@query("SELECT p_partkey AS identity_id FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity < 5)")
def orphan_identities(spark, d):
    used = table(spark, d, "lineitem").filter("l_quantity < 5").select(F.col("l_partkey").alias("identity_id"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("identity_id")).join(used, "identity_id", "left_anti")


@query("""WITH s AS (SELECT version_id AS version, count(DISTINCT source) AS n_sources FROM (SELECT l_orderkey AS version_id, l_suppkey % 4 AS source FROM lineitem) GROUP BY 1) SELECT * FROM s WHERE n_sources > 1""")
def source_conflicts(spark, d):
    return corpus.source_conflicts(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("version"), (F.col("l_suppkey") % 4).alias("source")))


CITES = """c AS (SELECT l_orderkey AS page_id, 'p' || l_partkey AS place, CASE WHEN l_returnflag = 'R' THEN 'repealed' ELSE 'effective' END AS legal_status, sha256(l_linestatus) AS now, CASE WHEN l_linenumber % 4 = 0 THEN NULL WHEN l_linenumber % 3 = 0 THEN sha256('x') ELSE sha256(l_linestatus) END AS snap FROM lineitem),
w AS (SELECT page_id, CASE WHEN legal_status = 'repealed' THEN place || ' 所在版本已被取代' WHEN snap <> now THEN place || ' 正文已变更' END AS why FROM c),
s AS (SELECT page_id, string_agg(DISTINCT why, '；' ORDER BY why) AS reason FROM w WHERE why IS NOT NULL GROUP BY 1)"""


def _stale(spark, d):
    l = table(spark, d, "lineitem")  # noqa: E741
    now = F.sha2("l_linestatus", 256)
    return corpus.stale_pages(l.select(
        F.col("l_orderkey").alias("page_id"), F.concat(F.lit("p"), "l_partkey").alias("place"), F.when(F.col("l_returnflag") == "R", "repealed").otherwise("effective").alias("legal_status"), now.alias("current_sha"),
        F.when(F.col("l_linenumber") % 4 == 0, F.lit(None)).when(F.col("l_linenumber") % 3 == 0, F.sha2(F.lit("x"), 256)).otherwise(now).alias("snapshot_sha"),
    ))


@query(f"WITH {CITES} SELECT * FROM s")
def staleness_flags(spark, d):
    return _stale(spark, d)


@query(f"""WITH {CITES}, o AS (SELECT o_orderkey AS page_id, 'old' AS reason FROM orders WHERE o_orderstatus = 'F')
SELECT page_id, CASE WHEN s.reason IS NULL THEN 'clear' ELSE 'flag' END AS action, s.reason AS reason FROM o FULL JOIN s USING (page_id) WHERE o.reason IS DISTINCT FROM s.reason""")
def staleness_diff(spark, d):
    old = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("page_id"), F.lit("old").alias("reason"))
    return corpus.flag_changes(old, _stale(spark, d))


@query("""WITH r AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS number FROM orders),
p AS (SELECT c_custkey AS page_id, c_nationkey % 3 + 1 AS published FROM customer),
c AS (SELECT p.page_id, r_name || ' ' || p_size AS place, n_regionkey = 2 AS gone, sha256(p_name) AS now, CASE WHEN l_linenumber % 4 = 0 THEN NULL WHEN l_linenumber % 3 = 0 THEN sha256('x') ELSE sha256(p_name) END AS snap
  FROM p JOIN r ON r.o_custkey = p.page_id AND r.number = p.published JOIN lineitem ON l_orderkey = r.o_orderkey JOIN part ON p_partkey = l_partkey JOIN nation ON n_nationkey = p_size % 25 JOIN region ON r_regionkey = n_regionkey),
w AS (SELECT page_id, CASE WHEN gone THEN place || ' 所在版本已被取代' WHEN snap <> now THEN place || ' 正文已变更' END AS why FROM c)
SELECT page_id, string_agg(DISTINCT why, '；' ORDER BY why) AS reason FROM w WHERE why IS NOT NULL GROUP BY 1""")
def published_staleness(spark, d):
    """Stale pages by their published revisions alone: customers are pages, their orders revisions, line items citations, parts provisions, nations versions."""
    own = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    revisions = table(spark, d, "orders").select(F.col("o_orderkey").alias("revision_id"), F.col("o_custkey").alias("page_id"), F.row_number().over(own).alias("number"))
    pages = table(spark, d, "customer").select(F.col("c_custkey").alias("page_id"), (F.col("c_nationkey") % 3 + 1).alias("published_revision"))
    part = table(spark, d, "part")
    provisions = part.select(F.col("p_partkey").alias("provision_id"), F.col("p_partkey").alias("identity_id"), (F.col("p_size") % 25).alias("version_id"), F.sha2("p_name", 256).alias("current_sha"))
    snapshot = F.when(F.col("l_linenumber") % 4 == 0, F.lit(None)).when(F.col("l_linenumber") % 3 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.sha2("p_name", 256))
    cited = table(spark, d, "lineitem").join(part.hint("merge"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("revision_id"), F.col("l_partkey").alias("provision_id"), snapshot.alias("snapshot_sha"))
    identities = part.select(F.col("p_partkey").alias("identity_id"), F.col("p_size").cast("string").alias("provision_number"))
    versions = table(spark, d, "nation").select(F.col("n_nationkey").alias("version_id"), F.col("n_regionkey").alias("instrument_id"), F.when(F.col("n_regionkey") == 2, "repealed").otherwise("effective").alias("legal_status"))
    instruments = table(spark, d, "region").select(F.col("r_regionkey").alias("instrument_id"), F.col("r_name").alias("title"))
    return corpus.stale_pages(corpus.published_citations(pages, revisions, cited, provisions, identities, versions, instruments))


EDGES = "e AS (SELECT DISTINCT l_partkey AS source, l_suppkey AS target_identity FROM lineitem WHERE l_partkey <> l_suppkey)"


def _edges(spark, d):
    cites = table(spark, d, "lineitem").select(F.col("l_partkey").alias("source"), F.lit("one").alias("instrument"), F.col("l_suppkey").alias("target"))
    named = table(spark, d, "supplier").select(F.col("s_suppkey").alias("identity"), F.lit("one").alias("instrument"), F.col("s_suppkey").alias("number"))
    return citations.linked(cites, named)


@query(f"WITH {EDGES} SELECT *, 'cite' AS relation FROM e")
def citation_edges(spark, d):
    return _edges(spark, d)[0]


@query(f"""WITH {EDGES}, s AS (SELECT DISTINCT l_partkey AS identity, l_orderkey % 3 AS version FROM lineitem WHERE l_quantity < 3), v AS (SELECT DISTINCT l_suppkey AS identity, l_orderkey % 3 AS version FROM lineitem WHERE l_quantity > 25),
n AS (SELECT DISTINCT target_identity AS identity, version FROM e JOIN s ON source = identity) SELECT n.identity, n.version FROM n JOIN v USING (identity, version) WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.identity = n.identity AND s.version = n.version)""")
def one_hop(spark, d):
    l = table(spark, d, "lineitem").withColumn("version", F.col("l_orderkey") % 3)  # noqa: E741
    seeds = l.filter("l_quantity < 3").select(F.col("l_partkey").alias("identity"), "version")
    held = l.filter("l_quantity > 25").select(F.col("l_suppkey").alias("identity"), "version").distinct()
    return citations.one_hop(_edges(spark, d)[0].select("source", "target_identity"), seeds, held)


@query("""WITH a AS (SELECT l_orderkey AS version_id, l_linenumber AS artifact, l_orderkey * 10 + l_linenumber AS artifact_id FROM lineitem), g AS (SELECT artifact_id FROM a WHERE artifact <= 2 AND version_id % 3 = 0),
l AS (SELECT * FROM a WHERE artifact_id NOT IN (SELECT artifact_id FROM g)), r AS (SELECT DISTINCT version_id FROM a WHERE artifact_id IN (SELECT artifact_id FROM g) AND version_id NOT IN (SELECT version_id FROM l)),
v AS (SELECT o_orderkey AS version_id, o_custkey AS instrument_id FROM orders), k AS (SELECT * FROM v WHERE version_id NOT IN (SELECT version_id FROM r)),
i AS (SELECT DISTINCT instrument_id FROM v WHERE version_id IN (SELECT version_id FROM r) AND instrument_id NOT IN (SELECT instrument_id FROM k)),
p AS (SELECT l_orderkey AS version_id, l_partkey AS identity_id FROM lineitem), o AS (SELECT p_partkey AS identity_id FROM part WHERE p_partkey NOT IN (SELECT identity_id FROM p WHERE version_id NOT IN (SELECT version_id FROM r)))
SELECT 'versions' AS part, count(*) AS n FROM r UNION ALL SELECT 'instruments', count(*) FROM i UNION ALL SELECT 'provisions', count(*) FROM p WHERE version_id IN (SELECT version_id FROM r) UNION ALL SELECT 'identities', count(*) FROM o UNION ALL SELECT 'survivors', count(*) FROM l""")
def withdraw_plan(spark, d):
    l = table(spark, d, "lineitem")  # noqa: E741
    artifacts = l.select(F.col("l_orderkey").alias("version_id"), F.col("l_linenumber").alias("line"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("artifact_id"))
    gone = artifacts.filter("line <= 2 AND version_id % 3 = 0").select("artifact_id")
    plan = corpus.withdrawal(artifacts, table(spark, d, "orders").select(F.col("o_orderkey").alias("version_id"), F.col("o_custkey").alias("instrument_id")), l.select(F.col("l_orderkey").alias("version_id"), F.col("l_partkey").alias("identity_id")), table(spark, d, "part").select(F.col("p_partkey").alias("identity_id")), gone)
    parts = [plan[k].agg(F.lit(k).alias("part"), F.count(F.lit(1)).alias("n")) for k in ("versions", "instruments", "provisions", "identities", "survivors")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


@query("""WITH n AS (SELECT o_custkey AS k, o_orderkey AS v, o_totalprice AS price FROM orders), o AS (SELECT c_custkey AS k, 0::BIGINT AS v, c_acctbal AS price FROM customer),
u AS (SELECT *, 0 AS age FROM o UNION ALL SELECT *, 1 FROM n) SELECT k, v, price FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY age DESC, v DESC) AS r FROM u) WHERE r = 1""")
def upsert_last_wins(spark, d):
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.lit(0).cast("long").alias("v"), F.col("c_acctbal").alias("price"))
    new = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"), F.col("o_totalprice").alias("price"))
    return mutation.upsert(old, new, ["k"], ["v"])


@query("SELECT min(l_partkey) AS k FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 20) GROUP BY l_partkey")
def insert_if_absent(spark, d):
    return mutation.insert_absent(table(spark, d, "part").filter("p_size > 20").select(F.col("p_partkey").alias("k")), table(spark, d, "lineitem").select(F.col("l_partkey").alias("k")), ["k"])


@query("""WITH o AS (SELECT p_partkey AS k, p_size AS v FROM part WHERE p_partkey % 3 <> 0), n AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 4 = 0 THEN p_size + 1 ELSE p_size END AS v FROM part WHERE p_partkey % 5 <> 0)
SELECT k, CASE WHEN o.v IS NULL THEN 'insert' WHEN n.v IS NULL THEN 'delete' ELSE 'update' END AS action FROM o FULL JOIN n USING (k) WHERE o.v IS DISTINCT FROM n.v""")
def sync_plan(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("v"))
    return mutation.sync(p.filter("k % 3 <> 0"), p.filter("k % 5 <> 0").withColumn("v", F.when(F.col("k") % 4 == 0, F.col("v") + 1).otherwise(F.col("v"))), ["k"])


@query("""WITH n AS (SELECT s_suppkey, s_name || CASE WHEN s_suppkey % 2 = 0 THEN '*' ELSE '' END AS s_name, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_nationkey END AS s_nationkey FROM supplier)
SELECT o.s_suppkey, 's_name' AS field, o.s_name AS before, n.s_name AS after, false AS rejected FROM supplier o JOIN n USING (s_suppkey) WHERE o.s_name <> n.s_name
UNION ALL SELECT o.s_suppkey, 's_nationkey', o.s_nationkey::VARCHAR, n.s_nationkey::VARCHAR, n.s_nationkey IS NULL FROM supplier o JOIN n USING (s_suppkey) WHERE o.s_nationkey IS DISTINCT FROM n.s_nationkey""")
def audited_changes(spark, d):
    old = table(spark, d, "supplier")
    new = old.withColumn("s_name", F.when(F.col("s_suppkey") % 2 == 0, F.concat("s_name", F.lit("*"))).otherwise(F.col("s_name"))).withColumn("s_nationkey", F.when(F.col("s_suppkey") % 5 != 0, F.col("s_nationkey")))
    return mutation.audited_changes(old, new, "s_suppkey", ["s_name", "s_nationkey"], required=("s_nationkey",))


@query("SELECT c_custkey, c_nationkey % 5 = 1 AS applied FROM customer WHERE c_custkey % 2 = 0")
def compare_and_set(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", (F.col("c_nationkey") % 5).alias("revision"))
    return mutation.compare_and_set(rows, rows.filter("c_custkey % 2 = 0").select("c_custkey", F.lit(1).alias("expected_revision")), "c_custkey").select("c_custkey", "applied")


@query("""WITH w AS (SELECT p_partkey AS resource_id, CASE WHEN p_size % 2 = 0 THEN 'grant' ELSE 'revoke' END AS request FROM part)
SELECT resource_id, request, CASE WHEN request = 'grant' THEN CASE WHEN resource_id % 3 = 0 THEN 'audit_only' ELSE 'added' END ELSE CASE WHEN resource_id % 3 = 0 THEN 'removed' ELSE 'missing' END END AS outcome FROM w""")
def grant_changes(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("resource_id"), F.when(F.col("p_size") % 2 == 0, "grant").otherwise("revoke").alias("request"))
    return mutation.grant_changes(p.filter("resource_id % 3 = 0").select("resource_id"), p, ["resource_id"])


@query("""SELECT event_type, count(value) AS n, avg(value) AS mean, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS max FROM events GROUP BY 1""")
def latency_percentiles(spark, d):
    return evaluation.percentiles(table(spark, d, "events"), "value", ["event_type"])


@query("""WITH m AS (SELECT user_id, event_type, ts, event_id, min(ts) OVER (PARTITION BY user_id) AS t0, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_type) AS nxt FROM events)
SELECT event_type, count(*) AS n, round(sum((epoch_us(coalesce(nxt, t0 + INTERVAL 90 DAYS)) - epoch_us(ts)) / 1e6), 3) AS seconds FROM m GROUP BY 1""")
def stage_times(spark, d):
    marks = table(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("state"), "ts", F.lit(90 * 86400).alias("total"))
    return evaluation.stage_times(marks).groupBy(F.col("state").alias("event_type")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("seconds"), 3).alias("seconds"))


PAIRS = ", ".join(f"('{a}', '{b}')" for a, after in gates.TRANSITIONS.items() for b in after)
STATES = [*gates.TRANSITIONS, "ANSWERED"]


@query(f"""WITH a(b, c) AS (VALUES {PAIRS}), s AS (SELECT user_id AS run_id, event_id, [{', '.join(map(repr, STATES))}][(event_id % {len(STATES)} + 1)::INT] AS state FROM events),
m AS (SELECT run_id, lag(state) OVER (PARTITION BY run_id ORDER BY event_id) AS before, state AS after FROM s)
SELECT before, after, count(*) AS n FROM m WHERE before IS NOT NULL AND before <> after AND NOT EXISTS (SELECT 1 FROM a WHERE b = before AND c = after) GROUP BY 1, 2""")
def run_transitions(spark, d):
    state = F.get(F.array(*map(F.lit, STATES)), (F.col("event_id") % len(STATES)).cast("int"))
    states = table(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), state.alias("state"))
    return gates.illegal_changes(states, gates.transitions_frame(spark)).groupBy("before", "after").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS was FROM events) WHERE was IS DISTINCT FROM event_type")
def state_changes(spark, d):
    return conversation.changes(table(spark, d, "events").select("event_id", "user_id", "event_type"), "user_id", "event_id", "event_type")


EVENT = "CASE event_type WHEN 'view' THEN 'claim' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'fail' WHEN 'signup' THEN 'fail_final' WHEN 'click' THEN 'heartbeat' ELSE 'cancel' END"


@query(f"""WITH e AS (SELECT event_id % 500 AS job_id, event_id AS seq, {EVENT} AS event FROM events), f AS (SELECT job_id, count(*) FILTER (event = 'claim') AS attempts, arg_max(event, seq) FILTER (event <> 'heartbeat') AS last, max(seq) FILTER (event IN ('claim', 'heartbeat')) AS lease_from FROM e GROUP BY 1)
SELECT job_id, attempts, CASE WHEN last = 'claim' THEN lease_from END AS lease_from, CASE WHEN last IS NOT NULL THEN CASE last WHEN 'claim' THEN 'running' WHEN 'complete' THEN 'succeeded' WHEN 'cancel' THEN 'cancelled' WHEN 'fail_final' THEN 'failed' ELSE CASE WHEN attempts < 3 THEN 'retry_wait' ELSE 'failed' END END END AS status FROM f""")
def job_fold(spark, d):
    e = table(spark, d, "events").select((F.col("event_id") % 500).alias("job_id"), F.col("event_id").alias("seq"), F.expr(EVENT).alias("event"))
    return conversation.job_fold(e)


@query("""SELECT job_id, worker, attempt_count, lease FROM (SELECT event_id AS job_id, 'w' || (row_number() OVER (ORDER BY ts, event_id) - 1) % 4 AS worker, (event_id % 3 + 1)::INT AS attempt_count, 300 AS lease, row_number() OVER (ORDER BY ts, event_id) AS r FROM events WHERE event_type IN ('view', 'error')) WHERE r <= 40""")
def claimed_jobs(spark, d):
    """The 40 oldest waiting jobs, claimed by four workers."""
    e = table(spark, d, "events")
    status = F.when(F.col("event_type").isin("view", "error"), "queued").otherwise("succeeded")
    jobs = e.select(F.col("event_id").alias("job_id"), status.alias("status"), F.col("ts").alias("created_at"), F.col("ts").alias("available_at"), (F.col("event_id") % 3).cast("int").alias("attempt_count"))
    now = F.lit("2100-01-01").cast("timestamp")
    got = conversation.claimed(jobs, now, ["w0", "w1", "w2", "w3"], 40, 300)
    return got.select("job_id", "worker", "attempt_count", (F.unix_timestamp("lease_expires_at") - F.unix_timestamp(now)).cast("int").alias("lease"))


@query("SELECT event_id, least(600, 5 * pow(2, greatest(0, event_id % 12 - 1)))::BIGINT AS seconds FROM events")
def backoff(spark, d):
    return table(spark, d, "events").select("event_id", X.backoff(F.col("event_id") % 12, 5, 600).alias("seconds"))


@query("""SELECT user_id, arg_max(json_extract_string(props, '$.k'), event_id) AS k FROM events WHERE json_extract_string(props, '$.k')::INT >= 3 GROUP BY 1""")
def payload_backtrace(spark, d):
    """The last payload value of each key, told from an event log."""
    k = F.get_json_object("props", "$.k")
    return table(spark, d, "events").filter(k.cast("int") >= 3).groupBy("user_id").agg(F.max_by(k, "event_id").alias("k"))


@query("SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 2")
def session_last_turns(spark, d):
    return conversation.last_turns(table(spark, d, "conversations"), 2).select("conv_id", "turn", "text")


@query("""SELECT conv_id, turn, CASE WHEN was IS NULL THEN text ELSE was || chr(10) || text END AS query FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS was FROM conversations WHERE role = 'user' AND trim(text) <> '')""")
def compose_query(spark, d):
    return conversation.composed(table(spark, d, "conversations"))


@query("""SELECT p_partkey, n FROM (SELECT p_partkey, try_cast(regexp_extract(replace(p_brand, 'Brand#', ''), '^[0-9]+') AS INT) AS n FROM part)""")
def article_sort_key(spark, d):
    return table(spark, d, "part").select("p_partkey", X.article_sort_key(F.replace("p_brand", F.lit("Brand#"), F.lit(""))).alias("n"))


@query("""SELECT l_orderkey AS version, string_agg(l_linestatus || l_linenumber, chr(10) ORDER BY l_linenumber, l_linestatus) AS text, min(l_linenumber) AS first FROM lineitem GROUP BY 1""")
def grouped_text(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("version"), F.concat("l_linestatus", "l_linenumber").alias("text"), F.col("l_linenumber").alias("ordinal"))
    return corpus.grouped_text(rows, ["version"])


@query("""WITH a AS (SELECT o_orderkey AS rid, o_orderkey % 2 AS author, o_custkey % 2 AS reviewer, (o_orderkey % 4)::INT AS c, (o_orderkey % 5 = 0)::INT AS h, o_orderpriority AS s FROM orders)
SELECT rid, array_to_string(list_filter([CASE WHEN s <> '1-URGENT' THEN 'not_submitted' END, CASE WHEN c = 0 THEN 'no_citations' END, CASE WHEN h > 0 THEN 'citation_not_visible' END, CASE WHEN author = reviewer THEN 'own_revision' END], lambda x: x IS NOT NULL), ',') AS blocks FROM a""")
def publish_blocks(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("rid"), (F.col("o_orderkey") % 2).alias("author"), (F.col("o_custkey") % 2).alias("reviewer"), (F.col("o_orderkey") % 4).alias("n_citations"), (F.col("o_orderkey") % 5 == 0).cast("int").alias("n_hidden"), F.when(F.col("o_orderpriority") == "1-URGENT", "submitted").otherwise("draft").alias("status"))
    return corpus.publishable(o).select("rid", F.array_join("blocks", ",").alias("blocks"))


@query("""SELECT version_id, decision, CASE WHEN decision NOT IN ('approved', 'rejected') OR rs IS NULL THEN 'invalid' WHEN decision = rs THEN 'no_change' ELSE 'applied' END AS outcome
FROM (SELECT doc_id AS version_id, CASE doc_id % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' ELSE 'maybe' END AS decision, CASE quality WHEN 1 THEN 'approved' WHEN 0 THEN 'rejected' END AS rs FROM documents LEFT JOIN labels USING (doc_id))""")
def review_decisions(spark, d):
    v = table(spark, d, "labels").select(F.col("doc_id").alias("version_id"), F.when(F.col("quality") == 1, "approved").otherwise("rejected").alias("review_status"))
    wanted = table(spark, d, "documents").select(F.col("doc_id").alias("version_id"), F.when(F.col("doc_id") % 3 == 0, "approved").when(F.col("doc_id") % 3 == 1, "rejected").otherwise("maybe").alias("decision"))
    return corpus.reviewed(v, wanted).select("version_id", "decision", "outcome")


HELD = ["reader", "editor", "legal_reviewer", "knowledge_admin", "system_admin", "auditor", "guest"]


@query(f"""WITH g(role, p) AS (VALUES {', '.join(f"('{r}', '{p}')" for r, granted in ROLES.items() for p in granted)}),
u AS (SELECT c_custkey AS user_id, unnest([c_custkey % 7, c_nationkey % 5 + 2]) AS i FROM customer), n AS (SELECT user_id, {HELD}[(i + 1)::INT] AS role FROM u)
SELECT user_id, coalesce(string_agg(DISTINCT p, ',' ORDER BY p), '') AS permissions FROM n LEFT JOIN g USING (role) GROUP BY 1""")
def role_permissions(spark, d):
    """What each customer may do under two roles, which may be one, or unknown."""
    held = F.array(*map(F.lit, HELD))
    roles = F.array_distinct(F.array(F.get(held, (F.col("c_custkey") % 7).cast("int")), F.get(held, F.col("c_nationkey") % 5 + 2)))
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.explode(roles).alias("role"))
    return access.permissions(rows).select("user_id", F.array_join("permissions", ",").alias("permissions"))


@query("SELECT job_id, created_at FROM (SELECT event_id AS job_id, ts AS created_at FROM events WHERE event_type IN ('view', 'click')) ORDER BY created_at, job_id LIMIT 50")
def next_jobs(spark, d):
    """The 50 jobs to claim next."""
    e = table(spark, d, "events").select(F.col("event_id").alias("job_id"), F.when(F.col("event_type").isin("view", "click"), "queued").otherwise("succeeded").alias("status"), F.col("ts").alias("created_at"), F.col("ts").alias("available_at"))
    return conversation.next_jobs(e, F.lit("2999-01-01").cast("timestamp"), 50).select("job_id", "created_at")


@query("SELECT event_id, CASE WHEN event_type = 'view' AND event_id % 2 = 0 THEN CASE WHEN event_id % 4 >= 3 THEN 'failed' ELSE 'retry_wait' END WHEN event_type = 'view' THEN 'running' ELSE 'queued' END AS status FROM events")
def reclaimed_jobs(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "view", "running").otherwise("queued").alias("status"), (F.col("event_id") % 4).cast("int").alias("attempt_count"), F.when(F.col("event_id") % 2 == 0, "2000-01-01").otherwise("2999-01-01").cast("timestamp").alias("lease_expires_at"), F.lit(None).cast("string").alias("error_code"))
    return conversation.reclaimed(e, F.lit("2500-01-01").cast("timestamp")).select("event_id", "status")


@query("SELECT key, put_at FROM (SELECT user_id AS key, max(ts) AS put_at FROM events GROUP BY 1) WHERE put_at + INTERVAL 1 DAY > (SELECT max(ts) FROM events)")
def alive_entries(spark, d):
    e = table(spark, d, "events")
    now = e.agg(F.max("ts").alias("now"))
    cache = e.select(F.col("user_id").alias("key"), F.col("ts").alias("put_at"), (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("expires_at"))
    newest = cache.groupBy("key").agg(F.max_by("expires_at", "put_at").alias("expires_at"), F.max("put_at").alias("put_at"))
    return conversation.alive(newest.crossJoin(F.broadcast(now)), F.col("now")).select("key", "put_at")


@query("SELECT doc_id, sha256(text) AS sha256, strlen(text)::BIGINT AS size FROM documents")
def backup_manifest(spark, d):
    return mutation.manifest(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")


@query("""SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'missing' WHEN doc_id % 7 = 0 THEN 'altered' WHEN doc_id % 6 = 0 THEN 'conflict' END AS problem FROM documents WHERE doc_id % 10 = 0 OR doc_id % 7 = 0 OR doc_id % 6 = 0""")
def restore_problems(spark, d):
    m = mutation.manifest(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")
    archive = m.filter("doc_id % 10 <> 0").withColumn("size", F.when(F.col("doc_id") % 7 == 0, F.col("size") + 1).otherwise(F.col("size")))
    present = m.filter("doc_id % 6 = 0").withColumn("sha256", F.lit("other"))
    return mutation.restore_problems(m, archive, present, "doc_id")


@query("SELECT page, min(char_start) AS char_start, max(char_end) AS char_end, arg_min(label, char_start) AS label, doc FROM (SELECT l_orderkey AS doc, l_linenumber AS page, l_partkey AS char_start, l_partkey + 9 AS char_end, l_returnflag AS label FROM lineitem WHERE l_quantity > 10) RIGHT JOIN (SELECT l_orderkey AS doc, l_linenumber AS page FROM lineitem) USING (doc, page) GROUP BY doc, page")
def page_geometry(spark, d):
    from ..operators.structure import page_geometry as geometry

    l = table(spark, d, "lineitem")  # noqa: E741
    place = F.struct("_metadata.file_path", "_metadata.row_index").alias("place")
    blocks = l.filter("l_quantity > 10").select(place, F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("page"), F.col("l_partkey").alias("char_start"), (F.col("l_partkey") + 9).alias("char_end"), F.col("l_returnflag").alias("label"))
    return geometry(blocks, l.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("page")).distinct())


