"""Queries on the texts of documents and pages: blocks, chunks, parsing, redaction, import checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import evaluation, gates, redaction, registered, structure
from ..sources import files
from .base import query, table



@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
b AS (SELECT doc_id, i, trim(x) AS t FROM l WHERE trim(x) <> '')
SELECT doc_id, (row_number() OVER w - 1)::INT AS ordinal, 'l' || (i - 1) AS block_id, (sum(length(t) + 1) OVER w - length(t) - 1)::INT AS char_start, (sum(length(t) + 1) OVER w - 1)::INT AS char_end, sha256(t) AS text_sha256
FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY i)""")
def text_blocks(spark, d):
    b = table(spark, d, "documents").select("doc_id", F.explode(structure.text_blocks("text")).alias("b"))
    return b.select("doc_id", "b.ordinal", "b.block_id", "b.char_start", "b.char_end", F.sha2("b.text", 256).alias("text_sha256"))


@query("""WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
b AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, trim(x) AS t FROM l WHERE trim(x) <> ''),
c AS (SELECT doc_id, k, t, 0 AS chunk, length(t) AS used FROM b WHERE k = 1
 UNION ALL SELECT b.doc_id, b.k, b.t, CASE WHEN c.used > 0 AND c.used + length(b.t) > 800 THEN c.chunk + 1 ELSE c.chunk END, CASE WHEN c.used > 0 AND c.used + length(b.t) > 800 THEN length(b.t) ELSE c.used + length(b.t) END FROM c JOIN b ON b.doc_id = c.doc_id AND b.k = c.k + 1),
o AS (SELECT *, sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY k) - length(t) - 1 AS s FROM c)
SELECT doc_id, chunk, count(*)::INT AS n_blocks, min(s)::INT AS char_start, max(s + length(t))::INT AS char_end, sha256(string_agg(t, chr(10) ORDER BY k)) AS text_sha256 FROM o GROUP BY 1, 2""")
def chunk_greedy(spark, d):
    return structure.chunk_table(table(spark, d, "documents"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
SELECT doc_id, sha256(string_agg(trim(x), chr(10) ORDER BY i)) AS text_sha256 FROM l WHERE trim(x) <> '' GROUP BY 1""")
def chunk_roundtrip(spark, d):
    """The chunks of the outline, joined, are the normalised text again."""
    b = table(spark, d, "documents").select("doc_id", structure.text_blocks("text").alias("b")).select("doc_id", structure.structured_chunks(F.transform("b", lambda b: b["text"])).alias("c"))
    return b.filter(F.size("c") > 0).select("doc_id", F.sha2(F.array_join(F.transform("c", lambda c: c["text"]), "\n"), 256).alias("text_sha256"))


@query()
def html_leaf_blocks(spark, d):
    b = table(spark, d, "pages").select("page_id", F.posexplode(files.html_blocks("html")).alias("ordinal", "b"))
    return b.select("page_id", "ordinal", "b.kind", "b.level", "b.text", "b.char_start", "b.char_end")


#: Identifiers that the test data has.
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "ipv4": r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", "digits16": r"\d{16}"}


def _redacted(spark, d):
    redact = redaction.redact_udf(redaction.pattern_detector(PATTERNS), {k: k for k in PATTERNS})
    return table(spark, d, "documents").select("doc_id", "text", redact("text").alias("r"))


ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


@query(f"""SELECT doc_id, sha256(regexp_replace(text, '{ANY}', '[X]', 'g')) AS masked_sha256, len(list_distinct(regexp_extract_all(text, '{ANY}')))::INT AS n_entities, len(regexp_extract_all(text, '{ANY}'))::INT AS n_spans FROM documents""")
def redact_pii(spark, d):
    """The redacted text with its placeholders made alike: what a mask of all identifiers gives."""
    r = _redacted(spark, d)
    masked = F.regexp_replace("r.redacted", rf"\[(?:{'|'.join(PATTERNS)})_[0-9]+\]", "[X]")
    return r.select("doc_id", F.sha2(masked, 256).alias("masked_sha256"), F.size("r.entities").alias("n_entities"), F.size("r.spans").alias("n_spans"))


@query("SELECT doc_id, sha256(text) AS text_sha256 FROM documents")
def redact_restore(spark, d):
    return _redacted(spark, d).select("doc_id", F.sha2(redaction.restore("r.redacted", "r.entities"), 256).alias("text_sha256"))


@query("SELECT doc_id, sha256(text) AS text_sha256 FROM documents")
def redact_slices(spark, d):
    """Redacted halves put together and restored give the text again: no slice shows or loses a part of a value."""
    half = (F.length("text") / 2).cast("int")
    r = _redacted(spark, d).withColumn("h", half)
    joined = F.concat(redaction.redacted_slice("text", "r.spans", F.lit(0), "h"), redaction.redacted_slice("text", "r.spans", "h", F.length("text")))
    return r.select("doc_id", F.sha2(redaction.restore(joined, "r.entities"), 256).alias("text_sha256"))


@query("""WITH RECURSIVE h AS (SELECT doc_id // 50 AS question, doc_id, n_chars + 2 AS cost, row_number() OVER (PARTITION BY doc_id // 50 ORDER BY doc_id) AS k FROM documents),
c AS (SELECT question, doc_id, k, CASE WHEN cost <= 8192 - 500 - 8 - 700 - 256 THEN cost ELSE 0 END AS used, cost <= 8192 - 500 - 8 - 700 - 256 AS fits FROM h WHERE k = 1
 UNION ALL SELECT h.question, h.doc_id, h.k, CASE WHEN c.used + h.cost <= 6728 THEN c.used + h.cost ELSE c.used END, c.used + h.cost <= 6728 FROM c JOIN h ON h.question = c.question AND h.k = c.k + 1)
SELECT question, doc_id, fits AS included FROM c""")
def evidence_budget(spark, d):
    """Evidence that fits in a context; a question's hits are 50 documents in order (a bounded list of ids and sizes)."""
    own = table(spark, d, "documents").groupBy(F.floor(F.col("doc_id") / 50).alias("question")).agg(F.array_sort(F.collect_list(F.struct("doc_id", "n_chars"))).alias("h"))
    room = gates.budget(F.lit(8192), F.lit(500), F.lit("question"), F.lit(700))
    fits = own.select("question", "h", gates.included(F.transform("h", lambda h: (h["n_chars"] + 2).cast("int")), room.cast("int")).alias("i"))
    return fits.select("question", F.explode(F.arrays_zip("h", "i")).alias("x")).select("question", "x.h.doc_id", F.col("x.i").alias("included"))


@query(r"SELECT doc_id, regexp_replace(text, '\s+', '', 'g') AS flat_text FROM documents WHERE doc_id < 0 UNION ALL SELECT doc_id, sha256(regexp_replace(text, '[\s\x{3000}\x{A0}\x{85}\x{2028}]+', '', 'g')) FROM documents")
def flatten(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(X.flatten(F.col("text")), 256).alias("flat_text"))


@query("""SELECT page_id, CASE WHEN regexp_matches(html, '(?is)^\\s*(<!--.*?-->\\s*)*<(!doctype\\s+html|html)[\\s>]') THEN 'text/html' ELSE 'text/plain' END AS media_type, CASE WHEN page_id % 2 = 0 THEN CASE WHEN regexp_matches(html, '(?is)^\\s*(<!--.*?-->\\s*)*<(!doctype\\s+html|html)[\\s>]') THEN NULL ELSE 'type_differs' END ELSE 'unknown_extension' END AS reason FROM pages""")
def import_checks(spark, d):
    p = table(spark, d, "pages").select("page_id", F.concat(F.lit("dir/page"), "page_id", F.when(F.col("page_id") % 2 == 0, ".HTML").otherwise(".exe")).alias("path"), F.encode("html", "UTF-8").alias("content"))
    return files.accepted(p).select("page_id", "media_type", "reason")


@query("SELECT sha256(text) AS sha256, strlen(text)::BIGINT AS size FROM documents GROUP BY text")
def content_store(spark, d):
    return files.stored(table(spark, d, "documents").select(F.encode("text", "UTF-8").alias("content"))).select("sha256", "size")


@query("SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''))::INT AS n_blocks FROM documents")
def sql_functions(spark, d):
    """An operator called from SQL, under its registered name."""
    registered.register(spark)
    return spark.sql("SELECT doc_id, size(ts_text_blocks(text)) AS n_blocks FROM {docs}", docs=table(spark, d, "documents"))


@query("SELECT doc_id FROM documents WHERE doc_id % 9 = 0")
def integrity_rejects(spark, d):
    """Objects whose content isn't what was registered."""
    o = table(spark, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"), F.when(F.col("doc_id") % 9 != 0, F.sha2("text", 256)).otherwise("altered").alias("sha256"))
    return files.verified(o)[1].select("doc_id")


@query("""WITH p AS (SELECT doc_id AS a, text AS x, lead(text) OVER (PARTITION BY source ORDER BY doc_id) AS y FROM documents)
SELECT a, CASE WHEN x = y THEN 0.0 ELSE round(len(list_filter(list_zip(string_split(substr(x, 1, least(length(x), length(y))), ''), string_split(substr(y, 1, least(length(x), length(y))), '')), lambda c: c[1] <> c[2]))::DOUBLE / greatest(length(x), length(y)) + abs(length(x) - length(y))::DOUBLE / greatest(length(x), length(y)), 9) END AS ratio FROM p WHERE y IS NOT NULL""")
def difference_ratio(spark, d):
    """Differences between a document and the next one of its source."""
    docs = table(spark, d, "documents")
    # neighbours are told by their ids, within ranges of ids and between them, so a large source is no single task's; the texts are joined to the pairs
    ranged = docs.select("source", F.col("doc_id").alias("a"), F.floor(F.col("doc_id") / 1000).alias("range"))
    inside = F.lead("a").over(Window.partitionBy("source", "range").orderBy("a"))
    firsts = ranged.groupBy("source", "range").agg(F.min("a").alias("first")).withColumn("after", F.lead("first").over(Window.partitionBy("source").orderBy("range"))).drop("first")
    ids = ranged.withColumn("inside", inside).join(firsts, ["source", "range"]).select("a", F.coalesce("inside", "after").alias("b")).filter("b IS NOT NULL")
    pairs = ids.join(docs.select(F.col("doc_id").alias("a"), F.col("text").alias("x")), "a").join(docs.select(F.col("doc_id").alias("b"), F.col("text").alias("y")), "b")
    return pairs.select("a", F.round(X.difference_ratio(F.col("x"), F.col("y")), 9).alias("ratio"))


@query("""SELECT count(n_chars) AS n, avg(n_chars) AS mean, quantile_disc(n_chars, 0.5) AS p50, quantile_disc(n_chars, 0.95) AS p95, max(n_chars) AS max FROM documents""")
def length_percentiles(spark, d):
    """Nearest-rank percentiles of all documents' lengths, under a single key."""
    return evaluation.percentiles(table(spark, d, "documents"), "n_chars")
