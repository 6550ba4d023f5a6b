"""The version tree: ranking, supersession, quality gate, staleness, withdrawal, review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import MEDIA_ORDER, NOT_RANKED, STATUS_ORDER, UNLABELLED
from ..sources.commits import staged


def place_in(c: Column, order: list[str]) -> Column:
    at = F.array_position(F.array(*map(F.lit, order)), c)
    return F.when(at > 0, at - 1).otherwise(NOT_RANKED)


def artifact_order(status: str = "legal_status", day: str = "promulgated_on", media: str = "media_type", imported: str = "imported_at", tie: str = "artifact_id") -> list[Column]:
    """Best artifact first: status, later promulgation, better format, later import, then id."""
    return [place_in(F.col(status), STATUS_ORDER).asc(), F.col(day).desc_nulls_last(), place_in(F.col(media), MEDIA_ORDER).asc(), F.col(imported).desc_nulls_last(), F.col(tie).asc()]


def best_artifact(artifacts: DataFrame, version: str, **columns: str) -> DataFrame:
    """The best artifact of each version."""
    first = Window.partitionBy(version).orderBy(*artifact_order(**columns))
    return artifacts.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def merged_evidence(old: str, new: str) -> Column:
    """A known value stays; an unknown one is filled in."""
    return F.when((F.col(old) == "unknown") | F.col(old).isNull(), F.coalesce(new, old)).otherwise(F.col(old))


def recomputed(versions: DataFrame, today: Column, instrument: str = "instrument_id") -> DataFrame:
    """Versions with ``new_status`` as of a day: due ones become effective, effective ones promulgated strictly earlier than the newest are repealed.

    Undated versions stay, and so do instruments without any due version.
    """
    due = (F.col("legal_status") == "not_yet_effective") & (F.col("effective_from") <= today)
    marked = versions.withColumn("_due", F.coalesce(due, F.lit(False)))
    own = Window.partitionBy(instrument)
    marked = marked.withColumn("_any", F.max("_due").over(own))
    force = F.when((F.col("legal_status") == "effective") | F.col("_due"), F.col("promulgated_on"))
    marked = marked.withColumn("_newest", F.max(force).over(own)).withColumn("_force", force)
    status = F.when(F.col("_any") & (F.col("_force") < F.col("_newest")), "repealed").when(F.col("_due"), "effective").otherwise(F.col("legal_status"))
    return marked.withColumn("new_status", status).drop("_due", "_any", "_newest", "_force")


def verdicts(facts: DataFrame) -> DataFrame:
    """Quality gate: hard reasons fail a document and hide the soft ones, which degrade it. Adds status and reasons.

    Facts: source_name, license_note, chunk_count (null: not parsed), landed, version_label, review_status, provision_count.
    """
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    nameless = F.coalesce(F.col("source_name"), F.lit("")) == ""
    hard = F.array_compact(F.array(
        F.when(nameless, "source_missing").when(blank("license_note"), "license_note_missing"),
        F.when(F.col("chunk_count").isNull(), "parse_missing").when(F.col("chunk_count") == 0, "parse_empty"),
        F.when(~F.col("landed"), "not_landed"),
    ))
    soft = F.array_compact(F.array(
        F.when(~F.col("review_status").eqNullSafe(F.lit("approved")), "review_pending"),
        F.when(F.col("version_label") == UNLABELLED, "version_unlabelled"),
        F.when(F.col("provision_count") <= 0, "no_provisions"),
    ))
    both = facts.withColumn("_hard", hard).withColumn("_soft", soft)
    status = F.when(F.size("_hard") > 0, "failed").when(F.size("_soft") > 0, "degraded").otherwise("passed")
    return both.withColumn("status", status).withColumn("reasons", F.when(F.size("_hard") > 0, F.col("_hard")).otherwise(F.col("_soft"))).drop("_hard", "_soft")


def stale_pages(citations: DataFrame) -> DataFrame:
    """(page_id, reason) of published pages whose grounds are gone.

    Rows: page_id, place, legal_status, current_sha, snapshot_sha (null: no snapshot, so not compared).
    """
    why = F.when(F.col("legal_status") == "repealed", F.concat("place", F.lit(" 所在版本已被取代"))).when(F.col("snapshot_sha") != F.col("current_sha"), F.concat("place", F.lit(" 正文已变更")))
    return citations.select("page_id", why.alias("why")).filter("why IS NOT NULL").groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_set("why")), "；").alias("reason"))


def published_citations(pages: DataFrame, revisions: DataFrame, citations: DataFrame, provisions: DataFrame, identities: DataFrame, versions: DataFrame, instruments: DataFrame) -> DataFrame:
    """What the published revision of each page cites, as ``stale_pages`` takes it; drafts and older revisions don't count.

    pages: page_id, published_revision (null: none); revisions: revision_id, page_id, number; citations: revision_id, provision_id, snapshot_sha;
    provisions: provision_id, identity_id, version_id, current_sha; identities: identity_id, provision_number; versions: version_id, instrument_id,
    legal_status; instruments: instrument_id, title.
    """
    # tables that grow are merged: their files are small beside their rows, which a broadcast would hold in each task
    shown = pages.withColumnRenamed("published_revision", "number").join(revisions.hint("merge"), ["page_id", "number"])
    cited = shown.join(citations.hint("merge"), "revision_id").join(provisions.hint("merge"), "provision_id").join(identities.hint("merge"), "identity_id")
    cited = cited.join(versions, "version_id").join(instruments, "instrument_id")
    return cited.select("page_id", F.concat_ws(" ", "title", "provision_number").alias("place"), "legal_status", "current_sha", "snapshot_sha")


def flag_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """What to write: pages to flag (new or other reason) and to clear. Both: page_id, reason."""
    both = old.select("page_id", F.col("reason").alias("was")).join(new.select("page_id", "reason"), "page_id", "full")
    return both.filter(~F.col("was").eqNullSafe(F.col("reason"))).select("page_id", F.when(F.col("reason").isNull(), "clear").otherwise("flag").alias("action"), "reason")


def grouped_text(rows: DataFrame, keys: list[str], text: str = "text", order: str = "ordinal") -> DataFrame:
    """Texts of a key joined by line breaks in order, and the first row's order."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(pairs, lambda p: p["t"]), "\n").alias("text"), F.min(order).alias("first"))


def source_conflicts(landings: DataFrame) -> DataFrame:
    """Versions that different sources landed: (version, n_sources), to be reviewed."""
    return landings.groupBy("version").agg(F.countDistinct("source").alias("n_sources")).filter("n_sources > 1")


def withdrawal(artifacts: DataFrame, versions: DataFrame, provisions: DataFrame, identities: DataFrame, gone: DataFrame) -> dict[str, DataFrame]:
    """What goes when the artifacts ``gone`` (artifact_id) are withdrawn: a plan, nothing is written.

    A version goes if all its artifacts do, an instrument if all its versions do, an identity if it keeps no provision. The versions that go are
    staged, so that the artifacts are gone through once for them and not once for each part of the plan.
    """
    left = artifacts.join(gone, "artifact_id", "left_anti")
    marked = artifacts.select("version_id", "artifact_id").join(gone.select("artifact_id").distinct().withColumn("_gone", F.lit(True)), "artifact_id", "left")
    fate = marked.groupBy("version_id").agg(F.max(F.coalesce("_gone", F.lit(False))).alias("_some"), F.min(F.coalesce("_gone", F.lit(False))).alias("_all"))
    # every other part asks for it: told once
    removed = staged(fate.filter(F.col("_some") & (F.col("_all") | F.col("version_id").isNull())).select("version_id"), "withdrawn")
    kept = versions.join(removed, "version_id", "left_anti")
    instruments = versions.join(removed, "version_id", "left_semi").select("instrument_id").distinct().join(kept, "instrument_id", "left_anti")
    staying = provisions.join(removed, "version_id", "left_anti").select("identity_id").distinct()
    orphans = identities.join(staying, "identity_id", "left_anti")
    return {"artifacts": gone, "survivors": left, "versions": removed, "instruments": instruments, "provisions": provisions.join(removed, "version_id", "left_semi"), "identities": orphans}


def publishable(revisions: DataFrame) -> DataFrame:
    """Adds ``blocks``: why a submitted revision can't be published; empty if it can. Rows: status, author, reviewer, n_citations, n_hidden."""
    return revisions.withColumn("blocks", F.array_compact(F.array(
        F.when(F.col("status") != "submitted", "not_submitted"), F.when(F.col("n_citations") == 0, "no_citations"),
        F.when(F.col("n_hidden") > 0, "citation_not_visible"), F.when(F.col("author") == F.col("reviewer"), "own_revision"),
    )))


def reviewed(versions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions with ``outcome``: applied, no_change or invalid. Only approved and rejected are decisions; legal status never changes."""
    both = decisions.join(versions.select("version_id", "review_status"), "version_id", "left")
    return both.withColumn("outcome", F.when(~F.col("decision").isin("approved", "rejected") | F.col("review_status").isNull(), "invalid").when(F.col("decision") == F.col("review_status"), "no_change").otherwise("applied"))


def linked_versions(landings: DataFrame) -> dict[str, DataFrame]:
    """The version tree of landed artifacts, built as sets: instruments, versions, identities, provisions, conflicts.

    Rows: artifact_id, source, jurisdiction, title, version_label, legal_status, promulgated_on, effective_from,
    media_type, imported_at, confident, articles (array<struct<number,text>>). Ids are hashes of the natural keys,
    so a rerun, or a relink from stored chunks, gives the same tree.
    """
    keyed = landings.withColumn("instrument_id", F.sha2(F.concat_ws("\x1f", "jurisdiction", "title"), 256)).withColumn("version_id", F.sha2(F.concat_ws("\x1f", "jurisdiction", "title", "version_label"), 256))
    # texts take no part in the ranking: only those of the best artifacts are fetched
    best = best_artifact(keyed.drop("articles"), "version_id")
    known = keyed.groupBy("version_id").agg(
        F.min("promulgated_on").alias("promulgated_on"), F.min("effective_from").alias("effective_from"),
        F.coalesce(F.max(F.when(F.col("legal_status") != "unknown", F.col("legal_status"))), F.lit("unknown")).alias("legal_status"), F.countDistinct("source").alias("n_sources"),
    )
    review = F.when((F.col("n_sources") > 1) | ~F.col("confident"), "pending").otherwise("approved")
    versions = best.select("version_id", "instrument_id", "version_label", "artifact_id", "confident").join(known, "version_id").withColumn("review_status", review)
    texts = keyed.select("version_id", "artifact_id", "articles").join(best.select("version_id", "artifact_id", "instrument_id"), ["version_id", "artifact_id"])
    numbered = texts.select("version_id", "instrument_id", F.posexplode("articles").alias("at", "a"))
    # of a repeated number the first text counts
    rows = numbered.groupBy("version_id", "instrument_id", F.col("a.number").alias("number")).agg(F.min_by("a.text", "at").alias("text"))
    provisions = rows.withColumn("identity_id", F.sha2(F.concat_ws("\x1f", "instrument_id", "number"), 256)).withColumn("text_sha256", F.sha2("text", 256))
    return {
        "instruments": keyed.select("instrument_id", "jurisdiction", "title").distinct(),
        "versions": versions.drop("confident"),
        "identities": provisions.select("identity_id", "instrument_id", "number").distinct(),
        "provisions": provisions,
        "conflicts": source_conflicts(keyed.select(F.col("version_id").alias("version"), "source")),
    }


def drafts(chunks: DataFrame) -> DataFrame:
    """Parse drafts from stored chunks (revision, ordinal, article, text): preamble texts and articles, each in order."""
    own = chunks.groupBy("revision").agg(F.array_sort(F.collect_list(F.struct("ordinal", "article", "text"))).alias("c"))
    pick = lambda keep, show: F.transform(F.filter("c", keep), show)
    return own.select("revision", pick(lambda c: c["article"].isNull(), lambda c: c["text"]).alias("preamble"), pick(lambda c: c["article"].isNotNull(), lambda c: F.struct(c["article"].alias("number"), c["text"].alias("text"))).alias("articles"))


def review_marks(runs: DataFrame, marks: DataFrame) -> DataFrame:
    """Marks with ``applied``: a run that wants review is marked once; its state stays."""
    first = Window.partitionBy("run_id").orderBy("at")
    open_runs = runs.filter("review_required AND reviewed_at IS NULL").select("run_id", F.lit(True).alias("_open"))
    return marks.withColumn("_n", F.row_number().over(first)).join(open_runs, "run_id", "left").withColumn("applied", F.coalesce("_open", F.lit(False)) & (F.col("_n") == 1)).drop("_n", "_open")


def published_revisions(pages: DataFrame, revisions: DataFrame) -> DataFrame:
    """The revision that each page's pointer names; a page without pointer has none."""
    return pages.join(revisions, (pages["page_id"] == revisions["page"]) & (pages["published_revision"] == revisions["number"]))


def numbering_gaps(articles: DataFrame, doc: str = "doc", order: str = "ordinal", number: str = "number") -> DataFrame:
    """(doc, expected, actual) where main article numbers don't follow each other."""
    before = F.coalesce(F.lag(number).over(Window.partitionBy(doc).orderBy(order)), F.lit(0)) + 1
    return articles.withColumn("expected", before).filter(F.col("expected") != F.col(number)).select(doc, "expected", F.col(number).alias("actual"))


def inherited_paths(blocks: DataFrame, levels: list[str], doc: str = "doc", order: str = "ordinal") -> DataFrame:
    """Each block with the headings in force: the last one per level since the last outer one. Column ``level`` names a heading's level, ``label`` its text."""
    upto = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out, outer = blocks, F.lit(0)
    for name in levels:
        at = F.max(F.when(F.col("level") == name, F.col(order))).over(upto)
        text = F.last(F.when(F.col("level") == name, F.col("label")), ignorenulls=True).over(upto)
        out = out.withColumn(f"_{name}", at).withColumn(name, text)
    for name in levels:
        out = out.withColumn(name, F.when(F.coalesce(F.col(f"_{name}"), F.lit(-1)) >= outer, F.col(name)))
        outer = F.greatest(outer, F.coalesce(F.col(f"_{name}"), F.lit(0)))
    return out.drop(*[f"_{n}" for n in levels])
