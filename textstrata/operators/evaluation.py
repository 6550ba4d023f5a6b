"""Quality of retrieval and answers, judges and parsers."""

from __future__ import annotations

import math
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numerals import mentioned_articles
from ..functions.text import flatten, short_title
from ..functions.values import ABSTAINS, FLAGS
from ..sources.commits import staged

LOWER_IS_BETTER = ("forbidden_rate", "over_abstain_rate")


def query_scores(hits: DataFrame, expected: DataFrame, query: str = "query_id", key: str = "doc_id") -> DataFrame:
    """Per query: n_expected, n_returned, found, first_rank, rr, recall, found and returned at 5 and 10. Hits carry ``rank`` from 1."""
    wanted = expected.select(query, key).distinct()
    good = hits.join(wanted.withColumn("_good", F.lit(1)), [query, key], "left").withColumn("_good", F.coalesce("_good", F.lit(0)))
    return graded_scores(good, wanted.groupBy(query).agg(F.count(F.lit(1)).alias("n_expected")), query)


def graded_scores(good: DataFrame, sizes: DataFrame, query: str = "query_id") -> DataFrame:
    """The same of hits that are graded already (``_good`` 1 or 0) and the number expected of each query, where pairs that are expected would be many."""
    at = lambda k: [F.sum(F.when(F.col("rank") <= k, F.col("_good")).otherwise(0)).alias(f"found_{k}"), F.sum(F.when(F.col("rank") <= k, 1).otherwise(0)).alias(f"returned_{k}")]
    own = good.groupBy(query).agg(F.sum("_good").alias("found"), F.count(F.lit(1)).alias("n_returned"), F.min(F.when(F.col("_good") == 1, F.col("rank"))).alias("first_rank"), *at(5), *at(10))
    both = sizes.join(own, query, "full").na.fill(0, ["n_expected", "found", "n_returned", "found_5", "returned_5", "found_10", "returned_10"])
    return both.withColumn("rr", F.coalesce(1 / F.col("first_rank"), F.lit(0.0))).withColumn("recall", F.when(F.col("n_expected") > 0, F.col("found") / F.col("n_expected")))


def retrieval_metrics(scores: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Micro recall, precision over what was returned, macro MRR; recall_at_1 counts a query's recall if its first hit ranks first.

    With ``runs`` (query_id, elapsed_ms, error), also the queries asked, those that failed, and the mean of their times; a query that neither
    expects nor returns anything has no scores, but a run.
    """
    scored = F.col("n_expected") > 0
    only = lambda c: F.when(scored, c)
    ratio = lambda a, b: F.when(F.sum(b) > 0, F.sum(a) / F.sum(b))
    told = scores.agg(
        F.count_if(scored).alias("n_scored"), ratio(only(F.col("found")), only(F.col("n_expected"))).alias("recall"), ratio(only(F.col("found")), only(F.col("n_returned"))).alias("precision"),
        ratio(only(F.col("found_5")), only(F.col("n_expected"))).alias("recall_at_5"), ratio(only(F.col("found_5")), only(F.col("returned_5"))).alias("precision_at_5"), ratio(only(F.col("found_10")), only(F.col("returned_10"))).alias("precision_at_10"),
        F.avg(only(F.when(F.col("first_rank") == 1, F.col("recall")).otherwise(0.0))).alias("recall_at_1"), F.avg(only(F.col("rr"))).alias("mrr"), F.count_if(~scored & (F.col("n_returned") > 0)).alias("false_positives"),
    )
    # two single rows
    return told if runs is None else told.crossJoin(runs.agg(F.count(F.lit(1)).alias("queries"), F.count_if("error").alias("errors"), F.avg("elapsed_ms").alias("avg_ms")))


def _any(c: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(c, w))


def answer_scores(cases: DataFrame) -> DataFrame:
    """Per case: recalls, coverage, inventions, abstaining.

    Columns: id, answer, evidence (array of struct law, article), expect (same), required, forbidden (arrays), expect_abstain,
    status_flag_required, cited_ids (array, null for free text), abstained (null: told from the words).
    """
    flat = flatten(F.coalesce("answer", F.lit("")))
    pair = lambda p: F.struct(p["law"].alias("law"), p["article"].alias("article"))
    laws = F.array_distinct(F.transform("evidence", lambda e: e["law"]))
    named = lambda law: F.contains(F.col("_flat"), short_title(law)) | F.contains(F.col("_flat"), law)
    c = cases.withColumn("_flat", flat).withColumn("_articles", F.array_distinct(mentioned_articles(F.coalesce("answer", F.lit("")))))
    by_id = F.filter("expect", lambda x: F.exists("cited_ids", lambda i: F.coalesce(pair(F.get("evidence", i.try_cast("int") - 1)) == pair(x), F.lit(False))))
    by_text = F.filter("expect", lambda x: F.array_contains("_articles", x["article"]) & ((F.size(laws) == 1) | (F.array_contains(laws, x["law"]) & named(x["law"]))))
    ids = F.transform(F.sequence(F.lit(1), F.greatest(F.size("evidence"), F.lit(1))), lambda i: i.cast("string"))
    facts = lambda name: F.filter(F.transform(name, flatten), lambda f: f != "")
    has = lambda f: F.contains(F.col("_flat"), f)
    ratio = lambda a, b: F.when(F.size(b) > 0, F.size(a) / F.size(b))
    gone = F.coalesce("abstained", _any(F.col("_flat"), ABSTAINS))
    return c.select(
        "id", "expect_abstain", ratio(F.when(F.col("cited_ids").isNotNull(), by_id).otherwise(by_text), F.col("expect")).alias("citation_recall"),
        F.array_except("_articles", F.transform("evidence", lambda e: e["article"])).alias("unwarranted"),
        F.when(F.col("cited_ids").isNotNull(), F.array_except("cited_ids", F.when(F.size("evidence") > 0, ids).otherwise(F.array().cast("array<string>")))).otherwise(F.array().cast("array<string>")).alias("unwarranted_ids"),
        ratio(F.filter(facts("required"), has), facts("required")).alias("fact_coverage"), F.filter(facts("forbidden"), has).alias("forbidden_hits"),
        gone.alias("abstained"), (gone == F.col("expect_abstain")).alias("abstain_correct"), "status_flag_required", _any(F.col("_flat"), FLAGS).alias("status_flagged"),
    )


def answer_summary(scores: DataFrame) -> DataFrame:
    """Means over the cases that a metric applies to; null if there is none."""
    rate = lambda c, of=F.lit(True): F.avg(F.when(of, c.cast("double")))
    return scores.agg(
        F.avg("citation_recall").alias("citation_recall"), rate((F.size("unwarranted") == 0) & (F.size("unwarranted_ids") == 0)).alias("no_fabrication_rate"), F.avg("fact_coverage").alias("fact_coverage"),
        rate(F.size("forbidden_hits") > 0).alias("forbidden_rate"), rate(F.col("abstain_correct"), F.col("expect_abstain")).alias("abstain_accuracy"), rate(F.col("abstained"), ~F.col("expect_abstain")).alias("over_abstain_rate"),
        rate(F.col("status_flagged"), F.col("status_flag_required")).alias("status_flag_rate"),
    )


def against_thresholds(summary: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """(metric, value, threshold, ok); a metric without value has no verdict."""
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.lit(float(t)).alias("threshold"), (F.col(m) <= t if m in LOWER_IS_BETTER else F.col(m) >= t).alias("ok")) for m, t in thresholds.items()])
    return summary.select(F.explode(rows).alias("r")).select("r.*")


def judge_rates(verdicts: DataFrame, batch: str | None = None) -> DataFrame:
    """Defects that the judge found and sound claims that it let pass. Rows: expect_supported, supported (null: no verdict)."""
    said = F.coalesce("supported", F.lit(False))
    rates = [F.count(F.lit(1)).alias("n"), F.avg(F.when(~F.col("expect_supported"), (~said).cast("double"))).alias("defect_detection"), F.avg(F.when(F.col("expect_supported"), said.cast("double"))).alias("acceptance")]
    return verdicts.groupBy(batch).agg(*rates) if batch else verdicts.agg(*rates)


def flattened_groups(groups: DataFrame) -> DataFrame:
    """Claims of groups as rows: id, position, claim."""
    return groups.select("id", F.posexplode("claims").alias("position", "c")).select("id", "position", "c.*")


def case_problems(cases: DataFrame) -> DataFrame:
    """(id, problems) of gold cases whose structure is wrong. Columns: id, category, question, evidence, expect, required, expect_abstain, abstain_kind."""
    known = F.col("category").isin("grounded", "multi", "status", "abstain")
    repeated = F.count(F.lit(1)).over(Window.partitionBy("id")) > 1
    outside = F.size(F.array_except("expect", "evidence")) > 0
    problems = F.array_compact(F.array(
        F.when(repeated, "repeated_id"), F.when(~F.coalesce(known, F.lit(False)), "unknown_category"), F.when(F.trim(F.coalesce("question", F.lit(""))) == "", "no_question"), F.when(outside, "expected_outside_evidence"),
        F.when(F.col("expect_abstain") & (F.size("expect") > 0), "abstain_with_citations"), F.when(F.col("expect_abstain") & ~F.coalesce(F.col("abstain_kind").isin("no_evidence", "irrelevant"), F.lit(False)), "unknown_abstain_kind"),
        F.when(~F.col("expect_abstain") & (F.size("expect") == 0), "nothing_expected"),
    ))
    return cases.withColumn("problems", problems).filter(F.size("problems") > 0).select("id", "problems")


#: Parts of a quantile sketch, how far about a rank its range reaches, and spans that a range is counted by.
SKETCH, MARGIN, SPANS = 1000, 0.002, 256


def _selected(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """(k, share, value) by range counts: the value of the rank in [low, high], or null if the rank lies outside. bounds: k and sought (share, rank, low, high)."""
    placed = rows.join(bounds, "k").select("k", "v", F.explode(F.filter("sought", lambda s: F.col("v") <= s["high"])).alias("s"))
    inside = F.col("v") >= F.col("s.low")
    part = F.floor((F.col("v") - F.col("s.low")) / F.nullif(F.col("s.high") - F.col("s.low"), F.lit(0)) * SPANS)
    # values below the range are one group; infinite ends leave no parts, which is right, if coarse
    span = F.when(~inside, -1).when(F.col("v") == F.col("s.high"), SPANS).when(part.between(0, SPANS - 1), part).otherwise(0).cast("int")
    counts = placed.select("k", "s.share", "s.rank", span.alias("span"), F.when(inside, F.col("v")).alias("v")).groupBy("k", "share", "rank", "span", "v").agg(F.count(F.lit(1)).alias("c"))
    sums = counts.groupBy("k", "share", "rank", "span").agg(F.sum("c").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("k", "share").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    home = sums.withColumn("before", before).filter((F.col("before") < F.col("rank")) & (F.col("before") + F.col("c") >= F.col("rank")) & (F.col("span") >= 0)).select("k", "share", "span", "before")
    so_far = F.col("before") + F.sum("c").over(Window.partitionBy("k", "share").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    told = counts.join(home, ["k", "share", "span"]).withColumn("so_far", so_far).filter(F.col("so_far") >= F.col("rank")).groupBy("k", "share").agg(F.min("v").alias("value"))
    every = bounds.select("k", F.explode("sought").alias("s")).select("k", "s.share")
    return every.join(told, ["k", "share"], "left")


def order_statistics(rows: DataFrame, shares: tuple[float, ...]) -> DataFrame:
    """Per key k of rows (k, v) and share p: the exact value of rank ceil(p * n) (nearest rank; nulls don't count, NaN is the greatest), as (k, share, value).

    Two passes: quantile sketches, which combine before their shuffle, give a range about each rank; then range counts find the rank: how many
    values are below, how many are in each span of the range, and, of the one span that holds it, how often each value occurs. Only that
    span's distinct values are ordered, so a key with all rows is no single task's work. A sketch may err: where the counts show that a rank
    lies outside its range, it is sought among all values.
    """
    valid = rows.filter("v IS NOT NULL")
    steps = F.array(*[F.lit(i / SKETCH) for i in range(SKETCH + 1)])
    sketches = valid.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("v", steps, 10 * SKETCH).alias("cuts"), F.min("v").alias("least"), F.max("v").alias("most"))
    cut = lambda i: F.get("cuts", F.lit(int(min(SKETCH, max(0, i)))))
    rank = lambda p: F.greatest(F.lit(1), F.ceil(F.col("n") * p)).cast("long")
    sought = [F.struct(F.lit(p).alias("share"), rank(p).alias("rank"), cut(math.floor((p - MARGIN) * SKETCH)).alias("low"), cut(math.ceil((p + MARGIN) * SKETCH)).alias("high")) for p in shares]
    sketched = staged(sketches.select("k", F.array(*sought).alias("sought"), "least", "most"), "sketches")
    found = staged(_selected(valid, sketched.select("k", "sought")), "ranks")
    missed = found.filter("value IS NULL").select("k").distinct()
    if missed.isEmpty():
        return found
    whole = F.transform("sought", lambda s: F.struct(s["share"].alias("share"), s["rank"].alias("rank"), F.col("least").alias("low"), F.col("most").alias("high")))
    return found.join(missed, "k", "left_anti").unionByName(_selected(valid, sketched.join(missed, "k", "left_semi").select("k", whole.alias("sought"))))


def percentiles(df: DataFrame, value: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """n, mean, nearest-rank p50 and p95, max, exact; without values n is 0 and the rest null."""
    keyed = df.select(F.struct(*by).alias("k") if by else F.struct(F.lit(0).alias("all")).alias("k"), F.col(value).alias("v"))
    aggregates = [F.count("v").alias("n"), F.avg("v").alias("mean"), F.max("v").alias("max")]
    whole = keyed.groupBy("k").agg(*aggregates) if by else keyed.agg(*aggregates).withColumn("k", F.struct(F.lit(0).alias("all")))
    ranks = order_statistics(keyed, (0.5, 0.95)).groupBy("k").agg(*[F.max(F.when(F.col("share") == p, F.col("value"))).alias(name) for p, name in ((0.5, "p50"), (0.95, "p95"))])
    return whole.join(ranks, "k", "left").select(*[F.col(f"k.{b}").alias(b) for b in by], "n", "mean", "p50", "p95", "max")


def stage_times(marks: DataFrame, run: str = "run_id", state: str = "state", ts: str = "ts", end: str = "total") -> DataFrame:
    """(run, state, seconds) from each mark to the next one, the last to the run's end (seconds since its first mark)."""
    own = Window.partitionBy(run).orderBy(ts, state)
    whole = Window.partitionBy(run)
    at = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    stop = F.coalesce(F.lead(at).over(own), F.min(at).over(whole) + F.col(end))
    return marks.select(run, state, (stop - at).alias("seconds"))


def parser_checks(runs: DataFrame) -> DataFrame:
    """Per back end: documents, compliance (all offsets contiguous and text round-trips), mean coverage, seconds. Rows: backend, contiguous, round_trip, coverage, seconds, memory_mb."""
    return runs.groupBy("backend").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("contiguous") & F.col("round_trip")).alias("compliant"), F.avg("coverage").alias("coverage"), F.sum("seconds").alias("seconds"), F.max("memory_mb").alias("memory_mb"))


def recommended(checks: DataFrame) -> DataFrame:
    """The fastest compliant back end; memory, then name break ties; none if none complies."""
    return checks.filter("compliant").orderBy("seconds", "memory_mb", "backend").limit(1).select("backend")


def corpus_problems(cases: DataFrame, corpus: DataFrame) -> DataFrame:
    """(id, problem) of gold cases against the corpus (law, article, text): evidence that isn't there, facts that no expected text has.

    Cases: id, evidence and expect (array<struct<law,article>>), facts (array of text).
    """
    rows = cases.select("id", F.explode("evidence").alias("e")).select("id", "e.law", "e.article")
    missing = rows.join(corpus.select("law", "article"), ["law", "article"], "left_anti").select("id", F.lit("evidence_not_in_corpus").alias("problem"))
    texts = cases.select("id", F.explode("expect").alias("e")).select("id", "e.law", "e.article").join(corpus, ["law", "article"]).groupBy("id").agg(F.collect_list(flatten(F.col("text"))).alias("t"))
    held = cases.join(texts, "id", "left").withColumn("t", F.coalesce("t", F.array().cast("array<string>")))
    lost = held.filter(F.exists("facts", lambda f: ~F.exists("t", lambda t: F.contains(t, flatten(f))))).select("id", F.lit("fact_not_in_expected_text").alias("problem"))
    return missing.distinct().unionAll(lost)


def pinned_evidence(cases: DataFrame, provisions: DataFrame) -> DataFrame:
    """The provisions that the cases' (law, article) pairs name: a semi-join on both."""
    pairs = cases.select(F.explode("evidence").alias("e")).select("e.law", "e.article").distinct()
    return provisions.join(pairs, ["law", "article"], "left_semi")


def concurrency(spark: SparkSession, request: Callable[[str], DataFrame], texts: list[str], levels: list[int], rounds: int = 3) -> list[dict]:
    """Per level: requests, seconds, requests a second, and mean, p50 and p95 of their latencies in ms; ``rows`` is what all of them returned.

    A level runs ``rounds`` rounds of that many requests at once, each a Spark job of its own in a scheduler pool of its own (they share the
    executors evenly where spark.scheduler.mode is FAIR). Texts are taken in turn. A request that fails counts as an error and has no latency.
    """
    from concurrent.futures import ThreadPoolExecutor

    from pyspark import InheritableThread

    def one(text: str, pool: str) -> tuple[float | None, int]:
        got: list = [None, 0]

        def work() -> None:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", pool)
            begun = time.perf_counter()
            try:
                got[1] = request(text).count()
                got[0] = time.perf_counter() - begun
            except Exception:  # an unanswered request is a result of the measurement
                got[0] = None

        # a thread of its own, whose local properties are its own in the JVM, too
        thread = InheritableThread(target=work)
        thread.start()
        thread.join()
        return tuple(got)

    out = []
    for level in levels:
        told, begun = [], time.perf_counter()
        with ThreadPoolExecutor(level) as pool:
            for r in range(rounds):
                told += pool.map(lambda i, r=r: one(texts[(r * level + i) % len(texts)], f"level{level}-{i}"), range(level))
        wall = time.perf_counter() - begun
        times = sorted(t for t, _ in told if t is not None)
        rank = lambda p: times[max(1, math.ceil(len(times) * p)) - 1] * 1000 if times else None  # noqa: E731, B023
        out.append({
            "level": level, "n": len(told), "errors": sum(t is None for t, _ in told), "seconds": wall, "per_second": len(told) / wall,
            "mean_ms": sum(times) * 1000 / len(times) if times else None, "p50_ms": rank(0.5), "p95_ms": rank(0.95), "rows": sum(n for _, n in told),
        })
    return out
