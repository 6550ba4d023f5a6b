"""Withdrawal and staleness: results by plain sets, and what their plans hold and repeat."""

import random

from textstrata.catalogue import queries
from textstrata.operators import corpus


def test_withdrawal_by_plain_sets_goes_through_artifacts_once(spark):
    r = random.Random(5)
    some = lambda n: r.choice([None, *range(n)])
    artifacts = [(some(30), some(60)) for _ in range(80)]
    versions = [(some(30), some(12)) for _ in range(40)]
    provisions = [(some(30), some(25)) for _ in range(90)]
    gone = [(some(60),) for _ in range(50)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    plan = corpus.withdrawal(
        frame(artifacts, "version_id int, artifact_id int"), frame(versions, "version_id int, instrument_id int"),
        frame(provisions, "version_id int, identity_id int"), frame([(i,) for i in [*range(30), None]], "identity_id int"), frame(gone, "artifact_id int"),
    )
    # a null is equal to nothing
    ids = {g for (g,) in gone if g is not None}
    left = [a for a in artifacts if a[1] not in ids]
    removed = {v for v, a in artifacts if a in ids} - {v for v, _ in left if v is not None}
    kept = {i for v, i in versions if v is None or v not in removed}
    instruments = {i for v, i in versions if v is not None and v in removed} - {i for i in kept if i is not None}
    going = [p for p in provisions if p[0] is not None and p[0] in removed]
    staying = {i for v, i in provisions if v is None or v not in removed}
    want = {"survivors": [(a, v) for v, a in left], "versions": [(v,) for v in removed], "instruments": [(i,) for i in instruments], "provisions": going, "identities": [(i,) for i in [*range(30), None] if i is None or i not in staying]}
    assert removed and instruments and going
    for name, rows in want.items():
        assert sorted(map(tuple, plan[name].collect()), key=str) == sorted(rows, key=str), name
    assert plan["provisions"]._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_tables_that_grow_are_not_broadcast(spark, sf):
    plan = queries()["published_staleness"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastExchange") <= 2 and plan.count("SortMergeJoin") >= 5
