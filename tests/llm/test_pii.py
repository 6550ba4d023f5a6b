import random

from brute import KINDS, all_spans, base_spans, proposals, sha, spans_text

from textstrata.llm import pii


def rows():
    r = random.Random(1)
    out = [(i, "".join(r.choice("abZ09.@-+() %:é\n:" if i % 2 else "0123459.@-+() ") for _ in range(r.randint(0, 120)))) for i in range(1500)]
    return out + [
        (90001, None), (90002, ""), (90003, "mail a@b.c%d@e.f x@y.z card 4111 1111 1111 1111 ok +1 (743) 555-3824 at 1.2.3.4.5.6.7.8 and 00001.002.3.255 999.1.1.1"),
        (90004, "a." * 30_000 + "@b.c" + "1" * 50_000 + " 1.1.1.1" * 2000), (90005, "write to bob [at] mail [dot] example.com or call (415) 555-2671 now"), (90006, "+1 4111 1111 1111 1111 a@b.co"), (90003, "é1.2.3.4"),
    ]


def test_base_spans_by_brute_force(spark, folder):
    data = rows()
    d = folder(documents=([(*r, "x", 1) for r in data], "doc_id long, text string, found string, base int"))
    got = sorted((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.op8_pii(spark, d).collect())
    want = sorted((i, *[sum(k == x for _, k, _ in base_spans(t)) for x in range(4)], sha(spans_text(base_spans(t)))) for i, t in data)
    assert got == want


def test_added_spans_by_brute_force(spark, folder):
    r = random.Random(5)
    bits = ["bob [at] mail [dot] example.com", "x (at) y.zz", "(415) 555-2671", "212.555.0199", "2001:db8:1:2:3:4:5:6", "999.1.1.1", "4111 1111 1111 1112", "+12 34 56", "a@b.co", "+1 (743) 555-3824", "call", "host", "mail", "\n", "é", "12", "111-111-1111", "fax:"]
    data = [(i, " ".join(r.choice(bits) for _ in range(r.randint(0, 12)))) for i in range(400)] + [x for x in rows() if x[0] < 1500 or x[0] in (90003, 90006)]
    d = folder(documents=(data, "doc_id long, text string"))
    docs = spark.read.parquet(f"{d}/documents.parquet")
    found = pii.candidates(docs).cache()
    shapes = sorted((i.doc_id, c.start, c.k, c.stop, *[c[n] for n in (*pii.LABELERS, *pii.SHAPES)]) for i in found.select("doc_id", "found").collect() for c in i.found if not c.base)
    want = sorted((i, a, k, b, *votes, *shape) for i, t in data for a, k, b, votes, shape in proposals(t, pii))
    assert shapes == want
    weights = pii.fit(found)
    got = sorted((x.doc_id, x.spans) for x in pii.op8_pii(spark, d).collect())
    assert got == sorted((i, spans_text(all_spans(t, pii, weights))) for i, t in data)
    assert any(len(all_spans(t, pii, weights)) > len(base_spans(t)) for _, t in data)


def test_running_folds(spark):
    from pyspark.sql import functions as F

    from textstrata.llm.common import running

    r = random.Random(2)
    data = [(i, [r.randint(0, 99) for _ in range(n)]) for i, n in enumerate([0, 1, 127, 128, 129, 255, 256, 1000, 20_000])]
    df = spark.createDataFrame(data, "i int, v array<int>")
    got = {x.i: (x.s, x.m) for x in df.select("i", running(F.col("v"), lambda a, b: a + b).alias("s"), running(F.col("v"), F.greatest).alias("m")).collect()}
    for i, v in data:
        sums, tops = [0], [0]
        for x in v:
            sums.append(sums[-1] + x), tops.append(max(tops[-1], x))
        assert got[i] == (sums, tops)


def test_redaction_of_many_and_long(spark):
    unit = "é mail a@b.co, +1 4111 1111 1111 1111 x 1.2.3.4\n"
    texts = [unit * 700, "x" * 5000 + " a@b.co " + "y" * 3000, ("z" * 1023 + " ") * 3 + "1.2.3.4", "a@b.co", "a@b.co" + "w" * 1018 + " 1.2.3.4 "]
    got = {r.i: r.text for r in pii.redact(spark.createDataFrame(list(enumerate(texts)), "i int, text string")).collect()}
    for i, t in enumerate(texts):
        want, at, top = "", 0, 0
        for a, k, b in base_spans(t):
            if a >= top:
                want += t[at:a] + f"[{list(KINDS)[k].upper()}]"
            at = top = max(top, b)
        assert got[i] == want + t[at:], i


def test_added_spans_keep_the_base_and_find_other_forms(spark, folder):
    d = folder(documents=(rows()[-5:] + [(1, "the sum of 555 and 1234 in 1999-2004 at 10:20:30")], "doc_id long, text string"))
    got = {r.doc_id: r.spans for r in pii.op8_pii(spark, d).collect() if r.doc_id != 90003}
    assert got[90005] == "email:9:40,phone:49:63" and got[1] == ""


def test_redaction(spark):
    df = spark.createDataFrame([(1, "é a@b.c and +1 (743) 555-3824!", 0), (2, None, 0), (3, "", 0), (4, "nothing", 0)], "doc_id int, text string, spans int")
    got = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert got == {1: "é [EMAIL] and [PHONE]!", 2: None, 3: "", 4: "nothing"}
    assert pii.redact(df).columns == df.columns and pii.redact(df.limit(0)).count() == 0


def test_reliabilities_are_found():
    """Labelers that agree with a hidden truth more often get more weight."""
    r = random.Random(4)
    counts = {}
    for _ in range(4000):
        y = r.random() < 0.5
        votes = tuple((1 if (r.random() < p) == y else -1) for p in (0.95, 0.9)) + (1 if y and r.random() < 0.5 else 0, 1 if r.random() < 0.8 else -1)
        counts[votes] = counts.get(votes, 0) + 1
    patterns = sorted(counts.items())
    prior, theta, post = pii.expectation_maximisation(patterns)
    assert abs(prior - 0.5) < 0.15 and theta["strict"][1][2] > 0.8 and theta["strict"][0][0] > 0.8
    w = pii.span_classifier([(v, (0, 0, 0, 0, 0), n) for v, n in patterns], dict(zip([v for v, _ in patterns], post)))
    assert w[1] > 0 > w[2] and abs(w[1]) > abs(w[7])
    assert set(KINDS) == set(pii.KINDS)
