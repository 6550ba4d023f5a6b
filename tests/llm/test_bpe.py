import base64

import pytest
from brute import sha
from hypothesis import given, settings
from hypothesis import strategies as st

from textstrata.llm import bpe, token_counts


@pytest.fixture(scope="module")
def plain():
    import public_tokenizers as p
    import tiktoken

    with open(p.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = ["", None, "Hello  world\n\n x", "<|endoftext|> hi", "é🤝🏽漢字 'S don't", "\0\x01", " " * 3000, "a" * 20_000, "1234567 ١٢٣", " \u0085\xa0x", "abc"]


def test_ids_and_bytes_are_the_plain_encoder_s(spark, folder, plain):
    rows = [(i if i else None, t, "x") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "y")]
    d = folder(documents=(rows, "doc_id long, text string, ids string"))
    want = sorted((str(i), len(e := plain.encode_ordinary(t or "")), sha(b"".join(x.to_bytes(4, "little") for x in e)), sha((t or "").encode())) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op2_bpe(spark, d).collect()) == want


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_any_text(plain, text):
    own = bpe.codec(bpe.vocabulary())
    ids = own.encode([text])[0]
    assert ids == plain.encode_ordinary(text) and own.decode(ids) == text.encode()
    starts, ends, split = own.spans(text.encode(), ids)
    char_of = [k for k, c in enumerate(text) for _ in c.encode()]
    heads = {len(text[:k].encode()) for k in range(len(text) + 1)}
    at = 0
    for i, s, e, x in zip(ids, starts, ends, split):
        stop = at + len(own.bytes_of[i])
        # a token's span is that of the characters it touches
        assert (s, e, x) == (char_of[at], char_of[stop - 1] + 1, at not in heads or stop not in heads)
        at = stop
    assert at == len(text.encode())


def test_encode_then_decode(spark):
    df = spark.createDataFrame([(1, "añb🤝", "n"), (2, None, "m")], "k int, text string, n_tokens string")
    out = {r.k: r for r in bpe.decode(bpe.encode(df, spans=True)).collect()}
    assert bytes(out[1].decoded).decode() == "añb🤝" and out[2].n_tokens == 0 and bytes(out[2].decoded) == b""
    assert out[1].n_split > 0 and out[1].ends[-1] == 4
    assert bpe.round_trip(df.limit(0)).count() == 0


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_sections_by_brute_force(spark, plain, rule):
    texts = ["a\n\nbc d\n", "", None, "x" * 50 + "\n" + "é🤝\n" * 30, "\n\n\n\n\n  x\n\n", "one line"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    own = bpe.codec(bpe.vocabulary())
    for r in token_counts.section_tokens(df, rule=rule).collect():
        text = texts[r.doc_id] or ""
        cuts = [i for i in range(len(text)) if i == 0 or text[i - 1] == "\n"]
        line_of = [sum(c <= i for c in cuts) - 1 for i in range(len(text))]
        ids = plain.encode_ordinary(text)
        want = [0] * len(cuts)
        for s, e in zip(*own.spans(text.encode(), ids)[:2]):
            held = line_of[s:e]
            want[held[0] if rule == "start" else held[-1] if rule == "end" else max(sorted(set(held)), key=lambda k: (held.count(k), -k))] += 1
        assert list(r.section_tokens) == want and sum(want) == r.n_tokens == len(ids) and r.n_sections == len(cuts)
