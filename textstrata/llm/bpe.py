"""Operator 2, byte-level BPE encoding and decoding.

The tokenizers library encodes Arrow batches, in sub-batches of bounded size.
Token ids map to byte strings through the reversed byte-to-character table;
byte offsets become code-point offsets by counting the bytes that start a
character, so a token that splits a character gets the span of that character.
Decoding joins the byte strings; only whole results are read as UTF-8.

Defined results: null text is the empty text (no tokens, empty bytes); special
tokens' strings are ordinary text; repeated rows give repeated results; an
empty table gives an empty result; other columns are carried through unless
they clash with the added ones, which win.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

#: Bytes of text that are encoded at once in a worker.
STEP_BYTES = 2 << 20


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Path of a public vocabulary; other files can be given by their own paths."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_table() -> dict[str, int]:
    """Character to byte, reversed from the usual rule: printable Latin-1 stands for itself, the rest is counted up from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Codec:
    """A loaded vocabulary: encoder, and per id its bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.encoder.encode_special_tokens = True
        table = byte_table()
        vocab = self.encoder.get_vocab(with_added_tokens=False)
        size = max(vocab.values()) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(table[c] for c in token) if all(c in table for c in token) else token.encode()
        self.length_of = np.array([len(b) for b in self.bytes_of], dtype=np.int64)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.encoder.encode_batch_fast(texts, add_special_tokens=False)]

    def decode(self, ids) -> bytes:
        table = self.bytes_of
        return b"".join([table[i] for i in ids])

    def spans(self, raw: bytes, ids) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Code-point start and end of each token, and whether it splits a character."""
        heads = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
        count = np.concatenate(([0], np.cumsum(heads)))
        ends = np.cumsum(self.length_of[np.asarray(ids, np.int64)])
        starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
        is_head = np.concatenate((heads, [True]))
        inside_start, inside_end = ~is_head[starts], ~is_head[ends]
        return (count[starts] - inside_start).astype(np.int32), count[ends].astype(np.int32), inside_start | inside_end


@functools.cache
def codec(path: str) -> Codec:
    return Codec(path)


def steps(texts: list[str], most: int = STEP_BYTES) -> Iterator[list[str]]:
    """Consecutive runs of texts of about ``most`` characters; one longer text is a run of its own."""
    run: list[str] = []
    size = 0
    for t in texts:
        if run and size + len(t) > most:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


def _keep(df: DataFrame, added: set[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in added])


def encode(df: DataFrame, text: str = "text", path: str | None = None, spans: bool = False) -> DataFrame:
    """Adds n_tokens (long) and ids (binary, little-endian unsigned 32-bit); with ``spans`` also
    starts, ends (array<int>, code points, end exclusive) and n_split (tokens that split a character)."""
    path = path or vocabulary()
    small_batches(df.sparkSession)
    added = {"n_tokens": T.LongType(), "ids": T.BinaryType()}
    if spans:
        added |= {"starts": T.ArrayType(T.IntegerType()), "ends": T.ArrayType(T.IntegerType()), "n_split": T.LongType()}
    kept = [f for f in df.schema.fields if f.name.lower() not in added]
    schema = T.StructType(kept + [T.StructField(n, t) for n, t in added.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            at = 0
            for texts in steps(["" if t is None else t for t in batch.column(text).to_pylist()]):
                rows = batch.slice(at, len(texts))
                at += len(texts)
                ids = own.encode(texts)
                columns = [rows.column(f.name) for f in kept]
                columns += [pa.array([len(i) for i in ids], pa.int64()), pa.array([np.array(i, "<u4").tobytes() for i in ids], pa.binary())]
                if spans:
                    found = [own.spans(t.encode(), i) for t, i in zip(texts, ids, strict=True)]
                    columns += [pa.array([s for s, _, _ in found], pa.list_(pa.int32())), pa.array([e for _, e, _ in found], pa.list_(pa.int32())), pa.array([int(x.sum()) for _, _, x in found], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """Adds decoded (binary): the bytes of packed ``ids``. Null ids give null."""
    path = path or vocabulary()
    small_batches(df.sparkSession)
    kept = [f for f in df.schema.fields if f.name.lower() != "decoded"]
    schema = T.StructType([*kept, T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                out = [None if i is None else own.decode(np.frombuffer(i, "<u4").tolist()) for i in rows.column(ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([*[rows.column(f.name) for f in kept], pa.array(out, pa.binary())], names=[f.name for f in schema.fields])

    return df.mapInArrow(run, schema)


def round_trip(df: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """``decode(encode(df))`` in one pass of the workers: n_tokens, ids and decoded are added, the text is dropped."""
    path = path or vocabulary()
    small_batches(df.sparkSession)
    added = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())]
    kept = [f for f in df.schema.fields if f.name.lower() not in {"n_tokens", "ids", "decoded", text.lower()}]
    schema = T.StructType(kept + added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            at = 0
            for texts in steps(["" if t is None else t for t in batch.column(text).to_pylist()]):
                rows = batch.slice(at, len(texts))
                at += len(texts)
                ids = own.encode(texts)
                out = [pa.array([len(i) for i in ids], pa.int64()), pa.array([np.array(i, "<u4").tobytes() for i in ids], pa.binary()), pa.array([own.decode(i) for i in ids], pa.binary())]
                yield pa.RecordBatch.from_arrays([*[rows.column(f.name) for f in kept], *out], names=[f.name for f in schema.fields])

    return df.mapInArrow(run, schema)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return round_trip(docs).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


__all__ = ["Codec", "codec", "decode", "encode", "op2_bpe", "round_trip", "vocabulary"]
