"""Files: import, media types, safety, names, content store, parsers, JSON sets and reports."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrow import arrow_udf
from ..functions.values import BLOCK_ELEMENTS, LEFT_OUT_ELEMENTS, MEDIA_TYPES
from ..operators.structure import BLOCKS, assemble, lines_as_blocks

DOCX, PDF, HTML, TEXT = MEDIA_TYPES[".docx"], MEDIA_TYPES[".pdf"], MEDIA_TYPES[".html"], MEDIA_TYPES[".txt"]
#: Bounds of a DOCX package.
MOST_ENTRIES, MOST_RATIO, MOST_BYTES = 1000, 100, 200 << 20
BLOCK_SET, LEFT_OUT = set(BLOCK_ELEMENTS), set(LEFT_OUT_ELEMENTS)
VOID = set("area base br col embed hr img input link meta source track wbr".split())


def directory(spark: SparkSession, path: str, most_bytes: int = 50 << 20) -> DataFrame:
    """Files of a directory: path, content, length, reason (too_large for those beyond the bound, whose content isn't kept)."""
    files = spark.read.format("binaryFile").load(path)
    large = F.col("length") > most_bytes
    return files.select("path", F.when(~large, F.col("content")).alias("content"), "length", F.when(large, "too_large").alias("reason"))


def clean_name(c: Column) -> Column:
    """Base name of printable characters, at most 255; null if nothing is left."""
    base = F.trim(F.regexp_replace(F.regexp_extract(F.replace(c, F.lit("\\"), F.lit("/")), "([^/]*)/*$", 1), r"\p{C}|[\p{Z}&&[^ ]]", ""))
    return F.when(~base.rlike(r"^\.*$"), F.left(base, F.lit(255)))


def expected_type(name: Column) -> Column:
    end = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    out = F.when(F.lit(False), "")
    for e, t in MEDIA_TYPES.items():
        out = out.when(end == e, t)
    return out


def media_type(content: Column) -> Column:
    """Media type told from the bytes; null for what is neither a package, a PDF nor UTF-8 text without NUL."""
    head = F.hex(F.substring(content, 1, 5))
    text = F.try_validate_utf8(content.cast("string"))
    web = F.regexp_replace(text, "^﻿", "").rlike(r"(?is)^\s*(?:<!--.*?-->\s*)*<(?:!doctype\s+html|html)[\s>]")
    return F.when(head.startswith("504B0304"), DOCX).when(head == "255044462D", PDF).when(text.isNull() | F.contains(text, F.lit("\0")), F.lit(None)).when(web, HTML).otherwise(TEXT)


def docx_problem(content: bytes) -> str | None:
    """Why a package isn't accepted, or None."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            entries, names = z.infolist(), {e.filename.lower() for e in z.infolist()}
            if len(entries) > MOST_ENTRIES:
                return "too_many_entries"
            if any(e.flag_bits & 1 for e in entries):
                return "encrypted"
            if any(e.compress_size and e.file_size / e.compress_size > MOST_RATIO for e in entries) or sum(e.file_size for e in entries) > MOST_BYTES:
                return "too_large_unpacked"
            if not {"[content_types].xml", "word/document.xml"} <= names:
                return "not_docx"
            kinds = z.read("[Content_Types].xml").lower()
            if any(n.endswith("vbaproject.bin") or "/embeddings/" in n for n in names) or b"macroenabled" in kinds or b"vbaproject" in kinds:
                return "active_content"
    except (zipfile.BadZipFile, KeyError):
        return "not_docx"
    return None


@arrow_udf("string")
def package_problem(content: pd.Series) -> pd.Series:
    return content.map(lambda c: docx_problem(bytes(c)) if c is not None else None)


def pdf_problem(content: Column) -> Column:
    """active_content if a PDF has scripts, actions or attachments; the bytes are read as Latin-1."""
    active = F.decode(content, "ISO-8859-1").rlike(r"/(?:JavaScript|JS|Launch|EmbeddedFile|OpenAction|AA|RichMedia)\b")
    return F.when(active, "active_content")


def accepted(files: DataFrame, name: str = "path", content: str = "content") -> DataFrame:
    """Adds filename, media_type and reason: why a file isn't accepted (null if it is)."""
    named = files.withColumn("filename", clean_name(F.col(name))).withColumn("media_type", media_type(F.col(content)))
    told, due = F.col("media_type"), expected_type(F.col("filename"))
    reason = (
        F.when(F.col("filename").isNull(), "no_name").when(F.coalesce(F.octet_length(content), F.lit(0)) == 0, "empty").when(due.isNull(), "unknown_extension")
        .when(told.isNull(), "not_utf8").when(told != due, "type_differs").when(told == DOCX, package_problem(content)).when(told == PDF, pdf_problem(F.col(content)))
    )
    return named.withColumn("reason", F.coalesce(F.col("reason"), reason) if "reason" in files.columns else reason)


def stored(files: DataFrame, content: str = "content") -> DataFrame:
    """Content-addressed: one row per distinct content: sha256, size, content."""
    return files.select(F.sha2(content, 256).alias("sha256"), F.octet_length(content).cast("long").alias("size"), content).dropDuplicates(["sha256"])


def verified(objects: DataFrame, content: str = "content", digest: str = "sha256") -> tuple[DataFrame, DataFrame]:
    """Objects whose content has the registered digest, and the others."""
    same = F.sha2(content, 256).eqNullSafe(F.col(digest))
    return objects.filter(same), objects.filter(~same)


class _Leaves(HTMLParser):
    """Text of block elements that hold no block element, in order of their start. Unclosed paragraphs, items and cells end where HTML says."""

    ENDS = {"p": BLOCK_SET - {"body"}, "li": {"li"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[list] = []
        self.leaves: list[list] = []
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        if tag in LEFT_OUT:
            self.skip += 1
        if tag not in BLOCK_SET or self.skip:
            return
        while self.open and tag in self.ENDS.get(self.open[-1][0], ()):
            self.open.pop()
        for outer in self.open:
            outer[2] = False
        own = [tag, [], True]
        self.open.append(own)
        self.leaves.append(own)

    def handle_endtag(self, tag):
        if tag in LEFT_OUT:
            self.skip = max(0, self.skip - 1)
        elif any(o[0] == tag for o in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if self.open and not self.skip:
            for o in self.open:
                o[1].append(data)


def html_as_blocks(text: str | None) -> list[dict]:
    if not text or "\0" in text:
        return []
    p = _Leaves()
    p.feed(text.removeprefix("﻿"))
    p.close()
    kinds = {"li": "list_item", "td": "table_cell", "th": "table_cell", "pre": "preformatted"} | {f"h{i}": "heading" for i in range(1, 7)}
    leaves = [o for o in p.leaves if o[2]]
    return assemble([("".join(o[1]), kinds.get(o[0], "paragraph"), f"h{i}", int(o[0][1]) if o[0][0] == "h" and o[0][1:].isdigit() else None) for i, o in enumerate(leaves)])


@arrow_udf(BLOCKS)
def html_blocks(text: pd.Series) -> pd.Series:
    """Arrow UDF: leaf blocks of a page; null, or a page with NUL, has none."""
    return text.map(html_as_blocks)


W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_as_blocks(content: bytes) -> list[dict]:
    """Paragraphs and table cells in order of the body; headings by their style's name."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
        styles = ElementTree.fromstring(z.read("word/styles.xml")) if "word/styles.xml" in z.namelist() else ElementTree.Element("none")
    names = {s.get(f"{W}styleId"): (s.find(f"{W}name").get(f"{W}val") if s.find(f"{W}name") is not None else "") for s in styles.iter(f"{W}style")}

    def text(node) -> str:
        signs = {f"{W}tab": "\t", f"{W}br": "\n", f"{W}cr": "\n"}
        return "".join(t.text or "" if t.tag == f"{W}t" else signs.get(t.tag, "") for t in node.iter())

    parts, paragraphs, tables = [], 0, 0
    for child in body if body is not None else []:
        if child.tag == f"{W}p":
            style = child.find(f"{W}pPr/{W}pStyle")
            named = names.get(style.get(f"{W}val"), style.get(f"{W}val")) if style is not None else ""
            level = re.fullmatch(r"(?:[Hh]eading|标题)\s*([1-9])", named or "")
            parts.append((text(child), "heading" if level else "paragraph", f"p{paragraphs}", int(level[1]) if level else None))
            paragraphs += 1
        elif child.tag == f"{W}tbl":
            for r, row in enumerate(child.iter(f"{W}tr")):
                parts += [("\n".join(text(p) for p in cell.iter(f"{W}p")), "table_cell", f"t{tables}r{r}c{c}", None) for c, cell in enumerate(row.iter(f"{W}tc"))]
            tables += 1
    return assemble(parts)


def _decoded(content: bytes) -> str | None:
    try:
        return content.decode("utf-8-sig")
    except UnicodeDecodeError:
        return None


#: Parsers by media type: bytes to blocks. PDF takes part once a parser is registered.
PARSERS: dict[str, Callable[[bytes], list[dict]]] = {TEXT: lambda b: lines_as_blocks(_decoded(b)), HTML: lambda b: html_as_blocks(_decoded(b)), DOCX: docx_as_blocks}


def register_parser(media: str, parse: Callable[[bytes], list[dict]]) -> None:
    PARSERS[media] = parse


def parsed(files: DataFrame, most_chars: int = 5_000_000) -> DataFrame:
    """Accepted files with blocks and error: no_parser, unreadable or too_long (each without blocks)."""
    known = dict(PARSERS)

    @arrow_udf(f"struct<blocks:{BLOCKS},error:string>")
    def run(content: pd.Series, media: pd.Series) -> pd.DataFrame:
        out = []
        for c, m in zip(content, media, strict=True):
            blocks, error = [], None
            if m not in known:
                error = "no_parser"
            else:
                try:
                    blocks = known[m](bytes(c))
                except Exception:  # noqa: BLE001  a file that can't be read is a result, not a failure of the job
                    error = "unreadable"
                if blocks and blocks[-1]["char_end"] > most_chars:
                    blocks, error = [], "too_long"
            out.append((blocks, error))
        return pd.DataFrame(out, columns=["blocks", "error"])

    return files.withColumn("_p", run("content", "media_type")).select("*", "_p.blocks", "_p.error").drop("_p")


def json_set(spark: SparkSession, path: str, rows: str) -> DataFrame:
    """The rows of a gold set's envelope: a multi-line JSON file with an array under ``rows``."""
    return spark.read.json(path, multiLine=True).select(F.explode(rows).alias("r")).select("r.*")


def report(df: DataFrame, path: str) -> None:
    """A result as JSON lines in a folder."""
    df.write.mode("overwrite").json(path)


def embedded(texts: DataFrame, encode: Callable[[list[str]], list[list[float]]], key: str, text: str = "text", batch: int = 200) -> DataFrame:
    """(key, dimensions, embedding) from an injected encoder, called on batches; vectors are normalised. Null text is empty."""
    kind = texts.schema[key].dataType.simpleString()

    def run(frames):
        for pdf in frames:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                rows = []
                for v in encode([t or "" for t in part[text]]):
                    size = sum(x * x for x in v) ** 0.5
                    rows.append([float(x / size) if size else 0.0 for x in v])
                yield pd.DataFrame({key: part[key].to_list(), "dimensions": [len(r) for r in rows], "embedding": rows})

    return texts.select(key, text).mapInPandas(run, f"`{key}` {kind}, dimensions int, embedding array<float>")


def reranked(hits: DataFrame, score: Callable[[list[tuple[str, str]]], list[float]]) -> DataFrame:
    """Hits (query, text) with an injected reranker's score."""

    @arrow_udf("double")
    def run(query: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series(score(list(zip(query, text, strict=True))), dtype="float64")

    return hits.withColumn("score", run("query", "text"))


def markdown(rows: list[dict], title: str) -> str:
    """A small result (a summary's rows) as a Markdown table."""
    if not rows:
        return f"# {title}\n"
    names = list(rows[0])
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([f"# {title}", "", line(names), line(["---"] * len(names)), *[line(["" if r[n] is None else str(r[n]) for n in names]) for r in rows], ""])


def registration(files: DataFrame, known: DataFrame, now: Column) -> dict[str, DataFrame]:
    """What an import writes: artifacts and their objects for contents that aren't registered yet, a parse job and an audit entry each. Rejected files have none."""
    good = files.filter("reason IS NULL").withColumn("sha256", F.sha2("content", 256)).dropDuplicates(["sha256"]).join(known.select("sha256"), "sha256", "left_anti")
    artifacts = good.select("sha256", "filename", "media_type", F.octet_length("content").cast("long").alias("size_bytes"), now.alias("imported_at"))
    return {
        "objects": good.select("sha256", "content"),
        "artifacts": artifacts,
        "jobs": artifacts.select(F.concat(F.lit("parse:"), "sha256").alias("idempotency_key"), F.lit("document.parse").alias("job_type"), F.lit("queued").alias("status"), "sha256"),
        "audit": artifacts.select(F.lit("document.imported").alias("action"), "sha256", now.alias("created_at")),
    }
