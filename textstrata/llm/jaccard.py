"""Operator 4, n-gram Jaccard join in metric space, by connected components.

A document's set holds its distinct shingles of ``SIZE`` words. Jaccard
distance is a metric, and documents link at distance ``RADIUS`` or less. Almost
all pairs of texts share nothing and lie at distance 1 from each other and from
any pivot, so the space is first cut where it is empty:

1. All shingles are counted (as 32 bits each); the most frequent ones (in more
   than ``COMMON`` documents, ``BROADCAST`` at most) are common. Shingles are
   ordered uncommon first. Two linked sets share one within the first
   n - ceil(0.85 n) + 1 of each, whatever the order is.
2. Equal sets (by two 64-bit identities, sums over their shingles) become one.
   Sets that share an uncommon leading shingle are paired if they are
   ``GROUP`` or fewer, and kept if the number of leading shingles they share,
   with all that may follow, allows a link. Larger groups, and sets that share
   a common leading shingle, hang on one leader, without pairs. Connected sets
   form a region; every link lies inside one.
3. A region is joined exactly: pivots are chosen, each set belongs to the cell
   of its nearest pivot (Voronoi), and it is also dealt to every cell whose
   pivot is at most 2 * RADIUS farther (triangle inequality). Cells recurse; one
   that doesn't shrink is finished by windows on the distances to its pivots.
   A large region is dealt in pairs of blocks, so that no task holds it whole.

Links join into components by the union of a spanning subset of them; sets that
an earlier link has joined aren't compared again, so no link between different
components is missed and pairs are never all listed.

A shingle is compared as a hash of 64 bits: two sets' intersection is wrong
only if different shingles of just these two sets agree in all of them.

Defined results: null text, and text without words, has an empty set and is its
own component; documents with equal sets are linked; rows with a null id have
their set's size and a null component; repeated rows give repeated results; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, by_group, components, drop_stage, partitions, slices_of, stage
from .shingles import identities, mix, shingle_sets

SIZE, PERCENT = 4, 85
RADIUS = 1 - PERCENT / 100
#: A shingle in so many documents or fewer is uncommon; common shingles that are broadcast at most (4 bytes each): both only order a set's shingles.
COMMON, BROADCAST = 8, 4_000_000
#: Sets that share a leading shingle and are compared pair by pair at most.
GROUP = 32
#: Bytes of text whose shingles a worker sorts at once.
RANGE_BYTES = 32 << 20
#: Sets of a region that are joined in one task: blocks of so many at least and at most.
BLOCK_LEAST, BLOCK_MOST = 96, 2048
#: Pivots of a cell, and the size at which a cell is finished without recursion.
PIVOTS, LEAF = 6, 48
#: Shingles that a worker gathers before it passes counts on.
GATHER = 2_000_000


def _by_range(h: np.ndarray, ranges: int) -> np.ndarray:
    """Range of a hash: its upper 32 bits, scaled."""
    return (((h >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)


def ranges_of(docs: DataFrame, text: str = "text") -> int:
    """How many ranges of hashes the shingles are dealt to: they grow with the text, so that one range fits in a worker."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(partitions(docs.sparkSession), -(-size // RANGE_BYTES))


def common_shingles(docs: DataFrame, ranges: int, text: str = "text", size: int = SIZE, common: int = COMMON) -> np.ndarray:
    """Upper 32 bits of the most frequent shingles, ``BROADCAST`` at most, of those in more than ``common`` documents; sorted.

    Counts cover all documents. Workers count what they have read, and send sorted
    values as differences, by ranges of the hash.
    """
    spark = docs.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, n = [], 0

        def flush():
            v, c = np.unique(np.concatenate(kept), return_counts=True)
            cuts = np.searchsorted(_by_range(v.astype(np.uint64) << np.uint64(32), ranges), np.arange(ranges + 1))
            rows = []
            for r in range(ranges):
                part, times = v[cuts[r] : cuts[r + 1]], c[cuts[r] : cuts[r + 1]]
                if len(part):
                    step = np.diff(part, prepend=np.uint32(0))
                    far = step >= 65535
                    rows.append((r, np.where(far, 65535, step).astype("<u2").tobytes(), step[far].astype("<u4").tobytes(), np.minimum(times, 65535).astype("<u2").tobytes(), int(times.sum())))
            yield pa.RecordBatch.from_pydict({k: [x[i] for x in rows] for i, k in enumerate(("r", "steps", "far", "times", "total"))}, schema=schema)

        schema = pa.schema([("r", pa.int32()), ("steps", pa.binary()), ("far", pa.binary()), ("times", pa.binary()), ("total", pa.int64())])
        for rows in slices_of(batches, 0):
            h, _ = shingle_sets(rows.column(0), size)
            kept.append((h >> np.uint64(32)).astype(np.uint32))
            n += len(h)
            if n >= GATHER:
                yield from flush()
                kept, n = [], 0
        if n:
            yield from flush()

    def merge(table: pa.Table) -> Iterable[pa.RecordBatch]:
        values, times = [], []
        for steps, far, t in zip(table["steps"].to_pylist(), table["far"].to_pylist(), table["times"].to_pylist(), strict=True):
            step = np.frombuffer(steps, "<u2").astype(np.uint32)
            step[step == 65535] = np.frombuffer(far, "<u4")
            values.append(np.cumsum(step, dtype=np.uint32)), times.append(np.frombuffer(t, "<u2").astype(np.int64))
        v, t = np.concatenate(values), np.concatenate(times)
        order = np.argsort(v, kind="stable")
        v, t = v[order], t[order]
        first = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
        v, t = v[first], np.add.reduceat(t, first)
        often = t > common
        yield pa.RecordBatch.from_pydict({"v": pa.array(v[often].astype(np.int64)), "n": pa.array(t[often]), "total": pa.array(np.where(np.arange(often.sum()) == 0, sum(table["total"].to_pylist()), 0), pa.int64())})

    with batches_of(spark, 64):
        found = stage(by_group(docs.select(text).mapInArrow(count, "r int, steps binary, far binary, times binary, total long"), ["r"], merge, "v long, n long, total long", ranges), "common")
        total = found.agg(F.sum("total")).first()[0] or 0
        # Fewer than total / x values can occur more than x times: what reaches the driver is bounded either way.
        least = common if found.count() <= BROADCAST else max(common, total // BROADCAST)
        rows = found.filter(F.col("n") > least).select("v").toArrow()
        drop_stage(found)
    return np.sort(rows["v"].to_numpy().astype(np.uint32))


def leading(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """How many leading shingles a set of n must offer."""
    return n - (percent * n + 99) // 100 + 1


def leading_sets(docs: DataFrame, often, key: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """Per row: key, th (hash of the text), n, sig and sig2 (identities of the set), lead (leading shingles), n_common (of the leading ones), last (place of the last one in the order)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = often.value
        for rows in slices_of(batches, text):
            h, off = shingle_sets(rows.column(text), size)
            n = np.diff(off)
            owner = np.repeat(np.arange(len(n)), n)
            top = (h >> np.uint64(32)).astype(np.uint32)
            at = np.minimum(np.searchsorted(values, top), max(0, len(values) - 1))
            hot = values[at] == top if len(values) else np.zeros(len(h), bool)
            sig, sig2 = identities(h, off)
            order = np.lexsort((hot, owner))
            place = np.arange(len(h)) - off[:-1][owner]
            take = place < leading(n, percent)[owner]
            lead, hot_lead = h[order][take], hot[order][take]
            p = np.where(n > 0, leading(n, percent), 0)
            ends = np.cumsum(p)
            ranks = (hot_lead.astype(np.uint64) << np.uint64(63)) | (lead >> np.uint64(1))
            last = np.zeros(len(n), np.int64)
            last[n > 0] = (ranks[ends[n > 0] - 1] >> np.uint64(1)).astype(np.int64)
            common = np.bincount(owner[take], hot_lead, len(n)).astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(lead.view(np.int64)))
            yield pa.RecordBatch.from_arrays([rows.column(key), rows.column("th"), pa.array(n, pa.int64()), pa.array(sig), pa.array(sig2), lists, pa.array(common), pa.array(last)], names=[key, "th", "n", "sig", "sig2", "lead", "n_common", "last"])

    return docs.select(key, text, F.xxhash64(text).alias("th")).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, th long, n long, sig long, sig2 long, lead array<long>, n_common long, last long")


_ENTRY = np.dtype([("h", "<u8"), ("node", "<i8"), ("last", "<i8"), ("n", "<u4"), ("common", "<u4")])


def candidate_edges(sets: DataFrame, ranges: int, percent: int = PERCENT) -> DataFrame:
    """Edges (a, b) between sets that may link, and from sets to the leader of each large group of sets that share a leading shingle.

    ``sets``: one row per distinct set, with its node.
    """
    spark = sets.sparkSession

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in itertools.chain.from_iterable((b.slice(at, 2000) for at in range(0, b.num_rows, 2000)) for b in batches):
            lead = rows.column("lead")
            size = lead.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            out = np.empty(int(size.sum()), _ENTRY)
            out["h"] = lead.flatten().to_numpy().view(np.uint64)
            for name in ("node", "last", "n"):
                out[name] = np.repeat(rows.column(name).to_numpy(), size)
            # common leading shingles come last in a set
            out["common"] = np.repeat(rows.column("n_common").to_numpy(), size)
            place = np.arange(len(out)) - np.repeat(np.cumsum(size) - size, size)
            hot = place >= np.repeat(size - rows.column("n_common").to_numpy(), size)
            out["common"] |= hot.astype(np.uint32) << np.uint32(31)
            # leading shingles are the least hashes of their sets: mixed again, they spread over all ranges
            r = _by_range(mix(out["h"]), ranges)
            order = np.argsort(r, kind="stable")
            out, cuts = out[order], np.searchsorted(r[order], np.arange(ranges + 1))
            full = [k for k in range(ranges) if cuts[k] < cuts[k + 1]]
            yield pa.RecordBatch.from_pydict({"r": pa.array(full, pa.int32()), "e": pa.array([out[cuts[k] : cuts[k + 1]].tobytes() for k in full], pa.binary())})

    def pair(table: pa.Table) -> Iterable[pa.RecordBatch]:
        e = np.frombuffer(b"".join(table["e"].to_pylist()), _ENTRY)
        e = e[np.lexsort((e["node"], e["h"]))]
        common = (e["common"] & np.uint32(0x7FFFFFFF)).astype(np.int64)
        begins = np.flatnonzero(np.concatenate(([True], e["h"][1:] != e["h"][:-1])))
        members = np.diff(np.concatenate((begins, [len(e)])))
        hot = (e["common"] >> np.uint32(31)).astype(bool) | (np.repeat(members, members) > GROUP)
        leader = np.repeat(e["node"][begins], members)
        hang = hot & (leader != e["node"])
        found = [np.stack((leader[hang], e["node"][hang], np.zeros(hang.sum(), np.int64)), axis=1)]
        c, common = e[~hot], common[~hot]
        n = c["n"].astype(np.int64)
        rest = n - leading(n, percent)
        for d in range(1, len(c)):
            i = np.flatnonzero(c["h"][d:] == c["h"][:-d])
            if not len(i):
                break
            j = i + d
            fits = 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
            i, j = i[fits], j[fits]
            need = (percent * (n[i] + n[j]) + percent + 99) // (percent + 100)
            after = np.where(c["last"][i] < c["last"][j], rest[i], np.where(c["last"][i] > c["last"][j], rest[j], np.maximum(rest[i], rest[j])))
            found.append(np.stack((c["node"][i], c["node"][j], np.maximum(1, need - np.minimum(common[i], common[j]) - after)), axis=1))
        rows = np.concatenate(found)
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        first = np.flatnonzero(np.concatenate(([True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)))) if len(rows) else np.zeros(0, int)
        times = np.add.reduceat((rows[:, 2] > 0).astype(np.int64), first) if len(rows) else first
        rows = rows[first]
        yield pa.RecordBatch.from_pydict({"a": pa.array(rows[:, 0]), "b": pa.array(rows[:, 1]), "c": pa.array(times), "need": pa.array(rows[:, 2])})

    with batches_of(spark, 256):
        dealt = sets.select("node", "n", "lead", "n_common", "last").mapInArrow(deal, "r int, e binary")
        pairs = by_group(dealt, ["r"], pair, "a long, b long, c long, need long", ranges)
        kept = pairs.groupBy("a", "b").agg(F.sum("c").alias("c"), F.min("need").alias("need")).filter(F.col("c") >= F.col("need"))
        return stage(kept.select("a", "b"), "candidates")


class Region:
    """Exact join of a region's sets: pivots, Voronoi cells, triangle windows, recursion."""

    def __init__(self, values: np.ndarray, offsets: np.ndarray, percent: int = PERCENT):
        self.percent, self.radius = percent, 1 - percent / 100
        _, self.token = np.unique(values, return_inverse=True)
        self.off, self.n = offsets, np.diff(offsets)
        self.width = int(self.token.max()) + 1 if len(values) else 1
        self.root = np.arange(len(self.n))
        self.links: list[tuple[int, int]] = []
        self.mark = np.zeros(self.width, bool)
        self.compared = 0

    def _find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return int(i)

    def _roots(self) -> np.ndarray:
        while not np.array_equal(up := self.root[self.root], self.root):
            self.root = up
        return self.root

    def shared(self, p: int, members: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of set p with each member."""
        own = self.token[self.off[p] : self.off[p + 1]]
        self.mark[own] = True
        size = self.n[members]
        begin = np.cumsum(size) - size
        flat = self.token[np.repeat(self.off[members] - begin, size) + np.arange(int(size.sum()))]
        out = np.add.reduceat(self.mark[flat].astype(np.int64), begin) if len(flat) else np.zeros(len(members), np.int64)
        self.mark[own] = False
        self.compared += len(members)
        return out

    def measure(self, p: int, members: np.ndarray) -> np.ndarray:
        """Distances from p; links found on the way are kept."""
        both = self.shared(p, members)
        union = self.n[p] + self.n[members] - both
        for j in members[(100 * both >= self.percent * union) & (members != p)].tolist():
            a, b = self._find(p), self._find(j)
            if a != b:
                self.root[max(a, b)] = min(a, b)
                self.links.append((p, j))
        return 1 - both / union

    def join(self, members: np.ndarray) -> None:
        todo = [members]
        while todo:
            cell = todo.pop()
            if len(cell) < 2:
                continue
            order = cell[np.argsort(self.n[cell], kind="stable")]
            pivots = order[np.unique(np.linspace(0, len(cell) - 1, min(PIVOTS, len(cell))).astype(int))]
            far = np.stack([self.measure(int(p), cell) for p in pivots])
            if len(np.unique(self._roots()[cell])) == 1 or len(pivots) == len(cell):
                continue
            own = far.min(axis=0)
            cells = [cell[near & ~np.isin(cell, pivots)] for near in far <= own + 2 * self.radius + 1e-9]
            if len(cell) <= LEAF or max(map(len, cells)) > 0.7 * len(cell):
                self._windows(cell, far, set(pivots.tolist()))
            else:
                todo += [c for c in cells if len(c) > 1]

    def _windows(self, cell: np.ndarray, far: np.ndarray, done: set[int]) -> None:
        """Each set as a pivot in turn, against the later ones that its windows hold and that it isn't joined with yet."""
        ordinary = [k for k in range(len(cell)) if int(cell[k]) not in done]
        for k in ordinary:
            roots = self._roots()
            later = np.arange(k + 1, len(cell))
            near = (np.abs(far[:, later] - far[:, k, None]) <= self.radius + 1e-9).all(axis=0) & (roots[cell[later]] != roots[cell[k]])
            size, n = self.n[cell[later]], self.n[cell[k]]
            near &= 100 * np.minimum(size, n) >= self.percent * np.maximum(size, n)
            if near.any():
                self.measure(int(cell[k]), cell[later[near]])


def region_links(docs: DataFrame, members: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) that span the components of each region. ``members``: key, th, node, sig, sig2 and root of one document per set."""
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("m"))
    block = F.least(F.greatest(F.ceil(F.col("m") / 16), F.lit(BLOCK_LEAST)), F.lit(BLOCK_MOST))
    cut = members.join(sizes, "root").filter("m > 1").withColumn("nb", F.when(F.col("m") <= 2 * BLOCK_LEAST, 1).otherwise(F.ceil(F.col("m") / block)).cast("int"))
    own = F.pmod(F.xxhash64("sig", F.lit(4)), F.col("nb")).cast("int")
    own_text = cut.select(F.col(key).alias("_key"), "th", "node", "sig", "sig2", "root", "nb", own.alias("own"))
    # equal rows of one document count once: its text goes along with its set as one row
    texts = docs.select(F.col(key).alias("_key"), F.xxhash64(text).alias("th"), F.col(text).alias("_text"))
    texts = texts.join(own_text.select("_key", "th").hint("merge"), ["_key", "th"], "left_semi").groupBy("_key", "th").agg(F.first("_text").alias("_text"))
    blocks = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("j")))
    placed = own_text.hint("merge").join(texts, ["_key", "th"]).select("node", "sig", "sig2", "root", "_text", F.explode(blocks).alias("k"))
    dealt = placed.select("root", F.col("k.i").alias("i"), F.col("k.j").alias("j"), "node", "sig", "sig2", "_text")

    def run(table: pa.Table) -> Iterable[pa.RecordBatch]:
        table = table.combine_chunks()
        h, off = shingle_sets(table["_text"], size)
        node, n = table["node"].to_numpy(), np.diff(off)
        # should hashes of two texts of one key agree, only that whose set is the node's counts
        real = np.logical_and(*(own == table[name].to_numpy() for own, name in zip(identities(h, off), ("sig", "sig2"), strict=True)))
        _, first = np.unique(np.where(real, node, -1), return_index=True)
        rows = np.sort(first[real[first]])
        region = Region(np.concatenate([h[off[i] : off[i + 1]] for i in rows]) if len(rows) else h[:0], np.concatenate(([0], np.cumsum(n[rows]))), percent)
        region.join(np.arange(len(rows)))
        a, b = (np.array([x[k] for x in region.links], np.int64) for k in (0, 1))
        yield pa.RecordBatch.from_pydict({"a": pa.array(node[rows][a]), "b": pa.array(node[rows][b])})

    with batches_of(docs.sparkSession, 256):
        return stage(by_group(dealt, ["root", "i", "j"], run, "a long, b long"), "links")


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """Per row: key, n_shingles and component_id (the smallest key reachable by links of ``percent`` or more over shingles of ``size`` words)."""
    spark = docs.sparkSession
    docs = docs.select(key, text)
    ranges = ranges_of(docs, text)
    often = spark.sparkContext.broadcast(common_shingles(docs, ranges, text, size))
    with batches_of(spark, 1000):
        sets = stage(leading_sets(docs, often, key, text, size, percent), "sets")
    shape = [F.first(c).alias(c) for c in ("n", "lead", "n_common", "last")]
    # written once, the numbers stay as they are
    nodes = stage(sets.filter("n > 0").groupBy("sig", "sig2").agg(F.min(F.struct(F.col(key).isNull(), F.col(key).alias("key"), "th")).alias("least"), *shape).withColumn("node", F.monotonically_increasing_id()).select("*", F.col("least.key").alias(key), "least.th"), "nodes")
    candidates = candidate_edges(nodes, ranges, percent)
    regions = components(candidates)
    members = stage(nodes.filter(F.col(key).isNotNull()).select(key, "th", "node", "sig", "sig2").join(regions, "node"), "members")
    links = region_links(docs, members, key, text, size, percent)
    joined = components(links)
    rooted = nodes.select("node", "sig", "sig2", key).join(joined, "node", "left").select("sig", "sig2", key, F.coalesce("root", "node").alias("root"))
    heads = rooted.groupBy("root").agg(F.min(key).alias("component_id"))
    named = stage(rooted.join(heads, "root").select("sig", "sig2", "component_id"), "named")
    drop_stage(candidates, members, links, nodes)
    out = sets.select(key, F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("sig")).alias("sig"), "sig2").join(named, ["sig", "sig2"], "left")
    return out.select(key, "n_shingles", F.when(F.col(key).isNotNull(), F.coalesce("component_id", key)).alias("component_id"))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SIZE} THEN [array_to_string(w, ' ')] ELSE list_transform(range(len(w) - {SIZE} + 1), lambda i: array_to_string(w[i + 1 : i + {SIZE}], ' ')) END) AS s FROM d),
t AS (SELECT doc_id, len(s)::BIGINT AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y FROM t a JOIN t b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= {PERCENT} * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {PERCENT} * (a.n + b.n - count(*))),
r AS (WITH RECURSIVE c(x, y) AS (SELECT doc_id, doc_id FROM s UNION SELECT c.x, p.y FROM c JOIN p ON c.y = p.x) SELECT x, min(y) AS component_id FROM c GROUP BY x)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id FROM s JOIN r ON r.x = s.doc_id"""
