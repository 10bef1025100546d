"""SimHash near-dedup with pivot distance tables.

1. ``fingerprints``: 64-bit SimHash of word shingles, one Arrow pass, no shuffle.
2. ``pivot_distances``: for each distinct fingerprint, once, its Hamming distances to ``PIVOTS`` reference fingerprints.
3. ``linked_pairs``: links between distinct fingerprints that differ in at most ``radius`` bits.
   Blocking is by the pigeonhole rule: of ``segments`` bit segments at least ``segments - radius`` agree, so
   each fingerprint goes to one bucket per choice of that many segments. The distances travel with it: a pair whose
   coordinates differ by more than the radius anywhere cannot be within it (triangle inequality) and is discarded, and
   the survivors are verified bit by bit. A bucket returns a spanning forest of its links, never all pairs.
   A bucket over ``BUCKET_ROWS`` is dealt into blocks, and each pair of blocks is a task row of its own: no
   cap, no dropped partner, and no task holds more than two blocks of a bucket.
4. ``components``: connected components by alternating large-star and small-star steps on written tables.

Pivot distances cannot block by themselves: for 64-bit fingerprints two unrelated values pass one pivot's test
at radius 4 with probability about 0.57, so cells of pivot coordinates overlap nearly everywhere. Hence the
segments in front of the tables.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.shared import Put, free_name, scratch

#: Hash seed of the shingles.
SEED = 42
#: Reference fingerprints of the distance tables.
PIVOTS = 16
#: A larger bucket is dealt into blocks of about this many fingerprints.
BUCKET_ROWS = 2048
#: Random fingerprints in a bucket, at most, by which the segments are chosen.
BUCKET_EXPECTED = 64
#: Up to this many fingerprints a bucket is compared by shifts over the whole batch, above it by itself.
SHIFTED = 24


@dataclass(frozen=True)
class Rule:
    """What links: fingerprints within ``radius`` bits. ``segments`` sets how finely buckets are cut; None leaves it to
    the number of fingerprints."""

    radius: int
    segments: int | None = None

    def __post_init__(self):
        if self.segments is not None and self.segments <= self.radius:
            raise ValueError("segments must exceed radius")

    def cut(self, n: int) -> int:
        """Segments for ``n`` fingerprints: the fewest by which a bucket has ``BUCKET_EXPECTED`` of random ones at most."""
        if self.segments is not None:
            return self.segments
        return next((s for s in range(self.radius + 1, 4 * self.radius + 2) if n >> (64 * (s - self.radius) // s) <= BUCKET_EXPECTED), 4 * self.radius + 2)


#: One fingerprint, four bits.
CONTRACT = Rule(radius=4)

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8).reshape(-1, 1), axis=1, bitorder="little").astype(np.int64)
_OFFSETS = np.arange(8, dtype=np.int64) * 256


def shingle_hashes(text: str | None, shingle_words: int) -> np.ndarray:
    """XXH64 of each word shingle of a text, in order and with repeats; empty for a text without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < shingle_words:
        shingles: Iterable[bytes] = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle_words)), strict=False))
    return np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), shingles), dtype=np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """The unsigned 64-bit SimHash: a bit is 1 if it is set in over half the hashes; 0 for none."""
    places = hashes.astype("<u8").view(np.uint8).reshape(-1, 8) + _OFFSETS
    bytes_seen = np.bincount(places.ravel(), minlength=2048).reshape(8, 256)
    on = (bytes_seen @ _BITS).ravel() * 2 > len(hashes)
    return int(np.packbits(on, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text: str = "text", shingle_words: int = 4, out: str = "fp") -> DataFrame:
    """``df`` with a long column ``out``: the SimHash of ``text`` (the same 64 bits, signed).

    A-Z are lower-cased, words are what stands between white space, shingles count with repeats; a text of
    fewer words is one shingle; null, empty and blank texts get 0. All other columns pass unchanged; if one is
    named as ``out``, the new one gets an underscore.
    """
    out = free_name(df, out)

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        got = np.fromiter((simhash(shingle_hashes(t, shingle_words)) for t in texts), dtype=np.uint64, count=len(texts))
        return pd.Series(got.view(np.int64))

    return df.withColumn(out, of(F.col(f"`{text}`")))


def _segments(n: int) -> list[tuple[int, int]]:
    """(first bit, width) of ``n`` segments of 64 bits."""
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _keys(fp: Column, segments: int, radius: int) -> Column:
    """One struct (choice, bits) for each choice of ``segments - radius`` segments."""
    parts = _segments(segments)
    keys = []
    for n, chosen in enumerate(combinations(range(segments), segments - radius)):
        mask = sum(((1 << parts[i][1]) - 1) << parts[i][0] for i in chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.struct(F.lit(n).alias("choice"), fp.bitwiseAND(F.lit(signed).cast("long")).alias("bits")))
    return F.array(*keys)


def pivot_fingerprints(n: int = PIVOTS) -> np.ndarray:
    """``n`` reference fingerprints, half their bits set, the same on every machine."""
    return np.array([xxhash.xxh64_intdigest(f"pivot {i}", seed=SEED) for i in range(n)], dtype=np.uint64)


def pivot_distances(fp: Column, n: int = PIVOTS) -> Column:
    """The row of the distance table of a fingerprint: its Hamming distance to each reference fingerprint."""
    return F.array(*(F.bit_count(fp.bitwiseXOR(F.lit(int(p)))).cast("byte") for p in pivot_fingerprints(n).view(np.int64)))


def _verified(fps: np.ndarray, table: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (a, b), those that link: pivot by pivot first (``table`` has a row for each), then bit by bit."""
    for row in table:
        close = np.abs(row[a] - row[b]) <= radius
        a, b = a[close], b[close]
    close = np.bitwise_count(fps[a] ^ fps[b]) <= radius
    return a[close], b[close]


class _Forest:
    """Labels of the members of one bucket, merged as pairs come in."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def merge(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self.label[a], self.label[b]
        apart = a != b
        if not apart.any():
            return
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while x in parent:
                x = parent[x]
            return x

        for x, y in np.unique(np.stack([a[apart], b[apart]], axis=1), axis=0).tolist():
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        moved = np.arange(len(self.label))
        for x in parent:
            moved[x] = root(x)
        self.label = moved[self.label]


def bucket_links(fps: np.ndarray, table: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links in one bucket: (member, first member of its tree) as positions."""
    n = len(fps)
    order = np.argsort(table[0], kind="stable")
    first = table[0][order]
    forest = _Forest(n)
    for start in range(0, n, 256):
        rows = np.arange(start, min(start + 256, n))
        # in the order of the first pivot's distance, partners lie in a window
        end = np.searchsorted(first, first[rows[-1]] + radius, side="right")
        a, b = np.meshgrid(rows, np.arange(start, end), indexing="ij")
        later = a < b
        forest.merge(*_verified(fps, table, order[a[later]], order[b[later]], radius))
    moved = np.flatnonzero(forest.label != np.arange(n))
    return moved, forest.label[moved]


def _links_of_batch(fps: np.ndarray, table: np.ndarray, sizes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of many buckets that lie behind each other: small ones together by shifts, large ones one by one."""
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(sizes)), sizes)
    at = np.flatnonzero(sizes[owner] <= SHIFTED)
    small, near, owner = fps[at], table[:, at], owner[at]
    found = [(np.empty(0, np.int64),) * 2]
    for shift in range(1, int(sizes[sizes <= SHIFTED].max(initial=0))):
        a = np.flatnonzero(owner[:-shift] == owner[shift:])
        a, b = _verified(small, near, a, a + shift, radius)
        found.append((at[a], at[b]))
    for i in np.flatnonzero(sizes > SHIFTED):
        inside = slice(starts[i], starts[i] + sizes[i])
        a, b = bucket_links(fps[inside], table[:, inside], radius)
        found.append((starts[i] + a, starts[i] + b))
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def linked_pairs(distinct: DataFrame, rule: Rule, put: Put) -> DataFrame:
    """Links (a, b), a < b, between nodes, that connect what the rule links.

    ``distinct`` has each node once: the long column ``block`` and its pivot distances ``away``. The links are a spanning
    forest of every bucket, so two nodes are connected by them exactly if they are by the links of the rule.
    """
    segments = rule.cut(distinct.count())
    keyed = distinct.select(F.struct("block", "away").alias("fp"), F.explode(_keys(F.col("block"), segments, rule.radius)).alias("key")).select("fp", "key.choice", "key.bits")
    crowds = put(keyed.groupBy("choice", "bits").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET_ROWS), "crowds")
    blocks = crowds.select("choice", "bits", F.ceil(F.col("n") / BUCKET_ROWS).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("fp.block"), F.col("blocks")).cast("int")
    met = keyed.join(blocks, ["choice", "bits"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = met.select("choice", "bits", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = dealt.groupBy("choice", "bits", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps")
    radius = rule.radius

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            flat = lists.flatten()
            fps = np.asarray(flat.field("block")).view(np.uint64)
            table = np.ascontiguousarray(np.asarray(flat.field("away").flatten()).reshape(len(fps), -1).T)
            a, b = _links_of_batch(fps, table, np.asarray(lists.value_lengths()), radius)
            names = fps.view(np.int64)
            a, b = names[a], names[b]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return rows.mapInArrow(links, "a long, b long").distinct()


def _starred(edges: DataFrame) -> bool:
    """Whether distinct edges (hi, lo) are stars around their smallest nodes: none stands below one node and above another, or above two."""
    end = lambda c, above: F.struct(F.col(c).alias("node"), F.lit(above).alias("above"))
    ends = edges.select(F.explode(F.array(end("hi", 1), end("lo", 0))).alias("e")).groupBy("e.node").agg(F.sum("e.above").alias("above"), F.min("e.above").alias("least"))
    return not ends.where("above > 1 or above > least").count()


def components(pairs: DataFrame, put: Put) -> DataFrame:
    """(node_, label) of every node of ``pairs`` (a, b): label is the smallest node of its component.

    Alternating star steps: each round, neighbours above a node are moved to its smallest neighbour
    (large star), then those below it (small star); the rounds are logarithmic in the longest chain, and none is spent on links that are
    stars already. Every round is a written table. What a join meets is written before it, so that Spark can split the rows of a node with very
    many neighbours.
    """
    edges = put(pairs.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "links")
    while not _starred(edges):
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = put(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = put(both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct(), "large")
        low = put(large.groupBy("hi").agg(F.min("lo").alias("m")), "low")
        small = large.join(low, "hi").select(F.explode(F.array(F.struct("lo", "m"), F.struct(F.col("hi").alias("lo"), "m"))).alias("e")).select(F.col("e.lo").alias("hi"), F.col("e.m").alias("lo"))
        edges = put(small.where("hi <> lo").distinct(), "stars")
    return edges.select(F.col("hi").alias("node_"), F.col("lo").alias("label")).unionAll(edges.select(F.col("lo").alias("node_"), F.col("lo").alias("label"))).distinct()


def ordered(key: list[str]) -> Column:
    """Key columns as a struct that orders by them, nulls last."""
    return F.struct(*(f(F.col(f"`{k}`")).alias(f"{k}_{n}") for k in key for n, f in (("none", F.isnull), ("value", lambda c: c))))


def grouped(distinct: DataFrame, links: DataFrame, put: Put) -> DataFrame:
    """``distinct`` (node, least) with ``group``: the smallest ``least`` over all nodes that links (a, b) connect with it."""
    labels = put(components(links, put), "labels")
    at = put(distinct.join(labels, distinct.node == labels.node_, "left").select("node", F.coalesce("label", "node").alias("label"), "least"), "labelled")
    of_label = put(at.groupBy("label").agg(F.min("least").alias("group")), "groups")
    return at.join(of_label, "label").select("node", "least", "group")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", shingle_words: int = 4, rule: Rule = CONTRACT) -> DataFrame:
    """One row per row of ``df``: (key, fingerprint as 16 hex digits, component_id).

    ``component_id`` is the smallest key reachable over links of at most ``radius`` bits, itself included; null
    keys count only where a component has no other. Null, empty and blank texts have fingerprint zero and are
    linked like any other. Repeated rows are kept as they are; an empty table gives an empty result; other
    columns of ``df`` are not read.
    """
    with scratch(df.sparkSession) as keep:
        marked = keep(fingerprints(df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")), "t", shingle_words, "node").select("k", "node"), "fingerprints")
        with scratch(df.sparkSession) as put:
            distinct = put(marked.groupBy("node").agg(F.min(ordered(["k"])).alias("least")).select("*", pivot_distances(F.col("node")).alias("away")), "distinct")
            links = linked_pairs(distinct.select(F.col("node").alias("block"), "away"), rule, put)
            groups = keep(grouped(distinct.select("node", "least"), links, put).select("node", F.col("group.k_value").alias("component_id")), "components")
        keep.stay()
    return marked.join(groups, "node").select(F.col("k").alias(key), F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id")
