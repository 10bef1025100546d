"""Near copies by exact similarity of shingle sets, behind the pivot distance tables of fingerprints.

SimHash bits bound no similarity: of 48 pairs of 0.8 or more, 128 bits linked 42, and 219 pairs below. The fingerprint here is
the *parity fingerprint*: bit ``h mod BITS`` is the parity of the digests that fall on it, so the Hamming distance of two
fingerprints never exceeds the symmetric difference of the sets, and sets of the least similarity lie within a radius that
follows from their sizes. Long texts have a second, wide fingerprint of one bit a shingle or more. Hence, without any loss:

1. Candidates share one of the first digests of either set in one order (prefix filter), of sets close in size.
2. Pivot distance tables: the distances of each fingerprint to ``PIVOTS`` references are computed once; pairs whose coordinates
   differ by more than their radius anywhere are discarded, then pairs whose fingerprints do, then those whose wide ones do
   (in large groups at once, where they meet).
3. Survivors are verified by the exact similarity of their texts' shingle sets.

Each text is held against one text of each of its first digests. Texts that share a digest and that these links do not connect
yet meet in groups of up to ``GROUP_ROWS`` by a join (1.5 rows a text), in larger ones inside tasks, block by block: first a
task returns the closest pairs that would connect its block (fewer than it has texts), and when these are verified, what
passes the tables between texts that are still apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.shared import SPACE_CHARS, Put, free_name, scratch
from tallyweave.llm.simhash import PIVOTS, SEED, components, grouped, ordered, shingle_hashes

#: Least Jaccard similarity of the distinct five-word shingles of near copies, as (numerator, denominator).
SIMILAR = (4, 5)
SHINGLE_WORDS = 5
#: Bits of a parity fingerprint.
BITS = 1024
#: Shingles are counted in so many texts, about, or in one of ``SAMPLE_OF``, if these are more; from ``COMMON`` on one is common, and the
#: ``MOST_COMMON`` most frequent ones at most are held as such. What is taken for common affects the size of groups only.
SAMPLE_TEXTS, SAMPLE_OF = 8_000, 1_000
COMMON, MOST_COMMON = 3, 2_000_000
#: Texts that share a digest meet by a join up to this many, above it in blocks of ``BLOCK_ROWS``.
GROUP_ROWS, BLOCK_ROWS = 4, 1024


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct five-word shingles of a text as sorted digests."""
    return np.unique(shingle_hashes(text, SHINGLE_WORDS))


def ranks(hashes: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The counts of digests among the common ones, 0 for others."""
    if not len(common):
        return np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
    return np.where(common[at] == hashes, counts[at], 0)


def prefix(hashes: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first digests of a set in the order of (count among the common ones, digest), so many that two sets of
    the least similarity have one of them in common. Any order that is the same for all texts will do."""
    most = len(hashes) - -(-len(hashes) * SIMILAR[0] // SIMILAR[1]) + 1
    return hashes[np.lexsort((hashes, ranks(hashes, common, counts)))[:most]]


def parity(hashes: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The parity fingerprint of a set of digests, as bytes."""
    return np.packbits((np.bincount((hashes % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8))


def wide_parity(hashes: np.ndarray) -> bytes:
    """The fingerprint of a large set with at least one bit for each digest; empty where ``BITS`` are as many."""
    bits = BITS
    while bits < len(hashes):
        bits *= 2
    return parity(hashes, bits).tobytes() if bits > BITS else b""


def wide_within(x: bytes, n: int, y: bytes, m: int) -> bool:
    """Whether wide fingerprints of sets of sizes n and m allow the least similarity. One that has more bits is folded, which gives
    the fingerprint of fewer."""
    if not x or not y:
        return True
    u, v = (np.frombuffer(z, np.uint64) for z in (x, y))
    u, v = (np.bitwise_xor.reduce(z.reshape(-1, min(len(u), len(v))), axis=0) for z in (u, v))
    return int(np.bitwise_count(u ^ v).sum()) * (SIMILAR[0] + SIMILAR[1]) <= (n + m) * (SIMILAR[1] - SIMILAR[0])


def wide_allowed(wide: list[bytes], n: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``wide_within`` of the pairs (a, b), as positions in the tables: a row is folded once for each size that it meets."""
    length = np.array([len(w) for w in wide], np.int64)
    shorter, keep = np.minimum(length[a], length[b]), np.ones(len(a), bool)
    for size in np.unique(shorter[shorter > 0]).tolist():
        at = np.flatnonzero(shorter == size)
        rows, where = np.unique(np.concatenate([a[at], b[at]]), return_inverse=True)
        folded = np.stack([np.bitwise_xor.reduce(np.frombuffer(wide[r], np.uint64).reshape(-1, size // 8), axis=0) for r in rows.tolist()])
        x, y = where[: len(at)], where[len(at) :]
        step = max(1, (1 << 22) // size)
        for low in range(0, len(at), step):
            some = slice(low, low + step)
            apart = np.bitwise_count(folded[x[some]] ^ folded[y[some]]).sum(axis=1, dtype=np.int64)
            keep[at[some]] = apart * (SIMILAR[0] + SIMILAR[1]) <= (n[a[at[some]]] + n[b[at[some]]]) * (SIMILAR[1] - SIMILAR[0])
    return keep


def references(n: int = PIVOTS) -> np.ndarray:
    """The fingerprint without bits, from which the distance is the number of bits, and ``n - 1`` with half their bits, as bytes."""
    words = [[xxhash.xxh64_intdigest(f"reference {i} {j}", seed=SEED) for j in range(BITS // 64)] for i in range(n - 1)]
    return np.vstack([np.zeros(BITS // 8, np.uint8), np.array(words, "<u8").view(np.uint8)])


def distances(bits: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Hamming distances of the fingerprints ``bits`` and ``of``, by rows."""
    return np.bitwise_count((bits ^ of).view(np.uint64)).sum(axis=-1, dtype=np.int16)


def within(bits: np.ndarray, away: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the pairs (a, b), as positions in the tables, the sizes ``n`` of the sets allow, and their distances: pivot by
    pivot first, then bit by bit.

    Sets of sizes n and m at the least similarity p/q differ by (n + m) (q - p) / (q + p) digests at most.
    """
    p, q = SIMILAR
    left = np.flatnonzero(np.minimum(n[a], n[b]) * q >= np.maximum(n[a], n[b]) * p)
    for x in away.T:
        left = left[np.abs(x[a[left]] - x[b[left]]) * (q + p) <= (n[a[left]] + n[b[left]]) * (q - p)]
    apart = distances(bits[a[left]], bits[b[left]]).astype(np.int64)
    near = apart * (q + p) <= (n[a[left]] + n[b[left]]) * (q - p)
    return left[near], apart[near]


def joining(label: np.ndarray, a: np.ndarray, b: np.ndarray, apart: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of the pairs (a, b), those that connect labels that no closer pair has connected: fewer than there are labels."""
    order = np.argsort(apart / size, kind="stable")
    x, y = np.minimum(label[a], label[b])[order], np.maximum(label[a], label[b])[order]
    _, first = np.unique(np.stack([x, y], axis=1), axis=0, return_index=True)
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        while v in parent:
            v = parent[v]
        return v

    keep = []
    for i in np.sort(first).tolist():
        u, v = root(int(x[i])), root(int(y[i]))
        if u != v:
            parent[max(u, v)] = min(u, v)
            keep.append(order[i])
    return np.array(keep, np.int64)


def _tables(rows: pa.StructArray | pa.RecordBatch, side: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bits, away, n) of a batch of marks: fingerprints as rows of bytes, rows of the distance table, sizes of the sets."""
    column = rows.column if isinstance(rows, pa.RecordBatch) else rows.field
    bits = column(f"{side}bits").to_pylist()
    away = np.asarray(column(f"{side}away").flatten()).reshape(len(bits), PIVOTS).astype(np.int32)
    return np.frombuffer(b"".join(bits), np.uint8).reshape(len(bits), BITS // 8), away, np.asarray(column(f"{side}n")).astype(np.int64)


def alike(shared: int, n: int, m: int) -> bool:
    """Whether sets of sizes n and m with ``shared`` common digests have the least similarity."""
    return shared * SIMILAR[1] >= SIMILAR[0] * (n + m - shared)


def _common_shingles(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(sorted digests, counts) of the shingles that ``COMMON`` or more of a sample of the texts hold.

    The sample grows with the corpus, so that a shingle which is not found common stands in some thousands of texts at most; the
    driver gets 32 MB, whatever the number and the length of the texts.
    """
    one_in = min(max(1, round(texts.count() / SAMPLE_TEXTS)), SAMPLE_OF)

    @F.pandas_udf("array<long>")
    def sets(column: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t).view(np.int64) for t in column])

    sample = texts.where(F.pmod(F.xxhash64("node"), F.lit(one_in)) == 0).dropDuplicates(["node"])
    rows = sample.select(F.explode(sets(F.col("t"))).alias("h")).groupBy("h").count().where(F.col("count") >= COMMON)
    found = rows.orderBy(F.desc("count"), "h").limit(MOST_COMMON).toArrow()
    common, counts = (found.column(c).to_numpy().astype(np.int64) for c in ("h", "count"))
    order = np.argsort(common.view(np.uint64))
    return common.view(np.uint64)[order], counts[order]


def _marked(texts: DataFrame, put: Put) -> DataFrame:
    """(node, n, first, bits, away, wide) of each text: size of its set, first digests, fingerprint, pivot distances, wide fingerprint."""
    common, counts = _common_shingles(texts)

    @F.pandas_udf("struct<n: int, first: array<long>, bits: binary, away: array<smallint>, wide: binary>")
    def marks(column: pd.Series) -> pd.DataFrame:
        pivots, rows = references(), []
        for t in column:
            x = shingle_set(t)
            bits = parity(x)
            rows.append((len(x), prefix(x, common, counts).view(np.int64), bits.tobytes(), distances(pivots, bits), wide_parity(x)))
        return pd.DataFrame(rows, columns=["n", "first", "bits", "away", "wide"])

    return put(texts.where("t <> ''").select("node", marks("t").alias("m")).select("node", "m.*").dropDuplicates(["node"]), "marks")


def _sides(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """Pairs (a, b) with the columns of ``table`` for either node, as a_... and b_..."""
    of = lambda side: table.select(*(F.col(c).alias({"node": side}.get(c, f"{side}_{c}")) for c in table.columns))
    return pairs.join(of("a"), "a").join(of("b"), "b")


def _similar(pairs: DataFrame, held: DataFrame, marked: DataFrame, put: Put) -> DataFrame:
    """The pairs (a, b) of texts whose shingle sets reach the least similarity: by the tables, then by the texts (node, t), a row a node."""

    def may_be(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits, away, n = (np.concatenate(x) for x in zip(_tables(batch, "a_"), _tables(batch, "b_"), strict=True))
            at = np.arange(batch.num_rows)
            yield batch.select(["a", "b"]).take(pa.array(within(bits, away, n, at, at + batch.num_rows)[0]))

    def may_still(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("a_wide", "a_n", "b_wide", "b_n"))
            yield batch.select(["a", "b"]).filter(pa.array([wide_within(*x) for x in zip(*columns, strict=True)], pa.bool_()))

    def are(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last = None, np.empty(0, np.uint64)
        for batch in batches:
            keep = []
            for a, t, u in zip(batch.column("a").to_pylist(), batch.column("a_t"), batch.column("b_t"), strict=True):
                if a != at:
                    at, last = a, shingle_set(t.as_py())
                y = shingle_set(u.as_py())
                keep.append(alike(len(np.intersect1d(last, y, assume_unique=True)), len(last), len(y)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    met = _sides(pairs, marked.select("node", "n", "bits", "away"))
    near = put(met.mapInArrow(may_be, "a long, b long"), "near")
    close = put(_sides(near, marked.select("node", "n", "wide")).select("a", "b", "a_wide", "a_n", "b_wide", "b_n").mapInArrow(may_still, "a long, b long"), "close")
    nodes = put(close.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
    # Spark broadcasts the names where they are few: then only their texts travel; else both sides take them from one exchange
    wanted = held.join(nodes, "node", "left_semi")
    return put(_sides(close, wanted).select("a", "b", "a_t", "b_t").mapInArrow(are, "a long, b long"), "similar")


def _blocks(crowded: DataFrame, marked: DataFrame, forest: bool) -> DataFrame:
    """Pairs (a, b) of texts of one large group with different labels that pass the tables; with ``forest`` of each pair of
    blocks only those that connect its labels, the closest first.

    Groups are dealt into blocks by node, each pair of blocks is a row: a task holds two blocks at a time.
    """
    n_blocks = F.ceil(F.col("members") / BLOCK_ROWS).cast("int")
    rows = crowded.join(marked.select("node", "n", "bits", "away", "wide"), "node")
    own = F.pmod(F.xxhash64("node"), n_blocks).cast("int")
    dealt = rows.select("h", F.struct("node", "label", "n", "bits", "away", "wide").alias("x"), own.alias("own"), F.explode(F.sequence(F.lit(0), n_blocks - 1)).alias("other"))
    lists = dealt.groupBy("h", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(F.collect_list("x").alias("xs")).select("xs")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts = np.concatenate([[0], np.cumsum(np.asarray(batch.column(0).value_lengths()))])
            flat = batch.column(0).flatten()
            nodes, labels = (np.asarray(flat.field(c)) for c in ("node", "label"))
            bits, away, n = _tables(flat)
            wide = flat.field("wide").to_pylist()
            found = [(np.empty(0, np.int64),) * 2]
            for low, high in zip(starts, starts[1:], strict=False):
                label, pairs = labels[low:high], [(np.empty(0, np.int64),) * 3]
                for start in range(0, high - low, 64):
                    a, b = (x.ravel() for x in np.meshgrid(np.arange(start, min(start + 64, high - low)), np.arange(start + 1, high - low), indexing="ij"))
                    other = (a < b) & (label[a] != label[b])
                    a, b = a[other], b[other]
                    some, apart = within(bits[low:high], away[low:high], n[low:high], a, b)
                    a, b = a[some], b[some]
                    some = wide_allowed(wide[low:high], n[low:high], a, b)
                    a, b, apart = a[some], b[some], apart[some]
                    if forest and len(a):
                        some = joining(label, a, b, apart, n[low + a] + n[low + b])
                        a, b, apart = a[some], b[some], apart[some]
                    pairs.append((a, b, apart))
                a, b, apart = (np.concatenate(x) for x in zip(*pairs, strict=True))
                if forest and len(a):
                    some = joining(label, a, b, apart, n[low + a] + n[low + b])
                    a, b = a[some], b[some]
                found.append((low + a, low + b))
            x, y = (nodes[np.concatenate(z)] for z in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    return lists.mapInArrow(near, "a long, b long").distinct()


def _apart(shared: DataFrame, links: DataFrame, put: Put) -> tuple[DataFrame, DataFrame]:
    """(h, node, label, members, times) of the groups in which links leave texts apart, label by what links connect; and links as stars, which connect the same.

    Digests whose groups hold the same texts (a passage has many) are one group, ``times`` is their number. Groups are told by size and
    two 64-bit digests of their texts.
    """
    labels = put(components(links, put), "labels")
    at = shared.join(labels, shared.node == labels.node_, "left").select("h", "node", F.coalesce("label", "node").alias("label"))
    told = (F.bit_xor(F.xxhash64("node")).alias("u"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("v"))
    mixed = at.groupBy("h").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("members"), *told).where("x < y")
    mixed = put(mixed.groupBy("members", "u", "v").agg(F.min("h").alias("h"), F.count("*").alias("times")).select("h", "members", "times"), "mixed")
    return put(at.join(mixed, "h"), "apart"), labels.where("label <> node_").select(F.col("label").alias("a"), F.col("node_").alias("b"))


def similar_links(texts: DataFrame, put: Put) -> DataFrame:
    """Links (a, b), a < b, between ``node``s that connect all whose texts ``t`` reach the least similarity, and no others.

    Rows of a node have the same text. Links that were found are kept as stars, so that components start from what is connected already.
    """
    p, q = SIMILAR
    marked = _marked(texts, put)
    posts = marked.select(F.explode("first").alias("h"), "node")
    leads = put(posts.groupBy("h").agg(F.min("node").alias("lead"), F.max("node").alias("last")).where("lead < last").select("h", "lead"), "leads")
    shared = put(posts.join(leads, "h"), "shared")
    tested = put(shared.where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct(), "led")
    # the texts that share a first digest with another, once: all later pairs are between these
    held = put(texts.where("t <> ''").join(shared.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]), "held")
    links = _similar(tested, held, marked, put)
    crowded, links = _apart(shared, links, put)
    crowded = crowded.where(F.col("members") > GROUP_ROWS)
    closest = put(_blocks(crowded, marked, True).join(tested, ["a", "b"], "left_anti"), "closest")
    links, tested = links.unionAll(_similar(closest, held, marked, put)), tested.unionAll(closest)
    apart, links = _apart(shared, links, put)
    few = apart.where(F.col("members") <= GROUP_ROWS)
    x, y = few.alias("x"), few.alias("y")
    met = x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.label") != F.col("y.label")))
    met = met.groupBy(F.col("x.node").alias("a"), F.col("y.node").alias("b")).agg(F.sum("x.times").alias("both"))
    # both: the first digests that a pair shares, unless a large group has the pair, too, which finds it there. All that sets
    # share lies in both prefixes or behind one of them
    behind = lambda n: F.ceil(n * p / q) - 1
    may_be = (F.col("both") + F.greatest(behind(F.col("a_n")), behind(F.col("b_n")))) * (p + q) >= p * (F.col("a_n") + F.col("b_n"))
    small = _sides(met, marked.select("node", "n")).where(may_be).select("a", "b")
    rest = small.unionAll(_blocks(apart.where(F.col("members") > GROUP_ROWS), marked, False)).distinct().join(tested, ["a", "b"], "left_anti")
    return links.unionAll(_similar(rest, held, marked, put))


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` without near copies: the row with the smallest key of each group stays.

    A group is what links of the least similarity connect; texts without words (null, empty, blank) are alike. Texts of fewer
    than five words are one shingle. Rows without a key order after all others, by a digest of their text. Of
    rows that repeat a key, the one with the smallest text digest stays, and of exact repeats one. All columns of ``df`` are
    returned, whatever their names; an empty table gives an empty result.
    """
    spark = df.sparkSession
    k, d = free_name(df, "_key"), free_name(df, "_digest")
    digest = F.xxhash64(F.col(f"`{text}`"))
    bare = F.btrim(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit(SPACE_CHARS))
    texts = df.select(F.col(f"`{key}`").alias("k"), digest.alias("d"), F.xxhash64(bare).alias("node"), bare.alias("t"))
    with scratch(spark) as keep:
        with scratch(spark) as put:
            rows = put(texts.select("k", "d", "node"), "rows")
            distinct = rows.groupBy("node").agg(F.min(ordered(["k", "d"])).alias("least"))
            groups = grouped(distinct, similar_links(texts.select("node", "t"), put), put)
            kept = keep(groups.select(F.col("group.k_value").alias(k), F.col("group.d_value").alias(d)).distinct(), "kept")
            repeated = bool(rows.groupBy("k", "d").count().where("count > 1").limit(1).count())
        keep.stay()
    own = free_name(df, "_own")
    out = df.withColumn(own, digest).join(kept, F.col(f"`{key}`").eqNullSafe(F.col(k)) & F.col(own).eqNullSafe(F.col(d)), "left_semi")
    return (out.dropDuplicates([key, own]) if repeated else out).drop(own)
