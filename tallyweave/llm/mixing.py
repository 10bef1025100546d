"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions only.

A source's documents, shuffled by digest, are cut into blocks of words that are equal but for one word; its quota is the number
of blocks that comes next to its target. The mix is a row of slots, one block each. Slot ``i`` has the point ``i * golden
ratio`` modulo 1 (in 32-bit integers), which the cumulative quotas map to a source; so every stretch of the schedule
holds the sources in nearly their shares. Slots beyond a quota stay empty, what a source lacks follows at the end. The
source's ``r``-th slot takes its block ``r`` modulo the number of blocks, so documents repeat only after all
others of the source were used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyweave.llm.quality import words_of
from tallyweave.llm.shared import free_name, written

#: 2**32 divided by the golden ratio, made odd: multiples modulo 2**32 are spread evenly.
GOLDEN = 2654435769
#: Weights of the sources in code point order, repeating.
WEIGHTS = (1, 2, 3)
#: No source is used more often than this.
MAX_EPOCHS = 3
#: A block has this many words at least, and so many that the whole has about ``MOST_BLOCKS`` at most, while every source has
#: ``LEAST_BLOCKS`` of them at least; sources up to ``TINY_WORDS`` have blocks of one word.
BLOCK_WORDS, MOST_BLOCKS, LEAST_BLOCKS, TINY_WORDS = 64, 1 << 22, 64, 256
#: Documents of a source are dealt by digest into this many parts for running totals, slots by this many in a row.
PARTS, SLOT_RUN = 4096, 65536
#: Cells of the point range, by which slots meet the intervals of the sources.
CELLS = 1024


def sizes(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(k, source, size, digest) of every row: words in the text and the shuffling digest of key and text size."""
    size = F.size(words_of(F.col(f"`{text}`"))).cast("long")
    got = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{source}`").alias("source"), size.alias("size"))
    return got.withColumn("digest", F.md5(F.concat_ws(":", F.coalesce(F.col("k").cast("string"), F.lit("")), F.col("size").cast("string"))))


def targets(of_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``of_source`` (source, source_size) with ``n`` (place in code point order, null last), ``part`` (its range), ``weight``, ``target``.

    Targets share the total by weight; one above ``max_epochs`` times its source's size is set to that, and the
    excess goes to the others by weight, until none is above. Each round is one aggregation over the sources;
    only two sums per round reach the driver. If all are capped, the targets add up to less than the total.
    """
    # sources sort in ranges, so that the places are counted range by range
    order = F.col("source").asc_nulls_last()
    ranged = of_source.repartitionByRange(order).select("*", F.spark_partition_id().alias("part"), F.lit(0).alias("zero"), F.lit(1).alias("one"))
    ranked = _running(written(ranged, "ranges"), "zero", "part", [order], "one", "n")
    table = ranked.select("source", "source_size", "n", "part").withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("n") % len(weights) + 1).cast("int")).cast("double"))
    table = written(table.withColumn("cap", F.col("source_size").cast("double") * max_epochs), "sources")
    total, total_weight = table.agg(F.sum("source_size"), F.sum("weight")).first()
    if not total:
        return table.withColumn("target", F.lit(0.0)).drop("cap")
    left, weight_left, rate = float(total), float(total_weight), None
    while weight_left > 0:
        # target of the uncapped: left * weight / weight_left
        over = F.lit(left) * F.col("weight") / F.lit(weight_left) > F.col("cap")
        capped, capped_weight = table.where(over).agg(F.coalesce(F.sum("cap"), F.lit(0.0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
        now = (float(total) - capped, float(total_weight) - capped_weight)
        if rate == now:
            break
        rate = now
        left, weight_left = now
    open_target = F.lit(left) * F.col("weight") / F.lit(weight_left) if weight_left > 0 else F.col("cap")
    return table.withColumn("target", F.least(open_target, F.col("cap"))).drop("cap")


def _running(rows: DataFrame, group: str, part: str, order: list, amount: str, out: str) -> DataFrame:
    """``rows`` with ``out``: the sum of ``amount`` over the rows of ``group`` that come before, by ``part``, then ``order``.

    Sums of parts run over the parts, then rows run within their part: no task holds a group.
    """
    sums = rows.groupBy(group, part).agg(F.sum(amount).alias("_sum"))
    earlier = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col(group).alias("_g"), F.col(part).alias("_p"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(group, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    met = rows.withColumn("_in", F.coalesce(F.sum(amount).over(inside), F.lit(0))).join(sums, (F.col(group) == F.col("_g")) & (F.col(part) == F.col("_p")))
    return met.withColumn(out, F.col("_base") + F.col("_in")).drop("_g", "_p", "_base", "_in")


def quotas(sources: DataFrame, total: float) -> DataFrame:
    """``sources`` (source_size, target) with ``blocks``, the number of a source's blocks, and ``quota``, how many the mix takes.

    The first ``source_size % blocks`` blocks have a word more than the others.
    """
    general = max(BLOCK_WORDS, int(-(-total // MOST_BLOCKS)))
    size = F.col("source_size")
    words = F.when(size <= TINY_WORDS, 1).otherwise(F.least(F.lit(general), F.greatest(F.lit(1), F.floor(size / LEAST_BLOCKS))))
    blocks = F.greatest(F.lit(1), F.ceil(size / words)).cast("long")
    return sources.withColumn("blocks", blocks).withColumn("quota", F.when(size > 0, F.floor(F.col("target") * F.col("blocks") / size + F.lit(0.5))).otherwise(F.lit(0)).cast("long"))


def schedule(sources: DataFrame) -> DataFrame:
    """(slot, n, rank, epoch, block): for each slot its source, the slot's rank there, and the block it takes.

    ``sources`` has n, part, blocks and quota. Every source gets its quota of slots: those that its points give it up to
    the quota, then the lacking ones, in rounds over the sources, behind the last point.
    """
    slots, places = sources.agg(F.coalesce(F.sum("quota"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    slots, places = int(slots), int(places) + 1
    low = _running(sources.where("quota > 0").select("n", "part", "blocks", "quota", F.lit(0).alias("zero")), "zero", "part", ["n"], "quota", "ahead")
    point = lambda x: F.ceil(x.cast("double") / F.lit(float(max(slots, 1))) * F.lit(float(1 << 32))).cast("long")
    bounds = low.select("n", "blocks", "quota", point(F.col("ahead")).alias("low"), point(F.col("ahead") + F.col("quota")).alias("high"))
    width = (1 << 32) // CELLS
    cells = bounds.where("high > low").withColumn("cell", F.explode(F.sequence(F.expr(f"low div {width}"), F.expr(f"least((high - 1) div {width}, {CELLS - 1})"))))
    i = F.col("id").bitwiseAND(F.lit((1 << 32) - 1))
    spread = F.shiftleft((F.shiftright(i, 16) * GOLDEN).bitwiseAND(F.lit(0xFFFF)), 16) + i.bitwiseAND(F.lit(0xFFFF)) * GOLDEN
    points = sources.sparkSession.range(slots).select(F.col("id").alias("slot"), spread.bitwiseAND(F.lit((1 << 32) - 1)).alias("point"))
    points = points.withColumn("cell", F.expr(f"point div {width}"))
    taken = points.join(cells, "cell").where("point >= low and point < high").select("slot", "n", "blocks", "quota", F.expr(f"slot div {SLOT_RUN}").alias("run"), F.lit(1).alias("one"))
    ranked = _running(taken, "n", "run", ["slot"], "one", "rank").where("rank < quota").select("slot", "n", "blocks", F.col("rank").cast("long").alias("rank"))
    got = taken.groupBy("n").agg(F.count("*").alias("got"))
    lacking = bounds.join(got, "n", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < quota")
    late = lacking.select("n", "blocks", "got", F.explode(F.sequence(F.col("got"), F.col("quota") - 1)).alias("rank"))
    late = late.select((F.lit(slots) + (F.col("rank") - F.col("got")) * places + F.col("n")).cast("long").alias("slot"), "n", "blocks", F.col("rank").cast("long").alias("rank"))
    return ranked.unionByName(late).select("slot", "n", "rank", F.floor(F.col("rank") / F.col("blocks")).alias("epoch"), (F.col("rank") % F.col("blocks")).alias("block"))


def _word_range(start: Column, size: Column, source_size: Column, blocks: Column) -> Column:
    """One struct (block, words) for each block that the words ``start`` to ``start + size`` of a source touch."""
    # the first blocks have a word more
    longer, short = source_size % blocks, F.floor(source_size / blocks)
    edge = longer * (short + 1)
    of = lambda w: F.when(w < edge, F.floor(w / (short + 1))).otherwise(longer + F.floor((w - edge) / short))
    at = lambda b: b * short + F.least(b, longer)
    overlap = lambda b: F.least(at(b + 1), start + size) - F.greatest(at(b), start)
    return F.transform(F.sequence(of(start), of(start + size - 1)), lambda b: F.struct(b.alias("block"), overlap(b).cast("long").alias("words")))


def mixed(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(key, size, source_size, target, taken) of every row.

    ``taken`` counts the words that the mix takes from the row, repeats included; it is at most ``max_epochs``
    times the size. A source's sum lies within half a block of its target, and one word for each block. A null or blank text has size 0 and gives nothing; a null source is a source of its own,
    last in order. Rows that repeat a key are rows of their own. An empty table gives an empty result. Reruns
    agree: nothing depends on the order or partitioning of the input. Other columns are not read.
    """
    docs = written(sizes(df, key, text, source), "sizes")
    of_source = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = written(targets(of_source, weights, max_epochs), "targets")
    sources = written(quotas(sources, sources.agg(F.sum("target")).first()[0] or 0.0), "quotas")
    named = docs.join(sources.select(F.col("source").alias("_s"), "n", "source_size", "target", "blocks"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "source")
    full = named.where("size > 0").withColumn("part", F.conv(F.substring("digest", 1, 3), 16, 10).cast("int") % PARTS)
    laid = _running(full, "n", "part", ["digest", "k", "size"], "size", "start")
    pieces = laid.select("n", "k", "size", "source_size", "target", "start", F.explode(_word_range(F.col("start"), F.col("size"), F.col("source_size"), F.col("blocks"))).alias("piece")).select("*", "piece.block", "piece.words").drop("piece")
    times = schedule(sources).groupBy("n", "block").agg(F.count("*").alias("times"))
    met = pieces.join(times, ["n", "block"], "left")
    # (n, start) names a row: rows of some size never start at the same word of their source
    taken = met.groupBy("n", "start", "k", "size", "source_size", "target").agg(F.sum(F.col("words") * F.coalesce("times", F.lit(0))).alias("taken"))
    columns = [F.col("k").alias(key), "size", "source_size", "target", F.col("taken").cast("long").alias("taken")]
    return taken.select(*columns).unionByName(named.where("size = 0").withColumn("taken", F.lit(0)).select(*columns))


def resampled(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **params) -> DataFrame:
    """The rows of ``df`` as often as the mix takes them: ``taken / size`` rounded half up, all columns unchanged.

    Only the documents at a source's last block are taken in part, and are rounded. Rows that repeat key and size
    share their rounds evenly by the mean; rows of size 0 are left out. Keys may be null, columns may have any names; an
    empty table gives an empty result.
    """
    k, size, n, times, copy = (free_name(df, x) for x in ("_key", "_size", "_words", "_times", "_copy"))
    mix = mixed(df, key, text, source, **params).where("taken > 0")
    found = mix.groupBy(F.col(f"`{key}`").alias(k), F.col("size").alias(n)).agg(F.floor(F.avg(F.col("taken") / F.col("size")) + 0.5).cast("int").alias(times)).where(F.col(times) > 0)
    met = df.withColumn(size, F.size(words_of(F.col(f"`{text}`"))).cast("long")).join(found, F.col(f"`{key}`").eqNullSafe(F.col(k)) & (F.col(size) == F.col(n)))
    return met.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*(F.col(f"`{c}`") for c in df.columns))
