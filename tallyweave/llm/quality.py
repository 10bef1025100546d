"""Quality rules as learned decision lists, in DataFrame functions only.

``word_features`` measures every whole text; ``learn`` grows and prunes ordered rules by sequential covering
from counts of labelled rows; ``verdict`` turns the list into one ordered Spark conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.shared import SPACE, SPACE_CHARS, written

#: Words in a repeated window.
WINDOW = 8
#: A text fails with fewer words than this, or with more than this percentage of its words in repeated windows.
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: Of the label counts, every third cell-row by digest is held back for pruning.
PRUNE_PARTS, PRUNE_OF = 1, 3

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def words_of(text: Column) -> Column:
    """The words of a text (what stands between white space) as an array; none for null or blank."""
    bare = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(F.coalesce(F.length(bare), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(F.split(bare, f"[{SPACE}]+"))


def _pairs(values: str, step: int) -> Column:
    """For an array column of digests, the digest of each element with the one ``step`` later."""
    n = F.greatest(F.size(values) - step, F.lit(0))
    return F.zip_with(F.slice(values, F.lit(1), n), F.slice(values, F.lit(1 + step), n), lambda a, b: F.xxhash64(a, b))


def word_features(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` without ``text``, with the long columns of ``COUNTS``.

    ``n_repeat_words`` counts the words that lie in an eight-word window found at least twice in the text, the
    first occurrence included; windows compare by 64-bit digests. ``n_dup_lines`` counts lines with a word
    that equal an earlier line. Null, empty and blank texts have zero everywhere. A column of ``df`` that is named like a count
    passes under that name with underscores added. Array functions within the row: nothing is shuffled, and a long text costs
    n log n only if a window repeats.
    """
    rest = [c for c in df.columns if c != text]
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    row = F.struct(*(F.col(f"`{c}`") for c in rest)) if rest else F.lit(0)
    a = df.select(row.alias("_row"), words_of(t).alias("_w"), F.filter(F.split(t, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACE_CHARS))) > 0).alias("_l"), (F.length(t) - F.length(F.regexp_replace(t, "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"))
    a = a.select("_row", "n_symbols", F.size("_w").cast("long").alias("n_words"), F.length(F.array_join("_w", "")).cast("long").alias("word_chars"), (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"), F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"))
    kept = ["_row", "n_symbols", "n_words", "word_chars", "n_dup_lines"]
    step = 1
    while step < WINDOW:
        a = a.select(*kept, _pairs("_h", step).alias("_h"))
        step *= 2
    a = a.select(*kept, F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_s"))
    n = F.size("_s") - 1
    both = F.zip_with(F.slice("_s", F.lit(1), n), F.slice("_s", F.lit(2), n), lambda x, y: F.when(x.h == y.h, F.array(x.i, y.i)).otherwise(F.array().cast("array<int>")))
    a = a.select(*kept, F.when(F.col("_s").isNotNull(), F.sort_array(F.array_distinct(F.flatten(both)))).alias("_p"))
    k = F.size("_p") - 1
    gaps = F.zip_with(F.slice("_p", F.lit(1), k), F.slice("_p", F.lit(2), k), lambda x, y: F.least(y - x, F.lit(WINDOW)).cast("long"))
    covered = F.aggregate(gaps, F.lit(WINDOW).cast("long"), lambda acc, g: acc + g)
    names, taken = {}, {c.lower() for c in (*COUNTS, *rest)}
    for c in rest:
        name = c
        while c.lower() in COUNTS and name.lower() in taken:
            name += "_"
        names[c] = name
        taken.add(name.lower())
    return a.select(*(F.col("_row")[c].alias(n) for c, n in names.items()), "n_symbols", "n_words", "word_chars", "n_dup_lines", F.when(F.col("_p").isNotNull(), covered).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"))


def shares(n_words: Column, word_chars: Column, n_symbols: Column, n_dup_lines: Column, n_repeat_words: Column) -> dict[str, Column]:
    """The measures that learned conditions test, by name; zero for a text without words."""
    per = lambda a, b: F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))
    return {
        "words": n_words.cast("double"),
        "word_length": per(word_chars, n_words),
        "symbol_share": per(n_symbols, word_chars),
        "repeat_share": per(n_repeat_words, n_words),
        "dup_lines_per_word": per(n_dup_lines, n_words),
    }


@dataclass(frozen=True)
class Condition:
    measure: str
    above: bool  # value > threshold, else value <= threshold
    threshold: float


@dataclass(frozen=True)
class RejectRule:
    conditions: tuple[Condition, ...]
    precision: float
    rejected: int


def _cells(rows: DataFrame, measures: list[str], cuts: dict[str, list[float]], label: str) -> list[tuple[tuple[int, ...], bool, bool, int]]:
    """(bin of each measure, held back, bad, count): at most (cuts + 1) ** measures * 4 rows, however many are labelled."""
    bins = [sum((F.col(m) > c).cast("int") for c in cuts[m]) if cuts[m] else F.lit(0) for m in measures]
    held = F.pmod(F.xxhash64(*measures), F.lit(PRUNE_OF)) < PRUNE_PARTS
    got = rows.groupBy(F.array(*bins).alias("bins"), held.alias("held"), (F.col(label) == 0).alias("bad")).count()
    return [(tuple(r.bins), r.held, r.bad, r["count"]) for r in got.collect()]


def learn(labelled: DataFrame, label: str = "quality", measures: tuple[str, ...] = ("words", "word_length", "symbol_share", "repeat_share", "dup_lines_per_word"), n_cuts: int = 7, min_precision: float = 0.95, min_bad: int = 3, max_rules: int = 8) -> list[RejectRule]:
    """Rules that reject what ``label`` marks 0, most precise first found, by sequential covering.

    Cuts are quantiles of each measure among all and among bad rows. All labelled rows count, through one
    aggregation into cells. A rule grows by the condition with the best gain on the growing part, is pruned from its end by
    accuracy on the held-back part, and is accepted if at least ``min_precision`` of what it catches on both
    parts together is bad. Rows without a label or with a null label are left out; with no accepted rule
    (an empty table, one class only) the list is empty and nothing is rejected. Only cells and quantiles reach
    the driver; their number does not depend on the input.
    """
    rows = labelled.where(F.col(label).isNotNull()).select(label, *measures)
    probs = [(i + 1) / (n_cuts + 1) for i in range(n_cuts)]
    found = rows.groupBy((F.col(label) == 0).alias("bad")).agg(*(F.percentile_approx(m, probs, 1000).alias(m) for m in measures)).collect()
    cuts = {m: sorted({v for r in found for v in (r[m] if r.bad else r[m][:: max(1, n_cuts // 2)]) or []}) for m in measures}
    cells = _cells(rows, list(measures), cuts, label)
    options = [(i, above, k) for i, m in enumerate(measures) for k in range(len(cuts[m])) for above in (True, False)]
    meets = lambda bins, c: (bins[c[0]] > c[2]) == c[1]

    def counts(part: list, conditions: list) -> tuple[int, int]:
        good = bad = 0
        for bins, _, is_bad, n in part:
            if all(meets(bins, c) for c in conditions):
                bad, good = bad + n * is_bad, good + n * (not is_bad)
        return bad, good

    rules: list[RejectRule] = []
    while len(rules) < max_rules:
        grow, prune = [c for c in cells if not c[1]], [c for c in cells if c[1]]
        chosen: list[tuple[int, bool, int]] = []
        inside = grow
        bad, good = counts(inside, [])
        while bad and good and len(chosen) < 4:
            base, best = math.log2(bad / (bad + good)), None
            tally: dict[tuple[int, int], list[int]] = {}
            for bins, _, is_bad, n in inside:
                for i, b in enumerate(bins):
                    tally.setdefault((i, b), [0, 0])[not is_bad] += n
            for c in options:
                p, q = (sum(v[x] for (i, b), v in tally.items() if i == c[0] and (b > c[2]) == c[1]) for x in (0, 1))
                gain = p * (math.log2(p / (p + q)) - base) if p else 0.0
                if p and (best is None or gain > best[0] + 1e-12):
                    best = (gain, c)
            if best is None or best[0] <= 1e-9:
                break
            chosen.append(best[1])
            inside = [x for x in inside if meets(x[0], best[1])]
            bad, good = counts(inside, [])
        if not chosen:
            break
        worth = lambda c: (lambda p, q: (p - q) / (p + q) if p + q else -1.0)(*counts(prune, c))
        keep = max(range(len(chosen), 0, -1), key=lambda n: (worth(chosen[:n]), n))
        for n in (keep, len(chosen)):
            bad, good = counts(cells, chosen[:n])
            if bad >= min_bad and bad / (bad + good) >= min_precision:
                rules.append(RejectRule(tuple(Condition(measures[i], above, cuts[measures[i]][k]) for i, above, k in chosen[:n]), bad / (bad + good), bad + good))
                cells = [x for x in cells if not all(meets(x[0], c) for c in chosen[:n])]
                break
        else:
            break
    return rules


def verdict(rules: list[RejectRule], measures: dict[str, Column]) -> Column:
    """The ordered conditional expression of a list: the number of the first rule that holds, else 0."""
    out = None
    for n, rule in enumerate(rules, 1):
        holds = F.lit(True)
        for c in rule.conditions:
            holds = holds & ((measures[c.measure] > c.threshold) if c.above else (measures[c.measure] <= c.threshold))
        out = F.when(holds, F.lit(n)) if out is None else out.when(holds, F.lit(n))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def judged(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **params) -> DataFrame:
    """One row per row of ``df``: key, the counts, ``base_failed``, ``rule`` (first learned rule that holds,
    0 for none) and ``kept``.

    The features are measured once, written, and used for learning and for the verdict. ``labels`` has the
    key and ``quality`` (0 bad); labels of unknown keys are ignored, null keys match nothing, rows with
    several labels count with each. Other columns of either table are not read.
    """
    rows = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))
    features = written(word_features(rows, "t"), "features")
    measures = shares(*(F.col(c) for c in COUNTS))
    marks = labels.select(F.col(f"`{key}`").alias("k"), F.col("quality"))
    passing = features.where(~base_failed(F.col("n_words"), F.col("n_repeat_words")))
    labelled = passing.join(marks, "k").select("quality", *(v.alias(m) for m, v in measures.items()))
    rules = learn(labelled, **params)
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    out = features.select(F.col("k").alias(key), *COUNTS, failed.alias("base_failed"), verdict(rules, measures).alias("rule"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def kept_rows(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **params) -> DataFrame:
    """The rows of ``df`` that are kept, with all their columns.

    Rows and counts are written once, so that each text is measured once and none is shuffled; only keys and
    counts meet the labels. Rows with null keys are judged like all others.
    """
    marks = labels.select(F.col(f"`{key}`").alias("k"), F.col("quality"))
    measures = shares(*(F.col(c) for c in COUNTS))
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row")
    measured = written(word_features(df.select(row, F.col(f"`{text}`").alias("_text")), "_text"), "measured")
    labelled = measured.where(~failed).select(F.col(f"_row.`{key}`").alias("k"), *COUNTS).join(marks, "k").select("quality", *(v.alias(m) for m, v in measures.items()))
    rules = learn(labelled, **params)
    return measured.where(~failed & (verdict(rules, measures) == 0)).select("_row.*")
