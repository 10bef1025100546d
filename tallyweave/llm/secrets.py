"""Secret scans with a trigram inverted index, in DataFrame functions only.

1. ``trigram_query`` derives from each rule's pattern a Boolean query: an OR of ANDs of trigrams that every match must
   contain. A rule without mandatory trigrams scans every text.
2. ``postings``: (trigram, text digest) for the trigrams that some rule asks for, from one pass over the distinct texts.
3. ``candidates``: postings meet the terms of the queries; a text that has all trigrams of one AND is a candidate.
4. ``scanned`` verifies candidates with the patterns themselves, at exact places.

Texts are named by a 128-bit digest, so that equal texts are looked up once and keys need not be unique.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as sre
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.shared import written

#: Trigrams of an AND that are looked up; any of them are a condition of every match, and these few, evenly taken, are nearly as rare as all.
TERMS = 4
#: Most strings that one part of a pattern may stand for to be spelled out.
SPELLED = 64


@dataclass(frozen=True)
class SecretRule:
    """``pattern`` in the common ground of Python and Java; a match counts if ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    any_case: bool = False

    @property
    def java(self) -> str:
        return ("(?i)" if self.any_case else "") + self.pattern


#: The base kinds, in the order that breaks ties of place.
BASE = (
    SecretRule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    SecretRule("access", r"AKIA[A-Z0-9]+", 0, 20),
    SecretRule("hex", r"[0-9a-f]+", 0, 24),
)
#: Kinds that the method adds: well-known public formats of keys.
MORE = (
    SecretRule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY[A-Z ]*-----"),
    SecretRule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    SecretRule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    SecretRule("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
    SecretRule("stripe", r"[sr]k_live_[A-Za-z0-9]+", 0, 24),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
)
RULES = BASE + MORE

#: An OR of ANDs of trigrams; ``ALL`` stands for every text.
Query = frozenset[frozenset[str]]
ALL: Query = frozenset([frozenset()])


@dataclass(frozen=True)
class _Part:
    """What a piece of a pattern can match: all its strings if few, else None; and the query of every match."""

    strings: frozenset[str] | None
    query: Query


def _simplest(query: Query) -> Query:
    return frozenset(a for a in query if not any(b < a for b in query))


def _and(a: Query, b: Query) -> Query:
    joined = frozenset(x | y for x in a for y in b)
    # past a bound the weaker of both still holds for every match
    return _simplest(joined) if len(joined) <= SPELLED else min(a, b, key=len)


def _spelled(strings: frozenset[str]) -> Query:
    """Every string of the set contains all its own trigrams; one that is too short asks for nothing."""
    return _simplest(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))


def _then(parts: list[_Part]) -> _Part:
    """Parts behind each other: neighbours that are spelled out are joined before their trigrams are taken."""
    query, run = ALL, frozenset([""])
    whole: frozenset[str] | None = frozenset([""])
    for p in parts:
        joined = frozenset(a + b for a in run for b in p.strings) if p.strings is not None and len(run) * len(p.strings) <= SPELLED else None
        if joined is None:
            query = _and(_and(query, _spelled(run)), p.query)
            run, whole = (p.strings if p.strings is not None else frozenset([""])), None
        else:
            run = joined
            whole = run if whole is not None else None
    return _Part(whole, _and(query, _spelled(run)))


def _part(tree) -> _Part:
    return _then([_piece(op, arg) for op, arg in tree])


def _piece(op, arg) -> _Part:
    free = _Part(None, ALL)
    if op is sre.LITERAL:
        return _Part(frozenset([chr(arg)]), ALL)
    if op is sre.IN:
        if any(o not in (sre.LITERAL, sre.RANGE) for o, _ in arg):
            return free
        chars = {chr(c) for o, a in arg for c in (range(a[0], a[1] + 1) if o is sre.RANGE else [a])}
        return _Part(frozenset(chars), ALL) if len(chars) <= 8 else free
    if op is sre.SUBPATTERN:
        return _part(arg[3])
    if op is sre.BRANCH:
        branches = [_part(b) for b in arg[1]]
        strings = frozenset().union(*(b.strings for b in branches)) if all(b.strings is not None for b in branches) else None
        query = _simplest(frozenset().union(*(b.query if b.strings is None else _spelled(b.strings) for b in branches)))
        return _Part(strings if strings is not None and len(strings) <= SPELLED else None, query)
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, body = arg
        once = _part(body)
        if (low, high) == (0, 1) and once.strings is not None:
            return _Part(once.strings | {""}, ALL)
        if low == 0:
            return free
        return _Part(None, once.query if once.strings is None else _spelled(once.strings))
    return _Part(frozenset([""]), ALL) if op is sre.AT else free


def trigram_query(rule: SecretRule) -> Query:
    """The Boolean trigram query of a rule, in lower case for rules of any case; ``ALL`` if nothing is mandatory."""
    part = _part(_parser.parse(rule.pattern))
    query = part.query if part.strings is None else _spelled(part.strings)
    if frozenset() in query:
        return ALL
    return frozenset(_few([t.lower() if rule.any_case else t for t in a]) for a in query)


def _few(trigrams: list[str]) -> frozenset[str]:
    ordered = sorted(set(trigrams))
    n = min(TERMS, len(ordered))
    return frozenset(ordered[i * len(ordered) // n] for i in range(n))


def _digest(text: Column) -> Column:
    """128 bits that name a text."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(text, F.lit(1)).alias("b"))


def postings(texts: DataFrame, rules: tuple[SecretRule, ...]) -> DataFrame:
    """(any_case, trigram, digest): which of the rules' trigrams each distinct text has. ``texts`` has column ``t``."""
    wanted = sorted({(r.any_case, t) for r in rules for a in trigram_query(r) for t in a})
    folded = F.lower("t")
    has = [F.when(F.contains(F.col("_low") if any_case else F.col("t"), F.lit(t)), F.lit(i)) for i, (any_case, t) in enumerate(wanted)]
    found = texts.select("t", folded.alias("_low")).select(_digest(F.col("t")).alias("digest"), F.explode(F.array_compact(F.array(*has))).alias("trigram"))
    return found.distinct()


def candidates(texts: DataFrame, rules: tuple[SecretRule, ...]) -> DataFrame:
    """(digest, kinds): the rules whose query a text meets, of rules that have one. ``texts`` has column ``t``."""
    wanted = {w: i for i, w in enumerate(sorted({(r.any_case, t) for r in rules for a in trigram_query(r) for t in a}))}
    terms = [(r.kind, n, wanted[r.any_case, t], len(a)) for r in rules for n, a in enumerate(sorted(trigram_query(r), key=sorted)) for t in a]
    # a row per trigram of a rule: fixed by the rules, not by the data
    of_rules = F.broadcast(texts.sparkSession.createDataFrame(terms, "kind string, clause int, trigram int, need int"))
    met = postings(texts, rules).join(of_rules, "trigram").groupBy("digest", "kind", "clause").agg(F.count("*").alias("n"), F.max("need").alias("need")).where("n = need")
    return met.groupBy("digest").agg(F.collect_set("kind").alias("kinds"))


def matches(text: Column, rule: SecretRule) -> Column:
    """The counting matches of a rule: array of (start, end, kind) in code points, leftmost first, not overlapping."""
    whole, between = F.regexp_extract_all(text, F.lit(rule.java), F.lit(0)), F.split(text, rule.java)
    measured = whole if rule.group == 0 else F.regexp_extract_all(text, F.lit(rule.java), F.lit(rule.group))
    state = "struct<at: int, out: array<struct<start: int, end: int, kind: string>>>"
    steps = F.zip_with(F.slice(between, F.lit(1), F.size(whole)), F.arrays_zip(whole.alias("w"), measured.alias("m")), lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m["w"]).alias("width"), (F.length(m["m"]) >= rule.least).alias("counts")))

    def step(acc: Column, m: Column) -> Column:
        start = acc["at"] + m["gap"]
        found = F.array(F.struct(start.alias("start"), (start + m["width"]).alias("end"), F.lit(rule.kind).alias("kind")))
        return F.struct((start + m["width"]).alias("at"), F.when(m["counts"], F.concat(acc["out"], found)).otherwise(acc["out"]).alias("out")).cast(state)

    start = F.struct(F.lit(0).alias("at"), F.array().alias("out")).cast(state)
    return F.aggregate(steps, start, step, lambda acc: acc["out"])


def scanned(df: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """(key, found) of every row: ``found`` has (start, end, kind) of each secret, by start, then in the rules' order.

    Null and empty texts have none. Repeated rows are found alike; a null key passes; other columns are not read.
    Rules without mandatory trigrams scan every text, the others only candidates.
    """
    rows = df.select(F.col(f"`{key}`").alias("k"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    indexed = tuple(r for r in rules if trigram_query(r) != ALL)
    none = F.array().cast("array<struct<start: int, end: int, kind: string>>")
    kinds = F.array().cast("array<string>")
    if indexed:
        named = written(candidates(rows.where("t <> ''"), indexed), "candidates")
        met = rows.withColumn("digest", _digest(F.col("t"))).join(named, "digest", "left").select("k", "t", F.coalesce("kinds", kinds).alias("kinds"))
    else:
        met = rows.withColumn("kinds", kinds)
    found = [F.when(F.array_contains("kinds", r.kind) if r in indexed else F.lit(True), matches(F.col("t"), r)).otherwise(none) for r in rules]
    rank = F.create_map(*(x for n, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(n))))
    spans = F.flatten(F.array(*found))
    keyed = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return met.select("k", keyed.alias("spans")).select(F.col("k").alias(key), F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))).alias("found"))


def joined(found: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
