"""Registered queries of linkage in depth: titles that differ by letters, run disambiguation by every kind of evidence, conflicts, readiness, reconciliation, explanations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions.sequence import sequence_struct
from tallyweave.operators import candidates, compare, rank
from tallyweave.plans import bindings as b
from tallyweave.plans.fields import _RULES, _compared, _pick
from tallyweave.plans.queries import query

# ---- titles that differ by letters: every third title lacks a letter, every third has one twice

_LETTERS = """l AS (SELECT p_partkey AS k, p_brand, CASE p_partkey % 3 WHEN 0 THEN substr(p_name, 1, i - 1) || substr(p_name, i + 1) WHEN 1 THEN substr(p_name, 1, i) || substr(p_name, i) ELSE p_name END AS title FROM (SELECT *, 1 + p_partkey % length(p_name) AS i FROM part)),
a AS (SELECT k, p_brand, trim(regexp_replace(title, '[^a-z0-9]+', ' ', 'g')) AS key FROM l)"""
_GRAMS = "list_distinct(list_transform(range(1, length({0}) + 3), lambda i: substr('  ' || {0} || '  ', i, 3)))"


def _misspelt(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = b.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("source_id"), "p_name", (1 + F.col("p_partkey") % F.length("p_name")).cast("int").alias("i"), (F.col("p_partkey") % 3).alias("m"))
    i, name = F.col("i"), F.col("p_name")
    head, rest = F.substring(name, F.lit(1), i), F.substring(name, i, F.length(name))
    title = F.when(F.col("m") == 0, F.concat(F.substring(name, F.lit(1), i - 1), F.substring(name, i + 1, F.length(name)))).when(F.col("m") == 1, F.concat(head, rest)).otherwise(name)
    return b.part_locals(spark, sf_dir).drop("title").join(p.select("source_id", title.alias("title")), "source_id")


@query(f"""WITH {_LETTERS}, x AS (SELECT DISTINCT key FROM a), y AS (SELECT DISTINCT p_name AS other FROM part), g AS (SELECT key, other, {_GRAMS.format("key")} AS g1, {_GRAMS.format("other")} AS g2 FROM x, y),
near AS (SELECT key, other FROM g WHERE len(list_intersect(g1, g2)) / (len(g1) + len(g2) - len(list_intersect(g1, g2))) >= 0.5),
lone AS (SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.p_name = a.key AND p.p_brand = a.p_brand))
SELECT CAST(lone.k AS VARCHAR) AS source_id, 'work:' || p.p_partkey || ':book_work' AS candidate_key FROM lone JOIN near USING (key) JOIN part p ON p.p_name = near.other AND p.p_brand = lone.p_brand""")
def similar_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs by similar titles and a shared creator, for sources that have no pair by an equal title."""
    ladder, found = candidates.query_ladder(_misspelt(spark, sf_dir)), b.part_candidates(spark, sf_dir)
    exact = candidates.title_links(ladder, found).reached()
    return candidates.similar_pairs(ladder, found, exact).select("source_id", "candidate_key")


@query("""SELECT p_name AS key, '=' || trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g')) AS who, count(*) AS sources, count(*) AS candidates, count(*) * count(*) AS pairs FROM part GROUP BY p_name, p_brand HAVING count(*) * count(*) >= 4""")
def title_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.block_sizes(candidates.query_ladder(b.part_locals(spark, sf_dir)), b.part_candidates(spark, sf_dir), at_least=4)


# ---- runs: every series has three, A, B and C; which of them have a part's issue decides how it is resolved. Every seventh series carries a credit.

_ASKED = """o AS (SELECT p_partkey AS k, p_name || CASE WHEN p_partkey % 7 = 0 THEN ' by Ann Lee' ELSE '' END AS series, p_name FROM part), s AS (SELECT *, max(k) OVER (PARTITION BY series) AS top FROM o)"""


def _asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(local comics, runs, issues)."""
    p = b.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_name")
    k = F.col("k")
    number = sequence_struct(k.cast("string"))
    local = p.select(k.cast("string").alias("source_id"), F.lit("comic").alias("kind"), F.lit("issue").alias("subtype"), F.concat(F.initcap("p_name"), F.when(k % 7 == 0, " by Ann Lee").otherwise("")).alias("series_title"), F.when(k % 5 == 2, "The Long Night").alias("title"), number.alias("sequence"), F.lit(2005).alias("year"), F.lit(None).cast("int").alias("run_start_year"))
    runs = p.select("p_name").distinct().select(F.explode(F.array(*map(F.lit, "ABC"))).alias("r"), "p_name").select(F.concat_ws(":", "p_name", "r").alias("run_id"), F.col("p_name").alias("series_title"), F.lit("comic").alias("provider"), F.lit(2000).alias("run_start_year"), F.lit("House").alias("publisher"))
    held = F.when(k % 5 == 0, F.array(F.lit("A"))).when(k % 5 == 4, F.array().cast("array<string>")).otherwise(F.array(F.lit("A"), F.lit("B")))
    cover = F.when((k % 5 == 1) & (F.col("r") == "B"), "2005-03").otherwise("1990-01")
    title = F.when((k % 5 == 2) & (F.col("r") == "A"), "the long night").otherwise("qqqq")
    issues = p.select("k", "p_name", F.explode(held).alias("r")).select(F.concat_ws(":", "p_name", "r").alias("run_id"), number.alias("sequence"), cover.alias("cover_date"), title.alias("title"))
    return local, runs, issues


@query(f"""WITH {_ASKED} SELECT CAST(k AS VARCHAR) AS source_id, CASE k % 5 WHEN 0 THEN p_name || ':A' WHEN 1 THEN p_name || ':B' WHEN 2 THEN p_name || ':A' WHEN 3 THEN CASE WHEN top <> k AND top % 5 = 0 THEN p_name || ':A' END END AS run_id,
 CASE k % 5 WHEN 0 THEN 'issue in one run' WHEN 1 THEN 'cover year' WHEN 2 THEN 'issue title' WHEN 3 THEN CASE WHEN top <> k AND top % 5 = 0 THEN 'highest issue' ELSE 'ambiguous' END ELSE 'ambiguous' END AS reason FROM s""")
def run_disambiguation(spark: SparkSession, sf_dir: str) -> DataFrame:
    local, runs, issues = _asked(spark, sf_dir)
    return candidates.disambiguate_runs(local, candidates.matching_runs(local, runs), issues, candidates.series_hints(local))


@query(f"""WITH {_ASKED} SELECT CAST(k AS VARCHAR) AS source_id, p_name || ':' || unnest(['A', 'B', 'C']) AS run_id, CAST(3 AS INTEGER) AS n FROM s""")
def aliased_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series with a credit reach their runs by the name in front of it."""
    local, runs, _ = _asked(spark, sf_dir)
    return candidates.matching_runs(local, runs).select("source_id", "run_id", "n")


# ---- conflicts of scored pairs

_COLLECTED = "k % 2 = 1"


@query(f"""{_RULES} SELECT CAST(k AS VARCHAR) AS source_id, CASE WHEN {_COLLECTED} THEN concat_ws('|', CASE WHEN title = -18 THEN 'titles disagree' END, CASE WHEN publisher = -20 THEN 'collection publishers disagree' END,
 CASE edition_qualifier WHEN -30 THEN 'edition qualifier conflicts with provider edition family' WHEN -20 THEN 'distinctive local edition qualifier is absent from provider title' END, CASE WHEN year = -35 THEN 'collection edition years disagree materially' END) ELSE '' END AS material,
 concat_ws('|', CASE WHEN identifier = -100 THEN 'conflicting exact upc identifiers' END, CASE WHEN sequence = -100 THEN 'sequence numbers conflict' END) AS contradictions FROM d""")
def rule_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of ``rule_scores``, their texts compared once per distinct pair."""
    members, scores = _compared(spark, sf_dir, exchange=True)
    told = scores.select("a", "b", F.array_join("material_conflicts", "|").alias("material"), F.array_join("contradictions", "|").alias("contradictions"))
    return members.join(told, ["a", "b"]).select("source_id", "material", "contradictions")


@query("""SELECT p_partkey, NOT (p_partkey % 2 = 0 AND p_partkey % 5 < 3 AND p_size % 3 = 0) AS ready FROM part""")
def planning_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    kind = F.struct(F.when(k % 2 == 0, "comic").otherwise("book").alias("kind"), _pick(k % 5, "issue", "annual", "special", "omnibus", F.lit(None).cast("string")).alias("subtype"))
    rows = b.table(spark, sf_dir, "part").select("p_partkey", kind.alias("l"), F.struct(F.when(F.col("p_size") % 3 > 0, 1999).alias("run_start_year")).alias("c"))
    return rows.select("p_partkey", F.coalesce(compare.planning_ready(), F.lit(True)).alias("ready"))


# ---- reconciliation and explanation: each part as a book and its own catalogue record, altered by its number

_BOOKS = """WITH s AS (SELECT p_partkey AS k, p_name, p_brand, p_size, p_partkey % 7 = 0 AS missing, p_partkey % 2 = 0 AS edition, CASE p_partkey % 5 WHEN 0 THEN 55 WHEN 1 THEN -100 END AS ident, [8, 3, -7][p_partkey % 3 + 1] AS yr FROM part),
t AS (SELECT *, greatest(0.0, least(100.0, 90 + coalesce(ident, 0) + yr)) AS score, coalesce(ident = -100, false) AS hard FROM s),
u AS (SELECT *, CASE WHEN NOT missing AND score >= 80 AND NOT hard THEN 'accepted' ELSE 'unresolved' END AS work_state, CASE WHEN NOT missing AND edition AND coalesce(ident = 55, false) AND score >= 92 THEN 'accepted' ELSE 'unresolved' END AS edition_state FROM t)"""


def _books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked, reconciled pairs; every seventh book has no candidate."""
    local, found = b.part_locals(spark, sf_dir), b.part_candidates(spark, sf_dir)
    k = lambda c: F.col(c).cast("bigint")
    isbn = lambda v: F.array(F.struct(F.lit("ISBN").alias("scheme"), v.alias("value")))
    local = local.withColumn("identifiers", F.when(k("source_id") % 5 < 2, isbn(F.lit("123"))).otherwise(F.col("identifiers")))
    n = k("provider_id")
    date = (F.substring("publication_date", 1, 4).cast("int") + _pick(n % 3, 0, 1, 4)).cast("string")
    found = found.where(n % 7 > 0).withColumn("identifiers", F.when(n % 5 == 0, isbn(F.lit("123"))).when(n % 5 == 1, isbn(F.lit("456"))).otherwise(F.col("identifiers")))
    found = found.withColumn("record_type", F.when(n % 2 == 0, "book_edition").otherwise("book_work")).withColumn("publication_date", date)
    blocked = found.select(F.col("provider_id").alias("source_id"), "candidate_key", F.lit("own").alias("strategy"))
    scores = rank.with_eligibility(rank.ranked(compare.score_pairs(candidates.pairs(local, found, blocked))))
    alone = local.join(blocked, "source_id", "left_anti").select("source_id", F.struct(*local.columns).alias("l"))
    return compare.reconcile(scores.unionByName(alone, allowMissingColumns=True))


@query(f"""{_BOOKS} SELECT CAST(k AS VARCHAR) AS source_id, work_state, edition_state, CASE WHEN missing THEN '' ELSE 'title=' || p_name || ':' || printf('%.2f', 1.0) || '|publication_date=' || (2000 + p_size + [0, 1, 4][k % 3 + 1]) || ':' || printf('%.2f', least(score / 100, 0.85)) END AS fields,
 concat_ws('|', CASE WHEN missing THEN 'no external candidate' END, CASE WHEN NOT missing AND work_state = 'accepted' AND edition_state = 'unresolved' THEN 'work identity is strong but no exact edition identifier resolves the edition' END, CASE WHEN NOT missing AND hard THEN 'conflicting exact isbn identifiers' END) AS reasons FROM u""")
def reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = F.transform("reconciliation.fields", lambda x: F.concat(x["field"], F.lit("="), x["value"], F.lit(":"), F.format_number(x["confidence"], 2)))
    return _books(spark, sf_dir).select("source_id", "reconciliation.work_state", "reconciliation.edition_state", F.array_join(fields, "|").alias("fields"), F.array_join("reconciliation.reasons", "|").alias("reasons"))


@query(f"""{_BOOKS} SELECT CAST(k AS VARCHAR) AS source_id, concat_ws('|', 'Candidate work:' || k || ':book_work: score ' || printf('%.1f', score), 'Classification confidence: 0.98', 'Runner-up margin: ' || printf('%.1f', score),
 CASE ident WHEN 55 THEN 'identifier: exact (+55.0) - exact isbn identifier' WHEN -100 THEN 'identifier: hard_contradiction (-100.0) - conflicting exact isbn identifiers' END, 'title: exact (+32.0) - normalized titles agree', 'creators: exact (+18.0) - creator names overlap',
 CASE yr WHEN 8 THEN 'year: exact (+8.0) - years agree' WHEN 3 THEN 'year: supporting (+3.0) - years differ by one' ELSE 'year: conflict (-7.0) - years disagree' END, CASE WHEN hard THEN 'CONTRADICTION: conflicting exact isbn identifiers' END,
 'Eligible for explicit acceptance: ' || CASE WHEN score >= 92 AND NOT hard THEN 'yes' ELSE 'no' END) AS lines FROM u WHERE NOT missing""")
def explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _books(spark, sf_dir).where("c is not null").select("source_id", F.array_join(compare.explanation(), "|").alias("lines"))
