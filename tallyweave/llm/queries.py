"""The registered queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm import bpe, chat, linededup, media, mixing, periodic, quadratic, quality, secrets, simhash, substrings, tokencount, whitening
from tallyweave.llm.shared import table, written


def vocabulary_path(name: str) -> str:
    """Where a public vocabulary file lies; its text is broadcast from the driver."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pictures = media.stored(docs, "text", "media").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "media")
    f = media.media_features(pictures, "media", "f").select("doc_id", "n_bytes", "f.*")
    feature = F.format_string("jpeg:%dx%d:%s:%s", "width", "height", "average_hash", "difference_hash")
    return f.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"), "width", "height", "error")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.deduplicated(docs, "doc_id", "text", spans="removed")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scanned(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda s: s["kind"].isin(*(r.kind for r in secrets.BASE)))
    return found.select("doc_id", *(count(r.kind) for r in secrets.BASE), F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("found")).alias("spans"))


def op4_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotated(table(spark, sf_dir, "conversations"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = bpe.encoding_digests(docs, vocabulary_path("word_bpe_49k.json"), "text", "encoding")
    return got.select("doc_id", "encoding.n_tokens", "encoding.ids_sha256", "encoding.decoded_sha256")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n_bytes = F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes")
    got = tokencount.with_token_counts(docs, vocabulary_path("byte_bpe_50k.json"), "text", "n_tokens")
    return got.select("doc_id", n_bytes, "n_tokens", (F.col("n_tokens") > tokencount.LIMIT).alias("over_limit"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", linededup.host_of(F.col("url")).alias("host"), linededup.visible_lines(F.col("html")).alias("text"))
    pages = written(pages, "visible")  # the lines of a page are made once
    return linededup.deduplicated(pages, F.col("host"), "text", normalised=True)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), rule=simhash.CONTRACT, shingle_words=4)


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quadratic.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text, where every tenth text (by the CRC-32 h of its decimal doc_id) goes on with a period.

    With g = floor(h / 10), n words and a = g mod n, each word i >= a becomes the word a + (i - a) mod p, p = 1 + floor((n - a) / (3 + g mod 8)).
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    few = docs.select("doc_id", "text", F.when(h % 10 == 0, quality.words_of(F.col("text"))).alias("w"), F.floor(h / 10).cast("long").alias("g"))
    n = F.size("w")
    few = few.withColumn("a", F.when(n > 0, (F.col("g") % n).cast("int")))
    few = few.withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    tail = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil((n - F.col("a")) / F.col("p")).cast("int")))
    whole = F.concat(F.slice("w", F.lit(1), F.col("a")), F.slice(tail, F.lit(1), n - F.col("a")))
    return few.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(whole, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_periodic_tails(table(spark, sf_dir, "documents").select("doc_id", "text"))
    got = periodic.with_runs(docs, "text", "r", spans=False)
    exponent = F.floor(1000 * F.col("r.length") / F.col("r.period")).cast("long").alias("exponent_milli")
    return got.select("doc_id", "r.n_runs", "r.start", "r.length", "r.period", exponent, "r.runs_sha256", "r.collapsed_sha256")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_media, op2_substring_dedup, op3_secrets, op4_perspectives, op5_bpe, op6_quality_rules, op7_mixing, op8_token_counts, op9_line_dedup, op10_simhash, op11_quality_classifier, op12_whitening, op13_periodic_runs, pipeline)}



def _secrets_sql() -> str:
    """Places of matches from the lengths of the matches and of what stands between them."""
    found = []
    for place, r in enumerate(secrets.RULES):
        pattern = "'" + r.java.replace("'", "''") + "'"
        found.append(f"SELECT doc_id, {place} AS place, '{r.kind}' AS kind, regexp_extract_all(t, {pattern}, 0) AS w, string_split_regex(t, {pattern}) AS g, regexp_extract_all(t, {pattern}, {r.group}) AS m, {r.least} AS least FROM d")
    base = ", ".join(f"'{r.kind}'" for r in secrets.BASE)
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in secrets.BASE)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({" UNION ALL ".join(found)}), i AS (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM f),
s AS (SELECT doc_id, place, kind, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a, length(w[i]) AS n FROM i WHERE length(m[i]) >= least),
x AS (SELECT doc_id, {counts}, sha256(coalesce(string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, place) FILTER (kind IN ({base})), '')) AS base_sha256, string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, place) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secrets.BASE)}, coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN x USING (doc_id)"""


_WS = r"[ \t-\r]"

ORACLE_SQL: dict[str, str] = {
    "op3_secrets": _secrets_sql(),
    "op4_perspectives": rf"""
WITH e AS (SELECT conv_id, turn, trim(role, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS role, regexp_replace(coalesce(text, ''), '{chat.MARKS}', '< |\1|>', 'g') AS text FROM conversations),
t AS (SELECT conv_id, turn, CASE WHEN coalesce(role, '') = '' THEN 'unknown' ELSE regexp_replace(regexp_replace(role, '{_WS}+', '_', 'g'), '{chat.MARKS}', '< |\1|>', 'g') END AS speaker, text FROM e),
s AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
r AS (SELECT t.*, perspective, CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user' END AS as_role FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
g AS (SELECT *, '<|im_start|>' || as_role || CASE WHEN as_role = 'user' THEN ' name=' || speaker ELSE '' END || chr(10) AS head FROM r),
q AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS segment FROM g),
p AS (SELECT *, row_number() OVER w - 1 AS position, CAST(coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST, speaker, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS segment_start FROM q WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST, speaker, text))
SELECT conv_id, perspective, position, turn, speaker, as_role, segment, segment_start, CASE WHEN as_role = 'assistant' THEN segment_start + length(head) END AS mask_start, CASE WHEN as_role = 'assistant' THEN segment_start + length(segment) END AS mask_end FROM p""",
    "op7_mixing": rf"""
WITH d0 AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+')) AS BIGINT) AS size FROM documents),
d AS (SELECT *, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || size) AS digest FROM d0),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n, sum(source_size) OVER () AS total FROM s0),
s2 AS (SELECT *, CAST(n % 3 + 1 AS DOUBLE) AS weight, source_size * 3.0::DOUBLE AS cap FROM s1),
s3 AS (SELECT *, CAST(total AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY cap / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining, sum(weight) OVER (ORDER BY cap / weight, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM s2),
lv AS (SELECT arg_min(remaining, cap / weight) AS remaining, arg_min(weights, cap / weight) AS weights FROM s3 WHERE remaining * weight / weights <= cap),
s AS (SELECT s2.*, least(coalesce(lv.remaining * weight / lv.weights, cap), cap) AS target FROM s2, lv),
tt AS (SELECT greatest({mixing.BLOCK_WORDS}, CAST(ceil(sum(target) / {mixing.MOST_BLOCKS}) AS BIGINT)) AS general FROM s),
bl AS (SELECT s.*, greatest(1, CAST(ceil(source_size / CASE WHEN source_size <= {mixing.TINY_WORDS} THEN 1 ELSE least(general, greatest(1, source_size // {mixing.LEAST_BLOCKS})) END) AS BIGINT)) AS blocks FROM s, tt),
q AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target * blocks / source_size + 0.5) AS BIGINT) ELSE 0 END AS quota, source_size % blocks AS longer, source_size // blocks AS short FROM bl),
laid AS (SELECT doc_id, size, q.*, CAST(coalesce(sum(size) OVER (PARTITION BY n ORDER BY digest, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source WHERE size > 0),
ends AS (SELECT *, CASE WHEN start < longer * (short + 1) THEN start // (short + 1) ELSE longer + (start - longer * (short + 1)) // short END AS lo, start + size - 1 AS e FROM laid),
pieces AS (SELECT *, unnest(range(lo, CASE WHEN e < longer * (short + 1) THEN e // (short + 1) ELSE longer + (e - longer * (short + 1)) // short END + 1)) AS block FROM ends)
SELECT doc_id, size, source_size, target, CAST(sum((least((block + 1) * short + least(block + 1, longer), start + size) - greatest(block * short + least(block, longer), start)) * (quota // blocks + CAST(block < quota % blocks AS INT))) AS BIGINT) AS taken FROM pieces GROUP BY doc_id, size, source_size, target, start, n
UNION ALL SELECT doc_id, size, s.source_size, target, 0 FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source WHERE size = 0""",
    "op9_line_dedup": rf"""
WITH h AS (SELECT page_id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '') AS host,
 list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(html, '{linededup.HIDDEN}', '', 'g'), '{linededup.BREAKS}', chr(10), 'g'), '<[^<>]*>', '', 'g'), chr(10)), lambda x: regexp_replace(trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_WS}+', ' ', 'g')), lambda x: x <> '') AS lines FROM pages),
tot AS (SELECT host, count(*) AS p FROM h GROUP BY host), l AS (SELECT host, unnest(list_distinct(lines)) AS line FROM h),
n AS (SELECT host, line, count(*) AS n FROM l GROUP BY ALL), c AS (SELECT n.host, list(line) AS gone FROM n JOIN tot ON n.host IS NOT DISTINCT FROM tot.host WHERE n >= {linededup.MIN_PAGES} AND n > {linededup.RATIO} * p GROUP BY n.host)
SELECT page_id, h.host, array_to_string(list_filter(lines, lambda x: NOT list_contains(coalesce(gone, []), x)), chr(10)) AS text, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(list_filter(lines, lambda x: list_contains(coalesce(gone, []), x))) AS BIGINT) AS n_dropped FROM h LEFT JOIN c ON h.host IS NOT DISTINCT FROM c.host""",
}
