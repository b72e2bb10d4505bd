"""The registered queries of this subpackage, with DuckDB text where SQL can say them."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from . import decontaminate, language, mixing, negatives, quality, resampling, secrets, set_join, sharding, simhash, substrings, url_filter, warc
from .common import table, word_count

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

MIX_SEED = 7
SHARD_SEED = 11
SHARDS = 40


def query(name: str, sql: str | None = None):
    def register(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return fn

    return register


_DUCK_WORDS = r"len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))"


@query(
    "op5_mix_sources",
    rf"""
WITH d AS (SELECT doc_id, source, coalesce({_DUCK_WORDS}, 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w, 3 * source_size AS cap FROM s),
o AS (
  SELECT *, row_number() OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST) AS i FROM w),
f AS (
  SELECT *, (SELECT sum(source_size) FROM s)::BIGINT - coalesce(sum(cap) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS rest,
         sum(w) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS open FROM o),
c AS (SELECT *, cap::HUGEINT * open <= rest::HUGEINT * w AS capped FROM f),
l AS (SELECT arg_min(rest, i) AS rest, arg_min(open, i) AS open FROM c WHERE NOT capped),
t AS (
  SELECT c.source, c.source_size, CASE WHEN capped THEN cap::DOUBLE ELSE l.rest::DOUBLE * w / l.open END AS target,
         ('0x' || substr(sha256('{MIX_SEED}:' || coalesce('s' || c.source, 'n')), 1, 12))::BIGINT % 1000000000 AS start
  FROM c LEFT JOIN l ON true),
e AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS each_d FROM t),
p AS (
  SELECT d.doc_id, d.size, e.source_size, e.target, start::DECIMAL(38,0) * 1000 AS start12,
         CAST(CAST(each_d AS DECIMAL(14,12)) * 1000000000000 AS DECIMAL(38,0)) AS each12,
         row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) - 1 AS place
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source),
h AS (
  SELECT *, (start12::HUGEINT + each12::HUGEINT * (place + 1)) // 1000000000000 - (start12::HUGEINT + each12::HUGEINT * place) // 1000000000000 AS copies FROM p)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken FROM h
""",
)
def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("words"))
    out = mixing.mix(docs, MIX_SEED, prefix="", size=F.col("words"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def _crc_table() -> str:
    """The 16 remainders of half a byte."""
    out = []
    for c in range(16):
        for _ in range(4):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        out.append(str(c))
    return f"([{', '.join(out)}]::BIGINT[])"


def _crc_half(c: str) -> str:
    return f"xor({c} >> 4, {_crc_table()}[({c} & 15) + 1])"


def _feistel_sql(source: str) -> str:
    """``source`` (place, p, k) with p permuted once over the grid ``g`` (n, a, b)."""
    text = f"SELECT place, k, n, a, b, p // b AS l, p % b AS r FROM {source}, g"
    for i in range(sharding.ROUNDS):
        half, other, size = ("l", "r", "a") if i % 2 == 0 else ("r", "l", "b")
        digest = f"('0x' || substr(md5('{SHARD_SEED}:{i}:' || {other}), 1, 8))::BIGINT"
        text = f"SELECT place, k, n, a, b, ({half} + {digest}) % {size} AS {half}, {other} FROM ({text})"
    return f"SELECT place, l * b + r AS p, k + 1 AS k, n FROM ({text})"


@query(
    "op8_feistel_shards",
    f"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id NULLS FIRST) - 1 AS place FROM documents),
h AS (SELECT place, hex(encode(text)) AS h FROM t),
y AS (SELECT place, list_transform(range(1, strlen(h) + 1, 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT) AS bytes FROM h),
c AS (
  SELECT place, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, x: {_crc_half(_crc_half('xor(c, x)'))}), 4294967295) AS crc FROM y),
g AS (SELECT n, a, greatest(1, (n + a - 1) // a) AS b FROM (SELECT count(*) AS n, floor(sqrt(greatest(count(*) - 1, 0)))::BIGINT + 1 AS a FROM t)),
w AS (
  SELECT place, p, k, n FROM ({_feistel_sql('(SELECT place, place AS p, 0 AS k FROM t)')})
  UNION ALL
  SELECT place, p, k, n FROM ({_feistel_sql('(SELECT place, p, k FROM w WHERE p >= n)')}))
SELECT doc_id, strlen(text)::BIGINT + 16 AS size, crc AS text_crc32, 'rows' AS law, (p % {SHARDS})::INTEGER AS shard,
       p // {SHARDS} AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM t JOIN c USING (place) JOIN (SELECT place, p FROM w WHERE p < n) q USING (place)
""",
)
def op8_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + F.lit(16)).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    return sharding.shard(docs, SHARDS, SHARD_SEED).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query("op4_quality_rules")
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: A site is listed if its own label has one of these words between hyphens.
SPAM_WORDS = ("casino", "bets", "pills")
_SPAM = rf"(^|-)({'|'.join(SPAM_WORDS)})(-|$)"


@query(
    "op10_url_cascade",
    rf"""
WITH r AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
q AS (
  SELECT *, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
                 WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
                 WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
                 WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM p),
l AS (
  SELECT DISTINCT array_to_string(list_slice(string_split(host, '.'), greatest(len(string_split(host, '.')) - 2, 1), len(string_split(host, '.'))), '.') AS site FROM p),
b AS (SELECT site FROM l WHERE regexp_matches(string_split(site, '.')[1], '{_SPAM}'))
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN EXISTS (SELECT 1 FROM b WHERE host = site OR ends_with(host, '.' || site)) THEN 'block' ELSE 'allow' END AS verdict
FROM q
""",
)
def op10_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = F.split(url_filter.url_parts(F.col("url"))[0], r"\.")
    site = F.slice(labels, F.greatest(F.size(labels) - 2, F.lit(1)), F.lit(3))
    listed = pages.where(F.element_at(site, 1).rlike(_SPAM)).select(F.array_join(site, ".").alias("key"))
    return url_filter.judge(pages, URL_RULES, listed).select("page_id", "host", "path", "rule", "verdict")


_FOLDED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BENCH_WORDS = rf"coalesce(regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"


@query(
    "op2_decontaminate",
    rf"""
WITH i AS (SELECT item_id, {_BENCH_WORDS} AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(list_slice(w, p, p + least(len(w), 13) - 1), ' ') AS win
  FROM i, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS u(p) WHERE len(w) > 0),
d AS (SELECT doc_id, {_BENCH_WORDS} AS w FROM documents),
dw AS (
  SELECT doc_id, l.n, p, array_to_string(list_slice(w, p, p + l.n - 1), ' ') AS win
  FROM d, (SELECT DISTINCT n FROM iw) l, unnest(range(1, len(w) - l.n + 2)) AS u(p)),
h AS (SELECT dw.doc_id, dw.p, dw.n, iw.item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.win = iw.win),
hw AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT doc_id, p, n FROM h) x, unnest(range(p, p + n)) AS u(q) GROUP BY doc_id),
hi AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM h) y GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
""",
)
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join("items", ","), 256)
    return out.select("doc_id", "n_words", "n_hit", "n_items", items.alias("items_sha256"), "contaminated")


@query("op9_linked_secrets")
def op9_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE_KINDS))
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in secrets.BASE_KINDS], F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans")
    )


@query(
    "op3_warc_index",
    """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT *, strlen(html)::BIGINT AS payload_bytes, max(page_id) OVER (PARTITION BY html) AS original FROM p)
SELECT page_id, payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> original THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> original THEN original END AS refers_to
FROM g
""",
)
def op3_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    parts, index, archives = warc.archive(pages)
    keys = pages.select(warc.capture_key(F.col("url"), F.col("page_id")).alias("key"))
    found = warc.lookup(keys, parts, index, archives, payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op6_simhash_balls")
def op6_simhash_balls(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op1_language_gru")
def op1_language_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language.predict(docs, language.fit(docs))
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query(
    "op7_recompressed_repeats",
    r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
x AS (SELECT doc_id, p, array_to_string(list_slice(w, p, p + 19), ' ') AS win FROM d, unnest(range(1, len(w) - 18)) AS u(p)),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY win ORDER BY doc_id, p) AS nth FROM x),
g AS (SELECT DISTINCT doc_id, i FROM r, unnest(range(p, p + 20)) AS u(i) WHERE nth > 1),
v AS (SELECT doc_id, w[i] AS word, i FROM d, unnest(range(1, len(w) + 1)) AS u(i)),
k AS (
  SELECT v.doc_id, count(g.i) AS gone, string_agg(word, ' ' ORDER BY v.i) FILTER (WHERE g.i IS NULL) AS kept
  FROM v LEFT JOIN g ON v.doc_id = g.doc_id AND v.i = g.i GROUP BY v.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
""",
)
def op7_recompressed_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def _resample_features(name: str) -> str:
    return f"""SELECT {name}_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM {name}"""


@query(
    "op13_resample_target",
    rf"""
WITH doc AS (SELECT doc_id, {_BENCH_WORDS} AS w FROM documents),
item AS (SELECT item_id, {_BENCH_WORDS} AS w FROM benchmark),
df AS (SELECT doc_id, f, count(*) AS n FROM ({_resample_features('doc')}) GROUP BY 1, 2),
tf AS (SELECT f, count(*) AS n FROM ({_resample_features('item')}) GROUP BY 1),
u AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM df UNION SELECT f FROM tf)),
y AS (SELECT f, list_transform(range(1, strlen(h) + 1, 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT) AS bytes FROM u),
c AS MATERIALIZED (
  SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, x: {_crc_half(_crc_half('xor(c, x)'))}), 4294967295) % 10000 AS b FROM y),
n AS (
  SELECT b, coalesce(sum(s), 0)::DOUBLE AS s, coalesce(sum(t), 0)::DOUBLE AS t
  FROM (SELECT f, sum(n) AS s, NULL AS t FROM df GROUP BY 1 UNION ALL SELECT f, NULL, n FROM tf) JOIN c USING (f) GROUP BY 1),
g AS (
  SELECT b, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM n) + 10000) / ((s + 1) * ((SELECT sum(t) FROM n) + 10000))))::BIGINT AS gain FROM n),
w AS (SELECT doc_id, sum(df.n)::BIGINT AS n_features, floor(sum(df.n * gain) / sum(df.n)::DOUBLE)::BIGINT AS weight FROM df JOIN c USING (f) JOIN g USING (b) GROUP BY 1),
h AS (SELECT doc_id, len(w) AS n_words, ('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT AS h FROM doc),
s AS (
  SELECT doc_id, n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         (coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))))::BIGINT AS score
  FROM h LEFT JOIN w USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM s WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) FROM r) * 25 // 100 THEN rank END AS rank FROM s LEFT JOIN r USING (doc_id)
""",
)
def op13_resample_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return resampling.resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


@query(
    "op12_hard_negatives",
    """
WITH e AS MATERIALIZED (
  SELECT DISTINCT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, e.vec_id AS other, a.label = e.label AS same, list_inner_product(a.v, e.v)::BIGINT AS score
  FROM e a JOIN e ON a.vec_id % 100 = 0 AND a.vec_id <> e.vec_id),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) AS nth FROM s WHERE same) WHERE nth <= 5),
n AS (
  SELECT p.anchor_id, p.other AS positive_id, s.other AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.other ORDER BY s.score DESC, s.other)::INTEGER AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
""",
)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


@query("op11_parity_join")
def op11_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.linked_sets(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
