"""The corpus operators as registered queries: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.llm import bytebpe, centroids, contamination, dartminhash, language, lineruns, prefixtrie, quality, secrets, substrings, toxicity, urls, wavelet
from kerbside.llm.common import new_path, stage

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), RANKS, public_tokenizers.PATTERN)
    spans = F.col("secret_spans")
    of = lambda kind: F.filter(spans, lambda s: s["kind"] == kind)
    digest = lambda some: F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return scanned.select(
        "doc_id",
        *(F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in secrets.KINDS),
        F.sha2(digest(F.filter(spans, lambda s: s["kind"] != "random")), 256).alias("base_sha256"),
        digest(spans).alias("spans"),
    )


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    rates = [F.round(f"rate_{r}", 6).alias(f"rate_{r}") for r in quality.RULES]
    return judged.select("doc_id", *quality.MEASURES, "base_failed", "kept", *rates, "host_rule")


def _rate_sql(rule: str) -> str:
    """The shrunk rate of a rule, and the limit beyond which it rejects a host."""
    m, v = f"m_{rule}", f"v_{rule}"
    weight = f"greatest(4, coalesce({m} * (1 - {m}) / nullif({v}, 0) - 1, 1e12))"
    return f"(f_{rule} + {m} * {weight}) / (n + {weight}) AS rate_{rule}, CASE WHEN {v} > 0 THEN least(0.5, greatest(0.25, {m} + 2 * sqrt({v}))) END AS limit_{rule}"


def _prior_sql(rule: str) -> str:
    m = f"(sum(f_{rule}) / sum(n))"
    return f"{m} AS m_{rule}, greatest(0, coalesce((sum(f_{rule} * f_{rule} / n) - sum(n) * {m} * {m} - (count(*) - 1) * {m} * (1 - {m})) / nullif(sum(n) - count(*), 0), 0)) AS v_{rule}"


OP2_SQL = f"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
k AS (SELECT row_number() OVER () AS r, * FROM w),
g AS (SELECT r, unnest(range(1, len(ws) - 3)) AS k, ws FROM k WHERE len(ws) >= 5),
s AS (SELECT r, k, array_to_string(list_slice(ws, k, k + 4), ' ') AS five FROM g),
d AS (SELECT r, k FROM (SELECT r, k, count(*) OVER (PARTITION BY r, five) AS c FROM s) WHERE c > 1),
p AS (SELECT r, count(DISTINCT i) AS n_repeat_words FROM (SELECT r, unnest(range(k, k + 5)) AS i FROM d) GROUP BY r),
x AS (SELECT doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda a: length(a))), 0) AS BIGINT) AS word_chars,
 CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, list_filter(string_split(t, chr(10)), lambda a: regexp_matches(a, '[^\\x20\\x09-\\x0D]')) AS ls, coalesce(n_repeat_words, 0) AS n_repeat_words FROM k LEFT JOIN p USING (r)),
m AS (SELECT * EXCLUDE ls, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines FROM x),
f AS (SELECT *, n_words < 10 AS short, 100 * n_repeat_words > 20 * n_words AS repeated, 10 * n_symbols > n_words AS symbols, 10 * n_dup_lines > n_words AS lines FROM m),
h AS (SELECT source, CAST(count(*) AS DOUBLE) AS n, {", ".join(f"CAST(count(*) FILTER ({r}) AS DOUBLE) AS f_{r}" for r in quality.RULES)} FROM f WHERE source IS NOT NULL GROUP BY source),
q AS (SELECT {", ".join(map(_prior_sql, quality.RULES))} FROM h),
j AS (SELECT source, {", ".join(map(_rate_sql, quality.RULES))} FROM h, q),
v AS (SELECT *, CASE {" ".join(f"WHEN rate_{r} > limit_{r} THEN '{r}'" for r in quality.RULES)} END AS host_rule FROM j)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repeated AS base_failed, NOT (short OR repeated) AND host_rule IS NULL AS kept, {", ".join(f"round(rate_{r}, 6) AS rate_{r}" for r in quality.RULES)}, host_rule
FROM f LEFT JOIN v USING (source)
"""


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP4_SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
bn AS (SELECT item_id, ws, least(len(ws), 13) AS n FROM b WHERE len(ws) > 0),
bk AS (SELECT item_id, n, ws, unnest(range(1, len(ws) - n + 2)) AS k FROM bn),
iw AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(ws, k, k + n - 1), ' ') AS win FROM bk),
sizes AS (SELECT DISTINCT n FROM iw),
dk AS (SELECT doc_id, n, ws, unnest(range(1, len(ws) - n + 2)) AS k FROM w, sizes WHERE len(ws) >= n),
dw AS (SELECT doc_id, n, k, array_to_string(list_slice(ws, k, k + n - 1), ' ') AS win FROM dk),
m AS (SELECT doc_id, k, n, item_id FROM dw JOIN iw USING (n, win)),
mk AS (SELECT DISTINCT doc_id, k, n FROM m),
mu AS (SELECT doc_id, unnest(range(k, k + n)) AS i FROM mk),
hits AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM mu GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS l FROM m GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(l, '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)
"""


def op5_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    wavelet.write_shards(table(spark, sf_dir, "documents"), path, WORD_VOCABULARY, END_ID)
    documents = wavelet.read_documents(wavelet.read_shards(spark, path))
    return documents.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_dartminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dartminhash.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages have no fetch times and no list comes with them, so both are made from the table: page
    k is fetched 7919 k minutes into 2024 (modulo a year), and every host and parent domain of the
    pages gets dated entries by the digits of its MD5 sum."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_at", F.timestamp_seconds(F.lit(1704067200) + F.col("page_id") * 7919 % 525600 * 60))
    names = pages.select(F.explode(urls.parents(urls.host_of(F.col("url")))).alias("name")).distinct().where(F.contains(F.col("name"), F.lit(".")))
    digit = lambda k: F.conv(F.substring(F.md5("name"), k, 2), 16, 10).cast("int")
    day = lambda n: F.timestamp_seconds(F.lit(1704067200) + n * 86400)
    dated = F.array(*(F.struct(F.when(digit(2 * k + 1) % 3 == 0, "block").otherwise("allow").alias("action"), day(digit(2 * k + 1) + 100 * k).alias("listed_at")) for k in range(3)))
    entries = names.select("name", F.explode(dated).alias("e")).select("name", "e.*")
    return urls.judge(captures, entries)


OP7_SQL = """
WITH c AS (SELECT page_id, url, TIMESTAMP '2024-01-01' + to_minutes(page_id * 7919 % 525600) AS fetched_at,
 nullif(rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?(\\[[^]/?#@]*\\]|[^/?#:@]*)', 1)), '.'), '') AS host FROM pages),
h AS (SELECT DISTINCT host, CASE WHEN regexp_matches(host, '^(\\[.*|[0-9]+([.][0-9]+){3})$') THEN [host] ELSE string_split(host, '.') END AS l FROM c WHERE host IS NOT NULL),
s AS (SELECT host, array_to_string(list_slice(l, k, len(l)), '.') AS name FROM (SELECT host, l, unnest(range(1, len(l) + 1)) AS k FROM h)),
n AS (SELECT DISTINCT name FROM s WHERE contains(name, '.')),
d AS (SELECT name, k, CAST('0x' || substr(md5(name), 2 * k + 1, 2) AS INT) AS v FROM n, (SELECT unnest(range(0, 3)) AS k)),
e AS (SELECT name, TIMESTAMP '2024-01-01' + to_days(CAST(v + 100 * k AS INT)) AS valid_from, max(CASE WHEN v % 3 = 0 THEN 'block' ELSE 'allow' END) AS action FROM d GROUP BY 1, 2),
i AS (SELECT *, lead(valid_from) OVER (PARTITION BY name ORDER BY valid_from) AS valid_to FROM e),
m AS (SELECT page_id, url, fetched_at, i.name AS entry, action, valid_from, row_number() OVER (PARTITION BY page_id, url ORDER BY length(i.name) DESC) AS r
 FROM c JOIN s USING (host) JOIN i ON i.name = s.name AND fetched_at >= valid_from AND (valid_to IS NULL OR fetched_at < valid_to))
SELECT c.page_id, c.url, c.fetched_at, c.host, entry, action, valid_from, coalesce(action <> 'block', true) AS kept
FROM c LEFT JOIN m ON m.page_id = c.page_id AND m.url = c.url AND r = 1
"""


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = language.train(documents.where(~held_out))
    return language.predict(documents.select("doc_id", held_out.alias("held_out"), "text"), model)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(documents, toxic_chain(spark, documents, sf_dir), keep=["doc_id"]).select("doc_id", "p_low_quality", "p_toxic", F.col("is_toxic").alias("toxic"))


def toxic_chain(spark: SparkSession, documents: DataFrame, sf_dir: str) -> toxicity.Chain:
    """The chain over the label columns there are: low quality, then toxic."""
    labels = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    return toxicity.train(documents, labels, ["low_quality", "toxic"])


def op10_bytebpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bytebpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), RANKS, with_bytes=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


#: Batches that the documents' files are added in.
BATCHES = 8


def op11_lineruns(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    runs = lineruns.LineRuns(spark, least=10)
    for k, batch in enumerate(lineruns.file_batches(documents, BATCHES)):
        runs.add(batch, k)
    kept = lineruns.drop_common(documents, stage(runs.settled(), "settled"))
    runs.drop()
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP11_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS k FROM d),
t AS (SELECT r, k, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key FROM t WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10),
s AS (SELECT r, count(*) FILTER (c.key IS NOT NULL) AS n_dropped, string_agg(line, chr(10) ORDER BY k) FILTER (c.key IS NULL) AS kept FROM t LEFT JOIN c USING (key) GROUP BY r)
SELECT doc_id, CAST(len(ls) AS BIGINT) AS n_lines, n_dropped, sha256(coalesce(kept, '')) AS kept_sha256 FROM d JOIN s USING (r)
"""


def op12_drake(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), k=CENTROIDS, rounds=ROUNDS)[0]


CENTROIDS, ROUNDS = 40, 5
_SQUARE = "list_sum(list_transform(list_zip(v, q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


def _round_sql(n: int) -> str:
    """Assignment n to the centroids c{n}; but for the last, their means are c{n + 1}."""
    found = f"a{n} AS (SELECT r, vec_id, v, i, q, s FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY s, i) AS o FROM (SELECT r, vec_id, v, i, q, {_SQUARE} AS s FROM k, c{n})) WHERE o = 1)"
    if n == ROUNDS:
        return found
    mean = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"
    sums = f"u{n} AS (SELECT i, d, CAST(sum(v[d]) AS BIGINT) AS s, count(*) AS n FROM a{n}, (SELECT unnest(range(1, 65)) AS d) GROUP BY i, d)"
    means = f"m{n} AS (SELECT i, list({mean} ORDER BY d) AS q FROM u{n} GROUP BY i)"
    return f"{found}, {sums}, {means}, c{n + 1} AS (SELECT i, coalesce(m{n}.q, c{n}.q) AS q FROM c{n} LEFT JOIN m{n} USING (i))"


OP12_SQL = f"""
WITH k AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
 WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS i, v AS q FROM (SELECT v, sha256('2:' || CAST(vec_id AS VARCHAR)) AS h FROM k ORDER BY h, v LIMIT {CENTROIDS})),
{", ".join(_round_sql(n) for n in range(ROUNDS + 1))}
SELECT vec_id, CAST(i AS INTEGER) AS cluster, CAST(s AS BIGINT) AS distance, CAST(sum(s) OVER (PARTITION BY i) AS BIGINT) AS cluster_inertia, CAST(sum(s) OVER () AS BIGINT) AS inertia, sha256(array_to_string(q, ',')) AS centroid_sha256
FROM a{ROUNDS}
"""


def op13_prefixtrie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.trie(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


OP13_SQL = """
WITH t AS (SELECT conv_id AS c, x, w, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, x) AS r FROM (SELECT conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS x,
 len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w FROM conversations WHERE conv_id IS NOT NULL)),
i AS (SELECT DISTINCT c, [4294967295] || list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: ascii(s)) AS b FROM t),
g AS (SELECT c, c - c % 20 AS donor, xor(list_reduce(b, lambda a, y: list_reduce([xor(a, y), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) % 4 AS h FROM i),
f AS (SELECT g.c, t.r AS d, x, w FROM g JOIN t ON t.c = g.donor AND t.r <= h),
n AS (SELECT g.c, h, count(d) AS d0 FROM g LEFT JOIN f USING (c) GROUP BY ALL),
p AS (SELECT c, 0 AS d, '' AS x, 0 AS w FROM g UNION ALL SELECT * FROM f UNION ALL SELECT c, d0 + t.r - h, x, w FROM n JOIN t USING (c) WHERE t.r > h),
k AS (SELECT c, d, w, sha256(string_agg(x, '') OVER (PARTITION BY c ORDER BY d)) AS key FROM p),
q AS (SELECT *, lag(key) OVER (PARTITION BY c ORDER BY d) AS parent, lead(d) OVER (PARTITION BY c ORDER BY d) IS NULL AS ends FROM k),
m AS (SELECT d, key, min(c) AS conv_id, any_value(parent) AS parent, any_value(w) AS w, count(*) AS n_convs, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '') AS ids FROM q GROUP BY d, key),
ch AS (SELECT d - 1 AS d, parent AS key, count(*) AS n FROM m WHERE parent IS NOT NULL GROUP BY ALL),
o AS (SELECT m.*, coalesce(ch.n, 0) AS n_children FROM m LEFT JOIN ch USING (d, key)),
s AS (SELECT q.d, q.key, count(*) FILTER (o.n_children = 0) AS n_leaves, sum((o.n_convs - 1) * o.w) AS saved FROM o JOIN q ON q.c = o.conv_id AND q.d <= o.d GROUP BY ALL)
SELECT o.conv_id, CAST(o.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, o.n_convs, o.n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(o.ids) AS ends_sha256
FROM o JOIN s USING (d, key) LEFT JOIN m u ON u.d = o.d - 1 AND u.key = o.parent
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_quality": op2_quality,
    "op3_substrings": op3_substrings,
    "op4_decontamination": op4_decontamination,
    "op5_wavelet": op5_wavelet,
    "op6_dartminhash": op6_dartminhash,
    "op7_urls": op7_urls,
    "op8_language": op8_language,
    "op9_toxicity": op9_toxicity,
    "op10_bytebpe": op10_bytebpe,
    "op11_lineruns": op11_lineruns,
    "op12_drake": op12_drake,
    "op13_prefixtrie": op13_prefixtrie,
}
ORACLES: dict[str, str] = {"op2_quality": OP2_SQL, "op4_decontamination": OP4_SQL, "op7_urls": OP7_SQL, "op11_lineruns": OP11_SQL, "op12_drake": OP12_SQL, "op13_prefixtrie": OP13_SQL}
