"""The registered queries of the corpus operators, with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from arbora.llm import debruijn, exact, langid, mixing, near, packing, quality, sstable, urls, warc
from arbora.llm.common import table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op10_mixing(spark, d):
    return mixing.mix(table(spark, d, "documents")).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


ORACLE_SQL["op10_mixing"] = r"""
WITH s AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS key FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS src FROM s GROUP BY source),
w AS (SELECT *, [5, 2, 1][(src % 3 + 1)::INT] AS weight, source_size * 3 AS cap, (sum(source_size) OVER ())::BIGINT AS total FROM p),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
        / (sum(weight) OVER (ORDER BY cap / weight, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS own FROM w),
f AS (SELECT *, own * weight > cap AS filled FROM l),
t AS (SELECT src, source, source_size, cap, total, CASE WHEN filled THEN cap::DOUBLE ELSE (max(CASE WHEN NOT filled THEN own END) OVER ()) * weight END AS target FROM f),
h AS (SELECT *, CASE WHEN src = max(src) OVER () THEN 2147483648 ELSE floor(sum(target) OVER (ORDER BY src) / (sum(target) OVER ()) * 2147483648)::BIGINT END AS hi FROM t),
i AS (SELECT *, coalesce(lag(hi) OVER (ORDER BY src), 0) AS lo FROM h),
slots AS (SELECT slot, (slot % 2147483648) * 1327217885 % 2147483648 AS u FROM (SELECT unnest(range((SELECT ceil(max(total) / 64)::BIGINT FROM t))) AS slot)),
drawn AS (SELECT slot, src, row_number() OVER (PARTITION BY src ORDER BY slot) - 1 AS rank FROM slots JOIN i ON lo <= u AND u < hi),
g AS (SELECT src, least(count(*) * 64 - CASE WHEN max(slot) = (SELECT max(slot) FROM slots) THEN (max(slot) + 1) * 64 - any_value(total) ELSE 0 END, any_value(cap)) AS given FROM drawn JOIN t USING (src) GROUP BY src),
o AS (SELECT s.*, t.src, source_size, target, coalesce(given, 0)::BIGINT AS given,
        coalesce(sum(size) OVER (PARTITION BY t.src ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
      FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source LEFT JOIN g ON g.src = t.src)
SELECT doc_id, size, source_size, target,
  CASE WHEN size = 0 THEN 0 ELSE given // source_size * size + greatest(0, least(start + size, given % source_size) - start) END::BIGINT AS taken, CASE WHEN size > 0 AND start < given THEN slot END AS first_slot
FROM o LEFT JOIN drawn ON drawn.src = o.src AND drawn.rank = start // 64"""


#: host, path, verdict of the rules.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Sites of spam, gambling, adult content and trackers, listed in each zone with their numbered mirrors.
URL_SITES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
URL_ZONES = ("com", "net", "org")
URL_MIRRORS = 300
#: A site of which single pages are listed, by canonical URL: the numbers up to 999 in one language.
URL_PAGES = ("blog.tionsh.example.net", "/es/", 1000)


def url_list(spark):
    """The rules, the listed sites and the listed pages: 6,404 entries."""
    columns = ("host", "path", "verdict", "rank", "exact")
    values = ", ".join(f"('{h}', '{p}', '{v}', 0, false)" for h, p, v in URL_RULES)
    rules = spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(columns)})")
    names, zones = (F.array(*map(F.lit, x)) for x in (URL_SITES, URL_ZONES))
    number = F.when(F.col("id") > 0, F.col("id").cast("string")).otherwise(F.lit(""))
    sites = spark.range(URL_MIRRORS).select("id", F.explode(names).alias("name")).select("id", "name", F.explode(zones).alias("zone"))
    sites = sites.select(F.concat("name", number, F.lit(".example."), "zone"), F.lit(""), F.lit("block"), F.lit(1), F.lit(False))
    site, folder, n = URL_PAGES
    pages = spark.range(n).select(F.lit(site), F.concat(F.lit(folder), F.col("id").cast("string")), F.lit("block"), F.lit(1), F.lit(True))
    return rules.union(sites).union(pages).toDF(*columns)


@query
def op9_url_filter(spark, d):
    return urls.judge(table(spark, d, "pages"), url_list(spark)).select("page_id", "host", "path", "rule", "verdict", "listed")


ORACLE_SQL["op9_url_filter"] = r"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)(\?([^#]*))?', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)(\?([^#]*))?', 2), '') AS path, string_split(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)(\?([^#]*))?', 4), ''), '&') AS query FROM pages),
c AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '\.+$', ''), '^www\.', '') AS site,
  regexp_replace(regexp_replace(path, '/+', '/', 'g'), '/(index\.html?)?$', '') AS page, list_filter(query, lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|fbclid|gclid|msclkid|sessionid)(=|$)')) AS kept FROM u),
r(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
f AS (SELECT page_id, host, path, (SELECT arg_max(h || p, length(h) + length(p)) FROM r WHERE (c.host = h OR ends_with(c.host, '.' || h)) AND starts_with(c.path, p)) AS rule,
  (SELECT arg_max(v, length(h) + length(p)) FROM r WHERE (c.host = h OR ends_with(c.host, '.' || h)) AND starts_with(c.path, p)) AS verdict,
  regexp_matches(host, '(^|\.)(ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm)([1-9]|[1-9][0-9]|[12][0-9][0-9])?\.example\.(com|net|org)$')
    OR len(kept) = 0 AND regexp_matches(site || page, '^blog\.tionsh\.example\.net/es/(0|[1-9][0-9]{0,2})$') AS named FROM c)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN named THEN 'block' ELSE 'allow' END) AS verdict, rule IS NOT NULL OR named AS listed FROM f"""


TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@query
def op4_packing(spark, d):
    return packing.pack_documents(table(spark, d, "documents"), TOKENIZER)


@query
def op6_token_shards(spark, d):
    shards = sstable.write(table(spark, d, "documents"), TOKENIZER)
    return sstable.read(spark, shards).select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op5_warc(spark, d):
    files = warc.write(table(spark, d, "pages"))
    return warc.read(spark, files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL["op5_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages),
g AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, sha1(payload) AS payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM g"""


@query
def op2_exact_dedup(spark, d):
    return exact.dedup(table(spark, d, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE_SQL["op2_exact_dedup"] = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS n_chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS normal FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY normal) AS group_size, first_value(doc_id) OVER w = doc_id AS kept, sha256(normal) AS text_sha256
FROM n WINDOW w AS (PARTITION BY normal ORDER BY n_chars DESC, doc_id)"""


@query
def op1_quality(spark, d):
    return quality.judge(table(spark, d, "documents")).drop("rid", "kept_text")


ORACLE_SQL["op1_quality"] = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, hash(ws[i], ws[i + 1], ws[i + 2]) AS k FROM d, unnest(range(1, len(ws) - 1)) AS t(i)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
c AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM r, unnest(range(0, 3)) AS t(o) GROUP BY doc_id),
l AS (SELECT doc_id, source, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lw FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM d)),
v AS (SELECT doc_id, source, line, translate(array_to_string(lw, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS normal, len(lw) AS n FROM l WHERE len(lw) > 0),
u AS (SELECT doc_id, sum(k - 1)::BIGINT AS n FROM (SELECT doc_id, line, count(*) AS k FROM v GROUP BY ALL) GROUP BY doc_id),
x AS (SELECT doc_id, source, normal, sum(n) AS n FROM v GROUP BY ALL),
k AS (SELECT source, count(*) AS everything FROM documents GROUP BY source),
y AS (SELECT doc_id, x.source, n, count(*) OVER (PARTITION BY x.source, normal) AS docs FROM x),
z AS (SELECT doc_id, sum(n)::BIGINT AS n FROM y JOIN k ON k.source IS NOT DISTINCT FROM y.source WHERE docs > 100 OR docs >= 5 AND docs > 0.1 * everything GROUP BY doc_id),
m AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words, list_sum(list_transform(ws, lambda w: length(w))) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  coalesce(u.n, 0) AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, coalesce(z.n, 0) AS n_removed_words
  FROM d LEFT JOIN u ON u.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN z ON z.doc_id = d.doc_id)
SELECT doc_id, n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, n_symbols, n_dup_lines, n_repeat_words, n_removed_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_removed_words >= 0.3 * n_words AS kept
FROM m"""


@query
def op8_language(spark, d):
    docs = table(spark, d, "documents")
    out = langid.predict(docs, langid.train(docs))
    return out.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


@query
def op7_substring_dedup(spark, d):
    return debruijn.remove_repeats(table(spark, d, "documents")).drop("kept_text")


ORACLE_SQL["op7_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, i, array_to_string(ws[i : i + 19], ' ') AS k FROM d, unnest(range(1, len(ws) - 18)) AS t(i)),
again AS (SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, i + o AS i FROM again, unnest(range(0, 20)) AS t(o)),
p AS (SELECT doc_id, i, ws[i] AS word FROM d, unnest(range(1, len(ws) + 1)) AS t(i)),
k AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM p ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""


@query
def op3_near_dedup(spark, d):
    return near.near_dedup(table(spark, d, "documents"))


ORACLE_SQL["op3_near_dedup"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_sort(list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')))) END AS grams FROM d),
c AS (SELECT min(doc_id) AS c, grams, len(grams) AS n FROM g WHERE len(grams) > 0 GROUP BY grams),
s AS (SELECT c, n, unnest(grams) AS gram FROM c),
l AS (SELECT a.c AS x, b.c AS y FROM s a JOIN s b ON a.gram = b.gram AND a.c <> b.c AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r(c, node) AS (SELECT c, c FROM c UNION SELECT r.c, l.y FROM r JOIN l ON l.x = r.node),
m AS (SELECT c, min(node) AS component_id FROM r GROUP BY c)
SELECT doc_id, len(g.grams)::BIGINT AS n_shingles, coalesce(m.component_id, doc_id) AS component_id, coalesce(m.component_id, doc_id) = doc_id AS kept
FROM g LEFT JOIN c ON c.grams = g.grams LEFT JOIN m ON m.c = c.c"""
