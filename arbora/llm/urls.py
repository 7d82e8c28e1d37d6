"""URL filter: a blocked Bloom filter of listed canonical URLs before an exact hash join.

Listed entries are of two kinds. A prefix entry is a host and a path; it fits its host and all
subdomains where the URL's path starts with the entry's. Its key is the host and the path's
directory (up to its last ``/``); a URL has that key under one of its host suffixes and path
directories. An exact entry is a canonical URL, which fits URLs of that canonical form: host
without user, port, ``www.`` and dots at the end; path without repeated slashes, index page and
slash at the end; query without tracking parameters, the others in order; no scheme, no fragment.

A URL probes the filter under all its keys; possible hits go to an exact hash join with the
list, which removes the filter's false positives. DataFrame functions only.

The filter is blocked: a key sets one bit in each of the eight 32-bit words of one block, so
that a probe touches one row. Filter and list are broadcast only while the list's keys have at
most ``broadcast_bytes`` (the filter is smaller); beyond that both joins are shuffled.

Defined results: a null url, or one without ``://``, has an empty host and path, which no
entry fits, and takes part in no join; rows that repeat are judged each, their URL once; very long
URLs have as many keys as the list's deepest entry allows; an empty table gives no rows, an empty
list the default verdict. Of entries that fit, the smallest rank wins, then the longest (host and path); a
tie goes to the longer host, then to the later by code point. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.llm.common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"://([^/?#]*)([^?#]*)(?:\?([^#]*))?"
#: Parameters that say where a reader came from, not what the page is.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid|msclkid|sessionid)(=|$)"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def canonical(url: Column) -> Column:
    """The canonical form, without a scheme; empty where there is no host."""
    own = host(url)
    for noise in (r"^.*@", r":[0-9]*$", r"\.+$", r"^www\."):
        own = F.regexp_replace(own, noise, "")
    page = F.regexp_replace(F.regexp_replace(path(url), "/+", "/"), r"/(index\.html?)?$", "")
    parameters = F.filter(F.split(F.coalesce(F.regexp_extract(url, PARTS, 3), F.lit("")), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    query = F.array_join(F.array_sort(parameters), "&")
    return F.when(own == "", F.lit("")).otherwise(F.concat(own, page, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))))


def directory(p: Column) -> Column:
    return F.regexp_extract(p, r"^((?s:.*)/)?", 1)


def _masks(key: Column) -> list[Column]:
    h = F.xxhash64(key, F.lit(1))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 5 * i).bitwiseAND(31).cast("int")).alias(f"m{i}") for i in range(8)]


def bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """block, w0..w7 from the column ``key``."""
    bits = keys.select(F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block"), *_masks(F.col("key")))
    return bits.groupBy("block").agg(*(F.bit_or(f"m{i}").alias(f"w{i}") for i in range(8)))


def probes(urls: DataFrame, labels: int, depth: int) -> DataFrame:
    """host, path, page, key: a row for the page and one for each host suffix of at most ``labels`` labels and each directory of at most ``depth`` slashes."""
    names = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(names), F.lit(labels))), lambda n: F.call_function("substring_index", F.col("host"), F.lit("."), -n))
    slashes = F.length(F.regexp_replace("path", "[^/]+", ""))
    dirs = F.concat(
        F.array(F.lit("")),
        F.when(slashes > 0, F.transform(F.sequence(F.lit(1), F.least(slashes, F.lit(depth))), lambda n: F.concat(F.call_function("substring_index", F.col("path"), F.lit("/"), n), F.lit("/")))).otherwise(F.array().cast("array<string>")),
    )
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(dirs, lambda d: F.concat(F.lit("p"), s, d))))
    return urls.select("host", "path", "page", F.explode(F.concat(F.array(F.concat(F.lit("u"), "page")), keys)).alias("key"))


def possible_hits(keys: DataFrame, filter_: DataFrame, blocks: int) -> DataFrame:
    """The keys that the filter admits: all listed ones, and few others."""
    hit = F.lit(True)
    for i, m in enumerate(_masks(F.col("key"))):
        hit = hit & (F.col(f"w{i}").bitwiseAND(m) == m)
    found = keys.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks))).join(filter_, "block").where(hit)
    return found.select(*keys.columns)


def judge(pages: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", broadcast_bytes: int = 1 << 25) -> DataFrame:
    """id, host, path, rule, verdict, listed of every page.

    ``listed`` has host, path, verdict, rank and exact: of entries that fit, a lower rank goes
    before any length (0 for rules, 1 for the list proper). Host and path of an exact entry
    make its canonical URL.
    """
    exact = F.coalesce(F.col("exact"), F.lit(False))
    entries = listed.select(
        F.col("host").alias("l_host"), F.col("path").alias("l_path"), F.col("verdict").alias("l_verdict"), F.col("rank").alias("l_rank"), exact.alias("l_exact"),
        F.when(exact, F.concat(F.lit("u"), "host", "path")).otherwise(F.concat(F.lit("p"), "host", directory(F.col("path")))).alias("key"),
    )
    facts = entries.agg(
        F.count("*").alias("n"), F.max(F.size(F.split("l_host", r"\."))).alias("labels"), F.sum(F.octet_length("key") + 64).alias("bytes"),
        F.max(F.length(F.regexp_replace("l_path", "[^/]+", ""))).alias("depth"),
    ).first()
    url = F.col(url_col)
    judged = pages.select(F.col(id_col).alias("_id"), host(url).alias("host"), path(url).alias("path"), canonical(url).alias("page"))
    none = {"rule": F.lit(None).cast("string"), "verdict": F.lit(default), "listed": F.lit(False)}
    if not facts["n"]:
        return judged.drop("page").withColumns(none).withColumnRenamed("_id", id_col)
    small = F.broadcast if facts["bytes"] <= broadcast_bytes else (lambda df: df)
    blocks = max(1, -(-facts["n"] * 16 // 256))
    keys = probes(judged.where("host != ''").select("host", "path", "page").distinct(), facts["labels"], facts["depth"])
    possible = possible_hits(keys, small(bloom(entries, blocks)), blocks)
    fits = possible.join(small(entries), "key").where(F.col("l_exact") | F.col("path").startswith(F.col("l_path")))
    fits = fits.withColumn("order", F.struct(-F.col("l_rank"), F.length("l_host") + F.length("l_path"), F.length("l_host"), "l_host", "l_path"))
    # stored, so that both sides of the join below are plain and Spark can split a URL that many rows have
    best = stored(fits.groupBy("host", "path", "page").agg(F.max_by(F.struct("l_host", "l_path", "l_verdict", "l_rank"), "order").alias("best")))
    rule = F.when(F.col("best.l_rank") == 0, F.concat("best.l_host", "best.l_path"))
    found = judged.where("host != ''").join(best, ["host", "path", "page"], "left").select(
        "_id", "host", "path", rule.alias("rule"), F.coalesce("best.l_verdict", F.lit(default)).alias("verdict"), F.col("best").isNotNull().alias("listed")
    )
    return found.unionByName(judged.where("host = ''").drop("page").withColumns(none)).withColumnRenamed("_id", id_col)
