"""Quality rules: per-document measures, then lines that too many documents of a host share.

One pass over the texts gives the measures and, for each document, the distinct hashes of its
normalised lines (white space runs to one space, ends trimmed, A-Z lower-cased; a line without
a word is none) with the words they hold. Documents are counted for each (host, line hash):
a document counts once a line, and each task adds up before the shuffle. A line is above the limits
if more than ``max_docs`` documents of a host have it, or more than ``max_share`` of the host's
documents and at least ``min_docs``; it is removed from that host's documents. A document of which
less than ``min_left`` of the words remain is depleted, and rejected. ``kept_text`` is the text
without the removed lines, all other lines being as they were; the texts are stored beside the
measures for it, and are read again only by who asks for that column.

Defined results: a null text has no words, fails the base rules and stays null; a null host is a host of
its own; rows that repeat count as documents each; null identifiers are kept; an empty table
gives no rows; very long texts are read whole; there are no ties; other columns are not read,
whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from arbora.llm.common import LOWER, in_slices, stored, word_hashes, window_hashes

SYMBOLS = re.compile(rb"[#*$%&|<>]")
BASE = "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<long>, line_words array<long>, text string"


def repeated_words(ws: list[bytes], size: int = 3) -> int:
    """Words in windows of ``size`` words that the text has twice or more, the first included."""
    if len(ws) <= size:
        return 0
    h = window_hashes(word_hashes(ws), size)
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    covered = np.zeros(len(ws), bool)
    for k in range(size):
        covered[k : k + len(h)] |= twice
    return int(covered.sum())


def line_key(ws: list[bytes]) -> int:
    return xxhash.xxh3_64_intdigest(b" ".join(ws).translate(LOWER))


def without(text: str, gone: list[int]) -> str:
    """The text without the lines of these keys (as signed numbers)."""
    keys = {k % (1 << 64) for k in gone}
    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
    return b"\n".join(x for x in lines if not (own := x.split()) or line_key(own) not in keys).decode("utf-8", "surrogatepass")


@F.arrow_udf(StringType())
def cleaned(text: pa.Array, gone: pa.Array) -> pa.Array:
    return pa.array([without(t, g) if t and g else t for t, g in zip(text.to_pylist(), gone.to_pylist(), strict=True)], pa.string())


def measures(text: str | None) -> tuple:
    raw = (text or "").encode("utf-8", "surrogatepass")
    ws = raw.split()
    lines, dup, seen = {}, 0, set()
    for line in raw.split(b"\n"):
        own = line.split()
        if own:
            dup += line in seen
            seen.add(line)
            key = line_key(own)
            lines[key] = lines.get(key, 0) + len(own)
    chars = sum(map(len, ws)) if raw.isascii() else sum(len(w.decode("utf-8", "surrogatepass")) for w in ws)
    return len(ws), chars, len(SYMBOLS.findall(raw)), dup, repeated_words(ws), lines


def measured(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    def scan(batches):
        for b in in_slices(batches):
            rows = [measures(t) for t in b.column(2).to_pylist()]
            ends = np.cumsum([0, *(len(r[5]) for r in rows)]).astype(np.int32)
            keys = np.array([k for r in rows for k in r[5]], np.uint64).view(np.int64)
            sizes = np.array([n for r in rows for n in r[5].values()], np.int64)
            cols = [pa.array([r[i] for r in rows], pa.int64()) for i in range(5)]
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (keys, sizes)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols, *lists, b.column(2)], ["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines", "line_words", "text"])

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).cast("string").alias("text"))
    return stored(d.mapInArrow(scan, BASE).withColumn("rid", F.monotonically_increasing_id()))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_docs: int = 100, max_share: float = 0.1, min_docs: int = 5, min_left: float = 0.3) -> DataFrame:
    """doc_id, the measures, base_failed, n_removed_words, kept, kept_text, rid."""
    base = measured(docs, id_col, text_col, host_col)
    # a missing host is told from any host by the flag before it
    host = F.coalesce(F.concat(F.lit("h"), F.col("host")), F.lit("n"))
    lines = base.select("rid", host.alias("host"), F.explode(F.arrays_zip("lines", "line_words")).alias("l")).select("rid", "host", F.col("l.lines").alias("line"), F.col("l.line_words").alias("words"))
    hosts = stored(base.groupBy(host.alias("host")).agg(F.count("*").alias("all")))
    several = lines.groupBy("host", "line").agg(F.count("*").alias("docs")).where(F.col("docs") >= min(min_docs, max_docs + 1))
    above = (F.col("docs") > max_docs) | ((F.col("docs") >= min_docs) & (F.col("docs") > F.lit(max_share) * F.col("all")))
    # stored, so that both sides of the join below are plain and Spark can split a line that many documents have
    common = stored(several.join(hosts, "host").where(above).select("host", "line"))
    removed = lines.join(common, ["host", "line"]).groupBy("rid").agg(F.sum("words").alias("removed"), F.collect_list("line").alias("gone"))
    out = base.drop("lines", "line_words").join(removed, "rid", "left").withColumn("removed", F.coalesce("removed", F.lit(0)))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    left = F.col("n_words") - F.col("removed") >= F.lit(min_left) * F.col("n_words")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), F.col("removed").alias("n_removed_words"), (~failed & left).alias("kept"), cleaned("text", "gone").alias("kept_text"), "rid")
