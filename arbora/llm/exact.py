"""Exact dedup by a log-structured merge index of content digests.

Every task fills memtables of at most ``memtable`` documents. A full memtable keeps one entry
a digest (the best row, the number of rows) and is flushed as a run: entries sorted by digest,
with Bloom filters. Runs are merged in tiers of a fixed fan-in: a tier takes FAN runs and makes
one of them, with new filters. Its digests are cut into FAN times as many ranges as
the tier before had, so that a merge always holds about a memtable, and a digest is moved once a
tier; there are log_FAN(runs) tiers. In a merge, an entry whose digest no other run's filter
admits passes as it is; the others are compared in digest order, keeping the smallest (-code
points, identifier) and adding up the rows. A group of equal texts, however large, is one entry a
memtable, so compaction never sees it whole.

Lookup: documents join the compacted entries that stand for several rows. These hits receive
byte verification: the normalised text of the row is compared with that of the entry's row.
Texts that differ under one digest are regrouped by the text itself.

Texts are equal when they are identical after white space ([\\x20\\x09-\\x0D]) is deleted. Of
equal texts the row with the most code points stays, then the one with the smallest identifier.

Defined results: a null text is empty, and all empty texts are equal; null identifiers come
after all others, the largest number included; rows that repeat are members of the group each,
and the first of them as stored stays; very long texts are read whole; an empty table gives no
rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.llm.common import SPACES, in_slices, stored
from arbora.llm.sstable import Bloom

ENTRY = np.dtype([("digest", "<u8"), ("less", "<i8"), ("none", "u1"), ("id", "<i8"), ("rid", "<i8"), ("rows", "<i8")])
#: Runs that a tier makes one of, and ranges it cuts each range into.
FAN_BITS = 4
FAN = 1 << FAN_BITS
SLICES = "part long, run long, entries binary, filter binary"


def normalised(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(None, SPACES)


def best(entries: np.ndarray) -> np.ndarray:
    """One entry a digest: the smallest (less, id, rid), null identifiers last, with the rows added up."""
    entries = entries[np.lexsort((entries["rid"], entries["id"], entries["none"], entries["less"], entries["digest"]))]
    first = np.flatnonzero(np.r_[True, entries["digest"][1:] != entries["digest"][:-1]]) if len(entries) else np.zeros(0, int)
    out = entries[first].copy()
    if len(first):
        out["rows"] = np.add.reduceat(entries["rows"], first)
    return out


def merged(runs: list[np.ndarray], filters: list[Bloom]) -> np.ndarray:
    """One sorted run of several of one digest range."""
    alone, rest = [], []
    for i, run in enumerate(runs):
        met = np.zeros(len(run), bool)
        for j, f in enumerate(filters):
            if j != i:
                open_ = np.flatnonzero(~met)
                met[open_] = f.admits(run["digest"][open_])
        alone.append(run[~met])
        rest.append(run[met])
    out = np.concatenate([*alone, best(np.concatenate(rest))])
    return out[np.argsort(out["digest"], kind="stable")]


def sliced(run: np.ndarray, tier: int, number: int):
    """Rows of SLICES: a sorted run cut at the digest ranges that the tier merges."""
    part = run["digest"] >> np.uint64(64 - FAN_BITS * tier)
    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    for a, z in zip(cuts, [*cuts[1:], len(run)], strict=True):
        yield int(part[a]), number, run[a:z].tobytes(), bytes(Bloom.of(run["digest"][a:z]).bits)


def entries_of(docs: DataFrame, digest_bits: int) -> DataFrame:
    """doc_id, rid, n_chars, digest, text_sha256, text and row, to be stored so that ``rid`` stays."""
    mask = (1 << digest_bits) - 1

    def digests(batches):
        for b in in_slices(batches):
            texts = b.column(1).to_pylist()
            hashes = [hashlib.sha256(normalised(t)) for t in texts]
            digest = np.array([int.from_bytes(h.digest()[:8], "little") & mask for h in hashes], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array([len(t or "") for t in texts], pa.int64()), pa.array(digest, pa.int64()), pa.array([h.hexdigest() for h in hashes], pa.string()), b.column(1), b.column(3)],
                names,
            )

    whole = docs.select("doc_id", "rid", *(F.lit(0).cast("long").alias(c) for c in ("n_chars", "digest")), F.lit("").alias("text_sha256"), "text", "row")
    names = whole.columns
    return docs.select("doc_id", "text", "rid", "row").mapInArrow(digests, whole.schema)


def flushed(entries: DataFrame, memtable: int) -> DataFrame:
    """SLICES of the runs of all memtables, cut for the first tier; a run's number is its task's with its own in the task below."""

    def memtables(batches):
        held: list[np.ndarray] = []
        n = number = 0

        def flush():
            run = best(np.concatenate(held))
            rows = list(sliced(run, 1, (TaskContext.get().partitionId() << 32) + number))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["part", "run", "entries", "filter"])

        for b in in_slices(batches, memtable):
            e = np.zeros(b.num_rows, ENTRY)
            ids = b.column(0)
            e["none"], e["id"] = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
            e["rid"], e["less"] = b.column(1).to_numpy(), -b.column(2).to_numpy()
            e["digest"], e["rows"] = b.column(3).to_numpy().view(np.uint64), 1
            held.append(e)
            n += len(e)
            if n >= memtable:
                yield flush()
                held.clear()
                n, number = 0, number + 1
        if n:
            yield flush()

    return entries.select("doc_id", "rid", "n_chars", "digest").mapInArrow(memtables, SLICES)


def compacted(entries: DataFrame, memtable: int) -> DataFrame:
    """digest, keep_id, keep_rid, group_size of the digests that several rows have."""

    def merge(pdf: pd.DataFrame) -> np.ndarray:
        return merged([np.frombuffer(r, ENTRY) for r in pdf["entries"]], [Bloom(bytearray(f)) for f in pdf["filter"]])

    def tier(level: int):
        def compact(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame(sliced(merge(pdf), level + 1, int(key[1])), columns=["part", "run", "entries", "filter"])

        return compact

    def last(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = merge(pdf)
        out = out[out["rows"] > 1]
        ids = pd.array(out["id"], dtype="Int64")
        ids[out["none"] == 1] = pd.NA
        return pd.DataFrame({"digest": out["digest"].view(np.int64), "keep_id": ids, "keep_rid": out["rid"], "group_size": out["rows"]})

    runs = stored(flushed(entries, memtable))
    # one row for the driver: how many tasks flushed, and how many runs a task at most
    shape = runs.agg(F.max(F.shiftright("run", 32)), F.max(F.col("run").bitwiseAND((1 << 32) - 1))).first()
    each = (shape[1] or 0) + 1
    n = ((shape[0] or 0) + 1) * each
    runs = runs.withColumn("run", F.shiftright("run", 32) * each + F.col("run").bitwiseAND((1 << 32) - 1))
    level = 1
    while n > FAN:
        n = -(-n // FAN)
        runs = runs.withColumn("run", F.shiftright("run", FAN_BITS)).groupBy("part", "run").applyInPandas(tier(level), SLICES)
        level += 1
    return runs.groupBy("part").applyInPandas(last, "digest long, keep_id long, keep_rid long, group_size long")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bits: int = 64, memtable: int = 65536, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, rid of every row; with ``carry`` also text and row (those columns)."""
    row = F.struct(*carry) if carry else F.struct(F.lit(1).alias("none"))
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("rid"), row.alias("row"))
    entries = stored(entries_of(d, digest_bits))
    index = stored(compacted(entries, memtable))

    squeezed = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", "")
    # byte verification: the texts of hits against that of the row which stays
    hits = stored(entries.join(index.select("digest", "keep_rid"), "digest").select("digest", "doc_id", "rid", "n_chars", "keep_rid", squeezed.alias("normal")))
    keepers = hits.where("rid = keep_rid").select("digest", F.col("normal").alias("keep_normal"))
    # stored before it is made distinct: an aggregation on the join's key would keep Spark from splitting a large group
    differing = stored(hits.join(keepers, "digest").where("normal <> keep_normal").select("digest")).distinct()
    out = entries.join(index, "digest", "left").select(
        "digest", "rid", "doc_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"), (F.col("group_size").isNull() | (F.col("rid") == F.col("keep_rid"))).alias("kept"), "text_sha256", "text", "row",
    )
    if not differing.isEmpty():
        own = hits.join(differing, "digest", "left_semi")
        order = F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), "doc_id", "rid")
        groups = own.groupBy("digest", "normal").agg(F.min(order).alias("first"), F.count("*").alias("group_size"))
        again = own.join(groups, ["digest", "normal"]).select(
            "digest", "rid", "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("first.rid")).alias("kept"),
        )
        again = again.join(entries.select("rid", "text_sha256", "text", "row"), "rid").select(*out.columns)
        out = out.join(differing, "digest", "left_anti").unionByName(again)
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256", "rid", *(("text", "row") if carry else ()))
