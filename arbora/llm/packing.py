"""Sum-of-squares packing of documents into sequences of a fixed capacity.

A document's ids, its end id included, are cut into pieces of at most the capacity. A piece
that fills a sequence has one to itself. For the others the rule is: let N(g) be the number
of open bins with gap g; a piece of size s goes where the sum of the squared N(g) becomes
smallest, into an open bin or a new one. Counts of other gaps do not change, so it compares
2 * (N(g - s) - N(g)) over the gaps g >= s, a new bin among them. Pieces come in a shuffled
order, for which the rule is made; bins that end up well filled stay, the others are taken
apart for the next round, and the last round goes by descending size.

Packing runs in groups of about ``per_group`` pieces, dealt out by a hash of the stored piece's
row number, so that pieces of one identifier, however many, are spread like all others.
What a group leaves badly filled is packed again in far fewer groups, bins being taken apart
first. Only sizes and numbers move; ids stay behind as a checksum.

Defined results: a null text is empty, its document the end id alone; rows that repeat are
packed each; null identifiers are kept; pieces of equal length are ties, which go by their row
numbers; a very long text is as many pieces as it fills; an empty table gives no rows; other
columns are not read, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.llm.common import in_slices, stored, task_count
from arbora.llm.tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    end = end_id.to_bytes(4, "little")

    def cut(batches):
        enc = encoder(tokenizer_path)
        for b in in_slices(batches):
            out = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = enc.ids(text) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut, PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int, order: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each piece, and the fill of each bin; pieces come by ``order``, else largest first."""
    order = np.argsort(-lengths, kind="stable") if order is None else order
    count = np.zeros(capacity + 1, np.int64)  # N(g); a new bin has gap `capacity`, of which none counts as open
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, offset, fill = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    for i in order.tolist():
        s = int(lengths[i])
        if s >= capacity:
            where[i] = len(fill)
            fill.append(s)
            continue
        change = count[: capacity + 1 - s] - count[s:]  # for gaps s..capacity
        change[0] = -count[s]  # a full bin is no longer open
        change[1:] += 1
        open_ = count[s:] > 0
        open_[-1] = True
        g = s + int(np.where(open_, change, np.iinfo(np.int64).max).argmin())
        if g == capacity and not bins[g]:
            fill.append(0)
            k = len(fill) - 1
        else:
            k = bins[g].pop()
            count[g] -= 1
        where[i], offset[i] = k, fill[k]
        fill[k] += s
        if (left := capacity - fill[k]) > 0:
            bins[left].append(k)
            count[left] += 1
    return where, offset, np.array(fill, np.int64)


def in_rounds(lengths: np.ndarray, capacity: int, rounds: int = 2, good: float = 0.99) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset and the bin's fill for each piece."""
    n = len(lengths)
    where, offset, fill = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    left, used = np.arange(n), 0
    for k in range(rounds + 1):
        order = np.random.default_rng(k).permutation(len(left)) if k < rounds else None
        w, o, f = sum_of_squares(lengths[left], capacity, order)
        done = f[w] >= good * capacity if k < rounds else np.ones(len(left), bool)
        at = left[done]
        where[at], offset[at], fill[at] = w[done] + used, o[done], f[w[done]]
        left, used = left[~done], used + len(f)
    return where, offset, fill


def pack(parts: DataFrame, capacity: int = 2048, per_group: int = 16384, good: float = 0.98) -> DataFrame:
    """Adds sequence_id and offset to pieces; ``parts``, with a row number ``rid``, is read more than once, so it should be stored."""
    schema = f"{PIECES}, rid long, grp long, bin long, offset long, fill long"
    own = ["doc_id", "piece", "start", "length", "ids_crc32", "rid"]

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "rid"], ignore_index=True)
        where, offset, fill = in_rounds(pdf["length"].to_numpy(), capacity)
        return pdf[own].assign(grp=key[0], bin=where, offset=offset, fill=fill)

    def dealt(df: DataFrame, groups: int, tag: int) -> DataFrame:
        g = F.pmod(F.xxhash64("rid", F.lit(tag)), F.lit(groups))
        return df.select(*own, g.alias("grp")).groupBy("grp").applyInPandas(one, schema)

    rest = parts.where(F.col("length") < capacity)
    n = rest.count()
    first = stored(dealt(rest, task_count(n, per_group), 0))
    bad = first.where(F.col("fill") < good * capacity)
    again = dealt(bad, task_count(bad.count(), 4 * per_group), 1)
    full = parts.where(F.col("length") >= capacity).withColumn("grp", F.lit(0).cast("long")).withColumn("bin", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    keep = ["doc_id", "piece", "start", "length", "ids_crc32", "grp", "bin", "offset"]
    out = None
    for tag, df in enumerate((full, first.where(F.col("fill") >= good * capacity), again)):
        # bins are numbered below 2^32 in a group; rows of the full ones by Spark's own partition numbers
        number = F.col("bin") * 3 + tag if tag == 0 else (F.col("grp") * (1 << 32) + F.col("bin")) * 3 + tag
        df = df.select(*keep).withColumn("sequence_id", number)
        out = df if out is None else out.unionByName(df)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", per_group: int = 16384) -> DataFrame:
    numbered = pieces(docs, tokenizer_path, end_id, capacity, id_col, text_col).withColumn("rid", F.monotonically_increasing_id())
    return pack(stored(numbered), capacity, per_group)
