"""MinHash near-dedup by an inverted join of signature coordinates.

Texts with one shingle set form a class; the rest works on classes.

1. A class has a signature of ``coords`` minima; it is posted under each (coordinate, value)
   pair, its tokens. A pair of classes is a candidate if at least ``least`` coordinates agree
   (a T-occurrence problem). With similarity s the agreements are binomial (coords, s): at
   s = 0.75, 48 and 22, a pair is missed with probability 2e-6.
2. Prefix: tokens that one class alone has cannot agree. A class with fewer than ``least``
   others has no candidate and goes. The others need to share one of their rarest
   (others - least + 1) tokens, in one order by frequency, so only these are posted; the
   common tokens of boilerplate are skipped.
3. Merging: a list's classes are compared with a leader first, as a group of near copies,
   however large, comes together by that. Lists whose classes are in one component then are
   skipped. The others are merged in tasks that hold two chunks of a list, every chunk
   with every other. First on signatures alone: agreements are counted, pairs of one component
   or of too different sizes are skipped, a pair is dealt with only in the list of its first
   common prefix token, and classes with a partner of ``least`` agreements go on, not their
   pairs. Then with the full sets of these: a task confirms pairs, skipping those that it has
   joined already. Chunks are bounded by rows and by bytes. No pair of a list is left out and no
   list is cut.
4. Components come from links by alternating large-star and small-star steps.

Shingles are ``size`` consecutive words (A-Z lower-cased) of whole texts, as 64-bit hashes; a
text of fewer words is one shingle.

Defined results: a null or empty text has no shingles and is linked with nothing; null
identifiers come after all others; rows that repeat are members of the class each, with one
component; of ties the smallest identifier stays; very long texts are read whole; an empty table
gives no rows; other columns are not read, whatever their names, but for those in ``carry``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from arbora.llm.common import in_slices, lower_ascii, mixed, stored, window_hashes, word_hashes


def shingles(text: str | None, size: int) -> np.ndarray:
    """Hashes of a text's shingles, in order."""
    h = word_hashes(lower_ascii(text).split())
    return window_hashes(h, min(size, len(h))) if len(h) else h


def _turns(coords: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**63, coords, np.uint64), rng.integers(0, 2**62, coords, np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(docs: DataFrame, size: int, coords: int, seed: int = 11) -> DataFrame:
    """n_shingles, set_key, sig (null without shingles) and all columns of ``docs``, the second of which is the text."""
    xor, odd = _turns(coords, seed)

    def scan(batches):
        for b in in_slices(batches, 256):
            found = [shingles(t, size) for t in b.column(1).to_pylist()]
            full = [i for i, h in enumerate(found) if len(h)]
            sets = [np.unique(h) for h in found]
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            sig: list = [None] * len(found)
            if full:
                h = np.concatenate([found[i] for i in full])
                cuts = np.cumsum([0, *(len(found[i]) for i in full[:-1])])
                low = np.stack([np.minimum.reduceat(mixed((h ^ x) * m), cuts) for x, m in zip(xor, odd, strict=True)], 1)
                for i, row in zip(full, (low >> np.uint64(32)).astype(np.uint32).view(np.int32), strict=True):
                    sig[i] = row.tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(sig, pa.list_(pa.int32())), *(b.column(c) for c in passed)],
                ["n_shingles", "set_key", "sig", *passed],
            )

    passed = [c for c in docs.columns if c != "text" or "row" in docs.columns]
    schema = StructType.fromDDL("n_shingles long, set_key binary, sig array<int>")
    for c in passed:
        schema = schema.add(docs.schema[c])
    return docs.mapInArrow(scan, schema)


def sets_of(texts: DataFrame, size: int) -> DataFrame:
    """c, shingles: the distinct hashes in ascending order, as bytes."""

    def scan(batches):
        for b in in_slices(batches, 256):
            found = [np.unique(shingles(t, size)).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], ["c", "shingles"])

    return texts.select("c", "text").mapInArrow(scan, "c long, shingles binary")


def signature_bytes(classes: DataFrame) -> DataFrame:
    """c, the set's size and the signature as bytes."""

    def scan(batches):
        for b in batches:
            sig = [np.array(x, np.int32).tobytes() for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sig, pa.binary())], ["c", "size", "sig"])

    return classes.select("c", "size", "sig").mapInArrow(scan, "c long, size long, sig binary")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Of two ascending arrays of distinct hashes."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    if len(a) > len(b):
        a, b = b, a
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def postings(classes: DataFrame, least: int) -> DataFrame:
    """token, c: the prefix tokens of the classes that may have a partner."""
    value = F.col("col").cast("long").bitwiseAND(0xFFFFFFFF)
    tokens = classes.select("c", F.posexplode("sig")).select("c", (F.shiftleft(F.col("pos").cast("long"), 32) + value).alias("token"))
    # stored, so that both sides of the join are plain and Spark can split a frequent token
    shared = stored(tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1"))
    own = tokens.join(shared, "token").groupBy("c").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("own")).where(F.size("own") >= least)
    return own.select("c", F.explode(F.slice("own", 1, F.size("own") - (least - 1))).alias("t")).select("t.token", "c")


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) of all nodes that ``links`` (a, b) name, roots themselves left out."""
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())

    def star(directed: DataFrame, large: bool) -> DataFrame:
        # m: the smallest of u and its neighbours; stored, so that the join below can be split
        low = stored(directed.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        met = directed.join(low, "u")
        if large:
            out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        return out.where("u <> v").distinct()

    def mark(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = mark(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        larger = stored(star(both, True))
        edges = stored(star(larger.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), False))
        after = mark(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (x, y) those that are similar on full sets."""

    def check(batches):
        for b in in_slices(batches):
            ok = [similar(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), percent) for p, q in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["x", "y"]).filter(pa.array(ok, pa.bool_()))

    a, b = (sets.select(F.col("c").alias(k), F.col("shingles").alias(f"set_{k}")) for k in ("y", "x"))
    # the side that many pairs share comes first, while rows are small
    both = pairs.join(a, "y").join(b, "x").select("x", "y", "set_x", "set_y")
    return stored(both.mapInArrow(check, "x long, y long"))


KEYS = ["token", "a", "b"]


def chunked(lists: DataFrame, chunks) -> DataFrame:
    """Every chunk of a list with every other: ``own`` is a row's chunk, (token, a, b) the group it goes to."""
    rows = lists.withColumn("_n", chunks.cast("int")).withColumn("own", F.pmod(F.xxhash64("c"), F.col("_n")))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return rows.withColumn("a", F.least("own", "_other")).withColumn("b", F.greatest("own", "_other")).drop("_n", "_other")


def by_group(rows: DataFrame, merge, schema: str) -> DataFrame:
    """``merge`` over the rows of each (token, a, b), as a generator of result rows."""
    kinds, names = to_arrow_schema(StructType.fromDDL(schema)).types, StructType.fromDDL(schema).names

    def scan(batches):
        key, held = None, []

        def batch(out):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

        for b in batches:
            out = []
            for row in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if row[:3] != key:
                    if len(held) > 1:
                        out += merge(key, held)
                    key, held = row[:3], []
                held.append(row[3:])
            if out:
                yield batch(out)
        if len(held) > 1 and (out := list(merge(key, held))):
            yield batch(out)

    return rows.repartition(*KEYS).sortWithinPartitions(*KEYS, "c").mapInArrow(scan, schema)


def agreeing(key: tuple, held: list[tuple], least: int, percent: int):
    """For each row in turn: itself and the later ones whose signatures agree and that this list deals with."""
    token, a, b = key
    c, comp, own, size, sig, mask = list(zip(*held, strict=True))[:6]
    sig, mask = np.frombuffer(b"".join(sig), np.int32).reshape(len(c), -1), np.array(mask, np.int64)
    comp, own, size, place = np.array(comp), np.array(own), np.array(size), np.int64(1) << np.arange(sig.shape[1], dtype=np.int64)
    here = np.int64(1) << np.int64(token >> 32)
    for i in range(len(c) - 1):
        same = sig[i] == sig[i + 1 :]
        ok = (same.sum(1) >= least) & (comp[i + 1 :] != comp[i]) & (100 * np.minimum(size[i], size[i + 1 :]) >= percent * np.maximum(size[i], size[i + 1 :]))
        if a != b:
            ok &= own[i + 1 :] != own[i]
        at = np.flatnonzero(ok)
        if len(at):
            common = (same[at] @ place) & mask[i] & mask[at + i + 1]
            at = at[(common & -common) == here] + i + 1
            if len(at):
                yield i, at


def merged(lists: DataFrame, detail: DataFrame, sets: DataFrame, least: int, percent: int, chunk: int, chunk_bytes: int) -> DataFrame:
    """Links (x, y) between the components of each list (token, c, comp, n); ``detail``: c, size, sig, mask."""
    columns = ["token", "c", "comp", "size", "sig", "mask"]
    schema = "token long, c long, comp long, size long, sig binary, mask long"

    def partners(key: tuple, held: list[tuple]):
        found = np.zeros(len(held), bool)
        for i, at in agreeing(key, held, least, percent):
            found[i] = found[at] = True
        for i in np.flatnonzero(found).tolist():
            c, comp, _, size, sig, mask = held[i]
            yield key[0], c, comp, size, sig, mask

    rows = chunked(lists.select("token", "c", "comp", "n"), F.ceil(F.col("n") / chunk)).join(detail, "c")
    some = by_group(rows.select(*KEYS, "c", "comp", "own", "size", "sig", "mask"), partners, schema)
    some = stored(some.dropDuplicates(["token", "c"]))

    def confirm(key: tuple, held: list[tuple]):
        root: dict[int, int] = {}

        def find(x):
            while x in root:
                x = root[x]
            return x

        for i, at in agreeing(key, held, least, percent):
            for j in at.tolist():
                p, q = find(held[i][1]), find(held[j][1])
                if p != q and similar(np.frombuffer(held[i][6], np.uint64), np.frombuffer(held[j][6], np.uint64), percent):
                    root[p] = q
                    yield held[i][0], held[j][0]

    sizes = stored(some.groupBy("token").agg(F.greatest(F.ceil(F.count("*") / chunk), F.ceil(F.sum("size") * 8 / chunk_bytes)).alias("chunks")))
    rows = chunked(some.join(sizes, "token"), F.col("chunks")).drop("chunks").join(sets, "c")
    return stored(by_group(rows.select(*KEYS, "c", "comp", "own", "size", "sig", "mask", "shingles"), confirm, "x long, y long"))


def classes_linked(posted: DataFrame, sets: DataFrame, sigs: DataFrame, least: int, percent: int, chunk: int, chunk_bytes: int) -> DataFrame:
    """c, comp of all posted classes."""
    comp = stored(posted.select("c").distinct().withColumn("comp", F.col("c")))

    def joined(links: DataFrame) -> DataFrame:
        named = links.join(comp.withColumnRenamed("c", "x"), "x").withColumnRenamed("comp", "a").join(comp.withColumnRenamed("c", "y"), "y").withColumnRenamed("comp", "b")
        roots = components(named.select("a", "b"))
        return stored(comp.join(roots.withColumnRenamed("node", "comp"), "comp", "left").select("c", F.coalesce("root", "comp").alias("comp")))

    def active() -> DataFrame:
        """token, c, comp, n, leader of the lists that hold several components."""
        own = stored(posted.join(comp, "c"))
        lists = stored(own.groupBy("token").agg(F.count("*").alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("c").alias("leader")).where("low <> high"))
        return own.join(lists.select("token", "n", "leader"), "token")

    # each class and the smallest leader of its lists; lists do not count as dealt with by this
    for _ in range(2):
        first = active().where("c <> leader").groupBy("c").agg(F.min("leader").alias("y"))
        first = first.join(comp, "c").join(comp.select(F.col("c").alias("y"), F.col("comp").alias("comp_y")), "y").where("comp <> comp_y")
        comp = joined(confirmed(first.select(F.col("c").alias("x"), "y"), sets, percent))
    masks = posted.groupBy("c").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright("token", 32).cast("int"))).alias("mask"))
    detail = stored(sigs.join(masks, "c"))
    return joined(merged(active(), detail, sets, least, percent, chunk, chunk_bytes))


def near_dedup(docs: DataFrame, size: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text", coords: int = 48, least: int = 22, chunk: int = 512, chunk_bytes: int = 1 << 24, broadcast_bytes: int = 1 << 25, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row; with ``carry`` also text and row (those columns)."""
    text = F.col(text_col).cast("string")
    row = [F.struct(*carry).alias("row")] if carry else []
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tkey"), *row)
    signed = stored(signatures(d, size, coords))
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "tkey"))
    classes = signed.where("n_shingles > 0").groupBy("set_key").agg(rep.alias("rep"), F.first("sig").alias("sig"), F.first("n_shingles").alias("size"))
    classes = stored(classes.withColumn("c", F.monotonically_increasing_id()))
    posted = stored(postings(classes, least))
    chosen = stored(classes.join(posted.select("c").distinct(), "c", "left_semi").select("c", "size", "sig", "rep.doc_id", "rep.tkey"))
    e = chosen.select("c", F.col("doc_id").alias("rep_id"), "tkey")
    # texts stay where they are while the list of those wanted is small; a row of a broadcast takes 128 bytes at most
    e = F.broadcast(e) if chosen.count() * 128 <= broadcast_bytes else e
    texts = d.join(e, "tkey").where(F.col("doc_id").eqNullSafe(F.col("rep_id"))).select("c", "text").dropDuplicates(["c"])
    sets = stored(sets_of(texts, size))
    comp = classes_linked(posted, sets, signature_bytes(chosen), least, percent, chunk, chunk_bytes)

    named = classes.select("c", "set_key", F.col("rep.doc_id").alias("doc_id")).join(comp, "c", "left").withColumn("comp", F.coalesce("comp", "c"))
    lowest = stored(named.groupBy("comp").agg(F.min("doc_id").alias("component_id")))
    of_set = stored(named.join(lowest, "comp").select("set_key", "component_id"))
    out = signed.drop("sig").join(of_set, "set_key", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), *(("text", "row") if carry else ()))
