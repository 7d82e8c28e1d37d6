"""Mixing sources to target weights: a low-discrepancy schedule of equal-token blocks.

Each source's documents stand in a shuffled order (by a digest of identifier and text) and
form a stream of words that starts over when it ends. The stream is cut into blocks of
equal size. The mix has as many slots as all words fill blocks. Slot i has the golden-ratio
point ``i * STEP mod 2^31``, in whole numbers so that any engine gets the same, which falls into
one source's share of the cumulative targets; the r-th slot of a source takes block r of
its stream. The last slot holds what is left of the words. So every stretch of the mix has nearly the wanted shares, and what a source gives
is what its slots hold: its target up to the points' discrepancy, a few blocks. A source does
not go through its stream more than ``most`` times: a slot beyond that stays empty.

Targets: sources in code-point order (null last) have the given weights in turn and share
the sum of all sizes; none gets more than ``most`` times its own size, and the excess goes
to the others by weight until none is above.

Rows of one source, identifier and text are alike; they are counted before they are dealt to
tasks, and then numbered by the partitions they lie in, so that no number of them meets in one task.

Defined results: a null or empty text has size 0 and takes 0; a null source is a source of
its own; null identifiers and repeated ones are dealt by their texts; rows that repeat count
each; of ties in the shuffled order any one may come first, as they are alike; an empty table
gives no rows; a very long text is as many blocks as it fills; other columns are not read,
whatever their names.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arbora.llm.common import running_sum, stored, words

#: The golden-ratio step on a circle of 2^31 points: odd, so that a round meets every point once.
BITS = 31
STEP = 1327217885
CELL_BITS = 10


def sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, key (of the shuffled order), size (words), row (the columns named in ``carry``), with a number ``rid`` that stays as stored."""

    def count(batches):
        for b in batches:
            n = pa.array([len(words(t)) for t in b.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), n, b.column(4)], ["doc_id", "source", "key", "size", "row"])

    row = F.struct(*carry) if carry else F.struct(F.lit(1).alias("none"))
    text, own = F.col(text_col).cast("string"), F.col(id_col).cast("long")
    key = F.md5(F.concat(F.coalesce(own.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")))))
    d = docs.select(own.alias("doc_id"), F.col(source_col).cast("string").alias("source"), text.alias("text"), key.alias("key"), row.alias("row"))
    schema = d.select("doc_id", "source", "key", F.lit(0).cast("long").alias("size"), "row").schema
    return stored(d.mapInArrow(count, schema).withColumn("rid", F.monotonically_increasing_id()))


def targets(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """One row per source: its number ``src``, size, weight, target and share [lo, hi) of the points.

    The table has one row per source, so windows over all of it are small.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    everything = Window.partitionBy(F.lit(0))
    ranked = per.withColumn("src", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("src") % len(weights) + 1).cast("int"))
    s = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    by_ratio = everything.orderBy(F.col("cap") / F.col("weight"), "src")
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    s = (
        s.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after))
        .withColumn("full", F.col("level") * F.col("weight") > F.col("cap"))
    )
    s = s.withColumn("level", F.max(F.when(~F.col("full"), F.col("level"))).over(everything))
    s = s.withColumn("target", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("level") * F.col("weight")))
    upto = everything.orderBy("src").rowsBetween(Window.unboundedPreceding, 0)
    share = F.sum("target").over(upto) / F.greatest(F.sum("target").over(everything), F.lit(1e-9))
    last = F.col("src") == F.max("src").over(everything)
    s = s.withColumn("hi", F.when(last, F.lit(1 << BITS)).otherwise(F.floor(share * (1 << BITS))).cast("long"))
    s = s.withColumn("lo", F.coalesce(F.lag("hi").over(everything.orderBy("src")), F.lit(0)))
    return s.withColumn("most", F.col("cap")).select("src", "source", "source_size", "n_docs", "total", "target", "most", "lo", "hi")


def schedule(sources: DataFrame, slots: int, step: int = STEP, chunk: int = 65536) -> DataFrame:
    """slot, src, rank: which source each slot of the mix draws from, and how manieth of that source's it is."""
    spark, narrow = sources.sparkSession, BITS - CELL_BITS
    # a share spans some cells of the circle, so that points meet shares by an equi join
    cells = sources.where("lo < hi").select("src", "lo", "hi", F.explode(F.sequence(F.shiftright("lo", narrow), F.shiftright(F.col("hi") - 1, narrow))).alias("cell"))
    points = spark.range(slots).select(F.col("id").alias("slot"), F.pmod(F.pmod("id", F.lit(1 << BITS)) * step, F.lit(1 << BITS)).alias("u"))
    drawn = points.withColumn("cell", F.shiftright("u", narrow)).join(cells, "cell").where("lo <= u AND u < hi")
    drawn = drawn.select("slot", "src", F.floor(F.col("slot") / chunk).alias("part"), F.lit(1).alias("one"))
    return running_sum(drawn, ["src"], "part", ["slot"], "one", "rank").select("slot", "src", "rank")


def placed(sized: DataFrame, sources: DataFrame, per_chunk: int) -> DataFrame:
    """rid, src, size, start: where each document with words begins in its source's stream."""
    d = sized.where("size > 0").drop("row").join(sources, sized.source.eqNullSafe(sources.source)).drop(sources.source)
    # the number of chunks follows the source's rows; rows that are alike count as one with their number
    alike = d.groupBy("src", "key", "size", "n_docs").agg(F.count("*").alias("n"))
    chunk = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.ceil(F.col("n_docs") / per_chunk) / F.lit(2**32))
    alike = alike.withColumn("chunk", chunk).withColumn("words", F.col("n") * F.col("size"))
    first = stored(running_sum(alike, ["src"], "chunk", ["key"], "words", "first").select("src", "key", "n", "first"))
    d = d.select("rid", "src", "key", "size").join(first, ["src", "key"])
    several = d.where("n > 1").withColumn("at", F.shiftright("rid", 33)).withColumn("one", F.lit(1))
    several = running_sum(several, ["src", "key"], "at", ["rid"], "one", "nth")
    columns = ["rid", "src", "size"]
    return d.where("n = 1").select(*columns, F.col("first").alias("start")).unionByName(several.select(*columns, (F.col("first") + F.col("nth") * F.col("size")).alias("start")))


class Mix:
    """A mix of documents; the tables it is made of are stored."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), most: int = 3, block: int = 64, per_chunk: int = 2048, step: int = STEP, carry: tuple[str, ...] = ()):
        self.sized = sizes(docs, id_col, text_col, source_col, carry)
        self.sources = stored(targets(self.sized, weights, most))
        self.words = self.sources.agg(F.max("total")).first()[0] or 0
        self.slots = -(-self.words // block)
        slots = stored(schedule(self.sources, self.slots, step))
        # what a source gives: the blocks of its slots, the last slot of all being cut at the sum of all sizes, and no more than its stream holds
        cut = F.when(F.max("slot") == self.slots - 1, self.slots * block - self.words).otherwise(0)
        given = slots.groupBy("src").agg((F.count("*") * block - cut).alias("n"))
        # stored, so that its size is known before the join: a row a source, and a source may have a third of all documents
        given = stored(self.sources.join(given, "src").select("src", "source_size", F.least("n", "most").alias("given")))
        turns = placed(self.sized, self.sources, per_chunk).join(given, "src")
        turns = turns.withColumn("turn", F.explode(F.sequence(F.lit(0), F.floor((F.col("given") - 1) / F.col("source_size")))))
        turns = turns.withColumn("a", F.col("turn") * F.col("source_size") + F.col("start")).withColumn("b", F.least(F.col("a") + F.col("size"), F.col("given"))).where("a < b")
        # a document's pieces lie in blocks; a block has the slot of its rank
        pieces = turns.select("rid", "turn", "src", "a", "b", F.explode(F.sequence(F.floor(F.col("a") / block), F.floor((F.col("b") - 1) / block))).alias("rank"))
        pieces = pieces.withColumn("got", F.least("b", (F.col("rank") + 1) * block) - F.greatest("a", F.col("rank") * block))
        self.turns = pieces.join(slots, ["src", "rank"]).groupBy("rid", "turn").agg(F.sum("got").alias("got"), F.min("slot").alias("slot"))

    def documents(self) -> DataFrame:
        """doc_id, source, size, source_size, target, taken, first_slot, rid and row (the columns in ``carry``) of every document."""
        taken = self.turns.groupBy("rid").agg(F.sum("got").alias("taken"), F.min("slot").alias("first_slot"))
        per = self.sources.select("source", "source_size", "target")
        out = self.sized.join(per, self.sized.source.eqNullSafe(per.source)).drop(per.source).join(taken, "rid", "left")
        return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "first_slot", "rid", "row")

    def in_order(self, words_per_part: int = 1 << 22, broadcast_bytes: int = 1 << 25) -> DataFrame:
        """row, slot, turn, rid: a row each time the mix takes half of a document or more, in the order of its slots.

        Slots hold equal numbers of words, so equal stretches of them are equal partitions.
        """
        parts = max(1, -(-self.words // words_per_part))
        # texts move once, to their place in the order, while what is taken is small; a row of a broadcast takes 128 bytes at most
        turns = stored(self.turns)
        turns = F.broadcast(turns) if turns.count() * 128 <= broadcast_bytes else turns
        out = self.sized.where("size > 0").select("rid", "size", "row").join(turns, "rid").where("2 * got >= size")
        out = out.select("row", "slot", "turn", "rid", F.floor(F.col("slot") * parts / max(1, self.slots)).cast("int").alias("part"))
        return out.repartitionById(parts, "part").drop("part").sortWithinPartitions("slot", "turn", "rid")


def mix(docs: DataFrame, **options) -> DataFrame:
    return Mix(docs, **options).documents()
