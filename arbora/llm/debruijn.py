"""Removal of repeated word windows by compaction of their de Bruijn graph.

Edges are windows of ``size`` words (token k-mers); an edge runs from the node of its first
``size - 1`` words to that of its last. Nodes whose occurrences all have one word before and
one word after do not branch, and a path over such nodes is one unitig: wherever one of its
edges occurs, all of them do. So windows need not be posted one by one; a unitig's occurrence
is, once, with its coordinates.

1. Documents are stored in files. Each window contains an anchor: the ``k``-mer (half a
   window) of smallest hash. A shuffle of the distinct anchors' hashes finds those that occur
   twice; a window can repeat only if its anchor does. What returns to each file is one bit an
   anchor, in the order in which the file's task sent them, so the file's task joins them by
   place.
2. The nodes next to such windows go into a second shuffle, with their neighbouring words
   reduced to "which one" or "several"; one bit a node returns: whether it branches.
3. Each file's task cuts its documents' runs of such windows at branching nodes. Every piece
   is a unitig's occurrence, keyed by a 128-bit digest of the very words at its coordinates,
   which verifies the repeat. A file's task sends its first occurrence of each key (smallest
   identifier, then earliest start); any other it has is no first. A Spark aggregation finds
   the first of all files of each key that several have, a join the others.
4. The words of the others are removed, all at once, judged on the input.

Every step sends distinct hashes or keys of each file, so a passage that many documents share,
or that one repeats many times, costs one entry a file.

Defined results: a null or empty text has no words and nothing to remove; rows that repeat an
identifier are documents each, in stored order, and null identifiers come last; of ties the
first place stays; very long texts are read whole; an empty table gives no rows; other columns are
not read, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.llm.common import stored, window_hashes, word_hashes
from arbora.llm.sstable import open_path

#: Labels of a node's neighbours: 0 is no word, 1 is several.
NONE, SEVERAL = np.uint64(0), np.uint64(1)


class Piece:
    """Some documents of a file: their words' hashes in one array, with what derives from them."""

    def __init__(self, texts: list[str | None], size: int, k: int):
        self.words = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
        n = np.array([len(w) for w in self.words], np.int64)
        self.starts = np.r_[0, np.cumsum(n)]
        self.size, self.k, self.n = size, k, int(self.starts[-1])
        self.h = np.concatenate([word_hashes(w) for w in self.words]) if self.n else np.zeros(0, np.uint64)
        #: first words of windows that lie in one document
        at = np.arange(max(0, self.n - size + 1))
        self.doc_end = np.repeat(self.starts[1:], n) if self.n else at
        self.is_edge = at + size <= self.doc_end[: len(at)]
        self.anchor, self.place = self._anchors()

    def _anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """The smallest k-mer hash in each window (0 where there is no window), and its first place there."""
        h = window_hashes(self.h, self.k)
        m = len(self.is_edge)
        if not m:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        # minimum over the k-mers of a window, by doubling
        width, reach, out, place = self.size - self.k + 1, 1, h, np.arange(len(h))
        while reach * 2 <= width:
            out, place = _smaller(out[: len(out) - reach], place[: len(out) - reach], out[reach:], place[reach:])
            reach *= 2
        late = width - reach
        out, place = _smaller(out[:m], place[:m], out[late : late + m], place[late : late + m])
        return np.where(self.is_edge, out, np.uint64(0)), place


def _smaller(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    left = a <= b
    return np.where(left, a, b), np.where(left, at, bt)


class Segment:
    """A stored file, read again in each step; windows and nodes come out alike each time."""

    def __init__(self, path: str, size: int, k: int, buckets: int):
        self.path, self.size, self.k, self.buckets = path, size, k, buckets

    def pieces(self, columns: tuple[str, ...] = ("text",)):
        filesystem, name = open_path(self.path)
        with filesystem.open_input_file(name) as f:
            for b in pq.ParquetFile(f).iter_batches(batch_size=384, columns=list(columns)):
                yield Piece(b.column(columns.index("text")).to_pylist(), self.size, self.k), b

    def by_bucket(self, h: np.ndarray) -> np.ndarray:
        """Where each bucket of an ascending array of hashes begins and ends."""
        step = (1 << 64) // self.buckets + 1
        return np.searchsorted(h, np.array([min(i * step, (1 << 64) - 1) for i in range(self.buckets)] , np.uint64)).tolist() + [len(h)]

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchors in ascending order, and whether another window place of the file has them too."""
        found = []
        for p, _ in self.pieces():
            # neighbouring windows share an anchor; the same hash at another place counts anew
            own = p.anchor[p.is_edge]
            new = np.r_[True, np.diff(p.place[p.is_edge]) != 0][: len(own)]
            u, c = np.unique(own[new], return_counts=True)
            found.append((u, c))
        if not found:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        return merged_counts(found)

    def repeated(self, p: Piece, known: np.ndarray) -> np.ndarray:
        """Windows whose anchor is among ``known`` (ascending)."""
        if not len(known) or not len(p.anchor):
            return np.zeros(len(p.anchor), bool)
        at = np.minimum(np.searchsorted(known, p.anchor), len(known) - 1)
        return p.is_edge & (known[at] == p.anchor)

    def node_places(self, p: Piece, edges: np.ndarray) -> np.ndarray:
        """First words of the nodes next to the windows."""
        touched = np.zeros(len(edges) + 1, bool)
        touched[:-1] |= edges
        touched[1:] |= edges
        return np.flatnonzero(touched)

    def nodes(self, known: np.ndarray):
        """Distinct nodes in ascending order, with the labels before and after."""
        found = []
        for p, _ in self.pieces():
            places = self.node_places(p, self.repeated(p, known))
            if not len(places):
                continue
            h = window_hashes(p.h, self.size - 1)[places]
            label = np.maximum(p.h, np.uint64(2))
            doc = np.searchsorted(p.starts, places, side="right") - 1
            before = np.where(places > p.starts[doc], label[np.maximum(places - 1, 0)], NONE)
            end = places + self.size - 1
            after = np.where(end < p.doc_end[places], label[np.minimum(end, p.n - 1)], NONE)
            found.append(reduced(h, before, after))
        return reduced(*map(np.concatenate, zip(*found, strict=True))) if found else (np.zeros(0, np.uint64),) * 3

    def unitigs(self, known: np.ndarray, nodes: np.ndarray, branching: np.ndarray):
        """(row, start, words, digest) of each unitig's occurrence, for rows of one batch at a time."""
        for p, b in self.pieces(("doc_id", "rid", "text")):
            edges = self.repeated(p, known)
            first = np.flatnonzero(edges)
            if not len(first):
                continue
            h = window_hashes(p.h, self.size - 1)[first]
            # a window continues the piece before if its first node does not branch
            joined = np.r_[False, (first[1:] == first[:-1] + 1)] & ~branching[np.searchsorted(nodes, h)]
            heads = np.flatnonzero(~joined)
            lasts = np.r_[heads[1:], len(first)] - 1
            doc = np.searchsorted(p.starts, first[heads], side="right") - 1
            starts, ends = first[heads] - p.starts[doc], first[lasts] + self.size - p.starts[doc]
            ids, rids = b.column(0).to_pylist(), b.column(1).to_pylist()
            for d, s, e in zip(doc.tolist(), starts.tolist(), ends.tolist(), strict=True):
                yield ids[d], rids[d], s, e - s, hashlib.blake2b(b" ".join(p.words[d][s:e]), digest_size=16).digest()

    def firsts(self, unitigs):
        """The file's first occurrence of each key with the key, every other one without: those can be no first."""
        best: dict[bytes, tuple] = {}
        for doc_id, rid, start, words, key in unitigs:
            new = (doc_id is None, doc_id or 0, rid, start, words, doc_id)
            old = best.setdefault(key, new)
            if old is not new:
                if new < old:
                    best[key], new = new, old
                yield new[5], new[2], new[3], new[4], None
        for key, (_, _, rid, start, words, doc_id) in best.items():
            yield doc_id, rid, start, words, key


def merged_counts(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    h, c = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    u, where = np.unique(h, return_inverse=True)
    return u, np.bincount(where, c, len(u)) > 1


def reduced(h: np.ndarray, before: np.ndarray, after: np.ndarray):
    """One row a node: the label that all its occurrences share, or SEVERAL."""
    order = np.argsort(h, kind="stable")
    h, before, after = h[order], before[order], after[order]
    cut = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, int)
    out = []
    for x in (before, after):
        if len(cut):
            low, high = np.minimum.reduceat(x, cut), np.maximum.reduceat(x, cut)
            x = np.where(low == high, low, SEVERAL)
        out.append(x)
    return h[cut], *out


def _bits(mask: np.ndarray) -> bytes:
    return np.packbits(mask).tobytes()


def _unbits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def _joined(segment: Segment, hashes: np.ndarray, bits: list) -> np.ndarray:
    """The flags that came back, by bucket, put to the hashes they were sent for."""
    out, cuts = np.zeros(len(hashes), bool), segment.by_bucket(hashes)
    for x in bits:
        a, z = cuts[x["bucket"]], cuts[x["bucket"] + 1]
        out[a:z] = _unbits(x["bits"], z - a)
    return out


def _send(segment: Segment, file: int, hashes: np.ndarray, *more: np.ndarray):
    cuts = segment.by_bucket(hashes)
    for k in range(segment.buckets):
        a, z = cuts[k], cuts[k + 1]
        if z > a:
            yield k, file, hashes[a:z].tobytes(), b"".join(x[a:z].tobytes() for x in more)


def _answers(sent: DataFrame, judge) -> DataFrame:
    """file, bits: for each file, the judge's flags on what it sent, bucket by bucket."""

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        h = [np.frombuffer(x, np.uint64) for x in pdf["hashes"]]
        ends = np.cumsum([0, *map(len, h)])
        flags = judge(np.concatenate(h), list(pdf["more"]), ends)
        return pd.DataFrame({"file": pdf["file"], "bucket": key[0], "bits": [_bits(flags[a:z]) for a, z in zip(ends, ends[1:], strict=False)]})

    answers = sent.groupBy("bucket").applyInPandas(one, "file long, bucket int, bits binary")
    return answers.groupBy("file").agg(F.collect_list(F.struct("bucket", "bits")).alias("bits"))


def _anchor_flags(h: np.ndarray, more: list[bytes], ends: np.ndarray) -> np.ndarray:
    twice = np.concatenate([np.frombuffer(m, bool) for m in more])
    _, where, n = np.unique(h, return_inverse=True, return_counts=True)
    return (n + np.bincount(where, twice, len(n)) > 1)[where]


def _node_flags(h: np.ndarray, more: list[bytes], ends: np.ndarray) -> np.ndarray:
    labels = [np.frombuffer(m, np.uint64) for m in more]
    before = np.concatenate([x[: len(x) // 2] for x in labels])
    after = np.concatenate([x[len(x) // 2 :] for x in labels])
    u, b, a = reduced(h, before, after)
    branching = (b == SEVERAL) | (a == SEVERAL)
    return branching[np.searchsorted(u, h)]


def spans(files: DataFrame, size: int, k: int, buckets: int) -> DataFrame:
    """file, rid, start, words: the unitig occurrences to remove."""

    def rows_of(make, kinds, names):
        def run(batches):
            for b in batches:
                for row in b.to_pylist():
                    held = []
                    for r in make(row):
                        held.append(r)
                        if len(held) == 4096 or len(held) and isinstance(r[-1], bytes) and len(r[-1]) > 1 << 16:
                            yield pack(held)
                            held = []
                    if held:
                        yield pack(held)

        def pack(held):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names)

        return run

    def send_anchors(row):
        s = Segment(row["path"], size, k, buckets)
        return _send(s, row["file"], *s.anchors())

    def known_anchors(s: Segment, bits):
        h, _ = s.anchors()
        return h[_joined(s, h, bits or [])]

    def send_nodes(row):
        s = Segment(row["path"], size, k, buckets)
        return _send(s, row["file"], *s.nodes(known_anchors(s, row["bits"])))

    def send_unitigs(row):
        s = Segment(row["path"], size, k, buckets)
        known = known_anchors(s, row["bits"])
        nodes, _, _ = s.nodes(known)
        branching = _joined(s, nodes, row["more"] or [])
        return ((row["file"], *u) for u in s.firsts(s.unitigs(known, nodes, branching)))

    sent = "bucket int, file long, hashes binary, more binary"
    kinds, names = (pa.int32(), pa.int64(), pa.binary(), pa.binary()), ["bucket", "file", "hashes", "more"]
    first = _answers(files.mapInArrow(rows_of(send_anchors, kinds, names), sent), _anchor_flags)
    with_anchors = _spread(stored(files.join(first, "file", "left")))
    second = _answers(with_anchors.mapInArrow(rows_of(send_nodes, kinds, names), sent), _node_flags).withColumnRenamed("bits", "more")
    with_nodes = _spread(stored(with_anchors.join(second, "file", "left")))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    found = stored(with_nodes.mapInArrow(rows_of(send_unitigs, kinds, ["file", "doc_id", "rid", "start", "words", "key"]), "file long, doc_id long, rid long, start long, words long, key binary"))

    place = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "rid", "start")
    firsts = found.where("key IS NOT NULL").groupBy("key").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    again = found.join(firsts, "key").where(~((F.col("rid") == F.col("first.rid")) & (F.col("start") == F.col("first.start"))))
    columns = ["file", "rid", "start", "words"]
    return again.select(*columns).unionByName(found.where("key IS NULL").select(*columns))


def _spread(df: DataFrame) -> DataFrame:
    """A file a task, as far as there are tasks: rows are few, and each stands for a whole file."""
    n = max(1, df.count())
    return df.repartition(n, "file")


def remove_repeats(docs: DataFrame, size: int = 20, k: int = 10, id_col: str = "doc_id", text_col: str = "text", rows_per_file: int = 16384, words_per_bucket: int = 1 << 22) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and the kept text of every row."""
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # a word takes seven bytes or so; the number of buckets follows the input and is no limit
    copy = stored(d.withColumn("rid", F.monotonically_increasing_id()), max_rows=rows_per_file)
    size_words = (copy.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 7
    buckets = max(8, -(-size_words // words_per_bucket))
    paths = sorted(copy.inputFiles())
    files = spark.createDataFrame(list(enumerate(paths)), "file long, path string") if paths else spark.createDataFrame([], "file long, path string")
    files = files.repartition(max(1, len(paths)), "file")
    cut = spans(files, size, k, buckets).groupBy("file").agg(F.collect_list(F.struct("rid", "start", "words")).alias("cut"))

    def apply(batches):
        for b in batches:
            for row in b.to_pylist():
                by_row: dict[int, list[tuple[int, int]]] = {}
                for c in row["cut"] or []:
                    by_row.setdefault(c["rid"], []).append((c["start"], c["words"]))
                filesystem, name = open_path(row["path"])
                with filesystem.open_input_file(name) as f:
                    for part in pq.ParquetFile(f).iter_batches(batch_size=512, columns=["doc_id", "rid", "text"]):
                        out = [kept(t, by_row.get(r, ())) for r, t in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                        n, m, texts = zip(*out, strict=True)
                        shas = [hashlib.sha256(t).hexdigest() for t in texts]
                        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(shas, pa.string()), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    work = _spread(stored(files.join(cut, "file", "left")))
    return work.mapInArrow(apply, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def kept(text: str | None, cuts) -> tuple[int, int, bytes]:
    """Words, words removed, and the rest joined by one blank."""
    ws = (text or "").encode("utf-8", "surrogatepass").split()
    if not cuts:
        return len(ws), 0, b" ".join(ws)
    gone = np.zeros(len(ws), bool)
    for start, n in cuts:
        gone[start : start + n] = True
    return len(ws), int(gone.sum()), b" ".join([w for w, g in zip(ws, gone.tolist(), strict=True) if not g])
