"""Language identification by error-correcting output codes over character n-grams.

Every language has a codeword of bits; a binary classifier for each bit predicts it from
hashed character n-grams (of 1 to 3 letters, words padded by a blank, A-Z and their like
lower-cased). For up to ``exhaustive`` languages the code is exhaustive (all ways to split
them in two), beyond that it is a random code of distinct, balanced columns. Decoding weighs
each bit by its classifier's accuracy on the training rows, sums the logistic loss of each
codeword, and takes the language with the smallest; the score is the softmax of the losses.
A text whose two best losses are closer than ``margin`` is ambiguous.

Training rows are bounded: at most ``per_language`` labelled rows of each language, those
with the smallest digests of their identifiers, whole texts. That bound is the only one;
prediction reads whole texts of all rows and nothing but the text. Which rows these are follows
from counts by digest: all rows below the digest range where the bound is met, and the first of that range.

Defined results: a text that is null or has no letter is ``und`` with score 0; with no
labelled row everything is; with one language everything with a letter is that one; of languages
with equal losses the first by code point; very long texts are read whole; rows that repeat are
predicted each, and learnt from once; null identifiers are kept, and never learnt from; an empty
table gives no rows; other columns are not read but for those in ``keep``, of which one with the
name of a result gives way to it.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbora.llm.common import in_slices

DIM = 1 << 13
_MULT = np.uint32(0x9E3779B1)
#: ASCII characters that are no letters become blanks.
_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def features(text: str, dim: int = DIM) -> np.ndarray:
    """Relative frequencies of hashed n-grams, by square root and scaled to length 1."""
    letters = text.encode("utf-8", "replace").translate(_LETTERS).decode()
    codes = np.frombuffer(f" {' '.join(letters.lower().split())} ".encode("utf-32-le"), np.uint32)
    out, h = np.zeros(dim, np.float32), np.zeros(len(codes), np.uint32)
    for n in range(1, 4):
        if len(codes) < n:
            break
        h = (h[: len(codes) - n + 1] * np.uint32(31) + codes[n - 1 :]) * _MULT
        h ^= h >> np.uint32(15)
        out += np.bincount(h & np.uint32(dim - 1), minlength=dim).astype(np.float32)
    np.sqrt(out, out)
    return out / max(float(np.linalg.norm(out)), 1e-9)


def codewords(n: int, exhaustive: int = 6, seed: int = 5) -> np.ndarray:
    """n codewords of bits +1 and -1, as rows."""
    if n == 1:
        return np.ones((1, 1), np.int8)
    if n <= exhaustive:
        return _exhaustive(n)
    rng, bits = np.random.default_rng(seed), int(np.ceil(15 * np.log2(n)))
    cols: list[np.ndarray] = []
    while len(cols) < bits:
        col = np.where(rng.permutation(n) < n // 2, 1, -1).astype(np.int8)
        if not any(abs(int(col @ c)) == n for c in cols):
            cols.append(col)
    return np.stack(cols, 1)


def _exhaustive(n: int) -> np.ndarray:
    """All splits of n languages in two, the first always on the same side."""
    cols = [[1, *(1 if k >> i & 1 else -1 for i in range(n - 1))] for k in range(2 ** (n - 1) - 1)]
    return np.array(cols, np.int8).T


class Model:
    """langs, their codewords, and for each bit a linear classifier and its weight."""

    def __init__(self, langs: list[str], code: np.ndarray, weights: np.ndarray, bias: np.ndarray, trust: np.ndarray):
        self.langs, self.code, self.weights, self.bias, self.trust = langs, code, weights, bias, trust

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of feature rows: index of the language, score, gap between the two best losses."""
        f = x @ self.weights + self.bias
        loss = np.logaddexp(0, -f[:, None, :] * self.code[None]) @ self.trust
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        best = loss.argmin(1)
        two = np.sort(loss, 1)[:, :2]
        gap = two[:, 1] - two[:, 0] if loss.shape[1] > 1 else np.full(len(x), np.inf)
        return best, p[np.arange(len(x)), best], gap


def fit(texts: list[str], langs: list[str], rounds: int = 120, rate: float = 20.0, decay: float = 1e-4) -> Model | None:
    names = sorted(set(langs))
    if not names:
        return None
    code = codewords(len(names))
    x = np.zeros((len(texts), DIM), np.float32)
    for i, t in enumerate(texts):
        x[i] = features(t)
    y = code[[names.index(v) for v in langs]].astype(np.float32)
    share = np.bincount([names.index(v) for v in langs], minlength=len(names))
    each = (1 / share)[[names.index(v) for v in langs]].astype(np.float32)
    each /= each.sum()
    w, b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    for step in range(rounds):  # full-batch gradient of the logistic loss, languages weighing alike
        g = -y / (1 + np.exp(np.clip(y * (x @ w + b), -30, 30))) * each[:, None]
        now = rate / (1 + step / rounds)
        w -= now * (x.T @ g + decay * w)
        b -= now * g.sum(0)
    right = (np.sign(x @ w + b) == y).T @ each
    trust = np.maximum(right - 0.5, 1e-3)
    return Model(names, code, w, b, (trust / trust.sum() * y.shape[1]).astype(np.float32))


def held_out(id_: Column) -> Column:
    """Identifiers whose CRC-32, as text, leaves 2 by 4 are never learnt from; neither are null ones."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 1000) -> Model | None:
    d = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    d = d.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    # which rows: without their texts, and without bringing a language together
    narrow = d.select("id", "lang", F.xxhash64("id").alias("at")).distinct().withColumn("bin", F.shiftright("at", 64 - 10))
    bins = narrow.groupBy("lang", "bin").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("lang").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0))).where(F.col("before") < per_language)
    some = narrow.join(F.broadcast(bins), ["lang", "bin"])  # at most 1024 bins a language
    whole, cut = F.col("before") + F.col("rows") <= per_language, Window.partitionBy("lang", "bin").orderBy("at", "id")
    last = some.where(~whole).withColumn("n", F.row_number().over(cut)).where(F.col("before") + F.col("n") <= per_language)
    chosen = some.where(whole).select("id", "lang").unionByName(last.select("id", "lang"))
    rows = d.join(F.broadcast(chosen), ["id", "lang"], "left_semi").dropDuplicates(["id"]).orderBy("id").collect()
    return fit([r["text"] for r in rows], [r["lang"] for r in rows])


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), margin: float = 0.05) -> DataFrame:
    """Adds lang_pred, score, ambiguous to the columns named in ``keep`` and the identifier."""
    known = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # as large as the model, whatever the corpus
    made = ["lang_pred", "score", "ambiguous"]
    names = [n for n in dict.fromkeys([id_col, *keep]) if n not in made]
    text = "_" * max(map(len, names)) + "_text"  # longer than any name that is kept
    schema = docs.select(*names).schema
    for field in ("lang_pred string", "score double", "ambiguous boolean"):
        schema = schema.add(*field.split())

    def scan(batches):
        m = pickle.loads(known.value)
        for b in in_slices(batches, 256):
            texts = b.column(b.num_columns - 1).to_pylist()
            lang, score, unsure = ["und"] * len(texts), [0.0] * len(texts), [False] * len(texts)
            rows = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if m else []
            if rows:
                best, p, gap = m.decode(np.stack([features(texts[i]) for i in rows]))
                for i, k, s, g in zip(rows, best.tolist(), p.tolist(), gap.tolist(), strict=True):
                    lang[i], score[i], unsure[i] = m.langs[k], min(1.0, max(0.0, s)), g < margin
            cols = [*b.columns[:-1], pa.array(lang), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, [*names, *made])

    return docs.select(*names, F.col(text_col).cast("string").alias(text)).mapInArrow(scan, schema)
