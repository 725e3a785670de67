"""Language identification: averaged hashed subword embeddings under a linear softmax, trained by stochastic gradient descent.

A text is lower-cased in ASCII, every ASCII byte that is no letter becomes a space, and each window of 3 and of 4 bytes whose second byte is part
of a word is hashed into a row of the embedding table.  The text's vector is the average of its rows, a linear layer and softmax give the
languages' probabilities.  Averaging and the linear layer are both linear, so scoring sums rows of (table x layer), one number per
language and window, over the whole text.

Fitting uses a bounded sample: `per_lang` distinct rows of each language, those with the smallest hashes of id and text among the rows with
language and a fold other than 1; one row a language is broadcast, for a bound on the hash that keeps the others from the shuffle. A fifth of them is kept for calibration: a temperature that minimises the log loss there, and a rejection
threshold below which less than `loss` of the right calibration answers lie, never above `most`.

Defined cases: null texts and texts without a letter are `und` with score 0 and rejected; texts with letters but no window get the prior. A null
id has fold 0. If there is nothing to learn from, as in an empty table, every text is `und`. Repeated rows are answered one by one and teach once.
Other columns are ignored. A text is held whole, with some 40 bytes of memory a byte while it is scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import FINE_BYTES, bounded, fold, kept, slices, sums, table, utf8

BUCKETS = 1 << 15
PAD = 4


def _fold_table() -> np.ndarray:
    t = np.full(256, 32, np.uint8)
    t[65:91] = np.arange(97, 123)
    t[97:123] = np.arange(97, 123)
    t[128:] = np.arange(128, 256)
    return t


FOLDED = _fold_table()


def windows(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each window length: bucket of the window that starts at each byte, BUCKETS where there is none, and offsets by text."""
    n = np.diff(at)
    rows = len(n)
    out = at + PAD * np.arange(rows + 1) + PAD  # each text is followed by PAD spaces, the first also preceded by them
    buf = np.full(int(out[-1]) + PAD, 32, np.uint8)
    place = np.arange(len(data)) + np.repeat(PAD * (np.arange(rows) + 1), n)
    buf[place] = FOLDED[data]
    word = buf != 32
    b = buf.astype(np.uint32)
    starts = np.r_[out[:-1] - 1, len(buf) - PAD - 1]  # a window may begin with the space before the text
    pair = b[:-3] | (b[1:-2] << np.uint32(8)) | (b[2:-1] << np.uint32(16))
    for code in (pair, pair | (b[3:] << np.uint32(24))):
        four = code is not pair
        h = (code * np.uint32(2654435761 if four else 2246822519)) >> np.uint32(17)
        h = np.where(word[1:-2] & (word[2:-1] | word[:-3] | ~np.bool_(four)), h, BUCKETS).astype(np.int32)
        yield h, np.minimum(starts, len(h))


class Model:
    """langs, table of log odds by bucket (one row more, of zeros), bias, temperature, threshold."""

    def __init__(self, langs: list[str], rows: np.ndarray, bias: np.ndarray):
        self.langs, self.bias, self.temperature, self.threshold = langs, bias, 1.0, 0.0
        self.rows = np.vstack([rows, np.zeros((1, rows.shape[1]))]).astype(np.float32)

    def logits(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        total, count = np.zeros((len(at) - 1, len(self.langs))), np.zeros(len(at) - 1)
        for h, starts in windows(data, at):
            total += sums(self.rows[h], starts)
            count += sums((h < BUCKETS).astype(np.int64), starts)
        return total / np.maximum(count, 1)[:, None] + self.bias

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def counted(docs: DataFrame) -> DataFrame:
    """key, lang, buckets, counts: the distinct buckets of each text with their counts, at most BUCKETS of them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", FINE_BYTES):
            data, at = utf8(b.column("text"))
            parts = list(windows(data, at))
            ids, counts = [], []
            for i in range(b.num_rows):
                u, c = np.unique(np.concatenate([h[s[i] : s[i + 1]] for h, s in parts]), return_counts=True)
                ids.append(u[u < BUCKETS])
                counts.append(c[u < BUCKETS])
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("lang"), pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], ["key", "lang", "buckets", "counts"])

    return docs.mapInArrow(work, "key long, lang string, buckets array<int>, counts array<int>")


def descend(rows: list, langs: list[str], dim: int = 12, epochs: int = 12, rate: float = 0.5, seed: int = 7) -> Model:
    """Stochastic gradient descent, one text a step, with a falling rate.

    The layer takes plain gradient steps; each row of the table takes its gradient times a step size of its own, larger (up to 20 / its share)
    where the text has many different windows, as averaging makes those gradients small: a diagonal scaling, not the plain gradient.
    """
    rng = np.random.default_rng(seed)
    emb = (rng.standard_normal((BUCKETS, dim)) / dim).astype(np.float32)
    out = np.zeros((dim, len(langs)), np.float32)
    bias = np.zeros(len(langs), np.float32)
    index = {name: i for i, name in enumerate(langs)}
    data = [(np.asarray(r.buckets, np.int64), np.asarray(r.counts, np.float32), index[r.lang]) for r in rows if len(r.buckets)]
    steps = max(1, epochs * len(data))
    for e in range(epochs):
        for k, i in enumerate(rng.permutation(len(data))):
            ids, c, y = data[i]
            share = c / c.sum()
            x = share @ emb[ids]
            z = x @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            lr = np.float32(rate * (1 - (e * len(data) + k) / steps))
            back = out @ p
            out -= lr * np.outer(x, p)
            bias -= lr * np.float32(0.1) * p
            emb[ids] -= (lr * len(ids) * share / share.max()).clip(max=20 * lr)[:, None] * share[:, None] * back
    return Model(langs, emb @ out, bias)


def calibrate(model: Model, rows: list, loss: float, most: float) -> None:
    """Temperature and rejection threshold from texts that taught nothing."""
    index = {name: i for i, name in enumerate(model.langs)}
    rows = [r for r in rows if len(r.buckets) and r.lang in index]
    if not rows:
        return
    z = np.array([(np.asarray(r.counts) @ model.rows[np.asarray(r.buckets)]) / sum(r.counts) + model.bias for r in rows])
    y = np.array([index[r.lang] for r in rows])
    best = np.inf
    for t in np.geomspace(0.02, 5, 60):
        model.temperature, before = t, model.temperature
        p = np.clip(model.probabilities(z)[np.arange(len(y)), y], 1e-9, 1)
        if (now := -np.log(p).mean()) < best:
            best = now
        else:
            model.temperature = before
    p = model.probabilities(z)
    right = p.argmax(1) == y
    model.threshold = float(min(most, np.quantile(p.max(1)[right], loss))) if right.any() else 0.0


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 400, loss: float = 0.001, most: float = 0.4, seed: int = 7) -> Model | None:
    """The model of all languages that occur with a training row; None if there is none."""
    d = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    pool = d.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("id", 3) != 1)).withColumn("key", F.xxhash64("id", "text"))
    # About 3 * per_lang distinct rows of each language pass a bound on their hash, in the scan: so many, not a language's rows, are shuffled.
    share = F.least(F.lit(1.0), 3.0 * per_lang / F.greatest(F.approx_count_distinct("key"), F.lit(1)))
    bounds = pool.groupBy("lang").agg(share.alias("share")).withColumnRenamed("lang", "b_lang")
    low = pool.join(F.broadcast(bounds), F.col("lang") == F.col("b_lang")).where(F.shiftrightunsigned("key", 11) <= F.col("share") * F.lit(2.0**53))
    # Equal rows teach once, whatever their number.
    low = low.groupBy("lang", "key").agg(F.first("id").alias("id"), F.first("text").alias("text"))
    w = Window.partitionBy("lang").orderBy("key")
    chosen = low.withColumn("n", F.row_number().over(w)).where(F.col("n") <= per_lang)
    rows = counted(chosen.select("id", "lang", "text", "key")).collect()  # per_lang rows a language, each at most BUCKETS numbers
    if not rows:
        return None
    rows.sort(key=lambda r: (r.lang, r.key))
    langs = sorted({r.lang for r in rows})
    kept = [r for i, r in enumerate(rows) if i % 5 == 4]
    model = descend([r for i, r in enumerate(rows) if i % 5 != 4], langs, seed=seed)
    calibrate(model, kept, loss, most)
    return model


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score, rejected; one row per row of docs."""
    bounded(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", FINE_BYTES):
            p = model.probabilities(model.logits(*utf8(b.column("text"))))
            lang = pa.array(model.langs).take(pa.array(p.argmax(1)))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("letter"), lang.cast(pa.string()), pa.array(p.max(1))], ["id", "letter", "lang", "p"])

    # \p{L} is a letter of any script; null texts have none.
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("letter"))
    if model is None:
        out = d.select("id", F.lit(False).alias("letter"), F.lit("und").alias("lang"), F.lit(0.0).alias("p"))
        threshold = 0.0
    else:
        out, threshold = d.mapInArrow(work, f"id {kind}, letter boolean, lang string, p double"), model.threshold
    known = F.col("letter")
    return out.select(
        F.col("id").alias(id_col), F.when(known, F.col("lang")).otherwise("und").alias("lang_pred"),
        F.when(known, F.col("p")).otherwise(0.0).alias("score"), (~known | (F.col("p") < threshold)).alias("rejected"),
    )


def accepted(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of docs that aren't rejected, with all their columns."""
    if model is None:
        return docs.where(F.lit(False))

    def test(text: pa.Array, letter: pa.Array) -> np.ndarray:
        p = model.probabilities(model.logits(*utf8(text))).max(1)
        return letter.to_numpy(zero_copy_only=False).astype(bool) & (p >= model.threshold)

    return kept(docs, text_col, test, {"letter": F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs, fit(docs))
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "rejected")
