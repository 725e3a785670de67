"""Quality classifier: regularised quadratic discriminant over transformed statistics of whole texts.

Statistics are counted on the text's UTF-8 bytes with numpy and transformed (logs, square roots of shares).  Each class gets a mean and a
covariance from sums over all labelled training rows (map-side partial sums, a few hundred numbers reach the driver); the covariance is
shrunk towards the pooled one and then towards a multiple of the identity.  The score is the logistic of the difference of the two
log densities, each a Mahalanobis distance by the class's cached Cholesky factor plus its log determinant and log prior, divided by a
constant TEMPERATURE: the statistics aren't independent Gaussians, so undivided odds would be too sure. It moves no decision at 0.5.

Defined cases: null and empty texts have the statistics of an empty text and are scored like any other; label rows with a null id or label, or of
another label than 0 and 1, teach nothing; repeated label rows count as often as they occur; if fewer than two classes have training rows, the
score is the share of 1 among them (0.5 without any). An empty table gives no rows. Other columns are ignored. A text is held whole, with
some 45 bytes of memory a byte while its statistics are counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import FINE_BYTES, bounded, fold, kept, list_array, slices, sums, table, utf8, written

STATISTICS = ("log_bytes", "word_bytes", "upper", "digit", "comma_stop", "symbol", "bang", "bar", "non_ascii", "line_words", "repeat_byte", "runs_of_symbols", "entropy", "repeated_lines", "short_words")
D = len(STATISTICS)
#: A short text's shares are mostly chance: each statistic but the first is drawn towards a typical value, half way at HALF bytes.
HALF = 200
#: The log odds are divided by this before they become a score.
TEMPERATURE = 2.0
TYPICAL = np.array([1.8, 0.14, 0.0, 0.17, 0.0, 0.0, 0.0, 0.1, 4.0, 0.14, 0.0, 2.9, 0.0, 0.35])


def _kinds() -> np.ndarray:
    """Kinds of bytes as columns of a 256-row table."""
    b = np.arange(256)
    space = (b == 32) | ((b >= 9) & (b <= 13))
    upper, lower, digit = (b >= 65) & (b <= 90), (b >= 97) & (b <= 122), (b >= 48) & (b <= 57)
    stop = np.isin(b, list(b".,;:'\"()-?"))
    bang, bar = b == 33, b == 124
    symbol = (b > 32) & (b < 127) & ~(upper | lower | digit | stop | bang | bar)
    return np.stack([space, upper, digit, stop, symbol, bang, bar, b >= 128, b == 10], 1).astype(np.uint8)


KINDS = _kinds()


def statistics(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The transformed statistics of each text, given all bytes and the texts' offsets."""
    n = np.diff(at)
    rows = len(n)
    own = np.repeat(np.arange(rows), n)
    # Counts of each byte value of each text, from which every share follows.
    hist = np.zeros((rows, 256), np.int64)
    for a in range(0, rows, 4096):
        b = min(a + 4096, rows)
        part = (own[at[a] : at[b]] - a) * 256 + data[at[a] : at[b]]
        hist[a:b] = np.bincount(part, minlength=(b - a) * 256).reshape(b - a, 256)
    c = hist @ KINDS.astype(np.int64)
    space = KINDS[:, 0].astype(bool)[data]
    first = np.ones(len(data), bool)
    if len(data):
        first[1:] = space[:-1]
        first[at[:-1][n > 0]] = True
    words = sums((first & ~space).astype(np.int64), at)
    same = np.zeros(len(data), bool)
    if len(data):
        same[1:] = (data[1:] == data[:-1]) & (own[1:] == own[:-1])
    sym = KINDS[:, 4].astype(bool)[data]
    repeat, runs = sums(same.astype(np.int64), at), sums((same & sym).astype(np.int64), at)
    p = hist / np.maximum(n, 1)[:, None]
    entropy = -(p * np.log(np.maximum(p, 1e-12))).sum(1)
    # Lines as random-weight sums of their bytes by place: equal lines have equal sums.
    lines, again = c[:, 8] + (n > 0), np.zeros(rows)
    if len(data):
        new = np.flatnonzero(data == 10) + 1
        cut = np.unique(np.r_[at[:-1][n > 0], new[new < len(data)]])
        ends = np.r_[cut[1:], len(data)]
        place = np.arange(len(data)) - np.repeat(cut, ends - cut)
        mixed = (data.astype(np.uint64) + np.uint64(1)) * ((place.astype(np.uint64) * np.uint64(2) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        mixed ^= mixed >> np.uint64(29)
        code = np.add.reduceat(mixed * np.uint64(0xBF58476D1CE4E5B9), cut)
        long = ends - cut > 20
        key = np.stack([own[cut][long].astype(np.uint64), code[long]], 1)
        order = np.lexsort((key[:, 1], key[:, 0]))
        key = key[order]
        dup = np.r_[False, (key[1:] == key[:-1]).all(1)] if len(key) else np.zeros(0, bool)
        again = np.bincount(key[:, 0].astype(np.int64), weights=dup, minlength=rows)[:rows]
    size, w = np.maximum(n, 1), np.maximum(words, 1)
    trust = n / (n + HALF)
    short = sums(_short(space, first, at), at) / w
    share = lambda x: np.sqrt(x / size)
    measured = np.stack([np.log((n - c[:, 0] + 1) / w), share(c[:, 1]), share(c[:, 2]), share(c[:, 3]), share(c[:, 4]), share(c[:, 5]), share(c[:, 6]), share(c[:, 7]), np.log1p(words / np.maximum(lines, 1)), share(repeat), share(runs), entropy, np.sqrt(again / np.maximum(lines, 1)), short], 1)
    return np.concatenate([np.log1p(np.maximum(n, HALF))[:, None], TYPICAL + trust[:, None] * (measured - TYPICAL)], 1)


def _short(space: np.ndarray, first: np.ndarray, at: np.ndarray) -> np.ndarray:
    """1 where a word of at most three bytes starts."""
    start = first & ~space
    if not len(space):
        return start.astype(np.int64)
    end = space.copy()
    edge = np.zeros(len(space) + 1, bool)
    edge[at] = True
    stops = np.flatnonzero(np.r_[end, True] | edge)
    begin = np.flatnonzero(start)
    length = stops[np.searchsorted(stops, begin, side="right")] - begin
    out = np.zeros(len(space), np.int64)
    out[begin[length <= 3]] = 1
    return out


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and x, the array of statistics of the whole text."""
    bounded(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", FINE_BYTES):
            x = statistics(*utf8(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("id"), list_array(x.reshape(-1), np.arange(len(x) + 1) * D, pa.float64())], ["id", "x"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(work, f"id {kind}, x array<double>")


class Discriminant:
    """Two Gaussian classes with shrunk covariances; scores are probabilities of class 1."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]], pool: float = 0.2, ridge: float = 0.02):
        """moments: by class the count, the sums and the sums of products."""
        self.count = {k: m[0] for k, m in moments.items()}
        self.factor = {}
        if len(moments) < 2:
            return
        total = sum(self.count.values())
        mean = sum(m[1] for m in moments.values()) / total
        spread = np.sqrt(np.maximum(sum(np.diag(m[2]) for m in moments.values()) / total - mean**2, 1e-9))
        self.mean, self.spread = mean, spread
        within, cov, centre = np.zeros((D, D)), {}, {}
        for k, (n, s, ss) in moments.items():
            mu = (s / n - mean) / spread
            second = (ss / n - np.outer(s / n, mean) - np.outer(mean, s / n) + np.outer(mean, mean)) / np.outer(spread, spread)
            cov[k], centre[k] = second - np.outer(mu, mu), mu
            within += cov[k] * n / total
        for k, (n, _, _) in moments.items():
            # A class of few rows leans on the pooled covariance more.
            share = max(pool, D / (D + n))
            c = (1 - share) * cov[k] + share * within
            c = (1 - ridge) * c + ridge * np.eye(D) * max(np.trace(c) / D, 1e-3)
            chol = np.linalg.cholesky(c + 1e-9 * np.eye(D))
            self.factor[k] = centre[k], np.linalg.inv(chol), 2 * np.log(np.diag(chol)).sum(), np.log(n / total)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.spread
        dens = {}
        for k, (centre, inv, logdet, prior) in self.factor.items():
            dens[k] = prior - 0.5 * (((z - centre) @ inv.T) ** 2).sum(1) - 0.5 * logdet
        return dens[1] - dens[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.factor:
            n = sum(self.count.values())
            return np.full(len(x), self.count.get(1, 0) / n if n else 0.5)
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x) / TEMPERATURE, -500, 500)))


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", pool: float = 0.2, ridge: float = 0.02) -> Discriminant:
    """Fits on all labelled rows of stats (id, x) whose id isn't held out."""
    l = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("id").isNotNull() & (fold("id", 3) != 1))
    pairs = stats.join(l, "id").select("y", "x")

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = np.zeros((2, 1 + D + D * D))
        for b in batches:
            if not b.num_rows:
                continue
            y = b.column("y").to_numpy()
            x = b.column("x").flatten().to_numpy().reshape(-1, D)
            for k in (0, 1):
                part = x[y == k]
                m[k] += np.concatenate([[len(part)], part.sum(0), (part.T @ part).reshape(-1)])
        k, i = np.nonzero(m)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(i.astype(np.int32)), pa.array(m[k, i])], ["y", "i", "v"])

    found: dict[int, np.ndarray] = {}
    for r in pairs.mapInArrow(moments, "y int, i int, v double").groupBy("y", "i").agg(F.sum("v").alias("v")).collect():  # 2 (1 + D + D^2) rows at most
        found.setdefault(r.y, np.zeros(1 + D + D * D))[r.i] = r.v
    return Discriminant({k: (m[0], m[1 : 1 + D], m[1 + D :].reshape(D, D)) for k, m in found.items()}, pool, ridge)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", pool: float = 0.2, ridge: float = 0.02) -> DataFrame:
    """id, held_out, score (of label 1), predicted; one row per row of docs."""
    kind = docs.schema[id_col].dataType.simpleString()
    stats = written(text_statistics(docs, id_col, text_col), "quality")
    model = fit(stats, labels, id_col, label_col, pool, ridge)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = model.score(b.column("x").flatten().to_numpy().reshape(-1, D))
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(s)], ["id", "score"])

    scored = stats.mapInArrow(work, f"id {kind}, score double")
    return scored.select(F.col("id").alias(id_col), (fold("id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", least: float = 0.5) -> DataFrame:
    """The rows of docs that score `least` or more, with all their columns."""
    model = fit(written(text_statistics(docs, id_col, text_col), "quality"), labels, id_col, label_col)
    return kept(docs, text_col, lambda text: model.score(statistics(*utf8(text))) >= least)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality"))
