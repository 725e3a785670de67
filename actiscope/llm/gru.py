"""Language-model scoring: a gated recurrent network whose softmax is factored by word classes.

P(word | history) = P(class | state) * P(unit | class, state) * share of the word in its unit; the state is that of a gated recurrent unit that has
read the text so far, by the units of its words.  There are CLASSES classes of WITHIN units: the end of a text and the most frequent words have a
unit each, all other words share HASHED units by their last two bytes and a hash, so the unit of any word, known or not, follows from the word alone.
Inside a shared unit a word's share is (c + a) / (sum of c + a), its smoothed training count; the unit holds one unknown word of mass a.  The
number of units is fixed, as are the state's and the embedding's width; the counts grow with the corpus.

1. Blocks.  Documents are dealt to blocks by a hash of id and text, about BLOCK_BYTES of text each, so neither training nor scores depend on how
   the table is partitioned.  A block is tokenized once and written as a row: the distinct words as 64-bit hashes with their counts in the block's
   training texts, and the texts as indices into those.
2. Counts.  (word, count) rows of the blocks are summed by word, on the map side first.  The HEAD most frequent words' counts are broadcast (a bound
   on the table, whatever the vocabulary); a word of one block only has its whole count there; the few others are looked up by a join.
3. Training.  A first block warms the weights up on the driver; then every block trains a copy on all of its training texts, by truncated
   backpropagation (windows of WINDOW tokens, the state carried from one to the next over stretches of STRETCH words), and the weights are averaged by tokens seen, summed as
   integers so that their order doesn't matter.
4. Scoring.  Documents run through the network in parallel lanes, the state carried through the whole text, so a score is the log-likelihood of
   the complete document.  The joined words' part is added as an exact decimal sum.

Nothing of the corpus reaches the driver but one block, the units' masses, the head's counts, a bit map of fixed size and the weights.

Defined cases: a null text is an empty one and has only its end; a null id has fold 0; repeated rows are scored one by one and counted as often
(equal rows share a block, which is cut where it grows beyond CUT_BYTES). Without training texts N = V = 0, every word is unknown. An empty table
gives no rows. Other columns are ignored. A text is never cut: it is held whole, with some 30 bytes of memory a byte. Words that share a 64-bit
hash would share a count.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import bit_map, bounded, fold, in_map, ragged, slices, sums, table, utf8, written

BLOCK_BYTES = 6 << 20
#: A block is cut into rows where its text exceeds this.
CUT_BYTES = 10 << 20
#: Classes of words, units in each; the units from FIRST_SHARED on are shared by words.
CLASSES, WITHIN = 32, 64
UNITS = CLASSES * WITHIN
FIRST_SHARED = UNITS // 2
END = 0
SMOOTH = 0.1
HIDDEN, EMBED = 16, 16
#: Where the components of each unit's embedding are among all.
EMB_AT = np.arange(UNITS * EMBED).reshape(UNITS, EMBED)
WINDOW = 16
LANES = 384
#: Logits under this size have exponentials that neither overflow nor vanish, so their maximum needn't be taken off.
FAR = 60.0
#: Words of a text that training reads in a row.
STRETCH = 1024
#: One in so many stretches trains the weights, in every block: all of them.
TRAIN_EVERY = 1
#: Words whose counts are broadcast, at most, and the bits of the map of the others that several blocks have (a power of two).
HEAD = 1 << 18
MAP_BITS = 26
#: Weights are averaged as multiples of 1 / QUANTA.
QUANTA = 1 << 20
TOKENS_ROW = "block long, ids array<long>, held array<boolean>, lens array<int>, tokens binary, h array<long>, shared array<short>, c array<int>"


def tokenized(col: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Indices of all words of all texts, the distinct words, and the number of words of each text.

    Words are maximal runs without ASCII white space, A-Z lower-cased.
    """
    data, at = utf8(col)  # a copy without an offset: splitting reads slices wrongly
    whole = pa.LargeStringArray.from_buffers(len(col), pa.py_buffer(np.ascontiguousarray(at)), pa.py_buffer(np.ascontiguousarray(data)))
    lists = pc.ascii_split_whitespace(pc.ascii_lower(whole))
    at, flat = lists.offsets.to_numpy().astype(np.int64), lists.values
    full = pc.greater(pc.binary_length(flat), 0)
    lens = sums(full.to_numpy(zero_copy_only=False).astype(np.int64), at)
    coded = flat.filter(full).dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary, lens


def hashes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word, and the shared unit that it has unless it is frequent: by the last two bytes and the hash."""
    data, at = utf8(words)
    raw, edges = data.tobytes(), at.tolist()
    h = np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in itertools.pairwise(edges)), np.uint64, len(words))
    byte, ends = data.astype(np.int64), at[1:]
    last = byte[ends - 1] * 256 + np.where(ends - at[:-1] > 1, byte[ends - 2], 0)
    group = (last * 40503 >> 5) % (CLASSES - FIRST_SHARED // WITHIN)
    return h.view(np.int64), FIRST_SHARED + group * WITHIN + (h % np.uint64(WITHIN)).astype(np.int64)


def pieces(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """Rows sorted by column b, as (b, number of the piece, its rows); pieces of one b hold about `most` bytes of text, however the batches are cut."""
    name, done, kept, number = None, 0, [], 0

    def all_kept() -> pa.RecordBatch:
        return pa.Table.from_batches(kept).combine_chunks().to_batches()[0]

    for batch in slices(batches, "text", most):
        b = batch.column("b").to_numpy()
        size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        for x in range(len(b)):
            if x and b[x] == b[x - 1] and done < most:
                done += size[x]
                continue
            if x and kept_from < x:
                kept.append(batch.slice(kept_from, x - kept_from))
            if b[x] != name or done >= most:
                if kept:
                    yield name, number, all_kept()
                kept, number = [], number + 1 if b[x] == name else 0
                name, done = b[x], 0
            done += size[x]
            kept_from = x
        kept.append(batch.slice(kept_from))
    if kept:
        yield name, number, all_kept()


def blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row per block, or piece of one: see TOKENS_ROW. tokens are 32-bit indices into h, c counts in training texts."""
    spark = docs.sparkSession
    bounded(spark)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, number, b in pieces(batches, CUT_BYTES):
            tokens, words, lens = tokenized(b.column("text"))
            held = b.column("held").to_numpy(zero_copy_only=False)
            h, shared = hashes(words)
            c = np.bincount(tokens[np.repeat(~held, lens)], minlength=len(h))
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            lists = [one(b.column("id")), one(b.column("held")), one(pa.array(lens.astype(np.int32))), pa.array([tokens.astype("<u4").tobytes()], pa.binary())]
            lists += [one(pa.array(h)), one(pa.array(shared.astype(np.int16))), one(pa.array(c.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays([pa.array([int(name) << 20 | number]), *lists], ["block", "ids", "held", "lens", "tokens", "h", "shared", "c"])

    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), (fold(id_col, 10) == 0).alias("held"))
    total = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-total // BLOCK_BYTES))
    # Tasks of some blocks each; what is in a block doesn't depend on their number.
    tasks = max(-(-total // (64 << 20)), min(count, int(spark.conf.get("spark.sql.shuffle.partitions"))), 1)
    dealt = d.withColumn("hash", F.xxhash64("id", "text")).withColumn("b", F.pmod("hash", F.lit(count)))
    return dealt.repartition(tasks, "b").sortWithinPartitions("b", "hash", "id").select("id", "text", "held", "b").mapInArrow(work, TOKENS_ROW)


class Network:
    """Weights as one vector, so that averaging and Adam are single expressions."""

    SHAPES = {
        "emb": (UNITS, EMBED), "wx": (EMBED, 3 * HIDDEN), "b": (3 * HIDDEN,), "u": (HIDDEN, 3 * HIDDEN),
        "wo": (HIDDEN, CLASSES), "bo": (CLASSES,), "wi": (CLASSES, HIDDEN, WITHIN), "bi": (CLASSES, WITHIN),
    }
    SIZE = sum(int(np.prod(s)) for s in SHAPES.values())

    def __init__(self, flat: np.ndarray | None = None, seed: int = 3):
        self.flat = np.empty(self.SIZE, np.float32)
        if flat is None:
            rng = np.random.default_rng(seed)
            for name, w in self.views(self.flat).items():
                w[...] = 0 if name in ("b", "bo", "bi", "wo", "wi") else rng.standard_normal(w.shape) / np.sqrt(w.shape[0] if name != "emb" else EMBED)
        else:
            self.flat[:] = flat
        self.w = self.views(self.flat)

    @classmethod
    def views(cls, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in cls.SHAPES.items():
            n = int(np.prod(shape))
            out[name], at = flat[at : at + n].reshape(shape), at + n
        return out

    def steps(self, x: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: bool) -> tuple[np.ndarray, tuple]:
        """States (steps, HIDDEN, lanes) after each of the inputs x (steps, lanes); the state is cleared where a text begins.

        keep: also what each step read (embeddings, a row of ones, the state before), its 1 + exp(-r), 1 + exp(-z) and c, and its product with u.
        """
        w, n, k = self.w, HIDDEN, EMBED + 1
        # Signs of r and z are turned in the weights, not in each step.
        sign = np.where(np.arange(3 * n) < 2 * n, np.float32(-1), np.float32(1))
        u = np.ascontiguousarray((w["u"] * sign).T)
        read = np.empty((len(x), k + n if keep else k, x.shape[1]), np.float32)
        read[:, :EMBED], read[:, EMBED] = w["emb"].take(x, axis=0).transpose(0, 2, 1), 1
        fed = np.matmul(np.ascontiguousarray((np.vstack([w["wx"], w["b"]]) * sign).T), read[:, :k])
        out, any_fresh = np.empty((len(x), n, x.shape[1]), np.float32), fresh.any(1).tolist()
        hu_all = np.empty((len(x) if keep else 1, 3 * n, x.shape[1]), np.float32)
        hu, more = hu_all[0], np.empty(out.shape[1:], np.float32)
        for t, (now, rz, c) in enumerate(zip(out, fed[:, : 2 * n], fed[:, 2 * n :], strict=True)):
            if any_fresh[t]:
                h = h * ~fresh[t]
            if keep:
                hu, read[t, k:] = hu_all[t], h
            np.matmul(u, h, out=hu)
            rz += hu[: 2 * n]
            np.exp(rz, out=rz)
            rz += 1
            np.divide(hu[2 * n :], rz[:n], out=more)
            c += more
            np.tanh(c, out=c)
            h = np.subtract(h, c, out=now)
            h /= rz[n:]
            h += c
        return out, (read, fed, hu_all)

    def start_from(self, mass: np.ndarray) -> None:
        """Output biases that give the units' shares of the training words, whatever the state."""
        by_class = np.maximum(mass, 1e-3).reshape(CLASSES, WITHIN)
        self.w["bo"][...] = np.log(by_class.sum(1) / by_class.sum())
        self.w["bi"][...] = np.log(by_class / by_class.sum(1, keepdims=True))

    @staticmethod
    def _softmax(logits: np.ndarray, y: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log-probabilities of y, one a column; exponentials of all logits, in place, and their sums. reach: a bound on the logits' sizes."""
        if not reach < FAR:
            logits -= logits.max(0)
        target = logits[y, np.arange(len(y))]
        e = np.exp(logits, out=logits)
        total = e.sum(0)
        return target - np.log(total), e, total

    def output(self, states: np.ndarray, y: np.ndarray) -> tuple:
        """For units y, sorted by class, after the states (columns): the classes' ranges, both softmaxes, the states with a row of ones."""
        w, cls = self.w, y // WITHIN
        edge = np.searchsorted(cls, np.arange(CLASSES + 1))
        ranges = [(k, slice(edge[k], edge[k + 1])) for k in np.flatnonzero(edge[1:] > edge[:-1]).tolist()]
        s = np.empty((HIDDEN + 1, len(y)), np.float32)
        s[:HIDDEN], s[HIDDEN] = states, 1
        wide = max(1.0, float(states.max(initial=0)), -float(states.min(initial=0)))
        # The biases are weights of the ones.
        wo, wi = np.vstack([w["wo"], w["bo"]]), np.concatenate([w["wi"], w["bi"][:, None]], 1)
        inner = np.empty((WITHIN, len(y)), np.float32)
        for k, part in ranges:
            np.matmul(wi[k].T, s[:, part], out=inner[:, part])
        outer = wo.T @ s
        return ranges, self._softmax(outer, cls, wide * np.abs(wo).sum(0).max()), self._softmax(inner, y % WITHIN, wide * np.abs(wi).sum(1).max()), s

    def log_probs(self, states: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Log-probabilities of the units y after the states (columns)."""
        order = np.argsort((y // WITHIN).astype(np.uint8), kind="stable")
        _, outer, inner, _ = self.output(states.take(order, axis=1), y[order])
        out = np.empty(len(y))
        out[order] = outer[0] + inner[0]
        return out

    def gradient(self, x: np.ndarray, y: np.ndarray, fresh: np.ndarray, live: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient of the mean log loss of one window, back to its first step, and the last state."""
        w, n = self.w, HIDDEN
        states, (read, gates, hu_all) = self.steps(x, fresh, h, True)
        flat = np.zeros(self.SIZE, np.float32)
        g = self.views(flat)
        at = np.flatnonzero(live)
        at = at[np.argsort((y.reshape(-1)[at] // WITHIN).astype(np.uint8), kind="stable")]
        y, weight = y.reshape(-1)[at], np.float32(1 / max(1, len(at)))
        ranges, (_, p, p_sum), (_, q, q_sum), s = self.output(states.transpose(1, 0, 2).reshape(n, -1).take(at, axis=1), y)
        each = np.arange(len(y))
        p *= weight / p_sum
        q *= weight / q_sum
        p[y // WITHIN, each] -= weight
        q[y % WITHIN, each] -= weight
        both = s @ p.T
        g["wo"][...], g["bo"][...] = both[:n], both[n]
        back = p.T @ w["wo"].T
        for k, part in ranges:
            both = s[:, part] @ q[:, part].T
            g["wi"][k], g["bi"][k] = both[:n], both[n]
            back[part] += q[:, part].T @ w["wi"][k].T
        dout = np.zeros((x.size, n), np.float32)
        dout[at] = back
        dout = np.ascontiguousarray(dout.reshape(len(x), -1, n).transpose(0, 2, 1))
        dh, keep, more = np.zeros_like(h), np.empty_like(h), np.empty_like(h)
        # Of one step: gradients of c, r, z before their functions, and of the product with u in c.
        da = np.empty((4 * n, x.shape[1]), np.float32)
        dc, dr, dz, dhc = da.reshape(4, n, -1)
        by_read, by_input, any_fresh = np.zeros((4 * n, read.shape[1]), np.float32), np.empty((*x.shape, EMBED), np.float32), fresh.any(1).tolist()
        wx = np.ascontiguousarray(np.roll(w["wx"], n, 1).T)
        for t in range(len(x) - 1, -1, -1):
            rz, c = gates[t, : 2 * n], gates[t, 2 * n :]
            np.reciprocal(rz, out=rz)
            r, z = rz[:n], rz[n:]
            dh += dout[t]
            np.multiply(dh, z, out=keep)
            np.subtract(dh, keep, out=dc)
            np.multiply(c, c, out=more)
            np.subtract(1, more, out=more)
            dc *= more
            np.subtract(read[t, EMBED + 1 :], c, out=dz)
            dz *= keep
            np.subtract(1, z, out=more)
            dz *= more
            np.multiply(dc, r, out=dhc)
            np.multiply(dhc, hu_all[t, 2 * n :], out=dr)
            np.subtract(1, r, out=more)
            dr *= more
            by_read += da @ read[t].T
            np.matmul(da[: 3 * n].T, wx, out=by_input[t])
            np.matmul(w["u"], da[n:], out=dh)
            dh += keep
            if any_fresh[t]:
                dh *= ~fresh[t]
        by_gate = np.roll(by_read[: 3 * n], -n, 0)  # c, r, z to r, z, c
        g["wx"][...], g["b"][...], g["u"][...] = by_gate[:, :EMBED].T, by_gate[:, EMBED], by_read[n:, EMBED + 1 :].T
        g["emb"][...] = np.bincount(EMB_AT.take(x, axis=0).reshape(-1), by_input.reshape(-1), UNITS * EMBED).reshape(UNITS, EMBED)
        return flat, states[-1]


class Adam:
    def __init__(self, net: Network, rate: float):
        self.net, self.rate, self.m, self.v, self.t = net, rate, np.zeros_like(net.flat), np.zeros_like(net.flat), 0

    def step(self, g: np.ndarray, share: float) -> None:
        """share: how much of the training is done, for the falling rate."""
        size = float(np.sqrt(np.dot(g, g)))
        if size > 1:
            g = g / size
        self.t += 1
        self.m += 0.1 * (g - self.m)
        g = g * g
        g -= self.v
        g *= 0.01
        self.v += g
        rate = self.rate * (1 - 0.9 * share) / (1 - 0.9**self.t)
        # rate * m / (sqrt(v / (1 - 0.99 ** t)) + 1e-6)
        np.multiply(self.v, 1 / (1 - 0.99**self.t), out=g)
        np.sqrt(g, out=g)
        g += 1e-6
        np.divide(self.m, g, out=g)
        g *= rate
        self.net.flat -= g


class Lanes:
    """Texts laid end to end in lanes of about the same length, longest lane first; step after step, without the cells behind a lane's end.

    Of each cell: x, the unit before it (the end, where a text begins), y, its unit (-1 where a text that isn't whole stops), whether a text begins
    there, and its text. width: lanes at each step.
    """

    def __init__(self, units: np.ndarray, lens: np.ndarray, most: int = LANES, whole: np.ndarray | None = None):
        size = lens + 1  # with the end
        total = int(size.sum())
        n = int(max(1, min(most, len(size), total // 64)))
        load = [(0, i) for i in range(n)]
        lane, at = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        for d in np.argsort(-size, kind="stable").tolist():
            used, i = load[0]
            lane[d], at[d] = i, used
            heapq.heapreplace(load, (used + int(size[d]), i))
        length = np.bincount(lane, weights=size, minlength=n).astype(np.int64)
        rank = np.empty(n, np.int64)
        rank[np.argsort(-length, kind="stable")] = np.arange(n)
        length = -np.sort(-length)
        self.width = np.searchsorted(-length, -np.arange(int(length[0])), side="left")
        self.start = np.cumsum(self.width) - self.width
        ends = np.cumsum(size)
        first, inner = ends - size, np.ones(total, bool)
        cell = self.start[np.arange(total) + np.repeat(at - first, size)] + np.repeat(rank[lane], size)
        inner[ends - 1] = False
        y, x = np.full(total, END, np.int16), np.full(total, END, np.int16)
        y[inner] = units
        if whole is not None:
            y[(ends - 1)[~whole]] = -1
        x[1:] = np.maximum(y[:-1], 0)
        x[first] = END
        self.x, self.y, self.fresh, self.doc = np.empty_like(x), np.empty_like(y), np.zeros(total, bool), np.empty(total, np.int32)
        self.x[cell], self.y[cell], self.doc[cell] = x, y, np.repeat(np.arange(len(size), dtype=np.int32), size)
        self.fresh[cell[first]] = True

    def windows(self, steps) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Windows of steps(lanes) steps, of all lanes that their first step has: the first step; x, y (-1 behind a lane's end), fresh and text of each cell."""
        t = 0
        while t < len(self.width):
            n = int(self.width[t])
            of = slice(t, t + steps(n))
            lane = np.arange(n)
            there, cell = lane < self.width[of, None], self.start[of, None] + lane
            if there.all():
                yield t, self.x[cell], self.y[cell], self.fresh[cell], self.doc[cell]
            else:
                cell[~there] = 0
                yield t, np.where(there, self.x[cell], END), np.where(there, self.y[cell], -1), self.fresh[cell] & there, self.doc[cell]
            t = of.stop


def stretches(units: np.ndarray, lens: np.ndarray, most: int = STRETCH, every: int = TRAIN_EVERY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts cut into about equal stretches of at most `most` words: lanes of training are even then, whatever the longest text.

    One in `every` of them: their units, their lengths, and whether the text ends there.
    """
    parts = np.maximum(-(-lens // most), 1)
    of = np.repeat(np.arange(len(lens)), parts)
    j = ragged(np.zeros(len(lens)), parts)
    size = (j + 1) * lens[of] // parts[of] - j * lens[of] // parts[of]
    use = np.arange(len(size)) % every == 0
    return units[np.repeat(use, size)], size[use], (j + 1 == parts[of])[use]


def train(net: Network, adam: Adam, units: np.ndarray, lens: np.ndarray, begin: float = 0.0, end: float = 1.0) -> int:
    """One pass over stretches of the texts; words seen."""
    if not len(lens):
        return 0
    units, lens, whole = stretches(units, lens)
    laid, h = Lanes(units, lens, whole=whole), np.zeros((HIDDEN, LANES), np.float32)
    for t, x, y, fresh, _ in laid.windows(lambda _: WINDOW):
        g, h = net.gradient(x, np.maximum(y, 0), fresh, y >= 0, h[:, : x.shape[1]])
        adam.step(g, begin + (end - begin) * t / len(laid.width))
    return int(lens.sum()) + len(lens)


def likelihood(net: Network, units: np.ndarray, lens: np.ndarray, most: int = 16 * LANES) -> np.ndarray:
    """Natural log-probability of the units of each whole text, its end included; windows of about `most` tokens."""
    h, total = np.zeros((HIDDEN, LANES), np.float32), np.zeros(len(lens))
    for _, x, y, fresh, doc in Lanes(units, lens).windows(lambda n: max(WINDOW, most // n)):
        states, _ = net.steps(x, fresh, h[:, : x.shape[1]], False)
        h = states[-1]
        flat, y, doc = states.transpose(1, 0, 2).reshape(HIDDEN, -1), y.reshape(-1), doc.reshape(-1)
        live = np.flatnonzero(y >= 0)
        if len(live) < len(y):
            flat, y, doc = flat.take(live, axis=1), y[live], doc[live]
        total += np.bincount(doc, weights=net.log_probs(flat, y), minlength=len(lens))
    return total


def units_of(h: np.ndarray, shared: np.ndarray, top: np.ndarray) -> np.ndarray:
    """Unit of each word: its own, if it is one of the most frequent (sorted hashes), else the shared one."""
    if not len(top):
        return shared
    at = np.minimum(np.searchsorted(top, h), len(top) - 1)
    return np.where(top[at] == h, 1 + at, shared)


def _row(row: dict, top: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of all words of a block's texts, lengths, held-out marks."""
    units = units_of(row["h"].to_numpy(), row["shared"].to_numpy().astype(np.int64), top)
    tokens = np.frombuffer(row["tokens"], "<u4")
    return units.astype(np.int16)[tokens], row["lens"].to_numpy().astype(np.int64), row["held"].to_numpy(zero_copy_only=False)


def _rows(b: pa.RecordBatch | pa.Table) -> Iterator[dict]:
    for i in range(b.num_rows):
        yield {n: b.column(n)[i].as_py() if n in ("tokens", "block") else b.column(n)[i].values for n in b.schema.names}


def _training(row: dict, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    units, lens, held = _row(row, top)
    return units[np.repeat(~held, lens)], lens[~held]


def fit(made: DataFrame, top: np.ndarray, mass: np.ndarray, rate: float = 0.01, warm_up: int = 2) -> Network:
    """Weights averaged over all blocks, each of which has trained on all its texts from a common start."""
    made = made.select("block", "held", "lens", "tokens", "h", "shared")
    first = made.agg(F.min("block")).first()[0]
    net = Network()
    net.start_from(mass)
    if first is None:
        return net
    for row in _rows(made.where(F.col("block") == first).toArrow().combine_chunks()):
        adam, texts = Adam(net, 2 * rate), _training(row, top)
        for k in range(warm_up):
            train(net, adam, *texts, k / warm_up, (k + 1) / warm_up)
    begin = net.flat.copy()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(Network.SIZE, np.int64), 0
        for b in batches:
            for row in _rows(b):
                own = Network(begin)
                n = train(own, Adam(own, rate), *_training(row, top))
                total += np.round(own.flat.astype(np.float64) * QUANTA).astype(np.int64) * n
                seen += n
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(Network.SIZE, dtype=np.int32)), pa.array(total), pa.array(np.full(Network.SIZE, seen))], ["i", "w", "n"])

    # Sums of integers: the same in any order, and so for any partitioning.
    parts = made.mapInArrow(work, "i int, w long, n long")
    whole = parts.groupBy("i").agg(F.sum(F.col("w").cast("decimal(38,0)")).alias("w"), F.sum("n").alias("n"))
    got = whole.select("i", (F.col("w").cast("double") / F.col("n")).alias("w")).toArrow()  # Network.SIZE rows
    net.flat[got.column("i").to_numpy()] = got.column("w").to_numpy() / QUANTA
    return net


def counts(made: DataFrame) -> DataFrame:
    """h, shared (its unit, if it isn't frequent), c (in all training texts), several (true if more than one row of made has it)."""
    rows = made.select(F.explode(F.arrays_zip("h", "shared", "c")).alias("w")).select("w.h", "w.shared", F.col("w.c").cast("long").alias("c"))
    by_word = rows.groupBy("h").agg(F.first("shared").alias("shared"), F.sum("c").alias("c"), F.count(F.lit(1)).alias("rows"))
    return by_word.select("h", "shared", "c", (F.col("rows") > 1).alias("several"))


def head_of(counted: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent words, at most `most`: their hashes, ascending, and counts."""
    bucket = F.floor(F.log2("c") * 16).cast("int")
    frequent = counted.where("c > 0")
    by_size = sorted(frequent.groupBy(bucket.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True)  # 16 rows a power of two
    total, least = 0, None
    for r in by_size:
        total += r.n
        if total > most:
            break
        least = r.s
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    got = frequent.where(bucket >= least).select("h", "c").toArrow()
    h, c = got.column("h").to_numpy(), got.column("c").to_numpy()
    order = np.argsort(h)
    return h[order], c[order]


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score; one row per row of docs."""
    spark = docs.sparkSession
    made = written(blocks(docs, id_col, text_col), "lm-blocks")
    counted = written(counts(made), "lm-words")
    known = counted.where("c > 0")
    ends = made.select(F.explode("held").alias("held")).where("NOT held").count()
    top_rows = known.orderBy(F.desc("c"), "h").limit(FIRST_SHARED - 1).select("h", "c", "shared").collect()
    top_rows.sort(key=lambda r: r.h)
    top = np.array([r.h for r in top_rows], np.int64)
    # Mass of each unit: its words' counts, smoothed, and one unknown word where words share it.
    n_known, n_tokens = (1 if ends else 0), ends
    mass = np.zeros(UNITS)
    mass[END] = ends + SMOOTH
    mass[FIRST_SHARED:] = SMOOTH
    for r in known.groupBy("shared").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect():  # UNITS rows at most
        mass[r.shared] += r.c + SMOOTH * r.n
        n_known, n_tokens = n_known + r.n, n_tokens + r.c
    for i, r in enumerate(top_rows):
        mass[1 + i] = r.c + SMOOTH
        mass[r.shared] -= r.c + SMOOTH
    mass[FIRST_SHARED:] = np.maximum(mass[FIRST_SHARED:], SMOOTH)
    net = fit(made, top, mass)
    weights = net.flat
    log_total, log_mass = np.log10(n_tokens + SMOOTH * (n_known + 1)), np.log10(np.where(mass > 0, mass, 1.0))
    # Words beyond the head that several blocks have: their counts aren't known where the texts are.
    head_h, head_c = head_of(counted, HEAD)
    least = int(head_c.min()) if len(head_c) else 0
    others = counted.where(F.col("several") & ~((F.col("c") >= least) & F.lit(bool(len(head_c)))))
    asked = spark.sparkContext.broadcast((head_h, head_c, bit_map(others.select(F.col("h").alias("v")), MAP_BITS)))
    end_count, train_tokens = ends, n_tokens

    def looked_up(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash and count of each word of a block, and whether the count is only the block's."""
        head, count, found = asked.value
        h, c = row["h"].to_numpy(), row["c"].to_numpy().astype(np.int64)
        if not len(h):
            return h, c, np.zeros(0, bool)
        at = np.minimum(np.searchsorted(head, h), max(0, len(head) - 1))
        frequent = head[at] == h if len(head) else np.zeros(len(h), bool)
        return h, np.where(frequent, count[at], c) if len(head) else c, ~frequent & in_map(found, h)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(weights)
        for b in batches:
            for row in _rows(b):
                units, lens, held = _row(row, top)
                _, c, open_ = looked_up(row)
                tokens, at = np.frombuffer(row["tokens"], "<u4"), np.r_[0, np.cumsum(lens)]
                words = sums(np.where(open_, 0.0, np.log10(c + SMOOTH))[tokens], at) + np.log10(end_count + SMOOTH)
                found = sums(((c > 0) & ~open_)[tokens].astype(np.int64), at) + (end_count > 0)
                outside = sums(log_mass[units], at) + log_mass[END]
                del c, open_, tokens
                lp = likelihood(net, units, lens) / np.log(10)
                n = lens + 1
                cols = [pa.array(np.full(len(n), row["block"])), pa.array(np.arange(len(n), dtype=np.int32)), row["ids"], pa.array(held), pa.array(n), pa.array(found), pa.array(words - n * log_total), pa.array(words - outside + lp)]
                yield pa.RecordBatch.from_arrays(cols, ["block", "row", "id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in _rows(b):
                h, c, open_ = looked_up(row)
                tokens, lens = np.frombuffer(row["tokens"], "<u4"), row["lens"].to_numpy().astype(np.int64)
                at = np.flatnonzero(open_[tokens])
                if len(at):
                    pair, n = np.unique(np.repeat(np.arange(len(lens)), lens)[at] * len(h) + tokens[at], return_counts=True)
                    i = pair % len(h)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), row["block"])), pa.array((pair // len(h)).astype(np.int32)), pa.array(h[i]), pa.array(n), pa.array(c[i])], ["block", "row", "w", "n", "own"])

    local = made.mapInArrow(scores, "block long, row int, id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    local = written(local, "lm-scores")
    rest = made.select("block", "lens", "tokens", "h", "c").mapInArrow(asking, "block long, row int, w long, n long, own long")
    rest = rest.join(others.select("h", "c"), F.col("w") == F.col("h"), "left").withColumn("c", F.coalesce("c", "own"))
    # Decimals: their sum is the same in any order.
    part = F.sum((F.col("n") * F.log10(F.col("c") + F.lit(SMOOTH))).cast("decimal(30,12)")).cast("double")
    rest = rest.groupBy(F.col("block").alias("r_block"), F.col("row").alias("r_row")).agg(part.alias("words"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("found"))
    out = local.join(rest, (F.col("block") == F.col("r_block")) & (F.col("row") == F.col("r_row")), "left")
    more = F.coalesce("words", F.lit(0.0))
    return out.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("found", F.lit(0))).alias("n_known"), F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + more).alias("base_score"), (F.col("score") + more).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"))
