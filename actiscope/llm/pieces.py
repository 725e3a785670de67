"""SentencePiece encoding and decoding: distinct sampled segmentations without replacement.

A text is normalised as the model does (a space in front, spaces as U+2581) and spans a lattice of vocabulary pieces; a character without a piece is
its UTF-8 bytes.  Segmentations have the probability of their pieces' scores to the power alpha, normalised over the lattice by a backward pass.

The k samples are the first k arrivals of a Gumbel process over all segmentations: perturbed A* search, top down.  In the equivalent exponential race a
node of prefix probability P has its first arrival at the same time as its first child's, and its other children's first arrival is later by
Exp(1) / (P * their mass).  So a sample is a walk along conditional probabilities, every node of it leaves one bound behind, that of its
untaken edges, and the next sample starts at the node of the least bound: no bound is computed twice and none is missed.  The walks of all words of
all texts of a slice advance together.  A sample's perturbed log-probability is minus the logarithm of its arrival, the threshold is that of the first
arrival not returned, and the inclusion score is log(1 - exp(-p * exp(-threshold))).

No piece of the vocabulary joins a character to a following U+2581, nor a newline to anything (checked when the model is loaded; if not so, texts aren't
cut), so the lattice is a chain of lattices of words, built once for each distinct word of a slice.

The vocabulary files score pieces by merge rank, not by log-probability: a piece of rank r is given the log-probability -log(r + OFFSET), byte pieces that
of the last rank.  Random numbers are hashes of seed, row key, sample and character position: they don't depend on partitions or batches.

Defined cases: null and empty texts have one segmentation, without pieces, of log-probability and inclusion score 0; a text with fewer than k
segmentations gets all of them, then the inclusion score is 0 (certain). Rows that repeat key and text repeat their samples. A null key is a key of its
own. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import bounded, list_array, ragged, slices, sums, table, utf8
from .jaccard import mix

SPACE = "▁"
OFFSET = 16
P = np.uint64(0x9E3779B97F4A7C15)
SLICE = 512 << 10


class Vocabulary:
    """Pieces of a SentencePiece model file, their log-probabilities and bytes."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        byte = [i for i in range(n) if sp.is_byte(i)]
        skip = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)} | set(byte)
        self.byte = np.array(byte, np.int64)
        if len(byte) != 256:
            raise ValueError("the model has no byte pieces")
        score = np.array([sp.get_score(i) for i in range(n)])
        rank = np.empty(n, np.int64)
        plain = np.array([i for i in range(n) if i not in skip])
        rank[np.r_[plain[np.argsort(-score[plain], kind="stable")], np.array(sorted(skip), np.int64)]] = np.arange(n)
        self.logp = -np.log(np.minimum(rank, len(plain)) + float(OFFSET))
        self.longest = max(len(self.pieces[i]) for i in plain)
        normal = [self.pieces[i] for i in plain]
        self.split = not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in normal)
        # Open addressing over the hashes of all pieces and of all that begin one (id -1).
        known = {c: -1 for p in normal for c in _codes(p)} | {_codes(p)[-1]: int(i) for p, i in zip(normal, plain, strict=True)}
        self.mask = (1 << 20) - 1
        self.code, self.id = np.zeros(1 << 20, np.uint64), np.full(1 << 20, -2, np.int64)
        for c, i in known.items():
            at = c & self.mask
            while self.id[at] != -2:
                at = (at + 1) & self.mask
            self.code[at], self.id[at] = c, i
        # Bytes that a piece decodes to.
        raw = [bytes([byte.index(i)]) if i in set(byte) else b"" if i in skip else self.pieces[i].replace(SPACE, " ").encode() for i in range(n)]
        self.raw_at = np.r_[0, np.cumsum([len(r) for r in raw])]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)

    def find(self, code: np.ndarray) -> np.ndarray:
        """Piece ids of hashes of strings; -1 for what only begins a piece, -2 for what doesn't."""
        at = (code & np.uint64(self.mask)).astype(np.int64)
        out = self.id[at]
        left = np.flatnonzero((out != -2) & (self.code[at] != code))
        at = at[left]
        while len(left):
            at = (at + 1) & self.mask
            out[left] = self.id[at]
            go = (out[left] != -2) & (self.code[at] != code[left])
            left, at = left[go], at[go]
        return out

    def decode(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and offsets of the texts of many id sequences, without the space that normalisation puts in front."""
        size = self.raw_at[ids + 1] - self.raw_at[ids]
        data = self.raw[ragged(self.raw_at[ids], size)]
        n = sums(size, at)
        begin = np.r_[0, np.cumsum(n)]
        front = (n > 0) & (data[np.minimum(begin[:-1], max(len(data) - 1, 0))] == 32 if len(data) else False)
        keep = np.ones(len(data), bool)
        keep[begin[:-1][front]] = False
        return data[keep], np.r_[0, np.cumsum(n - front)]


def _codes(word: str) -> list[int]:
    """Hashes of all that the word begins with, itself the last."""
    h, out = 0, []
    for c in word:
        h = ((h + ord(c) + 1) * int(P)) & (1 << 64) - 1
        h ^= h >> 32
        out.append(h)
    return out


@functools.lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Lattice:
    """Lattices of many words: a node per character and one behind each word; edges by node."""

    def __init__(self, v: Vocabulary, words: list[str], alpha: float):
        text = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
        n = np.array([len(w) for w in words], np.int64)
        self.first = np.cumsum(n + 1) - (n + 1)
        total = int((n + 1).sum())
        char = np.zeros(total, np.uint64)
        at = ragged(self.first, n)
        char[at] = text
        left = np.zeros(total, np.int64)  # characters from the node to the word's end
        left[at] = np.repeat(n, n) - (at - np.repeat(self.first, n))
        self.end = self.first + n
        code = np.zeros(len(at), np.uint64)
        node, ids, step = [], [], []
        for size in range(1, v.longest + 1):
            if size > 1:
                use = left[at] >= size
                at, code = at[use], code[use]
            if not len(at):
                break
            code = (code + char[at + size - 1] + np.uint64(1)) * P
            code ^= code >> np.uint64(32)
            found = v.find(code)
            alive, hit = found != -2, found >= 0
            if size == 1:
                # No piece: the bytes of the character, marked by -1 - character.
                found = np.where(hit, found, -1 - char[at].astype(np.int64))
                hit = np.ones(len(at), bool)
            node.append(at[hit].astype(np.int32))
            ids.append(found[hit].astype(np.int32))
            step.append(np.full(len(node[-1]), size, np.int32))
            at, code = at[alive], code[alive]
        # Edges by node, longest first.
        node, ids, step = (np.concatenate([*x[::-1], np.zeros(0, np.int32)]) for x in (node, ids, step))
        order = np.argsort(node, kind="stable")
        node, ids, step = node[order], ids[order], step[order]
        lone = np.flatnonzero(ids < 0)
        w = (alpha * v.logp)[np.maximum(ids, 0)]
        c = -1 - ids[lone]
        w[lone] = alpha * (1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)) * v.logp[v.byte[0]]
        self.start = np.searchsorted(node, np.arange(total + 1))
        degree = np.diff(self.start)
        # Backward pass by distance to the word's end.
        beta = np.zeros(total)
        far = left.astype(np.uint16) if len(left) and left.max() < 1 << 16 else left
        order = np.argsort(far, kind="stable")
        cut = np.searchsorted(far[order], np.arange(1, int(far.max(initial=0)) + 2))
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            if a == b:
                continue
            at, size = order[a:b], degree[order[a:b]]
            e = ragged(self.start[at], size)
            val = w[e] + beta[node[e] + step[e]]
            own = np.cumsum(size) - size
            top = np.maximum.reduceat(val, own)
            val -= np.repeat(top, size)
            beta[at] = top + np.log(np.add.reduceat(np.exp(val), own))
        self.id, self.step, self.node = ids, step, node
        del order
        self.logc = w + beta[node + step] - beta[node]
        self.logc[degree[node] == 1] = 0.0  # no other edge: nothing is left behind
        some = degree > 0
        self.cdf = np.cumsum(np.exp(self.logc))
        before = np.r_[0.0, self.cdf][self.start[:-1][some]]
        self.cdf -= np.repeat(before, degree[some])
        self.cdf[self.start[1:][some] - 1] = 2.0  # the last edge takes what rounding leaves


def uniform(key: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from a key and a counter."""
    return ((mix(key + (at.astype(np.uint64) + np.uint64(1)) * P) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def walk(lat: Lattice, pos: np.ndarray, end: np.ndarray, key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to its word's end, sampled by conditional probability: all edges lane by lane, and how many each lane has."""
    count = np.zeros(len(pos), np.int64)
    seen = []
    live = np.flatnonzero(pos < end).astype(np.int32)
    p, a, k, stop = pos[live], at[live], key[live], end[live]
    while len(live):
        u = uniform(k, a)
        e = lat.start[p]
        more = np.flatnonzero(u > lat.cdf[e])
        while len(more):
            e[more] += 1
            more = more[u[more] > lat.cdf[e[more]]]
        seen.append((live, e.astype(np.int32)))
        count[live] += 1
        step = lat.step[e]
        p, a = p + step, a + step
        go = p < stop
        live, p, a, k, stop = live[go], p[go], a[go], k[go], stop[go]
    begin = np.cumsum(count) - count
    out = np.empty(int(count.sum()), np.int32)
    for t, (lane, e) in enumerate(seen):
        out[begin[lane] + t] = e
    return out, count


def _least(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least value of each range, infinite if empty, and where it is."""
    n = np.diff(at)
    low, where = np.full(len(n), np.inf), np.zeros(len(n), np.int64)
    full = np.flatnonzero(n)
    if len(full):
        low[full] = np.minimum.reduceat(x, at[full])
        hit = np.flatnonzero(x == np.repeat(low, n))
        own = np.searchsorted(at, hit, side="right") - 1
        first = np.r_[True, own[1:] != own[:-1]] if len(hit) else np.zeros(0, bool)
        where[own[first]] = hit[first]
    return low, where


class Path:
    """One sample of each text: edges, offsets by text, and the bounds that its nodes leave behind."""

    def __init__(self, lat: Lattice, edges: np.ndarray, at: np.ndarray, arrival: np.ndarray, key: np.ndarray, fresh: np.ndarray):
        """fresh: the first node of each text whose bound is new; those before are other samples' nodes."""
        self.edges, self.at, self.arrival = edges, at, arrival
        n = np.diff(at)
        own = np.repeat(np.arange(len(n)), n)
        logc = lat.logc[edges]
        run = np.cumsum(logc)
        base = np.r_[0.0, run][at[:-1]]
        self.logp = sums(logc, at)
        phi = run - logc - np.repeat(base, n)
        step = lat.step[edges]
        place = np.cumsum(step) - step
        place -= np.repeat(place[np.minimum(at[:-1], max(len(place) - 1, 0))], n) if len(place) else 0
        self.place, self.phi = place.astype(np.int32), phi
        rest = 1.0 - np.exp(logc)
        gap = -np.log(uniform(key[own] ^ P, place))
        with np.errstate(divide="ignore"):
            later = np.log(gap) - np.log(rest) - phi
        self.bound = np.where((rest > 0) & (np.arange(len(edges)) >= (at[:-1] + fresh)[own]), np.logaddexp(arrival[own], later), np.inf)


def words_of(v: Vocabulary, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Texts (bytes, offsets) as words of the lattice: indices, the distinct words, and the number of words of each text."""
    n = np.diff(at)
    full = n > 0
    to = np.r_[0, np.cumsum(n + full)]
    text = np.full(int(to[-1]), 32, np.uint8)  # a space in front of each text that isn't empty
    text[ragged(to[:-1] + 1, n)] = data
    space, line = text == 32, text == 10
    begin = np.zeros(len(text), bool)
    if v.split:
        begin[1:] = (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
    begin[to[:-1][full]] = True
    cut = np.r_[np.flatnonzero(begin), len(text)].astype(np.int64)
    coded = pa.LargeStringArray.from_buffers(len(cut) - 1, pa.py_buffer(cut), pa.py_buffer(text)).dictionary_encode()
    return coded.indices.to_numpy(), [w.replace(" ", SPACE) for w in coded.dictionary.to_pylist()], sums(begin.astype(np.int64), to)


def samples(v: Vocabulary, data: np.ndarray, text_at: np.ndarray, seeds: np.ndarray, k: int, alpha: float) -> list[tuple]:
    """Of texts (bytes, offsets), for each of at most k samples: texts that have it, ids, offsets, log-probabilities, log arrivals; at last
    the log arrivals of what follows."""
    texts = range(len(text_at) - 1)
    word, distinct, counts = words_of(v, data, text_at)
    lat = Lattice(v, distinct, alpha)
    doc_at = np.r_[0, np.cumsum(counts)]
    owner = np.repeat(np.arange(len(texts)), counts)
    size = lat.end[word] - lat.first[word]
    place = np.cumsum(size) - size
    if len(place):
        place -= np.repeat(place[np.minimum(doc_at[:-1], len(place) - 1)], counts)
    keys = [mix(seeds + np.array([s + 1], np.uint64) * P) for s in range(k + 1)]
    edges, n = walk(lat, lat.first[word], lat.end[word], keys[0][owner], place)
    root = np.log(-np.log(uniform(seeds, np.zeros(len(texts), np.int64))))
    paths = [Path(lat, edges, np.r_[0, np.cumsum(sums(n, doc_at))], root, keys[0], np.zeros(len(texts), np.int64))]
    out, have, gone = [], np.ones(len(texts), bool), {}
    for s in range(1, k + 1):
        last = paths[-1]
        out.append((np.flatnonzero(have), *_ids(v, lat, last.edges, last.at), last.logp, last.arrival))
        found = [_least(p.bound, p.at) for p in paths]
        bound = np.stack([f[0] for f in found])
        which, bound = bound.argmin(0), bound.min(0)
        if s == k:
            break
        have = bound < np.inf
        # Texts that go on: where they leave which path, and by which edge.
        lanes_pos, lanes_end, lanes_at, lanes_doc, heads, keep = [], [], [], [], [], []
        for d in np.flatnonzero(have).tolist():
            p = paths[which[d]]
            x = int(found[which[d]][1][d])
            e = int(p.edges[x])
            node = int(lat.node[e])
            left = gone.setdefault((int(which[d]), x), {e})
            others = [o for o in range(int(lat.start[node]), int(lat.start[node + 1])) if o not in left]
            share = np.cumsum(np.exp(lat.logc[others]))
            u = uniform(keys[s][d : d + 1] ^ np.uint64(7), p.place[x : x + 1])[0]
            o = others[min(int(np.searchsorted(share, u * share[-1], side="right")), len(others) - 1)]
            left.add(o)
            # What is left at this node waits for its next arrival.
            rest = share[-1] - np.exp(lat.logc[o])
            if len(others) > 1 and rest > 0:
                gap = -np.log(uniform(keys[s][d : d + 1] ^ np.uint64(11), p.place[x : x + 1])[0])
                p.bound[x] = np.logaddexp(bound[d], np.log(gap) - np.log(rest) - p.phi[x])
            else:
                p.bound[x] = np.inf
            behind = int(p.place[x]) + int(lat.step[o])
            w = int(doc_at[d]) + int(np.searchsorted(place[doc_at[d] : doc_at[d + 1]], p.place[x], side="right")) - 1
            heads.append((p.edges[p.at[d] : x], o))
            keep.append(x - int(p.at[d]))
            first = np.r_[node + int(lat.step[o]), lat.first[word[w + 1 : doc_at[d + 1]]]]
            lanes_pos.append(first)
            lanes_end.append(lat.end[word[w : doc_at[d + 1]]])
            lanes_at.append(np.r_[behind, place[w + 1 : doc_at[d + 1]]])
            lanes_doc.append(np.full(len(first), d))
        if not heads:
            bound = np.full(len(texts), np.inf)
            break
        doc = np.concatenate(lanes_doc)
        tail, n = walk(lat, np.concatenate(lanes_pos), np.concatenate(lanes_end), keys[s][doc], np.concatenate(lanes_at))
        tail_n = np.bincount(doc, weights=n, minlength=len(texts)).astype(np.int64)
        tail_at = np.r_[0, np.cumsum(tail_n)]
        parts, lens, fresh = [], np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for (head, o), x, d in zip(heads, keep, np.flatnonzero(have).tolist(), strict=True):
            parts += [head, [o], tail[tail_at[d] : tail_at[d + 1]]]
            lens[d], fresh[d] = x + 1 + tail_n[d], x + 1  # the node that was left keeps its bound on the path before
        paths.append(Path(lat, np.concatenate(parts).astype(np.int32), np.r_[0, np.cumsum(lens)], np.where(have, bound, np.inf), keys[s], fresh))
    return [*out, bound]


def _ids(v: Vocabulary, lat: Lattice, edges: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of edges; a character without a piece becomes its byte pieces."""
    ids = lat.id[edges]
    lone = np.flatnonzero(ids < 0)
    if not len(lone):
        return ids, at
    raw = [list(chr(-1 - c).encode()) for c in ids[lone].tolist()]
    size = np.ones(len(ids), np.int64)
    size[lone] = [len(r) for r in raw]
    out = np.repeat(ids, size)
    out[ragged((np.cumsum(size) - size)[lone], size[lone])] = v.byte[np.array([b for r in raw for b in r])]
    return out, np.r_[0, np.cumsum(size)][at]


SAMPLES = "sample int, ids array<int>, log_prob double, perturbed double, log_inclusion double, text_crc32 long"


def encode(docs: DataFrame, model: str, k: int = 2, alpha: float = 0.5, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per text and sample: key, sample (from 1, by arrival), ids, log_prob, perturbed, log_inclusion, text_crc32 (of the text its ids decode to)."""
    bounded(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for b in slices(batches, "text", SLICE):
            *found, after = samples(v, *utf8(b.column("text")), b.column("seed").to_numpy().view(np.uint64), k, alpha)
            for s, (rows, ids, at, logp, arrival) in enumerate(found, 1):
                n = np.diff(at)[rows]
                at = np.r_[0, np.cumsum(n)]  # texts without this sample have no ids
                text, text_at = v.decode(ids, at)
                view = memoryview(np.ascontiguousarray(text))
                crc = [zlib.crc32(view[x:y]) for x, y in zip(text_at[:-1].tolist(), text_at[1:].tolist(), strict=True)]
                # log(1 - exp(-p / arrival rate)): tiny p by its logarithm, certain if nothing is left.
                rate = logp[rows] + after[rows]
                with np.errstate(over="ignore", divide="ignore"):
                    include = np.where(after[rows] == np.inf, 0.0, np.where(rate < -30, rate, np.log(-np.expm1(-np.exp(np.minimum(rate, 700))))))
                cols = [pa.array(np.full(len(rows), s, np.int32)), list_array(ids.astype(np.int32), at, pa.int32()), pa.array(logp[rows]), pa.array(-arrival[rows]), pa.array(include), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(rows)), *cols], ["id", *(x.split()[0] for x in SAMPLES.split(", "))])

    kind = docs.schema[id_col].dataType.simpleString()
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(id_col).isNull()).alias("seed"))
    return d.mapInArrow(work, f"id {kind}, {SAMPLES}").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """The frame with the text of its ids; null ids give a null text, bytes that are no UTF-8 become U+FFFD."""
    names = encoded.columns
    if text_col in names:
        raise ValueError(f"there is a column {text_col} already")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for b in batches:
            ids = b.column(ids_col)
            n = ids.value_lengths().fill_null(0).to_numpy().astype(np.int64)
            data, at = v.decode(ids.flatten().to_numpy().astype(np.int64), np.r_[0, np.cumsum(n)])
            raw = data.tobytes()
            texts = [raw[x:y].decode("utf-8", "replace") if ok else None for x, y, ok in zip(at[:-1], at[1:], ids.is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*names, text_col])

    return encoded.mapInArrow(work, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in encoded.schema)}, `{text_col}` string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
