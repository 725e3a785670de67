"""FLAC streams in a column: encode 8-bit PCM losslessly, decode it, verify it, seek in it.

A payload of bytes is a mono signal of signed 8-bit samples (byte - 128).  It is cut into frames of BLOCK samples, each a constant, verbatim,
fixed-predictor or linear-predictor subframe with Rice-coded residuals; every frame has the CRC-8 of its header and the CRC-16 of its whole,
the stream has STREAMINFO with the MD5 of the samples and a SEEKTABLE with one point for each frame.  What is decoded is written as PCM blocks with a
table of their offsets (`write_pcm`, `PcmReader`, `pcm_column`).  `decode` handles all frames of many
streams in step, one sample of each frame at a time, so numpy does the Rice unary codes and the predictors of thousands of frames at once;
`decode_range` reads only the frames that hold a range of samples.  Both check sync codes, CRC-8, CRC-16; `decode` also the MD5.

The format is that of the published FLAC specification (RFC 9639); mono streams of 8 bits with fixed block size are read, with any
predictor, partition order and Rice parameter, escape codes too.

Defined cases: a null text is an empty one; the empty payload is padded to one unit like any other, so streams are never empty; the encoder is a
function of the payload, so equal payloads give equal streams; null and repeated ids are rows like others; an empty table gives no rows. Damaged
streams raise ValueError; streams without a seek table, or with one that has only some frames, are walked. Other columns are ignored. A text is
held whole, with some 80 bytes of memory a byte while it is encoded.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField

from .base import binary_array, bounded, fresh, ragged, scratch, slices, sums, table, utf8

BLOCK = 1024
RATE = 8000
PRECISION, SHIFT = 12, 10
#: Predictor coefficients tried for each frame, beside the fixed predictors: running means of the last samples.
MEANS = (4, 8)
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


def _crc_table(poly: int, bits: int) -> np.ndarray:
    crc = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        crc = np.where(crc >> (bits - 1) & 1, (crc << 1) ^ poly, crc << 1) & ((1 << bits) - 1)
    return crc.astype(np.uint32)


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def crc(data: np.ndarray, start: np.ndarray, length: np.ndarray, bits: int) -> np.ndarray:
    """CRCs of many byte ranges, one byte of each at a time."""
    t = CRC8 if bits == 8 else CRC16
    order = np.argsort(-length, kind="stable")
    left = np.searchsorted(-length[order], -np.arange(int(length.max(initial=0))), side="left")
    at, value = start[order].copy(), np.zeros(len(order), np.uint32)
    for n in left:
        v, a = value[:n], at[:n]
        value[:n] = (t[(v >> (bits - 8)) ^ data[a]] ^ (v << 8)) & ((1 << bits) - 1)
        a += 1
    out = np.empty_like(value)
    out[order] = value
    return out


def _number(n: int) -> bytes:
    """A frame number in the UTF-8 like code of frame headers."""
    if n < 128:
        return bytes([n])
    size = next(k for k in range(2, 8) if n < 1 << (5 * k + 1))
    tail = [0x80 | (n >> (6 * i) & 63) for i in range(size - 1)][::-1]
    return bytes([(0xFF00 >> size & 0xFF) | n >> (6 * (size - 1)), *tail])


def _predict(x: np.ndarray, coefficients: tuple[int, ...], shift: int, place: np.ndarray) -> np.ndarray:
    """Residuals; place is the index in the frame, warm-up samples keep their value."""
    order = len(coefficients)
    if not order:
        return x
    guess = np.zeros(len(x), np.int32)
    for i, c in enumerate(coefficients, 1):
        guess[i:] += np.int32(c) * x[:-i]
    return np.where(place >= order, x - (guess >> shift), x)


def _cost(r: np.ndarray, place: np.ndarray, order: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Zigzag residuals, the better of two Rice parameters for each frame, and the bits it takes."""
    z = ((r << 1) ^ (r >> 31)).astype(np.uint32)
    z[place < order] = 0
    n = np.diff(at) - order
    mean = sums(z, at) / np.maximum(n, 1)
    k0 = np.clip(np.floor(np.log2(np.maximum(mean * 0.7, 1))), 0, 13).astype(np.int64)
    best_k, best = k0, None
    for k in (k0, np.minimum(k0 + 1, 14)):
        bits = sums(z >> np.repeat(k, np.diff(at)).astype(np.uint32), at).astype(np.int64) + np.maximum(n, 0) * (k + 1)
        if best is None:
            best = bits
        else:
            best_k, best = np.where(bits < best, k, best_k), np.minimum(bits, best)
    return z, best_k, np.where(n > 0, best, 1 << 40)


def encode(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The streams of many payloads (bytes, offsets): bytes, offsets. No payload may be empty."""
    n_of = np.diff(at)
    frames_of = -(-n_of // BLOCK)
    number = ragged(np.zeros(len(n_of)), frames_of)
    owner = np.repeat(np.arange(len(n_of)), frames_of)
    begin = at[owner] + number * BLOCK
    length = np.minimum(BLOCK, at[owner + 1] - begin)
    fat = np.r_[begin, at[-1]]
    x = data.astype(np.int32) - 128
    place = np.arange(len(x)) - np.repeat(begin, length)
    # Each frame takes the cheapest of the predictors, or is kept verbatim, or is constant.
    choices = [(c, 0, 8 + i) for i, c in enumerate(FIXED[:2])] + [(((1 << SHIFT) // p,) * p, SHIFT, 32 + p - 1) for p in MEANS]
    z, k, bits = _cost(x, place, 0, fat)
    kind = np.full(len(begin), 8)
    order = np.zeros(len(begin), np.int64)
    for c, shift, code in choices[1:]:
        zz, kk, b = _cost(_predict(x, c, shift, place), place, len(c), fat)
        b = b + 8 * len(c) + (9 + PRECISION * len(c) if shift else 0)
        better = b < bits
        each = np.repeat(better, length)
        z, k, bits = np.where(each, zz, z), np.where(better, kk, k), np.minimum(b, bits)
        kind, order = np.where(better, code, kind), np.where(better, len(c), order)
    low, high = np.minimum.reduceat(x, begin), np.maximum.reduceat(x, begin)
    plain = bits + 10 >= 8 * length
    kind, order, k = np.where(plain, 1, kind), np.where(plain, length, order), np.where(plain, 0, k)
    same = low == high
    kind, order = np.where(same, 0, kind), np.where(same, 1, order)
    rice = kind >= 8
    lpc = kind >= 32
    # Where the parts of each frame start, in bits from its begin.
    coded = [_number(i) for i in range(int(number.max(initial=0)) + 1)]
    number_size = np.array([len(c) for c in coded])[number]
    odd = length != BLOCK
    head = 4 + number_size + 2 * odd + 1
    warm = 8 * (head + 1)
    extra = np.where(lpc, 9 + PRECISION * order, 0)
    codes = warm + 8 * order + extra + np.where(rice, 10, 0)
    size_of = np.where(rice[np.repeat(np.arange(len(begin)), length)] & (place >= np.repeat(order, length)), (z >> np.repeat(k, length).astype(np.uint32)) + 1 + np.repeat(k, length), 0)
    body = sums(size_of, fat)
    size = -(-(codes + body) // 8) + 2
    out_at = np.r_[0, np.cumsum(size)]
    bit = np.zeros(int(out_at[-1]) * 8, np.uint8)
    base = out_at[:-1] * 8

    def put(pos: np.ndarray, value: np.ndarray, width: int) -> None:
        for j in range(width):
            bit[pos + j] = value >> (width - 1 - j) & 1

    raw = place < np.repeat(order, length)
    put(np.repeat(base + warm, length)[raw] + 8 * place[raw], x[raw] & 255, 8)
    put(base + 8 * head, kind << 1, 8)
    if lpc.any():
        p = (base + warm + 8 * order)[lpc]
        put(p, np.full(len(p), PRECISION - 1), 4)
        put(p + 4, np.full(len(p), SHIFT), 5)
        for m in MEANS:
            own = p[order[lpc] == m]
            for i in range(m):
                put(own + 9 + PRECISION * i, np.full(len(own), (1 << SHIFT) // m), PRECISION)
    put((base + codes - 4)[rice], k[rice], 4)
    res = np.flatnonzero(size_of)
    running = np.cumsum(size_of)
    first = np.r_[0, running][begin]
    end = running[res] + np.repeat(base + codes - first, length)[res]
    kr, zr = np.repeat(k, length)[res], z[res]
    bit[end - kr - 1] = 1
    for j in range(int(kr.max(initial=0))):
        deep = slice(None) if (kr > j).all() else np.flatnonzero(kr > j)
        bit[end[deep] - 1 - j] = zr[deep] >> np.uint32(j) & np.uint32(1)
    buf = np.packbits(bit)
    del bit
    b0 = out_at[:-1]
    buf[b0], buf[b0 + 1] = 0xFF, 0xF8
    buf[b0 + 2] = np.where(odd, 0x70, 0xA0)
    buf[b0 + 3] = 0x02
    for i, c in enumerate(coded):
        own = b0[number == i]
        for j, v in enumerate(c):
            buf[own + 4 + j] = v
    o = np.flatnonzero(odd)
    buf[(b0 + 4 + number_size)[o]] = (length[o] - 1) >> 8
    buf[(b0 + 5 + number_size)[o]] = (length[o] - 1) & 255
    buf[b0 + head - 1] = crc(buf, b0, head - 1, 8)
    check = crc(buf, b0, size - 2, 16)
    buf[b0 + size - 2], buf[b0 + size - 1] = check >> 8, check & 255
    # One stream after the other: marker, STREAMINFO, SEEKTABLE, frames.
    parts, sizes = [], []
    edge = np.r_[0, np.cumsum(frames_of)]
    signed = (data ^ 0x80).tobytes()
    for i in range(len(n_of)):
        f = slice(edge[i], edge[i + 1])
        a, z_ = out_at[edge[i]], out_at[edge[i + 1]]
        block = min(BLOCK, int(n_of[i]))
        block = max(block, 16)
        info = struct.pack(">HH", block, block) + int(size[f].min()).to_bytes(3, "big") + int(size[f].max()).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | int(n_of[i])).to_bytes(8, "big") + hashlib.md5(signed[at[i] : at[i + 1]]).digest()
        points = np.zeros(int(frames_of[i]), [("s", ">u8"), ("o", ">u8"), ("n", ">u2")])
        points["s"], points["o"], points["n"] = number[f] * BLOCK, b0[f] - a, length[f]
        stream = b"fLaC" + struct.pack(">I", 34) + info + struct.pack(">I", 0x83 << 24 | 18 * len(points)) + points.tobytes() + buf[a:z_].tobytes()
        parts.append(stream)
        sizes.append(len(stream))
    return np.frombuffer(b"".join(parts), np.uint8), np.r_[0, np.cumsum(sizes)].astype(np.int64)


def index(stream: bytes) -> tuple[int, bytes, np.ndarray, int]:
    """Number of samples, MD5, seek points (sample, offset, samples) and where the frames begin."""
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    pos, last, info, points = 4, False, None, None
    while not last:
        if pos + 4 > len(stream):
            raise ValueError("the metadata is cut off")
        kind, size = stream[pos], int.from_bytes(stream[pos + 1 : pos + 4], "big")
        body = stream[pos + 4 : pos + 4 + size]
        if len(body) < size:
            raise ValueError("the metadata is cut off")
        last, pos = kind >= 128, pos + 4 + size
        if kind & 127 == 0:
            info = body
        elif kind & 127 == 3:
            points = np.frombuffer(body, [("s", ">u8"), ("o", ">u8"), ("n", ">u2")])
    if info is None or len(info) < 34:
        raise ValueError("STREAMINFO is missing")
    packed = int.from_bytes(info[10:18], "big")
    if packed >> 41 & 7 or packed >> 36 & 31 != 7:
        raise ValueError("only mono streams of 8 bits are read")
    n = packed & (1 << 36) - 1
    block = int.from_bytes(info[2:4], "big")
    whole = points is not None and len(points) == -(-n // max(block, 1))  # its points are checked where they are used
    return n, info[18:34], points if whole else _walk(stream, pos, n, block), pos


def _walk(stream: bytes, pos: int, n: int, block: int) -> np.ndarray:
    """A seek point for every frame, for streams whose table is absent or has only some: frames follow where sync code, number and checksums agree."""
    buf = np.frombuffer(stream, np.uint8)
    at = np.flatnonzero((buf[pos:-1] == 0xFF) & (buf[pos + 1 :] == 0xF8)) + pos
    starts: list[int] = []
    for c in at.tolist():
        head = _number(len(starts))
        code = stream[c + 2] >> 4
        size = 4 + len(head) + {6: 1, 7: 2}.get(code, 0) + 1
        if stream[c + 4 : c + 4 + len(head)] != head or c + size > len(stream) or crc(buf, np.array([c]), np.array([size]), 8)[0]:
            continue
        if starts and crc(buf, np.array(starts[-1:]), np.array([c - starts[-1]]), 16)[0]:
            continue
        starts.append(c)
    points = np.zeros(len(starts), [("s", ">u8"), ("o", ">u8"), ("n", ">u2")])
    points["s"], points["o"] = np.arange(len(starts)) * block, np.array(starts, np.int64) - pos
    points["n"] = np.minimum(block, n - points["s"].astype(np.int64))
    if len(starts) != -(-n // max(block, 1)):
        raise ValueError("the frames aren't those that STREAMINFO tells of")
    return points


def _frames(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Decodes frames that lie at [start, end) in buf, which has 16 spare bytes: samples one frame after the other, frame lengths."""
    if not ((end - start >= 8) & (buf[start] == 0xFF) & (buf[start + 1] == 0xF8)).all():
        raise ValueError("a frame doesn't start with its sync code")
    if crc(buf, start, end - start, 16).any():  # the CRC of all with the CRC appended is 0
        raise ValueError("a frame's CRC-16 is wrong")
    lead = buf[start + 4]
    number_size = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC, lead < 0xFE], [1, 2, 3, 4, 5, 6], 7)
    code = buf[start + 2] >> 4
    tail = np.select([code == 6, code == 7], [1, 2], 0)
    p = start + 4 + number_size
    length = np.select([code == 6, code == 7, code >= 8, code == 1], [buf[p] + 1, (buf[p].astype(np.int64) << 8) + buf[p + 1] + 1, 1 << code.astype(np.int64), 192], 0)
    length = np.where((code >= 2) & (code <= 5), 576 << (code.astype(np.int64) - 2), length).astype(np.int64)
    head = 4 + number_size + tail + 1
    if crc(buf, start, head, 8).any():
        raise ValueError("a frame header's CRC-8 is wrong")
    kind = (buf[start + head] >> 1 & 63).astype(np.int64)
    if (buf[start + head] & 1).any() or (buf[start + 3] & 0xF9).any() or (~((kind < 2) | ((kind >= 8) & (kind < 13)) | (kind >= 32))).any():
        raise ValueError("a subframe of a kind that isn't read")
    order = np.select([kind == 0, kind == 1, kind < 32], [1, length, kind - 8], kind - 31)
    # 32 bits from each byte on, most significant first.
    word = buf[:-3].astype(np.uint32) << 24 | buf[1:-2].astype(np.uint32) << 16 | buf[2:-1].astype(np.uint32) << 8 | buf[3:]

    def take(pos: np.ndarray, width) -> np.ndarray:
        """Up to 24 bits at each bit position."""
        width = np.asarray(width)
        w = word[pos >> 3] << (pos & 7).astype(np.uint32)
        return np.where(width > 0, w >> ((32 - width) & 31).astype(np.uint32), 0).astype(np.int64)

    signed = lambda v, width: v - (v >> (width - 1) << width)
    # Longer frames first, so that those still running are always the first ones.
    by = np.argsort(-length, kind="stable")
    start, end, length, head, kind, order = (a[by] for a in (start, end, length, head, kind, order))
    out = np.zeros((int(length.max(initial=0)), len(start)), np.int32)
    pos = 8 * (start + head + 1)
    rice = kind >= 8
    for t in range(int(order.max(initial=0))):
        own = np.flatnonzero(order > t)
        out[t, own] = signed(take(pos[own], 8), 8)
        pos[own] += 8
    one = np.flatnonzero(kind == 0)
    out[:, one] = out[0, one]
    # Coefficients of either sort of predictor in one table, newest sample first.
    top = int(order[rice].max(initial=0))
    coef, shift = np.zeros((top, len(start)), np.int64), np.zeros(len(start), np.int64)
    for i in range(1, 5):
        own = np.flatnonzero(kind == 8 + i)
        for j, c in enumerate(FIXED[i] if len(own) else ()):
            coef[j, own] = c
    own = np.flatnonzero(kind >= 32)
    if len(own):
        precision = take(pos[own], 4) + 1
        shift[own] = signed(take(pos[own] + 4, 5), 5)
        pos[own] += 9
        for j in range(int(order[own].max())):
            has = order[own] > j
            part = own[has]
            coef[j, part] = signed(take(pos[part], precision[has]), precision[has])
            pos[part] += precision[has]
    method = np.where(rice, take(pos, 2), 0)
    partitions = np.where(rice, take(pos + 2, 4), 0)
    pos = np.where(rice, pos + 6, pos)
    if (method > 1).any() or (shift < 0).any():
        raise ValueError("a reserved code")
    each = length >> partitions
    run = np.flatnonzero(rice)  # still by falling length
    next_at = np.zeros(len(start), np.int64)  # sample at which the next partition begins
    k, raw = np.zeros(len(start), np.int64), np.full(len(start), -1, np.int64)
    plain = not (partitions > 0).any()
    stop = np.minimum(end * 8, len(word) * 8 - 8)
    for t in range(int(length[run].max(initial=0))):
        run = run[: np.searchsorted(-length[run], -t, side="left")]
        live = run if t >= top else run[order[run] <= t]
        if not len(live):
            continue
        if not plain or t <= top:
            new = live[next_at[live] <= t]
            if len(new):
                width = 4 + method[new]
                k[new] = take(pos[new], width)
                pos[new] += width
                raw[new] = -1
                escape = k[new] == (1 << width) - 1
                if escape.any():
                    e = new[escape]
                    raw[e] = take(pos[e], 5)
                    pos[e] += 5
                next_at[new] = (t // each[new] + 1) * each[new]
        if (pos[live] >= stop[live]).any():
            raise ValueError("a frame's codes run past its end")
        at = pos[live]
        w = word[at >> 3] << (at & 7).astype(np.uint32)
        # Leading zeros: 24 bits at least are valid, floats of 24 bits are exact.
        zeros = 32 - np.frexp((w >> np.uint32(8)).astype(np.float32))[1].astype(np.int64) - 8
        q = zeros.copy()
        far = np.flatnonzero(zeros >= 24)
        while len(far):
            ahead = at[far] + q[far]
            if (ahead >= stop[live][far]).any():
                raise ValueError("a frame's codes run past its end")
            v = word[ahead >> 3] << (ahead & 7).astype(np.uint32)
            more = 24 - np.frexp((v >> np.uint32(8)).astype(np.float32))[1].astype(np.int64)
            q[far] += more
            far = far[more >= 24]
        kl = k[live]
        at += q + 1
        low = take(at, kl)
        z = q << kl | low
        value = (z >> 1) ^ -(z & 1)
        at += kl
        if (esc := raw[live] >= 0).any():
            e = live[esc]
            width = raw[e]
            value[esc] = np.where(width > 0, signed(take(pos[e], width), np.maximum(width, 1)), 0)
            at[esc] = pos[e] + width
        pos[live] = at
        if top:
            guess = np.zeros(len(live), np.int64)
            for j in range(min(top, t)):
                guess += coef[j, live] * out[t - 1 - j, live]
            value += guess >> shift[live]
        out[t, live] = value
    if ((out < -128) | (out > 127)).any():
        raise ValueError("a sample is out of range")
    back = np.empty(len(by), np.int64)
    back[by] = np.arange(len(by))
    lengths = length[back]
    flat = np.ascontiguousarray(out.T.astype(np.int8))[back]
    return flat[np.arange(flat.shape[1])[None, :] < lengths[:, None]], lengths


def decode(streams: list[bytes]) -> list[np.ndarray]:
    """The payload bytes of each stream, verified by all its checksums."""
    heads = [index(s) for s in streams]
    buf = np.frombuffer(b"".join(streams) + bytes(16), np.uint8)
    base = np.r_[0, np.cumsum([len(s) for s in streams])]
    start = np.concatenate([base[i] + h[3] + h[2]["o"].astype(np.int64) for i, h in enumerate(heads)] or [np.zeros(0, np.int64)])
    end = np.concatenate([np.r_[base[i] + h[3] + h[2]["o"][1:].astype(np.int64), base[i + 1]] for i, h in enumerate(heads)] or [np.zeros(0, np.int64)])
    if (start >= end).any() or (end > base[-1]).any():
        raise ValueError("a seek point is out of the stream")
    flat, lengths = _frames(buf, start, end)
    of = np.repeat(np.arange(len(heads)), [len(h[2]) for h in heads])
    ends = np.cumsum(np.bincount(of, weights=lengths, minlength=len(heads)).astype(np.int64))
    out = []
    told = [np.concatenate([h[2][c].astype(np.int64) for h in heads] or [np.zeros(0, np.int64)]) for c in ("s", "n")]
    begins = np.cumsum(lengths) - lengths - np.r_[0, ends][of]
    if (told[0] != begins).any() or (told[1] != lengths).any():
        raise ValueError("a seek point is wrong")
    for i, (n, md5, _, _) in enumerate(heads):
        x = flat[ends[i - 1] if i else 0 : ends[i]]
        if len(x) != n or hashlib.md5(x.tobytes()).digest() != md5:
            raise ValueError("the samples aren't those that were stored")
        out.append(x.view(np.uint8) ^ 0x80)
    return out


def decode_range(stream: bytes, first: int, count: int) -> np.ndarray:
    """`count` samples (as payload bytes) from `first` on, from the frames that hold them alone."""
    n, _, points, base = index(stream)
    last = min(n, first + count)
    if first >= last:
        return np.zeros(0, np.uint8)
    s = points["s"].astype(np.int64)
    a, b = np.searchsorted(s, first, side="right") - 1, np.searchsorted(s, last, side="left")
    at = base + np.r_[points["o"].astype(np.int64), len(stream) - base]
    flat, _ = _frames(np.frombuffer(stream + bytes(16), np.uint8), at[a:b], at[a + 1 : b + 1])
    return flat[first - s[a] : last - s[a]].view(np.uint8) ^ 0x80


PCM = b"PCMBLOCK"


def write_pcm(out, samples: np.ndarray, block: int = BLOCK) -> None:
    """Samples as PCM blocks: magic, number of samples, samples a block, byte offset of each block and of the end (little-endian), blocks."""
    count = -(-len(samples) // block)
    begin = len(PCM) + 12 + 8 * (count + 1)
    offsets = begin + np.minimum(np.arange(count + 1, dtype="<i8") * block, len(samples))
    out.write(PCM + struct.pack("<QI", len(samples), block) + offsets.astype("<i8").tobytes())
    for i in range(count):
        out.write(samples[i * block : (i + 1) * block].tobytes())


class PcmReader:
    """Random access to the blocks that write_pcm wrote: a range is read from the blocks that hold it."""

    def __init__(self, file):
        self.file = file
        file.seek(0)
        head = file.read(len(PCM) + 12)
        if len(head) < len(PCM) + 12 or head[: len(PCM)] != PCM:
            raise ValueError("no PCM blocks")
        self.samples, self.block = struct.unpack("<QI", head[len(PCM) :])
        size = 8 * (-(-self.samples // self.block) + 1)
        table = file.read(size)
        if len(table) < size:
            raise ValueError("the table of PCM blocks is cut off")
        self.offsets = np.frombuffer(table, "<i8")

    def range(self, first: int, count: int) -> np.ndarray:
        last = min(self.samples, first + count)
        if first >= last:
            return np.zeros(0, np.uint8)
        a, b = first // self.block, -(-last // self.block)
        self.file.seek(int(self.offsets[a]))
        want = int(self.offsets[b] - self.offsets[a])
        data = self.file.read(want)
        if len(data) < want:
            raise ValueError("a PCM block is cut off")
        return np.frombuffer(data, np.uint8)[first - a * self.block : last - a * self.block]


def pcm_column(media: DataFrame, media_col: str = "media") -> DataFrame:
    """The rows with `pcm`: the verified samples of each stream as PCM blocks; write it as a table and read ranges by `PcmReader`."""
    name = fresh(media, "pcm")[0]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, media_col, 2 << 20):
            files = [_blocks(x).getvalue() for x in decode(b.column(media_col).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(files, pa.binary())], [*b.schema.names, name])

    ddl = media.schema
    return media.mapInArrow(work, type(ddl)([*ddl.fields, StructField(name, BinaryType())]))


def _blocks(samples: np.ndarray) -> io.BytesIO:
    out = io.BytesIO()
    write_pcm(out, samples)
    return out


def padded(data: np.ndarray, at: np.ndarray, unit: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Payloads with zeros appended up to a positive multiple of the unit."""
    n = np.diff(at)
    size = np.maximum(-(-n // unit), 1) * unit
    to = np.r_[0, np.cumsum(size)]
    out = np.zeros(int(to[-1]), np.uint8)
    out[ragged(to[:-1], n)] = data
    return out, to


def encode_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes and media, the FLAC stream of the text's padded UTF-8 bytes."""
    bounded(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 2 << 20):
            data, at = utf8(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.diff(at)), binary_array(*encode(*padded(data, at)))], ["id", "n_bytes", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(work, f"id {kind}, n_bytes long, media binary")


def features(x: np.ndarray) -> str:
    """Integers of the signal: peak, sum of absolute values, energy, sign changes."""
    v = x.astype(np.int64) - 128
    return f"peak={np.abs(v).max(initial=0)};abs={np.abs(v).sum()};energy={(v * v).sum()};crossings={int(((v[1:] < 0) != (v[:-1] < 0)).sum())}"


def media_report(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Decodes and verifies each stored stream into PCM blocks: lengths, digests and features of what is read back from those.

    A row's blocks live in the task's memory here; `pcm_column` gives them as rows.
    """
    schema = "id {}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string".format(media.schema["id"].dataType.simpleString())
    names = [part.split()[0] for part in schema.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "media", 2 << 20):
            stored = b.column("media").to_pylist()
            read = [(r := PcmReader(_blocks(x))).range(0, r.samples) for x in decode(stored)]
            cols = [[len(x) for x in read], [hashlib.sha256(x.tobytes()).hexdigest() for x in read], [zlib.crc32(x[-64:].tobytes()) for x in read], [len(s) for s in stored], [hashlib.sha256(s).hexdigest() for s in stored], [features(x) for x in read]]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n_bytes"), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names)

    return media.mapInArrow(work, schema).withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "flac")
    media = encode_column(table(spark, sf_dir, "documents").select("doc_id", "text"))
    media.write.option("compression", "zstd").parquet(path)
    return media_report(spark.read.schema(media.schema).parquet(path))
