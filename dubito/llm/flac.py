"""Media columns: FLAC streams in a binary column, written and read in numpy.

The encoder takes bytes as unsigned 8-bit samples (byte 128 is silence), one channel, in
frames of ``BLOCK`` samples. Each frame is a constant, a fixed predictor of order 0 to 4, a
linear predictor of order ``LINEAR`` or plain samples, whichever is smallest, with Rice-coded
residuals. A seek table names every frame where there is more than one. The decoder reads mono
8-bit streams with any fixed or linear predictor, Rice partitions of any order and escaped
partitions; it verifies the CRC-8 and CRC-16 of each frame and the MD5 of all samples, and
returns PCM blocks with their sample offsets. Frames are independent, so those of a batch are
coded side by side. ``store`` writes streams, ``write_blocks`` decoded blocks, as Parquet
(zstd) to a folder that Spark reaches; ``load`` and ``read_samples`` read them, the latter any
range of samples by the offsets of the blocks.

Defined results: null texts are empty texts, whose payload is 64 zero bytes; equal texts have
equal streams; rows that repeat a doc_id get a row each; rows with a null doc_id are left
out. A stream that isn't FLAC, is cut short or fails a checksum raises ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import documents
from .shared import scratch
from .text import Texts, chunks

BLOCK = 4096
RATE = 8000
PAD = 64
#: Order of the linear predictor.
LINEAR = 4
_PRECISION, _SHIFT = 12, 10
_PACKED = {"compression": "zstd", "parquet.compression.codec.zstd.level": "9"}


def _table(poly: int, bits: int) -> np.ndarray:
    out = np.arange(256, dtype=np.int64) << (bits - 8)
    for _ in range(8):
        out = np.where(out >> (bits - 1) & 1, out << 1 ^ poly, out << 1) & ((1 << bits) - 1)
    return out


_CRC8, _CRC16 = _table(0x07, 8), _table(0x8005, 16).astype(np.uint16)
_far = np.zeros((0, 256), np.uint16)


def _crc16(raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-16 of pieces of raw: what each byte adds depends on its distance to the end alone."""
    global _far
    most = int(size.max(initial=1))
    if len(_far) < most:
        rows = [_CRC16] if not len(_far) else [_far[-1]]
        for _ in range(most - max(1, len(_far))):
            rows.append((rows[-1] << np.uint16(8)) ^ _CRC16[rows[-1] >> np.uint16(8)])
        _far = np.stack(rows) if not len(_far) else np.concatenate([_far, np.stack(rows[1:])])
    total = np.cumsum(size)
    within = np.arange(int(size.sum())) - np.repeat(total - size, size)
    part = _far[np.repeat(size - 1, size) - within, raw[within + np.repeat(begin, size)]]
    return np.bitwise_xor.reduceat(part, total - size) if len(size) else np.zeros(0, np.uint16)


def _crc8(raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    out = np.zeros(len(begin), np.int64)
    for i in range(int(size.max(initial=0))):
        out = np.where(i < size, _CRC8[out ^ raw[np.minimum(begin + i, len(raw) - 1)]], out)
    return out


def _predictors(lag: np.ndarray) -> np.ndarray:
    """Coefficients of the linear predictor of each frame, by Levinson's recursion. lag: autocorrelations, one row for each distance."""
    order = len(lag) - 1
    a, error = np.zeros((order, lag.shape[1])), lag[0].copy()
    for i in range(order):
        live = error > 1e-9 * np.maximum(lag[0], 1)
        k = np.where(live, (lag[i + 1] - (a[:i] * lag[i:0:-1]).sum(0)) / np.where(live, error, 1), 0)
        a[:i] -= k * a[:i][::-1].copy()
        a[i] = k
        error *= 1 - k * k
    return a


def _numbers(n: np.ndarray) -> list[bytes]:
    """Frame numbers in the extended UTF-8 of the format."""
    out = []
    for x in n.tolist():
        if x < 128:
            out.append(bytes([x]))
            continue
        tail = []
        room = 0x3F
        while x > room:
            tail.append(0x80 | x & 0x3F)
            x >>= 6
            room >>= 1
        out.append(bytes([(0xFF ^ (room * 2 + 1)) & 0xFF | x, *tail[::-1]]))
    return out


def _fill(words: np.ndarray, at: np.ndarray, value: np.ndarray, n: np.ndarray) -> None:
    """Writes values of n bits at ascending bit places that don't overlap."""
    if not len(at):
        return
    word, room = at >> 6, 64 - (at & 63) - n
    over = np.flatnonzero(room < 0)
    spill = value[over] << (64 + room[over]).astype(np.uint64)
    value[over] >>= (-room[over]).astype(np.uint64)
    room[over] = 0
    value <<= room.astype(np.uint64)
    head = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    words[word[head]] |= np.bitwise_or.reduceat(value, head)
    words[word[over] + 1] |= spill


def encode(payloads: list[np.ndarray]) -> list[bytes]:
    """FLAC streams of byte arrays, none of them empty."""
    size = np.array([len(p) for p in payloads], np.int64)
    raw = np.concatenate(payloads)
    frames = -(-size // BLOCK)
    doc = np.repeat(np.arange(len(size)), frames)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(frames) - frames, frames)
    begin = number * BLOCK + (np.cumsum(size) - size)[doc]
    length = np.minimum(BLOCK, size[doc] - number * BLOCK)
    x = raw.astype(np.int16) - np.int16(128)
    frame_of = np.repeat(np.arange(len(doc), dtype=np.int32), length)

    # The predictor that leaves the smallest residuals, without the samples that warm it up. What
    # a frame's neighbours hold must not count, so that equal texts have equal streams.
    def left(residual: np.ndarray, order: int) -> np.ndarray:
        size = np.abs(residual)
        for j in range(order):
            size[begin[length > j] + j] = 0
        return np.add.reduceat(size, begin, dtype=np.int64)

    cost = [left(x, 0)]
    d = x
    for o in range(1, 5):
        d = np.r_[d[:1], d[1:] - d[:-1]]
        cost.append(left(d, o))
    f = x.astype(np.float32)
    lag, last = [], begin + length - 1
    for j in range(LINEAR + 1):
        product = np.r_[f[j:] * f[: len(f) - j], np.zeros(min(j, len(f)), np.float32)]
        for i in range(j):
            product[(last - i)[length > i]] = 0
        lag.append(np.add.reduceat(product, begin, dtype=np.float64))
    lag = np.stack(lag)
    c = np.clip(np.rint(_predictors(lag) * (1 << _SHIFT)), -(1 << _PRECISION - 1), (1 << _PRECISION - 1) - 1).astype(np.int32)
    guess = np.zeros(len(x), np.int32)
    for j in range(LINEAR):
        guess[j + 1 :] += c[j][frame_of[j + 1 :]] * x[: len(x) - j - 1]
    linear = x - (guess >> _SHIFT)
    cost.append(left(linear, LINEAR) + 16)
    kind = np.argmin(np.where(length[:, None] > [0, 1, 2, 3, 4, LINEAR], np.stack(cost, 1), np.iinfo(np.int64).max), 1)
    best = x.astype(np.int32)
    d = best
    for o in range(1, 6):
        d = linear if o == 5 else np.r_[d[:1], d[1:] - d[:-1]]
        if (kind == o).any():
            here = (kind == o)[frame_of]
            best[here] = d[here]
    kind = np.where(kind == 5, 31 + LINEAR, kind)

    lpc = kind > 31
    order = np.where(lpc, LINEAR, kind)
    warm_up = max(4, LINEAR)
    u = best << 1 ^ best >> 31
    for j in range(warm_up):
        u[begin[order > j] + j] = 0
    n_coded = length - order
    mean = np.add.reduceat(u, begin, dtype=np.int64) / np.maximum(n_coded, 1)
    k = np.searchsorted(2.0 ** (np.arange(1, 15) - 0.5), mean * 0.69, "right").astype(np.int32)
    k_of = k[frame_of]
    zeros = u >> k_of
    code_bits = zeros + k_of + 1
    for j in range(warm_up):
        code_bits[begin[order > j] + j] = 0
    extra = np.where(lpc, 4 + 5 + LINEAR * _PRECISION, 0)
    bits = 8 + 8 * order + extra + 10 + np.add.reduceat(code_bits, begin, dtype=np.int64)
    low, high = np.minimum.reduceat(x, begin), np.maximum.reduceat(x, begin)
    flat, plain = low == high, (bits >= 8 + 8 * length) & (low < high)
    bits = np.where(flat, 16, np.where(plain, 8 + 8 * length, bits))
    rice = ~flat & ~plain

    # Headers.
    names = _numbers(number)
    heads = []
    for i, name in enumerate(names):
        full = length[i] == BLOCK
        heads.append(bytes([0xFF, 0xF8, 0xC0 if full else 0x70, 0x02]) + name + (b"" if full else struct.pack(">H", length[i] - 1)))
    head_size = np.array([len(h) for h in heads], np.int64)
    frame_size = head_size + 1 + (bits + 7) // 8 + 2
    seek_size = np.where(frames > 1, 4 + 18 * frames, 0)
    prefix = 4 + 4 + 34 + seek_size
    stream_size = prefix + np.bincount(doc, frame_size, len(size)).astype(np.int64)
    stream_at = np.cumsum(stream_size) - stream_size
    in_doc = np.cumsum(frame_size) - frame_size
    in_doc -= in_doc[np.cumsum(frames) - frames][doc]
    at = stream_at[doc] + prefix[doc] + in_doc
    sub = at + head_size + 1

    words = np.zeros(int(stream_size.sum()) // 8 + 2, np.uint64)
    first = sub * 8 + 8 + 8 * order + extra + 10
    code_end = np.cumsum(code_bits, dtype=np.int64)
    here = code_bits > 0
    if not rice.all():
        here &= rice[frame_of]
    shift = first - (code_end - code_bits)[begin]
    n_bits = (k_of + 1)[here]
    value = ((1 << k_of) | (u & ((1 << k_of) - 1)))[here].astype(np.uint64)
    _fill(words, (code_end + shift[frame_of])[here] - n_bits, value, n_bits)

    def put(where: np.ndarray, value: np.ndarray, n: int) -> None:
        room = 64 - (where & 63) - n
        v = value.astype(np.uint64)
        np.bitwise_or.at(words, where >> 6, np.where(room >= 0, v << np.maximum(room, 0).astype(np.uint64), v >> np.maximum(-room, 0).astype(np.uint64)))
        over = room < 0
        np.bitwise_or.at(words, (where >> 6)[over] + 1, v[over] << (64 + room[over]).astype(np.uint64))

    code = np.where(flat, 0, np.where(plain, 1, np.where(lpc, kind, 8 + kind)))
    put(sub * 8, code << 1, 8)
    put(sub[flat] * 8 + 8, x[begin[flat]] & 255, 8)
    for j in range(warm_up):
        warm = rice & (order > j)
        put(sub[warm] * 8 + 8 + 8 * j, x[begin[warm] + j] & 255, 8)
    lpc &= rice
    behind = sub[lpc] * 8 + 8 + 8 * LINEAR
    put(behind, np.full(lpc.sum(), _PRECISION - 1), 4)
    put(behind + 4, np.full(lpc.sum(), _SHIFT), 5)
    for j in range(LINEAR):
        put(behind + 9 + j * _PRECISION, c[j][lpc] & ((1 << _PRECISION) - 1), _PRECISION)
    put(first[rice] - 4, k[rice], 4)
    out = words.astype(">u8").view(np.uint8)
    for i in np.flatnonzero(plain).tolist():
        out[sub[i] + 1 : sub[i] + 1 + length[i]] = raw[begin[i] : begin[i] + length[i]] ^ 0x80
    flat_heads = np.frombuffer(b"".join(heads), np.uint8)
    total = np.cumsum(head_size)
    out[np.arange(len(flat_heads)) - np.repeat(total - head_size, head_size) + np.repeat(at, head_size)] = flat_heads
    out[at + head_size] = _crc8(out, at, head_size)
    crc = _crc16(out, at, frame_size - 2)
    out[at + frame_size - 2], out[at + frame_size - 1] = crc >> 8, crc & 255

    streams, f = [], 0
    ends = np.cumsum(size)
    for i in range(len(size)):
        g = f + int(frames[i])
        s, n = int(stream_at[i]), int(size[i])
        block = int(length[f:g].max())
        packed = RATE << 44 | 0 << 41 | 7 << 36 | n
        md5 = hashlib.md5((raw[ends[i] - n : ends[i]] ^ 0x80).tobytes()).digest()
        info = struct.pack(">HH", block if g - f == 1 else BLOCK, block) + int(frame_size[f:g].min()).to_bytes(3, "big") + int(frame_size[f:g].max()).to_bytes(3, "big") + packed.to_bytes(8, "big") + md5
        points = b"".join(struct.pack(">QQH", b * BLOCK, o, w) for b, o, w in zip(number[f:g].tolist(), in_doc[f:g].tolist(), length[f:g].tolist(), strict=True))
        seek = bytes([0x83]) + len(points).to_bytes(3, "big") + points if g - f > 1 else b""
        head = b"fLaC" + bytes([0 if seek else 0x80]) + (34).to_bytes(3, "big") + info + seek
        streams.append(head + out[s + len(head) : s + int(stream_size[i])].tobytes())
        f = g
    return streams


class Bits:
    """Reads bits of many lanes of one buffer."""

    def __init__(self, raw: np.ndarray):
        self.at = np.ndarray((len(raw) - 8,), ">u8", raw.data, strides=(1,))

    def top(self, pos: np.ndarray) -> np.ndarray:
        """57 bits or more from pos on, at the top."""
        return self.at[pos >> 3].astype(np.uint64) << (pos & 7).astype(np.uint64)

    def read(self, pos: np.ndarray, n) -> np.ndarray:
        return (self.top(pos) >> np.uint64(1) >> (63 - np.asarray(n)).astype(np.uint64)).astype(np.int64)


def _signed(v: np.ndarray, n) -> np.ndarray:
    return np.where(v >> (n - 1) & 1, v - (1 << n), v)


def decode_frames(raw: np.ndarray, at: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(samples of each frame, its end) of the frames that start at these places. raw has 16 spare bytes."""

    def need(ok, what: str) -> None:
        if not np.all(ok):
            raise ValueError(f"not a frame that can be read: {what}")

    inside = lambda p: np.minimum(p, len(raw) - 1)
    need((raw[inside(at)] == 0xFF) & (raw[inside(at + 1)] & 0xFC == 0xF8), "no sync code")
    need(raw[inside(at + 3)] >> 4 == 0, "more than one channel")
    need(np.isin(raw[inside(at + 3)] >> 1 & 7, (0, 1)), "samples of other than 8 bits")
    lead = raw[inside(at + 4)]
    utf = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC, lead < 0xFE], [1, 2, 3, 4, 5, 6], 7)
    p = at + 4 + utf
    size, rate = raw[inside(at + 2)] >> 4, raw[inside(at + 2)] & 15
    wide = np.where(size == 6, 1, np.where(size == 7, 2, 0))
    byte, pair = raw[inside(p)].astype(np.int64), raw[inside(p)].astype(np.int64) << 8 | raw[inside(p + 1)]
    s = size.astype(np.int64)
    n = np.select([s == 1, (s >= 2) & (s <= 5), s == 6, s == 7, s >= 8], [192, 576 << np.clip(s - 2, 0, 3), byte + 1, pair + 1, 256 << np.clip(s - 8, 0, 7)], 0)
    need(n > 0, "no block size")
    head = utf + 4 + wide + np.select([rate == 12, (rate == 13) | (rate == 14)], [1, 2], 0)
    need(_crc8(raw, at, head) == raw[inside(at + head)], "CRC-8")
    bits, pos = Bits(raw), (at + head + 1) * 8
    code = bits.read(pos, 8)
    need(code & 129 == 0, "wasted bits")
    kind, pos = code >> 1, pos + 8
    need((kind <= 1) | (kind >= 8) & (kind <= 12) | (kind >= 32), "kind of subframe")
    out: list[np.ndarray] = [None] * len(at)  # type: ignore[list-item]
    end = np.zeros(len(at), np.int64)
    for i in np.flatnonzero(kind == 0):
        out[i] = np.full(n[i], _signed(bits.read(pos[i : i + 1], 8), 8)[0])
        end[i] = pos[i] + 8
    for i in np.flatnonzero(kind == 1):
        out[i] = raw[pos[i] // 8 : pos[i] // 8 + n[i]].view(np.int8).astype(np.int64)
        end[i] = pos[i] + 8 * n[i]
    lanes = np.flatnonzero(kind >= 8)
    lanes = lanes[np.argsort(-n[lanes], kind="stable")]
    if len(lanes):
        x, stop = _rice_frames(bits, pos[lanes], kind[lanes], n[lanes])
        for j, i in enumerate(lanes):
            out[i] = x[j, : n[i]]
        end[lanes] = stop
    end = (end + 7) // 8
    need(end + 2 <= len(raw), "cut short")
    need(_crc16(raw, at, end - at) == (raw[end].astype(np.int64) << 8 | raw[end + 1]), "CRC-16")
    return out, end + 2


def _leading(top: np.ndarray) -> np.ndarray:
    """Zeros before the first one of the upper 32 bits; more than 31 if there is none."""
    return 1054 - ((top >> np.uint64(32)).astype(np.float64).view(np.int64) >> 52)


def _rice_frames(bits: Bits, pos: np.ndarray, kind: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples and ends of frames with predictors, the longest first."""
    order = np.where(kind >= 32, kind - 31, kind - 8)
    x = np.zeros((len(n), int(n[0])), np.int32)
    for j in range(int(order.max())):
        some = order > j
        x[some, j] = _signed(bits.read(pos[some], 8), 8)
        pos = np.where(some, pos + 8, pos)
    lpc = kind >= 32
    precision = np.where(lpc, bits.read(pos, 4) + 1, 0)
    shift = np.where(lpc, _signed(bits.read(pos + 4, 5), 5), 0)
    pos = np.where(lpc, pos + 9, pos)
    coefficients = np.zeros((len(n), int(order.max(initial=1)) + 1), np.int64)
    for j in range(int(order.max())):
        some = lpc & (order > j)
        coefficients[some, j] = _signed(bits.read(pos[some], precision[some]), precision[some])
        pos = np.where(some, pos + precision, pos)
    method, parts = bits.read(pos, 2), bits.read(pos + 2, 4)
    pos = pos + 6
    if (method > 1).any() or (n % (1 << parts)).any():
        raise ValueError("not a frame that can be read: residual")
    wide = np.where(method == 1, 5, 4)
    part = n >> parts
    k, raw_bits = np.zeros(len(n), np.int64), np.full(len(n), -1)
    changes: dict[int, list[int]] = {}
    for i in range(len(n)):
        changes.setdefault(int(order[i]), []).append(i)
        for b in range(int(part[i]), int(n[i]), int(part[i])):
            changes.setdefault(b, []).append(i)
    alive = np.searchsorted(-n, -np.arange(int(n[0])), "left")  # lanes with more than i samples
    everyone, start = 0, int(order.max())
    escaped = False
    for i in range(int(order.min()), int(n[0])):
        m = int(alive[i])
        if i in changes:
            w = np.array(changes[i])
            v = bits.read(pos[w], wide[w])
            pos[w] += wide[w]
            esc = v == (1 << wide[w]) - 1
            raw_bits[w] = -1
            k[w] = v
            if esc.any():
                e = w[esc]
                raw_bits[e] = bits.read(pos[e], 5)
                pos[e] += 5
                escaped = True
        if i < start or escaped:
            live = np.flatnonzero(order[:m] <= i)
            if escaped and (e := live[raw_bits[live] >= 0]).size:
                width = raw_bits[e]
                x[e, i] = np.where(width > 0, _signed(bits.read(pos[e], width), np.maximum(width, 1)), 0)
                pos[e] += width
                live = live[raw_bits[live] < 0]
            if not len(live):
                continue
            pl, kl = pos[live], k[live]
        else:
            live = everyone = slice(0, m)
            pl, kl = pos[:m], k[:m]
        top = bits.top(pl)
        lead = _leading(top)
        if (lead > 31).any():
            q = np.zeros(len(lead), np.int64)
            while (more := lead > 31).any():
                pl = np.where(more, pl + 32, pl)
                q += np.where(more, 32, 0)
                top = np.where(more, bits.top(pl), top)
                lead = _leading(top)
        else:
            q = 0
        u = (lead + (q - 1) << kl) + (top >> (63 - lead - kl).view(np.uint64)).view(np.int64)
        x[live, i] = u >> 1 ^ -(u & 1)
        pos[live] = pl + lead + (kl + 1)
    for o in range(1, 5):
        rows = np.flatnonzero((kind == 8 + o))
        if len(rows):
            d = x[rows]
            for j in range(o, 0, -1):  # sums undo differences, from the known differences of the warm-up on
                warm = x[rows][:, :o]
                for _ in range(j - 1):
                    warm = np.diff(warm, axis=1)
                d[:, :j] = 0
                d[:, j - 1] = warm[:, 0]
                d[:, j - 1 :] = np.cumsum(d[:, j - 1 :], axis=1)
                # places before j - 1 hold nothing at this level
            d[:, :o] = x[rows][:, :o]
            x[rows] = d
    rows = np.flatnonzero(lpc)
    if len(rows):
        a, c, sh, o = x[rows], coefficients[rows], shift[rows], order[rows]
        a = np.ascontiguousarray(a.T)
        for i in range(int(o.min()), len(a)):
            p = np.zeros(len(rows), np.int64)
            for j in range(min(i, int(o.max()))):
                p += c[:, j] * a[i - 1 - j]
            a[i] += np.where((o <= i), np.where(sh >= 0, p >> np.maximum(sh, 0), p << np.maximum(-sh, 0)), 0)
        x[rows] = a.T
    return x, pos


def _frames(raw: np.ndarray, at: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    try:
        return decode_frames(raw, at)
    except IndexError:
        raise ValueError("not a frame that can be read: cut short") from None


def decode(streams: list[bytes]) -> list[list[tuple[int, np.ndarray]]]:
    """PCM blocks of each stream: (sample offset, unsigned 8-bit samples)."""
    where, starts, infos = [], [], []
    base = 0
    for i, s in enumerate(streams):
        if s[:4] != b"fLaC" or len(s) < 42:
            raise ValueError("not a FLAC stream")
        p, last, points, info = 4, False, [], b""
        while not last:
            last, kind, n = bool(s[p] & 0x80), s[p] & 0x7F, int.from_bytes(s[p + 1 : p + 4], "big")
            body = s[p + 4 : p + 4 + n]
            if len(s) < p + 8 + n:
                raise ValueError("a FLAC stream that is cut short")
            if kind == 0:
                info = body
            elif kind == 3:
                points = [x for x in struct.iter_unpack(">QQH", body[: n // 18 * 18]) if x[0] != 2**64 - 1]
            p += 4 + n
        packed = int.from_bytes(info[10:18], "big")
        if len(info) < 34 or packed >> 41 & 7 or packed >> 36 & 31 != 7:
            raise ValueError("not a mono stream of 8-bit samples")
        total = packed & (1 << 36) - 1
        infos.append((total, info[18:34]))
        if not points and total <= int.from_bytes(info[2:4], "big"):
            points = [(0, 0, total)]  # a single frame
        whole = points and points[0][0] == 0 and all(a[0] + a[2] == b[0] for a, b in zip(points, [*points[1:], (total,)], strict=True))
        starts.append((base + p, base + len(s), [(base + p + o, at) for at, o, _ in points] if whole else None))
        where.append(base)
        base += len(s)
    raw = np.zeros(base + 16, np.uint8)
    raw[:base] = np.frombuffer(b"".join(streams), np.uint8)
    blocks: list[list[tuple[int, np.ndarray]]] = [[] for _ in streams]
    named = [(i, p, at) for i, (_, _, known) in enumerate(starts) if known for p, at in known]
    if named:
        samples, _ = _frames(raw, np.array([p for _, p, _ in named]))
        for (i, _, at), x in zip(named, samples, strict=True):
            blocks[i].append((at, x))
    for i, (p, stop, known) in enumerate(starts):
        at = 0
        while known is None and p < stop and at < infos[i][0]:
            (x,), end = _frames(raw, np.array([p]))
            blocks[i].append((at, x))
            at, p = at + len(x), int(end[0])
    out = []
    for found, (total, md5) in zip(blocks, infos, strict=True):
        done, digest, row = 0, hashlib.md5(), []
        for at, x in found:
            if at != done:
                raise ValueError("frames that don't follow each other")
            done += len(x)
            digest.update(x.astype(np.int8).tobytes())
            row.append((at, (x + 128).astype(np.uint8)))
        if total and done != total or any(md5) and digest.digest() != md5:
            raise ValueError("the samples don't have the stream's length or MD5")
        out.append(row)
    return out


def payload(text: bytes | np.ndarray) -> np.ndarray:
    """The bytes with zeros up to a positive multiple of 64."""
    raw = np.frombuffer(text, np.uint8) if isinstance(text, bytes) else text
    out = np.zeros(max(PAD, -(-len(raw) // PAD) * PAD), np.uint8)
    out[: len(raw)] = raw
    return out


def encode_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): the FLAC stream of each whole text."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b, size=2 << 20):  # arrays of some fifty bytes a sample
                t = Texts(c.column("text"))
                media = encode([payload(t.raw[a:e]) for a, e in zip(t.offsets[:-1], t.offsets[1:], strict=True)])
                yield pa.RecordBatch.from_arrays([c.column("doc_id"), pa.array(np.diff(t.offsets)), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return documents(docs).mapInArrow(task, "doc_id long, n_bytes long, media binary")


def _groups(b: pa.RecordBatch, most: int = 6 << 20) -> Iterator[pa.RecordBatch]:
    yield from chunks(b, "media", most)


def pcm_blocks(media: DataFrame) -> DataFrame:
    """(doc_id, offset, n_samples, pcm): the verified blocks of media (doc_id, media), by sample offset."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in _groups(b):
                found = decode([m.as_buffer().to_pybytes() for m in c.column("media")])
                rows = [(d, at, len(x), x.tobytes()) for d, blocks in zip(c.column("doc_id").to_pylist(), found, strict=True) for at, x in blocks]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "offset", "n_samples", "pcm"])

    return media.where("media is not null").select("doc_id", "media").mapInArrow(task, "doc_id long, offset long, n_samples long, pcm binary")


def store(media: DataFrame, folder: str) -> None:
    """Writes the streams, packed once more by zstd, to a new folder."""
    media.write.options(**_PACKED).parquet(folder)


def load(spark, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def write_blocks(media: DataFrame, folder: str) -> None:
    """Decodes media and writes its blocks (doc_id, offset, n_samples, pcm) to a new folder."""
    pcm_blocks(media).write.options(**_PACKED).parquet(folder)


def read_samples(spark, folder: str, doc_id: int, begin: int, end: int) -> bytes:
    """Samples begin to end of a document, from the written blocks that hold them alone."""
    rows = load(spark, folder).where((F.col("doc_id") == doc_id) & (F.col("offset") < end) & (F.col("offset") + F.col("n_samples") > begin))
    return b"".join(bytes(r.pcm)[max(0, begin - r.offset) : end - r.offset] for r in rows.select("offset", "pcm").distinct().orderBy("offset").collect())


def round_trip(docs: DataFrame) -> DataFrame:
    """Writes the streams of docs to the shared folder and digests what is read back."""
    spark = docs.sparkSession
    folder = f"{scratch(spark, 'media')}/streams"
    store(encode_texts(docs), folder)
    return media_digests(load(spark, folder))


def feature(samples: np.ndarray) -> str:
    """Root mean square, peak and sign changes of the signal around silence."""
    x = samples.astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"rms={np.sqrt((x * x).sum() / len(x)):.6f};peak={int(np.abs(x).max())};crossings={crossings}"


def media_digests(media: DataFrame) -> DataFrame:
    """What the streams of media (doc_id, n_bytes, media) decode to, as sizes, digests and a feature."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in _groups(b):
                streams = [m.as_buffer().to_pybytes() for m in c.column("media")]
                rows = []
                for s, blocks in zip(streams, decode(streams), strict=True):
                    x = np.concatenate([x for _, x in blocks])
                    p = x.tobytes()
                    rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-PAD:]), len(s), hashlib.sha256(s).hexdigest(), feature(x)))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([c.column("doc_id"), c.column("n_bytes"), *(pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True))], names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(task, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
