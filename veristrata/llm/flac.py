"""A FLAC codec in numpy for mono streams of equal blocks: all frames of a batch advance one sample at a time, side by side.

Encoder: constant, verbatim, fixed (order 0 to 2) and linear (order 2) predictors, one Rice partition a frame, CRC-8 and
CRC-16, stream MD5, and a seek table with a point every SEEK_FRAMES frames. Decoder: those, and fixed order to 4, linear
order to 32, more Rice partitions and escaped partitions. Wasted bits, several channels and changing block sizes raise.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np

BLOCK = 192
RATE = 8000
SEEK_FRAMES = 4
_WORDS = 29
U = np.uint64

# Fixed values of the format: block sizes by header code, coefficients of the fixed predictors.
BLOCK_SIZES = {1: 192, 2: 576, 3: 1152, 4: 2304, 5: 4608, 8: 256, 9: 512, 10: 1024, 11: 2048, 12: 4096, 13: 8192, 14: 16384, 15: 32768}
FIXED = {0: [], 1: [1], 2: [2, -1], 3: [3, -3, 1], 4: [4, -6, 4, -1]}


def _crc_table(poly: int, bits: int) -> np.ndarray:
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    out = []
    for b in range(256):
        c = b << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly if c & top else c << 1) & mask
        out.append(c)
    return np.array(out, np.uint32)


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
_CLZ16 = np.array([16 - int(x).bit_length() for x in range(1 << 16)], np.int64)


def crc16_rows(rows: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """CRC-16 of the first lens[i] bytes of each row."""
    crc = np.zeros(len(rows), np.uint32)
    cols = np.ascontiguousarray(rows.T)
    least = int(lens.min()) if len(lens) else 0
    for j in range(int(lens.max()) if len(lens) else 0):
        new = ((crc << np.uint32(8)) & np.uint32(0xFFFF)) ^ CRC16[(crc >> np.uint32(8)) ^ cols[j]]
        crc = new if j < least else np.where(j < lens, new, crc)
    return crc


def _coded_number(n: int) -> bytes:
    """The variable-length frame number."""
    if n < 128:
        return bytes([n])
    k = 2
    while n >= 1 << (5 * k + 1):
        k += 1
    head = (0xFF << (8 - k)) & 0xFF
    return bytes([head | (n >> (6 * (k - 1))), *(0x80 | ((n >> (6 * i)) & 0x3F) for i in range(k - 2, -1, -1))])


class _Headers:
    """Frame headers by frame number; grows as longer streams come."""

    def __init__(self):
        self.rows, self.lens = np.zeros((0, 16), np.uint8), np.zeros(0, np.int64)

    def upto(self, n: int) -> None:
        if n < len(self.lens):
            return
        rows, lens = [], []
        for k in range(len(self.lens), max(n + 1, 2 * len(self.lens), 64)):
            h = bytes([0xFF, 0xF8, 0x14, 0x02]) + _coded_number(k)
            c = 0
            for b in h:
                c = int(CRC8[c ^ b])
            h += bytes([c])
            rows.append(h.ljust(16, b"\0"))
            lens.append(len(h))
        self.rows = np.vstack([self.rows, np.frombuffer(b"".join(rows), np.uint8).reshape(-1, 16)])
        self.lens = np.append(self.lens, lens)


_HEADERS = _Headers()


def _put(out: np.ndarray, base: np.ndarray, pos: np.ndarray, val: np.ndarray, nbits: np.ndarray) -> None:
    """ORs val's low nbits into each row at bit pos; nbits 0 writes nothing if val is 0."""
    room = 64 - (pos & 63) - nbits
    at = base + (pos >> 6)
    over = room < 0
    left = np.maximum(room, 0).astype(U)
    out[at] |= np.where(left < U(64), val << np.minimum(left, U(63)), U(0)) >> np.maximum(-room, 0).astype(U)
    if over.any():
        i = np.flatnonzero(over)
        out[at[i] + 1] |= val[i] << (64 + room[i]).astype(U)


def encode_frames(x: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames of an (F, 192) int32 array of 8-bit samples: (bytes of all, length of each)."""
    f, n = x.shape
    _HEADERS.upto(int(number.max()) if f else 0)
    # predictors: residuals, their magnitudes, the smallest
    e1 = np.diff(x, axis=1)
    e2 = np.diff(e1, axis=1)
    c = x.astype(np.float32)
    r0, r1, r2 = (np.einsum("ij,ij->i", c[:, k:], c[:, : n - k]).astype(np.float64) for k in range(3))
    det = r0 * r0 - r1 * r1
    ok = det > 1e-3
    det = np.where(ok, det, 1)
    q1 = np.clip(np.rint(64 * np.where(ok, r1 * (r0 - r2) / det, 0)), -128, 127).astype(np.int32)
    q2 = np.clip(np.rint(64 * np.where(ok, (r0 * r2 - r1 * r1) / det, 0)), -128, 127).astype(np.int32)
    lp = x[:, 2:] - ((q1[:, None] * x[:, 1:-1] + q2[:, None] * x[:, :-2]) >> 6)
    cost = np.stack([np.abs(x).sum(1), np.abs(e1).sum(1) + 8, np.abs(e2).sum(1) + 16, np.abs(lp).sum(1) + 40], 1)
    kind = cost.argmin(1)
    order = np.array([0, 1, 2, 2])[kind]
    res = x.copy()
    for k, e in ((1, e1), (2, e2), (3, lp)):
        i = np.flatnonzero(kind == k)
        res[i, n - e.shape[1] :] = e[i]
    u = ((res << 1) ^ (res >> 31)).astype(np.int32)
    warm = np.arange(n)[None, :2] < order[:, None]
    u[:, :2][warm] = 0
    count = n - order
    mean = u.sum(1) / count
    k0 = np.clip(np.floor(np.log2(np.maximum(mean * 0.6931, 1e-9))), 0, 12).astype(np.int32)
    bits0 = (u >> k0[:, None]).sum(1) + count * (1 + k0)
    bits1 = (u >> (k0 + 1)[:, None]).sum(1) + count * (2 + k0)
    k = np.where(bits1 < bits0, k0 + 1, k0)
    bits = np.minimum(bits0, bits1) + order * 8 + 10 + 25 * (kind == 3)
    constant = (x == x[:, :1]).all(1)
    verbatim = ~constant & (bits >= 8 * n)
    rice = ~constant & ~verbatim
    # fields of the subframe
    hl = _HEADERS.lens[number]
    out = np.zeros((f, _WORDS), ">u8")
    out.view(np.uint8).reshape(f, -1)[:, :16] = _HEADERS.rows[number]
    out = out.astype(U).reshape(-1)
    base, pos = np.arange(f, dtype=np.int64) * _WORDS, hl * 8
    full = np.full(f, 8, np.int64)

    def put(val, nbits):
        nonlocal pos
        _put(out, base, pos, val, nbits)
        pos = pos + nbits

    head = np.where(constant, 0, np.where(verbatim, 2, np.where(kind == 3, (32 + 1) << 1, (8 + order) << 1)))
    put(head.astype(U), full)
    for j in range(2):
        on = rice & (order > j)
        put(np.where(on, x[:, j] & 255, 0).astype(U), 8 * on)
    on = rice & (kind == 3)
    par = (7 << 21) | (6 << 16) | ((q1 & 255) << 8) | (q2 & 255)
    put(np.where(on, par, 0).astype(U), 25 * on)
    put(np.where(rice, k, 0).astype(U), 10 * rice)
    # samples
    live = rice[:, None] & (np.arange(n)[None, :] >= order[:, None])
    skip = np.where(live, u >> k[:, None], 0)
    val = np.where(live, (1 << k[:, None]) | (u & ((1 << k[:, None]) - 1)), 0)
    wide = np.where(live, 1 + k[:, None], 0)
    val[verbatim] = x[verbatim] & 255
    wide[verbatim] = 8
    val[constant, 0] = x[constant, 0] & 255
    wide[constant, 0] = 8
    val, skip, wide = (np.ascontiguousarray(a.T) for a in (val.astype(np.int32), skip.astype(np.int32), wide.astype(np.int32)))
    for j in range(n):
        pos = pos + skip[j]
        w = wide[j].astype(np.int64)
        _put(out, base, pos, val[j].astype(U), w)
        pos = pos + w
    lens = (pos + 7) >> 3
    rows = out.astype(">u8").view(np.uint8).reshape(f, -1)
    crc = crc16_rows(rows, lens)
    i = np.arange(f)
    rows[i, lens] = crc >> 8
    rows[i, lens + 1] = crc & 255
    lens = lens + 2
    return rows[np.arange(rows.shape[1])[None, :] < lens[:, None]], lens


def encode_streams(data: np.ndarray, lens: np.ndarray) -> list[bytes]:
    """One FLAC stream for each run of lens[i] bytes of data (multiples of 192); a sample is its byte less 128."""
    frames = (lens // BLOCK).astype(np.int64)
    x = (data.astype(np.int32) - 128).reshape(-1, BLOCK)
    first = np.cumsum(frames) - frames
    number = np.arange(len(x)) - np.repeat(first, frames)
    body, fl = encode_frames(x, number)
    at = np.append(0, np.cumsum(fl))
    raw, signed, out = body.tobytes(), x.astype(np.int8).tobytes(), []
    for i, (a, m) in enumerate(zip(first.tolist(), frames.tolist(), strict=True)):
        b = a + m
        own, start = fl[a:b], int(at[a])
        seek = range(0, m, SEEK_FRAMES)
        info = struct.pack(">HH", BLOCK, BLOCK) + int(own.min()).to_bytes(3, "big") + int(own.max()).to_bytes(3, "big") + ((RATE << 44) | (7 << 36) | int(lens[i])).to_bytes(8, "big")
        info += hashlib.md5(signed[a * BLOCK : b * BLOCK]).digest()
        points = b"".join(struct.pack(">QQH", j * BLOCK, int(at[a + j]) - start, BLOCK) for j in seek)
        out.append(b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(points).to_bytes(3, "big") + points + raw[start : int(at[b])])
    return out


class Stream:
    """Container of one stream: block size, samples, MD5, where the frames begin, and its seek points (sample, byte)."""

    def __init__(self, s: bytes):
        if s[:4] != b"fLaC":
            raise ValueError("not a FLAC stream")
        at, last, self.points = 4, False, [(0, 0)]
        while not last:
            last, kind, n = bool(s[at] & 128), s[at] & 127, int.from_bytes(s[at + 1 : at + 4], "big")
            body = s[at + 4 : at + 4 + n]
            if kind == 0:
                self.block, most = struct.unpack(">HH", body[:4])
                packed = int.from_bytes(body[10:18], "big")
                self.rate, self.channels, self.width, self.samples = packed >> 44, ((packed >> 41) & 7) + 1, ((packed >> 36) & 31) + 1, packed & ((1 << 36) - 1)
                self.md5 = body[18:34]
                if self.channels != 1 or self.width != 8 or self.block != most:
                    raise ValueError("only mono 8-bit streams of equal blocks are read")
            elif kind == 3:
                flat = np.frombuffer(body, np.dtype([("s", ">u8"), ("o", ">u8"), ("n", ">u2")]))
                self.points = [(int(p), int(o)) for p, o in zip(flat["s"], flat["o"], strict=True) if p != 0xFFFFFFFFFFFFFFFF] or self.points
            at += 4 + n
        self.first = at


def decode_frames(buf: np.ndarray, at: np.ndarray, number: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Frames that start at the bytes `at` of buf, side by side: (F, n) int32 samples and the byte after each frame.

    Checks sync code, header CRC-8, frame number and frame CRC-16.
    """
    return _decode(buf, _windows(buf), at, number, n, len(at))


def _windows(buf: np.ndarray) -> np.ndarray:
    """The 64 bits from each byte on."""
    pad = np.append(buf, np.zeros(16, np.uint8)).astype(U)
    win = np.zeros(len(buf) + 8, U)
    for j in range(8):
        win |= pad[j : j + len(win)] << U(56 - 8 * j)
    return win


def _decode(buf, win, at, number, n, f):
    byte = lambda i: buf[np.minimum(at + i, len(buf) - 1)].astype(np.int64)
    if ((byte(0) != 0xFF) | (byte(1) != 0xF8)).any():
        raise ValueError("no frame where one must start")
    code, b4 = byte(2) >> 4, byte(4)
    if (np.array([BLOCK_SIZES.get(i, 0) for i in range(16)])[code] != n).any() or ((byte(3) >> 4) != 0).any():
        raise ValueError("a frame is not a mono frame of the stream's block size")
    extra = np.where(b4 < 128, 0, np.where(b4 < 0xE0, 1, np.where(b4 < 0xF0, 2, np.where(b4 < 0xF8, 3, np.where(b4 < 0xFC, 4, 5)))))
    num = np.where(extra == 0, b4, b4 & ((1 << (6 - extra)) - 1))
    crc = np.zeros(f, np.uint32)
    for j in range(4 + 1 + int(extra.max())):
        on = j < 5 + extra
        b = byte(j)
        crc = np.where(on, CRC8[(crc ^ b.astype(np.uint32)) & 255], crc)
        if j > 4:
            num = np.where(on, (num << 6) | (b & 63), num)
    if (crc != byte(5 + extra)).any() or (num != number).any():
        raise ValueError("a frame header fails its checksum or number")
    pos = (at + 6 + extra) * 8
    peek = lambda i, p: win[p >> 3] << (p & 7).astype(U)
    take = lambda p, k: ((win[p >> 3] << (p & 7).astype(U)) >> U(1)) >> (63 - k).astype(U)
    head = (win[pos >> 3] >> U(56)).astype(np.int64)
    if (head & 129).any():
        raise ValueError("wasted bits or a broken subframe")
    kind = head >> 1
    pos = pos + 8
    out = np.zeros((n, f), np.int32)
    signed = lambda v, k: v - ((v >> (k - 1)) << k)
    for j in np.flatnonzero(kind == 0):
        out[:, j] = signed(int(buf[pos[j] >> 3]), 8)
    if len(v := np.flatnonzero(kind == 1)):
        out[:, v] = buf[(pos[v] >> 3)[None, :] + np.arange(n)[:, None]].view(np.int8)
    pos = pos + np.where(kind == 0, 8, np.where(kind == 1, 8 * n, 0))
    if len(v := np.flatnonzero(kind > 1)):
        kd, p = kind[v], pos[v]
        if (((kd < 8) | (kd > 12)) & (kd < 32)).any():
            raise ValueError("a reserved subframe type")
        linear = kd >= 32
        order = np.where(linear, kd - 31, kd - 8)
        most = int(order.max())
        res = np.zeros((n, len(v)), np.int64)
        for j in range(most):
            on = order > j
            w = take(p, np.full(len(v), 8)).astype(np.int64)
            res[j] = np.where(on, signed(w, 8), 0)
            p = p + 8 * on
        coef, shift = np.zeros((max(most, 1), len(v)), np.int64), np.zeros(len(v), np.int64)
        for o, cs in FIXED.items():
            for j, c in enumerate(cs[:most]):
                coef[j, ~linear & (order == o)] = c
        if linear.any():
            prec = np.where(linear, take(p, np.full(len(v), 4)).astype(np.int64) + 1, 1)
            shift = np.where(linear, take(p + 4, np.full(len(v), 5)).astype(np.int64), 0)
            p = p + 9 * linear
            for j in range(most):
                on = linear & (order > j)
                w = take(p, prec).astype(np.int64)
                coef[j] = np.where(on, w - ((w >> (prec - 1)) << prec), coef[j])
                p = p + prec * on
        method, po = take(p, np.full(len(v), 2)).astype(np.int64), take(p + 2, np.full(len(v), 4)).astype(np.int64)
        p = p + 6
        if (method > 1).any():
            raise ValueError("a reserved residual coding")
        kbits = np.where(method == 0, 4, 5)
        size = n >> po
        k, raw = np.zeros(len(v), np.int64), np.full(len(v), -1)
        simple = (po == 0).all()
        for i in range(n):
            live = None if i >= most else i >= order
            if i == 0 or not simple:
                new = i % size == 0
                if new.any():
                    got = take(p, kbits).astype(np.int64)
                    k = np.where(new, got, k)
                    p = p + kbits * new
                    esc = new & (k == (1 << kbits) - 1)
                    raw = np.where(new, -1, raw)
                    if esc.any():
                        raw = np.where(esc, take(p, np.full(len(v), 5)).astype(np.int64), raw)
                        p = p + 5 * esc
                escaped = (raw >= 0).any()
            w = win[p >> 3] << (p & 7).astype(U)
            z = _CLZ16[(w >> U(48)).astype(np.int64)]
            if (far := z == 16).any():
                w2, far = w, far & (raw < 0) & (True if live is None else live)
                q = np.where(far, 0, np.minimum(z, 15))
                pp = p.copy()
                while far.any():
                    pp = pp + 16 * far
                    q = q + 16 * far
                    w2 = win[pp >> 3] << (pp & 7).astype(U)
                    z2 = _CLZ16[(w2 >> U(48)).astype(np.int64)]
                    q = q + np.where(far & (z2 < 16), z2, 0)
                    far = far & (z2 == 16)
                start = p + q + 1
                r = ((win[start >> 3] << (start & 7).astype(U)) >> U(1)) >> (63 - k).astype(U)
            else:
                q = z
                r = ((w << (z + 1).astype(U)) >> U(1)) >> (63 - k).astype(U)
            u = (q << k) | r.astype(np.int64)
            e, step = (u >> 1) ^ -(u & 1), q + 1 + k
            if escaped:
                rw = np.maximum(raw, 1)
                lit = take(p, rw).astype(np.int64)
                lit = np.where(raw > 0, lit - ((lit >> (rw - 1)) << rw), 0)
                e, step = np.where(raw >= 0, lit, e), np.where(raw >= 0, np.maximum(raw, 0), step)
            if live is None:
                res[i] = e
                p = p + step
            else:
                res[i] = np.where(live, e, res[i])
                p = p + np.where(live, step, 0)
        if most:
            for i in range(n):
                guess = 0
                for j in range(min(most, i)):
                    guess = guess + coef[j] * res[i - 1 - j]
                add = guess >> shift if i else 0
                res[i] += add if i >= most else np.where(i >= order, add, 0)
        out[:, v] = res
        pos[v] = p
    end = (pos + 7) >> 3
    lens = end - at
    rows = buf[np.minimum(at[:, None] + np.arange(int(lens.max())), len(buf) - 1)]
    stored = (buf[np.minimum(end, len(buf) - 1)].astype(np.uint32) << 8) | buf[np.minimum(end + 1, len(buf) - 1)]
    if (end + 2 > len(buf)).any() or (crc16_rows(rows, lens) != stored).any():
        raise ValueError("a frame fails its checksum")
    return out.T, end + 2


def decode_range(s: bytes, first: int, count: int) -> np.ndarray:
    """int8 samples from `first` on, `count` at most: frames are decoded from the last seek point at or before `first` only."""
    h = Stream(s)
    stop = min(h.samples, first + count)
    if first < 0 or first >= stop:
        return np.zeros(0, np.int8)
    begin, at = max((p for p in h.points if p[0] <= first), default=(0, 0))
    after = min((p[1] for p in h.points if p[0] >= stop), default=len(s) - h.first)
    buf = np.frombuffer(s, np.uint8)[h.first + at : h.first + after]
    win, where, parts = _windows(buf), np.zeros(1, np.int64), []
    for k in range(begin // h.block, -(-stop // h.block)):
        x, where = _decode(buf, win, where, np.array([k]), h.block, 1)
        parts.append(x.reshape(-1))
    return np.concatenate(parts)[first - begin : stop - begin].astype(np.int8)


def decode_streams(streams: list[bytes]) -> list[np.ndarray]:
    """int8 samples of each stream. Runs between seek points are decoded side by side; MD5 and sample counts are checked."""
    heads = [Stream(s) for s in streams]
    if not heads:
        return []
    n = heads[0].block
    if any(h.block != n for h in heads):
        return [decode_streams([s])[0] for s in streams]
    base = np.append(0, np.cumsum([len(s) for s in streams]))
    buf = np.frombuffer(b"".join(streams), np.uint8)
    win = _windows(buf)
    total = np.array([h.samples // n for h in heads])
    if any(h.samples % n for h in heads):
        raise ValueError("the last block of a stream is short")
    out_at = np.append(0, np.cumsum(total))
    at, num, left, row = [], [], [], []
    for i, h in enumerate(heads):
        pts = [(s // n, o) for s, o in h.points] if total[i] else []
        for (a, o), (b, _) in zip(pts, [*pts[1:], (int(total[i]), 0)], strict=True):
            at.append(int(base[i]) + h.first + o)
            num.append(a)
            left.append(b - a)
            row.append(int(out_at[i]) + a)
    at, num, left, row = (np.array(a, np.int64) for a in (at, num, left, row))
    pcm = np.zeros((int(out_at[-1]), n), np.int8)
    while len(at):
        x, at = _decode(buf, win, at, num, n, len(at))
        pcm[row] = x
        num, row, left = num + 1, row + 1, left - 1
        on = left > 0
        at, num, left, row = at[on], num[on], left[on], row[on]
    out = [pcm[out_at[i] : out_at[i + 1]].reshape(-1) for i in range(len(heads))]
    for x, h in zip(out, heads, strict=True):
        if h.md5 != bytes(16) and hashlib.md5(x.tobytes()).digest() != h.md5:
            raise ValueError("a stream fails its MD5")
    return out
