"""Lossless WebP (RFC 9649) in numpy: many images decoded and encoded side by side.

A lossless stream is a list of transforms and an entropy-coded image; transforms have
small images of their own. ``decode`` runs a parser for each image, which hands over
an entropy-coded image whenever it needs its pixels; those of all images are read in
step, one prefix-coded symbol of each at a time, so that the work is array operations
over images and not a loop over one image's bits. What the symbols stand for is
settled afterwards without a loop: a back-reference points to an earlier pixel, a
colour-cache code to the last pixel before it of the same hash, and pointers are
followed by doubling. Predictors are inverted along diagonals, of all images at once.

``encode`` finds copies by sorting windows of four pixels, cache hits by sorting
hashes, gives symbols lengths by their shares and completes the code, and puts all
images' bits down at once.

Pixels are 32-bit ARGB numbers. A broken stream raises ValueError.
"""

from __future__ import annotations

from collections.abc import Generator, Iterator
from dataclasses import dataclass, field

import numpy as np

from corvane.llm.textscan import U64, mix, ragged

PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
LONGEST = 15  # bits of a prefix code
MOST_LENGTH = 4096
MOST_DISTANCE = (1 << 20) - 120
# Fixed values of the format.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
CACHE_FACTOR = 0x1E35A7BD


def _near() -> np.ndarray:
    """(dx, dy) of the 120 short distances: nearest first, of equally near ones the smaller dx, right of the pixel first."""
    at = [(x, y) for y in range(8) for x in range(-7, 9) if y or x > 0]
    return np.array(sorted(at, key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0)), np.int64)


NEAR = _near()
REVERSED = np.zeros(1 << LONGEST, np.int64)
for _k in range(LONGEST):
    REVERSED |= ((np.arange(1 << LONGEST) >> _k) & 1) << (LONGEST - 1 - _k)


def by_key(key: np.ndarray) -> np.ndarray:
    """The places of numbers in their order, equal ones as they stand."""
    bits = max(1, len(key).bit_length())
    if len(key) and int(key.max()).bit_length() + bits > 63:
        return np.argsort(key, kind="stable")
    # Sorting numbers that carry their places is several times as fast as a stable sort of places.
    return np.sort(key << bits | np.arange(len(key))) & ((1 << bits) - 1)


def cache_key(argb: np.ndarray, bits: np.ndarray | int) -> np.ndarray:
    return ((argb.astype(np.int64) * CACHE_FACTOR) & 0xFFFFFFFF) >> (32 - bits)


def split(argb: np.ndarray) -> np.ndarray:
    """(n, 4) channels, in order of alpha, red, green, blue."""
    return np.ascontiguousarray(argb, np.uint32).astype(">u4").view(np.uint8).reshape(-1, 4)


def joined(channels: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(channels, np.uint8).view(">u4").ravel().astype(np.uint32)


# --- decoding


@dataclass
class Code:
    """A prefix code as a table over the next ``bits`` bits, of symbols and their lengths in four low bits."""

    bits: int
    table: np.ndarray


def codes_of(lengths: np.ndarray) -> list[Code]:
    """The canonical codes of these lengths, a row each; one of a single symbol takes no bits."""
    many, alphabet = lengths.shape
    used = lengths > 0
    count = used.sum(1)
    bits = np.where(count < 2, 0, lengths.max(1))
    order = by_key(np.where(used, lengths, LONGEST + 1).astype(np.int64).ravel() + 32 * np.repeat(np.arange(many), alphabet)).reshape(many, alphabet) - alphabet * np.arange(many)[:, None]
    own = np.take_along_axis(lengths, order, 1)
    share = np.where(own > 0, 1 << np.maximum(bits[:, None] - own, 0), 0)
    share[count < 2] = 0
    share[count < 2, 0] = 1
    if (share.sum(1) != 1 << bits).any():
        raise ValueError("a prefix code is not complete")
    entry = np.where((count < 2)[:, None], order << 4, order << 4 | own)
    entry[count == 0] = 0
    table = np.repeat(entry.ravel(), share.ravel())
    size = 1 << bits
    end = np.cumsum(size)
    low = np.arange(end[-1]) - np.repeat(end - size, size)
    table = table[np.repeat(end - size, size) + (REVERSED[low] >> np.repeat(LONGEST - bits, size))].astype(np.int32)
    return [Code(b, table[e - (1 << b) : e]) for b, e in zip(bits.tolist(), end.tolist(), strict=True)]


class Bits:
    """Bits of a byte string from ``pos`` to ``end``, least significant first."""

    def __init__(self, data: bytes, pos: int, end: int):
        self.data, self.pos, self.end = data, pos, end

    def read(self, n: int) -> int:
        """The next bits, 57 at most."""
        at = self.pos >> 3
        out = int.from_bytes(self.data[at : at + 8], "little") >> (self.pos & 7) & ((1 << n) - 1)
        self.pos += n
        if self.pos > self.end:
            raise ValueError("the stream ends early")
        return out


_LENGTH_CODES: dict[int, np.ndarray] = {}


def _length_code(said: int, many: int) -> np.ndarray:
    """The table over seven bits of the code that ``many`` lengths of three bits give."""
    if said not in _LENGTH_CODES:
        if len(_LENGTH_CODES) > 4096:
            _LENGTH_CODES.clear()
        lengths = np.zeros((1, 19), np.int64)
        for k in range(many):
            lengths[0, LENGTH_ORDER[k]] = said >> (3 * k) & 7
        code = codes_of(lengths)[0]
        _LENGTH_CODES[said] = code.table[np.arange(128) & ((1 << code.bits) - 1)]
    return _LENGTH_CODES[said]


@dataclass
class Lengths:
    """Code lengths to be read from ``bits.pos`` on, ``left`` of them at most."""

    bits: Bits
    alphabet: int
    table: np.ndarray | None = None
    left: int = 0
    code: Code | None = None


def _read_code(bits: Bits, alphabet: int) -> Generator[Lengths, None, Code]:
    job = Lengths(bits, alphabet)
    if bits.read(1):
        two = bits.read(1)
        symbols = [bits.read(8 if bits.read(1) else 1)]
        if two:
            symbols.append(bits.read(8))
        symbols = sorted(set(symbols))
        return Code(len(symbols) - 1, np.array([x << 4 | len(symbols) - 1 for x in symbols], np.int32))
    many = bits.read(4) + 4
    job.table = _length_code(bits.read(3 * many) | 0, many) if many < 19 else _length_code(bits.read(57), 19)
    job.left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    yield job
    return job.code


def read_lengths(jobs: list[Lengths], window: np.ndarray) -> None:
    """Fill in the jobs' codes and move their bits past them, all jobs in step."""
    if not jobs:
        return
    table = np.stack([j.table for j in jobs])
    pos, end = (np.array([getattr(j.bits, a) for j in jobs]) for a in ("pos", "end"))
    alphabet, left = np.array([j.alphabet for j in jobs]), np.array([j.left for j in jobs])
    found, last = np.zeros(len(jobs), np.int64), np.full(len(jobs), 8)
    lane = np.arange(len(jobs))
    cells = []
    while len(lane):
        p = pos[lane]
        w = window[p >> 3] >> (p & 7)
        entry = table[lane, w & 127]
        s, n = (entry >> 4).astype(np.int64), (entry & 15).astype(np.int64)
        w >>= n
        plain = s < 16
        extra = np.where(plain, 0, np.where(s == 16, 2, np.where(s == 17, 3, 7)))
        times = np.where(plain, 1, np.where(s == 18, 11, 3) + (w & ((1 << extra) - 1)))
        value = np.where(plain, s, np.where(s == 16, last[lane], 0))
        cells.append((lane, found[lane], times, value))
        last[lane] = np.where(plain & (s > 0), s, last[lane])
        pos[lane] = p + n + extra
        found[lane] += times
        left[lane] -= 1
        lane = lane[(found[lane] < alphabet[lane]) & (left[lane] > 0)]
        if (pos[lane] > end[lane]).any():
            raise ValueError("the stream ends early")
    if (found > alphabet).any() or (pos > end).any():
        raise ValueError("too many code lengths")
    wide = max(256, int(alphabet.max()))
    lengths = np.zeros(len(jobs) * wide, np.int64)
    lane, at, times, value = (np.concatenate(c) for c in zip(*cells, strict=True))
    lengths[ragged(lane * wide + at, times)] = np.repeat(value, times)
    for j, p, code in zip(jobs, pos.tolist(), codes_of(lengths.reshape(-1, wide)), strict=True):
        j.bits.pos, j.code = p, code


@dataclass
class Job:
    """An entropy-coded image to be read from ``bits.pos`` on; ``groups`` has five codes each, ``which`` the group of each block."""

    bits: Bits
    width: int
    height: int
    cache: int
    groups: list[list[Code]]
    which: np.ndarray | None = None
    block: int = 0
    pixels: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint32))


def _across(width: int, bits: int) -> int:
    return (width + (1 << bits) - 1) >> bits


def _coded(bits: Bits, width: int, height: int, main: bool) -> Generator[Job | Lengths, None, np.ndarray]:
    """The pixels of an entropy-coded image."""
    cache = bits.read(4) if bits.read(1) else 0
    if cache > 11:
        raise ValueError("the colour cache is too large")
    which, block, many = None, 0, 1
    if main and bits.read(1):
        block = bits.read(3) + 2
        of = yield from _coded(bits, _across(width, block), _across(height, block), False)
        which = (of.astype(np.int64) >> 8) & 0xFFFF
        many = int(which.max()) + 1
    alphabets = (280 + (1 << cache if cache else 0), 256, 256, 256, 40)
    groups = []
    for _ in range(many):
        group = []
        for a in alphabets:
            group.append((yield from _read_code(bits, a)))
        groups.append(group)
    job = Job(bits, width, height, cache, groups, which, block)
    yield job
    return job.pixels


def chunk(data: bytes) -> bytes:
    """The lossless stream of a WebP file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at = 12
    while at + 8 <= len(data):
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        if data[at : at + 4] == b"VP8L":
            return data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no lossless stream")


@dataclass
class Image:
    width: int
    height: int
    argb: np.ndarray


def _parse(bits: Bits, width: int, height: int) -> Generator[Job | Lengths, None, tuple[np.ndarray, list]]:
    """The coded pixels of an image and its transforms, in order of reading."""
    transforms, seen = [], set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform comes twice")
        seen.add(kind)
        size, data, own = 0, None, width
        if kind in (PREDICTOR, CROSS_COLOUR):
            size = bits.read(3) + 2
            data = yield from _coded(bits, _across(width, size), _across(height, size), False)
        elif kind == PALETTE:
            n = bits.read(8) + 1
            steps = yield from _coded(bits, n, 1, False)
            data = joined(np.cumsum(split(steps), axis=0, dtype=np.uint8))
            size = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            width = _across(width, size)
        transforms.append((kind, size, data, own))
    return (yield from _coded(bits, width, height, True)), transforms


def decode(files: list[bytes]) -> list[Image]:
    """The images of WebP files with a lossless stream."""
    streams = [chunk(f) for f in files]
    data = b"".join(streams) + bytes(16)
    window = _window(np.frombuffer(data, np.uint8))
    heads, parsers, at = [], [], 0
    for stream in streams:
        bits = Bits(data, 8 * at, 8 * (at := at + len(stream)))
        if bits.read(8) != 0x2F:
            raise ValueError("not a lossless stream")
        width, height = bits.read(14) + 1, bits.read(14) + 1
        bits.read(1)
        if bits.read(3):
            raise ValueError("unknown version")
        heads.append((width, height))
        parsers.append(_parse(bits, width, height))
    done: list[tuple[np.ndarray, list]] = [(np.zeros(0, np.uint32), [])] * len(files)
    ready, images = list(range(len(files))), []
    while ready or images:
        lengths = []
        for k in ready:
            try:
                job = next(parsers[k])
                (lengths if isinstance(job, Lengths) else images).append((k, job))
            except StopIteration as end:
                done[k] = end.value
        if lengths:  # pixels wait until no image has codes to be read, so that more are read in step
            read_lengths([j for _, j in lengths], window)
            ready = [k for k, _ in lengths]
        else:
            read_pixels([j for _, j in images], window)
            ready, images = [k for k, _ in images], []
    pixels, transforms = [p for p, _ in done], [t for _, t in done]
    for turn in range(max((len(t) for t in transforms), default=0)):
        own = [(k, t[len(t) - 1 - turn]) for k, t in enumerate(transforms) if len(t) > turn]
        predicted = [(k, t) for k, t in own if t[0] == PREDICTOR]
        for (k, _), p in zip(predicted, _unpredict([(pixels[k], t[3], t[1], t[2]) for k, t in predicted]), strict=True):
            pixels[k] = p
        for k, (kind, size, data, width) in own:
            if kind == CROSS_COLOUR:
                pixels[k] = cross_colour(pixels[k], width, size, data, back=True)
            elif kind == SUBTRACT_GREEN:
                pixels[k] = subtract_green(pixels[k], back=True)
            elif kind == PALETTE:
                pixels[k] = _unindexed(pixels[k], width, size, data)
    return [Image(w, h, p) for (w, h), p in zip(heads, pixels, strict=True)]


def _window(data: np.ndarray) -> np.ndarray:
    """The 64 bits from every byte on."""
    out = np.zeros(len(data) - 8, np.int64)
    for k in range(8):
        out |= data[k : len(out) + k].astype(np.int64) << (8 * k)
    return out


def read_pixels(jobs: list[Job], window: np.ndarray) -> None:
    """Fill in the jobs' pixels and move their bits past them, all jobs in step."""
    if not jobs:
        return
    codes: dict[int, int] = {}
    pool: list[Code] = []
    for j in jobs:
        for c in (c for g in j.groups for c in g):
            if id(c) not in codes:
                codes[id(c)] = len(pool)
                pool.append(c)
    table = np.concatenate([c.table for c in pool])
    start = np.cumsum([0] + [len(c.table) for c in pool])
    groups = np.array([[codes[id(c)] for c in g] for j in jobs for g in j.groups]).T
    offset, mask = start[groups], np.array([(1 << c.bits) - 1 for c in pool])[groups]
    base = np.cumsum([0] + [len(j.groups) for j in jobs])[:-1]
    blocks = any(j.which is not None for j in jobs)
    which = np.concatenate([j.which if j.which is not None else np.zeros(1, np.int64) for j in jobs])
    which_at = np.cumsum([0] + [len(j.which) if j.which is not None else 1 for j in jobs])[:-1]
    size = np.array([j.block if j.which is not None else 31 for j in jobs])
    width = np.array([j.width for j in jobs])
    wide = (width + (1 << size) - 1) >> size
    alpha = blocks or bool((mask[3] > 0).any())  # else it takes no bits and is put in later

    lane = np.arange(len(jobs))
    pos, end = (np.array([getattr(j.bits, a) for j in jobs]) for a in ("pos", "end"))
    out, total = np.zeros(len(jobs), np.int64), np.array([j.width * j.height for j in jobs])
    off, msk = offset[:, base], mask[:, base]
    ends = pos.copy()
    lanes, greens, reds, blues, alphas, copies = [], [], [], [], [], []
    n_tokens = 0
    while len(lane):
        if blocks:
            y, x = np.divmod(out, width[lane])
            g = base[lane] + which[which_at[lane] + (y >> size[lane]) * wide[lane] + (x >> size[lane])]
            off, msk = offset[:, g], mask[:, g]
        w = window[pos >> 3] >> (pos & 7)
        green = table[off[0] + (w & msk[0])]
        n = green & 15
        w >>= n
        red = table[off[1] + (w & msk[1])]
        m = red & 15
        w >>= m
        blue = table[off[2] + (w & msk[2])]
        m += blue & 15
        if alpha:
            far = pos + n + m
            entry = table[off[3] + ((window[far >> 3] >> (far & 7)) & msk[3])]
            m += entry & 15
            alphas.append(entry)
        step = 1
        other = green >= 256 << 4
        if other.any():
            m[other] = 0
            k = np.flatnonzero(other & (green < 280 << 4))
            if len(k):
                at = pos[k] + n[k]
                long, extra = _value((green[k] >> 4).astype(np.int64) - 256, window[at >> 3] >> (at & 7))
                at += extra
                w = window[at >> 3] >> (at & 7)
                entry = table[off[4][k] + (w & msk[4][k])]
                far, extra = _value((entry >> 4).astype(np.int64), w >> (entry & 15))
                at += (entry & 15) + extra
                m[k] = at - pos[k] - n[k]
                near = far <= len(NEAR)
                at = np.minimum(far, len(NEAR)) - 1
                dist = np.where(near, np.maximum(1, NEAR[at, 0] + NEAR[at, 1] * width[lane[k]]), far - len(NEAR))
                copies.append((n_tokens + k, dist, long))
                step = np.ones(len(lane), np.int64)
                step[k] = long
        lanes.append(lane), greens.append(green), reds.append(red), blues.append(blue)
        n_tokens += len(lane)
        pos = pos + n + m
        out = out + step
        left = out < total[lane]
        if not left.all():
            ends[lane[~left]] = pos[~left]
            keep = np.flatnonzero(left)
            lane, pos, out = lane[keep], pos[keep], out[keep]
            off, msk = off[:, keep], msk[:, keep]
        if len(lanes) % 64 == 0 and (pos > end[lane]).any():
            raise ValueError("the stream ends early")
    if (ends > end).any():
        raise ValueError("the stream ends early")
    for j, e in zip(jobs, ends.tolist(), strict=True):
        j.bits.pos = e
    lane = np.concatenate(lanes).astype(np.uint16 if len(jobs) < 1 << 16 else np.int64)
    order = np.argsort(lane, kind="stable")
    kind = np.concatenate(greens) >> 4
    value = (np.concatenate(reds) >> 4 << 16 | kind << 8 | np.concatenate(blues) >> 4).astype(np.int64)
    if alpha:
        value |= (np.concatenate(alphas) >> 4).astype(np.int64) << 24
    else:
        value |= (table[offset[3, base]].astype(np.int64) >> 4 << 24)[lane]
    value = np.where(kind < 256, value, kind - 280)
    dist = np.zeros(n_tokens, np.int64)
    for at, d, long in copies:
        dist[at], value[at] = d, long
    value, kind = value[order], kind[order]
    _settle(jobs, lane[order].astype(np.int64), value, kind, dist[order], total)


def _value(prefix: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What length and distance prefixes with their extra bits stand for, and the number of these."""
    extra = np.where(prefix < 4, 0, (prefix - 2) >> 1)
    low = np.where(prefix < 4, prefix, (2 + (prefix & 1)) << extra)
    return low + (w & ((1 << extra) - 1)) + 1, extra


def _followed(to: np.ndarray) -> np.ndarray:
    """Where pointers lead in the end; pointers lead to smaller places or themselves."""
    while True:
        far = to[to]
        if (far == to).all():
            return to
        to = far


def _settle(jobs: list[Job], lane: np.ndarray, value: np.ndarray, kind: np.ndarray, dist: np.ndarray, total: np.ndarray) -> None:
    """The pixels that tokens in order of jobs stand for."""
    copy, cached = dist > 0, kind >= 280
    size = np.where(copy, value, 1)
    begin = np.cumsum(size) - size
    first = np.cumsum(total) - total
    n = int(size.sum())
    if n != int(total.sum()) or (begin[copy] - first[lane[copy]] < dist[copy]).any():
        raise ValueError("a copy leaves its image")
    argb = np.zeros(n + 1, np.int64)  # the last is an empty place of the cache
    plain = ~copy & ~cached
    argb[begin[plain]] = value[plain]
    to = np.arange(n + 1)
    spread = ragged(begin[copy], size[copy])
    to[spread] = spread - np.repeat(dist[copy], size[copy])
    to = _followed(to)
    if cached.any():
        bits = np.array([j.cache for j in jobs])
        own = np.repeat(bits, total)
        key = np.zeros(n, np.int64)
        has = own > 0
        key[has] = cache_key(argb[:n][has], own[has])
        key[begin[cached]] = value[cached]
        key = key[to[:n]] + (np.repeat(np.arange(len(jobs)), total) << 11)
        order = by_key(key)
        same = key[order][1:] == key[order][:-1]
        before = np.full(n, n)
        before[order[1:][same]] = order[:-1][same]
        at = begin[cached]
        # An empty place is the last of all: the only pointer that leads up.
        to[at] = before[at]
        while True:
            far = to[to]
            if (far == to).all():
                break
            to = far
    argb = argb[to[:n]].astype(np.uint32)
    for j, a, t in zip(jobs, first, total, strict=True):
        j.pixels = argb[a : a + t]


# --- transforms


def subtract_green(argb: np.ndarray, back: bool) -> np.ndarray:
    c = split(argb).copy()
    for k in (1, 3):
        c[:, k] = c[:, k] + c[:, 2] if back else c[:, k] - c[:, 2]
    return joined(c)


def _blocks(n: int, width: int, size: int) -> np.ndarray:
    """Each pixel's block."""
    y, x = np.divmod(np.arange(n), width)
    return (y >> size) * _across(width, size) + (x >> size)


def cross_colour(argb: np.ndarray, width: int, size: int, data: np.ndarray, back: bool) -> np.ndarray:
    c = split(argb).copy()
    how = split(data)[_blocks(len(c), width, size)].view(np.int8).astype(np.int32)
    signed = lambda v: v.astype(np.uint8).view(np.int8).astype(np.int32)
    green, sign = signed(c[:, 2]), 1 if back else -1
    red = c[:, 1].astype(np.int32)
    new = red + sign * ((how[:, 3] * green) >> 5)
    blue = c[:, 3].astype(np.int32) + sign * (((how[:, 2] * green) >> 5) + ((how[:, 1] * signed((new if back else red) & 255)) >> 5))
    c[:, 1], c[:, 3] = new & 255, blue & 255
    return joined(c)


def predicted(mode: int, left: np.ndarray, top: np.ndarray, corner: np.ndarray, right: np.ndarray) -> np.ndarray:
    """What a mode foretells of pixels from those left, above, above left and above right; (n, 4) int16."""
    half = lambda a, b: (a + b) >> 1
    if mode == 11:
        near_left, near_top = np.abs(top - corner).sum(1), np.abs(left - corner).sum(1)
        return np.where((near_left < near_top)[:, None], left, top)
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        mean = half(left, top)
        d = mean - corner
        return np.clip(mean + (d + (d < 0)) // 2, 0, 255)
    simple = {
        1: lambda: left, 2: lambda: top, 3: lambda: right, 4: lambda: corner,
        5: lambda: half(half(left, right), top), 6: lambda: half(left, corner), 7: lambda: half(left, top),
        8: lambda: half(corner, top), 9: lambda: half(top, right), 10: lambda: half(half(left, corner), half(top, right)),
    }
    if mode in simple:
        return simple[mode]()
    out = np.zeros_like(left)
    out[:, 0] = 255
    return out


def _modes(n: int, width: int, size: int, data: np.ndarray) -> np.ndarray:
    """Each pixel's mode; the first row and column have their own."""
    at = np.arange(n)
    mode = ((data[_blocks(n, width, size)] >> 8) & 15).astype(np.int64)
    mode[at % width == 0] = 2
    mode[at < width] = 1
    mode[:1] = 0
    return mode


def _unpredict(images: list[tuple[np.ndarray, int, int, np.ndarray]]) -> list[np.ndarray]:
    """Images (residuals, width, block size, modes) restored, diagonal by diagonal."""
    if not images:
        return []
    count = [len(p) for p, *_ in images]
    margin = max(w for _, w, *_ in images) + 1
    c = np.zeros((margin + sum(count), 4), np.int16)
    c[margin:] = np.concatenate([split(p) for p, *_ in images])
    mode = np.concatenate([_modes(n, w, s, d) for n, (_, w, s, d) in zip(count, images, strict=True)])
    wide = np.repeat([w for _, w, *_ in images], count)
    at = np.concatenate([np.arange(n) for n in count])
    when = at % wide + 2 * (at // wide)
    order = np.argsort(when, kind="stable")
    for p in np.split(order, np.flatnonzero(np.diff(when[order])) + 1):
        q, w = p + margin, wide[p]
        left, top, corner, right = c[q - 1], c[q - w], c[q - w - 1], c[q - w + 1]
        own = mode[p]
        for m in np.unique(own):
            k = np.flatnonzero(own == m)
            c[q[k]] = (c[q[k]] + predicted(int(m), left[k], top[k], corner[k], right[k])) & 255
    out = joined(c[margin:].astype(np.uint8))
    return np.split(out, np.cumsum(count)[:-1])


def _around(argb: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Left, top, corner and right neighbours of every pixel, as the format counts them."""
    c = np.vstack([np.zeros((width + 1, 4), np.int16), split(argb).astype(np.int16)])
    at = np.arange(len(argb)) + width + 1
    return c[at - 1], c[at - width], c[at - width - 1], c[at - width + 1]


def predict(argb: np.ndarray, width: int, size: int, modes: tuple[int, ...] = tuple(range(14))) -> tuple[np.ndarray, np.ndarray]:
    """Residuals and the image of modes: for each block the mode of least residuals."""
    own, around = split(argb).astype(np.int16), _around(argb, width)
    block = _blocks(len(argb), width, size)
    cost = []
    for m in modes:
        r = (own - predicted(m, *around)) & 255
        cost.append(np.bincount(block, np.minimum(r, 256 - r).sum(1), int(block[-1]) + 1))
    data = 0xFF000000 | (np.array(modes)[np.argmin(cost, axis=0)] << 8).astype(np.uint32)
    mode = _modes(len(argb), width, size, data)
    out = np.empty_like(own)
    for m in np.unique(mode):
        k = np.flatnonzero(mode == m)
        out[k] = (own[k] - predicted(int(m), *(x[k] for x in around))) & 255
    return joined(out.astype(np.uint8)), data


def colour_factors(argb: np.ndarray, width: int, size: int) -> np.ndarray:
    """For each block the factors by which red and blue follow green, and blue red: least squares in 32nds."""
    block = _blocks(len(argb), width, size)
    c = split(argb).view(np.int8).astype(np.float64)
    sums = lambda v: np.bincount(block, v, int(block[-1]) + 1)

    def factor(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.clip(np.round(32 * sums(x * y) / np.maximum(1, sums(x * x))), -128, 127).astype(np.int64)

    g2r, g2b = factor(c[:, 2], c[:, 1]), factor(c[:, 2], c[:, 3])
    left = c[:, 3] - g2b[block] * c[:, 2] / 32
    r2b = factor(c[:, 1], left)
    return (0xFF000000 | (r2b & 255) << 16 | (g2b & 255) << 8 | (g2r & 255)).astype(np.uint32)


def indexed(argb: np.ndarray, width: int) -> tuple[np.ndarray, int, int, np.ndarray]:
    """(packed pixels, their width, pixels a byte as a power of two, colours) of an image of at most 256 colours."""
    colours, at = np.unique(argb, return_inverse=True)
    size = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
    wide, each = _across(width, size), 8 >> size
    rows = at.reshape(-1, width)
    packed = np.zeros((len(rows), wide), np.int64)
    for k in range(1 << size):
        part = rows[:, k :: 1 << size]
        packed[:, : part.shape[1]] |= part << (k * each)
    return (0xFF000000 | packed.ravel() << 8).astype(np.uint32), wide, size, colours


def _unindexed(argb: np.ndarray, width: int, size: int, colours: np.ndarray) -> np.ndarray:
    wide, each = _across(width, size), 8 >> size
    green = ((argb.astype(np.int64) >> 8) & 255).reshape(-1, wide)
    x = np.arange(width)
    at = (green[:, x >> size] >> ((x & ((1 << size) - 1)) * each)) & ((1 << each) - 1)
    return np.append(colours, np.zeros(256, np.uint32))[at.ravel()].astype(np.uint32)


# --- encoding


class Segments:
    """Runs of bits that are put one after another in the end."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.fields: list[tuple[int, int, int]] = []
        self.many = 0

    def add(self, value: np.ndarray, bits: np.ndarray, owner: np.ndarray, many: int) -> np.ndarray:
        """``many`` new segments of numbers, of which ``owner`` (ascending) says whose they are; their names."""
        self.parts.append((value.astype(U64), bits, owner + self.many))
        self.many += many
        return np.arange(self.many - many, self.many)

    def one(self, *fields: tuple[int, int]) -> int:
        """A segment of (number, bits)."""
        self.fields += [(v, n, self.many) for v, n in fields]
        self.many += 1
        return self.many - 1

    def bytes(self, layouts: list[list[int]]) -> list[bytes]:
        """The bytes of each layout's segments, every segment being in one layout."""
        if self.fields:
            value, wide, owner = zip(*self.fields, strict=True)
            self.parts.append((np.array(value, U64), np.array(wide), np.array(owner)))
        size = np.zeros(self.many, np.int64)
        for _, wide, owner in self.parts:
            size += np.bincount(owner, wide, self.many).astype(np.int64)
        of, count = np.concatenate([np.array(x) for x in layouts]), np.array([len(x) for x in layouts])
        ends = np.cumsum(size[of])
        last = ends[np.cumsum(count) - 1]
        bits = np.diff(np.append(0, last))
        whole = -(-bits // 64) * 64
        start = np.zeros(self.many, np.int64)
        start[of] = ends - size[of] + np.repeat(np.cumsum(whole) - whole - (last - bits), count)
        words = np.zeros(int(whole.sum()) // 64 + 1, U64)
        for value, wide, owner in self.parts:
            begin = np.cumsum(wide) - wide
            new = np.append(True, owner[1:] != owner[:-1])[: len(owner)]
            at = start[owner] + begin - np.maximum.accumulate(np.where(new, begin, 0))
            if (at[1:] < at[:-1]).any():
                order = np.argsort(at, kind="stable")
                at, value = at[order], value[order]
            word, shift = at >> 6, (at & 63).astype(U64)
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            words[word[first]] |= np.bitwise_or.reduceat(value << shift, first)
            over = np.flatnonzero(shift)
            high = value[over] >> (U64(64) - shift[over])
            over, high = over[high > 0], high[high > 0]
            words[word[over] + 1] |= high  # one number at most goes over a word's end
        data = words.tobytes()
        return [data[a // 8 : a // 8 + -(-n // 8)] for a, n in zip((np.cumsum(whole) - whole).tolist(), bits.tolist(), strict=True)]


@dataclass
class Coded:
    """An image to be entropy-coded; ``which`` gives each pixel's group of codes, ``cache`` the cache's bits at most."""

    argb: np.ndarray
    width: int
    cache: int = 0
    copies: bool = True
    which: np.ndarray | None = None


def _prefix(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix, number of extra bits and these, of lengths and distances from 1 on."""
    v = v - 1
    high = np.frexp(np.maximum(v, 1))[1] - 1
    extra = np.where(v < 4, 0, high - 1)
    prefix = np.where(v < 4, v, 2 * high + ((v >> np.maximum(high - 1, 0)) & 1))
    return prefix, extra, np.where(v < 4, 0, v & ((1 << extra) - 1))


def _copies(px: np.ndarray, owner: np.ndarray, allowed: np.ndarray) -> list[tuple[int, int, int]]:
    """(first pixel, length, distance) of copies of four pixels or more, not overlapping."""
    n = len(px) - 3
    if n <= 0:
        return []
    wide = px.astype(U64)
    key = mix(wide[:n] | wide[1 : n + 1] << U64(32)) + (wide[2 : n + 2] << U64(32))
    # Within an image alone, so that what is found does not depend on the images beside it.
    key = (mix(key + wide[3:]) >> U64(40)).astype(np.int64) | owner[:n] << 24
    order = by_key(key)
    same = np.flatnonzero(key[order][1:] == key[order][:-1])
    dist = np.zeros(n, np.int64)
    dist[order[same + 1]] = order[same + 1] - order[same]
    at = np.flatnonzero(dist)
    good = allowed[at] & (dist[at] <= MOST_DISTANCE) & (owner[at + 3] == owner[at]) & (owner[at - dist[at]] == owner[at])
    for k in range(4):
        good &= px[at + k] == px[at - dist[at] + k]
    at = at[good]
    d = dist[at]
    first = np.flatnonzero(np.append(True, (np.diff(at) != 1) | (np.diff(d) != 0) | (np.diff(owner[at]) != 0))) if len(at) else at
    out, end = [], 0
    for a, b, far in zip(at[first].tolist(), (at[np.append(first[1:], len(at)) - 1] + 4).tolist() if len(at) else [], d[first].tolist(), strict=True):
        a = max(a, end)
        while b - a >= 4:
            long = min(b - a, MOST_LENGTH)
            out.append((a, long, far))
            end = a = a + long
    return out


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Lengths of complete prefix codes, a row each: the logarithms of the symbols' shares, and what is left over shortens the most frequent that it can."""
    total = counts.sum(1, keepdims=True)
    used = counts > 0
    few = used.sum(1) < 2
    share = np.maximum(counts / np.maximum(total, 1), 1 / 256) * used  # none is much longer, so that tables stay small
    share /= np.maximum(share.sum(1, keepdims=True), 1e-9)
    length = np.where(used, np.clip(np.ceil(-np.log2(np.where(used, share, 1)) - 1e-9), 1, LONGEST), 0).astype(np.int64)
    left = (1 << LONGEST) - (np.where(used, 1 << (LONGEST - length), 0)).sum(1)
    left[few] = 0
    order = np.argsort(-counts, axis=1, kind="stable")
    most, rows = int(used.sum(1).max(initial=0)), np.arange(len(counts))
    while (left > 0).any():
        for k in range(most):
            s = order[:, k]
            n = length[rows, s]
            step = np.where(n > 1, 1 << (LONGEST - n), 1 << 20)
            take = (step <= left) & (n > 0)
            left = left - np.where(take, step, 0)
            length[rows, s] = n - take
    length[few & used.any(1)] = used[few & used.any(1)]
    return length


def code_bits(length: np.ndarray) -> np.ndarray:
    """The canonical codes, first bit lowest."""
    rows, alphabet = length.shape
    order = np.argsort(np.where(length > 0, length, LONGEST + 1), axis=1, kind="stable")
    own = np.take_along_axis(length, order, 1)
    share = np.where(own > 0, 1 << (LONGEST - own), 0)
    code = np.zeros_like(length)
    np.put_along_axis(code, order, REVERSED[np.minimum(np.cumsum(share, axis=1) - share, (1 << LONGEST) - 1)], 1)
    return code


#: Lengths of the code that writes code lengths: the usual ones short, 16 not used.
LENGTH_LENGTHS = np.array([3, 7, 7, 5, 5, 3, 3, 3, 3, 4, 4, 6, 7, 7, 7, 7, 0, 4, 4])
LENGTH_BITS = code_bits(LENGTH_LENGTHS[None])[0]


def _code_segments(out: Segments, length: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """Segments that say the codes; alphabet: the symbols that each code has to tell of."""
    rows, symbol = np.nonzero(length)
    count = np.bincount(rows, minlength=len(length))
    top = np.zeros(len(length), np.int64)
    np.maximum.at(top, rows, symbol)
    simple = (count < 2) & (top < 256)
    # A single symbol, or none: 1, no second one, eight bits of it.
    value, bits = np.where(simple, 0b101 | top << 3, 30 << 0), np.where(simple, 11, 5)
    head = [(value, bits)]
    head += [(np.full(len(length), LENGTH_LENGTHS[s]), np.where(simple, 0, 3)) for s in LENGTH_ORDER]
    head.append((np.zeros(len(length), np.int64), np.where(simple, 0, 1)))
    heads = [np.stack([np.broadcast_to(x[i], (len(length),)) for x in head], 1) for i in (0, 1)]
    # The lengths themselves: for each symbol that is used the gap before it and its length, then the last gap.
    kept = ~simple[rows]
    rows, symbol = rows[kept], symbol[kept]
    last = np.flatnonzero(~simple)
    r = np.concatenate([rows, last])
    s = np.concatenate([symbol, alphabet[last]])
    n = np.concatenate([length[rows, symbol], np.full(len(last), -1)])
    order = np.lexsort((s, r))
    r, s, n = r[order], s[order], n[order]
    gap = s - np.where(np.append(True, r[1:] != r[:-1]), 0, np.append(0, s[:-1] + 1))
    cells = []
    while len(gap) and (gap > 0).any():
        long, mid = gap >= 11, (gap >= 3) & (gap < 11)
        run = np.where(long, np.minimum(gap, 138), np.where(mid, gap, np.minimum(gap, 1)))
        own = np.where(long, 18, np.where(mid, 17, 0))
        k = LENGTH_LENGTHS[own]
        cells.append((LENGTH_BITS[own] | (np.where(long, run - 11, np.where(mid, run - 3, 0)) << k), np.where(gap > 0, k + np.where(long, 7, np.where(mid, 3, 0)), 0)))
        gap = gap - run
    own = np.maximum(n, 0)
    cells.append((LENGTH_BITS[own], np.where(n >= 0, LENGTH_LENGTHS[own], 0)))
    value = np.concatenate([heads[0].ravel(), np.stack([c[0] for c in cells], 1).ravel()])
    bits = np.concatenate([heads[1].ravel(), np.stack([c[1] for c in cells], 1).ravel()])
    owner = np.concatenate([np.repeat(np.arange(len(length)), heads[0].shape[1]), np.repeat(r, len(cells))])
    order = np.argsort(owner, kind="stable")
    return out.add(np.where(bits[order] > 0, value[order], 0), bits[order], owner[order], len(length))


def entropy(out: Segments, images: list[Coded]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Segments of the images' pixels, their caches' bits, and the segments of their groups of codes."""
    count = np.array([len(i.argb) for i in images])
    px = np.concatenate([i.argb for i in images]).astype(np.int64)
    owner = np.repeat(np.arange(len(images)), count)
    many = np.array([1 if i.which is None else int(i.which.max()) + 1 for i in images])
    base = np.cumsum(many) - many
    group = np.repeat(base, count) + np.concatenate([np.zeros(len(i.argb), np.int64) if i.which is None else i.which for i in images])
    # Tokens: pixels that no copy covers, and copies.
    found = _copies(px, owner, np.repeat([i.copies for i in images], count))
    begin, long, far = (np.array(x, np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    inside = np.zeros(len(px) + 1, np.int64)
    np.add.at(inside, begin, 1)
    np.add.at(inside, begin + long, -1)
    is_copy = np.zeros(len(px), bool)
    is_copy[begin] = True
    token = np.flatnonzero((np.cumsum(inside[:-1]) == 0) | is_copy)
    copy = is_copy[token]
    # Cache hits: the last pixel before of the same hash is the same.
    cache = np.array([i.cache for i in images])
    if cache.any():
        own = np.repeat(cache, count)
        slot = np.where(own > 0, cache_key(px, np.maximum(own, 1)), 0)
        key = slot + (owner << 11)
        order = by_key(key)
        again = (key[order][1:] == key[order][:-1]) & (px[order][1:] == px[order][:-1])
        hit = np.zeros(len(px), bool)
        hit[order[1:][again]] = True
        hit = hit[token] & ~copy & (cache[owner[token]] > 0)
        worth = np.bincount(owner[token], hit, len(images)) >= (1 << cache) / 4
        cache = np.where(worth, cache, 0)
        hit &= cache[owner[token]] > 0
    else:
        slot, hit = np.zeros(len(px), np.int64), np.zeros(len(token), bool)
    c = split(px.astype(np.uint32)).astype(np.int64)[token]
    green = np.where(hit, 280 + slot[token], c[:, 2])
    prefix, extra, rest = _prefix(long)
    green[copy] = 256 + prefix
    distance, extra_far, rest_far = _prefix(far + len(NEAR))
    plain = ~hit & ~copy
    g = group[token]
    alphabet = np.repeat(280 + np.where(cache > 0, 1 << cache, 0), many)
    sets = int(many.sum())

    def coded(symbol: np.ndarray, of: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray]:
        counts = np.bincount(of * wide + symbol, minlength=sets * wide).reshape(sets, wide)
        n = code_lengths(counts)
        return n, code_bits(n)

    kinds = [coded(green, g, int(alphabet.max())), *(coded(c[plain, k], g[plain], 256) for k in (1, 3, 0)), coded(distance, g[copy], 40)]
    single = [(n > 0).sum(1) < 2 for n, _ in kinds]
    codes = [_code_segments(out, n, alphabet if k == 0 else np.full(sets, n.shape[1])) for k, (n, _) in enumerate(kinds)]

    def cost(k: int, of: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, code = kinds[k]
        bits = np.where(single[k][of], 0, n[of, symbol])
        return np.where(bits > 0, code[of, symbol], 0), bits

    value, bits = cost(0, g, green)
    at = np.flatnonzero(plain)
    for k, channel in ((1, 1), (2, 3), (3, 0)):
        v, n = cost(k, g[at], c[at, channel])
        value[at] |= v << bits[at]
        bits[at] += n
    at = np.flatnonzero(copy)
    v, n = cost(4, g[at], distance)
    for number, size in ((rest, extra), (v, n), (rest_far, extra_far)):
        value[at] |= number << bits[at]
        bits[at] += size
    pixels = out.add(value, bits, owner[token], len(images))
    by_group = np.stack(codes, 1)
    return pixels, cache, [by_group[a : a + m].ravel() for a, m in zip(base, many, strict=True)]


@dataclass
class Plan:
    """How an image is written: transforms in order of writing, each (kind, block size), the cache's bits, copies, and blocks of two groups of codes."""

    transforms: tuple[tuple[int, int], ...] = ()
    cache: int = 0
    copies: bool = True
    groups: int | None = None


def encode(images: list[Image], plans: list[Plan]) -> list[bytes]:
    """WebP files of the images."""
    out, layouts, jobs, places = Segments(), [], [], []
    for image, plan in zip(images, plans, strict=True):
        argb, width = image.argb, image.width
        opaque = not len(argb) or bool((argb >> 24 == 255).all())
        layout: list = [out.one((0x2F, 8), (width - 1, 14), (image.height - 1, 14), (int(not opaque), 1), (0, 3))]
        for kind, size in plan.transforms:
            if kind == PALETTE:
                argb, width, size, colours = indexed(argb, width)
                layout.append(out.one((1, 1), (kind, 2), (len(colours) - 1, 8)))
                steps = split(colours).copy()
                steps[1:] -= split(colours)[:-1]
                jobs.append(Coded(joined(steps), len(colours)))
            elif kind == SUBTRACT_GREEN:
                argb = subtract_green(argb, back=False)
                layout.append(out.one((1, 1), (kind, 2)))
                continue
            else:
                if kind == PREDICTOR:
                    argb, data = predict(argb, width, size)
                else:
                    data = colour_factors(argb, width, size)
                    argb = cross_colour(argb, width, size, data, back=False)
                layout.append(out.one((1, 1), (kind, 2), (size - 2, 3)))
                jobs.append(Coded(data, _across(width, size)))
            layout.append(("small", len(jobs) - 1))
        layout.append(out.one((0, 1)))
        which = None
        if plan.groups is not None:
            wide = _across(width, plan.groups)
            of = np.arange(wide * _across(image.height, plan.groups)) % 2
            which = of[_blocks(len(argb), width, plan.groups)]
            jobs.append(Coded((0xFF000000 | of << 8).astype(np.uint32), wide))
            layout.append(("groups", len(jobs) - 1, plan.groups))
        jobs.append(Coded(argb, width, plan.cache, plan.copies, which))
        layout.append(("main", len(jobs) - 1))
        layouts.append(layout)
    pixels, cache, codes = entropy(out, jobs) if jobs else (np.zeros(0, np.int64), np.zeros(0, np.int64), [])

    def whole(layout: list) -> Iterator[int]:
        head: list[int] = []
        for x in layout:
            if isinstance(x, int):
                yield x
                continue
            kind, k = x[0], x[1]
            info = out.one((1, 1), (int(cache[k]), 4)) if cache[k] else out.one((0, 1))
            if kind == "groups":
                head = [out.one((1, 1), (x[2] - 2, 3)), info, *codes[k].tolist(), int(pixels[k])]
                continue
            yield info
            if kind == "main":
                yield from head or [out.one((0, 1))]
            yield from codes[k].tolist()
            yield int(pixels[k])

    laid = [list(whole(x)) for x in layouts]
    files = []
    for stream in out.bytes(laid) if laid else []:
        pad = len(stream) & 1
        size = len(stream).to_bytes(4, "little")
        files.append(b"RIFF" + (12 + len(stream) + pad).to_bytes(4, "little") + b"WEBPVP8L" + size + stream + bytes(pad))
    return files
