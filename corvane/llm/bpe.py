"""Byte-pair encoding and decoding over a contiguous rank array.

A short word's part ids and the ranks of its adjacent pairs lie side by side in
one row of an array. Each step scans the row for the least rank, deletes the
boundary at its leftmost place, and looks up anew only the two ranks beside it.
Many words of like length are stepped together. Scanning a whole row a merge costs
the square of a word's length, so words longer than ``SHORT`` bytes keep their
boundaries as links and their ranks in a heap instead; the result is the same.

Words met before are found again by their bytes: those of up to seven are a number
each, with their length, in an open-addressed table, longer ones keys of a
dictionary. The tables start anew beyond ``most`` words or ``most_bytes`` bytes.
"""

from __future__ import annotations

import json
import unicodedata
from itertools import repeat

import numpy as np

from corvane.llm.textscan import SPACE, U64, mix, owner, ragged, runs

SHORT = 48
FAR = np.int32(2**31 - 1)

# The code points that match \s in the tokenizers' patterns.
WHITE = (
    9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000
)
OTHER, LETTER, NUMBER, BLANK = 0, 1, 2, 3


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(spare)) for b in range(256)]


_CLASSES: list[np.ndarray] = []


def classes() -> np.ndarray:
    """The class of every code point: letter, number, blank or other."""
    if not _CLASSES:
        t = np.zeros(0x110000, np.uint8)
        for cp in range(0x110000):
            c = unicodedata.category(chr(cp))[0]
            if c == "L":
                t[cp] = LETTER
            elif c == "N":
                t[cp] = NUMBER
        t[list(WHITE)] = BLANK
        _CLASSES.append(t)
    return _CLASSES[0]


class Ranks:
    """Vocabulary and merge ranks of a tokenizers BPE file."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        vocab = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        chars = byte_chars()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.first = np.array([vocab[c] for c in chars], np.int32)
        self.last = np.array([vocab[c + suffix] for c in chars], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        a = np.array([vocab[x] for x, _ in pairs], np.int64)
        b = np.array([vocab[y] for _, y in pairs], np.int64)
        self.made = np.array([vocab[x + y] for x, y in pairs] or [0], np.int32)
        self.bits = 20
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, FAR, np.int32)
        left, rank, self.probes = (a << 20) | b, np.arange(len(a), dtype=np.int32), 0
        todo = np.arange(len(a))
        while len(todo):
            slot = (self._slot(left[todo]) + self.probes) & ((1 << self.bits) - 1)
            free = self.keys[slot] < 0
            winner = np.full(1 << self.bits, -1, np.int64)
            winner[slot[free][::-1]] = todo[free][::-1]
            won = free & (winner[slot] == todo)
            self.keys[slot[won]], self.ranks[slot[won]] = left[todo[won]], rank[todo[won]]
            todo = todo[~won]
            self.probes += 1
        back = {c: i for i, c in enumerate(chars)}
        spelled = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in vocab.items():
            body = token.removesuffix(suffix) if suffix else token
            spelled[i] = bytes(back[c] for c in body) if all(c in back for c in body) else token.encode()
        for token, i in self.special.items():
            spelled[i] = token.encode()
        self.spelled_off = np.concatenate([[0], np.cumsum([len(x) for x in spelled])]).astype(np.int64)
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(U64) * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The merge ranks of pairs of ids; FAR where there is none or an id is negative."""
        key = (a.astype(np.int64) << 20) | b
        slot = self._slot(key)
        out = np.where(self.keys[slot] == key, self.ranks[slot], FAR)
        rest = np.flatnonzero((self.keys[slot] != key) & (self.keys[slot] >= 0) & (a >= 0) & (b >= 0))
        for p in range(1, self.probes):
            if not len(rest):
                break
            at = (slot[rest] + p) & ((1 << self.bits) - 1)
            found = self.keys[at] == key[rest]
            out[rest[found]] = self.ranks[at[found]]
            rest = rest[~found & (self.keys[at] >= 0)]
        out[(a < 0) | (b < 0)] = FAR
        return out

    def _array(self, buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and counts of words of at most as many bytes as the longest."""
        n, width = len(start), int(size.max())
        col = np.arange(width)
        inside = col < size[:, None]
        at = np.minimum(start[:, None] + col, len(buf) - 1)
        ids = np.where(inside, self.first[buf[at]], -1).astype(np.int32)
        ids[np.arange(n), size - 1] = self.last[buf[start + size - 1]]
        ranks = np.full((n, width), FAR, np.int32)
        if width > 1:
            ranks[:, :-1] = self.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
        count = size.copy()
        live = np.arange(n)
        while len(live):
            j = ranks.argmin(1) if len(live) == n else ranks[live].argmin(1)
            least = ranks[live, j]
            going = least < FAR
            live, j, least = live[going], j[going], least[going]
            if not len(live):
                break
            shift = np.minimum(col + (col > j[:, None]), width - 1)
            part = np.take_along_axis(ids[live], shift, 1)
            part[:, -1] = np.where(j + 1 < width, -1, part[:, -1])
            rank = np.take_along_axis(ranks[live], shift, 1)
            rank[:, -1] = FAR
            r = np.arange(len(live))
            part[r, j] = self.made[least]
            left = np.maximum(j - 1, 0)
            fresh = self.rank(np.where(j > 0, part[r, left], -1), part[r, j])
            rank[r, left] = np.where(j > 0, fresh, rank[r, left])
            right = np.minimum(j + 1, width - 1)
            rank[r, j] = np.where(j + 1 < width, self.rank(part[r, j], part[r, right]), FAR)
            ids[live], ranks[live] = part, rank
            count[live] -= 1
        return ids[col < count[:, None]], count

    def encode(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the words buf[start:end], and the bounds of each word's ids."""
        size = end - start
        counts = np.zeros(len(start), np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        low = 0
        for high in (4, 8, 12, 16, 24, 32, SHORT):
            picked = np.flatnonzero((size > low) & (size <= high))
            for k in range(0, len(picked), 50_000):
                rows = picked[k : k + 50_000]
                ids, counts[rows] = self._array(buf, start[rows], size[rows])
                done.append((rows, ids))
            low = high
        for r in np.flatnonzero(size > SHORT):
            ids = self._long(buf[start[r] : end[r]])
            counts[r] = len(ids)
            done.append((np.array([r]), ids))
        off = np.concatenate([[0], np.cumsum(counts)])
        out = np.zeros(off[-1], np.int32)
        for rows, ids in done:
            out[ragged(off[rows], counts[rows])] = ids
        return out, off

    def _long(self, word: np.ndarray) -> np.ndarray:
        """A long word: boundaries as links, pairs in a heap, stale entries skipped."""
        import heapq

        n = len(word)
        ids = self.first[word].tolist()
        ids[-1] = int(self.last[word[-1]])
        nxt, prv = [*range(1, n), -1], [-1, *range(n - 1)]
        got = self.rank(np.array(ids[:-1]), np.array(ids[1:])).tolist()
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(got) if r < FAR]
        heapq.heapify(heap)

        def push(i: int) -> None:
            if i >= 0 and nxt[i] >= 0:
                r = self._one(ids[i], ids[nxt[i]])
                if r < FAR:
                    heapq.heappush(heap, (r, i, ids[i], ids[nxt[i]]))

        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], nxt[i] = int(self.made[r]), -1, nxt[j]
            if nxt[i] >= 0:
                prv[nxt[i]] = i
            push(i)
            push(prv[i])
        return np.array([x for x in ids if x >= 0], np.int32)

    def _one(self, a: int, b: int) -> int:
        key = (a << 20) | b
        slot = ((key * 0x9E3779B97F4A7C15) % (1 << 64)) >> (64 - self.bits)
        for p in range(self.probes):
            at = (slot + p) & ((1 << self.bits) - 1)
            k = self.keys[at]
            if k == key:
                return int(self.ranks[at])
            if k < 0:
                break
        return int(FAR)

    def decode(self, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes that the ids spell, and each row's bounds in them."""
        size = self.spelled_off[1:] - self.spelled_off[:-1]
        n = size[ids]
        ends = np.concatenate([[0], np.cumsum(n)])
        return self.spelled[ragged(self.spelled_off[ids], n)], ends[off]


class Known:
    """Words of up to seven bytes, packed with their length into a number: an open-addressed table."""

    def __init__(self, bits: int = 22):
        self.bits = bits
        self.keys = np.zeros(1 << bits, U64)
        self.at = np.zeros(1 << bits, np.int32)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (mix(key) >> U64(64 - self.bits)).astype(np.int64)

    def find(self, key: np.ndarray) -> np.ndarray:
        """Each word's number, -1 where new."""
        out = np.full(len(key), -1, np.int64)
        rest, slot = np.arange(len(key)), self._slot(key)
        while len(rest):
            k = self.keys[slot]
            hit = k == key[rest]
            out[rest[hit]] = self.at[slot[hit]]
            on = ~hit & (k != 0)
            rest, slot = rest[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, key: np.ndarray, number: np.ndarray) -> None:
        """Distinct new words under their numbers."""
        rest, slot = np.arange(len(key)), self._slot(key)
        while len(rest):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = key[rest[free]]  # of several, one stays
            won = self.keys[slot] == key[rest]
            self.at[slot[won]] = number[rest[won]]
            rest, slot = rest[~won], (slot[~won] + 1) & ((1 << self.bits) - 1)


_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)], U64)


def packed(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Words of up to seven bytes and their lengths as numbers."""
    wide = np.concatenate([buf, np.zeros(8, np.uint8)])
    return (np.ndarray((len(buf) + 1,), "<u8", wide.data, 0, (1,))[start] & _MASKS[size]) | (size.astype(U64) << U64(56))


class Pool:
    """Arrays of ids under numbers, appended to."""

    def __init__(self) -> None:
        self.ids = np.zeros(1 << 16, np.int32)
        self.off = np.zeros(1 << 14, np.int64)
        self.n = 0

    def add(self, ids: np.ndarray, off: np.ndarray) -> None:
        used, k = int(self.off[self.n]), len(off) - 1
        if used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[:used], np.zeros(used + 2 * len(ids), np.int32)])
        if self.n + k + 1 > len(self.off):
            self.off = np.concatenate([self.off[: self.n + 1], np.zeros(self.n + 2 * k, np.int64)])
        self.ids[used : used + len(ids)] = ids
        self.off[self.n + 1 : self.n + k + 1] = used + off[1:]
        self.n += k

    def take(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the numbered words one after another, and how many each has."""
        n = self.off[number + 1] - self.off[number]
        return self.ids[ragged(self.off[number], n)], n


def cut_out(raw: bytes, start: np.ndarray, end: np.ndarray) -> list[bytes]:
    """The words raw[start:end]."""
    return [raw[x:y] for x, y in zip(start.tolist(), end.tolist(), strict=True)]


def code_points(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of UTF-8 bytes and the byte at which each starts, and the length last."""
    lead = np.flatnonzero((buf & 0xC0) != 0x80)
    if len(lead) == len(buf):
        return buf.astype(np.uint32), np.arange(len(buf) + 1)
    cps = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    return cps, np.append(lead, len(buf))


def _contractions(cp: np.ndarray, kind: np.ndarray, bound: np.ndarray, open_quote: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Apostrophes that start 's 't 'm 'd 're 've 'll, and the letters that follow in each.

    bound: a text starts here. open_quote: an apostrophe may start a token here.
    """
    n = len(cp)
    at = np.flatnonzero((cp == 39) & open_quote)

    def nth(k: int) -> np.ndarray:
        i = np.minimum(at + k, n - 1)
        inside = at + k < n
        for j in range(1, k + 1):
            inside &= ~bound[np.minimum(at + j, n - 1)]
        return np.where(inside, cp[i], 0)

    a, b = nth(1), nth(2)
    one = np.isin(a, [ord(c) for c in "stmd"])
    two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
    size = np.where(one, 1, np.where(two, 2, 0))
    return at[size > 0], size[size > 0]


def split_spaced(cp: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Starts of byte-level BPE's words in the code points of texts bounded by ``off``.

    A word takes the one space before it; of other white space before a word
    the last character stands alone.
    """
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[cp]
    bound = np.zeros(n, bool)
    bound[off[:-1][off[:-1] < n]] = True
    prev = np.concatenate([[BLANK], kind[:-1]])
    start = bound | (kind != prev)
    run = start.copy()  # of like characters, before spaces are moved
    blank = kind == BLANK
    last = blank.copy()  # the last blank before a word of the same text
    last[:-1] &= ~blank[1:] & ~bound[1:]
    last[-1] = False
    start |= last
    taken = np.flatnonzero(last & (cp == 32))
    start[taken + 1] = False
    spaced = np.zeros(n, bool)
    spaced[taken + 1] = True
    quote, size = _contractions(cp, kind, bound, run & (kind == OTHER) & ~spaced)
    if len(quote):
        start[quote + 1] = False
        end = quote + size + 1
        inner = end[end < n]
        start[inner] = True
        two = quote[size == 2]
        start[two + 2] = False
        # what followed a contraction's letters starts a word of its own, and a space before it is still taken
        start[inner[spaced[inner]]] = True
    return np.flatnonzero(start)


def split_folded(cp: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the lower-case BPE's words: letters, single numbers, other marks."""
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = classes()[cp]
    bound = np.zeros(n, bool)
    bound[off[:-1][off[:-1] < n]] = True
    prev = np.concatenate([[BLANK], kind[:-1]])
    run = bound | (kind != prev)
    start = run | (kind == NUMBER)
    quote, size = _contractions(cp, kind, bound, run & (kind == OTHER))
    if len(quote):
        start[quote + 1] = run[quote + 1] = False
        end = quote + size + 1
        start[end[end < n]] = True
    start &= kind != BLANK
    s = np.flatnonzero(start)
    stop = np.flatnonzero(start | run | bound)
    e = np.append(stop, n)[np.searchsorted(stop, s, "right")]
    return s, e


class Encoder:
    """Encodes texts as the tokenizers library does with a file of either kind.

    spaced: byte-level words with their space, else lower-cased words without it.
    """

    def __init__(self, path: str, spaced: bool, most: int = 1_000_000, most_bytes: int = 64 << 20):
        self.ranks, self.spaced, self.most, self.most_bytes = Ranks(path), spaced, most, most_bytes
        self.path = path
        self.fresh()

    def fresh(self) -> None:
        self.short, self.pool, self.n, self.bytes = Known(), Pool(), 0, 0
        self.long: dict[bytes, int] = {}

    def _lookup(self, buf: np.ndarray, s: np.ndarray, e: np.ndarray, encode) -> np.ndarray:
        """Numbers of the words, new ones encoded and kept."""
        size = e - s
        short, long = np.flatnonzero(size <= 7), np.flatnonzero(size > 7)
        key = packed(buf, s[short], size[short])
        words = cut_out(buf.tobytes(), s[long], e[long])
        for fresh in (False, True):
            number = np.empty(len(s), np.int64)
            number[short] = self.short.find(key)
            number[long] = np.fromiter(map(self.long.get, words, repeat(-1)), np.int64, len(words))
            if not (number < 0).any():
                return number
            unseen = np.flatnonzero(number[short] < 0)
            _, first = np.unique(key[unseen], return_index=True)
            own = unseen[first]
            others = {words[k]: k for k in np.flatnonzero(number[long] < 0).tolist()}
            part = np.concatenate([short[own], long[np.fromiter(others.values(), np.int64, len(others))]])
            grown = int(size[part].sum())
            if fresh or not self.n or (self.n + len(part) <= self.most and self.bytes + grown <= self.most_bytes):
                break
            self.fresh()
        if not self.n and len(own) > 1 << (self.short.bits - 1):
            self.short = Known(len(own).bit_length() + 1)
        self.pool.add(*encode(buf, s[part], e[part]))
        self.short.add(key[own], np.arange(self.n, self.n + len(own)))
        self.long.update(zip(others, range(self.n + len(own), self.n + len(part)), strict=True))
        self.n, self.bytes = self.n + len(part), self.bytes + grown
        number[short[unseen]] = self.short.find(key[unseen])
        late = np.flatnonzero(number[long] < 0)
        number[long[late]] = [self.long[words[k]] for k in late.tolist()]
        return number

    def texts(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the texts and each text's bounds in them."""
        special = [i for i, t in enumerate(self._has_special(buf, off)) if t]
        if special:
            return self._with_special(buf, off, set(special))
        return self._plain(buf, off)

    def _has_special(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        whole = buf.tobytes()
        out = np.zeros(len(off) - 1, bool)
        for token in self.ranks.special:
            t, i = token.encode(), -1
            while (i := whole.find(t, i + 1)) >= 0:
                out[owner(np.array([i]), off)] = True
        return out

    def _with_special(self, buf: np.ndarray, off: np.ndarray, rows: set[int]) -> tuple[np.ndarray, np.ndarray]:
        """Texts holding special tokens' strings: the stretches between are texts of their own."""
        import re

        pattern = re.compile(b"(" + b"|".join(re.escape(t.encode()) for t in self.ranks.special) + b")")
        number = {t.encode(): i for t, i in self.ranks.special.items()}
        parts, counts, bounds = [], [], [0]
        for r in range(len(off) - 1):
            text = buf[off[r] : off[r + 1]].tobytes()
            pieces = pattern.split(text) if r in rows else [text]
            got = []
            for p in pieces:
                if p in number:
                    got.append(np.array([number[p]], np.int32))
                else:
                    b = np.frombuffer(p, np.uint8)
                    got.append(self._plain(b, np.array([0, len(b)]))[0])
            parts += got
            counts.append(sum(map(len, got)))
        bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        return np.concatenate(parts) if parts else np.zeros(0, np.int32), bounds

    def _plain(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(buf):
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        if self.spaced:
            cp, at = code_points(buf)
            first = split_spaced(cp, np.searchsorted(at, off))
            s = at[first]
            e = np.append(s[1:], len(buf))
            number = self._lookup(buf, s, e, self.ranks.encode)
        else:
            s, e = runs(~SPACE[buf], off)
            number = self._lookup(buf, s, e, self._folded)
        ids, n = self.pool.take(number)
        ends = np.concatenate([[0], np.cumsum(n)])
        return ids, ends[np.searchsorted(s, off)]

    def _folded(self, buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of stretches without ASCII white space: composed, lower-cased, split and encoded."""
        n = e - s
        raw = buf[ragged(s, n)].tobytes()
        off = np.concatenate([[0], np.cumsum(n)])
        if raw.isascii():
            low = np.frombuffer(raw.lower(), np.uint8)
        else:
            pieces = [raw[a:b].decode("utf-8") for a, b in zip(off[:-1], off[1:], strict=True)]
            fold = unicodedata.normalize("NFC", "\n".join(pieces)).replace("Σ", "σ").lower().split("\n")
            data = [p.encode("utf-8") for p in fold]
            low = np.frombuffer(b"".join(data), np.uint8)
            off = np.concatenate([[0], np.cumsum([len(d) for d in data])])
        cp, at = code_points(low)
        first, last = split_folded(cp, np.searchsorted(at, off))
        ws, we = at[first], at[last]
        words = cut_out(low.tobytes(), ws, we)
        place = dict(zip(words, range(len(words)), strict=True))
        pick = np.fromiter(place.values(), np.int64, len(place))
        number = dict(zip(place, range(len(place)), strict=True))
        back = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        ids, bounds = self.ranks.encode(low, ws[pick], we[pick])
        count = bounds[1:] - bounds[:-1]
        flat = ids[ragged(bounds[:-1][back], count[back])]
        ends = np.concatenate([[0], np.cumsum(count[back])])
        return flat, ends[np.searchsorted(ws, off)]
