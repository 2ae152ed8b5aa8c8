"""Lossless images: every transform and code there and back, a stream of another encoder, and the media query by hand."""

from __future__ import annotations

import zlib
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import media, queries, webp
from corvane.llm.webp import CROSS_COLOUR, PALETTE, PREDICTOR, SUBTRACT_GREEN, Image, Plan

SF = "/root/testdata/sf0.001"


def drawn(kind, w, h, rng):
    n = w * h
    y, x = np.divmod(np.arange(n), w)
    green = (x * 2 + y * 3) & 255
    some = {
        "noise": lambda: rng.integers(0, 1 << 32, n),
        "two": lambda: rng.choice(rng.integers(0, 1 << 32, 2), n),
        "few": lambda: rng.choice(rng.integers(0, 1 << 32, 40), n),
        "one": lambda: np.full(n, 0xFF102030),
        "smooth": lambda: 0xFF000000 | ((green + 3) & 255) << 16 | green << 8 | (green * 2 & 255),
        "rows": lambda: rng.integers(0, 1 << 32, w)[x],
    }
    return Image(w, h, some[kind]().astype(np.uint32))


@pytest.mark.parametrize("transforms", [(), ((PREDICTOR, 2),), ((CROSS_COLOUR, 3),), ((SUBTRACT_GREEN, 0),), ((PALETTE, 0),), ((PREDICTOR, 3), (CROSS_COLOUR, 2), (SUBTRACT_GREEN, 0)), ((PALETTE, 0), (PREDICTOR, 2))])
def test_images_come_back(transforms):
    rng = np.random.default_rng(5)
    images, plans = [], []
    for w, h in ((1, 1), (1, 9), (7, 1), (5, 5), (64, 3), (33, 20), (64, 64)):
        for kind in ("noise", "two", "few", "one", "smooth", "rows"):
            image = drawn(kind, w, h, rng)
            if any(k == PALETTE for k, _ in transforms) and len(np.unique(image.argb)) > 256:
                continue
            for cache, copies, groups in ((0, False, None), (0, True, None), (1, True, 2), (6, True, None), (11, False, 3)):
                images.append(image), plans.append(Plan(transforms, cache, copies, groups))
    for image, back in zip(images, webp.decode(webp.encode(images, plans)), strict=True):
        assert (image.width, image.height) == (back.width, back.height) and (image.argb == back.argb).all()


def test_predictors_by_hand():
    """Each mode pixel by pixel, as the format has it."""
    rng = np.random.default_rng(2)
    mean = lambda a, b: [(p + q) // 2 for p, q in zip(a, b, strict=True)]
    clip = lambda v: min(255, max(0, v))

    def foretold(m, left, top, corner, right):
        if m == 11:
            p = [a + b - c for a, b, c in zip(left, top, corner, strict=True)]
            near = sum(abs(a - b) for a, b in zip(p, left, strict=True)) < sum(abs(a - b) for a, b in zip(p, top, strict=True))
            return left if near else top
        if m == 12:
            return [clip(a + b - c) for a, b, c in zip(left, top, corner, strict=True)]
        if m == 13:
            return [clip(a + int((a - c) / 2)) for a, c in zip(mean(left, top), corner, strict=True)]
        return {0: [255, 0, 0, 0], 1: left, 2: top, 3: right, 4: corner, 5: mean(mean(left, right), top), 6: mean(left, corner), 7: mean(left, top), 8: mean(corner, top), 9: mean(top, right), 10: mean(mean(left, corner), mean(top, right))}[m]

    w, h, size = 9, 11, 2
    for m in range(14):
        rest = rng.integers(0, 256, (w * h, 4))
        px = []
        for p in range(w * h):
            x, y = p % w, p // w
            guess = [255, 0, 0, 0] if p == 0 else px[p - 1] if y == 0 else px[p - w] if x == 0 else foretold(m, px[p - 1], px[p - w], px[p - w - 1], px[p - w + 1])
            px.append([(int(a) + int(b)) & 255 for a, b in zip(rest[p], guess, strict=True)])
        data = np.full(9, 0xFF000000 | m << 8, np.uint32)
        (got,) = webp._unpredict([(webp.joined(rest), w, size, data)])
        assert webp.split(got).tolist() == px


def file_of(stream):
    return b"RIFF" + (12 + len(stream)).to_bytes(4, "little") + b"WEBPVP8L" + len(stream).to_bytes(4, "little") + stream


def test_copies_and_cache_by_hand():
    """A stream written bit by bit: literals, cache codes, a copy that overlaps itself and a far one."""
    red, blue = 0xFF0000AA, 0xFFBB0001
    key = [int(webp.cache_key(np.array([c]), 1)[0]) for c in (red, blue)]
    assert sorted(key) == [0, 1]
    fields = [(0x2F, 8), (9, 14), (0, 14), (0, 1), (0, 3), (0, 1), (1, 1), (1, 4), (0, 1)]  # 10 x 1, a cache of one bit
    # Green: 0, a copy of length 3 (258) and the cache's two, two bits each; their lengths by a code of 2 and runs of zeros.
    fields += [(0, 1), (15, 4)] + [(int(s in (2, 18)), 3) for s in webp.LENGTH_ORDER] + [(0, 1)]
    fields += [(0, 1), (1, 1), (138 - 11, 7), (1, 1), (119 - 11, 7), (0, 1), (1, 1), (21 - 11, 7), (0, 1), (0, 1)]
    fields += [(1, 1), (1, 1), (1, 1), (0, 8), (0xBB, 8)]  # red: 0 or BB
    fields += [(1, 1), (1, 1), (1, 1), (1, 8), (0xAA, 8)]  # blue: 1 or AA
    fields += [(1, 1), (0, 1), (1, 1), (255, 8)]  # alpha
    fields += [(1, 1), (1, 1), (1, 1), (1, 8), (13, 8)]  # distance prefixes 1 and 13
    green = {0: (0b00, 2), 258: (0b10, 2), 280: (0b01, 2), 281: (0b11, 2)}  # first bit lowest
    fields += [green[0], (0, 1), (1, 1), green[0], (1, 1), (0, 1), green[280 + key[0]]]
    fields += [green[258], (0, 1)]  # the second short distance: one to the left
    fields += [green[258], (1, 1), (28, 5)]  # 97 and 28 more: five pixels back
    fields += [green[280 + key[1]]]
    out = webp.Segments()
    name = out.one(*fields)
    assert webp.decode([file_of(out.bytes([[name]])[0])])[0].argb.tolist() == [red, blue, red, red, red, red, blue, red, red, blue]


# Fixed value: the alpha plane of the 16 x 16 logo among the standard library's test pictures, a lossless stream without its head.
LOGO = "27a2a89124e57ae7185fe7df2a998898ff74718de02630e2e18b7732c8c1115c832b30e8b078158e785135c1080c024f92a06ab055191cd6b66d462f4ec6763cb6ed77fbaf29ae21a2ff49d1fd8f90f7ba4449241b3a259134f3146d0ec7d3e51620f40b14be90e183b71a329e36827f1d297e4e7608fb889eb391ef997346e83282dbf8cc48b2f745307d20fd36178c2132562da5d66b23bc5de3a55915d59c81a4d96e96758a18310f8aaa2c5034fa3082dfba6b505229b52dcfe954140a010000"


def test_a_stream_of_another_encoder():
    head = b"\x2f" + (15 | 15 << 14).to_bytes(4, "little")
    (image,) = webp.decode([file_of(head + bytes.fromhex(LOGO))])
    alpha = (image.argb.reshape(16, 16) >> 8 & 255).tolist()
    assert alpha[0] == [0, 0, 0, 0, 175, 237, 255, 255, 255, 247, 146, 11, 3, 0, 0, 0]
    assert alpha[7] == [255, 255, 255, 255, 182, 92, 76, 72, 71, 65, 107, 247, 255, 255, 255, 70]
    assert alpha[15] == [0, 0, 0, 0, 8, 29, 53, 66, 71, 69, 56, 31, 8, 0, 0, 0]


def test_broken_streams():
    good = webp.encode([drawn("noise", 8, 8, np.random.default_rng(1))], [Plan()])[0]
    for bad in (b"", b"RIFF0000WEBP", good[: len(good) // 2], good[:20] + b"\x00" + good[21:]):
        with pytest.raises(ValueError):
            webp.decode([bad])


def test_op12(spark):
    got = {r["doc_id"]: r for r in queries.op12_lossless_webp(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert sorted(got) == sorted(r["doc_id"] for r in rows)
    by_text = {}
    for row in rows:
        data = (row["text"] or "").encode()
        body = data + b" " * (-len(data) % 192 if data else 192)
        r = got[row["doc_id"]]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(body), sha256(body).hexdigest(), zlib.crc32(body[-16:]))
        px = np.frombuffer(body, np.uint8).reshape(-1, 3).astype(int)
        assert r["feature"].split("-")[:3] == [str(int(px[:, k].sum() + len(px) // 2) // len(px)) for k in range(3)]
        by_text.setdefault(data, set()).add((r["media_bytes"], r["media_sha256"], r["feature"]))
    assert all(len(v) == 1 for v in by_text.values())


def test_odd_rows_and_pixels(spark):
    long = "".join(chr(97 + (k * k + k // 7) % 26) for k in range(400_000))
    rows = [(1, long), (2, None), (3, ""), (None, "é" * 96), (2, "twice"), (2, "twice"), (4, "a" * 50_000), (5, "".join(chr(48 + k // 40 % 10) for k in range(20_000))), (6, "x" * 192), (7, "0123456789" * 500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("media", "n_bytes", "part", "feature"):
        df = df.withColumn(name, F.lit("clash"))
    out = media.stored(df)
    assert media.digest(df).count() == len(rows) and media.digest(df.where("false")).count() == 0
    small = media.digest(df, batch_bytes=1000).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(small, key=key) == sorted(media.digest(df).collect(), key=key)
    parts = {}
    for r in media.pixels(out).collect():
        assert (r["width"], len(r["rgba"])) == (64, 256 * r["height"])
        parts.setdefault(r["doc_id"], []).append((r["part"], r["rgba"]))
    body = b"".join(p for _, p in sorted(parts[1]))
    assert np.frombuffer(body, np.uint8).reshape(-1, 4)[:, :3].tobytes().decode().rstrip() == long
    assert (np.frombuffer(body, np.uint8).reshape(-1, 4)[:, 3] == 255).all()
