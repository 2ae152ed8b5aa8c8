"""Media columns: payloads as lossless WebP images, written, read back as pixels and described.

A payload is a text's UTF-8 bytes with blanks up to a positive multiple of LINE bytes.
Its bytes are the red, green and blue samples of pixels in rows of WIDTH; a payload of
over ROWS rows makes several images, one below the other, so that a long text is many
small images and no array follows its length. Images are chosen a way of writing each
by their pixels alone: a palette where colours are few, the colour cache where they
recur, and, where neighbours are alike, predictors and cross-colour if that is shorter.

Null texts count as empty. Ids may be null or repeat; equal texts have equal images
and values. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import scratch, webp
from corvane.llm.textscan import buffers, chunks, ragged

LINE, WIDTH, ROWS = 192, 64, 64
PLAIN, CACHED = webp.Plan(), webp.Plan(cache=6)
INDEXED = webp.Plan(((webp.PALETTE, 0),))
SMOOTH = webp.Plan(((webp.PREDICTOR, 4), (webp.CROSS_COLOUR, 4), (webp.SUBTRACT_GREEN, 0)))


def payloads(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes with blanks up to a positive multiple of LINE, and their bounds."""
    size = np.diff(off)
    whole = np.maximum(LINE, -(-size // LINE) * LINE)
    bounds = np.concatenate([[0], np.cumsum(whole)])
    out = np.full(int(bounds[-1]), 32, np.uint8)
    out[ragged(bounds[:-1], size)] = buf
    return out, bounds


def tiles(data: np.ndarray, bounds: np.ndarray) -> tuple[list[webp.Image], np.ndarray]:
    """Payloads as images, and the payloads' bounds in them."""
    c = np.empty((len(data) // 3, 4), np.uint8)
    c[:, 0], c[:, 1:] = 255, data.reshape(-1, 3)
    argb = webp.joined(c)
    images, count = [], []
    for a, b in zip((bounds[:-1] // 3).tolist(), (bounds[1:] // 3).tolist(), strict=True):
        parts = [argb[k : min(b, k + WIDTH * ROWS)] for k in range(a, b, WIDTH * ROWS)]
        images += [webp.Image(WIDTH, len(p) // WIDTH, p) for p in parts]
        count.append(len(parts))
    return images, np.concatenate([[0], np.cumsum(count)]).astype(np.int64)


def written(images: list[webp.Image]) -> list[bytes]:
    """Files of opaque images, each as its own pixels suggest."""
    if not images:
        return []
    size = np.array([len(i.argb) for i in images])
    argb = np.concatenate([i.argb for i in images])
    own = np.repeat(np.arange(len(images)), size)
    key = np.sort(own.astype(np.uint64) << np.uint64(32) | argb)
    colours = np.bincount((key[np.append(True, key[1:] != key[:-1])] >> np.uint64(32)).astype(np.int64), minlength=len(images))
    plans = [INDEXED if n <= 16 else CACHED if 4 * n <= p else PLAIN for n, p in zip(colours.tolist(), size.tolist(), strict=True)]
    files = webp.encode(images, plans)
    c = argb.view(np.uint8).reshape(-1, 4)
    step = np.abs(np.diff(c.astype(np.int16), axis=0, prepend=0)).sum(1)
    step[np.cumsum(size) - size] = 0
    smooth = np.flatnonzero((np.bincount(own, step) < 12 * size) & (colours > 16)).tolist()
    for k, other in zip(smooth, webp.encode([images[k] for k in smooth], [SMOOTH] * len(smooth)), strict=True):
        files[k] = min(files[k], other, key=len)
    return files


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 2 << 20) -> DataFrame:
    """(doc_id, n_bytes, media) of every text; media: its images, from top to bottom."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, buf, off in chunks(b.column(1), batch_bytes):
                images, bounds = tiles(*payloads(buf, off))
                files = [f for k in range(0, len(images), 2000) for f in written(images[k : k + 2000])]
                media = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(files, pa.binary()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(np.diff(off)), media], ["doc_id", "n_bytes", "media"])

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return given.mapInArrow(run, "doc_id long, n_bytes long, media array<binary>")


def _read(column: pa.ListArray, batch_bytes: int) -> Iterator[tuple[int, int, list[bytes], np.ndarray, list[webp.Image]]]:
    """(first row, row after the last, files, rows' bounds in them, images) of some rows at a time; a long row's images are read some at a time."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null([]) if column.null_count else column
    lists = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    files = column.flatten()
    at = buffers(files)[1]
    at = (at - at[0])[lists]
    i, n = 0, len(lists) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + batch_bytes, "right")) - 1)
        own = files.slice(lists[i], lists[j] - lists[i]).to_pylist()
        yield i, j, own, lists[i : j + 1] - lists[i], [x for k in range(0, len(own), 2000) for x in webp.decode(own[k : k + 2000])]
        i = j


def pixels(media: DataFrame, batch_bytes: int = 1 << 20) -> DataFrame:
    """(doc_id, part, width, height, rgba) of every image of ``media``; rgba: four bytes a pixel, row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            for i, _, _, bounds, images in _read(b.column(1), batch_bytes):
                row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                part = np.arange(len(images)) - bounds[row]
                rgba = [np.ascontiguousarray(webp.split(x.argb)[:, [1, 2, 3, 0]]).tobytes() for x in images]
                cells = [pa.array([ids[i + r] for r in row.tolist()], pa.int64()), pa.array(part, pa.int32()), pa.array([x.width for x in images], pa.int32()), pa.array([x.height for x in images], pa.int32()), pa.array(rgba, pa.binary())]
                yield pa.RecordBatch.from_arrays(cells, ["doc_id", "part", "width", "height", "rgba"])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, part int, width int, height int, rgba binary")


def features(samples: np.ndarray, bounds: np.ndarray) -> list[str]:
    """Of each payload's samples the channels' rounded means, and in which of 65 stretches of pixels the luma rises to the next."""
    px = samples.reshape(-1, 3)
    at = bounds // 3
    n = np.diff(at)
    means = (np.add.reduceat(px, at[:-1], axis=0, dtype=np.int64) + n[:, None] // 2) // n[:, None]
    luma = px @ np.array([2, 5, 1], np.int64)
    # At least 64 pixels: where there are few, stretches share some.
    begin = at[:-1, None] + np.arange(65) * n[:, None] // 65
    end = np.maximum(begin + 1, at[:-1, None] + np.arange(1, 66) * n[:, None] // 65)
    total = np.concatenate([[0], np.cumsum(luma)])
    mean = (total[end] - total[begin]) // (end - begin)
    rises = np.packbits(mean[:, 1:] > mean[:, :-1], axis=1)
    return [f"{r}-{g}-{b}-{bits.tobytes().hex()}" for (r, g, b), bits in zip(means.tolist(), rises, strict=True)]


def digest(docs: DataFrame, batch_bytes: int = 2 << 20) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature), all but the first two of what was stored and read back."""
    media = scratch.table(stored(docs, batch_bytes=batch_bytes), "media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, files, bounds, images in _read(b.column(2), batch_bytes):
                samples = webp.split(np.concatenate([x.argb for x in images]))[:, 1:].ravel()
                size = np.concatenate([[0], np.cumsum([3 * len(x.argb) for x in images])])[bounds]
                data = samples.tobytes()
                own = [data[a:e] for a, e in zip(size[:-1].tolist(), size[1:].tolist(), strict=True)]
                whole = [b"".join(files[a:e]) for a, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                cells = [b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(np.diff(size))]
                cells += [pa.array([sha256(x).hexdigest() for x in own]), pa.array([zlib.crc32(x[-16:]) for x in own], pa.int64())]
                cells += [pa.array([len(x) for x in whole], pa.int64()), pa.array([sha256(x).hexdigest() for x in whole]), pa.array(features(samples, size))]
                yield pa.RecordBatch.from_arrays(cells, ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.mapInArrow(run, schema)
