"""Encoding and decoding of whole texts by the contiguous rank array.

A null text counts as empty and gives no ids. Texts of any length are encoded
whole; memory follows the longest text. Rows are independent: ids may be null or
repeat, an empty table gives an empty result, and only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.bpe import Encoder
from corvane.llm.textscan import chunks


def _lists(off: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), values)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded) of every text: its token ids, and the text that they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(path, spaced=True)
        for b in batches:
            for i, j, buf, off in chunks(b.column(1)):
                ids, at = coder.texts(buf, off)
                text, bound = coder.ranks.decode(ids, at)
                shown = [text[x:y].tobytes().decode("utf-8", "replace") for x, y in zip(bound[:-1], bound[1:], strict=True)]
                cols = [b.column(0).slice(i, j - i), _lists(at, pa.array(ids)), pa.array(shown, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "ids", "decoded"])

    given = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return given.mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): ``encode``'s results as digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(path, spaced=True)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            for i, j, buf, off in chunks(b.column(1)):
                ids, at = coder.texts(buf, off)
                text, bound = coder.ranks.decode(ids, at)
                whole = text.tobytes()
                try:
                    whole.decode("utf-8")
                    shown = [sha(whole[x:y]) for x, y in zip(bound[:-1], bound[1:], strict=True)]
                except UnicodeDecodeError:  # bytes that no text holds decode to U+FFFD
                    shown = [sha(whole[x:y].decode("utf-8", "replace").encode()) for x, y in zip(bound[:-1], bound[1:], strict=True)]
                joined, ends = decimal(ids, at)
                cols = [
                    b.column(0).slice(i, j - i),
                    pa.array(at[1:] - at[:-1]),
                    pa.array([sha(joined[x:y]) for x, y in zip(ends[:-1], ends[1:] - (at[1:] > at[:-1]), strict=True)], pa.string()),
                    pa.array(shown, pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    given = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return given.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def decimal(ids: np.ndarray, at: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The ids in decimal, each followed by a comma, and the bounds of each row's bytes."""
    digits = 1 + sum((ids >= 10**k).astype(np.int64) for k in range(1, 10))
    ends = np.concatenate([[0], np.cumsum(digits + 1)])
    out = np.full(ends[-1], ord(","), np.uint8)
    rest = ids.astype(np.int64)
    for k in range(int(digits.max(initial=0))):
        has = digits > k
        out[ends[1:][has] - 2 - k] = 48 + rest[has] % 10
        rest //= 10
    return out.tobytes(), ends[at]
