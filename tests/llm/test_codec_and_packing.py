"""Rank-array BPE against the tokenizers library, and certified packing."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from corvane.llm import codec, packing
from corvane.llm.bpe import Encoder
from corvane.llm.textscan import chunks

ODD = ["", " ", "don't we're 's  's\n's ''s a'.b 'sx 'llama I'LL", "  a\n\n b \t c  ", "x" * 500, "é" * 90, "naïve ÉCOLE ΣΑΣ İ ½ ² Ⅷ 12345 a1b2",
       "hi<|endoftext|>there <|startoftext|> x", "漢字かな 🙂🙂 x\u0085y", "'re've'll", "a'rex b'vey", "\x1c\x1dx", "...'s 's'", "word \n", "\n\n"]


def thue_morse(k):
    """Two words of 2**k letters that polynomial hashes modulo a power of two confuse."""
    w = "a"
    for _ in range(k):
        w += w.translate({97: "b", 98: "a"})
    return [w, w.translate({97: "b", 98: "a"})]


def texts():
    rng = random.Random(1)
    return ODD + thue_morse(11) + ["".join(rng.choice("ab's tlrevmd  \n\t1.é'²,") for _ in range(rng.randint(0, 60))) for _ in range(300)]


@pytest.mark.parametrize(("name", "spaced"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_same_ids_as_the_library(name, spaced):
    path = public_tokenizers.path(name)
    given = texts()
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(given, add_special_tokens=False)]
    for most in (1_000_000, 40):  # the second starts its table anew again and again
        coder, got = Encoder(path, spaced, most), []
        for _, _, buf, off in chunks(pa.array(given), limit=300):
            ids, at = coder.texts(buf, off)
            got += [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
            if spaced:
                data, ends = coder.ranks.decode(ids, at)
                assert data.tobytes() == buf.tobytes() and (ends == off).all()
        assert got == want


def test_codec_rows(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (None, None, "y"), (1, "", "z")], "doc_id long, text string, ids string")
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = codec.digest(df, path).collect()
    assert sorted(r["n_tokens"] for r in rows) == [0, 0, 2]
    assert {r["decoded"] for r in codec.encode(df, path).collect()} == {"a b", ""}
    assert codec.digest(df.where("false"), path).count() == 0


def test_packing_is_whole_and_tight(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma's", "7"]) for _ in range(rng.choice([0, 3, 40, 300])))) for i in range(400)]
    rows += [(None, None), (5, "again"), (5, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    want = []
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        for p in range(0, len(ids), 128):
            part = ids[p : p + 128]
            want.append((str(i), p // 128, p, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    out = packing.packed(df, path, capacity=128, per_part=60).collect()
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == sorted(want)
    bins: dict[int, list] = {}
    for r in out:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 128
    bound = packing.lower_bound(np.array([w[3] for w in want]), 128)
    assert len(bins) <= bound * 1.02 + 1


def test_lower_bound_never_exceeds_best_fit():
    rng = np.random.default_rng(0)
    for _ in range(200):
        size = rng.integers(1, 41, rng.integers(1, 40))
        bins, offs = packing.best_fit_decreasing(size, 40)
        assert packing.lower_bound(size, 40) <= bins.max() + 1
        assert np.bincount(bins, weights=size).max() <= 40
