"""Text functions as column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _cut(w: Column, n: int) -> Column:
    return F.substring(w, 1, F.length(w) - n)


def stem(w: Column) -> Column:
    """Suffix stripping of words of six characters and more; the first rule that fits applies."""
    before_es = F.substring(w, F.length(w) - 2, F.lit(1))
    cut = (
        F.when(w.endswith("ing"), _cut(w, 3))
        .when(w.endswith("ed") | w.endswith("ly"), _cut(w, 2))
        .when(w.endswith("es") & before_es.isin("s", "x", "z", "h"), _cut(w, 2))
        .when(w.endswith("er") | w.endswith("en"), _cut(w, 2))
        .when(w.endswith("s") & ~w.endswith("ss"), _cut(w, 1))
        .when(w.endswith("e"), _cut(w, 1))
        .otherwise(w)
    )
    return F.when(F.length(w) < 6, w).otherwise(cut)


def tokenize(text: Column) -> Column:
    """Distinct tokens: words, their camel-case and underscore parts, and the stems of all.

    The parts of all words are the whole text split three ways, so only the stems
    are made word by word.
    """
    whole = F.coalesce(text, F.lit(""))
    ways = [F.split(whole, p) for p in ("[^a-zA-Z0-9_]+", "[^a-zA-Z0-9_]+|(?=[A-Z])", "[^a-zA-Z0-9]+")]
    parts = F.array_distinct(F.split(F.lower(F.concat_ws(" ", F.array_distinct(F.concat(*ways)))), " "))
    lower = F.filter(parts, lambda w: F.length(w) >= 2)
    return F.array_distinct(F.concat(lower, F.transform(lower, stem)))


def _stemmed(w: str) -> str:
    """``stem`` of one word."""
    if len(w) < 6:
        return w
    es = w.endswith("es") and w[-3] in "sxzh"
    for cut, fits in ((3, w.endswith("ing")), (2, w.endswith(("ed", "ly")) or es or w.endswith(("er", "en"))), (1, w.endswith("s") and not w.endswith("ss")), (1, w.endswith("e"))):
        if fits:
            return w[:-cut]
    return w


def _tokens_of(word: str) -> tuple[str, ...]:
    """The tokens that ``tokenize`` gives for one word of [A-Za-z0-9_]."""
    low = word.lower()
    if "_" not in word and word[1:] == low[1:]:  # of one part, as most are
        own = _stemmed(low)
        return () if len(low) < 2 else (low,) if own == low else (low, own)
    parts = {word, *re.split("(?=[A-Z])", word), *word.split("_")}
    lower = {p.lower() for p in parts if len(p) >= 2}
    return tuple(lower | {_stemmed(p) for p in lower})


def token_lists(rows: DataFrame, id_col: str, text_col: str, path_col: str | None) -> DataFrame:
    """(id, path, dl, tokens): ``tokenize`` of every row, by Arrow batches that remember each word's tokens.

    Splitting every text three ways and stemming every row's words as column
    expressions takes over ten times as long; the vocabulary is small against the texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[str, ...]] = {}
        words = re.compile("[a-zA-Z0-9_]+")
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                b = batch.slice(k, 500)
                found: list[list[str]] = []
                for text in b.column(2).to_pylist():
                    own: set[str] = set()
                    for w in set(words.findall(text or "")):
                        got = known.get(w)
                        if got is None:
                            if len(known) > 500_000:
                                known.clear()
                            got = known[w] = _tokens_of(w)
                        own.update(got)
                    found.append(list(own))
                cols = [b.column(0), b.column(1), pa.array([len(f) for f in found], pa.int32()), pa.array(found, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(cols, ["id", "path", "dl", "tokens"])

    given = rows.select(F.col(id_col).cast("long").alias("id"), (F.col(path_col) if path_col else F.lit(None)).cast("string").alias("path"), F.col(text_col).cast("string").alias("text"))
    return given.mapInArrow(run, "id long, path string, dl int, tokens array<string>")


def token_hashes(text: Column) -> Column:
    """The 64-bit hashes of a text's tokens as ``tokenize`` gives them, in order; that of "" where there are none."""

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        class Known(dict):
            def __missing__(self, word: bytes) -> tuple[int, ...]:
                if len(self) > 500_000:
                    self.clear()
                got = self[word] = tuple(map(number, _tokens_of(word.decode())))
                return got

        number = lambda x: int.from_bytes(blake2b(x.encode(), digest_size=8).digest(), "little", signed=True)
        known, none = Known(), {number("")}
        # All other bytes part words, those of characters beyond ASCII too.
        apart = bytes(c if re.fullmatch(b"[a-zA-Z0-9_]", bytes([c])) else 32 for c in range(256))
        for batch in texts:
            for k in range(0, len(batch), 500):
                found: list[np.ndarray] = []
                for text in batch.slice(k, 500).cast(pa.binary()).to_pylist():
                    own = set().union(*map(known.__getitem__, set((text or b"").translate(apart).split()))) or none
                    found.append(np.sort(np.fromiter(own, np.int64, len(own))))
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))

    # The kind of an Arrow function is told by its hints, which are text in this module.
    run.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "array<long>")(text)


def word_set(text: Column, least: int = 1) -> Column:
    """Distinct lower-case words of at least ``least`` characters, split at other than [A-Za-z0-9_]."""
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-zA-Z0-9_]+"), lambda w: F.length(w) >= least))


def jaccard(a: Column, b: Column, empty: float = 0.0) -> Column:
    """Of two sets as arrays; ``empty`` where both are."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def shared(a: Column, b: Column, stop: list[str] | None = None) -> Column:
    """How many values two sets share, stop words apart."""
    both = F.array_intersect(a, b)
    return F.size(F.array_except(both, F.array(*map(F.lit, stop))) if stop else both)


def first_match(text: Column, rules: list[tuple[str, str]], other: str | None = None) -> Column:
    """The class of the first rule (class, pattern) that is found in the text."""
    out = F.lit(other)
    for name, pattern in reversed(rules):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def any_match(text: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(p) for p in patterns])


def error_signature(tool: Column, error: Column) -> Column:
    """tool|error in lower case, white space collapsed, digits masked, at most 160 characters."""
    flat = F.regexp_replace(F.regexp_replace(F.lower(error), r"\s+", " "), r"\d+", "#")
    return F.concat(F.lower(tool), F.lit("|"), F.substring(F.trim(flat), 1, 160))


# What is taken off a page's name, in this order; the folder may stand in a state folder.
PAGE_PARTS = [r"(?i)\.(md|markdown)$", r"^\./", r"(?i)^{state}wiki/", r"/+$", r"^/+"]


def page_id(target: Column, state: str | None = None) -> Column:
    """A link target without suffix, leading folder marks and outer slashes, in lower case.

    state: the name of the folder that the pages' folder may stand in.
    """
    out = F.regexp_replace(F.trim(target), r"\\", "/")
    for pattern in PAGE_PARTS:
        out = F.regexp_replace(out, pattern.replace("{state}", f"({re.escape(state)}/)?" if state else ""), "")
    return F.lower(out)


def estimate_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(text) / 4).cast("long")


def half_up(x: Column) -> Column:
    """Rounding with halves toward plus infinity."""
    return F.floor(x + 0.5)


def strip_comments(text: Column) -> Column:
    """A comment's words: block marks, HTML marks, doc-string quotes and line prefixes removed."""
    out = text
    for pattern in (r"^\s*/\*+", r"\*+/\s*$", r"^\s*<!--", r"-->\s*$", r'^\s*("""|\'\'\')', r'("""|\'\'\')\s*$', r"(?m)^\s*(//+|#+|\*+|--+|;+|%+)[ \t]?"):
        out = F.regexp_replace(out, pattern, "")
    return F.trim(out)
