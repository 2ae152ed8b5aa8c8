"""Pluggable model providers: embedding, description, reranking and decisions.

A provider is a callable over a list; batches go to it as Arrow arrives. The hash
embedder needs no model and is the same everywhere.
"""

from __future__ import annotations

import hashlib
import random
import re
import time
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Embed = Callable[[list[str]], list[list[float] | None]]


def hash_embedder(dim: int = 64) -> Embed:
    """Signed feature hashing of words, unit length; an empty text has the zero vector."""

    def run(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dim))
        for row, t in zip(out, texts, strict=True):
            for w in re.findall(r"\w+", t.lower()):
                h = hashlib.blake2b(w.encode(), digest_size=8).digest()
                row[int.from_bytes(h[:4], "little") % dim] += 1 if h[4] & 1 else -1
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(size > 0, size, 1)).tolist()

    return run


def resilient(call: Embed, batch: int = 100, tries: int = 3, wait_s: float = 0.1, most_failures: int = 5) -> Embed:
    """Retries with growing jittered waits, halves a failing batch, and stops asking after failures in a row; failed texts give None."""

    def run(texts: list[str]) -> list[list[float] | None]:
        failures = 0

        def part(some: list[str]) -> list[list[float] | None]:
            nonlocal failures
            if failures >= most_failures:
                return [None] * len(some)
            for k in range(tries):
                try:
                    out = call(some)
                    failures = 0
                    return out
                except Exception:  # noqa: BLE001  any provider error counts
                    time.sleep(wait_s * 2**k * (1 + random.random()))
            if len(some) > 1:
                mid = len(some) // 2
                return part(some[:mid]) + part(some[mid:])
            failures += 1
            return [None]

        return [v for s in range(0, len(texts), batch) for v in part(texts[s : s + batch])]

    return run


def embed(chunks: DataFrame, provider: Embed, text: str = "content", out: str = "embedding") -> DataFrame:
    """``chunks`` with a vector column; null where the provider failed."""

    @F.pandas_udf("array<float>")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(provider(s.fillna("").tolist()))

    return chunks.withColumn(out, udf(F.col(text)))


def dimension(provider: Embed, given: int | None = None) -> int:
    """The length of the provider's vectors: as configured, else by one call; an error if it gives none."""
    if given:
        return given
    vector = provider(["dimension probe"])[0]
    if not vector:
        raise ValueError("the provider gave no vector")
    return len(vector)


def cache_key(content: Column, config: str, context: Column | None = None) -> Column:
    """A description's key: the content's digest, the configuration's, and that of the place where one is given."""
    parts = [F.substring(F.sha2(content, 256), 1, 16), F.lit(hashlib.sha256(config.encode()).hexdigest()[:16])]
    if context is not None:
        parts.append(F.substring(F.sha2(context, 256), 1, 8))
    return F.concat_ws("_", *parts)


def evict(cache: DataFrame, now: Column, most: int = 50_000, days: int = 30) -> DataFrame:
    """The cache (cache_key, description, created) as it is while it has ``most`` entries at most; else without those
    over ``days`` old, and of the rest the ``most`` newest. Entries of one time go by key."""
    total = cache.agg(F.count("*").alias("__n"))
    young = F.unix_timestamp(now) - F.unix_timestamp("created") <= days * 86400
    left = cache.crossJoin(F.broadcast(total)).where((F.col("__n") <= most) | young)  # one row
    kept = left.agg(F.count("*").alias("__left"))
    # The edge is the oldest entry that stays; one sort of the keys finds it, and no window holds all rows.
    edge = left.orderBy(F.desc("created"), "cache_key").offset(most).limit(1).select(F.struct(F.col("created").alias("c"), F.col("cache_key").alias("k")).alias("__edge"))
    out = left.crossJoin(F.broadcast(kept)).join(F.broadcast(edge), F.lit(True), "left")  # one row each
    newer = (F.col("created") > F.col("__edge.c")) | ((F.col("created") == F.col("__edge.c")) & (F.col("cache_key") < F.col("__edge.k")))
    return out.where((F.col("__left") <= most) | F.coalesce(newer, F.lit(True))).select(cache.columns)


def described(chunks: DataFrame, cache: DataFrame, provider: Callable[[list[str]], list[str]], config: str, context: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Chunks with descriptions, and the cache with the new ones: only texts that the cache misses go to the provider.

    context: what a description tells of besides the content, such as its place.
    """
    keyed = chunks.withColumn("cache_key", cache_key(F.col("content"), config, context))
    lack = keyed.select("cache_key", "content").dropDuplicates(["cache_key"]).join(cache.select("cache_key"), "cache_key", "left_anti")

    @F.pandas_udf("string")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(provider(s.tolist()))

    grown = cache.select("cache_key", "description").unionByName(lack.select("cache_key", udf("content").alias("description")))
    return keyed.join(grown, "cache_key", "left").drop("cache_key"), grown


class Reranker:
    """A reranking call with a memory of its scores, at most ``most`` documents a call, and a rest after failures.

    call: (query, documents) to scores. ``most_cached`` scores are remembered, those asked
    for last. After ``failures`` failed calls in a row nothing is asked for ``rest_s``
    seconds; ``now`` gives the time.
    """

    def __init__(self, name: str, call: Callable[[str, list[str]], list[float]], most: int = 16, most_cached: int = 500, failures: int = 3, rest_s: float = 300, now: Callable[[], float] = time.time):
        self.name, self.call, self.most, self.most_cached = name, call, most, most_cached
        self.failures, self.rest_s, self.now = failures, rest_s, now
        self.known: OrderedDict[bytes, float] = OrderedDict()
        self.failed, self.until = 0, 0.0

    def available(self) -> bool:
        return self.now() >= self.until

    def _key(self, query: str, document: str) -> bytes:
        return hashlib.sha1("\0".join((self.name, query, document)).encode()).digest()

    def scores(self, query: str, documents: list[str]) -> list[float] | None:
        """A score for each document; None while at rest, or where a call failed."""
        keys = [self._key(query, d) for d in documents]
        lack = [k for k, key in enumerate(keys) if key not in self.known]
        if lack and not self.available():
            return None
        got: dict[bytes, float] = {key: self.known[key] for key in keys if key in self.known}
        for s in range(0, len(lack), self.most):
            part = lack[s : s + self.most]
            try:
                found = self.call(query, [documents[k] for k in part])
                if len(found) != len(part):
                    raise ValueError("as many scores as documents are needed")
            except Exception:  # noqa: BLE001  any provider error counts
                self.failed += 1
                if self.failed >= self.failures:
                    self.failed, self.until = 0, self.now() + self.rest_s
                return None
            self.failed = 0
            got |= {keys[k]: float(v) for k, v in zip(part, found, strict=True)}
        for key in keys:
            self.known[key] = got[key]
            self.known.move_to_end(key)
        while len(self.known) > self.most_cached:
            self.known.popitem(last=False)
        return [got[key] for key in keys]


def rerank_scores(results: DataFrame, make: Callable[[], Reranker], pool: int = 20, query: str = "query", text: str = "content") -> DataFrame:
    """``results`` (qid, id, rank, query, content) with rerank_score for each query's first ``pool``; null beyond, and where the provider had none.

    A query's pool goes to one reranker together; each task makes its own.
    """
    head = results.where(F.col("rank") < pool).select("qid", "id", F.col(query).alias("q"), F.col(text).alias("t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make()
        for pdf in batches:
            for k in range(len(pdf)):
                found = provider.scores(pdf["q"][k], [x or "" for x in pdf["ts"][k]])
                yield pd.DataFrame({"qid": pdf["qid"][k], "id": pdf["ids"][k], "rerank_score": found if found is not None else [None] * len(pdf["ids"][k])})

    lists = head.groupBy("qid").agg(F.first("q").alias("q"), F.array_sort(F.collect_list(F.struct("id", "t"))).alias("d"))  # at most ``pool`` a query
    lists = lists.select("qid", "q", F.col("d.id").alias("ids"), F.col("d.t").alias("ts"))
    scores = lists.mapInPandas(run, "qid long, id long, rerank_score double")
    return results.join(scores, ["qid", "id"], "left")


# How many questions a call takes, and options a question.
MOST_QUESTIONS, OPTIONS, MOST_STATE = 8, (2, 24), 6000


def decision_problem(state: str, questions: list[dict], most_state: int = MOST_STATE, most_questions: int = MOST_QUESTIONS) -> str | None:
    """What is wrong with a decision request; None for nothing.

    A question has an id of its own, a type (choice, score or noul), instructions and
    criteria: a choice's options as a list or a mapping, a score's levels as a list, a
    noul's two sides as a mapping.
    """
    if not (state or "").strip():
        return "the state is empty"
    if len(state) > most_state:
        return f"the state has {len(state)} characters, over {most_state}"
    if not 1 <= len(questions) <= most_questions:
        return f"1 to {most_questions} questions are needed, not {len(questions)}"
    low, high = OPTIONS
    seen = set()
    for q in questions:
        name, criteria = str(q.get("id") or "").strip(), q.get("criteria")
        if not name or name in seen:
            return f"every question needs an id of its own, not {name!r}"
        seen.add(name)
        if not str(q.get("instructions") or "").strip():
            return f"question {name} has no instructions"
        if q.get("type") == "choice" and not (isinstance(criteria, (list, dict)) and low <= len(criteria) <= high):
            return f"choice {name} needs {low} to {high} options"
        if q.get("type") == "score" and not (isinstance(criteria, list) and low <= len(criteria) <= high):
            return f"score {name} needs {low} to {high} levels in a list"
        if q.get("type") == "noul" and isinstance(criteria, list):
            return f"noul {name} takes a mapping"
        if q.get("type") not in ("choice", "score", "noul"):
            return f"question {name} has an unknown type"
    return None


def decided(rows: DataFrame, provider: Callable[[list[str], list[dict]], list[list[dict]]], questions: list[dict], state: str = "state") -> DataFrame:
    """``rows`` with answers, an array of (id, choice, noul, score, confidence), by a provider over batches of states.

    Probabilities are clamped to 0 to 1. A state that is not fit to be asked about, or
    of which the provider says nothing, has no answers.
    """
    answer = "struct<id: string, choice: string, noul: double, score: double, confidence: double>"

    def plain(a: dict) -> dict:
        number = lambda v: None if isinstance(v, bool) or not isinstance(v, (int, float)) or v != v else float(v)
        noul = a.get("noul")
        noul = number(noul.get("probability", noul.get("noul"))) if isinstance(noul, dict) else number(noul)
        return {
            "id": str(a.get("id")), "choice": a.get("choice") or None, "noul": None if noul is None else min(1.0, max(0.0, noul)),
            "score": number(a.get("score")), "confidence": number(a.get("confidence")),
        }

    @F.pandas_udf(f"array<{answer}>")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            fit = [k for k, x in enumerate(s) if decision_problem(x, questions) is None]
            found = dict(zip(fit, provider([s.iloc[k] for k in fit], questions), strict=True)) if fit else {}
            yield pd.Series([[plain(a) for a in found.get(k) or []] for k in range(len(s))])

    return rows.withColumn("answers", udf(F.col(state)))


def guard_verdict(answers: Column, threshold: float) -> Column:
    """(flagged, destructive, malicious, category) of a command's answers of those names; what is not told counts as 0 or none."""
    said = lambda name, field: F.try_element_at(F.transform(F.filter(answers, lambda a: a["id"] == name), lambda a: a[field]), F.lit(-1))
    p = lambda name: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(said(name, "noul"), F.lit(0.0))))
    category = F.coalesce(said("category", "choice"), F.lit("none"))
    flagged = (p("destructive") >= threshold) | (p("malicious") >= threshold)
    return F.struct(flagged.alias("flagged"), p("destructive").alias("destructive"), p("malicious").alias("malicious"), category.alias("category"))


class Expiring:
    """A memory of at most ``most`` values that each last ``ttl_s`` seconds; the oldest go first."""

    def __init__(self, ttl_s: float, most: int, now: Callable[[], float] = time.time):
        self.ttl_s, self.most, self.now = ttl_s, most, now
        self.held: OrderedDict = OrderedDict()

    def get(self, key):
        value, until = self.held.get(key, (None, 0.0))
        return value if until > self.now() else None

    def put(self, key, value) -> None:
        if self.ttl_s <= 0 or self.most <= 0:
            return
        self.held.pop(key, None)
        while len(self.held) >= self.most:
            self.held.popitem(last=False)
        self.held[key] = (value, self.now() + self.ttl_s)
