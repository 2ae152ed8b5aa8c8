"""Keyword, vector and hybrid retrieval over a table of chunks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.functions import vectors as vx
from corvane.operators import alike
from corvane.sources import shared

RRF = 60
DEMOTION = {"doc": 0.5, "test": 0.6}
OVERFETCH = 3


def top(scored: DataFrame, k: int, by: list[str] | None = None, score: str = "score", id_col: str = "id", rank: str = "rank") -> DataFrame:
    """The k best of each group by score, ties by id, ranked from 0.

    The row number itself is compared with k, so that Spark limits each group before the shuffle.
    """
    order = [F.col(score).desc(), F.col(id_col)]
    w = Window.partitionBy(*by).orderBy(*order) if by else Window.orderBy(*order)
    found = scored if by else scored.orderBy(*order).limit(k)
    return found.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k).withColumn(rank, F.col("__n") - 1).drop("__n")


def knn(vectors: DataFrame, queries: DataFrame, k: int, where: Column | None = None, id_col: str = "id", vector: str = "embedding", most: int = 20_000) -> DataFrame:
    """(qid, id, score, rank): exact nearest vectors by clamped cosine; ``where`` filters before the search.

    Queries are multiplied as matrices with Arrow batches of vectors; each task keeps
    its k best of every query, so a shuffle moves k rows a query and task. At most
    ``most`` queries are broadcast at once; more are asked in as many scans as it takes.
    Queries without a vector find nothing.
    """
    queries = queries.where(F.col("qvec").isNotNull())
    pool = vectors.where(where) if where is not None else vectors
    given = pool.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    lots = max(1, -(-queries.count() // most))
    found = None
    for lot in range(lots):
        part = queries if lots == 1 else queries.where(F.pmod(F.xxhash64("qid"), F.lit(lots)) == lot)
        asked = part.select("qid", F.col("qvec").cast("array<double>").alias("q")).collect()  # about ``most`` rows
        held = vectors.sparkSession.sparkContext.broadcast(([r["qid"] for r in asked], [r["q"] for r in asked]))
        near = given.mapInArrow(_nearest(held, k), "qid long, id long, score double")
        found = near if found is None else found.unionByName(near)
    return top(found, k, ["qid"])


def _nearest(held, k: int):
    """The k best of each batch run for every query: higher scores, then lower ids."""

    def run(batches):
        qid = np.array(held.value[0], np.int64)
        if not len(qid):
            return
        q = np.array(held.value[1], float).reshape(len(qid), -1)
        size = np.linalg.norm(q, axis=1)
        q = q / np.where(size > 0, size, 1)[:, None]
        ids, scores = np.zeros((len(qid), 0), np.int64), np.zeros((len(qid), 0))
        for b in batches:
            for a in range(0, b.num_rows, 4096):
                part = b.slice(a, 4096)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                n = np.linalg.norm(x, axis=1)
                s = np.clip((q @ (x / np.where(n > 0, n, 1)[:, None]).T + 1) / 2, 0, 1).round(6)
                own = np.broadcast_to(part.column(0).to_numpy(), s.shape)
                ids, scores = np.hstack([ids, own]), np.hstack([scores, s])
                if scores.shape[1] > k:
                    order = best(ids, scores, k)
                    ids, scores = np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)
        m = ids.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, m)), pa.array(ids.ravel()), pa.array(scores.ravel())], ["qid", "id", "score"])

    return run


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each row; among equal scores at the edge the lowest ids."""
    edge = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
    out = np.empty((len(scores), k), np.int64)
    for r in range(len(scores)):
        at = np.flatnonzero(scores[r] >= edge[r])
        out[r] = at[np.lexsort((ids[r, at], -scores[r, at]))[:k]]
    return out


def nearest(vectors: DataFrame, query: Column, k: int, id_col: str = "id", vector: str = "embedding") -> DataFrame:
    """The same for one query vector, as column expressions: (id, score, rank)."""
    scored = vectors.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), F.round(vx.similarity(F.col(vector), query), 6).alias("score"))
    return top(scored, k)


def demotion(role: Column) -> Column:
    return F.when(role == "doc", DEMOTION["doc"]).when(role == "test", DEMOTION["test"]).otherwise(1.0)


def fuse(vector_leg: DataFrame, keyword_leg: DataFrame, roles: DataFrame, kw: Column | float = 0.4, normalized: bool = False, min_score: float = 0.0) -> DataFrame:
    """Weighted reciprocal-rank fusion of two ranked legs of (qid, id, score, rank).

    Keyword contributions are demoted by role. normalized divides by what the legs
    present could reach. Where the keyword leg has nothing for a query, the vector
    scores themselves are gated and kept. Ties: vector rank, keyword rank, id.
    """
    kw = F.lit(kw) if not isinstance(kw, Column) else kw
    v = vector_leg.select("qid", "id", F.col("score").alias("vector_score"), F.col("rank").alias("vector_rank"))
    w = keyword_leg.select("qid", "id", F.col("score").alias("keyword_score"), F.col("rank").alias("keyword_rank"))
    some = w.select(F.col("qid").alias("kq")).distinct()
    both = v.join(w, ["qid", "id"], "full").join(some, F.col("qid") == F.col("kq"), "left").join(roles, "id", "left")
    part = lambda rank, weight: F.coalesce(weight * (RRF + 1) / (RRF + F.col(rank) + 1), F.lit(0.0))
    fused = part("vector_rank", 1 - kw) + part("keyword_rank", kw) * demotion(F.col("role"))
    if normalized:
        reach = F.when(F.col("vector_rank").isNotNull(), 1 - kw).otherwise(0.0) + F.when(F.col("keyword_rank").isNotNull(), kw).otherwise(0.0)
        fused = F.when(reach > 0, fused / reach).otherwise(0.0)
    score = F.round(F.when(F.col("kq").isNull(), F.col("vector_score")).otherwise(fused), 6)
    return both.select("qid", "id", score.alias("score"), "vector_score", "keyword_score", "vector_rank", "keyword_rank").where(F.col("score") >= min_score)


def ranked(fused: DataFrame, k: int) -> DataFrame:
    order = [F.col("score").desc(), F.col("vector_rank").asc_nulls_last(), F.col("keyword_rank").asc_nulls_last(), F.col("id")]
    best = fused.withColumn("__n", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).where(F.col("__n") <= k)
    return best.withColumn("rank", F.col("__n") - 1).drop("__n")


def confidence(results: DataFrame) -> DataFrame:
    """Min-max of the raw vector scores of a query's results; 1 where they are equal."""
    w = Window.partitionBy("qid")
    raw = F.coalesce("vector_score", F.lit(0.0))
    low, high = F.min(raw).over(w), F.max(raw).over(w)
    return results.withColumn("confidence", F.round(F.when(high > low, (raw - low) / (high - low)).otherwise(1.0), 6))


def merge_adjacent(results: DataFrame, gap: int = 5) -> DataFrame:
    """Islands of a file's chunks whose start lies within gap + 1 of the previous chunk's end."""
    w = Window.partitionBy("qid", "file_path").orderBy("start_line", "id")
    far = F.coalesce(F.col("start_line") - F.lag("end_line").over(w) > gap + 1, F.lit(True))
    marked = results.withColumn("island", F.sum(F.when(far, 1).otherwise(0)).over(w))
    parts = F.array_sort(F.collect_list(F.struct("start_line", "id", "end_line", "content")))
    out = marked.groupBy("qid", "file_path", "island").agg(parts.alias("p"), F.max("score").alias("score"))
    return out.select(
        "qid", "file_path", F.concat_ws("+", F.transform("p", lambda x: x["id"].cast("string"))).alias("merged_ids"),
        F.col("p")[0]["start_line"].alias("start_line"), F.element_at("p", -1)["end_line"].alias("end_line"),
        F.concat_ws("\n", F.transform("p", lambda x: x["content"])).alias("content"), "score", F.size("p").alias("parts"),
    )


def cap_per_file(results: DataFrame, n: int = 3, key: str = "id") -> DataFrame:
    """The n best of each query's file, and whether the file had more."""
    w = Window.partitionBy("qid", "file_path")
    kept = results.withColumn("place", F.row_number().over(w.orderBy(F.col("score").desc(), F.col(key))))
    kept = kept.withColumn("file_capped", F.count("*").over(w) > n)
    return kept.where(F.col("place") <= n).drop("place")


def drop_similar(results: DataFrame, threshold: float = 0.8, best_first: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Greedy removal of a file's chunks whose token sets overlap over ``threshold`` with a better one's.

    Pairs of a query's results of one file are taken in order of (rank, id); of a pair
    of which both are left the higher score stays, on a tie the earlier. No file is a
    group of one task: similar pairs are found by parts of their token sets that agree,
    and the walk over them is done in rounds. Of a pair it is known what becomes of it once no earlier pair
    can still remove its winner; a round settles all such pairs at once, so that there
    are as many rounds as pairs wait for one another in a row. Equal token sets are
    similar pairs too, no further than to the next of a higher score (``_turns``);
    where results come ``best_first``, of equal ones only the first
    is walked with, as it removes the others or goes with them. The results are written
    once with their sets and without what is not in ``keep``, the columns that are
    returned; all of them where it is not given.
    """
    kept, own, at = keep or results.columns, ["qid", "file_path"], F.struct("rank", "id", "__row")
    held = list(dict.fromkeys([*kept, *own, "rank", "id", "score"]))
    # Rows of no query or file have none to be similar to. Two without tokens are alike.
    group = F.when(F.col("qid").isNotNull() & F.col("file_path").isNotNull(), F.xxhash64(F.to_json(F.struct(*own))))
    rows = results.select(*held, F.monotonically_increasing_id().alias("__row"), group.alias("__group"), tx.token_hashes(F.col("content").cast("string")).alias("__w"))
    rows = rows.withColumn("__set", F.shiftrightunsigned(F.xxhash64("__group", "__w"), 1))
    # Words are few against their places: told by a dictionary, a place takes two bytes or so instead of eight.
    rows = shared.table(rows, "results", **{"compression": "zstd", "parquet.dictionary.page.size": 16 << 20})
    named = rows.where("__group is not null")
    member = named.select("__row", F.col("__set").alias("set"), at.alias("at"), "score")
    sets, walked = named.select(F.col("__set").alias("id"), F.col("__group").alias("group"), F.col("__w").alias("w")), member
    if best_first:
        walked = member.join(member.groupBy("set").agg(F.min("at").alias("f")).select(F.col("f.__row").alias("__row")), "__row", "left_semi")
    pairs = shared.table(_turns(walked, alike.pairs(sets, threshold)), "pairs")
    gone = shared.table(pairs.select(F.col("loser").alias("v"), "t").limit(0), "gone")
    while not pairs.isEmpty():
        waits = pairs.groupBy(F.col("loser").alias("winner")).agg(F.min("t").alias("wait"))
        fate = lambda c, name: gone.select(F.col("v").alias(c), F.col("t").alias(name))  # noqa: B023, E731
        known = pairs.join(waits, "winner", "left").join(fate("winner", "end"), "winner", "left").join(fate("loser", "out"), "loser", "left")
        # A pair whose winner went before it comes to nothing; one whose loser did changes nothing.
        known = known.where((F.col("end").isNull() | (F.col("end") > F.col("t"))) & (F.col("out").isNull() | (F.col("out") > F.col("t"))))
        known = shared.table(known.withColumn("sure", F.col("wait").isNull() | (F.col("wait") > F.col("t"))).select("winner", "loser", "t", "sure"), "known")
        gone = gone.unionByName(known.where("sure").select(F.col("loser").alias("v"), "t")).groupBy("v").agg(F.min("t").alias("t"))
        gone = shared.table(gone, "gone")
        pairs = known.where("not sure").drop("sure")
    out = gone.select(F.col("v").alias("__row"))
    if best_first:
        out = out.unionByName(member.select("__row").join(walked.select("__row"), "__row", "left_anti"))
    return rows.join(out, "__row", "left_anti").select(*kept)


def _turns(member: DataFrame, near: DataFrame) -> DataFrame:
    """(winner, loser, t) of the similar pairs of members (__row, set, at, score); near: (x, y), the sets that are similar; t: the pair's turn.

    Whoever comes to its turn meets nobody after the next of its own set with a higher
    score: that one is still there, as what would have removed it is similar to both and
    would have removed the lower and earlier one before, and it ends the turn.
    """
    places = member.withColumn("n", F.count("*").over(Window.partitionBy("set"))).where("n > 1").withColumn("place", F.row_number().over(Window.partitionBy("set").orderBy("at")))
    higher = places.select("set", "__row", "place", F.col("score").cast("double").alias("score")).groupBy("set").applyInArrow(_next_higher, "__row long, stop long")
    until = higher.join(member.select(F.col("__row").alias("stop"), F.col("at").alias("until")), "stop").select("__row", "until")
    member = member.join(until, "__row", "left")
    side = lambda c: member.select(F.col("set").alias(f"set_{c}"), F.col("__row").alias(c), *[F.col(k).alias(f"{k}_{c}") for k in ("at", "score", "until")])
    early = F.col("at_x") < F.col("at_y")
    reached = F.when(early, F.col("until_x").isNull() | (F.col("at_y") <= F.col("until_x"))).otherwise(F.col("until_y").isNull() | (F.col("at_x") <= F.col("until_y")))
    columns = ["x", "at_x", "score_x", "y", "at_y", "score_y"]
    equal = side("x").join(side("y"), F.col("set_x") == F.col("set_y")).where((F.col("at_x") < F.col("at_y")) & reached).select(*columns)
    near = near.select(F.col("x").alias("set_x"), F.col("y").alias("set_y"))
    both = equal.unionByName(near.join(side("x"), "set_x").join(side("y"), "set_y").where(reached).select(*columns))
    turn = F.when(early, F.struct(F.col("at_x").alias("a"), F.col("at_y").alias("b"))).otherwise(F.struct(F.col("at_y").alias("a"), F.col("at_x").alias("b")))
    x_stays = F.when(early, F.col("score_x") >= F.col("score_y")).otherwise(F.col("score_x") > F.col("score_y"))
    return both.select(F.when(x_stays, F.col("x")).otherwise(F.col("y")).alias("winner"), F.when(x_stays, F.col("y")).otherwise(F.col("x")).alias("loser"), turn.alias("t"))


def _next_higher(table: pa.Table) -> pa.Table:
    """(__row, stop): the next in place with a higher score, where there is one."""
    row, place, score = (table.column(c).to_numpy() for c in ("__row", "place", "score"))
    order = np.argsort(place)
    stop, waiting = np.full(len(row), -1, np.int64), []
    for k in order.tolist():
        while waiting and score[waiting[-1]] < score[k]:
            stop[waiting.pop()] = row[k]
        waiting.append(k)
    return pa.table({"__row": row[stop >= 0], "stop": stop[stop >= 0]})


def rerank(results: DataFrame, score: Column, pool: int = 20, min_score: float = 0.0) -> DataFrame:
    """The first ``pool`` of each query by the reranker's ``score``, then the rest as they were; pool members under ``min_score`` go."""
    marked = results.withColumn("rerank_score", F.when(F.col("rank") < pool, score))
    kept = marked.where((F.col("rank") >= pool) | (F.col("rerank_score") >= min_score))
    order = [F.col("rerank_score").desc_nulls_last(), F.col("rank")]
    return kept.withColumn("new_rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order)) - 1)
