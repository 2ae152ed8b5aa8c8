"""A keyword index as a stored table: built, added to, removed from, merged and searched.

Below ``root`` lie generations, each written once: postings (token, id, dl) in folders
by a hash of the token, so that a search reads its tokens' folders only; the chunks
(id, path, dl) they come from; and the paths that a generation removes. STATE names the
generations that count, and is replaced after a generation is whole: a reader sees all
of one or nothing. Compaction folds everything into a new generation.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.operators import retrieval
from corvane.sources import shared

K1, B = 1.2, 0.75
MOST = 2_000_000  # postings a file


def bucket(token: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


class KeywordIndex:
    """The index below ``root``; ``buckets`` folders of tokens, in each as many files, by a hash of the chunk, as
    a generation's size asks for, ``files`` at least: one task writes one file, of about ``MOST`` postings."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16, files: int = 1):
        self.spark, self.root = spark, root.rstrip("/")
        state = shared.read_state(spark, f"{self.root}/STATE")
        self.state = json.loads(state) if state else {"buckets": buckets, "files": files, "last": 0, "live": [], "removed": []}

    def _save(self) -> None:
        shared.write_text(self.spark, f"{self.root}/STATE", json.dumps(self.state))

    def _path(self, kind: str, gen: int) -> str:
        return f"{self.root}/{kind}/gen={gen}"

    def _write(self, gen: int, postings: DataFrame, rows: int) -> None:
        """postings: (token, id, dl, path), about ``rows``, of which the chunks are those of the token that stands for the chunk itself."""
        n = self.state["buckets"]
        files = max(self.state["files"], -(-rows // (n * MOST)))
        dealt = postings.withColumn("bucket", F.when(F.col("token") == "", -1).otherwise(bucket(F.col("token"), n)))
        file = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(files)).cast("int")
        dealt = dealt.withColumn("file", (F.col("bucket") + 1) * files + file).repartitionById((n + 1) * files, "file")
        dealt.select("token", "id", "dl", "path", "bucket").write.partitionBy("bucket").parquet(self._path("postings", gen))

    def add(self, chunks: DataFrame, id_col: str = "id", path: str = "file_path", content: str = "content") -> KeywordIndex:
        """Index the chunks; one of an id that is there already takes its place."""
        gen = self.state["last"] + 1
        lists = tx.token_lists(chunks, id_col, content, path)
        # The empty token stands for the chunk itself: its row has the path and the length.
        rows = lists.select(F.explode(F.concat(F.array(F.lit("")), "tokens")).alias("token"), "id", "dl", "path")
        size = chunks.agg(F.count("*").alias("n"), F.sum(F.octet_length(F.col(content).cast("string"))).alias("bytes")).first()
        # Texts have about one distinct token in eight bytes.
        self._write(gen, rows.withColumn("path", F.when(F.col("token") == "", F.col("path"))), size["n"] + (size["bytes"] or 0) // 8)
        self.state["last"] = gen
        self.state["live"].append(gen)
        self._save()
        return self

    def remove(self, paths: DataFrame, path: str = "file_path") -> KeywordIndex:
        """Chunks of these files count no more, case aside; files that are added later do."""
        gen = self.state["last"] + 1
        paths.select(F.lower(F.col(path)).alias("gone")).distinct().write.parquet(self._path("removed", gen))
        self.state["last"] = gen
        self.state["removed"].append(gen)
        self._save()
        return self

    def _read(self, kind: str, gens: list[int]) -> DataFrame | None:
        return self.spark.read.option("basePath", f"{self.root}/{kind}").parquet(*[self._path(kind, g) for g in gens]) if gens else None

    def _stored(self) -> DataFrame:
        found = self._read("postings", self.state["live"])
        if found is None:
            return self.spark.createDataFrame([], "token string, id long, dl int, path string, gen int, bucket int")
        return found

    def chunks(self) -> DataFrame:
        """(id, path, dl, gen) of the live chunks: the newest of each id, unless its file was removed since."""
        own = self._stored().where("bucket = -1").select("id", "path", "dl", "gen")
        if len(self.state["live"]) > 1:
            own = own.groupBy("id").agg(F.max(F.struct("gen", "path", "dl")).alias("m")).select("id", "m.path", "m.dl", "m.gen")
        gone = self._read("removed", [g for g in self.state["removed"] if g > min(self.state["live"], default=0)])
        if gone is not None:
            gone = gone.groupBy("gone").agg(F.max("gen").alias("at"))
            own = own.join(gone, (F.lower("path") == F.col("gone")) & (F.col("at") > F.col("gen")), "left_anti")
        return own

    def _folded(self) -> bool:
        return len(self.state["live"]) <= 1 and not any(g > min(self.state["live"], default=0) for g in self.state["removed"])

    def postings(self, tokens: DataFrame | None = None) -> DataFrame:
        """(token, id, dl) of the live chunks; of ``tokens`` (token) only, from their folders."""
        rows = self._stored().where("bucket >= 0")
        if tokens is not None:
            asked = tokens.select("token").distinct()
            folders = [r[0] for r in asked.select(bucket(F.col("token"), self.state["buckets"])).distinct().collect()]  # at most as many as folders
            rows = rows.where(F.col("bucket").isin(folders)).join(asked, "token", "left_semi")
        if not self._folded():
            rows = rows.join(self.chunks().select("id", "gen"), ["id", "gen"], "left_semi")
        return rows.select("token", "id", "dl")

    def statistics(self) -> DataFrame:
        """One row: n live chunks that have tokens, and their average length."""
        return self.chunks().where("dl > 0").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))

    def compact(self) -> KeywordIndex:
        """Fold all generations into one, and delete them."""
        gen = self.state["last"] + 1
        live = self.chunks().select(F.lit("").alias("token"), "id", "dl", "path")
        self._write(gen, live.unionByName(self.postings().withColumn("path", F.lit(None).cast("string"))), self._stored().count())
        old = [self._path("postings", g) for g in self.state["live"]] + [self._path("removed", g) for g in self.state["removed"]]
        self.state |= {"last": gen, "live": [gen], "removed": []}
        self._save()
        fs = shared.files(self.spark, self.root)
        for p in old:
            fs.delete(shared.at(self.spark, p), True)
        return self

    def merge(self, other: KeywordIndex) -> KeywordIndex:
        """Take over the other index's chunks; of an id that both have, the other's stays."""
        gen = self.state["last"] + 1
        live = other.chunks().select(F.lit("").alias("token"), "id", "dl", "path")
        self._write(gen, live.unionByName(other.postings().withColumn("path", F.lit(None).cast("string"))), other._stored().count())
        self.state["last"] = gen
        self.state["live"].append(gen)
        self._save()
        return self

    def search(self, queries: DataFrame, query: str = "query", qid: str = "qid", most: int = 20_000) -> DataFrame:
        """(qid, id, score): BM25 with term frequency one, statistics from the whole index.

        The tokens of at most ``most`` queries are taken to the driver, which reads the plans'
        folders off them; those of more stay a table that is made for each use.
        """
        asked = self.asked(queries, query, qid, most)
        return bm25(self.postings(asked), self.statistics(), asked)

    def asked(self, queries: DataFrame, query: str = "query", qid: str = "qid", most: int = 20_000) -> DataFrame:
        """(qid, token) of the queries; of at most ``most`` as a local table, which joins without a shuffle of postings."""
        found = tx.token_lists(queries, qid, query, None).select(F.col("id").alias("qid"), F.explode("tokens").alias("token"))
        return self.spark.createDataFrame(found.toArrow()) if queries.limit(most + 1).count() <= most else found

    def best(self, queries: DataFrame, k: int, query: str = "query", qid: str = "qid", most: int = 20_000) -> DataFrame:
        """(qid, id, score, rank): the k best of ``search``.

        For at most ``most`` queries the postings of their tokens are dealt by chunk, and
        each task adds up a matrix of queries by chunks, some chunks at a time, and keeps
        its k best of every query: sums need no rows of (query, chunk) then. More queries
        go by ``search``.
        """
        asked = tx.token_lists(queries, qid, query, None).select(F.col("id").alias("qid"), F.explode("tokens").alias("token"))
        if queries.limit(most + 1).count() > most:
            return retrieval.top(self.search(queries, query, qid, most), k, ["qid"])
        asked = self.spark.createDataFrame(asked.toArrow())
        hits = self.postings(asked)
        stats = self.statistics().first()
        # A row for each token of the queries.
        df = hits.groupBy("token").agg(F.count("*").alias("df")).toPandas()
        idf = np.log(1 + (stats["n"] - df["df"].to_numpy() + 0.5) / (df["df"].to_numpy() + 0.5))
        pairs = asked.toPandas().merge(pd.DataFrame({"token": df["token"], "at": np.arange(len(df))}), on="token").sort_values(["at", "qid"])
        names, column = np.unique(pairs["qid"].to_numpy(np.int64), return_inverse=True)
        first = np.searchsorted(pairs["at"].to_numpy(), np.arange(len(df) + 1))
        held = self.spark.sparkContext.broadcast((df["token"].tolist(), idf * (K1 + 1), float(stats["avgdl"] or 1), first, column, names))
        parts = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")), int(df["df"].sum()) // MOST)
        dealt = hits.select("id", "token", "dl").repartition(parts, "id").sortWithinPartitions("id")
        return retrieval.top(dealt.mapInArrow(_added(held, k), "qid long, id long, score double"), k, ["qid"])


def _added(held, k: int, cells: int = 4_000_000):
    """The k best chunks of every query among postings in order of chunks."""

    def run(batches):
        tokens, weight, avgdl, first, column, names = held.value
        if not len(names):
            return
        place = pd.Index(tokens)
        some = max(1, cells // len(names))  # chunks at a time
        ids, scores = np.zeros((len(names), 0), np.int64), np.zeros((len(names), 0))

        def add(token: np.ndarray, chunk: np.ndarray, dl: np.ndarray) -> None:
            nonlocal ids, scores
            own, row = np.unique(chunk, return_inverse=True)
            w = weight[token] / (1 + K1 * (1 - B + B * dl / avgdl))
            n = first[token + 1] - first[token]
            total = np.zeros(len(names) * len(own))
            ends = np.cumsum(n)
            for a in range(0, len(token), step := 200_000):
                m, low = n[a : a + step], ends[a : a + step] - n[a : a + step]
                at = np.repeat(first[token[a : a + step]] - (low - (low[0] if len(low) else 0)), m) + np.arange(int(m.sum()))
                total += np.bincount(column[at] * len(own) + np.repeat(row[a : a + step], m), np.repeat(w[a : a + step], m), len(total))
            table = np.where(total > 0, total.round(6), -1).reshape(len(names), len(own))
            ids, scores = np.hstack([ids, np.broadcast_to(own, table.shape)]), np.hstack([scores, table])
            if scores.shape[1] > k:
                order = retrieval.best(ids, scores, k)
                ids, scores = np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)

        waiting = [np.zeros(0, np.int64)] * 3
        for b in batches:
            new = [place.get_indexer(b.column(1).to_pandas()), b.column(0).to_numpy(), b.column(2).to_numpy().astype(np.int64)]
            waiting = [np.concatenate(x) for x in zip(waiting, new, strict=True)]
            while True:
                starts = np.flatnonzero(np.concatenate([[True], waiting[1][1:] != waiting[1][:-1]])) if len(waiting[1]) else np.zeros(0, np.int64)
                if len(starts) <= some:
                    break
                add(*(x[: starts[some]] for x in waiting))
                waiting = [x[starts[some] :] for x in waiting]
        if len(waiting[1]):
            add(*waiting)
        r, c = np.nonzero(scores > 0)
        yield pa.RecordBatch.from_arrays([pa.array(names[r]), pa.array(ids[r, c]), pa.array(scores[r, c])], ["qid", "id", "score"])

    return run


def bm25(hits: DataFrame, statistics: DataFrame, asked: DataFrame) -> DataFrame:
    """Scores of the postings of asked tokens. hits: (token, id, dl); statistics: one row; asked: (qid, token)."""
    df = hits.groupBy("token").agg(F.count("*").alias("df"))
    weighted = df.crossJoin(F.broadcast(statistics)).select("token", "avgdl", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))  # statistics is one row
    weight = F.col("idf") * (K1 + 1) / (1 + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hits.join(asked.join(weighted, "token"), "token").groupBy("qid", "id").agg(F.round(F.sum(weight), 6).alias("score"))
