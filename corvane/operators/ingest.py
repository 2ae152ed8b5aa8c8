"""Files into a store of chunks at once: chunked, described, embedded and written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import parsing as ps
from corvane.operators import chunking, incremental, providers


def ingest(
    store: DataFrame, files: DataFrame, embedder: providers.Embed, describe: Callable[[list[str]], list[str]] | None = None, cache: DataFrame | None = None,
    config: str = "", overrides: dict[str, str] | None = None, prefix: str = "",
) -> tuple[DataFrame, DataFrame | None]:
    """The store with the files' (path, text) chunks in place of what it had of them, and the grown description cache.

    store: (id, path, start_line, end_line, language, content, description, embedding).
    Chunks without a description of their own get one of ``describe`` where the cache has
    none; chunks whose embedding failed are not written.
    """
    chunks = chunking.chunk_files(files, overrides)
    if describe is not None:
        place = F.concat_ws(":", "path", F.col("start_line").cast("string"), F.col("end_line").cast("string"))
        lack = chunks.where("description = ''").drop("description")
        told, cache = providers.described(lack, cache, describe, config, place)
        chunks = chunks.where("description <> ''").unionByName(told.select(chunks.columns))
    header = ps.metadata_header(F.col("path"), F.col("content"), F.col("language"))
    ready = chunks.withColumn("__text", ps.embed_text(F.col("path"), header, F.coalesce("description", F.lit("")), F.col("content"), prefix))
    write = providers.embed(ready, embedder, "__text").select(store.columns)
    return incremental.upsert(store, write), cache
