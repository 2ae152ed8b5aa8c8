"""What runs, watchers and results are like, and the names that a workspace may go by."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions import parsing as ps


def run_state(unavailable: Column, chunks: Column, new: Column, modified: Column, *failures: Column) -> Column:
    """incomplete without an embedder or where changed files gave no chunk, partial where anything failed, else ok."""
    none = (chunks == 0) & (new + modified > 0)
    some = F.greatest(F.lit(0), *failures) > 0
    return F.when(unavailable | none, "incomplete").when(some, "partial").otherwise("ok")


def watcher_reason(failures: Column, last_error: Column, changed: Column, succeeded: Column) -> Column:
    """Why a watcher is unhealthy; null where it is healthy."""
    n = F.coalesce(failures, F.lit(0))
    said = F.concat(n.cast("string"), F.lit(" consecutive reindex failure(s)"), F.coalesce(F.concat(F.lit(": "), last_error), F.lit("")))
    late = changed.isNotNull() & (succeeded.isNull() | (changed > succeeded))
    return F.when(n > 0, said).when(late, "changes detected after the last successful reindex")


def is_weak(mean_score: Column, floor: float) -> Column:
    """Whether results whose mean score is this are weak; a floor of 0 or less has none."""
    return (mean_score < floor) if floor > 0 else F.lit(False)


def canonical(folder: Column, windows: bool = False) -> Column:
    """The spelling that counts: on Windows with the drive letter in upper case."""
    return F.concat(F.upper(F.substring(folder, 1, 1)), F.substring(folder, 2, 100_000)) if windows else folder


def legacy_names(folder: Column, windows: bool = False) -> Column:
    """The other namespaces that earlier writers gave a folder: its spelling as it is and with either case of the first letter."""
    first, rest = F.substring(folder, 1, 1), F.substring(folder, 2, 100_000)
    spelled = F.array(folder, F.concat(F.lower(first), rest), F.concat(F.upper(first), rest))
    return F.array_except(F.transform(spelled, namespace_of), F.array(namespace_of(canonical(folder, windows))))


def namespace_of(folder: Column) -> Column:
    """A folder's namespace: its base name and eight digits of the path's hash."""
    base = F.regexp_extract(F.regexp_replace(folder, r"\\", "/"), r"([^/]*)/*$", 1)
    name = F.when(base == "", "workspace").otherwise(base)
    return ps.namespace(F.concat(name, F.lit("_"), F.substring(F.sha1(folder), 1, 8)))
