"""The memory log: recall, injection gates, capture, lint and namespaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import signals as sg
from corvane.functions import text as tx
from corvane.operators import alike


def recall(
    records: DataFrame, min_confidence: float = 0.5, min_score: float = 0.72, kind: str | None = None, tags: list[str] = (), exclude_tags: list[str] = (), k: int = 10
) -> DataFrame:
    """The k best live records by similarity times confidence, past the gates.

    records: (id, similarity, confidence, kind, tags, deleted); a null confidence is 1.
    """
    conf = F.coalesce("confidence", F.lit(1.0))
    hold = ~F.col("deleted") & (conf >= min_confidence) & (F.col("similarity") >= min_score)
    if kind:
        hold &= F.col("kind") == kind
    if tags:
        hold &= F.arrays_overlap("tags", F.array(*map(F.lit, tags)))
    if exclude_tags:
        hold &= ~F.arrays_overlap("tags", F.array(*map(F.lit, exclude_tags)))
    score = F.round(F.col("similarity") * F.least(F.lit(1.0), F.greatest(F.lit(0.01), conf)), 6)
    return records.where(hold).withColumn("score", score).orderBy(F.desc("score"), "id").limit(k)


def similar_pairs(records: DataFrame, threshold: float, text: str = "content", id_col: str = "id") -> DataFrame:
    """(a, b, similarity): word-set Jaccard over ``threshold``, of pairs that share one of their rarest words.

    A pair over the threshold t shares at least t of the longer set, so it has a
    common word among the first n - ceil(t n) + 1 of each set by rising frequency:
    only those prefixes are joined, and no pair is lost. A pair is made where the first
    word that both prefixes have meets, so none is made twice. Equal sets are joined
    as one; what is returned pairs their first with the others.
    """
    w = F.array_sort(tx.word_set(F.col(text)))
    sets = records.select(F.col(id_col).alias("id"), w.alias("w"))
    name = F.when(F.col("w").isNull(), "none").otherwise(F.sha2(F.array_join("w", " "), 256))  # words have no spaces
    one = sets.groupBy(name.alias("name")).agg(F.min("id").alias("id"), F.first("w").alias("w"))
    words = one.select("id", "w", F.explode("w").alias("t"))
    freq = words.groupBy("t").agg(F.count("*").alias("f"))
    ordered = words.join(freq, "t").groupBy("id").agg(F.first("w").alias("w"), F.array_sort(F.collect_list(F.struct("f", "t"))).alias("o"))
    n = F.size("o")
    keep = n - F.ceil(threshold * n) + 1
    head = ordered.select("id", "w", F.slice(F.transform("o", lambda x: x["t"]), F.lit(1), keep.cast("int")).alias("p")).select("*", F.explode("p").alias("t"))
    other = head.select(F.col("id").alias("b"), F.col("w").alias("wb"), F.col("p").alias("pb"), "t")
    low, high = F.least(F.size("w"), F.size("wb")), F.greatest(F.size("w"), F.size("wb"))
    met = head.join(other, "t").where((F.col("id") < F.col("b")) & (low >= threshold * high) & (F.array_intersect("p", "pb")[0] == F.col("t")))
    pairs = met.select(F.col("id").alias("a"), "b", tx.jaccard(F.col("w"), F.col("wb")).alias("similarity")).where(F.col("similarity") > threshold)
    member = sets.select(F.col("id").alias("b"), name.alias("name"))
    equal = one.select(F.col("id").alias("a"), "name").join(member, "name").where("a <> b").select("a", "b", F.lit(1.0).alias("similarity"))
    return pairs.unionByName(equal)


def lint(records: DataFrame, now: Column, min_confidence: float = 0.5, half_life_days: int = 30, threshold: float = 0.85) -> DataFrame:
    """(issue, id, other): low confidence, older than twice the half-life, near-duplicates."""
    none = F.lit(None).cast("long")
    low = records.where(F.col("confidence") < min_confidence).select(F.lit("low-confidence").alias("issue"), "id", none.alias("other"))
    stale = records.where(sg.stale(F.col("observed"), now, half_life_days)).select(F.lit("stale").alias("issue"), "id", none.alias("other"))
    near = similar_pairs(records, threshold).select(F.lit("near-duplicate").alias("issue"), F.col("a").alias("id"), F.col("b").alias("other"))
    return low.unionByName(stale).unionByName(near)


def lint_counts(records: DataFrame, now: Column, min_confidence: float = 0.5, half_life_days: int = 30, threshold: float = 0.85) -> DataFrame:
    """(issue, n): how many records or, of near-duplicates, pairs of records have each issue that there is."""
    issues = F.array(F.when(F.col("confidence") < min_confidence, "low-confidence"), F.when(sg.stale(F.col("observed"), now, half_life_days), "stale"))
    single = records.select(F.explode(issues).alias("issue")).where("issue is not null").groupBy("issue").agg(F.count("*").alias("n"))
    near = alike.count(records, threshold).where("n > 0").select(F.lit("near-duplicate").alias("issue"), "n")
    return single.unionByName(near)


def inject(candidates: DataFrame, message: Column, done: DataFrame, k: int, min_shared: int = 2, min_content: int = 1, stop: list[str] = ()) -> DataFrame:
    """Candidates not yet injected that share enough words with the message, by content overlap, overlap, score and id."""
    w, m = tx.word_set(F.col("content"), 3), tx.word_set(message, 3)
    out = candidates.join(done, "id", "left_anti").withColumn("shared", tx.shared(w, m)).withColumn("content_shared", tx.shared(w, m, list(stop)))
    out = out.where((F.col("shared") >= min_shared) & (F.col("content_shared") >= min_content))
    return out.orderBy(F.desc("content_shared"), F.desc("shared"), F.desc("score"), "id").limit(k)


def new_candidates(candidates: DataFrame, existing: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Candidates less similar than ``threshold`` to every existing record: those of the joint pairs are left out."""
    both = candidates.select(F.col("id"), "content").unionByName(existing.select((-F.col("id") - 1).alias("id"), "content"))
    hit = similar_pairs(both, threshold - 1e-9).where((F.col("a") < 0) != (F.col("b") < 0)).select(F.greatest("a", "b").alias("id"))
    return candidates.join(hit, "id", "left_anti")


def namespaces(rows: DataFrame) -> DataFrame:
    """The live namespace: most rows, then the newest version."""
    found = rows.groupBy("ns").agg(F.count("*").alias("n"), F.max("ver").alias("ver"))
    return found.orderBy(F.desc("n"), F.desc("ver"), "ns")


def version_newer(a: Column, b: Column) -> Column:
    """Dotted numeric comparison; what follows a dash is dropped."""
    part = lambda v, i: F.coalesce(F.try_element_at(F.split(F.split_part(v, F.lit("-"), F.lit(1)), r"\."), F.lit(i)).cast("int"), F.lit(0))
    key = lambda v: F.struct(*[part(v, i).alias(f"p{i}") for i in (1, 2, 3)])
    return key(a) > key(b)


def gotchas(records: DataFrame, tools: list[str], k: int = 5) -> DataFrame:
    """(id, tool, content) of the k newest records on failures of callable tools whose cause is worth a warning.

    records: (id, content, tags, observed). The tags tell the tool and the cause.
    """
    tool, kind = F.lower(sg.tag_value(F.col("tags"), sg.TOOL_TAG)), sg.tag_value(F.col("tags"), sg.CAUSE_TAG)
    fit = F.array_contains("tags", sg.ERROR_TAG) & tool.isin([t.lower() for t in tools]) & kind.isin(sg.WARNED_OF)
    return records.where(fit).orderBy(F.desc("observed"), F.desc("id")).limit(k).select("id", tool.alias("tool"), "content")


def known_failures(failures: DataFrame, records: DataFrame) -> DataFrame:
    """The failures (tool, cause, ...) for which a record bears both the tool's tag and the cause's."""
    marked = records.select(F.explode(F.filter("tags", lambda t: t.startswith(sg.TOOL_TAG))).alias("t"), "tags")
    marked = marked.select("t", F.explode(F.filter("tags", lambda t: t.startswith(sg.CAUSE_TAG))).alias("c")).distinct()
    own = (F.concat(F.lit(sg.TOOL_TAG), F.lower("tool")) == F.col("t")) & (F.concat(F.lit(sg.CAUSE_TAG), F.col("cause")) == F.col("c"))
    return failures.join(marked, own, "left_semi")


def recall_for_error(hits: DataFrame, error: Column, injected: DataFrame, k: int = 2, min_score: float = 0.7, inject_min: float | None = None, min_shared: int = 1, budget: bool = True) -> DataFrame:
    """(id, similarity, inject) of the hits for one error: candidates past the floor, and which of them may be injected.

    hits: (id, content, score, similarity). The max(3k, 6) best scores are taken, those
    that share too few words with the error go. Candidates come by similarity; with
    budget left, the k first at ``inject_min`` or more that were not injected before are.
    """
    some = hits.where(F.col("score") >= min_score).orderBy(F.desc("score"), "id").limit(max(3 * k, 6))
    some = some.where(tx.shared(tx.word_set(F.col("content"), 3), tx.word_set(error, 3)) >= min_shared)
    free = some.join(injected.select(F.col("id").alias("done")), F.col("id") == F.col("done"), "left")
    bar = min_score if inject_min is None else inject_min
    fit = F.col("done").isNull() & (F.col("similarity") >= bar) & F.lit(budget)
    place = F.row_number().over(Window.partitionBy("fit").orderBy(F.desc("similarity"), "id"))  # at most max(3k, 6) rows
    return free.withColumn("fit", fit).withColumn("place", place).select("id", "similarity", (F.col("fit") & (F.col("place") <= k)).alias("inject"))


def capture(extracted: DataFrame, existing: DataFrame, output: str = "output", most: int = 2, threshold: float = 0.85) -> DataFrame:
    """Extracted candidates (id, turn, content, output) to be remembered: ``most`` a turn, in order of id.

    Only turns whose output tells of a failure count, only candidates that no record
    resembles, and only contents that are allowed.
    """
    failed = extracted.where(sg.signal(F.col(output)).isNotNull())
    fresh = new_candidates(failed, existing, threshold).where(sg.allowed(F.col("content")))
    place = F.row_number().over(Window.partitionBy("turn").orderBy("id"))
    return fresh.withColumn("place", place).where(F.col("place") <= most).drop("place")


def add(log: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The log with the new records whose content is allowed, and those that are rejected.

    Both: (id, content, kind, tags, confidence, observed, deleted_at). A null confidence is 1.
    """
    ok = sg.allowed(F.col("content"))
    given = new.withColumn("confidence", F.coalesce("confidence", F.lit(1.0)))
    return log.unionByName(given.where(ok).select(log.columns)), given.where(~ok)


def update(log: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The log with the patches (id, content, kind, tags, confidence) of live records; nulls keep what is there.

    The second result tells of every patch (id, state): updated, rejected, where a new
    content is not allowed and nothing of the patch counts, or missing. The time of the
    observation stays.
    """
    names = ["content", "kind", "tags", "confidence"]
    given = patches.select(F.col("id").alias("__id"), *[F.col(c).alias(f"__{c}") for c in names])
    refused = F.col("__content").isNotNull() & (F.col("__content") != F.col("content")) & ~sg.allowed(F.col("__content"))
    hit = F.col("__id").isNotNull() & F.col("deleted_at").isNull()
    both = log.join(given, F.col("id") == F.col("__id"), "left")
    out = both.select(*[(F.when(hit & ~F.coalesce(refused, F.lit(False)), F.coalesce(f"__{c}", c)).otherwise(F.col(c)) if c in names else F.col(c)).alias(c) for c in log.columns])
    told = given.join(log.where("deleted_at is null"), F.col("id") == F.col("__id"), "left")
    state = F.when(F.col("id").isNull(), "missing").when(F.coalesce(refused, F.lit(False)), "rejected").otherwise("updated")
    return out, told.select(F.col("__id").alias("id"), state.alias("state"))


def remove(log: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """The log with tombstones: removed records stay, deleted and last observed ``now``, so that a merge cannot revive them."""
    gone = ids.select(F.col("id").alias("__id")).distinct()
    both = log.join(gone, F.col("id") == F.col("__id"), "left")
    hit = F.col("__id").isNotNull() & F.col("deleted_at").isNull()
    put = {"deleted_at": now, "observed": now}
    return both.select(*[(F.when(hit, put[c]).otherwise(F.col(c)) if c in put else F.col(c)).alias(c) for c in log.columns])


def reconcile(log: DataFrame, store: DataFrame, indexed: DataFrame, suspects: DataFrame, now: Column, grace_s: int = 3600) -> tuple[DataFrame, DataFrame]:
    """What to do so that the store and the keyword index follow the log: (id, action), and the next suspects (id, first_seen).

    log: (id, deleted_at); store: (id), a row each; indexed: (id); suspects: of the last
    time. Live records: ``collapse`` where the store has several rows, which are written
    anew, ``restore`` where it has none, ``index`` where the keyword index lacks them or
    they were written anew. Store rows without a live record: kept as suspects at first,
    ``delete`` once they are seen ``grace_s`` after; with an empty log nothing is deleted
    and the suspects stay.
    """
    live = log.where("deleted_at is null").select("id").distinct()
    rows = store.groupBy("id").agg(F.count("*").alias("rows"))
    both = live.join(rows, "id", "left").join(indexed.select("id", F.lit(True).alias("there")).distinct(), "id", "left")
    anew = F.col("rows").isNull() | (F.col("rows") > 1)
    act = F.array(F.when(F.col("rows") > 1, "collapse"), F.when(anew, "restore"), F.when(anew | F.col("there").isNull(), "index"))
    actions = both.select("id", F.explode(F.filter(act, lambda a: a.isNotNull())).alias("action"))
    known = log.limit(1).select(F.lit(True).alias("known"))  # one row, or none
    orphans = rows.select("id").join(live, "id", "left_anti").join(suspects, "id", "left").crossJoin(F.broadcast(known))
    old = F.col("first_seen").isNotNull() & (F.unix_timestamp(now) - F.unix_timestamp("first_seen") >= grace_s)
    late = orphans.where(old).select("id", F.lit("delete").alias("action"))
    left = orphans.where(~old).select("id", F.coalesce("first_seen", now).alias("first_seen"))
    unknown = suspects.join(log.limit(1).select(F.lit(1).alias("one")), F.lit(True), "left_anti")
    return actions.unionByName(late), left.unionByName(unknown.select("id", "first_seen"))
