"""The link graph of pages: edges, orphans, neighbourhoods and staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import page_id


def plain(text: Column) -> Column:
    """Without fenced blocks, of which an unclosed one reaches to the end, and without inline code."""
    lines = F.regexp_replace(text, r"\r\n?", "\n")
    open_ = F.regexp_replace(lines, r"(?ms)^[ \t]*(```|~~~).*?(^[ \t]*(```|~~~)[^\n]*$|\z)", "")
    return F.regexp_replace(open_, r"`[^`\n]*`", "")


def wiki_links(text: Column) -> Column:
    """Targets of [[target#anchor|alias]] outside fenced and inline code."""
    raw = F.regexp_extract_all(plain(text), F.lit(r"\[\[([^\]\[\n]+)\]\]"), F.lit(1))
    target = F.transform(raw, lambda r: F.trim(F.regexp_extract(r, r"^([^|#]*)", 1)))
    return F.filter(target, lambda t: F.length(t) > 0)


def page_links(text: Column) -> Column:
    """Targets of [text](path.md) links to local pages, outside code."""
    return F.regexp_extract_all(plain(text), F.lit(r"\[[^\]]*\]\((?!https?:|mailto:|#)([^)\s]+?\.md)(?:\s+\"[^\"]*\")?\)"), F.lit(1))


def _base(c: Column) -> Column:
    return F.regexp_extract(c, r"([^/]*)$", 1)


# Pages that hold no content of their own.
INDEXES = ("index", "log")


def vertices(pages: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(id, base, title, is_content) of each page once: its title is that of its block, else its first heading, else its name; index, log and template pages aren't content. A page without an id is left out."""
    own = F.regexp_extract(F.regexp_replace(text, r"\r\n?", "\n"), r"\A---[ \t]*\n(?s:.*?)(?<=\n)title:[ \t]*[\"']?([^\n]*?)[\"']?[ \t]*\n", 1)
    head = F.trim(F.regexp_extract(text, r"(?m)^#\s+(.+)$", 1))
    out = pages.select(page_id(F.col(path)).alias("id"), own.alias("own"), head.alias("head")).where("id <> ''")
    out = out.groupBy("id").agg(F.min(F.struct("own", "head")).alias("t")).select("id", _base(F.col("id")).alias("base"), "t.own", "t.head")
    title = F.when(F.col("own") != "", F.col("own")).when(F.col("head") != "", F.col("head")).otherwise(F.col("base"))
    return out.select("id", "base", title.alias("title"), (~F.col("id").isin(*INDEXES) & ~F.col("id").startswith("templates/")).alias("is_content"))


def resolve(pages: DataFrame, links: DataFrame) -> DataFrame:
    """(src, raw, dst): the page of the same id, else the only one of that base name, else null.

    pages: (id), normalised. links: (src, raw).
    """
    want = links.withColumn("t", page_id(F.col("raw")))
    exact = pages.select(F.col("id").alias("exact"))
    unique = pages.groupBy(_base(F.col("id")).alias("base")).agg(F.min("id").alias("only"), F.count("*").alias("n")).where("n = 1").select("base", "only")
    found = want.join(exact, F.col("t") == F.col("exact"), "left").join(unique, _base(F.col("t")) == F.col("base"), "left")
    return found.select("src", "raw", F.when(F.length("t") > 0, F.coalesce("exact", "only")).alias("dst"))


def edges(resolved: DataFrame) -> DataFrame:
    """Distinct links between different pages."""
    return resolved.where("dst is not null and src <> dst").select("src", "dst").distinct()


def orphans(pages: DataFrame, edge: DataFrame, ignore: list[str] = ("index", "log")) -> DataFrame:
    """Pages that no other page but the ignored ones links to."""
    real = edge.where(~F.col("src").isin(*ignore)).select(F.col("dst").alias("id")).distinct()
    return pages.select("id").where(~F.col("id").isin(*ignore)).join(real, "id", "left_anti")


def neighbourhood(edge: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(id, hop): pages within ``hops`` links of the seeds, either way, and the fewest links."""
    both = edge.select("src", "dst").unionByName(edge.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    seen = seeds.select("id", F.lit(0).alias("hop"))
    last = seen
    for h in range(1, hops + 1):
        step = last.join(both, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct()
        last = step.join(seen.select("id"), "id", "left_anti").withColumn("hop", F.lit(h))
        seen = seen.unionByName(last)
    return seen


def overview(pages: DataFrame, edge: DataFrame) -> DataFrame:
    """One row: pages, links, the median in-degree at floor(n / 2), and the hub."""
    degree = pages.join(edge.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("d")), "id", "left").select("id", F.coalesce("d", F.lit(0)).alias("d"))
    w = degree.agg(F.count("*").alias("pages"), F.sum("d").alias("links"), F.min_by("id", F.struct(-F.col("d"), "id")).alias("hub"))
    per = degree.groupBy("d").agg(F.count("*").alias("c"))  # a row a degree
    upto = per.alias("a").join(per.select(F.col("d").alias("e"), F.col("c").alias("m")), F.col("e") <= F.col("d")).groupBy("d").agg(F.sum("m").alias("n"))
    half = w.select(F.floor(F.col("pages") / 2).alias("half"))
    return w.crossJoin(upto.crossJoin(half).where("n > half").agg(F.min("d").alias("median_degree")))  # one row each


def staleness(reviews: DataFrame, touches: DataFrame, now: Column, max_days: int = 90) -> DataFrame:
    """(id, state): missing review, stale if a source changed after the review's day, old after max_days, else fresh."""
    newest = touches.groupBy("id").agg(F.max("touched").alias("touched"))
    end = F.col("reviewed") + F.expr("interval 1 day")
    old = F.unix_timestamp(now) - F.unix_timestamp("reviewed") > max_days * 86400
    state = F.when(F.col("reviewed").isNull(), "unreviewed").when(F.col("touched") >= end, "stale").when(old, "old").otherwise("fresh")
    return reviews.join(newest, "id", "left").select("id", state.alias("state"))
