"""Session and token roll-ups over an event table.

Events: (session_id, ts, event, message_id, role, model, tokens..., cost, tool,
injected, context_tokens). Every roll-up is one aggregation per key, partly done
before its shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import half_up

# The token estimates of the comparison.
GUIDANCE, READ_TOKENS, SEARCH_TOKENS, USUAL_READS = 150, 1200, 800, 2.5
RAG_TOOLS = ["search_semantic", "get_file_skeleton", "find_usages", "read"]


def summary(events: DataFrame) -> DataFrame:
    """A row a session: message, step, token, cost, tool and context sums and the mean response time."""
    said = (F.col("event") == "message") & (F.col("role") == "assistant")
    took = F.when(said & (F.col("completed") > F.col("created")), F.col("completed") - F.col("created"))
    total = lambda c, when: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0))
    tool = F.col("event") == "tool"
    context = F.col("event") == "rag.context"
    return events.groupBy("session_id").agg(
        F.min("ts").alias("started_at"), F.max("ts").alias("last_event_at"), F.count_if(said).alias("messages"),
        total("input", said).alias("input"), total("output", said).alias("output"), F.round(total("cost", said), 6).alias("cost"),
        F.count_if(F.col("event") == "step").alias("steps"), F.count_if(tool).alias("tools"),
        F.count_if(tool & F.col("tool").isin(*RAG_TOOLS)).alias("rag_tools"), F.count_if(context & F.col("injected")).alias("contexts"),
        total("context_tokens", context).alias("context_tokens"), F.count_distinct(F.when(said, F.col("model"))).alias("models"),
        half_up(F.avg(took)).cast("long").alias("avg_response"),
    )


def tool_counts(events: DataFrame) -> DataFrame:
    """(session_id, counts): a map from tool to calls."""
    per = events.where("event = 'tool' and tool is not null").groupBy("session_id", "tool").agg(F.count("*").alias("n"))
    return per.groupBy("session_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tool", "n")))).alias("counts"))


def message_breakdown(events: DataFrame) -> DataFrame:
    """A row a message: its first assistant event, its last context event, its tool calls."""
    said = (F.col("event") == "message") & (F.col("role") == "assistant")
    context = F.col("event") == "rag.context"
    first = F.min(F.when(said, F.struct("ts", "event_id", "input", "output", "cost")))
    last = F.max(F.when(context, F.struct("ts", "event_id", "context_tokens")))
    tool = F.col("event") == "tool"
    search = F.count_if(tool & F.col("tool").isin("search_semantic", "get_file_skeleton", "find_usages"))
    m = events.groupBy("session_id", "message_id").agg(first.alias("f"), last.alias("c"), F.count_if(tool & (F.col("tool") == "read")).alias("reads"), search.alias("searches"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return m.where("f is not null").select(
        "session_id", "message_id", zero("f.input").alias("input"), zero("f.output").alias("output"), zero("f.cost").alias("cost"),
        zero("c.context_tokens").alias("context_tokens"), "reads", "searches",
    )


def savings(totals: DataFrame) -> DataFrame:
    """Estimated tokens without retrieval, from (messages, input, context_tokens, contexts, reads, searches)."""
    n = F.col("messages")
    guidance = F.when(F.col("contexts") > 0, GUIDANCE * n).otherwise(0)
    extra = F.greatest(F.lit(0.0), USUAL_READS - F.when(n > 0, F.col("reads") / n).otherwise(0.0)) * READ_TOKENS * n
    without = F.col("input") - F.col("context_tokens") - guidance + extra + F.col("searches") * SEARCH_TOKENS
    net = without - F.col("input")
    pct = F.when(without > 0, 100 * net / without).otherwise(0.0)
    return totals.select(*totals.columns, half_up(without).cast("long").alias("without_rag"), half_up(net).cast("long").alias("net"), (half_up(pct * 10) / 10).alias("pct"))


def compare(a: DataFrame, b: DataFrame, key: str, measures: list[str]) -> DataFrame:
    """Full outer join of two runs: b less a, a missing side counts 0."""
    x = a.select(F.col(key), *[F.col(m).alias(f"a_{m}") for m in measures])
    y = b.select(F.col(key).alias("__k"), *[F.col(m).alias(f"b_{m}") for m in measures])
    d = [(F.coalesce(f"b_{m}", F.lit(0)) - F.coalesce(f"a_{m}", F.lit(0))).alias(f"d_{m}") for m in measures]
    return x.join(y, F.col(key) == F.col("__k"), "full").select(F.coalesce(key, "__k").alias(key), *d)


def within_budget(results: DataFrame, by: str, order: list[Column], tokens: Column, budget: int) -> DataFrame:
    """The best results whose tokens fit the budget together; the best of each group always stays."""
    from pyspark.sql import Window

    w = Window.partitionBy(by).orderBy(*order)
    return results.withColumn("__sum", F.sum(tokens).over(w)).withColumn("__n", F.row_number().over(w)).where((F.col("__sum") <= budget) | (F.col("__n") == 1)).drop("__sum", "__n")
