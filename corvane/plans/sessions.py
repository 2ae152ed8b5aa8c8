"""Session queries: events as a session log."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import sessions as ss
from corvane.plans.fixtures import read
from corvane.plans.registry import query

_LOG = """e AS (SELECT event_id, user_id % 50 AS session_id, epoch_us(ts) AS ts, 'm' || (event_id % 400) AS message_id,
    CASE event_id % 7 WHEN 0 THEN 'step' WHEN 1 THEN 'tool' WHEN 2 THEN 'tool' WHEN 3 THEN 'rag.context' ELSE 'message' END AS event,
    CASE WHEN event_id % 3 = 0 THEN 'user' ELSE 'assistant' END AS role, CASE event_id % 4 WHEN 0 THEN 'read' WHEN 1 THEN 'search_semantic' WHEN 2 THEN 'bash' ELSE 'find_usages' END AS tool,
    event_type AS model, event_id % 997 AS input, event_id % 101 AS output, (event_id % 13) / 8.0 AS cost, event_id % 2 = 0 AS injected, event_id % 313 AS context_tokens,
    event_id AS created, event_id + event_id % 5 * 100 AS completed FROM events)"""


def _log(spark, sf_dir):
    i = F.col("event_id")
    pick = lambda n, values, other: F.coalesce(*[F.when(i % n == k, F.lit(v)) for k, v in values.items()], F.lit(other))
    return read(spark, sf_dir, "events").select(
        i, (F.col("user_id") % 50).alias("session_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.concat(F.lit("m"), (i % 400).cast("string")).alias("message_id"),
        pick(7, {0: "step", 1: "tool", 2: "tool", 3: "rag.context"}, "message").alias("event"), F.when(i % 3 == 0, "user").otherwise("assistant").alias("role"),
        pick(4, {0: "read", 1: "search_semantic", 2: "bash"}, "find_usages").alias("tool"), F.col("event_type").alias("model"), (i % 997).alias("input"), (i % 101).alias("output"),
        ((i % 13) / 8.0).alias("cost"), (i % 2 == 0).alias("injected"), (i % 313).alias("context_tokens"), i.alias("created"), (i + i % 5 * 100).alias("completed"),
    )


_SAID = "event = 'message' AND role = 'assistant'"
_SUMMARY = f"""SELECT session_id, min(ts) AS started_at, max(ts) AS last_event_at, count(*) FILTER ({_SAID}) AS messages, coalesce(sum(input) FILTER ({_SAID}), 0)::BIGINT AS input,
    coalesce(sum(output) FILTER ({_SAID}), 0)::BIGINT AS output, round(coalesce(sum(cost) FILTER ({_SAID}), 0), 6)::DOUBLE AS cost, count(*) FILTER (event = 'step') AS steps, count(*) FILTER (event = 'tool') AS tools,
    count(*) FILTER (event = 'tool' AND tool <> 'bash') AS rag_tools, count(*) FILTER (event = 'rag.context' AND injected) AS contexts, coalesce(sum(context_tokens) FILTER (event = 'rag.context'), 0)::BIGINT AS context_tokens,
    count(DISTINCT model) FILTER ({_SAID}) AS models, floor(avg(completed - created) FILTER ({_SAID} AND completed > created) + 0.5)::BIGINT AS avg_response FROM e GROUP BY session_id"""


@query(f"WITH {_LOG} {_SUMMARY}")
def a7_a8_session_summary(spark, sf_dir):
    return ss.summary(_log(spark, sf_dir))


_MSG = f"""m AS (SELECT session_id, message_id, arg_min(input, (ts, event_id)) FILTER ({_SAID}) AS input, arg_min(output, (ts, event_id)) FILTER ({_SAID}) AS output, arg_min(cost, (ts, event_id)) FILTER ({_SAID}) AS cost,
    coalesce(arg_max(context_tokens, (ts, event_id)) FILTER (event = 'rag.context'), 0) AS context_tokens, count(*) FILTER (event = 'tool' AND tool = 'read') AS reads,
    count(*) FILTER (event = 'tool' AND tool IN ('search_semantic', 'find_usages')) AS searches FROM e GROUP BY ALL HAVING count(*) FILTER ({_SAID}) > 0)"""


@query(f"WITH {_LOG}, {_MSG} SELECT session_id, message_id, input, output, cost::DOUBLE AS cost, context_tokens, reads, searches FROM m")
def j14_a9_message_breakdown(spark, sf_dir):
    return ss.message_breakdown(_log(spark, sf_dir))


@query(
    f"""WITH {_LOG}, {_MSG}, s AS ({_SUMMARY}), t AS (SELECT session_id, sum(reads) AS reads, sum(searches) AS searches, sum(context_tokens) AS ctx FROM m GROUP BY 1),
    x AS (SELECT s.session_id, input, input - ctx - CASE WHEN contexts > 0 THEN 150 * messages ELSE 0 END + greatest(0, 2.5 - reads::DOUBLE / messages) * 1200 * messages + searches * 800 AS without FROM s JOIN t USING (session_id))
    SELECT session_id, floor(without + 0.5)::BIGINT AS without_rag, floor(without - input + 0.5)::BIGINT AS net, CASE WHEN without > 0 THEN floor(1000 * (without - input) / without + 0.5) / 10 ELSE 0 END AS pct FROM x"""
)
def a9_a11_token_savings(spark, sf_dir):
    log = _log(spark, sf_dir)
    t = ss.message_breakdown(log).groupBy("session_id").agg(F.sum("reads").alias("reads"), F.sum("searches").alias("searches"), F.sum("context_tokens").alias("context_tokens"))
    s = ss.summary(log).select("session_id", "messages", "input", "contexts")
    return ss.savings(s.join(t, "session_id")).select("session_id", "without_rag", "net", "pct")


@query(f"WITH {_LOG}, s AS ({_SUMMARY}), a AS (SELECT session_id % 25 AS k, sum(input) AS i, sum(messages) AS n FROM s WHERE session_id < 25 GROUP BY 1), b AS (SELECT session_id % 30 AS k, sum(input) AS i, sum(messages) AS n FROM s WHERE session_id >= 25 GROUP BY 1) SELECT coalesce(a.k, b.k) AS k, (coalesce(b.i, 0) - coalesce(a.i, 0))::BIGINT AS d_input, (coalesce(b.n, 0) - coalesce(a.n, 0))::BIGINT AS d_messages FROM a FULL JOIN b ON a.k = b.k")
def j13_a10_compare_sessions(spark, sf_dir):
    s = ss.summary(_log(spark, sf_dir))
    fold = lambda part, n: part.groupBy((F.col("session_id") % n).alias("k")).agg(F.sum("input").alias("input"), F.sum("messages").alias("messages"))
    return ss.compare(fold(s.where("session_id < 25"), 25), fold(s.where("session_id >= 25"), 30), "k", ["input", "messages"])


@query(f"WITH {_LOG} SELECT session_id, tool, count(*) AS calls FROM e WHERE event = 'tool' GROUP BY ALL")
def f29_tool_counts(spark, sf_dir):
    return ss.tool_counts(_log(spark, sf_dir)).select("session_id", F.explode("counts").alias("tool", "calls"))


@query("WITH t AS (SELECT conv_id, turn, ceil(length(text) / 4.0) + 12 AS n FROM conversations), s AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS total, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM t) SELECT conv_id, turn FROM s WHERE total <= 200 OR rn = 1")
def t9_token_budget(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    return ss.within_budget(c, "conv_id", [F.col("turn")], F.ceil(F.length("text") / 4) + 12, 200).select("conv_id", "turn")
