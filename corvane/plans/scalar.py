"""Scalar functions, predicates and browsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import paths
from corvane.functions import signals as sg
from corvane.functions import text as tx
from corvane.functions import vectors as vx
from corvane.functions.signals import BLOCKED, CAUSES, SIGNALS
from corvane.plans.fixtures import CHUNKS, chunks, read, stem_sql, tokens_sql
from corvane.plans.registry import query

def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _case(rules: list[tuple[str, str]], col: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({col}, {_lit(p)}) THEN {_lit(c)}" for c, p in rules) + " END"


_MESSAGES = """m AS (SELECT event_id, CASE event_id % 12
    WHEN 0 THEN 'Error: ENOENT no such file or directory ' || event_id WHEN 1 THEN 'Request timed out after ' || event_id || ' ms'
    WHEN 2 THEN 'npm ERR! code ERESOLVE' WHEN 3 THEN 'Traceback (most recent call last)' WHEN 4 THEN 'HTTP 429   Too Many Requests'
    WHEN 5 THEN 'EACCES: permission denied' WHEN 6 THEN 'please skip the flaky tests' WHEN 7 THEN 'run git push --force now'
    WHEN 8 THEN 'Exited with code ' || (event_id % 3) WHEN 9 THEN 'Segmentation fault' WHEN 10 THEN 'disable lint in CI'
    ELSE props END AS msg FROM events)"""


def _messages(spark, sf_dir):
    e, m = F.col("event_id"), F.col("event_id") % 12
    n = e.cast("string")
    made = {
        0: F.concat(F.lit("Error: ENOENT no such file or directory "), n), 1: F.concat(F.lit("Request timed out after "), n, F.lit(" ms")),
        2: F.lit("npm ERR! code ERESOLVE"), 3: F.lit("Traceback (most recent call last)"), 4: F.lit("HTTP 429   Too Many Requests"),
        5: F.lit("EACCES: permission denied"), 6: F.lit("please skip the flaky tests"), 7: F.lit("run git push --force now"),
        8: F.concat(F.lit("Exited with code "), (e % 3).cast("string")), 9: F.lit("Segmentation fault"), 10: F.lit("disable lint in CI"),
    }
    out = F.col("props")
    for k, v in made.items():
        out = F.when(m == k, v).otherwise(out)
    return read(spark, sf_dir, "events").select("event_id", out.alias("msg"))


@query(f"WITH {tokens_sql('tok', 'documents', 'doc_id', 'text')} SELECT key AS doc_id, count(*) AS n_tokens, sha256(string_agg(token, ' ' ORDER BY token)) AS tokens_sha FROM tok GROUP BY key")
def f1_tokenize(spark, sf_dir):
    lists = tx.token_lists(read(spark, sf_dir, "documents"), "doc_id", "text", None)
    t = lists.where("dl > 0").select(F.col("id").alias("doc_id"), F.array_sort("tokens").alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", "t"), 256).alias("tokens_sha"))


@query(f"WITH w AS (SELECT DISTINCT unnest(string_split_regex(lower(text), '[^a-z]+')) AS w FROM documents) SELECT w AS word, {stem_sql('w')} AS stem FROM w WHERE w <> ''")
def f2_stem(spark, sf_dir):
    w = read(spark, sf_dir, "documents").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).where("word <> ''").distinct()
    return w.select("word", tx.stem(F.col("word")).alias("stem"))


@query(
    """WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0)
    SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 6) AS cosine, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm FROM embeddings, q"""
)
def f3_f4_vector_maths(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    q = e.where("vec_id = 0").select(F.col("embedding").alias("q"))  # one row
    return e.crossJoin(F.broadcast(q)).select("vec_id", F.round(vx.cosine(F.col("embedding"), F.col("q")), 6).alias("cosine"), F.round(vx.norm(F.col("embedding")), 6).alias("norm"))


_PATH_FACTS = r"""SELECT id,
    CASE WHEN regexp_matches(file_path, '(?i)\.(?:test|spec|bench)\.[a-z0-9]+$') OR regexp_matches(lower(file_path), '(^|/)(__tests__|test|tests|spec|specs|fixtures)(/|$)') THEN 'test'
         WHEN regexp_matches(lower(file_path), '\.(md|mdx|rst|adoc)$') OR regexp_matches(lower(file_path), '(^|/)(doc|docs|documentation)(/|$)') THEN 'doc' ELSE 'source' END AS role,
    CASE WHEN file_path LIKE '%.test.ts' THEN 'test' WHEN file_path LIKE 'docs/%' THEN 'documentation' WHEN file_path LIKE 'config/%' THEN 'configuration' ELSE 'source' END AS content_type
    FROM chunks"""


@query(f"WITH {CHUNKS} {_PATH_FACTS}")
def p11_p12_path_classes(spark, sf_dir):
    p = F.col("file_path")
    return chunks(spark, sf_dir).select("id", paths.role(p).alias("role"), paths.content_type(p).alias("content_type"))


@query(f"WITH {CHUNKS} SELECT id, file_path FROM chunks WHERE regexp_matches(file_path, '^src/([^/]*/)*[^/]*[.]ts$') AND language IN ('en', 'de') AND kind IN ('') AND lower(file_path) LIKE '%.ts'")
def p7_conjunctive_filter(spark, sf_dir):
    hold = paths.metadata_filter(F.col("file_path"), F.col("language"), F.col("kind"), ["src/**/*.ts"], ["en", "de"], [""], ["TS", ".ts"])
    return chunks(spark, sf_dir).where(hold).select("id", "file_path")


@query(f"WITH {CHUNKS} SELECT id FROM chunks WHERE file_path LIKE 'docs/%' OR file_path LIKE '%util_3%'")
def p4_glob_like(spark, sf_dir):
    return chunks(spark, sf_dir).where(paths.glob_like(F.col("file_path"), ["docs/**", "*util_3*"])).select("id")


@query(f"WITH {CHUNKS} SELECT id FROM chunks WHERE regexp_matches(file_path, '^docs/[^/]*/guide-[^/][.]md$')")
def p5_glob_regex(spark, sf_dir):
    return chunks(spark, sf_dir).where(paths.glob(F.col("file_path"), ["docs/*/guide-?.md"])).select("id")


@query(f"WITH {CHUNKS} SELECT id FROM chunks WHERE lower(file_path) LIKE '%.md' OR lower(file_path) LIKE '%.py'")
def p6_extension_filter(spark, sf_dir):
    return chunks(spark, sf_dir).where(paths.has_extension(F.col("file_path"), [" MD", "..py", "md", ""])).select("id")


@query(f"WITH {CHUNKS} SELECT id, list_contains(string_split(file_path, '/'), '__tests__') OR file_path LIKE '%.json' AS excluded, file_path LIKE 'src/%' AS included FROM chunks")
def p8_p9_exclude_include(spark, sf_dir):
    p = F.col("file_path")
    return chunks(spark, sf_dir).select("id", paths.excluded(p, ["__TESTS__"], ["*.json"]).alias("excluded"), paths.included(p, ["src"]).alias("included"))


@query("SELECT item_id, CASE WHEN length(trim(s)) <= 60 AND regexp_matches(trim(s), '^[A-Za-z_$][A-Za-z0-9_$]*([.][A-Za-z_$][A-Za-z0-9_$]*)*$') THEN 'symbol' ELSE 'natural-language' END AS shape FROM (SELECT item_id, CASE item_id % 3 WHEN 0 THEN split_part(text, ' ', 2) WHEN 1 THEN 'app.get_' || item_id ELSE text END AS s FROM benchmark)")
def p13_query_shape(spark, sf_dir):
    i = F.col("item_id")
    s = F.when(i % 3 == 0, F.split_part("text", F.lit(" "), F.lit(2))).when(i % 3 == 1, F.concat(F.lit("app.get_"), i.cast("string"))).otherwise(F.col("text"))
    return read(spark, sf_dir, "benchmark").select("item_id", paths.query_shape(s).alias("shape"))


@query(f"WITH {CHUNKS} SELECT id, count(*) OVER () AS total FROM chunks WHERE language = 'en' AND starts_with(file_path, 'src/') ORDER BY id LIMIT 25 OFFSET 10")
def p14_t7_browse_page(spark, sf_dir):
    found = chunks(spark, sf_dir).where((F.col("language") == "en") & F.col("file_path").startswith("src/"))
    total = found.agg(F.count("*").alias("total"))
    return found.orderBy("id").offset(10).limit(25).crossJoin(F.broadcast(total)).select("id", "total")  # one row


@query(f"WITH {CHUNKS} SELECT id, file_path FROM chunks WHERE id IN (3, 5, 8, 13, 21)")
def p15_get_by_ids(spark, sf_dir):
    return chunks(spark, sf_dir).where(F.col("id").isin(3, 5, 8, 13, 21)).select("id", "file_path")


@query(f"WITH {CHUNKS} SELECT id FROM chunks WHERE start_line <= 120 AND end_line >= 60")
def p16_line_overlap(spark, sf_dir):
    return chunks(spark, sf_dir).where("start_line <= 120 and end_line >= 60").select("id")


@query(f"WITH {_MESSAGES} SELECT event_id, NOT ({' OR '.join(f'regexp_matches(msg, {_lit(p)})' for p in BLOCKED)}) AS allowed FROM m")
def p17_trust_filter(spark, sf_dir):
    return _messages(spark, sf_dir).select("event_id", sg.allowed(F.col("msg")).alias("allowed"))


@query(
    f"""WITH {_MESSAGES} SELECT event_id, CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 17 = 1 THEN 'exit-code'
    WHEN event_id % 5 = 0 THEN CASE WHEN regexp_matches(msg, '^Could not read file:') THEN 'path' END ELSE {_case(SIGNALS, "msg")} END AS signal FROM m"""
)
def p18_error_signal(spark, sf_dir):
    """Outputs of commands, of other tools, and of commands whose exit code is known."""
    i = F.col("event_id")
    code = F.when(i % 17 == 0, 0).when(i % 17 == 1, 2)
    tool = F.when(i % 5 == 0, "read").otherwise("Bash")
    found = sg.signal(F.concat(F.lit("\u001b[31m"), "msg"), F.lower(tool).isin(sg.COMMAND_TOOLS), code)
    return _messages(spark, sf_dir).select("event_id", found.alias("signal"))


@query(f"WITH {_MESSAGES} SELECT event_id, {_case(CAUSES, 'msg')} AS cause FROM m")
def p19_error_cause(spark, sf_dir):
    return _messages(spark, sf_dir).select("event_id", sg.cause(F.col("msg")).alias("cause"))


@query(rf"WITH {_MESSAGES} SELECT event_id, 'bash|' || left(trim(regexp_replace(regexp_replace(lower(msg), '\s+', ' ', 'g'), '\d+', '#', 'g')), 160) AS signature FROM m")
def p20_error_signature(spark, sf_dir):
    return _messages(spark, sf_dir).select("event_id", tx.error_signature(F.lit("Bash"), F.col("msg")).alias("signature"))


@query("SELECT doc_id, sha256(text) AS hash, text = '' AS is_empty, strlen(text) < 64 AS is_too_small, left(sha256(text), 16) || '_' || left(sha256(lang), 8) AS cache_key FROM documents")
def s2_f10_scan_hashes(spark, sf_dir):
    h = F.sha2("text", 256)
    return read(spark, sf_dir, "documents").select(
        "doc_id", h.alias("hash"), (F.col("text") == "").alias("is_empty"), (F.octet_length("text") < 64).alias("is_too_small"),
        F.concat(F.substring(h, 1, 16), F.lit("_"), F.substring(F.sha2("lang", 256), 1, 8)).alias("cache_key"),
    )


@query("SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens, 'lines ' || 1 || '-' || (length(text) - length(replace(text, chr(10), '')) + 1) || ', ' || lang AS description FROM documents")
def f15_f16_describe_and_count(spark, sf_dir):
    lines = F.size(F.split("text", "\n"))
    return read(spark, sf_dir, "documents").select("doc_id", tx.estimate_tokens(F.col("text")).alias("tokens"), F.format_string("lines 1-%d, %s", lines, F.col("lang")).alias("description"))


@query(r"SELECT page_id, lower(regexp_replace(regexp_replace(regexp_replace(url, '(?i)\.(md|markdown)$', ''), '/+$', ''), '^/+', '')) AS page, regexp_extract(regexp_replace(url, '/+$', ''), '([^/]*)$', 1) AS base FROM pages")
def f11_f21_page_ids(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", tx.page_id(F.col("url")).alias("page"), F.regexp_extract(F.regexp_replace("url", "/+$", ""), "([^/]*)$", 1).alias("base"))


@query("SELECT event_id, v = 1 OR (v = 0 AND d >= 0.8) AS flagged FROM (SELECT event_id, least(1, greatest(0, value / 100)) AS d, event_id % 2 AS v FROM events)")
def f26_verdict(spark, sf_dir):
    d = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("value") / 100))
    return read(spark, sf_dir, "events").select("event_id", ((F.col("event_id") % 2 == 1) | (d >= 0.8)).alias("flagged"))


@query("SELECT o_orderkey, CASE WHEN m < 60 THEN m || 'm' WHEN m < 2880 THEN (m // 60) || 'h' ELSE (m // 1440) || 'd' END AS age FROM (SELECT o_orderkey, o_orderkey * 7 AS m FROM orders)")
def m17_relative_age(spark, sf_dir):
    m = F.col("o_orderkey") * 7
    label = lambda n, unit: F.concat(F.floor(n).cast("string"), F.lit(unit))
    age = F.when(m < 60, label(m, "m")).when(m < 2880, label(m / 60, "h")).otherwise(label(m / 1440, "d"))
    return read(spark, sf_dir, "orders").select("o_orderkey", age.alias("age"))
