"""The versioned store against a server that runs its statements in DuckDB."""

from __future__ import annotations

import json
import re
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

import duckdb
import pytest

from corvane.sources import versioned

ROWS = "/root/testdata/sf0.001/documents.parquet"


@pytest.fixture(scope="module")
def server():
    """Every document twice, the newer version without every ninth; a second epoch of a few."""
    con = duckdb.connect()
    con.execute(f"""CREATE TABLE v AS
        SELECT doc_id, 'old' AS text, lang, source, n_chars, 1 AS epoch, 1 AS ver, false AS gone FROM '{ROWS}'
        UNION ALL SELECT doc_id, text, lang, source, n_chars, 1, 2, doc_id % 9 = 0 FROM '{ROWS}'
        UNION ALL SELECT doc_id, 'next', lang, source, n_chars, 2, 1, false FROM '{ROWS}' WHERE doc_id < 5""")
    con.execute("CREATE VIEW chunks AS SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY doc_id, epoch ORDER BY ver DESC) = 1 AND NOT gone")
    con.execute("""CREATE TABLE state AS SELECT 'meta' AS name, '{"activeEpoch": 1}' AS data""")
    con.execute("CREATE MACRO cityHash64(x) AS hash(x)")
    con.execute("CREATE MACRO startsWith(a, b) AS starts_with(a, b)")
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            text = self.rfile.read(int(self.headers["Content-Length"])).decode()
            params = {k.removeprefix("param_"): v[0] for k, v in parse_qs(urlsplit(self.path).query).items() if k.startswith("param_")}
            asked.append((text, params, self.headers.get("X-ClickHouse-User")))
            sql = re.sub(r"\{(p\d+):(\w+)\}", lambda m: f"CAST(${m[1]} AS {dict(String='VARCHAR', Int64='BIGINT', Bool='BOOLEAN')[m[2]]})", text)
            sql = sql.replace(" FINAL", "").replace("`main`.", "").replace("`", '"')
            cur = con.cursor().execute(sql, params)
            names = [d[0] for d in cur.description]
            body = "".join(json.dumps(dict(zip(names, r, strict=True))) + "\n" for r in cur.fetchall()).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_address[1]}/", asked, con
    http.shutdown()


def scan(spark, url, kind="doc_id long, text string, lang string, source string, n_chars long", **more):
    versioned.register(spark)
    options = {"url": url, "database": "main", "table": "chunks", "keys": "doc_id", "partitions": 3, "user": "reader", "state": "state"} | more
    return spark.read.format(versioned.FORMAT).options(**options).schema(kind).load()


def test_rows_as_they_stand(spark, server):
    url, asked, con = server
    got = sorted(map(tuple, scan(spark, url).collect()))
    want = sorted(con.cursor().execute("SELECT doc_id, text, lang, source, n_chars FROM chunks WHERE epoch = 1").fetchall())
    assert got == want and len(got) > 100 and {a[2] for a in asked} == {"reader"}
    assert scan(spark, url, epoch=2).count() == 5


def test_filters_and_columns_reach_the_server(spark, server):
    url, asked, con = server
    asked.clear()
    df = scan(spark, url, "doc_id long, lang string, n_chars long").where("lang = 'en' AND n_chars > 200 AND doc_id % 2 = 1")
    got = sorted(map(tuple, df.collect()))
    assert got == sorted(con.cursor().execute("SELECT doc_id, lang, n_chars FROM chunks WHERE epoch = 1 AND lang = 'en' AND n_chars > 200 AND doc_id % 2 = 1").fetchall())
    scans = [(t, p) for t, p, _ in asked if "chunks" in t]
    assert len(scans) == 3
    for text, params in scans:
        assert text.startswith("SELECT `doc_id`, `lang`, `n_chars` FROM") and "en" in params.values() and "200" in params.values()
        assert "'" not in text and "epoch = " in text and "cityHash64(`doc_id`) % 3" in text
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "lang" not in plan.split("RelationV2")[0] and "%" in plan  # Spark filters by what the server did not take


def test_values_are_never_part_of_a_statement(spark, server):
    url, asked, _ = server
    asked.clear()
    assert scan(spark, url).where("lang = \"x' OR 1 = 1 --\"").count() == 0
    assert scan(spark, url).where("lang IN ('en', 'de') AND startswith(source, 'src1')").count() > 0
    assert all("OR 1" not in t for t, _, _ in asked)


def test_a_failing_server_is_an_error(spark, server):
    url, _, _ = server
    with pytest.raises(Exception, match="500|Remote|closed|HTTP"):
        scan(spark, url, table="none").collect()


def test_columns_must_be_named(spark, server):
    versioned.register(spark)
    with pytest.raises(Exception, match="name the wanted columns"):
        spark.read.format(versioned.FORMAT).options(url=server[0], table="chunks").load()
