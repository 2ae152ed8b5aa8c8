"""A versioned table behind a database server, read by statements over HTTP that answer JSON lines."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from urllib.parse import urlencode
from urllib.request import Request, urlopen

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

FORMAT = "versioned"
BLOCK = 4 << 20
# The server's login headers, its settings for a scan, and its types of pushed values.
LOGIN = {"X-ClickHouse-User": "user", "X-ClickHouse-Key": "password"}
SETTINGS = {"output_format_json_quote_64bit_integers": "0", "default_format": "JSONEachRow"}
TYPES = {str: "String", int: "Int64", bool: "Bool"}
COMPARED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def quoted(name: str) -> str:
    return "`" + name.replace("\\", "\\\\").replace("`", "\\`") + "`"


class Where:
    """Conditions as text with numbered parameters, so that no value is ever part of a statement."""

    def __init__(self) -> None:
        self.texts: list[str] = []
        self.params: dict[str, str] = {}

    def value(self, v: object) -> str:
        name = f"p{len(self.params)}"
        self.params[name] = str(v).lower() if isinstance(v, bool) else str(v).replace("\\", "\\\\").replace("\t", "\\t").replace("\n", "\\n")
        return f"{{{name}:{TYPES[type(v)]}}}"

    def push(self, f: Filter) -> bool:
        """Whether the server takes the filter: comparisons, lists and prefixes of text, whole numbers and truth values of plain columns."""
        column = getattr(f, "attribute", ())
        if len(column) != 1:
            return False
        name = quoted(column[0])
        if isinstance(f, IsNotNull):
            self.texts.append(f"{name} IS NOT NULL")
        elif isinstance(f, In) and f.value and all(type(v) in TYPES for v in f.value):
            self.texts.append(f"{name} IN ({', '.join(map(self.value, f.value))})")
        elif isinstance(f, StringStartsWith):
            self.texts.append(f"startsWith({name}, {self.value(f.value)})")
        elif type(f) in COMPARED and type(f.value) in TYPES:
            self.texts.append(f"{name} {COMPARED[type(f)]} {self.value(f.value)}")
        else:
            return False
        return True


class VersionedReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.options, self.schema, self.where = dict(options), schema, Where()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Filters that the server takes go into the statement; Spark applies the rest."""
        return [f for f in filters if not self.where.push(f)]

    def lines(self, statement: str, params: dict[str, str]) -> Iterator[bytes]:
        query = SETTINGS | {f"param_{k}": v for k, v in params.items()}
        head = {k: self.options[o] for k, o in LOGIN.items() if o in self.options}
        ask = Request(f"{self.options['url']}?{urlencode(query)}", statement.encode(), head)
        with urlopen(ask, timeout=float(self.options.get("timeout", "300"))) as answer:
            yield from answer

    def table(self, name: str) -> str:
        return f"{quoted(self.options.get('database', 'default'))}.{quoted(name)}"

    def epoch(self) -> int | None:
        """The given epoch, else the promoted one of the state table; None reads every epoch."""
        if "epoch" in self.options:
            return int(self.options["epoch"])
        if "state" not in self.options:
            return None
        w = Where()
        asked = f"SELECT data FROM {self.table(self.options['state'])} FINAL WHERE name = {w.value(self.options.get('name', 'meta'))} LIMIT 1"
        for line in self.lines(asked, w.params):
            return int(json.loads(json.loads(line)["data"]).get("activeEpoch", 1))
        return 1

    def partitions(self) -> list[InputPartition]:
        """The rows by a hash of the key, all of the one epoch that is active now."""
        epoch, n = self.epoch(), int(self.options.get("partitions", "16"))
        return [InputPartition((epoch, k, n)) for k in range(n)]

    def statement(self, epoch: int | None, part: int, parts: int) -> tuple[str, dict[str, str]]:
        w = Where()
        w.texts, w.params = list(self.where.texts), dict(self.where.params)
        if epoch is not None:
            w.texts.append(f"epoch = {w.value(epoch)}")
        if parts > 1:
            keys = ", ".join(map(quoted, self.options["keys"].split(",")))
            w.texts.append(f"cityHash64({keys}) % {parts} = {part}")
        wanted = ", ".join(quoted(f.name) for f in self.schema.fields)
        return f"SELECT {wanted} FROM {self.table(self.options['table'])} FINAL" + (f" WHERE {' AND '.join(w.texts)}" if w.texts else ""), w.params

    def read(self, partition: InputPartition) -> Iterator:
        import pyarrow as pa
        from pyarrow import json as pj

        how = pj.ParseOptions(explicit_schema=to_arrow_schema(self.schema), unexpected_field_behavior="ignore")

        def parsed(block: list[bytes]) -> Iterator:
            size = sum(map(len, block)) + 1
            table = pj.read_json(pa.BufferReader(b"".join(block)), pj.ReadOptions(use_threads=False, block_size=size), how)
            yield from table.select([f.name for f in self.schema.fields]).to_batches()

        block, held = [], 0
        for line in self.lines(*self.statement(*partition.value)):
            block.append(line)
            held += len(line)
            if held >= BLOCK:
                yield from parsed(block)
                block, held = [], 0
        if block:
            yield from parsed(block)


class VersionedStore(DataSource):
    """Rows as they stand in a table that keeps versions: each key's newest, deleted ones left out, of one epoch.

    Options: ``url``, ``table``, ``keys`` (comma-separated, of the table's order, by which the
    partitions are dealt), and if wanted ``database``, ``user``, ``password``, ``timeout`` in
    seconds, ``partitions`` (16), ``epoch``, or ``state`` (and ``name``), the table whose row names
    the promoted epoch. The reader's schema names the columns, and only those are asked for.
    A lost task asks again; a server that stops amid an answer is an error, not an end.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        raise ValueError("name the wanted columns: spark.read.schema(...)")

    def reader(self, schema: StructType) -> VersionedReader:
        return VersionedReader(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    """Make ``spark.read.format("versioned")`` known, and let it take filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(VersionedStore)
