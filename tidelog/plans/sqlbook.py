"""Named, parameterised SQL: books of queries, run by Spark SQL."""

from __future__ import annotations

import re
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAME = re.compile(r"^\s*--\s*name:\s*(\S+)\s*$")
#: A quoted text, a comment, or a placeholder.
TOKEN = re.compile(r"('(?:[^'\\]|\\.|'')*'|\"[^\"]*\"|`[^`]*`|--[^\n]*|/\*.*?\*/)|(\?)|(?<![:\w]):(\w+)", re.S)


def parse_book(text: str) -> dict[str, str]:
    """``-- name: x`` blocks of one file."""
    book: dict[str, str] = {}
    name = None
    for line in text.splitlines():
        header = NAME.match(line)
        if header:
            name = header.group(1)
            book[name] = ""
        elif name is not None:
            book[name] += line + "\n"
    return {n: body.strip().rstrip(";").strip() for n, body in book.items()}


def load_books(folder: str) -> dict[str, str]:
    """All ``.sql`` files of a folder in name order; of equal names the last one wins."""
    book: dict[str, str] = {}
    for path in sorted(Path(folder).glob("*.sql")):
        book.update(parse_book(path.read_text(encoding="utf-8")))
    return book


def _bind(spark: SparkSession, text: str, args: tuple, named: dict[str, Any]) -> tuple[str, dict[str, Any]]:
    """Text with uniquely named markers, and their values; lists open up inside ``IN``."""
    values: dict[str, Any] = {}
    rest = list(args)
    used: set[str] = set()

    def marker(value: Any) -> str:
        if isinstance(value, (list, tuple, set)):
            items = list(value)
            if not items:
                raise ValueError("an empty list cannot be bound")
            return ", ".join(marker(v) for v in items)
        name = f"p{len(values)}"
        values[name] = value
        return f":{name}"

    def swap(match: re.Match) -> str:
        if match.group(1) is not None:
            return match.group(1)
        if match.group(2) is not None:
            if not rest:
                raise ValueError("too few arguments")
            return marker(rest.pop(0))
        key = match.group(3)
        if key not in named:
            raise ValueError(f"no value for :{key}")
        used.add(key)
        return marker(named[key])

    bound = TOKEN.sub(swap, text)
    if rest:
        raise ValueError("too many arguments")
    return bound, values


def named_query(spark: SparkSession, book: dict[str, str], name: str, *args: Any, **named: Any) -> DataFrame:
    """Run the text called ``name`` with ``?`` or ``:name`` parameters."""
    if name not in book:
        raise KeyError(f"no query called {name}")
    text, values = _bind(spark, book[name], args, named)
    return spark.sql(text, args=values) if values else spark.sql(text)


def fetch_as(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows in a declared shape, strictly: the column sets must be equal."""
    have, want = set(df.columns), set(schema.names)
    if have != want:
        raise ValueError(f"missing columns {sorted(want - have)}, extra columns {sorted(have - want)}")
    return df.to(schema)


def execute(spark: SparkSession, book: dict[str, str], name: str, *args: Any, **named: Any) -> None:
    """Run DDL or DML by name; Spark runs such statements at once."""
    named_query(spark, book, name, *args, **named)


def execute_batch(rows: DataFrame, table: str) -> None:
    """Insert many rows; columns are matched by name, and written by executors."""
    target = rows.sparkSession.table(table)
    fields = {f.name: f.dataType for f in target.schema.fields}
    if set(rows.columns) != set(fields):
        raise ValueError(f"columns of {table} are {sorted(fields)}, not {sorted(rows.columns)}")
    shaped = rows.select(*[F.col(n).cast(t).alias(n) for n, t in fields.items()])
    shaped.write.insertInto(table)
