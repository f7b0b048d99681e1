"""Compare a query with its SQL twin: names, type classes, rows, values."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, bool):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, decimal.Decimal):
        return ("dec", format(value, "f"))
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def kind(field_type: str) -> str:
    text = field_type.lower()
    for prefix, name in (
        ("bigint", "long"), ("int64", "long"), ("hugeint", "hugeint"), ("integer", "int"), ("int", "int"), ("varchar", "string"),
        ("double", "double"), ("boolean", "boolean"), ("timestamp", "timestamp"), ("date", "date"), ("decimal", "decimal"),
    ):
        if text.startswith(prefix):
            return name
    return text


def compare(df, con, sql: str) -> list[str]:
    """Differences between a DataFrame and a SQL result; empty when equal."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    types = dict(zip(names, [kind(str(d[1])) for d in result.description]))
    expected = result.fetchall()
    problems = []
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    for field in df.schema.fields:
        spark_kind = kind(field.dataType.simpleString())
        if spark_kind != types[field.name]:
            problems.append(f"type {field.name}: {spark_kind} != {types[field.name]}")
    order = sorted(names)
    left = [tuple(plain(row[c]) for c in order) for row in df.collect()]
    where = [names.index(c) for c in order]
    right = [tuple(plain(row[i]) for i in where) for row in expected]
    if len(left) != len(right):
        problems.append(f"rows {len(left)} != {len(right)}")
    left.sort(key=repr)
    right.sort(key=repr)
    if left != right:
        only_left = list(set(left) - set(right))[:3]
        only_right = list(set(right) - set(left))[:3]
        problems.append(f"values {order}\n   spark {only_left}\n   sql   {only_right}")
    return problems
