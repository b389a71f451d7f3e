"""Compare Spark results with the SQL oracle, ignoring row order."""

from __future__ import annotations

import glob
import os
from typing import Any


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for path in sorted(glob.glob(os.path.join(sf_dir, "*.parquet"))):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(v: Any) -> Any:
    if isinstance(v, float):
        if v != v:
            return "NaN"
        return repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(str(_cell(x)) for x in v) + "]"
    return repr(v)


def table(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def kinds(types: list[str]) -> list[str]:
    names = {"bigint": "int", "long": "int", "hugeint": "huge", "integer": "int32", "int": "int32", "double": "float",
             "string": "text", "varchar": "text", "boolean": "bool", "decimal": "decimal"}
    return [names.get(t.lower().split("(")[0], t.lower()) for t in types]


def differences(spark_df, con, sql: str) -> tuple[int, int, list[str]]:
    """(spark rows, oracle rows, messages); no messages means equal."""
    s_cols, s_rows = table(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    d_types = dict(zip(names, kinds([str(d[1]) for d in res.description])))
    d_cols, d_rows = table(names, res.fetchall())
    out = []
    if s_cols != d_cols:
        return len(s_rows), len(d_rows), [f"columns {sorted(set(s_cols) ^ set(d_cols))}"]
    s_types = dict(zip(spark_df.columns, kinds([t for _, t in spark_df.dtypes])))
    out += [f"type of {c}: {s_types[c]} / {d_types[c]}" for c in s_cols
            if s_types[c] != d_types[c] and not s_types[c].startswith("array")]
    if len(s_rows) != len(d_rows):
        out.append(f"rows {len(s_rows)} / {len(d_rows)}")
    bad = [(a, b) for a, b in zip(s_rows, d_rows) if a != b]
    if bad:
        out.append(f"{len(bad)} rows differ, first {s_cols}\n   spark  {bad[0][0]}\n   oracle {bad[0][1]}")
    return len(s_rows), len(d_rows), out
