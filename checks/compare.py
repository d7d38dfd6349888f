"""Compare the rows of a Spark result with those of its SQL on DuckDB."""

from __future__ import annotations

import duckdb

from shelfgrade.plans.views import TABLES


def rows_of(table):
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    return names, sorted(zip(*columns), key=repr) if columns else []


def engine(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def compare(con, name, df, sql):
    """Returns a complaint or an empty text, and the number of rows."""
    got = df.toArrow()
    if sql is None:
        return "", got.num_rows
    want = con.execute(sql).to_arrow_table()
    gn, g = rows_of(got)
    wn, w = rows_of(want)
    if gn != wn:
        return f"columns {gn} <> {wn}", len(g)
    kinds = lambda t: {f.name: str(f.type).replace("large_", "").replace("decimal128", "decimal") for f in t.schema}
    a, b = kinds(got), kinds(want)
    differing = {n: (a[n], b[n]) for n in gn if a[n] != b[n] and not a[n].startswith(("timestamp", "list", "map", "struct"))}
    complaint = f"types {differing} " if differing else ""
    if len(g) != len(w):
        return complaint + f"rows {len(g)} <> {len(w)}", len(g)
    if g != w:
        bad = [(x, y) for x, y in zip(g, w) if x != y]
        return complaint + f"{len(bad)} rows differ, first {dict(zip(gn, bad[0][0]))} <> {dict(zip(gn, bad[0][1]))}"[:900], len(g)
    return complaint, len(g)
