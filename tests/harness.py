"""Run registered queries against their SQL in DuckDB: ``python -m tests.harness [--sf 0.01] [name ...]``."""

from __future__ import annotations

import argparse
import os
import sys
import time
import traceback

import duckdb

DATA = "/root/testdata"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value: object) -> str:
    return repr(value)


def table(columns: list[str], rows: list[tuple], ordered: bool = False) -> tuple[list[str], list[tuple]]:
    """Rows with columns in name order, as texts, sorted unless their order counts."""
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    texts = [tuple(plain(r[i]) for i in at) for r in rows]
    return [columns[i] for i in at], texts if ordered else sorted(texts)


def spark_table(df, ordered: bool = False) -> tuple[list[str], list[tuple]]:
    return table(df.columns, [tuple(r) for r in df.collect()], ordered)


def sql_table(con, sql: str, ordered: bool = False) -> tuple[list[str], list[tuple]]:
    result = con.execute(sql)
    return table([d[0] for d in result.description], result.fetchall(), ordered)


def difference(got, want) -> str | None:
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        extra = set(got[1]) - set(want[1])
        missing = set(want[1]) - set(got[1])
        return f"rows {len(got[1])} != {len(want[1])}; extra {sorted(extra)[:2]} missing {sorted(missing)[:2]}"
    for g, w in zip(got[1], want[1]):
        if g != w:
            return f"first difference\n   got  {str(g)[:600]}\n   want {str(w)[:600]}"
    return None


def session():
    from gleaner.session import build_session

    spark = build_session(
        "gleaner-check", f"local[{os.cpu_count() or 8}]", spark__sql__shuffle__partitions="8",
        spark__driver__memory="8g", spark__ui__enabled="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> int:
    from gleaner.queries import load_all

    args = argparse.ArgumentParser()
    args.add_argument("--sf", default="0.01")
    args.add_argument("--part", default=None)
    args.add_argument("names", nargs="*")
    opts = args.parse_args()
    folder = f"{DATA}/sf{opts.sf}"
    spark, con = session(), connect(folder)
    registry = load_all()
    names = opts.names or list(registry)
    bad = 0
    for name in names:
        q, start = registry[name], time.time()
        try:
            got = spark_table(q.run(spark, folder), q.ordered)
            took = time.time() - start
            problem = difference(got, sql_table(con, q.sql, q.ordered)) if q.sql else None
            if not problem and not got[1]:
                problem = "no rows"
        except Exception as error:  # report and go on with the next query
            took, problem, got = time.time() - start, f"{type(error).__name__}: {str(error)[:1500]}", None
            if "-v" in os.environ.get("HARNESS", ""):
                traceback.print_exc()
        bad += problem is not None
        rows = len(got[1]) if got else 0
        print(f"{'FAIL' if problem else 'ok  ' if q.sql else 'rows'} {name} rows={rows} {took:.2f}s {problem or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} pass")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
