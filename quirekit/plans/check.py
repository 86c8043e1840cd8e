"""Compare registered queries with their SQL on the same parquet files.

    python -m quirekit.plans.check /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

from quirekit.session import build_session

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]

    def cell(value):
        if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and value != value):
            return None
        if isinstance(value, float):
            return round(value, 9)
        return value.item() if hasattr(value, "item") else value

    rows = [tuple(cell(v) for v in row) for row in frame.itertuples(index=False, name=None)]
    return sorted(rows, key=repr)


def _trim(a, b):
    """Shorten two differing rows to the part around the first difference."""
    a, b = repr(a), repr(b)
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), 0)
    return a[:40] + " ... " + a[max(0, at - 60):at + 200], b[:40] + " ... " + b[max(0, at - 60):at + 200]


def compare(spark, con, sf_dir: str, name: str) -> str:
    from quirekit.plans import load_all

    queries, oracles = load_all()
    start = time.time()
    got = queries[name](spark, sf_dir)
    columns = sorted(got.columns)
    left = canonical(got.toPandas())
    took = time.time() - start
    if name not in oracles:
        return f"rows {len(left):6d} {took:6.2f}s {name} (no SQL)"
    start = time.time()
    expected = con.execute(oracles[name]).df()
    sql_took = time.time() - start
    if sorted(expected.columns) != columns:
        return f"FAIL columns {columns} vs {sorted(expected.columns)} {name}"
    right = canonical(expected)
    if left == right:
        return f"ok   {len(left):6d} {took:6.2f}s sql {sql_took:6.2f}s {name}"
    only_left, only_right = sorted(set(left) - set(right), key=repr), sorted(set(right) - set(left), key=repr)
    bad = list(zip(only_left or [None] * len(only_right), only_right or [None] * len(only_left)))
    sample = "\n".join(f"   spark {a!r:.700}\n   sql   {b!r:.700}" for a, b in (_trim(*pair) for pair in bad[:3]))
    return f"FAIL {name}: {len(left)} vs {len(right)} rows, {len(bad)} differ {columns}\n{sample}"


def main(argv: list[str]) -> int:
    from quirekit.plans import load_all

    sf_dir, wanted = argv[0], argv[1:]
    queries, _ = load_all()
    names = [n for n in queries if not wanted or any(n.startswith(w) for w in wanted)]
    spark = build_session("quirekit-check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name in names:
        try:
            line = compare(spark, con, sf_dir, name)
        except Exception as error:  # report and go on with the next query
            line = f"FAIL {name}: {type(error).__name__} {str(error)[:900]}"
        failed += line.startswith("FAIL")
        print(line, flush=True)
    print(f"{len(names)} queries, {failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
