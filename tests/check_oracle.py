"""Compare registered queries with their SQL: ``python -m tests.check_oracle [sf] [name ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from pagemill.session import local_session  # noqa: E402

TABLES = "documents conversations benchmark".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def normalized(frame) -> tuple[list[str], list[tuple]]:
    """Columns by name, rows in any order; whole numbers compare across widths."""
    columns = sorted(frame.columns)
    rows = frame[columns].astype(object).where(frame[columns].notna(), None).itertuples(index=False, name=None)
    return columns, sorted(rows, key=repr)


DUCK_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def compare(spark, con, sf_dir: str, name: str) -> tuple[bool, str]:
    start = time.time()
    df = queries()[name](spark, sf_dir)
    got = normalized(df.toPandas())
    spent = time.time() - start
    want = normalized(con.execute(oracle_sql()[name]).df())
    sql_spent = time.time() - start - spent
    detail = f"{len(got[1])} rows, spark {spent:.1f}s, sql {sql_spent:.1f}s"
    types = {f.name: DUCK_TYPES[f.dataType.simpleString()] for f in df.schema.fields}
    wanted = {row[0]: row[1] for row in con.execute(f"DESCRIBE {oracle_sql()[name]}").fetchall()}
    if types != wanted:
        return False, f"{detail}, types {types}, expected {wanted}"
    if got == want:
        return True, detail
    differing = [(g, w) for g, w in zip(got[1], want[1]) if g != w][:1]
    return False, f"{detail}, expected {len(want[1])} rows {want[0]} not {got[0]}; {str(differing)[:1500]}"


def main() -> None:
    sf, names = (sys.argv[1] if len(sys.argv) > 1 else "0.01"), sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = local_session(8), connect(sf_dir)
    failed = 0
    for name in names or oracle_sql():
        try:
            ok, detail = compare(spark, con, sf_dir, name)
        except Exception as error:  # noqa: BLE001 - go on to the next query
            ok, detail = False, f"{type(error).__name__}: {str(error)[:1500]}"
        failed += not ok
        print("ok  " if ok else "FAIL", name, detail, flush=True)
    print(f"{failed} failed")
    sys.exit(bool(failed))


if __name__ == "__main__":
    main()
