"""Run registered queries next to their SQL twins and compare the rows.

    python tools/check_oracle.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import importlib
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from dossier.plans import ENTRIES, load_all  # noqa: E402
from dossier.session import local_session  # noqa: E402
from dossier.sources.tables import SCHEMAS  # noqa: E402


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in SCHEMAS:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def canon(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value + 0.0)
    return repr(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(canon(r[i]) for i in order) for r in rows)


def compare(spark, con, folder, entry):
    started = time.time()
    frame = entry.run(spark, folder)
    got_cols, got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    spent = time.time() - started
    if entry.sql is None:
        return True, f"{len(got)} rows, no SQL twin, {spent:.1f}s"
    started = time.time()
    cur = con.execute(entry.sql)
    want_cols, want = rows_of([c[0] for c in cur.description], cur.fetchall())
    sql_spent = time.time() - started
    if got_cols != want_cols:
        return False, f"columns {got_cols} != {want_cols}"
    if got != want:
        extra = [r for r in got if r not in set(want)][:3]
        missing = [r for r in want if r not in set(got)][:3]
        return False, f"rows {len(got)} vs {len(want)}; only spark {extra}; only sql {missing}"
    return True, f"{len(got)} rows, spark {spent:.1f}s, sql {sql_spent:.1f}s"


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("--module", default=None, help="load only this plan module")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    if args.module:
        for part in args.module.split(","):
            importlib.import_module(f"dossier.plans.{part}")
    else:
        load_all()
    folder = f"/root/testdata/sf{args.sf}"
    spark = local_session()
    con = connect(folder)
    failed = 0
    for name, entry in list(ENTRIES.items()):
        if args.names and name not in args.names:
            continue
        try:
            good, note = compare(spark, con, folder, entry)
        except Exception as error:  # noqa: BLE001
            good, note = False, "".join(traceback.format_exception_only(error))[:900]
        failed += not good
        print(f"{'ok  ' if good else 'FAIL'} {name} [{entry.row}]: {note}", flush=True)
    print("failed", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
