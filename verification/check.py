"""Compare every query with its SQL on one scale factor: ``python -m verification.check <dir> [names]``."""

from __future__ import annotations

import sys
import time

import duckdb

from seamline.session import local_session
from verification.oracle import oracle_sql
from verification.queries import queries

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def expected(sf_dir: str, sql: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con.sql(sql).df()


def differences(got, want) -> str:
    """Empty if the two pandas frames hold the same rows, else what differs."""
    columns = sorted(got.columns)
    if columns != sorted(want.columns):
        return f"columns {columns} and {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}"
    types = [(c, str(got[c].dtype), str(want[c].dtype)) for c in columns]
    sort = lambda d: sorted(d[columns].astype(object).where(d[columns].notna(), None)
                            .itertuples(index=False, name=None), key=repr)
    bad = [(g, w) for g, w in zip(sort(got), sort(want)) if repr(g) != repr(w)]
    if bad:
        return f"{len(bad)} rows differ, first {bad[0]}"
    mixed = [t for t in types if t[1] != t[2] and "object" not in t[1] + t[2] and "str" not in t[1] + t[2]]
    return f"types {mixed}" if mixed else ""


def main() -> int:
    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = local_session(8)
    oracle, failed = oracle_sql(), 0
    for name, query in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        got = query(spark, sf_dir).toPandas()
        seconds = time.time() - start
        spark.catalog.clearCache()
        problem = differences(got, expected(sf_dir, oracle[name]))
        failed += bool(problem)
        print(f"{name:20s} {len(got):8d} rows {seconds:6.1f} s  {problem or 'ok'}"[:600], flush=True)
    return failed


if __name__ == "__main__":
    raise SystemExit(main())
