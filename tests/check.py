"""Compare registered queries with their SQL twins: ``python tests/check.py [-s SF] [name ...]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canon(value):
    if value is None or value is pd.NaT:
        return None
    if isinstance(value, float):
        return None if value != value else round(value, 6) + 0.0
    if hasattr(value, "tolist") and not isinstance(value, (str, bytes)):
        return canon(value.tolist())
    if isinstance(value, (list, tuple)):
        return tuple(canon(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, canon(v)) for k, v in value.items()))
    if hasattr(value, "isoformat"):
        return pd.Timestamp(value).tz_localize(None).isoformat() if getattr(value, "tzinfo", None) is None else value.isoformat()
    if type(value).__name__ == "Decimal":
        return round(float(value), 6) + 0.0
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(canon(r[i]) for i in order) for r in rows), key=lambda t: tuple((v is None, str(type(v)), str(v)) for v in t)
    )


def compare(df, con, sql):
    """None when equal, else a short account of the difference."""
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; spark {got[:2]} sql {want[:2]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)}/{len(got)} rows differ, e.g. {sorted(names)} spark {bad[0][0]} sql {bad[0][1]}"
    return None


if __name__ == "__main__":
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    import __spark_entry__ as entry
    from tidegauge.core.session import get_session

    args = sys.argv[1:]
    sf = "0.01"
    if args[:1] == ["-s"]:
        sf, args = args[1], args[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    extra = {"spark.tidegauge.scan.bucketRows": args.pop(1)} if args[:1] == ["-b"] else {}
    args = args[1:] if extra else args
    spark = get_session(master="local[8]", **extra, **{"spark.sql.shuffle.partitions": os.environ.get("CHECK_PARTITIONS", "8"), "spark.ui.enabled": "false",
                        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    qs, sqls = entry.queries(), entry.oracle_sql()
    names = [n for n in qs if not args or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in args)]
    ok = 0
    for n in names:
        t = time.time()
        try:
            df = qs[n](spark, sf_dir)
            if n in sqls:
                res = compare(df, con, sqls[n])
            else:
                res = None if df.count() > 0 else "no rows"
        except Exception as e:  # report and go on
            res = f"{type(e).__name__}: {str(e)[:700]}"
        ok += res is None
        print(f"{'ok  ' if res is None else 'FAIL'} {n} {time.time() - t:.1f}s {'' if n in sqls else '(rows only)'} {res or ''}", flush=True)
    print(f"{ok}/{len(names)}")
