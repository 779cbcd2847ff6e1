"""Run catalogued queries next to their SQL twins in DuckDB and compare whole results.

usage: check_oracle.py SF_DIR [name-prefix ...]
"""

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from barloom.catalog import QUERIES, SQL  # noqa: E402
from barloom.session import local_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, float):
        return f"{v + 0.0:.6f}" if v else f"{0.0:.6f}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(cell(x) for x in v) + "]"
    return str(v)


def table(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def main(sf_dir, prefixes):
    spark = local_session()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    bad = []
    for name, fn in QUERIES.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf_dir)
            got = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: {str(e)[:1500]}")
            bad.append(name)
            continue
        t1 = time.time()
        if name not in SQL:
            print(f"rows {name} n={len(got)} {t1 - t0:.1f}s")
            continue
        try:
            cur = con.execute(SQL[name])
            want, cols = cur.fetchall(), [d[0] for d in cur.description]
        except Exception as e:  # noqa: BLE001
            print(f"SQLERR {name}: {str(e)[:1500]}")
            bad.append(name)
            continue
        t2 = time.time()
        if sorted(cols) != sorted(df.columns):
            print(f"COLS {name}: {sorted(cols)} vs {sorted(df.columns)}")
            bad.append(name)
            continue
        a, b = table(got, df.columns), table(want, cols)
        if a == b:
            kinds = dict(zip(cols, (str(d[1]) for d in cur.description)))
            print(f"ok   {name} n={len(got)} spark={t1 - t0:.1f}s sql={t2 - t1:.1f}s")
            del kinds
        else:
            bad.append(name)
            diff = [(x, y) for x, y in zip(a, b) if x != y]
            print(f"DIFF {name}: {len(a)} vs {len(b)} rows, {len(diff)} differ; {sorted(cols)}")
            for x, y in diff[:3]:
                print("   spark", x, "\n   sql  ", y)
    print("bad:", bad)


main(sys.argv[1], sys.argv[2:])
