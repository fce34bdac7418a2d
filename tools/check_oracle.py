"""Run registered queries and their SQL side by side: python tools/check_oracle.py [sf_dir] [prefix ...]"""

import os
import sys
import threading
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pathgram.plans import catalogue
from pathgram.session import build_session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        if frame[c].dtype.kind in "OSU":
            frame[c] = frame[c].map(lambda v: None if v is None or v is pd.NA or (isinstance(v, float) and v != v) else v)
            frame[c] = frame[c].astype("string") if frame[c].map(lambda v: v is None or isinstance(v, str)).all() else frame[c]
    by = list(frame.columns)
    return frame.sort_values(by, key=lambda s: s.astype("string")).reset_index(drop=True)


def main() -> int:
    args = sys.argv[1:]
    sf = args[0] if args else "/root/testdata/sf0.01"
    wanted = args[1:]
    spark = build_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    bad = 0
    for name, fn in catalogue.QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            got = fn(spark, sf).toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: {str(e)[-600:]}", flush=True)
            bad += 1
            continue
        took = time.time() - start
        if name not in catalogue.ORACLES:
            print(f"rows {name}: {len(got)} rows {took:.1f}s", flush=True)
            continue
        start = time.time()
        try:
            alarm = threading.Timer(12, con.interrupt)
            alarm.start()
            want = con.sql(catalogue.ORACLES[name]).df()
            alarm.cancel()
        except Exception as e:  # noqa: BLE001
            print(f"SQL  {name}: {str(e)[:600]}", flush=True)
            bad += 1
            continue
        sql_took = time.time() - start
        a, b = canonical(got), canonical(want)
        note = ""
        if list(a.columns) != list(b.columns):
            note = f"columns {list(a.columns)} / {list(b.columns)}"
        elif len(a) != len(b):
            note = f"rows {len(a)} / {len(b)}"
        else:
            for c in a.columns:
                left, right = a[c], b[c]
                if left.dtype.kind != right.dtype.kind and {left.dtype.kind, right.dtype.kind} <= set("iufb"):
                    note += f" dtype {c} {left.dtype}/{right.dtype};"
                same = (left == right) | (left.isna() & right.isna())
                if not same.fillna(False).all():
                    k = (~same.fillna(False)).to_numpy().nonzero()[0]
                    note += f" {c}: {len(k)} differ, e.g. {left[k[0]]!r} / {right[k[0]]!r};"
        print(f"{'ok  ' if not note else 'DIFF'} {name}: {len(got)} rows {took:.1f}s sql {sql_took:.1f}s {note}", flush=True)
        bad += bool(note)
    print("problems:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
