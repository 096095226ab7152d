"""Run every registered query against its oracle SQL: python tests/run_parity.py [sf_dir] [names...]"""

import json
import sys
import time

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
sys.path.insert(0, __file__.rsplit("/", 1)[0])

from parity import compare, duck  # noqa: E402

import __spark_entry__ as E  # noqa: E402
from eventide.session import build_session  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
names = sys.argv[2:]
import os  # noqa: E402
tz = os.environ.get("PARITY_TZ")
spark = build_session(extra={"spark.sql.session.timeZone": tz} if tz else None)
qs, sqls = E.queries(), E.oracle_sql()
con = duck(sf)
bad = 0
for name in (names or sorted(qs)):
    t = time.time()
    if name not in sqls:
        n = qs[name](spark, sf).count()
        print(f"{name:36s} rows-only {n} ({time.time()-t:.1f}s)")
        continue
    try:
        r = compare(spark, name, qs[name], sqls[name], sf, con)
    except Exception as e:  # report and continue
        bad += 1
        print(f"{name:36s} ERROR {type(e).__name__}: {str(e)[:400]}")
        continue
    ok = r["value_match"] and r["rows_match"]
    bad += not ok
    print(f"{name:36s} {'OK ' if ok else 'BAD'} rows {r['spark_rows']}/{r['oracle_rows']} ({time.time()-t:.1f}s)")
    if not ok:
        print("   ", json.dumps({k: v for k, v in r.items() if k not in ('query',)}, default=str)[:1500])
print("failures:", bad)
