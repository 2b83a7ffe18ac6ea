"""Time the oracle SQL of the bench queries in DuckDB (single node).

Usage: python tools/duckdb_baseline.py [sf_dir] [threads]
Prints one JSON line: median of 3 warm runs per query, in seconds.
"""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bench import HEADLINE  # noqa: E402
from eventfold.plans.oracle import ORACLE  # noqa: E402
from tools.oracle_check import duck  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
threads = int(sys.argv[2]) if len(sys.argv) > 2 else 8
con = duck(sf)
con.execute(f"SET threads TO {threads}")
out = {}
for name in HEADLINE:
    sql = ORACLE[name]
    con.execute(sql).fetchall()
    times = []
    for _ in range(3):
        t0 = time.perf_counter()
        con.execute(sql).fetchall()
        times.append(time.perf_counter() - t0)
    out[name] = round(statistics.median(times), 3)
print(json.dumps({"engine": "duckdb", "threads": threads, "sf_dir": sf,
                  "value": round(sum(out.values()), 3), "queries": out}))
