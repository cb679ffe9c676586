"""Command line: compare registered queries with their SQL, all or by name part."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle import compare, connect

from merchantry.plans.registry import oracle_sql, queries
from merchantry.session import local_session

folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
spark = local_session("8")
con = connect(folder)
sql = oracle_sql()
bad = 0
for name, run in queries().items():
    if len(sys.argv) > 1 and not any(part in name for part in sys.argv[1:]):
        continue
    start = time.time()
    try:
        if name in sql:
            problem = compare(run(spark, folder), con, sql[name])
        else:
            rows = run(spark, folder).count()
            problem = "" if rows else "no rows"
    except Exception as error:
        problem = f"{type(error).__name__}: {str(error)[:1500]}"
    bad += bool(problem)
    print(f"{'BAD' if problem else 'ok '} {name:38s} {time.time() - start:6.2f}s {'' if name in sql else '(rows only)'} {problem}", flush=True)
print("bad:", bad)
