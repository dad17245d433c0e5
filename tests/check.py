"""``python tests/check.py [sf] [name-prefix ...]``: run queries against their SQL twins."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from compare import compare, connect

import __spark_entry__ as e
from logwarden.session import local_session

if __name__ == "__main__":
    sf = f"/root/testdata/{sys.argv[1] if len(sys.argv) > 1 else 'sf0.01'}"
    want = sys.argv[2:]
    spark, con = local_session(), connect(sf)
    sqls, bad = e.oracle_sql(), 0
    for name, q in e.queries().items():
        if want and not any(name.startswith(w) for w in want):
            continue
        t = time.time()
        try:
            if name in sqls:
                msg = compare(spark, con, q, sqls[name], sf)
            else:
                n = q(spark, sf).count()
                msg = None if n else "no rows"
                name += f" (rows {n})"
        except Exception as x:
            msg = f"{type(x).__name__}: {str(x)[:1500]}"
        bad += msg is not None
        print(f"{'ok  ' if msg is None else 'FAIL'} {name} {time.time() - t:.2f}s {msg or ''}", flush=True)
    print("failures", bad)
