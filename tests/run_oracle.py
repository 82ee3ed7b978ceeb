"""Command line check: python -m tests.run_oracle [sf] [name prefixes...]"""

import sys
import time

from tests.conftest import make_session
from tests.oracle import compare, connect

import __spark_entry__ as entry

if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    spark = make_session()
    sf_dir = f"/root/testdata/sf{sf}"
    con = connect(sf_dir)
    oracles = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t = time.time()
        try:
            if name in oracles:
                n, diff = compare(fn(spark, sf_dir), con, oracles[name])
            else:
                n, diff = fn(spark, sf_dir).count(), None
        except Exception as e:  # report and go on with the next query
            n, diff = -1, f"{type(e).__name__}: {str(e)[:700]}"
        bad += diff is not None
        print(f"{'FAIL' if diff else 'ok  '} {name} rows={n} {time.time() - t:.1f}s {diff or ''}"
              f"{'' if name in oracles else ' (no oracle)'}", flush=True)
    print("failures:", bad)
