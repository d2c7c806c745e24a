"""Run registered queries against the oracle: python tests/check_oracle.py SF [key ...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from raresight.session import get_session
from tests.compare import differences, oracle_connection
from workload.registry import registry

if __name__ == "__main__":
    sf = f"/root/testdata/{sys.argv[1]}"
    reg = registry()
    keys = sys.argv[2:] or list(reg)
    if keys[0].startswith("@"):
        import importlib

        keys = [k for m in keys for k in importlib.import_module(f"workload.{m[1:]}").QUERIES]
    spark, con = get_session(cores=8), oracle_connection(sf)
    failed = 0
    for k in keys:
        fn, sql = reg[k]
        t = time.time()
        try:
            got = fn(spark, sf).toPandas()
            spent = time.time() - t
            note = differences(got, con.execute(sql).df()) if sql else ""
        except Exception as e:  # report and go on
            spent, note, got = time.time() - t, f"{type(e).__name__}: {str(e)[:600]}", ()
        failed += bool(note)
        print(f"\n{'FAIL' if note else 'ok  '} {k:28s} {spent:6.2f}s rows={len(got)} {'' if sql else '(rows only)'} {note}", flush=True)
    print("\nfailed:", failed)
