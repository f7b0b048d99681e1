"""Run queries against their SQL twins: ``python tests/check.py [names...]``."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as entry  # noqa: E402
from factledger.session import local_session  # noqa: E402
from twin import compare, duck  # noqa: E402


def main(names, sf_dir):
    spark = local_session("check")
    con = duck(sf_dir)
    sql = entry.oracle_sql()
    for name, run in entry.queries().items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            if name in sql:
                problems = compare(df, con, sql[name])
                label = "ok" if not problems else "DIFF"
            else:
                problems, label = [], f"rows-only {df.count()}"
        except Exception as exc:  # noqa: BLE001 - report and go on to the next query
            problems, label = [f"{type(exc).__name__}: {str(exc)[:1500]}"], "ERROR"
        print(f"{name:28s} {label} {time.time() - start:.1f}s", flush=True)
        for problem in problems:
            print("   ", problem[:1800], flush=True)


if __name__ == "__main__":
    main(sys.argv[1:], os.environ.get("SF_DIR", "/root/testdata/sf0.01"))
