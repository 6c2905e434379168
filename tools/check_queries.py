"""Run registered queries at one scale and compare each with its SQL: check_queries.py DIR [NAME ...]"""

from __future__ import annotations

import os
import sys
import time
import traceback

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from compare import connect, differences  # noqa: E402

from marketlens.plans.catalogue import all_oracles, all_queries  # noqa: E402
from marketlens.session import build_session  # noqa: E402


def main() -> None:
    directory, names = sys.argv[1], sys.argv[2:]
    spark = build_session("check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = all_queries(), all_oracles()
    connection = connect(directory)
    failed = 0
    for name in names or queries:
        start = time.time()
        try:
            frame = queries[name](spark, directory)
            found = differences(frame, connection, oracles[name]) if name in oracles else [f"no SQL, {frame.count()} rows"]
        except Exception as error:
            found = [f"{type(error).__name__}: {str(error)[:600]}"]
            if names:
                traceback.print_exc()
        failed += bool(found and found != ["EMPTY"])
        print(f"{time.time() - start:6.2f}s  {name:34s} {'ok' if not found else found}", flush=True)
    print(f"{failed} failed")


main()
