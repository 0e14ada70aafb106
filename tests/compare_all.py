"""Compare every query with its SQL: python tests/compare_all.py [folder] [name part …]"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gridsight.session import local_session  # noqa: E402
from gridsight.queries import QUERIES, SQL  # noqa: E402
from tests.oracle import compare, connect  # noqa: E402

if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    counts: dict[str, int] = {}
    for name, function in QUERIES.items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            if name in SQL:
                verdict, note = compare(function(spark, folder), con, SQL[name])
            else:
                verdict, note = "rows", f"{len(function(spark, folder).collect())} rows"
        except Exception as error:  # noqa: BLE001
            verdict, note = "fail", f"{type(error).__name__}: {str(error)[:600]}"
        counts[verdict] = counts.get(verdict, 0) + 1
        print(f"{verdict:5} {time.time() - start:6.2f}s {name:28} {note[:700]}", flush=True)
    print(counts)
