"""Command line: compare all (or the named) queries with their SQL on a folder.

    python tests/check_all.py [--sf /root/testdata/sf0.01] [name ...]
"""

from __future__ import annotations

import argparse
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from compare import difference, duck  # noqa: E402

from glossaline.session import local_session  # noqa: E402
from glossaline.workloads import ORACLES, QUERIES  # noqa: E402


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("--trace", action="store_true")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = local_session("8")
    con = duck(args.sf)
    bad = 0
    for name, fn in QUERIES.items():
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        start = time.time()
        try:
            if name in ORACLES:
                result = difference(spark, con, fn, ORACLES[name], args.sf)
            else:
                result = None if fn(spark, args.sf).count() > 0 else "no rows"
        except Exception as exc:
            result = f"{type(exc).__name__}: {str(exc)[:600]}"
            if args.trace:
                traceback.print_exc()
        bad += result is not None
        kind = "sql" if name in ORACLES else "rows"
        print(f"{'ok ' if result is None else 'BAD'} {kind:4} {time.time() - start:6.2f}s {name} {result or ''}"[:900], flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
