"""Print the formatted physical plan of registered queries.

    python tools/explain.py [--sf DIR] key [key ...]
"""

from __future__ import annotations

import argparse
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from fleetscope.plans.catalog import REGISTRY  # noqa: E402
from fleetscope.session import local_session  # noqa: E402


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.1")
    ap.add_argument("--mode", default="formatted")
    ap.add_argument("keys", nargs="+")
    a = ap.parse_args()
    spark = local_session()
    for k in a.keys:
        print(f"===== {k}")
        REGISTRY[k].build(spark, a.sf).explain(a.mode)


if __name__ == "__main__":
    main()
