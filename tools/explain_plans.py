"""Print the formatted physical plans of the headline queries (or of the keys given).

usage: python tools/explain_plans.py [sf_dir] [key ...]
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    from bench import HEADLINE
    from vaultlake.plans.registry import PLANS
    from vaultlake.session import build_session
    from vaultlake.sources.ledger import Ledger

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    keys = sys.argv[2:] or HEADLINE
    spark = build_session("local[8]", shuffle_partitions=8)
    L = Ledger.shared(spark, sf_dir)
    for k in keys:
        print(f"==================== {k}")
        PLANS[k](L).explain("formatted")


if __name__ == "__main__":
    main()
