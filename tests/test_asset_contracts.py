"""Event totals of the vaults that hold an asset, and of the contracts whose state carries its code."""

import __spark_entry__ as E
from own_tables import KINDS, write_tables


def test_every_vault_that_holds_the_asset_is_counted(spark, tmp_path):
    """Vaults of nations in region 0 hold USDC: 0, 5, 10, 15 and 20; the code's own contract is CA0."""
    folder = write_tables(spark, tmp_path)
    q = E.queries()
    want = {}
    for i in range(600):
        kind, vault = KINDS[i % 5], (i // 2) % 25
        on_vault = kind in ("purchase", "error", "view") or kind == "signup" and i % 18 < 10
        if i % 53 and on_vault and vault % 5 == 0:
            want.setdefault(f"CV{vault:04d}", []).append(i // 2)
    got = {r["contract_id"]: (r["num_events"], r["num_transactions"]) for r in q["asset_contract_events"](spark, folder).collect()}
    assert got == {k: (len(v), len(set(v))) for k, v in want.items()} and len(got) == 5
    assert {r["contract_id"] for r in q["asset_code_events"](spark, folder).collect()} <= {"CA0"}
