"""vaultlake: vault and ledger analytics expressed as Spark DataFrame jobs.

Layers:
  sources/    ledger-shaped tables (state snapshots, contract events, transactions, prices)
  functions/  Column expressions: exact i128 decoding, payload field access, time buckets
  operators/  reusable relational building blocks (latest per key, gap filling, bounded broadcast,
              skew-tolerant lag)
  plans/      the dashboard queries and the documented analyses, one function per key
  streaming/  Structured Streaming versions of the event jobs
  oracle/     DuckDB SQL used to cross-check every key
"""

from vaultlake.config import VaultConfig
from vaultlake.sources.ledger import Ledger

__all__ = ["Ledger", "VaultConfig"]
