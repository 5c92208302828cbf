from vaultlake.sources.ledger import Ledger

__all__ = ["Ledger"]
