"""Fixed values and tunable parameters.

Fixed values below must equal the on-chain identifiers, encodings and constants that the
dashboard queries depend on; they are stated plainly and kept together on purpose.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal

# ---------------------------------------------------------------------------------------------
# Fixed values
# ---------------------------------------------------------------------------------------------
# Factory contract whose vector entries list the vault addresses.
FACTORY_CONTRACT = "CDKFHFJIET3A73A2YN4KV7NSV32S6YGQMUFH3DNJXLBWL4SKEGVRNFKI"
# Contract of the native asset; its instance carries an empty asset code.
NATIVE_ASSET_CONTRACT = "CAS3J7GYLGXMF6TDJBBYYSE3HQ6BBSMLNUQ34T6TZMYMW2EVH34XOWMA"
NATIVE_ASSET_CODE = "XLM"
UNKNOWN_ASSET_CODE = "UNKNOWN"

# contract_key_type values
KEY_VEC = "ScValTypeScvVec"
KEY_INSTANCE = "ScValTypeScvLedgerKeyContractInstance"
KEY_MAP = "ScValTypeScvMap"

# Event topic words
TOPIC_DEPOSIT = "deposit"
TOPIC_WITHDRAW = "withdraw"
TOPIC_FEES = "dfees"
STRATEGY_TOPIC = "BlendStrategy"
TOPIC_HARVEST = "harvest"
REPORT_KEY_WORD = "Report"

# Payload symbols
SYM_DEPOSITOR = "depositor"
SYM_WITHDRAWER = "withdrawer"
SYM_AMOUNTS = "amounts"
SYM_AMOUNTS_WITHDRAWN = "amounts_withdrawn"
SYM_FUNDS_BEFORE = "total_managed_funds_before"
SYM_TOTAL_AMOUNT = "total_amount"
SYM_SUPPLY_BEFORE = "total_supply_before"
SYM_MINTED = "df_tokens_minted"
SYM_BURNED = "df_tokens_burned"
SYM_AMOUNT = "amount"
SYM_PPS = "price_per_share"
SYM_DISTRIBUTED_FEES = "distributed_fees"
SYM_LOCKED_FEE = "locked_fee"
SYM_GAINS = "gains_or_losses"
SYM_PREV_BALANCE = "prev_balance"

# i128 = hi * 2^64 + lo, in units of 10^-7 of a token.
TWO_POW_64 = Decimal(2**64)
TOKEN_SCALE = Decimal("0.0000001")

# Annualisation: ((end/start) ^ (DAYS_PER_YEAR * MS_PER_DAY / elapsed_ms) - 1) * 100
DAYS_PER_YEAR = 365.2425
MS_PER_DAY = 86400000.0

# Strategy registry (name, address, asset token), in the order it is published.
STRATEGIES = [
    ("usdc_blend_autocompound_fixed_strategy", "CDB2WMKQQNVZMEBY7Q7GZ5C7E7IAFSNMZ7GGVD6WKTCEWK7XOIAVZSAP", "USDC"),
    ("eurc_blend_autocompound_fixed_strategy", "CC5CE6MWISDXT3MLNQ7R3FVILFVFEIH3COWGH45GJKL6BD2ZHF7F7JVI", "EURC"),
    ("xlm_blend_autocompound_fixed_strategy", "CDPWNUW7UMCSVO36VAJSQHQECISPJLCVPDASKHRC5SEROAAZDUQ5DG2Z", "XLM"),
    ("usdc_blend_autocompound_yieldblox_strategy", "CCSRX5E4337QMCMC3KO3RDFYI57T5NZV5XB3W3TWE4USCASKGL5URKJL", "USDC"),
    ("eurc_blend_autocompound_yieldblox_strategy", "CA33NXYN7H3EBDSA3U2FPSULGJTTL3FQRHD2ADAAPTKS3FUJOE73735A", "EURC"),
    ("xlm_blend_autocompound_yieldblox_strategy", "CBDOIGFO2QOOZTWQZ7AFPH5JOUS2SBN5CTTXR665NHV6GOCM6OUGI5KP", "XLM"),
    ("cetes_blend_autocompound_yieldblox_strategy", "CBTSRJLN5CVVOWLTH2FY5KNQ47KW5KKU3VWGASDN72STGMXLRRNHPRIL", "CETES"),
    ("aqua_blend_autocompound_yieldblox_strategy", "CCMJUJW6Z7I3TYDCJFGTI3A7QA3ASMYAZ5PSRRWBBIJQPKI2GXL5DW5D", "AQUA"),
    ("ustry_blend_autocompound_yieldblox_strategy", "CDDXPBOF727FDVTNV4I3G4LL4BHTJHE5BBC4W6WZAHMUPFDPBQBL6K7Y", "USTRY"),
    ("usdglo_blend_autocompound_yieldblox_strategy", "CCTLQXYSIUN3OSZLZ7O7MIJC6YCU3QLLS6TUM3P2CD6DAVELMWC3QV4E", "USDGLO"),
]
# Strategy subset used by harvest and APY reports ("_" is a one-character wildcard in LIKE).
APY_STRATEGY_PATTERN = "%yieldblox_strategy%"
APY_ASSETS = ("USDC", "EURC", "XLM")
# APY horizons: (suffix, seconds)
APY_HORIZONS = (("24h", 24 * 3600), ("7d", 7 * 86400), ("30d", 30 * 86400))

# ---------------------------------------------------------------------------------------------
# Tunable parameters
# ---------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class VaultConfig:
    """Deployment-specific settings.

    vault_topic:   contract name that vault events carry in their topics
    name_prefix:   prefix stripped from vault names for display
    pegged_codes:  asset codes valued at 1 USD without a price row
    max_broadcast_rows: largest dimension that may be broadcast (checked at run time)
    only_successful: restrict vault and strategy event logs to successful transactions (the
                     dashboard queries do not, so the default is off)
    layout:          how the event and transaction tables are stored: "hash" (bucketed on the transaction
                     hash: per-transaction rules without a shuffle) or "day" (partitioned by day, clustered
                     by contract: time windows read their days only, per-transaction rules shuffle once)
    """

    vault_topic: str = "YieldVault"
    name_prefix: str = "YieldVault-"
    pegged_codes: tuple[str, ...] = ("USDC",)
    max_broadcast_rows: int = 2_000_000
    only_successful: bool = False
    layout: str = "hash"
    strategies: tuple = field(default_factory=lambda: tuple(STRATEGIES))
