"""Display names and asset codes of vaults."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from vaultlake.config import NATIVE_ASSET_CODE, NATIVE_ASSET_CONTRACT, UNKNOWN_ASSET_CODE


def display_name(name: Column, vault: Column, prefix: str) -> Column:
    """`<name without prefix> - <first 3>..<last 3 of address>`; NULL if the name is NULL."""
    return F.concat(
        F.regexp_replace(name, F.lit("^" + re.escape(prefix)), F.lit("")),
        F.lit(" - "),
        F.substr(vault, F.lit(1), F.lit(3)),
        F.lit(".."),
        F.substr(vault, F.length(vault) - 2, F.lit(3)),
    )


def native_code(asset_code: Column, contract_id: Column) -> Column:
    """The native asset contract carries an empty code: report it under its ticker."""
    return F.when((asset_code == "") & (contract_id == NATIVE_ASSET_CONTRACT), F.lit(NATIVE_ASSET_CODE)).otherwise(
        asset_code
    )


def resolve_code(asset_code: Column) -> Column:
    """Empty or missing codes become UNKNOWN."""
    return F.coalesce(F.nullif(asset_code, F.lit("")), F.lit(UNKNOWN_ASSET_CODE))
