"""Query keys -> plan functions of a Ledger.

Keys follow the key column of the survey's operator inventory: reference queries, their building
blocks, the documented analyses, typed-event audits, the pipeline helpers and the streaming jobs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from vaultlake.plans import activity as A
from vaultlake.plans import audit as X
from vaultlake.plans import blocks as B
from vaultlake.plans import dag as G
from vaultlake.plans import refresh as R
from vaultlake.plans import strategies as S
from vaultlake.plans import tvl as T
from vaultlake.plans import vaults as V
from vaultlake.sources.ledger import Ledger
from vaultlake.streaming import jobs as SJ

PLANS: dict[str, Callable[[Ledger], DataFrame]] = {
    "vault_registry": V.vault_registry,
    "vault_info": V.vault_info,
    "vault_events": V.vault_events,
    "tvl_hours": V.tvl_hours,
    "tvl_days_filled": V.tvl_days_filled,
    "latest_vaults": V.latest_vaults,
    "latest_usd_tvl": V.latest_usd_tvl,
    "aggregated_stats": V.aggregated_stats,
    "explore_reports": V.explore_reports,
    "strategy_overview": S.strategy_overview,
    "strategy_subset": S.strategy_subset,
    "harvest_events": S.harvest_events,
    "harvest_fields": S.harvest_fields,
    "fee_tuples": S.fee_tuples,
    "fees_distributed": S.fees_distributed,
    "report_key": S.report_key,
    "report_pivot": S.report_pivot,
    "locked_fees": S.locked_fees,
    "strategy_apy": S.strategy_apy,
    "trailing_endpoints": S.trailing_endpoints,
    "pps_at_endpoints": S.pps_at_endpoints,
    "recent_events": A.recent_events,
    "events_per_contract": A.events_per_contract,
    "fees_daily": A.fees_daily,
    "top_accounts": A.top_accounts,
    "failure_share": A.failure_share,
    "state_changes": A.state_changes,
    "events_transactions": A.events_transactions,
    "events_latest_state": A.events_latest_state,
    "asset_contract_events": A.asset_vault_events,  # the vaults that hold the asset
    "asset_code_events": A.asset_contract_events,  # the contracts whose state carries its code
    "asset_vault_events": A.asset_vault_events,
    "hourly_counts_filled": A.hourly_counts_filled,
    "moving_avg_rank": A.moving_avg_rank,
    "user_activity": A.user_activity,
    "top_depositors": A.top_depositors,
    "net_flow_vault": A.net_flow_vault,
    "net_flow": A.net_flow,
    "active_users": A.active_users,
    "cohort_retention": A.cohort_retention,
    "busiest_days": A.busiest_days,
    "activity_profile": A.activity_profile,
    "vault_transitions": A.vault_transitions,
    "multi_vault_users": A.multi_vault_users,
    "new_vaults": A.new_vaults,
    "resource_usage": A.resource_usage,
    "fee_headroom": A.fee_headroom,
    "ingest_lag": A.ingest_lag,
    "ingest_lag_quantiles": A.ingest_lag_quantiles,
    "resource_quantiles": A.resource_quantiles,
    "topic_frequency": A.topic_frequency,
    "tvl_change": T.tvl_change,
    "tvl_growth_30d": T.tvl_growth_30d,
    "fastest_growing": T.fastest_growing,
    "tvl_by_asset": T.tvl_by_asset,
    "asset_share": T.asset_share,
    "cross_vault": T.cross_vault,
    "vault_assets": T.vault_assets,
    "tvl_volatility": T.tvl_volatility,
    "tvl_drops": T.tvl_drops,
    "tvl_trend": T.tvl_trend,
    "tvl_forecast": T.tvl_forecast,
    "user_growth": A.user_growth,
    "protocol_tvl": T.protocol_tvl,
    "market_share": T.market_share,
    "price_tvl_corr": T.price_tvl_corr,
    "large_withdrawals": T.large_withdrawals,
    "vault_ranking": T.vault_ranking,
    "vault_outliers": T.vault_outliers,
    "decode_events": X.decode_events,
    "vault_creations": X.vault_creations,
    "harvest_step_apy": X.harvest_step_apy,
    "fee_audit": X.fee_audit,
    "rebalance_log": X.rebalance_log,
    "share_price": X.share_price,
    "share_reconcile": X.share_reconcile,
    "fee_split": X.fee_split,
    "report_deltas": X.report_deltas,
    "allocations": X.allocations,
    "strategy_status": X.strategy_status,
    "allocation_status": X.allocation_status,
    "scan_state": B.scan_state,
    "scan_events": B.scan_events,
    "scan_transactions": B.scan_transactions,
    "decode_i128": B.decode_i128,
    "payload_fields": B.payload_fields,
    "latest_snapshot": B.latest_snapshot,
    "latest_snapshot_ties": B.latest_snapshot_ties,
    "contract_metadata": B.contract_metadata,
    "asset_code_resolve": B.asset_code_resolve,
    "vault_display_name": B.vault_display_name,
    "topic_filter": B.topic_filter,
    "event_classify": B.event_classify,
    "registry_semi_join": B.registry_semi_join,
    "event_account": B.event_account,
    "event_amount_sum": B.event_amount_sum,
    "event_tvl": B.event_tvl,
    "hourly_max": B.hourly_max,
    "dedup_prices": B.dedup_prices,
    "price_join": B.price_join,
    "usd_value": B.usd_value,
    "daily_max": B.daily_max,
    "nonzero_keys": B.nonzero_keys,
    "calendar": B.calendar,
    "dense_grid": B.dense_grid,
    "grid_join": B.grid_join,
    "fill_groups": B.fill_groups,
    "forward_fill": B.forward_fill,
    "materialize_dag": G.materialize_dag,
    "refresh_days": R.refresh_days,
    "preview": G.preview,
    "inspect_raw_decoded": G.inspect_raw_decoded,
    "stream_decode": SJ.stream_decode,
    "stream_net_flow": SJ.stream_net_flow,
    "stream_hourly_tvl": SJ.stream_hourly_tvl,
    "stream_alerts": SJ.stream_alerts,
}
