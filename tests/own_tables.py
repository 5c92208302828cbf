"""Small driver tables made by the tests themselves."""

from datetime import datetime, timedelta

import pyarrow.parquet as pq

T0 = datetime(2024, 1, 1)
KINDS = ("purchase", "error", "view", "click", "signup")


def write_tables(spark, folder, n=600, lines=400) -> str:
    """region, nation, events, orders and lineitem below `folder`."""
    nation = [(i, f"NATION{i}", i % 5) for i in range(25)]
    events = [(i, T0 + timedelta(minutes=37 * i), i % 19, KINDS[i % 5], (i % 90) + 0.25, "{}") for i in range(n)]
    orders = [(i, i % 40, "FOP"[i % 3], 100.0 + i, T0 + timedelta(hours=i), f"{i % 5 + 1}-X") for i in range(200)]
    items = [
        (i // 4, i % 37, i % 50, i % 4 + 1, 1000.0 + i % 11, i % 10 / 100, i % 9 / 100, "RAN"[i % 3], T0 + timedelta(days=i % 60)) for i in range(lines)
    ]
    tables = {
        "region": ([(i, f"REGION{i}") for i in range(5)], "r_regionkey long, r_name string"),
        "nation": (nation, "n_nationkey long, n_name string, n_regionkey long"),
        "events": (events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"),
        "orders": (orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"),
        "lineitem": (
            items,
            "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_discount double, l_tax double, "
            "l_returnflag string, l_shipdate timestamp_ntz",
        ),
    }
    for name, (rows, schema) in tables.items():
        pq.write_table(spark.createDataFrame(rows, schema).toArrow(), f"{folder}/{name}.parquet")
    return str(folder)
