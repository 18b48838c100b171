"""The test-table to star-schema mapping, as DuckDB SQL common table expressions.

Used only by the correctness oracle: DuckDB sees the driver's raw tables as
views, so each oracle query starts with these CTEs and then states the scorecard
query the way the source system writes it (date-part predicates, row-wise bucket
additions, scalar subqueries), independently of how the Spark plans compute it.
"""

from __future__ import annotations

# Fixed values of the test mapping, stated here once more: the oracle shares none with the engine.
_LEVELS = ("WHEN 0 THEN 'Partner' WHEN 1 THEN 'Director' WHEN 2 THEN 'Manager' "
           "WHEN 3 THEN 'Senior' WHEN 4 THEN 'Staff' WHEN 5 THEN ''")
_QUARTERS = "generate_series(DATE '1999-04-01', DATE '2001-10-01', INTERVAL 3 MONTH)"

CTES = {
    "nat": """nat AS (
    SELECT n_nationkey, n_name,
           CASE WHEN n_nationkey = 0 THEN NULL WHEN n_nationkey = 1 THEN '' ELSE n_name END AS firm
    FROM nation)""",
    "cust": """cust AS (
    SELECT c.c_custkey, c.c_name, c.c_nationkey, n.n_name, n.firm
    FROM customer c JOIN nat n ON c.c_nationkey = n.n_nationkey)""",
    "fct_time_entry": """fct_time_entry AS (
    SELECT n.firm AS member_firm_id,
           l.l_suppkey AS person_key,
           CAST(l.l_shipdate AS DATE) AS entry_date,
           CAST(l.l_quantity AS DECIMAL(18,2)) AS hours,
           CAST(l.l_extendedprice AS DECIMAL(18,2)) AS production_amount,
           CASE WHEN l.l_discount = 0 THEN NULL
                ELSE -1 * (CAST(l.l_extendedprice AS DECIMAL(12,2)) * CAST(l.l_discount AS DECIMAL(4,2)))
           END AS write_up_down,
           CASE WHEN l.l_returnflag = 'R' THEN FALSE WHEN l.l_linenumber = 7 THEN NULL ELSE TRUE END
             AS is_billable,
           CASE WHEN p.p_size = 1 THEN NULL ELSE p.p_type END AS service_line
    FROM lineitem l
    JOIN supplier s ON l.l_suppkey = s.s_suppkey
    JOIN nat n ON s.s_nationkey = n.n_nationkey
    JOIN part p ON l.l_partkey = p.p_partkey)""",
    "fct_invoice": """fct_invoice AS (
    SELECT cu.firm AS member_firm_id, o.o_custkey AS client_key,
           CAST(o.o_orderdate AS DATE) AS invoice_date,
           CAST(o.o_totalprice AS DECIMAL(18,2)) AS invoice_amount
    FROM orders o JOIN cust cu ON o.o_custkey = cu.c_custkey)""",
    "fct_cash_receipt": """fct_cash_receipt AS (
    SELECT cu.firm AS member_firm_id, o.o_custkey AS client_key,
           CAST(o.o_orderdate AS DATE) + 30 AS receipt_date,
           CAST(o.o_totalprice AS DECIMAL(14,2))
             * CAST(CASE WHEN o.o_orderstatus = 'F' THEN 1.0 ELSE 0.5 END AS DECIMAL(2,1)) AS receipt_amount
    FROM orders o JOIN cust cu ON o.o_custkey = cu.c_custkey
    WHERE o.o_orderstatus IN ('F', 'P'))""",
    "dim_person": f"""dim_person AS (
    SELECT s_suppkey AS person_key,
           CASE WHEN s_suppkey % 12 = 11 THEN NULL ELSE CASE s_suppkey % 6 {_LEVELS} END END AS staff_level,
           CAST(s_suppkey % 6 AS INTEGER) AS staff_level_index
    FROM supplier)""",
    "dim_client": """dim_client AS (
    SELECT c_custkey AS client_key, c_name AS client_name,
           CASE WHEN c_nationkey = 0 THEN NULL ELSE n_name END AS partner_name
    FROM cust)""",
    "report_dates": f"""report_dates AS (
    SELECT CAST(q - INTERVAL 1 DAY AS DATE) AS report_date
    FROM (SELECT unnest({_QUARTERS}) AS q))""",
    # Open items: the snapshots are sums of these, so the oracle never builds a snapshot.
    "ar_items": """ar_items AS (
    SELECT o.o_custkey AS client_key, cu.firm AS member_firm_id,
           CAST(o.o_orderdate AS DATE) AS item_date,
           if(o.o_custkey % 10 = 0, -1, 1) * CAST(o.o_totalprice AS DECIMAL(18,2)) AS amount
    FROM orders o JOIN cust cu ON o.o_custkey = cu.c_custkey
    WHERE o.o_orderstatus <> 'F')""",
    "wip_items": """wip_items AS (
    SELECT o.o_custkey AS client_key, cu.firm AS member_firm_id,
           CAST(l.l_shipdate AS DATE) AS item_date,
           if(o.o_custkey % 10 = 0, -1, 1) * CAST(l.l_extendedprice AS DECIMAL(18,2)) AS amount
    FROM lineitem l
    JOIN orders o ON l.l_orderkey = o.o_orderkey
    JOIN cust cu ON o.o_custkey = cu.c_custkey
    WHERE l.l_linestatus = 'O')""",
}

# What each star table needs before it.
DEPENDS = {
    "fct_time_entry": ["nat"],
    "fct_invoice": ["nat", "cust"],
    "fct_cash_receipt": ["nat", "cust"],
    "dim_person": [],
    "dim_client": ["nat", "cust"],
    "ar_items": ["nat", "cust", "report_dates"],
    "wip_items": ["nat", "cust", "report_dates"],
}


def with_star(tables: list[str], extra_ctes: list[str] = ()) -> str:
    """``WITH`` clause defining the named star tables (and their inputs)."""
    order: list[str] = []
    for t in tables:
        for dep in DEPENDS[t] + [t]:
            if dep not in order:
                order.append(dep)
    return "WITH " + ",\n".join([CTES[c] for c in order] + list(extra_ctes)) + "\n"
