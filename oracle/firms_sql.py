"""Oracle SQL (DuckDB) for the all-firms scale form.

Each statement is the single-firm query grouped by firm, restricted to the listed
firms, with one-row panels left-joined from the firm list (a firm with no rows
gets the NULL row its single-firm query would give).
"""

from __future__ import annotations

from . import queries as Q
from . import report_sql as RS
from .star_sql import with_star

FIRMS_CTE = ("f AS (SELECT DISTINCT member_firm_id FROM fct_time_entry "
             "WHERE member_firm_id IS NOT NULL AND member_firm_id != '')")


def _grouped(cols: list[str], table: str, where: str = "") -> str:
    return (f"SELECT t.member_firm_id,\n    " + ",\n    ".join(cols)
            + f"\nFROM {table} t {where}\nGROUP BY t.member_firm_id")


def _tg(as_of: str) -> str:
    return _grouped(Q.time_gauge_cols(as_of), "fct_time_entry", "WHERE t.is_billable = true")


def _ig(as_of: str) -> str:
    return _grouped(Q.invoice_gauge_cols(as_of), "fct_invoice")


def _cg(as_of: str) -> str:
    return _grouped(Q.cash_gauge_cols(as_of), "fct_cash_receipt")


def time_gauges(as_of: str) -> str:
    return (with_star(["fct_time_entry"], [FIRMS_CTE, f"g AS ({_tg(as_of)})"])
            + "SELECT * FROM f LEFT JOIN g USING (member_firm_id)")


def _measures(as_of: str) -> list[str]:
    return [FIRMS_CTE, f"tg AS ({_tg(as_of)})", f"ig AS ({_ig(as_of)})", f"cg AS ({_cg(as_of)})",
            "m AS (SELECT * FROM f LEFT JOIN tg USING (member_firm_id) "
            "LEFT JOIN ig USING (member_firm_id) LEFT JOIN cg USING (member_firm_id))"]


_STARS = ["fct_time_entry", "fct_invoice", "fct_cash_receipt"]


def perf_table(as_of: str) -> str:
    return with_star(_STARS, _measures(as_of)) + RS.perf_select("m", ["member_firm_id"])


def gauges(as_of: str) -> str:
    return with_star(_STARS, _measures(as_of)) + RS.gauges_select("m", ["member_firm_id"])


def service_lines(as_of: str) -> str:
    return with_star(["fct_time_entry"]) + (
        "SELECT t.member_firm_id, service_line,\n    " + ",\n    ".join(Q.service_line_cols(as_of))
        + "\nFROM fct_time_entry t WHERE t.is_billable = true AND t.member_firm_id IS NOT NULL"
          " AND t.member_firm_id != ''\nGROUP BY t.member_firm_id, service_line")


_BY = ["member_firm_id"]
_LISTED = "SELECT * FROM f LEFT JOIN g USING (member_firm_id)"


def _utilization_body(as_of: str) -> str:
    return f"SELECT * FROM ({Q.utilization_body(as_of, None, _BY)}) WHERE length(member_firm_id) > 0"


def utilization(as_of: str) -> str:
    return with_star(["fct_time_entry", "dim_person"]) + _utilization_body(as_of)


def utilization_share(as_of: str) -> str:
    return (with_star(["fct_time_entry", "dim_person"], [f"u AS ({_utilization_body(as_of)})"])
            + RS._util_share_select("u", _BY))


def utilization_metrics(as_of: str) -> str:
    return (with_star(["fct_time_entry", "dim_person"], [f"u AS ({_utilization_body(as_of)})"])
            + RS._util_metrics_select("u", _BY))


def _aging(kind: str, as_of: str) -> list[str]:
    return [FIRMS_CTE, Q.open_items(kind, as_of), f"g AS ({Q.aging_body(kind, by=_BY)})"]


def ar_aging(as_of: str) -> str:
    return with_star(["fct_time_entry", "ar_items"], _aging("ar", as_of)) + _LISTED


def wip_aging(as_of: str) -> str:
    return with_star(["fct_time_entry", "wip_items"], _aging("wip", as_of)) + _LISTED


def ar_distribution(as_of: str) -> str:
    return (with_star(["fct_time_entry", "ar_items"], [*_aging("ar", as_of), f"a AS ({_LISTED})"])
            + RS._ar_distribution_select("a", _BY))


def _risk(kind: str, as_of: str, dbl: bool = True) -> list[str]:
    body = Q.risk_body(kind, by=_BY, dbl=dbl)
    return [FIRMS_CTE, Q.open_items(kind, as_of),
            f"r AS (SELECT * FROM ({body}) WHERE member_firm_id IN (SELECT member_firm_id FROM f))"]


def ar_risk(as_of: str) -> str:
    return with_star(["fct_time_entry", "ar_items", "dim_client"], _risk("ar", as_of)) + "SELECT * FROM r"


def wip_risk(as_of: str) -> str:
    return with_star(["fct_time_entry", "wip_items", "dim_client"], _risk("wip", as_of)) + "SELECT * FROM r"


def invoice_gauges(as_of: str) -> str:
    return (with_star(["fct_time_entry", "fct_invoice"], [FIRMS_CTE, f"g AS ({_ig(as_of)})"])
            + "SELECT * FROM f LEFT JOIN g USING (member_firm_id)")


def cash_gauges(as_of: str) -> str:
    return (with_star(["fct_time_entry", "fct_cash_receipt"], [FIRMS_CTE, f"g AS ({_cg(as_of)})"])
            + "SELECT * FROM f LEFT JOIN g USING (member_firm_id)")


def tvp_summary(as_of: str) -> str:
    rows = [{"period": RS._lit(p), "current": RS._num(f"cy_{k}_tvp"), "prior": RS._num(f"py_{k}_tvp")}
            for p, k, _ in RS._PERIOD_KEYS]
    base = RS._union(rows, "tg", ["member_firm_id"])
    return (with_star(["fct_time_entry"],
                      [FIRMS_CTE, f"g AS ({_tg(as_of)})",
                       "tg AS (SELECT * FROM f LEFT JOIN g USING (member_firm_id))"])
            + f"SELECT *, {RS._status('pct_chg')} AS status FROM ("
              f"SELECT *, {RS._pct(chr(34) + 'current' + chr(34), 'prior')} AS pct_chg FROM ({base}))")


def service_line_change(as_of: str) -> str:
    hc, hp = RS._num("cy_mtd_hours"), RS._num("py_mtd_hours")
    tc, tp = RS._num("cy_mtd_tvp"), RS._num("py_mtd_tvp")
    sl = ("SELECT t.member_firm_id, service_line,\n    " + ",\n    ".join(Q.service_line_cols(as_of))
          + "\nFROM fct_time_entry t WHERE t.is_billable = true AND t.member_firm_id IS NOT NULL"
            " AND t.member_firm_id != ''\nGROUP BY t.member_firm_id, service_line")
    inner = (f"SELECT member_firm_id, service_line, {hc} AS cy_mtd_hours, {hp} AS py_mtd_hours, "
             f"{RS._pct(hc, hp)} AS hours_pct_chg, {tc} AS cy_mtd_tvp, {tp} AS py_mtd_tvp, "
             f"{RS._pct(tc, tp)} AS tvp_pct_chg FROM sl")
    return (with_star(["fct_time_entry"], [f"sl AS ({sl})"])
            + f"SELECT *, {RS._status('hours_pct_chg')} AS hours_status, "
              f"{RS._status('tvp_pct_chg')} AS tvp_status FROM ({inner})")


def risk_total(kind: str, as_of: str) -> str:
    return (with_star(["fct_time_entry", f"{kind}_items", "dim_client"],
                      [*_risk(kind, as_of, dbl=False),
                       f"g AS (SELECT member_firm_id, CAST(COUNT(*) AS BIGINT) AS items, "
                       f"CAST(SUM({kind}_amount) AS DOUBLE) AS total FROM r "
                       f"GROUP BY member_firm_id)"])
            + "SELECT f.member_firm_id, COALESCE(g.items, 0) AS items, "
              "COALESCE(g.total, 0.0) AS total FROM f LEFT JOIN g USING (member_firm_id)")


def time_gauges_series(dates: list[str]) -> str:
    parts = [f"SELECT '{d}' AS as_of, * FROM f LEFT JOIN ({_tg(d)}) USING (member_firm_id)" for d in dates]
    return with_star(["fct_time_entry"], [FIRMS_CTE]) + " UNION ALL ".join(parts)


def perf_table_series(dates: list[str]) -> str:
    ctes = [FIRMS_CTE]
    for i, d in enumerate(dates):
        ctes += [f"m{i} AS (SELECT '{d}' AS as_of, * FROM f LEFT JOIN ({_tg(d)}) USING (member_firm_id) "
                 f"LEFT JOIN ({_ig(d)}) USING (member_firm_id) LEFT JOIN ({_cg(d)}) USING (member_firm_id))"]
    ctes.append("m AS (" + " UNION ALL ".join(f"SELECT * FROM m{i}" for i in range(len(dates))) + ")")
    return with_star(_STARS, ctes) + RS.perf_select("m", ["member_firm_id", "as_of"])
