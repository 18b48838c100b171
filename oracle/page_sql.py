"""Oracle SQL (DuckDB) for the whole page in its long form: panel, position, label, measure, value, text."""

from __future__ import annotations

from . import firms_sql as FQ
from . import queries as Q
from . import report_sql as RQ

# Per panel: columns that name a row, numbers, and other columns.
_CHANGE = ["current", "prior", "pct_chg"]
PANELS = {
    "tvp_summary": (["period"], _CHANGE, ["status"]),
    "gauges": (["period", "position", "label"],
               ["current", "py_same", "py_full", "pct_chg", "ratio", "ratio_clamped"], ["unit", "status"]),
    "perf_table": (["period", "position", "metric"], _CHANGE, ["unit", "status"]),
    "service_line_change": (["service_line"],
                            ["cy_mtd_hours", "py_mtd_hours", "hours_pct_chg", "cy_mtd_tvp", "py_mtd_tvp", "tvp_pct_chg"],
                            ["hours_status", "tvp_status"]),
    "utilization": (["staff_level_index", "staff_level"], ["headcount", "avg_hours", "avg_tvp", "avg_rate"], []),
    "utilization_share": (["staff_level_index", "staff_level"], ["avg_hours", "scale_hours", "bar_pct"], ["band"]),
    "ar_distribution": (["position", "bucket"], ["amount", "total", "rel_height", "share_pct"], ["show_label"]),
    "wip_risk": (["client_name", "partner_name"], ["wip_amount"], []),
    "wip_risk_total": ([], ["items", "total"], []),
    "ar_risk": (["client_name", "partner_name"], ["ar_amount"], []),
    "ar_risk_total": ([], ["items", "total"], []),
}


def _long(statements: dict[str, str], by: list[str]) -> str:
    parts = []
    lead = "".join(f"{c}, " for c in by)
    for panel, statement in statements.items():
        names, numbers, texts = PANELS[panel]
        order = [f'"{c}" NULLS FIRST' for c in names]
        if panel in ("wip_risk", "ar_risk"):
            order.insert(0, f"{numbers[0]} DESC")
        over = (f"PARTITION BY {', '.join(by)} " if by else "") + (f"ORDER BY {', '.join(order)}" if order else "")
        label = " || ' / ' || ".join(f"COALESCE(CAST(\"{c}\" AS VARCHAR), '')" for c in names) or "''"
        rows = f"SELECT *, row_number() OVER ({over}) AS place, {label} AS name FROM ({statement})"
        for c in numbers + texts:
            value = f'CAST("{c}" AS DOUBLE)' if c in numbers else "CAST(NULL AS DOUBLE)"
            text = "CAST(NULL AS VARCHAR)" if c in numbers else f'CAST("{c}" AS VARCHAR)'
            parts.append(f"SELECT {lead}'{panel}' AS panel, CAST(place AS INTEGER) AS position, name AS label, "
                         f"'{c}' AS measure, {value} AS value, {text} AS text FROM ({rows})")
    return "\nUNION ALL\n".join(parts)


def scorecard(as_of: str, firm: str | None = None) -> str:
    return _long({
        "tvp_summary": RQ.tvp_summary(as_of, firm), "gauges": RQ.gauges(as_of, firm),
        "perf_table": RQ.perf_table(as_of, firm), "service_line_change": RQ.service_line_change(as_of, firm),
        "utilization": RQ.utilization_metrics(as_of, firm), "utilization_share": RQ.utilization_share(as_of, firm),
        "ar_distribution": RQ.ar_distribution(as_of, firm), "wip_risk": Q.wip_risk(as_of, firm),
        "wip_risk_total": RQ.risk_total("wip", as_of, firm), "ar_risk": Q.ar_risk(as_of, firm),
        "ar_risk_total": RQ.risk_total("ar", as_of, firm)}, [])


def scorecard_all_firms(as_of: str) -> str:
    return _long({
        "tvp_summary": FQ.tvp_summary(as_of), "gauges": FQ.gauges(as_of), "perf_table": FQ.perf_table(as_of),
        "service_line_change": FQ.service_line_change(as_of), "utilization": FQ.utilization_metrics(as_of),
        "utilization_share": FQ.utilization_share(as_of), "ar_distribution": FQ.ar_distribution(as_of),
        "wip_risk": FQ.wip_risk(as_of), "wip_risk_total": FQ.risk_total("wip", as_of),
        "ar_risk": FQ.ar_risk(as_of), "ar_risk_total": FQ.risk_total("ar", as_of)},
        ["member_firm_id"])
