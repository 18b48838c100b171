"""Oracle SQL (DuckDB) for the derived scorecard layer.

The page's arithmetic restated in SQL over the oracle's own query results: NULL
becomes 0 before any maths, divisions only under a positive (or non-zero)
denominator, change and status as in the page.
"""

from __future__ import annotations

from . import queries as Q
from .star_sql import with_star


def _num(c: str) -> str:
    return f"COALESCE(CAST({c} AS DOUBLE), 0.0)"


def _pct(cur: str, pri: str) -> str:
    return f"CASE WHEN {pri} != 0 THEN ({cur} - {pri}) / abs({pri}) * 100 END"


def _status(x: str) -> str:
    return (f"CASE WHEN {x} IS NULL OR isnan({x}) OR isinf({x}) THEN 'N/A' "
            f"WHEN {x} > 0 THEN 'Ahead' WHEN {x} >= -5 THEN 'Flat' ELSE 'Behind' END")


def _rate(tvp: str, hours: str) -> str:
    return f"CASE WHEN {hours} > 0 THEN {tvp} / {hours} ELSE 0.0 END"


def _real(tvp: str, wuwd: str) -> str:
    return f"CASE WHEN {tvp} > 0 THEN ({tvp} + {wuwd}) / {tvp} * 100 ELSE 0.0 END"


def _union(rows: list[dict], src: str, keys: list[str]) -> str:
    sels = []
    for r in rows:
        cols = keys + [f"{v} AS \"{k}\"" for k, v in r.items()]
        sels.append(f"SELECT {', '.join(cols)} FROM {src}")
    return "\nUNION ALL\n".join(sels)


def _lit(s) -> str:
    return f"CAST({s} AS INTEGER)" if isinstance(s, int) else "'" + s.replace("'", "''") + "'"


_PERIOD_KEYS = (("MTD", "mtd", "month"), ("YTD", "ytd", "year"))


def measures_ctes(as_of: str, firm: str | None) -> list[str]:
    return [f"tg AS ({Q.time_gauges_body(as_of, firm)})",
            f"ig AS ({Q.invoice_gauges_body(as_of, firm)})",
            f"cg AS ({Q.cash_gauges_body(as_of, firm)})",
            "m AS (SELECT * FROM tg, ig, cg)"]


def perf_rows() -> list[dict]:
    rows = []
    for period, k, _ in _PERIOD_KEYS:
        ch, ph = _num(f"cy_{k}_hours"), _num(f"py_{k}_hours")
        ct, pt = _num(f"cy_{k}_tvp"), _num(f"py_{k}_tvp")
        cw, pw = _num(f"cy_{k}_wuwd"), _num(f"py_{k}_wuwd")
        metrics = [("Billable Hours", "number", ch, ph), ("TVP", "currency", ct, pt),
                   ("Avg Billable Rate", "rate", _rate(ct, ch), _rate(pt, ph)),
                   ("Billings", "currency", _num(f"cy_{k}_billings"), _num(f"py_{k}_billings")),
                   ("Realization %", "percent", _real(ct, cw), _real(pt, pw)),
                   ("Collections", "currency", _num(f"cy_{k}_cash"), _num(f"py_{k}_cash"))]
        for pos, (metric, unit, cur, pri) in enumerate(metrics, 1):
            rows.append({"period": _lit(period), "position": _lit(pos), "metric": _lit(metric),
                         "unit": _lit(unit), "current": cur, "prior": pri})
    return rows


def perf_select(src: str, keys: list[str]) -> str:
    base = _union(perf_rows(), src, keys)
    return (f"SELECT *, {_status('pct_chg')} AS status FROM ("
            f"SELECT *, {_pct('\"current\"', 'prior')} AS pct_chg FROM ({base}))")


def perf_table(as_of: str, firm: str | None = None) -> str:
    stars = ["fct_time_entry", "fct_invoice", "fct_cash_receipt"]
    return with_star(stars, measures_ctes(as_of, firm)) + perf_select("m", [])


def gauge_rows() -> list[dict]:
    rows = []
    for period, k, full in _PERIOD_KEYS:
        labels = [("Hours", "hours", "number"), ("TVP", "tvp", "currency"),
                  ("Billings", "billings", "currency"), ("Collections", "cash", "currency")]
        for pos, (label, m, unit) in enumerate(labels, 1):
            rows.append({"period": _lit(period), "position": _lit(pos), "label": _lit(label),
                         "unit": _lit(unit), "current": _num(f"cy_{k}_{m}"),
                         "py_same": _num(f"py_{k}_{m}"), "py_full": _num(f"py_full_{full}_{m}")})
    return rows


def gauges_select(src: str, keys: list[str]) -> str:
    base = _union(gauge_rows(), src, keys)
    ratio = 'CASE WHEN py_full != 0 THEN "current" / abs(py_full) ELSE 0.0 END'
    return (f"SELECT *, {_status('pct_chg')} AS status, "
            f"least(greatest(ratio, 0.0), 1.0) AS ratio_clamped FROM ("
            f"SELECT *, {_pct('\"current\"', 'py_same')} AS pct_chg, {ratio} AS ratio "
            f"FROM ({base}))")


def gauges(as_of: str, firm: str | None = None) -> str:
    stars = ["fct_time_entry", "fct_invoice", "fct_cash_receipt"]
    return with_star(stars, measures_ctes(as_of, firm)) + gauges_select("m", [])


def tvp_summary(as_of: str, firm: str | None = None) -> str:
    rows = [{"period": _lit(p), "current": _num(f"cy_{k}_tvp"), "prior": _num(f"py_{k}_tvp")}
            for p, k, _ in _PERIOD_KEYS]
    base = _union(rows, "tg", [])
    return (with_star(["fct_time_entry"], [f"tg AS ({Q.time_gauges_body(as_of, firm)})"])
            + f"SELECT *, {_status('pct_chg')} AS status FROM ("
              f"SELECT *, {_pct('\"current\"', 'prior')} AS pct_chg FROM ({base}))")


def service_line_change(as_of: str, firm: str | None = None) -> str:
    hc, hp = _num("cy_mtd_hours"), _num("py_mtd_hours")
    tc, tp = _num("cy_mtd_tvp"), _num("py_mtd_tvp")
    inner = (f"SELECT service_line, {hc} AS cy_mtd_hours, {hp} AS py_mtd_hours, "
             f"{_pct(hc, hp)} AS hours_pct_chg, {tc} AS cy_mtd_tvp, {tp} AS py_mtd_tvp, "
             f"{_pct(tc, tp)} AS tvp_pct_chg FROM sl")
    return (with_star(["fct_time_entry"], [f"sl AS ({Q.service_lines_body(as_of, firm)})"])
            + f"SELECT *, {_status('hours_pct_chg')} AS hours_status, "
              f"{_status('tvp_pct_chg')} AS tvp_status FROM ({inner})")


def _util_metrics_select(src: str, keys: list[str]) -> str:
    hc = "COALESCE(CAST(headcount AS DOUBLE), 0.0)"
    h, t = _num("total_hours"), _num("total_tvp")
    k = "".join(f"{c}, " for c in keys)
    return (f"SELECT {k}staff_level, staff_level_index, headcount, "
            f"CASE WHEN {hc} > 0 THEN {h} / {hc} ELSE 0.0 END AS avg_hours, "
            f"CASE WHEN {hc} > 0 THEN {t} / {hc} ELSE 0.0 END AS avg_tvp, "
            f"{_rate(t, h)} AS avg_rate FROM {src}")


def utilization_metrics(as_of: str, firm: str | None = None) -> str:
    return (with_star(["fct_time_entry", "dim_person"],
                      [f"u AS ({Q.utilization_body(as_of, firm)})"])
            + _util_metrics_select("u", []))


def _util_share_select(src: str, keys: list[str]) -> str:
    part = f"PARTITION BY {', '.join(keys)}" if keys else ""
    k = "".join(f"{c}, " for c in keys)
    inner = (f"SELECT {k}staff_level, staff_level_index, avg_hours, "
             f"greatest(max(avg_hours) OVER ({part}), 40.0) AS scale_hours "
             f"FROM ({_util_metrics_select(src, keys)})")
    return (f"SELECT *, least(avg_hours / scale_hours * 100, 100.0) AS bar_pct, "
            f"CASE WHEN avg_hours >= 30 THEN 'high' WHEN avg_hours >= 20 THEN 'mid' "
            f"ELSE 'low' END AS band FROM ({inner})")


def utilization_share(as_of: str, firm: str | None = None) -> str:
    return (with_star(["fct_time_entry", "dim_person"],
                      [f"u AS ({Q.utilization_body(as_of, firm)})"])
            + _util_share_select("u", []))


_AR_LABELS = [("Current", "current_bucket"), ("31-60", "bucket_31_60"),
              ("61-90", "bucket_61_90"), ("91-120", "bucket_91_120"),
              ("120+", "bucket_120_plus")]


def _ar_distribution_select(src: str, keys: list[str]) -> str:
    max_val = "greatest(" + ", ".join(_num(c) for _, c in _AR_LABELS) + ", 1.0)"
    rows = [{"position": _lit(i), "bucket": _lit(label), "amount": _num(c),
             "max_amount": max_val, "total": _num("total")}
            for i, (label, c) in enumerate(_AR_LABELS, 1)]
    base = _union(rows, src, keys)
    share = 'CASE WHEN total > 0 THEN amount / total * 100 ELSE 0.0 END'
    k = "".join(f"{c}, " for c in keys)
    return (f"SELECT *, share_pct >= 3 AS show_label FROM ("
            f"SELECT {k}position, bucket, amount, total, amount / max_amount AS rel_height, "
            f"{share} AS share_pct FROM ({base}))")


def ar_distribution(as_of: str, firm: str | None = None, edge: str | None = None) -> str:
    return (with_star(["ar_items"], [Q.open_items("ar", as_of, firm, edge), f"a AS ({Q.aging_body('ar', edge)})"])
            + _ar_distribution_select("a", []))


def _risk_ctes(kind: str, as_of: str, firm: str | None, edge: str | None, dbl: bool) -> str:
    return with_star([f"{kind}_items", "dim_client"],
                     [Q.open_items(kind, as_of, firm, edge), f"r AS ({Q.risk_body(kind, edge, dbl=dbl)})"])


def risk_total(kind: str, as_of: str, firm: str | None = None, edge: str | None = None) -> str:
    return (_risk_ctes(kind, as_of, firm, edge, False)
            + f"SELECT CAST(COUNT(*) AS BIGINT) AS items, "
              f"COALESCE(CAST(SUM({kind}_amount) AS DOUBLE), 0.0) AS total FROM r")


def risk_search(kind: str, query: str, as_of: str, firm: str | None = None, edge: str | None = None) -> str:
    q = query.lower().replace("'", "''")
    return (_risk_ctes(kind, as_of, firm, edge, True)
            + f"SELECT * FROM r WHERE contains(lower(COALESCE(client_name, '')), '{q}') "
              f"OR contains(lower(COALESCE(partner_name, '')), '{q}')")


def reporting_friday() -> str:
    back = ("CASE WHEN dayofweek(ts) = 5 AND hour(ts) < 17 THEN 7 "
            "ELSE (dayofweek(ts) + 2) % 7 END")
    # ISO text: no fraction when it is zero, six digits otherwise
    text = ("CASE WHEN epoch_us(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') "
            "ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END")
    return (f"SELECT event_id, {text} AS ts, "
            f"strftime(CAST(ts AS DATE) - CAST({back} AS INTEGER), '%Y-%m-%d') AS week_ending "
            f"FROM events")


def perf_table_series(dates: list[str], firm: str | None = None) -> str:
    ctes = []
    for i, d in enumerate(dates):
        ctes += [f"tg{i} AS ({Q.time_gauges_body(d, firm)})",
                 f"ig{i} AS ({Q.invoice_gauges_body(d, firm)})",
                 f"cg{i} AS ({Q.cash_gauges_body(d, firm)})",
                 f"m{i} AS (SELECT '{d}' AS as_of, * FROM tg{i}, ig{i}, cg{i})"]
    ctes.append("m AS (" + " UNION ALL ".join(f"SELECT * FROM m{i}" for i in range(len(dates)))
                + ")")
    stars = ["fct_time_entry", "fct_invoice", "fct_cash_receipt"]
    return with_star(stars, ctes) + perf_select("m", ["as_of"])
