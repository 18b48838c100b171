"""Property tests on Spark: the pruned, unpruned, rollup and series forms agree."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from star_rows import make_star
from ledgerlens.operators import gauges as G
from ledgerlens.plans import rollup as RU

day = st.one_of(st.none(), st.dates(min_value=dt.date(1998, 11, 1), max_value=dt.date(2001, 4, 30)))
amount = st.one_of(st.none(), st.integers(min_value=-500, max_value=500).map(
    lambda c: Decimal(c).scaleb(-2)))
row = st.tuples(st.sampled_from(["A", "B", None]), st.integers(1, 3), day, amount, amount,
                st.one_of(st.none(), amount.map(lambda a: None if a is None else a.scaleb(-2))),
                st.sampled_from([True, True, False, None]), st.sampled_from(["Audit", "Tax", None]))
as_of = st.dates(min_value=dt.date(1999, 1, 1), max_value=dt.date(2001, 3, 31))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(facts=st.lists(row, max_size=12), t=as_of, firm=st.sampled_from([None, "A"]))
def test_pruned_unpruned_rollup_and_series_agree(spark, facts, t, firm):
    star = make_star(spark, fct_time_entry=facts)
    raw = rows(G.time_gauges(star, t, firm, prune=False))
    assert rows(G.time_gauges(star, t, firm)) == raw
    assert rows(G.time_gauges(RU.with_time_rollup(star), t, firm)) == raw
    series = RU.time_gauges_series(star, [t], firm).drop("as_of")
    assert rows(series) == raw
    lines = rows(G.service_lines(star, t, firm, prune=False))
    assert rows(G.service_lines(star, t, firm, prune=True)) == lines
    assert rows(G.service_lines(RU.with_time_rollup(star), t, firm)) == lines
    by = ["member_firm_id"]
    assert rows(G.time_gauges(star, t, by=by, prune=True)) == rows(
        G.time_gauges(star, t, by=by, prune=False))
    assert rows(G.service_lines(star, t, by=by, prune=True)) == rows(
        G.service_lines(star, t, by=by, prune=False))
