from __future__ import annotations

import __spark_entry__ as E


def test_entry_runs_on_smoke_data(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 12
    assert {r.metric for r in rows} == {"Billable Hours", "TVP", "Avg Billable Rate", "Billings",
                                        "Realization %", "Collections"}
    assert df.columns == E.entry(spark).columns


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_oracle_sql_reads_only_registered_views():
    for sql in E.oracle_sql().values():
        assert "read_parquet" not in sql and "/root/" not in sql
