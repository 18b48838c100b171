"""Ad-hoc SQL over the star schema with a bounded preview.

The source system shows results of generated SQL capped at 200 rows (50 on
screen). Here the caller's SQL runs through ``spark.sql`` with named parameters
(values are bound, never spliced into the text) and the result is cut with
``limit``, which Spark plans as ``CollectLimit`` (or ``TakeOrderedAndProject``
under an ORDER BY), so only the preview rows reach the driver.

Generated SQL is not trusted. It is parsed as a query before anything runs, so a command (DROP, INSERT, CREATE, SET, ...)
or a second statement is a parse error, and it may read nothing but the star's tables and its own
common table expressions: other tables, files and temporary views are refused by name. The tables are visible under
their names inside the call only; no view stays behind, and none of the caller's is touched.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession

from ..sources.star import StarSchema

# Rows of a preview (fixed value).
PREVIEW_ROWS = 200


@dataclass(frozen=True)
class Preview:
    """Rows of an ad-hoc query; ``cut`` says whether it has more."""
    columns: list[str]
    rows: list[Row]
    cut: bool


def check_query(spark: SparkSession, sql: str, tables: list[str]) -> None:
    """Raise unless ``sql`` is one query over ``tables`` and its own common table expressions. Runs nothing."""
    parsed = spark._jsparkSession.sessionState().sqlParser().parseQuery(sql).toString()
    known = {t.lower() for t in tables}
    for names in re.findall(r"\bCTE \[([^\]]*)\]", parsed):
        known |= {n.strip().lower() for n in names.split(",")}
    read = {n.strip().lower() for n in re.findall(r"UnresolvedRelation \[([^\]]*)\]", parsed)}
    if read - known:
        raise ValueError(f"ad-hoc SQL may only read the star's tables, not {', '.join(sorted(read - known))}")


def adhoc(spark: SparkSession, sql: str, args: dict[str, Any] | None = None, *,
          star: StarSchema, limit: int = PREVIEW_ROWS) -> DataFrame:
    """The first ``limit`` rows of a query over the star's tables (lazy)."""
    sql = sql.strip().rstrip(";")
    tables = star.tables()
    check_query(spark, sql, list(tables))
    tag = f"_star_{uuid.uuid4().hex}_"
    try:
        star.register(tag)
        views = ",\n".join(f"{t} AS (SELECT * FROM {tag}{t})" for t in tables)
        # the caller's text ends in a line of its own, so that a comment cannot reach the bracket
        return spark.sql(f"WITH {views}\nSELECT * FROM (\n{sql}\n)", args=args or {}).limit(limit)
    finally:
        for t in tables:
            spark.catalog.dropTempView(tag + t)


def preview(spark: SparkSession, sql: str, args: dict[str, Any] | None = None, *,
            star: StarSchema, limit: int = PREVIEW_ROWS) -> Preview:
    """At most ``limit`` rows on the driver, and whether there are more."""
    found = adhoc(spark, sql, args, star=star, limit=limit + 1)
    rows = found.collect()
    return Preview(found.columns, rows[:limit], len(rows) > limit)
