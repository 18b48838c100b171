"""Result edge: the conversions a caller of the scorecard sees.

Sums stay exact DECIMAL inside the plans; at the edge decimals become DOUBLE and
dates ISO ``YYYY-MM-DD`` strings, as in the service the scorecard replaces. The
conversion is a projection over the schema, fused into the last codegen stage.
"""

from __future__ import annotations

import datetime as dt
import os
from urllib.parse import quote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.params import as_of_date

ALL_FIRMS = "__all__"


def normalize(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            # ISO text: no fraction when it is zero, six digits otherwise
            whole = F.date_trunc("second", c) == c
            c = F.when(whole, F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(
                F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
        cols.append(c.alias(f.name))
    return df.select(cols)


def write_panels(panels: dict[str, DataFrame], root: str, as_of: dt.date | str,
                 firm: str | None = None) -> None:
    """Scale sink: each panel goes to its own folder per as-of date and firm.

    ``<root>/<panel>/as_of=<date>/firm=<firm or __all__>`` is overwritten as a whole, also by
    an empty result, so a re-run leaves exactly its own rows and touches no other
    date or firm. ``root`` should be a shared folder; reading ``<root>/<panel>`` gives back
    ``as_of`` and ``firm`` as partition columns.
    """
    day = as_of_date(as_of).isoformat()
    part = quote(firm, safe="") if firm else ALL_FIRMS
    for name, df in panels.items():
        normalize(df).write.mode("overwrite").parquet(
            os.path.join(root, name, f"as_of={day}", f"firm={part}"))
