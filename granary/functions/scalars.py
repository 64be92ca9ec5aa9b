"""Session functions whose values are the engine's own, and small scalar helpers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

VERSION = "granary 1.0 on Spark"


def session_values(database: str = "granary", user: str = "granary", schema: str = "public") -> Mapping[str, str]:
    """Values of the niladic functions by name."""
    return {
        "version": VERSION, "current_database": database, "current_catalog": database, "current_schema": schema,
        "current_user": user, "user": user, "session_user": user, "current_role": user,
    }


def date_of(timestamp: Column) -> Column:
    return F.to_date(timestamp)


def json_value(json: Column, path: str) -> Column:
    return F.get_json_object(json, path)


def boolean_of(text: Column) -> Column:
    """t, true, yes, y, on, 1 and their opposites, whatever the case; null for other texts."""
    low = F.lower(F.trim(text.cast("string")))
    return F.when(low.isin("t", "true", "yes", "y", "on", "1"), True).when(low.isin("f", "false", "no", "n", "off", "0"), False)


def units(value: Column, places: int) -> Column:
    """A double in whole units of its last place, as a long: halves away from zero, by binary multiplication."""
    scaled = value * float(10**places)
    return F.when(scaled < 0, -F.floor(0.5 - scaled)).otherwise(F.floor(scaled + 0.5))


def round_half_away(value: Column, places: int) -> Column:
    return units(value, places).cast("double") / float(10**places)


def amount_sum(value: Column) -> Column:
    """The sum of amounts of four places as a decimal, whatever the order of rows: two sums of longs, which don't
    overflow below 10 ** 12 rows of 10 ** 14."""
    each, million = units(value, 4), F.lit(1_000_000)
    high, low = F.sum(F.call_function("div", each, million)), F.sum(each % million)
    return ((high.cast("decimal(19,0)") * F.lit(1_000_000).cast("decimal(7,0)") + low.cast("decimal(19,0)")) * F.lit("0.0001").cast("decimal(4,4)")).cast("decimal(28,4)")
