"""Weather expressions: condition classification (C11)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Snow below 35 F, fog below 3 miles.
SNOW_BELOW_F = 35.0
FOG_BELOW_MILES = 3.0


def classify_condition(precip: Column, temp: Column, visibility: Column) -> Column:
    """Clear; precipitation -> Rain; precipitation below 35 F -> Snow;
    visibility < 3 without precipitation -> Fog (later rules win)."""
    return (
        F.when((visibility < FOG_BELOW_MILES) & (precip == 0), F.lit("Fog"))
        .when((precip > 0) & (temp < SNOW_BELOW_F), F.lit("Snow"))
        .when(precip > 0, F.lit("Rain"))
        .otherwise(F.lit("Clear"))
    )
