"""Spreads, direction labels, net demand."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadforge.config import HORIZONS, SPREADS
from spreadforge.functions.scalar import col


def add_spreads(df: DataFrame) -> DataFrame:
    """Later market minus earlier market, for each pair present."""
    cols = set(df.columns)
    return df.withColumns({name: col(later) - col(earlier) for name, later, earlier in SPREADS
                           if later in cols and earlier in cols})


def direction(c) -> F.Column:
    """+1 for >= 0, else -1 (a missing spread is -1, zero is +1)."""
    return F.when(c >= 0, F.lit(1)).otherwise(F.lit(-1))


def add_directions(df: DataFrame) -> DataFrame:
    return df.withColumns({f"dir_{s}": direction(col(s)) for s in df.columns if s.startswith("spr_")})


def add_net_demand(df: DataFrame) -> DataFrame:
    """Demand forecast - wind forecast - solar, per horizon (NULL-propagating;
    a missing input column raises, as in the reference)."""
    return df.withColumns({
        f"NetDemand_{s}": col(f"EirGridDemandFc_{s}") - col(f"EirGridWindFc_{s}") - col(f"ISEMSOLAR_{s}")
        for s in HORIZONS})


def add_spreads_and_fundamentals(df: DataFrame) -> DataFrame:
    return add_net_demand(add_directions(add_spreads(df)))
