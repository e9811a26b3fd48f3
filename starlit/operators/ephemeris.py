"""Per-object ephemeris operators: phase folding, transit windows, model flux, quarters from time."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the light-curve model: stellar variability amplitude 0.002,
# quarters of 90 days numbered 1..18 cyclically.
VARIABILITY = 0.002
QUARTER_DAYS = 90
QUARTERS_PER_CYCLE = 18


def join_ephemeris(obs: DataFrame, ephemeris: DataFrame) -> DataFrame:
    """Observations with their object's ephemeris (left join on object_id; AQE broadcasts the
    ephemeris when it is small at run time)."""
    return obs.join(ephemeris, "object_id", "left")


def phase(time="time", period="period"):
    """Phase in [0, 1): (time mod period) / period with a non-negative modulo."""
    return F.pmod(F.col(time), F.col(period)) / F.col(period)


def in_transit(phase_col, duration="duration"):
    return phase_col < F.col(duration)


def model_flux(time="time", period="period", depth="depth", base="base_flux", transit=None):
    """base * (1 + 0.002 * sin(2 pi t / period) - depth * in_transit)."""
    transit = in_transit(phase(time, period)) if transit is None else transit
    variability = F.lit(VARIABILITY) * F.sin(F.lit(2.0 * math.pi) * F.col(time) / F.col(period))
    drop = F.when(transit, -F.col(depth)).otherwise(F.lit(0.0))
    return F.col(base) * (F.lit(1.0) + variability + drop)


def fold(df: DataFrame) -> DataFrame:
    """Adds phase, in_transit, model_flux and model_residual (flux - model)."""
    out = df.withColumn("phase", phase())
    out = out.withColumn("in_transit", in_transit(F.col("phase")))
    out = out.withColumn("model_flux", model_flux(transit=F.col("in_transit")))
    return out.withColumn("model_residual", F.col("flux") - F.col("model_flux"))


def quarter_from_time(time="time"):
    """(floor(time / 90) mod 18) + 1."""
    return (F.pmod(F.floor(F.col(time) / F.lit(float(QUARTER_DAYS))), F.lit(QUARTERS_PER_CYCLE)) + 1).cast("int")
