"""Unit conversion, rounding and scaling expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardframe.sources import codes


def charted_measure(itemid: Column, value: Column) -> Column:
    """Fahrenheit to Celsius and inch to centimetre, by item and threshold."""
    return (
        F.when(
            itemid.isin(*codes.FAHRENHEIT_ITEMS) & (value > codes.FAHRENHEIT_ABOVE),
            (value - 32) * 5 / 9,
        )
        .when(itemid.isin(*codes.INCH_ITEMS) & (value < codes.INCH_BELOW), value * 2.54)
        .otherwise(value)
    )


def charted_unit(unit: Column) -> Column:
    low = F.lower(unit)
    out = F.when(low == "inch", F.lit("cm"))
    for source in ("deg. f", "?f"):
        out = out.when(low == source, F.lit(codes.UNIT_LABELS[source]))
    return out.otherwise(unit)


def round_half_up(value: Column, digits: int) -> Column:
    """Round as a decimal (half away from zero), back to double."""
    return F.round(value.cast("decimal(28,6)"), digits).cast("double")


def round_half_even(value: Column, digits: int) -> Column:
    """NumPy-style rounding on the decimal value, back to double."""
    return F.bround(value.cast("decimal(28,6)"), digits).cast("double")


def dose_in_mg(itemid: Column, unit: Column, dose: Column) -> Column:
    low = F.lower(unit)
    return (
        F.when((low == "unit") & itemid.isin(*codes.HEPARIN_RX_ITEMS), dose * codes.DOSE_FACTOR_HEPARIN)
        .when((low == "unit") & itemid.isin(*codes.INSULIN_RX_ITEMS), dose * codes.DOSE_FACTOR_INSULIN)
        .when(low.isin("ml", "mg"), dose)
    )


def scale_to(value: Column, low: Column, high: Column, lo: float, hi: float) -> Column:
    """Min-max transform; a constant feature divides by one."""
    span = F.when(high == low, F.lit(1.0)).otherwise(high - low)
    return (value - low) / span * (hi - lo) + lo


def unscale_from(value: Column, low: Column, high: Column, lo: float, hi: float) -> Column:
    span = F.when(high == low, F.lit(1.0)).otherwise(high - low)
    return (value - lo) / (hi - lo) * span + low


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)
