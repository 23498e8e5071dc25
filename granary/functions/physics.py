"""Unit standardisation that depends on a column's own statistics, derived targets, and acceleration factors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOLTZMANN_EV = 8.617333262e-5


def column_statistics(df: DataFrame, columns: dict[str, float]) -> dict[str, float | None]:
    """A percentile of each column, all in one pass; one row reaches the driver."""
    row = df.agg(*(F.percentile(c, p).alias(c) for c, p in columns.items())).first()
    return row.asDict()


def standardize_temperature(df: DataFrame, c: str) -> Column:
    """Kelvin: as it is if the median lies in 250..400, shifted if in -50..150, else all null."""
    median = column_statistics(df, {c: 0.5})[c]
    if median is not None and 250 <= median <= 400:
        return F.col(c)
    return F.col(c) + 273.15 if median is not None and -50 <= median <= 150 else F.lit(None).cast("double")


def standardize_humidity(df: DataFrame, c: str) -> Column:
    """Per cent: fractions (95th percentile up to 1) times 100; kept from 0 to 100."""
    high = column_statistics(df, {c: 0.95})[c]
    x = F.col(c) * 100 if high is not None and high <= 1 else F.col(c)
    return F.when(x.between(0, 100), x)


def standardize_light(text: Column, number: Column) -> Column:
    """Suns from mW/cm2, W/m2 or bare numbers; dark is null; kept above 0 up to 20."""
    t = F.lower(F.coalesce(text, F.lit("")))
    x = F.when(t.contains("dark"), None).when(t.contains("mw/cm"), number / 100).when(t.contains("w/m2"), number / 1000).when(number > 10, number / 100).otherwise(number)
    return F.when((x > 0) & (x <= 20), x)


def fraction_to_percent(df: DataFrame, c: str) -> Column:
    high = column_statistics(df, {c: 0.95})[c]
    return F.col(c) * 100 if high is not None and high <= 1.5 else F.col(c)


def retention_percent(df: DataFrame, end: str, initial: str) -> Column:
    """End over initial in per cent where the end values look absolute and the result lies in 0..150, else the end value as per cent."""
    high = column_statistics(df, {end: 0.95})[end]
    plain = F.col(end) * 100 if high is not None and high <= 1.5 else F.col(end)
    if high is None or high <= 2:
        return plain
    derived = F.when(F.col(initial) > 0, F.try_divide(F.col(end), F.col(initial)) * 100)
    return F.when(derived.between(0, 150), derived).otherwise(plain)


def log1p_target(c: Column) -> Column:
    return F.when(c >= 0, F.log1p(c))


def threshold_label(value: Column, threshold: float, gate: Column | None = None) -> Column:
    """1.0 or 0.0 by the threshold, null without a value or where the gate is not true."""
    known = value.isNotNull() if gate is None else value.isNotNull() & F.coalesce(gate, F.lit(False))
    return F.when(known, (value >= threshold).cast("double"))


def acceleration_factors(temperature: Column, humidity: Column, light: Column, energy_ev: float = 0.6, humidity_exponent: float = 1.0, light_exponent: float = 0.7, reference: tuple[float, float, float] = (298.15, 50.0, 1.0)) -> dict[str, Column]:
    """Arrhenius, humidity and light factors and their product; unknown conditions count as the reference."""
    t0, rh0, l0 = reference
    t, rh, light = F.coalesce(temperature, F.lit(t0)), F.coalesce(humidity, F.lit(rh0)), F.coalesce(light, F.lit(l0))
    exponent = F.lit(energy_ev / BOLTZMANN_EV) * (F.lit(1 / t0) - F.try_divide(F.lit(1.0), t))
    heat = F.exp(F.greatest(F.lit(-50.0), F.least(F.lit(50.0), exponent)))
    damp = F.when(rh <= rh0, 1.0).otherwise(F.pow(rh / rh0, F.lit(humidity_exponent)))
    shine = F.pow(light / l0, F.lit(light_exponent))
    return {"af_temperature": heat, "af_humidity": damp, "af_light": shine, "af_total": heat * damp * shine}


def observed_rate(retention: Column, exposure_h: Column, t80_h: Column, beta: float = 1.0, least_exposure_h: float = 1.0, retention_range: tuple[float, float] = (0.01, 0.999)) -> Column:
    """Decay rate an hour from the end retention where it is usable, else from T80."""
    by_end = retention.between(*retention_range) & (retention < 1) & (exposure_h >= least_exposure_h)
    by_t80 = t80_h >= least_exposure_h
    end = F.when(by_end, F.try_divide(F.pow(-F.ln(retention), F.lit(1 / beta)), exposure_h))
    return F.coalesce(end, F.when(by_t80, F.try_divide(F.pow(F.lit(0.22314355131420976), F.lit(1 / beta)), t80_h)))
