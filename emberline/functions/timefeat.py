"""Time, radiometric and activity expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.cleaning import confidence_unit


def time_features(df: DataFrame, ts: str = "ts") -> DataFrame:
    """hour_utc, day_of_week (Monday 0), month, date and year-month."""
    return df.withColumns({
        "hour_utc": F.hour(ts), "day_of_week": F.weekday(ts), "month": F.month(ts), "date": F.to_date(ts),
        "year_month": F.date_format(ts, "yyyy-MM")})


def daynight_from_hour(hour: Column) -> Column:
    return F.when(hour.between(6, 18), "D").otherwise("N")


def daynight(events: DataFrame, recovered: DataFrame | None, id_col: str = "id", ts: str = "ts") -> DataFrame:
    """Add ``daynight``: the recovered D/N by detection id (last row wins), else from the hour.

    ``recovered``: id, daynight and an ordering column ``_row``.
    """
    guess = daynight_from_hour(F.hour(ts))
    if recovered is None:
        return events.withColumn("daynight", guess)
    known = (recovered.groupBy(F.col(id_col)).agg(F.max_by(F.upper(F.trim("daynight")), "_row").alias("_dn")))
    joined = events.join(known, id_col, "left")
    return joined.select(*events.columns, F.when(F.col("_dn").isin("D", "N"), F.col("_dn")).otherwise(guess)
                         .alias("daynight"))


def radiometric(df: DataFrame) -> DataFrame:
    """Channel contrast, log FRP, night flag, unit confidence and hour from raw tracker columns."""
    return df.withColumns({
        "temp_diff_ti4_ti5": F.col("bright_ti4") - F.col("bright_ti5"),
        "log_frp": F.log1p(F.greatest(F.lit(0.0), F.col("frp"))),
        "is_night": F.coalesce((F.upper("daynight") == "N").cast("int"), F.lit(0)),
        "confidence_numeric": confidence_unit(F.col("confidence")),
        "acq_hour": F.substring(F.lpad(F.col("acq_time").cast("string"), 4, "0"), 1, 2).try_cast("int")})


def persistence_score(d24: Column, d7: Column) -> Column:
    """0-1 score from detections in 24 h and 7 d."""
    linear = F.least(F.lit(1.0), d7 / 10.0 * 0.7 + d24 / 5.0 * 0.3)
    saturating = (F.lit(1.0) - F.exp(F.lit(-0.35) * d7)) * 0.8
    return (F.when((d7 == 0) & (d24 == 0), F.lit(0.0))
            .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.greatest(linear, saturating)))))


def activity_anomaly(baseline: Column, current: Column) -> tuple[Column, Column]:
    """(anomaly, ratio) of the activity baseline: NULL when both are 0."""
    anomaly = (F.when(baseline > 0, (current - baseline) / F.nullif(baseline, F.lit(0.0)))
               .when(current > 0, current))
    return anomaly, F.when(baseline > 0, current / F.nullif(baseline, F.lit(0.0)))


def anomaly_level(baseline: Column, current: Column, anomaly: Column) -> Column:
    return (F.when(baseline.isNull() | current.isNull(), "unknown")
            .when(baseline == 0, F.when(current > 3, "high").when(current != 0, "moderate").otherwise("unknown"))
            .when(anomaly.isNull(), "unknown").when(anomaly >= 5, "critical").when(anomaly >= 2, "high")
            .when(anomaly >= 0.5, "moderate").otherwise("low"))
