"""Column expressions that turn raw detection fields (all strings) into typed values with reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Source header (trimmed, lower case) -> canonical column.
COLUMN_ALIASES = {
    "latitude": "latitude", "lat": "latitude", "y": "latitude",
    "longitude": "longitude", "lon": "longitude", "long": "longitude", "lng": "longitude", "x": "longitude",
    "frp": "frp", "fire_radiative_power": "frp", "power": "frp",
    "bright_ti4": "bright_ti4", "bright_ti5": "bright_ti5", "bright_t31": "bright_t31", "bright_t4": "bright_ti4",
    "brightness": "brightness_temperature", "brightness_temperature": "brightness_temperature",
    "bright_temp": "brightness_temperature", "bt": "brightness_temperature",
    "ti4": "bright_ti4", "ti5": "bright_ti5", "t31": "bright_t31",
    "confidence": "confidence", "conf": "confidence", "conf_a": "confidence",
    "acq_date": "acq_date", "acq_time": "acq_time", "acq_datetime": "acq_datetime", "timestamp": "timestamp",
    "datetime": "acq_datetime", "date": "acq_date", "time": "acq_time",
    "satellite": "satellite", "sat": "satellite", "instrument": "instrument", "sensor": "instrument",
    "daynight": "daynight", "scan": "scan", "track": "track", "version": "version",
}
# Column groups of which every input has one.
REQUIRED_GROUPS = [["latitude", "lat", "y"], ["longitude", "lon", "long", "lng", "x"],
                   ["acq_date", "acq_datetime", "timestamp", "datetime", "date"]]
# Brightness temperature sources, best first.
BT_PRIORITY = ["bright_ti4", "bright_ti5", "bright_t31", "brightness_temperature"]
# Confidence codes on the percent scale and on the unit scale.
CONFIDENCE_PERCENT = {"l": 30.0, "n": 60.0, "h": 90.0}
CONFIDENCE_UNIT = {"l": 0.33, "low": 0.33, "n": 0.66, "nominal": 0.66, "h": 1.0, "high": 1.0}


class SchemaError(ValueError):
    """The input lacks a column group that every detection needs."""


def alias_columns(df: DataFrame) -> DataFrame:
    """Canonical headers; two sources of one column merge by first non-blank, unknown headers stay (lower case)."""
    sources: dict[str, list[str]] = {}
    for raw in df.columns:
        key = raw.lstrip("﻿").strip().lower()
        sources.setdefault(COLUMN_ALIASES.get(key, key), []).append(raw)

    def merged(names: list[str]) -> Column:
        cols = [F.col(f"`{n}`") for n in names]
        return cols[0] if len(cols) == 1 else F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cols])

    return df.select(*[merged(names).alias(target) for target, names in sources.items()])


def require_groups(df: DataFrame) -> DataFrame:
    """Raise when latitude, longitude or time cannot be derived from the columns."""
    require_columns(df.columns)
    return df


def require_columns(columns: list[str]) -> None:
    missing = [group for group in REQUIRED_GROUPS if not set(group) & set(columns)]
    if missing:
        raise SchemaError("missing column(s): " + "; ".join(f"need one of {g}" for g in missing)
                          + f"; present: {sorted(columns)}")


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def to_double(c: Column) -> Column:
    """Number or NULL; a Java type suffix (``1d``) is not a number here."""
    text = F.trim(c)
    return F.when(~text.rlike(r"(?i)^[+-]?[0-9.]+(e[+-]?[0-9]+)?[df]$"), text.try_cast("double"))


def _quoted(c: Column) -> Column:
    return F.concat(F.lit("'"), c, F.lit("'"))


def number(c: Column, field: str) -> tuple[Column, Column]:
    """(value, reason): reason is NULL when the value is usable."""
    text, value = blank_to_null(c), to_double(c)
    # The usable case comes first: it shares the parse with the value column.
    reason = (F.when(value.isNotNull() & ~F.isnan(value), F.lit(None).cast("string"))
              .when(text.isNull(), F.lit(f"missing {field}"))
              .when(value.isNull(), F.concat(F.lit(f"malformed {field}: "), _quoted(c)))
              .otherwise(F.lit(f"NaN {field}")))
    return value, reason


def _lookup(c: Column, table: dict[str, float]) -> Column:
    out = None
    for key, value in table.items():
        out = F.when(c == key, F.lit(value)) if out is None else out.when(c == key, F.lit(value))
    return out


def confidence_percent(c: Column) -> tuple[Column, Column]:
    """l/n/h or 0-100 (fractions are kept as they are) -> percent, with reason."""
    code = F.lower(F.trim(c))
    value = F.coalesce(_lookup(code, CONFIDENCE_PERCENT), to_double(c))
    reason = (F.when(blank_to_null(c).isNull(), F.lit("missing confidence"))
              .when(value.isNull() | F.isnan(value), F.concat(F.lit("malformed confidence: "), _quoted(c)))
              .when(~value.between(0, 100), F.concat(F.lit("confidence out of range 0-100: "), _quoted(c))))
    return F.when(reason.isNull(), value), reason


def confidence_unit(c: Column) -> Column:
    return F.coalesce(_lookup(F.lower(c), CONFIDENCE_UNIT), F.lit(0.5))


def _optional(df_columns: list[str], name: str) -> Column:
    return F.col(name) if name in df_columns else F.lit(None).cast("string")


def acquisition_time(columns: list[str]) -> tuple[Column, Column]:
    """UTC instant from an ISO field, else from date (``-`` or ``/``) plus ``HHMM`` or ``H:M[:S]``, with reason."""
    iso = None
    for name in ("acq_datetime", "timestamp"):
        text = F.trim(_optional(columns, name))
        parsed = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}([T ].*)?$"), F.try_to_timestamp(text))
        iso = parsed if iso is None else F.coalesce(iso, parsed)

    date_text = blank_to_null(_optional(columns, "acq_date"))
    day = F.when(date_text.rlike(r"^\d{4}(-\d{1,2}-\d{1,2}|/\d{1,2}/\d{1,2})$"),
                 F.replace(date_text, F.lit("/"), F.lit("-")).try_cast("date"))

    raw_time = F.coalesce(F.trim(_optional(columns, "acq_time")), F.lit("0000"))
    clock = (F.when(raw_time.rlike(r"^\d{0,4}$"), F.regexp_replace(F.lpad(raw_time, 4, "0"), r"^(..)(..)$", "$1:$2:00"))
             .when(raw_time.rlike(r"^\d+:\d+$"), F.concat(raw_time, F.lit(":00")))
             .when(raw_time.rlike(r"^\d+:\d+:\d+(\.\d*)?$"), F.regexp_replace(raw_time, r"\.\d*$", "")))
    built = F.try_to_timestamp(F.concat_ws(" ", day.cast("string"), clock), F.lit("yyyy-MM-dd H:m:s"))
    ts = F.coalesce(iso, built)
    reason = (F.when(ts.isNotNull(), F.lit(None).cast("string"))
              .when(date_text.isNull(), F.lit("missing acq_date"))
              .when(day.isNull(), F.concat(F.lit("malformed acq_date: "), _quoted(date_text)))
              .when(clock.isNull(), F.concat(F.lit("malformed acq_time: "), _quoted(raw_time)))
              .otherwise(F.concat(F.lit("acq_time out of range: "), _quoted(raw_time))))
    return ts, reason


def brightness(columns: list[str]) -> tuple[Column, Column]:
    """(value, source column): first parsable source in priority order."""
    value = source = None
    for name in BT_PRIORITY:
        if name not in columns:
            continue
        v = to_double(F.col(name))
        value = v if value is None else F.coalesce(value, v)
        source = F.when(v.isNotNull(), F.lit(name)) if source is None else source.when(v.isNotNull(), F.lit(name))
    none = F.lit(None)
    return (none.cast("double"), none.cast("string")) if value is None else (value, source)


def satellite_name(columns: list[str]) -> Column:
    """Satellite, else instrument, else VIIRS, in canonical spelling."""
    raw = F.coalesce(blank_to_null(_optional(columns, "satellite")), blank_to_null(_optional(columns, "instrument")))
    low = F.lower(raw)
    return (F.when(raw.isNull() | low.isin("viirs", "v", "n", "j1", "npp"), F.lit("VIIRS"))
            .when(low.isin("terra", "aqua"), F.concat(F.lit("MODIS_"), F.upper(raw)))
            .otherwise(F.upper(raw)))


def detection_id(satellite: Column, ts: Column, lat: Column, lon: Column) -> Column:
    """FIRMS_ plus 8 hex digits over satellite, UTC second and 5-decimal coordinates."""
    payload = F.concat_ws("|", satellite, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"),
                          F.format_string("%.5f", lat), F.format_string("%.5f", lon))
    return F.concat(F.lit("FIRMS_"), F.upper(F.substring(F.sha1(payload), 1, 8)))
