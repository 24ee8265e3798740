"""Date, number and text scalars as Column expressions."""

from __future__ import annotations

import math
from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def decompose_datetime(df: DataFrame, columns: Mapping[str, str], only_epoch: tuple[str, ...] = (), drop: bool = False) -> DataFrame:
    """Adds <base>_year, _month, _day, _hour and _ts (epoch seconds) for each timestamp column -> base name."""
    for column, base in columns.items():
        c = F.col(column)
        if column not in only_epoch:
            for part, f in (("year", F.year), ("month", F.month), ("day", F.dayofmonth), ("hour", F.hour)):
                df = df.withColumn(f"{base}_{part}", f(c))
        df = df.withColumn(f"{base}_ts", F.unix_seconds(c.cast("timestamp")))
    return df.drop(*columns) if drop else df


def delivery_verdict(difference: Column) -> Column:
    """matched (0), overvalued (above), undervalued (below, and null)."""
    return F.when(difference == 0, "matched").when(difference > 0, "overvalued").otherwise("undervalued")


def over_under(value: Column) -> tuple[Column, Column]:
    """The parts above and below zero, as columns over and under."""
    return F.greatest(value, F.lit(0)).alias("over"), F.least(value, F.lit(0)).alias("under")


def late_flag(value: Column) -> Column:
    return F.when(value >= 0, 0).otherwise(1)


def delay_minutes(seconds: Column, compat: bool = False) -> Column:
    """Minutes of a duration; compat: the minute of the hour of that many seconds since the epoch."""
    return F.minute(F.timestamp_seconds(seconds)) if compat else seconds / 60


def delay_days(seconds: Column, compat: bool = False) -> Column:
    """Days of a duration; compat: the day of the month of that many seconds since the epoch (days + 1, wrapping; -5 s gives 31)."""
    return F.dayofmonth(F.timestamp_seconds(seconds)) if compat else seconds / 86400


def span_days(start: Column, end: Column) -> Column:
    """Whole 24-hour spans between two timestamps, floored (not calendar days)."""
    return F.floor((F.unix_seconds(end.cast("timestamp")) - F.unix_seconds(start.cast("timestamp"))) / 86400)


def seconds_to_time(seconds: Column) -> Column:
    """Seconds as text HH:mm:ss of the day."""
    return F.date_format(F.timestamp_seconds(seconds), "HH:mm:ss")


def run_time_text(time: Column) -> Column:
    """``H:M:S`` as "1 h 2 min 3 s" without the parts that are zero; seconds are rounded."""
    parts = F.split(time, ":")
    pieces = []
    for i, unit in enumerate(("h", "min", "s")):
        n = F.round(F.element_at(parts, i + 1).cast("double")).cast("int")
        pieces.append(F.when(n != 0, F.concat(n.cast("string"), F.lit(f" {unit}"))))
    return F.concat_ws(" ", *pieces)


def group_thousands(number: Column, compat: bool = False) -> Column:
    """Thousands set apart by a space, decimals kept. compat: the sign counts as a digit ("-100" becomes "- 100")."""
    text = number.cast("string")
    whole = F.regexp_extract(text, r"^(-?\d*)", 1)
    rest = F.regexp_extract(text, r"^-?\d*(.*)$", 1)
    ahead = r"(?<=[-\d])(?=(\d{3})+$)" if compat else r"(?<=\d)(?=(\d{3})+$)"
    return F.concat(F.regexp_replace(whole, ahead, " "), rest)


def largest_of(values: Mapping[str, Column]) -> Column:
    """The name of the largest value (ties the first named), null where none is above zero."""
    most = F.greatest(*values.values())
    out = F.lit(None).cast("string")
    for name, value in reversed(values.items()):
        out = F.when(value == most, name).otherwise(out)
    return F.when(most > 0, out)


def replace_words(text: Column, translator: Mapping[str, str]) -> Column:
    """Each key replaced by its value: one pass where all keys are single characters, else key after key."""
    if all(len(k) == 1 and len(v) == 1 for k, v in translator.items()):
        return F.translate(text, "".join(translator), "".join(translator.values()))
    for key, value in translator.items():
        text = F.replace(text, F.lit(key), F.lit(value))
    return text


#: Accented letters and what they are without accent.
ACCENTS = {"àáâãäåā": "a", "çćč": "c", "èéêëēė": "e", "ìíîïī": "i", "ñń": "n", "òóôõöøō": "o", "šś": "s", "ùúûüū": "u", "ýÿ": "y", "žź": "z"}


#: Ligatures and what they are written out.
LIGATURES = (("œ", "oe"), ("Œ", "OE"), ("æ", "ae"), ("Æ", "AE"), ("ß", "ss"))


def accent_map() -> dict[str, str]:
    """Each accented letter, small and capital, and its plain one."""
    plain = {c: base for group, base in ACCENTS.items() for c in group}
    return plain | {c.upper(): base.upper() for c, base in plain.items() if len(c.upper()) == 1}


def strip_accents(text: Column, lower: bool = False) -> Column:
    """Latin letters without accents; ligatures written out."""
    plain = accent_map()
    out = F.translate(text, "".join(plain), "".join(plain.values()))
    for a, b in LIGATURES:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.lower(out) if lower else out


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, unit: str = "m") -> Column:
    """Great-circle distance in m or km on the mean sphere (within 0.5 % of the ellipsoid)."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371008.8 * F.asin(F.sqrt(F.least(h, F.lit(1.0)))) / (1000 if unit == "km" else 1)


def lambert93(lat: Column, lon: Column) -> tuple[Column, Column]:
    """WGS 84 degrees to Lambert-93 metres (x, y), in closed form."""
    # The GRS 80 ellipsoid and the parameters of the projection
    e, n, c, xs, ys, lon0 = 0.08181919112, 0.7256077650, 11754255.426, 700000.0, 12655612.050, 3.0
    phi = F.radians(lat)
    iso = F.log(F.tan(phi / 2 + math.pi / 4)) - e / 2 * F.log((1 + e * F.sin(phi)) / (1 - e * F.sin(phi)))
    r = c * F.exp(-n * iso)
    g = n * F.radians(lon - lon0)
    return xs + r * F.sin(g), ys - r * F.cos(g)


def from_lambert93(x: Column, y: Column) -> tuple[Column, Column]:
    """Lambert-93 metres back to WGS 84 degrees (lat, lon)."""
    # The GRS 80 ellipsoid and the parameters of the projection
    e, n, c, xs, ys, lon0 = 0.08181919112, 0.7256077650, 11754255.426, 700000.0, 12655612.050, 3.0
    r = F.sqrt(F.pow(x - xs, 2) + F.pow(y - ys, 2))
    lift = F.exp(-F.log(r / c) / n)

    def step(phi: Column, _: Column) -> Column:
        return 2 * F.atan(F.pow((1 + e * F.sin(phi)) / (1 - e * F.sin(phi)), e / 2) * lift) - math.pi / 2

    lat = F.aggregate(F.sequence(F.lit(1), F.lit(8)), 2 * F.atan(lift) - math.pi / 2, step)
    return F.degrees(lat), lon0 + F.degrees(F.atan((x - xs) / (ys - y))) / n


@F.pandas_udf(T.DoubleType())
def _vincenty(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.Series:
    a, f, rounds = 6378137.0, 1 / 298.257223563, 12  # Fixed values: the WGS 84 ellipsoid
    b = a * (1 - f)
    u1, u2 = (np.arctan((1 - f) * np.tan(np.radians(p.to_numpy(float)))) for p in (lat1, lat2))
    su1, cu1, su2, cu2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    across = np.radians(lon2.to_numpy(float) - lon1.to_numpy(float))
    lam = across
    for left in range(rounds, -1, -1):
        ss = np.hypot(cu2 * np.sin(lam), cu1 * su2 - su1 * cu2 * np.cos(lam))
        cs = su1 * su2 + cu1 * cu2 * np.cos(lam)
        sa = np.divide(cu1 * cu2 * np.sin(lam), ss, out=np.zeros_like(ss), where=ss != 0)
        c2a = 1 - sa * sa
        cm = cs - np.divide(2 * su1 * su2, c2a, out=np.zeros_like(ss), where=c2a != 0)
        if left:
            c = f / 16 * c2a * (4 + f * (4 - 3 * c2a))
            lam = across + (1 - c) * f * sa * (np.arctan2(ss, cs) + c * ss * (cm + c * cs * (2 * cm * cm - 1)))
    u = c2a * (a * a - b * b) / (b * b)
    big = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
    small = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
    delta = small * ss * (cm + small / 4 * (cs * (2 * cm * cm - 1) - small / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))
    return pd.Series(b * big * (np.arctan2(ss, cs) - delta))


def vincenty(lat1: Column, lon1: Column, lat2: Column, lon2: Column, unit: str = "m") -> Column:
    """Distance along the WGS 84 ellipsoid by twelve rounds of Vincenty's iteration, 0 for equal points; not for points on opposite
    sides of the globe. Rounds feed into each other, which as one Column expression would grow with every round: numpy in Arrow batches."""
    return _vincenty(*[c.cast("double") for c in (lat1, lon1, lat2, lon2)]) / (1000 if unit == "km" else 1)


def parse_address(text: Column) -> Column:
    """A location text in any of its notations (JSON, or the same with single quotes and a nested JSON text) as a struct
    latitude, longitude, address, city, state, zip; null where nothing can be read."""
    clean = F.regexp_replace(text, r"\\\"", '"')
    clean = F.regexp_replace(clean, r"[\"']\{", "{")
    clean = F.regexp_replace(clean, r"\}[\"']", "}")
    clean = F.regexp_replace(clean, "'", '"')
    shape = "latitude string, longitude string, human_address struct<address: string, city: string, state: string, zip: string>"
    v = F.from_json(clean, shape)
    a = v["human_address"]
    return F.when(v["latitude"].isNotNull() | a.isNotNull(), F.struct(v["latitude"].cast("double").alias("latitude"), v["longitude"].cast("double").alias("longitude"), a["address"].alias("address"), a["city"].alias("city"), a["state"].alias("state"), a["zip"].alias("zip")))
