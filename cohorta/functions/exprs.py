"""Column expressions: NaN handling, seasons, bands, status, encodings, angles and map projection."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Season names by month, and the age bands with their upper bounds.
SEASONS = {"Hiver": (12, 1, 2), "Printemps": (3, 4, 5), "Été": (6, 7, 8), "Automne": (9, 10, 11)}
AGE_EDGES = (0, 35, 50, 65, 80, 120)
AGE_LABELS = ("0-35", "36-50", "51-65", "66-80", "81+")
# Daily limits by pollutant.
EU_LIMITS = {"PM10": 50.0, "O3": 180.0, "NO2": 200.0}
WHO_LIMITS = {"PM25": 15.0, "PM10": 45.0, "NO2": 25.0, "O3": 100.0}
STANDARDS = {"EU": EU_LIMITS, "WHO": WHO_LIMITS}


class MissingColumns(ValueError):
    """A table lacks columns that an operator needs."""


def require_columns(df: DataFrame, names: Sequence[str]) -> None:
    if lacking := [n for n in names if n not in df.columns]:
        raise MissingColumns(f"lacks {', '.join(lacking)}; has {', '.join(df.columns)}")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in float columns becomes NULL, so that comparisons and aggregates skip it."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[F.nanvl(F.col(f"`{c}`"), F.lit(None)).alias(c) if c in floats else F.col(f"`{c}`") for c in df.columns])


def season(d: Column) -> Column:
    return reduce(lambda out, kv: out.when(F.month(d).isin(*kv[1]), kv[0]), list(SEASONS.items())[1:], F.when(F.month(d).isin(*SEASONS["Hiver"]), "Hiver"))


def season_year(d: Column) -> Column:
    """The year a season counts for: December belongs to the next one."""
    return F.year(d) + (F.month(d) == 12).cast("int")


def band(x: Column, edges: Sequence[float] = AGE_EDGES, labels: Sequence[str] = AGE_LABELS, closed: str = "right") -> Column:
    """Label of the interval that holds x, closed on the right or the left; NULL outside."""
    if closed not in ("right", "left"):
        raise ValueError(f"closed is right or left, not {closed}")
    inside = (lambda lo, hi: (x > lo) & (x <= hi)) if closed == "right" else (lambda lo, hi: (x >= lo) & (x < hi))
    out = F.lit(None).cast("string")
    for lo, hi, label in zip(edges, edges[1:], labels):
        out = F.when(inside(lo, hi), label).otherwise(out)
    return out


def censored_status(status: Column, news: Column, end: str, yes: str = "oui", no: str = "non") -> Column:
    """A 'yes' dated after the study's end counts as 'no'."""
    return F.when((status == yes) & (news > F.lit(end).cast("date")), no).otherwise(status)


def flag_or_zero(status: Column, yes: str = "oui") -> Column:
    """1 for yes, 0 for anything else, NULL included."""
    return F.when(status == yes, 1).otherwise(0)


def flag_or_null(status: Column, yes: str = "oui", no: str = "non") -> Column:
    """1 for yes, 0 for no, NULL for anything else."""
    return F.when(status == yes, 1).when(status == no, 0)


def flag_by(status: Column, mapping: dict[str, int], other: int | None = None) -> Column:
    """The number that ``mapping`` gives a status, compared without case; ``other`` for the rest, NULL included."""
    out = F.lit(other).cast("int")
    for k, v in mapping.items():
        out = F.when(F.lower(status) == k.lower(), v).otherwise(out)
    return out


def outcome_count(df: DataFrame, status: str, yes: str = "oui") -> Column:
    """Aggregate: rows whose status is ``yes`` where it is text, or not 0 where it is a number or a boolean."""
    hit = F.col(status) == yes if isinstance(df.schema[status].dataType, T.StringType) else F.col(status).cast("double") != 0
    return F.count_if(F.coalesce(hit, F.lit(False)))


def age(birth: Column, at: Column) -> Column:
    """Difference of the years, as the study counts age."""
    return F.year(at) - F.year(birth)


def same_text(a: Column, b: Column | str) -> Column:
    """Equal but for case and outer blanks."""
    plain = lambda c: F.lower(F.trim(c if isinstance(c, Column) else F.lit(c)))
    return plain(a) == plain(b)


def without_prefix(x: Column, prefix: str) -> Column:
    """``x`` without ``prefix`` where it begins so."""
    return F.when(x.startswith(prefix), F.substr(x, F.lit(len(prefix) + 1), F.length(x))).otherwise(x)


def interaction(*x: Column) -> Column:
    """Product of columns; NULL if any is."""
    return reduce(lambda a, b: a * b, [c.cast("double") for c in x])


def critical_state(month: Column, year: Column, ref: Column, dead: Column) -> Column:
    return F.when((month == F.month(ref)) & (year == F.year(ref)) & (dead == 1), 1).otherwise(0)


def months_between_whole(a: Column, b: Column) -> Column:
    return (F.year(a) - F.year(b)) * 12 + F.month(a) - F.month(b)


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def kelvin_to_celsius(t: Column) -> Column:
    return t - F.lit(273.15)


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def angle_degrees(x: Column, y: Column) -> Column:
    """Direction of (x, y) in [0, 360)."""
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def safe_name(x: Column) -> Column:
    return F.translate(x, " /\\'", "____")


def days_in_month(d: Column) -> Column:
    return F.dayofmonth(F.last_day(d))


def parse_date(x: Column, fmt: str = "yyyy-MM-dd") -> Column:
    """NULL where the text is no such date."""
    return F.try_to_timestamp(x, F.lit(fmt)).cast("date")


def to_number(x: Column) -> Column:
    return x.try_cast("bigint")


def only_in_reference_month(df: DataFrame, columns: Sequence[str], year: str, month: str, ref: str) -> DataFrame:
    """Values of ``columns`` are kept in the reference's month and year and are NULL elsewhere."""
    same = (F.col(year) == F.year(ref)) & (F.col(month) == F.month(ref))
    return df.withColumns({c: F.when(same, F.col(c)) for c in columns})


def one_hot(df: DataFrame, column: str, levels: Sequence, reference=None) -> DataFrame:
    """A 0/1 column for each level but the reference (the first where none is named)."""
    skip = levels[0] if reference is None else reference
    return df.withColumns({f"{column}_{v}": (F.col(column) == F.lit(v)).cast("int") for v in levels if v != skip})


def label_encode(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """Rank of the value among the sorted distinct values, from 0. The distinct values are joined back, not windowed over all rows."""
    from pyspark.sql import Window

    codes = df.select(column).where(F.col(column).isNotNull()).distinct().withColumn(out or f"{column}_code", F.row_number().over(Window.orderBy(column)) - 1)
    return df.join(codes, column, "left")


def impute(df: DataFrame, medians: Sequence[str] = (), means: Sequence[str] = (), modes: Sequence[str] = ()) -> DataFrame:
    """NULLs replaced by the exact median, the mean, or the most frequent value (the smallest of equals), in one pass."""
    made = [F.median(c).alias(c) for c in medians] + [F.avg(c).alias(c) for c in means]
    row = df.agg(*made).first().asDict() if made else {}
    for c in modes:
        top = df.where(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).first()
        row[c] = top[c] if top else None
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in row.items() if v is not None})


# The GRS80 ellipsoid and the parameters of Lambert-93 (EPSG:2154).
_A, _F = 6378137.0, 1 / 298.257222101
_LAT1, _LAT2, _LAT0, _LON0, _FE, _FN = 44.0, 49.0, 46.5, 3.0, 700000.0, 6600000.0


def lambert93(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Lambert-93 metres of degrees: a conformal conic with two standard parallels, in closed form."""
    e = math.sqrt(2 * _F - _F * _F)

    def m(p: float) -> float:
        return math.cos(p) / math.sqrt(1 - (e * math.sin(p)) ** 2)

    def t(p: float) -> float:
        return math.tan(math.pi / 4 - p / 2) / ((1 - e * math.sin(p)) / (1 + e * math.sin(p))) ** (e / 2)

    p1, p2, p0 = (math.radians(x) for x in (_LAT1, _LAT2, _LAT0))
    n = (math.log(m(p1)) - math.log(m(p2))) / (math.log(t(p1)) - math.log(t(p2)))
    scale = m(p1) / (n * t(p1) ** n) * _A
    p = F.radians(lat)
    s = F.sin(p) * e
    tp = F.tan(F.lit(math.pi / 4) - p / 2) / F.pow((1 - s) / (1 + s), F.lit(e / 2))
    r, theta = F.lit(scale) * F.pow(tp, F.lit(n)), F.lit(n) * (F.radians(lon) - math.radians(_LON0))
    return _FE + r * F.sin(theta), _FN + scale * t(p0) ** n - r * F.cos(theta)
