"""Header normalisation, column resolution and required-column checks."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.cleaning import mask_sentinels


def snake(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", name.strip().lower()).strip("_") or "unnamed"


def normalise_headers(df: DataFrame) -> DataFrame:
    """snake_case names; repeats get _2, _3 ...."""
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        base = snake(c)
        seen[base] = seen.get(base, 0) + 1
        names.append(base if seen[base] == 1 else f"{base}_{seen[base]}")
    return df.toDF(*names)


def require_columns(df: DataFrame, required: Sequence[str], table: str) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{table} lacks required columns {missing}")
    return df


def project(df: DataFrame, required: Sequence[str], optional: Sequence[str] = (), table: str = "input") -> DataFrame:
    """Required plus present optional columns, so nothing else is read."""
    require_columns(df, required, table)
    return df.select(*required, *[c for c in optional if c in df.columns])


def resolve(columns: Sequence[str], aliases: Mapping[str, Sequence[str]]) -> dict[str, str | None]:
    """Canonical name -> first alias that exists, compared without case and punctuation."""
    bare = lambda s: re.sub(r"[^a-z0-9]", "", s.lower())
    have: dict[str, str] = {}
    for c in columns:
        have.setdefault(bare(c), c)
    return {name: next((have[bare(a)] for a in tries if bare(a) in have), None) for name, tries in aliases.items()}


def rename_resolved(df: DataFrame, aliases: Mapping[str, Sequence[str]], table: str = "input", required: Sequence[str] = ()) -> DataFrame:
    found = resolve(df.columns, aliases)
    require_columns(df.select(*[F.col(c).alias(n) for n, c in found.items() if c]), required, table)
    return df.withColumnsRenamed({c: n for n, c in found.items() if c})


@dataclass(frozen=True)
class Resolver:
    """How the columns of one kind of table are found: their names, what makes two names equal, which are needed."""

    aliases: Mapping[str, Sequence[str]]
    same: Callable[[str], str]
    required: Sequence[str] = ()
    last_wins: bool = False

    def find(self, columns: Sequence[str]) -> dict[str, str | None]:
        """Canonical name -> column. Of columns with equal names the first counts, or the last if so set."""
        have: dict[str, str] = {}
        for c in columns if not self.last_wins else reversed(columns):
            have.setdefault(self.same(c), c)
        return {name: next((have[self.same(a)] for a in tries if self.same(a) in have), None) for name, tries in self.aliases.items()}

    def apply(self, df: DataFrame, table: str = "input") -> DataFrame:
        """The found columns under their canonical names, nothing else; fails if a required one is missing."""
        found = {n: c for n, c in self.find(df.columns).items() if c is not None}
        missing = [n for n in self.required if n not in found]
        if missing:
            raise ValueError(f"{table} lacks required columns {missing}")
        return df.select(*[F.col("`" + c.replace("`", "``") + "`").alias(n) for n, c in found.items()])


def bare(name: str) -> str:
    return re.sub(r"[^a-z0-9]", "", name.strip().lower())


#: Requests compare by words, and a later column hides an earlier one of equal name; parcels by letters and digits alone.
RESOLVERS = {
    "requests": Resolver(fv.REQUEST_COLUMNS, snake, ("created_date", "complaint_type", "nta2020"), last_wins=True),
    "poi": Resolver(fv.POI_COLUMNS, snake, ("nta2020",)),
    "parcels": Resolver(fv.PARCEL_COLUMNS, bare, ("nta2020",)),
}


# fixed values: weather column names per family, then fallback name patterns
WEATHER_NAMES = {
    "tmax": ["tmax", "max_temp", "maximum_temperature"],
    "tmin": ["tmin", "min_temp", "minimum_temperature"],
    "tavg": ["tavg", "tavg_est", "avg_temp", "mean_temp"],
    "prcp": ["prcp", "precipitation", "rainfall"],
    "snow": ["snow", "snowfall"],
    "snwd": ["snwd", "snow_depth"],
    "awnd": ["awnd", "wind_speed", "avg_wind_speed", "average_wind_speed"],
}
WEATHER_NAME_PATTERNS = {
    "tmax": r"(^|_)tmax($|_)|max_*temp|temp_*max|maximum_*temperature",
    "tmin": r"(^|_)tmin($|_)|min_*temp|temp_*min|minimum_*temperature",
    "tavg": r"(^|_)tavg($|_)|avg_*temp|temp_*avg|mean_*temp|average_*temperature",
    "prcp": r"(^|_)prcp($|_)|precip|rainfall|(^|_)rain($|_)",
    "snow": r"(^|_)snow($|_)|snowfall",
    "snwd": r"(^|_)snwd($|_)|snow_*depth",
    "awnd": r"(^|_)awnd($|_)|avg_*wind|average_*wind|wind_*speed|(^|_)wspd($|_)",
}
WEATHER_EXCLUDED = r"flag|attribute|quality|station|name|id$|identifier|source|datatype|units?"
WEATHER_DERIVED = r"(^|_)(day|days|count|counts|flag|indicator|event|events|hot|cold|ice|rain|snow|heavy|moderate|very)(_|$)"


def valid_shares(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Share of usable numbers per column, one aggregate for all."""
    if not columns:
        return {}
    row = df.agg(*[F.avg(mask_sentinels(F.col(f"`{c}`")).isNotNull().cast("int")).alias(c) for c in columns]).first()
    return {c: row[c] or 0.0 for c in columns}


def weather_columns(df: DataFrame, min_valid: float = 0.01) -> dict[str, list[str]]:
    """Columns of each weather family: known names first, else name patterns without flags and derived columns."""
    by_snake = {c: snake(c) for c in df.columns}
    known = {f: [c for c, s in by_snake.items() if s in names] for f, names in WEATHER_NAMES.items()}
    guess = {
        f: [
            c
            for c, s in by_snake.items()
            if re.search(p, s) and not re.search(WEATHER_EXCLUDED, s) and not re.search(WEATHER_DERIVED, s)
        ]
        for f, p in WEATHER_NAME_PATTERNS.items()
    }
    shares = valid_shares(df, sorted({c for g in (*known.values(), *guess.values()) for c in g}))
    usable = lambda cols: [c for c in cols if shares[c] >= min_valid]
    found = {f: usable(known[f]) or usable(guess[f]) for f in fv.WEATHER_FAMILIES}
    return {f: cols for f, cols in found.items() if cols}
