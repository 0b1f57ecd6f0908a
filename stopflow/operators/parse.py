"""Parsing of nested stop lists and coercion of text columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stopflow.functions import columns as C
from stopflow.functions import constants as K

WEATHER_MAP = T.MapType(T.StringType(), T.StringType())
STOP_FIELDS = ["stationShortCode", "type", "scheduledTime", "differenceInMinutes", "cancelled",
               "trainStopping", "commercialStop"]
STOP = T.StructType([T.StructField(f, T.StringType()) for f in STOP_FIELDS]
                    + [T.StructField("weather_observations", WEATHER_MAP)])
_OPTIONS = {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true", "mode": "PERMISSIVE"}


# A string in either kind of quotes, or what lies between strings.
_PIECE = r"""'[^'\\]*(?:\\.[^'\\]*)*'|"[^"\\]*(?:\\.[^"\\]*)*"|[^'"]+|['"]"""


def _words(outside: Column) -> Column:
    """Words of the feed as JSON words; outside strings they are values."""
    for word, token in (("nan", "null"), ("None", "null"), ("True", "true"), ("False", "false")):
        outside = F.replace(outside, F.lit(word), F.lit(token))
    return outside


def _json_tokens(cell: Column) -> Column:
    """The cell with the feed's words as JSON words; strings stay as they are.

    Where only plain single quotes occur, every other piece between them is a
    string; else the pieces are found one by one.
    """
    plain = F.array_join(F.transform(F.split(cell, "'"), lambda p, i: F.when(i % 2 == 0, _words(p)).otherwise(p)), "'")
    pieces = F.regexp_extract_all(cell, F.lit(_PIECE), F.lit(0))
    quoted = lambda p: p.startswith("'") | p.startswith('"')
    mixed = F.array_join(F.transform(pieces, lambda p: F.when(quoted(p), p).otherwise(_words(p))), "")
    return F.when(F.contains(cell, F.lit('"')) | F.contains(cell, F.lit("\\")), mixed).otherwise(plain)


def stop_list(cell: str | Column) -> Column:
    """Serialised list of stops to an array. The JSON reader takes a single stop as
    a list of one, so the rewritten text is used, and computed, only once."""
    return F.from_json(_json_tokens(C.col(cell)), T.ArrayType(STOP), _OPTIONS)


def parse_status(cell: str | Column, parsed: Column) -> Column:
    c = C.col(cell)
    return (F.when(c.isNull() | F.trim(c).isin("", "nan", "None"), "empty")
            .when(parsed.isNull(), "parse_error").otherwise("success"))


def with_stops(df: DataFrame, cell: str = "timeTableRows") -> DataFrame:
    out = df.withColumn("_stops", stop_list(cell))
    return out.withColumn("parse_status", parse_status(cell, F.col("_stops")))


def weather_field(weather: Column, name: str) -> Column:
    """Weather value under any of its known spellings."""
    return F.coalesce(*[F.try_element_at(weather, F.lit(k)) for k, v in K.FI_FIELDS.items() if v == name])


def explode_stops(df: DataFrame) -> DataFrame:
    """One row per stop. Stop fields win over train fields of the same name,
    weather fields over both; a train without stops keeps one row."""
    out = df.select("*", F.posexplode_outer("_stops").alias("stop_no", "_stop"))
    taken: dict[str, Column] = {}
    for field in STOP_FIELDS:
        value = F.col(f"_stop.{field}")
        if field in df.columns:
            value = F.when(F.col("_stop").isNotNull(), value).otherwise(F.col(field))
        taken[K.FI_FIELDS.get(field, field)] = value
    for name in ["air_temp", "wind_speed", "wind_gust", "precipitation_1h", "snow_depth", "cloud_cover",
                 "visibility", "dew_point", "humidity"]:
        taken[name] = weather_field(F.col("_stop.weather_observations"), name)
    base = [F.col(c).alias(K.FI_FIELDS.get(c, c)) for c in df.columns
            if c not in ("timeTableRows", "_stops", *STOP_FIELDS)]
    return out.select(*base, "stop_no", *[v.alias(k) for k, v in taken.items()])


def parse_log(parsed: DataFrame, file: str) -> DataFrame:
    """Per file: trains, stop rows, and outcomes of parsing."""
    rows = F.greatest(F.coalesce(F.size("_stops"), F.lit(0)), F.lit(1))
    return parsed.groupBy(file).agg(
        F.count(F.lit(1)).alias("n_trains"), F.sum(rows).alias("n_stops"),
        *[F.count_if(F.col("parse_status") == s).alias(a) for s, a in
          (("success", "n_success"), ("empty", "n_empty"), ("parse_error", "n_error"))])


def coerce(df: DataFrame, numbers: Sequence[str], booleans: Sequence[str] = (), dates: Sequence[str] = (),
           timestamps: Sequence[str] = ()) -> DataFrame:
    """Text to types; whatever cannot be read becomes NULL (booleans: false)."""
    return df.withColumns({
        **{c: F.trim(c).try_cast("float").cast("double") for c in numbers},
        **{c: C.tolerant_bool(c) for c in booleans},
        **{c: F.col(c).try_cast("date") for c in dates},
        **{c: F.col(c).try_cast("timestamp_ntz") for c in timestamps},
    })


def coercion_log(df: DataFrame, numbers: Sequence[str]) -> DataFrame:
    """Share of missing values per column after coercion. A text column counts
    as entirely missing before it."""
    kinds = dict(df.dtypes)
    aggs = [F.avg(F.trim(F.col(c).cast("string")).try_cast("float").isNull().cast("int")).alias(c) for c in numbers]
    after = df.agg(*aggs).unpivot([], list(numbers), "column", "nan_rate")
    before = [F.avg(F.col(c).isNull().cast("int")).alias(c) if kinds[c] != "string" else F.lit(1.0).alias(c) for c in numbers]
    left = df.agg(*before).unpivot([], list(numbers), "column", "nan_rate_before")
    return after.join(left, "column")


def rename_known(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rename headers; when two spellings of one name coexist, the first
    non-NULL value wins."""
    groups: dict[str, list[str]] = {}
    for c in df.columns:
        groups.setdefault(names.get(c, c), []).append(c)
    return df.select(*[F.coalesce(*[F.col(f"`{c}`") for c in cs]).alias(n) for n, cs in groups.items()])


def normalise_codes(df: DataFrame, alternatives: Sequence[str] = ("stationShortCode", "stationShortcode", "station_short_code")) -> DataFrame:
    """Station code from whichever column carries it, train type with a default."""
    present = [c for c in ("station_code", *alternatives) if c in df.columns]
    kind = C.code("train_type") if "train_type" in df.columns else F.lit("OTHER")
    out = df.withColumns({"station_code": C.code(F.coalesce(*[F.col(c) for c in present])), "train_type": kind})
    if "train_number" in df.columns:
        out = out.withColumn("train_number", F.col("train_number").try_cast("double"))
    return out.drop(*[c for c in present if c != "station_code"])
