"""Column-level building blocks: every function takes and returns Column
expressions, so whatever uses them stays inside whole-stage code generation."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from stopflow.functions import constants as K


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lookup(value: Column, table: dict) -> Column:
    """Literal map lookup; NULL for a key that is not in the map."""
    literal_map = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    return F.try_element_at(literal_map, value)


def truth(condition: Column) -> Column:
    """NULL counts as false, as a pandas comparison does."""
    return F.coalesce(condition, F.lit(False))


def flag(condition: Column) -> Column:
    return truth(condition).cast("int")


def r6(c: str | Column) -> Column:
    return F.round(col(c), 6)


# -- delays and cancellation -------------------------------------------------

def delay_value(raw: str | Column) -> Column:
    """Delay text to minutes: 'N', 'S' and anything unreadable become NULL."""
    return F.trim(col(raw)).try_cast("float").cast("double")


def delay_cancelled(raw: str | Column) -> Column:
    """The sentinel 'S' marks a suppressed stop."""
    return truth(F.trim(col(raw)) == "S")


def tolerant_bool(raw: str | Column, accept_digits: bool = True) -> Column:
    """Text to boolean; NULL and unknown text are false."""
    accepted = ["true", "1"] if accept_digits else ["true"]
    return truth(F.lower(col(raw).cast("string")).isin(accepted))


def any_of(*flags: Column) -> Column:
    out = truth(flags[0])
    for f in flags[1:]:
        out = out | truth(f)
    return out


def late(delay: str | Column, cancelled: str | Column | None = None,
         minutes: float = K.LATE_MINUTES) -> Column:
    """Stop label: delay above the threshold, or cancelled."""
    out = truth(col(delay) > minutes)
    if cancelled is not None:
        out = out | truth(col(cancelled))
    return out.cast("int")


# -- codes -------------------------------------------------------------------

def code(raw: str | Column) -> Column:
    return F.upper(F.trim(col(raw)))


def train_class(raw: str | Column) -> Column:
    return F.coalesce(lookup(code(raw), K.TRAIN_CLASS), F.lit(K.OTHER_CLASS))


def weather_text_severity(raw: str | Column, unknown_to: int | None = 0) -> Column:
    known = lookup(F.lower(F.trim(col(raw))), K.WEATHER_TEXT)
    return known if unknown_to is None else F.coalesce(known, F.lit(unknown_to))


def is_unknown_weather(raw: str | Column) -> Column:
    label = F.lower(F.trim(col(raw)))
    return truth(label.isNotNull() & (label != "nan") & lookup(label, K.WEATHER_TEXT).isNull())


def _steps(value: Column, cuts: list[tuple[float, int]]) -> Column:
    out = F.lit(0)
    for at_least, severity in cuts:
        out = F.when(value >= at_least, severity).otherwise(out)
    return out


def weather_severity(precipitation: str | Column, snow_depth: str | Column,
                     visibility: str | Column | None = None) -> Column:
    """Severity 0..4 from measurements; a missing measurement adds nothing."""
    parts = [
        _steps(F.coalesce(col(precipitation), F.lit(0.0)), K.PRECIP_CUTS),
        _steps(F.coalesce(col(snow_depth), F.lit(0.0)), K.SNOW_CUTS),
    ]
    if visibility is not None:
        fog = truth(col(visibility) < K.LOW_VISIBILITY_M)
        parts.append(F.when(fog, K.LOW_VISIBILITY_SEVERITY).otherwise(0))
    return F.greatest(*parts)


# -- numbers and dates in text -------------------------------------------------

def decimal_comma(raw: str | Column) -> Column:
    return F.replace(col(raw), F.lit(","), F.lit(".")).try_cast("double")


def digits_only(raw: str | Column) -> Column:
    return F.regexp_replace(col(raw), "[^0-9]", "").try_cast("double")


def first_number(raw: str | Column) -> Column:
    return F.regexp_extract(col(raw), r"(\d+)", 1).try_cast("double")


def slash_date(raw: str | Column) -> Column:
    """`yyyy/M/d`; invalid text becomes NULL."""
    return F.try_to_timestamp(col(raw), F.lit("yyyy/M/d")).cast("date")


# -- identifiers ----------------------------------------------------------------

def prefixed_id(country: str | Column, raw: str | Column, day: str | Column | None = None) -> Column:
    prefix = F.lit(f"{country}_") if isinstance(country, str) else F.concat(country, F.lit("_"))
    parts = [prefix, F.replace(col(raw).cast("string"), F.lit(" "), F.lit("_"))]
    if day is not None:
        parts += [F.lit("_"), F.date_format(col(day), "yyyy-MM-dd")]
    return F.concat(*parts)


def country_of(identifier: str | Column) -> Column:
    return F.substring(col(identifier), 1, 2)


def train_key(service_id: str | Column, country: str | Column) -> Column:
    """Train number without its country prefix and its date, per country."""
    number = F.regexp_replace(col(service_id), r"^[A-Z]{2}_", "")
    number = F.regexp_replace(number, r"_\d{4}-\d{2}-\d{2}$", "")
    return F.concat(col(country), F.lit("_"), number)


# -- fault texts ----------------------------------------------------------------

def fault_description(cause: str | Column, group: str | Column, width: int | None = None) -> Column:
    """The whole text; cut where a width is given."""
    text = F.concat(F.coalesce(col(cause), F.lit("nan")), F.lit(" | "),
                    F.coalesce(col(group), F.lit("nan")))
    return text if width is None else F.substring(text, 1, width)


def cause_group(description: str | Column) -> Column:
    """Text behind the first ' | '; the whole text when there is none."""
    return F.trim(F.element_at(F.split(col(description), r" \| ", 2), -1))


# -- buckets ---------------------------------------------------------------------

def cut_right(value: str | Column, cuts: list[tuple[float, str]], low: float = -0.01) -> Column:
    """Right-closed bins `(previous, edge]` with labels; NULL outside."""
    v = col(value)
    out = F.when(v <= low, None)
    for edge, label in cuts:
        out = out.when(v <= edge, label)
    return out


def position_bucket(value: str | Column) -> Column:
    return cut_right(value, K.POSITION_CUTS)


def probability_bucket(value: str | Column) -> Column:
    return cut_right(value, K.PROBABILITY_CUTS)


def probability_band(value: str | Column) -> Column:
    """Left-closed bands used by the dashboard filter."""
    v = col(value)
    return (F.when(v.isNull(), "").when(v < 0.25, "low").when(v < 0.5, "mid_low")
            .when(v < 0.75, "mid_high").otherwise("high"))


def position_category(origin: str | Column, terminus: str | Column, norm: str | Column) -> Column:
    n = col(norm)
    return (F.when(truth(col(origin) == 1), "origin")
            .when(truth(col(terminus) == 1), "terminus")
            .when(n.isNull(), "")
            .when(n < 0.25, "early").when(n < 0.75, "mid").otherwise("late"))


def bin_index(value: str | Column, low: Column, high: Column, bins: int) -> Column:
    """0-based equal-width bin over [low, high]; the upper edge joins the last bin."""
    v = col(value)
    width = F.nullif(high - low, F.lit(0.0)) / F.lit(float(bins))
    index = F.floor((v - low) / width)
    return F.greatest(F.lit(0), F.least(F.coalesce(index, F.lit(0)), F.lit(bins - 1))).cast("int")


def bin_index_right(value: str | Column, low: Column, high: Column, bins: int) -> Column:
    """0-based equal-width bin, right-closed; the lower edge joins the first bin."""
    v = col(value)
    width = F.nullif(high - low, F.lit(0.0)) / F.lit(float(bins))
    index = F.ceil((v - low) / width) - 1
    return F.greatest(F.lit(0), F.least(F.coalesce(index, F.lit(0)), F.lit(bins - 1))).cast("int")


# -- hygiene ----------------------------------------------------------------------

def finite_or_null(c: str | Column) -> Column:
    v = col(c)
    bad = F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    return F.when(~bad, v)


def finite_or_zero(c: str | Column) -> Column:
    return F.coalesce(finite_or_null(c), F.lit(0.0))
