"""Scalar functions as column expressions: built-in functions only, inside code generation."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Risk by merchant category, and the limits that features are divided by.
MCC_RISK = {
    "5411": 0.15,
    "5812": 0.30,
    "5912": 0.20,
    "5944": 0.45,
    "7801": 0.80,
    "7802": 0.75,
    "7995": 0.85,
    "4511": 0.35,
    "5311": 0.25,
    "5999": 0.50,
}
MCC_DEFAULT = 0.50
LIMITS = {"amount": 10_000.0, "installments": 12.0, "ratio": 10.0, "minutes": 1440.0, "km": 1000.0, "tx_count": 20.0, "merchant_avg": 10_000.0}
QUANTUM = 127
CLOCK = r"^([0-9]{4}-[0-9]{2}-[0-9]{2})T([0-9]{2}):([0-9]{2})"


def real(x: Column | float) -> Column:
    """As a 32-bit float."""
    return (x if isinstance(x, Column) else F.lit(x)).cast("float")


def over(x: Column, limit: float) -> Column:
    """32-bit quotient; Spark divides in 64 bits, rounded once more the result is the same."""
    return real(real(x) / real(limit))


def once(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x) with x taken once a row, however often use names it: inside a condition Spark takes a repeated expression again each time."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def clamp(x: Column) -> Column:
    """x between 0 and 1; NaN passes."""
    return once(x, lambda v: F.when(v < 0, real(0.0)).when((v > 1) & ~F.isnan(v), real(1.0)).otherwise(v))


def hour_of(text: Column) -> Column:
    """The hour as it stands in YYYY-MM-DDTHH:MM, whatever offset follows and whatever the session's time zone; null elsewhere."""
    return F.regexp_extract(text, CLOCK, 2).try_cast("int")


def weekday_of(text: Column) -> Column:
    """Monday 0 to Sunday 6 of the date as it stands; null where there is none."""
    return F.weekday(F.regexp_extract(text, CLOCK, 1).try_cast("date"))


def clock_minutes(text: Column) -> Column:
    """Whole minutes since 1970 of date and time as they stand; null where they are none."""

    def minutes(read: Column) -> Column:
        day, hour, minute = F.substring(read, 1, 10).try_cast("date"), F.substring(read, 12, 2).try_cast("int"), F.substring(read, 15, 2).try_cast("int")
        return (F.unix_date(day).cast("long") * 1440 + F.when((hour < 24) & (minute < 60), hour * 60 + minute)).cast("long")

    return once(F.regexp_extract(text, CLOCK, 0), minutes)


def epoch_minutes(ts: Column) -> Column:
    """Whole minutes since 1970 of a timestamp, seconds cut off."""
    return F.floor(F.unix_seconds(ts.cast("timestamp")) / 60).cast("long")


def minutes_between(later: Column, earlier: Column) -> Column:
    """Whole minutes of each text cut before subtracting; never negative."""
    return F.greatest(clock_minutes(later) - clock_minutes(earlier), F.lit(0).cast("long"))


def leading_int(text: Column) -> Column:
    """The digits that a number's text begins with, 0 where it begins otherwise (3.7 gives 3, -3 gives 0); saturates."""
    most = F.lit(2**31 - 1)
    number = once(F.regexp_extract(text, "^[0-9]+", 0), lambda digits: F.when(digits == "", 0).otherwise(F.least(F.coalesce(digits.try_cast("long"), most), most)).cast("int"))
    return F.when(text.isNotNull(), number)


def mcc_risk(mcc: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in MCC_RISK.items() for x in pair))
    return real(F.coalesce(F.try_element_at(table, mcc), F.lit(MCC_DEFAULT)))


def quantise(x: Column) -> Column:
    """A float to -127..127, halves away from zero; what is beyond saturates, infinity too, and NaN gives 0."""
    bounded = F.when(F.isnan(x), real(0.0)).otherwise(F.least(F.greatest(real(x), real(-2.0)), real(2.0)))
    near = bounded * real(float(QUANTUM)) + F.when(bounded >= 0, real(0.5)).otherwise(real(-0.5))
    return F.least(F.greatest(near.cast("int"), F.lit(-QUANTUM)), F.lit(QUANTUM))


def quantise_vector(v: Column) -> Column:
    return F.transform(v, lambda x: quantise(x).cast("tinyint"))


def dequantise_vector(v: Column) -> Column:
    return F.transform(v, lambda x: real(real(x) / real(float(QUANTUM))))


def l2sq(a: Column, b: Column, dims: int) -> Column:
    """Squared distance of two arrays, written out; integers are widened before subtracting."""
    terms = [(a[i].cast("double") - b[i].cast("double")) for i in range(dims)]
    return reduce(lambda x, y: x + y, (t * t for t in terms))


def box_bound(q: Column, low: Column, high: Column, dims: int) -> Column:
    """Squared distance of a point to a box: no point inside is nearer."""
    out = [F.greatest(low[i].cast("int") - q[i].cast("int"), F.lit(0), q[i].cast("int") - high[i].cast("int")) for i in range(dims)]
    return reduce(lambda x, y: x + y, (t * t for t in out))
