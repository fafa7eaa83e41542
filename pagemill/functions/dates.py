"""Date texts to ISO-8601 strings, independent of the session time zone.

All arithmetic is done on TIMESTAMP_NTZ, so no session setting can shift a value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill import rules
from pagemill.functions.text import cached_expression, col, let, strip

_DATE_ONLY = r"\A\d{4}-\d{2}-\d{2}\z"
# date (extended or basic), any one-character separator, time, optional zone
_ISO = (
    r"(?s)\A(\d{4})(-?)(\d{2})\2(\d{2})"
    r"(?:.(\d{2})(?:(:?)(\d{2})(?:\6(\d{2})(?:[.,](\d+))?)?)?"
    r"([+-]\d{2}:?\d{2}(?::?\d{2})?|[+-]\d{2})?)?\z"
)
_ISO_WEEK = (
    r"(?s)\A(\d{4})(-?)W(\d{2})(?:\2([1-7]))?"
    r"(?:.(\d{2})(?:(:?)(\d{2})(?:\6(\d{2})(?:[.,](\d+))?)?)?"
    r"([+-]\d{2}:?\d{2}(?::?\d{2})?|[+-]\d{2})?)?\z"
)
_RFC_DAY_FIRST = (
    r"(?i)\A(?:[a-z]+\.?,?\s*)??(\d{1,2})[\s-]+([a-z]+),?[\s-]+(\d{2,4}),?\s+"
    r"(\d{1,2})[:.](\d{1,2})(?:[:.](\d{1,2}))?(?:\s*([+-]\d{4})|\s+(\S+))?(?:\s.*)?\z"
)
_RFC_MONTH_FIRST = (
    r"(?i)\A(?:[a-z]+\.?,?\s+)??([a-z]+)[\s-]+(\d{1,2}),?[\s-]+(\d{2,4}),?\s+"
    r"(\d{1,2})[:.](\d{1,2})(?:[:.](\d{1,2}))?(?:\s*([+-]\d{4})|\s+(\S+))?(?:\s.*)?\z"
)


def _moment(date_text: Column, hour: Column, minute: Column, second: Column, fraction: Column, offset: Column) -> Column:
    """Pieces every notation is brought to before one common formatting step."""
    return F.struct(
        date_text.alias("date"), hour.alias("hour"), minute.alias("minute"), second.alias("second"),
        fraction.alias("fraction"), offset.alias("offset"),
    )


def _format(m: Column) -> Column:
    """ISO text; aware values (offset known) become UTC with a ``Z``; NULL if no such moment exists."""

    def two(part: Column) -> Column:
        return F.lpad(F.when(part == "", F.lit("0")).otherwise(part), 2, "0")

    micros = F.rpad(F.substring(m["fraction"], 1, 6), 6, "0")
    text = F.concat(
        m["date"], F.lit(" "), two(m["hour"]), F.lit(":"), two(m["minute"]), F.lit(":"), two(m["second"]), F.lit("."), micros
    )
    shift = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.coalesce(m["offset"], F.lit(0)).cast("decimal(18,6)"))
    # Offsets stay below a day; larger ones are no valid zone.
    usable = m["offset"].isNull() | (F.abs(m["offset"]) < 86400)

    def written(shifted: Column) -> Column:
        whole = F.split_part(shifted, F.lit("."), F.lit(1))
        part = F.split_part(shifted, F.lit("."), F.lit(2))
        return F.concat(
            whole,
            F.when(part == "", F.lit("")).otherwise(F.concat(F.lit("."), F.rpad(part, 6, "0"))),
            F.when(m["offset"].isNull(), F.lit("")).otherwise(F.lit("Z")),
        )

    return F.when(
        usable, let(F.translate((text.try_cast("timestamp_ntz") - shift).cast("string"), " ", "T"), written)
    )


def _iso_offset(zone: Column) -> Column:
    digits = F.regexp_replace(zone, "[^0-9]", "")

    def part(start: int) -> Column:
        piece = F.substring(digits, start, 2)
        return F.when(piece == "", F.lit(0)).otherwise(piece.try_cast("int"))

    seconds = part(1) * 3600 + part(3) * 60 + part(5)
    return F.when(zone != "", F.when(zone.startswith("-"), -seconds).otherwise(seconds))


def _groups(text: Column, pattern: str, count: int) -> Column:
    """All groups of one match as an array, from a single regex pass."""
    joined = F.regexp_replace(text, pattern, "\u0001".join(f"${n}" for n in range(1, count + 1)))
    return F.split(joined, "\u0001", count)


def _iso(text: Column) -> Column:
    def build(g: Column) -> Column:
        def at(n: int) -> Column:
            return F.get(g, F.lit(n - 1))

        date_text = F.concat_ws("-", at(1), at(3), at(4))
        return _moment(date_text, at(5), at(7), at(8), at(9), _iso_offset(at(10)))

    return F.when(text.rlike(_ISO), let(_groups(text, _ISO, 10), build))


def _iso_week(text: Column) -> Column:
    def build(g: Column) -> Column:
        def at(n: int) -> Column:
            return F.get(g, F.lit(n - 1))

        year = at(1).try_cast("int")
        week = at(3).try_cast("int")
        weekday = F.when(at(4) == "", F.lit(1)).otherwise(at(4).try_cast("int"))
        monday = F.trunc(F.concat(at(1), F.lit("-01-04")).try_cast("date"), "week")
        day = F.date_add(monday, (week - 1) * 7 + weekday - 1)
        # Week 53 exists only when the Thursday of that week is still in the year.
        thursday = F.date_add(monday, (week - 1) * 7 + 3)
        valid = week.between(1, 53) & (F.year(thursday) == year)
        return F.when(valid, _moment(day.cast("string"), at(5), at(7), at(8), at(9), _iso_offset(at(10))))

    return F.when(text.rlike(_ISO_WEEK), let(_groups(text, _ISO_WEEK, 10), build))


def _month_number(name: Column) -> Column:
    lowered = F.lower(name)
    short = F.array_position(F.array(*[F.lit(m) for m in rules.MONTH_NAMES]), lowered)
    long = F.array_position(F.array(*[F.lit(m) for m in rules.LONG_MONTH_NAMES]), lowered)
    return F.greatest(short, long)


def _rfc_offset(numeric: Column, name: Column) -> Column:
    hhmm = numeric.try_cast("int")
    zones = F.create_map(*[F.lit(v) for pair in rules.ZONE_OFFSETS.items() for v in pair])
    named = F.try_element_at(zones, F.upper(name))
    value = F.when(numeric != "", hhmm).otherwise(named)
    size = F.abs(value)
    seconds = F.signum(value).cast("int") * (F.floor(size / 100) * 3600 + (size % 100) * 60)
    # "-0000" means: UTC, but no zone known.
    return F.when(numeric == "-0000", F.lit(None).cast("int")).otherwise(seconds.cast("int"))


def _rfc_one(text: Column, pattern: str, day_at: int, month_at: int) -> Column:
    def build(g: Column) -> Column:
        def at(n: int) -> Column:
            return F.get(g, F.lit(n - 1))

        year = at(3).try_cast("int")
        full_year = F.when(year > 99, year).when(year > 68, year + 1900).otherwise(year + 2000)
        month = _month_number(at(month_at))
        date_text = F.concat_ws(
            "-",
            F.lpad(full_year.cast("string"), 4, "0"),
            F.lpad(month.cast("string"), 2, "0"),
            F.lpad(at(day_at), 2, "0"),
        )
        return F.when(month > 0, _moment(date_text, at(4), at(5), at(6), F.lit(""), _rfc_offset(at(7), at(8))))

    return F.when(text.rlike(pattern), let(_groups(text, pattern, 8), build))


def _rfc(text: Column) -> Column:
    return F.coalesce(_rfc_one(text, _RFC_DAY_FIRST, 1, 2), _rfc_one(text, _RFC_MONTH_FIRST, 2, 1))


def normalize_rfc2822(value: Column | str) -> Column:
    """RFC-2822 dates; a weekday is ignored, right or wrong."""
    return let(let(strip(value), _rfc), _format)


@cached_expression
def normalize_datetime(value: Column | str) -> Column:
    """Date-only text stays, ISO and RFC-2822 become ISO, else NULL."""

    def build(text: Column) -> Column:
        iso_text = F.replace(text, F.lit("Z"), F.lit("+00:00"))
        return (
            F.when(text == "", F.lit(None).cast("string"))
            .when(text.rlike(_DATE_ONLY), text)
            .otherwise(let(let(iso_text, lambda iso: F.coalesce(_iso(iso), _iso_week(iso), _rfc(text))), _format))
        )

    return let(strip(value), build)


def as_timestamp(value: Column | str) -> Column:
    """Typed companion of a normalised text (``Z`` and naive values read as UTC)."""
    text = F.regexp_replace(col(value), r"Z\z", "")
    return F.to_utc_timestamp(text.try_cast("timestamp_ntz").cast("timestamp"), F.current_timezone())
