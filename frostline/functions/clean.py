"""Row-wise cleaning, predicates and numeric guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Text that stands for a missing ward, and the recognised formats.
TEXT_NULLS = ["Null", "nan", "None", "NaN", ""]
WARD_PATTERN = r"^Ward\s+[1-8]$"
ADDRESS_PATTERN = r"^(\d+[A-Za-z]?)\s+([^,]+?)(?:\s+((Apt|Unit|#)\s*[^,]+))?$"
ZIP_PATTERN = r"\b\d{5}\b"


# --- coercion ---------------------------------------------------------------

def to_ts(c: Column, fmt: str | None = None) -> Column:
    """Timestamp, or null where the text does not parse."""
    return F.try_to_timestamp(c, F.lit(fmt)) if fmt else F.try_to_timestamp(c)


def to_number(c: Column) -> Column:
    """Double, or null where the text does not parse or is not a number."""
    return nan_to_null(c.try_cast("double"))


def nan_to_null(c: Column) -> Column:
    """Spark orders NaN above every number; comparisons here must see null instead."""
    return F.when(~F.isnan(c), c)


def finite_or(c: Column, other: Column) -> Column:
    d = c.cast("double")
    return F.when(d.isNotNull() & ~F.isnan(d) & (F.abs(d) != F.lit(float("inf"))), d).otherwise(other)


def count_prediction(c: Column) -> Column:
    """Non-finite predictions count as 0, negatives are clipped at 0."""
    return F.greatest(finite_or(c, F.lit(0.0)), F.lit(0.0))


def numeric_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Booleans to 0/1, non-finite and null to 0 – the form linear models accept."""
    return df.withColumns({c: finite_or(F.col(c).cast("double"), F.lit(0.0)) for c in columns})


# --- text -------------------------------------------------------------------

def strip(c: Column) -> Column:
    """Drop leading and trailing whitespace of any kind."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def clean_label(c: Column) -> Column:
    return F.coalesce(F.lower(strip(c)), F.lit("unknown"))


def clean_address(c: Column) -> Column:
    return F.coalesce(strip(F.regexp_replace(c, r"[\s\x01]+", " ")), F.lit("unknown"))


def null_text_wards(c: Column) -> Column:
    """Trimmed ward; null for text that stands for a missing value."""
    t = strip(c)
    return F.when(~t.isin(TEXT_NULLS), t)


def address_parts(addr: Column) -> dict[str, Column]:
    """House number, street and unit; null where the address does not parse.

    One rewrite puts a control character in front of each group, and the text is split there; text that does not match stays
    in one piece. Text that holds that character itself, which cleaning removes, has it replaced by a space first.
    The pieces stand in the condition of every part, so they are worked out once for all three.
    """
    plain = F.translate(addr, "\u0001", " ")
    pieces = F.split(F.regexp_replace(plain, ADDRESS_PATTERN, "\u0001$1\u0001$2\u0001$3"), "\u0001")

    def group(i: int) -> Column:
        return F.nullif(F.when(F.size(pieces) == 4, pieces[i]), F.lit(""))

    return {"number": group(1), "street": group(2), "unit": group(3)}


# --- predicates -------------------------------------------------------------

def contains_ci(c: Column, word: str) -> Column:
    """Case-insensitive substring; null text does not match."""
    return F.coalesce(F.lower(c).contains(word.lower()), F.lit(False))


def word_ci(c: Column, word: str) -> Column:
    """Case-insensitive whole word, plural allowed."""
    return F.coalesce(c.rlike(rf"(?i)\b{word}(s)?\b"), F.lit(False))


def valid_ward(c: Column) -> Column:
    return F.coalesce(c.rlike(WARD_PATTERN), F.lit(False))


def first_keyword(text: Column, keywords: list[str]) -> Column:
    """The first keyword of an ordered list contained in ``text`` (case-insensitive), else null."""
    return F.coalesce(*[F.when(contains_ci(text, k), F.lit(k)) for k in keywords])


# --- durations and lateness ---------------------------------------------------

def hours_between(start: Column, end: Column) -> Column:
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return micros / F.lit(3.6e9)


def with_lateness(df: DataFrame) -> DataFrame:
    """Due/response hours, overdue and on-time flags, late hours (0 unless overdue)."""
    add, due, done = F.col("add_ts"), F.col("due_ts"), F.col("resolved_ts")
    both = F.col("due_hours").isNotNull() & F.col("response_hours").isNotNull()
    return (
        df.withColumns({
            "due_hours": hours_between(add, due),
            "response_hours": hours_between(add, done),
            "overdue": F.coalesce(done > due, F.lit(False)).cast("int"),
        })
        .withColumns({
            "late_hours": F.when(F.col("overdue") == 1, hours_between(due, done)).otherwise(F.lit(0.0)),
            "on_time": F.coalesce(both & (F.col("response_hours") <= F.col("due_hours")), F.lit(False)).cast("int"),
            "has_both": both.cast("int"),
        })
    )


def weather_flags(df: DataFrame, heavy_rain_mm: float = 10.0) -> DataFrame:
    """Temperature range and 0/1 day flags; a null temperature sets no flag."""
    def flag(c: Column) -> Column:
        return F.coalesce(c, F.lit(False)).cast("int")

    return df.withColumns({
        "t_range": F.col("tmax_c") - F.col("tmin_c"),
        "freeze_day": flag(F.col("tmin_c") < 0),
        "freeze_thaw_day": flag((F.col("tmin_c") < 0) & (F.col("tmax_c") > 0)),
        "heavy_rain_day": flag(F.col("precip_mm") >= heavy_rain_mm),
    })
