"""Ordered cascade of anchored date and time patterns, as Catalyst expressions.

Every pattern is anchored and rewrites a match into one canonical line
``kind|year|month|day|hour|minute|second|fraction|half|zone`` that is cut up once.
No Python runs per row and nothing depends on the session time zone.

Policy for local times: of a doubled local hour the earlier instant is taken, in a
skipped one the offset before the change. ``convert_timezone`` on TIMESTAMP_NTZ
resolves local times in exactly this way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# English month names and their usual short forms.
MONTHS = (
    "January February March April May June July August September October November December"
).split()
# Zone abbreviations and their minutes east of UTC.
ZONE_MINUTES = {
    "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "BST": 60, "WEST": 60, "CET": 60, "CEST": 120, "EET": 120,
    "EEST": 180, "MSK": 180, "IST": 330, "KST": 540, "JST": 540, "AWST": 480, "ACST": 570, "ACDT": 630,
    "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780, "NST": -210, "NDT": -150, "AST": -240, "ADT": -180,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "AKST": -540, "AKDT": -480, "HST": -600,
}

_MON = r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sept?(?:ember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\.?"
_DAY_NAME = r"(?:(?:Mon|Tues?|Wed(?:nes)?|Thu(?:rs)?|Fri|Sat(?:ur)?|Sun)(?:day)?\.?,?\s+)?"
_ZONE = r"(?:\s*(Z|[+-]\d{1,2}(?::?\d{2})?|\[[A-Za-z0-9_+/-]+\]|[A-Za-z]+/[A-Za-z0-9_+/-]+|[A-Z]{2,5})(?:\[[A-Za-z0-9_+/-]+\])?)?"
_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?(?:\s*([AP])\.?M\.?(?![A-Za-z]))?" + _ZONE

#: (name, pattern, canonical form); the first that matches the whole trimmed value wins.
CASCADE: list[tuple[str, str, str]] = [
    ("year", r"(\d{4})", "d|$1|||||||"),
    ("year_month", r"(\d{4})[-/.](\d{1,2})", "d|$1|$2||||||"),
    ("iso_date", r"(\d{4})-(\d{1,2})-(\d{1,2})", "d|$1|$2|$3|||||"),
    ("iso_time", r"(\d{4})-(\d{1,2})-(\d{1,2})(?:[Tt]|\s+)" + _TIME, "t|$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    ("year_slash", r"(\d{4})/(\d{1,2})/(\d{1,2})", "d|$1|$2|$3|||||"),
    ("year_slash_time", r"(\d{4})/(\d{1,2})/(\d{1,2})(?:T|\s+)" + _TIME, "t|$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    ("compact_date", r"(\d{4})(\d{2})(\d{2})", "d|$1|$2|$3|||||"),
    ("compact_time", r"(\d{4})(\d{2})(\d{2})T?(\d{2})(\d{2})(\d{2})(?:[.,](\d+))?" + _ZONE, "t|$1|$2|$3|$4|$5|$6|$7||$8"),
    ("epoch_s", r"(\d{10})", "e|$1|||||||"),
    ("epoch_ms", r"(\d{10})(\d{3})", "e|$1||||||$2|"),
    ("slash", r"(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})", "o|$3|$1|$2|||||"),
    ("slash_time", r"(\d{1,2})/(\d{1,2})/(\d{4}|\d{2}),?\s+" + _TIME, "p|$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    ("dotted", r"(\d{1,2})\.\s?(\d{1,2})\.\s?(\d{4})", "d|$3|$2|$1|||||"),
    ("dotted_time", r"(\d{1,2})\.(\d{1,2})\.(\d{4}),?\s+" + _TIME, "t|$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    ("day_month", _DAY_NAME + rf"(\d{{1,2}})(?:st|nd|rd|th)?\s+({_MON}),?\s+(\d{{4}})", "d|$3|$2|$1|||||"),
    ("day_month_time", _DAY_NAME + rf"(\d{{1,2}})(?:st|nd|rd|th)?\s+({_MON}),?\s+(\d{{4}}),?\s+" + _TIME, "t|$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    ("day_dash_month", rf"(\d{{1,2}})-({_MON})-(\d{{4}}|\d{{2}})", "d|$3|$2|$1|||||"),
    ("month_day", _DAY_NAME + rf"({_MON})\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})", "d|$3|$1|$2|||||"),
    ("month_day_time", _DAY_NAME + rf"({_MON})\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}}),?\s+" + _TIME, "t|$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    ("year_month_day", rf"(\d{{4}})\s+({_MON})\s+(\d{{1,2}})", "d|$1|$2|$3|||||"),
    ("year_month_name", rf"(\d{{4}})\s+({_MON})", "d|$1|$2||||||"),
    ("month_name_year", rf"({_MON}),?\s+(\d{{4}})", "d|$2|$1||||||"),
    ("cjk_date", r"(\d{4})\s?[년年]\s?(\d{1,2})\s?[월月]\s?(\d{1,2})\s?[일日]", "d|$1|$2|$3|||||"),
    ("cjk_month", r"(\d{4})\s?[년年]\s?(\d{1,2})\s?[월月]", "d|$1|$2||||||"),
]


def known_zones(spark: SparkSession) -> list[str]:
    """Zone names the JVM can resolve; a bounded list of about 600."""
    return sorted(str(z) for z in spark._jvm.java.time.ZoneId.getAvailableZoneIds().toArray())


def _number(part: Column) -> Column:
    return F.try_to_number(F.nullif(part, F.lit("")), F.lit("999999999999999")).cast("bigint")


def _month(part: Column) -> Column:
    at = F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.lower(F.substring(part, 1, 3)))
    return F.when(part.rlike(r"^\d+$"), _number(part)).when(F.length(part) >= 3, ((at + 2) / 3).cast("bigint"))


def trimmed(value: Column) -> Column:
    """``value`` without outer blanks, no-break and zero-width ones included."""
    return F.regexp_replace(value, "^[\\s\\u00a0\\u200b\\ufeff]+|[\\s\\u00a0\\u200b\\ufeff]+$", "")


def canonical(text: Column) -> Column:
    """The canonical line of the first pattern that matches, else NULL."""
    out = None
    for _, pattern, form in CASCADE:
        anchored = rf"(?i)^{pattern}$"
        hit = text.rlike(anchored)
        line = F.regexp_replace(text, anchored, form)
        out = F.when(hit, line) if out is None else out.when(hit, line)
    return out


def add_normal_form(
    df: DataFrame, output: str, value: Column, default_zone: Column, date_order: Column, zones: list[str]
) -> DataFrame:
    """Add ``output``, the ISO form of ``value``; NULL if it holds no such date or time.

    A time comes out as ``yyyy-MM-ddTHH:mm:ss.SSSSSSZ`` in UTC, a date as
    ``yyyy-MM-dd``, ``yyyy-MM`` or ``yyyy`` as given. A time without zone and
    without ``default_zone`` is not unambiguous and gives NULL, as do unknown zone
    names and impossible dates (13th month, 30 February, hour 24).

    The steps are projections of their own: each result is used several times by the
    next, so Catalyst keeps them apart and every step compiles to a small method.
    """
    helpers: list[str] = []

    def step(frame: DataFrame, **cols: Column) -> DataFrame:
        named = {f"__ts_{k}": v for k, v in cols.items()}
        helpers.extend(named)
        return frame.withColumns(named)

    c = lambda name: F.col(f"__ts_{name}")
    df = step(df, text=trimmed(value))
    df = step(df, line=canonical(c("text")), zone0=default_zone, order=F.upper(F.coalesce(date_order, F.lit(""))))
    df = step(df, p=F.split(c("line"), r"\|", -1))
    p = [F.get(c("p"), F.lit(i)) for i in range(10)]
    df = step(df, kind=p[0], raw_month=p[2], raw_day=p[3], half=F.lower(p[8]), fraction=p[7], hour0=_number(p[4]),
              minute=_number(p[5]), second=F.coalesce(_number(p[6]), F.lit(0)),
              zone=F.regexp_replace(p[9], r"^\[|\]$", ""),
              year=_number(F.when(F.length(p[1]) == 2, F.concat(F.lit("20"), p[1])).otherwise(p[1])))
    # Day before month: a slash date of an order the lookup doesn't give stays unread.
    first, second_part = c("raw_month"), c("raw_day")
    swapped = c("kind").isin("o", "p")
    df = step(
        df,
        month=F.when(~swapped, _month(first)).when(c("order") == "MDY", _number(first)).when(c("order") == "DMY", _number(second_part)),
        day=F.when(~swapped, _number(second_part)).when(c("order") == "MDY", _number(second_part)).when(c("order") == "DMY", _number(first)),
        hour=F.when(c("half") == "", c("hour0")).when(c("hour0").between(1, 12), c("hour0") % 12 + F.when(c("half") == "p", 12).otherwise(0)),
    )
    # A part that is given but can't be read must not count as missing.
    month0 = F.when(first == "", F.lit(1)).otherwise(c("month"))
    day0 = F.when(second_part == "", F.lit(1)).otherwise(c("day"))
    df = step(df, whole=F.format_string("%04d-%02d-%02d", c("year"), month0, day0))
    offset = c("zone").rlike(r"^[+-]\d")
    digits = F.regexp_replace(c("zone"), ":", "")
    off_h = _number(F.when(offset, F.regexp_extract(digits, r"^.(\d{1,2})(?:\d\d)?$", 1)))
    off_m = F.coalesce(_number(F.when(offset, F.regexp_extract(digits, r"^.\d{1,2}(\d\d)$", 1))), F.lit(0))
    short = F.create_map(*[F.lit(x) for kv in ZONE_MINUTES.items() for x in kv])
    df = step(
        df,
        date_ok=F.try_to_date(c("whole"), "yyyy-MM-dd").isNotNull() & (c("year") > 0),
        clock_ok=c("hour").between(0, 23) & c("minute").between(0, 59) & c("second").between(0, 59),
        local=F.try_make_timestamp_ntz(
            c("year").cast("int"), c("month").cast("int"), c("day").cast("int"), c("hour").cast("int"),
            c("minute").cast("int"), c("second").cast("decimal(16,6)"),
        ),
        fixed=F.when(F.upper(c("zone")) == "Z", F.lit(0))
        .when(offset & (off_h <= 18) & (off_m <= 59), (off_h * 60 + off_m) * F.when(c("zone").startswith("-"), -1).otherwise(1))
        .when(c("zone") != "", F.try_element_at(short, F.upper(c("zone"))))
        .cast("int"),
        named0=F.when(c("zone") == "", c("zone0")).when(~offset, c("zone")),
    )
    df = step(df, named=F.when(c("named0").isin(*zones), c("named0")))
    df = step(
        df,
        instant=F.coalesce(
            c("local") - F.make_dt_interval(mins=c("fixed")), F.convert_timezone(c("named"), F.lit("UTC"), c("local"))
        ).cast("string"),
    )
    from_epoch = F.to_utc_timestamp(F.timestamp_seconds(c("year")), F.current_timezone())
    out = (
        F.when(
            c("kind") == "e",
            F.concat(F.date_format(from_epoch, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), F.rpad(c("fraction"), 6, "0"), F.lit("Z")),
        )
        .when(c("kind").isin("d", "o") & c("date_ok") & (first == ""), F.substring(c("whole"), 1, 4))
        .when(c("kind").isin("d", "o") & c("date_ok") & (second_part == ""), F.substring(c("whole"), 1, 7))
        .when(c("kind").isin("d", "o") & c("date_ok"), c("whole"))
        .when(
            c("kind").isin("t", "p") & c("date_ok") & c("clock_ok"),
            F.concat(
                F.substring(c("instant"), 1, 10), F.lit("T"), F.substring(c("instant"), 12, 8), F.lit("."),
                F.rpad(F.substring(c("fraction"), 1, 6), 6, "0"), F.lit("Z"),
            ),
        )
    )
    return df.withColumn(output, out).drop(*helpers)
