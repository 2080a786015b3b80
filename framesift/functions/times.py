"""Dates and times. A timestamp has a precision, one of PRECISIONS; second is the default."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keys of months and week days (from Sunday), and the names that queries may use for months.
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
WEEKDAYS = ("SUN", "MON", "TUES", "WED", "THURS", "FRI", "SAT")
MONTH_NAMES = {
    "JAN": ("jan", "january", "janvier"), "FEB": ("feb", "february", "fevrier"), "MAR": ("mar", "march", "mars"), "APR": ("apr", "april", "avril"), "MAY": ("may", "mai"), "JUN": ("jun", "june", "juin"),
    "JUL": ("jul", "july", "juli"), "AUG": ("aug", "august", "aout"), "SEP": ("sep", "september", "sept", "septembre"), "OCT": ("oct", "october", "octobre"), "NOV": ("nov", "november", "novembre"), "DEC": ("dec", "december", "decembre"),
}
PRECISIONS = ("year", "month", "day", "hour", "minute", "second")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_iso8601(s) -> Column:
    """PARSE-ISO8601: struct (ts, precision) from text that may stop after any field; null if it is no time."""
    t = _c(s)
    forms = [
        (r"^\d{4}$", "yyyy", "year"), (r"^\d{4}-\d{2}$", "yyyy-MM", "month"), (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd", "day"),
        (r"^\d{4}-\d{2}-\d{2}T\d{2}$", "yyyy-MM-dd'T'HH", "hour"), (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}$", "yyyy-MM-dd'T'HH:mm", "minute"),
        (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$", "yyyy-MM-dd'T'HH:mm:ss", "second"),
    ]
    out = F.lit(None).cast("struct<ts:timestamp,precision:string>")
    for pattern, fmt, precision in forms:
        value = F.try_to_timestamp(t, F.lit(fmt))
        out = F.when(t.rlike(pattern) & value.isNotNull(), F.struct(value.alias("ts"), F.lit(precision).alias("precision"))).otherwise(out)
    return out


def iso_timestring(t) -> Column:
    """ISO-TIMESTRING, DATESTRING."""
    return F.date_format(_c(t), "yyyy-MM-dd'T'HH:mm:ss")


def timestring(t) -> Column:
    return F.date_format(_c(t), "HH:mm:ss")


def earlier(a, b) -> Column:
    return _c(a) < _c(b)


def later(a, b) -> Column:
    """LATER? is "not earlier": equal times are later."""
    return _c(a) >= _c(b)


def timestamp_diff(a, b) -> Column:
    """TIMESTAMP-DIFF, DIFFTIME: seconds."""
    return _c(a).cast("timestamp").cast("double") - _c(b).cast("timestamp").cast("double")


def timestamp_plus(t, seconds) -> Column:
    return F.timestamp_add("SECOND", seconds if isinstance(seconds, Column) else F.lit(seconds), _c(t))


def breakup_timestamp(t) -> Column:
    x = _c(t)
    return F.struct(F.year(x).alias("year"), F.month(x).alias("month"), F.dayofmonth(x).alias("day"), F.hour(x).alias("hour"), F.minute(x).alias("minute"), F.second(x).alias("second"), F.lit(0).alias("tzoff"))


def get_year(t) -> Column:
    return F.year(_c(t))


def get_monthnum(t) -> Column:
    """From 0."""
    return F.month(_c(t)) - 1


def get_month(t) -> Column:
    return F.date_format(_c(t), "MMMM")


def get_date(t) -> Column:
    return F.dayofmonth(_c(t))


def get_day(t) -> Column:
    return F.date_format(_c(t), "EEEE")


def get_hour(t) -> Column:
    return F.hour(_c(t))


def get_minute(t) -> Column:
    return F.minute(_c(t))


def get_second(t) -> Column:
    return F.second(_c(t))


def _keys(*pairs: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*(F.when(test, F.lit(name)) for test, name in pairs)))


def get_season(t) -> Column:
    """GET-SEASON: overlapping; months from 0."""
    m = F.month(_c(t)) - 1
    return _keys(((m > 5) & (m < 10), "SUMMER"), ((m > 2) & (m < 6), "SPRING"), ((m > 8) & (m < 12), "AUTUMN"), ((m < 4) | (m > 10), "WINTER"))


def get_daytime(t) -> Column:
    """GET-DAYTIME: overlapping; hour 12 is neither morning nor afternoon."""
    h = F.hour(_c(t))
    return _keys(((h > 5) & (h < 12), "MORNING"), ((h > 12) & (h < 18), "AFTERNOON"), ((h > 16) & (h < 20), "EVENING"), ((h < 5) | (h > 20), "NIGHT"))


def _name_at(names: tuple[str, ...], i: Column) -> Column:
    return F.get(F.array(*map(F.lit, names)), i)


def ordinal(day: Column) -> Column:
    """1ST, 2ND, 3RD, 4TH, ..., 11TH, 12TH, 13TH, ..., 21ST."""
    teen, last = (day >= 11) & (day <= 13), day % 10
    end = F.when(~teen & (last == 1), "ST").when(~teen & (last == 2), "ND").when(~teen & (last == 3), "RD").otherwise("TH")
    return F.concat(day.cast("string"), end)


def hour_key(hour: Column) -> Column:
    """MIDNIGHT, 1AM, ..., NOON, 1PM, ..., 11PM."""
    return F.when(hour == 0, "MIDNIGHT").when(hour == 12, "NOON").when(hour < 12, F.concat(hour.cast("string"), F.lit("AM"))).otherwise(F.concat((hour - 12).cast("string"), F.lit("PM")))


def get_timekeys(t, precision: str = "second") -> Column:
    """GET-TIMEKEYS: the set of index keys of a time, as far as its precision goes. Season bounds differ from GET-SEASON's."""
    x = _c(t)
    level = PRECISIONS.index(precision)
    m = F.month(x) - 1
    parts = [F.year(x).cast("string")]
    sets = [F.array(*parts)]
    if level >= 1:
        sets.append(_keys(((m >= 5) & (m < 9), "SUMMER"), ((m >= 2) & (m <= 5), "SPRING"), ((m >= 8) & (m < 11), "AUTUMN"), ((m < 3) | (m > 10), "WINTER")))
        sets.append(F.array(_name_at(MONTHS, m), F.concat_ws("/", F.month(x).cast("string"), F.year(x).cast("string"))))
    if level >= 2:
        week = F.floor((F.dayofyear(x) - 1) / 7).cast("int") + 1
        sets.append(F.array(ordinal(F.dayofmonth(x)), _name_at(WEEKDAYS, F.dayofweek(x) - 1), F.concat(F.lit("W"), week.cast("string")), F.concat_ws("/", F.month(x).cast("string"), F.dayofmonth(x).cast("string"))))
    if level >= 3:
        sets.append(get_daytime(x))
        sets.append(F.array(hour_key(F.hour(x)), F.concat(F.hour(x).cast("string"), F.lit(":"), F.lpad(F.minute(x).cast("string"), 2, "0"))))
    return F.array_sort(F.array_distinct(F.concat(*sets)))


def parse_timespec(s) -> Column:
    """parse-timespec: the key sets that a query asks for, one per word that means a time: years and ranges of them
    (1996-1998), months and ranges (May-August, which may run over the new year), days, month/day pairs, seasons."""
    names = F.create_map(*(F.lit(x) for i, (key, ns) in enumerate(MONTH_NAMES.items()) for n in ns for x in (n, i)))
    months = F.array(*map(F.lit, MONTHS))

    def keys(w: Column) -> Column:
        low = F.lower(w)
        a, b = F.regexp_extract(low, "^([a-z]+)-", 1), F.regexp_extract(low, "-([a-z]+)$", 1)
        first, last = F.try_element_at(names, a), F.try_element_at(names, b)
        span = F.transform(F.sequence(first, F.when(last >= first, last).otherwise(last + 12)), lambda i: F.get(months, i % 12))
        start, end = F.regexp_extract(w, r"^(\d{4})-", 1).try_cast("int"), F.regexp_extract(w, r"-(\d{4})$", 1).try_cast("int")
        day = w.try_cast("int")
        month = F.try_element_at(names, low)
        return (
            F.when(w.rlike(r"^\d{4}-\d{4}$") & (start <= end), F.transform(F.sequence(start, end), lambda y: y.cast("string")))
            .when(first.isNotNull() & last.isNotNull(), span)
            .when(month.isNotNull(), F.array(F.get(months, month)))
            .when(w.rlike(r"^\d{4}$") | w.rlike(r"^\d+/\d+$"), F.array(w))
            .when(w.rlike(r"^\d{1,2}$") & (day >= 1) & (day <= 31), F.array(ordinal(day)))
            .when(low.isin("summer", "winter", "spring", "autumn"), F.array(F.upper(w)))
            .otherwise(F.array().cast("array<string>"))
        )

    return F.filter(F.transform(F.split(_c(s), " +"), keys), lambda k: F.size(k) > 0)


def timestamp(x=None) -> Column:
    """TIMESTAMP, XTIMESTAMP: of text, or the time at which the query began (GET-NOW, CLOCK)."""
    return F.current_timestamp() if x is None else F.try_to_timestamp(_c(x))


def parse_timestring(s) -> Column:
    """PARSE-TIMESTRING: struct (ts, precision) from ISO text, or from day/month/year, US dates and clock times."""
    t = F.trim(_c(s))
    out = parse_iso8601(t)
    for pattern, fmt, precision in ((r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy", "day"), (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy", "day"), (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy", "day"), (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$", "yyyy-MM-dd HH:mm:ss", "second")):
        value = F.try_to_timestamp(t, F.lit(fmt))
        out = F.when(out.isNotNull(), out).when(t.rlike(pattern) & value.isNotNull(), F.struct(value.alias("ts"), F.lit(precision).alias("precision")))
    return out
