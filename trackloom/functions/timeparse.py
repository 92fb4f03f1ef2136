"""Reading of time stamps written in mixed notations, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = " \t\r\n\f\x0b\u00a0\u3000"

_PLAIN = r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d$"
_ISO = r"^\d{4}[-/]\d\d?[-/]\d\d?[ Tt]\d\d?:\d\d(:\d\d([.,]\d+)?)?\s?([Zz]|UTC|GMT|[+-]\d\d(:?\d\d)?)?$"
_DAY_FIRST = r"^(\d\d?)\.(\d\d?)\.(\d{4})[ T]"
_DAY_FIRST_FULL = r"^\d\d?\.\d\d?\.\d{4}[ T]\d\d?:\d\d(:\d\d([.,]\d+)?)?$"
_DIGITS14 = r"^(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)$"
_COUNT = r"^-?\d{1,19}([.]\d+)?$"


def epoch_seconds(text: Column) -> Column:
    """Whole epoch seconds (bigint) of a time written as text; null if unreadable.

    Readable are calendar texts (``yyyy-MM-dd HH:mm[:ss[.f]]`` with ``-`` or
    ``/``, blank or ``T``, optional ``Z`` or offset; ``dd.MM.yyyy HH:mm[:ss]``),
    the bare digits ``yyyyMMddHHmmss``, and epoch counts: up to 11 digits are
    seconds, 12 and 13 milliseconds, 15 and 16 microseconds, 18 and 19
    nanoseconds.  A text without an offset is UTC.  Impossible calendar values,
    partial dates, other texts, empty texts and nulls give null.  Fractions are
    floored.
    """
    plain = text.rlike(_PLAIN)
    # the rare notations stay out of the generated code, which would be too long to be compiled
    rare = F.get(F.transform(F.array(text), _any_notation), F.lit(0))
    return F.when(plain, F.unix_seconds(F.concat(text, F.lit("Z")).try_cast("timestamp"))).otherwise(rare)


def _any_notation(text: Column) -> Column:
    s = F.btrim(text, F.lit(WHITE))
    iso = F.translate(F.translate(s, "/,", "-."), "t", "T")
    zone = r"(?i)([Zz]|UTC|GMT|[+-]\d\d(:?\d\d)?)$"
    with_time = F.regexp_extract(iso, r"^\S+[ T]\S+\s?(\S*)$", 0)
    offset = F.regexp_extract(with_time, r"[ T]\d\d?:\d\d(?::\d\d(?:\.\d+)?)?\s?(" + zone[4:-1] + r")$", 1)
    body = F.regexp_replace(F.substring_index(iso, "Z", 1), r"(?<=:\d\d|\.\d{1,12})\s?(UTC|GMT|[+-]\d\d(:?\d\d)?)$", "")
    tz = (
        F.when(offset.rlike(r"^[+-]\d\d$"), F.concat(offset, F.lit(":00")))
        .when(offset.rlike(r"^[+-]\d{4}$"), F.concat(F.substring(offset, 1, 3), F.lit(":"), F.substring(offset, 4, 2)))
        .when(offset.rlike(r"^[+-]"), offset)
        .otherwise(F.lit("Z"))
    )
    canonical = (
        F.when(s.rlike(_PLAIN), F.concat(s, F.lit("Z")))
        .when(s.rlike(_ISO), F.concat(body, tz))
        .when(s.rlike(_DAY_FIRST_FULL), F.concat(F.regexp_replace(F.translate(s, ",", "."), _DAY_FIRST, "$3-$2-$1 "), F.lit("Z")))
        .when(s.rlike(_DIGITS14), F.regexp_replace(s, _DIGITS14, "$1-$2-$3 $4:$5:$6Z"))
    )
    whole = F.substring_index(s, ".", 1)
    digits = F.length(F.translate(whole, "-", ""))
    count = whole.try_cast("bigint")
    per = F.when(digits <= 11, F.lit(1)).when(digits.isin(12, 13), F.lit(1000)).when(digits.isin(15, 16), F.lit(1_000_000)).when(digits >= 18, F.lit(1_000_000_000))
    counted = F.when(canonical.isNull() & s.rlike(_COUNT), F.floor(F.try_divide(count.cast("decimal(20,0)"), per.cast("decimal(20,0)"))).cast("bigint"))
    return F.coalesce(F.unix_seconds(canonical.try_cast("timestamp")), counted)


def clean_key(key: Column) -> Column:
    """Lower case without surrounding white space; blank keys are null."""
    k = F.lower(F.btrim(key, F.lit(WHITE)))
    return F.when(F.length(k) > 0, k)
