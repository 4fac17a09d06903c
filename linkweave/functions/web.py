"""Fields of a collected page: headers, certificate text, status-page markers, paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkweave import fixed


def status_exposed(html: str) -> Column:
    out = F.lit(False)
    for marker in fixed.STATUS_PAGE_MARKERS:
        out = out | F.coalesce(F.col(html).contains(marker), F.lit(False))
    return out


def header(headers: str, name: str, default: str) -> Column:
    """A header by name, case ignored; the last of equal names wins."""
    entries = F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name.lower())
    return F.coalesce(
        F.try_element_at(F.transform(entries, lambda e: e["value"]), F.lit(-1)), F.lit(default)
    )


def certificate_digest(pem: str) -> Column:
    """Digest of the trimmed certificate text; empty without a certificate."""
    text = F.regexp_replace(F.col(pem), r"^\s+|\s+$", "")
    return F.when(F.coalesce(F.col(pem), F.lit("")) == "", "").otherwise(F.sha2(text, 256))


def common_name(pem: str) -> Column:
    """Text after the first CN= up to the line's end or a slash."""
    after = F.split(F.col(pem), "CN=", 3).getItem(1)
    name = F.trim(F.substring_index(F.substring_index(after, "\n", 1), "/", 1))
    return F.when(F.col(pem).contains("CN="), name).otherwise("Unknown")


def normal_path(path: str) -> Column:
    """Request path with its ids replaced, to keep the number of paths small."""
    p = F.col(path)
    return (
        F.when(
            p.contains("/api/v1/hypotheses/") & p.contains("/review"),
            "/api/v1/hypotheses/{id}/review",
        )
        .when(p.contains("/api/v1/cases/"), "/api/v1/cases/{id}")
        .when(p.contains("/api/v1/actors/"), "/api/v1/actors/{id}")
        .otherwise(p)
    )


_DATE = r"(\d{4})(?:-(\d{2})-(\d{2})|(\d{2})(\d{2})|-W(\d{2})(?:-(\d))?|W(\d{2})(\d)?)"
_TIME = r"(\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d+))?)?)?"
_OFFSET = r"(?:([+-])(\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,]\d+)?)?)?)?"
_ISO = f"^{_DATE}(?:.{_TIME}{_OFFSET})?$"


def iso_timestamp(text: str) -> Column:
    """ISO-8601 text to a timestamp: Z or offset read, none means UTC, bad text is NULL.

    Dates may be plain, without dashes or by week; times may leave out colons, seconds or
    minutes; fractions beyond microseconds are cut.
    """
    t = F.regexp_replace(F.trim(F.col(text)), "[zZ]$", "+00:00")
    part = lambda n: F.regexp_extract(t, _ISO, n)
    either = lambda *ns: F.concat(*[part(n) for n in ns])
    number = lambda c: F.when(c == "", 0).otherwise(c.cast("int"))
    week, day = either(6, 8), either(7, 9)
    january4 = F.try_to_date(F.concat(part(1), F.lit("-01-04")))
    monday = F.date_sub(january4, F.weekday(january4))
    by_week = F.when(
        number(week).between(1, 53) & (F.when(day == "", 1).otherwise(number(day))).between(1, 7),
        F.date_add(monday, (number(week) - 1) * 7 + F.when(day == "", 0).otherwise(number(day) - 1)),
    )
    plain = F.concat_ws("-", part(1), either(2, 4), either(3, 5))
    date = F.when(week != "", by_week.cast("string")).otherwise(plain)
    filled = lambda n: F.lpad(part(n), 2, "0")
    fraction = F.rpad(F.substring(part(13), 1, 6), 6, "0")
    moment = F.try_to_timestamp(
        F.concat(date, F.lit(" "), filled(10), F.lit(":"), filled(11), F.lit(":"), filled(12), F.lit("."), fraction, F.lit("+00:00"))
    )
    shift = number(part(15)) * 3600 + number(part(16)) * 60 + number(part(17))
    east = F.when(part(14) == "-", -shift).otherwise(shift)
    return F.when(
        t.rlike(_ISO) & (number(part(15)) < 24) & (number(part(16)) < 60),
        F.timestamp_micros(F.unix_micros(moment) - east * F.lit(1_000_000).cast("long")),
    )
