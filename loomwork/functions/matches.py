"""Scalar rules of the match record: status, labels, lookups, days and parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lower-cased team names and their three-letter codes.
NAME_TO_CODE = {
    "algeria": "ALG", "argentina": "ARG", "australia": "AUS", "austria": "AUT", "belgium": "BEL", "bosnia-herzegovina": "BIH",
    "bosnia and herzegovina": "BIH", "brazil": "BRA", "canada": "CAN", "cape verde": "CPV", "cape verde islands": "CPV", "colombia": "COL",
    "congo dr": "COD", "dr congo": "COD", "croatia": "CRO", "curaçao": "CUW", "curacao": "CUW", "czechia": "CZE", "czech republic": "CZE",
    "ecuador": "ECU", "egypt": "EGY", "england": "ENG", "france": "FRA", "germany": "GER", "ghana": "GHA", "haiti": "HAI", "iran": "IRN",
    "iraq": "IRQ", "ivory coast": "CIV", "côte d'ivoire": "CIV", "japan": "JPN", "jordan": "JOR", "mexico": "MEX", "morocco": "MAR",
    "netherlands": "NED", "new zealand": "NZL", "norway": "NOR", "panama": "PAN", "paraguay": "PAR", "portugal": "POR", "qatar": "QAT",
    "saudi arabia": "KSA", "scotland": "SCO", "senegal": "SEN", "south africa": "RSA", "south korea": "KOR", "korea republic": "KOR",
    "spain": "ESP", "sweden": "SWE", "switzerland": "SUI", "tunisia": "TUN", "türkiye": "TUR", "turkey": "TUR", "united states": "USA",
    "usa": "USA", "uruguay": "URU", "uzbekistan": "UZB",
}
# Raw status texts of the season feed.
SEASON_STATUS = {
    "NS": "SCHEDULED", "NOT STARTED": "SCHEDULED", "1H": "IN_PLAY", "2H": "IN_PLAY", "ET": "IN_PLAY", "BT": "IN_PLAY", "P": "IN_PLAY",
    "LIVE": "IN_PLAY", "HT": "PAUSED", "FT": "FINISHED", "AET": "FINISHED", "PEN": "FINISHED", "AP": "FINISHED", "MATCH FINISHED": "FINISHED",
    "POSTPONED": "POSTPONED", "PST": "POSTPONED", "CANCELLED": "CANCELLED", "CANCELED": "CANCELLED", "ABANDONED": "SUSPENDED", "SUSPENDED": "SUSPENDED",
}
# Badges.
BADGES = {"IN_PLAY": "LIVE", "PAUSED": "HT", "FINISHED": "FT", "POSTPONED": "PPD", "CANCELLED": "CANC", "SUSPENDED": "SUSP"}
SCORED = ("IN_PLAY", "PAUSED", "FINISHED", "SUSPENDED")


def lookup(table: dict[str, str], key: Column) -> Column:
    """Value of a small fixed table, null on a miss."""
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def filled(c: Column) -> Column:
    """Null for the empty string, which the feeds use for a missing value."""
    return F.nullif(c, F.lit(""))


def leading_int(c: Column) -> Column:
    """The integer that a text begins with, else null."""
    return F.regexp_extract(c, r"^\s*([+-]?\d+)", 1).try_cast("int")


def feed_status(name: Column, state: Column) -> Column:
    return (
        F.when(name == "STATUS_HALFTIME", "PAUSED")
        .when(name == "STATUS_POSTPONED", "POSTPONED")
        .when(name == "STATUS_CANCELED", "CANCELLED")
        .when(name.isin("STATUS_SUSPENDED", "STATUS_ABANDONED"), "SUSPENDED")
        .when(state == "in", "IN_PLAY")
        .when(state == "post", "FINISHED")
        .otherwise("SCHEDULED")
    )


def season_status(raw: Column, postponed: Column) -> Column:
    mapped = lookup(SEASON_STATUS, F.upper(unicode_trim(raw)))
    return F.when(F.lower(postponed) == "yes", "POSTPONED").otherwise(F.coalesce(mapped, F.lit("SCHEDULED")))


def has_score(status: Column) -> Column:
    return status.isin(*SCORED)


def is_live(status: Column) -> Column:
    return status.isin("IN_PLAY", "PAUSED")


def is_upcoming(status: Column) -> Column:
    return status.isin("SCHEDULED", "TIMED")


def badge(status: Column) -> Column:
    return lookup(BADGES, status)


def advances(pos: Column) -> Column:
    return F.coalesce(pos <= 2, F.lit(False))


def group_label(g: Column) -> Column:
    letter = F.upper(F.regexp_extract(g, r"(?i)^group[_ ]([a-l])$", 1))
    return F.when(letter != "", F.concat(F.lit("Group "), letter)).otherwise(F.coalesce(g, F.lit("")))


def competition_label(group: Column, stage: Column) -> Column:
    return F.when(filled(group).isNotNull(), group_label(group)).otherwise(F.coalesce(stage, F.lit("")))


def slug_title(slug: Column) -> Column:
    word = lambda w: F.when(w == "of", w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w))))
    return F.array_join(F.transform(F.split(slug, "-"), word), " ")


def venue_line(full: Column, city: Column) -> Column:
    return F.when(filled(full).isNotNull(), F.when(filled(city).isNotNull(), F.concat(full, F.lit(", "), city)).otherwise(full))


def completed_instant(stamp: Column, day: Column, time: Column) -> Column:
    """The season feed's instant as text, with a zone."""
    made = F.coalesce(filled(stamp), F.when(filled(day).isNotNull(), F.concat(day, F.lit("T"), F.coalesce(filled(time), F.lit("00:00:00")))))
    return F.when(made.rlike(r"(?i)(Z|[+-]\d\d:?\d\d)$"), made).otherwise(F.concat(made, F.lit("Z")))


def instant(text: Column) -> Column:
    """ISO text as a timestamp; text without a zone takes the session's."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm[:ss][.SSS][XXX]")), text.try_cast("timestamp"))


def known_zone(zone: str | None) -> bool:
    import zoneinfo

    try:
        return zone is None or bool(zoneinfo.ZoneInfo(zone))
    except (zoneinfo.ZoneInfoNotFoundError, ValueError):
        return False


def in_zone(kick: Column, zone: str | None) -> Column:
    """A UTC instant on the clock of a zone (UTC if none is given)."""
    at = kick.cast("timestamp_ntz")
    return at if zone is None else F.convert_timezone(F.lit("UTC"), F.lit(zone), at)


def day_key(kick: Column, raw: Column, zone: str | None) -> Column:
    """Calendar day in a zone as text; an unknown zone falls back to the text's first ten characters."""
    if not known_zone(zone):
        return F.when(filled(raw).isNotNull(), F.substring(raw, 1, 10))
    return F.when(filled(raw).isNotNull(), F.coalesce(F.date_format(in_zone(kick, zone), "yyyy-MM-dd"), F.lit("Invalid Date")))


def date_label(kick: Column, raw: Column, zone: str | None = None) -> Column:
    """Short weekday, month and day in a zone; an unknown zone gives the text's first ten characters or ''."""
    if not known_zone(zone):
        return F.coalesce(F.substring(raw, 1, 10), F.lit(""))
    return F.coalesce(F.date_format(in_zone(kick, zone), "E, MMM d"), F.lit("Invalid Date"))


def time_label(kick: Column, zone: str | None = None) -> Column:
    """Two-digit hour and minute in a zone; '' for an unknown zone."""
    if not known_zone(zone):
        return F.lit("")
    return F.coalesce(F.date_format(in_zone(kick, zone), "hh:mm a"), F.lit("Invalid Date"))


def in_days(raw: Column, days: Column) -> Column:
    """Whether the text's first ten characters are among an array of days; false without a text."""
    return F.coalesce(F.array_contains(days, F.substring(filled(raw), 1, 10)), F.lit(False))


def utc_window(now: Column) -> Column:
    """(days, fetch_range): the day before, of and after an instant in UTC, and the range to fetch, which starts a day earlier."""
    day = lambda k, form: F.date_format(F.date_add(F.to_date(now), k), form)
    days = F.array(*[day(k, "yyyy-MM-dd") for k in (-1, 0, 1)])
    return F.struct(days.alias("days"), F.concat(day(-2, "yyyyMMdd"), F.lit("-"), day(1, "yyyyMMdd")).alias("fetch_range"))


def days_from(kick: Column, raw: Column, now: Column, zone: str | None = None) -> Column:
    """Whole days of a match from today in a zone: 0 today, 1 tomorrow, -1 yesterday; null if it has no day there.

    With an unknown zone both sides are the text's prefix and the instant's UTC day.
    """
    today = F.to_date(in_zone(now, zone if known_zone(zone) else None))
    return F.datediff(day_key(kick, raw, zone).try_cast("date"), today)


def near_today(kick: Column, raw: Column, now: Column, zone: str | None = None) -> Column:
    """Whether a match is yesterday, today or tomorrow in a zone."""
    return F.coalesce(days_from(kick, raw, now, zone).between(-1, 1), F.lit(False))


def unicode_trim(c: Column) -> Column:
    space = r"[\s\x{A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
    return F.regexp_replace(c, f"^{space}|{space}$", "")
