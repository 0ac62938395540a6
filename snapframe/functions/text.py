"""Column expressions that read text: scoreboards, URLs, titles and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and tables read from scoreboards, addresses and titles.
DOWN_DISTANCE = r"(?i)\b([1Il234](?:st|nd|rd|th))\s*&\s*(\d{1,2}|goal)\b"
CLOCK = r"(?i)\b([1Il234](?:st|nd|rd|th)|OT)\b\D{0,4}(\d{1,2})[:.,]{1,2}(\d{2})\b"
QUARTERS = {"1st": 1, "ist": 1, "lst": 1, "2nd": 2, "3rd": 3, "4th": 4, "ot": 5}
MOST_CLOCK_MINUTES = 20
VIDEO_ID = r"^[A-Za-z0-9_-]{11}$"
ADDRESS_ID = r"(?:[?&]v=|youtu\.be/|/embed/)([A-Za-z0-9_-]{11})"
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
VERSUS = r"(\w+(?:\s+\w+)?)\s+(?:VS\.?|@)\s+(\w+(?:\s+\w+)?)"
YEAR = r"(20\d{2}|2\d{3})"
PLAYOFF = r"(?:CFP|COLLEGE FOOTBALL PLAYOFF)\s+(?:FINAL|SEMIFINAL|CHAMPIONSHIP|ELITE EIGHT|ROUND OF (?:16|12|8))"
ALIASES = {
    "ala": "Alabama", "lsu": "LSU", "texas": "Texas", "ohio st": "Ohio State", "georgia": "Georgia", "oklahoma": "Oklahoma", "clemson": "Clemson",
    "fl": "Florida", "bama": "Alabama", "ttu": "Texas Tech", "osu": "Ohio State", "ok state": "Oklahoma State", "u of a": "Arizona", "u of m": "Michigan",
}
BANDWIDTH = ((5, "1080p"), (3, "720p"), (1, "480p"))
LEVELS = (("nfl", ("nfl", "pro", "national football league")), ("high_school", ("high school", "hs ", "prep")))


def _let(value: Column, body) -> Column:
    """Evaluate `value` once and use it several times inside `body`."""
    return F.transform(F.array(value), body)[0]


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def down_and_distance(text: Column) -> Column:
    """Such as '3rd & 7', lower-cased; null if there is none."""
    return F.lower(_found(text, DOWN_DISTANCE, 0))


def game_clock(text: Column) -> Column:
    """(quarter, seconds) of a clock; null if unreadable or beyond twenty minutes."""
    quarter = F.create_map(*(F.lit(x) for kv in QUARTERS.items() for x in kv))[F.lower(_found(text, CLOCK, 1))]
    minutes, seconds = _found(text, CLOCK, 2).cast("int"), _found(text, CLOCK, 3).cast("int")
    total = minutes * 60 + seconds
    return F.when(quarter.isNotNull() & (total <= 60 * MOST_CLOCK_MINUTES), F.struct(quarter.alias("quarter"), total.alias("seconds")))


def video_id(address: Column) -> Column:
    """The id in an address or a bare id; for other hosts the first 11 digits of the address's SHA-256."""
    trimmed = F.trim(address)
    other = F.when(trimmed.rlike(r"^https?://"), F.substring(F.sha2(trimmed, 256), 1, 11))
    return F.coalesce(_found(trimmed, ADDRESS_ID), F.when(trimmed.rlike(VIDEO_ID), trimmed), other)


def is_video_id(text: Column) -> Column:
    return text.rlike(VIDEO_ID)


def is_email(text: Column) -> Column:
    return text.rlike(EMAIL)


def is_safe_path(path: Column) -> Column:
    """A relative path that cannot leave its folder."""
    return ~path.rlike(r"(^|/)\.\.(/|$)") & ~path.startswith("/") & ~path.contains("\x00")


def host(address: Column) -> Column:
    return F.lower(_found(address, r"^https?://([^/:?#]+)"))


def is_accepted_source(address: Column, hosts: tuple[str, ...], extensions: tuple[str, ...]) -> Column:
    """A known host or one of its subdomains, or a path with a known file extension."""
    at = host(address)
    known = F.lit(False)
    for h in hosts:
        known = known | (at == h) | at.endswith("." + h)
    path = F.lower(_found(address, r"^https?://[^/?#]+([^?#]*)"))
    for x in extensions:
        known = known | F.coalesce(path.endswith(x), F.lit(False))
    return F.coalesce(known, F.lit(False))


def team_name(name: Column, aliases: dict[str, str] = ALIASES) -> Column:
    """The first alias, in order, that the name contains; otherwise the name in title case."""
    pairs = F.array(*(F.struct(F.lit(part).alias("part"), F.lit(full).alias("full")) for part, full in aliases.items()))
    found = _let(F.lower(F.trim(name)), lambda n: F.get(F.filter(pairs, lambda p: n.contains(p["part"])), F.lit(0))["full"])
    return F.coalesce(found, F.initcap(F.trim(name)))


def teams(text: Column) -> Column:
    """The two sides of 'A vs B' or 'A @ B'; null if the text names none."""
    upper = F.upper(text)
    home, away = _found(upper, VERSUS, 1), _found(upper, VERSUS, 2)
    return F.when(home.isNotNull() & away.isNotNull(), F.struct(team_name(home).alias("team1"), team_name(away).alias("team2")))


def year(text: Column, last: int) -> Column:
    """The first year-like number, if it lies from 2000 to `last`."""
    found = _found(text, YEAR).cast("int")
    return F.when(found.between(2000, last), found)


def level(text: Column) -> Column:
    """Level of play by known substrings in order, college by default."""
    lowered, out = F.lower(text), F
    for name, parts in LEVELS:
        some = F.lit(False)
        for part in parts:
            some = some | lowered.contains(part)
        out = out.when(some, name)
    return out.otherwise("college")


def playoff_round(text: Column) -> Column:
    """Round a text names; 'final' also matches in 'semifinal', so semifinals count as championships."""
    found = _found(F.upper(text), PLAYOFF, 0)
    out = F.when(found.contains("CHAMPIONSHIP") | found.contains("FINAL"), "CFP_CHAMPIONSHIP").when(found.contains("ELITE EIGHT"), "CFP_ELITE_EIGHT")
    for n in ("16", "12", "8"):
        out = out.when(found.endswith(n), f"CFP_ROUND_OF_{n}")
    return out


def title_metadata(title: Column, description: Column, last_year: int) -> Column:
    """What a title and description tell, with a fixed confidence for each field found."""
    both = F.concat_ws(" ", title, description)
    sure = lambda c, p: F.when(c.isNotNull(), p).otherwise(0.0)
    read = _let(both, lambda b: F.struct(teams(b).alias("sides"), year(b, last_year).alias("year"), level(b).alias("level"), playoff_round(b).alias("stage")))
    return _let(
        F.struct(read.alias("r"), F.substring(description, 1, 500).alias("description")),
        lambda x: F.struct(
            x["r"]["sides"]["team1"].alias("team1"),
            x["r"]["sides"]["team2"].alias("team2"),
            sure(x["r"]["sides"], 0.8).alias("teams_confidence"),
            x["r"]["year"].alias("year"),
            sure(x["r"]["year"], 0.9).alias("year_confidence"),
            x["r"]["level"].alias("level"),
            x["r"]["stage"].alias("cfp_round"),
            sure(x["r"]["stage"], 0.7).alias("cfp_confidence"),
            x["description"].alias("description"),
        ),
    )


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def is_jersey(text: Column) -> Column:
    """One to three characters."""
    return F.length(text).between(1, 3)


def frame_index(path: Column) -> Column:
    return _found(path, r"frame_(\d+)").cast("int")


def play_suffix(play_index: Column) -> Column:
    return F.when(play_index.isNotNull(), F.format_string("_p%04d", play_index)).otherwise("")


def row_key(prefix: str, index: Column, play_index: Column, width: int = 6) -> Column:
    """Zero-padded key of a row, with its play if it has one."""
    return F.concat(F.format_string(f"{prefix}_%0{width}d", index), play_suffix(play_index))


def quality_for(megabits: Column) -> Column:
    """Stream quality a bandwidth can carry."""
    out = F
    for edge, name in BANDWIDTH:
        out = out.when(megabits >= edge, name)
    return out.when(megabits > 0, "360p").otherwise("auto")


def age_minutes(since: Column, now: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(since)) / 60_000_000
