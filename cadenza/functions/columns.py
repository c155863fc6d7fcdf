"""Scalar column expressions used by the jobs.

All of these build Catalyst expressions, so they run inside whole-stage
codegen; none is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the application's behaviour.
SEED_LIMIT = 5                 # genres + artists combined (F3)
MAX_QUERIES = 6                # queries kept per request (F4, W5)
HITS_PER_QUERY = 10            # search hits kept per query (W5)
TOP_ITEMS_PER_RANGE = 50       # ranked items read per time range (S10)
RECENT_PLAYS = 100             # two pages of 50 recent plays (S11)
DEFAULT_LIMIT = 30             # criteria limit default, valid range 1..100
DEFAULT_MARKET = "FR"
FEATURE_DEFAULTS = {"energy": 0.5, "valence": 0.5, "danceability": 0.5,
                    "acousticness": 0.5, "tempo": 120.0}
FALLBACK_QUERY = "genre:indie year:2010-2024"
TIME_RANGES = ["short_term", "medium_term", "long_term"]   # earliest wins
BATCH_SIZE = 100               # tracks per add-to-playlist call (S14)
# Title defaults are our own wording (application copy is not reproduced).
DEFAULT_TITLE = "My Playlist"
DEFAULT_DESCRIPTION = "Generated playlist"
# Base of the track link built when a hit carries no external URL.
TRACK_LINK_BASE = "https://open.example.com/track/"

# Characters Python's str.strip() removes in ASCII text; Spark's one-argument
# trim only removes spaces.
WHITESPACE = " \t\n\r\f\x0b"


def strip_ws(c: Column) -> Column:
    """Trim leading/trailing whitespace the way ``str.strip()`` does (ASCII)."""
    return F.trim(c, F.lit(WHITESPACE))


def year_of(release_date: Column) -> Column:
    """year = first four characters when the text has at least four,
    else NULL.  A non-numeric prefix gives NULL (the application raised)."""
    return F.when(F.length(release_date) >= 4,
                  F.substring(release_date, 1, 4).try_cast("int"))


def year_in_range(year: Column, year_min: Column, year_max: Column) -> Column:
    """P5: inclusive bounds; a NULL *or zero* bound is no bound, and an
    unknown (NULL or zero) year always passes."""
    y = F.nullif(year, F.lit(0))
    lo_ok = F.coalesce(y >= F.nullif(year_min, F.lit(0)), F.lit(True))
    hi_ok = F.coalesce(y <= F.nullif(year_max, F.lit(0)), F.lit(True))
    return lo_ok & hi_ok


def artist_names(artists: Column) -> Column:
    """List of artist structs -> list of names, order kept."""
    return F.transform(artists, lambda a: a["name"])


def first_image_url(images: Column) -> Column:
    """URL of the first album image, NULL when there is none."""
    return F.get(images, 0)["url"]


def strip_fence(text: Column) -> Column:
    """trim; only when the text starts with three backticks, drop the
    opening fence (lower-case tag, optional newline) and the closing fence;
    trim again."""
    t = strip_ws(text)
    unfenced = F.regexp_replace(F.regexp_replace(t, "^```[a-z]*\\n?", ""), "\\n?```$", "")
    return strip_ws(F.when(t.startswith("```"), unfenced).otherwise(t))


def clamp_seeds(genres: Column, artists: Column, trim_genres: bool = True):
    """At most 5 seeds in total, artists dropped from the end
    first, then genres.  Closed form of the pop loop: genres keep their
    first five, artists keep the first ``max(0, 5 - size(genres))``.
    With ``trim_genres=False`` (F3b) the genre list is left as is."""
    kept_genres = F.slice(genres, 1, SEED_LIMIT) if trim_genres else genres
    room = F.greatest(F.lit(0), F.lit(SEED_LIMIT) - F.size(kept_genres))
    return kept_genres, F.slice(artists, 1, room)


def duration_text(duration_ms: Column) -> Column:
    """``m:ss`` from milliseconds, floored to whole seconds; NULL or
    non-positive durations give a dash."""
    secs = F.floor(duration_ms / 1000)
    text = F.concat(F.floor(secs / 60).cast("string"), F.lit(":"),
                    F.lpad((secs % 60).cast("string"), 2, "0"))
    return F.when(duration_ms > 0, text).otherwise(F.lit("-"))


# French month names, January first (F7, browser variant).
FRENCH_MONTHS = ["janvier", "février", "mars", "avril", "mai", "juin", "juillet",
                 "août", "septembre", "octobre", "novembre", "décembre"]


def long_date(ts: Column, french: bool = False) -> Column:
    """"d Month yyyy".  English month names by default (what the server
    template printed); ``french=True`` gives the browser's wording."""
    if not french:
        return F.date_format(ts, "d MMMM yyyy")
    month = F.element_at(F.array(*[F.lit(m) for m in FRENCH_MONTHS]), F.month(ts))
    return F.concat_ws(" ", F.dayofmonth(ts).cast("string"), month, F.year(ts).cast("string"))


def long_date_of(value: Column, french: bool = False) -> Column:
    """F7 of a text: its long date if it is an ISO date (and time), else the
    text as it is."""
    ts = F.when(value.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ].+)?$"), F.try_to_timestamp(value))
    return F.when(ts.isNull(), value).otherwise(long_date(ts, french))


def join_artists(names: Column, sep: str = ", ") -> Column:
    """F8: artist names joined by ``sep`` (", " in text context, " · " in lists)."""
    return F.array_join(names, sep)


def track_link(external_url: Column, track_id: Column) -> Column:
    """the stored external URL, else a link built from the track id."""
    return F.coalesce(F.nullif(external_url, F.lit("")),
                      F.concat(F.lit(TRACK_LINK_BASE), track_id.cast("string")))


def round3(mean: Column) -> Column:
    """Round a mean to three places, half-up on the decimal value.
    Doubles are first fixed to nine decimals so that both Spark and a SQL
    oracle round the same digits."""
    return F.round(mean.cast("decimal(18,9)"), 3).cast("double")


def is_saved(url: Column) -> Column:
    """A playlist is saved when it has a non-empty external URL."""
    return F.coalesce(url.isNotNull() & (url != F.lit("")), F.lit(False))
