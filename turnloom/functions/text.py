"""Text functions over columns. Lengths count code points, so no cut ever splits a character.

White space means the wide set (no-break, ideographic and zero-width no-break spaces, line and paragraph separators
too), since logs come from programs that trim with it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Members of a character class, valid in Java, Python and RE2 patterns alike.
WIDE_SPACE = "\t\n\x0b\x0c\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
ELLIPSIS = "…"
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-%s[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"


def wide_trim(x: Column) -> Column:
    """Without wide white space at either end."""
    return F.regexp_replace(x, f"^[{WIDE_SPACE}]+|[{WIDE_SPACE}]+$", "")


def one_line(x: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(x, f"[{WIDE_SPACE}]+", " "))


def printable_line(x: Column) -> Column:
    """one_line() after control characters become spaces."""
    return one_line(F.regexp_replace(x, r"\p{Cc}", " "))


def safe_line(x: Column) -> Column:
    """One line without terminal escapes, control characters, invisible format marks and line separators."""
    # Fixed value: the pattern of terminal escapes.
    escapes = "\x1b(?:\\][^\x07]*(?:\x07|\x1b\\\\)|\\[[0-?]*[ -/]*[@-~])"
    return one_line(F.regexp_replace(F.regexp_replace(x, escapes, " "), r"[\x00-\x1f\x7f-\x9f\p{Cf}\p{Zl}\p{Zp}]", " "))


def cut_after(x: Column, n: int) -> Column:
    """At most n characters, and an ellipsis behind them if more were there."""
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n), F.lit(ELLIPSIS))).otherwise(x)


def cut_within(x: Column, n: int) -> Column:
    """At most n characters with the ellipsis among them."""
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n - 1), F.lit(ELLIPSIS))).otherwise(x)


def first_visible_line(x: Column) -> Column:
    """The first line that is not blank, trimmed; empty if there is none."""
    lines = F.filter(F.transform(F.split(x, "\n"), wide_trim), lambda line: line != "")
    return F.coalesce(F.get(lines, 0), F.lit(""))


def first_line(x: Column) -> Column:
    """The first line as one line, blank or not."""
    return one_line(F.get(F.split(x, "\n"), 0))


def joined_lines(x: Column) -> Column:
    """Lines trimmed, blank ones dropped, joined by one space."""
    return F.array_join(F.filter(F.transform(F.split(x, "\r?\n"), wide_trim), lambda line: line != ""), " ")


def line_count(x: Column, of_nothing: int) -> Column:
    """Line feeds and one; an empty text has `of_nothing` lines (layouts differ in that)."""
    return F.when(x == "", F.lit(of_nothing)).otherwise(F.size(F.split(x, "\n", -1)))


def iso_utc(moment: Column) -> Column:
    """A timestamp as ISO-8601 UTC with milliseconds."""
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def parsed_iso(x: Column) -> Column:
    """A text as ISO-8601 UTC with milliseconds, or null if it is no time."""
    return iso_utc(F.try_to_timestamp(x))


def to_minute(x: Column) -> Column:
    """An ISO time as YYYY-MM-DD HH:MMZ; other texts as they are."""
    return F.regexp_replace(x, r"(?s)^(\d{4}-\d{2}-\d{2})T(\d{2}:\d{2}).*$", "$1 $2Z")


def thousands(n: Column) -> Column:
    """840 stays 840, 34000 becomes 34k; halves round up."""
    value = F.greatest(F.lit(0), F.floor(n + 0.5))
    return F.when(value >= 1000, F.concat(F.floor(value / 1000 + 0.5).cast("string"), F.lit("k"))).otherwise(value.cast("string"))


def counted(n: Column, one: str, many: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, F.lit(one)).otherwise(F.lit(many)))


def _squeezed(commit: Column) -> Column:
    return F.regexp_replace(commit, f"[{WIDE_SPACE}]+", "")


def short_commit(commit: Column) -> Column:
    return F.substring(_squeezed(commit), 1, 7)


def same_commit(left: Column, right: Column) -> Column:
    """Equal, or one begins with the other and both have at least seven characters; letter case does not count."""
    a, b = F.lower(_squeezed(left)), F.lower(_squeezed(right))
    prefix = (F.length(a) >= 7) & (F.length(b) >= 7) & (a.startswith(b) | b.startswith(a))
    return F.coalesce((a != "") & (b != "") & ((a == b) | prefix), F.lit(False))


def commit_gap(ahead: Column, behind: Column) -> Column:
    """" (14 commits ahead)" and the like; empty if nothing moved."""
    both = F.concat(F.lit(" ("), counted(ahead, "commit", "commits"), F.lit(" ahead, "), behind.cast("string"), F.lit(" behind)"))
    only = lambda n, word: F.concat(F.lit(" ("), counted(n, "commit", "commits"), F.lit(f" {word})"))
    return F.when((ahead > 0) & (behind > 0), both).when(ahead > 0, only(ahead, "ahead")).when(behind > 0, only(behind, "behind")).otherwise("")


def home_relative(path: Column, home: Column) -> Column:
    """Paths at or below the home start with ~."""
    return F.when(path == home, F.lit("~")).when(path.startswith(F.concat(home, F.lit("/"))), F.concat(F.lit("~"), path.substr(F.length(home) + 1, F.length(path)))).otherwise(path)


def id_shape(x: Column) -> Column:
    """"v4" or "v7" for whole UUIDs of these versions, else "other"."""
    return F.when(x.rlike(UUID % "4"), F.lit("v4")).when(x.rlike(UUID % "7"), F.lit("v7")).otherwise(F.lit("other"))


def is_absolute(path: Column) -> Column:
    return F.coalesce(path.startswith("/"), F.lit(False))


def dashed_directory(path: Column) -> Column:
    """A directory as a folder name: everything but ASCII letters and digits becomes a dash."""
    return F.regexp_replace(path, "[^A-Za-z0-9]", "-")


def framed_directory(path: Column) -> Column:
    """A directory as a folder name between double dashes, without the leading separator."""
    return F.concat(F.lit("--"), F.regexp_replace(F.regexp_replace(path, r"^[/\\]", ""), r"[/\\:]", "-"), F.lit("--"))


def seeded_uuid(seed: Column, index: Column) -> Column:
    """A version-4-shaped UUID from the SHA-256 of seed:index, the same on every run."""
    h = F.sha2(F.concat_ws(":", seed, index.cast("string")), 256)
    nibble = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1), F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("4"), F.substring(h, 14, 3)), F.concat(nibble, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def fingerprint(*columns: Column) -> Column:
    """v1-sha256-<hex> of the values in the order given; null is the empty text."""
    return F.concat(F.lit("v1-sha256-"), F.sha2(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]), 256))


def canonical_json(json: Column) -> Column:
    """JSON text with the keys of all objects sorted and no blanks, by way of VARIANT, whose objects are stored in key order.
    A field that is null, one that is '' and one that is not there stay apart; text that is no JSON gives null."""
    # Parsing stops after the first value, so the text is followed by its own digest, which nothing in it can foresee.
    end = F.sha2(json, 256)
    both = F.try_parse_json(F.concat(F.lit("["), json, F.lit(',"'), end, F.lit('"]')))
    return F.when(F.try_variant_get(both, "$[1]", "string") == end, F.to_json(F.try_variant_get(both, "$[0]", "variant")))


def json_fingerprint(json: Column) -> Column:
    """v1-sha256-<hex> of the canonical JSON, so that the order of keys and blanks don't count; null without JSON."""
    return F.concat(F.lit("v1-sha256-"), F.sha2(canonical_json(json), 256))
