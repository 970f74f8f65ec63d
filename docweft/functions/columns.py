"""Column expressions shared by the operators. All run inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sorts before every real instant; stands for a commit date that cannot be read.
NO_INSTANT = -(2**62)
#: Sorts after every real instant.
FOREVER = 2**62


def instant(commit_date: Column) -> Column:
    """Microseconds since the epoch of an RFC 3339 text; NO_INSTANT for null or unreadable ones."""
    return F.coalesce(F.unix_micros(F.try_to_timestamp(F.upper(F.trim(commit_date)))), F.lit(NO_INSTANT))


def comparable_text(content: Column) -> Column:
    """The form in which two texts count as the same.

    Null counts as empty; runs of blanks become one space, outer ones vanish; link targets lose all before their ``#``.
    """
    one_space = F.regexp_replace(F.coalesce(content, F.lit("")), r"[\t\r\n][ \t\r\n]*| [ \t\r\n]+", " ")
    return F.regexp_replace(F.trim(one_space), r"\]\([^)#]*#", "](#")


def text_digest(content: Column) -> Column:
    """16 bytes that are equal for equal comparable texts; all that is shuffled of a text."""
    return F.unhex(F.md5(comparable_text(content)))


def norm_spec(to_spec: Column) -> Column:
    """Spec names match without regard to case or outer blanks."""
    return F.lower(F.btrim(to_spec, F.lit(" \t\r\n")))


def norm_anchor(to_anchor: Column) -> Column:
    """An anchor without one leading ``#`` and with %XX escapes decoded as UTF-8.

    A percent sign that starts no escape stays; a plus sign stays a plus sign.
    """
    bare = F.when(to_anchor.startswith("#"), F.substring(to_anchor, 2, 2**30)).otherwise(to_anchor)
    safe = F.replace(F.regexp_replace(bare, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B"))
    return F.when(F.contains(bare, F.lit("%")), F.coalesce(F.try_url_decode(safe), bare)).otherwise(bare)


def key_hashes(*cols: Column) -> list[Column]:
    """Two independent 64-bit hashes of a composite key, together a 128-bit name for it."""
    return [F.xxhash64(*cols), F.xxhash64(F.lit("second"), *reversed(cols))]


def ascii_lower(c: Column) -> Column:
    """Lower case for A to Z only, as the reference store folds names."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
