"""Column expressions for log lines: all native, all inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The shapes of a log line and of a block id. (?Ud): Unicode classes, and only \n ends a
# line. The separator class adds U+001C to U+001F.
_SEP = r"[\s\x1c-\x1f]+"
LINE_PATTERN = rf"(?Ud)^(\d{{6}}){_SEP}(\d{{6}}){_SEP}(\d+){_SEP}(\w+){_SEP}([\w.$]+):{_SEP}(.+)$"
BLOCK_PATTERN = r"(?U)blk_-?\d+"
# Rank of each level; levels not named rank 0.
LEVEL_RANK = {"FATAL": 4, "ERROR": 3, "WARN": 2, "INFO": 1, "DEBUG": 0}
# Words that mark a failure.
FAILURE_KEYWORDS = ["corrupt", "error", "fail", "exception", "timeout", "unable", "lost", "disconnect"]
ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once: a lambda's variable is bound, never inlined."""
    return F.transform(F.array(value), body)[0]


def strip(line: Column) -> Column:
    """Without undecodable bytes, and without Unicode white space at both ends."""
    decoded = F.when(F.is_valid_utf8(line), line).otherwise(F.replace(F.make_valid_utf8(line), F.lit("\ufffd"), F.lit("")))
    return F.regexp_replace(decoded, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def line_fields(line: Column) -> Column:
    """The six fields of a line as an array, null where it has not the log shape; one pass for all of them.

    A line that matches always changes. Only the last field can hold U+0001, which the split limit leaves alone.
    """
    marked = F.regexp_replace(line, LINE_PATTERN, "$1\u0001$2\u0001$3\u0001$4\u0001$5\u0001$6")
    return let(marked, lambda m: F.when(m != line, F.split(m, "\u0001", 6)))


def time_of(day: Column, time: Column) -> Column:
    """TIMESTAMP_NTZ of yyMMdd and HHmmss; years 69 to 99 are 19xx. Null for an impossible time."""
    number = lambda c, i: F.substring(c, i, 2).try_cast("int")
    year = number(day, 1) + F.when(number(day, 1) >= 69, 1900).otherwise(2000)
    return F.when(
        (number(time, 5) < 60) & (number(time, 1) < 24),
        F.try_make_timestamp_ntz(year, number(day, 3), number(day, 5), number(time, 1), number(time, 3), number(time, 5).cast("decimal(16,6)")),
    )


def iso_timestamp(ts: Column, day: Column, time: Column) -> Column:
    """ISO text of ``ts``; an impossible time, for which it is null, keeps its digits, always as 20yy."""
    part = lambda c, i: F.substring(c, i, 2)
    kept = F.concat(F.lit("20"), part(day, 1), F.lit("-"), part(day, 3), F.lit("-"), part(day, 5), F.lit("T"), part(time, 1), F.lit(":"), part(time, 3), F.lit(":"), part(time, 5))
    return F.coalesce(F.date_format(ts, ISO_FORMAT), kept)


def block_id(message: Column) -> Column:
    """The first block id in a message, else null."""
    found = F.regexp_extract(message, BLOCK_PATTERN, 0)
    return F.when(found != "", found)


def level_rank(level: Column) -> Column:
    rank = F.create_map(*[F.lit(x) for pair in LEVEL_RANK.items() for x in pair])
    return F.coalesce(rank[level], F.lit(0))


def iso(ts: Column) -> Column:
    return F.date_format(ts, ISO_FORMAT)


# The colours of a severity.
def severity_color(severity: Column) -> Column:
    return F.when(severity == "ERROR", "red").when(severity == "WARN", "orange").otherwise("green")
