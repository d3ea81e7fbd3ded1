"""Column functions that infer year, day, author and repository from a path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed patterns of years and days in path parts.
YEAR = "(?i)(?:20\\d{2}|aoc[\\s_-]?\\d{2}|adventofcode\\d{2,4})"
YEAR_WHOLE = "(?i)(?:20\\d{2}|aoc[\\s_-]?(?:20)?\\d{2}|adventofcode\\d{2,4})"
DAY_WORD = "(?i)(?:^|/)[^/]*?\\b(?:day|d)[\\s_-]?(\\d{1,2})\\b"
DAY_BARE = "^(0?[1-9]|1\\d|2[0-5])(?:\\D|$)"
DAY_SUFFIXED = "(?i)^day[_-]?(0?[1-9]|1\\d|2[0-5])(?:[_-][ab])?$"
DAY = "^(?:0?[1-9]|1\\d|2[0-5])$"
DAY_NAME = "(?i)^(day[\\s_-]?\\d{1,2}|d\\d{1,2}|\\d{1,2})(?:[\\s_-].*)?$"


def parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))


def name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(file: Column) -> Column:
    """A file name without its last suffix; a leading or a last dot is none."""
    return F.regexp_replace(file, "^(.+)\\.[^.]+$", "$1")


def parent_name(path: Column) -> Column:
    return F.coalesce(F.try_element_at(F.split(path, "/"), F.lit(-2)), F.lit(""))


def infer_year(path: Column, fixed: bool = False) -> Column:
    """The year of the first part that matches.  By default ``aoc2021`` reads as ``aoc20``; ``fixed`` mends that.

    No match runs over a slash, so the first one in the path is the first part's."""
    hit = F.regexp_extract(path, YEAR_WHOLE if fixed else YEAR, 0)
    return F.regexp_replace(F.nullif(F.regexp_extract(hit, "\\d{2,4}", 0), F.lit("")), "^(\\d{2})$", "20$1")


def _day(digits: Column) -> Column:
    """Two digits; null for an empty text."""
    return F.nullif(F.lpad(digits, 2, "0"), F.lit("00"))


def infer_day(path: Column) -> Column:
    """Two digits, from the most specific hint: a day word, a bare number, a suffixed day, the folder.

    Of each part its first day word counts, and of the parts the last one whose day is 1 to 25."""
    words = F.filter(F.regexp_extract_all(path, F.lit(DAY_WORD), F.lit(1)), lambda d: d.rlike(DAY))
    file = stem(name(path))
    return F.coalesce(_day(F.try_element_at(words, F.lit(-1))), _day(F.regexp_extract(file, DAY_BARE, 1)), _day(F.regexp_extract(file, DAY_SUFFIXED, 1)), _day(F.regexp_extract(stem(parent_name(path)), DAY_BARE, 1)))


def is_python(path: Column) -> Column:
    return F.regexp_like(name(path), F.lit("^.+\\.py$"))


def is_valid_solution(path: Column, years: list[str]) -> Column:
    return is_python(path) & F.coalesce(infer_year(path).isin(*years), F.lit(False))


def is_day_file(path: Column) -> Column:
    return is_python(path) & stem(name(path)).rlike(DAY_NAME)


def is_day_folder(path: Column) -> Column:
    return parent_name(path).rlike(DAY_NAME)


def below_repos(path: Column) -> Column:
    """The parts after the ``repos`` folder: user, repository, then the file's own path."""
    p = parts(path)
    return F.slice(p, F.array_position(p, "repos").cast("int") + 1, F.size(p))
