"""Line filters over whole texts, without splitting them into rows."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def drop_lines(text: Column, patterns: list[str]) -> Column:
    """The text without the lines that match one of the patterns."""
    hit = lambda x: F.coalesce(x.rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(False))
    return F.concat_ws("\n", F.filter(F.split(text, "\n", -1), lambda x: ~hit(x)))


def trim_blank_tail(text: Column) -> Column:
    """The text without the newlines at its end; a last line of spaces stays."""
    return F.regexp_replace(text, r"\n+\z", "")
