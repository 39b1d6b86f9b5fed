"""Delimited lines whose delimiter, quoting and header differ from file to file, parsed JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The delimiters that occur, in the order that decides ties.
DELIMITERS = [",", ";", "\t", "|"]
LITERAL = {",": ",", ";": ";", "\t": "\t", "|": "\\|"}

INT = r"^[+-]?[0-9]+$"
DEC = r"^(?:[+-]?(?:[0-9]+\.[0-9]*|\.[0-9]+|Infinity)|NaN)$"


def by_delimiter(delim: Column, f) -> Column:
    out = None
    for d in DELIMITERS:
        out = F.when(delim == d, f(d)) if out is None else out.when(delim == d, f(d))
    return out


def quoting_broken(text: Column, delim: Column) -> Column:
    """True if a double quote is unclosed, stands in an unquoted cell or is followed by other than a delimiter.

    Well-formed quoted cells are cut out; any quote that is left is a broken one.
    """
    left = by_delimiter(delim, lambda d: F.regexp_replace(F.concat(F.lit(d), text), f'(?<={LITERAL[d]})"[^"]*+(?:""[^"]*+)*+"(?={LITERAL[d]}|$)', ""))
    return text.contains('"') & left.contains('"')


def cells_of(text: Column, delim: Column) -> Column:
    """The cells as written; quoted cells keep their quotes (see unquoted)."""
    plain = by_delimiter(delim, lambda d: F.split(text, LITERAL[d], -1))
    quoted = by_delimiter(
        delim,
        lambda d: F.regexp_extract_all(F.concat(F.lit(d), text), F.lit(f'{LITERAL[d]}("[^"]*+(?:""[^"]*+)*+"|[^"{LITERAL[d]}]*+)'), F.lit(1)),
    )
    return F.when(text.contains('"'), quoted).otherwise(plain)


def unquoted(cell: Column) -> Column:
    return F.trim(F.when(cell.startswith('"'), F.replace(cell.substr(F.lit(2), F.length(cell) - 2), F.lit('""'), F.lit('"'))).otherwise(cell))


def field_name(cell: Column) -> Column:
    """Lower case; every run of characters other than letters and digits is one underscore, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(cell), "[^a-z0-9]+", "_"), F.lit("_"))


def headers(lines: DataFrame) -> DataFrame:
    """One row a file: file_id, delim, names, width. Line 1 is the header; files without one give no row."""
    h = lines.where("line_no = 1 and line_text is not null").groupBy("file_id").agg(F.min("line_text").alias("__h"))
    t = F.col("__h")
    counts = {d: F.length(t) - F.length(F.replace(t, F.lit(d), F.lit(""))) for d in DELIMITERS}
    best = F.greatest(*counts.values())
    delim = None
    for d in DELIMITERS:
        delim = F.when(counts[d] == best, F.lit(d)) if delim is None else delim.when(counts[d] == best, F.lit(d))
    h = h.withColumn("delim", delim).withColumn("names", F.transform(cells_of(t, F.col("delim")), field_name))
    return h.select("file_id", "delim", "names", F.size("names").alias("width"))


def with_header(lines: DataFrame, head: DataFrame) -> DataFrame:
    """Every later line with its file's header row; a shuffle on file_id in which AQE splits large files."""
    body = lines.where("line_no > 1")
    return body.join(head.hint("shuffle_hash"), "file_id")


def is_int(v: Column) -> Column:
    return v.rlike(INT)


def is_decimal(v: Column) -> Column:
    return v.rlike(DEC)
