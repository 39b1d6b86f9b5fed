"""Rows that fail to parse, set apart with the reason.

Lines: cells are exploded into (line, column, value), a rule table (type of the field in its file, label or not)
is joined, every rule is evaluated, the errors are aggregated per line, and the clean lines are what an anti-join
with the errors leaves. Rules reach the lines as one code string a file, so cells never shuffle.
Vectors: the text is split into entries, exploded and checked the same way.

Reasons, the first that applies: quoting, column_count, bad_value. Null lines and vectors are no rows at all and
give no reason; an empty line has one empty cell (column_count unless the header has one field).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions.labels import CLASSES, LABEL_WORDS, fold, names_class
from flowloom.operators.drift import field_table
from flowloom.sources.delimited import cells_of, headers, is_decimal, is_int, quoting_broken, unquoted, with_header

REASONS = ["quoting", "column_count", "bad_value"]
NUMBER = r"^(?:[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|[+-]?Infinity|NaN|null)$"
WRAPPED = r'(?s)^\{\s*"type"\s*:\s*\d+\s*,\s*"values"\s*:\s*(.*?)\s*\}$'


def rule_table(fields: DataFrame) -> DataFrame:
    """(file_id, rules): one character a field: i, d or t for its type, capital if the field is the label."""
    label = f"(f.n_class * 2 >= f.n and f.n > 0) or (f.name rlike '{LABEL_WORDS}' and (f.n_class + f.n_id) * 2 >= f.n)"
    code = "case f.kind when 'integer' then 'i' when 'decimal' then 'd' else 't' end"
    return fields.select("file_id", F.expr(f"array_join(transform(fields, f -> if({label}, upper({code}), {code})), '')").alias("rules"))


def label_unknown(v: Column) -> Column:
    """A non-blank label that names no class and is no id of the vocabulary."""
    known = names_class(v) | (fold(v) == "unknown") | F.regexp_replace(v, "^[+]?0*(?=[0-9])", "").isin(*[str(i) for i in range(len(CLASSES))])
    return ~known


def line_errors(lines: DataFrame, fields: DataFrame | None = None) -> DataFrame:
    """(line_id, reason, n_errors): the lines that cannot be read."""
    fields = fields if fields is not None else field_table(lines)
    rules = headers(lines).select("file_id", "delim", "width").join(rule_table(fields), "file_id")
    j = with_header(lines.select("file_id", "line_id", "line_no", "line_text").where("line_text is not null"), rules)
    t, d = F.col("line_text"), F.col("delim")
    j = j.select("line_id", "width", "rules", quoting_broken(t, d).alias("broken"), cells_of(t, d).alias("cells"))
    whole = F.when(F.col("broken"), 0).when(F.size("cells") != F.col("width"), 1)
    j = j.withColumn("whole", whole)
    # a line that fails as a whole is one cell of error; the others are exploded into their cells
    cells = j.select("line_id", "rules", "whole", F.posexplode(F.when(F.col("whole").isNotNull(), F.array(F.lit(""))).otherwise(F.col("cells"))).alias("pos", "cell"))
    cells = cells.select("line_id", "whole", unquoted(F.col("cell")).alias("v"), F.substring("rules", F.col("pos") + 1, F.lit(1)).alias("rule"))
    v, r = F.col("v"), F.col("rule")
    bad = F.when(v == "", False).when(r.isin("i", "I") & ~is_int(v), True).when(r.isin("d", "D") & ~(is_int(v) | is_decimal(v)), True).otherwise(F.when(r.isin("I", "D", "T"), label_unknown(v)).otherwise(False))
    code = F.coalesce(F.col("whole"), F.when(bad, F.lit(2)))
    failed = cells.select("line_id", code.alias("code")).where("code is not null")
    return failed.groupBy("line_id").agg(F.min("code").alias("c"), F.count("*").alias("n_errors")).select("line_id", _reason(F.col("c")).alias("reason"), "n_errors")


def _reason(c: Column) -> Column:
    return F.element_at(F.array(*[F.lit(r) for r in REASONS]), c + 1)


def clean_lines(lines: DataFrame, errors: DataFrame) -> DataFrame:
    """The lines that load: all but headers, null lines and lines with an error."""
    return lines.where("line_no > 1 and line_text is not null").join(errors.select("line_id"), "line_id", "left_anti")


def vector_body(text: Column) -> Column:
    """The text between the brackets, trimmed; null if a bracket is missing or a quote stands inside."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    inner = F.when(t.startswith("{"), F.regexp_extract(t, WRAPPED, 1)).otherwise(t)
    body = inner.substr(F.lit(2), F.length(inner) - 2)
    framed = (F.length(inner) >= 2) & inner.startswith("[") & inner.endswith("]")
    return F.when(framed & ~body.rlike(r"[\[\]\"']"), body)


def vector_errors(df: DataFrame, key: str, text: str, size: int = 78) -> DataFrame:
    """(key, reason, n_errors), once a key: vectors that cannot be read."""
    v = df.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), vector_body(F.col(text)).alias("body"))
    v = v.withColumn("cells", F.split("body", ",", -1))
    v = v.select("k", F.when(F.col("body").isNull(), 0).when(F.size("cells") != size, 1).alias("whole"), "cells")
    cells = v.select("k", "whole", F.explode(F.when(F.col("whole").isNotNull(), F.array(F.lit("0"))).otherwise(F.col("cells"))).alias("cell"))
    code = F.coalesce(F.col("whole"), F.when(~F.trim("cell").rlike(NUMBER), F.lit(2)))
    failed = cells.select("k", code.alias("code")).where("code is not null")
    return failed.groupBy("k").agg(F.min("code").alias("c"), F.count("*").alias("n_errors")).select(F.col("k").alias(key), _reason(F.col("c")).alias("reason"), "n_errors")


def parsed_vectors(df: DataFrame, key: str, text: str, size: int = 78) -> DataFrame:
    """The rows whose own vector reads, with `vector` array<double>; null entries stay null."""
    cells = F.split(vector_body(F.col(text)), ",", -1)
    # each row by itself: a damaged repeat of a key leaves the key's other rows
    ok = df.where(F.col(text).isNotNull()).withColumn("__cells", cells).where((F.size("__cells") == size) & F.forall("__cells", lambda x: F.trim(x).rlike(NUMBER)))
    return ok.withColumn("vector", F.transform("__cells", lambda x: F.trim(x).try_cast("double"))).drop("__cells")
