"""Label cleaning as Column expressions (no Python UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The class vocabulary in id order.
CLASSES = [
    "benign", "ddos", "dos_hulk", "dos_goldeneye", "dos_slowloris", "dos_slowhttptest", "portscan", "bot",
    "ftp_patator", "ssh_patator", "web_sql_injection", "web_xss", "web_bruteforce", "infiltration", "heartbleed", "unknown",
]

# The text that marks a class; the first that occurs wins.
MARKS = [
    ("benign", "benign"), ("ddos", "ddos"), ("dos_hulk", "dos_hulk"), ("goldeneye", "dos_goldeneye"),
    ("slowloris", "dos_slowloris"), ("slowhttptest", "dos_slowhttptest"), ("portscan", "portscan"), ("bot", "bot"),
    ("ftp_patator", "ftp_patator"), ("ssh_patator", "ssh_patator"), ("sql", "web_sql_injection"), ("xss", "web_xss"),
    ("brute_force", "web_bruteforce"), ("infiltration", "infiltration"), ("heartbleed", "heartbleed"),
]

# Words of which one stands in the name of a field that holds classes as ids; classes as texts are known by content alone.
LABEL_WORDS = r"(?:^|_)(?:label|class|attack|category|target|verdict)(?:_|$)"


def fold(c: Column) -> Column:
    """Lower case, ASCII only, runs of hyphen, blank, slash and underscore as one underscore."""
    ascii_only = F.regexp_replace(F.lower(F.trim(c)), r"[^\x00-\x7F]", "")
    return F.regexp_replace(F.translate(ascii_only, "- /", "___"), "_+", "_")


def canonical_label(c: Column) -> Column:
    """The class a label text names; unknown if null or none of the marks occurs."""

    def first_mark(f: Column) -> Column:
        out = F.when(f.isNull(), F.lit("unknown"))
        for mark, name in MARKS:
            out = out.when(f.contains(mark), F.lit(name))
        return out.otherwise(F.lit("unknown"))

    # the array of one makes the folded text a variable that is computed once
    return F.transform(F.array(fold(c)), first_mark)[0]


def names_class(c: Column) -> Column:
    """canonical_label(c) != 'unknown', by one pattern."""
    return fold(c).rlike("|".join(mark for mark, _ in MARKS))


def label_id(c: Column) -> Column:
    """The class id, or null for a name outside the vocabulary."""
    m = F.create_map(*[x for i, n in enumerate(CLASSES) for x in (F.lit(n), F.lit(i))])
    return m[c]


def class_name(i: Column) -> Column:
    m = F.create_map(*[x for k, n in enumerate(CLASSES) for x in (F.lit(k), F.lit(n))])
    return m[i]


def class_key(attack_type: Column, vocab_name: Column) -> Column:
    """Trimmed, lower case, each run of blank, slash and hyphen as one underscore; if null, the vocabulary's name."""
    return F.coalesce(F.regexp_replace(F.lower(F.trim(attack_type)), r"[ /\-]+", "_"), vocab_name)
