"""Schemas that drift between files: profile, match, unify.

Every field of every file is profiled in one pass over its cells: type counts and a mergeable value sketch
(moments of log magnitudes, zeros, time-like and class-like counts). Consecutive versions are compared; fields
that vanished and fields that appeared are the two sides of a bipartite graph weighted by sketch and name
similarity, and the maximum matching names the renames. Only field lists (bounded by the header width) ever
reach Python; cells stay in the JVM.

Defined results: a field without a non-empty value in undamaged lines has no type and is never reported as
retyped; an empty file (no header) takes no part; duplicate header names count once, by first position.
"""

from __future__ import annotations

import difflib
import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions.labels import CLASSES, LABEL_WORDS, canonical_label, class_name, fold, names_class
from flowloom.operators.balanced import balanced_lag
from flowloom.sources.delimited import cells_of, headers, is_decimal, is_int, quoting_broken, unquoted, with_header
from flowloom.session import checkpointed


def undamaged_cells(lines: DataFrame, head: DataFrame) -> DataFrame:
    """(file_id, pos, v): trimmed cells of all lines that parse and have the header's width."""
    j = with_header(lines.select("file_id", "line_no", "line_text"), head.select("file_id", "delim", "width"))
    t, d = F.col("line_text"), F.col("delim")
    j = j.where(t.isNotNull() & ~quoting_broken(t, d)).select("file_id", "width", cells_of(t, d).alias("cells")).where(F.size("cells") == F.col("width"))
    return j.select("file_id", F.posexplode("cells").alias("pos", "cell")).select("file_id", "pos", unquoted(F.col("cell")).alias("v"))


# The least of a field's texts under several orders: two fields agree in about the share of distinct texts they have in common.
SKETCH = [0, 0x2545F4914F6CDD1D, 0x5851F42D4C957F2D, 0x14057B7EF767814F, 0x3C79AC492BA7B653, 0x1C69B3F74AC4AE35]


def profile_fields(lines: DataFrame, head: DataFrame) -> DataFrame:
    """One row per (file_id, pos) with type counts and sketch; partial aggregates are merged by key."""
    v = F.col("v")
    cells = undamaged_cells(lines, head).where(v != "")
    cells = cells.withColumn("k", F.when(is_int(v), 1).when(is_decimal(v), 2).otherwise(3))
    k = F.col("k")
    number = F.when(k < 3, v).otherwise(F.regexp_substr(v, F.lit(r"[0-9]+\.?[0-9]*"))).try_cast("double")
    cells = cells.withColumn("u", F.log1p(F.abs(number)))
    finite = F.col("u").isNotNull() & ~F.isnan("u") & (F.col("u") < F.lit(float("inf")))
    cells = cells.withColumn("u", F.when(finite, F.col("u")))
    return cells.groupBy("file_id", "pos").agg(
        F.count("*").alias("n"),
        F.count_if(k == 1).alias("n_int"),
        F.count_if(k == 2).alias("n_dec"),
        F.count("u").alias("n_num"),
        F.sum("u").alias("s1"),
        F.sum(F.col("u") * F.col("u")).alias("s2"),
        F.count_if(F.col("u") == 0).alias("n_zero"),
        F.count_if(F.when(k == 3, v.rlike(r"[0-9]:[0-9][0-9]|[0-9]T[0-9]{6}")).otherwise((k == 1) & F.length(v).isin(10, 13, 16))).alias("n_time"),
        F.count_if(F.when(k == 3, names_class(v))).alias("n_class"),
        F.count_if((k == 1) & (F.length(v) <= 2)).alias("n_id"),
        *[F.min(F.when(k == 3, F.xxhash64(v).bitwiseXOR(F.lit(seed)))).alias(f"h{i}") for i, seed in enumerate(SKETCH)],
    )


def field_table(lines: DataFrame) -> DataFrame:
    """(file_id, fields): per file the list of its fields with name, kind and sketch, in header order."""
    head = headers(lines)
    prof = profile_fields(lines, head)
    names = head.select("file_id", F.posexplode("names").alias("pos", "name"))
    j = names.join(prof, ["file_id", "pos"], "left")
    n = F.col("n")
    kind = F.when(n.isNull(), F.lit(None)).when(F.col("n_int") * 10 >= n * 9, "integer").when((F.col("n_int") + F.col("n_dec")) * 10 >= n * 9, "decimal").otherwise("text")
    mean = F.try_divide("s1", "n_num")
    field = F.struct(
        "pos", "name", kind.alias("kind"), F.coalesce(n, F.lit(0)).cast("long").alias("n"), F.coalesce("n_num", F.lit(0)).cast("long").alias("n_num"),
        mean.cast("float").alias("mean"), F.sqrt(F.greatest(F.try_divide("s2", "n_num") - mean * mean, F.lit(0.0))).cast("float").alias("sd"),
        F.try_divide(F.col("n_zero"), F.col("n_num")).cast("float").alias("zero"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_time", "n_class", "n_id")],
        F.array(*[F.col(f"h{i}") for i in range(len(SKETCH))]).alias("texts"),
    )
    return j.groupBy("file_id").agg(F.array_sort(F.collect_list(field)).alias("fields"))


def time_cells(lines: DataFrame, fields: DataFrame | None = None) -> DataFrame:
    """(file_id, line_id, time_text): the time cell of all undamaged lines of the files that have a time field.

    The field is known by its content, whatever its name; of several the one with most times, then the first.
    """
    fields = fields if fields is not None else field_table(lines)
    best = "array_sort(transform(filter(fields, f -> f.n > 0 and f.n_time * 2 >= f.n), f -> struct(-f.n_time as n, f.pos as pos)))"
    at = fields.select("file_id", F.get(F.expr(best), F.lit(0))["pos"].alias("pos")).where("pos is not null")
    head = headers(lines).select("file_id", "delim", "width").join(at, "file_id")
    j = with_header(lines.select("file_id", "line_id", "line_no", "line_text"), head)
    t, d = F.col("line_text"), F.col("delim")
    j = j.where(t.isNotNull() & ~quoting_broken(t, d)).withColumn("cells", cells_of(t, d)).where(F.size("cells") == F.col("width"))
    return j.select("file_id", "line_id", unquoted(F.get("cells", F.col("pos"))).alias("time_text"))


def _is_label(f) -> bool:
    return f["n_class"] * 2 >= f["n"] > 0 or re.search(LABEL_WORDS, f["name"]) is not None and (f["n_class"] + f["n_id"]) * 2 >= f["n"]


def shared_texts(a, b) -> float:
    """Estimated share of distinct texts that two fields have in common."""
    pairs = [(x, y) for x, y in zip(a.get("texts") if a.get("texts") is not None else [], b.get("texts") if b.get("texts") is not None else [], strict=False)]
    return sum(x is not None and x == y for x, y in pairs) / len(pairs) if pairs else 0.0


def similarity(a, b) -> float:
    """0 if the contents differ, else 0.5 to 1 by the names' similarity; times and labels match by content alone."""
    name = difflib.SequenceMatcher(None, a["name"], b["name"]).ratio()
    time_a, time_b = (f["n_time"] * 2 >= f["n"] > 0 for f in (a, b))
    label_a, label_b = _is_label(a), _is_label(b)
    if time_a or time_b or label_a or label_b:
        return 0.9 + 0.1 * name if (time_a and time_b) or (label_a and label_b) else 0.0
    if not a["n"] or not b["n"]:
        return 0.5 + 0.5 * name if name >= 0.75 else 0.0
    num_a, num_b = (f["n_num"] * 2 >= f["n"] for f in (a, b))
    if num_a != num_b:
        return 0.0
    if not num_a:
        # the same texts under whatever name; else the names decide, as ids and free texts hardly recur
        common = shared_texts(a, b)
        return 0.5 + 0.5 * max(name, common) if name >= 0.4 or common >= 0.5 else 0.0
    na, nb = a["n_num"], b["n_num"]
    spread = math.sqrt((a["sd"] ** 2 + 0.05) / na + (b["sd"] ** 2 + 0.05) / nb)
    z = abs(a["mean"] - b["mean"]) / spread
    p = (a["zero"] * na + b["zero"] * nb) / (na + nb)
    z0 = abs(a["zero"] - b["zero"]) / math.sqrt((p * (1 - p) + 0.01) * (1 / na + 1 / nb))
    if max(z, z0) > (5.0 if name >= 0.6 else 3.5) or name < 0.4:
        return 0.0
    return 0.5 + 0.5 * name - 0.02 * max(z, z0)


def best_matching(weight: list[list[float]]) -> list[tuple[int, int]]:
    """Maximum-weight bipartite matching (shortest augmenting paths with potentials); zero weights are no edges."""
    n, m = len(weight), len(weight[0]) if weight else 0
    if not n or not m:
        return []
    size = max(n, m)
    cost = [[-(weight[i][j]) if i < n and j < m else 0.0 for j in range(size)] for i in range(size)]
    u, v, match = [0.0] * (size + 1), [0.0] * (size + 1), [0] * (size + 1)
    for i in range(1, size + 1):
        match[0], j0 = i, 0
        low, way, used = [math.inf] * (size + 1), [0] * (size + 1), [False] * (size + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = match[j0], math.inf, 0
            for j in range(1, size + 1):
                if not used[j]:
                    c = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if c < low[j]:
                        low[j], way[j] = c, j0
                    if low[j] < delta:
                        delta, j1 = low[j], j
            for j in range(size + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    low[j] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    return [(match[j] - 1, j - 1) for j in range(1, m + 1) if match[j] - 1 < n and weight[match[j] - 1][j - 1] > 0]


def _change_batches(batches):
    for pdf in batches:
        rows = []
        for fid, gone, come, retyped in zip(pdf["file_id"], pdf["gone"], pdf["come"], pdf["retyped"], strict=True):
            gone = list({f["name"]: f for f in reversed(list(gone))}.values())
            come = list({f["name"]: f for f in reversed(list(come))}.values())
            pairs = best_matching([[similarity(a, b) for b in come] for a in gone])
            rows += [(fid, "renamed", gone[i]["name"], come[j]["name"]) for i, j in pairs]
            rows += [(fid, "removed", f["name"], "") for i, f in enumerate(gone) if i not in {p[0] for p in pairs}]
            rows += [(fid, "added", "", f["name"]) for j, f in enumerate(come) if j not in {p[1] for p in pairs}]
            rows += [(fid, "retyped", n, n) for n in retyped]
        yield pd.DataFrame(rows, columns=["file_id", "change_kind", "field_before", "field_after"])


def schema_changes(lines: DataFrame, files: DataFrame, fields: DataFrame | None = None) -> DataFrame:
    """(file_id, change_kind, field_before, field_after) of each file against the one before it in its feed.

    files: file_id, feed_id, file_seq. Rows of files that are not in it, or with a null feed, give nothing.
    """
    fields = fields if fields is not None else field_table(lines)
    order = files.where("feed_id is not null").select("file_id", "feed_id", "file_seq")
    prev = balanced_lag(order, ["feed_id"], ["file_seq", "file_id"], "file_id", "prev_id").where("prev_id is not null").select("file_id", "prev_id")
    now = fields.select("file_id", F.col("fields").alias("now"))
    was = fields.select(F.col("file_id").alias("prev_id"), F.col("fields").alias("was"))
    j = now.join(prev, "file_id").join(was, "prev_id")
    # hashed set operations on names; the field lists are searched only for the few names that come out of them.
    # Binding those as the variable of a lambda keeps them from being evaluated anew for every field.
    names, typed_names = "transform({}, f -> f.name)", "transform(filter({}, f -> f.kind is not null), f -> f.name)"
    typed = "transform(filter({}, f -> f.kind is not null), f -> concat(f.kind, ' ', f.name))"
    new_kinds = f"transform(array_except({typed.format('now')}, {typed.format('was')}), t -> substring_index(t, ' ', -1))"
    pick = "transform(array({n}), n -> filter({f}, f -> array_contains(n, f.name)))[0]"
    j = (
        j.withColumn("come", F.expr(f"array_except({names.format('now')}, {names.format('was')})"))
        .withColumn("gone", F.expr(f"array_except({names.format('was')}, {names.format('now')})"))
        .withColumn("retyped", F.expr(f"array_intersect({new_kinds}, {typed_names.format('was')})"))
        .where("size(come) + size(gone) + size(retyped) > 0")
        .select("file_id", F.expr(pick.format(n="come", f="now")).alias("come"), F.expr(pick.format(n="gone", f="was")).alias("gone"), "retyped")
    )
    return j.mapInPandas(_change_batches, "file_id long, change_kind string, field_before string, field_after string")


LABEL, TIME = "label", "timestamp"  # Fixed values: the canonical names of the fields that are known by content.


def _role(f) -> str:
    return LABEL if _is_label(f) else TIME if f["n_time"] * 2 >= f["n"] > 0 else ""


def _vocabulary(fields: DataFrame) -> DataFrame:
    """One row a header name over all files, with its pooled counts and sketch."""
    x = fields.select(F.explode("fields").alias("f")).select("f.*")
    w = F.col("n_num")
    total = lambda c: F.sum(c).alias(c)
    v = x.groupBy("name").agg(
        F.count("*").alias("files"), total("n"), total("n_num"), total("n_time"), total("n_class"), total("n_id"),
        F.sum(w * F.col("mean")).alias("s1"), F.sum(w * (F.col("sd") * F.col("sd") + F.col("mean") * F.col("mean"))).alias("s2"), F.sum(w * F.col("zero")).alias("s0"),
    )
    mean = F.coalesce(F.try_divide("s1", "n_num"), F.lit(0.0))
    sd = F.sqrt(F.greatest(F.coalesce(F.try_divide("s2", "n_num"), F.lit(0.0)) - mean * mean, F.lit(0.0)))
    return v.select("name", "files", "n", "n_num", "n_time", "n_class", "n_id", mean.alias("mean"), sd.alias("sd"), F.coalesce(F.try_divide("s0", "n_num"), F.lit(0.0)).alias("zero"))


def _together_batches(batches):
    """The pairs of names that stand in one header with the number of their files, each once a partition."""
    seen: Counter[tuple[str, ...]] = Counter()
    for pdf in batches:
        seen.update(tuple(sorted(set(x))) for x in pdf["names"])
    vocabulary = sorted({n for h in seen for n in h})
    at = {n: i for i, n in enumerate(vocabulary)}
    x = np.zeros((len(seen), len(at)))
    for i, h in enumerate(seen):
        x[i, [at[n] for n in h]] = 1
    both = np.triu(x.T @ (x * np.array(list(seen.values()), dtype="float64").reshape(-1, 1)), 1)
    a, b = np.nonzero(both)
    yield pd.DataFrame({"a": [vocabulary[i] for i in a], "b": [vocabulary[i] for i in b], "n": both[a, b].astype("int64")}, columns=["a", "b", "n"])


def canonical_names(vocabulary: list, renames: list[tuple[str, str, int]], together: dict[tuple[str, str], int], effective: int = 60) -> dict[str, str]:
    """Header name -> canonical name, one for all feeds.

    Names that any feed renames into each other are one field; the rest are matched by sketch and name, best first.
    Names that stand in one header are never one field, nor are the groups they belong to, unless a feed renames one
    into the other and most files of the rarer have only that one (the old name came back for a new field). The name
    that most files use stands for the group. Times and labels are known by content (see _role) and take no part.
    """
    # pooled counts are cut to those of a usual file: feeds differ more than the samples of one feed
    rows = {}
    for v in vocabulary:
        share = min(1.0, effective / v["n"]) if v["n"] else 1.0
        rows[v["name"]] = v | {c: v[c] * share for c in ("n", "n_num", "n_time", "n_class", "n_id")}
    plain = sorted(n for n, v in rows.items() if not _role(v))
    group = {n: {n} for n in plain}

    renamed = {(min(a, b), max(a, b)) for a, b, _ in renames}

    def apart(p: str, q: str) -> bool:
        pair = (min(p, q), max(p, q))
        return together.get(pair, 0) * 2 > (min(rows[p]["files"], rows[q]["files"]) if pair in renamed else 0)

    def union(a: str, b: str) -> None:
        x, y = group[a], group[b]
        if x is not y and not any(apart(p, q) for p in x for q in y):
            x |= y
            for n in y:
                group[n] = x

    for a, b, _ in sorted(renames, key=lambda r: (-r[2], r[0], r[1])):
        if a in group and b in group:
            union(a, b)
    close = []
    for i, a in enumerate(plain):
        for b in plain[i + 1 :]:
            if group[a] is not group[b] and (a, b) not in together and difflib.SequenceMatcher(None, a, b).ratio() >= 0.6:
                s = similarity(rows[a], rows[b])
                if s > 0:
                    close.append((-s, a, b))
    for _, a, b in sorted(close):
        union(a, b)
    best = lambda g: min(g, key=lambda n: (-rows[n]["files"], len(n), n))
    out = {n: best(group[n]) for n in plain}
    return out | {n: _role(v) for n, v in rows.items() if n not in out}


def unified_fields(fields: DataFrame, changes: DataFrame, max_names: int = 20_000) -> DataFrame:
    """(file_id, keys, kinds, counts, numbers): per file the canonical name of each field in header order, each name once
    a file, with its kind, number of values and of values that hold a number.

    The names of all feeds are matched on the driver; their number is bounded and checked, it does not grow with lines.
    """
    vocabulary = [r.asDict() for r in _vocabulary(fields).limit(max_names + 1).collect()]
    if len(vocabulary) > max_names:
        raise ValueError(f"more than {max_names} header names")
    renames = [tuple(r) for r in changes.where("change_kind = 'renamed'").groupBy("field_before", "field_after").count().collect()]
    names = fields.select(F.expr("transform(fields, f -> f.name)").alias("names"))
    together = {(r["a"], r["b"]): r["n"] for r in names.mapInPandas(_together_batches, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).collect()}
    canon = canonical_names(vocabulary, renames, together)

    def keys(batches):
        for pdf in batches:
            out = []
            for names, label, time in zip(pdf["names"], pdf["label"], pdf["time"], strict=True):
                key, used = [""] * len(names), {LABEL, TIME}
                # of several labels (or times) of a file the one with most content is it; without values the name decides
                for role, content in ((LABEL, label), (TIME, time)):
                    of = [i for i, c in enumerate(content) if c > 0 or c == 0 and canon[names[i]] == role]
                    if of:
                        key[max(of, key=lambda i: (content[i], -i))] = role
                # where an old name came back beside its rename, the rename is the field that goes on
                for i in sorted(range(len(names)), key=lambda i: canon[names[i]] == names[i]):
                    if not key[i]:
                        options = [canon[names[i]], names[i], *(f"{names[i]}_{k}" for k in range(2, len(names) + 4))]
                        key[i] = next(n for n in options if n not in used)
                        used.add(key[i])
                out.append(key)
            yield pd.DataFrame({"file_id": pdf["file_id"], "keys": out, "kinds": pdf["kinds"], "counts": pdf["counts"], "numbers": pdf["numbers"]})

    # -1: other content, 0: no values, else the values of that content and one
    content = "transform(fields, f -> case when f.n = 0 then 0L when {} then {} + 1L else -1L end)"
    is_label = f"f.n_class * 2 >= f.n or f.name rlike '{LABEL_WORDS}' and (f.n_class + f.n_id) * 2 >= f.n"
    of_file = fields.select(
        "file_id", F.expr("transform(fields, f -> f.name)").alias("names"), F.expr(content.format(is_label, "f.n_class")).alias("label"), F.expr(content.format("f.n_time * 2 >= f.n", "f.n_time")).alias("time"),
        F.expr("transform(fields, f -> f.kind)").alias("kinds"), F.expr("transform(fields, f -> f.n)").alias("counts"), F.expr("transform(fields, f -> f.n_num)").alias("numbers"),
    )
    return of_file.mapInPandas(keys, "file_id long, keys array<string>, kinds array<string>, counts array<long>, numbers array<long>")


def _lines_with(lines: DataFrame, per_file: DataFrame) -> DataFrame:
    """The undamaged lines as cells, with what per_file holds of their file."""
    head = headers(lines).select("file_id", "delim", "width").join(per_file, "file_id")
    j = with_header(lines.select("file_id", "line_id", "line_no", "line_text"), head)
    t, d = F.col("line_text"), F.col("delim")
    return j.where(t.isNotNull() & ~quoting_broken(t, d)).withColumn("cells", cells_of(t, d)).where(F.size("cells") == F.col("width"))


def unified_lines(lines: DataFrame, files: DataFrame, changes: DataFrame, fields: DataFrame | None = None) -> DataFrame:
    """(file_id, line_id, flow): all undamaged lines as maps from canonical field name to the text of the value."""
    fields = fields if fields is not None else checkpointed(field_table(lines))
    j = _lines_with(lines, unified_fields(fields, changes).select("file_id", "keys"))
    return j.select("file_id", "line_id", F.map_from_arrays("keys", F.transform("cells", unquoted)).alias("flow"))


def number_of(v: Column) -> Column:
    """The number a cell writes, as double: plain, hexadecimal, counted (n12), in thousands (1.5k) or in microseconds (12 us)."""
    double = lambda c: c.try_cast("double")
    return (
        F.when(is_int(v) | is_decimal(v), double(v))
        .when(v.rlike(r"^0[xX][0-9a-fA-F]{1,13}$"), double(F.conv(v.substr(F.lit(3), F.length(v)), 16, 10)))
        .when(v.rlike(r"^n[0-9]+$"), double(v.substr(F.lit(2), F.length(v))))
        .when(v.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?k$"), F.round(double(F.regexp_extract(v, "^(.*)k$", 1)) * 1000, 3))
        .when(v.rlike(r"^[+-]?[0-9]+(\.[0-9]+)? ?us$"), double(F.regexp_extract(v, "^(.*?) ?us$", 1)))
    )


def class_of(v: Column) -> Column:
    """The class a label cell names by text or id; other texts stay as they are."""
    i = F.regexp_replace(v, "^[+]?0*(?=[0-9])", "")
    return F.when(names_class(v) | (fold(v) == "unknown"), canonical_label(v)).when(i.isin(*map(str, range(len(CLASSES)))), class_name(i.try_cast("int"))).when(v != "", v)


def field_types(keys: DataFrame) -> dict[str, str]:
    """Canonical name -> string, bigint or double, one for all files.

    A field is a number if it is one in some file and nine tenths of its values hold one, also with a unit or prefix;
    it is a double if any file has decimals.
    """
    j = keys.select(F.explode(F.arrays_zip("keys", "kinds", "counts", "numbers")).alias("x")).select("x.*")
    plain = F.col("kinds").isin("integer", "decimal")
    g = j.groupBy("keys").agg(
        F.count_if(plain).alias("p"), F.count_if(F.col("kinds") == "decimal").alias("d"), F.sum("counts").alias("n"), F.sum(F.when(plain, F.col("counts")).otherwise(F.col("numbers"))).alias("m")
    )
    return {r["keys"]: "string" if r["keys"] in (LABEL, TIME) or not r["p"] or r["m"] * 10 < r["n"] * 9 else "double" if r["d"] else "bigint" for r in g.collect()}


def unified_table(lines: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, line_id, flow, rest): all undamaged lines with flow as a struct of one typed field per canonical name.

    label is the class, timestamp the text as written (its instant needs the sensor). rest has the text of the cells
    that are not of their field's type.
    """
    fields = checkpointed(field_table(lines))
    keys = checkpointed(unified_fields(fields, schema_changes(lines, files, fields)))
    types = field_types(keys)
    names = [n for n in (LABEL, TIME) if n in types] + sorted(set(types) - {LABEL, TIME})
    by = {t: [n for n in names if types[n] == t] for t in ("bigint", "double", "string")}
    place = {t: F.transform(F.array(*[F.lit(n) for n in by[t]]), lambda n: F.array_position("keys", n).cast("int")) if by[t] else F.array().cast("array<int>") for t in by}
    j = _lines_with(lines, keys.select("file_id", *[place[t].alias(f"at_{t}") for t in by]))
    text = lambda t: F.transform(f"at_{t}", lambda i: F.when(i > 0, unquoted(F.get("cells", i - 1))))
    j = j.select("file_id", "line_id", *[text(t).alias(f"t_{t}") for t in by])
    whole = lambda v, x: F.when(is_int(v), v.try_cast("long")).when((x == F.floor(x)) & (F.abs(x) < 2.0**53), x.try_cast("long"))
    j = j.withColumns({"v_bigint": F.transform("t_bigint", lambda v: whole(v, number_of(v))), "v_double": F.transform("t_double", number_of)})

    def unread(t: str) -> Column:
        z = F.arrays_zip(F.array(*[F.lit(n) for n in by[t]]).cast("array<string>").alias("k"), F.col(f"t_{t}").alias("t"), F.col(f"v_{t}").alias("v"))
        left = F.filter(z, lambda x: (x["t"] != "") & x["v"].isNull())
        return F.transform(left, lambda x: F.struct(x["k"].alias("key"), x["t"].alias("value")))

    value = {t: {n: F.get(f"{'t' if t == 'string' else 'v'}_{t}", F.lit(i)) for i, n in enumerate(by[t])} for t in by}
    typed = [(class_of(value["string"][n]) if n == LABEL else F.when(value["string"][n] != "", value["string"][n]) if types[n] == "string" else value[types[n]][n]).alias(n) for n in names]
    return j.select("file_id", "line_id", F.struct(*typed).alias("flow"), F.map_from_entries(F.concat(unread("bigint"), unread("double"))).alias("rest"))
