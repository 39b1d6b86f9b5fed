"""Text cut off by field limits, in SQL.

Every text becomes a row of tokens in which sentence and line ends are tokens of their own. Each word is counted
with the two before it, apart for places inside a sentence and places at an end. The last trigram of a text is
looked up: if it is frequent inside but almost never at an end, the text stops inside a sentence; if it is unseen
but the beginning of a frequent one, it stops inside a word. Rare contexts back off to the last two words and the
last word. Cuts inside a character, an entity or a tag show in the text itself. A text as long as a length at which
its source piles up (a field limit) needs less evidence.

Prefix counts are an equi-join on (context, prefix), so no pair of words of a hot context is ever compared.

Defined results: null, blank or one-word texts are looked up like others and are not flagged without evidence; ties
do not occur, each text is judged alone; empty input gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from flowloom.session import checkpointed

END = "¶"

TOKENS = r"""
SELECT id, source, n_chars, n_bytes, text,
  filter(split(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    lower(text),
    '&(?:#[0-9]+|[a-z]+);', ' '),
    '<[^<>]*>|\\[/?[a-z]+\\]', ' '),
    '[0-9]+', '0'),
    '\\r?\\n[\\s>]*', ' ¶ '),
    '[.?!…]+["\')\\]*_]*(?=\\s|$)', ' ¶ '),
    '[^\\p{{L}}0¶+.\'’&#=/:-]+|(?<=[^\\p{{L}}0])[.\'’:-]+(?=\\s|$)|[:,](?=\\s|$)', ' ')), ' +'), t -> t <> '') AS w
FROM {docs}
"""

FINAL = r"""
SELECT id, source, n_chars, n_bytes, dotted,
  CASE
    WHEN text RLIKE '�\\s*$' THEN 'character'
    WHEN text RLIKE '&(?:#[0-9]{{0,5}}|[a-z]{{0,6}})$' AND NOT text RLIKE '\\s&$' THEN 'entity'
    WHEN text RLIKE '<(?:/?[A-Za-z]{{1,12}}|a\\s[^<>\\n]{{0,80}})$' OR text RLIKE '\\[/?[a-z]{{0,9}}$' THEN 'tag'
  END AS shown,
  text RLIKE '[,(]\\s*$' AS open_clause,
  text RLIKE '[.?!…][)"*_\\]]*\\s*$' AS ended,
  if(dotted AND size(w) > 0, concat(element_at(w, -1), '.'), if(size(w) = 0, '', element_at(w, -1))) AS p,
  if(size(w) = 0, '', element_at(w, -1)) AS w,
  CASE WHEN size(w) < 2 THEN '¶' ELSE element_at(w, -2) END AS c1,
  CASE WHEN size(w) < 3 OR element_at(w, -2) = '¶' THEN '¶' ELSE element_at(w, -3) END AS c2
FROM (
  SELECT id, source, n_chars, n_bytes, text, dotted, if((marked OR dotted) AND size(w) > 0 AND element_at(w, -1) = '¶', slice(w, 1, size(w) - 1), w) AS w
  FROM (SELECT *, text RLIKE '[\\p{{L}}0-9]\\.$' AS dotted, text RLIKE '(?:…|\\.\\.\\.|\\[\\.\\.\\.\\]|\\[…\\])\\s*$' AS marked FROM {tokens})
)
"""

TRIGRAMS = r"""
SELECT c2, c1, w, count_if(NOT stop) AS n_in, count_if(stop AND NOT last) AS n_end, count_if(last) AS n_last
FROM (
  SELECT explode(transform(filter(sequence(0, size(w) - 1), i -> w[i] <> '¶'), i -> named_struct(
    'w', w[i],
    'c1', if(i < 1, '¶', get(w, i - 1)),
    'c2', if(i < 2 OR get(w, i - 1) = '¶', '¶', get(w, i - 2)),
    'stop', coalesce(get(w, i + 1) = '¶', true),
    'last', i = size(w) - 1))) AS g
  FROM {tokens} WHERE size(w) > 0
) LATERAL VIEW inline(array(g)) t AS w, c1, c2, stop, last
GROUP BY c2, c1, w
"""

# Of the words in a context only those beginnings are made that a final token in this context asks for, by its length:
# a word of n letters is not spelt out n times, and contexts in which no text ends are left out before the explode.
PREFIXES = r"""
SELECT c2, c1, p, sum(n) AS n_longer
FROM (
  SELECT t.c2, t.c1, t.n_in + t.n_end AS n, explode(transform(filter(lens, k -> k < length(t.w)), k -> substring(t.w, 1, k))) AS p
  FROM {trigrams} t JOIN {asked} a ON t.c2 = a.c2 AND t.c1 = a.c1
  WHERE length(t.w) > 1 AND t.n_in + t.n_end > 0
)
GROUP BY c2, c1, p
"""

ASKED = "SELECT {c2} AS c2, {c1} AS c1, collect_set(length(p)) AS lens FROM {{final}} WHERE p <> '' GROUP BY 1, 2"

LIMITS = r"""
SELECT source, unit, len FROM (
  SELECT source, unit, len, n,
    sum(n) OVER (PARTITION BY source, unit ORDER BY len RANGE BETWEEN 10 PRECEDING AND 10 FOLLOWING) - n AS around,
    sum(n) OVER (PARTITION BY source, unit ORDER BY len RANGE BETWEEN CURRENT ROW AND 200 FOLLOWING) - n AS beyond
  FROM (SELECT source, unit, len, count(*) AS n FROM {docs} LATERAL VIEW stack(2, 'chars', n_chars, 'bytes', n_bytes) s AS unit, len GROUP BY source, unit, len)
) WHERE n >= 8 AND n * 2 >= around AND n >= 2 * beyond
"""

JUDGED = r"""
SELECT id, source, n_chars, at_limit,
  CASE
    WHEN shown IS NOT NULL THEN shown
    WHEN dotted THEN CASE WHEN t_longer >= {support} AND (t_in + t_end + t_last) * 10 < t_longer THEN 'word' END
    WHEN w = '¶' OR w = '' THEN NULL
    WHEN open_clause THEN 'sentence'
    WHEN t_in + t_end + t_last >= {support} AND (t_end + t_last) >= {rare} * (t_in + t_end + t_last) AND t_longer < 5 * (t_in + t_end + t_last) THEN if(open_limit, 'limit', NULL)
    WHEN t_in >= {support} AND (t_end + t_last) < {rare} * t_in THEN 'sentence'
    WHEN t_longer >= {support} AND (t_in + t_end + t_last) * 10 < t_longer THEN 'word'
    WHEN b_in + b_end + b_last >= {support} AND (b_end + b_last) >= {rare} * (b_in + b_end + b_last) AND b_longer < 5 * (b_in + b_end + b_last) THEN if(open_limit, 'limit', NULL)
    WHEN b_in >= {support} AND (b_end + b_last) < {rare} * b_in THEN 'sentence'
    WHEN b_longer >= {support} AND (b_in + b_end + b_last) * 10 < b_longer THEN 'word'
    WHEN u_in + u_end + u_last < 2 AND u_longer >= {support} AND length(w) >= 2 THEN 'word'
    WHEN u_in >= 20 AND (u_end + u_last) < {rare} * u_in THEN 'sentence'
    WHEN open_limit THEN 'limit'
  END AS cut
FROM (
  SELECT f.*, l.len IS NOT NULL OR lb.len IS NOT NULL AS at_limit,
    (l.len IS NOT NULL OR lb.len IS NOT NULL) AND NOT ended AS open_limit
FROM (
  SELECT f.*,
    coalesce(t.n_in, 0) AS t_in, coalesce(t.n_end, 0) AS t_end, greatest(coalesce(t.n_last, 0) - 1, 0) AS t_last,
    coalesce(b.n_in, 0) AS b_in, coalesce(b.n_end, 0) AS b_end, greatest(coalesce(b.n_last, 0) - 1, 0) AS b_last,
    coalesce(u.n_in, 0) AS u_in, coalesce(u.n_end, 0) AS u_end, greatest(coalesce(u.n_last, 0) - 1, 0) AS u_last,
    coalesce(tp.n_longer, 0) AS t_longer, coalesce(bp.n_longer, 0) AS b_longer, coalesce(up.n_longer, 0) AS u_longer
  FROM {final} f
  LEFT JOIN {trigrams} t ON f.c2 = t.c2 AND f.c1 = t.c1 AND f.w = t.w
  LEFT JOIN {bigrams} b ON f.c1 = b.c1 AND f.w = b.w
  LEFT JOIN {unigrams} u ON f.w = u.w
  LEFT JOIN {prefixes} tp ON f.c2 = tp.c2 AND f.c1 = tp.c1 AND f.p = tp.p
  LEFT JOIN {bi_prefixes} bp ON f.c1 = bp.c1 AND f.p = bp.p
  LEFT JOIN {uni_prefixes} up ON f.p = up.p
) f
  LEFT JOIN {limits} l ON l.unit = 'chars' AND f.source <=> l.source AND f.n_chars = l.len
  LEFT JOIN {limits} lb ON lb.unit = 'bytes' AND f.source <=> lb.source AND f.n_bytes = lb.len
)
"""


def judged_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", support: int = 4, rare: float = 0.06) -> DataFrame:
    """(id, source, n_chars, at_limit, cut): cut is null for whole texts, else where the text stops.

    support: least count on which a verdict rests; rare: share of ends below which a phrase almost never ends.
    """
    spark = docs.sparkSession
    docs = docs.selectExpr(f"`{key}` AS id", f"`{source}` AS source", f"coalesce(`{text}`, '') AS text", f"length(coalesce(`{text}`, '')) AS n_chars", f"octet_length(coalesce(`{text}`, '')) AS n_bytes")
    sql = lambda q, **f: spark.sql(q, **f)
    tokens = sql(TOKENS, docs=docs)
    # one short row a text, read four times; blind to the texts themselves from here on
    final = checkpointed(sql(FINAL, tokens=tokens))
    # distinct trigrams are read six times, so they are written once
    trigrams = checkpointed(sql(TRIGRAMS, tokens=tokens))
    bigrams = sql("SELECT '¶' AS c2, c1, w, sum(n_in) AS n_in, sum(n_end) AS n_end, sum(n_last) AS n_last FROM {t} GROUP BY c1, w", t=trigrams)
    unigrams = sql("SELECT '¶' AS c2, '¶' AS c1, w, sum(n_in) AS n_in, sum(n_end) AS n_end, sum(n_last) AS n_last FROM {b} GROUP BY w", b=bigrams)

    def prefixes(level: DataFrame, c2: str, c1: str) -> DataFrame:
        return sql(PREFIXES, trigrams=level, asked=sql(ASKED.format(c2=c2, c1=c1), final=final))

    return sql(
        JUDGED.replace("{support}", str(support)).replace("{rare}", str(rare)),
        final=final, trigrams=trigrams, bigrams=bigrams, unigrams=unigrams, limits=sql(LIMITS, docs=docs),
        prefixes=prefixes(trigrams, "c2", "c1"), bi_prefixes=prefixes(bigrams, "'¶'", "c1"), uni_prefixes=prefixes(unigrams, "'¶'", "'¶'"),
    )


def truncation_report(judged: DataFrame) -> DataFrame:
    """Per source: texts, cut texts, their share, and how many stand at a length limit."""
    return judged.sparkSession.sql(
        "SELECT source, count(*) AS texts, count(cut) AS cut_texts, round(count(cut) / count(*), 6) AS share, count_if(at_limit) AS at_limit FROM {j} GROUP BY source", j=judged
    )
