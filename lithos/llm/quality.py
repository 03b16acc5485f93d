"""Quality classification by hierarchical empirical Bayes.

The document classifier is a naive Bayes over binned text statistics, fitted on
all labelled rows by grouped counts. Its probability is evidence about the
document's host and path (here: source, and source with language): each host's
mean is shrunk toward the global mean, each path's toward its host's, with
strengths estimated from the spread of the means. The document's log odds are
then moved by its path's posterior log odds against the global ones, where the
path's posterior leaves the document itself out: its evidence counts once.

Sums run over probabilities in whole millionths, so that their order doesn't
matter. Only SQL functions are used; sparse groups cost one row each.

Defined results. A null text is empty; an empty text is a bin of its own. A null
host or language is a value like any other. Labels of unknown documents, null
labels and null ids are not learned from; without labels every document has
probability 0.5 before shrinking. Documents that share an id are scored one by
one. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithos.llm._common import cut

#: Characters that prose has few of.
SYMBOLS = "!#$%&*+/<=>@\\^_`{|}~"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = "0123456789"
BINS = 20
FEATURES = ("f_symbol", "f_upper", "f_digit", "f_words")
#: Bounds of the estimated strengths, in documents.
LEAST_K, MOST_K = 1.0, 1000.0
KEEP = 0.5


def _share(text: Column, chars: str) -> Column:
    n = F.char_length(text)
    rest = F.char_length(F.translate(text, chars, ""))
    return F.when(n > 0, F.floor((n - rest) * BINS / n)).otherwise(-1).cast("int")


def features(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """Id, host, path language and the binned statistics."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.split(text, " ")
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(host_col).alias("host"),
        F.col(lang_col).alias("lang"),
        _share(text, SYMBOLS).alias("f_symbol"),
        _share(text, UPPER).alias("f_upper"),
        _share(text, DIGITS).alias("f_digit"),
        F.floor(F.size(F.array_distinct(words)) * BINS / F.size(words)).cast("int").alias("f_words"),
    )


def evidence(rows: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """Adds ``p_ppm``: the classifier's probability in millionths."""
    known = labels.where(f"{label_col} IN (0, 1)").select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("y"))
    seen = rows.join(known, "doc_id")
    stacked = seen.select("y", F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("v")) for f in FEATURES])).alias("x")).select("y", "x.f", "x.v")
    # Features times bins times two: bounded.
    counts = {(r.f, r.v, r.y): r.n for r in stacked.groupBy("f", "v", "y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = [sum(c for (f, _, y), c in counts.items() if f == FEATURES[0] and y == k) for k in (0, 1)]
    odds: Column = F.log(F.lit((n[1] + 1.0) / (n[0] + 1.0)))
    for f in FEATURES:
        values = sorted({v for g, v, _ in counts if g == f})
        term = F.log(F.lit((n[0] + BINS + 2.0) / (n[1] + BINS + 2.0)))
        if values:
            case = F.col(f)
            chain = None
            for v in values:
                ratio = F.lit((counts.get((f, v, 1), 0) + 1.0) / (counts.get((f, v, 0), 0) + 1.0))
                chain = F.when(case == v, F.log(ratio)) if chain is None else chain.when(case == v, F.log(ratio))
            term = term + chain.otherwise(0.0)
        odds = odds + term
    return rows.withColumn("p_ppm", F.least(F.greatest(F.round(1e6 / (1 + F.exp(-odds))), F.lit(1.0)), F.lit(999999.0)).cast("long"))


def _strength(groups: DataFrame, within: str, mean: str) -> DataFrame:
    """One row ``k``: the strength of the prior that the spread of the group
    means allows. ``groups`` has n, s (millionths) and the prior mean."""
    spread = F.sum(F.col("n") * (F.col("s") / F.col("n") / 1e6 - F.col(mean)) * (F.col("s") / F.col("n") / 1e6 - F.col(mean))) / F.sum("n")
    noise = F.sum(F.col(mean) * (1 - F.col(mean))) / F.sum("n")
    base = F.sum(F.col("n") * F.col(mean) * (1 - F.col(mean))) / F.sum("n")
    return groups.agg((base / F.greatest(spread - noise, F.lit(1e-9)) - 1).alias("k")).select(
        F.coalesce(F.least(F.greatest("k", F.lit(LEAST_K)), F.lit(MOST_K)), F.lit(MOST_K)).alias(within)
    )


def posteriors(scored: DataFrame) -> DataFrame:
    """Per host and language: the global mean ``g``, ``host_mean``, ``path_mean``,
    and what the last is made of: ``n``, ``s`` (millionths) and ``k2``."""
    paths = scored.groupBy("host", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum("p_ppm").alias("s"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    world = hosts.agg((F.sum("s") / F.sum("n") / 1e6).alias("g"))
    hosts = hosts.crossJoin(F.broadcast(world))  # one row
    k1 = _strength(hosts, "k1", "g")
    hosts = hosts.crossJoin(F.broadcast(k1)).select(F.col("host").alias("h"), "g", ((F.col("s") / 1e6 + F.col("k1") * F.col("g")) / (F.col("n") + F.col("k1"))).alias("host_mean"))
    paths = paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h")
    k2 = _strength(paths, "k2", "host_mean")
    return paths.crossJoin(F.broadcast(k2)).select(
        F.col("host").alias("h"), F.col("lang").alias("l"), "g", "host_mean", "n", "s", "k2",
        ((F.col("s") / 1e6 + F.col("k2") * F.col("host_mean")) / (F.col("n") + F.col("k2"))).alias("path_mean"),
    )


def _logit(x: Column) -> Column:
    return F.log(x / (1 - x))


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", lang_col: str = "lang", keep: float = KEEP) -> DataFrame:
    """One row per document: the classifier's, the host's and the path's
    probability, the combined ``quality``, and ``keep``."""
    rows = cut(features(docs, id_col=id_col, text_col=text_col, host_col=host_col, lang_col=lang_col))
    scored = evidence(rows, labels, id_col=id_col)
    table = posteriors(scored)
    both = scored.join(table, F.col("host").eqNullSafe(F.col("h")) & F.col("lang").eqNullSafe(F.col("l")))
    p = F.col("p_ppm") / 1e6
    others = ((F.col("s") - F.col("p_ppm")) / 1e6 + F.col("k2") * F.col("host_mean")) / (F.col("n") - 1 + F.col("k2"))
    quality = 1 / (1 + F.exp(-(_logit(p) + _logit(others) - _logit(F.col("g")))))
    return both.select(
        F.col("doc_id").alias(id_col),
        F.round(p, 5).alias("p_doc"),
        F.round("host_mean", 5).alias("p_host"),
        F.round("path_mean", 5).alias("p_path"),
        F.round(quality, 5).alias("quality"),
        (quality >= keep).alias("keep"),
    )


def _sql_share(chars: str) -> str:
    quoted = chars.replace("'", "''")
    return f"CASE WHEN length(t) > 0 THEN CAST(floor((length(t) - length(translate(t, '{quoted}', ''))) * {BINS} / length(t)) AS INTEGER) ELSE -1 END"


ORACLE = f"""
WITH d AS (SELECT doc_id, source AS host, lang, coalesce(text, '') AS t FROM documents),
r AS (
  SELECT doc_id, host, lang, {_sql_share(SYMBOLS)} AS f_symbol, {_sql_share(UPPER)} AS f_upper, {_sql_share(DIGITS)} AS f_digit,
    CAST(floor(len(list_distinct(string_split(t, ' '))) * {BINS} / len(string_split(t, ' '))) AS INTEGER) AS f_words FROM d),
y AS (SELECT r.*, quality AS y FROM r JOIN labels USING (doc_id) WHERE quality IN (0, 1)),
n AS (SELECT count(*) FILTER (WHERE y = 0) AS n0, count(*) FILTER (WHERE y = 1) AS n1 FROM y),
c AS (
  SELECT f, v, count(*) FILTER (WHERE y = 1) AS c1, count(*) FILTER (WHERE y = 0) AS c0
  FROM ({' UNION ALL '.join(f"SELECT '{f}' AS f, {f} AS v, y FROM y" for f in FEATURES)}) GROUP BY f, v),
e AS (
  SELECT r.doc_id, r.host, r.lang, ln((n1 + 1.0::DOUBLE) / (n0 + 1.0::DOUBLE)) {' '.join(f"+ (ln((n0 + {BINS + 2}::DOUBLE) / (n1 + {BINS + 2}::DOUBLE)) + coalesce(ln(({f}.c1 + 1::DOUBLE) / ({f}.c0 + 1::DOUBLE)), 0))" for f in FEATURES)} AS odds
  FROM r CROSS JOIN n {' '.join(f"LEFT JOIN c AS {f} ON {f}.f = '{f}' AND {f}.v = r.{f}" for f in FEATURES)}),
p AS (SELECT doc_id, host, lang, CAST(least(greatest(round(1e6 / (1 + exp(-odds))), 1), 999999) AS BIGINT) AS ppm FROM e),
paths AS (SELECT host, lang, count(*) AS n, CAST(sum(ppm) AS DOUBLE) AS s FROM p GROUP BY host, lang),
hosts AS (SELECT host, CAST(sum(n) AS DOUBLE) AS n, sum(s) AS s FROM paths GROUP BY host),
w AS (SELECT sum(s) / sum(n) / 1e6 AS g FROM hosts),
k1 AS (SELECT least(greatest(g * (1 - g) / greatest(sum(n * (s / n / 1e6 - g) * (s / n / 1e6 - g)) / sum(n) - count(*) * g * (1 - g) / sum(n), 1e-9) - 1, {LEAST_K}), {MOST_K}) AS k FROM hosts, w GROUP BY g),
h2 AS (SELECT host, g, (s / 1e6 + k * g) / (n + k) AS host_mean FROM hosts, w, k1),
p2 AS (SELECT paths.host, paths.lang, n, s, g, host_mean FROM paths JOIN h2 ON paths.host IS NOT DISTINCT FROM h2.host),
k2 AS (SELECT least(greatest((sum(n * host_mean * (1 - host_mean)) / sum(n)) / greatest(sum(n * (s / n / 1e6 - host_mean) * (s / n / 1e6 - host_mean)) / sum(n) - sum(host_mean * (1 - host_mean)) / sum(n), 1e-9) - 1, {LEAST_K}), {MOST_K}) AS k FROM p2),
q AS (SELECT host, lang, g, host_mean, n, s, k, (s / 1e6 + k * host_mean) / (n + k) AS path_mean FROM p2, k2),
o AS (
  SELECT p.doc_id, ppm, host_mean, path_mean, g, ((s - ppm) / 1e6 + k * host_mean) / (n - 1 + k) AS others
  FROM p JOIN q ON p.host IS NOT DISTINCT FROM q.host AND p.lang IS NOT DISTINCT FROM q.lang),
z AS (
  SELECT doc_id, ppm / 1e6 AS pd, host_mean, path_mean,
    1 / (1 + exp(-(ln(ppm / 1e6 / (1 - ppm / 1e6)) + ln(others / (1 - others)) - ln(g / (1 - g))))) AS quality
  FROM o)
SELECT doc_id, round(pd, 5) AS p_doc, round(host_mean, 5) AS p_host, round(path_mean, 5) AS p_path, round(quality, 5) AS quality, quality >= {KEEP} AS keep FROM z
"""
