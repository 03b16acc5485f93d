"""Document fingerprints by threshold-scaled sketches.

The sketch of a text keeps the hash of every shingle of five words that lies
below a fixed fraction of the hash range, so sketches of unions are unions of
sketches and the containment of a short text in a long one can be estimated: over
those hashes alone. The smallest hash is always kept too, which is mergeable, so
that no text with words has an empty fingerprint; above the fraction it says
nothing about containment, because a longer text does not keep it. Only SQL
functions are used.

Defined results. A null text is empty. Fewer than five words are one shingle.
Where a text has no hash below the fraction, containment is unknown and the
likeness is 1 for equal fingerprints (two texts without words among them) and 0
for others; at a fraction of an eighth a text of 35 shingles has none with a
probability of 1 %. Repeated rows are reported one by one, in any order among
themselves. Null ids come last. An empty table gives no rows. Extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHINGLE = 5
#: One hash in so many is kept.
SCALE = 8
#: Text of one neighbour bucket, about, in bytes; buckets at most.
BUCKET_BYTES = 8 << 20
MOST_BUCKETS = 10_000


def with_sketch(df: DataFrame, text_col: str, name: str, scale: int = SCALE) -> DataFrame:
    """Adds the sketch of a text column: sorted distinct kept hashes."""
    words = F.filter(F.split(F.lower(F.col(text_col)), r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    df = df.withColumn("_h", F.transform(words, lambda w: F.xxhash64(w)))
    shingles = F.when(
        F.size("_h") >= SHINGLE,
        F.transform(F.sequence(F.lit(0), F.size("_h") - SHINGLE), lambda i: F.xxhash64(*[F.get("_h", i + k) for k in range(SHINGLE)])),
    ).when(F.size("_h") > 0, F.array(F.xxhash64("_h"))).otherwise(F.expr("cast(array() as array<bigint>)"))
    df = df.withColumn("_s", shingles)
    kept = F.filter("_s", lambda x: x < F.lit(_limit(scale)))
    least = F.filter(F.array(F.array_min("_s")), lambda x: x.isNotNull())
    return df.withColumn(name, F.array_sort(F.array_union(kept, least))).drop("_h", "_s")


def _limit(scale: int) -> int:
    """Hashes below it are kept."""
    return -(1 << 63) + (1 << 64) // scale


def likeness(a: str, b: str, scale: int = SCALE) -> Column:
    """Containment of the smaller sketch in the other, 0 to 1, over the hashes
    below the fraction."""
    below = lambda s: F.filter(s, lambda x: x < F.lit(_limit(scale)))
    least = F.least(F.size(below(a)), F.size(below(b)))
    return F.when(F.col(a) == F.col(b), 1.0).when(least > 0, F.size(F.array_intersect(below(a), below(b))) / least).otherwise(0.0)


def as_text(sketch: str) -> Column:
    """Hashes as 16 hexadecimal digits each, one after the other."""
    return F.concat_ws("", F.transform(sketch, lambda x: F.lpad(F.hex(x), 16, "0")))


def with_next(df: DataFrame, bucket_bytes: int = BUCKET_BYTES, scale: int = SCALE) -> DataFrame:
    """``doc_id, text`` with ``sketch``, ``next_text`` and ``next_sketch``: those
    of the next row by descending id; after the last comes the first.

    Rows are dealt once, over ranges of ids found from quantiles. The first row
    of every range also goes, marked, to the end of the range before, so that one
    sort in each range finds every neighbour. What the driver holds is one id for
    each range."""
    spark = df.sparkSession
    total = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = int(min(MOST_BUCKETS, max(4 * tasks, total // bucket_bytes)))
    shares = F.array(*[F.lit(k / n) for k in range(1, n)])
    bounds = sorted(set(df.agg(F.percentile_approx("doc_id", shares, F.lit(10 * n))).first()[0] or []), reverse=True) if n > 1 else []
    # Two levels of about sqrt(n) bounds: few comparisons for a row.
    width = max(1, int(len(bounds) ** 0.5))
    rows = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    key = F.col("doc_id")
    bucket = F.lit(0)
    if rows:
        none = F.expr("cast(array() as array<bigint>)")
        row = F.size(F.filter(F.array(*[F.lit(r[-1]) for r in rows]), lambda b: key < b))
        inner = F.coalesce(F.get(F.array(*[F.array(*[F.lit(x) for x in r]) for r in rows]), row), none)
        bucket = F.when(key.isNull(), F.lit(len(bounds) + 1)).otherwise(row * F.lit(width) + F.size(F.filter(inner, lambda b: key < b)))
    df = df.withColumn("_bucket", bucket.cast("int"))
    tops = sorted((r[0], r[1]) for r in df.groupBy("_bucket").agg(F.max("doc_id")).collect())
    before = [(b, top, tops[k - 1][0]) for k, (b, top) in enumerate(tops)]
    table = spark.createDataFrame(before, "_b int, _top bigint, _before int")
    # One row for each range.
    heads = df.join(F.broadcast(table), (F.col("_bucket") == F.col("_b")) & key.eqNullSafe(F.col("_top"))).groupBy("_before").agg(F.max("text").alias("text"))
    marked = heads.select(F.lit(None).cast("bigint").alias("doc_id"), "text", F.col("_before").alias("_bucket"), F.lit(True).alias("_head"))
    dealt = df.select("doc_id", "text", "_bucket", F.lit(False).alias("_head")).unionByName(marked).repartition("_bucket")
    order = Window.partitionBy("_bucket").orderBy("_head", key.desc_nulls_last(), F.col("text").desc())
    both = with_sketch(dealt, "text", "sketch", scale).withColumn("_next", F.lead(F.struct("text", "sketch")).over(order))
    return both.where("NOT _head").select("doc_id", "text", "sketch", F.col("_next.text").alias("next_text"), F.col("_next.sketch").alias("next_sketch"))


def report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", scale: int = SCALE) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness."""
    df = with_next(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), scale=scale)
    df = df.withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    keep = (F.col("n_chars") - half).cast("int")
    df = df.withColumn("edited", F.concat(F.substring("text", F.lit(1), keep), F.substring("next_text", F.lit(1), half)))
    df = df.select("doc_id", "n_chars", "sketch", "next_sketch", "edited")
    df = with_sketch(df, "edited", "edited_sketch", scale)
    return df.select(
        F.col("doc_id").alias(id_col),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text("sketch").alias("fingerprint"),
        as_text("edited_sketch").alias("edited_fingerprint"),
        likeness("sketch", "edited_sketch", scale).alias("near_edited"),
        likeness("sketch", "next_sketch", scale).alias("near_next"),
    )
