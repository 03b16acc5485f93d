"""Near-duplicates by bottom-k sketches of one hash function.

1. A document's set is its distinct five-word shingles; one hash function orders
   them and the ``k`` smallest are its sketch. Equal sets form a class; only one
   representative of each goes on.
2. Inverted lists of retained values: representatives in one list overlap. Lists
   of at most ``list_rows`` members ("cold") give pairs by an equi-join.
3. A longer list ("hot") can matter on its own only to representatives with many
   hot values; the others share a cold value with every partner. Within a hot
   list, and a class of sizes that may link, each is compared with one pivot P,
   the member with the most hot values: a star, not all pairs.
4. A n B differs from one to the other as their differences from P do: |A + B| =
   |(A + P) + (B + P)|, where + is the symmetric difference. So the members of a
   star meet again in inverted lists of P and an element of A + P. Link means
   7 |A + B| <= |A| + |B|. With the weight w(A) = 7 |A + P| - |A|, two members
   of w(A) + w(B) <= 0 both link with P; any others share at least
   (w(A) + w(B)) / 14 elements of their differences. That is a prefix filter:
   rarest elements first, the lighter one needs its first few only, and what is
   left after a common element must be enough for the rest.
   A set with much text outside P shares a known part of that with every partner,
   so a sample of it by hash, as dense as that part needs, is enough: its lists
   are treated as the sketches' were, the long ones by a star of their own, and in
   the last round pair by pair.
5. Of all these lists only pairs count that the links so far leave in different
   components. The union sketch estimates the similarity of candidates and drops
   the hopeless ones; the exact Jaccard similarity of the full sets, or the
   exact size of the symmetric difference, decides.
6. Links are contracted by alternating large and small stars.

Two sets of similarity 0.75 or more never meet, or fall below the estimate's
floor, with a probability under 1e-9 at k = 64; sets of up to ``k`` shingles are
treated exactly.

Defined results. A null text, or one without words, has an empty set, links with
nothing and is kept. Fewer than five words are one shingle. Rows that share an
id count as one document. A row with a null id links with nothing, has a null
component and is kept. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lithos.llm._common import Tables, Words, chunks, cut, joined, mix, ship, texts_as_bytes, window_hashes

#: Words are runs of anything but blank, tab, line feed to carriage return.
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

SHINGLE = 5
SKETCH = 64
LIST_ROWS = 32
#: Least share of the union sketch that both must hold; a pair of similarity
#: 0.75 falls below it with a probability of about 1e-11.
FLOOR = 0.375
#: Of a sketch, so many of the smallest values may stand in a hot list: two sets
#: of similarity 0.75 share none of them with a probability of 0.25 ** 16.
HOT_VALUES = 16
#: A set whose partner shares only hot values has at most this share of cold ones
#: in its sketch, but for a probability of 1.5e-12 (21 or fewer of 64 at 0.75).
HOT_SHARE = 1 / 3
#: Expected number of common elements that a sample must keep: none is left with
#: a probability of e ** -28.
SAMPLE = 28
#: Ratio of neighbouring classes of set sizes; more than that of linked sets.
CLASS = 1.35
#: Rounds of stars; the lists that the last one leaves are paired in full.
ROUNDS = 3
#: Earlier elements that a row of a list names, so that a pair that shares one of
#: them does not meet again.
SEEN = 8
#: Probability that a pair is missed because one of the two stays out of a star,
#: all of whose values outside the pivot are in short lists; see `_reach`.
ALONE = 1e-10
#: Members of a list that one task pairs with the others.
LIST_PART = 500
#: Slots of the filter that tells which texts a comparison needs.
SLOTS = 1 << 22
#: Slots of the filter that spares most rows a shuffle in `keep_one`.
KEEP_SLOTS = 1 << 20


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    raw, begins = joined(texts)
    words = Words(raw, IS_WORD)
    n_docs = len(texts)
    doc = np.searchsorted(begins, words.starts, side="right") - 1
    first = np.searchsorted(doc, np.arange(n_docs + 1))
    windows = window_hashes(words.hashes, SHINGLE)
    out = []
    for k in range(n_docs):
        a, b = int(first[k]), int(first[k + 1])
        if b - a >= SHINGLE:
            out.append(np.unique(windows[a : b - SHINGLE + 1]))
        elif b > a:
            out.append(window_hashes(words.hashes[a:b], b - a))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    """Unsigned hashes as signed numbers of the same order."""
    return (x ^ np.uint64(1 << 63)).view(np.int64)


_ODD = np.uint64(0xD6E8FEB86659FD93)


def sketches(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """``id, n, s1, s2, sketch``: set size, 128-bit signature of the set, and its
    ``k`` smallest hashes."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 1 << 19):
            sets = shingle_sets(texts_as_bytes(batch, "text"))
            s1 = np.array([s.sum(dtype=np.uint64) for s in sets], dtype=np.uint64)
            s2 = np.array([np.bitwise_xor.reduce(s * _ODD) if len(s) else 0 for s in sets], dtype=np.uint64)
            flat = [_signed(s[:k]) for s in sets]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in flat])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int64)))
            arrays = [batch.column(0), pa.array(np.array([len(s) for s in sets], dtype=np.int64)), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), lists]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "n", "s1", "s2", "sketch"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "id bigint, n bigint, s1 bigint, s2 bigint, sketch array<bigint>")


def _log2(x: float) -> int:
    """Rounded down; 0 for what is smaller than 1."""
    return max(int(x).bit_length() - 1, 0)


def _apart(x: np.ndarray, inside: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, int, int, list[dict]]:
    """How set ``x`` differs from pivot ``y``: the whole symmetric difference, what
    is outside ``y`` first, if that is little, else nothing; its number; the sampling level (0 for the
    former); and the elements outside that it keeps, with the last level of each.
    A level keeps one in 2 ** level, all of them among those of the level before.

    A partner lacks at most a quarter of x. So of ``o`` elements outside it holds
    ``o - len(x) / 4``, and both keep ``SAMPLE`` of those at the larger of their
    own levels, which is at most that of all of ``o``."""
    out = x[~inside]
    spare = len(out) - len(x) / 4
    near = spare <= 2 * SAMPLE
    level = 0 if near else _log2(spare / SAMPLE)
    top = _log2(len(out) / SAMPLE)
    whole = np.concatenate([out, np.setdiff1d(y, x, assume_unique=True)]) if near else out[:0]
    if top < max(level, 1):
        return whole, len(out), level, []
    hashed = mix(out ^ _ODD) >> np.uint64(32)
    kept = hashed < np.uint64(1 << (32 - max(level, 1)))
    return whole, len(out), level, [{"level": 32 - h.bit_length(), "e": e} for h, e in zip(hashed[kept].tolist(), _signed(out[kept]).tolist(), strict=True)]


@functools.lru_cache(maxsize=4)
def _reach(k: int) -> list[float]:
    """By how many sketch values outside its pivot stand in long lists: the share of
    a set outside the pivot from which a partner is met in a short list.

    Of a union of ``u`` elements the two have ``(share - 1 / 4) * u`` outside the
    pivot in common. If no short list has those among the ``k`` smallest of the
    union, they are all counted here; so few are there with a probability of
    ``ALONE`` at most."""
    out = []
    for hot in range(k):
        low, high = 0.0, 1.0
        while high - low > 1e-6:
            p = (low + high) / 2
            few = sum(math.comb(k, j) * p**j * (1 - p) ** (k - j) for j in range(hot + 1))
            low, high = (p, high) if few > ALONE else (low, p)
        out.append(0.25 + high)
    return [*out, 2.0]


def _compare(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """``a, b, star`` to ``a, b, star, na, nb, both``: exact sizes of the sets and
    of their intersection; and for stars ``near, out, level, far``: see `_apart`,
    and ``rest``: the sketch of ``a`` without what is in ``b``."""
    spark = pairs.sparkSession
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS)).cast("int")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).select(slot("id").alias("slot")).distinct()
    flags = np.zeros(SLOTS, dtype=bool)  # SLOTS bytes, whatever the number of pairs
    flags[wanted.toArrow().column(0).to_numpy()] = True
    shared = spark.sparkContext.broadcast(flags)

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = shared.value[batch.column(2).to_numpy(zero_copy_only=False)]
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep)) for i in (0, 1)], names=["id", "text"])

    some = texts.withColumn("slot", slot("id")).mapInArrow(needed, "id bigint, text string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(iter([whole]), "ta", 1 << 19):
                left, right = (shingle_sets(texts_as_bytes(batch, c)) for c in ("ta", "tb"))
                stars = batch.column(batch.schema.get_field_index("star")).to_pylist()
                inside = [np.isin(x, y, assume_unique=True) for x, y in zip(left, right, strict=True)]
                found = [_apart(x, m, y) if s else (x[:0], 0, 0, []) for x, m, y, s in zip(left, inside, right, stars, strict=True)]
                new = {
                    "na": pa.array([len(x) for x in left], pa.int64()),
                    "nb": pa.array([len(x) for x in right], pa.int64()),
                    "both": pa.array([int(x.sum()) for x in inside], pa.int64()),
                    "near": pa.array([_signed(f[0]) for f in found], pa.list_(pa.int64())),
                    "out": pa.array([f[1] for f in found], pa.int32()),
                    "level": pa.array([f[2] for f in found], pa.int32()),
                    "far": pa.array([f[3] for f in found], pa.list_(pa.struct([("level", pa.int32()), ("e", pa.int64())]))),
                    "rest": pa.array([_signed(x[:k][~m[:k]]) if s else [] for x, m, s in zip(left, inside, stars, strict=True)], pa.list_(pa.int64())),
                }
                names = ["a", "b", "star", "na", "nb", "both", "near", "out", "level", "far", "rest"]
                yield pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(batch.schema.get_field_index(c)) for c in names], names=names)

    joined_ = (
        pairs.join(some.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
        .join(some.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
        .select("a", "b", "star", "ta", "tb")
    )
    return joined_.mapInArrow(run, "a bigint, b bigint, star boolean, na bigint, nb bigint, both bigint, near array<bigint>, out int, level int, far array<struct<level:int,e:bigint>>, rest array<bigint>")


def _linked(a: str = "na", b: str = "nb", both: str = "both"):
    """100 * both >= 75 * union."""
    return F.expr(f"7 * {both} >= 3 * ({a} + {b})")


def _likely(pairs: DataFrame, sets: DataFrame, k: int) -> DataFrame:
    """Pairs ``a, b`` of sizes that allow a link and whose union sketch does."""
    side = lambda x: sets.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    shared = F.size(F.array_intersect(F.array_intersect(union, F.col("sa")), F.col("sb")))
    return (
        pairs.join(side("a"), "a")
        .where("na > 0")
        .join(side("b"), "b")
        .where("3 * greatest(na, nb) <= 4 * least(na, nb)")
        .where(shared >= F.lit(FLOOR) * F.size(union))
        .select("a", "b")
    )


def _pairs_in_lists(lists: DataFrame, sets: DataFrame, k: int) -> DataFrame:
    """Pairs of the members of each list of ``v, rep, n`` that may link."""
    side = lambda x: lists.select("v", F.col("rep").alias(x), F.col("n").alias(f"n{x}"))
    pairs = side("a").join(side("b"), "v").where("a < b AND 3 * greatest(na, nb) <= 4 * least(na, nb)").select("a", "b").distinct()
    return _likely(pairs, sets, k).withColumn("star", F.lit(False))


def _split(lists: DataFrame, list_rows: int, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """Lists of two to ``list_rows`` members, and longer ones."""
    sizes = lists.groupBy("v").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    both = tables.write(lists.join(sizes, "v"))
    return both.where(F.col("c") <= list_rows), both.where(F.col("c") > list_rows)


def _stars(lists: DataFrame) -> DataFrame:
    """Of each list of ``v, rep, n, h`` and each two neighbouring classes of
    sizes, every member ``a`` with the pivot ``b``: the one of the most hot
    values, then the smallest id."""
    of = F.floor(F.log("n") / np.log(CLASS))
    classed = lists.withColumn("g", F.explode(F.array(of, of - 1)))
    pivots = classed.groupBy("v", "g").agg(F.max(F.struct("h", (-F.col("rep")).alias("r"))).alias("p")).select("v", "g", (-F.col("p.r")).alias("b"))
    return classed.join(pivots, ["v", "g"]).where("rep <> b").select(F.col("rep").alias("a"), "b").distinct().withColumn("star", F.lit(True))


def _dealt(index: DataFrame, probe: DataFrame, keys: list[str], member: str, size: str) -> DataFrame:
    """Index rows joined with probe rows on ``keys``. The index rows of a long
    list (of ``size`` members) are dealt over parts, each of which meets all its
    probe rows, so that no list is one task."""
    parts = F.ceil(F.col(size) / LIST_PART).cast("int")
    index = index.withColumn("_part", F.pmod(F.xxhash64(member), parts).cast("int")).drop(size)
    probe = probe.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop(size)
    return index.join(probe, [*keys, "_part"])


def _shared(posts: DataFrame, tables: Tables) -> DataFrame:
    """Rows ``a, b, e, na, c, k, s`` of lists of ``b, e`` that hold different
    components (``c``), with the list's ``size`` and ``left``: how many such
    elements ``a`` has from this one on, rarest first. Two members of different
    components share no others. ``p`` has the elements just before this one."""
    sizes = posts.groupBy("b", "e").agg(F.count(F.lit(1)).alias("size"), F.min("c").alias("_l"), F.max("c").alias("_r")).where("size > 1 AND _l <> _r").select("b", "e", "size")
    order = Window.partitionBy("a", "b").orderBy(F.col("size").desc(), "e")
    return tables.write(posts.join(sizes, ["b", "e"]).withColumns({"left": F.row_number().over(order), "p": F.collect_list("e").over(order.rowsBetween(1, SEEN))}))


def _near_links(star: DataFrame, tables: Tables) -> DataFrame:
    """Links of members of one star that have little outside its pivot, across
    components, by the size of the symmetric difference.

    Where both have at most a quarter outside, they meet by what differs; else
    by what is outside alone, of which they share all but a quarter of the set.
    Two members of several stars (``s``) meet in the first of these alone, and there
    not again at an element if they share one just before it: whatever allows two to
    meet at an element allows it at each one before."""
    rows = star.where("size(near) > 0").select("a", "b", "na", F.col("ina").alias("c"), "near", F.size("near").alias("m"), "out", (4 * F.col("out") <= F.col("na")).alias("inner"))
    mixed = rows.groupBy("b").agg((F.min("c") != F.max("c")).alias("mixed"), F.max(~F.col("inner")).alias("outer")).where("mixed").select("b", "outer")
    rows = rows.join(mixed, "b")
    rows = tables.write(rows.join(rows.groupBy("a").agg(F.collect_set("b").alias("s")), "a"))
    side = lambda x, t: t.select("b", "e", "size", *[F.col(c).alias(f"{c[-1]}{x}" if c != "a" else x) for c in ("a", "na", "c", "k", "left", "s", "p")])
    fits = "cx <> cy AND b = array_min(array_intersect(sx, sy)) AND NOT arrays_overlap(px, py) AND 3 * greatest(ax, ay) <= 4 * least(ax, ay)"
    differ = _shared(rows.where("inner").select("a", "b", "na", "c", "s", F.col("m").alias("k"), F.explode("near").alias("e")), tables)
    light, heavy = differ.where("7 * left >= 7 * k - na"), differ.where("3 * left >= 3 * k - na")
    meet = _dealt(side("x", light), side("y", heavy), ["b", "e"], "x", "size").where(f"{fits} AND 7 * ky - ay >= 7 * kx - ax AND 14 * least(tx, ty) >= 7 * ky - ay + 7 * kx - ax").select("b", "x", "y")
    outside = _shared(rows.where("outer").select("a", "b", "na", "c", "s", F.col("out").alias("k"), F.explode(F.expr("slice(near, 1, out)")).alias("e")), tables).where("4 * left >= 4 * k - na")
    more = _dealt(side("x", outside), side("y", outside), ["b", "e"], "x", "size").where(f"x < y AND {fits} AND greatest(4 * kx - ax, 4 * ky - ay) > 0 AND 4 * least(tx, ty) >= greatest(4 * kx - ax, 4 * ky - ay)").select("b", "x", "y")
    pairs = meet.union(more).select("b", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).groupBy("x", "y").agg(F.min("b").alias("b"))
    whole = lambda x: rows.select("b", F.col("a").alias(x), F.col("na").alias(f"n{x}"), F.col("near").alias(f"d{x}"))
    both = pairs.join(whole("x"), ["b", "x"]).join(whole("y"), ["b", "y"])
    apart = F.size("dx") + F.size("dy") - 2 * F.size(F.array_intersect("dx", "dy"))
    return both.where(7 * apart <= F.col("nx") + F.col("ny")).select(F.col("x").alias("a"), F.col("y").alias("b"))


def _far_lists(star: DataFrame, hot: DataFrame) -> DataFrame:
    """Lists of members of stars that share a sampled element outside their pivots:
    ``v, rep, n, h, level, own, part_of``. ``level`` is the element's last one. What a
    member keeps in several stars is listed once."""
    # The least level of a star's far members; the others keep nothing denser.
    least = star.where("level > 0").groupBy("b").agg(F.min("level").alias("least"))
    star = star.join(least, "b").where(F.col("out") >= F.lit(SAMPLE) * F.pow(F.lit(2), "least"))
    star = star.withColumn("far", F.filter("far", lambda p: p["level"] >= F.col("least")))
    once = star.groupBy("a", "na", "ina").agg(F.max("level").alias("own"), F.array_distinct(F.flatten(F.collect_list("far"))).alias("far"))
    posts = once.select("a", "na", "ina", "own", F.explode("far").alias("p"))
    posts = posts.select(F.col("p.e").alias("v"), F.col("a").alias("rep"), F.col("na").alias("n"), F.col("ina").alias("part_of"), F.col("p.level").alias("level"), "own")
    useful = posts.groupBy("v").agg(F.min("part_of").alias("l"), F.max("part_of").alias("r"), F.max("own").alias("far")).where("l <> r AND far > 0").select("v")
    return posts.join(useful, "v", "left_semi").join(hot.select("rep", "h"), "rep")


def _far_pairs(lists: DataFrame, sets: DataFrame, k: int) -> DataFrame:
    """Pairs of each of those lists that may link, across components. Two that share
    one of the lists just before, of sparser levels first, do not meet again."""
    order = Window.partitionBy("rep").orderBy(F.col("level").desc(), "v").rowsBetween(-SEEN, -1)
    lists = lists.withColumn("p", F.collect_list("v").over(order))
    side = lambda x: lists.select("v", F.col("c").alias("size"), F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("part_of").alias(f"c{x}"), F.col("own").alias(f"o{x}"), F.col("p").alias(f"p{x}"))
    pairs = _dealt(side("a"), side("b"), ["v"], "a", "size").where("a < b AND ca <> cb AND greatest(oa, ob) > 0 AND NOT arrays_overlap(pa, pb) AND 3 * greatest(na, nb) <= 4 * least(na, nb)")
    return _likely(pairs.select("a", "b").distinct(), sets, k).withColumn("star", F.lit(False))


def clusters(docs: DataFrame, sets: DataFrame, *, id_col: str, text_col: str, k: int = SKETCH, list_rows: int = LIST_ROWS, rounds: int = ROUNDS) -> DataFrame:
    """``id, component`` of every representative that links with another."""
    tables = Tables()
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL")
    postings = sets.select("rep", "n", F.posexplode("sketch").alias("place", "v"))
    cold, lists = _split(postings, list_rows, tables)
    hot = lists.groupBy("rep").agg(F.count(F.lit(1)).alias("h"), F.collect_list("v").alias("hots")).join(sets.select("rep", F.size("sketch").alias("z")), "rep").where(F.col("h") > HOT_SHARE * F.col("z")).select("rep", "h", "hots")
    hot = tables.write(hot)
    lists = lists.where(F.col("place") < HOT_VALUES).join(hot.select("rep", "h"), "rep")
    pairs, known = _pairs_in_lists(cold, sets, k), None
    for turn in range(rounds + 1):
        todo = tables.write(pairs.unionByName(_stars(lists)) if lists is not None else pairs)
        if known is not None and todo.isEmpty():
            break
        done = tables.write(_compare(todo, texts, k))
        known = merged(known, done.where(_linked()).select("a", "b"), tables)
        if lists is None:
            break
        star = done.where("star").join(hot.select(F.col("rep").alias("a"), "hots"), "a")
        reach = F.get(F.array(*map(F.lit, _reach(k))), F.size(F.array_intersect("rest", "hots")))
        star = star.where(F.col("out") < reach * F.col("na")).drop("rest", "hots")
        star = _placed(star, known)
        star = tables.write(star.join(star.where("ina <> inb").select("b").distinct(), "b", "left_semi"))
        if star.isEmpty():
            break
        known = merged(known, _near_links(star, tables), tables)
        far = tables.write(_far_lists(_placed(star.drop("ina", "inb"), known), hot))
        if far.isEmpty():
            break
        short, long = _split(far, list_rows, tables)
        last = turn + 1 == rounds or long.isEmpty()
        pairs, lists = _far_pairs(short.union(long) if last else short, sets, k), None if last else long
    tables.drop(known)
    return known


def _placed(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs ``a, b`` with the components that they are in: ``ina, inb``."""
    of = lambda x: known.select(F.col("id").alias(x), F.col("component").alias(f"in{x}"))
    return pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").withColumns({"ina": F.coalesce("ina", "a"), "inb": F.coalesce("inb", "b")})


def merged(known: DataFrame | None, edges: DataFrame, tables: Tables) -> DataFrame:
    """``known`` components after more edges, which are contracted to edges of
    components first."""
    if known is None:
        return tables.write(components(edges, tables))
    top = components(_placed(edges, known).select(F.col("ina").alias("a"), F.col("inb").alias("b")), tables)
    up = top.select(F.col("id").alias("component"), F.col("component").alias("to"))
    old = known.join(up, "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    return tables.write(old.union(top.join(known, "id", "left_anti").select("id", "component")))


def components(edges: DataFrame, tables: Tables | None = None) -> DataFrame:
    """``id, component`` for every endpoint of ``a, b``: the smallest reachable
    id, by alternating large and small stars."""

    def print_(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    tables = tables or Tables()
    e = tables.write(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    last = print_(e)
    while last[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lows = large.groupBy("u").agg(F.min("v").alias("m"))
        e = tables.write(large.join(lows, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lows.select("u", F.col("m").alias("v"))).distinct())
        now = print_(e)
        if now == last:
            break
        last = now
    tops = e.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(tops)


def groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = SKETCH, list_rows: int = LIST_ROWS, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: id, ``n_shingles``, ``component_id``, ``kept``."""
    all_ = cut(sketches(docs, id_col, text_col, k))
    sets = cut(all_.where("n > 0 AND id IS NOT NULL").groupBy("s1", "s2", "n").agg(F.min("id").alias("rep"), F.min("sketch").alias("sketch")))
    found = clusters(docs, sets, id_col=id_col, text_col=text_col, k=k, list_rows=list_rows, rounds=rounds)
    top = sets.select("s1", "s2", "n", "rep").join(found.withColumnRenamed("id", "rep"), "rep", "left")
    top = top.select("s1", "s2", "n", F.coalesce("component", "rep").alias("component"))
    labelled = all_.select("id", "n", "s1", "s2").join(top, ["s1", "s2", "n"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return labelled.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The rows of ``docs`` whose document stands for its group."""
    gone = cut(groups(docs, id_col=id_col, text_col=text_col, **kw).where("NOT kept").select(F.col(id_col).alias("_gone")).distinct())
    key = F.col(id_col).cast("long")
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(KEEP_SLOTS))
    # At most KEEP_SLOTS rows, whatever the size of `gone`; only rows that share
    # a slot with an id that goes are shuffled, for the exact answer.
    slots = F.broadcast(gone.select(slot(F.col("_gone")).alias("_slot")).distinct())
    clear = docs.join(slots, slot(key) == F.col("_slot"), "left_anti")
    doubtful = docs.join(slots, slot(key) == F.col("_slot"), "left_semi")
    return clear.union(doubtful.join(gone, key == F.col("_gone"), "left_anti"))


_UPPER, _LOWER26 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER26}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (
  SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS id, doc_id AS top FROM d UNION SELECT both_ways.b, r.top FROM r JOIN both_ways ON both_ways.a = r.id),
c AS (SELECT id, min(top) AS component_id FROM r GROUP BY id)
SELECT d.doc_id AS doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id AS component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN c ON c.id = d.doc_id
"""
