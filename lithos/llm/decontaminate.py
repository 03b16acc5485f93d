"""Benchmark decontamination.

The normalised word windows of the benchmark are a hash set that every
executor holds; document word windows are scanned against it, every hash hit is
verified word by word, and hit spans or documents are removed. The set is sorted
hashes and offsets into one buffer of words, about six bytes for each byte of
benchmark, and is broadcast only in blocks of a checked size: a larger benchmark
is scanned in several passes. Between passes the documents are written, so a
worker holds one block at a time; nothing is shuffled at any size.

Defined results. A null text has no words; a document without words has no
hits. A benchmark row with a null text, or no words, has no windows. Item ids are
listed as strings, whatever their type; a null one can hit but is not listed.
Repeated rows are reported one by one. Extra
columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithos.llm._common import Words, chunks, joined, ship, texts_as_bytes, window_hashes, written

#: Words: digits, a-z after lower-casing A-Z, and everything outside ASCII.
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[0x30:0x3A] = IS_WORD[0x61:0x7B] = IS_WORD[0x80:] = True

#: Bytes of benchmark text in one broadcast block.
BLOCK_BYTES = 16 << 20


class WindowSet:
    """Windows of some benchmark items, by their length in words: sorted hashes,
    and for each the item and where its words lie in one buffer."""

    def __init__(self, items: list[tuple[str | None, bytes]], width: int):
        self.ids = [item for item, _ in items]
        parts: dict[int, list] = defaultdict(list)
        buffers, at = [], 0
        for k, (_, text) in enumerate(items):
            words = Words(text + b" ", IS_WORD)
            n = len(words.starts)
            if not n:
                continue
            length = min(n, width)
            # The words alone, one blank after each.
            sizes = words.ends - words.starts + 1
            begins = np.concatenate([[0], np.cumsum(sizes)])
            pick = np.repeat(words.starts - begins[:-1], sizes) + np.arange(begins[-1])
            flat = np.append(words.data, np.uint8(32))[pick]
            flat[begins[1:] - 1] = 32
            buffers.append(flat)
            m = n - length + 1
            parts[length].append((window_hashes(words.hashes, length), np.full(m, k, np.int32), at + begins[:m], at + begins[length : length + m] - 1))
            at += len(flat)
        self.buffer = np.concatenate(buffers).tobytes() if buffers else b""
        self.tables: dict[int, tuple[np.ndarray, ...]] = {}
        self.maps: dict[int, np.ndarray] = {}
        for length, found in parts.items():
            columns = [np.concatenate(c) for c in zip(*found, strict=True)]
            order = np.lexsort((columns[1], columns[0]))
            self.tables[length] = tuple(c[order] for c in columns)
            self.maps[length] = np.zeros(1 << 20, dtype=bool)
            self.maps[length][columns[0] >> np.uint64(44)] = True

    def items_with(self, length: int, first: int, last: int, window: bytes) -> set:
        """Ids of the rows from ``first`` to ``last`` whose words are those."""
        _, item, start, end = self.tables[length]
        return {self.ids[item[r]] for r in range(first, last) if self.buffer[start[r] : end[r]] == window}


def _words(words: Words, first: int, length: int) -> bytes:
    data, s, e = words.data, words.starts, words.ends
    return b" ".join(data[s[k] : e[k]].tobytes() for k in range(first, first + length))


def _scan(texts: list[bytes], windows: WindowSet, spans_before: list, items_before: list):
    raw, begins = joined(texts)
    words = Words(raw, IS_WORD)
    n = len(words.starts)
    doc = np.searchsorted(begins, words.starts, side="right") - 1
    mark = np.zeros(n + 1, dtype=np.int64)
    items: list[set] = [set(x or ()) for x in items_before]
    for k, spans in enumerate(spans_before):
        for a, b in spans or ():
            i, j = np.searchsorted(words.starts, [a + begins[k], b + begins[k]])
            mark[i] += 1
            mark[j] -= 1
    for length, (known, *_) in windows.tables.items():
        if n < length:
            continue
        h = window_hashes(words.hashes, length)
        maybe = np.flatnonzero(windows.maps[length][h >> np.uint64(44)])
        maybe = maybe[doc[maybe] == doc[maybe + length - 1]]
        first, last = (np.searchsorted(known, h[maybe], side=s) for s in ("left", "right"))
        for k in np.flatnonzero(first < last).tolist():
            i = int(maybe[k])
            found = windows.items_with(length, int(first[k]), int(last[k]), _words(words, i, length))
            if found:
                mark[i] += 1
                mark[i + length] -= 1
                items[doc[i]] |= found
    hit = np.cumsum(mark[:-1]) > 0
    n_words = np.bincount(doc, minlength=len(texts))
    n_hit = np.bincount(doc[hit], minlength=len(texts))
    spans: list[list] = [[] for _ in texts]
    where = np.flatnonzero(hit)
    if len(where):
        new_run = np.flatnonzero((np.diff(where) > 1) | (np.diff(doc[where]) > 0)) + 1
        for run in np.split(where, new_run):
            k = doc[run[0]]
            spans[k].append((int(words.starts[run[0]] - begins[k]), int(words.ends[run[-1]] - begins[k])))
    return n_words, n_hit, spans, items


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


_FOUND = ("_n_words", "_n_hit", "_items", "_spans")


def _found(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...], text_col: str, item_id: str, item_text: str, width: int, block_bytes: int) -> DataFrame:
    """``_k0, _k1, ..`` for the kept columns, ``_text`` and what was found: names
    of their own, so that no column of ``docs`` can clash."""
    spark = docs.sparkSession
    ship(spark)
    out = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col(text_col).alias("_text")).withColumns(
        {
            "_n_words": F.lit(0).cast("long"),
            "_n_hit": F.lit(0).cast("long"),
            "_items": F.expr("cast(array() as array<string>)"),
            "_spans": F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)"),
        }
    )
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-size // block_bytes))
    for block in range(n_blocks):
        # Each block is about block_bytes of benchmark text, checked above. Written
        # documents end the pass before, and with it the need of its block.
        out = written(out) if block else out
        part = items if n_blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == block)
        rows = [(r.item, r.text.encode()) for r in part.where("text is not null").collect()]
        windows = spark.sparkContext.broadcast(WindowSet(rows, width))

        def scan(batches: Iterator[pa.RecordBatch], windows=windows) -> Iterator[pa.RecordBatch]:
            for batch in chunks(batches, "_text"):
                at = batch.schema.get_field_index
                n_words, n_hit, spans, found = _scan(
                    texts_as_bytes(batch, "_text"),
                    windows.value,
                    [[(x["start"], x["end"]) for x in s] for s in batch.column(at("_spans")).to_pylist()],
                    batch.column(at("_items")).to_pylist(),
                )
                new = {
                    "_n_words": pa.array(n_words, pa.int64()),
                    "_n_hit": pa.array(n_hit, pa.int64()),
                    "_items": pa.array([sorted(x for x in f if x is not None) for f in found], pa.list_(pa.string())),
                    "_spans": pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], _SPANS),
                }
                names = batch.schema.names
                yield pa.RecordBatch.from_arrays([new.get(c, batch.column(at(c))) for c in names], names=names)

        out = out.mapInArrow(scan, out.schema)
    return out


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = 10,
    keep: tuple[str, ...] = ("doc_id",),
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The columns in ``keep``, then ``n_words``, ``n_hit``, ``items`` (ids of the
    items with an occurring window) and ``spans`` (UTF-8 byte ranges of hit runs
    of words)."""
    found = _found(docs, benchmark, keep, text_col, item_id, item_text, width, block_bytes)
    return found.drop("_text").toDF(*keep, "n_words", "n_hit", "items", "spans")


def clean(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    remove: str = "documents",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = 10,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Documents without contamination, with the columns of ``docs``.

    ``remove="documents"`` drops every document with a hit; ``"spans"`` keeps
    it and cuts the hit runs of words from its text."""
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    cols = docs.columns
    found = _found(docs, benchmark, tuple(cols), text_col, item_id, item_text, width, block_bytes)
    if remove == "documents":
        return found.where("_n_hit = 0").select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(cols)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "_text"):
            texts = batch.column(len(cols)).cast(pa.large_binary()).to_pylist()
            spans = batch.column(batch.schema.get_field_index("_spans")).to_pylist()
            for i, (t, ss) in enumerate(zip(texts, spans, strict=True)):
                for s in reversed(ss):
                    t = t[: s["start"]] + t[s["end"] :]
                texts[i] = t
            arrays = list(batch.columns[: len(cols)])
            arrays[cols.index(text_col)] = pa.array([None if t is None else t.decode() for t in texts], pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names=cols)

    return found.mapInArrow(cut, docs.schema)


def report(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", **kw) -> DataFrame:
    """The digest of :func:`contamination`: counts, the hash of the item ids
    sorted as strings, and the verdict."""
    found = contamination(docs, benchmark, keep=(id_col,), **kw)
    return found.select(
        id_col,
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_UPPER, _LOWER26 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER26}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b0 AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER26}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
b AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b0 WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM b),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hits AS (SELECT doc_id, b.n AS n, i, item_id FROM dw JOIN b ON b.win = dw.win AND b.n = dw.n),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id AS doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(words.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(its.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(its.ids, '')) AS items_sha256, coalesce(words.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN its USING (doc_id)
"""
