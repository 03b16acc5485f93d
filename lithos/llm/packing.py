"""Packing token sequences by cutting-stock column generation.

Every document becomes its ids and an end id. Full sequences are cut off as they
stand; what remains of each document is one piece shorter than a sequence. The
histogram of those lengths (at most ``width`` numbers, at any corpus size) is
the demand of a cutting-stock problem: a linear program over patterns, whose
new columns an unbounded-knapsack dynamic program prices. Patterns are rounded
down, the rest is packed best-fit. Pieces are ranked within their length and
the rank decides the pattern, the sequence and the offset, so the documents
themselves are never gathered anywhere.

Defined results. A null text is empty and yields the end id alone. Repeated
rows are packed one by one. An empty table gives no rows. Extra columns are
ignored.
"""

from __future__ import annotations

import base64
import functools
import heapq
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithos.llm._common import chunks, cut, ranked, ship

#: Runs of white space that the vocabulary's pattern can't take in one go.
LONG_BLANK = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{65536,}")


@functools.lru_cache(maxsize=2)
def _encoder(path: str):
    """The vocabulary at ``path`` (a rank file), without special tokens: their
    strings in a text are ordinary text."""
    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def vocabulary() -> str:
    """Rank file with the ids of ``byte_bpe_50k.json``."""
    from public_tokenizers import path

    return path("byte_bpe_50k.tiktoken")


@functools.lru_cache(maxsize=1)
def _added() -> dict[str, int]:
    """The tokens that ``byte_bpe_50k.json`` adds to its vocabulary, and their ids."""
    from public_tokenizers import path

    with open(path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


def _ordinary(path: str):
    """Ids of ordinary text. The pattern takes a run of white space whole at the
    end of a text, and else all but its last character; very long runs are cut
    off so before the pattern sees them, because it would run out of stack."""
    vocabulary_ = _encoder(path)

    def run(text: str) -> list[int]:
        ids, at = [], 0
        if len(text) >= 65536:
            for m in LONG_BLANK.finditer(text):
                end = m.end() - (m.end() < len(text))
                ids += vocabulary_.encode_ordinary(text[at : m.start()])
                ids += vocabulary_._core_bpe.encode_single_piece(text[m.start() : end].encode())
                at = end
        return ids + vocabulary_.encode_ordinary(text[at:])

    return run


def encoder(ranks: str | None = None):
    """The ids of a text as ``byte_bpe_50k.json`` gives them without special tokens
    around it: added tokens in the text are one id each. A rank file of one's own
    has none."""
    encode = _ordinary(ranks or vocabulary())
    added = {} if ranks else _added()
    if not added:
        return encode
    split = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")

    def run(text: str) -> list[int]:
        if not any(t in text for t in added):
            return encode(text)
        return [i for part in split.split(text) for i in ([added[part]] if part in added else encode(part))]

    return run


#: What a piece is; the id has a name of its own until the end.
_PIECE = ("_id", "start", "length", "ids_crc32", "doc_tokens")


def pieces(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 1024, end_id: int = 0, ranks: str | None = None) -> DataFrame:
    """Tokenise and cut: one row per piece of at most ``width`` ids."""
    return _pieces(docs, id_col, text_col, width, end_id, ranks).toDF(id_col, *_PIECE[1:])


def _pieces(docs: DataFrame, id_col: str, text_col: str, width: int, end_id: int, ranks: str | None) -> DataFrame:
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks)
        for batch in chunks(batches, "_text"):
            keys = batch.column(0).to_pylist()
            out = ([], [], [], [], [])
            for key, text in zip(keys, batch.column(1).to_pylist(), strict=True):
                ids = encode(text) if text else []
                ids.append(end_id)
                flat = np.array(ids, dtype="<u4").tobytes()
                for a in range(0, len(ids), width):
                    b = min(len(ids), a + width)
                    for col, v in zip(out, (key, a, b - a, zlib.crc32(flat[4 * a : 4 * b]), len(ids)), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=list(_PIECE))

    source = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return source.mapInArrow(run, ", ".join(f"{c} bigint" for c in _PIECE))


# ---------------------------------------------------------------- the program


#: Columns that one run of the dynamic program may bring in.
COLUMNS = 16
#: Share of the lower bound that the program's value may stay above it.
GAP = 2e-4
#: Runs of the dynamic program at most: what is left to gain then is a share of
#: about 1e-3, and the driver's time stays some ten seconds for any corpus.
PRICINGS = 300


def _price(duals: np.ndarray, width: int, most: int = COLUMNS) -> tuple[float, list[np.ndarray]]:
    """Patterns of large total dual, the largest first, and that total, by one
    unbounded knapsack. ``duals[l]`` is the dual of length ``l``. The others are
    the best patterns that hold one more given length."""
    lengths = np.flatnonzero(duals > 1e-12)
    best = np.zeros(width + 1)
    choice = np.zeros(width + 1, dtype=np.int64)
    gain = duals[lengths]
    fits = np.searchsorted(lengths, np.arange(width + 1), side="right")
    for c in range(1, width + 1):
        k = fits[c]
        best[c] = best[c - 1]
        if k:
            v = gain[:k] + best[c - lengths[:k]]
            j = int(v.argmax())
            if v[j] > best[c] + 1e-12:
                best[c], choice[c] = v[j], lengths[j]

    def filled(c: int, first: int) -> np.ndarray:
        pattern = np.zeros(width + 1, dtype=np.int64)
        pattern[first] += first > 0
        while c > 0:
            if choice[c]:
                pattern[choice[c]] += 1
                c -= choice[c]
            else:
                c -= 1
        return pattern

    with_one = np.argsort(-(gain + best[width - lengths]), kind="stable")[: most - 1]
    return float(best[width]), [filled(width, 0), *(filled(width - int(lengths[j]), int(lengths[j])) for j in with_one)]


def solve(demand: dict[int, int], width: int) -> list[tuple[int, dict[int, int]]]:
    """Patterns ``(copies, {length: number})`` that cover ``demand`` exactly,
    none longer than ``width``.

    The first basis is the greedy packing: each of its patterns uses up a
    length, so its matrix is triangular. Columns are priced and generated until
    no column gains, or the program's value is proven: rounded up it is that of
    its lower bound (the summed lengths, or the duals over the best price), or
    above it by a share of ``GAP`` at most; or ``PRICINGS`` runs are over."""
    demand = {k: v for k, v in demand.items() if v}
    if not demand:
        return []
    lengths = np.array(sorted(demand), dtype=np.int64)
    row = {k: i for i, k in enumerate(lengths.tolist())}
    need = np.array([demand[k] for k in lengths.tolist()], dtype=float)
    m = len(lengths)
    columns = np.diag((width // lengths).astype(float))
    x = np.zeros(m)
    # Sparse forward substitution; no BLAS, whose threads would fight for cores.
    inverse, below = np.eye(m), [[] for _ in range(m)]
    for n, pattern, done in _basis(demand, width):
        r = row[done]
        columns[:, r] = 0
        columns[[row[k] for k in pattern], r] = list(pattern.values())
        x[r] = n
        for j, a in below[r]:
            inverse[r] -= a * inverse[j]
        inverse[r] /= pattern[done]
        for k, a in pattern.items():
            if k != done:
                below[row[k]].append((r, a))
    least = float((lengths * need).sum()) / width
    # A small extra demand breaks ties in the ratios, so that no basis returns.
    x = np.maximum(x + (inverse * (need * np.random.default_rng(1).uniform(0, 1e-8, m))).sum(axis=1), 0)
    idle = runs = 0
    while np.ceil(x.sum() - 1e-6) > np.ceil(least - 1e-6) and x.sum() > least * (1 + GAP) and runs < PRICINGS:
        runs += 1
        duals = np.zeros(width + 1)
        duals[lengths] = np.maximum(inverse.sum(axis=0), 0)
        value, found = _price(duals, width)
        least = max(least, float(duals[lengths] @ need) / value)
        if value <= 1 + 1e-9:
            break
        before = x.sum()
        for pattern in found:
            column = pattern[lengths].astype(float)
            some = np.flatnonzero(column)
            step = (inverse[:, some] * column[some]).sum(axis=1)
            rows = np.flatnonzero(step > 1e-9)
            if step.sum() <= 1 + 1e-9 or not len(rows):  # the last pivot took its gain
                continue
            ratio = x[rows] / step[rows]
            r = int(rows[ratio.argmin()])
            theta = float(ratio.min())
            pivot = inverse[r] / step[r]
            inverse -= np.outer(step, pivot)
            inverse[r] = pivot
            x = np.maximum(x - theta * step, 0)
            x[r] = theta
            columns[:, r] = column
        idle = 0 if x.sum() < before * (1 - 1e-12) else idle + 1
        if idle > m:  # rounding errors only
            break
    left = need.astype(np.int64)
    copies = np.zeros(m, dtype=np.int64)
    whole = np.rint(columns).astype(np.int64)
    waste = width - lengths @ whole
    for rounded in (np.floor(x + 1e-6), np.ceil(x - 1e-6)):  # up only where a sequence is left full
        for p in np.lexsort((-x, waste)):
            some = whole[:, p] > 0
            if rounded[p] > copies[p] and (rounded[p] == np.floor(x[p] + 1e-6) or waste[p] == 0):
                n = int(min(rounded[p] - copies[p], (left[some] // whole[some, p]).min()))
                copies[p] += n
                left -= n * whole[:, p]
    out = [(int(copies[p]), {int(k): int(a) for k, a in zip(lengths, whole[:, p], strict=True) if a}) for p in range(m) if copies[p]]
    return out + _greedy({int(k): int(v) for k, v in zip(lengths, left, strict=True) if v}, width)


def _basis(demand: dict[int, int], width: int) -> Iterator[tuple[float, dict[int, int], int]]:
    """Longest pieces first, in fractions of copies: each pattern uses up the
    length that comes with it."""
    rest = {k: float(v) for k, v in demand.items()}
    while rest:
        pattern: dict[int, int] = {}
        room = width
        for k in sorted(rest, reverse=True):
            if k <= room:
                pattern[k] = room // k
                room -= pattern[k] * k
        n, done = min((rest[k] / a, k) for k, a in pattern.items())
        for k, a in pattern.items():
            rest[k] = max(rest[k] - n * a, 0.0)
        del rest[done]
        yield n, pattern, done


def _greedy(demand: dict[int, int], width: int) -> list[tuple[int, dict[int, int]]]:
    """Whole copies, longest pieces first, as many of each pattern as the counts
    allow, so its steps don't grow with the counts."""
    rest, out = dict(demand), []
    while rest:
        pattern: dict[int, int] = {}
        room = width
        for k in sorted(rest, reverse=True):
            if k <= room:
                pattern[k] = min(rest[k], room // k)
                room -= pattern[k] * k
        n = min(rest[k] // a for k, a in pattern.items())
        for k, a in pattern.items():
            rest[k] -= n * a
            if not rest[k]:
                del rest[k]
        out.append((n, pattern))
    return out


def plan(histogram: dict[int, int], width: int) -> np.ndarray:
    """Assignment table, a row for each (pattern, length): length, first rank,
    pieces of it in one sequence, first sequence, offset. Sorted by length and
    rank; at most a few rows for each length and pattern."""
    patterns = solve({k: v for k, v in histogram.items() if k < width}, width)
    if histogram.get(width):
        patterns.append((histogram[width], {width: 1}))
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for n, pattern in patterns:
        offset = 0
        for k, a in sorted(pattern.items(), reverse=True):
            rows.append((k, used.get(k, 0), a, sequence, offset))
            used[k] = used.get(k, 0) + n * a
            offset += k * a
        sequence += n
    rows = heapq.nsmallest(len(rows), rows)
    return np.array(rows, dtype=np.int64).reshape(-1, 5)


# ------------------------------------------------------------ the whole corpus


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 1024, end_id: int = 0, ranks: str | None = None) -> DataFrame:
    """One row per piece with its ``sequence_id`` and ``offset``."""
    cutup = cut(_pieces(docs, id_col, text_col, width, end_id, ranks))
    # At most `width` rows reach the driver.
    histogram = {r[0]: r[1] for r in cutup.groupBy("length").count().collect()}
    table = plan(histogram, width)
    order = ["_id", "start", "ids_crc32", "doc_tokens"]
    placed = ranked(cutup, "length", order, total=sum(histogram.values()))
    shared = docs.sparkSession.sparkContext.broadcast(table)
    names = [*_PIECE, "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        keys = (t[:, 0] << 44) | t[:, 1]
        for batch in batches:
            at = batch.schema.get_field_index
            length, rank = (batch.column(at(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            row = t[np.searchsorted(keys, (length << 44) | rank, side="right") - 1]
            copy, slot = np.divmod(rank - row[:, 1], row[:, 2])
            new = {"sequence_id": pa.array(row[:, 3] + copy), "offset": pa.array(row[:, 4] + slot * length)}
            yield pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(at(c)) for c in names], names=names)

    out = placed.select(*_PIECE, "rank").mapInArrow(run, ", ".join(f"{c} bigint" for c in names))
    return out.toDF(id_col, *names[1:])
