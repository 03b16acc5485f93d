"""Shared plumbing of the training-data operators: shipping the package,
cutting lineage, and vectorised word hashing over UTF-8 bytes."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lithos.lineage import cut, shared_folder
from lithos.sources import storage

__all__ = ["BLOCK", "Tables", "Words", "chunks", "cut", "joined", "mix", "ranked", "shared_folder", "ship", "texts_as_bytes", "window_hashes", "written"]

#: Bytes of text that one numpy block holds; bounds a Python worker's memory.
BLOCK = 1 << 20

#: Rows of one group that a ranking task holds, about.
RANK_ROWS = 4_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of every executor."""
    sc = spark.sparkContext
    if getattr(sc, "_lithos_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp()) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))
    sc._lithos_shipped = True


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder. Unlike a checkpoint, whose size
    estimate is that of its plan and multiplies with every join of a loop, a
    table has the size of its files, so joins with small ones are broadcast."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lithos_path = path
    return out


class Tables:
    """Tables written on the way to a result; `drop` deletes all but its own."""

    def __init__(self) -> None:
        self._all: list[DataFrame] = []

    def write(self, df: DataFrame) -> DataFrame:
        self._all.append(written(df))
        return self._all[-1]

    def drop(self, keep: DataFrame) -> None:
        for t in self._all:
            if t is not keep:
                storage.delete(t.sparkSession, t._lithos_path)
        self._all = [keep]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser, so that high bits are uniform."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW, _NEG = _powers(_ODD, BLOCK + 1), _powers(_INV, BLOCK + 1)


class Words:
    """Words of UTF-8 text, lower-cased in A-Z, as maximal runs of the bytes
    marked in ``is_word``. ``starts``/``ends`` are byte offsets into ``data``;
    ``hashes`` are 64-bit."""

    def __init__(self, raw: bytes, is_word: np.ndarray):
        self.data = _LOWER[np.frombuffer(raw, dtype=np.uint8)]
        parts, pos, n = [], 0, len(self.data)
        while pos < n:
            end = min(n, pos + BLOCK)
            if end < n:
                gaps = np.flatnonzero(~is_word[self.data[pos:end]])
                if len(gaps):
                    end = pos + int(gaps[-1]) + 1
                else:  # one word longer than a block
                    while end < n and is_word[self.data[end]]:
                        end += 1
            parts.append(self._block(pos, end, is_word))
            pos = end
        empty = np.zeros(0, dtype=np.int64)
        self.starts = np.concatenate([p[0] for p in parts]) if parts else empty
        self.ends = np.concatenate([p[1] for p in parts]) if parts else empty
        self.hashes = np.concatenate([p[2] for p in parts]) if parts else empty.astype(np.uint64)

    def _block(self, pos: int, end: int, is_word: np.ndarray):
        d = self.data[pos:end]
        n = len(d)
        flags = np.zeros(n + 2, dtype=np.int8)
        flags[1:-1] = is_word[d]
        edge = np.diff(flags)
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        power, neg = (_POW, _NEG) if n <= BLOCK else (_powers(_ODD, n + 1), _powers(_INV, n + 1))
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[d] * power[:n], out=total[1:])
        return s + pos, e + pos, mix((total[e] - total[s]) * neg[s] + (e - s).astype(np.uint64))


def window_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of ``length`` consecutive words."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(length):
        out = out * _ODD + hashes[k : k + n]
    return mix(out + np.uint64(length))


@functools.lru_cache(maxsize=1)
def _trim() -> Callable[[int], int] | None:
    """The C library's ``malloc_trim``, where there is one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError, TypeError):
        return None


def give_back() -> None:
    """Return freed memory to the system. A Python worker outlives its task, and
    else keeps what its largest block took until the next one ends."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = 2 * BLOCK) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``limit`` bytes of text, or
    one row. Freed memory goes back to the system after each batch."""
    for batch in batches:
        sizes = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())
        lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(sizes), 0)).astype(np.int64)
        part = np.cumsum(lengths) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        del sizes
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)
        del batch
        give_back()


def texts_as_bytes(batch: pa.RecordBatch, text: str) -> list[bytes]:
    """Texts as UTF-8; null is empty."""
    col = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())
    return [b"" if x is None else x for x in col.to_pylist()]


def joined(texts: list[bytes]) -> tuple[bytes, np.ndarray]:
    """All texts with a blank after each, and where each begins."""
    raw = b" ".join(texts) + b" "
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    return raw, np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(texts) else np.zeros(0, dtype=np.int64)


def ranked(df: DataFrame, group: str, order: list[str], rows_in_task: int = RANK_ROWS, total: int | None = None, first: str | None = None) -> DataFrame:
    """Adds ``rank``: gapless from 0 within ``group``. A group of any size is
    dealt over hash buckets, ranked in each, and shifted by bucket offsets.
    ``first`` is a small number by which ranks rise before all else."""
    total = df.count() if total is None else total
    n = 1 + total // rows_in_task
    bucket = F.pmod(F.xxhash64(*order), F.lit(n))
    hashed = df.withColumn("_bucket", bucket if first is None else F.col(first).cast("long") * n + bucket)
    sizes = hashed.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(
        F.col(group).alias("_g"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_shift")
    )
    inner = Window.partitionBy(group, "_bucket").orderBy(*order)
    return (
        hashed.withColumn("_rn", F.row_number().over(inner) - 1)
        .join(shifts, (F.col(group) == F.col("_g")) & (F.col("_bucket") == F.col("_b")))
        .withColumn("rank", F.col("_rn") + F.col("_shift"))
        .drop("_rn", "_shift", "_g", "_b", "_bucket")
    )
