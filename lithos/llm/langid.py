"""Language identification with hyperdimensional profiles.

Every letter has a random bipolar vector, made from its code point by a hash.
An n-gram of letters binds its letters' vectors, each permuted by its place; a
document bundles its n-grams; a language bundles its documents, each of unit
length, so that neither long texts nor a large source weigh more. A document
gets the language whose prototype has the largest cosine with it.

Non-letters separate words; n-grams (three letters) include one separator at
either end. Sums are integers, so the result does not depend on the order of
partial sums.

Defined results. A text that is null or has no letter gets ``und`` and score 0,
and so does every text if no row can be learned from. Ties go to the language
that sorts first. A null id is never learned from and not held out. Repeated rows
are reported one by one; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithos.llm._common import chunks, mix, ship

UND = "und"
DIMENSIONS = 1024
_SCALE = 1 << 20
_GRAMS = 512
#: Bytes of text that are taken at once; bounds a Python worker's memory.
BLOCK = 1 << 18
#: Characters of a text that are taken at once.
LONG = 1 << 20


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point to its lower-case letter, or 0."""
    out = np.zeros(0x110000, dtype=np.int64)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            out[cp] = ord(low) if len(low) == 1 else cp
    return out


def _letter_bits(code_points: np.ndarray, dims: int) -> np.ndarray:
    """Random bits of each letter, a row for each."""
    words = np.arange(dims // 64, dtype=np.uint64)[None, :]
    seed = mix(code_points.astype(np.uint64) + np.uint64(1))[:, None]
    return np.unpackbits(mix(seed + words * np.uint64(0x9E3779B97F4A7C15)).view(np.uint8), axis=1)


def document_vectors(texts: list[str | None], dims: int = DIMENSIONS) -> np.ndarray:
    """Unit vector of each text, a row for each; zero without letters."""
    out = np.zeros((len(texts), dims), dtype=np.float64)
    short = [k for k, t in enumerate(texts) if len(t or "") <= LONG]
    if short:
        out[short] = _sums([texts[k] or "" for k in short], dims)
    for k, t in enumerate(texts):
        # A long text in pieces, with the neighbours of the letters at their ends.
        for a in range(0, len(t or "") if len(t or "") > LONG else 0, LONG):
            piece = t[max(a - 1, 0) : a + LONG + 1]
            out[k] += _sums([piece], dims, a > 0, a + LONG < len(t))[0]
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norms, out=out, where=norms > 0).astype(np.float32)


def _sums(texts: list[str], dims: int, skip_first: bool = False, skip_last: bool = False) -> np.ndarray:
    """Sum of the n-gram vectors of each text. The n-grams in whose middle the
    first or last character of all is may be left out."""
    raw = "\n".join(texts) + "\n"
    points = np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    doc = np.repeat(np.arange(len(texts)), np.array([len(t) + 1 for t in texts], dtype=np.int64))
    letters = _letters()[points]
    counted = letters != 0
    if skip_first:
        counted[0] = False
    if skip_last:
        counted[-2] = False  # before the line feed
    keep = (letters != 0) | np.concatenate([[True], letters[:-1] != 0])
    letters, doc, counted = (np.concatenate([np.zeros(1, x.dtype), x[keep]]) for x in (letters, doc, counted))
    out = np.zeros((len(texts), dims), dtype=np.float32)
    middle = np.flatnonzero(counted[1:-1]) + 1
    if not len(middle):
        return out
    # Numbered letters of this block, then numbered n-grams.
    alphabet, index = np.unique(letters, return_inverse=True)
    size = len(alphabet)
    code = (index[middle - 1] * size + index[middle]) * size + index[middle + 1]
    grams, gram = np.unique(code, return_inverse=True)
    cells, counts = np.unique(gram.astype(np.int64) * len(texts) + doc[middle], return_counts=True)
    cell_gram, cell_doc = np.divmod(cells, len(texts))
    bits = _letter_bits(alphabet, dims)
    turned, twice = np.roll(bits, 1, axis=1), np.roll(bits, 2, axis=1)
    for a in range(0, len(grams), _GRAMS):
        some = grams[a : a + _GRAMS]
        first, rest = np.divmod(some, size * size)
        second, third = np.divmod(rest, size)
        vectors = 1 - 2 * (twice[first] ^ turned[second] ^ bits[third]).astype(np.float32)
        lo, hi = np.searchsorted(cell_gram, [a, a + len(some)])
        weights = np.zeros((len(texts), len(some)), dtype=np.float32)
        weights[cell_doc[lo:hi], cell_gram[lo:hi] - a] = counts[lo:hi]
        out += weights @ vectors
    return out


#: Letters of a text from which `known_only` asks for its whole cosine, and up to
#: which for none.
FULL_LETTERS = 200
FREE_LETTERS = 20


def held_out(id_col: str) -> Column:
    """crc32 of the id as text leaves 1 by 3; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(3)) == 1, F.lit(False))


def _blocks(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, text, BLOCK):
        for a in range(0, batch.num_rows, 1024):
            yield batch.slice(a, 1024)


def fit(labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang", dims: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Language to its prototype, over all labelled rows. What reaches the driver
    is one vector for each language."""
    ship(labelled.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in _blocks(batches, "text"):
            vectors = np.rint(document_vectors(batch.column(0).to_pylist(), dims).astype(np.float64) * _SCALE).astype(np.int64)
            langs = np.array(batch.column(1).to_pylist(), dtype=object)
            for lang in set(langs):
                sums[lang] = sums.get(lang, 0) + vectors[langs == lang].sum(axis=0)
        for lang, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dims, pa.string()), pa.array(np.arange(dims)), pa.array(total)], names=["lang", "dim", "total"])

    source = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    parts = source.mapInArrow(run, "lang string, dim bigint, total bigint")
    rows = parts.groupBy("lang", "dim").agg(F.sum("total").alias("total")).collect()
    out: dict[str, np.ndarray] = {}
    for r in rows:
        out.setdefault(r.lang, np.zeros(dims))[r.dim] = r.total
    return {k: out[k] / n for k in sorted(out) if (n := np.linalg.norm(out[k]))}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], *, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns in ``keep``, then ``lang_pred`` and ``score``: the best
    language and its cosine, at least 0."""
    ship(docs.sparkSession)
    langs = list(prototypes)
    table = docs.sparkSession.sparkContext.broadcast(np.stack([prototypes[k] for k in langs]).astype(np.float32) if langs else None)
    # A kept text goes to the workers once.
    source = docs.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)), *([] if text_col in keep else [F.col(text_col).alias("_text")]))
    at = keep.index(text_col) if text_col in keep else len(keep)
    kinds, source_names = source.dtypes[: len(keep)], source.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = table.value
        for batch in _blocks(batches, source_names[at]):
            lang, score = [UND] * batch.num_rows, np.zeros(batch.num_rows)
            if p is not None:
                vectors = document_vectors(batch.column(at).to_pylist(), p.shape[1])
                cosines = vectors @ p.T
                best = cosines.argmax(axis=1)
                some = vectors.any(axis=1)
                lang = [langs[b] if s else UND for b, s in zip(best.tolist(), some.tolist(), strict=True)]
                score = np.clip(cosines[np.arange(len(best)), best].astype(np.float64), 0, 1) * some
            names = [k for k, _ in kinds]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(lang, pa.string()), pa.array(score)], names=[*names, "lang_pred", "score"])

    out = source.mapInArrow(run, ", ".join([*(f"{k} {t}" for k, t in kinds), "lang_pred string, score double"]))
    return out.toDF(*keep, "lang_pred", "score")


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: tuple[str, ...] = ()) -> DataFrame:
    """Learn from the labelled rows that aren't held out, predict all rows."""
    learn = docs.where(F.col(id_col).isNotNull() & ~held_out(id_col))
    return predict(docs, fit(learn, text_col=text_col, lang_col=lang_col), text_col=text_col, keep=keep or (id_col,))


def report(docs: DataFrame, *, id_col: str = "doc_id", **kw) -> DataFrame:
    """One row per document: id, ``held_out``, ``lang_pred``, ``score``."""
    return identify(docs, id_col=id_col, **kw).select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")


def known_only(docs: DataFrame, *, least: float = 0.08, **kw) -> DataFrame:
    """Rows of ``docs`` in one of the learned languages: those with ``und``, or a
    cosine below ``least``, go. A short text can't reach a high cosine, so up to
    ``FULL_LETTERS`` letters ``least`` shrinks with them, to none at
    ``FREE_LETTERS``."""
    cols = docs.columns
    found = identify(docs, keep=tuple(cols), **kw)
    letters = F.length(F.regexp_replace(f"_c{cols.index(kw.get('text_col', 'text'))}", r"[^\p{L}]", ""))
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (letters - FREE_LETTERS) / (FULL_LETTERS - FREE_LETTERS)))
    # Letters are counted only below ``least``.
    ok = (F.col("lang_pred") != UND) & F.when(F.col("score") >= least, True).otherwise(F.col("score") >= least * share)
    # By place: kept columns may be named like the two that were added.
    n = len(cols)
    found = found.toDF(*[f"_c{i}" for i in range(n)], "lang_pred", "score").where(ok)
    return found.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(cols)])
