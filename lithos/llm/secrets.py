"""Secret scans.

Three fixed patterns find assignments, access keys and long hexadecimal runs.
The token-efficiency test finds the rest: a run of credential characters that a
byte-pair vocabulary needs many tokens for is a random string. Known digests,
UUIDs and numbers are left out before the test; runs that look like words or names
take it with a lower threshold.

Defined results. A null text is empty. Offsets are code points, ends exclusive.
Repeated rows are reported one by one; an empty table gives no rows. Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithos.llm._common import chunks, ship
from lithos.llm.packing import _encoder, vocabulary

ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9a-f]{128}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64})")
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
NUMBER = re.compile(r"[0-9+/_=-]+")
NAME = re.compile(r"(?:[A-Za-z]+[0-9]*|[0-9]+)(?:[_/=+-]+(?:[A-Za-z]+[0-9]*|[0-9]+))*")
#: Share of the threshold for runs that look like names: words are cut finer than
#: prose, down to 2.0 characters per token of 2.2.
NAME_SHARE = 0.9


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the fixed patterns: leftmost, non-overlapping in each kind."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def is_known(run: str) -> bool:
    """Known digests, UUIDs and numbers."""
    return bool(DIGEST.fullmatch(run) or UUID.fullmatch(run) or NUMBER.fullmatch(run))


def is_name(run: str) -> bool:
    """Of the shape of a word, or of a name of words and numbers."""
    return bool(NAME.fullmatch(run)) and all(p.islower() or p.isupper() or p.istitle() for p in re.findall(r"[A-Za-z]+", run))


def random_spans(text: str, encode, most_chars_per_token: float) -> list[tuple[int, int, str]]:
    """Runs whose characters per token are below the threshold, the known ones
    left out; those that look like names need ``NAME_SHARE`` of it."""
    out = []
    for m in CANDIDATE.finditer(text):
        run = m[0]
        if not is_known(run):
            limit = most_chars_per_token
            if len(run) / len(encode(run)) >= limit:
                continue
            # Vocabularies know few words in capitals, so names count in small letters.
            if not is_name(run) or len(run) / len(encode(run.lower())) < NAME_SHARE * limit:
                out.append((m.start(), m.end(), "random"))
    return out


_SCHEMA = "n_assign bigint, n_access bigint, n_hex bigint, n_random bigint, base_sha256 string, spans string"


def scan(docs: DataFrame, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), ranks: str | None = None, most_chars_per_token: float = 2.2) -> DataFrame:
    """Per document: the columns in ``keep``, counts of spans by kind, the hash
    of the base spans, and all spans as ``kind:start:end`` joined by commas."""
    ship(docs.sparkSession)
    path = ranks or vocabulary()
    n_keep = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path).encode_ordinary
        for batch in chunks(batches, "_text"):
            counts: dict[str, list[int]] = {k: [] for k in KINDS}
            digests, joined = [], []
            for text in batch.column(n_keep).to_pylist():
                base = base_spans(text) if text else []
                extra = random_spans(text, encode, most_chars_per_token) if text else []
                taken = [(a, b) for a, b, _ in base]
                extra = [s for s in extra if not any(a <= s[0] and s[1] <= b for a, b in taken)]
                for k in KINDS:
                    counts[k].append(sum(s[2] == k for s in base) if k != "random" else len(extra))
                digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                joined.append(_joined(sorted(base + extra, key=lambda s: (s[0], KINDS.index(s[2])))))
            arrays = [batch.column(i) for i in range(n_keep)]
            arrays += [pa.array(counts[k], pa.int64()) for k in KINDS] + [pa.array(digests, pa.string()), pa.array(joined, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"])

    # Kept columns travel under names of their own, so that they can't clash.
    names = [f"_k{i}" for i in range(n_keep)]
    source = docs.select(*(F.col(c).alias(n) for c, n in zip(keep, names, strict=True)), F.col(text_col).alias("_text"))
    kinds = dict(source.dtypes)
    out = source.mapInArrow(run, ", ".join([*(f"{n} {kinds[n]}" for n in names), _SCHEMA]))
    return out.toDF(*keep, *out.columns[n_keep:])


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def redact(docs: DataFrame, *, text_col: str = "text", mark: str = "[SECRET]", ranks: str | None = None, most_chars_per_token: float = 2.2) -> DataFrame:
    """Documents with every span replaced by ``mark``; columns as in ``docs``."""
    ship(docs.sparkSession)
    path = ranks or vocabulary()
    cols = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path).encode_ordinary
        k = cols.index(text_col)
        for batch in chunks(batches, text_col):
            texts = batch.column(k).to_pylist()
            for i, text in enumerate(texts):
                if text:
                    spans = sorted(base_spans(text) + random_spans(text, encode, most_chars_per_token))
                    parts, at = [], 0
                    for a, b, _ in spans:
                        if a >= at:
                            parts += [text[at:a], mark]
                        at = max(at, b)
                    if parts:
                        texts[i] = "".join(parts) + text[at:]
            arrays = [batch.column(i) for i in range(len(cols))]
            arrays[k] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names=cols)

    return docs.mapInArrow(run, docs.schema)
