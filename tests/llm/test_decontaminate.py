"""Decontamination against brute force, in one block and in many."""

import hashlib
import re

import pytest

from lithos.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(t):
    return WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, width=10):
    windows = []
    for item, t in items:
        w = split(t)
        windows += [(item, tuple(w[i : i + width])) for i in range(max(1, len(w) - width + 1))] if w else []
    out = []
    for d, t in docs:
        w, hit, found = split(t), set(), set()
        for item, x in windows:
            for i in range(len(w) - len(x) + 1):
                if tuple(w[i : i + len(x)]) == x:
                    hit |= set(range(i, i + len(x)))
                    found.add(item)
        ids = sorted(str(i) for i in found if i is not None)
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.fixture
def items(spark, awkward_rows):
    base = awkward_rows[6][1].split()
    rows = [(1, " ".join(base[5:25])), (2, " ".join(base[20:32])), (10, "TWO"), (3, None), (4, "..."), (None, " ".join(base[40:52])), (5, "c d e f"), (1, "one two")]
    return rows, spark.createDataFrame(rows, "item_id bigint, text string")


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_brute_force(awkward, awkward_rows, items, block_bytes):
    rows, frame = items
    got = sorted(map(tuple, D.report(awkward, frame, block_bytes=block_bytes).collect()), key=str)
    assert got == brute([r[:2] for r in awkward_rows], rows)


def test_removal(awkward, items, nothing, spark):
    rows, frame = items
    kept = D.clean(awkward, frame)
    assert kept.columns == awkward.columns and kept.count() == D.report(awkward, frame).where("NOT contaminated").count()
    cut = D.clean(awkward, frame, remove="spans")
    assert cut.count() == awkward.count() and cut.where("doc_id = 3").first().text == "" and cut.where("doc_id = 0").first().text is None
    with pytest.raises(ValueError):
        D.clean(awkward, frame, remove="x")
    assert D.report(nothing, frame).count() == 0
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert D.report(awkward, none).where("contaminated").count() == 0


def test_string_item_ids_and_repeated_windows(spark):
    text = " ".join(f"w{i}" for i in range(14))
    bench = spark.createDataFrame([("b", text), ("a", "x " + text), ("a", text), (None, text), ("none", "other words")], "item_id string, text string")
    docs = spark.createDataFrame([(1, f"say {text} end"), (2, "nothing")], "doc_id bigint, text string")
    for block in (10, 1 << 20):
        got = {r.doc_id: r for r in D.contamination(docs, bench, block_bytes=block).collect()}
        assert got[1].items == ["a", "b"] and got[1].n_hit == 14 and got[2].items == []


def test_windows_take_little_memory():
    import random
    import tracemalloc

    rng = random.Random(1)
    items = [(str(i), " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(2000)).encode()) for i in range(80)]
    size = sum(len(t) for _, t in items)
    tracemalloc.start()
    kept = D.WindowSet(items, 10)
    used = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert kept.tables[10][0].size == 80 * 1991 and used < 8 * size + (2 << 20)
