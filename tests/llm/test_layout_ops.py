"""Fingerprints, resharding, packing, the pipeline."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lithos.llm import fingerprint, packing, reshard
from tests.conftest import DATA


def sketch(t):
    w = [x for x in __import__("re").split(r"[ \t\n\x0b\f\r]+", t.lower()) if x]
    h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in w]

    def chain(xs):
        seed = 42
        for x in xs:
            seed = xxhash.xxh64(x.to_bytes(8, "little"), seed=seed).intdigest()
        return seed - (1 << 64) if seed >> 63 else seed

    s = [chain(h[i : i + 5]) for i in range(len(h) - 4)] if len(h) >= 5 else [chain(h)] if h else []
    return sorted({x for x in s if x < -(1 << 63) + (1 << 61)} | ({min(s)} if s else set()))


def like(a, b):
    if a == b:
        return 1.0
    a, b = ({x for x in s if x < -(1 << 63) + (1 << 61)} for s in (a, b))
    n = min(len(a), len(b))
    return len(a & b) / n if n else 0.0


def brute_fingerprints(docs):
    docs = sorted(docs, key=lambda d: -d[0])
    for i, (d, t) in enumerate(docs):
        t, nxt = t or "", docs[(i + 1) % len(docs)][1] or ""
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        a, e, b = sketch(t), sketch(edited), sketch(nxt)
        text = lambda s: "".join(f"{x & (2**64 - 1):016X}" for x in s)
        yield (d, len(t), hashlib.sha256(edited.encode()).hexdigest(), text(a), text(e), round(like(a, e), 9), round(like(a, b), 9))


@pytest.mark.parametrize("n", [1, 2, 15])
def test_fingerprints_brute_force(spark, awkward_rows, n):
    rows = [r[:2] for r in awkward_rows[:n]]
    got = fingerprint.report(spark.createDataFrame(rows, "doc_id bigint, text string"))
    rounded = got.withColumns({c: F.round(c, 9) for c in ("near_edited", "near_next")})
    assert sorted(map(tuple, rounded.collect())) == sorted(brute_fingerprints(rows))


def test_fingerprint_edges_and_data(spark, awkward, nothing):
    assert fingerprint.report(awkward).count() == awkward.count() and fingerprint.report(nothing).count() == 0
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    got = {r[0]: tuple(r)[:5] for r in fingerprint.report(docs).collect()}
    want = {r[0]: r[:5] for r in brute_fingerprints([(r.doc_id, r.text) for r in docs.collect()])}
    assert got == want


def test_containment_of_unequal_texts(spark):
    """Short texts, each wholly inside the long one that comes next."""
    rng = random.Random(4)
    words = lambda n: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))
    rows, n = [], 40
    for k in range(n):
        short = words(60)
        rows += [(2 * k + 1, short), (2 * k, f"{words(500)} {short} {words(500)}")]
    got = {r.doc_id: r for r in fingerprint.report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    near = [got[2 * k + 1].near_next for k in range(n)]
    assert all(x in (0.0, 1.0) for x in near) and sum(near) >= n - 1  # none unless a text has no kept hash
    assert all(got[2 * k].near_next < 0.3 for k in range(n))


def brute_moved(blocks, shards):
    """Least moved bytes: every shard keeps as many of its dearest rows as fit."""
    total = sum(n for _, n, _ in blocks)
    best = None
    for extra in _choices(shards, total % shards):
        moved = 0.0
        for j in range(shards):
            room = total // shards + (j in extra)
            for _, n, s in sorted((b for b in blocks if b[0] == j), key=lambda b: -(b[2] // max(b[1], 1))):
                keep = min(n, room)
                room -= keep
                moved += (n - keep) * max(1, s // max(n, 1))
        moved += sum(n * max(1, s // max(n, 1)) for o, n, s in blocks if o >= shards)
        best = moved if best is None else min(best, moved)
    return best


def _choices(n, k):
    from itertools import combinations

    return combinations(range(n), k)


@pytest.mark.parametrize("seed", range(8))
def test_flow_moves_least(seed):
    rng = random.Random(seed)
    blocks = [(rng.randrange(5), rng.randrange(1, 9), rng.randrange(1, 500)) for _ in range(7)]
    got = reshard.transfers(blocks, 4)
    by = Counter()
    for k, j, n in got:
        by[j] += n
    total = sum(n for _, n, _ in blocks)
    assert sum(by.values()) == total and max(by[j] for j in range(4)) - min(by[j] for j in range(4)) <= 1
    cost = sum(n * max(1, blocks[k][2] // blocks[k][1]) for k, j, n in got if blocks[k][0] != j)
    assert cost == brute_moved(blocks, 4)


def test_reshard_law_slots_and_rewrite(spark, awkward, nothing, tmp_path):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").union(spark.createDataFrame([(None, None, None, None, None)] * 5, "doc_id bigint, text string, lang string, source string, n_chars bigint"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = reshard.report(docs).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        t = (texts[r.doc_id] or "").encode()
        assert r.size == len(t) + 8 and r.text_crc32 == zlib.crc32(t) and r.law == "rows" and r.grown_shard is None
    sizes = [len(slots[j]) for j in range(24)]
    assert sum(sizes) == 1005 and max(sizes) - min(sizes) <= 1 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert reshard.report(awkward).count() == awkward.count() and reshard.report(nothing).count() == 0
    placed = reshard.place(docs, F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(3)), shards=4)
    assert reshard.affected(placed).count() == 4


def _files(path):
    return {p.name: p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def _rows(df):
    return sorted((str(r) for r in df.drop("shard").collect()))


def test_rewrite_in_place(spark, tmp_path):
    """Repeated and null ids, clashing columns; shards 0 and 1 are as they were."""
    path = tmp_path / "layout"
    rng = random.Random(2)
    rows = [(None if i % 7 == 0 else i // 3, "x" * rng.randrange(40) if i % 11 else None, i % 2, rng.randrange(9)) for i in range(100)]
    sizes = [25, 25, 45, 5]
    parts = [rows[sum(sizes[:k]) : sum(sizes[: k + 1])] for k in range(4)]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, "doc_id bigint, text string, _size int, rank int").coalesce(1).write.parquet(str(path / f"shard={k}"))
    layout = spark.read.parquet(str(path))
    before, want = _files(path), _rows(layout)
    old = {k: _files(path / f"shard={k}") for k in range(4)}
    assert reshard.rewrite(layout, F.col("shard"), str(path), shards=4) == [2, 3]
    back = spark.read.parquet(str(path))
    assert _rows(back) == want and sorted(r[1] for r in back.groupBy("shard").count().collect()) == [25] * 4
    assert [_files(path / f"shard={k}") == old[k] for k in range(4)] == [True, True, False, False] and len(before) == 4
    assert not [p for p in path.iterdir() if not p.name.startswith("shard=") and not p.name.startswith(".")]
    # Fewer shards: the folder of a shard that goes is deleted; nothing to do: nothing is touched.
    assert reshard.rewrite(spark.read.parquet(str(path)), F.col("shard"), str(path), shards=3) == [0, 1, 2, 3]
    back = spark.read.parquet(str(path))
    assert _rows(back) == want and sorted(p.name for p in path.glob("shard=*")) == ["shard=0", "shard=1", "shard=2"]
    assert reshard.rewrite(back, F.col("shard"), str(path), shards=3) == []


def test_interrupted_rewrite_is_completed(spark, tmp_path, monkeypatch):
    from lithos.sources import storage

    path = tmp_path / "layout"
    rows = [(i, "x" * i, 0 if i < 30 else 1) for i in range(40)]
    spark.createDataFrame(rows, "doc_id bigint, text string, shard int").write.partitionBy("shard").parquet(str(path))
    move, calls = storage.move, []

    def dies(spark, source, target):
        calls.append(target)
        if len(calls) == 4:
            raise KeyboardInterrupt
        move(spark, source, target)

    monkeypatch.setattr(storage, "move", dies)
    with pytest.raises(KeyboardInterrupt):
        reshard.rewrite(spark.read.parquet(str(path)), F.col("shard"), str(path), shards=2)
    monkeypatch.setattr(storage, "move", move)
    reshard.complete(spark, str(path))
    back = spark.read.parquet(str(path))
    assert sorted(r.doc_id for r in back.collect()) == list(range(40)) and {r[1] for r in back.groupBy("shard").count().collect()} == {20}


def test_least_bytes_move_within_a_class(spark):
    docs = spark.createDataFrame([(i, "x" * (120 + i)) for i in range(100)], "doc_id bigint, text string")
    placed = reshard.place(docs, F.lit(0), shards=2).collect()
    # Sizes 128 to 227 are one class, in steps of two bytes.
    assert {r.size for r in placed if r.shard == 1} == set(range(128, 178))


def test_ids_are_those_of_the_tokenizer(awkward_rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    odd = ["it's  two\n\n spaces\t", "<|endoftext|> x", "数字 ①② ½ अनुच्छेद", "　wide nbsp\r\n", "don't 'quote' 123abc", "👩‍👩‍👧 ok", "\x00\x1f control"]
    runs = [" " * 70_000, "a" + "\n" * 70_000 + "b", " " * 70_000 + "b", "x\x1f" + "\u3000 " * 40_000 + "\x1f y" + "\t" * 70_000, "<|endoftext|>" + " " * 70_000 + "<|endoftext|>", " " * 65_536 + " c", "a" * 100_000]
    for text in [r[1] for r in awkward_rows if r[1]] + odd + runs:
        assert packing.encoder()(text) == t.encode(text, add_special_tokens=False).ids


def test_a_million_blanks_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, " " * 1_000_000), (2, "\n" * 1_000_000)], "length bigint, text string")
    rows = packing.pack(docs, id_col="length").collect()
    assert {r[0]: r[4] for r in rows} == {1: 1_000_001, 2: 500_001}
    assert packing.pack(docs.toDF("text", "length"), id_col="text", text_col="length").count() == len(rows)


def test_added_tokens_have_the_ids_of_the_tokenizer_file(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["hello <|endoftext|> x", "<|endoftext|>", "a<|endoftext|><|endoftext|>  b", "<|endoftext| >"]
    ids = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert list(map(packing.encoder(), texts)) == ids
    got = packing.pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).orderBy("doc_id").collect()
    assert [(r.doc_tokens, r.ids_crc32) for r in got] == [(len(x) + 1, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in [*x, 0]))) for x in ids]


@pytest.mark.parametrize("seed", range(4))
def test_solver_covers_demand_tightly(seed):
    rng = random.Random(seed)
    demand = Counter(rng.choices(range(1, 64), weights=[1 / (k + seed) for k in range(1, 64)], k=rng.choice([5, 300, 5000])))
    patterns = packing.solve(demand, 64)
    used = Counter()
    for n, p in patterns:
        assert n > 0 and sum(k * a for k, a in p.items()) <= 64
        for k, a in p.items():
            used[k] += n * a
    assert used == demand
    bound = -(-sum(k * n for k, n in demand.items()) // 64)
    big = sum(n for k, n in demand.items() if k > 32)
    assert sum(n for n, _ in patterns) <= 1.05 * max(bound, big) + 2


def test_columns_are_priced(monkeypatch):
    """A histogram on which the greedy start is not optimal: pricing brings the
    program to its bound."""
    calls, price = [], packing._price

    def counted(*a):
        calls.append(1)
        return price(*a)

    monkeypatch.setattr(packing, "_price", counted)
    fits = ((48, 31, 21), (47, 29, 24), (43, 36, 21), (41, 33, 26), (39, 37, 24), (45, 28, 27))
    demand = Counter()
    for k in (k for f in fits for k in f):
        demand[k] += 700
    patterns = packing.solve(demand, 100)
    assert calls and 4200 <= sum(n for n, _ in patterns) <= 4206 < sum(n for n, _ in packing._greedy(dict(demand), 100))


@pytest.mark.parametrize("which", ["awkward", "data"])
def test_packing_brute_force(spark, awkward, which):
    docs = awkward if which == "awkward" else spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    encode = packing.encoder()
    want = Counter()
    for r in docs.collect():
        want[(r.doc_id, tuple([*encode(r.text or ""), 0]))] += 1
    by_id = defaultdict(list)
    for (d, ids), n in want.items():
        by_id[d] += [ids] * n
    rows = packing.pack(docs).collect()
    sequences = defaultdict(list)
    seen = Counter()
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        options = [ids for ids in by_id[r.doc_id] if len(ids) == r.doc_tokens and zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32]
        assert options
        seen[(r.doc_id, r.start, r.length)] += 1
    assert sum(n * k[2] for k, n in seen.items()) == sum(len(ids) * n for (_, ids), n in want.items())
    used = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
        used += at
    if which == "data":
        assert used / (1024 * len(sequences)) > 0.97


def test_packing_nothing(nothing):
    assert packing.pack(nothing).count() == 0
