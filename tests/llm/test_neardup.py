"""Near-duplicates against all pairs, with short and long lists."""

import random
import re

import pytest

from lithos.llm import neardup as N
from tests.llm.conftest import words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t):
    w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs):
    sets = [(d, shingles(t)) for d, t in docs if d is not None]
    top = {d: d for d, _ in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, o in sets[i + 1 :]:
            if s and 100 * len(s & o) >= 75 * len(s | o):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    out = [(d, len(s), find(d), d == find(d)) for d, s in sets]
    return sorted(out + [(None, len(shingles(t)), None, True) for d, t in docs if d is None], key=str)


def got(df, **kw):
    return sorted(map(tuple, N.groups(df, **kw).collect()), key=str)


def test_awkward(awkward, awkward_rows, nothing):
    assert got(awkward) == brute([r[:2] for r in awkward_rows])
    assert N.groups(nothing).count() == 0
    kept = N.keep_one(awkward)
    assert kept.columns == awkward.columns and set(r.doc_id for r in kept.collect()) == {d for d, _, _, k in brute([r[:2] for r in awkward_rows]) if k}


@pytest.mark.parametrize("seed", [1, 2])
def test_large_groups_and_shared_passages(spark, seed):
    rng = random.Random(seed)
    passage, original = words(rng, 40), words(rng, 80).split()
    texts = []
    for _ in range(120):  # near copies, near and far
        w = list(original)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 6])):
            w[rng.randrange(len(w))] = words(rng, 1)
        texts.append(" ".join(w[: rng.choice([80, 80, 78, 66, 60, 50])]))
    texts += [passage + " " + words(rng, rng.choice([2, 4, 8, 15, 40])) for _ in range(80)]
    texts += [words(rng, 30) for _ in range(40)] + texts[:20]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert got(df, list_rows=8) == brute(rows)


def test_hot_groups_with_many_pivots(spark):
    """Large groups of near copies under the production lists: linked copies whose
    closest pivots differ."""
    texts, want = [], []
    for seed in range(6):
        rng = random.Random(seed)
        original = words(rng, 120).split()
        group = []
        for _ in range(400):
            w = list(original)
            for _ in range(rng.randint(2 + seed % 2, 4 + seed % 2)):
                w[rng.randrange(len(w))] = words(rng, 1)
            group.append((len(texts) + len(group), " ".join(w)))
        want += brute(group)
        texts += group
    assert got(spark.createDataFrame(texts, "doc_id bigint, text string")) == sorted(want, key=str)


def test_half_hot_sketch(spark):
    """A copy of a hot group with a sketch of which less than half is hot."""
    rng = random.Random(3)
    common = words(rng, 300).split()
    rows = []
    for i in range(40):
        w = list(common)
        w[7 * i] = words(rng, 1)
        rows.append((i, " ".join(w)))
    w = list(common)
    for _ in range(76):  # a tail of smaller hashes than chance would give
        w.append(min((words(rng, 1) for _ in range(5)), key=lambda x: N.shingle_sets([" ".join([*w[-4:], x]).encode()])[0][0]))
    rows.append((40, " ".join(w)))
    own, base = N.shingle_sets([" ".join(t).encode() for t in (w, common)])
    assert 16 < len(set(own[: N.SKETCH]) & set(base)) <= N.SKETCH // 2
    assert got(spark.createDataFrame(rows, "doc_id bigint, text string")) == brute(rows)


def test_two_boilerplates(spark):
    """A and B are alike, but the pages that each is closest to are not."""
    rng = random.Random(8)
    x, y, s, t = words(rng, 45), words(rng, 45), [words(rng, 22) for _ in range(60)], [words(rng, 22) for _ in range(60)]
    s, t = [s[0]] * 60, [t[0]] * 60
    rows = [(i, f"{x} {s[i]} u{i}x {words(rng, 3)}") for i in range(60)] + [(60 + i, f"{y} {t[i]} v{i}x {words(rng, 3)}") for i in range(60)]
    rows += [(200, f"{x} {s[0]} a {y}"), (201, f"{x} b {y} {t[0]}")]
    want = brute(rows)
    assert got(spark.createDataFrame(rows, "doc_id bigint, text string")) == want


@pytest.mark.parametrize("seed", range(4))
def test_shared_paragraphs(spark, seed):
    """Documents of two to four of a few paragraphs, of several lengths, in any
    order, with some words of their own: long lists of every kind."""
    rng = random.Random(100 + seed)
    paragraphs = [words(rng, rng.choice([20, 40, 80, 200])) for _ in range(5)]
    rows = []
    for i in range(500):
        w = " ".join(rng.sample(paragraphs, rng.randint(2, 4))).split()
        for _ in range(rng.choice([0, 1, 2, 4, 8])):
            w[rng.randrange(len(w))] = words(rng, 1)
        rows.append((i, " ".join([*w, *words(rng, rng.choice([1, 3, 10, 30])).split()])))
    rng.shuffle(rows)
    assert got(spark.createDataFrame(rows, "doc_id bigint, text string"), list_rows=8 if seed % 2 else N.LIST_ROWS, rounds=1 + seed % 3) == brute(rows)


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(40, 50), (41, 50), (60, 60), (42, 41)]
    found = dict(map(tuple, N.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    assert all(found[i] == 0 for i in range(31)) and {found[i] for i in (40, 41, 42, 50)} == {40} and 60 not in found
