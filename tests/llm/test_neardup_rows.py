"""How many rows near-duplicates make of members of stars."""

import random

import pytest

from lithos.llm import neardup as N
from tests.llm.conftest import words
from tests.llm.test_neardup import brute, got


def test_a_member_of_several_stars_is_listed_once(spark):
    far = [{"level": 1, "e": 5}, {"level": 2, "e": 6}]
    rows = [(a, b, 400, a, 1, 200, far) for a in (1, 2) for b in (10, 11, 12)]
    star = spark.createDataFrame(rows, "a bigint, b bigint, na bigint, ina bigint, level int, out int, far array<struct<level:int,e:bigint>>")
    hot = spark.createDataFrame([(1, 40), (2, 40)], "rep bigint, h bigint")
    assert sorted((r.rep, r.v) for r in N._far_lists(star, hot).collect()) == [(1, 5), (1, 6), (2, 5), (2, 6)]


@pytest.mark.parametrize("own", [75, 300])
def test_documents_alone_but_for_a_common_passage(spark, monkeypatch, own):
    """They are in a long list, but all else that they hold is in short ones."""
    rng = random.Random(own)
    passage, seen = words(rng, own * 2 // 3), []
    rows = [(i, f"{passage} {words(rng, own)}") for i in range(80)]
    rows += [(100 + i, f"{t} more") for i, t in rows[:5]]
    for name in ("_near_links", "_far_lists"):
        monkeypatch.setattr(N, name, lambda star, *a, f=getattr(N, name): seen.append(star.count()) or f(star, *a))
    assert got(spark.createDataFrame(rows, "doc_id bigint, text string")) == brute(rows)
    assert sum(seen) <= 8


@pytest.mark.parametrize("seed", [1, 2])
def test_linked_by_what_is_outside_several_pivots(spark, seed):
    """Pairs that share two common passages and much of their own, in groups too
    large for short lists."""
    rng = random.Random(seed)
    rows = []
    for _ in range(5):
        x, y, z = words(rng, 100), words(rng, 100), words(rng, 160)
        for _ in range(45):
            w = f"{x} {z} {y}".split()
            for _ in range(rng.choice([2, 5, 9, 12])):
                w[rng.randrange(len(w))] = words(rng, 1)
            rows.append((len(rows), " ".join(w)))
        rows += [(len(rows) + i, f"{x} {words(rng, 150)} {y}") for i in range(45)]
    assert got(spark.createDataFrame(rows, "doc_id bigint, text string")) == brute(rows)
