"""What Python workers take, and what they are sent."""

import random
import tracemalloc

import pyarrow as pa

from lithos.llm import _common, langid
from tests.llm.conftest import words


def test_language_blocks_are_small():
    rng = random.Random(1)
    texts = [words(rng, 600) for _ in range(500)]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    langid.document_vectors(["a"])
    tracemalloc.start()
    for block in langid._blocks(iter([batch]), "text"):
        langid.document_vectors(block.column(0).to_pylist())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 45e6


def test_freed_memory_goes_back_after_each_batch(monkeypatch):
    given = []
    monkeypatch.setattr(_common, "give_back", lambda: given.append(1), raising=False)
    batches = [pa.RecordBatch.from_pydict({"text": ["a b", None]})] * 3
    assert sum(b.num_rows for b in _common.chunks(iter(batches), "text")) == 6 and len(given) == 3


def test_a_kept_text_is_sent_once(awkward):
    kept = langid.identify(awkward, keep=("doc_id", "text"))
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("text#") and "_text" not in plan and kept.columns == ["doc_id", "text", "lang_pred", "score"]
    other = langid.identify(awkward)
    assert sorted(map(str, kept.select("doc_id", "lang_pred", "score").collect())) == sorted(map(str, other.collect()))
