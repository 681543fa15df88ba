"""What a Python worker remembers goes when it turns to tasks of another kind."""

from __future__ import annotations

import pyarrow as pa


def test_pieces_are_forgotten_when_another_stage_runs():
    import public_tokenizers

    from commitloom.llm import bpe as B
    from commitloom.llm import tables as T

    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["one more text"]})
    path = public_tokenizers.path("word_bpe_49k.json")

    def step(batch):
        return pa.RecordBatch.from_pydict({"n": [B._coding(path).encode(batch.column("text")[0].as_py())[2]]})

    first = [b.to_pydict() for b in T.per_batch(step, B.KIND)(iter([batch]))]
    assert B.coder(path).pieces.young
    list(T.per_batch(step, B.KIND)(iter([])))  # the next task of its kind finds it
    assert B.coder(path).pieces.young
    list(T.per_batch(lambda b: b)(iter([batch])))
    assert not B.coder(path).pieces.young and not B.coder(path).words.young
    assert [b.to_pydict() for b in T.per_batch(step, B.KIND)(iter([batch]))] == first
