"""What a Python worker holds between and within tasks."""

import pyarrow as pa

from webloom.llm import toxicity
from webloom.llm import tokens as T
from webloom.llm.columns import text_parts


def test_another_stage_drops_vocabularies_and_caches():
    coder = T.encoder("byte_bpe_50k.json")
    ids, ends = coder.encode(["some words here", ""])
    assert coder.rest and T._MODELS and len(ids) == ends[-1] > 0
    list(toxicity._triples(iter([pa.RecordBatch.from_arrays([pa.array(["a b", None]), pa.array([1, 0])], names=["text", "toxic"])])))
    assert not T._MODELS and not T._ENCODERS and not (coder.rest or coder.first or coder.words or coder.rest.older)
    again, _ = T.encoder("byte_bpe_50k.json").encode(["some words here", ""])
    assert again.tolist() == ids.tolist()


def test_a_batch_is_cut_by_sizes_of_its_texts():
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["é" * 4, None, "", "abcdefgh", "a", "bc"])], names=["i", "t"])
    parts = [p.column(0).to_pylist() for p in text_parts(batch, 1, 5)]
    assert parts == [[0, 1, 2, 3], [4, 5]] == [list(range(a, b)) for a, b in T.slices(["é" * 4, "", "", "abcdefgh", "a", "bc"], 5)]
    assert next(text_parts(batch, 1, 5)).column(1).buffers()[2].address == batch.column(1).buffers()[2].address  # no copy
    assert not list(text_parts(batch.slice(0, 0), 1, 5))
