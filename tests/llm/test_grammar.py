"""The grammar of token blocks: no frequent pair is left, however large the block and long the passage."""

import io
from collections import Counter

import numpy as np
import pytest

from webloom.llm import repair


def most_frequent(block):
    """Places of the commonest pair that do not overlap and lie within a document, by brute force."""
    symbols, count, before = block.symbols.tolist(), Counter(), {}
    ends = {int(f) - 1 for f in block.first[1:]}
    for i in range(len(symbols) - 1):
        pair = (symbols[i], symbols[i + 1])
        if i not in ends and before.get(pair) != i - 1:
            count[pair] += 1
            before[pair] = i
    return max(count.values(), default=0)


def documents(kind):
    rng = np.random.default_rng(3)
    if kind == "skewed":  # more symbols and more frequent pairs than rounds of 2,048 pairs cover
        return [np.minimum(rng.geometric(0.004, 1000), 4000) for _ in range(300)]
    if kind == "copies":
        one = rng.integers(0, 4000, 5000)
        return [one] * 30
    if kind == "ascending":
        return [np.arange(3000)] * 30
    if kind == "runs":
        return [np.full(n, 7) for n in range(1, 600)]
    # a pair in the middle of one stretch of a large block only
    return [rng.permutation(4000) for _ in range(18)] + [np.tile([1, 2, 3], 10)] + [rng.permutation(4000) for _ in range(18)]


@pytest.mark.parametrize("kind", ["skewed", "copies", "ascending", "runs", "unseen"])
def test_no_frequent_pair_is_left(kind):
    docs = [d.astype(np.uint32) for d in documents(kind)]
    counts = np.array([len(d) for d in docs])
    ids = np.concatenate(docs)
    data = repair.encode_block(list(range(len(docs))), counts, ids, base=4001)
    block = repair.Block(io.BytesIO(data))
    assert np.array_equal(block.all_ids(), ids)
    assert most_frequent(block) < 6
    assert np.array_equal(block.document(7, 2, 40), docs[7][2:42])
    assert len(block.flat) < 40 * len(ids)
    if kind == "copies":  # each copy is a few symbols, and the grammar costs less than three copies
        assert len(block.symbols) <= 3 * len(docs) and len(data) < 3 * 4 * 5000


def test_packed_numbers():
    for bits in (1, 7, 8, 17, 32):
        values = np.random.default_rng(bits).integers(0, 2**bits, 101)
        assert np.array_equal(repair.unpack(repair.pack(values, bits), 101, bits), values)
    assert repair.pack(np.zeros(0, np.uint32), 0) == b"" and len(repair.unpack(b"", 0, 0)) == 0


def test_nothing_is_collected_while_texts_are_encoded():
    import gc

    from webloom.llm.tokens import PieceEncoder

    coder, states = PieceEncoder("byte_bpe_50k.json"), []
    merge = coder.merge
    coder.merge = lambda word: states.append(gc.isenabled()) or merge(word)
    texts = ["plain words", "mots é́crits, ñandú", "a\nb c!"]
    ids, ends = coder.encode(texts)
    assert states and not any(states) and gc.isenabled()
    for text, begin, end in zip(texts, [0, *ends], ends):
        assert ids[begin:end].tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids
