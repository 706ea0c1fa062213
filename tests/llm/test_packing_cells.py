"""Grid cells of many documents counted at once, against one document at a time."""

import numpy as np

from quantarium.llm import packing
from quantarium.llm.tokens import PieceEncoder, vocabulary_path


def test_cells_of_many_documents():
    rng, towards = np.random.default_rng(3), packing.directions()
    many = [rng.integers(0, k, n).astype("<u2") for k, n in ((65536, 900), (3, 50), (1, 1), (65536, 0), (400, 700), (2, 0))]
    for ids, got in zip(many, packing.cells(many, towards)):
        kinds, n = np.unique(ids, return_counts=True)
        z = np.sqrt(n) @ towards[kinds].astype(float) / np.sqrt(max(1, n.sum()))
        u = 0.5 * (1 + np.tanh(0.7978845608 * (z + 0.044715 * z**3)))
        want = u * (1 << packing.BITS) if len(ids) else np.zeros(packing.DIMS)
        assert (np.abs(got + 0.5 - want) <= 0.5 + 1e-6).all()
    assert packing.cells([], towards).shape == packing.cells(many[3:4], towards)[:0].shape


def test_marks_behind_letters_are_encoded_as_the_library_does():
    encoder = PieceEncoder(vocabulary_path())
    assert encoder.cache.marked
    words = ["ab", "Éa", "x½", "½", "don't", "a_", "a_.", "one\\", "two]^`{|}~", "日本.", "a.b", "<|endoftext|>", "a<|endoftext|>", "c's.", "d1,", "!?", "endoftext", "e!\nF?"]
    texts = [" ".join([w, *words[k:], w + "!", w]) for k, w in enumerate(words)]
    want = [np.array(e.ids, "<u2").tobytes() for e in encoder.library.encode_batch_fast(texts, add_special_tokens=False)]
    assert encoder.encode(texts) == want and encoder.encode(texts) == want
