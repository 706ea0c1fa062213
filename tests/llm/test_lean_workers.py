"""Workers that stay for the next stage hold no encoder."""

import inspect

import pyarrow as pa

import corpus_pipeline
from quantarium.llm import packing, tokens


def test_packing_drops_its_encoder_with_the_task():
    path = tokens.vocabulary_path()
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["Of thstlyhe the. One", ""])], ["doc_id", "text"])
    kept = list(packing._key_batches([batch], path, 0, 1000))
    assert path in tokens._HELD
    again = list(packing._key_batches([batch], path, 0, 1000, keep=False))
    assert path not in tokens._HELD and kept == again
    steps = packing._key_batches([batch, batch], path, 0, 1000, keep=False)
    next(steps)
    steps.close()  # a task that ends before its rows do
    assert path not in tokens._HELD
    assert "keep=False" in inspect.getsource(corpus_pipeline.pack_sequences)
