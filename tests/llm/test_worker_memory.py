"""What a Python worker holds from task to task, or grows while it runs, has a bound."""

import inspect

import numpy as np

from rulewright.llm.langid import _Vectors, trigram_vectors
from rulewright.llm.packing import WordIds


def test_word_table_is_bounded():
    assert inspect.signature(WordIds).parameters["bound"].default <= 400_000


def test_vector_rows_are_not_copied_to_grow():
    vectors = _Vectors(16, bound=3000)
    rows = vectors.rows
    for start in (0, 1500, 2500):  # the last ones don't fit any more: the table begins anew
        codes = np.arange(start, start + 1500)
        counts = np.arange(1, 1501)
        assert np.allclose(vectors.bundle(codes, counts), counts @ trigram_vectors(codes, 16).astype(np.float32), rtol=1e-4)
        assert vectors.rows is rows
