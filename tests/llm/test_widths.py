"""Shingles of slices that hold fewer words than a shingle."""

import numpy as np
import pytest

from leafvoice.llm import minhash


@pytest.mark.parametrize("n", range(8))
def test_small_slices_at_default_width(n):
    """A slice's rows have the shingles they have in a larger slice."""
    text = " ".join(f"w{i}" for i in range(n)).encode()
    rest = b"a b c d e f g h i j"
    own, at = minhash.shingles(np.frombuffer(text, np.uint8), np.array([0, len(text)]), 5)
    both, first = minhash.shingles(np.frombuffer(text + rest, np.uint8), np.array([0, len(text), len(text + rest)]), 5)
    assert own.tolist() == both[: first[1]].tolist() and at[1] == first[1] == (max(1, n - 4) if n else 0)
