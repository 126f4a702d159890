"""Words are hashed from their bytes by tables, without a lower-case copy."""

import numpy as np
import pyarrow as pa

from loreframe.llm import shared


def test_words_from_bytes():
    texts = ["The  Lamp-\tburns", "", "thé LAMP- the", " \n"]
    words = shared.Words(*shared.utf8(pa.array(texts)))
    assert not hasattr(words, "_core") and np.array_equal(shared._LOW_VALUES, shared._VALUES[shared._LOWER])
    assert words.bounds.tolist() == [0, 3, 3, 6, 6]
    assert words.hashes[0] == words.hashes[5] and words.hashes[1] == words.hashes[4] and len(set(words.hashes.tolist())) == 4
    assert [(a, b - a) for a, b in zip(*words.cores()[1:], strict=True)] == [(0, 3), (5, 4), (11, 5), (16, 4), (21, 4), (27, 3)]
