import re

import numpy as np
import pyarrow as pa
import pytest
from cases import hard_rows

from tallyframe.llm import words as W

TEXTS = [r[1] for r in hard_rows()]


@pytest.mark.parametrize("size", [1, 50, 1 << 20])
@pytest.mark.parametrize("table,pattern", [(W.BLANK, rb"[^\x20\x09-\x0D]+"), (W.NOT_ALNUM, rb"[0-9A-Za-z\x80-\xff]+")])
def test_split_is_the_pattern(size, table, pattern):
    got = []
    for piece in W.pieces(pa.array(TEXTS).slice(2), size):
        found = W.split(piece, table)
        got += [(piece.first + t, piece.data[a:b].tobytes()) for t, a, b in zip(found.text, found.start, found.end)]
    want = [(i, w) for i, t in enumerate(TEXTS[2:]) for w in re.findall(pattern, (t or "").encode())]
    assert got == want


def test_hashes_and_windows_agree_with_equality():
    piece = next(W.pieces(pa.array(TEXTS)))
    found = W.split(piece)
    words = [piece.data[a:b].tobytes() for a, b in zip(found.start, found.end)]
    h = W.hashes(piece.data, found)
    assert len(set(zip(words, h.tolist()))) == len(set(words)) == len(set(h.tolist()))
    folded = W.hashes(piece.data, found, W.LOWER)
    lower = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    assert len(set(zip(lower, folded.tolist()))) == len(set(lower)) == len(set(folded.tolist()))
    firsts = found.firsts(piece.texts)
    for width in (1, 3, 20):
        value, whole = W.windows(h, firsts, width)
        real = [tuple(words[i : i + width]) for i in range(len(words))]
        inside = [i + width <= firsts[found.text[i] + 1] for i in range(len(words))]
        assert whole.tolist() == inside
        pairs = {(real[i], int(value[i])) for i in np.flatnonzero(whole)}
        assert len(pairs) == len({p[0] for p in pairs}) == len({p[1] for p in pairs})


def test_no_texts():
    assert list(W.pieces(pa.array([], pa.string()))) == []
    piece = next(W.pieces(pa.array([None, ""])))
    assert len(W.split(piece).text) == 0
