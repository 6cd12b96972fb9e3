import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from isoptic.llm import tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXT = st.lists(st.one_of(st.none(), st.text(alphabet="ab É\n\t\x0b xyz ", max_size=60)), max_size=6)


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_words_and_grams(texts):
    w = tokens.words(pa.array(texts, pa.string()))
    want = [WORD.findall(t or "") for t in texts]
    got = [[bytes(w.data[w.start[i] : w.end[i]]).decode() for i in range(w.first[d], w.first[d + 1])] for d in range(len(texts))]
    assert got == want
    flat = [x for ws in want for x in ws]
    assert len(set(flat)) == len(set(w.hash.tolist()))
    for k in (1, 2, 5):
        h, at = tokens.grams(w, k)
        want_g = [tuple(ws[i : i + k]) for ws in want for i in range(len(ws) - k + 1)]
        assert len(h) == len(want_g)
        assert len(set(h.tolist())) == len(set(want_g))
        assert dict(zip(h.tolist(), want_g)) == {a: b for a, b in zip(h.tolist(), want_g)}


def test_long_words_and_slices():
    texts = ["a" * 100_000 + " b", None, "", "É" * 9, "a" * 99_999 + "c b"]
    w = tokens.words(pa.array(texts).slice(1))
    assert np.diff(w.first).tolist() == [0, 0, 1, 2]
    batch = pa.record_batch({"t": pa.array(texts)})
    parts = list(tokens.pieces(iter([batch]), "t", 1000))
    assert sum(p.num_rows for p in parts) == 5 and pa.Table.from_batches(parts).column("t").to_pylist() == texts
