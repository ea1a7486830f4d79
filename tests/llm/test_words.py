import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from wikimill.llm import words as m

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbZz09 \t\n\x0b\x0c\r\x1f.é漢😀", max_size=40)), max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(1, 30))
def test_words_and_hashes(texts, limit):
    seen, m.CHUNK, old = {}, limit, m.CHUNK
    try:
        for lower, table, pattern in ((False, m.NON_SPACE, r"[^\x20\x09-\x0D]+"), (True, m.WORD_LIKE, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
            got, hashes = [], []
            column = pa.array([None, *texts, None], pa.string()).slice(1, len(texts))
            for c in m.word_chunks(column, table, lower):
                h = c.hashes()
                for i in range(c.hi - c.lo):
                    a, b = c.offsets[i], c.offsets[i + 1]
                    got.append([c.text(j) for j in range(a, b)])
                    hashes.append(h[a:b].tolist())
                    assert c.joined(i).decode() == " ".join(got[-1])
                    assert c.joined(i, np.arange(0, b - a, 2)).decode() == " ".join(got[-1][::2])
            low = {i: i + 32 for i in range(65, 91)} if lower else {}
            assert got == [re.findall(pattern, (t or "").translate(low)) for t in texts]
            for ws, hs in zip(got, hashes, strict=True):
                for w, h in zip(ws, hs, strict=True):
                    assert seen.setdefault(w, h) == h
        assert len(set(seen.values())) == len(seen)
    finally:
        m.CHUNK = old


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40), st.integers(1, 12))
def test_windows(values, k):
    h = m.mix(np.array(values, np.uint64))
    got = m.window_hashes(h, k)
    same = {}
    assert len(got) == max(0, len(values) - k + 1)
    for i, x in enumerate(got.tolist()):
        assert same.setdefault(tuple(values[i:i + k]), x) == x
    assert len(set(same.values())) == len(same)
    v = np.array(values)
    for i, at in enumerate(m.sliding_argmin(v, k).tolist()):
        part = values[i:i + k]
        assert at == i + max(j for j, x in enumerate(part) if x == min(part))


def test_window_starts():
    starts, counts = m.window_starts(np.array([0, 3, 3, 8]), 3)
    assert starts.tolist() == [0, 3, 4, 5] and counts.tolist() == [1, 0, 3]
