import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from matchloom.llm.words import lowered_words, rolling, split_words, window_rows


@settings(deadline=None)
@given(st.lists(st.none() | st.text(alphabet="aB \t\n\x0b\x0c\r\x1cé中", max_size=40), max_size=20), st.integers(1, 30))
def test_words_by_definition(texts, limit):
    seen = {}
    for words in split_words(pa.array(texts, pa.string()), limit):
        hashes = words.hashes(lower=True)
        for k, (a, b) in enumerate(zip(words.offsets[:-1], words.offsets[1:], strict=True)):
            want = lowered_words(texts[words.first_row + k])
            assert b - a == len(want)
            for word, h in zip(want, hashes[a:b].tolist(), strict=True):
                assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def test_sliced_columns_and_long_texts():
    column = pa.array(["a b", "c " * 200_000, None, "A B"]).slice(1)
    counts = np.concatenate([w.counts for w in split_words(column)])
    assert counts.tolist() == [200_000, 0, 2]


def test_rolling_depends_on_order_and_content():
    values = np.array([1, 2, 3, 4, 5, 6, 1, 2, 3, 4, 5, 5, 4, 3, 2, 1], np.uint64)
    for width in (1, 3, 5):
        got = rolling(values, width)
        runs = [tuple(values[k : k + width]) for k in range(len(values) - width + 1)]
        assert len(got) == len(runs) and len(set(got.tolist())) == len(set(runs))
        assert len({(r, g) for r, g in zip(runs, got.tolist(), strict=True)}) == len(set(runs))
    assert len(rolling(values[:2], 5)) == 0


def test_windows_stay_within_documents():
    first, docs = window_rows(np.array([0, 3, 3, 5]), 2)
    assert first.tolist() == [0, 1, 3] and docs.tolist() == [0, 0, 2]
