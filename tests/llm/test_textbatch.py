import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from cuelark.llm import textbatch as tb


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbB \n\té日", max_size=30)), max_size=8))
def test_word_hashes_equal_exactly_where_words_do(texts):
    got = [h[a:b] for _, h, first in tb.hashed_words(pa.array(texts, pa.string())) for a, b in zip(first[:-1], first[1:], strict=True)]
    assert [len(h) for h in got] == [len(words_of(t)) for t in texts]
    by_word = {}
    for h, t in zip(got, texts, strict=True):
        for x, w in zip(h.tolist(), words_of(t), strict=True):
            assert by_word.setdefault(w, x) == x
    assert len(set(by_word.values())) == len(by_word)


def test_shingle_sets_of_short_empty_and_long_texts():
    texts = [None, "", " \n", "one", "one two", "a b c d e", "a b c d e f", "a b c d e " * 50_000]
    sets = list(tb.shingle_sets(pa.array(texts, pa.string())))
    assert [len(s) for s in sets] == [0, 0, 0, 1, 1, 1, 2, 5]
    assert sets[5][0] in sets[6] and sets[5][0] in sets[7] and sets[3][0] != sets[4][0]
    assert all((np.diff(s.astype(object)) > 0).all() for s in sets)


def test_pieces_cover_all_texts():
    begins = np.array([0, 5, 5, 700_000, 700_001, 700_001])
    runs = list(tb.pieces(begins))
    assert runs[0][0] == 0 and runs[-1][1] == 5 and all(a[1] == b[0] for a, b in zip(runs, runs[1:], strict=False))
