"""Vectorised token counts against the tokenizer itself."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pluvion.llm.pieces import VOCABULARY, encoding, text_token_counts

TEXT = st.text(st.one_of(st.sampled_from(list("aZ9 _'\n\r\t.sdtmrevl  é日１③​́\x1c\x85")), st.characters(exclude_categories=["Cs"])), max_size=60)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, max_size=6))
def test_counts(texts):
    enc = encoding(VOCABULARY)
    assert text_token_counts(texts, VOCABULARY).tolist() == [len(enc.encode_ordinary(t)) for t in texts]
    assert text_token_counts(texts, VOCABULARY, batch_chars=1).tolist() == [len(enc.encode_ordinary(t)) for t in texts]


def test_none_and_contractions():
    enc = encoding(VOCABULARY)
    texts = [None, "", "we're it's 'tis don''t I'll've 'S x's'", "\n\n  'll"]
    assert text_token_counts(texts, VOCABULARY).tolist() == [len(enc.encode_ordinary(t or "")) for t in texts]
    assert np.array_equal(text_token_counts([], VOCABULARY), np.zeros(0))
