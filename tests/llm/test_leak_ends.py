"""Problem 9: changed words near the ends of a passage don't shorten it."""

import numpy as np
import pytest

from pluvion.llm import leaks as lk

NONE = np.zeros(0, int)


@pytest.mark.parametrize("off", [(2,), (22,), (2, 22), (1, 12, 23), (4, 20), ()])
def test_changed_words_near_the_ends(off):
    item = np.arange(1000, 1100) * 4
    text = np.full(60, -4)
    text[20:45] = item[30:55]
    text[[20 + i for i in off]] = -8
    assert lk.compare(text, item, -10, NONE)[:3] == (30, 25, len(off))


def test_too_many_changes_and_notices_still_end_a_passage():
    item = np.arange(1000, 1100) * 4
    text = item[30:55].copy()
    text[[2, 4, 20, 22]] = -8  # four of 25
    assert lk.compare(text, item, -30, NONE)[1] < 25
    text = item.copy()
    text[52] = -8
    assert lk.compare(text, item, 0, np.arange(20, 46))[:2] == (50, 50)  # words 20 to 49 are a notice
