"""A long word without a slash isn't read again from each of its letters."""

import time

from mosaiq.llm import broken_pairs as bp


def test_a_long_word_takes_no_square_of_its_length():
    start = time.process_time()
    assert bp.defect("What is it?", "The page is " + "x" * 60_000 + " as it is kept.") is None
    assert time.process_time() - start < 3


def test_pieces_give_the_words_of_the_whole():
    text = "See a/b, x_y and `c d` in foo.bar() or camelCase:\nÜber TwoWords c\\d ```\nno\n``` nur Straße"
    assert bp.prose(text).split() == ["See", "and", "in", "or", ":", "Über", "nur", "Straße"]
    assert not bp.refuses("we keep the page") and bp.refuses("we can not say it")
