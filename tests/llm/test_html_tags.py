"""Tags of broken pages: found in time in proportion to the page, unfinished ones dropped."""

import time

import pytest

pytest.importorskip("statuta.llm")
from statuta.llm import html_layout  # noqa: E402


def text(page):
    return " ".join(html_layout.layout(page).split())


@pytest.mark.parametrize("unit", ["<a b", '<a "', "<a '", "</a ", "<", "< ", "<!", "<a b='\">", '<a "x>', "<p title=\"", "</", "<a <b \"'"])
def test_a_megabyte_of_broken_tags_is_read_once(unit):
    page = "<p>one</p>" + unit * (1_000_000 // len(unit))
    began = time.process_time()
    assert text(page).startswith("one")
    assert time.process_time() - began < 12


def test_unfinished_tags_are_dropped():
    assert text("<p>one</p>two <a href='x") == "one two"
    assert text("<p>one</p>two <a") == "one two"
    assert text("<p>one</p>two </p") == "one two"
    assert text("1 < 2 and 3 <4 </ 5> x") == "1 < 2 and 3 <4 </ 5> x"


def test_stray_quotes_end_with_their_tag():
    assert text('<a href=x">one</a> two') == "one two"
    assert text("<p title='>'>one</p> <i class=it's>two</i> three") == "one two three"
    assert text('<p title="a > b">one</p>') == "one"
