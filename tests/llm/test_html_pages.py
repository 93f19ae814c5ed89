"""Pages in broken markup: time in proportion to length, inline adverts within paragraphs, white space."""

import time

import pytest

from brindle.llm.html_text import blocks_of


def texts(page):
    return [b for _, b in blocks_of(page)]


@pytest.mark.parametrize("piece", ["<a", "<a '", '<a "', '<p title="x>t</p>', "<div>", "</div>", "<div>x</p>", "<a 'x>y'", "<!--", "<!", "<script>", "<a b=\"'>", "<span class=ad>", "<p><b class=ad>", "<a x=", "<li>", "<", "<p ", "<textarea>", "</", "<td class=ad>"])
def test_time_is_linear(piece):
    for tail in ("", '"', "'", ">", '">'):
        began = time.time()
        blocks_of(piece * (300_000 // len(piece)) + tail)
        assert time.time() - began < 3


def test_long_attributes():
    began = time.time()
    for page in ("<a " + "x" * 1_000_000 + "=1>", "<a class=" + "b-" * 500_000 + ">", "<a " + "x" * 1_000_000 + ">t=", "<div>" * 100_000 + "x</p>" * 100_000):
        blocks_of(page)
    assert time.time() - began < 10


def test_inline_adverts_leave_their_paragraph_whole():
    assert texts('<p>x<span class="ad">AD</span>y <b>z</b></p>') == ["xy z"]
    assert texts('<p>a<span class="ad">q<div>d</div>r</span> b</p><p>c</p>') == ["a b", "c"]
    assert texts('<p>a<span class="ad">never closed</p><p>b</p>') == ["a", "b"]
    assert texts('a<span class="ad">never closed') == ["a"]
    assert texts('<table><tr><td>a</td><td class="ad">x</td><td>b</td></tr></table>') == ["a b"]


def test_white_space():
    assert texts("<p>  a&nbsp;\t b\n</p><p>&nbsp;</p>") == ["a b"]


def test_quotes_that_do_not_close():
    assert texts('<p>a</p><p title="x>b</p><p>c</p>') == ["a", "b", "c"]
    assert texts("<p>1 < 2 and 3 > 2</p>tail <a hr") == ["1 < 2 and 3 > 2", "tail"]
