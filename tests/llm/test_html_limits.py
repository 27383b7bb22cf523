"""What markup says about a page must not depend on how deep or how long it is."""

import time

import pytest

from traitweave.llm.html_extract import Page


def main(html):
    return "\n".join(text for _, text in Page(html).main())


@pytest.mark.parametrize("depth", [3, 150, 250, 3000])
def test_a_menu_is_a_menu_at_every_depth(depth):
    html = "<body>" + "<div>" * depth + "<p>text</p><nav><ul><li>menu</li></ul></nav><p>more</p>" + "</div>" * depth + "<footer>end</footer></body>"
    assert main(html) == "text\nmore"


@pytest.mark.parametrize("length", [50, 5_000, 500_000])
def test_attributes_of_every_length(length):
    value = "x" * length + " <b>leak</b> > tail"
    assert main(f'<div data-x="{value}"><p>text</p></div>') == "text"
    assert main(f"<div data-x = '{value}' class=y><p>text</p></div>") == "text"


def test_quotes_that_are_no_quotes():
    assert main("<p title=it's>one</p><p>it's two</p><p id=\"x>three</p>") in ("one\nit's two\nthree", "one\nit's two")
    assert main('<p a="1"b="2">one</p><p =">two</p>') == "one\ntwo"


@pytest.mark.parametrize("name", ["home right-sidebar", "has-sidebar", "single comments-open", "search", "page-template no-header"])
def test_words_on_the_whole_page(name):
    assert main(f'<html class="{name}"><body class="{name}"><p>text</p><div class="sidebar">aside</div></body></html>') == "text"
    assert main(f'<body><main class="{name}"><p>text</p></main><p>outside</p></body>') == "text"


def test_what_a_block_has_is_not_what_it_is():
    assert main('<div class="content has-sidebar"><p>text</p></div><div class="with-comments row"><p>more</p></div>') == "text\nmore"
    assert main('<p>text</p><div class="left-sidebar">aside</div><div class="comments">said</div>') == "text"


def test_deep_and_broken_markup_takes_linear_time():
    began = time.time()
    assert main("<div>" * 60_000 + "deep" + "</p></span></section>" * 20_000) == "deep"
    assert main("<ul><li>x" * 20_000).count("x") == 20_000
    assert time.time() - began < 20
