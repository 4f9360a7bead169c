"""Boilerplate words in the class of an element that encloses the main text."""

import pytest

from densitykit.llm.page_text import Weights, extract

TEXT = "<h1>Title here</h1><p>one two three four five six seven eight</p><p>nine ten eleven twelve</p>"
WANT = "Title here one two three four five six seven eight nine ten eleven twelve"
SIDE = '<div class="sidebar"><p>side words</p></div><nav><p>menu</p></nav>'


@pytest.mark.parametrize("page", [
    f'<html><body class="single has-sidebar"><div>{TEXT}</div>{SIDE}</body></html>',
    f'<html class="no-cookies cookie"><body id="search">{TEXT}{SIDE}</body></html>',
    f'<body><div id="page" class="with-sidebar"><div class="content">{TEXT}</div>{SIDE}</div></body>',
    f'<body><div class="content share">{TEXT}</div><div class="related"><article>teaser</article></div></body>',
    f'<body>{SIDE}<article class="post comment-open">{TEXT}<div class="share">tweet it</div></article></body>',
    f'<body>{SIDE}<main role="search">{TEXT}</main></body>',
    f'<body>{SIDE}<article><div class="body form">{TEXT}</div><div class="ad">buy now</div></article></body>',
])
def test_class_of_an_enclosing_element(page):
    assert extract(page, Weights()) == WANT


def test_comments_are_still_left_out():
    many = "".join(f'<article class="comment-body"><p>I liked post {i} a lot</p></article>' for i in range(20))
    page = f'<body><article>{TEXT}</article><div class="comments">{many[:400]}</div></body>'
    assert extract(page, Weights()) == WANT
    few = '<section id="comments"><article class="comment-body"><p>I liked it</p></article></section>'
    assert extract(f"<body><article>{TEXT}{few}</article></body>", Weights()) == WANT
