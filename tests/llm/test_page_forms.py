"""Main text by learned block forms: pages without ``article``, and class words that only raise a question."""

import re

import pytest
from pyspark.sql import functions as F

from densitykit.llm import page_text
from densitykit.llm.page_text import Weights, extract
from tests.conftest import SF

LONG = "The government of the country was formed after a long debate in which many members of the assembly took part and spoke."
MENU = '<ul class="topnav"><li><a href="/h">Home</a></li><li><a href="/a">About</a></li></ul>'


@pytest.fixture(scope="module")
def learned(spark):
    """Weights from half of the pages."""
    pages = spark.read.parquet(f"{SF['0.01']}/pages.parquet")
    return page_text.fit(pages.where(F.col("page_id") % 2 == 0))


@pytest.mark.parametrize("change", [[], [(r"<nav>(.*?)</nav>", r'<div class="top">\1</div>'), (r"<footer>(.*?)</footer>", r"<div>\1</div>")]])
def test_other_pages_without_article(spark, learned, change):
    pages = [r.html for r in spark.read.parquet(f"{SF['0.01']}/pages.parquet").where(F.col("page_id") % 2 == 1).collect()]
    right = unlearned = 0
    for h in pages:
        want = extract(re.search(r"<article>.*</article>", h, re.S)[0], Weights())
        for a, b in [(r"</?article>", ""), *change]:
            h = re.sub(a, b, h)
        right += extract(h, learned) == want
        unlearned += extract(h, Weights()) == want
    assert right == len(pages) > 100
    assert not change or unlearned < len(pages) / 2  # the weights are at work


@pytest.mark.parametrize("page, want", [
    (f"<body>{MENU}<h1>Title here</h1><p>{LONG}</p><p>{LONG}</p><p>© 2024 Acme Inc. All rights reserved.</p></body>", f"Title here {LONG} {LONG}"),
    (f'<body><div class="header"><p>My site</p></div><h1 class="page-header">Title here</h1><p>{LONG}</p></body>', f"Title here {LONG}"),
    (f'<article><p>{LONG}</p><section class="form-of-government"><h2>Form</h2><p>{LONG}</p></section></article>', f"{LONG} Form {LONG}"),
    (f'<article><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p><div id="search"><p>{LONG}</p></div></article>', " ".join([LONG] * 4)),
    (f'<article><p>{LONG}</p><p>{LONG}</p><div id="History_of_advertising"><p>{LONG}</p></div></article>', " ".join([LONG] * 3)),
    (f'<article><p>{LONG}</p><div id="search"><input><p>Search this site</p></div><div class="advertising"><p>{LONG}</p></div><p>{LONG}</p></article>', f"{LONG} {LONG}"),
    (f'<article><p>{LONG}</p><div class="comment-list"><p>{LONG}</p></div><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> hold.</p></article>', f"{LONG} Let x=2 hold."),
    (f'<article><p>{LONG}</p><ul><li><a href="/r">A reference</a></li></ul></article>', f"{LONG} A reference"),
    (f'<body><p>{LONG}</p><ul><li>{LONG}</li><li>{LONG}</li></ul></body>', " ".join([LONG] * 3)),
])
def test_marks_and_forms(learned, page, want):
    assert extract(page, learned) == want


def test_block_forms():
    toks = page_text.parse("<p>one two <a>three</a></p><p><a>one</a> two <a>three</a></p>&copy; me<br>x")[0]
    words = [len(t[2].split()) for t in toks]
    assert [f for t, f in zip(toks, page_text.block_forms(toks, words)) if t[0] == "t"] == ["2", "2", "2a", "2a", "2a", "2c", "1"]
