"""The reader of pages: what a plain pattern reads, in time that grows with the page alone."""

import html
import random
import re
import time

import pytest

from tidewell.llm import language


def plainly(markup):
    page = re.sub(r"<!--.*?-->|<(script|style|noscript|template)\b[^>]*>.*?</\1\s*>", " ", markup, flags=re.S | re.I)
    return html.unescape(re.sub(r"<[^>]*>", " ", page))


def test_pages_of_random_pieces():
    rng = random.Random(12)
    pieces = ["<!--", "-->", "<script>", "<SCRIPT a='>'>", "</script>", "</Script  >", "<style", "</style>", ">", "<", "<b>", "</b", "text", " &amp; ", "<template>", "</template>", "\n", "<scripts>", "--", "é"]
    for _ in range(3000):
        page = "".join(rng.choices(pieces, k=rng.randint(0, 14)))
        assert language.page_text(page) == plainly(page), page
    assert language.page_text(None) == ""


@pytest.mark.parametrize("piece", ["<script>", "<!--", "<style ", "<", "</script", "<script></style>", "<template><!--"])
def test_a_megabyte_of_what_is_never_closed(piece):
    page = piece * (1_000_000 // len(piece))
    t = time.process_time()
    language.page_text(page)
    language.declared_language(page)
    assert time.process_time() - t < 1.5
