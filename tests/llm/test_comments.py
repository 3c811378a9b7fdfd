"""Readers' comments are no main text, whatever elements hold them."""

import pytest

from voxlake.llm import html_text

SAID = "This is a long article text, with enough words to be the main content of this page, and it says much."
LIKED = "<p>I liked this a lot, thank you for writing it.</p>"
COMMENTS = [f'<div class="discussion"><article class="comment">{LIKED}</article></div>', f'<ol class="comment-list"><li><article class="comment-body">{LIKED}</article></li></ol>', f'<section class="responses">{LIKED}</section>']


@pytest.mark.parametrize("comments", COMMENTS)
def test_comments_leave(spark, comments):
    page = f"<html><body><main><article><h1>Title of it</h1><p>{SAID}</p><p>{SAID}</p>{comments}</article></main></body></html>"
    pages = spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")
    given = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html")
    for model in (html_text.fit(pages), html_text.fit(given)):
        assert html_text.extract(pages, model).first()["text"].split("\n") == ["Title of it", SAID, SAID]
