"""HTML to text: blocks, headings, lists, cells, preformatted text, references and broken markup."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.sources.html import decode, html_text, text_of_html


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        (" <p> </p>\n", ""),
        ("<!DOCTYPE html><title>t</title><p>One\n two</p><p>three", "One two\n\nthree\n"),
        ("<h2>A <br>b<p>c</h2>x", "## A b c\n\nx\n"),
        ("<h2></h2><p>x</p>", "x\n"),
        ("<ul><li>a<li><p>b</p></li><li></li></ul>c", "- a\n\n- b\n\nc\n"),
        ("<table><tr><td>a</td><td>b</td></tr><tr><td>c</table>", "a b\n\nc\n"),
        ("a<br>b<br/>c", "a\nb\nc\n"),
        ("<pre>x\n  y &lt;b&gt;</pre>z", "x\n  y <b>\n\nz\n"),
        ("a<script>if (1 < 2) '<p>'</script>b<!-- > <p> -->c<style>x", "abc\n"),
        ('<a title="x > y">link</a> 1 < 2 &amp;lt;', "link 1 < 2 &lt;\n"),
        ("a&nbsp; b &copy; &#65;&#x42; &nope; &#0; AT&T", "a b © AB &nope; &#0; AT&T\n"),
        ("x <p unclosed", "x\n"),
    ],
)
def test_page(page, text):
    assert text_of_html(page) == text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<h1>", "</h1>", "<li>", "<pre>", "</pre>", "<td>", "<br>", "a", " ", "\n", "<", "&amp;", "<script>", "</script>", "\ufdd0"])).map("".join))
def test_any_markup_ends_in_one_line_end_and_has_no_marks(page):
    text = text_of_html(page)
    assert text == "" or text.endswith("\n") and not text.endswith("\n\n")
    assert not any("\ufdd0" <= c <= "\ufdef" for c in text)


def test_decode_is_single():
    assert decode("&amp;amp;") == "&amp;"


def test_frame(spark):
    pages = spark.createDataFrame([(1, "<p>a</p>", 3), (2, None, 4)], "page_id long, html string, extra int")
    assert sorted(map(tuple, html_text(pages, "page_id", "html").collect())) == [(1, "a\n"), (2, None)]
