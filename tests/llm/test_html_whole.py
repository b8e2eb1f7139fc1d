"""What stands beside the best container is part of the article, unless it is mostly links."""

import pytest

from harrow.llm.html_text import main_text

LONG = "<p>" + "A long paragraph, with commas, that scores well, again and again. " * 5 + "</p>"
BODY = LONG * 4
TEXT = "\n\n".join(["A long paragraph, with commas, that scores well, again and again. " * 4 + "A long paragraph, with commas, that scores well, again and again."] * 4)
QUOTE, CODE, LIST = "<blockquote>A quotation.</blockquote>", "<pre>x = 1</pre>", "<ul><li>One item</li><li>Two</li></ul>"
LINKS = '<div><a href="a">Elsewhere one</a> <a href="b">Elsewhere two</a></div>'


@pytest.mark.parametrize("name", ["article", "main"])
def test_wrapper_div_in_an_article(name):
    page = f"<body>{LINKS}<{name}><header><h1>Title</h1></header><div class='entry-content'>{BODY}</div>{QUOTE}{CODE}{LIST}</{name}></body>"
    assert main_text(page) == f"Title\n\n{TEXT}\n\nA quotation.\n\nx = 1\n\nOne item\n\nTwo"


def test_siblings_without_an_article():
    page = f"<body><div><h1>Title</h1><div class='entry-content'>{BODY}</div>{QUOTE}{CODE}{LIST}{LINKS}<table><tr><td>Cell</td></tr></table></div></body>"
    assert main_text(page) == f"Title\n\n{TEXT}\n\nA quotation.\n\nx = 1\n\nOne item\n\nTwo\n\nCell"


def test_short_second_section():
    page = f"<body><div><section>{BODY}</section><section><p>A short one.</p></section></div></body>"
    assert main_text(page) == f"{TEXT}\n\nA short one."


def test_an_article_of_links_is_not_taken():
    many = LINKS * 60
    page = f"<body><article><div><div class='entry-content'>{BODY}</div>{QUOTE}</div>{many}</article></body>"
    assert main_text(page) == f"{TEXT}\n\nA quotation."
