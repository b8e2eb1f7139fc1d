"""Pages of many shapes with the text that they must give."""

import time

import pytest

from harrow.llm.html_text import main_text


def prose(n, sentences=4):
    return f"Paragraph {n} " + "has several words, commas, and enough length to score. " * (sentences - 1) + "It ends here."


def p(n, sentences=4):
    return f"<p>{prose(n, sentences)}</p>"


def many(*numbers):
    return "".join(map(p, numbers))


LINKED = '<ul><li><a href="/a">Home page</a></li><li><a href="/b">Other page</a></li></ul>'

#: name: (page, blocks of the main text)
PAGES = {
    "sections of several sizes": (
        f"<body><div class=sec>{many(1, 2)}</div><div class=sec>{many(3)}</div><div class=sec>{many(4)}</div></body>",
        [prose(1), prose(2), prose(3), prose(4)],
    ),
    "sections in an article": (
        f"<article><section>{many(1, 2, 3)}</section><section><h2>Second</h2><p>Short.</p></section></article>",
        [prose(1), prose(2), prose(3), "Second", "Short."],
    ),
    "names of content that hold a listed word": (
        f"<article>{many(1, 2)}<div class='tags-explained'><p>Tags are words.</p></div><div class='related-work'><p>Others did it.</p></div></article>",
        [prose(1), prose(2), "Tags are words.", "Others did it."],
    ),
    "names of furniture in an article": (
        f"<article>{many(1, 2)}<div class='share-buttons'>Share it</div><div class='social links-2'>Follow</div>"
        f"<section id=comments><h2>Comments</h2>{many(8, 9)}</section></article>",
        [prose(1), prose(2)],
    ),
    "a discussion with prose": (
        f"<article><h1>T</h1>{many(1)}<section class=discussion><h2>Discussion</h2>{many(2, 3)}</section><p class=notice>Reprinted.</p></article>",
        ["T", prose(1), "Discussion", prose(2), prose(3)],
    ),
    "a related box without prose": (
        f"<main>{many(1, 2)}<div class=related><h3>More</h3>{LINKED}</div></main>",
        [prose(1), prose(2)],
    ),
    "list, quote, code and table beside the container": (
        f"<body><div><div class=text>{many(1, 2)}</div><ul><li>One</li></ul><blockquote>Quote</blockquote><pre>a  =\n 1</pre>"
        "<table><tr><th>H</th><td>C</td></tr></table><div>Short</div></div></body>",
        [prose(1), prose(2), "One", "Quote", "a = 1", "H", "C", "Short"],
    ),
    "header of the article with title and date": (
        f"<header><p>Site name</p></header><article><header><h1>Title</h1><time>1 May</time></header>{many(1)}</article><footer>Foot</footer>",
        ["Title", "1 May", prose(1)],
    ),
    "title outside the container": (
        f"<body><div id=top><h1>Title</h1></div><div id=wrap><div id=cols><div id=text>{many(1, 2, 3)}</div></div></div></body>",
        ["Title", prose(1), prose(2), prose(3)],
    ),
    "page inside one form": (
        f"<body><form action=/x><input name=q><label>Find</label><main><h1>T</h1>{many(1)}</main><button>Go</button></form></body>",
        ["T", prose(1)],
    ),
    "small form in the article": (f"<main>{many(1)}<form><p>Your mail</p><input></form>{many(2)}</main>", [prose(1), prose(2)]),
    "menus without nav": (
        f"<body><div class=menu>{LINKED}</div><div>{LINKED}</div><div class=content>{many(1, 2)}</div><div id=sidebar>{many(7)}</div></body>",
        [prose(1), prose(2)],
    ),
    "camel case and BEM names": (
        f"<body><div class='cookieNotice'><p>Accept, please.</p></div><div class='story__body'>{many(1, 2)}</div><div class='story__comments'>{many(8)}</div></body>",
        [prose(1), prose(2)],
    ),
    "roles and hidden parts": (
        f"<body><div role=navigation>Go</div><div role=main>{many(1)}<p hidden>No</p><p style='display: none'>No</p><p aria-hidden=true>No</p></div></body>",
        [prose(1)],
    ),
    "references and white space": (
        "<article><p>Caf&eacute; &#38; bar&nbsp;&amp;\n\tgrill, &lt;open&gt; &#x1F600; daily, they say, for all.</p></article>",
        ["Café & bar & grill, <open> 😀 daily, they say, for all."],
    ),
    "inline markup and breaks": (
        "<article><p>A<b>b</b>c <i>d</i><br>e, f, and some more words to be counted.</p>loose text</article>",
        ["Abc d e, f, and some more words to be counted.", "loose text"],
    ),
    "unclosed paragraphs and cells": (
        "<main><p>One, two, three, four, five, six.<p>Seven, eight, nine.<table><tr><td>A<td>B<tr><td>C</table><ul><li>x<li>y</ul></main>",
        ["One, two, three, four, five, six.", "Seven, eight, nine.", "A", "B", "C", "x", "y"],
    ),
    "definition list and figure": (
        f"<main>{many(1)}<dl><dt>Term<dd>Meaning</dl><figure><img src=x><figcaption>Seen from afar</figcaption></figure></main>",
        [prose(1), "Term", "Meaning", "Seen from afar"],
    ),
    "scripts, styles and comments": (
        f"<body><script>if (a < b) document.write('<p>x</p>')</script><style>p > b {{}}</style><!-- <p>gone</p> --><article>{many(1)}<noscript>On</noscript></article>",
        [prose(1)],
    ),
    "many short articles are one text": (
        "<main>" + "".join(f"<article><h2>Item {n}</h2>{p(n, 2)}</article>" for n in range(4)) + "</main>",
        [x for n in range(4) for x in (f"Item {n}", prose(n, 2))],
    ),
    "one long article beside teasers": (
        f"<main><article>{many(*range(8))}</article><article class=teaser><h2>Next</h2><p>Soon.</p></article></main>",
        [prose(n) for n in range(8)],
    ),
    "no paragraph elements": (
        "<body><div>First line of text, which is long enough, surely.<br>Second line.</div><div>Another one, also long enough, it seems.</div></body>",
        ["First line of text, which is long enough, surely. Second line.", "Another one, also long enough, it seems."],
    ),
    "text after a link list": (f"<body><div>{LINKED}</div><div>{many(1)}</div><hr>{many(2)}</body>", [prose(1), prose(2)]),
    "links alone": ("<body><nav>" + LINKED + "</nav></body>", []),
    "a table of layout": (f"<table><tr><td width=20%>{LINKED}</td><td>{many(1, 2)}</td></tr></table>", [prose(1), prose(2)]),
    "upper case tags and odd quotes": (f"<BODY><DIV CLASS='ad'>Buy</DIV><ARTICLE ID=a1>{many(1)}</ARTICLE></BODY>", [prose(1)]),
    "right-to-left and Chinese commas": ("<article><p>今天天气很好，我们去公园，然后回家，吃饭，睡觉。</p><p>שלום, עולם.</p></article>", ["今天天气很好，我们去公园，然后回家，吃饭，睡觉。", "שלום, עולם."]),
}


@pytest.mark.parametrize("name", PAGES)
def test_page(name):
    page, blocks = PAGES[name]
    assert main_text(page) == "\n\n".join(blocks)


@pytest.mark.parametrize(
    "page",
    [
        "<div>" * 50_000 + p(1),
        "<article>" + "<p>" + "<b>" * 50_000 + prose(1) + "</i>" * 50_000,
        "<div class=ad>" * 20_000 + f"<main><h1></h1>{p(1)}</main>",
        f"<main>{'<p>' * 50_000}{p(1)}</main>",
    ],
)
def test_depth_costs_no_more_than_length(page):
    began = time.perf_counter()
    assert main_text(page) == prose(1)
    assert time.perf_counter() - began < 30


def test_a_long_page_is_read_whole():
    numbers = range(20_000)
    assert main_text(f"<article>{many(*numbers)}</article>") == "\n\n".join(map(prose, numbers))
