"""Pages whose article stands in what looks like furniture, and furniture that looks like an article."""

import pytest

from harrow.llm.html_text import main_text

PROSE = "This is a long enough paragraph, with commas, that is worth something to a reader."
P = f"<p>{PROSE}</p>"
BOX = "Read our newsletter, which comes on Mondays, and on all other days too."


@pytest.mark.parametrize(
    ("page", "blocks"),
    [
        (f"<form id=aspnetForm><h2>Title</h2><div>{P * 3}</div></form>", ["Title", *[PROSE] * 3]),
        (f'<body><div class="main-login-page">{P * 3}</div></body>', [PROSE] * 3),
        (f'<body><div id="menu-content">{P * 3}</div></body>', [PROSE] * 3),
        (f'<body><div role="form">{P * 3}</div><p>x</p></body>', [*[PROSE] * 3, "x"]),
        (f"<body><div><div>{P * 6}</div></div><div><div><p>A short second section, still text.</p></div></div></body>", [*[PROSE] * 6, "A short second section, still text."]),
        (
            f"<body><div><div class=entry>{P * 5}</div><h2>References</h2><ul><li>Smith, <a href=1>On things</a>, 2020</li></ul></div><div><p>x</p></div></body>",
            [*[PROSE] * 5, "References", "Smith, On things, 2020"],
        ),
        (f'<article>{P * 2}<section class="reader-comments">{P * 9}</section></article>', [PROSE] * 2),
        (f'<body><div class="comments">{P * 9}</div><div><p>Short article of one line here, fine.</p></div></body>', ["Short article of one line here, fine."]),
        (f'<body><div class="ad">{BOX}</div><article><h1>Title</h1><p>One.</p></article></body>', ["Title", "One."]),
        (f'<body><div class="comments">{P}</div></body>', [PROSE]),  # nothing else is there
        (f'<article class="has-comments">{P}</article>', [PROSE]),
    ],
)
def test_article_and_furniture(page, blocks):
    assert main_text(page).split("\n\n") == blocks


def test_plain_pages_are_read_as_their_blocks():
    """A page of headings and paragraphs alone is their texts, whatever wraps them."""
    for tag in ("div", "section", "main", "article", "form", "td"):
        for depth in (1, 4):
            inner = "".join(f"<h2>Part {i}</h2><p>{PROSE} {i}</p>" for i in range(7))
            page = f"<body>{f'<{tag}>' * depth}{inner}{f'</{tag}>' * depth}</body>"
            expected = [b for i in range(7) for b in (f"Part {i}", f"{PROSE} {i}")]
            assert main_text(page).split("\n\n") == expected, (tag, depth)
