import random
import time

import pytest

from gridlark.llm import html
from gridlark.llm.html import BAD, GOOD, INSIDE, OPEN, OUTSIDE, PLAIN

PROSE = "This is the story of a man that was on the road to the town, and it is one of the best that we have had in all these long years with you."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<p>", ""),
        ("<div", ""),
        (f"<body><nav><a href=/>Home</a></nav><article><h1>Title</h1><p><b>a &amp; b<br><p>  c\n d </p></article><footer>{PROSE}</footer>", "Title a & b c d"),
        (f"<div class='menu'><a>Home</a></div><p>Short.<p>{PROSE}<p>Tiny.<div id=comments><p>{PROSE}</div>", f"Short. {PROSE} Tiny."),
        ("<article>x<script>var t='<p>';</script><style>p{}</style><!-- y -->z</article>", "xz"),
        (f"<main><p>Text.</p><aside>{PROSE}</aside><form>{PROSE}</form><div class='cookie-notice'>{PROSE}</div><table><tr><td>1<td>2</table></main>", "Text. 1 2"),
        ("<article><p>One.</p><p><a href=x>Read the other story of the day</a></p><p>Two &lt;3 &#x41;&#66;</p></article>", "One. Two <3 AB"),
        (f"<article class='has-comments'><p>Main.</p></article><article class='comment'><p>{PROSE}</p></article>", "Main."),
        (f"<article><p>Before <span class='ad-slot'>{PROSE}</span>after <i>it</i>.</p><div hidden>{PROSE}</div><ul class=share><li>x</ul></article>", "Before after it."),
        (f"<header>{PROSE}</header><article><p>Body.</p><section class='comments'><p>{PROSE}</p></section></article><div class=ad>{PROSE}</div>", "Body."),
    ],
)
def test_main_text(page, text):
    assert html.main_text(page) == text


def slow_labels(rows):
    """Both passes from their definition. rows: (length, links, stops, container, excluded)."""
    named = any(c and not e for *_, c, e in rows)

    def first(length, links, stops, container, excluded):
        if excluded or links > 0.5:
            return BAD
        if container:
            return OPEN if length < 70 or stops < 0.1 and length < 200 else GOOD
        if named:
            return GOOD if length >= 200 and stops >= 0.2 else BAD
        if length < 70:
            return OPEN
        if stops < 0.1:
            return BAD
        return GOOD if stops >= 0.2 or length >= 200 else OPEN

    labels = [first(*r) for r in rows]
    out = []
    for i, label in enumerate(labels):
        if label == OPEN:
            sides = []
            for step in (-1, 1):
                j = i + step
                while 0 <= j < len(rows) and rows[j][3] == rows[i][3] and not (rows[j][3] and rows[j][4]):
                    if labels[j] != OPEN:
                        sides.append((abs(j - i), labels[j]))
                        break
                    j += step
            if rows[i][3]:
                label = GOOD if len(sides) < 2 or GOOD in (sides[0][1], sides[1][1]) else BAD
            elif sides:
                nearest = min(d for d, _ in sides)
                label = GOOD if (nearest, GOOD) in sides else BAD
            else:
                label = BAD
        out.append(label)
    return out


def test_labels_like_brute_force():
    draw = random.Random(7)
    for _ in range(4000):
        rows, container = [], 0
        for _ in range(draw.randint(0, 14)):
            if draw.random() < 0.25:
                container = draw.choice([0, 0, 1, 2])
            rows.append((draw.choice([5, 69, 70, 199, 200, 900]), draw.choice([0.0, 0.0, 0.5, 0.9]), draw.choice([0.0, 0.1, 0.15, 0.2, 0.5]), container, draw.random() < 0.2))
        named = any(c and not e for *_, c, e in rows)
        labels = [html.decided(a, b, s, INSIDE if c else OUTSIDE if named else PLAIN, e) for a, b, s, c, e in rows]
        assert html.inherited(labels, [r[3] for r in rows], [r[4] for r in rows]) == slow_labels(rows)


@pytest.mark.parametrize("page", [lambda n: "<b>" * n + "</i>" * n + "<p>" * n, lambda n: "<b>" * n + "<div>x</div>" * n, lambda n: "<b><p>x</b>" * n, lambda n: "<li>x<a href='y'>z" * n, lambda n: "<p title=\">" * n, lambda n: "<!-- x" * n, lambda n: "<div>x" * n + "</div>" * n, lambda n: f"<article>{'short <i>x</i><br>' * n}</article>"])
def test_time_grows_with_the_page(page):
    took = []
    for n in (4000, 32_000):
        began = time.process_time()
        html.main_text(page(n))
        took.append(time.process_time() - began)
    assert took[1] <= 16 * took[0] + 0.2


def test_long_page():
    whole = " ".join(f"<p>{PROSE} {i}</p>" for i in range(12_000))
    assert len(whole) > 1 << 20
    assert html.main_text(f"<nav>{'<a>x</a>' * 50}</nav>{whole}") == " ".join(f"{PROSE} {i}" for i in range(12_000))


def test_prose_outside_of_the_article():
    long = f"{PROSE} {PROSE}"
    assert html.main_text(f"<article><p>{PROSE}</p></article><p>{long}</p><p>Short.</p>") == f"{PROSE} {long}"


def test_rows(spark):
    rows = [(1, "u", "<article><p>ä 世</p></article>", 9), (1, "u", "<article><p>ä 世</p></article>", 9), (2, None, None, 9), (None, "v", "<p>", 9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = html.extract(pages).collect()
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in got) == [("1", "ä 世", 3), ("1", "ä 世", 3), ("2", "", 0), ("None", "", 0)]
    assert html.extract(pages.where("1 = 0")).count() == 0
