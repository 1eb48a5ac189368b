"""HTML extraction on made pages: twelve layouts with three articles each, word-level precision and recall; odd markup."""

import random
import time
from collections import Counter

import pytest

from khata.llm import html_extraction
from khata.llm.html_extraction import extract_main_text

NOISE = "login cart home about contact privacy terms share print subscribe newsletter copyright rights reserved follow".split()


def article(seed: int) -> tuple[str, list[str]]:
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4)))
    sentence = lambda: " ".join(word() for _ in range(rng.randrange(8, 16))).capitalize() + rng.choice([".", ".", "?", ", too."])
    return " ".join(word() for _ in range(6)).title(), [" ".join(sentence() for _ in range(rng.randrange(3, 6))) for _ in range(rng.randrange(4, 8))]


def links(words, tag="li"):
    return "".join(f'<{tag}><a href="/{w}">{w.title()}</a></{tag}>' for w in words)


NAV = f"<nav><ul>{links(NOISE[:6])}</ul></nav>"
FOOT = f"<footer><p>Copyright 2025. All rights reserved.</p><ul>{links(NOISE[4:9])}</ul></footer>"
SIDE = f'<aside class="sidebar"><h3>Popular</h3><ul>{links(NOISE[2:9])}</ul></aside>'
COMMENTS = '<div id="comments"><h3>Comments</h3><div class="comment"><p>I liked it.</p></div><div class="comment"><p>Me too, thanks.</p></div></div>'
AD = '<div class="ad">Buy shoes now!</div>'
paragraphs = lambda ps: "".join(f"<p>{p}</p>" for p in ps)

LAYOUTS = {
    "semantic": lambda t, ps: f"<html><head><title>x</title></head><body><header>{NAV}</header><main><article><h1>{t}</h1>{paragraphs(ps)}</article></main>{SIDE}{FOOT}</body></html>",
    "wrapper with sidebar in its name": lambda t, ps: f'<body><div class="site has-sidebar">{NAV}<article><h1>{t}</h1>{paragraphs(ps)}</article>{SIDE}</div>{FOOT}</body>',
    "taxonomy classes": lambda t, ps: f'<body>{NAV}<article class="post category-promo tag-news"><h1>{t}</h1>{paragraphs(ps)}</article>{SIDE}{FOOT}</body>',
    "comments open": lambda t, ps: f'<body>{NAV}<div class="content comments-open"><h1>{t}</h1>{paragraphs(ps)}</div>{COMMENTS}{FOOT}</body>',
    "plain divs": lambda t, ps: f'<body><div id="top"><ul>{links(NOISE[:6])}</ul></div><div id="body"><h1>{t}</h1>{paragraphs(ps)}</div><div id="bottom"><ul>{links(NOISE[5:])}</ul></div></body>',
    "unclosed paragraphs": lambda t, ps: f"<body>{NAV}<article><h1>{t}</h1>{''.join('<p>' + p for p in ps)}</article>{FOOT}",
    "adverts between": lambda t, ps: f"<body>{NAV}<article><h1>{t}</h1>{AD.join(f'<p>{p}</p>' for p in ps)}</article>{COMMENTS}{FOOT}</body>",
    "inline markup": lambda t, ps: f"<body>{NAV}<main><h1>{t}</h1>{''.join(f'<p><b>{p.split()[0]}</b> <a href=#>{p.split()[1]}</a> <span>' + ' '.join(p.split()[2:]) + '</span></p>' for p in ps)}</main>{SIDE}{FOOT}</body>",
    "tools in the article": lambda t, ps: f"<body>{NAV}<article><h1>{t}</h1><div><span>Share</span><span>Print</span><span>Save</span></div>{paragraphs(ps)}<div><span>Share</span><span>Mail</span></div></article>{FOOT}</body>",
    "teasers as articles": lambda t, ps: f"<body>{NAV}<article><h1>{t}</h1>{paragraphs(ps)}</article><section><article><h3>More news</h3><p>Read on.</p></article><article><h3>Other news</h3><p>Go there.</p></article></section>{FOOT}</body>",
    "scripts and notices": lambda t, ps: f'<body><script>var a = "<p>no</p>";</script><div class="cookie-notice"><p>We use cookies.</p></div>{NAV}<article><h1>{t}</h1>{paragraphs(ps)}<form><label>Mail</label><input><button>Subscribe</button></form></article><style>p {{}}</style>{FOOT}</body>',
    "table layout": lambda t, ps: f"<body><table><tr><td><ul>{links(NOISE[:7])}</ul></td><td><h1>{t}</h1>{paragraphs(ps)}</td></tr></table>{FOOT}</body>",
}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_words_of_made_pages(layout):
    for seed in range(3):
        title, ps = article(seed)
        got, want = Counter(extract_main_text(LAYOUTS[layout](title, ps)).split()), Counter(" ".join([title, *ps]).split())
        both = sum((got & want).values())
        assert both >= 0.95 * sum(got.values()) and both >= 0.95 * sum(want.values()), (layout, got - want, want - got)


def test_the_threshold_selects(monkeypatch):
    """With every path selected, what stands beside the text inside an article comes out."""
    title, ps = article(1)
    tools = "".join(f"<i>{w}</i>" for w in ("Share", "Print", "Save"))
    page = f"<body>{NAV}<article><h1>{title}</h1>{paragraphs(ps)}<section><ul><li>x<em>y</em></li></ul><div><div>{tools}</div></div></section></article>{FOOT}</body>"
    assert "Print" not in extract_main_text(page)
    monkeypatch.setattr(html_extraction, "_selected_paths", lambda page: set(page.path))
    assert "Print" in extract_main_text(page)


@pytest.mark.parametrize("markup", ["<a " * 350_000, "<b>" * 330_000, "<div>" * 200_000, "<p><table>" + "<b>" * 100_000 + "<h1>" * 100_000, "<i><div>" + "<b>" * 120_000 + "</i>" * 120_000, "<div>" * 100_000 + "</section>" * 90_000, '<a ">' * 200_000 + '"', "<!-- " * 200_000, "<article>x" * 100_000, "</" * 500_000])
def test_a_megabyte_of_broken_markup_takes_linear_time(markup):
    def seconds(source):
        begin = time.process_time()
        extract_main_text(source)
        return time.process_time() - begin

    quarter, whole = seconds(markup[: len(markup) // 4]), seconds(markup)
    assert whole < 6 and whole < 8 * quarter + 0.5


def test_cut_off_pages():
    assert extract_main_text("<p>One two three.</p><p>Four five six. <a hre") == "One two three. Four five six."
    assert extract_main_text("<p>One &amp; two &#x41;</p><!-- never closed <p>no</p>") == "One & two A"
    assert extract_main_text("5 < 6 and a<b>c</b>") == "5 < 6 and ac"
    assert [extract_main_text(x) for x in (None, "", "<div></div>", "   ")] == [""] * 4


# What an article holds besides long paragraphs: (markup, words).
KINDS = {
    "list": ("<p>You need</p><ul><li>two eggs</li><li>sugar</li></ul>", "You need two eggs sugar"),
    "steps": ("<ol><li>Beat</li><li>Bake it</li></ol>", "Beat Bake it"),
    "table": ("<table><caption>Times</caption><tr><th>Mon</th><td>9</td></tr><tr><th>Tue</th><td>10</td></tr></table>", "Times Mon 9 Tue 10"),
    "code": ("<pre>x = 1</pre>", "x = 1"),
    "quote": ("<blockquote>So it was</blockquote>", "So it was"),
    "quote of a paragraph": ("<blockquote><p>So it was</p></blockquote>", "So it was"),
    "caption": ("<figure><img src=a><figcaption>The kitchen</figcaption></figure>", "The kitchen"),
    "definitions": ("<dl><dt>Roux</dt><dd>flour in fat</dd></dl>", "Roux flour in fat"),
    "heading": ("<h3>Notes</h3>", "Notes"),
    "nested list": ("<ul><li>dry<ul><li>salt</li></ul></li></ul>", "dry salt"),
    "short paragraph": ("<p>Done.</p>", "Done."),
}


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("frame", ["<article>{}</article>", '<div id="body">{}</div>'])
def test_short_parts_of_the_article_stay(kind, frame):
    markup, words = KINDS[kind]
    title, ps = article(7)
    for before, after in ((1, 0), (1, len(ps)), (len(ps), 0)):
        inner = f"<h1>{title}</h1>{paragraphs(ps[:before])}{markup}{paragraphs(ps[before:after])}"
        want = f"{title} {' '.join(ps[:before])} {words} {' '.join(ps[before:after])}".split()
        assert extract_main_text(f"<body>{NAV}{frame.format(inner)}{COMMENTS}{FOOT}</body>").split() == want


def test_broken_names_take_linear_time():
    for page in ("<x" * 400_000, "<x" + "a" * 1_000_000, "<x" * 200_000 + ">", "<p>a" + "<x" + "b" * 500_000 + " c"):
        start = time.monotonic()
        extract_main_text(page)
        assert time.monotonic() - start < 5
