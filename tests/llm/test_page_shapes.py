"""Shapes of pages with their article's blocks marked by hand: none may be lost, and nothing around them may stay."""

import pytest

from dossier.llm import pages

LONG = "A long paragraph of the article, with commas, clauses and several sentences. It goes on for a while, so that its ratio is high. "
A, B, C = LONG + "First.", LONG * 2 + "Second.", LONG + "Third."
FRAMES = "<nav><a href=/>Home</a> <a href=/x>About us</a></nav>{}<footer>Copyright, all rights reserved, 2026.</footer>"
SHAPES = {
    "plain": (f"<article><h1>Head</h1><p>{A}</p><p>{B}</p></article>", ["Head", A, B]),
    "short div": (f"<article><p>{A}</p><div>Short note here</div><p>{B}</p></article>", [A, "Short note here", B]),
    "byline span": (f"<article><h1>Head</h1><span>By Jane</span><p>{A}</p></article>", ["Head", "By Jane", A]),
    "linked sources": (f"<article><p>{A}</p><p>{B}</p><ul><li><a href=1>Source one</a></li><li><a href=2>Source two</a></li><li><a href=3>Source three</a></li></ul></article>", [A, B, "Source one", "Source two", "Source three"]),
    "post header": (f"<article><div class='post-header'><h1>Head</h1></div><p>{A}</p></article>", ["Head", A]),
    "header element": (f"<article><header><h1>Head</h1><p>Standfirst</p></header><p>{A}</p></article>", ["Head", "Standfirst", A]),
    "table": (f"<article><p>{A}</p><table><tr><th>Year</th><th>Sum</th></tr><tr><td>1999</td><td>12</td></tr></table><p>{B}</p></article>", [A, "Year", "Sum", "1999", "12", B]),
    "quote": (f"<article><p>{A}</p><blockquote>So it goes.</blockquote><p>{B}</p></article>", [A, "So it goes.", B]),
    "figure": (f"<article><p>{A}</p><figure><img src=x><figcaption>A view</figcaption></figure><p>{B}</p></article>", [A, "A view", B]),
    "code": (f"<article><p>{A}</p><pre>x = 1</pre><p>{B}</p></article>", [A, "x = 1", B]),
    "definition list": (f"<article><p>{A}</p><dl><dt>Term</dt><dd>Meaning</dd></dl></article>", [A, "Term", "Meaning"]),
    "sections": (f"<article><section><h2>One</h2><p>{A}</p></section><section><h2>Two</h2><p>{B}</p></section></article>", ["One", A, "Two", B]),
    "divs": (f"<article><div><div>{A}</div></div><div><div>{B}</div></div></article>", [A, B]),
    "main": (f"<main><h1>Head</h1><p>{A}</p></main>", ["Head", A]),
    "short paragraph": (f"<article><p>{A}</p><p>Yes.</p><p>{B}</p></article>", [A, "Yes.", B]),
    "last line": (f"<article><p>{A}</p><p>{B}</p><div>The end</div></article>", [A, B, "The end"]),
    "first line": (f"<article><div>Berlin</div><p>{A}</p></article>", ["Berlin", A]),
    "in a form": (f"<form id=aspnetForm><article><p>{A}</p></article></form>", [A]),
    "in a sidebar wrap": (f"<div class='content-sidebar-wrap'><article><p>{A}</p><p>{B}</p></article></div>", [A, B]),
    "advert inside": (f"<article><p>{A}</p><div class='advert'>Buy shoes, today only, for less.</div><p>{B}</p></article>", [A, B]),
    "share bar inside": (f"<article><p>{A}</p><ul class='share-bar share'><li><a href=x>Tweet</a></li></ul><p>{B}</p></article>", [A, B]),
    "comments below": (f"<article><p>{A}</p></article><section id='comments'><p>{C}</p></section>", [A]),
    "aside inside": (f"<article><p>{A}</p><aside>Did you know that</aside><p>{B}</p></article>", [A, B]),
    "no article": (f"<div id=wrap><div><a href=1>News</a> <a href=2>Sport</a></div><div><p>{A}</p><p>{B}</p></div><div>Impressum</div></div>", [A, B]),
}


@pytest.mark.parametrize("name", SHAPES)
def test_shapes(name):
    page, blocks = SHAPES[name]
    assert pages.main_text("<html><body>" + FRAMES.format(page) + "</body></html>").split("\n\n") == [b.strip() for b in blocks]


def test_ratios_decide_without_an_article():
    """Nothing but the ratios tells the text from the boxes around it; with the threshold off, these stay."""
    boxes = "".join(f"<div class=x{k}><a href={k}>Link {k}</a> more</div>" for k in range(5))
    page = f"<div>{boxes}<div class=y><p>{A}</p><p>{B}</p></div>{boxes}</div>"
    assert pages.main_text(page).split("\n\n") == [A, B]
    assert "Link 3" in pages.main_text(page, share=0.0)
