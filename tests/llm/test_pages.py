"""Controls, drawings and foreign attributes cost no text of a page."""

import random

import pytest

from fabulagraph.llm import html

ARTICLE = "<article><h1>The title of it</h1>" + "".join(f"<p>Sentence {i} of an article that goes on for some words.</p>" for i in range(6)) + "</article>"


def page(head):
    return f"<html><body><header>{head}</header>{ARTICLE}<footer class=footer>end</footer></body></html>"


@pytest.mark.parametrize("head", [
    "<datalist><option value=a><option value=b></datalist>", "<select><option>one<option>two</select>", '<svg viewBox="0 0 1 1"/>',
    "<svg><style/><path d=x /><title>t</title></svg>", "<button>Menu", "<option>x", "<noscript>", "<button><div>Menu</div></button>",
    '<div data-state="open">x</div>', "<div data-state=closed data-fabulagraph-state=open>x</div>",
])
def test_header_parts_lose_nothing(head):
    assert html.trained().extract(page(head)) == html.trained().extract(page(""))


@pytest.mark.parametrize("tag", ["object", "canvas"])
def test_fallback_content(tag):
    got = html.trained().extract(f"<html><body><{tag}>{ARTICLE}</{tag}></body></html>")
    assert all(f"Sentence {i} of" in got for i in range(6))


def test_unclosed_button_before_blocks():
    got = html.trained().extract(f"<html><body><button>Menu{ARTICLE}</body></html>")
    assert "Menu" not in got and all(f"Sentence {i} of" in got for i in range(6))


@pytest.mark.parametrize("html_,want", [
    ("<article><p data-x=it's>Quoted it.</p><p>Next</p></article>", "Quoted it.\n\nNext"),
    ('<article><p>One</p><p class=a title="open>Two</p><p>Three</p></article>', "One\n\nTwo\n\nThree"),
    ('<article><h1>T</h1><div class="related-work"><h2>Related work</h2><p>Smith did it.</p></div><p>End.</p></article>', "T\n\nRelated work\n\nSmith did it.\n\nEnd."),
    ('<article><section class="main-header"><h1>Title</h1><p>Lead.</p></section><p>Body.</p></article>', "Title\n\nLead.\n\nBody."),
    ('<main><h1>T</h1><section id="search-methods"><p>We searched.</p></section></main>', "T\n\nWe searched."),
    ('<article><h1>T</h1><p>Body.</p><div class="related-posts"><h3>Related</h3><p>Other</p></div><div class="sidebar-left"><p>S</p></div></article>', "T\n\nBody."),
    ('<header class="page-header"><h1>Site</h1><p>motto</p></header><article><h1>T</h1><p>Body.</p></article>', "T\n\nBody."),
])
def test_names_and_quotes(html_, want):
    assert html.trained().extract(f"<html><body><nav><a href=x>Menu</a></nav>{html_}<footer>foot</footer></body></html>") == want


def written_pages(n, seed):
    """Pages by other rules than those of ``labelled_pages``: (html, main text)."""
    rng = random.Random(seed)
    pool = "river stone winter letter morning garden silver engine market teacher window corner simple yellow travel history science people always never".split()

    def line(k):
        return " ".join(rng.choice(pool) for _ in range(k)).capitalize() + "."

    pages = []
    for _ in range(n):
        title, blocks = line(5), []
        body = [f"<h1 itemprop='headline'>{title}</h1>"]
        blocks.append(title)
        for _ in range(rng.randint(3, 12)):
            text = line(rng.randint(6, 50))
            kind = rng.randrange(6)
            blocks.append(text)
            body.append([f"<p>{text}</p>", f"<p dir=ltr>{text}", f"<h2 id=s{rng.randrange(99)}>{text}</h2>", f"<blockquote>{text}</blockquote>", f"<ol><li>{text}</li></ol>", f"<p><em>{text[:4]}</em>{text[4:]}</p>"][kind])
            if rng.random() < 0.15:
                body.append(rng.choice(("<div class='ad-slot'>Buy our things</div>", "<aside><h4>See also</h4><a href=/q>Something else</a></aside>", "<div class='share-buttons'><a href=/s>Share</a></div>", "<form action=/n><label>Mail</label><input name=m></form>")))
        shell = rng.choice(("<article class='post'>%s</article>", "<main role=main><article>%s</article></main>", "<div id='main-content'>%s</div>", "<main>%s</main>", "<div class='page-wrap'><div class='entry-content'>%s</div></div>"))
        top = f"<header id=top><a href=/ class=logo>{line(2)}</a><nav><ul><li><a href=/1>Home</a><li><a href=/2>About us</a></ul></nav></header>"
        notes = "<div class='cookie-banner'><p>We use cookies to help.</p><button>Accept</button></div>" if rng.random() < 0.5 else ""
        talk = f"<section id=comments><h3>2 comments</h3><div class=comment><p>{line(12)}</p></div></section>" if rng.random() < 0.5 else ""
        end = "<footer class=site-footer><p>All rights reserved.</p><a href=/p>Privacy</a></footer>"
        pages.append(("<!doctype html><html><head><title>x</title></head><body>" + top + notes + shell % "".join(body) + talk + end + "</body></html>", "\n\n".join(blocks)))
    return pages


def test_pages_of_another_grammar():
    pages = written_pages(300, 5)
    model = html.trained()
    exact = sum(model.extract(source) == want for source, want in pages) / len(pages)
    assert exact >= 0.95, exact
