"""Main text of pages without an article element: every part of the article is known as the page is made."""

import random

import pytest

from creditloom.llm.html_text import NOT_ARTICLE, main_text, marks

WORDS = "river stone, market paper window, garden letter silver, number winter bridge travel".split()


def prose(dice, least, most):
    return " ".join(dice.choice(WORDS) for _ in range(dice.randint(least, most))) + "."


def part(dice):
    """Markup of one part of an article, and its text."""
    kind = dice.choice("p section ul ol pre blockquote table div h2 text figure dl".split())
    text = prose(dice, 3, 12)
    if kind in ("ul", "ol"):
        other = prose(dice, 1, 5)
        return f"<{kind}><li>{text}<li>{other}</{kind}>", f"{text} {other}"
    if kind == "table":
        other = prose(dice, 1, 5)
        return f"<table><tr><td>{text}<td>{other}</table>", f"{text} {other}"
    if kind == "section":
        return f"<section class=social-science><p>{text}</p></section>", text
    if kind == "figure":
        return f"<figure><figcaption>{text}</figcaption></figure>", text
    if kind == "dl":
        return f"<dl><dt>{text}<dd>{text}</dl>", f"{text} {text}"
    return (f" {text} " if kind == "text" else f"<{kind}>{text}</{kind}>"), text


def furniture(dice):
    return dice.choice([
        "<div class='ad-slot'>Buy</div>", "<div id=sidebar>Side, of some length, too</div>", "<script>x</script>",
        "<ul><li><a href=a>First</a><li><a href=b>Second</a></ul>", "<form><input></form>", "<div class='comment-list'><p>Reader, at length.</p></div>",
        "<div class='socialLinks'>Share this</div>", "<aside>Aside</aside>",
    ])


def page(dice):
    wanted, body = [], []
    for _ in range(dice.randint(3, 12)):
        markup, text = part(dice)
        # Bare text after bare text would be one block; the texts are the same.
        body.append(markup)
        wanted.append(text)
    long = prose(dice, 120, 200)
    at = dice.randrange(len(body) + 1)
    body.insert(at, f"<section><p>{long}</p></section>" if dice.random() < 0.5 else f"<p>{long}</p>")
    wanted.insert(at, long)
    for _ in range(dice.randint(0, 3)):
        body.insert(dice.randrange(len(body) + 1), furniture(dice))
    inner = "".join(body)
    for _ in range(dice.randint(0, 2)):
        inner = f"<div class='{dice.choice(['post', 'entry content', 'market-research'])}'>{inner}</div>"
    return (
        f"<html><head><title>T</title></head><body><header>Site</header><nav><a href=x>Home</a></nav><div>{inner}</div>"
        f"<footer>Foot, and more</footer></body></html>", " ".join(wanted),
    )


@pytest.mark.parametrize("block", range(5))
def test_all_parts_stay_without_article(block):
    dice = random.Random(block)
    for _ in range(80):
        markup, text = page(dice)
        assert main_text(markup) == text, markup


def test_parts_beside_the_best_container():
    long = "Long text, with words, and commas, for the score. " * 8
    parts = "<section><p>Short closing section.</p></section><ul><li>one<li>two</ul><pre>code  x</pre>tail"
    assert main_text(f"<nav>n</nav><div><section>{long}</section>{parts}</div>").endswith("score. Short closing section. one two code x tail")
    assert main_text(f"<div><p>{long}</p></div><div>second</div><table><tr><td>a<td>b</table>").endswith("second a b")
    assert main_text(f"<main><h1>Head</h1><div><p>{long}</p></div><ul><li>one</ul></main><div>Unmarked</div>").endswith("score. one")


def test_points_choose_among_articles():
    long = "Long text, with words, and commas, for the score. " * 20
    teasers = "<article><a href=x><p>Teaser</p></a></article>" * 3
    assert main_text(f"<div>{teasers}</div><div><p>{long}</p><p>{long}</p></div>") == " ".join((long * 2).split())


def test_names_that_mark_furniture():
    for name in ("ad", "ad-300x250", "cookie-consent-banner", "sidebar-left", "socialLinks", "comments-area", "main_nav", "nav2", "comment-body"):
        assert marks(name, NOT_ARTICLE), name
    for name in ("social-science", "post", "reading", "research", "search-and-rescue", "header-image", "", "--"):
        assert not marks(name, NOT_ARTICLE), name
