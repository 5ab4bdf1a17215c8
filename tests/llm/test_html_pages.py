"""Main text of hand-marked pages. In each, what is to be kept stands in [[ ]]; the marks are taken out of the page."""

import html
import re
import time
from collections import Counter

import pytest

from sparkweft.llm import htmltext

EN = "It is one of the things that were said of the old town, and there was a time when all of the people who had been there for years had it in their minds as well, with the rest of what they were told by those who came from the hills."
EN2 = "The river that is by the mill was not on the map, but it had been there for as long as they had, and when the winter was over it would come down with all of the snow that was on the hills and be in every cellar of the town."
FR = "Il est dans la vie des gens qui ont vu la mer un moment où ils ne sont pas tout à fait les mêmes, et ce que nous avons dit sur les bateaux du port n'est pas pour eux ce que les autres en ont pu lire dans les livres de la ville."
DE = "Es ist nicht so, dass die Leute in der Stadt nur noch von dem Fluss und der Mühle wie von einer alten Zeit zu sprechen haben, denn es war auch für sie ein Jahr, in dem das Wasser über die Wege und in die Häuser kam und bis zum Mai nicht mehr ging."
ES = "La casa que está en el camino de los molinos no es de las que se ven desde la plaza, pero todo el pueblo sabe que hay en ella más de lo que dicen los que han ido por allí, y que el dueño no está para nadie cuando es de noche."
LA = "Gallia omnia divisa partes tres quarum unam incolunt Belgae aliam Aquitani tertiam lingua Celtae nostra Galli appellantur hi omnes lingua institutis legibus inter differunt Gallos Aquitanis Garumna flumen Belgis Matrona Sequana dividit."
SHORT = "So it was in the end."
NAV = '<ul><li><a href="/">Home</a></li><li><a href="/a">About the town</a></li><li><a href="/b">All of the news that we have for you</a></li></ul>'
DIVNAV = '<div><a href="/">Home</a> | <a href="/a">About the town</a> | <a href="/b">Contact us</a></div>'
AD = "It is the best of all the offers that we have had for you and it is here for as long as there are some of them in the store."
FOOT = "&copy; 2024 The Town News. All rights reserved."

PAGES = {
    "article": f"<nav>{NAV}</nav><article><h1>[[The mill]]</h1><p>[[{EN}]]</p><p>[[{SHORT}]]</p></article><footer>{FOOT}</footer>",
    "no article": f"<nav>{NAV}</nav><h1>[[The mill]]</h1><p>[[{EN}]]</p><p>[[{EN2}]]</p><footer>{FOOT}</footer>",
    "no article, short between": f"{DIVNAV}<div><h1>[[The mill]]</h1><p>[[{EN}]]</p><p>[[{SHORT}]]</p><p>[[{EN2}]]</p></div>{DIVNAV}",
    "only divs": f"<div>{DIVNAV}</div><div>[[{EN}]]<br><br>[[{EN2}]]</div><div>{DIVNAV}</div>",
    "no telling names": f'<div class="x1">{DIVNAV}</div><div class="x2"><p>[[{EN}]]</p><p>[[{EN2}]]</p></div><div class="x3">{NAV}</div>',
    "teasers as articles": f'<main><h1>[[The mill]]</h1><p>[[{EN}]]</p><p>[[{EN2}]]</p></main><article><h3><a href="1">The river in the winter</a></h3><p>In the hills it is cold.</p></article><article><h3><a href="2">More</a></h3><p>Of the sea.</p></article>',
    "teasers, no main": f'<h1>[[The mill]]</h1><p>[[{EN}]]</p><p>[[{EN2}]]</p><div><article><a href="1">The river in the winter and in the spring</a></article><article><a href="2">What there was of the sea</a></article></div>',
    "teasers after the article": f'<article><h1>[[The mill]]</h1><p>[[{EN}]]</p><p>[[{EN2}]]</p></article><article><h3><a href="1">The river</a></h3><p>It is by the mill of the town.</p></article>',
    "several articles": f"<article><h2>[[One]]</h2><p>[[{EN}]]</p></article><article><h2>[[Two]]</h2><p>[[{EN2}]]</p></article>",
    "ad beside the article, no class": f"<div>{AD}</div><article><h1>[[The mill]]</h1><p>[[{EN}]]</p></article><div>{AD}</div>",
    "ad in the article": f'<article><p>[[{EN}]]</p><div class="ad">{AD}</div><p>[[{EN2}]]</p></article>',
    "ad by id": f'<p>[[{EN}]]</p><div id="sponsored">{AD}</div><p>[[{EN2}]]</p>',
    "wrapper named with-sidebar": f'<div class="layout with-sidebar"><div class="c"><h1>[[The mill]]</h1><p>[[{EN}]]</p><p>[[{EN2}]]</p></div><div class="sidebar"><p>{AD}</p></div></div>',
    "body class": f'<body class="has-comments has-sidebar"><article><p>[[{EN}]]</p></article><aside><p>{AD}</p></aside></body>',
    "article class comments-open": f'<article class="post comments-open"><h1>[[The mill]]</h1><p>[[{EN}]]</p></article><footer>{FOOT}</footer>',
    "page in a form": f'<form action="/x"><input type="hidden" name="v"><div>{DIVNAV}</div><h1>[[The mill]]</h1><p>[[{EN}]]</p><p>[[{EN2}]]</p><button>Send it</button></form>',
    "form in the article": f'<article><p>[[{EN}]]</p><form><label>Your name</label><input><p>We have a letter for you that is sent when it is time.</p><textarea>x</textarea><select><option>One</option></select></form><p>[[{SHORT}]]</p></article>',
    "comments": f'<article><p>[[{EN}]]</p></article><section id="comments"><h3>2 comments</h3><div class="comment"><p>{EN2}</p></div><div class="comment"><p>{AD}</p></div></section>',
    "comments in the article": f'<article><h1>[[The mill]]</h1><p>[[{EN}]]</p><p>[[{EN2}]]</p><div class="comments"><article class="comment"><p>{AD}</p></article></div></article>',
    "comments without article": f'<h1>[[The mill]]</h1><p>[[{EN}]]</p><p>[[{EN2}]]</p><ol class="comment-list"><li><p>{AD}</p></li></ol>',
    "cookie notice": f'<div class="cookie-notice"><p>{AD}</p><button>OK</button></div><article><p>[[{EN}]]</p></article>',
    "header with title in the article": f"<header><h2>The Town News</h2><p>{AD}</p></header><article><header><h1>[[The mill]]</h1></header><p>[[{EN}]]</p></article>",
    "aside and dialog": f"<dialog><p>{AD}</p></dialog><article><p>[[{EN}]]</p><aside><p>{AD}</p></aside><p>[[{EN2}]]</p></article>",
    "scripts and styles": f'<head><title>The mill</title><style>p {{ a: b }}</style></head><script>if (a < b) document.write("<p>{AD}</p>")</script><noscript>It is off.</noscript><p>[[{EN}]]</p><!-- <p>{AD}</p> --><template><p>{AD}</p></template>',
    "links inside text": f'<article><p>[[It is one of the things that are to be read in <a href="x">the book</a> of the town, where there is more of it than we have here.]]</p><p><a href="y">The next one of them</a> <a href="z">and the one before it</a></p></article>',
    "french": f"<nav>{NAV}</nav><div><p>[[{FR}]]</p><p>[[{FR}]]</p></div>",
    "german": f"<div><h1>[[Die Mühle]]</h1><p>[[{DE}]]</p></div><footer><p>{DE}</p></footer>",
    "spanish": f'<div class="a"><p>[[{ES}]]</p></div><div class="nav">{ES}</div>',
    "language without a list": f"{DIVNAV}<p>[[{LA}]]</p><p>[[{LA}]]</p>{DIVNAV}",
    "keywords, no prose": f"<p>[[{EN}]]</p><p>[[{EN2}]]</p><div>shoes boots sandals sneakers trainers slippers loafers pumps clogs heels wedges flats moccasins brogues oxfords</div>",
    "entities and white space": f"<article><p>[[{EN}]]</p><p>[[Fish &amp; chips &lt;3 caf&eacute;\n\t  and&nbsp;tea &#8212; it is all of it.]]</p></article>",
    "open paragraphs": f"<article><h1>[[The mill]]<p>[[{EN}]]<p>[[{SHORT}]]<p>[[{EN2}]]</article><footer>{FOOT}",
    "stray end tags": f"</div></p><article></b><p>[[{EN}]]</p></div></article></section><footer>{FOOT}</footer>",
    "hidden": f"<article><p>[[{EN}]]</p><div hidden><p>{AD}</p></div><p hidden>{AD}</p></article>",
    "cut off": f'<article><p>[[{EN}]]</p><p>[[{SHORT}]]</p><img alt="x" src="',
    "main with related": f'<main><article><p>[[{EN}]]</p><p>[[{EN2}]]</p></article><section><h2>More of it</h2><p>It is here that there are more.</p></section></main>',
    "short text among links": f"<p>[[{EN}]]</p><p>[[{EN2}]]</p>{DIVNAV}<p>Follow us here.</p>{DIVNAV}",
    "nothing": f"<nav>{NAV}</nav><footer>{FOOT}</footer>",
}


def plain(part: str) -> str:
    return " ".join(html.unescape(re.sub(r"<[^>]*>", "", part)).split())


@pytest.mark.parametrize("name", PAGES)
def test_page(name):
    page = PAGES[name]
    want = "\n".join(plain(x) for x in re.findall(r"\[\[(.*?)\]\]", page, re.S))
    for wrapped in (page, f"<!DOCTYPE html><html><body>{page}</body></html>" if "<body" not in page and name != "cut off" else page):
        assert htmltext.main_text(wrapped.replace("[[", "").replace("]]", "")) == want


def test_every_rule_rejects():
    """Each rule of the first pass, and the second pass, rejects blocks of these pages."""
    found = Counter(rule for p in PAGES.values() for keep, rule in htmltext.judge(htmltext.parse(p.replace("[[", "").replace("]]", ""))) if not keep)
    assert set(found) >= {"links", "markup", "outside", "stop words", "neighbours"}, found


@pytest.mark.parametrize("piece", ['<a title="x ', "<i ", "<b><i>", "</u>", "<aside>", "<!--", "<!", '<p>a<b class="x>', "<script ", "<td>", "<a href='\"'>x</a>", "&amp", "<div class='ad"])
def test_broken_pages_take_linear_time(piece):
    began = time.process_time()
    htmltext.main_text(piece * (1_000_000 // len(piece)))
    assert time.process_time() - began < 2
