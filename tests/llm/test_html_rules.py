"""The block rules: a plain second reading of both passes, pages without telling tags, short blocks at the ends, words that decide."""

import collections
import re

import pytest

from sparkweft.llm import htmltext as H

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def pages(spark):
    return [r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").collect() if r.html]


def plain_labels(page):
    """Each block by itself, its neighbours looked for one by one."""
    apart = H._believed(page)
    region = H._regions(page, apart)
    words = lambda t: re.findall(r"[^\W\d_]+", t.lower())
    density = lambda b: sum(w in H.STOP for w in words(b.text)) / len(words(b.text)) if len(b.text) >= 70 and words(b.text) else 0.0
    linked = lambda b: b.links > 0.33 * len(b.text)
    prose = [b for b in page.blocks if len(b.text) >= 70 and not linked(b) and not b.heading and not apart[b.hint]]
    known = sum(density(b) * len(b.text) for b in prose) >= 0.05 * sum(len(b.text) for b in prose)

    def decide(i):
        b, inside = page.blocks[i], region[i] > 0
        if linked(b):
            return "bad"
        if apart[b.hint] or (any(region) and not inside):
            return "away"
        if len(b.text) < 70 or b.heading:
            return None
        if inside or not known:
            return "good" if len(b.text) >= 200 or (known and density(b) >= 0.12) else None
        return "bad" if density(b) < 0.12 else "good" if density(b) >= 0.20 and len(b.text) > 200 else None

    first = [decide(i) for i in range(len(page.blocks))]
    out = []
    for i, label in enumerate(first):
        if label is None:
            near = [(abs(i - j), first[j]) for j in range(len(first)) if region[j] == region[i] and first[j] in ("good", "bad")]
            least = min((d for d, _ in near), default=None)
            at = {x for d, x in near if d == least}
            # Both sides are as near only if the two labels differ or are alike at one distance.
            label = ("good" if region[i] else "bad") if not near else "good" if "good" in at or (len([d for d, _ in near if d == least]) > 1 and region[i]) else "bad"
        out.append(label == "good")
    return out


def test_both_passes_against_plain(pages):
    untagged = [re.sub(r"<(/?)(article|main)\b", r"<\1div", h) for h in pages]
    unnamed = [re.sub(r'\s(class|id|role)="[^"]*"', "", h) for h in untagged]
    for h in [*pages, *untagged, *unnamed]:
        page = H.parse(h)
        assert [keep for keep, _ in H.judge(page)] == plain_labels(page)


def test_pages_without_article(pages):
    """With div for article and main, less than a hundredth of the blocks goes and none is added."""
    kept = lost = 0
    for h in pages:
        a, b = (collections.Counter(filter(None, H.main_text(x).split("\n"))) for x in (h, re.sub(r"<(/?)(article|main)\b", r"<\1div", h)))
        assert not b - a
        kept, lost = kept + a.total(), lost + (a - b).total()
    assert kept > 1000 and lost < 0.01 * kept


GOOD = "It was the best of the days that we had in all of the years, and it was as if there were no others to come after it for any of us who were there, so that when it was over she and I stood by the door and did not know what to say to them."


def test_short_blocks_at_the_ends_are_kept():
    body = f"<h1>A title</h1><p>Short first.</p><p>{GOOD}</p><p>Short middle.</p><p>{GOOD}</p><p>Short last.</p>"
    want = ["A title", "Short first.", GOOD, "Short middle.", GOOD, "Short last."]
    around = "<div><ul><li><a href=x>One</a></li><li><a href=y>Two</a></li></ul></div>{}<div><a href=z>Imprint and contact</a></div>"
    for tag in ("article", "main", "div", "section"):
        assert H.main_text("<body>" + around.format(f"<{tag}>{body}</{tag}>")).split("\n") == want
        assert H.main_text("<body>" + around.format(f"<div><div><{tag}>{body}</{tag}></div></div>")).split("\n") == want


def test_a_box_leaves_no_title_outside():
    page = f"<body><div><a href=x>Home</a></div><div><h1>A title</h1><div><p>{GOOD}</p><p>{GOOD}</p></div></div>"
    assert H.main_text(page).split("\n") == ["A title", GOOD, GOOD]


def test_stop_words_decide(monkeypatch):
    """Beside prose, a long list of names without stop words goes; without the list of words it stays."""
    names = ", ".join(f"Kensington Palace {w}" for w in "Alpha Bravo Charlie Delta Echo Foxtrot Golf Hotel India Juliet Kilo Lima".split())
    page = f"<body><p>{GOOD}</p><p>{GOOD}</p><table><tr><td>{names}</td></tr></table><p>{GOOD}</p>"
    assert names not in H.main_text(page)
    monkeypatch.setattr(H, "STOP", frozenset())
    assert names in H.main_text(page)
