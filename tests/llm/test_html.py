"""Main text of pages: element names, link lists, omitted ends, and features by hand."""

import numpy as np
import pytest

from kinetable.llm import html_text as ht

TREE = ht.grow()
LONG = "The committee met on Tuesday to consider the plans for the new bridge, which many residents of the town still oppose. " * 3


def page(inner, before="", after=""):
    return f"<body><nav><ul><li><a href=x>Home</a></li><li><a href=y>News</a></li></ul></nav>{before}<article><h1>The title here</h1><p>{LONG}</p>{inner}<p>{LONG}</p></article>{after}<footer>All rights reserved by us.</footer></body>"


def test_the_tree_fits_its_table_and_asks_for_text():
    x = ht.training_table()
    assert ((TREE.predict(x[:, :-1]) >= 0.5) == (x[:, -1] == 1)).all()
    found = ht.blocks(page("<p>Some more words in the article.</p>" * 4))
    assert ht.decided_by_text(TREE, ht.features(found, True)).mean() > 0.5


@pytest.mark.parametrize("name", ["advice-column", "formats", "navy-blue", "advantages", "alerting", "legal-history", "header-image-wrap", "adventure", "footnote-free"])
def test_text_in_elements_with_harmless_names_stays(name):
    assert ht.main_text(page(f'<div class="{name}"><p>Own {LONG}</p></div>'), TREE).count("committee") == 9


@pytest.mark.parametrize("name", ["comments", "comment-list comments", "site-sidebar", "ad", "cookie-notice", "newsletter", "main nav", "share"])
def test_boilerplate_elements_go_whatever_their_length(name):
    got = ht.main_text(page(f'<div class="{name}"><p>Gone {LONG}</p></div>'), TREE)
    assert "Gone" not in got and got.count("committee") == 6


def test_link_lists_go_and_single_links_stay():
    links = "<ul>" + "".join(f"<li><a href=/{i}>Link number {i}</a></li>" for i in range(6)) + "</ul>"
    assert "Link number" not in ht.main_text(page(links), TREE)
    assert "See the full report" in ht.main_text(page("<p><a href=x>See the full report</a></p>"), TREE)


def test_omitted_ends_and_ends_without_a_start():
    assert [b.text for b in ht.blocks("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><table><tr><td>1<td>2<tr><th>3</table><dl><dt>x<dd>y<dt>z</dl><p>p<div>q</div>r")] == list("abcd123xyzpqr")
    assert ht.main_text(page("<ul><li>one point<li>two points</ul></q></section></span>"), TREE).count("committee") == 6
    # twenty thousand elements left open: the article's state still holds, and its end still restores it
    deep = "<article>" + "<li>point <div>" * 20_001 + f"<p>{LONG}</p></article><p>behind it</p>"
    got = ht.main_text(deep, TREE)
    assert got.count("point") == 20_001 and got.count("committee") == 3 and "behind it" not in got
    comments = f'<article><p>{LONG}</p><div class="comments">' + "<li>said <div>" * 20_001 + f"</div></div></article><article><p>Then {LONG}</p></article>"
    assert "said" not in ht.main_text(comments, TREE)


def test_features_by_hand():
    found = ht.blocks('<div class="ad-slot">one two</div><article><h2>three</h2><p>four <a>five six</a> seven</p></article>')
    assert np.allclose(ht.features(found, True), [[2, 0, 0, 0, 1, 0, 1, 0, 1, 0], [1, 0, 2, 0, 4, 0.5, 0, 1, 1, 1], [4, 0.5, 1, 0, 0, 0, 0, 1, 1, 0]])


def test_name_hints():
    assert [ht.name_hint(n) for n in ("", "ad", "top-nav", "nav-item big", "advice", "site_footer", "headers", "Comments", "col2 ads1")] == [0, 2, 2, 1, 0, 2, 0, 2, 1]
