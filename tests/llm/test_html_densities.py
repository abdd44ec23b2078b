"""Densities decide what is prose; names of elements and classes only weigh."""

import re

import duckdb
import pytest

from postmill.llm import html_text

PROSE = "This is the first paragraph of the article and it has many of the usual words that are in the language."
LIST = "Zinc copper iron nickel cobalt silver gold platinum palladium rhodium iridium osmium ruthenium mercury."


@pytest.fixture(scope="module")
def pages():
    return [page for (page,) in duckdb.connect().execute("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()]


def unnamed(page: str, names: str) -> str:
    return re.sub(rf"<(/?)(?:{names})\b", r"<\1div", page)


def test_pages_without_their_names(pages):
    """The same texts where no article is marked, and nearly always where no element or class tells anything."""
    wanted = [html_text.main_text(page) for page in pages]
    assert [html_text.main_text(unnamed(page, "article|main")) for page in pages] == wanted
    bare = [re.sub(' class="[^"]*"', "", unnamed(page, "article|main|nav|footer|header|aside")) for page in pages]
    assert sum(html_text.main_text(page) == text for page, text in zip(bare, wanted)) >= 230


@pytest.mark.parametrize("density", [0.0, 1.0])
def test_stop_words_decide(pages, monkeypatch, density):
    """With a fixed density pages change; without link density menus come in."""
    bare = [re.sub(' class="[^"]*"', "", unnamed(page, "article|main|nav|footer|header|aside")) for page in pages[:60]]
    wanted = [html_text.main_text(page) for page in bare]
    page = f"<div><p>{PROSE}</p><p>{LIST}</p></div><div><p>{LIST}</p></div><div><a href=x>{PROSE}</a></div>"
    assert html_text.main_text(page) == f"{PROSE} {LIST}"
    monkeypatch.setattr(html_text, "LINKS", 2)
    assert html_text.main_text(page).count(PROSE) == 2
    monkeypatch.undo()
    monkeypatch.setattr(html_text, "_density", lambda text: density)
    changed = sum(html_text.main_text(page) != text for page, text in zip(bare, wanted))
    assert (changed > 0 or not density) and html_text.main_text(page) != f"{PROSE} {LIST}"


def test_names_inside_an_article():
    keep = ["social-history", "hidden-figures", "menu-engineering", "banner-year", "notice", "comment", "related-work"]
    drop = ["comments", "comment-list", "ad", "ads top", "cookie-notice", "newsletter-box", "share-buttons", "socialLinks", "sidebar"]
    for name in keep + drop:
        page = f'<nav><a href=x>a</a></nav><article><p>{PROSE}</p><section class="{name}"><p>{PROSE}</p></section></article>'
        assert html_text.main_text(page) == " ".join([PROSE] * (1 + (name in keep))), name


def test_an_article_of_little_prose_is_not_trusted():
    page = f"<article><p>A teaser of this.</p></article><div><h1>Title</h1><p>{PROSE}</p><p>{PROSE} And more of it.</p></div><footer>{PROSE}</footer>"
    assert html_text.main_text(page).endswith(f"Title {PROSE} {PROSE} And more of it.")
    page = f"<div><p>{PROSE}</p></div><article><h1>Title</h1><p>{PROSE}</p><p>Short.</p><p>{PROSE}</p><p>End.</p></article><div><p>More.</p></div>"
    assert html_text.main_text(page) == f"Title {PROSE} Short. {PROSE} End."
    assert html_text.main_text("<nav>Menu</nav><article><p>Only this.</p></article><footer>Foot</footer>") == "Only this."


def test_neighbours_of_the_same_part():
    """Short blocks follow the prose of their own part of the page, not a nearer block of another."""
    page = f"<div><ul><li><a href=x>Menu</a></ul></div><div><h1>Title</h1><p>{PROSE}</p><p>Last words.</p></div><div>© 2020 somebody, with all of the rights that are reserved to the owner of it</div>"
    assert html_text.main_text(page) == f"Title {PROSE} Last words."
