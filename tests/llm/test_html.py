"""Main text on pages whose names mislead, say nothing or are unknown."""

import random

import numpy as np
import pytest

from driftline.llm import html_main as h
from driftline.llm.common import table

#: Names that no training page carries.
UNSEEN = {
    **h.NAMES, "nav": "hauptmenue index-list wegweiser", "header": "kopf briefkopf", "footer": "fuss impressum", "side": "randspalte nebenbei", "notice": "hinweis zustimmung",
    "ad": "anzeige reklame", "form": "suche anmeldung", "comments": "user-responses meinungen remarks leserbriefe", "related": "mehr siehe-auch", "content": "beitrag haupttext lesestoff", "wrapper": "rahmen huelle",
}
TEXT = "".join(f"<p>This is a sentence number {i} with quite a few words in it, as articles have.</p>" for i in range(5))
LINES = [f"This is a sentence number {i} with quite a few words in it, as articles have." for i in range(5)]


@pytest.fixture(scope="module")
def model(spark):
    return h.fit([r.html for r in table(spark, "/root/testdata/sf0.001", "pages").limit(40).collect()])


def marked(page, model):
    t = h.tree_of(page)
    found = h.marginals(h.features_of(t), np.array(t.parent), np.array(t.depth), model)[:, h.CONTENT]
    return t, [i for i, x in enumerate(t.text) if x is not None], found >= 0.5


@pytest.mark.parametrize("names, speaking", [(h.NAMES, 1.0), (h.NAMES, 0.0), (UNSEEN, 1.0)])
def test_blocks_of_held_out_layouts(model, names, speaking):
    rng, right, extra, lost = random.Random(99), 0, 0, 0
    for _ in range(150):
        t, leaves, kept = marked(h.labelled_page(rng, names, speaking), model)
        for i, want in ((i, h.labels_given(t)[i] == h.CONTENT) for i in leaves):
            right, extra, lost = right + (kept[i] and want), extra + (kept[i] and not want), lost + (want and not kept[i])
    assert right / (right + extra) > 0.9 and right / (right + lost) > 0.9


@pytest.mark.parametrize(
    "page, want",
    [
        (f'<nav><a href="/">Home</a></nav><article class="post share-friendly"><h1>Title</h1>{TEXT}</article>', ["Title", *LINES]),
        (f'<article class="social-policy"><h1>Title</h1>{TEXT}</article><footer>Imprint</footer>', ["Title", *LINES]),
        (f'<section class="print view"><article><h1>Title</h1>{TEXT}</article></section>', ["Title", *LINES]),
        (f'<article><h1>Title</h1>{TEXT}</article><section class="user-responses"><div class="r"><b>Ann</b><p>I do not agree with that at all.</p></div><div class="r"><b>Bob</b><p>Nice read, thanks for it.</p></div></section>', ["Title", *LINES]),
        ("<article><p data-x=it's>Don't lose me here.</p><p>Second one's here.</p></article>", ["Don't lose me here.", "Second one's here."]),
        (f'<div class="kopf"><a href="/">Home</a></div><div class="beitrag"><h1>Title</h1>{TEXT}</div><div class="fuss"><a href="/i">Imprint</a></div>', ["Title", *LINES]),
    ],
)
def test_no_single_word_decides(model, page, want):
    t, leaves, kept = marked(f"<html><body>{page}</body></html>", model)
    assert [t.text[i] for i in leaves if kept[i]] == want


def test_attributes_end_where_html_says():
    for page, names, text in (("<p class=a'b>x", "a'b", "x"), ('<p title="a>b" class=\'c d\'>x', "c d", "x"), ("<p class=>x", "", "x"), ('<p class="open>x</p>', "open", "x"), ("<p a=b/c id=q>x", "q", "x")):
        t = h.tree_of(page)
        assert (t.names[1], t.text[2]) == (names, text)


def test_long_pages_are_learned_from_and_extracted(spark):
    long = "<html><body><nav><a>x</a></nav><article><h1>Long</h1>" + TEXT * 30_000 + "</article></body></html>"
    df = spark.createDataFrame([(1, "u", long, 3), (2, None, None, 3)], "page_id long, url string, html string, n_chars int")
    got = {r.page_id: r for r in h.main_text(df).collect()}
    assert len(long) > 10_000_000 and got[1].text == "\n".join(["Long", *LINES * 30_000]) and (got[2].text, got[2].n_chars) == ("", 0)
