"""Tables, lists of links, formulas, odd comments, scripts and plain text, by the whole operator."""

import random

import numpy as np

from driftline.llm import html_main as h
from driftline.llm.common import table

TEXT = "".join(f"<p>This is a sentence number {i} with quite a few words in it, as articles have.</p>" for i in range(5))
LINES = [f"This is a sentence number {i} with quite a few words in it, as articles have." for i in range(5)]
PAGES = {
    f"<nav><a href=/>Home</a></nav><article><h1>T</h1>{TEXT}<table><tr><td>1900</td><td>30 t</td></tr></table></article>": ["T", *LINES, "1900", "30 t"],
    f"<article><h1>T</h1>{TEXT}<ul><li><a href=x>Linked item</a></li><li>Plain item</li></ul></article>": ["T", *LINES, "Linked item", "Plain item"],
    f"<article><h1>T</h1><p>The value <math><mi>x</mi><mo>=</mo><mspace/><mn>2</mn></math> is known.</p>{TEXT}</article>": ["T", "The value x=2 is known.", *LINES],
    f"<article><h1>T</h1><p>So <math><semantics><mi>y</mi><annotation>\\y</annotation></semantics></math> it is.</p>{TEXT}</article>": ["T", "So y it is.", *LINES],
    f"<article><h1>T</h1><!--><p>After an odd comment.</p>{TEXT}<!-- x --!><p>And another.</p><!---><p>Third.</p></article>": ["T", "After an odd comment.", *LINES, "And another.", "Third."],
    f"<article><h1>T</h1><script src='x'/>var leak=1;</script><iframe/>in a frame</iframe>{TEXT}<svg/></article>": ["T", *LINES],
    f"<article><h1>T</h1>{TEXT}<pre>code here\n  more</pre><figure><img><figcaption>A caption</figcaption></figure><dl><dt>Term</dt><dd>Meaning of it</dd></dl></article>": ["T", *LINES, "code here more", "A caption", "Term", "Meaning of it"],
}


def test_nothing_is_lost_and_nothing_leaks(spark):
    model = h.fit([r.html for r in table(spark, "/root/testdata/sf0.001", "pages").limit(40).collect()])
    rows = [(i, f"<html><body>{page}</body></html>") for i, page in enumerate(PAGES)] + [(90, "Just plain text &amp; no tags.\nSecond line."), (91, ""), (92, None), (93, "<!-- only a comment -->")]
    got = {r.page_id: (r.text, r.n_chars) for r in h.extract(spark.createDataFrame([(i, None, p) for i, p in rows], "page_id long, url string, html string"), model).collect()}
    for i, want in enumerate(PAGES.values()):
        assert got[i][0].split("\n") == want
    assert got[90] == ("Just plain text & no tags. Second line.", 39) and got[91] == got[92] == got[93] == ("", 0)
    # the new layouts, held out
    rng, right, extra, lost = random.Random(77), 0, 0, 0
    for _ in range(200):
        t = h.tree_of(h.labelled_page(rng, h.NAMES, rng.random()))
        kept = h.marginals(h.features_of(t), np.array(t.parent), np.array(t.depth), model)[:, h.CONTENT] >= 0.5
        state = h.labels_given(t)
        for i in (i for i, x in enumerate(t.text) if x is not None and t.tag[t.parent[i]] in ("td", "th", "dt", "dd", "li", "pre", "figcaption")):
            want = state[i] == h.CONTENT
            right, extra, lost = right + (kept[i] and want), extra + (kept[i] and not want), lost + (want and not kept[i])
    assert right > 300 and right / (right + extra) > 0.9 and right / (right + lost) > 0.9, (right, extra, lost)
