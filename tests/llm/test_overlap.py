"""Near copies by shingle similarity against all pairs."""

import random

import numpy as np

import corpus_pipeline as cp
from driftline.llm import overlap, simhash
from driftline.llm.simhash import components


def similarity(a, b):
    a, b = ({tuple(t.lower().split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in (a, b))
    return len(a & b) / len(a | b)


def planted():
    """Ten texts of 200 words, each with a copy of similarity 0.8 to 0.95 and one below 0.75."""
    draw = random.Random(5)
    rows = []
    for i in range(10):
        words = [f"w{draw.randrange(5000)}" for _ in range(200)]
        near, far = list(words), list(words)
        for k in range(1 + i % 3):
            near[20 + 50 * k] = "changed"
        for k in range(10):
            far[10 + 18 * k] = "changed"
        rows += [(3 * i, " ".join(words)), (3 * i + 1, " ".join(near)), (3 * i + 2, " ".join(far))]
    return rows


def test_pipeline_drops_copies_from_eight_tenths_on(spark):
    rows = planted()
    assert all(0.8 <= similarity(rows[i][1], rows[i + 1][1]) <= 0.96 and similarity(rows[i][1], rows[i + 2][1]) < 0.75 for i in range(0, 30, 3))
    docs = spark.createDataFrame([(i, t, "l", "s", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(r.doc_id for r in dict(cp.STAGES)["near_duplicates"](spark, docs, "").collect())
    assert got == [i for i, _ in rows if i % 3 != 1]


def test_near_copies_equal_all_pairs(spark):
    rows = [*planted(), (100, None), (101, " \n"), (102, "One two"), (103, "one  TWO"), (104, "one three"), (None, "one two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in overlap.near_copies(docs).collect()}
    assert got == {i: i - i % 3 + (2 if i % 3 == 2 else 0) for i in range(30)} | {100: 100, 101: 100, 102: 102, 103: 102, 104: 104, None: 102}
    assert overlap.near_copies(docs.limit(0)).count() == 0
    own = overlap.keyed(docs)
    pairs = lambda block: {frozenset(r) for r in overlap.links(docs, own, block).collect()}
    assert pairs(1) == pairs(1024)  # chunks of one set meet each other too


def test_sketches_chain_what_simhash_links(spark):
    """sketched() against all pairs of fingerprints; a fingerprint shared by sets, a pair within four bits, a chain, strangers."""
    fps = {1: 0b1, 2: 0b1, 3: 0b11110, 4: 0xFFFF << 40, 5: (0xFFFF << 40) | 0b1111, 6: 0xFFFFF << 20, 7: (0xFFFF << 40) | 0b11111111, 8: 0b1 << 63}
    rows = [(s, s, fp - (1 << 64) if fp >> 63 else fp, [1]) for s, fp in fps.items()]
    own = spark.createDataFrame([*rows, (9, 9, 0, [])], "doc_id long, set_id long, fp long, bands array<long>")  # no words: no candidate
    group = {r.node: r.root for r in components(overlap.sketched(own)).collect() if r.node in fps}
    found = {frozenset(s for s in group if group[s] == root) for root in group.values()}
    label = {s: s for s in fps}
    for a in fps:
        for b in fps:
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                label = {s: label[a] if v == label[b] else v for s, v in label.items()}
    want = {frozenset(s for s in fps if label[s] == v) for v in label.values()}
    assert found == {g for g in want if len(g) > 1}


def test_fingerprint_of_a_set():
    text = " ".join(f"w{i}" for i in range(500))  # no shingle twice: the set's SimHash is the text's
    assert overlap.fingerprint(overlap.shingles(text)) == simhash.fingerprint(text, 5) != 0 == overlap.fingerprint(overlap.shingles(" "))


def test_chains_within_a_block():
    base = np.arange(100, dtype=np.uint64)
    chain = [base + np.uint64(10 * i) for i in range(20)]
    assert overlap.joined(chain).max() == 0 and not overlap.alike(chain[0], chain[2])
