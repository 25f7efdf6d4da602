"""Buckets in all three ways, hubs, and labels of large classes against plain loops."""

import numpy as np
import pytest

from driftline.llm import common, simhash


def plain(fps, radius=4):
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    groups = {}
    for l, f in zip(label, fps, strict=True):
        groups.setdefault(l, set()).add(f)
    return {frozenset(g) for g in groups.values() if len(g) > 1}


def of_links(links):
    groups = {}
    for node, root in map(tuple, simhash.components(links).collect()):
        groups.setdefault(root, {root}).add(node)
    return {frozenset(x & (1 << 64) - 1 for x in g) for g in groups.values()}


@pytest.mark.parametrize("block, flood", [(4096, 1024), (37, 1024), (37, 1), (5, 8)])
def test_every_way_of_a_hot_bucket_gives_all_pairs(spark, block, flood):
    rng = np.random.default_rng(5)
    centre = int(rng.integers(0, 1 << 63))
    cluster = [centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 9), replace=False)) for _ in range(150)]
    fps = sorted({*cluster, *map(int, rng.integers(0, 1 << 63, 100)), 0, 1, 7, 127, (1 << 64) - 1})
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in fps], "fp long")
    assert of_links(simhash.links(df, block=block, flood=flood)) == plain(fps)


def test_components_with_hubs_looked_up_by_broadcast(spark, monkeypatch):
    rng = np.random.default_rng(6)
    edges = [(0, i) for i in range(1, 200)] + [(int(a), int(b)) for a, b in rng.integers(200, 600, (150, 2))] + [(i, i + 1) for i in range(700, 760)]
    df = spark.createDataFrame(edges, "a long, b long")
    want = sorted(map(tuple, simhash.components(df).collect()))
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert want == sorted((x, find(x)) for x in root if find(x) != x)
    for module in (simhash, common):
        monkeypatch.setattr(module, "HOT_ROWS", 20)
    assert sorted(map(tuple, simhash.components(df).collect())) == want


def test_hot_fingerprints_and_roots(spark, monkeypatch):
    texts = ["", None, "one two three four five six", "one two three four five six", "seven"]
    docs = spark.createDataFrame([(i, texts[i % 5]) for i in range(300)], "doc_id long, text string")
    want = sorted(map(tuple, simhash.near_duplicates(docs).collect()))
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect())) == want
    assert {c for _, _, c in want} == {0, 2, 4}
