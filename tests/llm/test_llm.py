"""The training-data operators against brute force, on odd rows and small tables."""

import collections
import hashlib
import math
import re
import struct
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from driftline.llm import hmm, html_main, matroska, merkle, mixing, pieces, pii, quality, simhash, warc
from driftline.llm.common import table

SMALL = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977} is {i}" for i in range(9000))
ODD = [
    (1, "One two three four five.\nSix seven eight.", "a"), (2, "One two three four five.\nSix seven eight.", None), (2, "One two three four five.\nSix seven eight.", None),
    (3, "", "a"), (4, None, "b"), (5, "   \n\t ", "b"), (6, LONG, "a"), (7, "é漢字😀 ▁ <s> mail a@b.co, 10.0.0.255, +1 (555) 123-4567, 4111 1111 1111 1111", "c"), (None, "no id here", None),
    (9, "x" * 5000, "c"), (10, "\n\nA\n\n\nB\n", "c"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, s, "spam", len(t or ""), 1, "x") for i, t, s in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, key int, fp string")


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def test_merkle_next_and_edits(spark, odd, none):
    got = {(r.doc_id, r.text): r for r in merkle.fingerprint_documents(odd).collect()}
    rows = sorted(((i, t or "") for i, t, _ in ODD), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    for k, (i, t) in enumerate(rows):
        if i != 2:
            after = rows[(k + 1) % len(rows)][1]
            h = len(t) // 2
            assert got[i, t].next_text == after and got[i, t].edited == t[: len(t) - h] + after[:h]
    node = lambda x: hashlib.sha256(x.encode()).hexdigest()
    leaves = lambda p: [node(x)[:32] for x in re.sub(merkle.CUT, "\\1\n", p).split("\n") if x]
    root = lambda t: node("".join(node("".join(node("".join(leaves(p))) for p in s.split("\n"))) for s in t.split("\n\n")))
    for i, t, _ in ODD:
        assert got[i, t or ""].own.root == root(t or "") and sorted(got[i, t or ""].own.leaves) == sorted({x for p in (t or "").split("\n") for x in leaves(p)})
    assert got[1, ODD[0][1]].own.root == got[2, ODD[1][1]].own.root
    assert merkle.fingerprint_documents(none).count() == 0
    one = merkle.fingerprint_documents(odd.where("doc_id = 10")).first()
    assert one.next_text == one.text


def test_next_key_crosses_levels(spark):
    ids = sorted({-(1 << 62), -5, -1, 0, 1, 255, 256, 1 << 20, 1 << 40, (1 << 62) + 3})
    got = {r.k: r.next_key for r in merkle.next_key(spark.createDataFrame([(i,) for i in ids], "k long"), "k", 4).collect()}
    assert got == dict(zip(ids, [*ids[1:], None], strict=True))


def plain_fingerprint(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(rows, radius=4):
    fps = [plain_fingerprint(t or "") for _, t in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= radius and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    first = {}
    for l, (i, _) in zip(label, rows, strict=True):
        if i is not None:
            first[l] = min(first.get(l, i), i)
    return [(i, f"{f:016x}", first.get(l)) for l, f, (i, _) in zip(label, fps, rows, strict=True)]


def test_simhash_groups(spark, odd, none):
    assert sorted(map(str, map(tuple, simhash.near_duplicates(odd).collect()))) == sorted(map(str, plain_groups([(i, t) for i, t, _ in ODD])))
    assert simhash.near_duplicates(none).count() == 0
    docs = table(spark, SMALL, "documents")
    want = plain_groups([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(map(tuple, simhash.op3_simhash(spark, SMALL).collect())) == sorted(want)


def test_bit_sliced_distances():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    a[100:200] = a[0] ^ (np.uint64(1) << rng.integers(0, 64, 100).astype(np.uint64))
    for radius in (0, 3, 4, 7):
        assert (simhash.within(a[:70], a, radius) == (np.bitwise_count(a[:70, None] ^ a[None, :]) <= radius)).all()


def test_hot_bucket_is_split_exactly(spark):
    rng = np.random.default_rng(1)
    fps = np.unique((np.uint64(0xABCDEF) << np.uint64(40)) ^ rng.integers(0, 1 << 14, 400, dtype=np.uint64)).view(np.int64)
    df = spark.createDataFrame([(int(x),) for x in fps], "fp long")
    whole, split = (dict(map(tuple, simhash.components(simhash.links(df, block=b)).collect())) for b in (4096, 37))
    assert whole == split


def plain_spans(t):
    out, t = [], t or ""
    patterns = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))
    for k, (kind, p) in enumerate(patterns):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, kind, m.end()))
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(out))


def test_pii_base_spans_and_masks(spark, odd, none, tmp_path):
    more = ["a@b.c_x@d.e 1.2.3.4.5.6.7.8 300.1.1.1 0255.00.1.9999", "9" * 4000, "1.1.1.1" * 300, "@@a@b.c@d.e@f.g +1234567890123456789 +1-2-3-4-5-6-7-8-9-( 4 -", "4111-1111-1111-1111-1 x4111111111111111y"]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame([(100 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    texts = {i: t for i, t, _ in ODD} | {100 + i: t for i, t in enumerate(more)}
    for r in pii.op4_pii(spark, str(tmp_path)).collect():
        want = plain_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))
    assert pii.find_pii(none).count() == 0
    found = pii.with_candidates(odd)
    masked = pii.with_spans(found, pii.fit(found)).select("doc_id", pii.mask(F.coalesce("text", F.lit("")), F.col("spans")).alias("m")).where("doc_id = 7").first().m
    assert masked == "é漢字😀 ▁ <s> mail [EMAIL], [IP], [PHONE], [CARD]"


def test_mixing_targets_and_bounds(spark, odd, none):
    assert mixing.targets([("b", 10), ("a", 100), (None, 50)]) == {"a": pytest.approx(goal("a")), "b": pytest.approx(goal("b")), None: pytest.approx(goal(None))}
    docs = table(spark, SMALL, "documents")
    rows = mixing.mix(docs).collect()
    taken, targets_, top = collections.Counter(), {}, collections.Counter()
    words = {r.doc_id: len(r.text.encode().split()) for r in docs.collect()}
    for r in rows:
        assert 0 <= r.copies <= 2 and r.size == words[r.doc_id]
        taken[r.source] += r.copies * r.size
        targets_[r.source] = r.target
        top[r.source] = max(top[r.source], r.size)
    assert sum(targets_.values()) == pytest.approx(1.5 * sum(words.values()))
    assert all(abs(taken[s] - t) <= max(0.1 * t, 10) for s, t in targets_.items())
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs).collect()))
    assert mixing.mix(odd).count() == len(ODD) and mixing.mix(none).count() == 0


def goal(source):
    size, w = {"a": 100, "b": 10, None: 50}, {"a": 5.0, "b": 2.0, None: 1.0}
    left, free, out = 240.0, ["a", "b", None], {}
    while free:
        each = left / sum(w[s] for s in free)
        full = [s for s in free if each * w[s] >= 2 * size[s]]
        if not full:
            return (out | {s: each * w[s] for s in free})[source]
        for s in full:
            out[s], left = 2.0 * size[s], left - 2 * size[s]
            free.remove(s)
    return out[source]


def plain_likelihood(model, codes):
    """Sum over all state paths."""
    k = len(model.start)
    total = 0.0
    for path in np.ndindex(*[k] * len(codes)):
        p = model.start[path[0]] * model.emit[codes[0], path[0]]
        for a, b, c in zip(path, path[1:], codes[1:], strict=False):
            p *= model.move[a, b] * model.emit[c, b]
        total += p
    return math.log(total)


def test_forward_and_expected_counts_are_exact():
    rng = np.random.default_rng(2)
    model = hmm.Model(*(x / x.sum(axis=a, keepdims=True) for x, a in ((rng.random(3), 0), (rng.random((3, 3)), 1), (rng.random((hmm.CLASSES, 3)), 0))))
    lengths = np.array([6, 4, 4, 1])
    codes = rng.integers(0, 50, int(lengths.sum()))
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    got = hmm.forward(model, codes, starts, lengths)
    assert got == pytest.approx([plain_likelihood(model, codes[a : a + n]) for a, n in zip(starts, lengths, strict=True)])
    into = (np.zeros(3), np.zeros((3, 3)), np.zeros((hmm.CLASSES, 3)))
    assert hmm.expect(model, codes, starts, lengths, into) == pytest.approx(got.sum())
    assert into[0].sum() == pytest.approx(4) and into[1].sum() == pytest.approx(11) and into[2].sum() == pytest.approx(15)
    step = 1e-6  # expected moves are derivatives of the log likelihood by the log of the move's probability
    moved = hmm.Model(model.start, model.move.copy(), model.emit)
    moved.move[0, 1] *= 1 + step
    assert (hmm.forward(moved, codes, starts, lengths).sum() - got.sum()) / step == pytest.approx(into[1][0, 1], rel=1e-3)


def test_lm_scores(spark, odd, none):
    docs = table(spark, SMALL, "documents").select("doc_id", "text").union(odd.select("doc_id", "text"))
    local = [(r.doc_id, r.text) for r in docs.collect()]
    split = lambda t: [*(t or "").encode().lower().split(), b""]
    trained = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 != 0
    c = collections.Counter(w for i, t in local if trained(i) for w in split(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), not trained(i), len(split(t)), sum(c[w] > 0 for w in split(t)), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in split(t)), 6)) for i, t in local)
    rows = hmm.score_documents(docs).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == want
    kept = [r for r in rows if r.held_out]
    assert sum(r.score for r in kept) > sum(r.base_score for r in kept) and all(math.isfinite(r.score) for r in rows)
    assert hmm.score_documents(none).count() == 0


def test_html_on_pages_and_layouts(spark):
    pages = table(spark, SMALL, "pages")
    import html as entities

    got = {r.page_id: r for r in html_main.main_text(pages).collect()}
    for r in pages.collect():
        inner = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        blocks = [" ".join(entities.unescape(re.sub(r"<br>|</?b>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r.page_id].text == "\n".join(b for b in blocks if b) and got[r.page_id].n_chars == len(got[r.page_id].text)
    odd = [(1, "u", None), (2, None, ""), (3, "u", "<p>a & b &lt;<div>"), (4, "u", "<" * 50 + "a" * 9), (4, "u", "<article><p>x" + "<b>" * 3000 + "y</article>"), (None, "u", "<script>var a='</p>'")]
    rows = html_main.main_text(spark.createDataFrame(odd, "page_id long, url string, html string")).collect()
    assert len(rows) == len(odd) and all(r.text is not None for r in rows)
    assert html_main.main_text(spark.createDataFrame(odd, "page_id long, url string, html string").limit(0)).count() == 0


def test_messages_equal_enumeration():
    rng = np.random.default_rng(3)
    parent, depth = np.array([-1, 0, 0, 1, 1]), np.array([0, 1, 1, 2, 2])
    x = (rng.random((5, html_main.FEATURES)) < 0.3).astype(float)
    m = html_main.Potentials(rng.normal(size=(html_main.FEATURES, 3)), np.log([0.3, 0.3, 0.4]), np.log([0.2, 0.3, 0.5]), np.log(rng.dirichlet([1, 1, 1], 3)))
    own = x @ m.weights
    own = own - np.log(np.exp(own).sum(axis=1, keepdims=True)) - m.prior
    total = np.zeros((5, 3))
    for s in np.ndindex(3, 3, 3, 3, 3):
        p = math.exp(m.root[s[0]] + sum(own[i, s[i]] for i in range(5)) + sum(m.edge[s[parent[i]], s[i]] for i in range(1, 5)))
        for i in range(5):
            total[i, s[i]] += p
    assert html_main.marginals(x, parent, depth, m) == pytest.approx(total / total.sum(axis=1, keepdims=True))


def test_matroska_round_trip_and_lacing(spark, odd, none):
    rows = {r.doc_id: r for r in matroska.read_media(matroska.to_media(odd)).collect()}
    assert len(rows) == 10
    for i, t, _ in ODD:
        data = (t or "").encode()
        payload = data + b"\xff" * (max(576, -(-len(data) // 576) * 576) - len(data))
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert matroska.read_media(matroska.to_media(none)).count() == 0
    table_ = matroska.packet_table(matroska.to_media(odd)).where("doc_id = 6").orderBy("start").collect()
    assert [p.timestamp_ms for p in table_] == [72 * i for i in range(len(table_))] and {p.size for p in table_} == {576}
    frames = [bytes([i]) * n for i, n in enumerate((3, 300, 255, 254, 700))]
    for kind in (1, 3):
        block = b"\x81" + struct.pack(">h", -5) + bytes([kind << 1]) + matroska.lace(frames, kind)
        track, time, _, ranges = matroska.laced(block, 0, len(block))
        assert (track, time, [block[a : a + n] for a, n in ranges]) == (1, -5, frames)
    open_ended = matroska.element(matroska.EBML, b"") + b"\x18\x53\x80\x67\xff" + b"\x1f\x43\xb6\x75\xff" + matroska.number(matroska.TIME, 7) + matroska.element(matroska.GROUP, matroska.element(matroska.BLOCK, b"\x81\0\1\0ab")) + matroska.element(matroska.CLUSTER, matroska.number(matroska.TIME, 9))
    m = matroska.parse(open_ended)
    assert [c[1] for c in m.clusters] == [7, 9] and m.packets[0][:2] == (1, 8)
    with pytest.raises(ValueError):
        matroska.parse(b"\x1a\x45\xdf\xa3\x90")


def test_pieces_round_trip_and_distribution(spark, odd, none):
    rows = pieces.encode(odd)
    back = sorted(map(str, map(tuple, pieces.decode(rows).collect())))
    assert back == sorted(str((i, t or "")) for i, t, _ in ODD)
    assert pieces.encode(none).count() == 0 and all(r.lossless for r in pieces.round_trip(odd).collect())
    assert sorted(map(str, rows.collect())) == sorted(map(str, pieces.encode(odd.repartition(3)).collect()))
    v, n = pieces.Vocabulary(), 20_000
    got = collections.Counter(tuple(x.tolist()) for x in pieces.encode_texts(v, list(range(n)), ["the"] * n))
    weight = {}

    def walk(i, ids, p):
        if i == 4:
            weight[tuple(ids)] = p
        for j in range(i + 1, 5):
            q = v.pieces.get(" the"[i:j])
            if q is not None:
                walk(j, [*ids, q], p * v.weights[q])

    walk(0, [], 1.0)
    total = sum(weight.values())
    assert all(abs(got[k] / n - w / total) < 0.015 for k, w in weight.items()) and set(got) <= set(weight)


def test_quality_on_held_out_rows(spark, odd, none):
    rows = quality.op2_quality(spark, "/root/testdata/sf0.01").join(table(spark, "/root/testdata/sf0.01", "labels"), "doc_id").where("held_out and quality is not null").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.97
    labels = table(spark, SMALL, "labels")
    got = quality.score_documents(odd, labels)
    assert got.count() == len(ODD) and all(0 <= r.score <= 1 for r in got.collect())
    assert quality.score_documents(odd, labels.limit(0)).count() == len(ODD) and quality.score_documents(none, labels).count() == 0


def test_warc_revisits(spark, tmp_path):
    pages = [(1, "u", "<p>same\r\n\r\nWARC/1.1\r\n"), (5, "u", "<p>same\r\n\r\nWARC/1.1\r\n"), (3, None, "<p>same\r\n\r\nWARC/1.1\r\n"), (4, "x\r\ny", None), (6, "u", ""), (7, "u", "é" * 40_000), (None, "u", "alone"), (9, "u", "dup"), (9, "u", "dup")]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, last int")
    warc.write_archives(df, str(tmp_path / "w"))
    got = sorted(map(str, warc.resolved_archives(spark, str(tmp_path / "w")).collect()))
    assert len(got) == len(pages) and all("intact=True" in x for x in got)
    by = {r.page_id: r for r in warc.resolved_archives(spark, str(tmp_path / "w")).collect()}
    assert [(by[i].record_type, by[i].refers_to) for i in (1, 3, 5, 4, 6, 7, 9)] == [("revisit", 5), ("revisit", 5), ("response", None), ("revisit", 6), ("response", None), ("response", None), ("response", None)]
    warc.write_archives(df.limit(0), str(tmp_path / "e"))
    assert warc.resolved_archives(spark, str(tmp_path / "e")).count() == 0
    warc.write_archives(df, str(tmp_path / "l"), least=10)
    assert {r.page_id: r.record_type for r in warc.resolved_archives(spark, str(tmp_path / "l")).collect()}[4] == "response"


def test_pipeline_against_plain_versions(spark, tmp_path):
    import corpus_pipeline as cp

    docs = table(spark, SMALL, "documents")
    local = {r.doc_id: r for r in docs.collect()}
    good = cp.keep_quality(spark, docs, SMALL)
    predicted = {r.doc_id for r in quality.op2_quality(spark, SMALL).where("predicted = 1").collect()}
    kept = {r.doc_id for r in good.collect()}
    assert good.columns == docs.columns and len(kept ^ predicted) <= 0.02 * len(local)
    groups = plain_groups([(i, local[i].text) for i in sorted(kept)])
    one = cp.drop_near_duplicates(spark, docs.where(F.col("doc_id").isin(list(kept))), SMALL)
    assert sorted(r.doc_id for r in one.collect()) == sorted({c for _, _, c in groups})
    masked = cp.mask_personal_data(spark, docs, SMALL).collect()
    assert all(plain_spans(local[r.doc_id].text) == "" or r.text != local[r.doc_id].text for r in masked) and all(r.n_chars == len(r.text) for r in masked)
    copies = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    assert collections.Counter(r.doc_id for r in cp.mix_sources(spark, docs, SMALL).collect()) == collections.Counter({i: c for i, c in copies.items() if c})
    out = cp.run(spark, SMALL).collect()
    assert {r.doc_id for r in out} <= kept and all(r.n_pieces == len(r.ids) for r in out)
