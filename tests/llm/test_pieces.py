"""Packed transitions and the edges of piece lattices against plain searches; the memory that filtering takes."""

import random
import tracemalloc

import numpy as np
import pytest

from driftline.llm import pieces
from driftline.llm.steps import Steps


@pytest.fixture(scope="module")
def vocab():
    return pieces.Vocabulary()


@pytest.mark.parametrize(("states", "width"), [(1, 0), (1, 300), (3, 2), (40, 1), (400, 7), (60, 60)])
def test_steps_equal_a_dict(states, width):
    rng = random.Random(states)
    chars = [chr(c) for c in (*range(97, 97 + max(1, width)), 0x10FFFF)]
    want = {(s, c): rng.randrange(states) for s in range(states) for c in rng.sample(chars, rng.randrange(min(width, len(chars)) + 1))}
    steps = Steps(states, *(np.array(x, np.int64) for x in ([s for s, _ in want], [ord(c) for _, c in want], list(want.values()))))
    pairs = [(s, c) for s in range(states) for c in [*chars, "語"]]
    got = steps(np.array([s for s, _ in pairs]), steps.classes[[ord(c) for _, c in pairs]])
    assert got.tolist() == [want.get(p, -1) for p in pairs]


def test_edges_are_all_pieces_at_all_places(vocab, monkeypatch):
    units = [" the", "\n", "  ", "naïve", "語言", "😀x", "\ud800", " " + "internationalisation" * 30, "a", "▁b"]
    for most in (pieces.FILTERED_AT_ONCE, 7):
        monkeypatch.setattr(pieces, "FILTERED_AT_ONCE", most)
        lattice = pieces.Lattice(vocab, units)
        got = set(zip(lattice.start.tolist(), lattice.end.tolist(), lattice.code.tolist(), strict=True))
        want = set()
        for unit, first in zip(units, lattice.first.tolist(), strict=True):
            for i in range(len(unit)):
                want |= {(first + i, first + j, vocab.pieces[unit[i:j]]) for j in range(i + 1, len(unit) + 1) if unit[i:j] in vocab.pieces}
                if unit[i] not in vocab.pieces:
                    want.add((first + i, first + i + 1, vocab.size + ord(unit[i])))
        assert got == want and len(lattice.end) == len(want) and (np.diff(lattice.key) >= 0).all()


def test_filtering_takes_little_more_than_its_results(vocab):
    """It took 83 bytes an edge at its peak, too much for two workers beside the heap of the pipeline's executors; results are 20."""
    rng = random.Random(5)
    units = list({" " + "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(4, 14))) for _ in range(90_000)})
    pieces.Lattice(vocab, units[:10])
    tracemalloc.start()
    lattice = pieces.Lattice(vocab, units)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 * len(lattice.end)
