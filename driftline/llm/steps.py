"""Transitions of an automaton in one array, so that numpy takes a step of very many walkers at once."""

from __future__ import annotations

import numpy as np

#: Rounds after which the array is doubled.
ROUNDS = 32


class Steps:
    """A deterministic automaton's transitions (row displacement): those of a state stand at its base plus the class of the
    character, and each place names the state that it belongs to. The size follows the transitions, not states times
    characters."""

    def __init__(self, states: int, sources: np.ndarray, chars: np.ndarray, targets: np.ndarray) -> None:
        """Transition i leads from state sources[i] by the code point chars[i] to state targets[i]."""
        known = np.unique(chars)
        self.classes = np.zeros(0x110000, np.int32)  # 0: in no transition
        self.classes[known] = np.arange(1, len(known) + 1)
        per = np.bincount(sources, minlength=states)
        order = np.lexsort((sources, -per[sources]))  # the widest states first, while there is room
        source, kind, target = (x[order].astype(np.int64) for x in (sources, self.classes[chars], targets))
        room = max(64, 2 * len(source))
        self.base = np.zeros(states, np.int32)
        owner = np.full(room + len(known) + 1, -1, np.int64)
        rng = np.random.default_rng(0)
        # states of like width are placed together: each tries a base until no other state stands in its places
        widths = np.frexp(per[source].astype(float))[1]
        cuts = [0, *(np.flatnonzero(widths[1:] != widths[:-1]) + 1), len(source)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            left, tried = np.arange(a, b), 0
            while len(left):
                tried += 1
                if tried % ROUNDS == 0:
                    room *= 2
                    owner = np.concatenate((owner, np.full(room + len(known) + 1 - len(owner), -1, np.int64)))
                first = np.flatnonzero(np.concatenate(([True], source[left][1:] != source[left][:-1])))
                width = np.diff(np.concatenate((first, [len(left)])))
                base = rng.integers(0, room, len(first))
                place = np.repeat(base, width) + kind[left]
                free = np.repeat(np.logical_and.reduceat(owner[place] < 0, first), width)
                owner[place[free]] = source[left][free]
                own = owner[place] == source[left]
                whole = np.logical_and.reduceat(own, first)
                self.base[source[left][first[whole]]] = base[whole]
                lost = ~np.repeat(whole, width)
                owner[place[lost & own]] = -1
                left = left[lost]
        self.cells = np.full(len(owner), -1, np.int64)  # state and target in one, so that a step reads one place
        self.cells[self.base[source] + kind] = source << 32 | target

    def __call__(self, states: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """The states reached, -1 where there is no such transition."""
        cell = self.cells[self.base[states] + classes]
        return np.where(cell >> 32 == states, cell & 0xFFFFFFFF, -1)
