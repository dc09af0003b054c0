"""A minimal acyclic transducer from sorted terms to their places in that order.

Terms are bytes. Equal endings share states: while sorted terms come in, states that no later term can change
are replaced by an equal one made before (Daciuk et al. 2000). An edge carries how many terms are passed by
taking it, so the numbers on a term's path add up to its ordinal. Edges lie in one open hash table of arrays,
and many terms are walked through it at once, a byte at a time.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

MIX = np.uint64(0x9E3779B97F4A7C15)


def build(terms: Iterable[bytes]) -> list[dict[int, tuple[int, int, bool]]]:
    """States as byte: (target, terms passed, whether the term may end there), the start last.

    The terms are sorted and distinct, none empty.
    """
    made: list[dict[int, tuple[int, int, bool]]] = []
    below: list[int] = []  # terms that end below a state, itself not counted
    known: dict[tuple, int] = {}
    # The states of the last term that may still change: their edges, and whether a term ends there.
    path: list[list] = [[{}, False]]
    last = b""

    def settle(depth: int) -> None:
        """Give the states below ``depth`` their numbers, from the deepest up."""
        while len(path) > depth + 1:
            edges, ends = path.pop()
            path[-1][0][last[len(path) - 1]] = (settled(edges), ends)

    def settled(edges: dict[int, tuple[int, bool]]) -> int:
        key = tuple(edges.items())
        number = known.get(key)
        if number is None:
            passed, out = 0, {}
            for byte, (target, ends) in edges.items():
                out[byte] = (target, passed, ends)
                passed += below[target] + ends
            number = known[key] = len(made)
            made.append(out)
            below.append(passed)
        return number

    for term in terms:
        shared = 0
        while shared < len(last) and shared < len(term) and last[shared] == term[shared]:
            shared += 1
        settle(shared)
        path.extend([{}, False] for _ in range(shared, len(term)))
        path[-1][1] = True
        last = term
    settle(0)
    root = settled(path[0][0])
    if root != len(made) - 1:
        made.append(made[root])
    return made


class Transducer:
    """The states as arrays: of each slot of the hash table the edge (state and byte), its target and output."""

    def __init__(self, keys: np.ndarray, targets: np.ndarray, outputs: np.ndarray, start: int):
        self.keys, self.targets, self.outputs, self.start = keys, targets, outputs, start

    @classmethod
    def of(cls, terms: Iterable[bytes]) -> Transducer:
        states = build(terms)
        edges = [(state << 8 | byte, target << 1 | ends, passed) for state, out in enumerate(states) for byte, (target, passed, ends) in out.items()]
        size = max(4, 1 << (2 * len(edges)).bit_length())
        keys, targets, outputs = np.full(size, -1, np.int64), np.zeros(size, np.int32), np.zeros(size, np.int32)
        if edges:
            key, target, output = (np.array(c, np.int64) for c in zip(*edges))
            at, left = cls._slot(key, size), np.arange(len(key))
            while len(left):
                free = left[keys[at[left]] == -1]
                keys[at[free]] = key[free]  # of several that want a slot one gets it
                won = keys[at[left]] == key[left]
                targets[at[left[won]]], outputs[at[left[won]]] = target[left[won]], output[left[won]]
                left = left[~won]
                at[left] = (at[left] + 1) & (size - 1)
        return cls(keys, targets, outputs, len(states) - 1)

    @staticmethod
    def _slot(key: np.ndarray, size: int) -> np.ndarray:
        return ((key.astype(np.uint64) * MIX) >> np.uint64(64 - size.bit_length() + 1)).astype(np.int64)

    def to_bytes(self) -> bytes:
        head = np.array([len(self.keys), self.start], np.int64)
        return b"".join(x.tobytes() for x in (head, self.keys, self.targets, self.outputs))

    @classmethod
    def from_bytes(cls, data: bytes) -> Transducer:
        size, start = np.frombuffer(data, np.int64, 2).tolist()
        keys = np.frombuffer(data, np.int64, size, 16)
        targets, outputs = (np.frombuffer(data, np.int32, size, 16 + 8 * size + at * 4 * size) for at in (0, 1))
        return cls(keys, targets, outputs, start)

    def _step(self, key: np.ndarray) -> np.ndarray:
        """Slot of each edge, -1 if there is none."""
        at = self._slot(key, len(self.keys))
        there = self.keys[at]
        missed = np.flatnonzero((there != key) & (there != -1))
        while len(missed):
            at[missed] = (at[missed] + 1) & (len(self.keys) - 1)
            there[missed] = self.keys[at[missed]]
            missed = missed[(there[missed] != key[missed]) & (there[missed] != -1)]
        return np.where(there == key, at, -1)

    def ordinals(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of the terms at these stretches of a text's bytes their ordinals, -1 for what is none."""
        out = np.full(len(starts), -1, np.int64)
        active = np.flatnonzero(ends > starts)
        state, passed, place = np.full(len(active), self.start, np.int64), np.zeros(len(active), np.int64), starts[active]
        while len(active):
            slot = self._step(state << 8 | text[place])
            on = slot >= 0
            active, place, slot, passed = active[on], place[on] + 1, slot[on], passed[on] + self.outputs[slot[on]]
            target = self.targets[slot]
            over = place == ends[active]
            final = over & ((target & 1) == 1)
            out[active[final]] = passed[final]
            # A term that goes on from where another may end comes after it.
            state, passed = (target >> 1).astype(np.int64), passed + (target & 1)
            active, place, state, passed = (x[~over] for x in (active, place, state, passed))
        return out
