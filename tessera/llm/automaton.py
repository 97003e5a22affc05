"""A generalised suffix automaton over several sequences of symbols."""

from __future__ import annotations

from collections.abc import Hashable, Iterable, Sequence


class SuffixAutomaton:
    """States stand for classes of substrings that end at the same places of the added sequences.

    `next[s]` holds the transitions, `link[s]` the state of the longest suffix in another class, and
    `length[s]` the longest substring of the class. Size is linear in the symbols added.
    """

    def __init__(self, sequences: Iterable[Sequence[Hashable]] = ()):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.ends: list[int] = []  # the state of each whole sequence, in order of adding
        for sequence in sequences:
            self.add(sequence)

    def add(self, sequence: Sequence[Hashable]) -> list[int]:
        """Add a sequence; gives the state reached after each symbol."""
        at, path = 0, []
        for symbol in sequence:
            at = self._extend(at, symbol)
            path.append(at)
        self.ends.append(at)
        return path

    def _state(self, length: int, link: int, transitions: dict) -> int:
        self.next.append(transitions)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, parent: int, symbol: Hashable) -> int:
        """The state for parent's longest string plus symbol; a clone if the target holds longer ones."""
        target = self.next[parent][symbol]
        if self.length[target] == self.length[parent] + 1:
            return target
        clone = self._state(self.length[parent] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = clone
        while parent >= 0 and self.next[parent].get(symbol) == target:
            self.next[parent][symbol] = clone
            parent = self.link[parent]
        return clone

    def _extend(self, last: int, symbol: Hashable) -> int:
        if symbol in self.next[last]:
            return self._split(last, symbol)
        fresh = self._state(self.length[last] + 1, 0, {})
        walk = last
        while walk >= 0 and symbol not in self.next[walk]:
            self.next[walk][symbol] = fresh
            walk = self.link[walk]
        if walk >= 0:
            self.link[fresh] = self._split(walk, symbol)
        return fresh

    def step(self, state: int, matched: int, symbol: Hashable) -> tuple[int, int]:
        """Follow one symbol of a text: the new state and the length of the longest suffix matched."""
        while state and symbol not in self.next[state]:
            state = self.link[state]
            matched = self.length[state]
        to = self.next[state].get(symbol)
        return (0, 0) if to is None else (to, matched + 1)
