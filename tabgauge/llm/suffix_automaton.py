"""Generalised suffix automaton over sequences of token ids."""

from __future__ import annotations

from collections.abc import Iterable


class SuffixAutomaton:
    """Every part of every added sequence; state 0 is empty.

    ``length`` is the longest part of a state, ``link`` its longest proper suffix in
    another state. ``mark`` names parts: ``marked[s]`` is the nearest state on the suffix
    chain from ``s`` on that bears a name, ``mark_length`` the length of the named part.
    """

    def __init__(self) -> None:
        self.step: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.names: dict[int, set[str]] = {}
        self.mark_length: dict[int, int] = {}
        self.marked: list[int] = []

    def _state(self, length: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, before: int, token: int) -> int:
        """The state of exactly the longest part of ``before`` and then ``token``."""
        target = self.step[before][token]
        if self.length[target] == self.length[before] + 1:
            return target
        copy = self._state(self.length[before] + 1, dict(self.step[target]), self.link[target])
        self.link[target] = copy
        while before >= 0 and self.step[before].get(token) == target:
            self.step[before][token] = copy
            before = self.link[before]
        return copy

    def add(self, tokens: Iterable[int]) -> None:
        last = 0
        for token in tokens:
            if token in self.step[last]:
                last = self._split(last, token)
                continue
            new = self._state(self.length[last] + 1, {}, 0)
            at = last
            while at >= 0 and token not in self.step[at]:
                self.step[at][token] = new
                at = self.link[at]
            if at >= 0:
                self.link[new] = self._split(at, token)
            last = new

    def mark(self, part: Iterable[int], name: str) -> None:
        """Name a part of an added sequence."""
        state, n = 0, 0
        for token in part:
            state = self.step[state][token]
            n += 1
        self.names.setdefault(state, set()).add(name)
        self.mark_length[state] = n

    def finish(self) -> None:
        """Find the nearest named state of every state, shortest first."""
        self.marked = [0] * len(self.link)
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.marked[s] = s if s in self.names else self.marked[self.link[s]]

    def stream(self, tokens: Iterable[int]):
        """After each token: the state and the longest length that an added sequence matches there."""
        state = length = 0
        step, link, longest = self.step, self.link, self.length
        for token in tokens:
            while token not in step[state]:
                state = link[state]
                if state < 0:
                    break
                length = longest[state]
            if state < 0:
                state = length = 0
            else:
                state = step[state][token]
                length += 1
            yield state, length
