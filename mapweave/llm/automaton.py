"""Generalised suffix automaton over word sequences."""

from __future__ import annotations


class SuffixAutomaton:
    """Recognises every substring of the added sequences.

    State 0 is the root. ``step`` maps a symbol to the next state, ``link`` is
    the state of the longest proper suffix in another class, ``size`` the length
    of the longest string of the state.
    """

    def __init__(self) -> None:
        self.step: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.size = [0]

    def _state(self, size: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.size.append(size)
        self.link.append(link)
        return len(self.size) - 1

    def _split(self, before: int, symbol: int, wide: int) -> int:
        """Part the short strings of ``wide`` from its long ones."""
        narrow = self._state(self.size[before] + 1, dict(self.step[wide]), self.link[wide])
        self.link[wide] = narrow
        while before >= 0 and self.step[before].get(symbol) == wide:
            self.step[before][symbol] = narrow
            before = self.link[before]
        return narrow

    def _target(self, before: int, symbol: int) -> int:
        at = self.step[before][symbol]
        return at if self.size[at] == self.size[before] + 1 else self._split(before, symbol, at)

    def add(self, sequence: list[int]) -> None:
        last = 0
        for symbol in sequence:
            if symbol in self.step[last]:
                last = self._target(last, symbol)
                continue
            new = self._state(self.size[last] + 1, {}, 0)
            while last >= 0 and symbol not in self.step[last]:
                self.step[last][symbol] = new
                last = self.link[last]
            if last >= 0:
                self.link[new] = self._target(last, symbol)
            last = new

    def walk(self, sequence: list[int]):
        """The state after each symbol of an added sequence."""
        state = 0
        for symbol in sequence:
            state = self.step[state][symbol]
            yield state
