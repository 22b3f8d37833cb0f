"""Minimal acyclic automata of sorted words, whose paths number the words (a perfect hash)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence


class Automaton:
    """Words, sorted by code points and distinct, as one state for each distinct set of endings.

    A transition carries how many words come before those that take it, so that the sum along a
    path is the word's place in the sorted list.
    """

    def __init__(self, words: Sequence[str]):
        self.next: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self.count: list[int] = []
        known: dict[tuple, int] = {}

        def close(final: bool, children: list[tuple[str, int]]) -> int:
            """The state with these endings: one that is known, or a new one."""
            key = (final, *children)
            if (state := known.get(key)) is None:
                state = known[key] = len(self.next)
                before, out = int(final), {}
                for c, to in children:
                    out[c] = (to, before)
                    before += self.count[to]
                self.next.append(out)
                self.final.append(final)
                self.count.append(before)
            return state

        # the last word's states from the start, still open: their closed children, and whether they're final
        open_: list[list] = [[False, []]]
        last = ""
        for w in words:
            same = 0
            while same < len(last) and same < len(w) and last[same] == w[same]:
                same += 1
            while len(open_) > same + 1:
                final, children = open_.pop()
                open_[-1][1].append((last[len(open_) - 1], close(final, children)))
            open_.extend([False, []] for _ in w[same:])
            open_[-1][0] = True
            last = w
        while len(open_) > 1:
            final, children = open_.pop()
            open_[-1][1].append((last[len(open_) - 1], close(final, children)))
        self.start = close(*open_[0])

    def walk(self, rest: str, state: int | None = None, number: int = 0) -> tuple[int, int] | None:
        """The state after rest, and the number so far; None if no word goes on like this."""
        at = self.start if state is None else state
        for c in rest:
            if (step := self.next[at].get(c)) is None:
                return None
            at, number = step[0], number + step[1]
        return at, number

    def number(self, word: str) -> int | None:
        """The word's place in the sorted list."""
        end = self.walk(word)
        return end[1] if end and self.final[end[0]] else None

    def one_error(self, rest: str, state: int, number: int) -> Iterator[int]:
        """Numbers of the words that go on from state like rest, but for one code point that is added,
        missing or replaced; a number may come several times."""

        def ends(rest: str, state: int, number: int) -> Iterator[int]:
            end = self.walk(rest, state, number)
            if end and self.final[end[0]]:
                yield end[1]

        for i in range(len(rest) + 1):
            for c, (to, before) in self.next[state].items():
                yield from ends(rest[i:], to, number + before)
                if i < len(rest) and c != rest[i]:
                    yield from ends(rest[i + 1 :], to, number + before)
            if i == len(rest):
                return
            yield from ends(rest[i + 1 :], state, number)
            if (step := self.next[state].get(rest[i])) is None:
                return
            state, number = step[0], number + step[1]


class Dictionary:
    """Words in a forward automaton and, reversed, in a backward one."""

    def __init__(self, words: Sequence[str], forward: bool = True, backward: bool = True):
        self.words = sorted(set(words))
        self.forward = Automaton(self.words) if forward else None
        if backward:
            turned = sorted((w[::-1], i) for i, w in enumerate(self.words))
            self.backward, self.place = Automaton([w for w, _ in turned]), [i for _, i in turned]

    def after(self, start: str, rest: str) -> set[int]:
        """Words that begin with start and go on like rest but for one error."""
        at = self.forward.walk(start)
        return set(self.forward.one_error(rest, *at)) if at else set()

    def before(self, rest: str, end: str) -> set[int]:
        """Words that end with end and, before it, are like rest but for one error."""
        at = self.backward.walk(end[::-1])
        return {self.place[k] for k in self.backward.one_error(rest[::-1], *at)} if at else set()
