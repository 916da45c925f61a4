"""What byte-pair merges and their prefix structure have in common.

A vocabulary gives each token a rank; encoding merges, again and again, the leftmost of the
neighbouring pairs whose joint token has the lowest rank. Two facts follow. A sequence of
tokens is the encoding of its text if and only if each two neighbours are the encoding of
their own joint text. So each prefix of a text has exactly one last token, the one that
fits behind the encoding of the rest, and the encoding of the whole is read off by stepping
back from the end.
"""

from __future__ import annotations

NEVER = 1 << 62  # no such merge


def merge(word: str, ranks: dict[str, int]) -> list[str]:
    """The encoding by its definition, in quadratic time; for short strings."""
    parts = list(word)
    while len(parts) > 1:
        best = min(
            ((ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))))
        if best[0] == NEVER:
            break
        i = best[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
    return parts


class Traces(dict):
    """The merges that build a token, at first use: the rank of each step, and the token's
    first and last part before it. None if merging does not yield the token."""

    def __init__(self, ranks: dict[str, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, token: str) -> tuple[list[int], list[str], list[str]] | None:
        parts, steps, first, last = list(token), [], [token[0]], [token[-1]]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(a + b, NEVER), i)
                          for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == NEVER:
                break
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            steps.append(rank)
            first.append(parts[0])
            last.append(parts[-1])
        found = None if len(parts) > 1 else ([*steps, NEVER], first, last)
        self[token] = found
        return found


class Fits(dict):
    """Whether a token may follow another, by the pair; worked out at first use.

    The merges of the two texts run side by side, the lower rank first. The pair fits if at
    no time the parts that touch would merge. Only pairs that occur are held, at most
    ``limit`` of them.
    """

    def __init__(self, ranks: dict[str, int], limit: int = 400_000):
        super().__init__()
        self.ranks, self.limit, self.traces = ranks, limit, Traces(ranks)

    def token(self, text: str) -> bool:
        return text in self.ranks and self.traces[text] is not None

    def __missing__(self, pair: tuple[str, str]) -> bool:
        if len(self) >= self.limit:
            self.clear()
        a, _, ends = self.traces[pair[0]] or ([NEVER], None, [pair[0]])
        b, starts, _ = self.traces[pair[1]]
        get, i, j, fit = self.ranks.get, 0, 0, True
        while fit:
            rank = get(ends[i] + starts[j], NEVER)
            if rank < a[i] and rank <= b[j]:
                fit = False
            elif a[i] == b[j] == NEVER:
                break
            elif a[i] <= b[j]:
                i += 1
            else:
                j += 1
        self[pair] = fit
        return fit


class State:
    """What of a prefix decides how it goes on.

    ``token`` is the last token of its encoding. ``entries`` has, longest first, each end of
    the prefix that a longer token may begin with, down to the empty one: that end, the last
    token before it (None at the start), by how many tokens the encoding before it is shorter
    than the prefix's, and a mark that the first token of a text hands on.
    """

    __slots__ = ("token", "entries", "next")

    def __init__(self, token: str | None, entries: tuple):
        self.token, self.entries = token, entries
        self.next: dict[str, tuple[State, int]] = {}


class Machine:
    """A transducer over characters: its states know the last token of each prefix, its
    transitions emit the change of the number of tokens.

    States and transitions are compiled when first reached, since few of the finitely many
    ever are; at most ``limit`` states are held. A character that is no token is spelled out
    in its bytes, each a token that joins nothing. With ``counted=False`` the numbers of
    tokens, and so states that differ only in them, are not told apart. ``marked`` is the
    first token that sets the mark.
    """

    def __init__(self, ranks: dict[str, int], counted: bool = True, marked: str | None = None,
                 limit: int = 160_000):
        self.ranks, self.counted, self.marked, self.limit = ranks, counted, marked, limit
        self.fits = Fits(ranks)
        self.open = frozenset(t[:i] for t in ranks for i in range(1, len(t)))
        self.states: dict[tuple, State] = {}
        self.start = State(None, (("", None, 0, False),))

    def step(self, state: State, char: str) -> tuple[State, int]:
        known = state.next.get(char)
        if known is None:
            known = state.next[char] = self.compile(state, char)
        return known

    def compile(self, state: State, char: str) -> tuple[State, int]:
        token, still_open, fits = None, [], self.fits
        for end, last, less, mark in state.entries:
            end += char
            if token is None and end in self.ranks and fits.token(end) and (
                    last is None or fits[last, end]):
                token, before, change, first = end, last, 1 - less, mark
            if end in self.open:
                still_open.append((end, last, less, mark))
        if token is None:
            _, before, less, first = state.entries[-1]
            token, change = char, len(char.encode()) - less
        if before is None:
            first = token == self.marked
        shift = change if self.counted else 0
        entries = tuple([(e, t, n + shift, m) for e, t, n, m in still_open]
                        + [("", token, 0, first)])
        found = self.states.get(entries)
        if found is None:
            if len(self.states) >= self.limit:
                self.states.clear()
                self.start.next.clear()
            found = self.states[entries] = State(token, entries)
        return found, change
