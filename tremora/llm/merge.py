"""Front-coded sorted runs of byte strings, and their merge by a loser tree.

A run keeps, of each string, the length of the prefix it shares with the one
before and what follows.  The tree knows how far each contender agrees with the
string put out last; of two contenders the one that agrees longer is the smaller
one, and only strings that agree equally long are compared, from there on.  No
byte of a known common prefix is read twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

Entry = tuple[bytes, bytes, int]  # (string, what is carried with it, a number)


def agreement(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which so much is known."""
    n = min(len(a), len(b))
    while known < n:
        x, y = a[known : known + 64], b[known : known + 64]
        if x != y:
            m = min(len(x), len(y))
            apart = int.from_bytes(x[:m], "big") ^ int.from_bytes(y[:m], "big")
            return known + m - (apart.bit_length() + 7) // 8
        known += 64
    return n


def front_coded(entries: list[Entry]) -> bytes:
    """A run: sorted here, each string without what it shares with the one before."""
    entries = sorted(entries)
    shared, tails, before = [], [], b""
    for string, _, _ in entries:
        common = agreement(before, string)
        shared.append(common)
        tails.append(string[common:])
        before = string
    sizes = np.array(
        [[len(entries)] * 3, *zip(shared, map(len, tails), [len(e[1]) for e in entries])], "<u4"
    )
    numbers = np.array([e[2] for e in entries], "<i8")
    return b"".join([sizes.tobytes(), numbers.tobytes(), *tails, *[e[1] for e in entries]])


def decoded(run: bytes) -> Iterator[tuple[int, Entry]]:
    """(shared prefix with the one before, entry) of a run."""
    n = int(np.frombuffer(run, "<u4", 1)[0])
    sizes = np.frombuffer(run, "<u4", 3 * n, 12).reshape(n, 3)
    at = 12 + 12 * n
    numbers = np.frombuffer(run, "<i8", n, at).tolist()
    at += 8 * n
    carried_at = at + int(sizes[:, 1].sum())
    string = b""
    for (common, tail, carried), number in zip(sizes.tolist(), numbers):
        string = string[:common] + run[at : at + tail]
        at += tail
        yield common, (string, run[carried_at : carried_at + carried], number)
        carried_at += carried


def merged(runs: list[bytes]) -> Iterator[tuple[int, Entry]]:
    """(shared prefix with the one before, entry) of all runs in order."""
    streams = [decoded(run) for run in runs]
    size = 1
    while size < len(streams):
        size *= 2
    now: list[Entry | None] = [None] * size
    known = [-1] * size  # common prefix with the last one put out; -1: the run is over

    def advance(r: int) -> None:
        known[r], now[r] = next(streams[r], (-1, None))

    def smaller(a: int, b: int) -> bool:
        """Whether a goes first; the loser then knows its common prefix with the winner."""
        if known[a] != known[b]:
            return known[a] > known[b]
        if known[a] < 0:
            return a < b
        x, y = now[a][0], now[b][0]
        common = agreement(x, y, known[a])
        first = (x[common:], a) < (y[common:], b)
        known[b if first else a] = common
        return first

    for r in range(len(streams)):
        advance(r)
    losers = [0] * size
    best = list(range(size))
    while len(best) > 1:  # the first round of the tournament
        level = []
        for i in range(0, len(best), 2):
            a, b = best[i], best[i + 1]
            first = smaller(a, b)
            losers[len(best) // 2 + i // 2] = b if first else a
            level.append(a if first else b)
        best = level
    winner = best[0]
    while known[winner] >= 0:
        yield known[winner], now[winner]
        advance(winner)
        node = (winner + size) // 2
        while node:
            if not smaller(winner, losers[node]):
                winner, losers[node] = losers[node], winner
            node //= 2
