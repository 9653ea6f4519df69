"""A run-length compressed Burrows-Wheeler index with samples at run ends, in numpy.

The text is a list of phrases, each closed by a separator of its own; separators sort by the
order of their phrases, before every byte. Kept are: the symbol, first row and length of each
run of the transform, the text positions at the first and last row of each run, and where rows
stop sharing their first DEPTH symbols. From that the index answers, for many phrases at once,

* the backward step of an interval of rows (rank over runs),
* matching statistics cut at DEPTH: phrases are streamed from their end; each step extends
  the match to the left and, once it is longer than DEPTH, widens the interval to all rows that
  share DEPTH symbols; with every interval goes one known occurrence, renewed from the sample
  at a run end where the step leaves its run (the toehold),
* all occurrences of an interval, by walking to the neighbouring rows' positions through the
  samples (phi and its inverse).
"""

from __future__ import annotations

import numpy as np

DEPTH = 100


def suffix_order(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in suffix order, and ranks of the first 56 symbols. symbols: 0 for separators, else 1-256."""
    n = len(symbols)
    pad = np.zeros(n + 7, np.uint64)
    pad[:n] = symbols
    key, ended = np.zeros(n, np.uint64), np.zeros(n, bool)
    for k in range(7):
        s = pad[k : n + k]
        key = (key << np.uint64(9)) | np.where(ended, np.uint64(0), s)
        ended |= s == 0
    # suffixes that met their separator are told from equal ones by their place
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.r_[0, np.cumsum((key[order][1:] != key[order][:-1]) | ended[order][1:])]
    at, early = 7, None
    while rank[order[-1]] < n - 1:
        if at == 56:
            early = rank.copy()
        second = np.zeros(n, np.int64)
        second[: max(0, n - at)] = rank[at:] + 1
        both = rank * (n + 2) + second
        order = np.argsort(both)
        rank = np.empty(n, np.int64)
        rank[order] = np.r_[0, np.cumsum(both[order][1:] != both[order][:-1])]
        at *= 2
    return order, rank if early is None else early


class RunIndex:
    def __init__(self, phrases: list[bytes], depth: int = DEPTH):
        lengths = np.array([len(p) for p in phrases], np.int64)
        n = int(lengths.sum()) + len(phrases)
        self.ends = np.cumsum(lengths + 1) - 1  # of the separators
        self.begins = self.ends - lengths
        symbols = np.frombuffer(b"\0".join(phrases) + b"\0", np.uint8).astype(np.int64) + 1
        symbols[self.ends] = 0
        self.text, self.n, self.depth = symbols, n, depth
        phrase = np.repeat(np.arange(len(phrases)), lengths + 1)
        order, rank = suffix_order(symbols)
        left = self.ends[phrase] - np.arange(n)  # symbols before the separator
        # rows that open a class: the first depth symbols differ from the row before, or there are fewer
        half = depth - 56
        if depth == DEPTH:
            other = np.zeros(n, np.int64)
            other[: n - half] = rank[half:]
            same = (rank[order][1:] == rank[order][:-1]) & (other[order][1:] == other[order][:-1]) & (left[order][1:] >= depth) & (left[order][:-1] >= depth)
        else:  # small depths, for tests
            same = np.array([bool(left[a] >= depth and left[b] >= depth and (symbols[a : a + depth] == symbols[b : b + depth]).all()) for a, b in zip(order[:-1], order[1:])], bool)
        self.opens = np.flatnonzero(np.r_[True, ~same])
        before = symbols[order - 1]  # position 0 is preceded by the last separator
        # separators don't sort by what follows them, so each stands for a run of its own
        starts = np.flatnonzero(np.r_[True, (before[1:] != before[:-1]) | (before[1:] == 0)])
        self.starts, self.heads = starts, before[starts]
        lasts = np.r_[starts[1:], n] - 1
        self.first_at, self.last_at = order[starts], order[lasts]
        # runs by symbol: the step of a row is the number of rows of smaller symbols and earlier runs, plus its place in the run
        by = np.lexsort((np.arange(len(starts)), self.heads))
        self.keys = self.heads[by] * len(starts) + by
        self.sums = np.r_[0, np.cumsum((lasts - starts + 1)[by])]
        self.by = by
        # phi: the position in the row above; sampled where a run begins. Its inverse where a run ends.
        o = np.argsort(self.first_at)
        self.up_from, self.up_to = self.first_at[o], np.r_[-1, self.last_at[:-1]][o]
        o = np.argsort(self.last_at)
        self.down_from, self.down_to = self.last_at[o], np.r_[self.first_at[1:], -1][o]

    def run_of(self, rows: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, rows, "right") - 1

    def step(self, c: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """For each row the number of rows that the step with c puts before it."""
        run = np.searchsorted(self.starts, rows, "right") - 1
        inside = np.minimum(run, len(self.starts) - 1)
        base = self.sums[np.searchsorted(self.keys, c * len(self.starts) + run)]
        return base + np.where(self.heads[inside] == c, rows - self.starts[inside], 0)

    def up(self, at: np.ndarray) -> np.ndarray:
        k = np.searchsorted(self.up_from, at, "right") - 1
        return self.up_to[k] + at - self.up_from[k]

    def down(self, at: np.ndarray) -> np.ndarray:
        k = np.searchsorted(self.down_from, at, "right") - 1
        return self.down_to[k] + at - self.down_from[k]

    def statistics(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Streams every phrase: for each text position that starts depth symbols of its phrase, its class, and for each class one row and the position there."""
        m = len(self.ends)
        at = self.ends.copy()
        lo, hi = np.zeros(m, np.int64), np.full(m, self.n, np.int64)
        row = np.full(m, -1, np.int64)  # a known row of the interval, and its position
        pos = np.full(m, -1, np.int64)
        group = np.full(self.n, -1, np.int64)
        known_row = np.full(len(self.opens), -1, np.int64)
        known_pos = np.full(len(self.opens), -1, np.int64)
        live = np.arange(m)
        length = 0
        bounds = np.r_[self.opens, self.n]
        while len(live := live[at[live] > self.begins[live]]):
            at[live] -= 1
            c = self.text[at[live]]
            a, b = lo[live], hi[live]
            x, y = self.step(c, a), self.step(c, b)
            # toehold: the known row steps along if it is followed by c; else a run of c begins or ends in the interval
            stays = (row[live] >= 0) & (self.heads[self.run_of(np.maximum(row[live], 0))] == c)
            new_row, new_pos = self.step(c, np.maximum(row[live], 0)), pos[live] - 1
            move = np.flatnonzero(~stays)
            if len(move):
                cm = c[move]
                run = self.by[np.searchsorted(self.keys, cm * len(self.starts) + self.run_of(b[move] - 1), "right") - 1]
                ends = np.r_[self.starts[1:], self.n][run] <= b[move]
                new_row[move] = np.where(ends, y[move] - 1, self.step(cm, self.starts[run]))
                new_pos[move] = np.where(ends, self.last_at[run], self.first_at[run]) - 1
            lo[live], hi[live] = x, y
            row[live], pos[live] = new_row, new_pos
            length += 1
            if length >= self.depth:
                k = np.searchsorted(self.opens, x, "right") - 1
                lo[live], hi[live] = self.opens[k], bounds[k + 1]
                group[at[live]] = k
                known_row[k], known_pos[k] = new_row, new_pos
        return group, known_row, known_pos

    def earliest(self) -> tuple[np.ndarray, np.ndarray]:
        """Each position's class (-1: fewer than depth symbols left), and each class's smallest position."""
        group, row, pos = self.statistics()
        bounds = np.r_[self.opens, self.n]
        best = np.full(len(self.opens), self.n, np.int64)
        used = np.flatnonzero(row >= 0)
        best[used] = pos[used]
        for walk, left in ((self.up, row[used] - bounds[used]), (self.down, bounds[used + 1] - 1 - row[used])):
            live, now, left = used[left > 0], pos[used][left > 0], left[left > 0]
            while len(live):
                now = walk(now)
                best[live] = np.minimum(best[live], now)
                left = left - 1
                go = left > 0
                live, now, left = live[go], now[go], left[go]
        return group, best


def repeats(phrases: list[bytes], depth: int = DEPTH) -> list[np.ndarray]:
    """For each phrase a flag for every start of depth symbols: an earlier phrase (or start) has the same."""
    if not phrases:
        return []
    index = RunIndex(phrases, depth)
    group, best = index.earliest()
    at = np.arange(index.n)
    flag = (group >= 0) & (best[np.maximum(group, 0)] < at)
    return [flag[b : max(b, e - depth + 1)] for b, e in zip(index.begins.tolist(), index.ends.tolist())]
