"""I7 token alignment: keep the common subsequence, one ``<*>`` per run of differences.

The rows of the length table are the bits of one integer each; only every
``isqrt(n)``-th is kept, and the rows between two of them are made again when
the traceback comes to them."""

from __future__ import annotations

from math import isqrt

WILD = "<*>"


def token_masks(b: list) -> dict:
    """Places of each token of ``b`` as bits of one integer."""
    masks: dict = {}
    for j, t in enumerate(b):
        masks[t] = masks.get(t, 0) | 1 << j
    return masks


def next_row(row: int, hit: int, full: int) -> int:
    """The row behind a token with the matches ``hit``: bit j is 0 where the length grows at place j.

    Adding carries a run of ones past each match."""
    hit &= row
    return ((row + hit) | (row - hit)) & full if hit else row


def lcs_length(masks: dict, n: int, b: list) -> int:
    """Length of the longest common subsequence of ``b`` and the ``n`` tokens behind ``masks``."""
    full = (1 << n) - 1
    row = full
    for t in b:
        row = next_row(row, masks.get(t, 0), full)
    return n - row.bit_count()


class _Table:
    """Lengths of the common subsequence of the first i tokens of ``a`` and the first j of ``b``."""

    def __init__(self, a: list[str], b: list[str]):
        self.a, self.masks, self.full, self.step = a, token_masks(b), (1 << len(b)) - 1, isqrt(len(a)) + 1
        self.kept, row = [self.full], self.full
        for i, t in enumerate(a, 1):
            row = next_row(row, self.masks.get(t, 0), self.full)
            if i % self.step == 0:
                self.kept.append(row)
        self.block, self.rows = -1, []

    def row(self, i: int) -> int:
        block = i // self.step
        if block != self.block:
            rows = [self.kept[block]]
            for t in self.a[block * self.step:(block + 1) * self.step - 1]:
                rows.append(next_row(rows[-1], self.masks.get(t, 0), self.full))
            self.block, self.rows = block, rows
        return self.rows[i - block * self.step]


def align_pair(a: list[str], b: list[str]) -> list[str]:
    """Common tokens kept in order; each maximal run of differences -> ``<*>``.

    Of equally long common subsequences the one is kept that an end-to-front
    walk finds which drops from ``a`` where that costs nothing, else from ``b``.
    """
    table, keep = _Table(a, b), []
    i, j = len(a), len(b)
    gap_at = [False] * (len(a) + 1)  # a difference stands before this token of ``a``
    while i and j:
        low = (1 << j) - 1
        here, above = table.row(i) & low, table.row(i - 1) & low
        if here.bit_count() == above.bit_count():
            gap_at[i] = True
            i -= 1
        elif here >> (j - 1):  # no growth at the last place
            gap_at[i] = True
            j -= 1
        else:
            i, j = i - 1, j - 1
            keep.append(i)
    if i or j:
        gap_at[i] = True
    out: list[str] = []
    done = 0
    for k in [*reversed(keep), len(a)]:
        if any(gap_at[done:k + 1]) and (not out or out[-1] != WILD):
            out.append(WILD)
        if k < len(a) and not (a[k] == WILD and out and out[-1] == WILD):
            out.append(a[k])
        done = k + 1
    return out


def align_all(samples: list[list[str]]) -> list[str]:
    """Fold ``align_pair`` over samples (already in the wanted order)."""
    if not samples:
        return []
    cur = samples[0]
    for s in samples[1:]:
        cur = align_pair(cur, s)
    return cur


def positional_merge(a: list[str], b: list[str]) -> list[str] | None:
    """Same length, equal token kept, either ``<*>`` -> ``<*>``, else refuse."""
    if len(a) != len(b):
        return None
    out = []
    for x, y in zip(a, b):
        if x == y:
            out.append(x)
        elif x == WILD or y == WILD:
            out.append(WILD)
        else:
            return None
    return out
