"""Spans of positions: first and end."""

from __future__ import annotations

import numpy as np


def joined(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans that touch or overlap, as one."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]]))
    return start[new], end[np.concatenate([new[1:] - 1, [len(end) - 1]])]


def once_a_row(row: np.ndarray, names: list[np.ndarray], first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of a row with equal names, as one: (the entry of the least `first` of each, cuts, the other `first`s of each in turn)."""
    order = np.lexsort([first, *names[::-1], row])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for x in (row, *names):
        y = x[order]
        new[1:] |= y[1:] != y[:-1]
    heads = np.flatnonzero(new)
    cuts = np.append(heads, len(order)) - np.arange(len(heads) + 1)
    return order[heads], cuts, first[order[~new]]


def last_change(x: np.ndarray) -> int:
    """How many entries come before the last run of equal ones."""
    return len(x) - int(np.argmax(x[::-1] != x[-1])) if len(x) and x[0] != x[-1] else 0
