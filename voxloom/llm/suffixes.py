"""Suffix arrays of integer sequences by refinement of groups, and exact common prefixes."""

from __future__ import annotations

import numpy as np

from voxloom.llm.common import heads


def refine(rank: np.ndarray, sa: np.ndarray, active: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One doubling step. ``rank`` is the first place of a suffix's group in ``sa``; only ``active`` suffixes
    (those in groups of several) are sorted, by the group of what follows them. Returns the new active ones
    and their order; ``rank`` and ``sa`` change in place."""
    order = np.lexsort((second, rank[active]))
    active, second = active[order], second[order]
    old = rank[active]
    fresh = np.r_[True, old[1:] != old[:-1]]
    place = old + np.arange(len(active)) - heads(fresh)
    split = fresh | np.r_[True, second[1:] != second[:-1]]
    head = heads(split)
    sa[place] = active
    rank[active] = place[head]
    size = np.bincount(head, minlength=len(active))
    return active[size[head] > 1], place


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rank, suffix array and active suffixes after sorting by a first key."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    head = heads(np.r_[True, ordered[1:] != ordered[:-1]]) if len(keys) else np.zeros(0, np.int64)
    rank = np.empty(len(keys), np.int64)
    rank[order] = head
    size = np.bincount(head, minlength=len(keys))
    return rank, order, order[size[head] > 1]


def document_suffixes(ids: np.ndarray, doc: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array of several documents at once, grouped by document, and the ranks at lengths 1, 2, 4, ….

    ``ids`` are symbols, ``doc`` the document of each place, ``end`` where it ends. Suffixes of different
    documents never share a group. Equal ranks at length h mean h equal symbols in one document.
    """
    rank, sa, active = grouped((doc.astype(np.int64) << 32) | ids)
    levels, h = [rank.copy()], 1
    while len(active):
        there = active + h
        inside = there < end[active]
        second = np.where(inside, rank[np.where(inside, there, 0)], -1)
        active, _ = refine(rank, sa, active, second)
        h *= 2
        levels.append(rank.copy())
    return sa, levels


def common_prefix(a: np.ndarray, b: np.ndarray, end_a: np.ndarray, end_b: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Symbols that the suffixes at ``a`` and ``b`` share, by binary steps over the stored ranks."""
    a, b, found = a.copy(), b.copy(), np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = (a < end_a) & (b < end_b)
        same = inside & (levels[k][np.where(inside, a, 0)] == levels[k][np.where(inside, b, 0)])
        step = np.where(same, 1 << k, 0)
        a, b, found = a + step, b + step, found + step
    return found
