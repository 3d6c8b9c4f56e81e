"""Suffix trees of word sequences, one for each prefix, grown side by side in numpy."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Nodes(NamedTuple):
    """Internal nodes of suffix trees: the words on the way from the root, and their leaves as a range of ``leaves``."""

    depth: np.ndarray
    first: np.ndarray
    end: np.ndarray
    leaves: np.ndarray


def subtrees(x: np.ndarray, starts: np.ndarray, prefix: np.ndarray, most: int, times: np.ndarray) -> Nodes:
    """The internal nodes of the suffix tree of each prefix, down to a depth of ``most`` words.

    ``x`` are word ids, ``starts`` where the suffixes begin (each has ``most`` words), ``prefix`` the number of the prefix group a
    suffix belongs to, and ``times`` how often it occurs. A suffix that no other shares its way with leaves the work, unless it
    occurs several times itself. A node stands where the way branches, and at depth ``most``.
    """
    width = int(x.max(initial=0)) + 1
    order = np.argsort(prefix, kind="stable")
    slots = np.arange(len(starts))
    group = np.unique(prefix[order], return_inverse=True)[1] if len(order) else order
    depths, firsts, ends = [], [], []
    for depth in range(most + 1):
        if not len(slots):
            break
        heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        sizes = np.diff(np.append(heads, len(group)))
        several = np.add.reduceat(times[order[slots]], heads) > 1
        if depth == most:
            depths.append(np.full(int(several.sum()), depth))
            firsts.append(slots[heads][several])
            ends.append(slots[heads][several] + sizes[several])
            break
        alive = np.repeat(several, sizes)
        slots, group = slots[alive], group[alive]
        if not len(slots):
            break
        # one word further: within a group, by the next word
        group = np.unique(group, return_inverse=True)[1]
        key = group * width + x[starts[order[slots]] + depth]
        by = np.argsort(key, kind="stable")
        order[slots] = order[slots[by]]
        key = key[by]
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        finer = np.cumsum(fresh) - 1
        parents = group[by]
        begin = np.flatnonzero(np.concatenate([[True], parents[1:] != parents[:-1]]))
        last = np.append(begin[1:], len(parents))
        branching = finer[last - 1] > finer[begin]
        depths.append(np.full(int(branching.sum()), depth))
        firsts.append(slots[begin[branching]])
        ends.append(slots[last[branching] - 1] + 1)
        group = finer
    none = np.zeros(0, np.int64)
    return Nodes(*(np.concatenate([none, *parts]) for parts in (depths, firsts, ends)), order)


def deep_leaves(nodes: Nodes, least: int) -> np.ndarray:
    """The suffixes below internal nodes of at least ``least`` words: those with a repeat of that length."""
    deep = nodes.depth >= least
    edges = np.zeros(len(nodes.leaves) + 1, np.int64)
    np.add.at(edges, nodes.first[deep], 1)
    np.add.at(edges, nodes.end[deep], -1)
    return nodes.leaves[np.cumsum(edges[:-1]) > 0]
