"""Deep-shallow sorting of byte strings of one width, with the common prefixes of neighbours.

Multikey quicksort splits the strings by words of eight bytes, three ways around a pivot, down
to a shallow depth. Strings that still tie have long common prefixes; they go into blind
tries, whose nodes know only the word at which their strings branch, so what the strings of a
node have in common is never looked at again. Both work on all parts of a level at once, in
numpy; the memory is some copies of the strings.
"""

from __future__ import annotations

import numpy as np

WORD, SHALLOW = 8, 32


def _as_words(rows: np.ndarray) -> np.ndarray:
    n, width = rows.shape
    padded = np.zeros((n, -(-width // WORD) * WORD), dtype=np.uint8)
    padded[:, :width] = rows
    return padded.view(">u8").astype(np.uint64)


def _starts(group: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))


def _quicksort(words: np.ndarray, stop: int) -> tuple[np.ndarray, np.ndarray]:
    """The strings' order by their first `stop` words, and each place's group of strings that tie there."""
    n = len(words)
    order, group = np.arange(n), np.zeros(n, dtype=np.int64)
    depth = np.zeros(n, dtype=np.int64)  # by place: words that its part is known to share
    todo = np.arange(n)
    while len(todo):
        part = group[todo]
        first = _starts(part)
        size = np.diff(np.append(first, len(todo)))
        key = words[order[todo], depth[todo]]
        three = np.sort(np.stack((key[first], key[first + size // 2], key[first + size - 1])), axis=0)
        pivot = np.repeat(three[1], size)
        side = (key > pivot).astype(np.int64) * 2 + (key == pivot)
        cell = np.repeat(np.arange(len(first)) * 3, size) + side
        move = np.argsort(cell, kind="stable")
        order[todo] = order[todo][move]
        depth[todo] += (cell[move] % 3) == 1
        # a part's name is its first place, so names stay in order
        cell = cell[move]
        begin = _starts(cell)
        group[todo] = np.repeat(todo[begin], np.diff(np.append(begin, len(todo))))
        alone = np.repeat(np.diff(np.append(begin, len(todo))) == 1, np.diff(np.append(begin, len(todo))))
        todo = todo[~alone & (depth[todo] < stop)]
    return order, group


def _blind_tries(words: np.ndarray, order: np.ndarray, group: np.ndarray, depth: int) -> None:
    """Put the strings of each group, which share `depth` words, in order; in place."""
    width = words.shape[1]
    first = _starts(group)
    size = np.diff(np.append(first, len(group)))
    todo = np.flatnonzero(np.repeat(size > 1, size))
    while len(todo) and depth < width:
        node = group[todo]
        first = _starts(node)
        size = np.diff(np.append(first, len(todo)))
        mine = words[order[todo]]
        differ = mine[:, depth:] != np.repeat(mine[first], size, axis=0)[:, depth:]
        at = np.where(differ.any(axis=1), differ.argmax(axis=1) + depth, width)
        branch = np.repeat(np.minimum.reduceat(at, first), size)
        leaf = branch == width  # all strings of the node are equal
        todo, branch, mine = todo[~leaf], branch[~leaf], mine[~leaf]
        if not len(todo):
            return
        edge = mine[np.arange(len(todo)), branch]
        node = group[todo]
        move = np.lexsort((edge, node))
        order[todo] = order[todo][move]
        edge = edge[move]
        begin = np.flatnonzero(np.concatenate(([True], (node[1:] != node[:-1]) | (edge[1:] != edge[:-1]))))
        size = np.diff(np.append(begin, len(todo)))
        group[todo] = np.repeat(todo[begin], size)
        todo = todo[np.repeat(size > 1, size)]


def sort_strings(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp) of a (strings, width) byte matrix: lcp[i] is the common prefix of order[i - 1] and order[i], lcp[0] is 0."""
    n, width = rows.shape
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    words = _as_words(rows)
    stop = min(SHALLOW // WORD, words.shape[1])
    order, group = _quicksort(words, stop)
    _blind_tries(words, order, group, stop)
    lcp = np.zeros(n, dtype=np.int64)
    near = rows[order]
    differ = near[1:] != near[:-1]
    lcp[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return order, lcp
