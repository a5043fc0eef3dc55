"""Content-defined anchors of a text's byte windows.

Every window of LENGTH bytes is given the GRAM bytes of the least hash that lie in it. Equal
windows get equal grams at equal offsets, wherever they are, so a window can only be repeated
where its anchor's gram is repeated.
"""

from __future__ import annotations

import numpy as np

from . import common as C

LENGTH, GRAM = 100, 32
SPAN = LENGTH - GRAM + 1  # grams in a window


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minima of all runs of `width` values, by minima from and to block borders."""
    n = len(x)
    pad = -n % width
    y = np.concatenate((x, np.full(pad, np.iinfo(x.dtype).max, x.dtype))).reshape(-1, width)
    fore = np.minimum.accumulate(y, axis=1).ravel()
    back = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], fore[width - 1 : n])


def anchors(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: text, first and last window, anchor (all in the text), gram hash.

    Of equal hashes in a window the first is the anchor. Hashes are compared by 32 bits at
    every size, so the choice depends on the window's bytes alone.
    """
    none = np.zeros(0, dtype=np.int64)
    n = len(data)
    if n < LENGTH:
        return none, none, none, none, none.view(np.uint64)
    sums, down = C.prefix_sums(data, False)
    at = np.arange(n - GRAM + 1)
    h = C.mix((sums[GRAM:] - sums[: n - GRAM + 1]) * down[: n - GRAM + 1])
    low = np.uint64(0xFFFFFFFF)
    pos = (sliding_min((h & ~low) | at.astype(np.uint64), SPAN) & low).astype(np.int64)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))[: len(pos)]
    valid = at[: len(pos)] + LENGTH <= off[1:][doc]
    p = np.flatnonzero(valid)
    if not len(p):
        return none, none, none, none, none.view(np.uint64)
    cut = np.flatnonzero((pos[p][1:] != pos[p][:-1]) | (doc[p][1:] != doc[p][:-1])) + 1
    lo = p[np.concatenate(([0], cut))]
    hi = p[np.concatenate((cut - 1, [len(p) - 1]))]
    a = pos[lo]
    begin = off[doc[lo]]
    return doc[lo], lo - begin, hi - begin, a - begin, h[a]
