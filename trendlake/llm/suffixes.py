"""Suffix arrays of many short texts in numpy: Larsson-Sadakane refinement, Kasai prefixes, binary search."""

from __future__ import annotations

import numpy as np

SPAN = 50
#: Bytes of the first sorting: seven of nine bits each fill a word.
HEAD = 7
_NONE = np.int64(np.iinfo(np.int64).max)


def words(texts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each place in each row the next ``HEAD`` bytes as one number, nine bits a byte; a byte behind the end is below all."""
    wide = np.where(np.arange(texts.shape[1]) < sizes[:, None], texts.astype(np.uint64) + np.uint64(1), np.uint64(0))
    wide = np.pad(wide, ((0, 0), (0, HEAD)))
    out = np.zeros(texts.shape, np.uint64)
    for k in range(HEAD):
        out <<= np.uint64(9)
        out |= wide[:, k : k + texts.shape[1]]
    return out


def suffix_array(texts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all suffixes in order, and the rank of each place (0 behind a row's end).

    ``texts`` has a row for each text, ``sizes`` their lengths; a place is row * width + column. A suffix ends
    with its row; equal suffixes follow the order of rows. As Larsson and Sadakane do, suffixes are
    sorted by their first ``HEAD`` bytes; then only groups that are still equal are sorted by the rank of the
    suffix h places on, h doubling.
    """
    rows, width = texts.shape
    order = np.flatnonzero((np.arange(width) < sizes[:, None]).ravel())
    n = len(order)
    first = words(texts, sizes).ravel()
    order = order[np.argsort(first[order])]
    ordered = first[order]
    head = np.ones(n, bool)
    head[1:] = ordered[1:] != ordered[:-1]
    rank = np.zeros(rows * width + 1, np.int64)

    def settle(at: np.ndarray, is_head: np.ndarray) -> np.ndarray:
        """Ranks of the places at ``at`` of the order from their group heads; those of groups that are still open."""
        begins = np.flatnonzero(is_head)
        group = np.cumsum(is_head) - 1
        rank[order[at]] = at[begins][group] + 1
        return at[np.diff(np.append(begins, len(at)))[group] > 1]

    open_ = settle(np.arange(n), head)
    h = HEAD
    while len(open_):
        places = order[open_]
        if h < width:
            on = np.where(places % width + h < width, rank[np.minimum(places + h, rows * width)], 0)
        else:
            on = places // width  # equal to their ends
        key = rank[places].astype(np.uint64) * np.uint64(max(n, rows) + 1) + on.astype(np.uint64)
        by = np.argsort(key)
        order[open_], key = places[by], key[by]
        head = np.ones(len(open_), bool)
        head[1:] = key[1:] != key[:-1]
        open_ = settle(open_, head)
        h *= 2
    return order, rank


def common_prefixes(texts: np.ndarray, sizes: np.ndarray, order: np.ndarray, rank: np.ndarray, most: int = SPAN) -> np.ndarray:
    """For each suffix in order, the bytes (at most ``most``) that it shares with the one before it.

    Kasai's walk: one place further on in a text, at most one byte of the last common prefix is lost.
    All texts are walked side by side.
    """
    rows, width = texts.shape
    flat, out, h = texts.ravel(), np.zeros(len(order), np.int64), np.zeros(rows, np.int64)
    for c in range(width):
        mine = np.flatnonzero(sizes > c)
        place = mine * width + c
        at = rank[place] - 1
        before = np.where(at > 0, order[at - 1], -1)
        room = np.minimum(np.minimum(sizes[mine] - c, sizes[before // width] - before % width), most)
        room[before < 0] = 0
        kept = np.minimum(np.maximum(h[mine] - 1, 0), room)
        live = np.flatnonzero(kept < room)
        while len(live):
            same = flat[place[live] + kept[live]] == flat[before[live] + kept[live]]
            live = live[same]
            kept[live] += 1
            live = live[kept[live] < room[live]]
        h[mine] = kept
        out[at] = kept
    return out


def spans_of(texts: np.ndarray, sizes: np.ndarray, least: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct strings of ``span`` bytes in order: words, the least ``least`` of their rows, and for each row and column its string or -1."""
    rows, width = texts.shape
    order, rank = suffix_array(texts, sizes)
    shared = common_prefixes(texts, sizes, order, rank, span)
    group = np.cumsum(shared < span) - 1
    whole = order % width + span <= sizes[order // width]
    order, group = order[whole], group[whole]
    number = np.full(rows * width, -1, np.int32)
    if not len(order):
        return np.zeros((0, (span + 7) // 8), np.uint64), np.zeros(0, np.int64), number.reshape(rows, width)[:, : width - span + 1]
    head = np.append(True, group[1:] != group[:-1])
    begins = np.flatnonzero(head)
    number[order] = np.cumsum(head) - 1
    low = np.minimum.reduceat(least[order // width], begins)
    return key_words(texts, order[begins], span), low, number.reshape(rows, width)[:, : width - span + 1].copy()


def key_words(texts: np.ndarray, places: np.ndarray, span: int) -> np.ndarray:
    """The ``span`` bytes at each place as big-endian words, the last filled with zeros."""
    width = texts.shape[1]
    count = (span + 7) // 8
    wide = np.lib.stride_tricks.sliding_window_view(texts.ravel(), span)[places] if len(places) else np.zeros((0, span), np.uint8)
    out = np.zeros((len(places), count * 8), np.uint8)
    out[:, :span] = wide
    assert width >= span
    return out.view(">u8").astype(np.uint64)


def find(table: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """By binary search, the first row of the sorted ``table`` not below each query; both are rows of words."""
    lo = np.searchsorted(table[:, 0], queries[:, 0], "left") if len(table) else np.zeros(len(queries), np.int64)
    hi = np.searchsorted(table[:, 0], queries[:, 0], "right") if len(table) else lo.copy()
    open_ = np.flatnonzero(lo < hi) if table.shape[1] > 1 else []
    while len(open_):
        mid = (lo[open_] + hi[open_]) // 2
        ours, theirs = table[mid, 1:], queries[open_, 1:]
        differ = ours != theirs
        first = differ.argmax(axis=1)[:, None]
        below = np.take_along_axis(differ, first, 1)[:, 0] & (np.take_along_axis(ours, first, 1) < np.take_along_axis(theirs, first, 1))[:, 0]
        lo[open_[below]] = mid[below] + 1
        hi[open_[~below]] = mid[~below]
        open_ = open_[lo[open_] < hi[open_]]
    return lo


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted parts of (words, least) as one sorted table of distinct strings, each with its least value.

    Parts are merged two by two: each string of the smaller one is found in the larger by binary search.
    """
    parts = sorted(parts, key=lambda p: -len(p[0]))
    while len(parts) > 1:
        (ours, low), (theirs, other) = parts[-2], parts[-1]
        at = find(ours, theirs)
        there = np.flatnonzero(at < len(ours))
        there = there[(ours[at[there]] == theirs[there]).all(axis=1)]
        low = low.copy()
        np.minimum.at(low, at[there], other[there])
        new = np.ones(len(theirs), bool)
        new[there] = False
        whole = np.insert(ours, at[new], theirs[new], axis=0), np.insert(low, at[new], other[new])
        parts = sorted([*parts[:-2], whole], key=lambda p: -len(p[0]))
    return parts[0]


def least_of(texts: np.ndarray, sizes: np.ndarray, least: np.ndarray, part: int, span: int = SPAN) -> np.ndarray:
    """For each row and column the least value of all rows that hold its ``span`` bytes; the greatest number where fewer are left.

    Every ``part`` rows have a suffix array of their own; parts are merged by binary search.
    """
    cuts = list(range(0, len(texts), part))
    found = [spans_of(texts[a : a + part], sizes[a : a + part], least[a : a + part], span) for a in cuts]
    if not found:
        return np.zeros((0, texts.shape[1] - span + 1), np.int64)
    table, low = merged([(w, v) for w, v, _ in found])
    out = np.full((len(texts), texts.shape[1] - span + 1), _NONE)
    for a, (own, own_low, number) in zip(cuts, found, strict=True):
        values = own_low if len(found) == 1 else low[find(table, own)]
        some = number >= 0
        out[a : a + part][some] = values[number[some]]
    return out
