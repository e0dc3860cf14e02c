"""Suffix arrays of many short strings in numpy: Larsson-Sadakane refinement and Kasai prefixes."""

from __future__ import annotations

import numpy as np

_SYMBOLS = 7  # symbols of nine bits in a word of 63


def laid_out(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols (bytes + 1, a 0 behind each string), the string of each place and its end mark."""
    return laid_out_bytes(np.frombuffer(b"".join(strings), np.uint8), np.array([len(s) for s in strings], np.int64))


def laid_out_bytes(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of strings laid end to end."""
    sizes = lengths + 1
    ends = np.cumsum(sizes) - 1
    owner = np.repeat(np.arange(len(sizes)), sizes)
    symbols = np.zeros(len(owner), np.int16)
    inner = np.ones(len(owner), bool)
    inner[ends] = False
    symbols[inner] = data.astype(np.int16) + 1
    return symbols, owner, ends[owner]


def _words(symbols: np.ndarray, count: int, bits: int) -> np.ndarray:
    """For each place ``count`` symbols from there as one number, zeros behind the last."""
    wide = np.zeros(len(symbols) + count, np.int64)
    wide[: len(symbols)] = symbols
    out = wide[: len(symbols)].copy()
    for i in range(1, count):
        out <<= bits
        out |= wide[i : i + len(symbols)]
    return out


def _ordered(key: np.ndarray, bits: int) -> np.ndarray:
    """What sorts keys below ``2**bits``; equal keys come in any order or as they stand. Keys that leave room are
    sorted with their places in the same word, which is several times faster than sorting places by keys."""
    room = max(len(key) - 1, 1).bit_length()
    if bits + room > 63:
        return np.argsort(key, kind="stable")
    packed = key << room
    packed |= np.arange(len(key))
    packed.sort()
    packed &= (1 << room) - 1
    return packed


def suffix_array(symbols: np.ndarray, owner: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Places sorted by the text from there to their string's end mark; end marks differ, by owner.

    A place's rank is the number of its group's first slot. Each round sorts the groups that are not
    yet single by the rank of the place ``h`` further on, which doubles the depth that is sorted.
    """
    n = len(symbols)
    place = np.arange(n)
    if not n:
        return place
    # symbols that occur, in order; the first key takes as many of them as leave room for a place
    occurs = np.zeros(int(symbols.max()) + 1, bool)
    occurs[symbols] = True
    bits = max(int(occurs.sum()).bit_length(), 1)
    first = max(1, min(16, (63 - max(n - 1, 1).bit_length()) // bits))
    key = _words((np.cumsum(occurs) - occurs[0])[symbols], first, bits)
    # what follows an end mark is not part of the text
    left = end - place
    for i in range(first - 1):
        near = np.flatnonzero(left == i)
        drop = (first - 1 - i) * bits
        key[near] = key[near] >> drop << drop
    marks = np.flatnonzero(left == 0)
    key[marks] = 0
    order = _ordered(key, first * bits)
    order[: len(marks)] = marks  # end marks stand alone, in the order of their strings
    ranked = key[order]
    head = np.ones(n, bool)
    head[1:] = ranked[1:] != ranked[:-1]
    head[: len(marks) + 1] = True
    slot = np.maximum.accumulate(np.where(head, place, 0))
    rank = np.empty(n, np.int32 if n < 1 << 31 else np.int64)
    rank[order] = slot
    h = first
    wide = max(n - 1, 1).bit_length()
    while True:
        single = head & np.append(head[1:], True)
        todo = np.flatnonzero(~single)
        if not len(todo):
            return order
        these = order[todo]
        group = rank[these]
        ahead = rank[np.minimum(these + h, end[these])]
        # groups stay where they are, so a group's number among those left does for its rank
        number = np.cumsum(head[todo]) - 1
        if 3 * wide <= 63:
            by = _ordered(number << wide | ahead, 2 * wide)
        else:
            by = np.argsort((group.astype(np.int64) << 32) | ahead, kind="stable")
        these, ahead = these[by], ahead[by]
        order[todo] = these
        new = np.ones(len(todo), bool)
        new[1:] = (group[1:] != group[:-1]) | (ahead[1:] != ahead[:-1])
        head[todo] = new
        slot = np.maximum.accumulate(np.where(new, todo, 0))
        rank[these] = slot
        h *= 2


def common_prefixes(symbols: np.ndarray, end: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each suffix with the one before it in the array.

    Kasai's observation, place by place: the prefix shared at a place is at most one shorter than
    at the place before. Where both texts also agree one symbol earlier, it is exactly one shorter;
    only the other places are compared, seven symbols at a time.
    """
    n = len(order)
    lcp = np.zeros(n, np.int64)
    if n < 2:
        return lcp
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    place = np.arange(n)
    has = before >= 0
    earlier = np.zeros(n, bool)
    inner = has & (place > 0) & (before > 0)
    i = place[inner]
    earlier[inner] = (symbols[i - 1] == symbols[before[i] - 1]) & (symbols[i - 1] > 0)
    start = np.flatnonzero(has & ~earlier)
    length = np.zeros(len(start), np.int64)
    other = before[start]
    limit = np.minimum(end[start] - start, end[other] - other)
    words = _words(symbols, _SYMBOLS, 9)
    open_ = np.arange(len(start))
    while len(open_):
        at = length[open_]
        unlike = words[np.minimum(start[open_] + at, n - 1)] ^ words[np.minimum(other[open_] + at, n - 1)]
        same = np.zeros(len(open_), np.int64)
        for i in range(_SYMBOLS):
            same += unlike < 1 << 9 * i
        length[open_] = np.minimum(at + same, limit[open_])
        open_ = open_[(unlike == 0) & (length[open_] < limit[open_])]
    reach = np.zeros(n, np.int64)
    reach[start] = length + start
    shared = np.maximum.accumulate(reach) - place
    shared[~has] = 0
    lcp[:] = shared[order]
    return np.maximum(lcp, 0)
