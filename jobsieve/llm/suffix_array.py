"""Numpy core of the repeated-passage operator: window keys, suffix order, common prefixes, merging."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_A, _B, _C = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9)
_PLACE = _U((1 << 24) - 1)
#: windows handled at once (bounds the place bits above) and in one run
_CHUNK, LONGEST_RUN = 1 << 22, 1024


def _words(data: bytes | np.ndarray, n: int) -> np.ndarray:
    """The 8 bytes from every place, as little-endian 64-bit values."""
    return np.ndarray((n,), dtype="<u8", buffer=data, strides=(1,))


def gram_hashes(data: bytes, k: int) -> np.ndarray:
    """64-bit hash of every k-byte string (k >= 8), by doubling."""
    h = _words(data, len(data) - 7) * _A
    h ^= h >> _U(29)
    size = 8
    while 2 * size <= k:
        h = h[:-size] * _B + h[size:]
        h ^= h >> _U(31)
        size *= 2
    if k > size:
        h = h[:size - k] * _C + h[k - size:]
        h ^= h >> _U(30)
    h = h * _A
    return h ^ (h >> _U(29))


def window_runs(data: bytes, width: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive ``width``-byte windows with one key: (key, first window, windows, inner).

    A window's key is the smallest hash of its k-byte strings, so equal windows have equal keys wherever they are.
    ``inner`` tells that a run holds the key's string more than once and may repeat windows within itself."""
    keys, starts, sizes, inner = [], [], [], []
    span = width - k + 1
    for a in range(0, len(data) - width + 1, _CHUNK):
        h = gram_hashes(data[a:a + _CHUNK + width - 1], k)
        low = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        step = 1
        while 2 * step <= span:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        if span > step:
            low = np.minimum(low[:step - span], low[span - step:])
        moved = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
        key = h[(low[moved] & _PLACE).astype(np.int64)]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        first = moved[new]
        size = np.diff(np.append(first, len(low)))
        many = np.diff(np.append(np.flatnonzero(new), len(moved))) > 1
        key = key[new]
        if len(size) and size.max() > LONGEST_RUN:  # cut long runs; every window stays in exactly one
            parts = -(-size // LONGEST_RUN)
            owner = np.repeat(np.arange(len(size)), parts)
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
            first, key, many = first[owner] + nth * LONGEST_RUN, key[owner], many[owner]
            size = np.minimum(size[owner] - nth * LONGEST_RUN, LONGEST_RUN)
        keys.append(key), starts.append(first + a), sizes.append(size), inner.append(many)
    if not keys:
        none = np.empty(0, dtype=np.int64)
        return none.astype(np.uint64), none, none, none.astype(bool)
    return np.concatenate(keys), np.concatenate(starts), np.concatenate(sizes), np.concatenate(inner)


def ranks(text: np.ndarray, windows: np.ndarray, width: int) -> np.ndarray:
    """Rank of each window start by the ``width`` bytes from there (equal strings share a rank).

    Larsson-Sadakane refinement: places are first ordered by 8 bytes; a place's rank is the first slot of its
    group; each round orders the members of groups that are still shared by the rank of the place as many bytes
    further as are already sorted, which doubles the depth; places alone in their group are never touched
    again. The last round, only at window starts, overlaps the two halves to reach ``width`` exactly."""
    n = len(text)
    padded = np.concatenate((text, np.zeros(width + 8, dtype=np.uint8)))
    key = _words(padded, n).byteswap()
    rank = np.full(n + width, -1, dtype=np.int64)
    order = np.argsort(key)
    sorted_key = key[order]
    head = np.concatenate(([True], sorted_key[1:] != sorted_key[:-1]))
    slot = np.arange(n)
    rank[order] = np.maximum.accumulate(np.where(head, slot, 0))
    alone = head & np.append(head[1:], True)
    shared, depth = order[~alone], 8
    while 2 * depth <= width and len(shared):
        shared = _refine(rank, shared, depth)
        depth *= 2
    if depth < width and len(shared):
        open_windows = windows[np.isin(rank[windows], rank[shared])]
        _refine(rank, open_windows, width - depth)
    return rank[windows]


def _refine(rank: np.ndarray, places: np.ndarray, ahead: int) -> np.ndarray:
    """Split the groups of ``places`` by the rank ``ahead`` bytes on; returns the places still sharing a group."""
    if not len(places):
        return places
    key = (rank[places].astype(np.uint64) << _U(32)) | (rank[places + ahead] + 1).astype(np.uint64)
    by = np.argsort(key)
    places, key = places[by], key[by]
    group = key >> _U(32)
    new_group = np.concatenate(([True], group[1:] != group[:-1]))
    new_key = np.concatenate(([True], key[1:] != key[:-1]))
    slot = np.arange(len(places))
    begin = np.maximum.accumulate(np.where(new_group, slot, 0))
    sub = np.maximum.accumulate(np.where(new_key, slot, 0))
    rank[places] += sub - begin
    return places[~(new_key & np.append(new_key[1:], True))]


def common_prefixes(text: np.ndarray, order: np.ndarray, seg_start: np.ndarray, seg_size: np.ndarray, width: int) -> np.ndarray:
    """Common prefix (at most ``width``) of every window with its predecessor in suffix order, by Kasai's rule.

    ``order`` lists window starts in suffix order. Segments are walked in parallel, each in text order: from one
    window to the next the common prefix falls by at most one, so comparison goes on where it stopped. It starts
    afresh where the rule gives no bound: at a capped prefix and where the predecessor was its segment's last."""
    words = _words(np.concatenate((text, np.zeros(width + 8, dtype=np.uint8))), len(text) + width)
    before = np.full(len(text), -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    last = np.zeros(len(text) + 1, dtype=bool)
    last[seg_start + seg_size - 1] = True
    out = np.zeros(len(text), dtype=np.int64)
    by = np.argsort(-seg_size, kind="stable")
    start, size = seg_start[by], seg_size[by]
    done = np.zeros(len(start), dtype=np.int64)
    for i in range(int(size[0]) if len(size) else 0):
        live = int(np.searchsorted(-size, -i, side="left"))
        p = start[:live] + i
        q = before[p]
        h = np.where(q >= 0, done[:live], 0)
        at = np.flatnonzero(q >= 0)
        while len(at):
            diff = words[p[at] + h[at]] ^ words[q[at] + h[at]]
            same = diff == 0
            low = diff & (~diff + _U(1))  # lowest set bit: its byte is the first that differs
            h[at] += np.where(same, 8, (np.log2(np.where(same, 1, low).astype(np.float64)) // 8).astype(np.int64))
            at = at[same & (h[at] < width)]
        h = np.minimum(h, width)
        out[p] = h
        done[:live] = np.where((h >= width) | (q < 0) | last[np.maximum(q, 0)], 0, np.maximum(h - 1, 0))
    return out


def repeated_windows(segments: list[bytes], width: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """One shard: per segment, which of its windows start anywhere else in the shard too.

    Also the window starts in suffix order and their numbers (window i is the i-th over all segments)."""
    text = np.frombuffer(b"".join(segments), dtype=np.uint8)
    sizes = np.array([len(s) for s in segments], dtype=np.int64)
    seg_start, seg_size = np.cumsum(sizes) - sizes, sizes - width + 1
    first = np.cumsum(seg_size) - seg_size
    owner = np.repeat(np.arange(len(segments)), seg_size)
    windows = seg_start[owner] + np.arange(len(owner)) - first[owner]
    number = np.argsort(ranks(text, windows, width), kind="stable")
    order = windows[number]
    prefix = common_prefixes(text, order, seg_start, seg_size, width)[order]
    full = prefix >= width
    again = full.copy()
    again[:-1] |= full[1:]
    found = np.zeros(len(windows), dtype=bool)
    found[number] = again
    return [found[a:a + n] for a, n in zip(first, seg_size)], order, number


def merge_runs(runs: list[np.ndarray]) -> list[np.ndarray]:
    """Sorted arrays of distinct values -> per array, which values another array holds too.

    Each array is looked up in the merged arrays before it by binary search and inserted at the places found."""
    hit = [np.zeros(len(r), dtype=bool) for r in runs]
    merged, origin = runs[0], [(np.zeros(len(runs[0]), dtype=np.int32), np.arange(len(runs[0])))] if runs else None
    who, where = origin[0]
    for i, r in enumerate(runs[1:], 1):
        at = np.searchsorted(merged, r)
        inside = at < len(merged)
        same = np.zeros(len(r), dtype=bool)
        same[inside] = merged[at[inside]] == r[inside]
        hit[i] |= same
        for w in np.unique(who[at[same]]):
            mine = at[same][who[at[same]] == w]
            hit[w][where[mine]] = True
        new = np.flatnonzero(~same)
        merged = np.insert(merged, at[new], r[new])
        who, where = np.insert(who, at[new], i), np.insert(where, at[new], new)
    return hit
