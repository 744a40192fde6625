"""Deep-shallow sorting of suffixes, to a bounded depth.

Multikey quicksort orders suffixes by their first bytes, eight at a time: the segments that are still open are cut three
ways about a pivot, all in one vectorised round; smaller and larger ones stay at their depth, equal ones go on to the
next eight bytes. Groups that are equal to the shallow depth are ordered by blind tries. A group's members are held
against one leaf, each once, which gives the node of the leaf's path where the member branches off and the byte that it
branches on; what hangs there is a trie of its own, whose members never look at the skipped prefix again.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 24


def words_at(buffer: np.ndarray) -> np.ndarray:
    """The eight bytes from every position, first byte most significant; the buffer's end is padded with zeros."""
    x = np.concatenate([buffer, np.zeros(8, np.uint8)]).astype(np.uint64)
    for step in (1, 2, 4):
        x = (x[:-step] << np.uint64(8 * step)) | x[step:]
    return x[: len(buffer)]


def _heads(group: np.ndarray) -> np.ndarray:
    """Whether a sorted member is the first of its group."""
    return np.concatenate([[True], group[1:] != group[:-1]])[: len(group)]


def _spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of all members of segments."""
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - first, size)


def multikey_quicksort(words: np.ndarray, starts: np.ndarray, depth: int, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes by group and their first ``depth`` bytes (a multiple of eight), and the group of each that is equal in them.

    Pivots are medians of three drawn with a fixed seed, so that no order of the input makes the rounds many.
    """
    order = np.arange(len(starts)) if group is None else np.argsort(group, kind="stable")
    head = _heads(np.zeros(len(starts)) if group is None else group[order])
    rng = np.random.default_rng(0)
    first = np.flatnonzero(head)
    size = np.diff(np.append(first, len(starts)))
    at_depth = np.zeros(len(first), np.int64)
    while True:
        live = (size > 1) & (at_depth < depth)
        first, size, at_depth = first[live], size[live], at_depth[live]
        if not len(first):
            return order, np.cumsum(head) - 1
        place = _spread(first, size)
        member = order[place]
        key = words[starts[member] + np.repeat(at_depth, size)]
        begin = np.cumsum(size) - size
        a, b, c = key[begin + (rng.random((3, len(size))) * size).astype(np.int64)]
        pivot = np.repeat(np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c)), size)
        less, equal = key < pivot, key == pivot
        # stable three-way partition: members ahead of one on its own side
        few, same = np.cumsum(less) - less, np.cumsum(equal) - equal
        few, same = few - np.repeat(few[begin], size), same - np.repeat(same[begin], size)
        n_less, n_equal = np.add.reduceat(less, begin, dtype=np.int64), np.add.reduceat(equal, begin, dtype=np.int64)
        inside = np.arange(len(key)) - np.repeat(begin, size)
        to = np.where(less, few, np.where(equal, same + np.repeat(n_less, size), inside - few - same + np.repeat(n_less + n_equal, size)))
        order[np.repeat(first, size) + to] = member
        first = np.stack([first, first + n_less, first + n_less + n_equal], axis=1).ravel()
        size = np.stack([n_less, n_equal, size - n_less - n_equal], axis=1).ravel()
        at_depth = np.stack([at_depth, at_depth + 8, at_depth], axis=1).ravel()
        head[first[size > 0]] = True


def shared_prefix(words: np.ndarray, a: np.ndarray, b: np.ndarray, known: np.ndarray, depth: int) -> np.ndarray:
    """Bytes that the suffixes at a and b share, up to ``depth``; the first ``known`` ones are not looked at."""
    out, going = known.copy(), np.arange(len(a))
    while len(going):
        differ = words[a[going] + out[going]] ^ words[b[going] + out[going]]
        stop = going[differ != 0]
        out[stop] += _leading_bytes(differ[differ != 0])
        going = going[differ == 0]
        out[going] += 8
        going = going[out[going] < depth]
    return np.minimum(out, depth)


def blind_tries(words: np.ndarray, starts: np.ndarray, order: np.ndarray, group: np.ndarray, shallow: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order suffixes inside the groups that are equal to the shallow depth, down to ``depth`` bytes."""
    order, head = order.copy(), _heads(group)
    first = np.flatnonzero(head)
    size = np.diff(np.append(first, len(order)))
    known = np.full(len(first), shallow, np.int64)
    far = (depth + 1) * 256
    while True:
        live = (size > 1) & (known < depth)
        first, size, known = first[live], size[live], known[live]
        if not len(first):
            return order, np.cumsum(head) - 1
        place = _spread(first, size)
        pos, leaf = starts[order[place]], np.repeat(starts[order[first]], size)
        node = shared_prefix(words, pos, leaf, np.repeat(known, size), depth)
        top = np.uint64(56)
        byte, own = ((words[x + node] >> top).astype(np.int64) for x in (pos, leaf))
        # in-order walk of the leaf's path: smaller branches from the root down, the leaf, larger ones back up
        walk = np.where(node == depth, far, np.where(byte < own, node * 256 + byte, far + (depth - node) * 256 + byte + 1))
        tree = np.repeat(np.arange(len(size)), size)
        by = np.argsort(tree * (2 * far + 512) + walk, kind="stable")
        order[place] = order[place[by]]
        walk, node = walk[by], node[by]
        cut = np.flatnonzero(_heads(tree) | _heads(walk))
        first, size = place[cut], np.diff(np.append(cut, len(place)))
        head[first] = True
        known = np.where(walk[cut] == far, depth, node[cut] + 1)


def _leading_bytes(x: np.ndarray) -> np.ndarray:
    """Zero bytes before the first other one."""
    out = np.zeros(len(x), np.int64)
    for k in range(1, 8):
        out += x < (np.uint64(1) << np.uint64(64 - 8 * k))
    return out


def deep_shallow_sort(buffer: np.ndarray, starts: np.ndarray, depth: int, shallow: int = SHALLOW, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes by their first ``depth`` bytes, and group numbers that rise along it: equal ones are equal to that depth.

    Every suffix must have ``depth`` bytes in the buffer. With group, suffixes of different groups are kept apart, and
    groups come in the order of their numbers.
    """
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    shallow = min(shallow, depth) // 8 * 8
    words = np.concatenate([words_at(buffer), np.zeros(8, np.uint64)])
    order, group = multikey_quicksort(words, starts, shallow, group)
    return blind_tries(words, starts, order, group, shallow, depth)
