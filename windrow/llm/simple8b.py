"""Simple-8b: many small integers in one 64-bit word.

The top four bits of a word select how many values it holds and how wide they are. Values are packed in blocks of
``BLOCK``; each begins a new word, so the offsets of the blocks let all of them be unpacked at once. A value of
60 bits or more is an escape: its word holds the largest 60-bit number, and the value follows in a list.
"""

import numpy as np

BLOCK = 1024
#: Fixed: values in a word and bits of each, by selector.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE = np.uint64((1 << 60) - 1)


_SHORT_LENGTHS = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)


def _bit_lengths(values: np.ndarray) -> np.ndarray:
    if len(values) and values.max() < 1 << 16:
        return _SHORT_LENGTHS[values.astype(np.uint16)]
    if len(values) and values.max() < 1 << 53:
        return np.frexp(values.astype(np.float64))[1]
    high, low = values >> np.uint64(32), values & np.uint64(0xFFFFFFFF)
    return np.where(high > 0, np.frexp(high.astype(np.float64))[1] + 32, np.frexp(low.astype(np.float64))[1])


#: Blocks are laid out with this many empty places after each, so that no word of a block reaches into the next.
_STRIDE = BLOCK + int(COUNTS[0])


def _widest_choice(lengths: np.ndarray) -> np.ndarray:
    """For every place the selector that takes the most values from there. Empty places have length 0."""
    choice = np.full(len(lengths), len(COUNTS) - 1, np.uint8)
    # the greatest length among so many values from each place on; every count is at most twice the one before
    greatest, span = lengths, 1
    for selector in range(len(COUNTS) - 2, -1, -1):
        step = int(COUNTS[selector]) - span
        greatest = np.maximum(greatest, np.concatenate([greatest[step:], np.zeros(step, np.uint8)]))
        span += step
        np.putmask(choice, greatest <= int(WIDTHS[selector]), selector)
    return choice


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, offset of each block in them, escaped values."""
    values = np.asarray(values).astype(np.uint64, copy=False)
    n, n_blocks = len(values), -(-len(values) // BLOCK)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint64)
    escaped = values >= ESCAPE
    escapes = values[escaped]
    if len(escapes):
        values = np.where(escaped, ESCAPE, values)
    spread = np.zeros((n_blocks, _STRIDE), np.uint64)
    whole = n // BLOCK
    spread[:whole, :BLOCK] = values[: whole * BLOCK].reshape(whole, BLOCK)
    spread[whole:, : n - whole * BLOCK] = values[whole * BLOCK :]
    spread = spread.ravel()
    choice = _widest_choice(_bit_lengths(spread).astype(np.uint8))
    starts = np.arange(n_blocks, dtype=np.int64) * _STRIDE
    ends = starts + np.minimum(n - np.arange(n_blocks) * BLOCK, BLOCK)
    # all blocks advance together, a word at a time
    heads, blocks, place, open_blocks = [], [], starts.copy(), np.arange(n_blocks)
    while len(open_blocks):
        heads.append(place)
        blocks.append(open_blocks)
        place = place + COUNTS[choice[place]]
        left = place < ends[open_blocks]
        place, open_blocks = place[left], open_blocks[left]
    head, block = np.concatenate(heads), np.concatenate(blocks)
    order = np.argsort(block, kind="stable")
    head = head[order]
    offsets = np.concatenate([[0], np.cumsum(np.bincount(block, minlength=n_blocks))[:-1]]).astype(np.uint32)
    selectors = choice[head]
    words = selectors.astype(np.uint64) << np.uint64(60)
    spread = np.concatenate([spread, np.zeros(COUNTS[0], np.uint64)])
    for selector in np.unique(selectors):
        count, width = int(COUNTS[selector]), int(WIDTHS[selector])
        if width:
            rows = np.flatnonzero(selectors == selector)
            taken = spread[head[rows][:, None] + np.arange(count)]
            words[rows] |= np.bitwise_or.reduce(taken << (np.arange(count, dtype=np.uint64) * np.uint64(width)), axis=1)
    return words, offsets, escapes


def unpack(words: np.ndarray, offsets: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` values again, all blocks at once."""
    if not n:
        return np.zeros(0, np.uint64)
    n_blocks = len(offsets)
    selectors = (words >> np.uint64(60)).astype(np.uint8)
    counts = COUNTS[selectors]
    offsets = offsets.astype(np.int64)
    before = np.cumsum(counts) - counts
    words_in = np.diff(np.append(offsets, len(words)))
    head = before + np.repeat(np.arange(n_blocks) * _STRIDE - before[offsets], words_in)
    spread = np.zeros(n_blocks * _STRIDE, np.uint64)
    for selector in np.unique(selectors):
        count, width = int(COUNTS[selector]), int(WIDTHS[selector])
        if width:
            rows = np.flatnonzero(selectors == selector)
            shifts = np.arange(count, dtype=np.uint64) * np.uint64(width)
            spread[head[rows][:, None] + np.arange(count)] = (words[rows][:, None] >> shifts) & np.uint64((1 << width) - 1)
    out = spread.reshape(n_blocks, _STRIDE)[:, :BLOCK].ravel()[:n]
    if len(escapes):
        out[out == ESCAPE] = escapes
    return out
