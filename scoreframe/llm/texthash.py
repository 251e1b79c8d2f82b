"""Vectorised hashing of words in whole batches of texts with numpy; small helpers for use inside tasks."""

from __future__ import annotations

import numpy as np

_ODD = 0x9E3779B97F4A7C15


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers_made = [np.zeros(0, np.uint64)] * 2


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the odd number and of its inverse, n at least; the longest made so far are kept."""
    if len(_powers_made[0]) < n:
        with np.errstate(over="ignore"):
            for k, base in enumerate((_ODD, pow(_ODD, -1, 1 << 64))):
                made = np.full(1 << max(21, (n - 1).bit_length()), base, np.uint64)
                made[0] = 1
                _powers_made[k] = np.cumprod(made, out=made)
    return _powers_made


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte runs data[start:end], from running sums of bytes times powers of an odd number."""
    up, down = _powers(len(data))
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])])
        return mix64((sums[ends] - sums[starts]) * down[starts])


#: 0: ASCII white space; 1: word bytes; 2: other ASCII (punctuation), for tokens of words and of punctuation.
CLASSES = np.array([0 if b in b" \t\n\x0b\x0c\r" else 1 if b >= 128 or chr(b).isalnum() or b == 95 else 2 for b in range(256)], np.uint8)
#: As above but with all that isn't white space in one class.
SPACED = np.minimum(CLASSES, 1)


def tokens(texts: list[bytes], classes: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of one class, but for class 0, in a batch of texts: (bytes of the batch, doc of each run, start, end)."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    kind = classes[data]
    edge = np.flatnonzero(np.diff(kind, prepend=np.uint8(0)))
    edges = np.append(edge, len(data))
    starts, ends = edges[:-1], edges[1:]
    real = kind[starts] != 0
    starts, ends = starts[real], ends[real]
    ends_of_docs = np.cumsum([len(t) + 1 for t in texts])
    return data, np.searchsorted(ends_of_docs, starts, side="right"), starts, ends


def batches(sizes, most: int = 4_000_000):
    """Slices of rows that hold about ``most`` bytes together, one row at least."""
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield slice(begin, i)
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield slice(begin, len(sizes))
