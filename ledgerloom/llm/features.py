"""Hashed text features, computed for a batch of documents at once with numpy.

Tokens are runs of word bytes (letters, digits, every byte of non-ASCII characters) or runs of
punctuation; white space separates. Bytes of A-Z count as a-z. A token's hash is a difference of
prefix hashes modulo 2**64, so hashing costs a few array operations a byte.
"""

from __future__ import annotations

import numpy as np

PIECE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _classes() -> np.ndarray:
    kinds = np.full(256, 2, np.uint8)
    kinds[128:] = 1
    for low, high in ((48, 58), (65, 91), (97, 123)):
        kinds[low:high] = 1
    kinds[[0, 9, 10, 11, 12, 13, 32]] = 0
    return kinds


def _lower() -> np.ndarray:
    table = np.arange(256, dtype=np.uint64)
    table[65:91] += 32
    return table + np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


CLASSES, LOWER = _classes(), _lower()
_tables: dict[str, np.ndarray] = {}


def _table(name: str, base: int, n: int) -> np.ndarray:
    if len(_tables.get(name, ())) < n:
        _tables[name] = _powers(base, max(n, PIECE_BYTES + 2))
    return _tables[name][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _piece_tokens(buf: np.ndarray, prefixes: tuple[int, ...]) -> tuple[np.ndarray, ...]:
    kinds = CLASSES[buf]
    change = np.flatnonzero(kinds[1:] != kinds[:-1]) + 1
    edges = np.concatenate(([0], change, [len(buf)]))
    keep = kinds[edges[:-1]] != 0
    starts, ends = edges[:-1][keep], edges[1:][keep]
    sums = np.empty(len(buf) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(LOWER[buf] * _table("power", _BASE, len(buf)), dtype=np.uint64, out=sums[1:])
    back = _table("inverse", _INVERSE, len(buf) + 1)[starts]
    heads = []
    for n in prefixes:
        fits = (ends - starts >= n) & (kinds[starts] == 1)
        cut = np.where(fits, starts + n, starts)
        heads.append(np.where(fits, mix((sums[cut] - sums[starts]) * back + np.uint64(n)), np.uint64(0)))
    return (starts, mix((sums[ends] - sums[starts]) * back), *heads)


def token_hashes(texts: list[str | None], prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """For all tokens in order: index of the document, hash, and a hash for each prefix length (0: shorter)."""
    docs, hashes, heads = [], [], [[] for _ in prefixes]

    def take(owners: list[int], parts: list[bytes]) -> None:
        joined = b"\0".join(parts) + b"\0"
        begin = np.cumsum([0] + [len(p) + 1 for p in parts[:-1]])
        starts, h, *more = _piece_tokens(np.frombuffer(joined, np.uint8), prefixes)
        docs.append(np.asarray(owners, np.int64)[np.searchsorted(begin, starts, "right") - 1])
        hashes.append(h)
        for have, new in zip(heads, more, strict=True):
            have.append(new)

    owners, parts, size = [], [], 0
    for i, text in enumerate(texts):
        data = (text or "").encode("utf-8", "replace")
        at = 0
        while at < len(data) or at == 0:
            room = PIECE_BYTES - size
            end = len(data) if len(data) - at <= room else max(data.rfind(b" ", at, at + room), data.rfind(b"\n", at, at + room))
            if end <= at and at < len(data):
                if size:  # start a new piece
                    take(owners, parts)
                    owners, parts, size = [], [], 0
                    continue
                end = min(len(data), at + PIECE_BYTES)  # one token longer than a piece
            owners.append(i)
            parts.append(data[at:end])
            size += end - at + 1
            at = end if end > at else at + 1
            if size >= PIECE_BYTES - 1:
                take(owners, parts)
                owners, parts, size = [], [], 0
    if parts:
        take(owners, parts)
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), [np.zeros(0, np.uint64) for _ in prefixes]
    return np.concatenate(docs), np.concatenate(hashes), [np.concatenate(x) for x in heads]


def sparse_rows(texts: list[str | None], bits: int, ngrams: int = 2, prefixes: tuple[int, ...] = (), presence: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents as sparse rows (pointer, feature, value).

    Features are hashes of token n-grams, of word prefixes, and one that counts tokens equal to
    the one before. A value is 1 if ``presence``, else the square root of the count, each row
    scaled to length 1.
    """
    docs, h, heads = token_hashes(texts, prefixes)
    top = np.uint64(64 - bits)
    owner, ids = [docs], [h >> top]
    gram = h
    for n in range(2, ngrams + 1):
        if len(h) < n:
            break
        gram = mix(gram[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[n - 1 :] + np.uint64(n))
        same = docs[n - 1 :] == docs[: len(docs) - n + 1]
        owner.append(docs[n - 1 :][same])
        ids.append(gram[same] >> top)
    again = np.flatnonzero((h[1:] == h[:-1]) & (docs[1:] == docs[:-1])) if len(h) > 1 else np.zeros(0, np.int64)
    owner.append(docs[again])
    ids.append(np.full(len(again), 1, np.uint64))
    for x in heads:
        some = x != 0
        owner.append(docs[some])
        ids.append(x[some] >> top)
    key = (np.concatenate(owner) << bits) | np.concatenate(ids).astype(np.int64)
    key, count = np.unique(key, return_counts=True)
    rows = key >> bits
    ptr = np.searchsorted(rows, np.arange(len(texts) + 1))
    if presence:
        value = np.ones(len(key), np.float32)
    else:
        value = np.sqrt(count).astype(np.float32)
        total = np.zeros(len(texts))
        np.add.at(total, rows, count)
        value /= np.sqrt(np.maximum(total, 1))[rows].astype(np.float32)
    return ptr, key & ((1 << bits) - 1), value


def dot_rows(ptr: np.ndarray, ids: np.ndarray, value: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sparse dot product of every row with the weights; equal rows give equal results, wherever they stand."""
    row = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    return np.bincount(row, weights[ids].astype(np.float64) * value, len(ptr) - 1)
