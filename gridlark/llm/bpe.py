"""Byte-level BPE: encoding without regex, and decoding.

Boundaries are found for a whole step of documents at once. Each code point gets a class (letter,
number, space, other white space, other, or an apostrophe that a contraction suffix follows); a class
is a function from state to state, and since composing such functions is associative, fixed-length
blocks are composed side by side, their results are chained, and every block is then replayed from
its known first state. Slices go through a bounded cache in front of the pair merging. Token offsets
into one vocabulary blob turn decoding into a gather.

Null texts encode as empty ones; empty texts have no ids; repeated rows are kept.
"""

from __future__ import annotations

import base64
import functools
import unicodedata

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_arrow

#: Classes of code points; RESET stands between documents.
OTHER, LETTER, NUMBER, SPACE, WHITE, QUOTE2, QUOTE3, RESET = range(8)
#: States: what the last code point belongs to. ENDED follows a contraction; TWO and ONE wait for its letters.
S_WHITE, S_SPACE, S_LETTER, S_NUMBER, S_OTHER, S_TWO, S_ONE, S_ENDED = range(8)
#: White space of the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Code points of a block of the scan.
BLOCK = 256
#: Slices that a worker's cache may hold before it starts anew.
CACHE = 400_000


@functools.cache
def classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[WHITE_SPACE] = WHITE
    out[0x20] = SPACE
    return out


@functools.cache
def machine() -> tuple[np.ndarray, np.ndarray]:
    """next[class, state], and starts[class, state]: whether a token starts at a code point that isn't white space."""
    after = {OTHER: S_OTHER, LETTER: S_LETTER, NUMBER: S_NUMBER, SPACE: S_SPACE, WHITE: S_WHITE, RESET: S_WHITE}
    nxt, starts = np.zeros((8, 8), np.uint8), np.zeros((8, 8), bool)
    for c in range(8):
        for s in range(8):
            inside = c in (QUOTE2, QUOTE3) and s in (S_SPACE, S_OTHER)
            if c in (QUOTE2, QUOTE3) and not inside:
                nxt[c, s], starts[c, s] = (S_ONE if c == QUOTE2 else S_TWO), True
                continue
            kind = OTHER if inside else c
            nxt[c, s] = {S_TWO: S_ONE, S_ONE: S_ENDED}.get(s, after[kind])
            starts[c, s] = kind <= NUMBER and s not in (S_SPACE, S_TWO, S_ONE, after[kind])
    return nxt, starts


def scan(kinds: np.ndarray) -> np.ndarray:
    """The state before each code point, by composing the blocks' transition functions."""
    nxt, _ = machine()
    n = -(-len(kinds) // BLOCK)
    grid = np.full(n * BLOCK, RESET, np.uint8)
    grid[: len(kinds)] = kinds
    grid = np.ascontiguousarray(grid.reshape(n, BLOCK).T)
    flat = nxt.ravel()
    rows = grid.astype(np.intp) << 3
    whole = np.tile(np.arange(8, dtype=np.uint8), (n, 1))
    for j in range(BLOCK):
        whole = flat[rows[j][:, None] + whole]
    first, state = np.empty(n, np.uint8), S_WHITE
    for i, f in enumerate(whole.tolist()):
        first[i] = state
        state = f[state]
    before = np.empty((BLOCK, n), np.uint8)
    for j in range(BLOCK):
        before[j] = first
        first = flat[rows[j] + first]
    return before.T.reshape(-1)[: len(kinds)]


def boundaries(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """The texts joined by one separator; starts and ends of all slices; the first slice of each text, and the end."""
    joined = "\n" + "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    kinds = classes()[points]
    resets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    quote = np.flatnonzero(points[:-2] == 0x27)
    if len(quote):
        a, b = points[quote + 1], points[np.minimum(quote + 2, len(points) - 1)]
        kinds[quote[np.isin(a, [ord(x) for x in "stmd"])]] = QUOTE2
        three = np.zeros(len(quote), bool)
        for x, y in ("re", "ve", "ll"):
            three |= (a == ord(x)) & (b == ord(y))
        kinds[quote[three]] = QUOTE3
    kinds[resets] = RESET
    starts = machine()[1][kinds, scan(kinds)]
    white = (kinds == SPACE) | (kinds == WHITE)
    at = np.flatnonzero(white)  # a separator stands at either end, so at-1 and at+1 exist
    dark = ~white & (kinds != RESET)
    starts[at] = ~white[at - 1] | dark[at + 1]
    starts[resets] = False
    starts_at = np.flatnonzero(starts)
    firsts = np.searchsorted(starts_at, resets)
    ends_at = np.empty_like(starts_at)
    ends_at[:-1] = starts_at[1:]
    lasts = firsts[1:][firsts[1:] > firsts[:-1]] - 1
    ends_at[lasts] = resets[1:][firsts[1:] > firsts[:-1]]
    return joined, starts_at, ends_at, firsts


class Vocabulary:
    """Ranks of a tiktoken file, with a cached pair merging and an offset table for decoding."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.cache: dict[str, bytes] = {}
        size = max(self.ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.lengths = np.fromiter(map(len, tokens), np.int64, size)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)

    def merge(self, piece: bytes) -> bytes:
        """Ids of one slice as little-endian 32-bit integers: the lowest-ranked adjacent pair merges first."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return whole.to_bytes(4, "little")
        never = 1 << 40
        parts = [piece[i : i + 1] for i in range(len(piece))]
        if len(parts) > 200:
            return self._merge_long(parts)
        get = ranks.get
        pairs = [get(a + b, never) for a, b in zip(parts, parts[1:])]
        while pairs:
            best = min(pairs)
            if best == never:
                break
            i = pairs.index(best)
            parts[i] += parts.pop(i + 1)
            pairs.pop(i)
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], never)
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], never)
        return np.array([ranks[p] for p in parts], "<u4").tobytes()

    def _merge_long(self, parts: list[bytes]) -> bytes:
        """The same for long slices, with a heap over linked parts: n log n instead of n squared."""
        import heapq

        ranks, n = self.ranks, len(parts)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, parts[i] + parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        gone: list[bytes | None] = list(parts)
        while heap:
            _, i, joined = heapq.heappop(heap)
            if gone[i] is None or (j := right[i]) >= n or gone[i] + gone[j] != joined:
                continue
            gone[i], gone[j] = joined, None
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
                if (r := ranks.get(joined + gone[right[i]])) is not None:
                    heapq.heappush(heap, (r, i, joined + gone[right[i]]))
            if (k := left[i]) >= 0 and (r := ranks.get(gone[k] + joined)) is not None:
                heapq.heappush(heap, (r, k, gone[k] + joined))
        return np.array([ranks[p] for p in gone if p is not None], "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        joined, starts, ends, firsts = boundaries(texts)
        pieces = [joined[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        cache = self.cache
        if len(cache) > CACHE:
            cache.clear()
        for piece in set(pieces).difference(cache):
            cache[piece] = self.merge(piece.encode())
        ids = list(map(cache.__getitem__, pieces))
        cuts = firsts.tolist()
        return [b"".join(ids[a:b]) for a, b in zip(cuts, cuts[1:])]

    def decode(self, packed: list[bytes]) -> list[bytes]:
        counts = np.fromiter((len(x) >> 2 for x in packed), np.int64, len(packed))
        ids = np.frombuffer(b"".join(packed), "<u4")
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        whole = self.blob[np.repeat(self.offsets[ids] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [whole[a:b] for a, b in zip(cuts, cuts[1:])]


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens and ids (packed little-endian unsigned 32-bit integers) of every row."""
    schema = T.StructType([df.schema[key], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])

    def step(rows: dict) -> dict:
        ids = vocabulary(path).encode([x or "" for x in rows[text]])
        return {key: rows[key], "n_tokens": [len(x) >> 2 for x in ids], "ids": ids}

    return map_arrow(df.select(key, text), step, schema, text)


def decode(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """df with a column decoded: the bytes that the packed ids stand for; null ids decode to nothing."""
    schema = T.StructType([*(f for f in df.schema if f.name != "decoded"), T.StructField("decoded", T.BinaryType())])

    def step(rows: dict) -> dict:
        return rows | {"decoded": vocabulary(path).decode([x or b"" for x in rows[ids]])}

    return map_arrow(df, step, schema, ids, 4 << 20)
