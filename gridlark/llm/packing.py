"""Best-fit packing of tokenised documents, planned on the histogram of piece lengths.

Documents are tokenised, closed by an end id and cut into pieces of at most the capacity. The only
thing the driver sees is how many pieces have each length (at most `capacity` numbers, whatever the
input). Best-fit decreasing runs over those counts: bins with equal free space form ranges that fill
together. A piece's place then follows from its rank among the pieces of its length: a join of the
pieces with the planned ranges, whose number depends on the capacity alone.

Null texts count as empty; an empty document is one piece that holds the end id; repeated rows are
packed like others; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import _pieces, ascii_words, stash

#: Words that a worker's cache may hold; beyond it, the half that came last goes, since frequent words come early.
CACHE = 800_000

#: Letters whose lower case is one letter and that no composition changes, then punctuation without apostrophes.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!#$%&*+,\-./:;=?@|~]*)")


class WordTokens:
    """A tokenizers file, with a cache of words between ASCII white space.

    Holds for vocabularies whose pieces never cross white space and whose normaliser works within words.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        rules = json.loads(self.tokenizer.to_str())
        letters = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
        self.bare = Tokenizer.from_str(json.dumps(rules | {"normalizer": None, "pre_tokenizer": letters, "added_tokens": []}))
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith(rules["model"]["end_of_word_suffix"])]] = True
        self.cache: dict[bytes, bytes] = {}
        self.tails: dict[str, bytes] = {}

    def _whole(self, words: list[str]) -> list[bytes]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        packed = np.fromiter(itertools.chain.from_iterable(ids), "<u4").tobytes()
        ends = list(itertools.accumulate([4 * len(x) for x in ids], initial=0))
        return [packed[a:b] for a, b in zip(ends, ends[1:])]

    def _letters(self, words: list[str]) -> list[bytes]:
        """Words of lower-case letters, many in one call: each one's last token closes a word."""
        joined = [" ".join(words[i : i + 500]) for i in range(0, len(words), 500)]
        ids = np.fromiter(itertools.chain.from_iterable(e.ids for e in self.bare.encode_batch_fast(joined, add_special_tokens=False)), "<u4")
        ends = [0, *(4 * (np.flatnonzero(self.closes[ids]) + 1)).tolist()]
        packed = ids.tobytes()
        return [packed[a:b] for a, b in zip(ends, ends[1:])]

    def _learn(self, new: set[bytes]) -> None:
        """Plain letters, then punctuation, need the merges alone: the rest of the tokenizer would only lower their case and split that off."""
        plain, other, tails = [], [], set()
        for w in new:
            if found := _PLAIN.fullmatch(text := w.decode()):
                stem, tail = found.groups()
                plain.append((w, stem.lower(), tail))
                tails.add(tail)
            else:
                other.append((w, text))
        if len(self.tails) > 10_000:
            self.tails.clear()
        new_tails = list(tails.difference(self.tails))
        self.tails.update(zip(new_tails, self._whole(new_tails)))
        stems = list({s for _, s, _ in plain})
        ids = dict(zip(stems, self._letters(stems)))
        self.cache.update((w, ids[s] + self.tails[t]) for w, s, t in plain)
        self.cache.update(zip([w for w, _ in other], self._whole([t for _, t in other])))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as packed little-endian unsigned 32-bit integers."""
        words = [ascii_words(x) for x in texts]
        cache = self.cache
        if len(cache) > CACHE:
            for w in list(cache)[CACHE // 2 :]:
                del cache[w]
        self._learn(set().union(*words).difference(cache))
        return [b"".join(map(cache.__getitem__, w)) for w in words]


@functools.cache
def word_tokens(path: str) -> WordTokens:
    return WordTokens(path)


def pieces(df: DataFrame, path: str, capacity: int, end_id: int, key: str, text: str, keep_ids: bool = False) -> DataFrame:
    """Pieces with their length and checksum, the task that made them, and their rank among its pieces of that length."""
    fields = [df.schema[key], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("_task", T.IntegerType()), T.StructField("_nth", T.LongType())]
    schema = T.StructType(fields + [T.StructField("ids", T.BinaryType())] * keep_ids)
    arrow = to_arrow_schema(schema)
    end = end_id.to_bytes(4, "little")

    def run(batches):
        seen = np.zeros(capacity + 1, np.int64)
        task = TaskContext.get().partitionId()
        for batch in (p for b in batches for p in _pieces(b, text, 1 << 20)):
            out: list[list] = [[] for _ in range(6)]
            for k, packed in zip(batch.column(0).to_pylist(), word_tokens(path).encode(batch.column(1).to_pylist())):
                packed += end
                for i, at in enumerate(range(0, len(packed), 4 * capacity)):
                    part = packed[at : at + 4 * capacity]
                    for column, value in zip(out, (k, i, at >> 2, len(part) >> 2, zlib.crc32(part), part)):
                        column.append(value)
            lengths = np.array(out[3], np.int64)
            order = np.argsort(lengths, kind="stable")
            ordered = lengths[order]
            nth = np.empty(len(lengths), np.int64)
            nth[order] = seen[ordered] + np.arange(len(ordered)) - np.searchsorted(ordered, ordered)
            seen += np.bincount(lengths, minlength=capacity + 1)
            columns = [*out[:5], [task] * len(nth), nth, *out[5:][:keep_ids]]
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return df.select(key, text).mapInArrow(run, schema)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: rows (length, first rank, end rank, first bin, pieces a bin, offset).

    Piece number r of its length, first <= r < end, goes to bin first_bin + (r - first) // each, at
    offset + (r - first) % each * length.
    """
    rows: list[tuple[int, int, int, int, int, int]] = []
    free: dict[int, list[tuple[int, int]]] = {}  # free space: ranges (first bin, bins)
    spaces: list[int] = []  # the keys of free, in order
    bins = 0

    def give(space: int, first: int, n: int) -> None:
        if space and n:
            if space not in free:
                free[space] = []
                insort(spaces, space)
            free[space].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                first, n = free[space].pop()
                if not free[space]:
                    del free[space], spaces[at]
            else:
                space, first, n = capacity, bins, -(-left // (capacity // length))
                bins += n
            each = space // length
            whole = min(n, left // each)
            if whole:
                rows.append((length, rank, rank + whole * each, first, each, capacity - space))
                give(space - each * length, first, whole)
                rank, left = rank + whole * each, left - whole * each
            if whole < n and left:
                rows.append((length, rank, rank + left, first + whole, left, capacity - space))
                give(space - left * length, first + whole, 1)
                rank, left, whole = rank + left, 0, whole + 1
            give(space, first + whole, n - whole)
    return rows


def pack(df: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, key: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """key, piece, start, length, ids_crc32, sequence_id, offset (and the packed ids) of every piece."""
    cut = stash(pieces(df, path, capacity, end_id, key, text, keep_ids), "pieces")
    counted = cut.groupBy("_task", "length").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counted.select("_task", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    totals = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most `capacity` rows
    slots = df.sparkSession.createDataFrame(plan(totals, capacity), "length long, _from long, _to long, _bin long, _each long, _at long")
    ranked = cut.join(bases, ["_task", "length"]).withColumn("_rank", F.col("_base") + F.col("_nth"))
    placed = ranked.join(F.broadcast(slots), (ranked["length"] == slots["length"]) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))  # bounded by the capacity
    past = F.col("_rank") - F.col("_from")
    out = [ranked[c] for c in cut.columns if c not in ("_task", "_nth")]
    return placed.select(*out, (F.col("_bin") + F.expr("(_rank - _from) div _each")).alias("sequence_id"), (F.col("_at") + past % F.col("_each") * ranked["length"]).alias("offset"))
