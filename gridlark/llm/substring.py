"""Repeated passages by prefix-partitioned suffix trees over sparse suffixes.

A passage is a window of `WINDOW` words. Of all suffixes of all texts only those at anchors enter the
trees: a window's anchor is its leftmost smallest run of PREFIX words (by a mixed hash), so equal
windows have their anchor at the same place, and consecutive windows with one anchor travel as one
span. A window reads from its anchor to its right end and then on to the left of the anchor, and prefixes of
that reading split the windows into groups that lie in a task's memory:

* equal spans are one leaf of their tree, which its smallest owner keeps; an anchor with a single leaf ends here;
* a group starts with the PREFIX words of an anchor. While it has more than GROUP leaves, its prefix is
  made longer: first to half a window, rightwards for the windows that have so many words there and
  leftwards for the others, each of both a shorter span; then to the whole window;
* a group that fits is a subtree: leaves sorted by the words right of the anchor, with their common
  lengths, are its right-hand part; the same is done leftwards. Nodes at total depth WINDOW are the
  repeats, and the smallest owner below one keeps it;
* a prefix of WINDOW words is such a node by itself, so only its smallest owner is gathered.

A word goes if it lies in a window that also starts in a document with a smaller key. Null, empty and
short texts lose nothing; a null key neither loses nor owns anything; rows that repeat a key don't
take words from one another, and each loses its own. An empty table gives an empty result. Columns of any
name are kept.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_words, map_arrow, stash, temporary

WINDOW, PREFIX = 50, 8
#: Longer prefixes, each tried where the one before leaves too many leaves together. Every window has half of its
#: words right or left of the anchor's first.
HALF = WINDOW // 2
LENGTHS = (HALF, WINDOW)
#: Leaves of a group that one task holds as a subtree (about 600 bytes each).
GROUP = 4096
_SLOTS = WINDOW - PREFIX + 1
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD)]


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def anchors(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each window of a run of words, the place of its anchor; and every prefix's mixed hash."""
    n = len(hashes) - PREFIX + 1
    mixed = np.zeros(n, np.uint64)
    for j in range(PREFIX):
        mixed = mixed * _MIX[0] + hashes[j : n + j]
    mixed ^= mixed >> np.uint64(33)
    mixed *= _MIX[1]
    mixed ^= mixed >> np.uint64(29)
    least, place, width = mixed, np.arange(n, dtype=np.int32), 1
    while width < _SLOTS:
        shift = min(width, _SLOTS - width)
        left = least[:-shift] <= least[shift:]
        least, place = np.where(left, least[:-shift], least[shift:]), np.where(left, place[:-shift], place[shift:])
        width += shift
    return place, mixed


SPAN = T.StructType([T.StructField(n, t) for n, t in (("first", T.IntegerType()), ("windows", T.IntegerType()), ("left", T.IntegerType()), ("anchor", T.LongType()), ("c1", T.LongType()), ("c2", T.LongType()))])


def spans_of(texts: list) -> tuple[list[int], dict]:
    """For the texts of one step: each span's text, and its columns as in SPAN."""
    split = [ascii_words(t) for t in texts]
    split = [w if len(w) >= WINDOW else [] for w in split]
    words = [x for w in split for x in w]
    if not words:
        return [], {f.name: [] for f in SPAN}
    bounds = np.concatenate([[0], np.cumsum([len(w) for w in split])])
    place, mixed = anchors(word_hashes(words))
    sizes = np.diff(bounds)
    valid = np.ones(len(place), bool)
    for end in bounds[1:][sizes > 0][:-1].tolist():
        valid[end - WINDOW + 1 : end] = False
    at = np.flatnonzero(valid)
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (np.diff(place[at]) != 0)
    runs = np.flatnonzero(new)
    first, windows = at[runs], np.diff(np.append(runs, len(at)))
    text = np.searchsorted(bounds, first, "right") - 1
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh3_128_digest
    content = np.frombuffer(b"".join(digest(joined[a:b]) for a, b in zip(starts[first].tolist(), ends[first + windows + WINDOW - 2].tolist())), np.int64).reshape(-1, 2)
    found = {"first": first - bounds[text], "windows": windows, "left": place[first] - first, "anchor": mixed[place[first]].view(np.int64), "c1": content[:, 0], "c2": content[:, 1]}
    return text.tolist(), found


def spans(rows: DataFrame) -> DataFrame:
    schema = T.StructType([rows.schema["key"], rows.schema["hash"], *SPAN])

    def step(x: dict) -> dict:
        own, found = spans_of(x["text"])
        return {n: [x[n][i] for i in own] for n in ("key", "hash")} | found

    return map_arrow(rows, step, schema, "text")


def repeated_pair(a: tuple, b: tuple) -> list[int]:
    """masks() of two members, by direct comparison."""
    (owner_a, left_a, windows_a, words_a), (owner_b, left_b, windows_b, words_b) = a, b
    if owner_a == owner_b:
        return [0, 0]
    right = left = 0
    for x, y in zip(words_a[left_a:], words_b[left_b:]):
        if x != y:
            break
        right += 1
    for x, y in zip(words_a[:left_a][::-1], words_b[:left_b][::-1]):
        if x != y:
            break
        left += 1
    low = max(left_a - windows_a + 1, left_b - windows_b + 1, WINDOW - right)
    high = min(left_a, left_b, left)
    which, offset = (0, left_a) if owner_a > owner_b else (1, left_b)
    out = [0, 0]
    out[which] = sum(1 << (offset - o) for o in range(low, high + 1))
    return out


def masks(members: list[tuple]) -> list[int]:
    """Per member (owner, words left of the anchor, windows, words) a bit for each window that a smaller owner has too."""
    m = len(members)
    if m == 1:
        return [0]
    if m == 2:
        return repeated_pair(*members)
    owners = np.array([x[0] for x in members])
    lefts = np.array([x[1] for x in members])
    windows = np.array([x[2] for x in members])
    sides = [np.zeros((m, WINDOW), np.uint64), np.zeros((m, WINDOW), np.uint64)]
    for i, (_, left, _, words) in enumerate(members):
        hashed = word_hashes(words)
        right, back = hashed[left : left + WINDOW], hashed[:left][::-1][:WINDOW]
        sides[0][i, : len(right)], sides[1][i, : len(back)] = right, back
    offsets = np.arange(_SLOTS)
    nodes = []
    for side, depths in zip(sides, (WINDOW - offsets, offsets)):
        order = np.array(sorted(range(m), key=[x.tobytes() for x in side.astype(">u8")].__getitem__))
        same = side[order[1:]] == side[order[:-1]]
        common = np.where(same.all(1), WINDOW, same.argmin(1))  # the depth at which neighbours part
        node = np.zeros((m, _SLOTS), np.int64)
        node[order[1:]] = np.cumsum(common[:, None] < depths[None, :], axis=0)
        nodes.append(node)
    there = (offsets[None, :] <= lefts[:, None]) & (offsets[None, :] > (lefts - windows)[:, None])
    member, offset = np.nonzero(there)
    label = (offset * m + nodes[0][member, offset]) * m + nodes[1][member, offset]
    order = np.lexsort((owners[member], label))
    starts = np.flatnonzero(np.append(True, np.diff(label[order]) != 0))
    least = np.repeat(owners[member][order][starts], np.diff(np.append(starts, len(order))))
    gone = least < owners[member][order]
    out = [0] * m
    for i, o in zip(member[order][gone].tolist(), offset[order][gone].tolist()):
        out[i] |= 1 << (members[i][1] - o)
    return out


def subtrees(parts: DataFrame) -> DataFrame:
    """(c1, c2, mask) of the spans that lose windows; parts come sorted by group, each group in one partition."""
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("c1", "c2", "mask")])

    def run(batches):
        import pyarrow as pa

        now, held = None, {}

        def close():
            found = zip(held, masks([x[1:] for x in held.values()])) if held else ()
            return [(c1, c2, mask << held[c1, c2, shift][0]) for (c1, c2, shift), mask in found if mask]

        def pack(rows):
            return pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else ([], [], []))], names=["c1", "c2", "mask"])

        for batch in batches:
            out = []
            for group, c1, c2, shift, owner, left, windows, words in zip(*(batch.column(n).to_pylist() for n in ("group", "c1", "c2", "shift", "owner", "left", "windows", "words"))):
                if group != now:
                    out += close()
                    now, held = group, {}
                held[c1, c2, shift] = (shift, owner, left, windows, words.split())  # repeated rows bring the same again
            yield pack(out)
        yield pack(close())

    return parts.mapInArrow(run, schema)


def lengthened(parts: DataFrame, length: int) -> DataFrame:
    """The same windows by prefixes of `length` words: spans become shorter ones, in the columns of parts; `rest` tells whole windows apart."""

    def step(rows: dict) -> dict:
        out: dict[str, list] = {n: [] for n in schema.names}
        for c1, c2, shift, owner, left, windows, text in zip(*(rows[n] for n in ("c1", "c2", "shift", "owner", "left", "windows", "words"))):
            words = text.split()
            if length == WINDOW:
                pieces = [(t, t + 1, t, left - t) for t in range(windows)]
            else:  # the first window whose right part is long enough parts those before it from the rest
                cut = min(max(0, left - HALF), windows)
                pieces = [x for x in ((0, cut, left - HALF, -1), (cut, windows, left, -2)) if x[0] < x[1]]
            for first, end, start, tag in pieces:
                prefix = b" ".join(words[start : start + length]) + b" %d" % tag
                group, rest = np.frombuffer(xxhash.xxh3_128_digest(prefix), np.int64).tolist()
                body = b"" if length == WINDOW else b" ".join(words[first : end + WINDOW - 1])
                for n, x in zip(schema.names, (group, rest, c1, c2, shift + first, owner, left - first, end - first, body)):
                    out[n].append(x)
        return out

    schema = T.StructType([T.StructField("group", T.LongType()), T.StructField("rest", T.LongType()), *(parts.schema[n] for n in ("c1", "c2", "shift", "owner", "left", "windows", "words"))])
    return map_arrow(parts, step, schema, "words", 1 << 17)


def nodes(windows: DataFrame) -> DataFrame:
    """(c1, c2, mask) of windows whose group is one node, of which a smaller owner has a window too."""
    least = windows.groupBy("group", "rest").agg(F.min("owner").alias("least"), F.max("owner").alias("most")).where("least < most").drop("most")
    # Written, so that the join shuffles both sides anew and can split a frequent window.
    gone = windows.join(stash(least, "nodes"), ["group", "rest"]).where("owner > least")
    return gone.select("c1", "c2", F.expr("shiftleft(1L, cast(shift as int))").alias("mask"))


def lost_windows(parts: DataFrame, group: int = GROUP) -> DataFrame:
    """(c1, c2, mask) of the spans in parts (group, size, ...) that lose windows to a smaller owner."""
    lost = []
    for length in LENGTHS:
        fitting = parts.where(F.col("size") <= group).repartition("group").sortWithinPartitions("group")
        lost.append(subtrees(fitting))
        large = parts.where(F.col("size") > group)
        if not large.head(1):
            break
        longer = stash(lengthened(large, length), "longer")
        if length == WINDOW:
            lost.append(nodes(longer))
        else:
            sizes = stash(longer.groupBy("group").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes")  # as above
            parts = longer.join(sizes, "group")
    whole = lost[0]
    for x in lost[1:]:
        whole = whole.union(x)
    return whole.groupBy("c1", "c2").agg(F.expr("bit_or(mask)").alias("mask"))


def repeats(rows: DataFrame, group: int = GROUP) -> DataFrame:
    """key, hash and spans, an array of (first, mask): windows first + i of the text go where bit i of the mask is set.

    rows: key, hash (of the text) and text, without null keys.
    """
    found = stash(spans(rows), "spans")
    by_anchor = found.groupBy("anchor").agg(F.min("c1").alias("low"), F.max("c1").alias("high"), F.min("key").alias("owner"), F.max("key").alias("most"))
    # Written, so that the join below shuffles both sides anew and can split a frequent anchor.
    known = stash(by_anchor.where("owner < most").select("anchor", (F.col("low") == F.col("high")).alias("plain"), "owner"), "anchors")
    hits = stash(found.join(known, "anchor"), "hits")
    # Equal spans are one leaf: the smallest key owns them.
    contents = hits.where("not plain").groupBy("c1", "c2").agg(F.min(F.struct("key", "hash", "first")).alias("own"), F.min("anchor").alias("anchor"), F.min("left").alias("left"), F.min("windows").alias("windows"))
    contents = stash(contents.select("c1", "c2", F.col("own.key").alias("owner"), F.col("own.hash").alias("owner_hash"), F.col("own.first").alias("first"), "anchor", "left", "windows"), "contents")
    sizes = stash(contents.groupBy("anchor").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes")  # as above
    wanted = contents.join(sizes, "anchor").groupBy("owner", "owner_hash").agg(F.collect_list(F.struct("first", "anchor", "left", "windows", "c1", "c2", "size")).alias("wanted"))
    parts = stash(_words_of(rows.join(wanted, (F.col("key") == F.col("owner")) & (F.col("hash") == F.col("owner_hash")))), "parts")
    owned = contents.join(lost_windows(parts, group), ["c1", "c2"], "left").select("c1", "c2", F.col("owner").alias("first_owner"), "mask")
    owned = stash(owned, "owned")  # as above
    whole = F.expr("shiftleft(1L, windows) - 1")
    plain = hits.where("plain and key > owner").select("key", "hash", "first", whole.alias("mask"))
    rest = hits.where("not plain").join(owned, ["c1", "c2"]).select("key", "hash", "first", F.when(F.col("key") > F.col("first_owner"), whole).otherwise(F.col("mask")).alias("mask"))
    return plain.union(rest.where("mask <> 0")).groupBy("key", "hash").agg(F.collect_set(F.struct("first", "mask")).alias("spans"))


def _words_of(joined: DataFrame) -> DataFrame:
    """The words of the wanted spans."""
    names = ["c1", "c2", "left", "windows", "size"]
    schema = T.StructType([T.StructField("group", T.LongType()), T.StructField("shift", T.LongType()), *(T.StructField(n, T.LongType()) for n in names), T.StructField("owner", joined.schema["owner"].dataType), T.StructField("words", T.BinaryType())])

    def step(rows: dict) -> dict:
        out: dict[str, list] = {n: [] for n in schema.names}
        for owner, text, wanted in zip(rows["owner"], rows["text"], rows["wanted"]):
            words = ascii_words(text)
            for x in wanted:
                for n in names:
                    out[n].append(x[n])
                out["group"].append(x["anchor"])
                out["shift"].append(0)
                out["owner"].append(owner)
                out["words"].append(b" ".join(words[x["first"] : x["first"] + x["windows"] + WINDOW - 1]))
        return out

    return map_arrow(joined.select("owner", "text", "wanted"), step, schema, "text")


def kept_words(text: str | None, gone: list[dict] | None) -> tuple[int, list[bytes]]:
    words = ascii_words(text)
    if not gone:
        return len(words), words
    change = np.zeros(len(words) + 1, np.int32)
    for x in gone:
        first, mask = x["first"], x["mask"]
        low = (mask & -mask).bit_length() - 1
        while mask:  # runs of set bits
            mask >>= low
            run = (~mask & (mask + 1)).bit_length() - 1
            change[first + low] += 1
            change[first + low + run + WINDOW - 1] -= 1
            mask >>= run
            first += low + run
            low = (mask & -mask).bit_length() - 1
    covered = np.cumsum(change[:-1]) > 0
    return len(words), [words[i] for i in np.flatnonzero(~covered).tolist()]


def strip(df: DataFrame, key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """Every row with n_words, n_removed and, unless `digest` asks for its SHA-256 alone, the kept text.

    With digest: key, n_words, n_removed, kept_sha256. Without: df with text replaced where words went;
    other texts stay as they are.
    """
    names = [f"c{i}" for i in range(len(df.columns))]
    own, body = (names[df.columns.index(x)] for x in (key, text))
    plain = df.toDF(*names).select(*([own, body] if digest else names)).withColumns({"key": F.col(own), "hash": F.xxhash64(body)})
    with temporary() as keep:
        gone = keep(repeats(plain.where("key is not null").select("key", "hash", F.col(body).alias("text"))), "gone")
    columns = plain.columns[:-2]
    # A null key equals nothing, so such rows come without spans; dealt by their hash, they are not one hot key.
    rows = plain.join(gone.hint("merge"), ["key", "hash"], "left").select(*columns, "spans")
    if digest:
        schema = T.StructType([df.schema[key], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])
    else:
        schema = plain.select(*columns).schema

    def step(values: dict) -> dict:
        kept = [kept_words(t, g) for t, g in zip(values[body], values["spans"])]
        if not digest:
            return {c: values[c] for c in columns} | {body: [b" ".join(w).decode() if n > len(w) else t for t, (n, w) in zip(values[body], kept)]}
        return {key: values[own], "n_words": [n for n, _ in kept], "n_removed": [n - len(w) for n, w in kept], "kept_sha256": [hashlib.sha256(b" ".join(w)).hexdigest() for _, w in kept]}

    done = map_arrow(rows, step, schema, body)
    return done if digest else done.toDF(*df.columns)
