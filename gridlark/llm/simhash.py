"""SimHash near-duplicates with covering locality-sensitive hashing.

Each bit of a fingerprint gets a non-zero vector of radius + 1 bits; for every non-zero v, a mask keeps
the bits whose vector has an odd product with v. Two fingerprints that differ in at most `radius` bits
leave some v orthogonal to all differing bits, so under that mask they are equal: no pair is missed.

Equal fingerprints are one node from the start. A bucket of moderate size is linked inside one array;
a larger one by single-bit neighbours: two fingerprints differ in at most two bits just if some third
value is within one bit of both, which needs no pairs.

Null, empty and blank texts have the fingerprint zero and link like any other. Repeated rows are
exact copies. A row without a key has the class of its text like any other; a class of such rows alone has
no component_id. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_words, map_arrow, stash, temporary
from .graph import components

SEED, SHINGLE, RADIUS = 42, 3, 2
#: Members of a bucket that is linked as one array; larger ones go by neighbours.
ARRAY = 4096


def shingle_hashes(words: list[bytes], width: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of every run of `width` words joined by spaces; of all words if there are fewer; none of none."""
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)] if words else [], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[: 1 - width].tolist(), ends[width - 1 :].tolist())), np.uint64, len(words) + 1 - width)


def bits_over_half(hashes: np.ndarray) -> int:
    """Bit i is set if over half of the hashes have it set; as a signed 64-bit integer."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        total += np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint(text: str | None) -> int:
    return bits_over_half(shingle_hashes((text or "").encode().lower().split()))


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    schema = T.StructType([df.schema[key], T.StructField("fp", T.LongType())])
    return map_arrow(df.select(key, text), lambda rows: {key: rows[key], "fp": list(map(fingerprint, rows[text]))}, schema, text)


def masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    vectors = [i % ((2 << radius) - 1) + 1 for i in range(bits)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() & 1) for v in range(1, 2 << radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def stars(members: list[int], radius: int, direct: bool = False) -> list[tuple[int, int]]:
    """(member, smallest member of its linked part) for all but those smallest members; direct: a member within the radius instead."""
    values = np.sort(np.array(members, np.int64))
    bits = values.view(np.uint64)
    roots = np.full(len(values), -1)
    parents = roots.copy()
    for first in range(len(values)):
        if roots[first] >= 0:
            continue
        roots[first] = parents[first] = first
        front = [first]
        while front:
            i = front.pop()
            new = np.flatnonzero((np.bitwise_count(bits ^ bits[i]) <= radius) & (roots < 0))
            roots[new], parents[new] = first, i
            front += new.tolist()
    return [(int(v), int(values[r])) for i, (v, r) in enumerate(zip(values, (parents if direct else roots).tolist())) if r != i]


def links(distinct: DataFrame, radius: int = RADIUS, array: int = ARRAY, whole: bool = True) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that connect all pairs within radius.

    whole False serves callers that find the other links elsewhere: each edge is then within the radius, and
    large buckets are dealt into arrays.
    """
    tables = F.array(*(F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(masks(radius))))
    keyed = distinct.select("fp", F.explode(tables).alias("bucket"))
    sizes = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # Written, so that the join shuffles both sides anew and can split a large bucket.
    members = keyed.join(stash(sizes, "sizes").hint("merge"), "bucket")
    if not whole:
        members = members.withColumn("part", F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / F.lit(array)))).select("fp", F.xxhash64("bucket", "part").alias("bucket"), F.lit(0).alias("n"))
    arrays = members.where(F.col("n") <= array).groupBy("bucket").agg(F.collect_list("fp").alias("fps")).select("fps")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def step(rows: dict) -> dict:
        found = {e for m in rows["fps"] for e in stars(m, radius, not whole)}
        return {"a": [a for a, _ in found], "b": [b for _, b in found]}

    edges = map_arrow(arrays, step, schema)
    if not whole:
        return edges.distinct()
    large = members.where(F.col("n") > array).select("fp").distinct()
    return edges.union(neighbour_links(large, radius)).distinct()


def neighbour_links(distinct: DataFrame, radius: int) -> DataFrame:
    """The same edges by values near a fingerprint, without buckets: 65 rows each for radius 2.

    Two fingerprints are within the radius just if some value is within half of it, rounded down, of one and
    within the rest of the other; so all of the latter link to the smallest of the former.
    """
    near = [[0]]
    for _ in range((radius + 1) // 2):
        near.append(sorted({x ^ (1 << i) for x in near[-1] for i in range(64)} | set(near[-1])))
    closer, around = (distinct.select("fp", F.explode(F.array(*(F.col("fp").bitwiseXOR(F.lit(_signed(x))) for x in near[k]))).alias("value")) for k in (radius // 2, (radius + 1) // 2))
    least = closer.groupBy("value").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n"))
    least = (least.where("n > 1") if radius % 2 == 0 else least).drop("n")
    return around.join(least, "value").where("fp <> b").select(F.col("fp").alias("a"), "b")


def classes(df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """key, fp and component_id (smallest key reachable) of every row."""
    with temporary() as keep:
        marked = keep(fingerprints(df, key, text), "fingerprints")
        distinct = stash(marked.groupBy("fp").agg(F.min(key).alias("least")), "distinct")
        rooted = distinct.join(components(links(distinct.select("fp"), radius)), F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
        rooted = stash(rooted, "rooted")
        # Written, so that the joins shuffle both sides anew and can split a large class and a frequent fingerprint.
        smallest = stash(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "smallest")
        found = keep(rooted.join(smallest, "root").select("fp", "component_id"), "found")
    return marked.join(found.hint("merge"), "fp").select(key, "fp", "component_id")
