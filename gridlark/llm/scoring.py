"""Language-model scoring with a weighted backoff automaton that no single machine has to hold.

The model's n-grams have up to ORDER tokens. Of a history h that the training texts have,
p(w | h) = (c(h, w) + k p(w | h')) / (c(h) + k), where h' lacks h's first token and k depends on h's length; of
other histories p(w | h) = p(w | h'). At the end stands p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)).

As an automaton: seen histories are states, of at most ORDER - 1 tokens, the empty one is the root; seen
n-grams are arcs; a state's failure arc leads to its longest proper suffix and weighs k / (c(h) + k). After
each token the automaton is in the longest seen history that ends there. All weights of a state sum to one.

Texts form blocks where they are read. A block asks the buckets of the n-gram table (ranges of a hash) for the
counts of its own n-grams and gets back the part of the automaton that its texts can visit; the requests
themselves carry the counts to be summed, so the model covers the whole corpus. Only runs with some n-gram
are sent, so there are never more rows than n-grams, and every task holds one block or one bucket at a time,
both of bounded size. Hot words are one entry per block, repeated texts lie in several blocks.

N-grams are told apart by hashes of so many bits that one unseen in training meets a seen one with a
chance of about 2^-SLACK. Null texts count as empty: one token, the end. A null key is held out. Repeated rows
count each time. An empty training set gives add-0.1 probabilities of an empty table; an empty table no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import buckets, input_bytes

ADD = 0.1
#: Strength of the shorter history's distribution, by the tokens of the history: one, two and three.
PRIORS = (300.0, 30.0, 10.0)
#: Bytes of text per block and of input per bucket; most partitions, each of which works through its buckets in turn.
BLOCK_BYTES, BUCKET_BYTES, PARTITIONS = 8 << 20, 8 << 20, 20_000
#: Bits of an n-gram's hash beyond those that number the input's bytes.
SLACK = 16
#: Hashes of the end token and of the start context; words hash elsewhere but for a chance of 2^-64.
END, START = np.uint64(1), np.uint64(2)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' tokens, each text closed by END; where each text starts, and the end."""
    words: list[bytes] = []
    sizes = []
    for t in texts:
        own = t.lower().split()
        words += own
        words.append(b"")
        sizes.append(len(own) + 1)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    hashes[starts[1:] - 1] = END
    return hashes, starts


def grams(hashes: np.ndarray, starts: np.ndarray, bits: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order the hashes of the n-grams that end in each token, and whether the text has such a one; START counts as a token."""
    place = np.arange(len(hashes)) - np.repeat(starts[:-1], np.diff(starts))
    shift = np.uint64(64 - bits)
    own = hashes
    for order in range(1, most + 1):
        if order > 1:
            before = np.concatenate([hashes[:0], own[:1], own[:-1]])
            if order == 2:
                before[place == 0] = START
            own = before * np.uint64(0x9E3779B97F4A7C15) + hashes
            own ^= own >> np.uint64(32)
            own *= np.uint64(0xFF51AFD7ED558CCD)
            own ^= own >> np.uint64(29)
        yield (own * np.uint64(0xD6E8FEB86659FD93) if order == 1 else own) >> shift, place >= order - 2


def planes(values: np.ndarray) -> bytes:
    """Compressed, with bytes of equal weight side by side."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes())


def unplanes(packed: bytes, dtype: type) -> np.ndarray:
    import zstandard

    size = np.dtype(dtype).itemsize
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(size, -1).T.copy().view(dtype).ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    return planes(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(packed: bytes) -> np.ndarray:
    return np.cumsum(unplanes(packed, np.uint64), dtype=np.uint64)


def cuts(values: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted values, the buckets (equal ranges of the hash) that have some, and where each one's run starts, and the end."""
    high = values >> np.uint64(bits - 32) if bits > 32 else values << np.uint64(32 - bits)
    bucket = (high * np.uint64(n) >> np.uint64(32)).astype(np.int64)
    starts = np.flatnonzero(np.diff(bucket, prepend=-1))
    return bucket[starts], np.append(starts, len(values))


_LISTS = T.ArrayType(T.BinaryType())
ASKED = T.StructType([T.StructField("block", T.LongType()), T.StructField("bucket", T.IntegerType()), T.StructField("hashes", _LISTS), T.StructField("counts", _LISTS)])
TOLD = T.StructType([T.StructField("block", T.LongType()), T.StructField("bucket", T.IntegerType()), T.StructField("totals", _LISTS)])


def form(key: pa.DataType, size: int):
    """Rows (key, held_out, text) to blocks of about `size` bytes of text. A block's number follows from its content and place."""
    import zstandard

    def block(rows: list[tuple], at: int) -> pa.RecordBatch:
        from pyspark import TaskContext

        keys, held, texts = zip(*rows)
        texts = [(t or "").encode() for t in texts]
        packed = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
        number = xxhash.xxh3_64(f"{TaskContext.get().partitionId()}/{at}/{keys}".encode())
        number.update(packed)
        columns = ([number.intdigest() >> 1], [list(keys)], [list(held)], [list(map(len, texts))], [packed])
        types = (pa.int64(), pa.list_(key), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary())
        return pa.record_batch([pa.array(x, t) for x, t in zip(columns, types)], names=["block", "keys", "held", "sizes", "texts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, at = [], 0, 0
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                for row in zip(*(c.to_pylist() for c in batch.slice(i, 256).columns)):
                    held.append(row)
                    total += len(row[2] or "")
                    if total >= size:
                        yield block(held, at)
                        held, total, at = [], 0, at + 1
        if held:
            yield block(held, at)

    return run


def texts_of(sizes: list[int], packed: bytes) -> list[bytes]:
    import zstandard

    whole = zstandard.ZstdDecompressor().decompress(packed) if any(sizes) else b""
    ends = np.cumsum(sizes).tolist()
    return [whole[b - n : b] for b, n in zip(ends, sizes)]


def runs(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[dict[str, list]]:
    """Rows of equal `by`, which come together, as columns."""
    now, held = None, None
    for batch in batches:
        columns = {n: batch.column(n).to_pylist() for n in batch.schema.names}
        keys = columns[by]
        at = 0
        while at < len(keys):
            end = at + 1
            while end < len(keys) and keys[end] == keys[at]:
                end += 1
            if held is not None and keys[at] == now:
                for n, x in held.items():
                    x.extend(columns[n][at:end])
            else:
                if held is not None:
                    yield held
                now, held = keys[at], {n: x[at:end] for n, x in columns.items()}
            at = end
    if held is not None:
        yield held


def ask(n_buckets: int, bits: int, most: int):
    """Blocks to requests: per bucket that has some, the block's sorted n-gram hashes of each order and their training counts."""
    arrow = to_arrow_schema(ASKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in (b.slice(i, 1) for b in batches for i in range(b.num_rows)):
            row = one.to_pylist()[0]
            hashes, starts = tokens(texts_of(row["sizes"], row["texts"]))
            train = np.repeat(~np.array(row["held"]), np.diff(starts)).astype(np.float64)
            rows: dict[int, tuple[list, list]] = {}
            for order, (values, there) in enumerate(grams(hashes, starts, bits, most)):
                found, inverse = np.unique(values[there], return_inverse=True)
                counts = np.bincount(inverse, train[there], len(found)).astype(np.uint32)
                some, at = cuts(found, n_buckets, bits)
                for b, x, y in zip(some.tolist(), at.tolist(), at[1:].tolist()):
                    mine = rows.setdefault(b, ([None] * most, [None] * most))
                    mine[0][order], mine[1][order] = pack_sorted(found[x:y]), planes(counts[x:y])
            order = sorted(rows)
            for i in range(0, len(order), 64):
                part = order[i : i + 64]
                columns = [[row["block"]] * len(part), part, [rows[b][0] for b in part], [rows[b][1] for b in part]]
                yield pa.record_batch([pa.array(x, f.type) for x, f in zip(columns, arrow)], schema=arrow)

    return run


def summed(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
    return found, np.bincount(inverse, np.concatenate(counts), len(found)).astype(np.uint32)


def tell(most: int):
    """Buckets to replies: each block's totals in the order of its request."""
    arrow = to_arrow_schema(TOLD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, "bucket"):
            n = len(rows["block"])
            totals: list[list] = [[None] * most for _ in range(n)]
            for order in range(most):
                asked = [i for i in range(n) if rows["hashes"][i][order] is not None]
                if asked:
                    hashes = [unpack_sorted(rows["hashes"][i][order]) for i in asked]
                    found, counts = summed(hashes, [unplanes(rows["counts"][i][order], np.uint32) for i in asked])
                    for i, h in zip(asked, hashes):
                        totals[i][order] = planes(counts[np.searchsorted(found, h)])
            for at in range(0, n, 64):
                part = slice(at, min(n, at + 64))
                yield pa.record_batch([pa.array(x[part], f.type) for x, f in zip((rows["block"], rows["bucket"], totals), arrow)], schema=arrow)

    return run


def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets to their shares of N and V."""
    for rows in runs(batches, "bucket"):
        asked = [i for i, x in enumerate(rows["hashes"]) if x[0] is not None]
        if asked:
            _, counts = summed([unpack_sorted(rows["hashes"][i][0]) for i in asked], [unplanes(rows["counts"][i][0], np.uint32) for i in asked])
            yield pa.record_batch([pa.array([int(counts.sum(dtype=np.int64))]), pa.array([int((counts > 0).sum())])], names=["tokens", "types"])


class Automaton:
    """The part of the automaton that a block's texts can visit.

    ends[o][i] is the number of the n-gram of order o + 1 that ends in token i, or -1; counts[o] its training
    counts by number; places the tokens' places in their texts; n, v and texts the training set's sizes.
    """

    def __init__(self, ends: list[np.ndarray], counts: list[np.ndarray], places: np.ndarray, n: int, v: int, texts: int, priors: tuple = PRIORS):
        self.ends, self.places, self.texts = ends, places, texts
        log = lambda x: np.log10(x)
        p = (counts[0] + ADD) / (n + ADD * (v + 1))
        self.root = log(p)
        #: By order: weights of arcs; and of the failure arcs of the states that such n-grams lead to.
        self.arcs, self.failures, self.seen = [self.root], [], [counts[0] > 0]
        shorter = p[ends[0]]
        for order, (at, k) in enumerate(zip(ends[1:], priors), 1):
            history = self._history(order, counts[order - 1])
            self.failures.append(log(k / (history + k)))
            there = np.flatnonzero(at >= 0)
            p = np.where(history[there] > 0, (counts[order][at[there]] + k * shorter[there]) / (history[there] + k), shorter[there])
            shorter = shorter.copy()
            shorter[there] = p
            weights = np.zeros(len(counts[order]))
            weights[at[there]] = log(p)
            self.arcs.append(weights)
            self.seen.append(counts[order] > 0)

    def _history(self, order: int, counts: np.ndarray) -> np.ndarray:
        """Training counts of the history of `order` tokens before each token; 0 where the text has none."""
        out = np.zeros(len(self.places))
        before = self.ends[order - 1][:-1]
        out[1:] = np.where(before >= 0, counts[before], 0)
        out[self.places == 0] = self.texts if order == 1 else 0
        return out

    def traverse(self) -> np.ndarray:
        """Each token's log10 probability, of all texts' traversals side by side.

        Seen n-grams are closed under suffixes and prefixes. So the state before a token is the longest seen
        n-gram that ends in the token before it, and the arc taken is the longest seen one that ends in the
        token: failure arcs lead from the one length down to the other.
        """
        longest = np.zeros(len(self.places), np.int64)
        for order, (at, seen) in enumerate(zip(self.ends, self.seen), 1):
            longest[(at >= 0) & seen[at]] = order
        state = np.minimum(np.concatenate([[0], longest[:-1]]), len(self.ends) - 1)
        state[self.places == 0] = min(1, self.texts, len(self.ends) - 1)
        total = self.root[self.ends[0]]
        for order in range(2, len(self.ends) + 1):
            taken = longest == order
            total[taken] = self.arcs[order - 1][self.ends[order - 1][taken]]
        for length, weights in enumerate(self.failures, 1):
            failing = (state >= length) & (longest <= length)
            total[failing] += weights[failing]
        return total


def score_block(row: dict, told: dict[str, list], bits: int, priors: tuple = PRIORS) -> dict[str, np.ndarray]:
    hashes, starts = tokens(texts_of(row["sizes"], row["texts"]))
    replies = [told["totals"][i] for i in np.argsort(told["bucket"])]
    most = len(priors) + 1
    ends, counts = [], []
    for order, (values, there) in enumerate(grams(hashes, starts, bits, most)):
        _, inverse = np.unique(values[there], return_inverse=True)
        at = np.full(len(hashes), -1)
        at[there] = inverse
        ends.append(at)
        counts.append(np.concatenate([np.zeros(0, np.uint32), *(unplanes(x[order], np.uint32) for x in replies if x[order] is not None)]).astype(np.int64))
        if len(counts[-1]) != inverse.max(initial=-1) + 1:
            raise RuntimeError("A block's rows changed between its request and its replies.")
    n, v = row["tokens"] or 0, row["types"] or 0
    model = Automaton(ends, counts, np.arange(len(hashes)) - np.repeat(starts[:-1], np.diff(starts)), n, v, int(counts[0][ends[0][starts[1] - 1]]), priors)
    at = starts[:-1]
    return {
        "n_tokens": np.diff(starts),
        "n_known": np.add.reduceat(model.seen[0][ends[0]].astype(np.int64), at),
        "train_tokens": np.full(len(at), n, np.int64),
        "base_score": np.add.reduceat(model.root[ends[0]], at),
        "score": np.add.reduceat(model.traverse(), at),
    }


def requests(df: DataFrame, held_out: Column, key: str, text: str, most: int, bits: int, block_bytes: int, bucket_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Blocks (block, keys, held, sizes, texts), and what they ask, together by bucket."""
    n_buckets = buckets(df, bucket_bytes)
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    partitions = max(least, min(n_buckets, PARTITIONS))
    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("keys", T.ArrayType(kind)), T.StructField("held", T.ArrayType(T.BooleanType())), T.StructField("sizes", T.ArrayType(T.IntegerType())), T.StructField("texts", T.BinaryType())])
    source = df.select(F.col(key).alias("_key"), held_out.alias("_held"), F.col(text).alias("_text"))
    formed = source.mapInArrow(form(to_arrow_schema(T.StructType([T.StructField("x", kind)])).field(0).type, block_bytes), schema)
    blocks = formed.repartition(partitions, "block")  # both uses share this shuffle
    asked = blocks.mapInArrow(ask(n_buckets, bits, most), ASKED).repartition(partitions, "bucket").sortWithinPartitions("bucket")
    return blocks, asked


def score(df: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", priors: tuple = PRIORS, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score and score of every row; learns where held_out is false.

    priors has one strength per length of history, so the model's order is one more than their number.
    """
    bits = min(64, SLACK + max(20, input_bytes(df).bit_length()))
    blocks, asked = requests(df, held_out, key, text, len(priors) + 1, bits, block_bytes, bucket_bytes)
    told = asked.mapInArrow(tell(len(priors) + 1), TOLD)
    whole = asked.mapInArrow(sizes, "tokens long, types long").agg(F.struct(F.sum("tokens").alias("tokens"), F.sum("types").alias("types")).alias("n")).scalar()
    sized = blocks.withColumn("n", whole).select("*", "n.tokens", "n.types").drop("n")
    schema = T.StructType([df.schema[key], T.StructField("held_out", T.BooleanType()), *(T.StructField(x, T.LongType()) for x in ("n_tokens", "n_known", "train_tokens")), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def run(block: pa.Table, replies: pa.Table) -> pa.Table:
        row = block.to_pylist()[0]
        found = score_block(row, replies.to_pydict(), bits, priors)
        columns = {key: row["keys"], "held_out": row["held"]} | found
        return pa.table([pa.array(columns[f.name], f.type) for f in arrow], schema=arrow)

    return sized.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(run, schema)
