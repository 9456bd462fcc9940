"""Language-model scores by logistic mixing of hashed-context bit predictors.

A text is its token sequence: lower-cased words and one end. A word is coded byte by byte with a space behind it, the end as
one symbol; a byte is a path of yes/no steps in a binary code. Each step is predicted from three hashed contexts (the word so
far; the last three bytes; the word so far with the last short word before it, which tells the language and the phrase). Tables of counts
give each context's stretched probability; a gate, made of how much each context has seen, picks the weights that add them
up. Weights start from values learned over training text and are then refined by every stretch of the text that is scored,
which only ever uses what came before it.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.blocks import ROWS, Batch, answered, as_batch, chunks, scored, sharded
from dossier.llm.common import parts, save, tidy

#: Slots of a context's table are 2 ** BITS, a fixed amount of memory; counts of all training text go into them.
BITS, CONTEXTS = 22, 3
SLOTS = 1 << BITS
#: Parts that a context's table travels in; tables of so many tasks are added up in one go.
PARTS, FAN = 64, 64
#: Bytes of stream that are scored at once and that are counted at once, words of at most this many bytes as phrase context.
PIECE, COUNTED, SHORT = 200_000, 2_000_000, 3
#: Steps before a text's first refinement, and the most between two: stretches double from one to the other.
STRETCH, LONGEST = 256, 8192
#: Tasks that fill tables: one for so many of the input's, each with tables of its own to send.
FILLERS = 4
#: Weight sets: each context's share of counts seen falls into one of four levels.
GATES = 4**CONTEXTS
#: Bytes of text in a block.
BLOCK = 6_000_000
RATE = 0.1
END = b"\n"


def code(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A binary prefix code of the 256 bytes by their counts: (length of each, where its path begins, nodes, bits)."""
    heap = [(int(c) * 256 + 256, i, i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    parent, n = {}, 256
    while len(heap) > 1:
        (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        parent[x], parent[y] = (n, 0), (n, 1)
        heapq.heappush(heap, (a + b, n, n))
        n += 1
    size, begin, nodes, bits = np.zeros(256, np.int64), np.zeros(256, np.int64), [], []
    for i in range(256):
        path, x = [], i
        while x in parent:
            x, bit = parent[x]
            path.append((x, bit))
        begin[i], size[i] = len(nodes), len(path)
        nodes += [p[0] for p in path[::-1]]
        bits += [p[1] for p in path[::-1]]
    return size, begin, np.array(nodes, np.uint32), np.array(bits, np.uint8)


def stream(words: list[bytes]) -> bytes:
    return b" ".join(words) + b" " + END if words else END


class Contexts:
    """A few texts' streams: all bytes, for each byte a hash of each context it is read in, and where each text ends."""

    def __init__(self, texts: list[list[bytes]]):
        data = [stream(w) for w in texts]
        b = np.frombuffer(b"".join(data), np.uint8)
        n = len(b)
        ends = np.cumsum([len(x) for x in data])
        new = np.zeros(n, bool)  # where a word starts
        new[0] = True
        new[1:] = (b[:-1] == 32) | (b[:-1] == 10)
        word_at = np.flatnonzero(new)
        length = np.diff(np.append(word_at, n))
        # Hash of the word so far: a polynomial over the bytes since the word's start.
        up, down = powers(n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
        prefix = (total[:-1] - np.repeat(total[word_at], length)) * np.repeat(down[word_at], length)
        # The last short word that ended before this one, in the same text.
        length -= 1
        whole = (total[word_at + length] - total[word_at]) * down[word_at]
        short = np.where((length <= SHORT) & (b[word_at] != 10), np.arange(len(word_at)), -1)
        last = np.concatenate([[-1], np.maximum.accumulate(short)[:-1]])
        text_of = np.searchsorted(ends, word_at, side="right")
        held = (last >= 0) & (text_of[np.maximum(last, 0)] == text_of)
        phrase = np.where(held, whole[np.maximum(last, 0)], np.uint64(0)) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x77)
        recent = np.full(n, 1 << 24, np.uint32)
        for k in (1, 2, 3):
            recent[k:] |= b[:-k].astype(np.uint32) << np.uint32(8 * k - 8)
        starts = np.append(0, ends[:-1])
        for k in (0, 1, 2):  # what stands before the text's start isn't part of it
            at = starts[starts + k < ends] + k
            recent[at] &= np.uint32((1 << 8 * k) - 1)
        hashes = (prefix ^ np.uint64(0x51), recent.astype(np.uint64), prefix + np.repeat(phrase, length + 1))
        self.bytes, self.ends = b, ends
        self.hashes = [((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)).astype(np.uint32) for h in hashes]


def paths(b: np.ndarray, coder: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The steps of some bytes: how many each has, every step's node, scrambled, and its bit."""
    size, begin, nodes, bits = coder
    steps = size[b]
    at = np.cumsum(steps) - steps
    inside = np.repeat((begin[b] - at).astype(np.int32), steps)
    inside += np.arange(len(inside), dtype=np.int32)
    return steps, nodes[inside] * np.uint32(0x9E3779B1), bits[inside]


def slots(h: np.ndarray, steps: np.ndarray, node: np.ndarray) -> np.ndarray:
    """A context's slot in each step, from the context's hash for each byte."""
    s = np.repeat(h, steps)
    s += node
    s *= np.uint32(0x85EBCA6B)
    s ^= s >> np.uint32(15)
    s *= np.uint32(0xC2B2AE35)
    s >>= np.uint32(32 - BITS)
    return s


class Steps:
    """The yes/no steps of a few texts' streams: for each its bit, its slot in each context's table; and each text's first step."""

    def __init__(self, texts: list[list[bytes]], coder: tuple):
        found = Contexts(texts)
        steps, node, self.bit = paths(found.bytes, coder)
        self.slots = [slots(h, steps, node) for h in found.hashes]
        self.ends = np.cumsum(steps)[found.ends - 1]


def count_steps(texts: list[list[bytes]], coder: tuple, tables: np.ndarray) -> None:
    """Adds the steps of some texts to the tables (CONTEXTS, 2 * SLOTS). A byte that recurs in its context is walked once."""
    found = Contexts(texts)
    for t, h in zip(tables, found.hashes, strict=True):
        both = np.sort(h.astype(np.uint64) << np.uint64(8) | found.bytes)
        at = np.flatnonzero(np.append(True, both[1:] != both[:-1]))
        both, c = both[at], np.diff(np.append(at, len(both)))
        steps, node, bit = paths((both & np.uint64(255)).astype(np.uint8), coder)
        s = slots((both >> np.uint64(8)).astype(np.uint32), steps, node)
        np.add.at(t, s * np.uint32(2) + bit, np.repeat(c.astype(np.uint32), steps))


_powers = [np.ones(1, np.uint64)] * 2


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15
    if len(_powers[0]) < n + 1:
        for i, x in enumerate((base, pow(base, -1, 1 << 64))):
            _powers[i] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, x, np.uint64)]))
    return _powers[0][: n + 1], _powers[1][: n + 1]


def pieces(texts: list[list[bytes]], most: int = PIECE) -> Iterator[tuple[int, int]]:
    lo = size = 0
    for i, w in enumerate(texts):
        size += sum(map(len, w)) + len(w) + 1
        if size >= most:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def predictors(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """A table's slots as int16: 4 times the stretched probability in 256ths, plus the level of how much was seen."""
    n = zeros + ones
    p = (ones + 0.1) / (n + 0.2)
    level = (n > 0).astype(np.int64) + (n > 3) + (n > 50)
    return (np.clip(np.round(np.log(p / (1 - p)) * 256), -2040, 2040).astype(np.int64) * 4 + level).astype(np.int16)


def inputs(steps: Steps, tables: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Each context's stretched probability and the gate of every step."""
    xs, gate = [], None
    for t, s in zip(tables, steps.slots, strict=True):
        v = t.take(s, mode="clip")
        level = (v & 3).astype(np.uint8)
        gate = level if gate is None else gate * np.uint8(4) + level
        xs.append((v >> 2).astype(np.float32) * np.float32(1 / 256))
    return xs, gate


def mixed(steps: Steps, tables: np.ndarray, weights: np.ndarray, rate: float = RATE) -> np.ndarray:
    """Bits that each text costs. weights (GATES, CONTEXTS) is where every text starts.

    A text's steps go in stretches; all texts' stretches of the same rank are scored together, each with the text's own
    weights, which then move along the gradient of the stretch.
    """
    xs, gate = inputs(steps, tables)
    flip = np.float32(1) - np.float32(2) * steps.bit  # -1 where the bit is one
    begin = np.concatenate([[0], steps.ends[:-1]])
    size = steps.ends - begin
    scale = np.ones((len(size), CONTEXTS), np.float32)
    cost = np.zeros(len(size))
    own = np.ascontiguousarray(weights.T)
    done = r = 0
    while done < size.max():
        span = min(STRETCH << r, LONGEST)
        live = np.flatnonzero(size > done)
        lo = begin[live] + done
        m = np.minimum(size[live] - done, span)
        edge = np.cumsum(m) - m
        join = (lambda a, lo=lo, m=m: np.concatenate([a[i : i + k] for i, k in zip(lo.tolist(), m.tolist(), strict=True)])) if len(live) > 1 else (lambda a, lo=lo, m=m: a[lo[0] : lo[0] + m[0]])
        g, f = join(gate), join(flip)
        share = [own[k][g] * join(xs[k]) for k in range(CONTEXTS)]
        z = np.zeros(len(g), np.float32)
        for k in range(CONTEXTS):
            z += share[k] if r == 0 else share[k] * np.repeat(scale[live, k], m)
        z *= f
        np.clip(z, -12, 12, out=z)
        e = np.exp(z)
        cost[live] += np.add.reduceat(np.log(1 + e), edge)
        done, r = done + span, r + 1
        if done < size.max():
            err = e / (1 + e) * f
            for k in range(CONTEXTS):
                step = np.add.reduceat(err * share[k], edge) / np.sqrt(m)
                scale[live, k] = np.clip(scale[live, k] - rate * step, 0.2, 3)
    return cost / np.log(2)


def learned(steps: Steps, tables: np.ndarray, weights: np.ndarray, rate: float = 0.02) -> None:
    """Moves weights by online steps, all gates at once: each short run of steps is predicted, then learned from."""
    xs, gate = inputs(steps, tables)
    for lo in range(0, len(gate), 8192):
        at = slice(lo, lo + 8192)
        g, x = gate[at], [v[at] for v in xs]
        z = sum(weights[:, k][g] * x[k] for k in range(CONTEXTS))
        err = steps.bit[at] - 1 / (1 + np.exp(-np.clip(z, -12, 12)))
        n = np.bincount(g, minlength=GATES)
        for k in range(CONTEXTS):
            weights[:, k] += rate * np.bincount(g, err * x[k], minlength=GATES) / np.sqrt(n + 1)


def squeezed(table: np.ndarray) -> bytes:
    """Counts packed byte by byte of equal rank: most are small, so most of the ranks are zeros."""
    return pa.compress(np.ascontiguousarray(table.view(np.uint8).reshape(-1, 4).T).tobytes(), "zstd", asbytes=True)


def loosened(data: bytes) -> np.ndarray:
    size = 2 * SLOTS // PARTS
    return np.ascontiguousarray(np.frombuffer(pa.decompress(data, 4 * size, "zstd", asbytes=True), np.uint8).reshape(4, size).T).view(np.uint32)[:, 0]


def tokens(data: bytes) -> list[bytes]:
    return data.lower().split()


def key(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 7)


def scores(docs: DataFrame, held_out: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """For each row of docs the columns in keep, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte.

    held_out names a boolean column; its rows (and those where it is null) are not learned from. base_score and score are log10
    probabilities of the token sequence, by single-word counts with one added and by the mixed predictors. bits_per_byte is the
    score's bits over the text's bytes, null for an empty text. Null text counts as empty: one token, the end.
    Words meet their counts under 64-bit hashes.
    """
    spark, n = docs.sparkSession, parts(docs.sparkSession)
    train = F.coalesce(~F.col(held_out), F.lit(False))
    chosen = docs.select(*keep, F.coalesce(held_out, F.lit(False)).alias("_held"), train.alias("_train"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("_text"))

    # First pass: each block's distinct words, with their counts in training texts, and the counts of bytes.
    def count(batches: Iterator[Batch]) -> Iterator[Batch]:
        for block, b in chunks(batches, BLOCK):
            own: Counter[bytes] = Counter()
            rest: set[bytes] = set()
            byte = np.zeros(256)
            texts = 0
            for t, d in zip(b.column("_train").to_pylist(), b.column("_text").to_pylist(), strict=True):
                words = tokens(d)
                if t:
                    texts += 1
                    byte += np.bincount(np.frombuffer(stream(words), np.uint8), minlength=256)
                    own.update(words)
                else:
                    rest.update(words)
            own.update(dict.fromkeys(rest - own.keys(), 0))
            keys = np.fromiter(map(key, own), np.uint64, len(own))
            keys, first = np.unique(keys, return_index=True)
            vals = np.fromiter(own.values(), np.uint32, len(own))[first]
            yield as_batch([*sharded(block, keys, n, vals), (block, -1, b"", np.append(byte, texts).tobytes())])

    counted = save(chosen.mapInArrow(count, ROWS), "words")

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([np.empty(0, np.uint64), *(np.frombuffer(x, np.uint64) for x in pdf["keys"])])
        vals = np.concatenate([np.empty(0), *(np.frombuffer(x, np.uint32) for x in pdf["vals"])])
        whole, where = np.unique(keys, return_inverse=True)
        total = np.bincount(where, vals, minlength=len(whole))
        return pd.DataFrame([(-1, pdf["shard"].iloc[0], whole[total > 0].tobytes(), total[total > 0].tobytes())], columns=["block", "shard", "keys", "vals"])

    asked = counted.where("shard >= 0")
    summed = save(asked.groupBy("shard").applyInPandas(add, ROWS), "counts")

    def sums(batches: Iterator[Batch]) -> Iterator[Batch]:
        for b in batches:
            for v in b.column("vals").to_pylist():
                x = np.frombuffer(v)
                yield pa.RecordBatch.from_arrays([pa.array([len(x)], pa.int64()), pa.array([int(x.sum())], pa.int64())], names=["v", "n"])

    v, words = summed.mapInArrow(sums, "v bigint, n bigint").agg(F.coalesce(F.sum("v"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()

    def bytes_of(batches: Iterator[Batch]) -> Iterator[Batch]:
        total = np.zeros(257)
        for b in batches:
            for x in b.column("vals").to_pylist():
                total += np.frombuffer(x)
        yield pa.RecordBatch.from_arrays([pa.array(range(257), pa.int32()), pa.array(total)], names=["byte", "c"])

    byte = np.zeros(257)
    for r in counted.where("shard < 0").mapInArrow(bytes_of, "byte int, c double").groupBy("byte").agg(F.sum("c").alias("c")).collect():
        byte[r["byte"]] = r["c"]
    texts = int(byte[256])
    coder = code(byte[:256])
    v, words = v + (texts > 0), words + texts  # the end is a token too

    # Second pass: how often each slot of each context saw a zero and a one. A task sends its tables once. A sixteenth of the
    # training texts is counted apart: weights are learned on it over the tables of the others, then all counts are added up.
    apart = F.pmod(F.xxhash64("_text"), F.lit(16)) == 0

    def fill(batches: Iterator[Batch]) -> Iterator[Batch]:
        tables = np.zeros((2, CONTEXTS, 2 * SLOTS), np.uint32)
        held: tuple[list, list] = ([], [])
        size = [0, 0]
        for b in batches:
            for d, k in zip(b.column("_text"), b.column("_apart").to_pylist(), strict=True):
                d = d.as_py()
                held[k].append(tokens(d))  # only as many texts as are counted at once are words at a time
                size[k] += len(d)
                if size[k] >= COUNTED:
                    count_steps(held[k], coder, tables[k])
                    held[k].clear()
                    size[k] = 0
        for k in (0, 1):
            if held[k]:
                count_steps(held[k], coder, tables[k])
                held[k].clear()
            for i, own in enumerate(tables[k].reshape(CONTEXTS * PARTS, -1)):
                if own.any():
                    yield as_batch([(TaskContext.get().partitionId(), k * CONTEXTS * PARTS + i, squeezed(own), b"")])
        del tables
        tidy()

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(2 * SLOTS // PARTS, np.uint32)
        for x in pdf["keys"]:
            room = np.uint32(0xFFFFFFFF) - total  # a full counter stays full
            total += np.minimum(loosened(x), room)
        return pd.DataFrame([(pdf["block"].iloc[0] // FAN, pdf["shard"].iloc[0], squeezed(total), b"")], columns=["block", "shard", "keys", "vals"])

    def merged(rows: DataFrame) -> DataFrame:
        """One row for each part of a table. Tasks' tables are added up FAN at a time, so that no group grows with the input."""
        while True:
            last = rows.agg(F.max("block")).first()[0] or 0
            rows = save(rows.groupBy("shard", F.floor(F.col("block") / FAN)).applyInPandas(join, ROWS), "slots")
            if last < FAN:
                return rows

    def gathered(rows: DataFrame) -> np.ndarray:
        out = np.zeros((CONTEXTS * PARTS, SLOTS // PARTS), np.int16)
        for r in rows.toLocalIterator():  # of fixed size: SLOTS numbers a context
            both = loosened(r["keys"]).astype(np.float64)
            out[r["shard"]] = predictors(both[::2], both[1::2])
        return out.reshape(CONTEXTS, SLOTS)

    training = chosen.where("_train").select("_text", apart.cast("int").alias("_apart"))
    tasks = counted.select(F.shiftright("block", 32)).distinct().count()  # tasks that had rows
    slots_ = save(training.coalesce(max(min(tasks, FILLERS), tasks // FILLERS, 1)).mapInArrow(fill, ROWS), "slots")
    second = F.col("shard") - CONTEXTS * PARTS
    most, rest = merged(slots_.where(second < 0)), slots_.where(second >= 0).withColumn("shard", second)
    first = spark.sparkContext.broadcast(gathered(most))

    def learn(batches: Iterator[Batch]) -> Iterator[Batch]:
        weights = np.tile(np.array(START), (GATES, 1))
        seen = 0
        for b in batches:
            some = [tokens(d) for d in b.column("_text").to_pylist()]
            for lo, hi in pieces(some):
                steps = Steps(some[lo:hi], coder)
                seen += len(steps.bit)
                learned(steps, first.value, weights)
        yield pa.RecordBatch.from_arrays([pa.array(range(weights.size), pa.int32()), pa.array((weights * seen).ravel()), pa.array(np.full(weights.size, float(seen)))], names=["k", "w", "seen"])

    # Each task learns from the same start; the weights are averaged by the steps that they have seen.
    means = chosen.where("_train").where(apart).mapInArrow(learn, "k int, w double, seen double").groupBy("k").agg((F.sum("w") / F.nullif(F.sum("seen"), F.lit(0.0))).alias("w"))
    start = np.tile(np.array(START, np.float32), (GATES, 1))
    for r in means.collect():  # one number for each weight
        if r["w"] is not None:
            start.ravel()[r["k"]] = r["w"]
    first.destroy()
    model = spark.sparkContext.broadcast(gathered(merged(most.unionByName(rest))))

    def keys_of(b: Batch) -> tuple[np.ndarray, tuple]:
        texts_ = [tokens(d) for d in b.column("_text").to_pylist()]
        number: dict[bytes, int] = {}
        ids = [[number.setdefault(w, len(number)) for w in t] for t in texts_]
        return np.unique(np.fromiter(map(key, number), np.uint64, len(number))), (texts_, number, ids)

    def score(b: Batch, state: tuple, keys: np.ndarray, vals: np.ndarray) -> Batch:
        texts_, number, ids = state
        c = vals[np.searchsorted(keys, np.fromiter(map(key, number), np.uint64, len(number)))] if number else np.empty(0)
        each = np.log10((c + 1) / (words + v + 1))
        end = np.log10((texts + 1) / (words + v + 1))
        known = np.array([int((c[i] > 0).sum()) for i in ids]) + (texts > 0)
        base = np.array([each[i].sum() for i in ids]) + end
        bits = np.concatenate([mixed(Steps(texts_[lo:hi], coder), model.value, start) for lo, hi in pieces(texts_)])
        raw = np.array([len(d) for d in b.column("_text").to_pylist()])
        return pa.RecordBatch.from_arrays(
            [*(b.column(k) for k in keep), b.column("_held"), pa.array([len(t) + 1 for t in texts_], pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(raw), words), pa.int64()), pa.array(base), pa.array(-bits * np.log10(2)), pa.array(bits / np.maximum(raw, 1), mask=raw == 0)],
            names=[*keep, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"],
        )

    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    return scored(chosen, answered(asked.withColumn("vals", F.lit(b"")), summed, 0.0), keys_of, score, n, f"{kinds}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, bits_per_byte double", size=BLOCK)


#: Weights before any refinement: the word so far, the last three bytes, the word so far after the last short word.
START = (0.45, 0.15, 0.5)
