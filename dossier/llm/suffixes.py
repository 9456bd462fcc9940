"""Exact removal of repeated byte strings: a sparse suffix array, sorted by a distributed merge sort that knows common prefixes.

A string of LENGTH bytes holds LENGTH - HALF + 1 windows of HALF bytes, and the least window hash among them stands at the
same place in each of its occurrences. So only suffixes that start at such places (anchors), and only those whose window
occurs twice, need sorting. A repeated string shows as an anchor's common prefix with another to the right plus what both
have in common to the left.
"""

from __future__ import annotations

import bisect
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossier.llm.common import blob, numbered, save, tidy, with_first

LENGTH = 400
#: Suffixes that a task sorts before it writes a run.
RUN = 50_000
#: Bytes that are hashed at once.
PIECE = 500_000
#: Suffixes in a range of the merge, about, and the most with one window that are merged in one task.
RANGE, HOT = 100_000, 200_000
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


class Powers:
    """Powers of the base and its inverse modulo 2**64, as many as asked for so far."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up, cls.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, x, np.uint64)])) for x in (BASE, INVERSE))
        return cls.up[:n], cls.down[:n]


def window_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of each window of `size` bytes; as many as windows start."""
    n = len(data)
    if n < size:
        return np.empty(0, np.uint64)
    up, down = Powers.of(n)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up)])
    h = (total[size:] - total[:-size]) * down[: n - size + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def sliding(x: np.ndarray, size: int, best: np.ufunc, fill: np.uint64) -> np.ndarray:
    """best over x[i : i + size] for each i, in steps of blocks; len(x) - size + 1 values."""
    n = len(x)
    rows = -(-n // size)
    padded = np.full(rows * size, fill, x.dtype)
    padded[:n] = x
    block = padded.reshape(rows, size)
    ahead = best.accumulate(block, axis=1).ravel()
    back = best.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(back[: n - size + 1], ahead[size - 1 : n])


def anchors(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, offset, window hash) of every window of half the length that is least among those of some string of the length."""
    half = length // 2
    use = [i for i, t in enumerate(texts) if len(t) >= length]
    if not use:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    data = np.frombuffer(b"".join(texts[i] for i in use), np.uint8)
    sizes = np.array([len(texts[i]) for i in use])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    h = window_hashes(data, half)
    for e in ends[:-1]:  # windows that reach into the next text
        h[e - half + 1 : e] = NONE
    span = length - half + 1
    least = sliding(h, span, np.minimum, NONE)
    # Place i is taken if it is least in one of the strings that hold it, those that start at i - span + 1 to i.
    around = np.concatenate([np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)])
    taken = np.flatnonzero((sliding(around, span, np.maximum, np.uint64(0)) == h) & (h != NONE))
    which = np.searchsorted(ends, taken, side="right")
    return np.array(use)[which], taken - starts[which], h[taken]


def common(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the common prefix, known to be `at` at least."""
    n = min(len(a), len(b))
    if a[at:n] == b[at:n]:
        return n
    x = int.from_bytes(a[at:n], "big") ^ int.from_bytes(b[at:n], "big")
    return n - (x.bit_length() + 7) // 8


Entry = tuple[bytes, bytes, int, int]  # suffix, reversed bytes before it, text number, offset


def front_coded(entries: list[Entry]) -> bytes:
    """A sorted run: each suffix as the length it shares with the one before and the rest; what stands before it likewise."""
    out, last, before = [], b"", b""
    for s, p, t, o in entries:
        k, j = common(last, s), common(before, p)
        out.append(struct.pack("<HHHHqq", k, len(s) - k, j, len(p) - j, t, o))
        out += (s[k:], p[j:])
        last, before = s, p
    return b"".join(out)


def decoded(run: bytes) -> Iterator[tuple[int, Entry]]:
    """(common prefix with the suffix before, entry) of a run."""
    at, s, p = 0, b"", b""
    while at < len(run):
        k, m, j, n, t, o = struct.unpack_from("<HHHHqq", run, at)
        at += 24
        s, p = s[:k] + run[at : at + m], p[:j] + run[at + m : at + m + n]
        at += m + n
        yield k, (s, p, t, o)


def merged(runs: list[bytes]) -> Iterator[tuple[int, Entry]]:
    """All entries in order, each with its common prefix with the one before, by a loser tree.

    Each run's head keeps its common prefix with the last entry that left the tree. Of two heads the one with the longer
    prefix is smaller; only equal prefixes are compared, from their end on.
    """
    heads = [decoded(r) for r in runs]
    n = 1
    while n < len(heads):
        n *= 2
    state: list[list] = []  # common prefix with the last winner, entry
    for i in range(n):
        state.append(list(next(heads[i], (0, None))) if i < len(heads) else [0, None])
        state[i][0] = 0

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's prefix is then that with the winner."""
        x, y = state[a], state[b]
        if x[1] is None or y[1] is None:
            return (b, a) if x[1] is None else (a, b)
        if x[0] != y[0]:
            return (a, b) if x[0] > y[0] else (b, a)
        s, t = x[1][0], y[1][0]
        k = common(s, t, x[0])
        less = len(s) <= len(t) if k == min(len(s), len(t)) else s[k] < t[k]
        (y if less else x)[0] = k
        return (a, b) if less else (b, a)

    tree = [0] * n  # losers; the winner of all is in tree[0]
    won = list(range(n))
    level = n
    while level > 1:
        nxt = []
        for i in range(0, level, 2):
            w, lost = play(won[i], won[i + 1])
            tree[level // 2 + i // 2] = lost
            nxt.append(w)
        won, level = nxt, level // 2
    top = won[0]
    while state[top][1] is not None:
        yield state[top][0], state[top][1]
        state[top] = list(next(heads[top], (0, None)))
        node, w = (n + top) // 2, top
        while node:
            w, tree[node] = play(w, tree[node])
            node //= 2
        top = w


def extents(group: list[tuple[int, Entry]], length: int) -> tuple[list[int], list[int]]:
    """How far to the left of each suffix of a group, with half the length in common, its first and its last repeated string start.

    -1 and the length for a suffix in no repeated string. group: (common prefix with the one before, entry), in order. Neighbours are united by falling common prefix r; each set
    is kept in order of what stands before its suffixes. When the smaller set goes into the larger, every pair across has r
    in common to the right, and the longest they share to the left stands with a neighbour in that order. A pair counts if both
    add up to the length.
    """
    m = len(group)
    reach, low = [-1] * m, [length] * m  # furthest to the left; least offset of a string's start before the suffix
    sets: list[list[tuple[bytes, int]]] = [[(e[1], i)] for i, (_, e) in enumerate(group)]
    owner = list(range(m))

    def root(i: int) -> int:
        while owner[i] != i:
            owner[i] = owner[owner[i]]
            i = owner[i]
        return i

    for i in sorted(range(1, m), key=lambda i: -group[i][0]):
        right = min(group[i][0], length)
        need = length - right
        a, b = root(i - 1), root(i)
        if len(sets[a]) < len(sets[b]):
            a, b = b, a
        large, small = sets[a], sets[b]
        for x in small:
            k = bisect.bisect_left(large, x)
            for y in large[max(0, k - 1) : k + 1]:
                if (left := common(x[0], y[0])) >= need:
                    for z in (x[1], y[1]):
                        reach[z], low[z] = max(reach[z], left), min(low[z], need)
        if len(small) > 64:
            large += small
            large.sort()
        else:
            for x in small:
                bisect.insort(large, x)
        sets[b], owner[b] = [], a
    return reach, low


def spans_of(group: list[tuple[int, Entry]], length: int) -> Iterator[tuple[int, int, int]]:
    """(text number, start, end) of what repeated strings cover around each suffix of a group with half the length in common."""
    reach, low = extents(group, length)
    for i, (_, (_, _, t, o)) in enumerate(group):
        if reach[i] >= 0:
            yield t, o - reach[i], o - low[i] + length


def later_spans(group: list[tuple[int, Entry]], length: int) -> Iterator[tuple[int, int, int]]:
    """The same without each string's first occurrence, by text number and offset."""
    reach, low = extents(group, length)
    first: dict[int, tuple[int, int]] = {}
    for i in sorted((i for i, x in enumerate(reach) if x >= 0), key=lambda i: group[i][1][2:]):
        s, p, t, o = group[i][1]
        around, mid = p[::-1] + s, len(p)
        run: list[int] = []
        for a in range(reach[i], low[i] - 1, -1):
            place = (t, o - a)
            if first.setdefault(xxhash.xxh3_128_intdigest(around[mid - a : mid - a + length]), place) != place:
                run = [run[0], o - a] if run else [o - a, o - a]
            elif run:
                yield t, run[0], run[1] + length
                run = []
        if run:
            yield t, run[0], run[1] + length


def kept_bytes(data: bytes, spans: list[dict]) -> bytes:
    edge = [0, *(x for s in spans for x in (s["start"], s["end"])), len(data)]
    return b"".join(data[a:b] for a, b in zip(edge[::2], edge[1::2], strict=True))


def with_key(rows: DataFrame) -> DataFrame:
    """Rows (_rid, key, data) of rows (_rid, row): the bytes of row.text and their MD5 digest."""
    return rows.select("_rid", blob("row.text").alias("data")).select("_rid", F.unhex(F.md5("data")).alias("key"), "data")


def repeats(docs: DataFrame, length: int = LENGTH, run: int = RUN, range_size: int = RANGE, hot: int = HOT, keep_first: bool = False, stable: bool = False) -> DataFrame:
    """Rows (_rid, key, n, copies, spans, kept) for each row of docs (text): spans are the bytes that repeated strings cover.

    key: the text's MD5 digest; n: its bytes; copies: how many rows have it; spans: sorted, disjoint and not touching,
    array of struct (start, end), empty if nothing goes; kept: the other bytes, null if nothing goes. A text of `length` bytes
    or more that several rows have is covered whole. With keep_first a string's first occurrence, by row and offset, is not
    covered by it. Strings are judged on the texts as given, and never cross documents. Null counts as an empty text; columns
    besides text are ignored.

    Equal texts are worked on once. A window that more than `hot` places share is not merged in one task: its strings are
    hashed and counted by a grouped aggregate, with the same result. stable: see common.numbered.
    """
    return repeated(with_key(numbered(docs.select("text"), stable)), length, run, range_size, hot, keep_first)


def repeated(texts: DataFrame, length: int, run: int = RUN, range_size: int = RANGE, hot: int = HOT, keep_first: bool = False) -> DataFrame:
    """What repeats() gives, for rows of with_key()."""
    half = length // 2

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = b.column("data").to_pylist()
            off, h = [[] for _ in data], [[] for _ in data]

            def scan(pieces: list[tuple[int, int, bytes]], off: list = off, h: list = h) -> None:
                which, o, x = anchors([p for _, _, p in pieces], length)
                edge = np.searchsorted(which, np.arange(len(pieces) + 1))
                for (i, at, _), lo, hi in zip(pieces, edge[:-1], edge[1:], strict=True):
                    off[i].append(o[lo:hi] + at)
                    h[i].append(x[lo:hi])

            held: list[tuple[int, int, bytes]] = []
            size = 0
            for i, d in enumerate(data):
                for at in range(0, max(1, len(d)), PIECE):  # long texts in pieces that share a string's length
                    held.append((i, at, d[at : at + PIECE + length - 1]))
                    size += len(held[-1][2])
                    if size >= PIECE:
                        scan(held)
                        held, size = [], 0
            scan(held)
            edge = np.cumsum([0, *(sum(map(len, x)) for x in off)])
            flat = lambda parts, kind: np.concatenate([np.empty(0, kind), *(y for x in parts for y in x)])
            yield pa.RecordBatch.from_arrays(
                [b.column("_rid"), b.column("key"), pa.array([len(x) for x in data], pa.int64()), pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(flat(off, np.int64), pa.int64())), pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(flat(h, np.uint64).view(np.int64), pa.int64()))],
                names=["_rid", "key", "n", "off", "h"],
            )
        tidy()

    found = save(texts.mapInArrow(find, "_rid bigint, key binary, n bigint, off array<bigint>, h array<bigint>"), "anchors")
    shared = save(with_first(found.select("_rid", "key"), "key", F.col("_rid"), F.col("_rid")).select("_rid", "first", "copies"), "copies")
    once = found.join(shared.where(F.col("first") != F.col("_rid")), "_rid", "left_anti")
    placed = save(once.select("_rid", F.explode(F.arrays_zip("off", "h")).alias("x")).select("_rid", "x.off", "x.h").distinct(), "places")
    often = save(placed.groupBy("h").agg(F.count("*").alias("often")).where("often > 1"), "often")  # so that Spark can split the join
    again = placed.join(often, "h").select("_rid", F.struct("off", "h", (F.col("often") > hot).alias("hot")).alias("x"))
    again = again.groupBy("_rid").agg(F.collect_list("x").alias("at"))
    chosen = save(texts.join(again, "_rid").select("_rid", "data", "at"), "chosen")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def write(held: list[tuple[int, Entry]]) -> pa.RecordBatch:
            held.sort(key=lambda x: (x[0] % ranges, x[1][0]))
            out: list[tuple[int, bytes]] = []
            lo = 0
            while lo < len(held):
                r, hi = held[lo][0] % ranges, lo
                while hi < len(held) and held[hi][0] % ranges == r:
                    hi += 1
                out.append((r, front_coded([e for _, e in held[lo:hi]])))
                lo = hi
            return pa.RecordBatch.from_arrays([pa.array([r for r, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], names=["r", "run"])

        held: list[tuple[int, Entry]] = []
        for b in batches:
            for t, d, at in zip(*(b.column(c) for c in ("_rid", "data", "at")), strict=True):
                t, d = t.as_py(), d.as_py()
                for x in at.as_py():
                    if not x["hot"]:
                        o = x["off"]
                        held.append((x["h"], (d[o : o + length], d[max(0, o - (length - half)) : o][::-1], t, o)))
                        if len(held) >= run:
                            yield write(held)
                            held = []
        if held:
            yield write(held)
        tidy()

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        covered = later_spans if keep_first else spans_of
        out: list[tuple[int, int, int]] = []
        group: list[tuple[int, Entry]] = []
        for k, e in merged(list(pdf["run"])):
            if k < half:
                if len(group) > 1:
                    out += covered(group, length)
                group = []
            group.append((k, e))
        if len(group) > 1:
            out += covered(group, length)
        return pd.DataFrame(out, columns=["_rid", "start", "end"])

    n = chosen.select(F.sum(F.size("at"))).first()[0] or 0
    ranges = max(1, -(-n // range_size))
    spans = chosen.mapInArrow(sort, "r bigint, run binary").groupBy("r").applyInPandas(merge, "_rid bigint, start bigint, end bigint")
    if chosen.where(F.exists("at", lambda x: x["hot"])).limit(1).count():
        spans = spans.unionByName(counted(chosen, length, keep_first))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [kept_bytes(d, s) for d, s in zip(b.column("data").to_pylist(), b.column("spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("_rid"), b.column("spans"), pa.array(kept, pa.binary())], names=["_rid", "spans", "kept"])

    done = chosen.select("_rid", "data").join(united(spans), "_rid")
    done = done.mapInArrow(cut, "_rid bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")
    copy = F.col("first") != F.col("_rid") if keep_first else F.col("copies") > 1
    whole = copy & (F.col("n") >= length)
    all_of = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n").alias("end")))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    rows = found.select("_rid", "key", "n").join(shared, "_rid", "left").join(done, "_rid", "left")
    return rows.select("_rid", "key", "n", F.coalesce("copies", F.lit(1)).alias("copies"), F.when(whole, all_of).otherwise(F.coalesce("spans", none)).alias("spans"), F.when(whole, F.lit(b"")).otherwise(F.col("kept")).alias("kept"))


def counted(chosen: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """Spans around the anchors marked hot: every string of the length that holds such a window, kept if its digest occurs twice
    (with keep_first, earlier)."""
    half = length // 2

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t, d, at in zip(*(b.column(c) for c in ("_rid", "data", "at")), strict=True):
                t, d = t.as_py(), d.as_py()
                starts = sorted({p for x in at.as_py() if x["hot"] for p in range(max(0, x["off"] - (length - half)), min(x["off"], len(d) - length) + 1)})
                if starts:
                    digests = [hashlib.blake2b(d[p : p + length], digest_size=16).digest() for p in starts]
                    yield pa.RecordBatch.from_arrays([pa.array([t] * len(starts), pa.int64()), pa.array(starts, pa.int64()), pa.array(digests, pa.binary())], names=["_rid", "start", "digest"])

    every = save(chosen.mapInArrow(strings, "_rid bigint, start bigint, digest binary"), "strings")
    place = F.struct("_rid", "start")
    twice = with_first(every, "digest", place, F.col("_rid"))
    return (twice.where(place != F.col("first")) if keep_first else twice).select("_rid", "start", (F.col("start") + length).alias("end"))


def united(spans: DataFrame) -> DataFrame:
    """Rows (_rid, spans): each text's spans in order, those that overlap or touch made one."""
    order = W.partitionBy("_rid").orderBy("start", "end")
    ahead = order.rowsBetween(W.unboundedPreceding, -1)
    opens = spans.distinct().withColumn("opens", F.coalesce((F.col("start") > F.max("end").over(ahead)).cast("int"), F.lit(1)))
    run = opens.withColumn("run", F.sum("opens").over(order.rowsBetween(W.unboundedPreceding, 0)))
    one = run.groupBy("_rid", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return one.groupBy("_rid").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))


def digests(docs: DataFrame, length: int = LENGTH, stable: bool = False) -> DataFrame:
    """For each row of docs: doc_id, n_bytes, n_removed, n_spans and kept_sha256."""
    rows = numbered(docs.select("doc_id", "text"), stable)
    found = repeated(with_key(rows), length)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    found = found.select("_rid", F.col("n").alias("n_bytes"), removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("cut_sha256"))
    whole = rows.select("_rid", "row.doc_id", F.sha2(blob("row.text"), 256).alias("whole_sha256"))
    return whole.join(found, "_rid").select("doc_id", "n_bytes", "n_removed", "n_spans", F.coalesce("cut_sha256", "whole_sha256").alias("kept_sha256"))


def drop_repeats(docs: DataFrame, length: int = LENGTH, keep_first: bool = True, stable: bool = False) -> DataFrame:
    """docs with what repeats cut out of text, but for each string's first occurrence (by row and offset) if keep_first.

    Bytes of a character that a span cuts through go as well; other columns stay. n_chars is set anew where docs has it; null
    text stays null.
    """

    @F.pandas_udf("string")
    def valid(data: pd.Series) -> pd.Series:
        return data.map(lambda x: None if x is None else x.decode("utf-8", "ignore"))

    rows = numbered(docs, stable)
    found = repeated(with_key(rows), length, keep_first=keep_first).where("kept is not null").select("_rid", "kept")
    own = {"text": F.when(F.col("kept").isNull(), F.col("row.text")).otherwise(valid("kept"))}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.when(F.col("kept").isNull(), F.col("row.n_chars")).otherwise(F.length(valid("kept")).cast(docs.schema["n_chars"].dataType))
    return rows.join(found, "_rid", "left").select(*[own.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
