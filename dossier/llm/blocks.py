"""Lookups of many keys by blocks of documents: sharded count joins that carry arrays instead of a row for each token.

A block is a few megabytes of documents from one task. A first pass gives each block's distinct keys, dealt by shard; a
shard's keys from all blocks meet its share of the counts once; the answers go back to the block, where a second pass over
the same documents uses them. Both passes number blocks by partition and order, which a second read of the files repeats.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from dossier.llm.common import tidy

#: Bytes of text in a block, about.
BLOCK = 3_000_000
Batch = pa.RecordBatch


def chunks(batches: Iterator[Batch], size: int = BLOCK) -> Iterator[tuple[int, Batch]]:
    """(block number, rows) of a task's rows; a block ends once its column _text holds `size` bytes."""
    first = TaskContext.get().partitionId() << 32
    held: list[Batch] = []
    n = total = 0

    def block() -> tuple[int, Batch]:
        return first + n, pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for b in batches:
        lo = 0
        ends = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(b.column("_text")), 0)))
        while lo < b.num_rows:
            before = ends[lo - 1] if lo else 0
            hi = min(int(np.searchsorted(ends, before + size - total)) + 1, b.num_rows)
            held.append(b.slice(lo, hi - lo))
            total += int(ends[hi - 1] - before)
            lo = hi
            if total >= size:
                yield block()
                held, total, n = [], 0, n + 1
    if held:
        yield block()
    tidy()


def packed(batch: Batch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> Batch:
    return pa.ipc.open_stream(data).read_next_batch()


def dealt(keys: np.ndarray, shards: int) -> list[tuple[int, np.ndarray]]:
    """(shard, places of its keys) for sorted distinct uint64 keys."""
    shard = (keys >> np.uint64(40)).astype(np.int64) % shards
    order = np.argsort(shard, kind="stable")
    edge = np.searchsorted(shard[order], np.arange(shards + 1))
    return [(int(s), order[edge[s] : edge[s + 1]]) for s in np.flatnonzero(np.diff(edge))]


def sharded(block: int, keys: np.ndarray, shards: int, values: np.ndarray | None = None) -> Iterator[tuple[int, int, bytes, bytes]]:
    """Rows (block, shard, keys, vals) of sorted distinct keys."""
    for s, at in dealt(keys, shards):
        yield block, s, keys[at].tobytes(), b"" if values is None else values[at].tobytes()


ROWS = "block bigint, shard bigint, keys binary, vals binary"


def as_batch(rows: list[tuple[int, int, bytes, bytes]]) -> Batch:
    cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())], names=["block", "shard", "keys", "vals"])


def answered(asked: DataFrame, known: DataFrame, fill: float, kind: type = np.float64) -> DataFrame:
    """Rows (block, shard, keys, vals): the values in known of the keys that asked has, in their order, and no keys; `fill` where
    a key has none. known has the same columns, vals being its keys' values."""

    def look(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([np.empty(0, np.uint64), *(np.frombuffer(x, np.uint64) for x in right["keys"])])
        vals = np.concatenate([np.empty(0, kind), *(np.frombuffer(x, kind) for x in right["vals"])])
        order = np.argsort(keys)
        keys, vals = keys[order], vals[order]
        out = []
        for b, s, x in zip(left["block"], left["shard"], left["keys"], strict=True):
            k = np.frombuffer(x, np.uint64)
            v = np.full(len(k), fill, kind)
            if len(keys):
                i = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
                v = np.where(keys[i] == k, vals[i], v)
            out.append((b, s, b"", v.tobytes()))
        return pd.DataFrame(out, columns=["block", "shard", "keys", "vals"])

    return asked.groupBy("shard").cogroup(known.groupBy("shard")).applyInPandas(look, ROWS)


def scored(docs: DataFrame, answers: DataFrame, keys_of: Callable[[Batch], tuple[np.ndarray, object]], score: Callable, shards: int, schema: str, kind: type = np.float64, size: int = BLOCK) -> DataFrame:
    """score(rows, state, keys, values) for each block of docs (with column _text), as rows of the schema.

    keys_of gives a block's sorted distinct keys, those that were asked for, and a state that score gets.
    """

    def pack(batches: Iterator[Batch]) -> Iterator[Batch]:
        for n, b in chunks(batches, size):
            yield as_batch([(n, -1, packed(b), b"")])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        got = {s: np.frombuffer(v, kind) for s, v in zip(pdf["shard"], pdf["vals"], strict=True) if s >= 0}
        out = []
        for x in pdf["keys"][pdf["shard"] < 0]:
            b = unpacked(x)
            keys, state = keys_of(b)
            vals = np.empty(len(keys), kind)
            for s, at in dealt(keys, shards):
                vals[at] = got[s]
            out.append(score(b, state, keys, vals).to_pandas())
            del b, state, keys, vals
        tidy()
        return pd.concat(out) if out else pd.DataFrame(columns=[f.split()[0].strip("`") for f in schema.split(", ")])

    return docs.mapInArrow(pack, ROWS).unionByName(answers).groupBy("block").applyInPandas(run, schema)
