"""Byte-level BPE encoding and decoding by recursive queries in each partition."""

from __future__ import annotations

import base64
import functools
import gc
import hashlib
import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import tidy

#: Pieces that one recursive query encodes, pieces that texts wait with until their new ones are encoded together, and pieces that
#: a worker remembers, within a task, from task to task, and as met more than once.
QUERY_PIECES, WAITING, REMEMBERED, KEPT, OFTEN = 20_000, 150_000, 220_000, 40_000, 80_000
#: Bytes from which a piece is encoded with all occurrences of its least pair at once.
LONG = 256
#: Bytes from which a piece is encoded by a heap of its pairs: a recursive query keeps all its rounds, too many for such a piece.
HUGE = 8192

# Token-position rows (key: piece and byte position) join the merge table; each round contracts every piece's leftmost pair of
# minimum rank; pieces without a pair drop out, so a piece's last round holds its tokens.
ENCODE = """
WITH RECURSIVE step(round, key, token) AS (
    SELECT 0, key, token FROM first_tokens
  UNION ALL
    SELECT s.round + 1, s.key, CASE WHEN s.key = b.key THEN b.token ELSE s.token END
    FROM step s JOIN (
      SELECT p.key >> 32 AS piece, min(m.token::BIGINT << 32 | (p.key & 4294967295)) AS best, (best >> 32)::INT AS token,
        (p.key >> 32) << 32 | (best & 4294967295) AS key, arg_min(p.after, m.token::BIGINT << 32 | (p.key & 4294967295)) AS gone
      FROM (SELECT key, token, lead(token) OVER o AS next, lead(key) OVER o AS after FROM step WINDOW o AS (ORDER BY key)) p
      JOIN merges m ON m.pair = (p.token::BIGINT << 32 | p.next) WHERE p.after >> 32 = p.key >> 32 GROUP BY p.key >> 32
    ) b ON b.piece = s.key >> 32
    WHERE s.key <> b.gone
)
SELECT round, key, token FROM step
"""
# The same without a sort in each round: a join hands the rounds' rows on in the order of its larger side, by key like the first ones.
# Coder.merged looks at every round's rows and asks ENCODE again if any are out of order.
UNSORTED = ENCODE.replace("WINDOW o AS (ORDER BY key)", "WINDOW o AS ()")
# ENCODE for long pieces, with every occurrence of the least pair in a round if the pair is calm: no merge of the new token
# ranks before it, so a contraction makes no pair that comes before the occurrences still to be contracted. Of occurrences
# that overlap, every other one counts from the left. Of a pair that isn't calm, only the leftmost is contracted.
ENCODE_LONG = """
WITH RECURSIVE step(round, key, token) AS (
    SELECT 0, key, token FROM first_tokens
  UNION ALL
    SELECT round + 1, key, coalesce(joined, token) FROM (
      SELECT *, lag(joined) OVER (PARTITION BY piece ORDER BY key) AS before FROM (
        SELECT *, CASE WHEN rank = least AND (nth = 1 OR calm AND (row_number() OVER (PARTITION BY piece, rank = least, idx - nth ORDER BY key)) % 2 = 1) THEN rank END AS joined
        FROM (
          SELECT *, row_number() OVER (PARTITION BY piece, rank = least ORDER BY key) AS nth FROM (
            SELECT *, min(rank) OVER (PARTITION BY piece) AS least FROM (
              SELECT p.*, m.token AS rank, m.calm FROM (
                SELECT *, key >> 32 AS piece, lead(token) OVER o AS next, row_number() OVER o AS idx FROM step
                WINDOW o AS (PARTITION BY key >> 32 ORDER BY key)) p
              LEFT JOIN merges m ON m.pair = (p.token::BIGINT << 32 | p.next)))
          WHERE least IS NOT NULL)))
    WHERE before IS NULL
)
SELECT round, key, token FROM step
"""
# Ordered aggregation puts the tokens' bytes together. All rows are sorted at once, which one thread then aggregates in their order:
# an order inside the aggregate sorts each piece's few rows by itself, at seven times the cost.
DECODE = """
SELECT piece, unhex(string_agg(hex, '')) AS bytes
FROM (SELECT i.piece, t.hex FROM ids i JOIN tokens t ON t.token = i.token ORDER BY i.piece, i."at") GROUP BY piece
"""


class Coder:
    """The rank file in an in-memory database of one task's process."""

    def __init__(self, path: str, pattern: str):
        import duckdb

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.split = regex.compile(pattern).findall
        self.known: dict[str, tuple[str, int, bytes]] = {}
        self.recent: set[str] = set()
        self.often: set[str] = set()  # pieces met again after they were learned: most are met once and never asked for again
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "200MB", "temp_directory": ""})
        pairs = [(self.ranks[x[:i]], self.ranks[x[i:]], r) for x, r in self.ranks.items() for i in range(1, len(x)) if x[:i] in self.ranks and x[i:] in self.ranks]
        uneasy = {x for a, b, r in pairs for x in (a, b) if r < x}
        # A pair of tokens merges into the token that has their bytes; its rank decides the order.
        table = pa.table({"pair": pa.array([p[0] << 32 | p[1] for p in pairs], pa.int64()), "token": pa.array([p[2] for p in pairs], pa.int32()), "calm": pa.array([p[2] not in uneasy for p in pairs])})
        tokens = pa.table({"token": pa.array(self.ranks.values(), pa.int32()), "bytes": pa.array(list(self.ranks), pa.binary())})
        self.db.register("merges_in", table)
        self.db.register("tokens_in", tokens)
        self.db.execute("CREATE TABLE merges AS FROM merges_in")
        self.db.execute("CREATE TABLE tokens AS SELECT token, hex(bytes) AS hex FROM tokens_in")
        self.db.unregister("merges_in")
        self.db.unregister("tokens_in")
        self.byte = np.array([self.ranks[bytes([k])] for k in range(256)], np.int32)

    def merged(self, pieces: list[bytes], query: str) -> tuple[np.ndarray, np.ndarray]:
        """(number of tokens of each piece, all tokens in order)"""
        size = np.array([len(p) for p in pieces])
        start = np.repeat(np.cumsum(size) - size, size)
        key = np.repeat(np.arange(len(pieces), dtype=np.int64) << 32, size) | (np.arange(size.sum()) - start)
        self.db.register("first_tokens", pa.table({"key": key, "token": self.byte[np.frombuffer(b"".join(pieces), np.uint8)]}))
        got = self.db.sql(query).to_arrow_table()
        round_, key, token = (got.column(i).to_numpy() for i in range(3))
        if query == UNSORTED and not ((np.diff(round_) > 0) | (np.diff(round_) == 0) & (np.diff(key) > 0)).all():
            return self.merged(pieces, ENCODE)
        piece = key >> 32
        last = np.zeros(len(pieces), round_.dtype)
        np.maximum.at(last, piece, round_)
        done = round_ == last[piece]
        key, token = key[done], token[done]
        order = np.argsort(key)
        return np.bincount(key >> 32, minlength=len(pieces)), token[order]

    @functools.cached_property
    def merges(self) -> dict[int, int]:
        """The merge table as a dictionary, for huge pieces alone."""
        got = self.db.sql("SELECT pair, token FROM merges").to_arrow_table()
        return dict(zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True))

    def heaped(self, piece: bytes) -> np.ndarray:
        """A piece's tokens: the least pair, of equal ones the leftmost, is contracted as long as there is one.

        Pairs wait in a heap as rank and position; one that has changed meanwhile is passed over. Time grows as n log n, memory is
        about 150 bytes for each byte of the piece.
        """
        n, get = len(piece), self.merges.get
        token = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r << 32 | i for i in range(n - 1) if (r := get(token[i] << 32 | token[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            best = heapq.heappop(heap)
            i = best & 0xFFFFFFFF
            j = after[i]
            if token[i] < 0 or j >= n or get(token[i] << 32 | token[j]) != best >> 32:
                continue
            token[i], token[j] = best >> 32, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := get(token[i] << 32 | token[k])) is not None:
                    heapq.heappush(heap, r << 32 | i)
            h = before[i]
            if h >= 0 and (r := get(token[h] << 32 | token[i])) is not None:
                heapq.heappush(heap, r << 32 | h)
        found = np.array(token, np.int32)
        return found[found >= 0]

    def learn(self, pieces: list[str]) -> None:
        """Encodes and decodes pieces. One that is a token itself needs no merge; the others go through the queries."""
        data = list(map(str.encode, pieces))
        rank = list(map(self.ranks.get, data))
        whole = [(p, r) for p, r in zip(pieces, rank, strict=True) if r is not None]
        rest = [(p, b) for p, b, r in zip(pieces, data, rank, strict=True) if r is None]
        self.keep([p for p, _ in whole], np.ones(len(whole), np.int64), np.array([r for _, r in whole], np.int32))
        for query, some in ((UNSORTED, [x for x in rest if len(x[1]) < LONG]), (ENCODE_LONG, [x for x in rest if LONG <= len(x[1]) < HUGE])):
            for lo in range(0, len(some), QUERY_PIECES):
                part = some[lo : lo + QUERY_PIECES]
                self.keep([p for p, _ in part], *self.merged([b for _, b in part], query))
        for p, b in rest:
            if len(b) >= HUGE:
                found = self.heaped(b)
                self.keep([p], np.array([len(found)]), found)

    def keep(self, pieces: list[str], size: np.ndarray, token: np.ndarray) -> None:
        data = self.decode(size, token)
        text = list(map(str, token.tolist()))
        edge = [0, *np.cumsum(size).tolist()]
        ids = map(",".join, [text[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)])
        self.known.update(zip(pieces, zip(ids, size.tolist(), data, strict=True), strict=True))

    def decode(self, size: np.ndarray, token: np.ndarray) -> list[bytes]:
        """The bytes of each of len(size) runs of tokens."""
        start = np.repeat(np.cumsum(size) - size, size)
        row = np.repeat(np.arange(len(size), dtype=np.int32), size)
        self.db.register("ids", pa.table({"piece": row, "at": (np.arange(len(row)) - start).astype(np.int32), "token": token.astype(np.int32)}))
        out = [b""] * len(size)
        got = self.db.sql(DECODE).to_arrow_table()
        for i, x in zip(got.column(0).to_numpy().tolist(), got.column(1).to_numpy().tolist(), strict=True):
            out[i] = x
        return out

    def encode(self, texts: list[str]) -> Iterator[list[str]]:
        """Each text's pieces, all of which are known until the next call for a text."""
        held: list[list[str]] = []
        size = 0
        for t in texts:
            held.append(self.split(t))
            size += len(held[-1])
            if size > WAITING:
                yield from self.ready(held)
                held, size = [], 0
        yield from self.ready(held)

    def ready(self, held: list[list[str]]) -> Iterator[list[str]]:
        self.recent = pieces = set().union(*held)
        again = pieces.intersection(self.known)
        new = pieces.difference(again)
        self.often |= again
        if len(self.often) > OFTEN:
            self.often = again
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {p: self.known[p] for p in again | self.often}
        self.learn(list(new))
        yield from held

    def rest(self) -> None:
        """Between tasks a worker remembers some of the pieces: those met more than once first, then those met last."""
        if len(self.known) > KEPT:
            some = itertools.islice(itertools.chain(self.often, self.recent - self.often), KEPT)
            self.known = {p: self.known[p] for p in some if p in self.known}
            self.often &= self.known.keys()
        self.recent = set()


@functools.lru_cache(maxsize=1)
def coder(path: str, pattern: str) -> Coder:
    return Coder(path, pattern)


def encoded(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), with_ids: bool = True) -> DataFrame:
    """For each row of docs the columns in keep, n_tokens, ids (if asked for), ids_sha256 and decoded_sha256.

    Each match of the pattern is encoded by itself; null text counts as empty and has no tokens. ids_sha256 is of the decimal
    ids joined by commas, decoded_sha256 of the bytes that the ids decode to. A match may be as long as its text (see HUGE). path is a rank file that all executors see.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        gc.disable()  # the remembered pieces are no cycles, but a search for some would go through them over and over
        try:
            yield from coded(c, batches)
        finally:
            gc.enable()
        c.rest()
        tidy()

    def coded(c: Coder, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, ids, digests, decoded = [], [], [], []
            for pieces in c.encode(b.column("_text").to_pylist()):
                own_ids, sizes, data = zip(*map(c.known.__getitem__, pieces), strict=True) if pieces else ((), (), ())
                text = ",".join(own_ids)
                counts.append(sum(sizes))
                digests.append(hashlib.sha256(text.encode()).hexdigest())
                decoded.append(hashlib.sha256(b"".join(data)).hexdigest())
                if with_ids:
                    ids.append([int(x) for x in text.split(",")] if text else [])
            own = [pa.array(counts, pa.int64()), *([pa.array(ids, pa.list_(pa.int32()))] if with_ids else []), pa.array(digests), pa.array(decoded)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), *own], names=[*keep, "n_tokens", *(["ids"] if with_ids else []), "ids_sha256", "decoded_sha256"])

    chosen = docs.select(*keep, F.coalesce("text", F.lit("")).alias("_text"))
    kinds = ", ".join(f"`{k}` {chosen.schema[k].dataType.simpleString()}" for k in keep)
    return chosen.mapInArrow(run, f"{kinds}, n_tokens bigint, {'ids array<int>, ' if with_ids else ''}ids_sha256 string, decoded_sha256 string")


def decoded(tokens: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """For each row of tokens the columns in keep and data, the bytes of its ids; null or empty ids give no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        for b in batches:
            rows = b.column("ids").to_pylist()
            size = np.array([len(x or ()) for x in rows], np.int64)
            got = c.decode(size, np.array([t for x in rows for t in x or ()], np.int32))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(got, pa.binary())], names=[*keep, "data"])

    chosen = tokens.select(*keep, "ids")
    kinds = ", ".join(f"`{k}` {chosen.schema[k].dataType.simpleString()}" for k in keep)
    return chosen.mapInArrow(run, f"{kinds}, data binary")
