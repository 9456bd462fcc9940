"""Registries that grow: each new file's observations are folded into the tables; a file that comes again changes nothing.

Facts are partial folds that readers merge. Changes come from a state for each case, kept by Spark: a batch costs what it holds and the
runs next to its own, however many runs there have been. Both write through batches, whose folders compact_* fold together.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from dossier.streaming import batches

OBSERVATIONS = "coleta_id string, incidente bigint, aba string, sid bigint, posicao int, tipo string, descricao string, hash_natural string"
ITEMS = "incidente bigint, coleta_id string, lista string, posicao int, hash_natural string, item string"
PLACE = "struct<sid:bigint,posicao:int>"
PARTIAL = f"hash_natural string, first_at {PLACE}, whole_at {PLACE}, tipo string, descricao string"
#: The tab that is a whole list; others hold a part of it and don't move the last sight.
FULL_TAB = "andamentos"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# ------------------------------------------------------------ facts


def fold(observations: DataFrame) -> DataFrame:
    """Partial result of the seen-fold; see merged."""
    at = F.struct("sid", "posicao")
    whole = F.max(F.when(F.col("aba") == FULL_TAB, at))
    return observations.groupBy("hash_natural").agg(F.min(at).alias("first_at"), whole.alias("whole_at"), F.min_by("tipo", at).alias("tipo"), F.min_by("descricao", at).alias("descricao"))


def folded(partial: DataFrame) -> DataFrame:
    """Partial results as one a hash: minima and maxima, so order, splits and repetition don't matter."""
    return partial.groupBy("hash_natural").agg(F.min("first_at").alias("first_at"), F.max("whole_at").alias("whole_at"), F.min_by("tipo", "first_at").alias("tipo"), F.min_by("descricao", "first_at").alias("descricao"))


def merged(partial: DataFrame) -> DataFrame:
    """Partial results as one row a hash, as seen.upsert_seen gives it."""
    last = F.coalesce("whole_at", "first_at")
    return folded(partial).select("hash_natural", F.col("first_at.sid").alias("snapshot_first_seen"), last["sid"].alias("snapshot_last_seen"), last["posicao"].alias("posicao"), "tipo", "descricao")


def facts(spark: SparkSession, target: str) -> DataFrame:
    """The table of facts that stream_ingest has gathered so far."""
    return merged(batches.read(spark, target, PARTIAL))


def compact_facts(spark: SparkSession, target: str) -> int | None:
    return batches.compact(spark, target, PARTIAL, folded)


def stream_ingest(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that folds new files of observations (JSON lines) into partial tables under target, then stops. See facts."""

    def each(batch: DataFrame, n: int) -> None:
        batches.put(fold(batch), target, n)

    rows = spark.readStream.schema(OBSERVATIONS).option("maxFilesPerTrigger", 1).json(source)
    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# ------------------------------------------------------------ changes

#: A row of a comparison; efeito is null in the one row that says that a pair was compared. versao counts a case's comparisons.
CHANGES = "incidente bigint, anterior string, coleta_id string, lista string, efeito string, hash_natural string, item string, posicao int, versao bigint"
_NAMES = [f.split()[0] for f in CHANGES.split(", ")]
Change = Row(*_NAMES)
Held = dict[str, dict[str, tuple[str, int]]]  # list: hash: (item, place)


def compared(old: Held, new: Held) -> Iterator[tuple[str, str, str, str, int]]:
    """(list, effect, hash, item, place) of what appeared and disappeared, in the lists that both runs have."""
    for name in old.keys() & new.keys():
        for effect, here, there in (("apareceu", new[name], old[name]), ("sumiu", old[name], new[name])):
            for h, (item, place) in here.items():
                if h not in there:
                    yield name, effect, h, item, place


class Comparisons(StatefulProcessor):
    """A case's runs as state, each by its id; new runs are compared with the runs next to them in time.

    A run that comes late parts two that were compared before: both its pairs are compared, and the later comparison of a run counts.
    With `quiet`, a timer fires when a case had no new run for so many milliseconds: all its runs but the last are let go, and runs that
    come later still but lie before it are only compared with those that came since.
    """

    def __init__(self, quiet: int | None = None) -> None:
        self.quiet = quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.runs = handle.getMapState("runs", "coleta_id string", "itens string")
        self.known = handle.getValueState("known", "coletas array<string>, versao bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N802, N803
        came: dict[str, Held] = {}
        for r in rows:
            own = came.setdefault(r["coleta_id"], {}).setdefault(r["lista"], {})
            h, at = r["hash_natural"], r["posicao"]
            if h not in own or (at is not None and (own[h][1] is None or at < own[h][1])):
                own[h] = (r["item"], at)
        # Each question to the state is a message to the JVM, so a case's ids and its count lie together and are asked for once.
        runs, n = self.known.get() or ([], 0)
        before, held = set(runs), {}

        def items(run: str) -> Held:
            if run not in held:
                held[run] = json.loads(self.runs.getValue((run,))[0]) if run in before else {}
            return held[run]

        changed = set()
        for run, lists in came.items():
            own, more = items(run), run not in before
            for name, new in lists.items():
                there = own.setdefault(name, {})
                for h, x in new.items():
                    if h not in there:
                        there[h], more = x, True
            if more:
                self.runs.updateValue((run,), (json.dumps(own),))
                changed.add(run)
        order = sorted(before | came.keys())
        places = {r: i for i, r in enumerate(order)}
        pairs = sorted({(i, i + 1) for r in changed for i in (places[r] - 1, places[r]) if 0 <= i < len(order) - 1})
        if pairs or len(order) > len(before):
            self.known.update((order, n := n + bool(pairs)))
        for i, j in pairs:
            same = (key[0], order[i], order[j])
            yield Change(*same, None, None, None, None, None, n)
            for name, effect, h, item, place in compared(items(order[i]), items(order[j])):
                yield Change(*same, name, effect, h, item, place, n)
        if self.quiet is not None and changed:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        runs, n = self.known.get() or ([], 0)
        for run in runs[:-1]:
            self.runs.removeKey((run,))
        self.known.update((runs[-1:], n))
        yield from ()

    def close(self) -> None:
        pass


def _last(rows: DataFrame) -> DataFrame:
    """Of each run of a case the rows of its last comparison."""
    last = rows.groupBy("incidente", "coleta_id").agg(F.max("versao").alias("versao"))
    return rows.join(last, ["incidente", "coleta_id", "versao"], "left_semi").select(_NAMES)


def changes(spark: SparkSession, target: str) -> DataFrame:
    """The change rows of each run against the one before it, as far as the runs have come: of a run that was compared twice,
    since another came between, the later comparison counts."""
    return _last(batches.read(spark, target, CHANGES)).where("efeito is not null").drop("versao")


def compact_changes(spark: SparkSession, target: str) -> int | None:
    return batches.compact(spark, target, CHANGES, _last)


def stream_changes(spark: SparkSession, source: str, target: str, checkpoint: str, quiet: int | None = None) -> StreamingQuery:
    """Starts a query that compares each new run (a file of list items) with its neighbours in time of the same case, then stops; with
    quiet it goes on until it is stopped, since its timers want a batch even where no file comes.

    The runs are kept as state in RocksDB under the checkpoint, so a query that is started again goes on where it ended; a file that
    comes twice changes nothing. Items of a run with the same hash in a list count once, at their first place; rows without case, run,
    list or hash are left out. Read the result with changes(). See Comparisons for quiet.
    """
    rows = spark.readStream.schema(ITEMS).option("maxFilesPerTrigger", 1).json(source).dropna(subset=["incidente", "coleta_id", "lista", "hash_natural"])
    found = rows.groupBy("incidente").transformWithState(Comparisons(quiet), CHANGES, "Append", "None" if quiet is None else "ProcessingTime")

    def each(batch: DataFrame, n: int) -> None:
        batches.put(batch, target, n)

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:  # a query keeps the settings that it starts with
        query = found.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
        return (query.trigger(availableNow=True) if quiet is None else query.trigger(processingTime="1 second")).start()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before) if before else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
