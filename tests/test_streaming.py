"""The streamed fold equals the batch fold, changes don't depend on the order of files, and a replay changes nothing."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from dossier.operators.diff import diff_runs, previous_run
from dossier.operators.seen import upsert_seen
from dossier.streaming import batches
from dossier.streaming.ingest import ITEMS, OBSERVATIONS, changes, compact_changes, compact_facts, facts, stream_changes, stream_ingest


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"coleta_id": f"r{s}", "incidente": 1, "aba": "decisoes" if s == 3 else "andamentos", "sid": s, "posicao": p, "tipo": "t", "descricao": f"d{h}", "hash_natural": f"h{h}"} for s in range(4) for p, h in enumerate(range(s, s + 3))]
    for k in range(2):  # the second file comes twice
        for i in range(4):
            (tmp_path / "in" / f"{k}{i}.json").write_text("\n".join(json.dumps(r) for r in rows if r["sid"] == i))
    stream_ingest(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/t", f"file://{tmp_path}/c").awaitTermination()
    names = "hash_natural", "snapshot_first_seen", "snapshot_last_seen", "posicao"
    got = {tuple(r) for r in facts(spark, f"file://{tmp_path}/t").select(*names).collect()}
    batch = upsert_seen(spark.createDataFrame([tuple(r.values()) for r in rows], OBSERVATIONS), full=F.col("aba") == "andamentos")
    assert got == {tuple(r) for r in batch.select(*names).collect()}


@pytest.mark.parametrize("order", [(0, 1, 2, 3), (3, 2, 1, 0), (2, 0, 3, 1)])
def test_changes_in_any_order_of_files(spark, tmp_path, order):
    (tmp_path / "in").mkdir()
    held = {"r0": "ab", "r1": "bc", "r2": "c", "r3": "cde"}
    rows = [{"incidente": i, "coleta_id": r, "lista": "andamentos", "posicao": p, "hash_natural": h, "item": h * 2} for i in (1, 2) for r, own in held.items() for p, h in enumerate(own) if i == 1 or r != "r1"]
    for n, k in enumerate(order):
        path = tmp_path / "in" / f"{k}.json"
        path.write_text("\n".join(json.dumps(r) for r in rows if r["coleta_id"] == f"r{k}"))
        os.utime(path, (1_700_000_000 + 60 * n,) * 2)
    for _ in range(2):  # started again, it finds nothing new
        stream_changes(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/t", f"file://{tmp_path}/c").awaitTermination()
    names = "incidente", "anterior", "coleta_id", "efeito", "hash_natural", "posicao"
    got = sorted(tuple(r) for r in changes(spark, f"file://{tmp_path}/t").select(*names).collect())
    items = spark.createDataFrame([tuple(r.values()) for r in rows], ITEMS)
    want = diff_runs(previous_run(items.select("incidente", "coleta_id").distinct()), items)
    assert got == sorted(tuple(r) for r in want.select(*names).collect())
    assert len(got) == 10


def given(folder, name, rows, at):
    path = folder / f"{name}.json"
    path.write_text("\n".join(json.dumps(r) for r in rows))
    os.utime(path, (1_700_000_000 + 60 * at,) * 2)


def run(case, name, own, tab="andamentos"):
    return [{"incidente": case, "coleta_id": name, "lista": tab, "posicao": p, "hash_natural": h, "item": h * 2} for p, h in enumerate(own)]


def told(spark, target):
    return sorted(tuple(r) for r in changes(spark, target).select("incidente", "anterior", "coleta_id", "lista", "efeito", "hash_natural").collect())


def batch(spark, rows):
    items = spark.createDataFrame([tuple(r.values()) for r in rows], ITEMS)
    want = diff_runs(previous_run(items.select("incidente", "coleta_id").distinct()), items)
    return sorted(tuple(r) for r in want.select("incidente", "anterior", "coleta_id", "lista", "efeito", "hash_natural").collect())


def test_state_outlives_the_query(spark, tmp_path):
    """Runs that come before and after a restart and between others; a run in two files; a file that comes twice; compaction between."""
    (tmp_path / "in").mkdir()
    source, target, state = (f"file://{tmp_path}/{x}" for x in ("in", "t", "c"))
    start = lambda: stream_changes(spark, source, target, state).awaitTermination()
    rows = [*run(1, "r1", "ab"), *run(1, "r5", "xyz"), *run(2, "r1", "q"), *run(1, "r1", "m", "partes"), *run(1, "r5", "n", "partes")]
    given(tmp_path / "in", "a", rows, 0)
    start()
    assert told(spark, target) == batch(spark, rows)
    late = [*run(1, "r3", "bx"), *run(2, "r2", "")]
    given(tmp_path / "in", "b", late, 1)
    given(tmp_path / "in", "again", rows, 2)
    start()
    rows += late
    assert told(spark, target) == batch(spark, rows)
    assert compact_changes(spark, target) == 2
    assert compact_changes(spark, target) is None
    assert told(spark, target) == batch(spark, rows)
    more = [*run(1, "r3", "abc")[2:], *run(1, "r2", "a"), *run(3, "r1", "a"), *run(3, "r2", "b")]
    given(tmp_path / "in", "c", more, 3)
    start()
    rows += more
    assert told(spark, target) == batch(spark, rows)
    assert len(batches.read(spark, target, "incidente bigint").select("lote").distinct().collect()) == 2  # the base and one batch
    compact_changes(spark, target)
    assert told(spark, target) == batch(spark, rows)
    assert sorted(os.listdir(tmp_path / "t")) == ["base=2", "base=3", "lote=3"]


def test_quiet_cases_let_go_of_their_runs(spark, tmp_path):
    """After the timer the runs but the last are gone, so a late one meets that alone."""
    (tmp_path / "in").mkdir()
    source, target, state = (f"file://{tmp_path}/{x}" for x in ("in", "t", "c"))
    given(tmp_path / "in", "a", [*run(1, "r1", "a"), *run(1, "r3", "b")], 0)
    query = stream_changes(spark, source, target, state, quiet=1)
    until(lambda: len(told(spark, target)) == 2 and len(os.listdir(tmp_path / "t")) > 3)  # batches without a file fire the timer
    given(tmp_path / "in", "c", [*run(1, "r2", "c"), *run(1, "r4", "d")], 2)
    until(lambda: {("r2", "r3"), ("r3", "r4")} <= {r[1:3] for r in told(spark, target)})
    query.stop()
    assert ("r1", "r2") not in {r[1:3] for r in told(spark, target)}


def until(test, seconds=60):
    end = time.time() + seconds
    while not test():
        assert time.time() < end
        time.sleep(0.5)


def test_compacted_facts(spark, tmp_path):
    """Reads cost the base and what came since; the facts stay those of all batches."""
    (tmp_path / "in").mkdir()
    source, target, state = (f"file://{tmp_path}/{x}" for x in ("in", "t", "c"))
    assert facts(spark, target).count() == 0 and compact_facts(spark, target) is None
    rows = []
    for k in range(6):
        own = [{"coleta_id": f"r{k}", "incidente": 1, "aba": "decisoes" if k == 3 else "andamentos", "sid": k, "posicao": p, "tipo": f"t{k}", "descricao": f"d{h}", "hash_natural": f"h{h}"} for p, h in enumerate(range(k % 4, k % 4 + 3))]
        rows += own
        given(tmp_path / "in", k, own, k)
        stream_ingest(spark, source, target, state).awaitTermination()
        if k in (1, 4):
            assert compact_facts(spark, target) == k
    names = "hash_natural", "snapshot_first_seen", "snapshot_last_seen", "posicao"
    want = upsert_seen(spark.createDataFrame([tuple(r.values()) for r in rows], OBSERVATIONS), full=F.col("aba") == "andamentos")
    assert {tuple(r) for r in facts(spark, target).select(*names).collect()} == {tuple(r) for r in want.select(*names).collect()}
    assert sorted(x for x in os.listdir(tmp_path / "t")) == ["base=1", "base=4", "lote=2", "lote=3", "lote=4", "lote=5"]


def test_a_base_without_its_mark_is_not_read(spark, tmp_path):
    target = f"file://{tmp_path}/t"
    for n in range(2):
        batches.put(spark.range(n, n + 1), target, n)
    batches.compact(spark, target, "id bigint", lambda df: df)
    os.remove(tmp_path / "t" / "base=1" / "_SUCCESS")
    assert sorted(r.lote for r in batches.read(spark, target, "id bigint").collect()) == [0, 1]


def test_few_questions_to_the_state():
    """A case's batch costs a few messages to the JVM, however many runs the case has; before it was one for each of them and more."""
    from dossier.streaming.ingest import Comparisons

    asked = []

    class Map(dict):
        def getValue(self, key):  # noqa: N802
            asked.append(("get", key))
            return self.get(key)

        def updateValue(self, key, value):  # noqa: N802
            asked.append(("put", key))
            self[key] = value

    class Value:
        held = None

        def get(self):
            asked.append(("get", None))
            return self.held

        def update(self, value):
            asked.append(("put", None))
            self.held = value

    class Handle:
        def getMapState(self, *_a):  # noqa: N802
            return Map()

        def getValueState(self, *_a):  # noqa: N802
            return Value()

    of = Comparisons()
    of.init(Handle())
    for n in range(40):
        asked.clear()
        rows = [{"coleta_id": f"r{n:02}", "lista": "andamentos", "hash_natural": str(i), "item": str(i), "posicao": 0} for i in (n, n + 1)]
        got = [(r["efeito"], r["hash_natural"]) for r in of.handleInputRows((1,), iter(rows), None)]
        assert len(asked) <= 4
        assert set(got) == (set() if not n else {(None, None), ("apareceu", str(n + 1)), ("sumiu", str(n - 1))})
