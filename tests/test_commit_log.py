import threading

import pytest
from pyspark.sql import functions as F

from statuta.operators import registry as R
from statuta.sources.commit_log import CommitLog

SCHEMA = "split_id string, document_id string, n int"


def _event(spark, k, n=1):
    return spark.createDataFrame([(f"SPLIT_{k:06d}", "DOC_1", n)], SCHEMA)


def _rows(spark, k, values):
    return spark.createDataFrame([(f"SPLIT_{k:06d}", v) for v in values], "split_id string, v string")


def _values(log):
    found = log.children("split_events", "rows")
    return sorted(r.v for r in found.collect()) if found is not None else []


@pytest.fixture
def log(spark, tmp_path):
    made = CommitLog(spark, f"file://{tmp_path}/registry")
    made.commit("documents", "document_id", spark.createDataFrame([("DOC_1",)], "document_id string"))
    return made


def test_events_children_and_refusals(spark, log):
    entry = log.commit("split_events", "split_id", _event(spark, 1), {"rows": _rows(spark, 1, "ab")}, {"document_id": "documents"})
    log.commit("split_events", "split_id", _event(spark, 2), {"rows": _rows(spark, 2, "c"), "none": spark.createDataFrame([], "x int")})
    assert [tuple(r) for r in log.events("split_events", SCHEMA).collect()] == [("SPLIT_000001", "DOC_1", 1), ("SPLIT_000002", "DOC_1", 1)]
    assert _values(log) == ["a", "b", "c"] and log.children("split_events", "rows", ["SPLIT_000002"]).count() == 1
    assert log.children("split_events", "none").count() == 0 and log.children("split_events", "other") is None
    assert entry["children"] == ["rows"] and log.uncommitted("split_events") == []
    for event, children, parents in (
        (_event(spark, 1), {}, {}),
        (_event(spark, 3), {"rows": _rows(spark, 1, "x")}, {}),
        (_event(spark, 3), {}, {"document_id": "split_events"}),
        (_event(spark, 3).union(_event(spark, 4)), {}, {}),
        (_event(spark, 3).withColumn("split_id", F.lit(None).cast("string")), {}, {}),
        (_event(spark, 3).withColumn("split_id", F.lit("../x")), {}, {}),
    ):
        with pytest.raises(R.RegistryError):
            log.commit("split_events", "split_id", event, children, parents)
    assert _values(log) == ["a", "b", "c"] and len(log.entries("split_events")) == 2


def test_a_stop_at_any_step_leaves_nothing_that_is_seen(spark, log, monkeypatch):
    children = {"one": _rows(spark, 1, "ab"), "rows": _rows(spark, 1, "cd")}

    def stop(*_):
        raise OSError("stopped")

    def bad(written):
        raise ValueError("check")

    broken = {"one": children["one"], "rows": children["rows"].withColumn("v", F.raise_error(F.lit("lost")))}
    with pytest.raises(Exception):  # while the second child table is written  # noqa: B017
        log.commit("split_events", "split_id", _event(spark, 1), broken)
    with pytest.raises(ValueError):  # by a check
        log.commit("split_events", "split_id", _event(spark, 1), children, checks=[bad])
    with monkeypatch.context() as m:  # just before the commit
        m.setattr(CommitLog, "_put_if_absent", stop)
        with pytest.raises(OSError):
            log.commit("split_events", "split_id", _event(spark, 1), children)
    assert _values(log) == [] and log.entries("split_events") == {} and len(log.uncommitted("split_events")) == 3
    log.commit("split_events", "split_id", _event(spark, 1), children, token="run-7")
    # After the commit: the caller may not know, and tries again.
    assert log.commit("split_events", "split_id", _event(spark, 1), children, token="run-7")["token"] == "run-7"
    with pytest.raises(R.RegistryError):
        log.commit("split_events", "split_id", _event(spark, 1), children, token="run-8")
    assert _values(log) == ["c", "d"] and log.children("split_events", "one").count() == 2
    assert log.clear("split_events", 10**9) == [] and len(log.clear("split_events", 0)) == 3
    assert log.uncommitted("split_events") == [] and _values(log) == ["c", "d"]


def test_of_two_writers_at_once_one_commits(spark, log, monkeypatch):
    both, put = threading.Barrier(2), CommitLog._put_if_absent

    def together(self, *args):
        both.wait(60)  # both have checked and written by now
        return put(self, *args)

    monkeypatch.setattr(CommitLog, "_put_if_absent", together)
    ends = []

    def write(value):
        try:
            log.commit("split_events", "split_id", _event(spark, 1), {"rows": _rows(spark, 1, value)})
            ends.append(value)
        except R.RegistryError:
            ends.append(None)

    threads = [threading.Thread(target=write, args=(v,)) for v in ("a", "b")]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    (winner,) = [e for e in ends if e]
    assert len(ends) == 2 and _values(log) == [winner] and len(log.entries("split_events")) == 1


def test_retried_rows_count_once_in_the_plain_registry(spark, tmp_path, monkeypatch):
    path = lambda name: f"file://{tmp_path}/{name}"
    rows = _rows(spark, 1, "ab")
    with monkeypatch.context() as m:
        m.setattr(R, "append", lambda *_: (_ for _ in ()).throw(OSError("stopped")))
        with pytest.raises(OSError):
            R.append_with_children(_event(spark, 1), path("events"), "split_id", {path("rows"): rows})
    R.append_with_children(_event(spark, 1), path("events"), "split_id", {path("rows"): rows})
    with pytest.raises(R.RegistryError):
        R.append_with_children(_event(spark, 1), path("events"), "split_id", {path("rows"): rows})
    stored = spark.read.parquet(path("rows"))
    assert stored.count() == 4 and R.committed(stored, spark.read.parquet(path("events")), "split_id").count() == 2
