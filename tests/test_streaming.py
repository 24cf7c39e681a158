import pytest

from siltstone.operators import delta as D
from siltstone.operators import snapshot
from siltstone.streaming import changes


@pytest.mark.parametrize("every", [2, 16])
def test_stream_of_changes_equals_deltas(spark, tmp_path, every):
    batches = [[("a", "1", 1), ("b", "1", 2), ("a", "2", 3)], [("b", None, 4), ("c", "3", 5)], [("a", "2", 6), ("c", "4", 7)]]
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    states, now = [{}], {}
    for rows in batches:
        spark.createDataFrame(rows, "path string, content string, seq long").coalesce(1).write.mode("append").json(source)
        stream = spark.readStream.schema("path string, content string, seq long").json(source)
        changes.keep_snapshot(stream, folder, every).awaitTermination()
        now = dict(now)
        for p, c, _ in rows:
            now[p] = c
        now = {p: c for p, c in now.items() if c is not None}
        states.append(now)

    def held(state):
        return snapshot.index(spark.createDataFrame(list(state.items()), "path string, content string"))

    for i, (a, b) in enumerate(zip(states, states[1:])):
        want = {(r.path, r.status) for r in D.delta(held(a), held(b)).collect()}
        assert {(r.path, r.status) for r in spark.read.parquet(f"{folder}/changes/batch={i}").collect()} == want
    for i, state in enumerate(states):
        assert {tuple(r) for r in changes.snapshot_at(spark, folder, i - 1, every).collect()} == ({tuple(r) for r in held(state).collect()} if state else set())
