"""A stream of cues ends where the batch match does; checkpoints stop early."""

import pytest

from tideline import sinks
from tideline.operators.matching import Index
from tideline.operators.plan import move_order
from tideline.streaming import matching

from .test_matching import CUES, REFERENCES, A, B, cues


def test_stream_equals_batch(spark, tmp_path):
    query = [*cues("a", A[:3]), *cues("tie", A[:3] + B), *cues("void", [*A[:3], A[0]]), *cues("none", ["nothing at all here"])]
    index = Index.build(spark.createDataFrame(REFERENCES, CUES), 1000)
    for k in range(2):
        rows = [r for r in query if (r[1] >= 2) == bool(k)]
        spark.createDataFrame(rows, CUES).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(CUES).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    updates = matching.match_stream(stream, index.postings)
    run = updates.writeStream.format("memory").queryName("updates").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    assert run.awaitTermination(120)
    last = {}
    for r in spark.sql("select * from updates order by cues").collect():
        last[r.doc] = (r.outcome, r.ref, r.score)
    batch = {r.doc: (r.outcome, r.best.ref if r.outcome == "Identified" else None, r.best.score if r.outcome != "Unknown" else None) for r in index.match(spark.createDataFrame(query, CUES)).collect()}
    assert last == batch and last["a"][0] == "Identified" and last["tie"][0] == "Ambiguous" and last["void"][0] == "Unknown"


def test_late_cues_stop_a_document(spark, tmp_path):
    index = Index.build(spark.createDataFrame(REFERENCES, CUES), 1000)
    spark.createDataFrame([("d", 0, 50, "x y z"), ("d", 1, 40, "x y z")], CUES).write.parquet(str(tmp_path / "in"))
    stream = matching.match_stream(spark.readStream.schema(CUES).parquet(str(tmp_path / "in")), index.postings)
    run = stream.writeStream.format("memory").queryName("late").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    assert run.awaitTermination(120)
    assert [(r.outcome, r.error) for r in spark.sql("select * from late").collect()] == [("Error", "InvalidTiming")]


def test_progressive_checkpoints(spark):
    postings = {r.shingle: (r.ref, r.rcue, r.r_ms) for r in Index.build(spark.createDataFrame(REFERENCES, CUES), 1000).postings.collect()}
    lines = [(12_000 * k, t) for k, t in enumerate(A[:3])] + [(40_000 + k, f"filler {k} words go here") for k in range(100)]
    assert matching.progressive(lines, postings, (2, 3, 50)) == (3, ("Identified", "a", 3, None))
    assert matching.progressive(lines[:2], postings) == (2, ("Unknown", None, None, None))


def test_sinks_never_replace(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a")], "id int, t string")
    path = sinks.freeze(rows, str(tmp_path), {"show": 7, "season": 1})
    assert sinks.freeze(rows, str(tmp_path), {"season": 1, "show": 7}) == path
    held, receipt = sinks.published(spark, path)
    assert held.collect() == rows.collect() and receipt == {"show": 7, "season": 1}
    for f in (lambda: sinks.freeze(rows.union(rows), str(tmp_path), {"show": 7, "season": 1}), lambda: sinks.publish(rows, path)):
        with pytest.raises(FileExistsError):
            f()
    for n in (1, 2, 3):
        sinks.append_step(spark, str(tmp_path / "steps"), {"step": n})
    with pytest.raises(ValueError, match="cannot follow"):
        sinks.append_step(spark, str(tmp_path / "steps"), {"step": 4})
    sinks.write_srt(spark.createDataFrame([("d", "1\n")], "doc string, srt string"), str(tmp_path / "srt"))
    assert spark.read.text(str(tmp_path / "srt")).first().doc == "d"


def test_moves_free_their_targets():
    def carry_out(files, moves):
        for a, b in move_order(moves):
            assert a in files and b not in files
            files[b] = files.pop(a)
        return files

    assert carry_out({"a": 1, "b": 2, "c": 3}, [("a", "b"), ("b", "c"), ("c", "d")]) == {"b": 1, "c": 2, "d": 3}
    assert carry_out({"a": 1, "b": 2, "c": 3}, [("a", "b"), ("b", "a"), ("c", "c")]) == {"b": 1, "a": 2, "c": 3}
    with pytest.raises(ValueError):
        move_order([("a", "x"), ("b", "x")])
