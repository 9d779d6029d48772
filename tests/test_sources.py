"""Files in and out, resuming, and the streaming form of it."""

import json

from pyspark.sql import functions as F

from quizlens.operators import control
from quizlens.plans.items import neutral
from quizlens.sources import files
from quizlens.streaming.resume import ITEMS, control_stream, until_stopped


def test_items_are_read_by_domain_with_mixed_options(spark, tmp_path):
    (tmp_path / "code.jsonl").write_text(json.dumps({"question": "q", "options": ["a", 1, None, " "], "answer": "A"}) + "\n\n" + json.dumps({"question": None, "options": [], "answer": "B", "id": "own"}) + "\n")
    (tmp_path / "math.jsonl").write_text(json.dumps({"question": "m", "options": ["x"], "answer": 1}, ensure_ascii=False) + "\n")
    rows = files.read_items(spark, str(tmp_path)).orderBy("load_seq").collect()
    assert [(r.domain, r.options, r.answer) for r in rows] == [("math", ["x"], "1"), ("code", ["a", None, None, " "], "A"), ("code", [], "B")]
    assert rows[2].item_id == "own" and rows[0].item_id != rows[1].item_id
    assert files.read_items(spark, str(tmp_path / "none")).count() == 0


def test_truncated_sink_lines_count_as_not_written(spark, tmp_path):
    sink = tmp_path / "sink"
    sink.mkdir()
    (sink / "a.json").write_text('{"id": "x", "domain": "math"}\n\n{"id": ""}\n{"id": "y", "dom')
    assert [r.item_id for r in files.read_done(spark, str(sink)).collect()] == ["x"]


def test_resumed_control_sets_equal_one_run(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"i{i}", "math", f"q{i}", ["A", "B"], "A") for i in range(10)], ITEMS)
    build = lambda df: control.writable(neutral(df))
    sink = str(tmp_path / "sink")
    files.append_control(build(rows.where("item_no < 4")), sink)
    files.append_control(build(control.pending(rows, files.read_done(spark, sink))), sink)
    assert sorted((r.item_id, r.options) for r in files.read_control(spark, sink).collect()) == sorted((f"i{i}", ["a", "b"]) for i in range(10))


def test_stream_takes_up_only_new_files(spark, tmp_path):
    src, sink, check = (str(tmp_path / n) for n in ("src", "sink", "check"))
    rows = spark.createDataFrame([(i, f"i{i}", "stem", None, ["A"], "A") for i in range(9)], ITEMS)
    rows.where("item_no < 5").write.parquet(src)
    for more in ("item_no between 3 and 8", None):
        control_stream(spark, src, sink, check, lambda df: control.writable(neutral(df))).awaitTermination()
        if more:
            rows.where(more).write.mode("append").parquet(src)
    assert sorted(r.item_id for r in files.read_control(spark, sink).collect()) == [f"i{i}" for i in range(9)]


def test_features_reports_and_fingerprints(spark, tmp_path):
    folder = str(tmp_path / "features")
    files.write_features(spark.createDataFrame([("math", 1.0), ("code", 2.0)], "domain string, char_entropy double"), folder)
    assert spark.read.parquet(folder).where("domain = 'math'").select("char_entropy").collect()[0][0] == 1.0
    plan = spark.read.parquet(folder).where(F.col("domain") == "math")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(domain" in plan
    path = str(tmp_path / "report.json")
    files.write_report(spark, path, [{"grp": "g", "variant": "neutralized", "domain": None, "accuracy": 0.5}])
    assert files.read_report(spark, path, "g struct<overall:map<string,double>>").collect()[0].g.overall == {"neutralized": 0.5}
    assert files.fingerprints(spark, str(tmp_path), "report.json").collect()[0].size_bytes == len((tmp_path / "report.json").read_bytes())


def test_a_signal_finishes_the_batch_and_stops_the_stream(spark, tmp_path):
    import os
    import signal
    import threading
    import time

    src, sink, check = (str(tmp_path / n) for n in ("src", "sink", "check"))
    rows = spark.createDataFrame([(i, f"i{i}", "stem", None, ["A"], "A") for i in range(40)], ITEMS)
    rows.repartition(20).write.parquet(src)

    def slow(df):
        time.sleep(0.3)
        return control.writable(neutral(df))

    threading.Timer(3, os.kill, (os.getpid(), signal.SIGTERM)).start()
    code = until_stopped(control_stream(spark, src, sink, check, slow, files_per_batch=1))
    written = [r.item_id for r in files.read_control(spark, sink).collect()]
    assert code == 1 and 0 < len(written) < 40 and len(set(written)) == len(written)
    assert until_stopped(control_stream(spark, src, sink, check, lambda df: control.writable(neutral(df)))) == 0
    assert sorted(r.item_id for r in files.read_control(spark, sink).collect()) == sorted(f"i{i}" for i in range(40))
