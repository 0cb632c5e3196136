"""Sources, sinks, judges, streams."""
import json

import pytest
from pyspark.sql import functions as F

from textloom.operators import judge, logs
from textloom.plans import inputs
from textloom.sources import articles, jsonl
from textloom.streaming import logs as streams


def test_strict_and_tolerant_scans(spark, tmp_path):
    good, bad, gone = (str(tmp_path / n) for n in ("good.jsonl", "bad.jsonl", "gone.jsonl"))
    open(good, "w").write('{"prompt": "a", "x": 1}\n\n  \n{"prompt": "é"}\n{"prompt": "a"}\n')
    open(bad, "w").write('{"prompt": "a"}\n{broken\n{"x": 2}\n')
    assert jsonl.strict(spark, good, "prompt string", ("prompt",)).count() == 3
    with pytest.raises(Exception):
        jsonl.strict(spark, bad, "prompt string").collect()
    assert [r["prompt"] for r in jsonl.tolerant(spark, bad, "prompt").collect()] == ["a"]
    assert jsonl.tolerant(spark, gone, "prompt").count() == 0 and jsonl.holdout_keys(spark, gone).count() == 0
    open(gone, "w").write('{"x": 1}\n')
    with pytest.raises(Exception):
        jsonl.strict(spark, gone, "prompt string", ("prompt",)).collect()


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", None), ("b", "é")], "prompt string, title string")
    jsonl.write_split(rows, str(tmp_path), "train")
    lines = [json.loads(x) for p in (tmp_path / "train.jsonl").glob("part-*") for x in open(p)]
    assert sorted(lines, key=str) == sorted([{"prompt": "a", "title": None}, {"prompt": "b", "title": "é"}], key=str)
    jsonl.write_holdout(rows, str(tmp_path / "eval"))
    with pytest.raises(Exception):
        jsonl.write_holdout(rows, str(tmp_path / "eval"))
    jsonl.write_holdout(rows, str(tmp_path / "eval"), force=True)
    for _ in range(2):
        jsonl.append_pending(rows, str(tmp_path / "dpo"))
    assert spark.read.json(str(tmp_path / "dpo")).count() == 2
    (tmp_path / "t").write_bytes(b"ab")
    import hashlib

    assert jsonl.fingerprint(spark, [f"{tmp_path}/t", f"{tmp_path}/none"]) == hashlib.sha256(b"ab").hexdigest()[:16]
    assert jsonl.fingerprint(spark, [f"{tmp_path}/none"]) == "missing"
    for run in ("one", "two"):
        jsonl.write_pointer(spark, str(tmp_path), run)
    assert spark.read.json(f"{tmp_path}/latest.json").first()["target"] == "two"


def test_article_retries():
    answers, slept = [(429, {"Retry-After": "7"}, {}), (429, {}, {}), (503, {}, {}), (200, {}, {"title": "t"})], []
    assert articles.get_with_retries(lambda p: answers.pop(0), 1, sleep=slept.append) == {"title": "t"} and slept == [7.0, 2, 4]
    assert articles.get_with_retries(lambda p: (404, {}, {}), 1, sleep=slept.append) is None
    assert articles.get_with_retries(lambda p: (500, {}, {}), 1, sleep=slept.append) is None


def test_judges_are_asked_once_for_each_pair(spark, tmp_path):
    class Stub:
        def answer(self, requests):
            return [None if "bad" in r else json.dumps({"f": len(r), "h": 5, "lvl": "A2"}) for r in requests]

    rows = spark.createDataFrame([("s", "o"), ("s", "o"), ("s", "bad")], "source string, output string").withColumn("q", F.concat("source", "output"))
    verdicts = judge.ask(rows, ["source", "output"], "q", Stub, str(tmp_path / "v"))
    assert verdicts.count() == 2 and verdicts.where("error is not null").count() == 1
    assert judge.with_verdicts(rows, verdicts, ["source", "output"]).count() == 3
    assert judge.fan_out(rows, 4).count() == 12


def test_stream_equals_batch(spark, tmp_path):
    lines = inputs.log_lines(spark, "/root/testdata/sf0.001", "grpo").where("run_id < 20")
    lines.repartition(1).sortWithinPartitions("line_no").write.json(str(tmp_path / "in"))
    stream = streams.grpo_metrics(streams.read_lines(spark, str(tmp_path / "in")))
    run = stream.writeStream.format("memory").queryName("grpo").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(90)
    got = sorted(map(tuple, spark.table("grpo").collect()))
    assert got == sorted(map(tuple, logs.grpo_metrics(lines).collect())) and got


def test_nan_lines_are_dropped(spark):
    rows = spark.createDataFrame([(1, 1, "Iter 3: Val loss nan, Val took 1s"), (1, 2, "Iter 4: Val loss 1.5, Val took 1s")], "run_id long, line_no long, value string")
    assert [(r["iter"], r["metric"], r["value"]) for r in logs.flat_metrics(rows, logs.SFT).collect()] == [(4, "valid/loss", 1.5)]
