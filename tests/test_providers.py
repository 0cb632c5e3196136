"""Judges, teachers, evaluation, runs, batch rewards and stream sinks, with providers that need no network."""
import hashlib
import json

import sys

import pytest
from pyspark import cloudpickle

from textloom.operators import evaluate, judge, prompts, rewards, runs, splits
from textloom.plans import inputs
from textloom.operators import logs
from textloom.sources import articles, jsonl
from textloom.streaming import logs as streams


cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Generator:
    def answer(self, requests):
        return [None if "fail" in r else r.upper() for r in requests]


class Classifier:
    def answer(self, requests):
        def level(r):
            return "A2" if "ONE" in r else "b1" if "TWO" in r else "zzz"

        return [None if "SILENT" in r else f'```json\n{{"level": " {level(r)} "}}\n```' for r in requests]


def test_evaluation_and_report(spark, tmp_path):
    rows = [("one two three", "t", None), ("two words here now", None, "u"), ("silent", None, None), ("fail", None, None), ("other", None, None), ("one two three", "again", None)]
    got = evaluate.evaluate(spark.createDataFrame(rows, "complex string, title string, url string"), Generator, Classifier, str(tmp_path))
    by = {(r["complex"], r["title"]): (r["output"], r["level"], r["source_words"], r["output_words"]) for r in got.collect()}
    assert by[("one two three", "t")] == by[("one two three", "again")] == ("ONE TWO THREE", "A2", 3, 3)
    assert by[("two words here now", None)][1] == "B1" and by[("silent", None)][1] == by[("other", None)][1] == "NA" and by[("fail", None)] == (None, "NA", 1, 0)
    assert evaluate.made(got).count() == 5
    summary = evaluate.write_report(got, f"{tmp_path}/report.json", {"model": "m"})
    read = json.load(open(tmp_path / "report.json"))
    assert read["summary"] == summary and read["meta"] == {"model": "m"} and len(read["results"]) == 6 and "title" in read["results"][0]
    assert summary["count"] == 6 and summary["level_counts"] == {"A2": 2, "B1": 1, "NA": 3} and summary["pct_a2"] == pytest.approx(1 / 3) and summary["mean_length_ratio"] == pytest.approx(5 / 6)
    none = evaluate.summarize(got.limit(0))
    assert none["count"] == 0 and none["level_counts"] == {} and none["pct_a2"] == none["mean_length_ratio"] == 0
    labels = evaluate.triage(spark.createDataFrame([("ONE",), ("SILENT",), (None,)], "text string"), "text", Classifier, f"{tmp_path}/triage").collect()
    assert {r["text"]: r["level"] for r in labels} == {"ONE": "A2", "SILENT": None, None: None}


def test_http_judge_and_its_settings():
    seen = []

    def post(url, headers, body):
        seen.append((url, headers, body))
        if "bad" in body["messages"][0]["content"]:
            raise OSError("down")
        return {"choices": [{"message": {"content": "yes"}}]}

    assert judge.HttpJudge("http://h/v1/", "m", "k", post).answer(["a", "bad"]) == ["yes", None]
    assert seen[0][0] == "http://h/v1/chat/completions" and seen[0][1]["Authorization"] == "Bearer k" and seen[0][2]["model"] == "m"
    assert judge.judge_from({}) is None and judge.judge_from({"TEXTLOOM_JUDGE_URL": "http://x"})().key is None
    with pytest.raises(KeyError, match="level"):
        prompts.prompt("none")


def test_teacher_tries_again():
    calls, slept = {}, []

    def one(request):
        calls[request] = calls.get(request, 0) + 1
        if request == "broken" or request == "late" and calls[request] < 3:
            raise OSError
        return "  " if request == "blank" else f" {request} "

    assert judge.Teacher(one, threads=1, sleep=slept.append).answer(["fine", "late", "broken", "blank"]) == ["fine", "late", None, None]
    assert calls == {"fine": 1, "late": 3, "broken": 3, "blank": 3} and slept == [2.0, 4.0, 2.0, 4.0]


def test_batch_rewards(spark):
    told = []
    f = rewards.batch_reward(spark, "markdown")
    assert f(["p", "p"], ["# head", "plain"], ["a", "a"]) == [0.0, 1.0] and rewards.REWARD_FUNCTIONS["markdown"] is f and f([], [], []) == []
    with pytest.raises(ValueError):
        f(["p"], ["a", "b"], ["x"])
    assert rewards.register("own", lambda name: lambda g: told.append((name, g)))(f) is f and told == [("own", f)]


def test_runs_and_files(spark, tmp_path):
    df = spark.range(5).withColumnRenamed("id", "k")
    assert runs.limited(df, 0).count() == 5 and [r["k"] for r in runs.limited(df, 2, "k").collect()] == [0, 1]
    assert runs.require_rows(df, 5) is df and tuple(runs.kept_of(df, df["k"] > 1).first()) == (3, 5)
    with pytest.raises(ValueError, match="6 rows wanted, 5 there"):
        runs.require_rows(df, 6)
    folder = runs.run_folder(spark, str(tmp_path), "sft", "2024")
    for n in (1, 2):
        runs.write_meta(spark, folder, {"n": n, "path": tmp_path})
    assert folder.endswith("sft/2024-nosha") and json.load(open(f"{folder}/meta.json"))["n"] == 2
    for n in (3, 0):
        jsonl.write_split_file(spark.createDataFrame([(k, None) for k in range(n)], "k long, t string").repartition(2), str(tmp_path), "train")
        assert sorted(map(json.loads, open(tmp_path / "train.jsonl")), key=str) == [{"k": k, "t": None} for k in range(n)]
    assert [x.name for x in tmp_path.iterdir() if "train" in x.name and not x.name.endswith(".crc")] == ["train.jsonl"]


def test_tolerant_keys_take_whole_lines_only(spark):
    lines = ['{"prompt":"y"} trailing', '{"prompt":"x"}', '{"prompt":null}', "[1", '{"prompt":"z"}]}', '{"prompt":"z"}} x', '{"prompt":"z"},{}', '{"prompt":"x", "a": {"b": [1]}}', ""]
    assert [r["prompt"] for r in jsonl.tolerant_keys(spark.createDataFrame([(x,) for x in lines], "value string"), "prompt").collect()] == ["x"]


def test_quotas_cover_any_number():
    for shares in ((0.3, 0.3, 0.3, 0.1), (0.6, 0.15, 0.15, 0.1), (1.0,)):
        for n in range(40):
            bounds = splits.quota_bounds(n, [(str(k), s) for k, s in enumerate(shares)])
            assert bounds[0][1] == 0 and bounds[-1][2] == n and all(0 <= a <= z for _, a, z in bounds) and all(x[2] == y[1] for x, y in zip(bounds, bounds[1:]))


def test_pauses():
    assert articles.pause(200, {}, 0) is None and articles.pause(404, {}, 0) is None and articles.pause(500, {"Retry-After": "9"}, 3) == 8 and articles.pause(429, {"Retry-After": "9"}, 3) == 9


def test_fingerprint_of_tables(spark):
    from textloom.plans import registry

    d, digest = "/root/testdata/sf0.001", hashlib.sha256()
    for name in ("region", "nation"):
        digest.update(open(f"{d}/{name}.parquet", "rb").read())
    assert registry.QUERIES["dataset_fingerprint"](spark, d).first()["fingerprint"] == digest.hexdigest()[:16]


def test_latest_values_and_sinks(spark, tmp_path):
    lines = inputs.log_lines(spark, "/root/testdata/sf0.001", "sft").where("run_id < 10")
    lines.repartition(3).write.json(str(tmp_path / "in"))
    stream, seen = streams.flat_metrics(streams.read_lines(spark, str(tmp_path / "in"), 1), logs.SFT), []
    streams.to_sink(streams.latest(stream), lambda rows, batch: seen.append((batch, rows.collect())), str(tmp_path / "c1"), "update").awaitTermination(90)
    last = {(r["run_id"], r["metric"]): (r["line_no"], r["value"]) for _, rows in sorted(seen, key=lambda x: x[0]) for r in rows}
    want = {(r["run_id"], r["metric"]): (r["line_no"], r["value"]) for r in streams.latest(logs.flat_metrics(lines, logs.SFT)).collect()}
    assert last == want and want
    for _ in range(2):  # a restart adds nothing
        streams.append_lines(stream, str(tmp_path / "out"), str(tmp_path / "c2")).awaitTermination(90)
    assert spark.read.json(str(tmp_path / "out")).count() == logs.flat_metrics(lines, logs.SFT).count()
