"""Judges and generators as providers: asked once for each distinct request, results written before they are joined back."""
from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Provider(Protocol):
    """Answers a batch of requests; None where it fails. Made anew in each task by its factory."""

    def answer(self, requests: list[str]) -> list[str | None]: ...


def ask(requests: DataFrame, key: list[str], request: str, make, path: str) -> DataFrame:
    """key columns, raw, error: make() answers the distinct requests, and what is written to path is read back, so no request is repeated by later plans."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make()
        for frame in frames:
            try:
                raw, error = provider.answer(frame["_request"].tolist()), None
            except Exception as e:  # a failing provider gives neutral verdicts, as the column says
                raw, error = [None] * len(frame), str(e)[:200]
            yield frame.drop(columns="_request").assign(raw=raw, error=[error or (None if r is not None else "no answer") for r in raw])

    once = requests.select(*key, F.col(request).alias("_request")).dropDuplicates(key)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in requests.select(*key).schema) + ", raw string, error string"
    once.mapInPandas(run, schema).write.mode("overwrite").parquet(path)
    return requests.sparkSession.read.schema(schema).parquet(path)


def with_verdicts(rows: DataFrame, verdicts: DataFrame, key: list[str]) -> DataFrame:
    return rows.join(verdicts, key, "left")


def fan_out(rows: DataFrame, times: int) -> DataFrame:
    """Each row `times` times, numbered by rollout."""
    return rows.withColumn("rollout", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


class HttpJudge:
    """A provider over a chat service: post(url, headers, body) gives the decoded reply; temperature 0, one request after another."""

    def __init__(self, url: str, model: str, key: str | None = None, post: Callable[[str, dict, dict], dict] | None = None, temperature: float = 0.0):
        self.url, self.model, self.key, self.post, self.temperature = url.rstrip("/"), model, key, post or post_json, temperature

    def one(self, request: str) -> str | None:
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        body = {"model": self.model, "temperature": self.temperature, "messages": [{"role": "user", "content": request}]}
        return self.post(f"{self.url}/chat/completions", headers, body)["choices"][0]["message"]["content"]

    def answer(self, requests: list[str]) -> list[str | None]:
        out = []
        for request in requests:
            try:
                out.append(self.one(request))
            except Exception:  # this request alone has no answer
                out.append(None)
        return out


def post_json(url: str, headers: dict, body: dict) -> dict:
    import json
    import urllib.request

    with urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), headers), timeout=60) as reply:
        return json.loads(reply.read())


def judge_from(settings: Mapping[str, str]) -> Callable[[], HttpJudge] | None:
    """A factory by settings TEXTLOOM_JUDGE_URL, _MODEL and _KEY (os.environ, for instance); None without a URL: scores are then neutral."""
    url, model, key = (settings.get(f"TEXTLOOM_JUDGE_{x}") for x in ("URL", "MODEL", "KEY"))
    return (lambda: HttpJudge(url, model or "default", key)) if url else None


class Teacher:
    """A provider that asks another for each request again, after 2, 4, ... seconds, while it fails, and at once while its answer is blank; `threads` requests at a time."""

    def __init__(self, one: Callable[[str], str | None], attempts: int = 3, threads: int = 4, sleep: Callable[[float], None] = time.sleep):
        self.one, self.attempts, self.threads, self.sleep = one, attempts, threads, sleep

    def patiently(self, request: str) -> str | None:
        for attempt in range(1, self.attempts + 1):
            try:
                if text := (self.one(request) or "").strip():
                    return text
            except Exception:
                if attempt < self.attempts:
                    self.sleep(2.0 * attempt)
        return None

    def answer(self, requests: list[str]) -> list[str | None]:
        with ThreadPoolExecutor(self.threads) as pool:
            return list(pool.map(self.patiently, requests))
