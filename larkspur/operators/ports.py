"""What runs outside Spark's expressions: language models and remote batches, behind small replaceable parts."""

from __future__ import annotations

import json
import shutil
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Chat = Callable[[str, str], str]


class RateLimited(Exception):
    """The provider asks to wait."""


def with_retries(call: Callable, tries: int = 5, wait: float = 2.0, limited_wait: float = 60.0, growth: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """Calls again after a failure, at a fixed distance (or one that grows), and after a longer one where the provider limits the rate."""

    def run(*args):
        for attempt in range(tries):
            try:
                return call(*args)
            except RateLimited:
                if attempt == tries - 1:
                    raise
                sleep(limited_wait)
            except Exception:
                if attempt == tries - 1:
                    raise
            sleep(wait * growth**attempt)
        raise AssertionError

    return run


def choose_provider(model: str, local: Callable[[str], Chat], remote: Callable[[str], Chat], marks: tuple[str, ...] = ("llama",)) -> Callable[[], Chat]:
    """What makes the model's chat: the local maker if its name holds one of the marks, else the remote one."""
    maker = local if any(m in model for m in marks) else remote
    return lambda: maker(model)


def query_model(rows: DataFrame, prompt: str, system: str, provider: Callable[[], Chat], out: str = "answer") -> DataFrame:
    """`rows` with the model's answers, null where it failed after all tries. The provider is made once a worker.

    Not deterministic: write the result down before it is used twice.
    """

    @F.pandas_udf("string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        chat = provider()

        def one(text: str) -> str | None:
            try:
                return chat(system, text)
            except Exception:  # noqa: BLE001  a failed row is left out, not the job
                return None

        for batch in batches:
            yield batch.map(one, na_action="ignore").astype(object)

    return rows.withColumn(out, ask.asNondeterministic()(prompt))


def batch_requests(prompts: DataFrame, model: str, system: str) -> DataFrame:
    """custom_id, method, url, body from custom_id, prompt."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    body = F.struct(F.lit(model).alias("model"), F.array(message("system", F.lit(system)), message("user", F.col("prompt"))).alias("messages"))
    return prompts.select("custom_id", F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("url"), body.alias("body"))


class BatchClient(Protocol):
    """A remote batch service; the driver talks to it, rows never pass through it here."""

    def submit(self, path: str, description: str) -> str: ...
    def finished(self, batch_id: str) -> bool: ...
    def fetch(self, batch_id: str, path: str) -> None: ...
    def cancel(self, batch_id: str) -> None: ...


class FolderBatches:
    """Batches as files: requests wait in `folder`/requests, whoever answers puts a file of equal name into `folder`/answers."""

    def __init__(self, folder: str) -> None:
        self.requests, self.answers = Path(folder) / "requests", Path(folder) / "answers"
        for path in (self.requests, self.answers):
            path.mkdir(parents=True, exist_ok=True)

    def submit(self, path: str, description: str) -> str:
        batch_id = f"batch_{uuid.uuid4().hex}"
        shutil.copyfile(path, self.requests / f"{batch_id}.jsonl")
        return batch_id

    def status(self, batch_id: str) -> str:
        if (self.answers / f"{batch_id}.jsonl").exists():
            return "completed"
        return "in_progress" if (self.requests / f"{batch_id}.jsonl").exists() else "cancelled"

    def finished(self, batch_id: str) -> bool:
        return self.status(batch_id) == "completed"

    def fetch(self, batch_id: str, path: str) -> None:
        shutil.copyfile(self.answers / f"{batch_id}.jsonl", path)

    def cancel(self, batch_id: str) -> None:
        (self.requests / f"{batch_id}.jsonl").unlink(missing_ok=True)


class HttpBatches:
    """A batch service over HTTP: files, batches with a window of 24 hours, their states and results."""

    def __init__(self, base: str, key: str, endpoint: str = "/v1/chat/completions", timeout: float = 60.0) -> None:
        self.base, self.key, self.endpoint, self.timeout = base.rstrip("/"), key, endpoint, timeout

    def _call(self, path: str, body: bytes | None = None, kind: str = "application/json", method: str | None = None) -> bytes:
        headers = {"Authorization": f"Bearer {self.key}", "Content-Type": kind}
        request = urllib.request.Request(self.base + path, body, headers, method=method or ("GET" if body is None else "POST"))
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                return answer.read()
        except urllib.error.HTTPError as error:
            if error.code == 429:
                raise RateLimited(path) from error
            raise

    def submit(self, path: str, description: str) -> str:
        mark = uuid.uuid4().hex
        part = lambda head, value: f"--{mark}\r\nContent-Disposition: form-data; {head}\r\n\r\n".encode() + value + b"\r\n"
        body = part('name="purpose"', b"batch") + part(f'name="file"; filename="{Path(path).name}"', Path(path).read_bytes()) + f"--{mark}--\r\n".encode()
        file_id = json.loads(self._call("/v1/files", body, f"multipart/form-data; boundary={mark}"))["id"]
        asked = {"input_file_id": file_id, "endpoint": self.endpoint, "completion_window": "24h", "metadata": {"description": description}}
        return json.loads(self._call("/v1/batches", json.dumps(asked).encode()))["id"]

    def status(self, batch_id: str) -> str:
        return json.loads(self._call(f"/v1/batches/{batch_id}"))["status"]

    def finished(self, batch_id: str) -> bool:
        return self.status(batch_id) == "completed"

    def fetch(self, batch_id: str, path: str) -> None:
        file_id = json.loads(self._call(f"/v1/batches/{batch_id}"))["output_file_id"]
        Path(path).write_bytes(self._call(f"/v1/files/{file_id}/content"))

    def cancel(self, batch_id: str) -> None:
        self._call(f"/v1/batches/{batch_id}/cancel", method="POST")


class BatchRegistry:
    """File name to batch id, in one JSON file; a name that is there already gets the new id."""

    def __init__(self, path: str) -> None:
        self.path = Path(path)

    def read(self) -> dict[str, str]:
        return json.loads(self.path.read_text()) if self.path.exists() else {}

    def put(self, name: str, batch_id: str) -> None:
        written = self.path.with_suffix(".new")
        written.write_text(json.dumps(self.read() | {name: batch_id}, indent=1))
        written.replace(self.path)


def submit_batch(path: str, client: BatchClient, registry: BatchRegistry, description: str = "") -> str:
    """Submits a file of requests and notes its id."""
    batch_id = client.submit(path, description)
    registry.put(Path(path).name, batch_id)
    return batch_id


def collect_batches(registry: dict[str, str], client: BatchClient, folder: str, pattern: str = "", exists: Callable[[str], bool] = lambda path: False) -> list[str]:
    """Fetches finished batches whose file name holds the pattern and that were not fetched before; returns their paths."""
    done = []
    for name, batch_id in registry.items():
        path = f"{folder}/{name}"
        if pattern in name and not exists(path) and client.finished(batch_id):
            client.fetch(batch_id, path)
            done.append(path)
    return done


def cancel_batches(registry: dict[str, str], client: BatchClient) -> None:
    for batch_id in registry.values():
        client.cancel(batch_id)


def matching(registry: DataFrame, pattern: str) -> DataFrame:
    """Registry rows whose file name holds the pattern."""
    return registry.filter(F.contains(F.col("filename"), F.lit(pattern)))
