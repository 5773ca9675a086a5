"""Where documents go: JSON lines, or batches posted over HTTP and retried.

An HTTP sink is a ``foreachBatch`` function. Rows are posted from the tasks that hold them, in JSON arrays; a task that
fails is tried again by Spark, and the stream's checkpoint repeats a micro-batch that did not end, so delivery is at
least once and the event id tells repetitions.
"""

from __future__ import annotations

import json
import random
import time
import urllib.error
import urllib.request
from abc import ABC, abstractmethod
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Sink(ABC):
    """What takes documents: a column ``document`` of JSON text, and ``event_id``."""

    def start(self) -> None:  # noqa: B027
        """Before the first batch."""

    @abstractmethod
    def write(self, batch: DataFrame, batch_id: int = 0) -> None: ...

    def stop(self) -> None:  # noqa: B027
        """After the last batch."""

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        self.write(batch, batch_id)


def json_lines(df: DataFrame) -> DataFrame:
    """Each row as one compact line of JSON, nulls left out."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("value"))


class ConsoleSink(Sink):
    """Each document as a line on standard output, fetched a partition at a time."""

    def write(self, batch: DataFrame, batch_id: int = 0) -> None:
        for row in batch.select("document").toLocalIterator():
            print(row.document, flush=True)


class JsonLinesSink(Sink):
    """Text files of {"received_at", "event"} under a folder."""

    def __init__(self, path: str):
        self.path = path

    def write(self, batch: DataFrame, batch_id: int = 0) -> None:
        stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
        line = F.concat(F.lit('{"received_at":"'), stamp, F.lit('","event":'), F.col("document"), F.lit("}"))
        batch.select(line.alias("value")).write.mode("append").text(self.path)


@dataclass(frozen=True)
class Delivery:
    success: bool
    retryable: bool
    status: int | None
    error: str | None


def is_retryable(status: int | None) -> bool:
    return status is None or status in (408, 429) or 500 <= status <= 599


def post(url: str, bodies: list[str], timeout: float, token: str | None = None) -> Delivery:
    """One JSON array of documents."""
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {token}"} if token else {})
    request = urllib.request.Request(url, f"[{','.join(bodies)}]".encode(), headers, method="POST")
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return Delivery(200 <= answer.status < 300, is_retryable(answer.status), answer.status, None)
    except urllib.error.HTTPError as e:
        return Delivery(False, is_retryable(e.code), e.code, f"HTTP {e.code}")
    except (OSError, ValueError) as e:
        return Delivery(False, True, None, str(e)[:1024])


def backoff(attempts: int, base: float, most: float, rng: random.Random) -> float:
    delay = min(most, base * 2 ** min(attempts, 60))
    return min(most, delay + rng.uniform(0, 0.1 * delay))


def deliver(bodies: list[str], url: str, timeout: float, token: str | None, tries: int, base: float, most: float, rng: random.Random, sleep=time.sleep) -> tuple[Delivery, int]:
    """Post until it succeeds, isn't worth another try now, or ``tries`` are used up. (last answer, attempts)."""
    for attempt in range(tries):
        answer = post(url, bodies, timeout, token)
        if answer.success or not answer.retryable:
            return answer, attempt + 1
        if attempt + 1 < tries:
            sleep(backoff(attempt, base, most, rng))
    return answer, tries


class HttpSink(Sink):
    """Posts ``document`` in arrays of ``batch_size``; what can't be delivered goes to ``undelivered`` or fails the batch."""

    def __init__(self, url: str, batch_size: int = 50, timeout: float = 5.0, token: str | None = None, tries: int = 5, base: float = 2.0, most: float = 60.0, undelivered: str | None = None):
        if batch_size <= 0 or tries <= 0:
            raise ValueError("batch_size and tries must be positive")
        self.url, self.batch_size, self.timeout, self.token, self.tries, self.base, self.most, self.undelivered = url, batch_size, timeout, token, tries, base, most, undelivered

    def write(self, batch: DataFrame, batch_id: int = 0) -> None:
        url, size, timeout, token, tries, base, most = self.url, self.batch_size, self.timeout, self.token, self.tries, self.base, self.most
        fail = self.undelivered is None

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rng = random.Random(batch_id)
            for b in batches:
                ids, bodies = b.column(0).to_pylist(), b.column(1).to_pylist()
                for k in range(0, len(bodies), size):
                    answer, attempts = deliver(bodies[k : k + size], url, timeout, token, tries, base, most, rng)
                    if not answer.success:
                        if fail:
                            raise RuntimeError(f"delivery failed after {attempts} attempts: {answer.error}")
                        part = slice(k, k + size)
                        n = len(bodies[part])
                        yield pa.RecordBatch.from_arrays([pa.array(ids[part], pa.string()), pa.array(bodies[part], pa.string()), pa.array([attempts] * n, pa.int32()), pa.array([answer.error] * n, pa.string()), pa.array([answer.retryable] * n)], names=["event_id", "payload", "attempts", "last_error", "retryable"])

        left = batch.select("event_id", "document").mapInArrow(send, "event_id string, payload string, attempts int, last_error string, retryable boolean")
        if fail:
            left.write.format("noop").mode("overwrite").save()
        else:
            left.write.mode("append").parquet(self.undelivered)


def compact(document: dict) -> str:
    """A document as one line."""
    return json.dumps(document, separators=(",", ":"), ensure_ascii=False)
