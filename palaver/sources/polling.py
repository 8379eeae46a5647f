"""Polls of a capture provider as a stream: a log of what is to be polled, fetched in tasks, landed as snapshots."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from palaver.sources.capture import SNAPSHOT_DDL

POLLED_DDL = "position bigint, ref string, http_status int, error_code string, retryable boolean, value string"


@dataclass(frozen=True)
class Log:
    """What is to be polled, by position: `due()` says how many polls of the log are due by now and never falls;
    `refs(first, last)` names those at first, ..., last - 1, the same ones whenever it is asked."""

    due: Callable[[], int]
    refs: Callable[[int, int], Sequence[str]]


@dataclass(frozen=True)
class Answer:
    """A provider's answer: an HTTP status and the document."""

    status: int
    body: str | None = None


def fetched(fetch: Callable[[str], Answer], ref: str) -> tuple[int | None, str | None, bool, str | None]:
    """(http_status, error_code, retryable, value) of one poll.

    What takes too long is provider_timeout, what can't connect provider_unavailable; both may work later. Of statuses, 404
    is meeting_not_found, and this, 429 and 5xx may work later; any other that isn't 2xx is provider_unavailable for good.
    204 has no value. Other exceptions of `fetch` are faults and fail the task.
    """
    try:
        a = fetch(ref)
    except TimeoutError:
        return None, "provider_timeout", True, None
    except ConnectionError:
        return None, "provider_unavailable", True, None
    if 200 <= a.status < 300:
        return a.status, None, False, None if a.status == 204 else a.body
    return a.status, "meeting_not_found" if a.status == 404 else "provider_unavailable", a.status in (404, 429) or a.status >= 500, None


class _Range(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class _Polls(DataSourceStreamReader):
    """Offsets are positions of the log. A reader isn't told where its query stands when it asks for the latest offset, so
    what was admitted is kept in a file beside the checkpoint; it is never behind the query, and at most one batch ahead."""

    def __init__(self, log: Log, fetch: Callable[[str], Answer], admitted: str, most: int, a_task: int):
        self.log, self.fetch, self.admitted, self.most, self.a_task = log, fetch, admitted, most, a_task

    def _keep(self, position: int) -> None:
        os.makedirs(os.path.dirname(self.admitted), exist_ok=True)
        with open(self.admitted + ".new", "w") as f:
            f.write(str(position))
        os.replace(self.admitted + ".new", self.admitted)

    def _kept(self) -> int:
        if not os.path.exists(self.admitted):
            return 0
        with open(self.admitted) as f:
            return int(f.read())

    def initialOffset(self) -> dict:
        return {"position": 0}

    def latestOffset(self) -> dict:
        was = self._kept()
        now = max(was, min(self.log.due(), was + self.most))
        if now > was:
            self._keep(now)
        return {"position": now}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        a, z = start["position"], end["position"]
        return [_Range(x, min(z, x + self.a_task)) for x in range(a, z, self.a_task)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        for i, ref in enumerate(self.log.refs(partition.first, partition.last)):
            yield (partition.first + i, ref, *fetched(self.fetch, ref))


def poll_stream(spark: SparkSession, log: Log, fetch: Callable[[str], Answer], checkpoint: str, *, most: int = 10_000, a_task: int = 100, name: str = "capture_polls") -> DataFrame:
    """Streaming rows of polls: position, ref, http_status, error_code, retryable and value, the document.

    A batch takes at most `most` positions of the log (twice that after a failure), a task `a_task` of them, each of which is
    fetched once unless its task is repeated; the driver handles positions alone. `checkpoint` is the folder of the query that reads
    this stream, on a path that the driver can write: started again with it, the stream goes on where it stood. A null in
    `value` comes with an error or an empty answer; a document that isn't one is told apart by snapshots().
    """
    admitted = os.path.join(checkpoint.removeprefix("file:"), "polls", "admitted")

    class Polls(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return POLLED_DDL

        def streamReader(self, schema) -> DataSourceStreamReader:
            return _Polls(log, fetch, admitted, most, a_task)

    spark.dataSource.register(Polls)
    return spark.readStream.format(name).load()


def snapshots(polls: DataFrame) -> DataFrame:
    """Polls as capture.read_snapshots gives documents, with position and, as `_corrupt`, what isn't one. polled_at is now."""
    parsed = F.from_json("value", SNAPSHOT_DDL + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return polls.filter("value is not null").select("position", parsed.alias("s"), F.current_timestamp().alias("polled_at")).select("position", "s.*", "polled_at")


def again(polls: DataFrame) -> DataFrame:
    """Polls that failed but may work later, to be put at the end of a log: position, ref, error_code."""
    return polls.filter("error_code is not null and retryable").select("position", "ref", "error_code")
