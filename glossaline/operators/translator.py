"""The user-supplied translator as a partition-wise operator: calls in flight, time limits, retries, a result log."""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, functions as F, types as T

from .. import fixed_values as V
from ..schemas import TRANSLATIONS

RESULT = ["status", "translated_text", "provider", "model", "error_type", "error_message", "latency_ms"]
LOGGED_ROWS = 64  # results of a file of the log
SLICE_ROWS, SLICE_CHARS = 512, 2_000_000  # rows and characters that a task turns into Python objects at a time


class Call:
    """One call in a thread of its own, which is left behind when its time is over."""

    def __init__(self, fn: Callable, args: tuple, retries: int, backoff: float) -> None:
        self.result: tuple | None = None
        self.started = time.monotonic()
        self.over = threading.Event()
        self.thread = threading.Thread(target=self._run, args=(fn, args, retries, backoff), daemon=True)
        self.thread.start()

    def _run(self, fn: Callable, args: tuple, retries: int, backoff: float) -> None:
        for turn in range(retries + 1):
            try:
                r = fn(*args)
            except Exception as exc:  # the original text stays on any failure
                r = {"status": "failed", "error_type": type(exc).__name__, "error_message": str(exc)}
            if r.get("status", "success") != "failed" or turn == retries or self.over.wait(backoff * 2**turn):
                break
        self.result = (
            r.get("status", "success"), r.get("text"), r.get("provider"), r.get("model"), r.get("error_type"), r.get("error_message"), int(r.get("latency_ms") or 0),
        )
        self.over.set()

    def wait(self, timeout: float) -> tuple:
        if not self.over.wait(max(0.0, self.started + timeout - time.monotonic())):
            self.over.set()  # no more retries; a late answer is not looked at
            return ("failed", None, None, None, "timeout", f"no answer within {timeout:g} s", int(timeout * 1000))
        return self.result or ("failed", None, None, None, "timeout", f"no answer within {timeout:g} s", int(timeout * 1000))


def in_flight_calls(rows: Iterator[tuple], fn: Callable, window: int, timeout: float, retries: int, backoff: float) -> Iterator[tuple]:
    """Results of the rows, in order, with up to ``window`` calls waiting at the same time."""
    waiting: deque[Call] = deque()
    for row in rows:
        if len(waiting) == window:
            yield waiting.popleft().wait(timeout)
        waiting.append(Call(fn, row, retries, backoff))
    while waiting:
        yield waiting.popleft().wait(timeout)


class ResultLog:
    """Results of one task's calls in small files of the shared folder, so that a task that runs again does not call again."""

    def __init__(self, uri: str, task: int) -> None:
        import pyarrow.fs as fs

        self.files, root = fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)
        self.folder = f"{root}/task={task}"
        self.files.create_dir(self.folder, recursive=True)
        self.known: dict[str, tuple] = {}
        self.new: list[tuple] = []

    def load(self) -> None:
        import pyarrow.fs as fs
        import pyarrow.parquet as pq

        for info in self.files.get_file_info(fs.FileSelector(self.folder)):
            if info.path.endswith(".parquet"):
                with self.files.open_input_file(info.path) as f:
                    for row in zip(*(c.to_pylist() for c in pq.read_table(f).columns)):
                        self.known[row[0]] = row[1:]

    def add(self, key: str, result: tuple) -> None:
        self.known[key] = result
        self.new.append((key, *result))
        if len(self.new) >= LOGGED_ROWS:
            self.flush()

    def flush(self) -> None:
        import uuid

        import pyarrow as pa
        import pyarrow.parquet as pq

        if self.new:
            kinds = [pa.string()] * (len(RESULT)) + [pa.int64()]
            table = pa.table([pa.array(c, k) for c, k in zip(zip(*self.new), kinds)], names=["key", *RESULT])
            # Written under another name first: a half-written file is never read.
            name = f"{self.folder}/{uuid.uuid4().hex}"
            with self.files.open_output_stream(f"{name}.tmp") as f:
                pq.write_table(table, f)
            self.files.move(f"{name}.tmp", f"{name}.parquet")
            self.new = []


def slices(batch) -> Iterator:
    """The rows of an Arrow batch in pieces of at most ``SLICE_ROWS`` rows and, single rows apart, ``SLICE_CHARS`` characters."""
    chars = [len(text.as_py() or "") for text in batch.column("text")]  # one text at a time
    start = held = 0
    for n, size in enumerate(chars):
        if n > start and (n - start == SLICE_ROWS or held + size > SLICE_CHARS):
            yield batch.slice(start, n - start)
            start, held = n, 0
        held += size
    if start < len(chars):
        yield batch.slice(start)


def translate_rows(
    df: DataFrame, fn: Callable[[str, str, str], dict], parallelism: int | None = None, in_flight: int = 4, timeout: float = float(V.CALL_TIMEOUT_SECONDS),
    retries: int = 0, backoff: float = 0.5, log: str | None = None, dealt: bool = False,
) -> DataFrame:
    """Call ``fn(text, source_lang, target_lang)`` per row; adds status, translation, error, latency.

    ``fn`` returns a dict with any of: status, text, provider, model, error_type, error_message,
    latency_ms.  An exception, or no answer within ``timeout`` seconds (retries and their growing pauses
    included), becomes a failed row, never a failed task.  ``parallelism`` is the number of tasks that call,
    by default as many as the cluster runs at once; each keeps ``in_flight`` calls waiting, so one that hangs
    holds up the others of its task by at most one timeout.

    ``log``: a folder all executors reach.  Rows then meet by their text and languages: equal rows share one
    call, and a task that runs again, or the same job started again, finds the answers it had.  Failed calls are not kept.
    ``dealt``: the rows lie in as many partitions as they shall; without a log they are not dealt anew.
    """
    spark = df.sparkSession
    tasks = parallelism or spark.sparkContext.defaultParallelism
    key = F.sha2(F.concat_ws("\u0000", F.coalesce("source_lang", F.lit("")), F.coalesce("target_lang", F.lit("")), F.coalesce("text", F.lit(""))), 256)
    # A stated number of partitions: adaptive execution merges small ones by their bytes, but leaves these alone.
    if log is not None:
        placed = df.withColumn("_call", key).repartition(tasks, "_call")
    else:
        placed = df if dealt else df.repartition(tasks)
    schema = T.StructType(df.schema.fields + T.StructType.fromDDL(TRANSLATIONS).fields)
    given = df.columns

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        held = None
        if log is not None:
            held = ResultLog(log, TaskContext.get().partitionId())
            held.load()
        kinds = [pa.string()] * (len(RESULT) - 1) + [pa.int32()]
        for batch in batches:
            # A batch may hold ten thousand long texts; only a slice of it, and its answers, are ever Python objects.
            for part in slices(batch):
                texts, sources, targets = (part.column(c).to_pylist() for c in ("text", "source_lang", "target_lang"))
                keys = part.column("_call").to_pylist() if held else list(range(part.num_rows))
                known = {k: held.known[k] for k in keys if k in held.known} if held else {}
                asked: dict = {}
                for k, *call in zip(keys, texts, sources, targets):
                    if k not in known and k not in asked:
                        asked[k] = tuple(call)
                for k, result in zip(asked, in_flight_calls(iter(asked.values()), fn, in_flight, timeout, retries, backoff)):
                    known[k] = result
                    if held and result[0] != "failed":
                        held.add(k, result)
                if held:
                    held.flush()
                answers = [pa.array(c, kind) for c, kind in zip(zip(*[known[k] for k in keys]), kinds)]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in given], *answers], [*given, *RESULT])

    return placed.mapInArrow(run, schema)
