"""Embedders that run as a process of their own: one child for each task, fed by Arrow streams over its pipes.

The child reads record batches from its standard input and answers each with a batch of one column ``vec`` on its standard
output (``serve`` does both for any function).  A request has a deadline.  A child that dies, hangs or answers short is put
down; what it had answered is kept, and the next child starts with the first row that has no answer, so no row is lost and
none is embedded twice without need.  The last 2,000 characters of its standard error are the error of a row that
no child can embed."""

from __future__ import annotations

import contextlib
import io
import os
import select
import subprocess
import sys
import tempfile
import time
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa

#: Characters of the child's standard error that are kept.
TAIL = 2000


class Partial(RuntimeError):
    """A child failed; ``done`` has the vectors of the rows before the one it failed on."""

    def __init__(self, said: str, done: list):
        super().__init__(said)
        self.done = done


class _Pipe(io.RawIOBase):
    """One end of a pipe that waits no longer than until ``until``."""

    def __init__(self, fd: int):
        self.fd, self.until = fd, 0.0
        os.set_blocking(fd, False)

    def _wait(self, read: bool) -> None:
        left = self.until - time.monotonic()
        ready = select.select([self.fd] if read else [], [] if read else [self.fd], [], max(0, left))
        if not any(ready):
            raise TimeoutError("no answer before the deadline")

    def readable(self) -> bool:
        return True

    def writable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        self._wait(True)
        got = os.read(self.fd, len(buffer))
        buffer[: len(got)] = got
        return len(got)

    def write(self, data) -> int:
        at, data = 0, memoryview(data).cast("B")
        while at < len(data):
            self._wait(False)
            with contextlib.suppress(BlockingIOError):
                at += os.write(self.fd, data[at : at + (1 << 16)])
        return at


class Child:
    """A running process and its two streams."""

    def __init__(self, command: list[str], schema: pa.Schema, env: dict[str, str] | None):
        self.errors = tempfile.TemporaryFile()  # noqa: SIM115  of this task alone, gone with it
        self.process = subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=self.errors, env=os.environ | (env or {}), bufsize=0)
        self.to, self.back = _Pipe(self.process.stdin.fileno()), _Pipe(self.process.stdout.fileno())
        self.schema, self.sink, self.source = schema, None, None

    def ask(self, batch: pa.RecordBatch, seconds: float) -> pa.RecordBatch:
        self.to.until = self.back.until = time.monotonic() + seconds
        if self.sink is None:
            self.sink = pa.ipc.new_stream(pa.PythonFile(self.to, "w"), self.schema)
        self.sink.write_batch(batch)
        if self.source is None:
            self.source = pa.ipc.open_stream(pa.PythonFile(io.BufferedReader(self.back), "r"))
        return self.source.read_next_batch()

    def said(self) -> str:
        self.errors.seek(0)
        return self.errors.read().decode(errors="replace")[-TAIL:].strip()

    def end(self) -> None:
        with contextlib.suppress(OSError):
            self.process.kill()
        self.process.wait()
        for pipe in (self.process.stdin, self.process.stdout):
            with contextlib.suppress(OSError):
                pipe.close()


class ProcessEmbedder:
    """An embedder for ``embed.embedded``: ``command`` is started once per task and again after each failure."""

    def __init__(self, command: list[str], columns: list[str], deadline: float = 600.0, env: dict[str, str] | None = None):
        self.command, self.columns, self.deadline, self.env = command, columns, deadline, env
        self.child: Child | None = None

    def embed(self, rows: pd.DataFrame, batch_size: int) -> np.ndarray:
        table = pa.RecordBatch.from_pandas(rows[self.columns], preserve_index=False)
        done: list = []
        while len(done) < len(rows):
            batch = table.slice(len(done), batch_size)
            try:
                if self.child is None:
                    self.child = Child(self.command, table.schema, self.env)
                answer = self.child.ask(batch, self.deadline).column("vec").to_pylist()[: len(batch)]
                done += answer
                if len(answer) < len(batch):
                    raise RuntimeError(f"{len(answer)} answers to {len(batch)} rows")
            except Exception as error:
                raise Partial(self._ended(error), done) from error
        return np.array(done, dtype=np.float32)

    def _ended(self, error: Exception) -> str:
        if self.child is None:
            return str(error)
        self.child.end()
        said, code = self.child.said(), self.child.process.returncode
        self.child = None
        return said or f"exit {code}: {error}"


def serve(embed: Callable[[pd.DataFrame], np.ndarray]) -> None:
    """The child's side: answer every batch of standard input until it ends."""
    sink = None
    with pa.ipc.open_stream(sys.stdin.buffer) as source:
        for batch in source:
            out = pa.RecordBatch.from_arrays([pa.array([list(map(float, v)) for v in embed(batch.to_pandas())], pa.list_(pa.float32()))], names=["vec"])
            sink = sink or pa.ipc.new_stream(sys.stdout.buffer, out.schema)
            sink.write_batch(out)
            sys.stdout.buffer.flush()
