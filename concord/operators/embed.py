"""Embedders in tasks: batches of cells in, vectors out, with retries on memory errors and bisection on failures."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.operators.external import Partial
from concord.sources.scratch import staged


class Embedder(Protocol):
    """Built once per task by a factory.  ``embed`` gives one vector per row, or raises."""

    def embed(self, rows: pd.DataFrame, batch_size: int) -> np.ndarray: ...


def is_oom(error: BaseException) -> bool:
    text = str(error).lower()
    return isinstance(error, MemoryError) or "out of memory" in text or ("cuda" in text and "memory" in text) or "cublas" in text


def accepted(call: Callable, offered: dict) -> dict:
    """Those of the named arguments that ``call`` takes: models differ in what their versions know."""
    known = inspect.signature(call).parameters
    if any(p.kind is p.VAR_KEYWORD for p in known.values()):
        return dict(offered)
    return {k: v for k, v in offered.items() if k in known and known[k].kind is not inspect.Parameter.POSITIONAL_ONLY}


def with_halving(model: Embedder, rows: pd.DataFrame, batch_size: int) -> np.ndarray:
    """Memory errors halve the batch down to one; any other error goes to the caller at once."""
    size = max(1, batch_size)
    while True:
        try:
            return model.embed(rows, size)
        except Exception as error:  # noqa: BLE001
            if size == 1 or not is_oom(error):
                raise
            size //= 2


def bisected(model: Embedder, rows: pd.DataFrame, batch_size: int, split: bool = True) -> tuple[list, list]:
    """(vectors, errors) in row order; a segment that fails is halved until single rows fail by themselves.

    A ``Partial`` failure keeps what was answered before it and goes on from there.  Without ``split`` a failing chunk fails
    whole.  A short output gives its vectors to the first rows and the rest an error;
    what is too much is left out.  Whether dimensions agree is for ``one_per_side`` to say, which sees all chunks."""
    vectors: list = [None] * len(rows)
    errors: list = [None] * len(rows)
    stack = [(0, len(rows))]

    def keep(at: int, got: np.ndarray) -> None:
        for i, v in enumerate(got):
            if np.isfinite(v).all():
                vectors[at + i] = v.astype(float).tolist()
            else:
                errors[at + i] = "not finite"

    while stack:
        a, b = stack.pop()
        if a == b:
            continue
        try:
            got = np.asarray(with_halving(model, rows.iloc[a:b], batch_size), dtype=np.float32)
            if got.ndim != 2:
                raise ValueError(f"shape {got.shape}, not two-dimensional")
        except Exception as error:  # noqa: BLE001
            if isinstance(error, Partial) and error.done:
                keep(a, np.array(error.done, dtype=np.float32))
                stack.append((a + len(error.done), b))
            elif split and b - a > 1:
                middle = (a + b) // 2
                stack += [(middle, b), (a, middle)]
            else:
                errors[a:b] = [str(error)[-2000:]] * (b - a)
            continue
        keep(a, got[: b - a])
        for i in range(len(got), b - a):
            errors[a + i] = f"short output: {len(got)} vectors for {b - a} rows"
    return vectors, errors


def side_dimensions(done: DataFrame, order: Column | None = None) -> DataFrame:
    """Per side: rows, rows with a vector, and the dimension of the first one by ``order`` (the cell's id), whichever task made it."""
    first = F.min_by(F.size("vec"), F.when(F.col("vec").isNotNull(), F.struct(F.col("cell_id") if order is None else order, "cell_id")))
    return done.groupBy("dataset_side").agg(F.count("*").alias("n_rows"), F.count("vec").alias("n_vectors"), first.alias("dim"))


def one_per_side(done: DataFrame, order: Column | None = None) -> DataFrame:
    """``done`` with one dimension a side, that of the side's first success; vectors of another become errors.

    ``done`` must be written (``embed_run`` does it): it is read twice, and embedding again could give other successes."""
    dims = side_dimensions(done, order).select(F.col("dataset_side").alias("__side"), F.col("dim").alias("__dim"))
    met = done.join(F.broadcast(dims), done["dataset_side"].eqNullSafe(F.col("__side")), "left")  # a row for each side
    size = F.size("vec")
    odd = F.col("vec").isNotNull() & (size != F.col("__dim"))
    said = F.concat(F.lit("dimension "), size.cast("string"), F.lit(", not "), F.col("__dim").cast("string"))
    return met.withColumns({"error": F.when(odd, said).otherwise(F.col("error")), "vec": F.when(~odd, F.col("vec"))}).select(*done.columns)


def embedded(cells: DataFrame, factory: Callable[[], Embedder], batch_size: int = 32, chunk: int = 2048, split: bool = True, seed: int = 619) -> DataFrame:
    """dataset_side, cell_id, vec (null if it failed), error.  Rows stream through in chunks; the model loads once per task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import random

        from pyspark import TaskContext

        random.seed(seed + TaskContext.get().partitionId())
        np.random.seed(seed + TaskContext.get().partitionId())
        model = factory()
        for frame in frames:
            for at in range(0, len(frame), chunk):
                part = frame.iloc[at : at + chunk]
                vectors, errors = bisected(model, part, batch_size, split)
                yield pd.DataFrame({"dataset_side": part["dataset_side"].values, "cell_id": part["cell_id"].values, "vec": vectors, "error": errors})

    return cells.mapInPandas(run, "dataset_side string, cell_id string, vec array<double>, error string")


def embed_run(cells: DataFrame, factory: Callable[[], Embedder], order: Column | None = None, **how) -> DataFrame:
    """Two passes: the first embeds and writes, the second gives each side one dimension."""
    return one_per_side(staged(embedded(cells, factory, **how), "embedded"), order)


def run_counts(done: DataFrame, chunks: DataFrame) -> DataFrame:
    """Counters of a run per side: chunks in all, with a failure and without one, rows in all and failed.

    done: what ``embedded`` returns; chunks: dataset_side, cell_id, chunk.  A chunk whose cells are missing from ``done`` failed."""
    met = chunks.join(done.select("dataset_side", "cell_id", F.col("vec").isNotNull().alias("ok")), ["dataset_side", "cell_id"], "left")
    each = met.groupBy("dataset_side", "chunk").agg(F.count("*").alias("n"), F.count_if(~F.coalesce("ok", F.lit(False))).alias("bad"))
    return each.groupBy("dataset_side").agg(
        F.count("*").alias("chunks_total"), F.count_if(F.col("bad") > 0).alias("chunks_failed"), F.count_if(F.col("bad") == 0).alias("chunks_succeeded"),
        F.sum("n").alias("rows_total"), F.sum("bad").alias("rows_failed"),
    )


class StubEmbedder:
    """A fixed projection of the row's ``vec``; fails by memory above ``most`` rows a batch and on chosen cells.

    Cells for which ``narrow`` holds get half the dimensions; with others in one segment they cannot be embedded."""

    def __init__(self, dim: int = 8, most: int = 16, bad: frozenset[str] = frozenset(), narrow: Callable[[str], bool] | None = None):
        self.dim, self.most, self.bad, self.narrow = dim, most, bad, narrow

    def embed(self, rows: pd.DataFrame, batch_size: int) -> np.ndarray:
        if batch_size > self.most:
            raise RuntimeError("CUDA out of memory")
        if hit := sorted(self.bad & set(rows["cell_id"])):
            raise ValueError(f"cannot embed {hit[0]}")
        dim = self.dim
        if self.narrow:
            kinds = {self.narrow(c) for c in rows["cell_id"]}
            if len(kinds) > 1:
                raise ValueError("two widths in one segment")
            dim = dim // 2 if kinds.pop() else dim
        x = np.stack(rows["vec"].to_numpy())
        return x[:, : dim * (x.shape[1] // dim)].reshape(len(x), dim, -1).mean(2)
