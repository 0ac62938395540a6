"""Embedding whitening by a tiled covariance.

Vectors become whole numbers, x = floor(256 * c), and the fit list is each distinct x once. Tasks
cut the fit list into row-blocks and each row-block into column blocks; the column blocks are
shuffled by row-block, where every pair of them is multiplied. A pair of column blocks is the
key of a tile of the covariance. Each task sums its products by tile before they are shuffled, so
a tile's sum reads one matrix for each task and not one for each row-block. The tiles are put
together on the driver, whose matrix is bounded by the square of the vectors' width, and
decomposed there. Entries are centred before they are multiplied.

The same tiles measure the whitened vectors' covariance over the fit list.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapframe.llm.common import materialise, release

SCALE = 256
COMPONENTS = 4
TILE = 32
COLUMN_BLOCKS = 16
BLOCK_ROWS = 2048
NO_VARIANCE = 1e-12
_INT = np.iinfo(np.int64)
_WIDTHS = (np.dtype("<i2"), np.dtype("<i4"), np.dtype("<i8"))


class Whitening(NamedTuple):
    """A fit: vector width, size of the fit list, its sums by dimension, eigenvalues and components (columns), trace, error."""

    width: int
    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float


# --------------------------------------------------------------------------- whole-number vectors


def whole(values: np.ndarray) -> np.ndarray:
    """floor(256 * c) of finite doubles as int64; what is beyond a long takes the nearest long."""
    scaled = np.floor(values * float(SCALE))
    out = np.clip(scaled, -(2.0**62), 2.0**62).astype(np.int64)
    big = np.abs(scaled) > 2.0**62
    if big.any():
        out[big] = [min(max(int(v), _INT.min), _INT.max) if np.isfinite(v) else (_INT.max if v > 0 else _INT.min) for v in scaled[big]]
    return out


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat doubles, row offsets and which rows are whole: not null, without null or non-finite entries."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().cast(pa.float64())
    numbers = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(numbers))])
    fine = (bad[offsets[1:]] == bad[offsets[:-1]]) & pc.is_valid(column).to_numpy(zero_copy_only=False)
    return numbers, offsets, fine


def _packed(x: np.ndarray) -> bytes:
    """A vector's bytes in the narrowest width that holds it: equal vectors have equal bytes."""
    low, high = (int(x.min()), int(x.max())) if len(x) else (0, 0)
    for tag, kind in enumerate(_WIDTHS):
        limits = np.iinfo(kind)
        if limits.min <= low and high <= limits.max:
            break
    return bytes([tag]) + x.astype(kind).tobytes()


def _matrix(packed: list[bytes], width: int) -> np.ndarray:
    out = np.empty((len(packed), width), np.int64)
    for i, raw in enumerate(packed):
        out[i] = np.frombuffer(raw, _WIDTHS[raw[0]], offset=1)
    return out


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        numbers, offsets, fine = _vectors(batch.column(0))
        x = whole(numbers[np.isfinite(numbers)]) if not np.isfinite(numbers).all() else whole(numbers)
        place = np.concatenate([[0], np.cumsum(np.isfinite(numbers))])
        rows = np.flatnonzero(fine)
        packed = [_packed(x[place[offsets[r]] : place[offsets[r + 1]]]) for r in rows]
        yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), pa.array(offsets[rows + 1] - offsets[rows], pa.int32())], ["x", "width"])


def distinct_vectors(vectors: DataFrame) -> DataFrame:
    """The distinct whole-number vectors of a frame with one array column: x (packed bytes), width."""
    return vectors.mapInArrow(_pack, "x binary, width int").distinct()


# --------------------------------------------------------------------------- tiles


def _column_blocks(rows: Callable[[list], np.ndarray], width: int, tile: int):
    """Cut a task's centred rows into row-blocks and those into column blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count = TaskContext.get().partitionId(), 0
        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK_ROWS):
                matrix = rows(batch.column(0).slice(first, BLOCK_ROWS).to_pylist())
                cuts = range(0, width, tile)
                blocks = [np.ascontiguousarray(matrix[:, c : c + tile]).tobytes() for c in cuts]
                key = (task << 32) + count
                count += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * len(blocks), pa.int64()), pa.array(range(len(blocks)), pa.int32()), pa.array([len(matrix)] * len(blocks), pa.int32()), pa.array(blocks, pa.binary())],
                    ["row_block", "column_block", "height", "entries"],
                )

    return run


def _multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Products of pairs of column blocks, summed by tile within the task."""
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for i, j, height, left, right in zip(*(batch.column(c).to_pylist() for c in ("i", "j", "height", "entries", "other")), strict=True):
            product = np.frombuffer(left).reshape(height, -1).T @ np.frombuffer(right).reshape(height, -1)
            if (i, j) in sums:
                sums[i, j] += product
            else:
                sums[i, j] = product
    yield _tiles(sums)


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for i, j, raw in zip(*(batch.column(c).to_pylist() for c in ("i", "j", "entries")), strict=True):
            part = np.frombuffer(raw)
            sums[i, j] = sums[i, j] + part if (i, j) in sums else part
    yield _tiles(sums)


def _tiles(sums: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([i for i, _ in sums], pa.int32()), pa.array([j for _, j in sums], pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["i", "j", "entries"]
    )


def tiled_covariance(fit: DataFrame, n: int, width: int, centred: Callable[[list], np.ndarray], tile: int | None = None) -> np.ndarray:
    """Covariance (divisor n) of the rows that `centred` makes of the values of fit's only column.

    There are at most COLUMN_BLOCKS column blocks, so a row-block meets itself a bounded number of
    times however wide the vectors are.
    """
    tile = tile or max(TILE, -(-width // COLUMN_BLOCKS))
    blocks = fit.mapInArrow(_column_blocks(centred, width, tile), "row_block long, column_block int, height int, entries binary")
    left = blocks.select("row_block", F.col("column_block").alias("i"), "height", "entries")
    right = blocks.select(F.col("row_block").alias("other_block"), F.col("column_block").alias("j"), F.col("entries").alias("other"))
    pairs = left.join(right, (F.col("row_block") == F.col("other_block")) & (F.col("i") <= F.col("j"))).select("i", "j", "height", "entries", "other")
    kind = "i int, j int, entries binary"
    summed = pairs.mapInArrow(_multiply, kind).repartition("i", "j").mapInArrow(_add_up, kind)
    out = np.zeros((width, width))
    for i, j, raw in summed.collect():  # at most COLUMN_BLOCKS squared tiles of the covariance itself
        a, b = slice(i * tile, (i + 1) * tile), slice(j * tile, (j + 1) * tile)
        part = np.frombuffer(raw).reshape(len(range(width)[a]), -1)
        out[a, b] = part
        out[b, a] = part.T
    return out / n


# --------------------------------------------------------------------------- fit and transform


def _sums(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * width
        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK_ROWS):
                x = _matrix(batch.column(0).slice(first, BLOCK_ROWS).to_pylist(), width)
                safe = len(x) == 0 or np.abs(x.astype(np.float64)).max(initial=0) < 2.0**50
                n += len(x)
                total = [a + int(b) for a, b in zip(total, x.sum(0) if safe else x.astype(object).sum(0), strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([[str(t) for t in total]], pa.list_(pa.string()))], ["n", "sums"])

    return run


def _centre(width: int, n: int, sums: list[int]):
    mean, part = np.array([s // n for s in sums], np.int64), np.array([(s % n) / n for s in sums])  # whole and fractional part: near values lose nothing

    def run(packed: list[bytes]) -> np.ndarray:
        x = _matrix(packed, width)
        if x.size and (np.abs(x.astype(np.float64)).max() > 2.0**61 or np.abs(mean.astype(np.float64)).max() > 2.0**61):
            return x.astype(np.float64) - mean.astype(np.float64) - part
        return (x - mean).astype(np.float64) - part

    return run


def fit_whitening(fit: DataFrame, width: int) -> Whitening:
    """A whitening of the fit list `fit` (column x, packed vectors of `width` entries), which holds at least one row."""
    parts = fit.mapInArrow(_sums(width), "n long, sums array<string>")
    places = parts.select("n", F.posexplode("sums").alias("at", "part")).groupBy("at").agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
    found = sorted(places.collect(), key=lambda r: r["at"])  # one row for each dimension
    n, sums = found[0]["n"], [int(r["total"]) for r in found]
    centre = _centre(width, n, sums)
    covariance = tiled_covariance(fit, n, width, centre)
    values, vectors = np.linalg.eigh(covariance)
    top = np.argsort(-values, kind="stable")[:COMPONENTS]
    trace = float(np.trace(covariance))
    values, vectors = np.maximum(values[top], 0.0), vectors[:, top]
    varied = values > NO_VARIANCE * trace
    matrix = vectors[:, varied] / np.sqrt(values[varied])
    error = 0.0
    if varied.any():
        seen = tiled_covariance(fit, n, matrix.shape[1], lambda packed: centre(packed) @ matrix)
        error = float(np.abs(seen - np.eye(len(seen))).max())
    return Whitening(width, n, sums, values, vectors, trace, error)


def exact_deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n * x - S)^2, exact; None where it is beyond a long."""
    most = max(int(np.abs(x.astype(np.float64)).max(initial=0)), 1)
    if (n * (most + 1) + max((abs(s) for s in sums), default=0)) ** 2 * max(len(sums), 1) < _INT.max:
        gap = n * x - np.array(sums, np.int64)
        return (gap * gap).sum(1).tolist()
    totals = (sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist())
    return [t if t <= _INT.max else None for t in totals]


def _whitener(model: Whitening):
    centre = _centre(model.width, model.n, model.sums)
    varied = model.values > NO_VARIANCE * model.trace
    scale = np.where(varied, 1 / np.sqrt(np.where(varied, model.values, 1.0)), 0.0)
    shares = (model.values / model.trace).tolist() if model.trace > 0 else [0.0] * len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.values)
        for batch in batches:
            numbers, offsets, fine = _vectors(batch.column(1))
            rows = np.flatnonzero(fine & (np.diff(offsets) == model.width))
            entries = np.concatenate([numbers[offsets[r] : offsets[r + 1]] for r in rows]) if len(rows) else np.zeros(0)
            x = whole(entries).reshape(len(rows), model.width)
            white = (centre([_packed(v) for v in x]) @ model.components) * scale
            ids, again = batch.column(0).take(pa.array(rows)), np.repeat(np.arange(len(rows)), k)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(again)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
                    pa.array(np.full(len(again), model.n, np.int64)),
                    pa.array(exact_deviation(x, model.n, model.sums), pa.int64()).take(pa.array(again)),
                    pa.array(white.ravel()),
                    pa.array(shares * len(rows), pa.float64()),
                    pa.array(np.full(len(again), model.identity_error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return run


def whiten(embeddings: DataFrame) -> DataFrame:
    """For each row and component up to 4: vec_id, component, n, deviation, whitened, explained, identity_error.

    `embeddings` has vec_id and embedding, an array of numbers. Rows whose vector is null, empty or
    holds a null or non-finite entry are left out. One space has one width: the most frequent
    one of the distinct vectors (of several the greatest), and vectors of other widths are left out
    too. Repeated rows each have their result, but count once in the fit; null ids are kept.
    Components beyond the vectors' width do not exist. A component without variance (eigenvalue
    at most NO_VARIANCE of the trace, as for a single vector) has whitened 0 and is not part of identity_error.
    `deviation` is null where it is beyond a long. Empty input gives an empty result; extra
    columns are ignored.
    """
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fit = materialise(distinct_vectors(embeddings.select("embedding")), "whitening-fit")
    widths = fit.filter("width > 0").groupBy("width").count().orderBy(F.desc("count"), F.desc("width")).limit(1).collect()
    if not widths:
        return embeddings.sparkSession.createDataFrame([], schema)
    width = widths[0]["width"]
    model = fit_whitening(fit.filter(F.col("width") == width).select("x"), width)
    release(fit)
    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(_whitener(model), schema)
