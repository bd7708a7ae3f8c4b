"""Dense frames from a table of decoded lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.functions.binary import GROUP_LINES
from framelake.operators.windows import frame_ids
from framelake.sources.scanlines import EmptyWindowError

RUN_HEIGHTS = 4  # a run of frames spans this many heights, so about one line in four is sent twice


def dense_frames(lines: DataFrame, height: int, stride: int, run_frames: int | None = None, empty_window: str = "fail") -> DataFrame:
    """The frames of ``scan_frames`` from the rows of ``scan_lines(..., "pixels")``, wherever they lie.

    Lines meet the runs of consecutive frames that need them and are sorted by (source, run, line); a task walks its lines
    in that order, holds the last ``height`` of them, and gives out a frame when its last line has passed. So a line is sent
    once or twice however much windows overlap, no source and no run is gathered, and memory is one frame.

    A frame has the lines of the table that lie in its window; a frame without any has no row. Valid lines move up, rows
    left over are zero. Of rows that repeat a line, one stays. ``empty_window``: a frame without a valid line fails the
    job (``fail``) or is an empty image (``keep``). All lines of a source must have the same number of pixels, not null.
    """
    if height < 1 or stride < 1 or empty_window not in ("fail", "keep"):
        raise ValueError("height and stride must be positive, empty_window fail or keep")
    size = run_frames or max(1, -(-RUN_HEIGHTS * height // stride))
    span = (size - 1) * stride + height
    needed = lines.where(F.col("line") % stride < height) if stride > height else lines
    runs = needed.select("source", "line", "source_lines", "valid", "nibble", "sample", "pixels").withColumn(
        "run", F.explode(frame_ids(F.col("line"), span, size * stride))
    )
    placed = runs.repartition("source", "run").sortWithinPartitions("source", "run", "line")
    kinds = {name: lines.schema[name].dataType.simpleString() for name in ("source", "sample")}
    schema = (
        f"source {kinds['source']}, frame_id bigint, n_lines bigint, n_valid bigint, width int, height int, "
        f"window_start {kinds['sample']}, window_end {kinds['sample']}, pixels binary"
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = None
        for batch in batches:
            for key, part in _stretches(batch):
                if walk is None or walk.key != key:
                    if walk:
                        yield from walk.rest()
                    walk = _Walk(key, part, height, stride, size, empty_window == "keep")
                yield from walk.take(part)
        if walk:
            yield from walk.rest()

    return placed.mapInArrow(work, schema)


def _stretches(batch: pa.RecordBatch) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Neighbouring rows of one (source, run)."""
    source, run = batch.column("source").dictionary_encode().indices.fill_null(-1), batch.column("run")
    code, run = source.to_numpy(zero_copy_only=False), run.to_numpy()
    cuts = np.flatnonzero((code[1:] != code[:-1]) | (run[1:] != run[:-1])) + 1
    for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(run)], strict=True):
        if end > start:
            yield (batch.column("source")[start].as_py(), int(run[start])), batch.slice(start, end - start)


def _pixel_rows(column: pa.Array) -> np.ndarray:
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    width = int(offsets[1] - offsets[0])
    if column.null_count or not width or (np.diff(offsets) != width).any():
        raise ValueError("all lines must have the same number of pixels, not null")
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(len(column), width)


class _Walk:
    """Frames of one run from its lines in order; line n lies at n modulo the height."""

    def __init__(self, key: tuple, part: pa.RecordBatch, height: int, stride: int, size: int, keep_empty: bool):
        self.key, self.height, self.stride, self.keep_empty = key, height, stride, keep_empty
        self.frame, self.end = key[1] * size, (key[1] + 1) * size
        self.source, self.total = part.column("source").slice(0, 1), part.column("source_lines")[0].as_py()
        self.at = np.full(height, -1, np.int64)
        self.valid = np.zeros(height, bool)
        self.starts = np.zeros(height, bool)
        self.samples: list[pa.Array | None] = [None] * height
        self.no_sample = pa.nulls(1, part.column("sample").type)
        self.pixels = np.zeros((height, _pixel_rows(part.column("pixels").slice(0, 1)).shape[1]), np.uint8)

    def take(self, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        line, done = part.column("line").to_numpy(), 0
        while done < len(line):
            upto = int(np.searchsorted(line, self.frame * self.stride + self.height))
            if upto > done:
                self._put(line[done:upto], part.slice(done, upto - done))
                done = upto
            if done < len(line):
                yield from self._next()

    def rest(self) -> Iterator[pa.RecordBatch]:
        while self.frame < self.end and self.frame * self.stride < self.total:
            yield from self._next()

    def _put(self, line: np.ndarray, part: pa.RecordBatch) -> None:
        pixels = _pixel_rows(part.column("pixels"))
        if pixels.shape[1] != self.pixels.shape[1]:
            raise ValueError("all lines must have the same number of pixels, not null")
        place = line % self.height
        self.at[place], self.pixels[place] = line, pixels
        self.valid[place] = part.column("valid").fill_null(False).to_numpy(zero_copy_only=False)
        self.starts[place] = self.valid[place] & (part.column("nibble").fill_null(-1).to_numpy() == 0)
        sample = part.column("sample")
        for k in np.flatnonzero(self.starts[place]).tolist():
            self.samples[place[k]] = sample.slice(k, 1)

    def _next(self) -> Iterator[pa.RecordBatch]:
        frame, low = self.frame, self.frame * self.stride
        self.frame += 1
        wanted = np.arange(low, low + self.height)
        place = wanted % self.height
        here = self.at[place] == wanted
        if not here.any():
            return
        good = here & self.valid[place]
        n_valid = int(good.sum())
        if n_valid == 0 and not self.keep_empty:
            raise EmptyWindowError(f"frame {frame} of {self.key[0]} has no valid line")
        image = np.zeros_like(self.pixels)
        image[:n_valid] = self.pixels[place[good]]
        whole = wanted + GROUP_LINES <= min(low + self.height, self.total)
        groups = place[good & self.starts[place] & whole]
        ends = [self.samples[groups[k]] for k in (0, -1)] if len(groups) else [self.no_sample] * 2
        numbers = [pa.array([n], pa.int64()) for n in (frame, int(here.sum()), n_valid)]
        shape = [pa.array([n], pa.int32()) for n in (image.shape[1], self.height)]
        yield pa.RecordBatch.from_arrays(
            [self.source, *numbers, *shape, *ends, pa.array([image.tobytes()], pa.binary())],
            names=["source", "frame_id", "n_lines", "n_valid", "width", "height", "window_start", "window_end", "pixels"],
        )
