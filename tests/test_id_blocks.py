"""State of stream checks: ids in blocks, counts as a streaming aggregate."""

from collections import Counter

import numpy as np
import pandas as pd

from framelake.streaming import streams


class _Value:
    held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value


class _Map(dict):
    writes = 0
    containsKey = dict.__contains__
    getValue = dict.__getitem__

    def updateValue(self, key, value):
        self.writes += 1
        self[key] = value


def _operator():
    operator = streams.IdIntervals(["k"])
    operator.total, operator.blocks = _Value(), _Map()
    return operator


def _batch(operator, *runs):
    frames = iter([pd.DataFrame({"first": a, "last": b, "n": n}) for a, b, n in runs])
    return next(operator.handleInputRows(("x",), frames, None)).iloc[0]


def test_ids_in_blocks_by_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(40):
        operator, seen = _operator(), Counter()
        operator.HELD_BLOCKS = int(rng.integers(1, 4))
        base = streams.ID_BLOCK * int(rng.integers(-1, 3)) - 30
        for _ in range(4):
            ids = base + rng.integers(0, 90, 20) + streams.ID_BLOCK * rng.integers(0, 3)
            low = base + int(rng.integers(0, 60))
            high = low + int(rng.integers(0, 2 * streams.ID_BLOCK))
            once, n = np.unique(ids, return_counts=True)
            row = _batch(operator, (once, once, n), ([low], [high], [high - low + 1]))
            new = Counter(ids.tolist()) + Counter(range(low, high + 1))
            again = {i for i, n in new.items() if n > 1 or i in seen}
            seen += new
            have = np.array(sorted(seen))
            holes = int((np.diff(have) > 1).sum())
            assert (row.first_id, row.last_id, row.n_ids, row.n_rows, row.n_holes) == (have[0], have[-1], len(have), sum(seen.values()), holes)
            assert {i for r in row.repeated for i in range(r["first"], r["last"] + 1)} == again


def test_a_batch_touches_its_own_blocks():
    """Every third id, so nothing is an interval: earlier blocks are not written again and take a bitmap each."""
    operator = _operator()
    for block in range(20):
        ids = np.arange(block * streams.ID_BLOCK, (block + 1) * streams.ID_BLOCK, 3)
        row = _batch(operator, (ids, ids, np.ones(len(ids), np.int64)))
    assert operator.blocks.writes == len(operator.blocks) == 20
    assert max(len(ids) for (ids,) in operator.blocks.values()) == streams.ID_BLOCK // 8
    assert row.n_rows == row.n_ids


def test_counts_without_expiry_stay_in_the_engine(spark, tmp_path):
    spark.range(4).write.parquet(str(tmp_path / "in"))
    counts = streams.frame_counts(streams.read_files(spark, str(tmp_path / "in"), "id bigint"), ["id"], 3)
    assert "InPand" not in counts._jdf.queryExecution().analyzed().toString()
