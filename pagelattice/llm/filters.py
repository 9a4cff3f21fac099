"""A blocked Bloom filter of the keys of a table, for leaving out rows that a join on them would drop."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelattice.llm.common import map_arrow, mix64

#: Bits for each key, and the most 64-bit blocks: 32 MB. Beyond about 8 million keys the filter lets
#: more through, and stays right.
BITS, LEAST, MOST = 32, 1 << 10, 1 << 22


def _places(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block and the four bits within it of each 64-bit hash."""
    h = mix64(hashes)
    mask = np.uint64(1) << (h & np.uint64(63))
    for shift in (6, 12, 18):
        mask |= np.uint64(1) << ((h >> np.uint64(shift)) & np.uint64(63))
    return ((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32), mask


def key_filter(keys: DataFrame, hashes: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The filter of a written table's rows; hashes gives a batch's hashes as uint64. Blocks are
    combined by Spark, so the driver gets no more than the filter, whatever the number of tasks."""
    blocks = max(LEAST, min(MOST, keys.count() * BITS // 64))

    def run(batches):
        for b in batches:
            at, mask = _places(hashes(b), blocks)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(mask.view(np.int64))], names=["block", "mask"])

    found = map_arrow(keys, run, "block int, mask long").groupBy("block").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(blocks, np.uint64)
    out[found["block"].to_numpy()] = found["mask"].to_numpy().view(np.uint64)
    return out


def may_hold(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes may be in the filter; all that are."""
    at, mask = _places(hashes, len(bits))
    return (bits[at] & mask) == mask
