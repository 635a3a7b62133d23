"""A deterministic table for benchmarks: region, bucket (the same key as text and number), amount, price.

The rows are those of one xorshift64* stream with three draws a row (group, amount, price). The stream is
sequential, but its state moves by a linear map over GF(2): a task jumps to its first draw by a power of
that map, and inside a task many lanes step together. So the table is made in parallel and is the same
for every number of partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quern.shipping import ship

# Generator, seed and ranges of the benchmark's data.
SEED = 0xBA7CB12D
MULTIPLIER = 0x2545F4914F6CDD1D
ZERO_SEED = 0x9E3779B97F4A7C15
AMOUNT_RANGE, PRICE_RANGE = 1_000_000, 100_000
LANES = 4096


def step(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(12))
    x = x ^ (x << np.uint64(25))
    return x ^ (x >> np.uint64(27))


def apply_map(columns: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A linear map (images of the 64 bits) applied to states."""
    out = np.zeros_like(x)
    for bit in range(64):
        out ^= np.where((x >> np.uint64(bit)) & np.uint64(1), columns[bit], np.uint64(0))
    return out


def jump(state: np.ndarray, steps: int) -> np.ndarray:
    """States ``steps`` draws later."""
    power = step(np.uint64(1) << np.arange(64, dtype=np.uint64))
    while steps:
        if steps & 1:
            state = apply_map(power, state)
        power = apply_map(power, power)
        steps >>= 1
    return state


def draws(seed: int, first: int, count: int) -> np.ndarray:
    """Draws number first .. first+count-1 of a seed's stream."""
    start = np.array([seed % (1 << 64) or ZERO_SEED], np.uint64)
    each = -(-count // LANES)
    lanes = np.empty(LANES, np.uint64)
    lanes[:1] = jump(start, first)
    width = 1
    while width < LANES:  # lane i starts i * each draws after lane 0
        lanes[width : 2 * width] = jump(lanes[:width], each * width)
        width *= 2
    out = np.empty((LANES, each), np.uint64)
    for i in range(each):
        lanes = step(lanes)
        out[:, i] = lanes * np.uint64(MULTIPLIER)
    return out.ravel()[:count]


def amount_threshold(fraction: float) -> int:
    """The literal of amount > literal that about this fraction of rows passes."""
    if not 0 <= fraction <= 1:
        raise ValueError("a fraction lies between 0 and 1")
    return int((1 - fraction) * AMOUNT_RANGE)


def generate(spark: SparkSession, rows: int, cardinality: int, seed: int = SEED, chunk: int = 1 << 17) -> DataFrame:
    """region string, bucket long, amount long, price double."""
    if cardinality < 1:
        raise ValueError("cardinality is positive")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column(0).to_pylist():
                n = min(chunk, rows - number * chunk)
                d = draws(seed, 3 * number * chunk, 3 * n).reshape(-1, 3)
                group = (d[:, 0] % np.uint64(cardinality)).astype(np.int64)
                amount = (d[:, 1] % np.uint64(AMOUNT_RANGE)).astype(np.int64)
                price = (d[:, 2] % np.uint64(PRICE_RANGE)).astype(np.float64) / 100.0 - 500.0
                region = pa.array(np.char.add("r", group.astype(str)).tolist())
                yield pa.RecordBatch.from_arrays([region, pa.array(group), pa.array(amount), pa.array(price)], ["region", "bucket", "amount", "price"])

    ship(spark)
    chunks = -(-rows // chunk)
    return spark.range(0, chunks, 1, max(1, min(chunks, 4 * spark.sparkContext.defaultParallelism))).mapInArrow(make, "region string, bucket long, amount long, price double")
