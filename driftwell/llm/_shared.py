"""What several operators need: tables, scratch tables in the shared folder, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph
from ..runtime import materialize, shared_folder

__all__ = ["Sieve", "bit_sieve", "components", "documents", "materialize", "shared_folder", "table", "unused"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def unused(df: DataFrame, *names: str) -> list[str]:
    """These column names, each with underscores before it until ``df`` has none like it in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        out.append(n)
    return out


BLOCKS = 64
SIEVE_BITS = 29  # a sieve has 2**29 bits, 64 MB, at most


class Sieve:
    """A bit for each value of a hash's low bits; ``has`` says whether a hash may be among those marked."""

    def __init__(self, bits: int, marks: np.ndarray):
        self.mask, self.marks = np.uint64((1 << bits) - 1), marks

    def has(self, h: np.ndarray) -> np.ndarray:
        at = h.view(np.uint64) & self.mask
        return (self.marks[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def bit_sieve(hashes: DataFrame) -> Sieve:
    """The hashes ``h`` by their low bits, sixteen bits for each of them, in all 8 KB to 64 MB.

    A join has to tell false marks. From 2**27 hashes on more than a fifth of what isn't among them passes; from 2**29
    on the sieve sifts little and that join does all the work.
    """
    bits = int(min(SIEVE_BITS, max(16, np.ceil(np.log2(16 * max(1, hashes.count()))))))
    size = (1 << bits) // BLOCKS

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for b in batches:
            block, at = b.column(0).to_numpy(), b.column(1).to_numpy()
            for k in np.unique(block).tolist():
                if k not in blocks:
                    blocks[k] = np.zeros(size, bool)
                blocks[k][at[block == k]] = True
        for k, m in blocks.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([np.packbits(m, bitorder="little").tobytes()], pa.binary())], ["block", "m"])

    low = F.col("h").bitwiseAND((1 << bits) - 1)
    at = hashes.select(F.floor(low / size).cast("long").alias("block"), (low % size).alias("at"))
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in at.repartition(BLOCKS, "block").mapInArrow(marks, "block long, m binary").collect():  # 64 rows
        out[r.block * size // 8 : (r.block + 1) * size // 8] = np.frombuffer(r.m, np.uint8)
    return Sieve(bits, out)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of ``edges``: rows (node, comp), comp the smallest node that links reach."""
    return graph.components(edges.select(F.col(a).alias("src"), F.col(b).alias("dst"))).withColumnRenamed("component", "comp")
