"""A bitmap of an index's k-mers, asked before a sample's k-mers are shuffled."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits for each k-mer: with one bit set for each, about one strange k-mer in nine passes.
BITS = 8
#: Most bits of a bitmap (128 MiB), which bounds what is broadcast. Beyond this many k-mers (LEAST bits for each) it would let most pass.
MOST_BITS, LEAST = 1 << 30, 1
#: Bits of one row of the bitmap while it is made.
ROW = 1 << 20
_MULT = np.uint64(0x9E3779B97F4A7C15)


def places(codes: np.ndarray, bits: int) -> np.ndarray:
    """The bit of each code, by the high bits of a multiplicative hash of its mixed value. bits: a power of two."""
    h = codes.astype(np.uint64)
    h = (h ^ (h >> np.uint64(31))) * _MULT
    h = (h ^ (h >> np.uint64(29))) * _MULT
    return (h >> np.uint64(65 - bits.bit_length())).astype(np.int64)


def width(n: int) -> int | None:
    """Bits for n k-mers; None where a bitmap of MOST_BITS would be too full to help."""
    if n * LEAST > MOST_BITS:
        return None
    return min(MOST_BITS, 1 << max(16, (BITS * n - 1).bit_length()))


def kmer_filter(known: DataFrame) -> Callable[[np.ndarray], np.ndarray] | None:
    """Mask of the codes that may be in known(kmer long, distinct): never false for one that is. None: no filter that helps."""
    spark = known.sparkSession
    bits = width(known.count())
    if bits is None:
        return None
    row = min(ROW, bits)

    @F.pandas_udf("long")
    def place(codes: pd.Series) -> pd.Series:
        return pd.Series(places(codes.to_numpy(), bits))

    def packed(g: pd.DataFrame) -> pd.DataFrame:
        have = np.zeros(row, bool)
        have[g["at"].to_numpy() % row] = True
        return pd.DataFrame({"row": [int(g["at"].iloc[0]) // row], "bitmap": [np.packbits(have).tobytes()]})

    at = known.select(place("kmer").alias("at")).distinct()
    rows = at.groupBy(F.floor(F.col("at") / row).alias("_row")).applyInPandas(packed, "row long, bitmap binary").collect()  # MOST_BITS in all
    whole = np.zeros(bits // 8, np.uint8)
    for r in rows:
        whole[r["row"] * row // 8 : (r["row"] + 1) * row // 8] = np.frombuffer(bytes(r["bitmap"]), np.uint8)
    shared = spark.sparkContext.broadcast(whole.tobytes())

    def keep(codes: np.ndarray) -> np.ndarray:
        p = places(codes, bits)
        return (np.frombuffer(shared.value, np.uint8)[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1 > 0

    return keep
