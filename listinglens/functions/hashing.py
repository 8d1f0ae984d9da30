"""Perceptual photo hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RASTER_WIDTH = 9
RASTER_HEIGHT = 8


def dhash_from_pixels(px: Column) -> Column:
    """64-bit difference hash of a 9x8 grey raster as a signed long.

    One bit per horizontal neighbour pair (left darker than right), first pair
    in the highest bit. A raster of another size or with gaps gives null.
    """
    steps = RASTER_WIDTH - 1
    bits = F.sequence(F.lit(0), F.lit(RASTER_HEIGHT * steps - 1))

    def push(acc: Column, i: Column) -> Column:
        at = F.floor(i / steps).cast("int") * RASTER_WIDTH + i % steps
        darker = F.get(px, at) < F.get(px, at + 1)
        return F.shiftleft(acc, 1).bitwiseOR(darker.cast("long"))

    folded = F.aggregate(bits, F.lit(0).cast("long"), push)
    return F.when(F.size(px) == RASTER_WIDTH * RASTER_HEIGHT, folded)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
