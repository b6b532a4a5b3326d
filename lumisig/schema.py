"""Fixed values and table schemas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, ShortType, StringType, StructField, StructType, TimestampType

# Weights by bin of a coefficient and channel, from Jacobs, Finkelstein and Salesin, "Fast Multiresolution Image Querying", 1995.
WEIGHTS = (
    (5.00, 19.21, 34.37),
    (0.83, 1.26, 0.36),
    (1.01, 0.44, 0.45),
    (0.52, 0.53, 0.14),
    (0.47, 0.28, 0.18),
    (0.30, 0.14, 0.27),
)
# Rows of the NTSC colour matrix.
YIQ = ((0.299, 0.587, 0.114), (0.596, -0.275, -0.321), (0.212, -0.523, 0.311))
#: Factor of each level; stored signatures depend on these four digits.
LEVEL = 0.7071
GRAY_LIMIT = 0.006
UPSERT, DELETE = 1, 2
DEFAULT_LIMIT, MAX_LIMIT = 10, 200
CHUNK_SLOTS = 65_536
EPSILON = 0.01


@dataclass(frozen=True)
class Geometry:
    """Side of the square image and coefficients kept per channel. ties: how equal magnitudes are chosen."""

    side: int = 128
    keep: int = 40
    ties: str = "heap"

    @property
    def pixels(self) -> int:
        return self.side * self.side

    @property
    def dc_divisor(self) -> float:
        """Makes a flat plane of value m have a mean of about m / 256."""
        return 256.0 * self.side


FULL = Geometry()

IMAGES = StructType([
    StructField("post_id", IntegerType(), False), *(StructField(f"avglf{i}", DoubleType(), False) for i in (1, 2, 3)),
    StructField("sig", BinaryType(), False), StructField("updated_at", TimestampType()),
])
EVENTS = StructType([
    StructField("seq", LongType(), False), StructField("op", ShortType(), False), StructField("post_id", IntegerType(), False),
    *(StructField(f"avglf{i}", DoubleType()) for i in (1, 2, 3)), StructField("sig", BinaryType()), StructField("at", TimestampType()),
])
CORPUS = StructType([StructField("hash", StringType()), StructField("kind", StringType())])
SIGNATURE = StructType([StructField("avglf", ArrayType(DoubleType())), StructField("sig", ArrayType(ArrayType(ShortType())))])
