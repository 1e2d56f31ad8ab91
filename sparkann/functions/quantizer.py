"""Scalar quantization: ranges, presets, training by one aggregate, and quantized columns."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkann.functions.vectors import col, normalized


@dataclass(frozen=True)
class Quantizer:
    """bits, signedness and normalization; scale is there once it is trained, given, or preset."""

    bits: int = 8
    is_unsigned: bool = False
    normalize: bool = True
    scale: float | None = None

    @property
    def low(self) -> int:
        return 0 if self.is_unsigned else -(1 << self.bits - 1)

    @property
    def high(self) -> int:
        return (1 << self.bits) - 1 if self.is_unsigned else (1 << self.bits - 1) - 1

    def trained(self, low: float, high: float) -> Quantizer:
        """With the scale for data from low to high (after normalization, if that is on)."""
        most, tiny = max(abs(low), abs(high)), 1e-6
        if self.normalize:
            scale = self.high / ((high if low >= 0 else 2 * most if self.is_unsigned else most) + tiny)
        elif self.is_unsigned and low >= 0:
            scale = (self.high - self.low) / (high - low + tiny)
        else:
            scale = self.high / (most + tiny)
        return replace(self, scale=scale)

    def fit(self, df: DataFrame, vec: str = "embedding", every: int = 1) -> Quantizer:
        """Train on one global aggregate. A scale that is given already is kept, not trained over. every > 1 samples rows by a
        hash of the vector; the default reads all."""
        if self.scale is not None:
            return self
        r = data_range(df, vec, self.normalize, every)
        if r["low"] is None:
            raise ValueError("no vectors to train on")
        return self.trained(r["low"], r["high"])

    def __call__(self, vec: Column | str) -> Column:
        """The quantized vector, an array of SMALLINT."""
        if self.scale is None:
            raise ValueError("the quantizer isn't trained")
        v = normalized(vec) if self.normalize else col(vec)
        return F.transform(v, lambda x: quantized(x, self.scale, self.low, self.high))

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Quantizer:
        return Quantizer(**json.loads(text))


#: Presets with fixed scales: five signed bits, and unsigned bytes.
FIVE_BIT_SIGNED = Quantizer(5, False, True, 32.0)
UNSIGNED_BYTES = Quantizer(8, True, True, 512.0)


def quantized(x: Column, scale: float, low: int, high: int) -> Column:
    """round is half away from zero."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.round(x.cast("double") * F.lit(float(scale))))).cast("smallint")


def data_range(df: DataFrame, vec: str = "embedding", normalize: bool = False, every: int = 1) -> dict:
    """Least and greatest component, and whether any is negative, over all vectors (or a hashed sample)."""
    v = normalized(vec) if normalize else F.transform(col(vec), lambda x: x.cast("double"))
    held = df if every == 1 else df.where(F.pmod(F.xxhash64(vec), F.lit(every)) == 0)
    r = held.select(v.alias("v")).agg(F.min(F.array_min("v")).alias("low"), F.max(F.array_max("v")).alias("high")).first()
    return {"low": r["low"], "high": r["high"], "is_signed": r["low"] is not None and r["low"] < 0}


def auto_scale(low: float, high: float) -> float:
    """A scale from a range alone: 127 over the greatest magnitude if signed, else 255 over the greatest."""
    return 127.0 / max(abs(low), abs(high)) if low < 0 else 255.0 / high


def four_bit(vec: Column | str) -> Column:
    """Floats from -1 to 1 as 0 to 15."""
    return F.transform(col(vec), lambda x: F.greatest(F.lit(0), F.least(F.lit(15), F.floor((x.cast("double") + 1) * 7.5))).cast("smallint"))


def from_four_bit(vec: Column | str) -> Column:
    return F.transform(col(vec), lambda x: x.cast("double") / 7.5 - 1)
