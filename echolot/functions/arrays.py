"""Columns over fingerprints: arrays of 32-bit values and of shape bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def upper_median(values: Column) -> Column:
    """The element in the middle of the sorted array, the upper of two; the largest float if empty."""
    middle = F.floor(F.size(values) / 2).cast("int") + 1
    return F.when(F.size(values) > 0, F.element_at(F.array_sort(values), middle)).otherwise(F.lit(3.4028234663852886e38))


def key_halves(value: Column) -> Column:
    """Lower half, and upper half marked by bit 16."""
    return F.array(value.bitwiseAND(F.lit(65535)), F.shiftright(value, 16).bitwiseOR(F.lit(65536)))


def joint_halves(value: Column, following: Column) -> Column:
    """Lower halves of two values, and their upper halves marked by bit 32."""
    low = F.shiftleft(value.bitwiseAND(F.lit(65535)), 16).bitwiseOR(following.bitwiseAND(F.lit(65535)))
    high = F.shiftleft(F.shiftright(value, 16), 16).bitwiseOR(F.shiftright(following, 16))
    return F.array(low, high.bitwiseOR(F.lit(1 << 32)))


def band_bits(bands: Column, previous: Column) -> Column:
    """32 bits, lowest first: does the step between neighbouring bands grow from one frame to the next?"""
    step = lambda x, i: F.element_at(x, i + 1) - F.element_at(x, i + 2)
    weigh = lambda i: F.when(step(bands, i) - step(previous, i) > 0, F.expr("1L") * F.pow(F.lit(2.0), i).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    return F.aggregate(F.sequence(F.lit(0), F.size(bands) - 2), F.lit(0).cast("bigint"), lambda acc, i: acc + weigh(i))


def flux(bands: Column, previous: Column) -> Column:
    """Mean absolute change over all bands."""
    total = F.aggregate(F.zip_with(bands, previous, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda acc, x: acc + x)
    return total / F.size(bands)


def shape_template(means: Column) -> Column:
    """Band means relative to the loudest, from 8 decades down to 0, as bytes."""
    top = F.array_max(means)
    return F.transform(means, lambda m: F.round((F.least(F.lit(0.0), F.greatest(F.lit(-8.0), m - top)) + 8) / 8 * 255).cast("smallint"))


def shape_distance(a: Column, b: Column) -> Column:
    """Difference of two templates weighted by the louder of each band; 1 if they can't be compared."""
    pairs = F.zip_with(a, b, lambda x, y: F.struct(F.greatest(x, y).cast("double").alias("w"), F.abs(x - y).cast("double").alias("d")))
    weight = F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + p["w"] / 255)
    total = F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + p["w"] / 255 * p["d"])
    return F.when((F.size(a) != F.size(b)) | (F.size(a) == 0), 1.0).when(weight == 0, 0.0).otherwise(total / weight / 255)


def overlap(a: Column, b: Column, offset: Column) -> Column:
    """Values that lie on each other when a leads b by the offset."""
    return F.greatest(F.lit(0), F.least(F.size(a) - F.greatest(offset, F.lit(0)), F.size(b) - F.greatest(-offset, F.lit(0)))).cast("bigint")


def bit_errors(a: Column, b: Column, offset: Column, length: Column) -> Column:
    """Different bits in the overlap; both slices go through the JVM's bit count."""
    first = F.slice(a, (F.greatest(offset, F.lit(0)) + 1).cast("int"), length.cast("int"))
    second = F.slice(b, (F.greatest(-offset, F.lit(0)) + 1).cast("int"), length.cast("int"))
    return F.aggregate(F.zip_with(first, second, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("bigint")), F.lit(0).cast("bigint"), lambda acc, x: acc + x)


def bit_error_rate(errors: Column, length: Column) -> Column:
    return F.when(length > 0, errors / (length * 32)).otherwise(1.0)
