"""Vector columns (array<double> or array<float>) without leaving the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Places of hand joints in 24-wide dual-arm vectors, and of arm joints.
LEFT_ARM, LEFT_HAND, RIGHT_ARM, RIGHT_HAND = range(0, 6), range(6, 12), range(12, 18), range(18, 24)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def taken(v: Column, places: Sequence[int]) -> Column:
    """The elements at the given places, null where the vector is too short."""
    return F.transform(F.array(*[F.lit(i) for i in places]), lambda i: F.get(v, i))


def first_half(v: Column) -> Column:
    return F.when(F.size(v) % 2 == 0, F.slice(v, F.lit(1), (F.size(v) / 2).cast("int"))).otherwise(F.raise_error(F.lit("odd width")).cast("array<double>"))


def second_half(v: Column) -> Column:
    half = (F.size(v) / 2).cast("int")
    return F.when(F.size(v) % 2 == 0, F.slice(v, half + 1, half)).otherwise(F.raise_error(F.lit("odd width")).cast("array<double>"))


def padded(v: Column, width: int) -> Column:
    """Cut or filled with zeros to a width."""
    return F.slice(F.concat(v.cast("array<double>"), F.array_repeat(F.lit(0.0), width)), 1, width)


def with_gripper(state: Column, gripper: Column, tactile: Column | None = None) -> Column:
    """A 6-wide state gets the gripper as its last element; tactile features follow."""
    out = F.when(F.size(state) == 6, F.concat(state, F.array(gripper))).otherwise(state)
    return out if tactile is None else F.concat(out, F.coalesce(tactile, F.array().cast("array<double>")))


def clipped(x: Column, low: Column, high: Column) -> Column:
    return F.greatest(F.least(x, high), low)


def clip_slots(action: Column, xyz: float = 0.05, rotation: float = 0.35, gripper: tuple[float, float] = (0.0, 1.0)) -> Column:
    """Position, rotation and gripper slots of a 7-wide action, each to its own limits."""
    limit = lambda i, low, high: F.when(i < 3, F.lit(low * xyz)).when(i < 6, F.lit(low * rotation)).otherwise(F.lit(high))
    return F.transform(action, lambda x, i: clipped(x, limit(i, -1, gripper[0]), limit(i, 1, gripper[1])))


def clip_around(action: Column, current: Column, delta: float) -> Column:
    """Each element to within delta of the current one."""
    return F.zip_with(action, current, lambda a, c: clipped(a, c - delta, c + delta))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def largest_move(v: Column, slots: int = 3) -> Column:
    return F.array_max(F.transform(F.slice(v, 1, slots), lambda x: F.abs(x)))


def refuse_unsafe(v: Column, limit: float = 0.25) -> Column:
    """The action itself; raises where a position slot moves beyond the limit."""
    return F.when(largest_move(v) > limit, F.raise_error(F.lit("unsafe action")).cast("array<double>")).otherwise(v)


def to_absolute(delta: Column, state: Column, mask: Sequence[bool]) -> Column:
    """Elements marked in mask are added to the state; the others are kept."""
    marks = F.array(*[F.lit(bool(m)) for m in mask])
    return F.transform(delta, lambda d, i: F.when(F.get(marks, i), d + F.get(state, i)).otherwise(d))


def hand_to_unit(v: Column, low: Sequence[float], high: Sequence[float], flipped: Sequence[int] = (5, 11)) -> Column:
    """Hand degrees to [0, 1]; thumbs change sign first."""
    lows, highs = F.array(*[F.lit(float(x)) for x in low]), F.array(*[F.lit(float(x)) for x in high])
    flip = F.array(*[F.lit(i) for i in flipped])
    return F.transform(v, lambda x, i: (F.when(F.array_contains(flip, i), -x).otherwise(x) - F.get(lows, i)) / (F.get(highs, i) - F.get(lows, i)))


def binarised(v: Column, threshold: float = 1000.0) -> Column:
    return F.transform(v, lambda x: (x > threshold).cast("float"))


def not_finite(x: Column) -> Column:
    return F.isnan(x) | (F.abs(x) == F.lit(float("inf")))


def zeroed(v: Column) -> Column:
    """NaN and infinities as 0."""
    return F.transform(v, lambda x: F.when(not_finite(x), F.lit(0.0)).otherwise(x.cast("double")))


def normalised(x: Column, low: Column, high: Column) -> Column:
    """To [-1, 1]; a constant column maps to -1."""
    return (x - low) / (high - low + F.lit(1e-8)) * 2 - 1


def denormalised(x: Column, low: Column, high: Column) -> Column:
    return (x + 1) / 2 * (high - low + F.lit(1e-8)) + low
