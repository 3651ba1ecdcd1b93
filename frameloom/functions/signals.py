"""Force levels, waves, depth codes and tactile features."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from .vectors import clipped, let, zeroed


def unit(x: Column) -> Column:
    return clipped(x, F.lit(0.0), F.lit(1.0))


@dataclass(frozen=True)
class Force:
    """Motion range, thresholds on normalised motion and the forces they stand for."""

    least: float = 0.5
    most: float = 20.0
    soft_at: float = 0.15
    mild_at: float = 0.45
    firm_at: float = 0.75
    soft: float = 0.3
    mild: float = 0.6
    firm: float = 1.0
    discrete: bool = True


def motion_to_force(motion: Column, how: Force = Force()) -> Column:
    """Deadband, normalisation, then three levels above thresholds that never fall."""
    x = unit((motion - how.least) / max(how.most - how.least, 1e-6))
    if how.discrete:
        soft = min(1.0, max(0.0, how.soft_at))
        mild = max(soft, min(1.0, how.mild_at))
        firm = max(mild, min(1.0, how.firm_at))
        x = F.when(x <= soft, 0.0).when(x <= mild, how.soft).when(x <= firm, how.mild).otherwise(how.firm)
    return F.when(motion <= how.least, 0.0).otherwise(x)


def force_state(force: Column, how: Force = Force()) -> Column:
    out = F.when(force <= 1e-6, "off")
    if how.discrete:
        out = out.when(force >= how.firm - 1e-6, "firm").when(force >= how.mild - 1e-6, "mild").when(force >= how.soft - 1e-6, "soft")
    return out.otherwise("active")


def packet(left: Column, right: Column) -> Column:
    """The text of a force packet."""
    return F.format_string("%.4f %.4f", unit(left), unit(right))


def wave(mode: str, elapsed: Column, frequency: float, low: float, high: float, phase: float = 0.0) -> Column:
    if mode == "static":
        return F.lit(min(1.0, max(0.0, high)))
    cycle = (elapsed + phase / max(frequency, 1e-6)) * frequency
    if mode == "sine":
        level = 0.5 + 0.5 * F.sin(2 * F.pi() * cycle)
    elif mode == "triangle":
        p = F.pmod(cycle, F.lit(1.0))
        level = F.when(p < 0.25, 0.5 + 2 * p).when(p < 0.75, 1 - 2 * (p - 0.25)).otherwise(2 * (p - 0.75))
    else:
        raise ValueError(f"unknown wave: {mode}")
    return unit(low + (high - low) * level)


def depth_code(mm: Column, low: float = 200.0, high: float = 1500.0) -> Column:
    """Depth in mm as 0..255; invalid depth is 0, and so is valid depth at or below the range."""
    return F.when(mm > 0, F.floor((clipped(mm.cast("double"), F.lit(low), F.lit(high)) - low) * 255.0 / (high - low))).otherwise(0).cast("int")


def depth_of(code: Column, low: float = 200.0, high: float = 1500.0) -> Column:
    return F.when(code > 0, code / F.lit(255.0) * (high - low) + low).otherwise(0.0)


def keep_beyond(depth: Column, camera: Column) -> Column:
    """Far pixels stay and near ones become 0: beyond 800 for the first camera, 8000 for others."""
    return F.when(depth > F.when(camera == 0, 800).otherwise(8000), depth).otherwise(0)


def tactile_features(v: Column, episode: str, order: list[str]) -> Column:
    """Nine features: contact, mean, std, slip, left mean, right mean, sum, centre of pressure, 0. NaN and infinities
    count as 0; slip is the change of the sum since the row before, 0 on an episode's first row. Each sum is worked out
    once a row."""
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda s, e: s + e)
    size = lambda c: F.transform(c, lambda e: F.abs(e))
    pressure = add(size(zeroed(v)))
    slip = F.coalesce(F.abs(pressure - F.lag(pressure).over(Window.partitionBy(episode).orderBy(*order))), F.lit(0.0))

    def features(x: Column, n: Column, half: Column) -> Column:
        std = lambda mean: F.array(mean, F.sqrt(add(F.transform(x, lambda e: (e - mean) * (e - mean))) / n))

        def of(a: Column) -> Column:
            left = lambda left: F.array(left, F.when(n > 1, F.try_divide(add(F.slice(a, half + 1, F.greatest(n - half, F.lit(0)))), n - half)).otherwise(left))
            centre = lambda total: F.array(total, add(F.transform(a, lambda e, i: e * i)) / F.greatest(total, F.lit(1e-6)) / F.greatest(n - 1, F.lit(1)))
            return F.concat(let(add(F.slice(a, F.lit(1), half)) / half, left), let(add(a), centre))

        return F.concat(let(add(x) / n, std), let(size(x), of))

    n = F.size(v)
    half = F.greatest(F.floor(n / 2).cast("int"), F.lit(1))
    contact = lambda f: F.concat(F.array((f[4] > 1e-5).cast("double")), f, F.array(F.lit(0.0)))
    made = let(let(zeroed(v), lambda x: features(x, n, half)), contact)
    return F.concat(F.slice(made, 1, 3), F.array(slip), F.slice(made, 4, 5))
