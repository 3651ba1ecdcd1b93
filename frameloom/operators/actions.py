"""Actions from states: differences, replay, modes, edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameloom.functions.geometry import rotation_between

from .episodes import by_episode


def forward_delta(x: Column) -> Column:
    """The step to the next frame; 0 on the last."""
    return F.coalesce(F.lead(x).over(by_episode()) - x, F.lit(0.0))


def appended_delta(x: Column) -> Column:
    """The same by repeating the last value, as the evaluation does."""
    return F.coalesce(F.lead(x).over(by_episode()), x) - x


def slip(x: Column) -> Column:
    """The size of the step from the frame before; 0 on the first."""
    return F.coalesce(F.abs(x - F.lag(x).over(by_episode())), F.lit(0.0))


def replayed(start: Column, delta: Column) -> Column:
    """start plus all deltas of earlier frames."""
    before = by_episode().rowsBetween(Window.unboundedPreceding, -1)
    return start + F.coalesce(F.sum(delta).over(before), F.lit(0.0))


def rising_edge(x: Column, threshold: Column) -> Column:
    """The value reaches the threshold and was below it on the frame before."""
    return F.coalesce((F.lag(x).over(by_episode()) < threshold) & (x >= threshold), F.lit(False))


def vector_delta(v: Column) -> Column:
    """Forward difference of a vector column; zeros on the last frame."""
    after = F.lead(v).over(by_episode())
    return F.when(after.isNull(), F.transform(v, lambda x: F.lit(0.0))).otherwise(F.zip_with(after, v, lambda a, b: a - b))


# The action modes.
MODES = ("ee_delta_6d_gripper", "ee_absolute_6d_gripper", "joint_position_gripper", "joint_delta_gripper")


def _with_slot(arm: Column, wide: Column, gripper: Column | None) -> Column:
    """arm and one slot more: the gripper, else the seventh value of a wide vector, else 0."""
    slot = F.coalesce(F.get(wide, F.lit(6)), F.lit(0.0)) if gripper is None else gripper.cast("double")
    return F.concat(arm, F.array(slot))


def build_action(mode: str, state: Column, raw: Column | None = None, gripper: Column | None = None) -> Column:
    """The action vector of each frame. raw is the recorded action; without it the state stands in.

    ee_delta_6d_gripper: the step to the next frame's pose (first six of the state), positions subtracted, rotation
    vectors composed (next times inverse of this), zeros on the last frame; the recorded action isn't used.
    ee_absolute_6d_gripper: the recorded action's first six values. joint_position_gripper: the recorded action.
    joint_delta_gripper: the step to the next frame's recorded action, without its last value if it has more than six.
    All but joint_position_gripper end with one slot: the gripper; where none is given, the vector's seventh value (its
    last, for joints), else 0.
    """
    action = state if raw is None else raw
    if mode == "ee_delta_6d_gripper":
        pose = F.slice(state, 1, 6)
        after = F.coalesce(F.lead(pose).over(by_episode()), pose)
        step = F.zip_with(F.slice(after, 1, 3), F.slice(pose, 1, 3), lambda a, b: a - b)
        return _with_slot(F.concat(step, rotation_between(F.slice(pose, 4, 3), F.slice(after, 4, 3))), state, gripper)
    if mode == "ee_absolute_6d_gripper":
        return _with_slot(F.slice(action, 1, 6), action, gripper)
    if mode == "joint_position_gripper":
        return action
    if mode == "joint_delta_gripper":
        arm = F.when(F.size(action) > 6, F.slice(action, F.lit(1), F.size(action) - 1)).otherwise(action)
        last = F.when(F.size(action) > 6, F.element_at(action, -1)).otherwise(F.lit(0.0))
        return _with_slot(vector_delta(arm), action, last if gripper is None else gripper)
    raise ValueError(f"no action mode {mode}")


def from_first(frames: DataFrame, vector: str) -> Column:
    """Difference of each vector from its episode's first."""
    first = F.first(vector).over(by_episode().rowsBetween(Window.unboundedPreceding, 0))
    return F.zip_with(F.col(vector), first, lambda a, b: a - b)
