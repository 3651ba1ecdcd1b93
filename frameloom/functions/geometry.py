"""Rotations and poses, vectorised over rows: NumPy on whole batches, double precision inside."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


def _cross_matrix(v: np.ndarray) -> np.ndarray:
    out = np.zeros((len(v), 3, 3))
    out[:, 2, 1], out[:, 0, 2], out[:, 1, 0] = v[:, 0], v[:, 1], v[:, 2]
    return out - out.transpose(0, 2, 1)


def to_matrix(rotvec: np.ndarray) -> np.ndarray:
    """Rotation matrices [n, 3, 3] of rotation vectors [n, 3]; first order below an angle of 1e-8."""
    v = np.asarray(rotvec, float).reshape(-1, 3)
    angle = np.linalg.norm(v, axis=1)
    small = angle < 1e-8
    k = _cross_matrix(np.where(small[:, None], v, v / np.where(small, 1, angle)[:, None]))
    s, c = np.where(small, 1, np.sin(angle))[:, None, None], np.where(small, 0, 1 - np.cos(angle))[:, None, None]
    return np.eye(3) + s * k + c * (k @ k)


def to_rotvec(matrix: np.ndarray) -> np.ndarray:
    """Rotation vectors of matrices, with branches near no rotation and near a half turn."""
    m = np.asarray(matrix, float).reshape(-1, 3, 3)
    angle = np.arccos(np.clip((np.trace(m, axis1=1, axis2=2) - 1) / 2, -1, 1))
    skew = np.stack([m[:, 2, 1] - m[:, 1, 2], m[:, 0, 2] - m[:, 2, 0], m[:, 1, 0] - m[:, 0, 1]], axis=1)
    small, half = angle < 1e-8, np.pi - angle < 1e-5
    scale = np.where(small | half, 0.5, angle / (2 * np.sin(np.where(small | half, 1, angle))))
    out = skew * scale[:, None]
    if half.any():
        axis = np.copysign(np.sqrt(np.maximum(m[half][:, range(3), range(3)] + 1, 0) / 2), skew[half])
        size = np.linalg.norm(axis, axis=1, keepdims=True)
        out[half] = np.where(size < 1e-8, 0, axis / np.where(size < 1e-8, 1, size) * angle[half][:, None])
    return out


def relative(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The rotation vector that leads from one rotation vector to the other."""
    return to_rotvec(to_matrix(after) @ to_matrix(before).transpose(0, 2, 1))


def pose_delta(pose: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Six-wide difference of poses: positions subtract, rotations divide."""
    return np.concatenate([target[:, :3] - pose[:, :3], relative(pose[:, 3:6], target[:, 3:6])], axis=1)


def pose_after(pose: np.ndarray, delta: np.ndarray) -> np.ndarray:
    """The pose that a delta leads to."""
    return np.concatenate([pose[:, :3] + delta[:, :3], to_rotvec(to_matrix(delta[:, 3:6]) @ to_matrix(pose[:, 3:6]))], axis=1)


def delta_actions(poses: np.ndarray, gripper: np.ndarray) -> np.ndarray:
    """Seven-wide actions of an episode: pose deltas to the next frame (0 on the last) and the gripper itself."""
    out = np.zeros((len(poses), 7))
    if len(poses) > 1:
        out[:-1, :6] = pose_delta(poses[:-1], poses[1:])
    out[:, 6] = gripper
    return out


def replay(start: np.ndarray, actions: np.ndarray, composed: bool = False) -> np.ndarray:
    """Poses from a start and deltas. By default rotation vectors add up, which is exact without rotation; composed
    multiplies rotations, the inverse of delta_actions()."""
    out = np.repeat(np.asarray(start, float)[None, :6], len(actions), axis=0)
    if not composed:
        out[1:] += np.cumsum(actions[:-1, :6], axis=0)
        return out
    for i in range(1, len(actions)):
        out[i] = pose_after(out[i - 1 : i], actions[i - 1 : i, :6])[0]
    return out


@F.arrow_udf(ArrayType(DoubleType()))
def rotation_between(before: pa.Array, after: pa.Array) -> pa.Array:
    """relative() as a column expression: the rotation vector that leads from one column of rotation vectors to the other;
    null where either is null or isn't three wide. At a half turn exactly, either of the two opposite vectors."""
    three = lambda v: pc.fill_null(pc.equal(pc.list_value_length(v), 3), False)
    good = pc.and_(three(before), three(after))
    as_rows = lambda v: v.filter(good).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, 3)
    turned = relative(as_rows(before), as_rows(after)).reshape(-1)
    counts = good.to_numpy(zero_copy_only=False) * 3
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(turned), mask=pc.invert(good))
