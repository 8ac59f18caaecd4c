"""Moment tensors in Arrow batches: axes, nodal planes, decomposition and the angle between two mechanisms.

A tensor is the columns mnn, mee, mdd, mne, mnd, med; planes are strike, dip and rake in degrees.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

M6 = ("mnn", "mee", "mdd", "mne", "mnd", "med")


def matrices(m6: np.ndarray) -> np.ndarray:
    nn, ee, dd, ne, nd, ed = m6.T
    return np.stack([np.stack([nn, ne, nd], -1), np.stack([ne, ee, ed], -1), np.stack([nd, ed, dd], -1)], -2)


def nodal_planes(m: np.ndarray) -> np.ndarray:
    """(n, 2, 3): strike, dip and rake of both planes of the best double couple, the smaller strike first."""
    _, v = np.linalg.eigh(m)
    p, t = v[:, :, 0], v[:, :, 2]
    planes = []
    for normal, slip in (((t + p), (t - p)), ((t - p), (t + p))):
        normal, slip = normal / np.sqrt(2), slip / np.sqrt(2)
        up = np.where(normal[:, 2:] > 0, -1.0, 1.0)  # the normal of the hanging wall points upwards, down is positive
        normal, slip = normal * up, slip * up
        strike = np.degrees(np.arctan2(-normal[:, 0], normal[:, 1])) % 360
        dip = np.degrees(np.arccos(np.clip(-normal[:, 2], -1, 1)))
        s = np.radians(strike)
        along = slip[:, 0] * np.cos(s) + slip[:, 1] * np.sin(s)
        across = np.where(np.sin(np.radians(dip)) > 1e-9, -slip[:, 2] / np.maximum(np.sin(np.radians(dip)), 1e-9), -slip[:, 0] * np.sin(s) + slip[:, 1] * np.cos(s))
        planes.append(np.stack([strike, dip, np.degrees(np.arctan2(across, along))], -1))
    both = np.stack(planes, 1)
    swap = both[:, 0, 0] > both[:, 1, 0]
    both[swap] = both[swap][:, ::-1]
    return both


def decompose(m: np.ndarray) -> np.ndarray:
    """(n, 5): moments of the whole, its isotropic, deviatoric, double-couple and compensated-dipole parts."""
    iso = np.trace(m, axis1=1, axis2=2) / 3
    e = np.linalg.eigvalsh(m - iso[:, None, None] * np.eye(3))
    e = np.take_along_axis(e, np.argsort(np.abs(e), axis=1), 1)
    dev = np.abs(e[:, 2])
    ratio = np.divide(e[:, 0], e[:, 2], out=np.zeros(len(m)), where=e[:, 2] != 0)
    dc = np.where(dev < 1e-6 * np.abs(iso), 0, dev * (1 + 2 * np.minimum(0, ratio)))
    return np.stack([np.abs(iso) + dev, np.abs(iso), dev, dc, dev - dc], -1)


def kagan_angle(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest rotation, in degrees, between the principal axes of each pair: over their four symmetric choices."""
    def frame(m: np.ndarray) -> np.ndarray:
        v = np.linalg.eigh(m)[1].copy()
        v[:, :, 2] *= np.sign(np.linalg.det(v))[:, None]
        return v

    u = np.swapaxes(frame(a), 1, 2) @ frame(b)
    flips = np.array([[1, 1, 1], [1, -1, -1], [-1, 1, -1], [-1, -1, 1]], float)
    traces = np.einsum("nii,ki->nk", u, flips).max(axis=1)
    return np.degrees(np.arccos(np.clip((traces - 1) / 2, -1, 1)))


def _stacked(batch: pa.RecordBatch, names) -> np.ndarray:
    return np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(float) for n in names], -1)


def with_planes(tensors: DataFrame) -> DataFrame:
    """tensors with both nodal planes and the five moments; nulls or non-finite numbers in a tensor give nulls."""
    names = [f"{n}{i}" for i in (1, 2) for n in ("strike", "dip", "rake")] + ["moment", "moment_iso", "moment_dev", "moment_dc", "moment_clvd"]
    schema = T.StructType([*tensors.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m6 = _stacked(batch, M6)
            ok = np.isfinite(m6).all(axis=1)
            m = matrices(np.where(ok[:, None], m6, 0))
            values = np.concatenate([nodal_planes(m).reshape(len(m), 6), decompose(m)], axis=1)
            for k, n in enumerate(names):
                batch = batch.append_column(n, pa.array(values[:, k], pa.float64(), mask=~ok))
            yield batch

    return tensors.mapInArrow(run, schema)


def with_angle(pairs: DataFrame, other: str = "b_") -> DataFrame:
    """pairs of tensors (the second one's columns prefixed) with the angle between them."""
    schema = T.StructType([*pairs.schema.fields, T.StructField("angle", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = _stacked(batch, M6), _stacked(batch, [other + n for n in M6])
            ok = np.isfinite(a).all(axis=1) & np.isfinite(b).all(axis=1)
            angle = kagan_angle(matrices(np.where(ok[:, None], a, 0)), matrices(np.where(ok[:, None], b, 0)))
            yield batch.append_column("angle", pa.array(angle, pa.float64(), mask=~ok))

    return pairs.mapInArrow(run, schema)
