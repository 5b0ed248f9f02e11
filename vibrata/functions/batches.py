"""Arrow batches of windows as matrices: windows of one length are worked on at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd


def by_length(windows: pd.Series, work: Callable[[np.ndarray], list], least: int = 1) -> pd.Series:
    """``work`` on the matrix of all windows of a length, a result a row; None for null, incomplete or shorter windows."""
    out = np.full(len(windows), None, object)
    for places, matrix in matrices(windows, least):
        for i, result in zip(places, work(matrix), strict=True):
            out[i] = result
    return pd.Series(out)


def matrices(windows: pd.Series, least: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of the finite windows of each length from ``least`` on."""
    lengths: dict[int, list[int]] = {}
    arrays: dict[int, np.ndarray] = {}
    for i, w in enumerate(windows):
        if w is not None and len(w) >= least:
            values = np.asarray(w, dtype=object if isinstance(w, list) else None)
            values = values.astype(float) if values.dtype != float else values  # None becomes NaN
            if np.isfinite(values).all():
                arrays[i] = values
                lengths.setdefault(len(values), []).append(i)
    for places in lengths.values():
        yield np.array(places), np.stack([arrays[i] for i in places])
