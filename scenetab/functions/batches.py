"""Groups of rows inside tasks: many small ones at a time instead of a call for each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Whole groups of rows that come sorted by ``keys``, many at a time, with each row's group number; the last group of a batch waits for the next one."""
    held = None
    for pdf in batches:
        pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        if pdf.empty:
            continue
        new = np.zeros(len(pdf), bool)
        for k in keys:
            v, gap = pdf[k].to_numpy(), pdf[k].isna().to_numpy()
            new[1:] |= (v[1:] != v[:-1]) & ~(gap[1:] & gap[:-1])
        group = np.cumsum(new)
        end = int(np.searchsorted(group, group[-1]))
        if end:
            yield pdf.iloc[:end].reset_index(drop=True), group[:end]
        held = pdf.iloc[end:]
    if held is not None:
        yield held.reset_index(drop=True), np.zeros(len(held), np.int64)
