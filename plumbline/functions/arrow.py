"""Python functions over Arrow arrays."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa


def map_distinct(values: pa.Array, f: Callable[[str], str | None]) -> pa.Array:
    """f of each string, called once for each distinct one of the batch; nulls stay null."""
    coded = values.cast(pa.string()).dictionary_encode()
    return pa.array([f(v) for v in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)
