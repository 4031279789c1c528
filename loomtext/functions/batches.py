"""Arrow batches in stretches of bounded size: what a Python worker holds as objects doesn't grow with a batch.

Arrays are made of buffers, as `pa.array` and `to_numpy` would load pandas, which is about half of what an idle worker holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows of a stretch, and bytes unless one row has more; an item of a list counts as ITEM_BYTES.
PART_ROWS, PART_BYTES, ITEM_BYTES = 512, 1 << 19, 64


def _sizes(c: pa.Array) -> np.ndarray:
    n = pc.list_value_length(c) if pa.types.is_list(c.type) or pa.types.is_large_list(c.type) else pc.binary_length(c)
    return np.array([x or 0 for x in n.to_pylist()], np.int64) * (1 if pa.types.is_string(c.type) or pa.types.is_large_string(c.type) else ITEM_BYTES)


def stretches(*columns: pa.Array) -> Iterator[list[pa.Array]]:
    """Slices of the columns, side by side: every row once, in order."""
    size, at = np.cumsum(sum(_sizes(c) for c in columns)), 0
    while at < len(size):
        end = int(np.searchsorted(size, (size[at - 1] if at else 0) + PART_BYTES, side="right"))
        end = min(max(end, at + 1), at + PART_ROWS, len(size))
        yield [c.slice(at, end - at) for c in columns]
        at = end


def worked(f: Callable[..., Sequence], make: Callable[[Sequence], pa.Array], *columns: pa.Array) -> pa.Array:
    """What f gives for each stretch's values, a value per row, made into one array."""
    made = [make(f(*[c.to_pylist() for c in part])) for part in stretches(*columns)]
    return pa.concat_arrays(made) if made else make([])


def _bits(own: Sequence) -> pa.Buffer | None:
    there = [x is not None for x in own]
    return None if all(there) else pa.py_buffer(np.packbits(there, bitorder="little"))


def _ends(lengths: Sequence[int]) -> pa.Buffer:
    return pa.py_buffer(np.cumsum([0, *lengths]).astype(np.int32))


def strings(own: Sequence[str | None]) -> pa.Array:
    raw = [(x or "").encode() for x in own]
    return pa.StringArray.from_buffers(len(raw), _ends([len(x) for x in raw]), pa.py_buffer(b"".join(raw)), _bits(own))


def doubles(own: Sequence[float | None]) -> pa.Array:
    return pa.Array.from_buffers(pa.float64(), len(own), [_bits(own), pa.py_buffer(np.array([0.0 if x is None else x for x in own], np.float64))])


def ints(own: Sequence[int]) -> pa.Array:
    return pa.Array.from_buffers(pa.int32(), len(own), [None, pa.py_buffer(np.array(own, np.int32))])


def longs(own: Sequence[int]) -> pa.Array:
    return pa.Array.from_buffers(pa.int64(), len(own), [None, pa.py_buffer(np.array(own, np.int64))])


def lists(make: Callable[[Sequence], pa.Array]) -> Callable[[Sequence[Sequence]], pa.Array]:
    """A maker of lists from one of what they hold."""

    def made(own: Sequence[Sequence]) -> pa.Array:
        ends = pa.Array.from_buffers(pa.int32(), len(own) + 1, [None, _ends([len(x) for x in own])])
        return pa.ListArray.from_arrays(ends, make([x for row in own for x in row]))

    return made


def structs(**makes: Callable[[Sequence], pa.Array]) -> Callable[[Sequence[tuple]], pa.Array]:
    """A maker of structs, by the makers of their fields, from tuples."""
    return lambda own: pa.StructArray.from_arrays([make([row[i] for row in own]) for i, make in enumerate(makes.values())], list(makes))
