"""Whole groups of rows inside a task."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[pa.Table]:
    """Tables of about so many rows or more, from batches sorted by keys, that never cut a group in two."""
    held: pa.Table | None = None
    for batch in batches:
        more = pa.Table.from_batches([batch])
        held = more if held is None else pa.concat_tables([held, more])
        if held.num_rows < rows:
            continue
        last = [held[k][-1].as_py() for k in keys]
        cut = held.num_rows - 1
        while cut and [held[k][cut - 1].as_py() for k in keys] == last:
            cut -= 1
        if cut:
            yield held.slice(0, cut).combine_chunks()
            held = held.slice(cut)
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def _begins(t: pa.Table, keys: list[str]) -> np.ndarray:
    """The rows at which groups begin."""
    new = np.zeros(t.num_rows, bool)
    new[0] = True
    for k in keys:
        code = t[k].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


def groups_up_to(batches: Iterable[pa.RecordBatch], keys: list[str], rows: int, most: int) -> Iterator[tuple[pa.Table, np.ndarray | None]]:
    """As whole_groups, with the number of each row's group. Groups of more than ``most`` rows come in parts, as they are read, with None, so that a task never holds one."""
    held: pa.Table | None = None
    large: list | None = None

    def parts(t: pa.Table, end: bool) -> Iterator[tuple[pa.Table, np.ndarray | None]]:
        nonlocal held, large
        begins = _begins(t, keys)
        if large is not None and [t[k][0].as_py() for k in keys] == large:
            cut = int(begins[1]) if len(begins) > 1 else t.num_rows
            yield t.slice(0, cut).combine_chunks(), None
            t, begins = t.slice(cut), begins[1:] - cut
        cut = t.num_rows if end or not t.num_rows else int(begins[-1])
        if cut:
            yield t.slice(0, cut).combine_chunks(), np.searchsorted(begins, np.arange(cut), "right") - 1
        t = t.slice(cut)
        if t.num_rows > most:
            large = [t[k][0].as_py() for k in keys]
            yield t.combine_chunks(), None
            t = t.slice(t.num_rows)
        held = t if t.num_rows else None

    for batch in batches:
        if batch.num_rows:
            more = pa.Table.from_batches([batch])
            held = more if held is None else pa.concat_tables([held, more])
            if held.num_rows >= rows:
                yield from parts(held, False)
    if held is not None:
        yield from parts(held, True)
