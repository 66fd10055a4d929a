"""The N best items of every group by a mergeable, bounded aggregation."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a task holds before it prunes its heaps to the best N of each group.
BUFFER_ROWS = 65_536


def _codes(table: pa.Table, columns: Sequence[str]) -> np.ndarray:
    """Equal codes exactly for rows that agree in all columns, nulls included."""
    code = np.zeros(table.num_rows, dtype=np.int64)
    for name in columns:
        part = pc.dictionary_encode(table[name].combine_chunks(), null_encoding="encode")
        part = part.indices.to_numpy().astype(np.int64) if isinstance(part, pa.DictionaryArray) else part
        _, code = np.unique(code * (int(part.max(initial=0)) + 1) + part, return_inverse=True)
    return code


def keep_best(
    table: pa.Table, group: Sequence[str], order: Sequence[tuple[str, str]], unique: Sequence[str], n: str
) -> pa.Table:
    """The first n rows of each group by `order`, of rows with the same unique columns only the best."""
    work = table.append_column("__g", pa.array(_codes(table, group)))
    work = work.take(pc.sort_indices(work, sort_keys=[("__g", "ascending"), *order], null_placement="at_end"))
    _, first = np.unique(_codes(work, ["__g", *unique]), return_index=True)
    work = work.take(pa.array(np.sort(first)))
    g = work["__g"].to_numpy()
    starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, dtype=np.int64)
    place = np.arange(len(g)) - np.repeat(starts, np.diff(np.r_[starts, len(g)]))
    return work.filter(pa.array(place < work[n].to_numpy())).drop_columns(["__g"])


def _heaps(group, order, unique, n, sorted_by_group):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            if held.num_rows < BUFFER_ROWS:
                continue
            last = held.slice(held.num_rows - 1).select(group)
            held = keep_best(held.combine_chunks(), group, order, unique, n)
            if sorted_by_group:  # every group but the last is complete
                same = _codes(pa.concat_tables([last, held.select(group)]), group)
                going_on = same[1:] == same[0]
                yield from held.filter(pa.array(~going_on)).to_batches()
                held = held.filter(pa.array(going_on))
            elif held.num_rows > BUFFER_ROWS // 2:  # many groups: hand on what there is, later heaps merge it
                yield from held.to_batches()
                held = None
        if held is not None and held.num_rows:
            yield from keep_best(held.combine_chunks(), group, order, unique, n).to_batches()

    return run


def top_n(
    df: DataFrame, group: Sequence[str], order: Sequence[tuple[str, str]], unique: Sequence[str], n: str
) -> DataFrame:
    """The first `n` (an integer column, equal within a group) items of each group by `order`.

    `order` lists (column, "ascending" or "descending"), the score first; nulls in it sort last; `unique` names the
    item and, ascending, ends the order, so that ties have one result. Items delivered more than once count once, with
    their best row. Rows whose first order column is null or NaN, or whose unique columns are null, take no part; null
    group values form a group. A group without items, or an n below 1 or null, gives no rows. Columns not named here
    are not read.

    Each task keeps at most n rows of a group in its bounded heaps and hands only those to the shuffle; the same heaps
    merge them afterwards, over rows sorted by group, so that neither side ever holds a whole group.
    """
    group, unique = list(group), list(unique)
    order = [*order, *((u, "ascending") for u in unique if u not in {c for c, _ in order})]
    score = order[0][0]
    columns = list(dict.fromkeys([*group, *(c for c, _ in order), *unique, n]))
    rows = df.select(columns).where(F.col(score).isNotNull()).where(F.col(n) > 0)
    if dict(df.dtypes)[score] in ("double", "float"):
        rows = rows.where(~F.isnan(score))
    for u in unique:
        rows = rows.where(F.col(u).isNotNull())
    schema = rows.schema
    partial = rows.mapInArrow(_heaps(group, order, unique, n, False), schema)
    merged = partial.repartition(*[F.col(c) for c in group]).sortWithinPartitions(*group)
    return merged.mapInArrow(_heaps(group, order, unique, n, True), schema)
