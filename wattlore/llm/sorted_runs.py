"""Rows sorted over all partitions by a key: what a task can finish alone, and what goes on in other partitions."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import shuffle_parts


def sort_all(df: DataFrame, keys: list[str], within: list[str]) -> DataFrame:
    """df dealt by ranges of keys and sorted in each partition by within; both with nulls first. Take short keys: the driver samples them."""
    first = lambda cols: [F.col(c).asc_nulls_first() for c in cols]
    return df.repartitionByRange(shuffle_parts(df.sparkSession), *first(keys)).sortWithinPartitions(*first(within))


def sort_conversations(turns: DataFrame, *keep: str) -> DataFrame:
    """Columns keep (all by default) of turn rows (conv_id, turn, role, text, others), by conversation, turn, role and text over all partitions.

    A conversation of any size is dealt over as many partitions as it needs. Ties of turn and role go by the text's first
    64 characters, then by its hash; rows equal in all these are dealt by a number of their own.
    """
    keyed = turns.withColumns({"_head": F.substring("text", 1, 64), "_hash": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    keys = ["conv_id", "turn", "role", "_head", "_hash", "_row"]
    wanted = list(keep or turns.columns)
    return sort_all(keyed.select(*dict.fromkeys([*keys, *wanted])), keys, keys).select(*wanted)


def _lead(col: pa.ChunkedArray, value: object) -> int:
    """How many rows of a sorted column are equal to value."""
    if value is None:
        return col.null_count
    return pc.sum(pc.equal(col, value)).as_py() or 0


def runs(batches: Iterable[pa.RecordBatch], key: str, rows: int = 4096, size: int = 16 << 20) -> Iterator[tuple[pa.Table, bool]]:
    """(table, edge) of a partition that is sorted by key.

    edge False: some keys with all their rows, none of which can lie in another partition. edge True: rows of one key that may
    have more, elsewhere or in the tables that follow: the partition's first and last key, and keys with more rows or bytes than given.
    """
    carry, edges, began = None, set(), False
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([carry, t]) if carry is not None else t
        carry = None
        if not t.num_rows:
            continue
        if not began:
            edges.add(t[key][0].as_py())
            began = True
        lead = t[key][0].as_py()
        n = _lead(t[key], t[key][-1].as_py())
        head, tail = t.slice(0, t.num_rows - n), t.slice(t.num_rows - n)
        if head.num_rows and lead in edges:
            m = _lead(head[key], lead)
            yield head.slice(0, m), True
            head = head.slice(m)
        if head.num_rows:
            yield head, False
        if n >= rows or tail.nbytes >= size:
            edges.add(tail[key][0].as_py())
            yield tail, True
        else:
            carry = tail
    if carry is not None:
        yield carry, True
