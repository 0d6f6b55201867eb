"""State that is carried along a key's rows, in pieces of bounded size."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from ..staging import staged

#: Rows of a key that one group holds.
PIECE = 50_000


def carried(rows: DataFrame, key: str, order: list[str], columns: list[str], step: Callable, schema: str, piece: int = PIECE, beside: DataFrame | None = None, many: bool = False) -> DataFrame:
    """``rows`` with the columns of ``schema`` that ``step`` gives, row after row of each key, in ``order``.

    ``step(frame, state)`` gets ``columns`` of at most ``piece`` rows in order, and what it returned for the rows before (None
    at first); it returns a frame of the new columns, a row for each row, and a state that JSON can hold. All keys' first
    pieces are done side by side, then the second ones; keys with fewer rows than a piece take one round. A null key is a key.
    Rows come sorted by key in Arrow batches, and a task calls ``step`` key after key: a key is no group of Spark's, which
    would cost more than most keys' rows do, and its rows go through, so that nothing is joined to them afterwards.
    With ``beside`` (columns of its own, besides the key) ``step`` gets as a third argument what that holds for the key, once
    for each piece.

    With ``many``, ``step(frame, starts, ends, states, held, first)`` does the keys of a batch together: key ``i`` has the rows from
    ``starts[i]`` to ``ends[i]`` and the state ``states[i]``; what is beside it is row ``first[i]`` of ``held`` (-1: nothing). It returns the
    new columns by name and the keys' states. Its columns are numbers with fraction or have no nulls.
    """
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    numbered = staged(rows.withColumn("__n", n.cast("long")))
    added, paired = StructType.fromDDL(schema), beside is not None
    kinds = to_arrow_schema(added)
    out = StructType([*numbered.schema, *added, StructField("__state", StringType())])

    def through(body: pa.Table, heads: dict, flat: pd.DataFrame | None) -> pa.RecordBatch:
        """All keys of a table at once; ``heads``: by its number a key's state and which rows of ``flat`` are beside it."""
        starts = np.flatnonzero(_starts(body, key))
        ends, news, marks = [*starts[1:], len(body)], [], np.full(len(body), None, object)
        part = body.select(columns)
        if many:
            known = [heads.get(i, (None, (0, 0))) for i in range(len(starts))]
            states = [None if state is None else json.loads(state) for state, _ in known]
            made, states = step(part.to_pandas(), starts, np.asarray(ends), states, flat, [a if a < b else -1 for _, (a, b) in known])
            marks[np.asarray(ends) - 1] = [json.dumps(x) for x in states]
            return together(body, [made[f.name] for f in kinds], marks)
        # Nulls make pandas turn whole numbers into others: then key by key, so that no key's rows change another's.
        plain = not any(x.null_count and not (pa.types.is_floating(x.type) or pa.types.is_string(x.type)) for x in part.columns)
        frame = part.to_pandas() if plain else None
        for number, (a, b) in enumerate(zip(starts, ends, strict=True)):
            state, (u, v) = heads.get(number, (None, (0, 0)))
            own = frame.iloc[a:b] if plain else part.slice(a, b - a).to_pandas()
            beside_it = () if not paired else (flat.iloc[u:v] if u < v else pd.DataFrame(columns=wanted),)
            new, state = step(own.reset_index(drop=True), None if state is None else json.loads(state), *beside_it)
            news.append(new)
            marks[b - 1] = json.dumps(state)
        return together(body, [np.concatenate([x[f.name].to_numpy() for x in news]) for f in kinds], marks)

    def together(body: pa.Table, made: list[np.ndarray], marks: np.ndarray) -> pa.RecordBatch:
        arrays = [pa.Array.from_pandas(x, mask=pd.isna(x), type=f.type) for x, f in zip(made, kinds, strict=True)]
        return pa.RecordBatch.from_arrays([*(x.combine_chunks() for x in body.columns), *arrays, pa.array(marks, pa.string())], out.names)

    def whole(table: pa.Table) -> pa.RecordBatch | None:
        """Of whole keys, sorted; a key's head stands before its rows and may stand alone."""
        head = pc.less(table["__n"], 0).to_numpy()
        body = table.filter(pa.array(~head)).select(numbered_names)
        if not len(body):
            return None
        group = np.cumsum(_starts(table, key)) - 1
        number = {g: i for i, g in enumerate(np.unique(group[~head]))}
        at = [i for i in np.flatnonzero(head) if group[i] in number]
        tops = table.take(pa.array(at, pa.int64()))
        states, heads, flat, upto = tops["__state"].to_pylist(), {}, None, np.zeros(len(at) + 1, int)
        if paired:
            lists = tops["__held"].combine_chunks()
            flat = pa.Table.from_struct_array(lists.flatten()).to_pandas()
            upto = np.cumsum([0, *(0 if x is None else x for x in pc.list_value_length(lists).to_pylist())])
        for j, i in enumerate(at):
            heads[number[group[i]]] = (states[j], (upto[j], upto[j + 1]))
        return through(body, heads, flat)

    def run(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            cut = int(np.flatnonzero(_starts(table, key))[-1]) if len(table) else 0
            if cut and (made := whole(table.slice(0, cut))) is not None:
                yield made
            rest = table.slice(cut)
        if rest is not None and len(rest) and (made := whole(rest)) is not None:
            yield made

    last = numbered.agg(F.coalesce(F.max("__n"), F.lit(0))).first()[0] // piece
    numbered_names, wanted = numbered.columns, [] if beside is None else [x for x in beside.columns if x != key]
    tops = None if beside is None else beside.groupBy(key).agg(F.collect_list(F.struct(*wanted)).alias("__held"))
    done, state = [], None
    for p in range(last + 1):
        own = numbered if last == 0 else numbered.where(F.floor(F.col("__n") / piece) == p)
        own = own.withColumn("__state", F.lit(None).cast("string"))
        heads = state if tops is None else tops if state is None else state.join(tops.withColumnRenamed(key, "__k"), F.col(key).eqNullSafe(F.col("__k")), "left").drop("__k")
        if heads is not None:
            own = own.unionByName(heads.withColumn("__n", F.lit(-1).cast("long")), allowMissingColumns=True)
        done.append(staged(own.repartition(F.col(key)).sortWithinPartitions(key, "__n").mapInArrow(run, out)))
        state = done[-1].where("__state IS NOT NULL").select(key, "__state")
    return reduce(DataFrame.unionByName, done).drop("__state", "__n")


def _starts(table: pa.Table, key: str) -> np.ndarray:
    """Where another key begins; a null is a key."""
    k = table[key].combine_chunks()
    if not len(k):
        return np.zeros(0, bool)
    a, b = k.slice(0, len(k) - 1), k.slice(1)
    differs = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.not_equal(a.is_null(), b.is_null()))
    return np.concatenate([[True], differs.to_numpy(zero_copy_only=False)])
