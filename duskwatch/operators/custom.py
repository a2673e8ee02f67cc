"""User code over records, for what built-in functions do not express."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Frames = Callable[[pd.DataFrame], pd.DataFrame]


def apply_rows(df: DataFrame, fn: Frames, schema: str) -> DataFrame:
    """User code over record batches; rows stay where they are."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield fn(frame)

    return df.mapInPandas(batches, schema)


def apply_group(
    df: DataFrame, keys: list[str], partial: Frames, merge: Frames, state: str, finish: Frames,
    schema: str, fold_every: int = 50, state_rows: int = 200_000,
) -> DataFrame:
    """User code over one host, run or tuple, given as parts that add up.

    Each function gets and returns a frame with the key columns that may hold many groups:
    ``partial`` turns records into state rows, ``merge`` folds the state rows of each group,
    ``finish`` makes the results from folded state. Records are folded where they are read, so
    a group that holds most of the data sends one state per task and is never collected; what a task
    has folded goes out once it has ``state_rows`` rows. States are merged in order of their keys, one
    group after the other, so a task holds a batch and the group at hand, however many groups it has.
    ``state`` and ``schema`` name the columns besides the keys.
    """
    key_ddl = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def folded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for frame in frames:
            if len(frame):
                held.append(partial(frame))
            if len(held) >= fold_every:
                held = [merge(pd.concat(held, ignore_index=True))]
            if sum(map(len, held)) >= state_rows:
                yield merge(pd.concat(held, ignore_index=True))
                held = []
        if held:
            yield merge(pd.concat(held, ignore_index=True))

    def finished(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # states of the group at hand
        for frame in frames:
            if not len(frame):
                continue
            if held and not _like(held[-1].iloc[-1], frame, keys).iloc[0]:
                yield finish(merge(pd.concat(held, ignore_index=True)))
                held = []
            last = _like(frame.iloc[-1], frame, keys)
            if not last.iloc[0]:
                # Groups that end in this frame, the one at hand with them.
                yield finish(merge(pd.concat([*held, frame[~last]], ignore_index=True)))
                held = []
            held.append(frame[last])
            if len(held) >= fold_every:
                held = [merge(pd.concat(held, ignore_index=True))]
        if held:
            yield finish(merge(pd.concat(held, ignore_index=True)))

    states = df.mapInPandas(folded, f"{key_ddl}, {state}")
    return states.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(finished, f"{key_ddl}, {schema}")


def _like(row: pd.Series, frame: pd.DataFrame, keys: list[str]) -> pd.Series:
    """Which rows have the keys of ``row``; missing keys equal each other."""
    same = pd.Series(True, index=frame.index)
    for k in keys:
        same &= frame[k].isna() if pd.isna(row[k]) else frame[k].eq(row[k])
    return same


def custom_agg(
    df: DataFrame, keys: list[str], sums: dict[str, Callable[[pd.DataFrame], pd.Series]],
    finish: Callable[[pd.DataFrame], pd.Series], name: str,
) -> DataFrame:
    """A user aggregate over sums: ``sums`` gives a number per record under each name, and
    ``finish`` makes the value of each group from the columns of their totals.

    Use the built-in aggregates where they do; they stay in the engine.
    """
    names = list(sums)

    def total(frame: pd.DataFrame) -> pd.DataFrame:
        return frame.groupby(keys, dropna=False, sort=False)[names].sum().reset_index()

    def partial(frame: pd.DataFrame) -> pd.DataFrame:
        return total(frame[keys].assign(**{n: fn(frame).astype("float64") for n, fn in sums.items()}))

    return apply_group(
        df, keys, partial, total, ", ".join(f"`{n}` double" for n in names),
        lambda frame: frame[keys].assign(**{name: finish(frame)}), f"`{name}` double")
