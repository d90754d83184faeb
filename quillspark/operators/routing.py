"""Model calls routed to workers by weight, with bounded concurrency and another worker for what failed."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.session import materialize

#: Fixed value: most calls that one worker gets at a time.
MOST_SLOTS = 16


@dataclass
class Worker:
    name: str
    call: Callable[[pd.DataFrame], pd.DataFrame]
    capacity: int = 1
    enabled: bool = True


def worker_slots(workers: list[Worker]) -> list[str]:
    """The names of enabled workers, level by level: all once, then those with room for a second call, and so on."""
    able = [(w.name, max(1, min(MOST_SLOTS, w.capacity))) for w in workers if w.enabled and w.name.strip()]
    return [name for level in range(max((c for _, c in able), default=0)) for name, capacity in able if capacity > level]


def served(frames: Iterator[pd.DataFrame], calls: dict[str, Callable[[pd.DataFrame], pd.DataFrame]], batch: int) -> Iterator[pd.DataFrame]:
    """The answers to frames (slot, worker, ..), called batch by batch; one frame for all calls of one, as a frame costs more than a small batch."""
    for f in frames:
        for name, part in f.groupby("worker"):
            part, outs = part.drop(columns=["slot", "worker"]), []
            for i in range(0, len(part), batch):
                try:
                    out = calls[name](part.iloc[i : i + batch])
                except Exception:  # the next round takes the batch's rows
                    continue
                if len(out):
                    outs.append(out)
            if outs:
                yield pd.concat(outs, ignore_index=True).assign(worker=name)


def routed_calls(rows: DataFrame, key: str, workers: list[Worker], schema: str, batch: int = 16, place: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """§2.14: (answers with the columns worker and attempt, rows that no worker served).

    Rows are dealt over the slots by `place` (a hash of the key by default). A slot is a partition whose batches are called one
    after the other, so a worker never has more calls at a time than slots. Rows that a call raised on, or gave no row for, go to a slot
    of a worker that has not had them yet, in a round of its own, until every worker has. key is a column of schema, distinct in rows.
    """
    calls = {w.name: w.call for w in workers}
    slots = worker_slots(workers)
    place = F.xxhash64(key) if place is None else place

    left = rows.withColumn("tried", F.array().cast("array<string>"))
    found = []
    for attempt in range(len(set(slots))):
        free = [F.struct(F.lit(i).alias("slot"), F.lit(name).alias("worker")) for i, name in enumerate(slots)]
        open_ = F.filter(F.array(*free), lambda s: ~F.array_contains(F.col("tried"), s.worker))
        dealt = left.withColumn("open", open_).withColumn("s", F.element_at("open", (F.pmod(place, F.size("open")) + 1).cast("int"))).select(*rows.columns, "tried", "s.slot", "s.worker")
        dealt = materialize(dealt)
        got = dealt.drop("tried").repartitionById(len(slots), F.col("slot")).mapInPandas(lambda frames: served(frames, calls, batch), f"{schema}, worker string")
        got = materialize(got.withColumn("attempt", F.lit(attempt + 1)))
        found.append(got)
        left = dealt.join(got.select(key).distinct(), key, "left_anti").select(*rows.columns, F.concat("tried", F.array("worker")).alias("tried"))
        left = materialize(left)
        if not left.limit(1).count():
            break
    if not found:
        found = [rows.sparkSession.createDataFrame([], f"{schema}, worker string, attempt int")]
    return reduce(lambda a, b: a.unionByName(b), found), left.drop("tried")
