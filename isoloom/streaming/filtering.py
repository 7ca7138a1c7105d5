"""The alignment filter over a stream: the best alignment of each read so far."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from isoloom.functions.attributes import path_name
from isoloom.operators import filtering
from isoloom.schema import FilterParams

#: What is kept of a read: its best alignment, that one's number among the read's, the second score, how many came.
STATE = "ord long, path long, score long, introns long, second long, seen long"


class _Best(StatefulProcessor):
    """One row of state a read, whatever the number of its alignments."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("best", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        old = self.held.get()
        best = tuple(old) if old is not None else (None, 0, None, 0, 0, 0)
        for part in rows:
            ord_, path, score, introns, second, seen = best
            # the first of equals wins; all others, and what is overtaken, compete for the second place
            frame = part.sort_values("ord", kind="stable").reset_index(drop=True)
            at = int(frame["score"].to_numpy().argmax())
            top = int(frame["score"][at])
            others = frame["score"].drop(at)
            rest = int(others.max()) if len(others) else 0
            if score is None or top > score:
                second = max(second, rest, 0 if score is None else score)
                ord_, path, score, introns = int(frame["ord"][at]), seen + at + 1, top, int(frame["introns"][at])
            else:
                second = max(second, top)
            best = (ord_, path, score, introns, second, seen + len(frame))
        self.held.update(best)
        yield pd.DataFrame([(key[0], *best)], columns=["qname", "ord", "path", "score", "introns", "second", "seen"])

    def close(self) -> None:
        pass


def running_best(aln: DataFrame, params: FilterParams = FilterParams()) -> DataFrame:
    """qname, kept_name, ord, score, second, kept: of each read that a batch brings alignments of, what the filter says
    after it. Write it in update mode to a table with the key ``qname``.

    ``kept_name`` is null where the read's best alignment is not kept (``kept`` false): a second one may take away what
    an earlier batch had let through. After the last batch the kept rows are those of ``filtering.best_of_names`` if the
    alignments of each name come in order, over the batches and within each by ``ord``; reads may be mixed. The state is
    one row a read in a RocksDB store (``spark.sql.streaming.stateStore.providerClass``), which survives restarts
    from the query's checkpoint. Unmapped and weak alignments count for nothing; a null name is a name.
    """
    rows = filtering.confident(aln, params).select("qname", "ord", F.col("score").cast("long").alias("score"), F.col("introns").cast("long").alias("introns"))
    told = rows.groupBy("qname").transformWithStateInPandas(_Best(), f"qname string, {STATE}", "Update", "None")
    clear = F.col("second").cast("float") < F.lit(params.second_ratio).cast("float") * F.col("score").cast("float")
    kept = clear & (F.col("introns") >= params.min_introns)
    return told.select("qname", F.when(kept, path_name(F.col("qname"), F.col("path"))).alias("kept_name"), "ord", "score", "second", kept.alias("kept"))
