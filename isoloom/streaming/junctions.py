"""Junction counts over a stream of alignments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoloom.operators import junctions
from isoloom.schema import JunctionParams


def running_counts(aln: DataFrame, params: JunctionParams = JunctionParams()) -> DataFrame:
    """The junction table of a streaming DataFrame; write it in update or complete mode.

    The state is one row a junction, so it grows with the distinct junctions and not with the alignments.
    """
    rows = junctions.extract(aln, params)
    return junctions.count(rows.withColumns({"motif": F.lit(0), "strand": F.lit(0)}))
