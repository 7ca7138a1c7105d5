"""The views that the registered queries read."""

import pytest

from isoloom import views
from isoloom.sources import text


def parts(spark, folder, keys):
    """Parts of these keys; their bases in key order."""
    rows = [(k, None if k % 13 == 5 else k * 7 % 11) for k in keys]
    spark.createDataFrame(rows[::-1], "p_partkey long, p_size int").repartition(3).write.parquet(f"{folder}/part.parquet")
    return "".join("ACGT"[s % 4] for _, s in sorted(rows) if s is not None)


@pytest.mark.parametrize("keys", [range(3), range(1, 101), [*range(5000), *range(9000, 9100)], [10**12 + k * 10**6 for k in range(300)]])
def test_genome_of_any_keys(spark, tmp_path, keys):
    """Keys begin anywhere and have gaps; bases were once placed by their keys."""
    base = parts(spark, tmp_path, keys)
    whole = {r["chr"]: r["seq"] for r in text.fasta(spark, views.genome_file(spark, str(tmp_path))).collect()}
    assert whole == {f"chr{k + 1}": base * 20 for k in range(25)}
    lines = [r["value"] for r in views.genome_lines(spark, str(tmp_path), 3, 7).where("ord < 1000000 AND ord > 0").orderBy("ord").collect()]
    assert lines == [(base * 3)[a : a + 7] for a in range(0, 3 * len(base), 7)][: len(lines)] and lines
