"""The filter as a stream against the filter of the whole table, over micro-batches and a restart."""

import random

from pyspark.sql import functions as F

from isoloom.functions import cigar as cg
from isoloom.operators import filtering
from isoloom.schema import FilterParams
from isoloom.streaming.filtering import running_best

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KEY = "spark.sql.streaming.stateStore.providerClass"


def test_batches_and_a_restart_give_the_filter_of_the_whole(spark, tmp_path):
    rng = random.Random(4)
    rows = []
    for k in range(400):
        size = rng.choice([50, 100, 100, 150])
        cigar = rng.choice([f"{size}M", f"{size // 2}M90N{size // 2}M", f"{size}M", f"{size // 2}S{size // 2}M"])
        name = rng.choice([None, *"aab"]) if k % 3 == 0 else f"r{rng.randrange(150)}"
        rows.append((k, name, rng.choice([0, 0, 0, 4]), 0, "c", k, size, cigar, rng.choice([0, 0, 1, 5, 40]), None, 1))
    names = "ord long, qname string, flag int, tid int, chr string, pos int, l_qseq int, cigar string, nm int, xs string, nh int"
    whole = spark.createDataFrame(rows, names).withColumn("cigar", cg.parse(F.col("cigar"))).select(*[c.split()[0] for c in names.split(", ")])
    params = FilterParams(min_introns=0)
    expected = sorted((r["qname"] or "", r["ord"], r["score"], r["second"]) for r in filtering.best_of_names(filtering.confident(whole, params), params).collect())
    source, found = tmp_path / "in", {}
    before = spark.conf.get(KEY, None)
    spark.conf.set(KEY, ROCKS)

    def upsert(batch, _):
        found.update({r["qname"]: r for r in batch.collect()})

    try:
        done = 0
        for upto in (90, 91, 250, 400):  # each is a run of its own, continued from the checkpoint
            whole.where(f"ord >= {done} and ord < {upto}").coalesce(1).write.mode("append").parquet(str(source))
            done = upto
            stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
            run = running_best(stream, params).writeStream.outputMode("update").foreachBatch(upsert).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
            run.awaitTermination(120)
            assert run.exception() is None and not run.isActive
    finally:
        spark.conf.unset(KEY) if before is None else spark.conf.set(KEY, before)
    assert sorted((r["kept_name"] or "", r["ord"], r["score"], r["second"]) for r in found.values() if r["kept"]) == expected
    assert len(expected) > 50 and any(not r["kept"] for r in found.values())
