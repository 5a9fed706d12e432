"""What executors hold beside the JVM's heap: the batches that go to Python, and what workers keep of their arrays."""

import os
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from graphloom.llm import bpe
from graphloom.llm.text import arrow_map


def test_batches_are_bounded_by_bytes(spark):
    docs = spark.range(0, 3000, 1, 1).selectExpr("id as doc_id", "repeat('word and ', 2000) as text")
    seen = arrow_map(docs, lambda: lambda b: pa.record_batch({"n": [b.num_rows], "size": [b.nbytes]}), "n bigint, size bigint").collect()
    assert sum(r.n for r in seen) == 3000 and max(r.size for r in seen) < 8 << 20
    groups = docs.withColumn("k", F.lit(1)).groupBy("k").applyInArrow(lambda t: pa.table({"n": [t.num_rows]}), "n bigint").collect()
    assert [r.n for r in groups] == [3000]  # a group stays whole


def test_the_session_may_bound_batches(spark):
    key, docs = "spark.sql.execution.arrow.maxBytesPerBatch", spark.range(0, 3000, 1, 1).selectExpr("id as doc_id", "repeat('word and ', 200) as text")
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(1 << 20))
    try:
        seen = arrow_map(docs, lambda: lambda b: pa.record_batch({"size": [b.nbytes]}), "size bigint").collect()
        assert max(r.size for r in seen) < 1.1 * (1 << 20) and spark.conf.get(key) == str(1 << 20)
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def test_workers_give_memory_back(spark):
    def make():
        kept = []

        def f(b):
            own = int(re.search(r"RssAnon:\s+(\d+)", Path("/proc/self/status").read_text())[1]) >> 10
            np.ones(1 << 20)  # from now on the C library keeps arrays of up to 8 MB
            held = [np.ones(1 << 19) for _ in range(50)]
            kept[:] = held[-1:]  # above the others, which so can't be cut off
            return pa.record_batch({"mb": [own]})

        return f

    first, *rest = (r.mb for r in arrow_map(spark.range(0, 30_000, 1, 1), make, "mb bigint").collect())  # 10,000 rows a batch
    assert len(rest) == 2 and max(rest) < first + 100, (first, rest)


def test_workers_drop_what_other_functions_keep(spark):
    one = spark.range(0, 1, 1, 1)

    def held():
        def f(b):
            import gc

            return pa.record_batch({"pid": [os.getpid()], "n": [sum(type(x).__name__ in ("Batches", "Prefixes") for x in gc.get_objects())]})

        return f

    def pid():
        codec = bpe.worker("test", {bytes([i]): i for i in range(256)})
        return lambda b: pa.record_batch({"pid": [os.getpid()], "n": [id(codec)]})

    def run(make, **how):
        return tuple(arrow_map(one, make, "pid bigint, n bigint", **how).collect()[0])

    encoders = {run(pid, keep="test") for _ in range(12)}
    assert len(encoders) == len({p for p, _ in encoders})  # made once a worker
    seen = dict(run(held) for _ in range(12))
    assert seen.keys() & {p for p, _ in encoders} and not any(seen.values()), (seen, encoders)
