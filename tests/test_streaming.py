from tests.test_candidates import make, rows, table
from veilmatch import operators as ops
from veilmatch.functions import custom_blocking
from veilmatch.streaming import block_index, link_stream


def test_stream_equals_batch(spark, tmp_path):
    data = make(11)[:2]
    extra = [[[i % 3, i % 2] for i in range(len(d))] for d in data]
    t = table(spark, data, extra, "array<int>")
    t.where("dset_i = 1").repartition(3).write.parquet(str(tmp_path / "new"))
    stream = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "new"))
    found = link_stream(stream, block_index(t.where("dset_i = 0"), custom_blocking("v"), 4), custom_blocking("v"), 4, threshold=0.4)
    query = found.writeStream.format("memory").queryName("linked").trigger(availableNow=True).start()
    query.awaitTermination()
    want = rows(ops.find_candidate_pairs(t, "dice", 0.4, blocking=custom_blocking("v")))
    assert sorted(map(tuple, spark.table("linked").collect())) == sorted(want)
