from kmerloom.config import Config
from kmerloom.operators.filter import KmerFilter
from kmerloom.session import ship
from kmerloom.sources import fastx
from kmerloom.streaming import streams

TEST = Config(5, 4, 3, 4)


def shards(df):
    return sorted(tuple(r) for r in df.select("shard", "w0", "w1", "w2", "w3").collect())


def test_stream_builds_what_a_batch_builds(spark, tmp_path):
    ship(spark)
    src = tmp_path / "src"
    src.mkdir()
    for i, s in enumerate(["ACGTACGTACGTACGT", "TGCATGCATTGCA", "GGGAAAACCCTTA"]):
        (src / f"{i}.fa").write_text(f">r{i}\n{s}\n")
    spark.dataSource.register(fastx.FastxDataSource)
    stream = spark.readStream.format("fastx").option("filesPerTrigger", 1).load(str(src))
    whole = KmerFilter.build(fastx.read(spark, str(src)), TEST, 1 << 12)
    q = streams.build_into(stream, TEST, 1 << 12, str(tmp_path / "f"), str(tmp_path / "c"), processingTime="0 seconds")
    q.processAllAvailable()
    q.stop()
    assert shards(streams.open_built(spark, TEST, 1 << 12, str(tmp_path / "f")).shards) == shards(whole.shards)
    q = streams.shard_stream(spark.readStream.format("fastx").load(str(src)), TEST, 1 << 12).writeStream.outputMode("complete").format("memory").queryName("stream_shards").start()
    q.processAllAvailable()
    q.stop()
    assert shards(spark.table("stream_shards")) == shards(whole.shards)


def test_stream_probes_a_filter(spark, tmp_path):
    df = spark.createDataFrame([(0, "ACGTACGTNACG"), (1, "TTTTTTTT")], "record_index bigint, sequence string")
    df.write.parquet(str(tmp_path / "p"))
    flt = KmerFilter.build(df.where("record_index = 0"), TEST, 1 << 12)
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "p"))
    got = []
    streams.consume(stream, flt, lambda rows: got.extend(rows.collect()), str(tmp_path / "c")).awaitTermination()
    assert {r.record_index: r.positive_kmers for r in got} == {r.record_index: r.positive_kmers for r in flt.query_records(df).collect()}
    q = streams.probe_stream(stream, flt).writeStream.format("memory").queryName("stream_hits").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("stream_hits").count() == flt.contains(df).count()
