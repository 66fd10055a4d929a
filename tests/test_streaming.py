import pytest

from parallaxa.streaming.cursor import Sink, micro_batches


def test_restart_between_rows_and_commit_publishes_once(spark, tmp_path):
    src, schema = tmp_path / "in", spark.createDataFrame([], "id bigint, v string").schema
    write = lambda a, b: spark.range(a, b).selectExpr("id", "'x' as v").coalesce(1).write.mode("append").parquet(str(src))
    write(0, 10)
    write(10, 20)
    sink, checkpoint = Sink(str(tmp_path / "out")), str(tmp_path / "cursor")

    class Broken(Sink):
        def publish(self, rows, batch_id):
            super().publish(rows, batch_id)
            raise RuntimeError("lost after the rows, before the commit")

    with pytest.raises(Exception, match="lost after the rows"):
        micro_batches(spark, str(src), schema, Broken(sink.path), checkpoint, lambda df: df, files_per_batch=1)
    micro_batches(spark, str(src), schema, sink, checkpoint, lambda df: df, files_per_batch=1)
    assert sorted(r.id for r in sink.read(spark, schema).collect()) == list(range(20))
    write(20, 25)
    micro_batches(spark, str(src), schema, sink, checkpoint, lambda df: df, files_per_batch=1)
    assert sorted(r.id for r in sink.read(spark, schema).collect()) == list(range(25))
    assert sink.read(spark, schema).select("batch_id").distinct().count() >= 3
