from pyspark.sql import functions as F

from scenegrid.streaming import log

SCHEMA = "scene_id bigint, event_id bigint, object_id bigint, ts timestamp, dx double, dy double, base bigint"


def run(spark, tmp_path, batches, query, mode):
    source = tmp_path / "in"
    source.mkdir()
    stream = spark.readStream.schema(SCHEMA).parquet(str(source))
    name = f"t_{tmp_path.name}".replace("-", "_")
    out = query(stream).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        for rows in batches:
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
            out.processAllAvailable()
        return spark.table(name).collect()
    finally:
        out.stop()


def row(spark, scene, event, obj, hour, dx, base):
    ts = spark.range(1).select(F.to_timestamp(F.lit(f"2024-01-01 {hour:02d}:10:00"))).first()[0]
    return (scene, event, obj, ts, float(dx), 0.0, base)


def test_windows_close_behind_the_watermark(spark, tmp_path):
    first = [row(spark, 1, 1, 7, 1, 2, 0), row(spark, 1, 2, 7, 1, 3, 0), row(spark, 1, 3, 8, 2, 1, 0)]
    later = [row(spark, 1, 4, 7, 9, 1, 0)]
    late = [row(spark, 1, 5, 7, 1, 100, 0), row(spark, 1, 6, 9, 15, 1, 0)]
    got = run(spark, tmp_path, [first, later, late], log.moves_per_window, "append")
    sums = {(r.start.hour, r.object_id): r.dx for r in got}
    assert sums[(1, 7)] == 5 and sums[(2, 8)] == 1 and (15, 9) not in sums


def test_revisions_are_guarded_across_batches(spark, tmp_path):
    batches = [[row(spark, 1, 1, 7, 1, 0, 0), row(spark, 1, 2, 7, 2, 0, 0), row(spark, 2, 3, 7, 1, 0, 4)], [row(spark, 1, 4, 7, 3, 0, 1)]]
    got = run(spark, tmp_path, batches, log.guard_revisions, "update")
    last = max((r for r in got if r.scene_id == 1), key=lambda r: r.n_accepted)
    assert (last.n_accepted, last.n_stale, last.revision) == (2, 1, 2)
    assert [(r.n_accepted, r.n_stale) for r in got if r.scene_id == 2] == [(0, 1)]
