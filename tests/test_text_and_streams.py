import numpy as np

from strandweave.sources import text
from strandweave.streaming.periods import stream_periods


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def put(path, name, content):
    path.mkdir(exist_ok=True)
    (path / name).write_text(content)
    return str(path)


def test_bed_modes(spark, tmp_path):
    p = put(tmp_path / "bed", "a.bed", "chrom x1 x2\nchr1 1 5 n 2\nchr1\t1\t5\tn\t2\nchr1 7 9\n1 2 3\nchr2 4 x\nchr9 1 2 m 9\nchr1 3 4 k\n")
    chroms = spark.createDataFrame([("chr1",)], "chrom string")
    assert rows(text.read_bed(spark, p, chroms)) == [("chr1", 1, 5, "n", 2.0), ("chr1", 3, 4, "k", None), ("chr1", 7, 9, None, None)]
    assert rows(text.read_bed(spark, p, above=2.0)) == [("chr9", 1, 2, "m", 9.0)]
    # the percentile is over all scored rows, repeated ones too: 2, 2, 9
    assert rows(text.read_bed(spark, p, percentile=60.0)) == [("chr9", 1, 2, "m", 9.0)]
    assert text.read_bed_simple(spark, p).count() == 5


def test_bedgraph_and_bedpe(spark, tmp_path):
    p = put(tmp_path / "bg", "a.bedgraph", "chr1 0 10 1.5\nchrU 0 10 2\nbad line\nchr1 10 20 x\n")
    assert [r[:4] for r in rows(text.read_bedgraph(spark, p, spark.createDataFrame([("chr1",)], "chrom string")))] == [("chr1", 0, 10, 1.5)]
    p = put(tmp_path / "pe", "a.bedpe", "#chr1\tstart1\tend1\tchr2\tstart2\tend2\tscore\tname\nchr1\t1\t2\tchr1\t3\t4\t7\t\n")
    assert rows(text.read_bedpe(spark, p)) == [("chr1", 1, 2, "chr1", 3, 4, {"score": "7"})] and text.read_bedpe(spark, p, attributes=False).columns[-1] == "end2"


def test_writers(spark, tmp_path):
    d = spark.createDataFrame([("chr2", 1, 5, 6), ("chr1", 0, 1, 2)], "chrom string, chr_index int, start bigint, end bigint")
    text.write_bed(d, str(tmp_path / "o"))
    assert spark.read.text(str(tmp_path / "o")).count() == 2
    bins = spark.createDataFrame([("chr1", 2, 1.5), ("chr1", 3, 0.0)], "chrom string, bin bigint, value double")
    assert rows(text.bedgraph_rows(bins, 10)) == [("chr1", 20, 30, 1.5)] and text.bedgraph_rows(bins, 10, zeros=True).count() == 2
    text.write_routed(d.withColumnRenamed("chrom", "route"), str(tmp_path / "r"), ["route"])
    assert (tmp_path / "r" / "route=chr1").is_dir()
    grid = spark.createDataFrame([(i, j, i * 3 + j) for i in range(3) for j in range(3)], "dx bigint, dy bigint, total bigint")
    text.write_grid(grid, str(tmp_path / "g.txt"), 1)
    assert np.array_equal(np.loadtxt(tmp_path / "g.txt"), np.arange(9.0).reshape(3, 3))
    scores = spark.createDataFrame([("upstream", "chr1", 4, 1.5)], "side string, chrom string, bin bigint, score double")
    assert rows(text.anchor_score_rows(scores, spark.createDataFrame([("chr1", 0)], "chrom string, chr_index int"), 100))[0][:6] == ("chr1", 400, 500, "upstream", 1.5, "+")


def test_stream_periods(spark, tmp_path):
    shape = "f string, start1 bigint, end1 bigint"
    first = [("a", 0, 10), ("a", 20, 30), ("b", 5, 6), ("a", None, 3)]
    for i, part in enumerate((first, [("a", 10, 20), ("a", 40, 50)])):
        spark.createDataFrame(part, shape).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        q = stream_periods(spark.readStream.schema(shape).json(str(tmp_path / "in")), ["f"], tile=1000).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(
            lambda df, n: df.write.mode("append").json(str(tmp_path / f"out{n}"))).trigger(availableNow=True).start()
        q.awaitTermination()
    got = rows(spark.read.json(str(tmp_path / "out0")).select("f", "kind", "start1", "end1"))
    assert got == [("a", "gap", 10, 20), ("a", "period", 0, 10), ("a", "period", 20, 30), ("b", "period", 5, 6)]
    assert rows(spark.read.json(str(tmp_path / "out1")).select("f", "kind", "start1", "end1")) == [("a", "gap", 30, 40), ("a", "period", 0, 30), ("a", "period", 40, 50)]


def test_streamed_periods_reach_over_tiles(spark, tmp_path):
    import random

    from strandweave.operators.periods import merge_intervals
    from strandweave.streaming.periods import streamed_periods

    rng = random.Random(8)
    data = [("a", 900, 1100), ("a", 3500, 3600), ("b", 5, 9), ("b", 0, 4_000_000), (None, 1, 2), ("a", None, 3)] + [("c", s, s + rng.randint(1, 900)) for s in (rng.randint(0, 90_000) for _ in range(120))]
    shape = "f string, start1 bigint, end1 bigint"
    for i in range(3):
        spark.createDataFrame(data[i::3], shape).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    got = rows(streamed_periods(stream, ["f"], tile=1000))
    assert got == rows(merge_intervals(spark.createDataFrame(data, shape), ["f"], tile=1000))
    assert [r[1:] for r in got if r[0] == "a"] == [("gap", 1100, 3500), ("period", 3500, 3600), ("period", 900, 1100)]


def written_lines(folder):
    return [line.split("\t") for part in sorted(folder.glob("part-*")) for line in part.read_text().splitlines()]


def test_order_of_written_rows(spark, tmp_path):
    import random

    rng = random.Random(9)
    index = {"chr1": 0, "chr2": 1, "chr3": 2, "chr11": 10, "chr12": 11}
    data = [(c, i, s, s + rng.randint(1, 50)) for c, i in index.items() for s in (rng.randint(0, 9999) for _ in range(300))]
    rng.shuffle(data)
    d = spark.createDataFrame(data, "chrom string, chr_index int, start bigint, end bigint").repartition(7)
    text.write_bed(d, str(tmp_path / "bed"))
    # the index compares as text: 10 and 11 come between 1 and 2
    assert [(c, int(s), int(e)) for c, s, e in written_lines(tmp_path / "bed")] == [(c, s, e) for c, _, s, e in sorted(data, key=lambda r: (str(r[1]), r[2], r[3]))]
    scores = spark.createDataFrame([(rng.choice(["upstream", "downstream"]), c, b, 1.0) for c in index for b in rng.sample(range(9999), 200)], "side string, chrom string, bin bigint, score double").repartition(5)
    chroms = spark.createDataFrame(list(index.items()), "chrom string, chr_index int")
    text.anchor_score_rows(scores, chroms, 100).write.csv(str(tmp_path / "scores"), sep="\t")
    got = [(index[r[0]], int(r[1])) for r in written_lines(tmp_path / "scores")]
    assert got == sorted(got) and len(got) == 1000


def test_a_grid_with_a_repeated_cell_is_an_error(spark):
    import pytest

    with pytest.raises(ValueError):
        text.grid_array(spark.createDataFrame([(0, 0, 1), (0, 0, 2)], "dx bigint, dy bigint, total bigint"), 1)


def test_scratch_removes_what_was_written_inside(spark):
    import os

    from strandweave.session import materialize, scratch, shared_dir

    with scratch(spark):
        kept = materialize(spark.range(5), "gone")
        assert kept.count() == 5
        path = kept.inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path)
    assert not os.path.exists(path) and os.path.isdir(shared_dir(spark).removeprefix("file://").removeprefix("file:"))
