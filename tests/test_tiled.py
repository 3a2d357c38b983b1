import random

from pyspark.sql import functions as F

from strandweave.operators import tiled


def bag(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_islands_over_tiles(spark):
    rng = random.Random(1)
    bins = {(k, b) for k in "ab" for s in (rng.randint(-50, 400) for _ in range(25)) for b in range(s, s + rng.randint(1, 40))} | {("c", b) for b in range(200)} | {(None, 1), (None, 2)}
    want = []
    for k in ("a", "b", "c", None):
        own = sorted(b for x, b in bins if x == k)
        for b in own:
            if b - 1 not in own:
                last = b
                while last + 1 in own:
                    last += 1
                want.append((k, b, last, last - b + 1))
    df = spark.createDataFrame(list(bins), "k string, bin bigint")
    assert bag(tiled.islands(df, ["k"], tile=16)) == sorted(want, key=repr) and tiled.islands(df.limit(0), ["k"]).count() == 0


def test_halo_sees_what_a_whole_window_sees(spark):
    from pyspark.sql import Window

    rng = random.Random(2)
    df = spark.createDataFrame([(k, b, rng.random()) for k in "ab" for b in range(-20, 150)], "k string, bin bigint, value double")
    add = lambda w: {"x": F.lag("value", 3).over(w), "y": F.lead("value", 2).over(w), "z": F.max("value").over(w.rangeBetween(-3, 3))}
    assert bag(tiled.with_halo(df, ["k"], 3, add, tile=16)) == bag(df.withColumns(add(Window.partitionBy("k").orderBy("bin"))))


def test_running_sums_in_two_levels(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.randint(-99, 99), i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, s bigint, id bigint")
    got = {r["id"]: (r["before"], r["all"]) for r in tiled.running(df, ["k"], ["s", "id"], F.lit(2), total="all", tile=16).collect()}
    for k in ("a", "b", None):
        own = sorted(r[1:] for r in rows if r[0] == k)
        assert all(got[i] == (2 * n, 2 * len(own)) for n, (_, i) in enumerate(own))
    assert len(tiled.running(df, [], ["s", "id"], F.lit(1)).collect()) == 300
