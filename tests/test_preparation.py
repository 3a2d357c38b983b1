import os
import random
import re

import pytest

from strandweave.operators import drift, periods, rejects

BED = "file_id string, chrom string, start1 bigint, end1 bigint, tile string, kind string"
CHROMS = "chrom string, chr_index int, length bigint, is_autosome boolean"


def bag(df):
    return sorted(map(tuple, df.collect()), key=repr)


# --- periods
def brute(rows):
    out = []
    for s, e in sorted(rows):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def test_interval_map_against_sorting():
    rng = random.Random(3)
    for _ in range(200):
        rows = [(s, s + rng.randint(1, 9)) for s in (rng.randint(0, 60) for _ in range(rng.randint(0, 25)))]
        m = periods.IntervalMap()
        for r in rows:
            m.insert(*r)
        assert [list(x) for x in zip(m.starts, m.ends)] == brute(rows)
        assert all(a < b for a, b in m.gaps())


def test_periods_over_tiles_nulls_and_clashing_columns(spark):
    rng = random.Random(5)
    rows = [("f", "chr1", s, s + rng.randint(1, 70), "x", "y") for s in (rng.randint(0, 2000) for _ in range(120))]
    dirt = [("f", "chr1", None, 5, "", ""), ("f", "chr1", 9, 9, "", ""), ("f", "chr1", 9, 2, "", ""), (None, "chr1", 1, 2, "", "")]
    df = spark.createDataFrame(rows + rows[:10] + dirt, BED).repartition(5)
    got = bag(periods.merge_intervals(df, ["file_id", "chrom"], tile=64))
    want = brute([r[2:4] for r in rows])
    assert got == sorted([("f", "chr1", "period", a, b) for a, b in want] + [("f", "chr1", "gap", a[1], b[0]) for a, b in zip(want, want[1:])], key=repr)


def test_touching_intervals_and_names(spark):
    df = spark.createDataFrame([("f", " CHR2", 0, 10, "", ""), ("f", "2", 10, 20, "", ""), ("f", "chr9x", 1, 2, "", ""), ("f", None, 1, 2, "", "")], BED)
    chroms = spark.createDataFrame([("chr2", 1, 100, True)], CHROMS)
    assert bag(periods.bed_periods(df, chroms)) == [("f", "chr2", "period", 0, 20)]
    assert bag(periods.bed_periods(df.limit(0), chroms)) == []


# --- rejected lines
def lines(spark, raws):
    return spark.createDataFrame([(i, "f", i, r, 1) for i, r in enumerate(raws)], "line_id bigint, file_id string, line_no bigint, raw string, column int")


def test_reasons(spark):
    chroms = spark.createDataFrame([("chr1", 0, 1000, True)], CHROMS)
    cases = {
        "chr1\t1\t2": None, "chr1\t1\t2\r": None, ' chr1 \t 1\t2': None, '"chr1"\t"1"\t"2"\t"a\tb"\t"1.5"': None, 'chr1\t1\t2\t"say ""x"""\t.5': None, 'chr1\t1\t2\t""\t5.': None,
        'chr1\t1\t2\t"open\t3': "quoting", 'chr1\t1\t2\t"x"y\t3': "quoting", 'chr1\t1\t2\ta"b\t3': "quoting", 'chr1\t1\t2\t"a""\t3': "quoting", 'chr1\t1\t2\t "a"\t3': "quoting",
        "chr1\t1": "columns", "chr1\t1\t2\tn": "columns", "chr1\t1\t2\tn\t3\t": "columns", "chr1": "columns",
        "Chr1\t1\t2": "value", "chr1\t-1\t2": "value", "chr1\t1\t1": "value", "chr1\t1\t1001": "value", "chr1\t1\t1000": None, "chr1\t1\t２": "value", "chr1\t1\t99999999999999999999": "value",
        "chr1\t1\t2\tn\t": "value", "chr1\t1\t2\tn\tNaN": "value", "chr1\t1\t2\tn\t1e999": "value", "chr1\t1\t2\tn\t.": "value", "chr1\t1\t2\tn\t1e2": None, "chr1\t1\t2\t\t1": None,
        "": "skip", "  ": "skip", "\r": "skip", "#a": "skip", "track x": "skip", "browser y": "skip", "chrom\tx": "skip",
    }
    raws = [*cases, None, "chr1\t1\t2\t" + "n" * 300_000 + "\t1"]
    df = lines(spark, raws)
    got = {r["line_id"]: r["reason"] for r in rejects.rejected(df, chroms).collect()}
    assert {raws[i]: r for i, r in got.items()} == {k: v for k, v in cases.items() if v not in (None, "skip")}
    assert rejects.loaded(df, chroms).count() == sum(v is None for v in cases.values()) + 1
    assert bag(rejects.rejected(df.limit(0), chroms)) == []


# --- drift
def sieve(spark, files):
    """files: (file_id, stem, seq, header fields, rows of values); one loop per row number."""
    head = ["chr1", "start1", "end1", "chr2", "start2", "end2"]
    f = [(i, s, q, 0) for i, s, q, _, _ in files]
    ls = []
    for i, _, _, names, rows in files:
        ls.append((i, 1, "#" + "\t".join(head + names), "x"))
        ls += [(i, n + 2, "\t".join(["chr1", str(n), str(n + 1), "chr1", str(n + 5), str(n + 6), *r]), "x") for n, r in enumerate(rows)]
    return spark.createDataFrame(f, "file_id bigint, stem string, seq int, n int"), spark.createDataFrame(ls, "file_id bigint, line_no int, line string, path string")


def test_changes(spark):
    files, ls = sieve(spark, [
        (1, "s", 1, ["a", "b", "c", "e"], [["1", "x", "2.5", ""], ["2", "y", "NA", "."]]),
        (2, "s", 2, ["b", "a2", "c", "e"], [["x", "1", "7", "9"], ["y", "2", "8", "NaN"]]),  # a -> a2; c integer now; e gets its first type
        (3, "s", 3, ["a2", "c", "d"], [["1.5", "NA", "q"], ["2", "", "w"]]),  # b, e gone, d new; a2 decimal; c has no value
        (4, "s", 4, ["a2", "c", "d"], [["1", "3.5", "q"]]),  # a2 integer again; c decimal against what it was before the gap
        (5, "t", 1, ["z"], [["1"]]),
    ])
    want = {
        (2, "renamed", "a", "a2"), (2, "retyped", "c", "c"), (3, "removed", "b", ""), (3, "removed", "e", ""), (3, "added", "", "d"), (3, "retyped", "a2", "a2"), (4, "retyped", "a2", "a2"), (4, "retyped", "c", "c"),
    }
    assert set(bag(drift.field_changes(files, ls.unionByName(ls)))) == want
    assert bag(drift.field_changes(files.limit(0), ls)) == [] and bag(drift.field_changes(files, ls.limit(0))) == []
    table = drift.typed_table(files, ls, {"a": "own"}).collect()
    assert {(r["file_id"], r["line_no"]): r["own"] for r in table if r["file_id"] in (1, 2)} == {(1, 2): 1.0, (1, 3): 2.0, (2, 2): 1.0, (2, 3): 2.0}
    assert all(r["failed_casts"] == [] for r in table)


def test_failed_casts_and_odd_headers(spark):
    files, ls = sieve(spark, [(1, "s", 1, ["a", "a"], [["1", "7"], ["2"], ["x", "1", "9"], ["4"]]), (2, None, 1, ["a"], [["1"]])])
    rows = drift.typed_table(files, ls).collect()
    assert sorted(x for r in rows for x in r["failed_casts"]) == ["a=x"] and {r["integers"].get("a") for r in rows} == {1, 2, 4, None}


def whole(rows, key=("f", "chr1")):
    want = brute(rows)
    return sorted([(*key, "period", a, b) for a, b in want] + [(*key, "gap", a[1], b[0]) for a, b in zip(want, want[1:])], key=repr)


def test_long_intervals(spark):
    rng = random.Random(6)
    big = 9_000_000_000_000_000_000
    for extra in ([(100, big)], [(-5, 1 << 40)], [(1000, 10**7), (10**7 + 3, 10**9), (10**9, big), (64, 65)], [(0, 64 * 1030), (64 * 1030, 64 * 3000)]):
        rows = [(s, s + rng.randint(1, 70)) for s in (rng.randint(0, 200_000) for _ in range(300))] + extra
        df = spark.createDataFrame([("f", "chr1", *r, "x", "y") for r in rows], BED).repartition(3)
        assert bag(periods.merge_intervals(df, ["file_id", "chrom"], tile=64)) == whole(rows)


def test_merging_beside_the_input():
    import pyarrow as pa

    rng = random.Random(7)
    rows = [(rng.choice("ab"), rng.choice([None, 0, 1]), s, s + rng.randint(1, 9)) for s in (rng.randint(0, 300) for _ in range(400))]
    got = periods.merged(pa.table(dict(zip(("k", "tile", "s", "e"), zip(*rows)))), ["k"]).to_pylist()
    want = [(k, t, *r) for k in "ab" for t in (None, 0, 1) for r in brute([x[2:] for x in rows if x[:2] == (k, t)])]
    assert sorted((tuple(r.values()) for r in got), key=repr) == sorted(want, key=repr)


# --- the typed table against a plain version, over the whole smallest tables
def plain_table(files, lines):
    """(file, line_no) -> {field: (type, text)}, with the changes found as in test_changes' definition."""
    missing = {"", "NA", "NaN", "."}
    heads, body = {}, {}
    for i, n, line in lines:
        cells = line.removesuffix("\r").split("\t")
        if n == 1:
            heads[i] = list(dict.fromkeys(cells[6:])), [(c, k) for k, c in enumerate(cells) if k >= 6 and c not in cells[6:k]]
        else:
            body.setdefault(i, []).append((n, cells))
    values = {i: [(n, "\t".join(c[:6]), {p: c[k] for p, k in heads[i][1] if k < len(c) and c[k] not in missing}) for n, c in rows] for i, rows in body.items() if i in heads}

    def kind(t):
        return "integer" if re.fullmatch(r"[+-]?[0-9]+", t) else "decimal" if re.fullmatch(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?", t) else "text"

    out = {}
    for stem in {s for _, s, _ in files}:
        order = [i for i, s, _ in sorted(files, key=lambda f: (f[2], f[0])) if s == stem]
        held, used, names, counts, before = {}, {}, {}, {}, None
        for i in order:
            fields = heads.get(i, ([], []))[0]
            old = heads.get(before, ([], []))[0] if before is not None else []
            by_loop = [{}, {}]
            for side, f in ((0, before), (1, i)):
                for _, loop, v in values.get(f, []):
                    for p, t in v.items():
                        by_loop[side].setdefault((loop, p), set()).add(t)
            renamed = {}
            for g in sorted(set(old) - set(fields)):
                for q in sorted(set(fields) - set(old)):
                    both = [(t, by_loop[1][loop, q]) for (loop, p), t in by_loop[0].items() if p == g and (loop, q) in by_loop[1]]
                    if both and all(len(a | b) == 1 for a, b in both):
                        renamed.setdefault(q, g)
            for p in sorted(set(fields) - set(old) if before is not None else fields, key=lambda p: (p not in renamed, p)):
                field = held.pop(renamed[p], None) if p in renamed else held.get(p)
                if field is None:
                    used[p] = used.get(p, 0) + 1
                    field = p if used[p] == 1 else f"{p}#{used[p]}"
                held[p] = field
            names[i] = {p: held[p] for p in fields}
            for _, _, v in values.get(i, []):
                for p, t in v.items():
                    counts.setdefault(names[i][p], []).append(kind(t))
            before = i
        types = {f: "text" if ks.count("text") > 0.5 * len(ks) else "decimal" if "decimal" in ks else "integer" for f, ks in counts.items()}
        for i in order:
            for n, _, v in values.get(i, []):
                out[i, n] = {names[i][p]: (types[names[i][p]], t) for p, t in v.items()}
    return out


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
def test_typed_table_against_a_plain_version(spark):
    files, ls = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("sieve_files", "sieve_lines"))
    want = plain_table([tuple(r) for r in files.select("file_id", "stem", "seq").distinct().collect()], [tuple(r) for r in ls.select("file_id", "line_no", "line").collect()])
    rows = drift.typed_table(files, ls).collect()
    assert {(r["file_id"], r["line_no"]) for r in rows} == set(want)
    for r in rows:
        cells = want[r["file_id"], r["line_no"]]
        fails = {f"{f}={t}" for f, (k, t) in cells.items() if k != "text" and not (re.fullmatch(r"[+-]?[0-9]+", t) if k == "integer" else re.fullmatch(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?", t))}
        assert set(r["failed_casts"]) == fails
        ok = {f: (k, t) for f, (k, t) in cells.items() if f"{f}={t}" not in fails}
        assert r["integers"] == {f: int(t) for f, (k, t) in ok.items() if k == "integer"} and r["texts"] == {f: t for f, (k, t) in ok.items() if k == "text"}
        assert r["decimals"] == {f: float(t) for f, (k, t) in ok.items() if k == "decimal"}
