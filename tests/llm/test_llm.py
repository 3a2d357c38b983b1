import random

import pytest

pytest.importorskip("strandweave.llm.queries")

from strandweave.llm import copies, feistel, mail, mixing, packing, pii, topn  # noqa: E402

REC = "record_id bigint, rec string, codes string, field string"


# --- copies
def test_copies_in_many_styles(spark):
    same = [
        "chr1=chr5;start1=4882000;score=-2.50;LIST_UID=U00X1;name=Loop batch 3, rep. A",
        "score = -2.50;name = Loop batch 3 rep A;start1 = 4_882_000;LIST UID = u00x1;chr1 = CHR5",
        '{"CHR1" : "chr5",\n"START1" : "4882000",\n"SCORE" : "-2.50",\n"LIST.UID" : "U00X1",\n"NAME" : "loop\tbatch 3, REP. A"}',
        "\tchr1:“chr5” ;  start1:4'882'000 ;  score:-2.50 ;  list-uid:U00X1 ;  name:“Loop  batch  3 - rep. A”.",
        'start1=4882000,score=-2.50,chr1=chr5,LISTUID=U00X1,name="Loop batch 3, rep. A",',
    ]
    other = [same[0].replace("-2.50", "2.50"), same[0].replace("-2.50", "-25.0"), same[0].replace("4882000", "4882001"), same[0].replace("chr1=chr5;", "")]
    rows = [(i, r, "", "") for i, r in enumerate([*same, *other, None, "", "nothing here", "x=" + "y" * 200_000])]
    df = spark.createDataFrame(rows, REC)
    assert sorted(map(tuple, copies.found_copies(df).collect())) == [(0, i) for i in range(1, 5)]
    assert sorted(r["n_copies"] for r in copies.distinct_records(df).collect()) == [1, 1, 1, 1, 1, 5]
    assert copies.found_copies(df.limit(0)).count() == 0
    assert sorted(map(tuple, copies.found_copies(df.unionByName(df)).collect())) == [(0, i) for i in range(1, 5)]


# --- top n
def test_top_n_ties_nulls_repeats(spark):
    rng = random.Random(1)
    nan = float("nan")
    rows = [(f"l{rng.randint(0, 2)}", i, rng.choice([1.0, 2.0, 3.0, None, nan]), rng.choice([0.5, 1.5, None, nan]), "x") for i in range(200)]
    df = spark.createDataFrame(rows + rows[:50], "g string, id bigint, score double, z double, rank string")
    got = sorted((r["g"], r["rank"], r["id"]) for r in topn.top_n(df, ["g"], "score", "z", "id", 5).collect())
    bad = lambda v: v is None or v != v
    want = []
    for g in ("l0", "l1", "l2"):
        best = sorted((r for r in rows if r[0] == g and not bad(r[2])), key=lambda r: (-r[2], bad(r[3]), 0 if bad(r[3]) else -r[3], r[1]))[:5]
        want += [(g, i + 1, r[1]) for i, r in enumerate(best)]
    assert got == want and topn.top_n(df.limit(0), ["g"], "score", "z", "id").count() == 0


def test_top_n_prunes_before_the_shuffle(spark, tmp_path):
    df = spark.range(1000).selectExpr("id % 3 AS g", "id", "CAST(id AS DOUBLE) AS score", "0.0D AS z")
    plan = topn.top_n(df, ["g"], "score", "z", "id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


# --- packing
@pytest.mark.parametrize("seed", range(4))
def test_pack_keeps_everything(seed):
    rng = random.Random(seed)
    items = [(i, rng.choice("abc"), rng.choice([0, 3, 40, 99, 100, 101, 250, rng.randint(1, 130)])) for i in range(300)]
    got = packing.pack(items, 100, {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 10.0})
    assert all(sum(p[5] for p in c) <= 100 for c in got)
    by = {}
    for c in got:
        for doc, source, piece, n, start, size in c:
            by.setdefault(doc, []).append((piece, start, size, n))
    assert set(by) == {i for i, _, _ in items}
    for i, _, t in items:
        pieces = sorted(by[i])
        assert sum(p[2] for p in pieces) == t and len(pieces) == max(1, -(-t // 100)) and all(p[1] == p[0] * 100 for p in pieces)
    assert sum(map(lambda x: x[2], items)) / (100 * len(got)) > 0.9


def test_pack_follows_shares():
    items = [(i, "a" if i % 2 else "b", 5) for i in range(2000)]
    got = packing.pack(items, 100, {"a": 0.5, "b": 0.5}, {})
    assert all(abs(sum(p[5] for p in c if p[1] == "a") - 50) <= 10 for c in got[:90])


def test_pack_frame(spark):
    rows = [(i, None if i == 3 else f"s{i % 3}", i % 37 * 5, "c") for i in range(500)] + [(3, None, 15, "c")]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint, container string")
    out = packing.pack_containers(df, {"x": 64, "y": 128}, block_tokens=9_000)
    for spec in ("x", "y"):
        assert out.filter(f"spec = '{spec}'").groupBy().sum("tokens").first()[0] == sum(r[2] for r in rows)
    assert out.filter("container_tokens > capacity").count() == 0 and packing.pack_containers(df.limit(0), {"x": 64}).count() == 0
    assert out.filter("n_pieces = 1 AND tokens > capacity").count() == 0 and out.select("container").distinct().count() == packing.fill_report(out).groupBy().sum("containers").first()[0]


# --- mixing
def test_plan_fills_up_and_caps():
    p = {x.source: x for x in mixing.plan({"a": (0.5, 1), "b": (0.4, 1), "c": (0.1, 3)}, {"a": 1000, "b": 1000, "c": 20}, 1000)}
    assert p["c"].demand == 60 and abs(sum(x.demand for x in p.values()) - 1000) < 1e-6 and abs(p["a"].demand / p["b"].demand - 1.25) < 1e-9
    assert all(x.start >= -1e-12 and x.end >= -1e-12 for x in p.values())
    assert abs(sum(x.start for x in p.values()) - 1) < 1e-9 and abs(sum(x.end for x in p.values()) - 1) < 1e-9
    assert mixing.plan({"a": (1.0, 1)}, {}, 100) == []


def test_mix_frame(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "b", "b", "b", "c", None, "zz"]), rng.randint(0, 50), "q") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint, bucket string")
    targets = spark.createDataFrame([("A ", 0.4, 3), ("b", 0.4, 1), ("C", 0.2, 2)], "source string, target_share double, max_repeats int")
    out = mixing.mix(df, targets)
    got = out.collect()
    assert [r["position"] for r in got] == sorted(r["position"] for r in got) and 0 <= got[0]["position"] and got[-1]["position"] <= 1
    assert {r["source"] for r in got} == {"a", "b", "c"} and len({(r["doc_id"], r["repeat_no"]) for r in got}) == len(got)
    report = {r["source"]: r for r in mixing.share_report(out, targets).collect()}
    assert all(r["most_repeats"] <= r["max_repeats"] for r in report.values()) and abs(sum(r["actual_share"] for r in report.values()) - 1) < 1e-9
    assert abs(report["b"]["actual_share"] - 0.4) < 0.1
    assert mixing.mix(df.limit(0), targets).count() == 0 and mixing.mix(df, targets.limit(0)).count() == 0


# --- pseudonyms
def test_feistel_is_a_permutation():
    for n in (1, 2, 7, 100, 1000):
        image = [feistel.permute(b"k", "t", i, n) for i in range(n)]
        assert sorted(image) == list(range(n)) and [feistel.permute(b"k", "t", y, n, inverse=True) for y in image] == list(range(n))


def test_pseudonyms_keep_format_and_invert():
    for v in ("+999 34 764 0569", "AB9025218", "12345678-X", "860213-4930", "(555) 678-9804"):
        p = feistel.pseudonym(b"key", "id", v)
        shape = lambda s: "".join("0" if c.isdigit() else "A" if c.isupper() else c for c in s)
        assert shape(p) == shape(v) and p != v and feistel.pseudonym(b"key", "id", p, inverse=True) == v
        assert p == feistel.pseudonym(b"key", "id", v) and p != feistel.pseudonym(b"other", "id", v)
    d = feistel.pseudonym(b"key", "id", "860213-4930")
    assert 1 <= int(d[2:4]) <= 12 and 1 <= int(d[4:6]) <= 31
    assert feistel.pseudonym(b"key", "phone", "+999 34 764 0569", 3).startswith("+999 ")


# --- e-mails
MESSAGE = """From: Kaquon Zimpegaarn <k.z@halden-core.example>
To: "Yorevrenne, Pénork" <py@umlaut.invalid>
Message-ID: <no.id@halden-core.example>
Subject: =?utf-8?B?cXVpY2sgQGEuYmI=?=
Content-Type: multipart/mixed; boundary="=_b"

--=_b
Content-Type: text/plain; charset="utf-8"
Content-Transfer-Encoding: quoted-printable

Present: P=C3=A9nork
> Yorevrenne and K. Zimpegaarn. Write to f [dot] o [at] hal-core [dot]
> example, or lu=40x.exa=
mple today. Call +999 34 764
0569 or (555) 678-9804 ext. 3. The part number is 180.180.7074 rev 3.
passport no., it is
> 66 422 813 040. Lot AB9025218. Ship to: 92 Silkwick Ave.,
Calborough, 89195
--=_b
Content-Type: text/html

<p>Calle Vastowmere n&ordm; 68, 69951 Toltierra<br>
q&#64;y.test</p>
--=_b
Content-Transfer-Encoding: base64

cGVyc29uQGV4YW1wbGUuY29t
--=_b--
"""
FOUND = {
    ("email", "k.z@halden-core.example"), ("email", "py@umlaut.invalid"), ("email", "f.o@hal-core.example"), ("email", "lu@x.example"), ("email", "q@y.test"), ("phone", "999347640569"), ("phone", "5556789804"), ("id", "66422813040"),
    ("address", "92 silkwick ave calborough 89195"), ("address", "calle vastowmere nº 68 69951 toltierra"), ("name", "kaquon zimpegaarn"), ("name", "yorevrenne pénork"), ("name", "pénork yorevrenne"), ("name", "k zimpegaarn"),
}


def mails(spark):
    docs = [(1, MESSAGE, "x", "y"), (1, MESSAGE, "x", "y"), (2, None, "", ""), (3, "", "", ""), (4, "nothing", "", ""), (5, "a " * 200_000 + "z@z.test", "", ""), (6, MESSAGE.replace("\n", "\r\n"), "", "")]
    known = spark.createDataFrame([("Kaquon",), (None,), ("Pénork",)], "given string")
    return spark.createDataFrame(docs, "doc_id bigint, text string, kind string, given string"), known


def test_found(spark):
    docs, known = mails(spark)
    got = {}
    for r in pii.find(docs, known).collect():
        got.setdefault(r["doc_id"], set()).add((r["kind"], r["pii_value"]))
    assert got[1] == FOUND and got[6] == FOUND and got[5] == {("email", "z@z.test")} and set(got) == {1, 5, 6}
    assert pii.find(docs.limit(0), known).count() == 0


def test_redacted(spark):
    docs, known = mails(spark)
    out = {r["doc_id"]: r for r in pii.redact(docs, known, b"key").collect()}
    assert out[2]["text"] is None and out[3]["text"] == "" and out[4]["text"] == "nothing"
    t = out[1]["text"]
    assert all(v not in t for v in ("Zimpegaarn", "Silkwick", "678-9804", "66 422", "k.z@", "Vastowmere")) and "no.id@halden-core.example" in t and "180.180.7074" in t
    assert t.count("[NAME ") == 4 and "[ADDRESS " in t and "[PHONE (" in t and "<p>" in t


def test_view_positions():
    v = mail.visible(MESSAGE)
    for i in range(0, v.size, 7):
        s, e = v.raw_span(i, i + 1)
        assert e - s != 1 or MESSAGE[s] == v.text[i]
    assert "cGVyc29u" not in v.text and "no.id" not in v.text


def test_top_n_prunes_before_its_only_shuffle(spark):
    rows = [(i % 3, i, float(i % 7), 0.0) for i in range(300)]
    df = spark.createDataFrame(rows * 40, "g bigint, id bigint, score double, z double").repartition(4)
    top = topn.top_n(df, ["g"], "score", "z", "id", 5)
    assert {tuple(r) for r in top.collect()} == {tuple(r) for r in topn.top_n(df, ["g"], "score", "z", "id", 5, repeats_agree=False).collect()}
    plan = [line for line in top._jdf.queryExecution().sparkPlan().toString().splitlines()]
    assert sum("WindowGroupLimit" in line for line in plan) == 2
    text = spark.range(900).selectExpr("id % 3 AS g", "id", "CAST(id AS DOUBLE) AS score", "0.0D AS z").transform(lambda d: topn.top_n(d, ["g"], "score", "z", "id", 5))
    steps = [s for line in text._jdf.queryExecution().executedPlan().toString().splitlines() for s in ("Exchange", "WindowGroupLimit") if s in line]
    assert steps == ["WindowGroupLimit", "Exchange", "WindowGroupLimit"]
    differ = spark.createDataFrame([("a", 1, 9.0, 0.0), ("a", 1, 8.0, 0.0), ("a", 2, 7.0, 0.0)], "g string, id bigint, score double, z double")
    assert [(r["id"], r["score"]) for r in topn.top_n(differ, ["g"], "score", "z", "id", 2, repeats_agree=False).orderBy("rank").collect()] == [(1, 9.0), (2, 7.0)]


def test_canonical_values(spark):
    field = {"s": "score", "p": "start1"}
    cases = [
        ("s", ["1,234.5", "1234.5", "+1234.50", '"1 234.5"', "1.2345e3", "1234.5."], 1), ("s", ["1,234.5", "1,999.5", "1999", "1,5", "15"], 5), ("s", ["NA", "n.d.", "", "-"], 4), ("s", ["−1.5", "-1.5", "–1.50"], 1), ("s", ["-1.5", "1.5"], 2),
        ("s", ["0.5", ".5", "00.5", "5e-1"], 1), ("s", ["0", "-0.0", "0.000", "+0"], 1), ("s", ["1e40000", "1e40001"], 2), ("p", ["-5", "5"], 2), ("p", ["4882000", "4_882_000", "4'882'000", "4.882.000", "4,882,000", "04882000", "“4 882 000”"], 1), ("p", ["12.5", "125"], 2),
        ("p", ["", "x", "y"], 3),
    ]
    df = spark.createDataFrame([(i, field[f], v) for i, (f, vs, _) in enumerate(cases) for v in vs], "i int, raw_field string, raw_value string")
    from pyspark.sql import functions as F

    got = copies.canonical(df).withColumnRenamed("value", "v").groupBy("i").agg(F.count_distinct("v").alias("n"), F.collect_set("v").alias("v"), F.count("v").alias("all")).collect()
    assert {r["i"]: r["n"] for r in got} == {i: n for i, (_, _, n) in enumerate(cases)}, got
    assert {r["i"]: r["all"] for r in got} == {i: len(vs) for i, (_, vs, _) in enumerate(cases)}


def test_long_field_names_and_common_values(spark):
    for n in (38, 41, 42, 4000):
        rows = [(1, f"chr1=chr5;{'f' * n}=7", "", ""), (2, f"{'F' * n} : 7, CHR1 : chr5", "", ""), (3, f"chr1=chr5;{'f' * n}=8", "", "")]
        assert list(map(tuple, copies.found_copies(spark.createDataFrame(rows, REC)).collect())) == [(1, 2)]
    many = spark.range(3000).selectExpr("id AS record_id", "concat('chr1=chr5;start1=', id % 1500) AS rec")
    found = copies.found_copies(many).collect()
    assert sorted(map(tuple, found)) == [(i, i + 1500) for i in range(1500)]
    codes = sorted(r["code"] for r in copies.dictionary(copies.cells(many)).select("code").distinct().collect())
    assert codes == list(range(1501))
