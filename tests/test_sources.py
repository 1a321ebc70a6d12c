"""Files of the formats that the engine reads and writes."""

import struct

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tracklens.sources import files, records, runs, texts
from tracklens.streaming import streams

TEXT = "banner\nPoints=4\nPoint\tTime\tSpeed\n-\ts\tkm/h\n1\t0.00\t20\n2\t0.01\tbad\n3\t0.02\n4\t0.03\t17\n"


def test_text_runs(spark, tmp_path):
    (tmp_path / "V1_T2_R3.txt").write_text(TEXT)
    got = runs.read_runs(spark, str(tmp_path), ["Speed", "Absent"]).orderBy("seq").collect()
    assert [(r.Speed, r.Absent) for r in got] == [(20.0, None), (None, None), (17.0, None)]
    strict = runs.read_runs(spark, str(tmp_path), ["Speed"], strict=True).orderBy("seq").collect()
    assert [r.good for r in strict] == [True, False, False, True]
    p = runs.peek(spark, str(tmp_path)).first()
    assert (p.declared, p.channels, p.first_time, p.last_time) == (4, 3, 0.0, 0.03)


def test_specs_and_discovery(spark, tmp_path):
    (tmp_path / "V1_T2_R3.txt").write_text(TEXT)
    (tmp_path / "V1_T2_R3.spec").write_text("Type=one\nA=1\nA=2\n\nType=two\n")
    (tmp_path / "other.txt").write_text("x")
    got = {r.name: (r.value, r.types) for r in runs.read_specs(spark, str(tmp_path / "*.spec")).collect()}
    assert got == {"Type": ("one", ["one", "two"]), "A": ("1", ["one", "two"])}
    found = files.discover(files.inventory(spark, str(tmp_path))).collect()
    assert [(r.path.split("/")[-1], r.has_companion) for r in found] == [("V1_T2_R3.txt", True)]


def test_inspection(spark):
    d = spark.createDataFrame([("a", i, float(i if i != 3 else 9), 6) for i in range(5)], "k string, i int, t double, n int")
    r = runs.inspect(d, "k", "i", "t", "n").first()
    assert (r.rows_, r.truncated, r.monotonic, r.uniform, r.reasons) == (5, True, False, False, "truncated,not_monotonic,not_uniform")


def test_bytes_read_of_runs_do_not_depend_on_their_size(spark, tmp_path):
    def export(n, declared, wide=3):
        names = "\t".join(["Point", "Time", *[f"C{k}" for k in range(wide - 2)]])
        return f"banner\nPoints={declared}\n{names}\n-\n" + "".join(f"{i}\t{i * 0.01:.2f}\t{i % 7}\r\n" for i in range(n))

    (tmp_path / "small.txt").write_text(export(900, 900))
    (tmp_path / "large.txt").write_text(export(300_000, 300_001))
    (tmp_path / "wide.txt").write_text(export(4000, 4000, 3000))
    (tmp_path / "tail.txt").write_text(export(5000, 5000) + "end\tnone\n\n")
    (tmp_path / "short.txt").write_text("banner\nPoints=x\n")
    (tmp_path / "empty.txt").write_text("")
    got = {r.run.rsplit("/", 1)[1]: r for r in runs.peek(spark, str(tmp_path)).collect()}
    assert {k: (r.declared, r.channels, r.first_time, r.last_time) for k, r in got.items()} == {
        "small.txt": (900, 3, 0.0, 8.99), "large.txt": (300_001, 3, 0.0, 2999.99), "wide.txt": (4000, 3000, 0.0, 39.99), "tail.txt": (5000, 3, 0.0, 49.99), "short.txt": (None, 1, None, None),
    }
    assert got["large.txt"].taken == got["small.txt"].taken == 2 * runs.PEEK < got["wide.txt"].taken <= 8 * runs.PEEK
    g = {r.run.rsplit("/", 1)[1]: r for r in runs.inspect_files(spark, str(tmp_path), max_rows=500).collect()}
    assert (g["large.txt"].rows_, g["large.txt"].truncated, g["large.txt"].monotonic, g["large.txt"].uniform, g["large.txt"].reasons) == (500, True, True, True, "truncated")
    assert g["large.txt"].taken == g["tail.txt"].taken <= 3 * runs.PEEK and g["short.txt"].reasons == ""
    whole = {r.run.rsplit("/", 1)[1]: r for r in runs.inspect_files(spark, str(tmp_path), max_rows=5001).collect()}
    assert (whole["tail.txt"].rows_, whole["small.txt"].rows_, whole["small.txt"].truncated) == (5001, 900, False)
    with pytest.raises(ValueError, match="max_rows"):
        runs.inspect_files(spark, str(tmp_path), max_rows=0)


def test_runs_written_and_read(spark, tmp_path):
    rows = spark.createDataFrame([(u, i, i * 0.5, None if i == 3 else f"k{i}") for u in (7, 8) for i in range(6 - u % 2)], "u int, i int, t double, c string").repartition(3)
    runs.write_runs(rows, f"{tmp_path}/w", "u", ["i"], {"i": "-", "t": "s", "c": "m"})
    texts = {p.parent.name: p.read_text() for p in (tmp_path / "w").glob("u=*/part*")}
    assert texts["u=7"] == "export\nPoints=5\ni\tt\tc\n-\ts\tm\n0\t0.0\tk0\n1\t0.5\tk1\n2\t1.0\tk2\n3\t1.5\t\n4\t2.0\tk4\n" and len(texts) == 2
    back = runs.read_runs(spark, f"{tmp_path}/w/*/part*", ["t"])
    assert back.count() == 11 and back.agg(F.sum("t")).first()[0] == 12.5


def test_a_run_is_one_file(spark, tmp_path):
    """Rows and heads that come from shuffles of their own, and are coalesced apart, end in one file of each run."""
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    rows = spark.range(200_000).select((F.col("id") % 40).alias("u"), F.col("id").alias("t"))
    rows = rows.withColumn("i", F.row_number().over(Window.partitionBy("u").orderBy("t")))
    runs.write_runs(rows, f"{tmp_path}/w", "u", ["i"], {"i": "-", "t": "s"})
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert [len(list(p.glob("part*"))) for p in (tmp_path / "w").glob("u=*")] == [1] * 40
    got = runs.peek(spark, f"{tmp_path}/w").collect()
    assert {(r.declared, r.channels) for r in got} == {(5000, 2)} and {(r.first_time, r.last_time) for r in got} == {(float(u), 199_960.0 + u) for u in range(40)}


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(n, kind, body):
    return varint(n << 3 | kind) + (varint(len(body)) + body if kind == 2 else body)


def test_records_and_scenarios(spark, tmp_path):
    assert records.crc32c(b"123456789") == 0xE3069283
    state = field(2, 1, struct.pack("<d", 1.5)) + field(3, 1, struct.pack("<d", -2.0)) + field(9, 5, struct.pack("<f", 0.5)) + field(11, 0, b"\x01")
    track = field(1, 0, varint(300)) + field(2, 0, b"\x01") + field(3, 2, state)
    scenario = field(5, 2, b"case") + field(1, 2, struct.pack("<d", 0.1)) + field(2, 2, track) + field(99, 0, b"\x07")
    (tmp_path / "a.rec").write_bytes(records.frame(scenario) + records.frame(b""))
    got = records.read_scenarios(spark, str(tmp_path)).collect()
    assert [(r.scenario, r.track, r.kind, r.frame, r.t, r.x, r.y, r.vx, r.valid) for r in got] == [("case", 300, 1, 0, 0.1, 1.5, -2.0, 0.5, True)]
    assert records.read_records(spark, str(tmp_path), limit=1).count() == 1
    broken = bytearray(records.frame(scenario))
    broken[14] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        list(records.split_records(bytes(broken)))
    with pytest.raises(ValueError, match="cut short"):
        list(records.split_records(records.frame(scenario)[:-1]))


def test_csv_of_two_encodings(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("名,x\n甲,1\n".encode("utf-8-sig"))
    (tmp_path / "b.csv").write_bytes("名,y\n乙,2\n".encode("gb18030"))
    got = sorted((r["名"], r.x, r.y) for r in texts.read_csv_auto(spark, str(tmp_path)).collect())
    assert got == sorted([("甲", "1", None), ("乙", None, "2")])


def test_csv_union_and_shards(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x")], "id int, p string"), spark.createDataFrame([(2, "y")], "id int, q string")
    files.write_csv(str(tmp_path / "c"), a, b)
    assert spark.read.csv(str(tmp_path / "c"), header=True).columns == ["id", "p", "q"]
    d = spark.range(10).select("id", F.lit("s").alias("source"), F.when(F.col("id") < 5, "train").otherwise("val").alias("split"))
    files.write_shards(d, str(tmp_path / "s"), rows=2)
    assert files.shard_catalog(spark, str(tmp_path / "s")).where("single_source and rows_ <= 2").count() >= 6


def test_map(spark, tmp_path):
    (tmp_path / "m.osm").write_text('<osm><node id="1" lat="0.5" lon="3.1"/><node id="2" lat="0.6" lon="3.2"/><way id="7"><nd ref="2"/><nd ref="1"/><tag k="type" v="curb"/></way><relation id="9"><member type="way" ref="7" role="left"/><tag k="speed" v="30 mph"/></relation></osm>')
    m = files.read_map(spark, str(tmp_path / "m.osm"))
    line = m["way_node"].join(m["node"], F.col("node") == F.col("id")).orderBy("way", "ord").collect()
    assert [(r.way, r.node, r.lat) for r in line] == [(7, 2, 0.6), (7, 1, 0.5)]
    assert m["member"].first().role == "left"
    assert m["relation_tag"].select(files.speed_limit(F.col("v")).alias("s")).first().s == pytest.approx(13.4112)


def test_streams(spark, tmp_path):
    rows = [("u", f"2024-01-01 00:0{m}:00", float(m)) for m in (0, 1, 5, 6)] + [("u", "2024-01-01 00:01:00", 1.0)]
    spark.createDataFrame(rows, "k string, t string, x double").selectExpr("k", "cast(t as timestamp) t", "x").write.parquet(str(tmp_path / "in"))

    def drain(make, name):
        src = spark.readStream.schema("k string, t timestamp, x double").parquet(str(tmp_path / "in"))
        q = make(src).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(60)
        return spark.table(name)

    assert drain(lambda s: streams.dedup(s, ["k", "t"], "t", "1 minute"), "once").count() == 4
    assert drain(lambda s: streams.gap_sessions(s, "k", "t", "2 minutes", "0 seconds"), "sessions").where("n_events = 3").count() == 1
    assert drain(lambda s: streams.windows(s, "k", "t", "x", "2 minutes", "0 seconds"), "tumbling").where("n = 3").count() == 1


def test_json_lines_and_hashes(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "tags": ["x"], "spec": {"v": 2.5}}\n\n{"id": 2}\n{"id": \n')
    good, bad = files.read_jsonl(spark, str(tmp_path), "id int, tags array<string>, spec struct<v: double>")
    assert sorted((r.id, r.tags, r.spec and r.spec.v) for r in good.collect()) == [(1, ["x"], 2.5), (2, None, None)]
    assert [r.line for r in bad.collect()] == ['{"id": ']
    assert len(files.hash_files(spark, str(tmp_path)).first().sha256) == 64


def test_map_features(spark, tmp_path):
    point = lambda x, y: field(1, 1, struct.pack("<d", x)) + field(2, 1, struct.pack("<d", y))
    lane = field(1, 1, struct.pack("<d", 25.0)) + field(8, 2, point(1, 2)) + field(8, 2, point(3, 4)) + field(8, 2, field(1, 1, struct.pack("<d", 9.0)))
    features = [field(1, 0, varint(7)) + field(3, 2, lane), field(1, 0, varint(8)) + field(7, 2, field(2, 2, point(5, 6))), field(8, 2, field(1, 2, point(0, 1))), field(1, 0, varint(9)) + field(4, 2, b""), field(1, 0, varint(10)) + field(9, 2, field(1, 2, point(float("nan"), 1)))]
    record = field(5, 2, b"case") + b"".join(field(8, 2, f) for f in features)
    (tmp_path / "a.rec").write_bytes(records.frame(record))
    got = sorted((r.feature, r.kind, r.ord, r.x, r.y, round(r.speed, 6)) for r in records.read_map_points(spark, str(tmp_path)).collect())
    assert got == [("7", "lane_center", 0, 1.0, 2.0, 11.176), ("7", "lane_center", 1, 3.0, 4.0, 11.176), ("8", "stop_line", 0, 5.0, 6.0, 0.0), ("unknown", "crosswalk", 0, 0.0, 1.0, 0.0)]


def test_archives_of_arrays(spark, tmp_path):
    import numpy as np

    np.savez(tmp_path / "a.npz", x=np.arange(6.0).reshape(2, 3), n=np.array([7], np.int32))
    got = sorted((r.name, r.shape, r.kind, r["values"]) for r in files.read_npz(spark, str(tmp_path / "*.npz")).collect())
    assert got == [("n", [1], "int32", [7.0]), ("x", [2, 3], "float64", [0.0, 1.0, 2.0, 3.0, 4.0, 5.0])]


def test_csv_with_a_mark_by_groups(spark, tmp_path):
    a, b = spark.createDataFrame([("x", 1)], "g string, n int"), spark.createDataFrame([("y", "é")], "g string, t string")
    files.write_csv(str(tmp_path / "c"), a, b, by=["g"])
    raw = {p.parent.name: p.read_bytes() for p in (tmp_path / "c").rglob("*.csv")}
    assert set(raw) == {"g=x", "g=y"} and all(r.startswith(b"\xef\xbb\xbfn,t") for r in raw.values())
