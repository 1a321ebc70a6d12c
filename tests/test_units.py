"""Units that survive interruption, and pointers to written rows."""

import shutil

import pytest
from pyspark.sql import functions as F

from tracklens.sources import files, units


def inputs(spark, changed=""):
    rows = spark.createDataFrame([(u, i, f"{u}{i}") for u in "abcdefgh" for i in range(30)] + [("empty", 0, "drop")], "unit string, i int, t string")
    prints = rows.groupBy("unit").agg(F.concat(F.count("*").cast("string"), F.when(F.col("unit") == changed, "x").otherwise("")).alias("sha"))
    return prints, rows


def keep(rows):
    return rows.where("t <> 'drop'").select("unit", "i")


def runs(path):
    return sorted(p.name for p in path.iterdir() if p.name.startswith("run-"))


def test_a_conversion_that_fails_half_way_is_taken_up(spark, tmp_path):
    out, (prints, rows) = f"file://{tmp_path}/u", inputs(spark)
    broken = {u for u in "abcdefgh" if spark.range(1).select(F.pmod(F.xxhash64(F.lit(u)), F.lit(4))).first()[0] == 2}
    assert broken and len(broken) < 8

    def fails(part):
        return keep(part).withColumn("i", F.when(F.col("unit").isin(*broken) & (F.col("i") == 17), F.raise_error(F.lit("power cut"))).otherwise(F.col("i")).cast("int"))

    with pytest.raises(Exception, match="power cut"):
        units.convert_units(prints, rows.repartition(5), out, "unit", "sha", fails, batches=4, rows_per_file=7)
    before = {r.unit: r.run for r in units.markers(spark, out).collect()}
    assert before and not broken & set(before)
    (tmp_path / "u" / "run-left").mkdir()
    (tmp_path / "u" / "run-left" / "part-0.parquet").write_bytes(b"cut sh")
    got = {r.unit: (r.state, r.rows) for r in units.convert_units(prints, rows, out, "unit", "sha", keep, batches=4, rows_per_file=7).collect()}
    assert got == {u: ("reused" if u in before else "converted", 0 if u == "empty" else 30) for u in [*"abcdefgh", "empty"]}
    assert {r.unit: r.run for r in units.markers(spark, out).collect()}.items() >= before.items() and "run-left" not in runs(tmp_path / "u")
    back = units.read_units(spark, out)
    assert sorted((r.unit, r.i) for r in back.collect()) == sorted((u, i) for u in "abcdefgh" for i in range(30))
    assert back.groupBy("file").count().agg(F.max("count")).first()[0] <= 7
    again = units.convert_units(prints, rows, out, "unit", "sha", keep).collect()
    assert {r.state for r in again} == {"reused"} and len(again) == 9


def test_stale_markers_are_errors(spark, tmp_path):
    out, (prints, rows) = f"file://{tmp_path}/u", inputs(spark)
    assert units.wipe_partial(spark, out) == [] and units.markers(spark, out).count() == 0
    units.convert_units(prints, rows, out, "unit", "sha", keep)
    with pytest.raises(ValueError, match="changed: c"):
        units.convert_units(inputs(spark, "c")[0], rows, out, "unit", "sha", keep)
    name = next((tmp_path / "u" / runs(tmp_path / "u")[0]).glob("*.parquet"))
    name.unlink()
    with pytest.raises(ValueError, match="files are gone"):
        units.convert_units(prints, rows, out, "unit", "sha", keep)
    shutil.rmtree(tmp_path / "u")
    with pytest.raises(ValueError, match="no unit"):
        units.read_units(spark, out)


def test_pointers_lead_to_their_rows(spark, tmp_path):
    d = spark.range(500).select("id", (F.col("id") * 3).alias("x"), F.when(F.col("id") % 5 == 0, "s").otherwise("t").alias("source"), F.lit("train").alias("split")).repartition(3)
    out = f"file://{tmp_path}/s"
    files.write_shards(d, out, rows=40)
    p = units.pointers(spark, out, ["id"])
    by = {}
    for r in p.collect():
        by.setdefault(r.file, []).append(r.row)
    assert len(by) > 10 and all(sorted(v) == list(range(len(v))) and len(v) <= 40 for v in by.values())
    some = p.where("id % 50 = 3")
    got = units.read_pointers(some.union(some))
    assert sorted((r.id, r.x) for r in got.collect()) == [(i, 3 * i) for i in range(3, 500, 50)]
    opened = {f.split("/")[-1] for f in got.inputFiles()}
    assert {r.file.split("/")[-1] for r in some.collect()} == opened and len(opened) < len(by)
    with pytest.raises(ValueError, match="has no row"):
        units.read_pointers(some.withColumn("row", F.lit(10**6)))
    with pytest.raises(ValueError, match="no pointers"):
        units.read_pointers(some.limit(0))
