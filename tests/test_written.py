"""Published versions, checks of written files, and settings from XML."""

from __future__ import annotations

import hashlib
import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tessera.sources import exports, settings, sinks


def staged(spark, folder, name, n):
    spark.range(n).write.parquet(str(folder / name))
    return str(folder / name)


def test_versions_replace_each_other_and_readers_keep_theirs(spark, tmp_path):
    path = str(tmp_path / "table")
    with pytest.raises(FileNotFoundError):
        sinks.current(spark, path)
    assert sinks.publish(spark, staged(spark, tmp_path, "a", 3), path) == 1
    held = spark.read.parquet(sinks.current(spark, path))
    assert sinks.publish(spark, staged(spark, tmp_path, "b", 5), path) == 2
    assert held.count() == 3 and spark.read.parquet(sinks.current(spark, path)).count() == 5
    assert spark.read.parquet(sinks.current(spark, path, 1)).count() == 3
    (tmp_path / "table" / "pointers" / f"{9:012}").write_text("half a na")  # a writer that died
    assert spark.read.parquet(sinks.current(spark, path)).count() == 5
    os.makedirs(tmp_path / "table" / "versions" / "left-behind")
    assert sinks.collect_versions(spark, path, keep=1) == []  # younger than the grace
    gone = sinks.collect_versions(spark, path, keep=1, grace_s=0)
    assert len(gone) == 2 and "left-behind" in gone and spark.read.parquet(sinks.current(spark, path)).count() == 5
    with pytest.raises(FileNotFoundError):
        sinks.current(spark, path, 1)
    with pytest.raises(ValueError):
        sinks.collect_versions(spark, path, keep=0)
    with pytest.raises(OSError):
        sinks.publish(spark, str(tmp_path / "nowhere"), path)


def test_writers_at_one_time_get_numbers_of_their_own(spark, tmp_path):
    folders = [staged(spark, tmp_path, f"s{i}", i + 1) for i in range(6)]
    path = str(tmp_path / "table")
    with ThreadPoolExecutor(6) as pool:
        numbers = list(pool.map(lambda f: sinks.publish(spark, f, path), folders))
    assert sorted(numbers) == [1, 2, 3, 4, 5, 6]
    assert {n: spark.read.parquet(sinks.current(spark, path, n)).count() for n in numbers} == {n: i + 1 for i, n in enumerate(numbers)}


def test_files_are_verified_by_their_bytes(spark, tmp_path):
    folder = tmp_path / "out"
    rows = spark.range(40).select(F.when(F.col("id") < 25, "a").otherwise("b c").alias("g"), "id")
    sinks.write_shards(rows, str(folder), ["g"], [F.col("id")], 10)
    manifest = spark.createDataFrame(sinks.file_digests(spark, str(folder)).collect(), sinks.FILES)
    disk = {str(p.relative_to(folder)): p.read_bytes() for p in folder.rglob("part-*")}
    assert {(r.path, r.bytes, r.sha256) for r in manifest.collect()} == {(p, len(b), hashlib.sha256(b).hexdigest()) for p, b in disk.items()} and len(disk) >= 5
    state = lambda m=manifest, **k: {(r.path, r.state) for r in sinks.verify_files(m, sinks.file_digests(spark, str(folder)), **k).collect()}
    assert state() == set()
    names = sorted(disk)
    (folder / names[0]).write_bytes(b"x" + disk[names[0]][1:])
    (folder / names[1]).write_bytes(disk[names[1]] + b"\n")
    (folder / names[2]).unlink()
    (folder / "more.txt").write_text("more")
    (folder / "index.html").write_text("index")
    os.rename(folder / names[3], tmp_path / "elsewhere")
    os.symlink(tmp_path / "elsewhere", folder / names[3])
    wrong = {(names[0], "digest"), (names[1], "size"), (names[2], "missing"), ("more.txt", "extra"), (names[3], "link")}
    assert state(also=["index.html"]) == wrong and state() == wrong | {("index.html", "extra")}
    listed = manifest.unionByName(manifest.filter(F.col("path") == names[4])).unionByName(spark.createDataFrame([("../up", 1, "0" * 64, False), (None, 1, "x", False)], manifest.schema))
    assert state(listed, also=["index.html"]) == wrong | {(names[4], "repeated"), ("../up", "unsafe"), (None, "unsafe")}


QUIZ = """<questestinterop><assessment title="Q"><assessmentcontrol hintswitch="yes" xmlns:d="u" d:time="+5"/>
<assess_procextension><time_limit>30</time_limit><password>secret</password><grade_item resource_code="r1"> x </grade_item><group><inner>1</inner></group><time_limit> 45 </time_limit></assess_procextension>
<assessfeedback><shown/></assessfeedback><section><assess_procextension><deep>no</deep></assess_procextension></section></assessment>
<assessment><assess_procextension><second>1</second></assess_procextension></assessment></questestinterop>"""


def test_settings_of_a_quiz(spark):
    files = spark.createDataFrame([("s", "quiz.xml", QUIZ.encode(), None), ("s", "other.xml", b"<a/>", None)], exports.FILES)
    nodes = exports.read_nodes(files).cache()
    found = [(r["name"], r.raw, r.kind, r.value, r.source_kind, r.is_sensitive) for r in settings.observed(nodes).orderBy("place").collect()]
    nested = '{"value":"x","attributes":{"resource_code":"r1"}}'
    assert found == [
        ("hintswitch", "yes", "boolean", "true", "assessmentcontrol.attribute", False), ("time", "+5", "integer", "5", "assessmentcontrol.attribute", False), ("time_limit", "30", "integer", "30", "assess_procextension", False),
        ("password", "[redacted]", "redacted", "[redacted]", "assess_procextension", True), ("grade_item", nested, "nested", nested, "assess_procextension", False), ("group", "", "empty", "", "assess_procextension", False),
        ("time_limit", "45", "integer", "45", "assess_procextension", False), ("shown", "", "empty", "", "assessfeedback", False),
    ]
    assert settings.assessment_settings(nodes).first().settings == {"time_limit": "45", "password": "secret", "grade_item": "x"}
    assert settings.observed(nodes.limit(0)).count() == 0
