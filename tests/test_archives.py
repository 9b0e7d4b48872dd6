"""Files, nested archives and workbooks: what is read, what is not and why."""

from __future__ import annotations

import io
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.sources import archives

LIMITS = archives.Limits(member=40_000, archive=400_000)


def packed(*members, compress=zipfile.ZIP_DEFLATED) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", compress) as archive:
        for name, content in members:
            archive.writestr(name, content)
    return out.getvalue()


def workbook() -> bytes:
    main = '<workbook xmlns:r="r"><sheets><sheet name="Data" r:id="rId1"/></sheets></workbook>'
    sheet = '<worksheet><sheetData><row><c r="A1" t="s"><v>1</v></c><c r="B1"><v>4.5</v></c><c r="C1"><f>A1+1</f><v>2</v></c><c r="D1" t="inlineStr"><is><t>in</t><t>line</t></is></c><c r="E1"/></row></sheetData></worksheet>'
    return packed(
        ("xl/workbook.xml", main),
        ("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>'),
        ("xl/sharedStrings.xml", "<sst><si><t>zero</t></si><si><r><t>mail a@</t></r><r><t>b.org</t></r></si></sst>"),
        ("xl/worksheets/sheet1.xml", sheet),
        ("xl/worksheets/_rels/sheet1.xml.rels", '<Relationships><Relationship Target="http://x.org" TargetMode="External"/></Relationships>'),
        ("docProps/core.xml", "<p><creator>Somebody</creator><revision>3</revision></p>"),
    )


def nested(depth: int) -> bytes:
    content = packed(("deep.txt", f"depth {depth}"))
    for k in range(depth):
        content = packed((f"in{k}.zip", content))
    return content


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("share")
    (top / "sub").mkdir()
    (top / "note.md").write_text("call 555-123-4567\nnothing\r\nmail me@x.org and you@x.org\n")
    (top / ".gitignore").write_text("*.log\n")
    (top / "empty.txt").write_text("")
    (top / "tool.exe").write_bytes(b"MZ")
    (top / "pixel.png").write_bytes(b"\x89PNG" + "mail w@ide.org".encode("utf-16-le") + b"\xff")
    (top / "large.txt").write_bytes(b"x" * (LIMITS.member + 1))
    (top / "broken.zip").write_bytes(b"PK no archive")
    (top / "sub" / "book.xlsx").write_bytes(workbook())
    (top / "sub" / "bad.xlsx").write_bytes(b"no workbook")
    (top / "many.zip").write_bytes(packed(*[(f"d/{i:03}.txt", f"member {i}") for i in range(200)], ("../up.txt", "x"), ("a.bin", "x"), ("d/", "")))
    for depth in range(4):
        (top / f"depth{depth}.zip").write_bytes(nested(depth))
    (top / "bomb.zip").write_bytes(packed(("zeros.txt", b"0" * (LIMITS.member + 1)), ("small.txt", "small")))
    (top / "sum.zip").write_bytes(packed(*[(f"{i:02}.txt", b"abc\n" * (LIMITS.member // 4)) for i in range(11)]))
    lying = bytearray(packed(("lie.txt", b"0" * 1000)))
    at = lying.rfind(b"PK\x01\x02")
    lying[at + 24 : at + 28] = struct.pack("<I", 10)  # the directory says ten bytes
    (top / "lying.zip").write_bytes(bytes(lying))
    return top


@pytest.fixture(scope="module")
def found(spark, folder):
    rows = archives.artifacts(spark, str(folder), limits=LIMITS)
    name = F.regexp_replace("artifact", f"^file:/*{str(folder).lstrip('/')}/", "")
    return rows.withColumn("artifact", name).cache()


def test_reasons(found):
    reasons = {r.artifact: r.reason for r in found.filter("reason IS NOT NULL").collect()}
    deep = "depth3.zip!/in2.zip!/in1.zip!/in0.zip"
    assert reasons == {
        "tool.exe": "unsupported_file_type", "large.txt": "text_scan_size_limit", "broken.zip": "zip_open_failed", "sub/bad.xlsx": "xlsx_open_failed",
        "many.zip!/../up.txt": "unsafe_archive_member_name", "many.zip!/a.bin": "unsupported_archive_member_type", deep: "nested_archive_depth_exceeded",
        "bomb.zip!/zeros.txt": "archive_scan_size_limit", "sum.zip!/10.txt": "archive_scan_size_limit", "lying.zip!/lie.txt": "member_read_failed",
    }


def test_every_member_is_read_once(found):
    texts = {r.artifact: r.text for r in found.filter("kind = 'text' AND reason IS NULL").collect()}
    assert {a: t for a, t in texts.items() if a.startswith("many.zip")} == {f"many.zip!/d/{i:03}.txt": f"member {i}" for i in range(200)}
    assert texts["depth2.zip!/in1.zip!/in0.zip!/deep.txt"] == "depth 2" and texts["bomb.zip!/small.txt"] == "small"
    assert found.filter("kind = 'text' AND reason IS NULL").count() == len(texts)
    assert [r.artifact for r in found.filter("kind = 'image'").collect()] == ["pixel.png"]


def test_workbooks_are_read_by_cells(found):
    cells = {r.location: r.text for r in found.filter("artifact = 'sub/book.xlsx'").collect()}
    assert cells == {"Data!A1": "mail a@b.org", "Data!B1": "4.5", "Data!C1": "=A1+1", "Data!D1": "inline", "Data (hyperlink)": "http://x.org", "workbook.properties.creator": "Somebody"}


def test_findings_and_verdict(spark, found):
    matched = archives.findings(found)
    rows = sorted((r.artifact, r.location, r.rule, r.n_found) for r in matched.collect())
    assert rows == [("note.md", "line:1", "phone", 1), ("note.md", "line:3", "email", 2), ("pixel.png", "image bytes", "email", 1), ("sub/book.xlsx", "Data!A1", "email", 1)]
    assert archives.verdict(found, matched).first().asDict() == {"n_scanned": found.filter("reason IS NULL AND kind <> 'archive'").select("artifact").distinct().count(), "n_unscanned": 10, "n_findings": 5, "status": "fail"}
    clean, none = found.filter("artifact LIKE 'depth2%'"), matched.limit(0)
    assert archives.verdict(clean, none).first().status == "pass"
    assert [archives.verdict(found, none, allow).first().status for allow in (False, True)] == ["fail", "pass"]


def test_kinds_of_names(spark):
    names = ["a/b.TXT", "x.tar.zip", ".gitignore", ".zip", "a.b/c", "noext", "p.JPeG", "w.xlsx", "d.docx", "trailing."]
    rows = spark.createDataFrame([(n,) for n in names], "name string").select("name", archives.kind_column(F.col("name")).alias("kind")).collect()
    assert [(r.name, r.kind) for r in rows] == [(n, archives.kind_of(n)) for n in names]
    assert [r.kind for r in rows] == ["text", "archive", "text", None, None, None, "image", "workbook", "archive", None]
