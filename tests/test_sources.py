import json
import zipfile

import pytest

from drawlake.sources import files

DXF = """  0
SECTION
  2
HEADER
  9
$INSUNITS
 70
4
  0
ENDSEC
  0
SECTION
  2
ENTITIES
  0
LINE
  8
MAIN
 10
0.0
 20
0.0
 11
3.0
 21
4.0
  0
ARC
  8
GT_CLOSURE
 10
1.0
 20
1.0
 40
2.0
 50
350.0
 51
80.0
  0
LINE
  8
CONSTRUCTION
 10
0
 20
0
 11
1
 21
1
  0
TEXT
  8
MAIN
  0
ENDSEC
  0
EOF
"""


def document(text="R5", score=0.5):
    return {"meta": {"original_size": {"width": 10, "height": 10}}, "records": [{"text": text, "box": [[0, 0], [1, 0], [1, 1], [0, 1]], "score": score}]}


def test_corpus_files_pairs_by_stem(spark, tmp_path):
    for name in ("a.jpg", "a.png", "a.json", "b.jpg"):
        (tmp_path / name).write_bytes(b"{}")
    rows = {r["case_id"]: r for r in files.corpus_files(spark, str(tmp_path)).collect()}
    assert rows["a"]["image"].endswith("a.jpg") and rows["a"]["ocr"].endswith("a.json") and rows["a"]["images"] == 2
    assert rows["b"]["ocr"] is None


def test_source_inventory_flags_case_clash(spark, tmp_path):
    (tmp_path / "A.jpg").write_bytes(b"1")
    (tmp_path / "a.png").write_bytes(b"1")
    rows = files.source_inventory(spark, str(tmp_path)).collect()
    assert len(rows) == 2 and all(r["duplicate_id"] for r in rows) and len({r["sha256"] for r in rows}) == 1


def test_ocr_document_is_refused_as_a_whole(spark, tmp_path):
    (tmp_path / "good.json").write_text(json.dumps(document()))
    bad = document()
    bad["records"].append({"text": "x", "box": [[0, 0]], "score": None})
    (tmp_path / "bad.json").write_text(json.dumps(bad))
    (tmp_path / "score.json").write_text(json.dumps(document(score=2)))
    problems = {r["case_id"]: r["problem"] for r in files.ocr_documents(spark, str(tmp_path)).collect()}
    assert problems == {"good": None, "bad": "invalid_box", "score": "invalid_score"}
    rows = files.ocr_records(spark, str(tmp_path)).collect()
    assert [(r["case_id"], r["record_id"], r["text"]) for r in rows] == [("good", "r000", "R5")]


def test_drawing_entities(spark, tmp_path):
    (tmp_path / "d.dxf").write_text(DXF)
    rows = files.profile_entities(files.drawing_entities(spark, str(tmp_path))).orderBy("ord").collect()
    assert [r["kind"] for r in rows] == ["LINE", "ARC", "LINE", "TEXT"]
    assert rows[0]["length"] == 5.0 and rows[0]["unit_code"] == 4
    assert rows[1]["assumed"] and abs(rows[1]["length"] - 2 * 3.141592653589793 / 2) < 1e-9
    assert [r["skipped"] for r in rows] == [None, None, "layer:CONSTRUCTION", "type:TEXT"]


def test_reference_inventory_keeps_bad_archives(spark, tmp_path):
    (tmp_path / "x.dxf").write_text(DXF)
    (tmp_path / "x_debug.dxf").write_text(DXF)
    (tmp_path / "bad.zip").write_bytes(b"no")
    with zipfile.ZipFile(tmp_path / "p.zip", "w") as package:
        package.writestr("in/main.dxf", "")
        package.writestr("../evil.dxf", "")
        package.writestr("note.txt", "")
    rows = {(r["path"].rsplit("/", 1)[1], r["member"], r["problem"]) for r in files.reference_inventory(spark, str(tmp_path)).collect()}
    assert rows == {("x.dxf", None, None), ("bad.zip", None, "invalid_archive"), ("p.zip", "in/main.dxf", None), ("p.zip", "../evil.dxf", "traversal")}


def test_receipts_count_by_path(spark, tmp_path):
    for folder in ("run1/initial", "run1/full-source-binding"):
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / "r.json").write_text(json.dumps({"status": "ok", "network_requests": 1}))
    (tmp_path / "run1" / "skip.json").write_text(json.dumps({"status": "skipped"}))
    phases = sorted(r["phase"] for r in files.receipt_files(spark, str(tmp_path)).collect())
    assert phases == ["initial", "radius_rebinding"]


def test_sinks_and_frozen_reuse(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("a", 1)], "run_id string, n int")
    files.write_report(rows, str(tmp_path / "report"))
    with pytest.raises(Exception):
        files.write_report(rows, str(tmp_path / "report"))
    files.write_csv(rows, str(tmp_path / "csv"))
    assert files.reuse_frozen(rows, rows).count() == 2
    with pytest.raises(ValueError):
        files.reuse_frozen(rows, rows.distinct())
