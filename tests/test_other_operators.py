import json
import subprocess
import sys
import zipfile
from io import BytesIO
from pathlib import Path

from pyspark.sql import functions as F

from sumline.config import DEFAULT, from_toml
from sumline.operators import edits, geometry, score
from sumline.sources.tables import read_ground_truth, sheet_names, workbook

ROOT = Path(__file__).resolve().parent.parent


def test_lines(spark):
    rows = [("a", 0, 10, 100.0), ("b", 12, 20, 102.0), ("c", 100, 110, 101.0), ("d", 0, 5, 104.5), ("e", 0, 9, 130.0)]
    df = spark.createDataFrame([("f", 1, t, float(x), float(y), top) for t, x, y, top in rows], "file string, page int, text string, x0 double, x1 double, top double")
    got = {r.text: r.line_id for r in geometry.build_lines(df).collect()}
    assert got["a"] == got["b"] and len({got[k] for k in "acde"}) == 4


def test_suppress_against_brute_force(spark):
    import random

    r = random.Random(3)
    boxes = [(p, i, r.randint(0, 2), float(x := r.randint(0, 30)), float(y := r.randint(0, 30)), float(x + r.randint(1, 25)), float(y + r.randint(1, 25))) for p in range(5) for i in range(25)]
    df = spark.createDataFrame(boxes, "page int, box_id int, rank int, x0 double, y0 double, x1 double, y1 double")
    got = {(x.page, x.box_id) for x in geometry.suppress(df, ["page"]).collect()}
    want = set()
    for p in range(5):
        kept = []
        for b in sorted((b for b in boxes if b[0] == p), key=lambda b: (b[2], -(b[5] - b[3]) * (b[6] - b[4]), b[1])):
            share = lambda k: max(0, min(b[5], k[5]) - max(b[3], k[3])) * max(0, min(b[6], k[6]) - max(b[4], k[4])) / max(1, min((b[5] - b[3]) * (b[6] - b[4]), (k[5] - k[3]) * (k[6] - k[4])))  # noqa: B023, E731
            if all(share(k) <= 0.55 for k in kept):
                kept.append(b)
        want |= {(p, b[1]) for b in kept}
    assert got == want


def test_score(spark):
    base = [["", 2024, 2023], ["Revenue", 1000000, 900000], ["Cost of sales", -400000, -350000], ["Gross profit", 600000, 550000], ["Profit for the year", 300000, 300000]]
    wrong = [list(r) for r in base]
    wrong[2][1] = -400001
    other = [["x", 1, 2], ["qqq", 5, 6]]
    found = {"same": base, "extra": [["Title", None, None], *base, ["Tail", 3, 3]], "short": base[:2] + base[3:], "wrong": wrong, "other": other}
    rows = [(k, s, i, j, v if isinstance(v, str) else None, float(v) if isinstance(v, int) else None) for k, f in found.items() for s, t in (("truth", base), ("found", f)) for i, r in enumerate(t) for j, v in enumerate(r)]
    got = {r.case: r for r in score.score_tables(spark.createDataFrame(rows, "case string, side string, row_idx int, col_idx int, txt string, num double")).collect()}
    assert got["same"].score == got["extra"].score == 1.0 and got["short"].score < 1 and got["short"].missing == 1
    assert 0 < got["wrong"].score < 1 and got["other"].score < 0.3


def test_edits(spark):
    log = spark.createDataFrame([("a", 1, "edit", "x"), ("a", 2, "delete", None), ("a", 3, "restore", None), ("b", 1, "edit", "y"), ("b", 2, "delete", None)], "table_id string, edit_id int, op string, payload string")
    assert [(r.table_id, r.payload) for r in edits.latest(log).collect()] == [("a", "x")]
    one = spark.createDataFrame([("a b c",)], "s string").select(edits.split_label(F.col("s")).alias("x")).first().x
    assert one == ["a b", "c"]
    bands = spark.sql("select array(named_struct('lo', 0D, 'hi', 10D), named_struct('lo', 10D, 'hi', 20D)) b")
    pick = lambda c: [tuple(x) for x in bands.select(c.alias("x")).first().x]
    assert pick(edits.insert_line(F.col("b"), 4.0)) == [(0, 4), (4, 10), (10, 20)]
    assert pick(edits.move_line(F.col("b"), 10.2, 12.0)) == [(0, 12), (12, 20)]
    assert pick(edits.remove_line(F.col("b"), 10.0)) == [(0, 20)]


def test_sources(spark, tmp_path):
    (tmp_path / "case.json").write_text(json.dumps({"source_pdf": "a.pdf", "source_page": 3, "title": "T", "rows": [["Revenue", 5], ["x", "-"]]}))
    got = sorted((r.table_id, r.row_idx, r.col_idx, r.raw) for r in read_ground_truth(spark, str(tmp_path)).collect())
    assert got == [("case", 0, 0, "Revenue"), ("case", 0, 1, "5"), ("case", 1, 0, "x"), ("case", 1, 1, "-")]
    assert sheet_names(["a/b", "a:b", "x" * 40]) == ["a_b", "a_b_2", "x" * 28]
    book = zipfile.ZipFile(BytesIO(workbook({"A&B": [["x", 1.5, None], ["<y>", -2]]})))
    assert b"<v>1.5</v>" in book.read("xl/worksheets/sheet1.xml") and b"A&amp;B" in book.read("xl/workbook.xml")
    (tmp_path / "c.toml").write_text("tol_pl = 5.0\nnone = 1\n")
    assert from_toml(str(tmp_path / "c.toml")).tol_pl == 5.0 and DEFAULT.tol_pl == 2.0


def test_works_without_corpus_operators():
    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_report_diff_states_every_line(spark):
    import duckdb

    from sumline import registry

    sf_dir = "/root/testdata/sf0.001"
    tables = duckdb.connect()
    for t in ("orders", "customer"):
        tables.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got = sorted(tuple(r) for r in registry.QUERIES["report_diff_lines"](spark, sf_dir).collect())
    assert len({key for _, _, key, _ in got}) == 9 and got == sorted(tables.execute(registry.ORACLES["report_diff_lines"]).fetchall())
