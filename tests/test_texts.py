"""What is read outside SQL, one text at a time, against the SQL of the same detector; and that no text is dealt out to be read."""

import random

import duckdb
import pytest

from inkstone.dialect import DUCK
from inkstone.functions import matching
from inkstone.functions.chars import URL
from inkstone.operators import shapes
from inkstone.plans.registered import _doubles, _long_sums
from inkstone.queries import ORACLE_SQL, QUERIES
from inkstone.sources.zh_view import SLOTS, ZH_SQL, zh_text

#: Queries whose findings are placed without a window over all of them.
PLACED = "sc6_translation_score sc7_domain_thresholds exc18_masked_findings fx6_carried_state fx5_convergence ai29_slogan_places ort10_ellipsis ort1_halfwidth_marks tr18_phase_dedup ort11_space_by_fullwidth_mark ort3_colon".split()


def texts(n: int) -> list[str]:
    """Short texts of what detectors look for, and of what stands around it."""
    pieces = [p for _, p in SLOTS] + list("，。！？；：、,.!?;:~-…()「」『』\" \n\t#*") + ["https://a.b/好", "://", "@x", "a://b@c", "好", "的", "Dr.", "word", "12", "...", "到底為什麼？因為不是錢，而是人。", "不是甲，而是乙。", "\n\n"]
    rnd = random.Random(7)
    return ["".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 25))) for _ in range(n)]


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("CREATE TABLE made (doc_id BIGINT, zh VARCHAR)")
    con.executemany("INSERT INTO made VALUES (?, ?)", list(enumerate(texts(250))))
    return con


@pytest.mark.parametrize("name", shapes.SHAPES)
def test_a_reading_finds_what_sql_finds(con, name):
    rows = con.execute(f"SELECT doc_id, start, found, suggestion, kind, severity FROM ({_long_sums(_doubles(shapes.findings(shapes.SHAPES[name], DUCK, 'made')))})").fetchall()
    got = [(i, *f[1:]) for i, t in enumerate(texts(250)) for f in shapes.found_in(t, [name])]
    assert sorted(map(str, got)) == sorted(map(str, rows))


def test_masks_from_their_marks():
    import re

    whole = matching.compiled(f"{URL}|@[a-zA-Z0-9_]+|[。，]+")
    for t in texts(2000):
        assert list(matching.hits(t, f"{matching.MASK}|[。，]+")) == [m.span() for m in re.finditer(whole, t)]


def test_the_view_of_one_text():
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    rnd = random.Random(3)
    words = [w for w, _ in SLOTS] + ["x", "y.", "\n"]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(30))) for i in range(200)]
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert con.execute(f"SELECT zh FROM {ZH_SQL} ORDER BY doc_id").fetchall() == [(zh_text(t),) for _, t in rows]


@pytest.mark.parametrize("name", PLACED)
def test_no_window_over_findings(spark, tmp_path, name):
    spark.createDataFrame([(1, "a the b of c")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    # Rules have a window of their own.
    assert not any("Window" in line and "rule_id" not in line for line in plan.splitlines())


@pytest.mark.parametrize("name, readings", [("sc1_structural_families", 19), ("sc1_signature", 24)])
def test_families_of_few_readings(spark, tmp_path, name, readings):
    """Against the SQL, on texts that show families; detectors share readings."""
    words = [w for w, _ in SLOTS]
    rnd = random.Random(11)
    rows = [(i, " ".join(rnd.choice(words + ["word", "Dr."]) for _ in range(rnd.randint(1, 150)))) for i in range(80)] + [(80, ""), (81, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    columns = ", ".join(found.columns)
    assert sorted(map(tuple, found.collect())) == sorted(con.execute(f"SELECT {columns} FROM ({ORACLE_SQL[name]})").fetchall())
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation [") <= readings
