import random

from pyspark.sql import functions as F

from daywise.llm import scan_repair as S

WORDS = "the haematology department reported a persistent elevation of albumin despite appropriate refrigeration without clinical consequences".split()


def document(rnd, token, pages=3, noise=()):
    rows, i = [], 0
    for p in range(1, pages + 1):
        body = [" ".join(rnd.choice(WORDS) for _ in range(5)) for _ in range(6)]
        for t in ["Northvale Clinic - Ward report", *body, "Form LM-22 rev. 4", f"- {p} -"]:
            rows.append([token, i, p, t])
            i += 1
    for at, text in noise:
        rows[at][3] = text
    return [tuple(r) for r in rows]


def corpus(spark):
    rnd = random.Random(1)
    rows = [r for d in range(30) for r in document(rnd, f"d{d}")]
    rows += document(rnd, "x", noise=[(2, "persistcnt elevati0n of albumin despite"), (3, "the department reported a persis-"), (4, "tent elevation of albumin without clinical"), (5, "12.S"), (9, "Northvale C1inic - Ward report")])
    rows += rows[:5] + [("n", 0, 1, None), ("n", 1, 1, ""), ("n", 2, None, "word")]
    han = ["结果在参考区间内，请结合临床", "患者空腹采血后继续观察", "未见异常，检验科"]
    rows += [("z", i, 1, han[i % 3]) for i in range(60)] + [("z", 60, 1, "洁果在叁考区间内，请结合临床")]
    return spark.createDataFrame(rows, "document_token string, line_index int, page_number int, text string").withColumn("edge", F.lit("clash")).withColumn("like", F.lit("clash"))


def test_kinds_and_repair(spark):
    lines = corpus(spark)
    got = {(r.document_token, r.line_index, r.noise_kind) for r in S.scan_noise(lines).collect()}
    own = {(i, k) for d, i, k in got if d == "x"}
    assert own == {(p * 9, "running_line") for p in range(3)} | {(p * 9 + 7, "running_line") for p in range(3)} | {(p * 9 + 8, "page_number") for p in range(3)} | {(2, "misread"), (5, "misread"), (3, "hyphen_break")}
    assert {x for x in got if x[0] == "z"} == {("z", 60, "misread")} and not {x for x in got if x[0] == "n"}
    fixed = {r.line_index: r.fixed for r in S.repaired_lines(lines).filter("document_token = 'x'").collect()}
    assert fixed[2] == "persistent elevation of albumin despite" and fixed[5] == "12.5" and fixed[0] is None
    text = " ".join(r.text for r in S.paragraphs(lines).filter("document_token = 'x'").orderBy("paragraph_no").collect())
    assert "a persistent elevation of albumin without" in text and "Northvale" not in text and "- 2 -" not in text


def test_line_kinds_do_not_hang_on_size(spark, monkeypatch):
    # As in a corpus of some thousand times the size: the share these head lines have of it is smaller by as much.
    monkeypatch.setattr(S, "LEAST_LINE_SHARE", 0.02, raising=False)
    rnd = random.Random(2)
    rows = [r for d in range(30) for r in document(rnd, f"d{d}")] + [r for d in range(4) for r in document(rnd, f"k{d}", 2, [(0, "Osterbrook Infirmary, record"), (9, " ".join(rnd.sample(WORDS, 6)))])]
    lines = spark.createDataFrame(rows, "document_token string, line_index int, page_number int, text string")
    got = {(r.document_token, r.line_index) for r in S.repaired_lines(lines).filter("furniture = 'running_line'").collect()}
    assert {(f"k{d}", 0) for d in range(4)} <= got and ("k0", 9) not in got


def test_empty(spark):
    lines = corpus(spark).limit(0)
    assert S.scan_noise(lines).count() == 0 and S.paragraphs(lines).count() == 0


def test_strokes_and_numbers():
    assert S.strokes("rnodern") == S.strokes("modern") and S.strokes("diirch") == S.strokes("durch") and S.strokes("hat") == S.strokes("bat")
    assert S.misread_number("l3.5", False) and S.misread_number("4O", True) and not S.misread_number("48b", False) and not S.misread_number("ZZ1912754", False) and not S.misread_number("B12", False) and not S.misread_number("12.5", True)


def test_slices_of_a_large_vocabulary_give_the_same(spark, monkeypatch):
    lines = corpus(spark)
    shown = lambda: sorted((str(r.document_token), r.line_index, r.furniture or "", r.broken, r.misread, r.fixed or "") for r in S.repaired_lines(lines).collect())
    whole = shown()
    monkeypatch.setattr(S, "MOST_WORDS", 3)
    monkeypatch.setattr(S, "SLICE_WORDS", 500)
    assert shown() == whole and any(r[4] for r in whole)


def test_rare_words_do_not_hang_on_size(spark):
    """A word seen seven times and its misreading, alone and among a hundred times as many other lines."""
    rnd = random.Random(3)
    rows = [("r", i, 1, "ordered by Thalmira Quessington today") for i in range(7)] + [("r", 7, 1, "ordered by Thalrnira Quessington today")]
    found = []
    for more in (0, 3000):
        other = [(f"o{d}", i, 1, " ".join(rnd.choice(WORDS) for _ in range(6))) for d in range(more // 30) for i in range(30)]
        lines = spark.createDataFrame(rows + other, "document_token string, line_index int, page_number int, text string")
        found.append({(r.line_index, r.fixed) for r in S.repaired_lines(lines).filter("misread and document_token = 'r'").collect()})
    assert found[0] == found[1]


def test_lines_move_once_and_their_likes_are_made_once(spark):
    told = S.scan_noise(corpus(spark))._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    nodes = told.split("\n\n")
    moved = [x for x in nodes if ") Exchange\n" in x and ("text#" in x or "body#" in x)]
    assert moved and all("REPARTITION_BY_COL" in x for x in moved)
    assert not [x for x in nodes if ") Filter" in x and "substring_index" in x]


def test_a_word_goes_on_behind_pages_of_furniture(spark):
    rnd = random.Random(4)
    rows = [r for d in range(30) for r in document(rnd, f"d{d}")]
    long = document(rnd, "x", 3, [(6, "the department reported a persis-"), (19, "tent elevation of albumin without clinical")])
    rows += [r for r in long if not 10 <= r[1] <= 15]  # the second page has no body
    lines = spark.createDataFrame(rows, "document_token string, line_index int, page_number int, text string")
    got = {r.line_index: r for r in S.repaired_lines(lines).filter("document_token = 'x'").collect()}
    assert [i for i in sorted(got) if got[i].furniture] == [0, 7, 8, 9, 16, 17, 18, 25, 26] and got[6].broken and not got[19].misread
