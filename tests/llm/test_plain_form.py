from collections import Counter

from pyspark.sql import functions as F

from daywise.llm import plain_form as P

PLAIN = {"Hemoglobin": 900, "β2-microglobulin": 300, "γ-GT": 300, "Гемоглобин": 300, "Креатинин": 200, "C反应蛋白": 300, "pCO2": 200, "CA 19-9": 200, "μmol/L": 900, "10⁹/L": 500, "°C": 100, "Hämoglobin": 100, "血红蛋白": 500, "ヘモグロビン": 100, "Factor VIII activity": 90, "HbA1c": 80}
# disguised: plain
CASES = {
    "Неmoglobin": "Hemoglobin", "Ｈｅｍｏｇｌｏｂｉｎ": "Hemoglobin", "Hemo​globin": "Hemoglobin", "　Hemoglobin ": "Hemoglobin", "ß2-micrоglobulin": "β2-microglobulin", "ɣ-GT": "γ-GT",
    "Гeмоглoбин": "Гемоглобин", "С反应蛋白": "C反应蛋白", "рСО2": "pCO2", "СА 19-9": "CA 19-9", "µmol∕L": "μmol/L", "１0⁹/Ⅼ": "10⁹/L", "℃": "°C", "ºC": "°C", "Hämoglobin": "Hämoglobin", "⾎红蛋⽩": "血红蛋白",
    "ﾍﾓｸﾞﾛﾋﾞﾝ": "ヘモグロビン", "Factor Ⅷ activity": "Factor VIII activity", "нbА1с": "нbА1с",
}


def model():
    counts: Counter = Counter()
    for text, n in PLAIN.items():
        P.pair_counts(text, n, counts)
    return P.PairModel(counts)


def test_disguises_and_plain_texts():
    m = model()
    for text, want in CASES.items():
        if text != want:
            assert P.plain(text, m) == want, text
    for text in PLAIN:
        assert P.plain(text, m) == text
        assert P.plain(P.plain(text, m), m) == text


def test_nothing_visible():
    m = model()
    assert P.plain(None, m) is None and P.plain("", m) == "" and P.plain("​ ⁠", m) == ""
    assert len(P.plain("е" * 50_000, m)) == 50_000


def test_records(spark):
    rows = [(f"r{i}", t, u) for i, (t, u) in enumerate([("Hemoglobin", "g/L"), ("Неmoglobin", "g/L"), (None, None), ("", " g/L"), ("Hemoglobin‍", "ｇ/L")] + [("Hemoglobin", "g/L")] * 50)]
    df = spark.createDataFrame(rows + rows[:2], "record_id string, project_name string, unit string").withColumn("v", F.lit("clash")).withColumn("unit_plain", F.lit("clash"))
    got = {(r.record_id, r.field_name) for r in P.disguised_fields(df).collect()}
    assert got == {("r1", "project_name"), ("r3", "unit"), ("r4", "project_name"), ("r4", "unit")}
    assert P.disguised_fields(df).count() == 4
    assert P.disguised_fields(df.limit(0)).count() == 0
    out = P.plain_form(df, ["unit"])
    assert out.count() == len(rows) + 2 and {r.unit_plain for r in out.collect()} == {"g/L", None}


def test_kana_by_their_lattice():
    assert [P._kana(t) for t in ("力ルシウム", "二トロ", "ニ酸化炭素", "第ー", "トロンボ一ス", "カ", "力", "ヘモグロビン", "へモグロビン", "へや", "口 ロ", "ニ口ト", "カ月")] == ["カルシウム", "ニトロ", "二酸化炭素", "第一", "トロンボース", "カ", "力", "ヘモグロビン", "ヘモグロビン", "へや", "口 ロ", "ニロト", "力月"]
    assert P._kana("ア" * 50_000 + "力") == "ア" * 50_000 + "カ" and P._kana("") == ""


def test_ascii_words_beside_words_of_another_script():
    into = Counter()
    for w, n in (("сахар", 40), ("крови", 40), ("глюкоза", 30), ("sugar", 40), ("blood", 40), ("extra", 20)):
        P.pair_counts(w, n, into)
    model = P.PairModel(into)
    assert P.plain("caxap крови", model) == "сахар крови" and P.plain("caxap", model) == "caxap" and P.plain("pH крови", model) == "pH крови"
