import pytest
from pyspark.sql import functions as F

from daywise.llm.sentences import sentence_positions, sentence_starts, sentences

# Texts with | before each sentence; the mark is taken off.
CASES = [
    "|Dr. Zellbach saw p. 31 only, i.e. the first. |Then it ended.",
    "|The note says “Sample clotted. Please repeat!” and gives no reason. |Next.",
    "|He replied: “No. 9 is the duplicate.” |Ward 7 agreed.",
    "|“Was it valid?” asked the reviewer. |(The copy was not counted again.) |Both rows share it.",
    "|The value was 7.78 min. |mmol/L and mg/dL must not be mixed. |pH was 7.4 on arrival.",
    "|It rose, etc. |The rest did not.",
    "|Heading here\n\n|A line that\ngoes on. |Another.",
    "|1. first item\n|2. second item\n|3. third",
    "|- one\n|- two\n\n|Text - with a dash.",
    "|Der Wert lag bei 5,3 am 7. Tag. |Siehe Abb. 5 bzw. Tab. 3, z. B. bei Verlegung. |„Gilt das?“, fragte die Prüferin. |Nein!",
    "|La ligne n° 3 reste indécis ; l'unité manque. |Le Dr Varrick a-t-il validé ? |Non !",
    "|La nota dice: «Muestra coagulada. Repetir». |¡No se encontró nada! |Véase la pág. 82.",
    "|Д-р Вессина указывает 76,0 г/л, т. е. после выписки. |См. рис. 6 и стр. 24.",
    "|血红蛋白为5.3g/L。|“页眉适用吗？”审核者问道。|（副本不计数。）|记录写道：“凝固。请重采！”|完。|未决……|下一句。",
    "|備考に「検体凝固。再採取。」とある。|次の文。|「有効か？」と尋ねた。",
    "|नमूना स्पष्ट नहीं है। |डॉ. मिरेंका ने लिखा (देखें चित्र 3)। |क्या?",
    "|المراجع لا يحمل وقتا. |د. ميرنكا يذكر القيمة 5.3؛ والوحدة مفقودة. |هل هو واضح؟ |نعم!",
    "|Dr. J. R. Smith came. |Prof. A. Miller and John F. Kennedy left.",
    "|The U.S. Army came. |It lives in the U.S. |The war ended. |Is U.S. law valid?",
    "|Take Vitamin B. |Next day it rose. |See Table B. |Patients agreed.",
    "|“" + "(" * 20 + "One. Two.” said he. |Next.",
    "|" + "x" * 300 + " " * 100 + "Dr. Miller came. |Y" + "y" * 100 + ". |Next.",
    "|หน้าที่ 9 ไม่ระบุเวลา |แพทย์เวรไม่มีหน่วยวัด |ค่า 9.1 และ 8 มาจากรายงานเดียวกัน",
]


@pytest.mark.parametrize("marked", CASES)
def test_boundaries(marked):
    text, want = "", []
    for c in marked:
        if c == "|":
            want.append(len(text))
        else:
            text += c
    assert sentence_starts(text) == want


def test_blank_and_long():
    assert sentence_starts(None) == sentence_starts("") == sentence_starts(" \n　\t") == []
    assert sentence_starts("　 a") == [2]
    assert len(sentence_starts("Yes it is. " * 20_000)) == 20_000
    assert sentence_starts("(" * 100_000) == [0]
    assert len(sentence_starts("(“a. B” [" * 20_000 + "End. Go.")) >= 1


def test_documents(spark):
    rows = [(1, "One. Two.", "en"), (1, "One. Two.", "en"), (2, None, "en"), (3, "", None), (4, "  ", "xx"), (5, "Ja. Nein.", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("start_pos", F.lit("clash")).withColumn("i", F.lit(1))
    got = sorted((r.doc_id, r.start_pos) for r in sentence_positions(df).collect())
    assert got == [(1, 0), (1, 0), (1, 5), (1, 5), (5, 0), (5, 4)]
    assert sentence_positions(df.drop("lang")).count() == 6 and sentence_positions(df.limit(0)).count() == 0
    assert {r.sentence for r in sentences(df).filter("doc_id = 1").collect()} == {"One.", "Two."}
