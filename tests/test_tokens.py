import unicodedata

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from caseloom.codebook import Codebook
from caseloom.functions import tokens as tk
from caseloom.functions.text import normalize_text, strip
from caseloom.operators.long import emit_long
from caseloom.operators.tokens import harmonized_tokens, known_tokens, question_tokens, unknown_tokens, validate_tokens_long


def parsed(spark, *rows):
    data = [(f"D{i}", a) for i, a in enumerate(rows)]
    return spark.createDataFrame(data, "ID string, answers map<string,string>")


def test_split_and_status(spark):
    cases = [
        ("Q30", "A, ,B,,A", ["A", "B", "A"], "DISCUSSED", 0),
        ("Q30", None, [], "NOT_MENTIONED", 0),
        ("Q30", "ENUM:A,B", ["B"], "DISCUSSED", 0),
        ("Q30", "NONE_DISCUSSED", ["NONE_DISCUSSED"], "NONE_DISCUSSED", 0),
        ("Q32", "NONE_DISCUSSED", ["NONE_DISCUSSED"], "DISCUSSED", 0),
        ("Q31", "SECURITY,NONE_VIOLATED,NOT_DETERMINED", ["SECURITY", "NONE_VIOLATED", "NOT_DETERMINED"], "NONE_VIOLATED", 1),
        ("Q57", "NOT_DETERMINED", ["NOT_DETERMINED"], "NOT_DETERMINED", 0),
        ("Q31", "NOT_APPLICABLE,NOT_APPLICABLE", ["NOT_APPLICABLE"] * 2, "NOT_APPLICABLE", 0),
        ("Q46", "NONE_MENTIONED", ["NONE_MENTIONED"], "NONE_MENTIONED", 0),
        ("Q46", "NONE_MENTIONED,CHILDREN", ["NONE_MENTIONED", "CHILDREN"], "DISCUSSED", 1),
        ("Q46", "UNCLEAR,NOT_MENTIONED", ["UNCLEAR", "NOT_MENTIONED"], "DISCUSSED", 0),
        ("Q53", "NONE,NOT_APPLICABLE", ["NONE", "NOT_APPLICABLE"], "DISCUSSED", 0),
    ]
    df = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(cases)], "i int, q string, v string")
    t = tk.answer_tokens(F.col("v"))
    rows = df.select("i", t.alias("t")  , tk.multiselect_status(F.col("q"), t).alias("s"), tk.exclusivity_conflict(t).alias("c")).orderBy("i").collect()
    assert [(r.t, r.s, r.c) for r in rows] == [c[2:] for c in cases]


def test_measures(spark):
    df = spark.createDataFrame([(["NONE_DISCUSSED"], ["SECURITY", "NONE_VIOLATED"], ["REPRIMAND", "NONE"], None),
                                ([], [], ["ADMINISTRATIVE_FINE"], 5.0), ([], [], ["WARNING"], 5.0), ([], [], [], 0.0)],
                               "a array<string>, b array<string>, c array<string>, f double")
    got = df.select(tk.principles_discussed(F.col("a")), tk.principles_violated(F.col("b")), tk.corrective_measures(F.col("c")),
                    tk.severity_present(F.col("c")), tk.remedy_only(F.col("c"), F.col("f"))).collect()
    assert [tuple(r) for r in got] == [(1, 1, 1, 1, 1), (0, 0, 1, 1, 0), (0, 0, 1, 1, 0), (0, 0, 0, 0, 0)]


def test_long_rows(spark):
    rows = emit_long(parsed(
        spark,
        {"Q30": "Zeta,SECURITY,SECURITY", "Q35": "NOT_APPLICABLE", "Q31": "ENUM:A", "Q41": " ", "Q53": "NONE"},
        {"Q35": "TYPE:X", "Q46": "ENUM:A,CHILDREN"},
    )).collect()
    got = sorted((r.decision_id, r.role, r.option, r.status, r.token_status) for r in rows)
    assert got == [
        ("D0", "article_5_discussed", "SECURITY", "DISCUSSED", "KNOWN"),
        ("D0", "article_5_discussed", "Zeta", "DISCUSSED", "UNKNOWN"),
        ("D0", "article_5_violated", "DISCUSSED", "DISCUSSED", "STATUS_ONLY"),
        ("D0", "corrective_powers", "NONE", "DISCUSSED", "KNOWN"),
        ("D0", "li_test_outcome", "NOT_APPLICABLE", "DISCUSSED", "KNOWN"),
        ("D1", "vulnerable_groups", "CHILDREN", "DISCUSSED", "KNOWN"),
    ]
    # known tokens come before unknown ones
    assert [r.option for r in rows if r.role == "article_5_discussed"] == ["SECURITY", "Zeta"]


def test_codebook_without_options_accepts_all(spark):
    rows = emit_long(parsed(spark, {"Q30": "Anything"}), Codebook({})).collect()
    assert [r.token_status for r in rows] == ["KNOWN"]


def test_validation_joins(spark):
    tokens = question_tokens(parsed(spark, {"Q30": "SECURITY,x", "Q99": "free"}), ["Q30", "Q99"])
    book = Codebook.default().to_frame(spark)
    got = {(r.question, r.token): r.token_status for r in validate_tokens_long(tokens, book).collect()}
    assert got == {("Q30", "SECURITY"): "KNOWN", ("Q30", "x"): "UNKNOWN", ("Q99", "free"): "KNOWN"}
    assert [r.token for r in known_tokens(tokens, book).collect()] == ["SECURITY"]
    assert [r.token for r in unknown_tokens(tokens, book).collect()] == ["x"]
    fixed = harmonized_tokens(question_tokens(parsed(spark, {"Q30": "Storage limitation,FORMAT:X,odd"}), ["Q30"]), book)
    assert sorted((r.raw_token, r.token, r.validation_error) for r in fixed.collect()) == [
        ("Storage limitation", "STORAGE_LIMITATION", 0), ("odd", "ODD", 1)]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aBe ,\u00a0\u2003\u200b\u00e9\u0301\u1161\u1100\n\x1c\ufeff", max_size=12), min_size=20, max_size=20))
def test_python_equivalence(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, v string")
    rows = df.select("i", strip(F.col("v")).alias("s"), tk.split_tokens(F.col("v")).alias("t"), normalize_text(F.col("v")).alias("n"),
                     F.array_distinct(tk.split_tokens(F.col("v"))).alias("d")).orderBy("i").collect()
    for text, r in zip(texts, rows, strict=True):
        assert r.s == text.strip()
        assert r.t == [x.strip() for x in text.split(",") if x.strip()]
        assert r.d == list(dict.fromkeys(r.t))
        plain = unicodedata.normalize("NFC", text)
        for z in "\u200b\u200c\u200d\ufeff":
            plain = plain.replace(z, "")
        assert r.n == " ".join(plain.split())


def test_answer_columns_are_the_answers(spark):
    rows = parsed(spark, {"Q1": "a", "Q3": ""}, {"Q2": "b"}, {})
    got = tk.answer_columns(rows, {"one": "Q1", "two": "Q2", "three": "Q3", "again": "Q1"}, "ID")
    assert got.columns == ["ID", "one", "two", "three", "again"]
    assert [tuple(r) for r in got.orderBy("ID").collect()] == [("D0", "a", None, "", "a"), ("D1", None, "b", None, None), ("D2", None, None, None, None)]


def test_lookups_are_a_loop(spark):
    """Written out, each lookup adds to one generated method, which is then never compiled."""
    rows = parsed(spark, {"Q1": "a"})
    few, many = ([f"Q{i}" for i in range(1, n)] for n in (5, 65))
    size = lambda qs: rows.select(tk.answer_list(F.col("answers"), qs).alias("x"))._jdf.queryExecution().optimizedPlan().toString().count("answers#")
    assert size(few) == size(many)
    assert [(x.question, x.answer) for x in rows.select(tk.answer_list(F.col("answers"), ["Q2", "Q1"]).alias("x")).first().x] == [("Q2", None), ("Q1", "a")]
