"""Token work by Arrow kernels, against the rules written out in Python."""

from pyspark.sql import functions as F

from caseloom import vocab
from caseloom.codebook import Codebook
from caseloom.operators.long import emit_long, long_cells
from caseloom.operators.wide import multiselect_fields
from caseloom.sources import sinks
from workload import queries

ANSWERS = ["", ",", "SECURITY, ODD , SECURITY", "MULTI_SELECT:X", "TYPE:STRING,ODD", "NOT_APPLICABLE,NOT_APPLICABLE", "NONE_MENTIONED, SECURITY",
           "NONE_DISCUSSED", "NOT_DETERMINED,SECURITY", "a:b, ACCURACY ", None]


def answered(spark):
    rows = [(f"D{i}", {q: a for q in ("Q30", "Q31", "Q35") if a is not None}) for i, a in enumerate(ANSWERS)]
    return spark.createDataFrame([*rows, (None, {"Q30": "SECURITY"}), ("D3", {"Q30": "SECURITY"}), ("N", None)], "ID string, answers map<string,string>")


def tokens_of(a):
    return [t for t in (x.strip(vocab.SPACE_CHARS) for x in (a or "").split(",")) if t and not t.startswith(vocab.ECHO_PREFIXES)]


def status_of(q, t):
    if not t:
        return "NOT_MENTIONED"
    for word in ("NONE_VIOLATED", "NOT_DETERMINED"):
        if q == "Q31" and word in t:
            return word
    return t[0] if len({*t}) == 1 and t[0] in ("NOT_APPLICABLE", "NONE_MENTIONED", *["NONE_DISCUSSED"] * (q == "Q30")) else "DISCUSSED"


def test_fields_of_many_answers(spark):
    book = Codebook.default()
    found = answered(spark).filter("ID like 'D%'").select("ID", "answers", multiselect_fields(F.col("answers"), ["Q30", "Q31"], book).alias("f"))
    assert "array_contains" not in found._jdf.queryExecution().executedPlan().toString()  # no lambda looks at tokens one by one
    for row in found.collect():
        for q, f in zip(("Q30", "Q31"), row.f):
            t = tokens_of(row.answers.get(q))
            assert f.known == ",".join(x for x in t if x in book.allowed(q))
            assert f.unknown == ",".join(x for x in t if x not in book.allowed(q))
            assert f.status == status_of(q, t)
            assert f.conflict == any(x in vocab.EXCLUSIVE_MARKERS for x in t) * any(x not in vocab.EXCLUSIVE_MARKERS for x in t)


def test_long_rows_of_many_answers(spark):
    book, want = Codebook.default(), []
    for row in answered(spark).collect():
        for role, q in vocab.LONG_ROLES:
            a = (row.answers or {}).get(q)
            if a is None:
                continue
            if role in vocab.SINGLE_VALUE_ROLES:
                whole = a.strip(vocab.SPACE_CHARS)
                t, mute, status = [whole] if whole and not whole.startswith(vocab.ECHO_PREFIXES) else [], False, "DISCUSSED"
            else:
                t = list(dict.fromkeys(tokens_of(a)))
                mute, status = not t and any(x.strip(vocab.SPACE_CHARS) for x in a.split(",")), status_of(q, t)
            want += [(row.ID, role, x, status, "KNOWN" if x in book.allowed(q) else "UNKNOWN") for x in t]
            want += [(row.ID, role, "DISCUSSED", "DISCUSSED", "STATUS_ONLY")] * mute
    got = emit_long(answered(spark), book)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert "array_remove" not in got._jdf.queryExecution().executedPlan().toString()


def test_cells_are_written_as_rows(spark, tmp_path):
    sinks.write_long_cells(long_cells(answered(spark)), str(tmp_path / "long"))
    columns = ["decision_id", "role", "option", "status", "token_status"]
    back = spark.read.parquet(str(tmp_path / "long")).select(*columns)
    assert sorted(map(str, back.collect())) == sorted(map(str, emit_long(answered(spark)).select(*columns).collect()))


def test_master_file_is_written_where_its_texts_are_made(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(f"D{i}", f"Answer 1: a,{i}\nAnswer 2: \"b\"") for i in range(60)], "ID string, response string").repartition(6)
    monkeypatch.setattr(queries, "responses", lambda spark, sf_dir: rows)
    monkeypatch.setattr(queries, "scratch", lambda spark, name: str(tmp_path / name))
    found = queries.s1_master_csv(spark, "")
    assert len(list((tmp_path / "master").glob("*.csv"))) == 6  # no shuffle of the texts before
    assert sorted((r.ID, r.Q1) for r in found.select("ID", "Q1").collect()) == sorted((f"D{i}", f"a,{i}") for i in range(60))
