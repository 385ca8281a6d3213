from pyspark.sql import functions as F

from caseloom.operators.parse import parse_answers, parse_blocks, segment_blocks


def parse(spark, *texts):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "ID string, response string")
    return [r for r in parse_answers(df).orderBy("ID").collect()]


FULL = "\n".join(["Answer 1: ISO_3166-1_ALPHA-2: PT", "Answer 2: Authority of the test"] + [f"Answer {i}: value {i}" for i in range(3, 69)])


def test_complete_block(spark):
    row = parse(spark, FULL)[0]
    assert row.metadata.completeness and row.metadata.question_count == 68
    assert row.metadata.missing_questions == [] and row.metadata.warnings == []
    assert row.answers["Q1"] == "ISO_3166-1_ALPHA-2: PT"
    assert row.metadata.parser_version == "1.1.0" and row.metadata.line_count == 68


def test_answer_layouts(spark):
    a = [r.answers for r in parse(
        spark,
        "Answer 4: \nAnswer 5: UPHELD\nAnswer 6: NO",          # blank answer swallows the next line
        "Answer 4: YES\nAnswer 4: NO",                          # last one wins
        "  Answer 4: YES\nAnswer 5: X",                         # indented line is no answer
        '"Answer 4: YES\nAnswer 5: X"',                         # opening quote dropped, closing kept
        "Answer 04: YES\nAnswer 99: Z",                         # keys keep their digits
        "Answer 7: \u200b Acme \u200b\r\nAnswer 8: a: b",       # zero-width ends, no second trim
        "Answer\u00a09:\u2003x\u3000\nxAnswer 10: no",          # any Unicode space
        "Answer 11: a\x0bb\x85c\u2028d",                        # only \n ends a line
        "Answer 5:\n  ",                                        # nothing but space: an empty answer
    )]
    assert a[0] == {"Q4": "Answer 5: UPHELD", "Q6": "NO"}
    assert a[1] == {"Q4": "NO"}
    assert a[2] == {"Q5": "X"}
    assert a[3] == {"Q4": "YES", "Q5": 'X"'}
    assert a[4] == {"Q04": "YES", "Q99": "Z"}
    assert a[5] == {"Q7": " Acme ", "Q8": "a: b"}
    assert a[6] == {"Q9": "x"}
    assert a[7] == {"Q11": "a\x0bb\x85c\u2028d"}
    assert a[8] == {"Q5": ""}
    assert parse(spark, "Answer 5:", "Answer 5:\n", "Answer 5: ")[0].answers == {}
    assert [r.answers for r in parse(spark, "Answer 5:\n", "Answer 5: ", "Answer 5: x  \n\n")] == [{}, {"Q5": ""}, {"Q5": "x"}]


def test_metadata(spark):
    rows = parse(spark, None, "Answer 1: a\nAnswer 2: b", FULL.replace("Answer 5: X", "Answer 69: X"))
    empty, two, odd = (r.metadata for r in rows)
    assert empty.line_count == 0 and empty.question_count == 0 and not empty.completeness
    assert two.missing_questions == [f"Q{i}" for i in range(3, 69)]
    assert two.warnings == ["incomplete_record: missing=Q3,Q4,Q5,Q6,Q7,Q8,Q9,Q10,Q11,Q12..."]
    # 68 distinct answers count as complete whatever their numbers
    assert odd.completeness and odd.missing_questions == []


def test_line_count_is_splitlines(spark):
    texts = ["", "a", "a\n", "a\r\nb", "a\r\n\r\n", "a\x0bb\x1cc\x85d\u2028e\u2029", "\n", "a\rb\n", "x\x0c"]
    got = [r.metadata.line_count for r in parse(spark, *texts)]
    assert got == [len(t.splitlines()) for t in texts]


def test_lines_cut_at_their_colon_are_those_of_the_pattern(spark):
    """Plain texts leave by Arrow kernels, any other by the pattern; both in one batch, the plan without a regex."""
    plain = ["Answer 3: c\nno answer\nAnswer 1:\u3000a: b \r\nAnswer 070: z\u200b", "Answer 2:x\nAnswer 20: \u200b"]
    odd = ["Answer 1: a\nAnswer 2: b\nAnswer 1: c", "Answer  1: a\nAnswer 2:\nAnswer 3: d", "Answer 5\nAnswer x: y\nAnswer \u0661: q",
           "Answer\n7: g\nAnswered: no\nAnswer: no\nAnswer +1: no", "", None]
    got = [r.answers for r in parse(spark, *plain, *odd)]
    assert got == [dict(pairs) for pairs in (
        [("Q3", "c"), ("Q1", "a: b"), ("Q070", "z")], [("Q2", "x"), ("Q20", "")],
        [("Q2", "b"), ("Q1", "c")], [("Q1", "a"), ("Q2", "Answer 3: d")], [("Q\u0661", "q")], [("Q7", "g")], [], [])]
    df = spark.createDataFrame([("1", FULL)], "ID string, response string")
    assert "regexp" not in parse_answers(df)._jdf.queryExecution().executedPlan().toString()


def test_line_count_of_neighbours(spark):
    texts = ["\r", "\na", "\u00a8\u2028", "\u0085", "\u20a8 \u0405\u0165", "", "\x1d\r\n", "\n\r\n\r", "\u2029\u00a9x"]
    df = spark.createDataFrame([(f"{i:02d}", t) for i, t in enumerate(texts)], "ID string, response string").coalesce(1)
    got = [r.metadata.line_count for r in parse_answers(df).orderBy("ID").collect()]
    assert got == [len(t.splitlines()) for t in texts]


def test_segments(spark):
    text = (
        "junk\nAnswer 1: a\nAnswer 11: b\n\"Answer 1: c\nAnswer 2: d\"\nAnswer  1: dropped\nAnswer 2: gone\nAnswer 1:e\n"
    )
    rows = segment_blocks(spark.createDataFrame([("f", text), ("g", ""), ("h", None)], "f string, value string"))
    got = [(r.f, r.record_index, r.response) for r in rows.orderBy("record_index").collect()]
    assert got == [("f", 0, "Answer 1: a\nAnswer 11: b"), ("f", 1, '"Answer 1: c\nAnswer 2: d"'), ("f", 2, "Answer 1:e")]
    records = parse_blocks(spark.createDataFrame([(text,)], "value string"))
    assert {"record_index", "ingestion_timestamp", "answers", "metadata"} <= set(records.columns)
    assert records.filter(F.col("metadata.question_count") == 2).count() == 2


def test_no_shuffle(spark):
    df = spark.createDataFrame([("1", FULL)], "ID string, response string")
    assert "Exchange" not in parse_answers(df)._jdf.queryExecution().executedPlan().toString()
