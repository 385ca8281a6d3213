import csv
import json
import math

from pyspark.sql import functions as F

from caseloom.codebook import Codebook
from caseloom.operators import corpus, enrich
from caseloom.operators.parse import parse_answers
from caseloom.plans.run import derive, run_all
from caseloom.sources import readers, sinks
from caseloom.sources.shared import shared_dir
from caseloom.streaming import incremental
from workload import queries as wq

SMALL = "/root/testdata/sf0.001"


def test_master_csv(spark, tmp_path):
    p = tmp_path / "master.csv"
    with p.open("w", newline="", encoding="utf-8") as f:
        w = csv.writer(f)
        w.writerows([["ID", "response"], ["X1", 'Answer 1: a "b", c\nAnswer 2: d'], ["X2", ""], ["X3", "Answer 1: \u00e9\r\nAnswer 2: x"]])
    rows = {r.ID: r.response for r in readers.read_master_csv(spark, str(p)).collect()}
    assert rows["X1"] == 'Answer 1: a "b", c\nAnswer 2: d' and rows["X2"] == ""
    parsed = {r.ID: r.answers for r in parse_answers(readers.read_master_csv(spark, str(p))).collect()}
    assert parsed["X3"] == {"Q1": "\u00e9", "Q2": "x"}


def test_codebook_json_and_prompt(spark, tmp_path):
    (tmp_path / "book.json").write_text(json.dumps({"questions": {
        "30": {"kind": "MULTI_SELECT", "options": ["B", "A"]}, "2": {"kind": "TYPE", "type": "STRING"}, "4": {"kind": "ENUM", "options": ["YES"]}}}))
    book = Codebook.from_frame(readers.read_codebook(spark, str(tmp_path / "book.json")))
    assert book.options == {"Q30": ("B", "A"), "Q4": ("YES",)}
    (tmp_path / "prompt.md").write_text(
        "# T\n\n**Question 1:** c?\n**Answer 1:** CODES: A,B\n\n**Question 2:** n\n**Answer 2:** TYPE:STRING\n"
        "**Answer 3:** see below\nENUM: YES , NO,\n**Answer 4:** MULTI_SELECT:A,B\n**Answer 4:** ENUM:C\nlast line\n")
    rows = {r.question: (r.kind, r.options) for r in readers.read_codebook_prompt(spark, str(tmp_path / "prompt.md")).collect()}
    assert rows == {"Q1": ("RAW", None), "Q2": ("TYPE", None), "Q3": ("ENUM", ["YES", "NO"]), "Q4": ("ENUM", ["C"])}


def test_sector_csv(spark, tmp_path):
    p = tmp_path / "sectors.csv"
    p.write_text('"Code","Description"\n"S","Shops, stalls and markets"\n"47","Retail, all kinds"\n'
                 '"4711","Corner\nshops"\nshort\n"47","Again",extra\nK,Finance\n64,\n', encoding="utf-8")
    dim = {r.code: (r.description, r.section) for r in enrich.sector_dimension(readers.read_sector_csv(spark, str(p))).collect()}
    assert dim["4711"] == ("Corner\nshops", "S") and dim["47"] == ("Again", "S")
    assert dim["K"] == ("Finance", "K") and dim["64"] == ("", "K") and "short" not in dim


def test_redelivery_after_the_horizon_counts_again(spark, tmp_path):
    schema = "decision_id string, ingestion_timestamp timestamp"
    src, out, ck = (str(tmp_path / n) for n in ("src2", "out2", "ck2"))
    arrivals = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 21:36:00"), ("b", "2024-01-02 06:00:00"), ("c", "2024-01-03 07:00:00"), ("a", "2024-01-02 12:00:00")]
    for row in arrivals:
        spark.createDataFrame([row], "decision_id string, t string").select(
            "decision_id", F.to_timestamp("t").alias("ingestion_timestamp")).write.mode("append").parquet(src)
        incremental.write_available(incremental.drop_redelivered(spark.readStream.schema(schema).parquet(src)), out, ck)
    got = [r.decision_id for r in spark.read.schema(schema).parquet(out).collect()]
    assert sorted(got) == ["a", "a", "b", "c"]


def test_run_all_and_sinks(spark, tmp_path):
    responses = spark.createDataFrame([
        ("D0", "Answer 1: ISO_3166-1_ALPHA-2: FR\nAnswer 3: 2020-02-03\nAnswer 30: SECURITY,odd\nAnswer 37: 1000.5\nAnswer 53: ADMINISTRATIVE_FINE"),
        ("D1", "Answer 37: 0\nAnswer 53: ADMINISTRATIVE_FINE"),
    ], "ID string, response string")
    tables = run_all(spark, responses, str(tmp_path / "run"))
    assert tables.wide.count() == 2 and tables.validation.count() == 2 and tables.consistency.count() == 1
    assert tables.long.filter("role = 'article_5_discussed'").count() == 2
    assert tables.long.filter("role = 'dpo_issues'").count() == 0
    lazy = derive(parse_answers(responses))
    assert sorted(map(tuple, lazy.long.select("decision_id", "role", "option").collect())) == sorted(
        map(tuple, tables.long.select("decision_id", "role", "option").collect()))
    text = sinks.wide_csv_rows(tables.wide).orderBy("decision_id").first()
    assert (text.fine_eur, text.fine_log1p, text.decision_date, text.turnover_eur) == (
        "1000.500000", f"{math.log1p(1000.5):.6f}", "2020-02-03T00:00:00+00:00", "")
    sinks.write_wide_csv(tables.wide, str(tmp_path / "csv"))
    with next((tmp_path / "csv").glob("part-*.csv")).open(newline="", encoding="utf-8") as f:
        back = list(csv.DictReader(f))
    assert len(back[0]) == 124 and back[0]["turnover_eur"] == ""
    plan = tables.long.filter("role = 'dpo_issues'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(role" in plan


def test_shared_dir_is_read_from_the_session(spark):
    assert shared_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")


def test_corpus_reader_and_fields(spark, tmp_path):
    d = tmp_path / "c" / "authorities" / "Czech Republic"
    d.mkdir(parents=True)
    (d / "a+b.md").write_text(
        "# T\n\n**Jurisdiction:** Czechia\n\n**Authority:** X\n\n**Fine:** 900.000 EUR\n\n**Decided:** 5. 2. 2020\n\n**Relevant Law:** Article 5(1)(f) GDPRArticle 32 GDPR\n\n"
        "## Contents\n\n**Authority:** no\n\n## English Summary\n\n### Facts\n\nfacts\nmore\n\n### Holding\n\nheld\n\n## Comment\n\n"
        "## English Machine Translation of the Decision\n\ntext\n## Part\nend\n", encoding="utf-8")
    (d / "w.md").write_text("# Welcome to the wiki\n", encoding="utf-8")
    (d / "x.md").write_text("neither heading nor header\n## Contents\n**Jurisdiction:** too late\n", encoding="utf-8")
    docs = readers.read_corpus(spark, str(tmp_path / "c"))
    assert docs.select("doc_id").distinct().count() == 3
    kept = corpus.drop_non_decisions(docs)
    assert kept.count() == 1
    r = corpus.sections(corpus.corpus_columns(corpus.header_fields(kept))).first()
    assert (r.body_type, r.country, r.file_name) == ("authorities", "Czech Republic", "a+b.md")
    assert r.header["Authority"] == "X" and str(r.decided) == "2020-02-05"
    assert (float(r.fine_amount), r.fine_currency) == (900000.0, "EUR")
    assert (r.facts, r.holding, r.comment, r.machine_translation) == ("facts\nmore", "held", "", "text\n## Part\nend")
    cited = corpus.cited_articles(corpus.header_fields(kept), "doc_id").orderBy("position").collect()
    assert [c.article for c in cited] == ["Article 5(1)(f)", "Article 32"]


def test_exact_duplicates_of_a_hot_text(spark):
    df = spark.createDataFrame([(i, "same" if i % 3 else f"t{i}") for i in range(60)], "id long, text string")
    kept = corpus.drop_exact_duplicates(df, "id").collect()
    assert sorted(r.id for r in kept) == sorted({1} | {i for i in range(60) if i % 3 == 0})


def test_stream_equals_batch(spark, tmp_path):
    events = wq.table(spark, SMALL, "events")
    batch = parse_answers(wq.event_responses(events)).select("ID", "answers")
    stream = incremental.parse_stream(wq.event_responses(wq.event_stream(spark, SMALL))).select("ID", "answers")
    incremental.write_available(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    out = spark.read.schema(stream.schema).parquet(str(tmp_path / "out"))
    as_rows = lambda df: sorted((r.ID, tuple(sorted(r.answers.items()))) for r in df.collect())
    assert as_rows(out) == as_rows(batch)


def test_redelivered_once_across_batches(spark, tmp_path):
    schema = "decision_id string, ingestion_timestamp timestamp"
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    for part in ([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:05:00"), ("b", "2024-01-01 01:00:00")],
                 [("a", "2024-01-01 02:00:00"), ("c", "2024-01-01 03:00:00")]):
        spark.createDataFrame(part, "decision_id string, t string").select(
            "decision_id", F.to_timestamp("t").alias("ingestion_timestamp")).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        incremental.write_available(incremental.drop_redelivered(stream), out, ck)
    got = [r.decision_id for r in spark.read.schema(schema).parquet(out).collect()]
    assert sorted(got) == ["a", "b", "c"]
