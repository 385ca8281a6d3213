import itertools
import json
import random

from pyspark.sql import functions as F

from caseloom.codebook import Codebook
from caseloom.operators import authorities, components, derived, enrich, frequency, graph, matrices, model, qa, retrieval
from caseloom.operators.checks import check_consistency, consistency_flags
from caseloom.operators.parse import parse_answers
from caseloom.operators.wide import WIDE_COLUMNS, clean_wide, validate


def parsed(spark, *rows):
    data = [(f"D{i}", "\n".join(f"Answer {q}: {v}" for q, v in a.items())) for i, a in enumerate(rows)]
    return parse_answers(spark.createDataFrame(data, "ID string, response string"))


def flags(spark, row):
    return consistency_flags(parsed(spark, row)).first().flags


def test_fine_without_amount(spark):
    found = check_consistency(parsed(spark, {37: "0", 53: "ADMINISTRATIVE_FINE"}, {16: "YES"})).collect()
    assert [r.decision_id for r in found] == ["D0"]
    assert found[0].flags == ["admin_fine_present_but_fine_zero_or_invalid"]


def test_filters_do_not_repeat_the_parsing(spark):
    found = check_consistency(parsed(spark, {37: "0", 53: "ADMINISTRATIVE_FINE"}))
    assert found._jdf.queryExecution().executedPlan().toString().count("regexp_extract_all(") == 2


def test_numbers_and_rules_are_evaluated_once(spark, tmp_path):
    parsed(spark, {37: "0"}).write.parquet(str(tmp_path / "p"))
    rows = spark.read.parquet(str(tmp_path / "p"))
    for report in (check_consistency(rows), validate(rows), derived.conflict_matrix(derived.all_flags(rows))):
        plan = report._jdf.queryExecution().executedPlan().toString()
        assert plan.count("regexp_replace(") == 4  # two for each of the two numbers


def test_missing_answers_in_rules(spark):
    assert flags(spark, {27: "YES_REQUIRED"}) == ["q27_yes_required_but_q16_not_yes"]
    assert flags(spark, {60: "YES_REQUIRED_NOT_APPOINTED"}) == ["q60_required_not_appointed_but_q61_missing_no_dpo"]
    assert flags(spark, {4: "NO"}) == ["appeal_outcome_present_but_q4_no"]
    assert flags(spark, {39: "HIT_4PCT_TURNOVER_CAP", 37: "5"}) == ["turnover_cap_claim_unverifiable_turnover_missing"]
    assert flags(spark, {39: "HIT_4PCT_TURNOVER_CAP", 37: "5", 38: "NOT_MENTIONED"}) == []
    assert flags(spark, {49: "YES_LEAD_AUTHORITY_CASE", 1: "ISO_3166-1_ALPHA-2: FR"}) == [
        "cross_border_claim_requires_geo_verification"]
    assert flags(spark, {49: "YES_LEAD_AUTHORITY_CASE", 1: "ISO_3166-1_ALPHA-2: EU"}) == []
    assert flags(spark, {49: "YES_LEAD_AUTHORITY_CASE", 62: "NON_EU_ENTITY_INVOLVED"}) == []
    assert flags(spark, {37: "-5", 53: "ADMINISTRATIVE_FINE"}) == ["admin_fine_present_but_fine_zero_or_invalid"]
    assert flags(spark, {}) == []


def test_wide_row(spark):
    sectors = enrich.sector_dimension(spark.createDataFrame(
        [(0, "J", "Information"), (1, "62", "Programming"), (2, " 6209 ", '"Other"')], "ordinal long, code string, description string"))
    rows = clean_wide(parsed(spark, {
        1: "ISO_3166-1_ALPHA-2: UK", 2: "TYPE:STRING", 3: "2023-10-26", 12: "6299", 16: "YES", 30: "SECURITY,NONE_DISCUSSED,zz",
        31: "SECURITY,NONE_VIOLATED", 37: "0", 53: "REPRIMAND,REPRIMAND", 36: "two  words",
    }, {12: '"6209"'}, {12: "TYPE:X"}, {12: "abc"}), sectors=sectors)
    assert rows.columns == WIDE_COLUMNS and len(WIDE_COLUMNS) == 124
    a, b, c, d = rows.orderBy("decision_id").collect()
    assert (a.country_code, a.country_mapped_from_uk, a.country_whitelist_ok) == ("GB", 1, 0)
    assert (a.dpa_name_raw, a.dpa_name_canonical, a.schema_echo_flag, a.schema_echo_fields) == ("TYPE:STRING", "", 1, "Q2")
    assert (str(a.decision_date), a.decision_year, a.decision_quarter) == ("2023-10-26", 2023, "Q4")
    assert (a.isic_code, a.isic_desc, a.isic_section) == ("62", "Programming", "J")
    assert (a.q30_discussed_known, a.q30_discussed_unknown, a.q30_discussed_exclusivity_conflict) == ("SECURITY,NONE_DISCUSSED", "zz", 1)
    assert (a.n_principles_discussed, a.n_principles_violated, a.n_corrective_measures) == (2, 1, 2)
    assert (a.severity_measures_present, a.remedy_only_case, a.breach_case) == (1, 1, 1)
    assert (a.q36_text, a.q36_tokens, a.q36_lang, a.q31_violated_status) == ("two words", 2, "ENGLISH_LIKELY", "NONE_VIOLATED")
    assert (b.isic_code, b.isic_desc, b.isic_section) == ("6209", "Other", "J")
    assert (c.isic_code, c.schema_echo_fields, d.isic_code, d.isic_section) == ("", "Q12", "abc", "")


def test_every_decision_is_kept(spark):
    rows = parsed(spark, {}, {1: "FR"}, {37: "x"})
    assert clean_wide(rows).count() == 3
    assert {r.decision_id: r.flags for r in validate(rows).collect()} == {"D0": [], "D1": [], "D2": ["fine_parse_error"]}


def test_fill_forward_against_brute_force(spark):
    rng = random.Random(3)
    data = [(i, rng.choice([None, None, "A", "B"])) for i in range(60)]
    df = spark.createDataFrame(data, "p long, v string").repartition(5)
    rows = enrich.fill_forward(df, "p", "v", "f", block_rows=7).orderBy("p").collect()
    last, want = None, []
    for _, v in data:
        last = v or last
        want.append(last)
    assert [r.f for r in rows] == want


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_authority_match_finds_every_pair(spark):
    rng = random.Random(5)
    base = ["data protection office", "national commission", "privacy authority", "dpa", "ico"]

    def mutate(s):
        s = list(s)
        for _ in range(rng.randint(0, 4)):
            i = rng.randrange(len(s) + 1)
            s[i:i + rng.randint(0, 1)] = rng.choice(["", "x", "q"])
        return "".join(s).strip() or "z"

    registry = [(i, "FR", mutate(rng.choice(base))) for i in range(12)]
    wanted = {("FR", mutate(rng.choice(base))) for _ in range(60)}
    names = spark.createDataFrame([*wanted, *wanted], "country string, name string")
    reg = spark.createDataFrame(registry, "authority_id long, country string, authority_name string")
    got = {r.name: (r.authority_id, r.distance) for r in authorities.match_authorities(names, reg, 2).collect()}
    assert len(got) == len(wanted)
    for _, name in wanted:
        best = min(((edit_distance(name, n), i) for i, _, n in registry))
        assert got[name] == ((best[1], best[0]) if best[0] <= 2 else (None, None)), name


def test_pieces_are_the_rarest_disjoint_ones():
    assert authorities._rarest([9, 1, 9, 9, 2, 9, 0, 9], 3, 3) in ([0, 3, 6], [1, 4, 7], [0, 3, 7], [0, 4, 7], [1, 4, 7])
    assert authorities._rarest([5, 0, 5, 5, 1], 2, 2) == [1, 4]
    assert authorities._rarest([3, 1, 2], 1, 2) == [1, 2] and authorities._rarest([7], 0, 4) == [0]
    rng = random.Random(9)
    for _ in range(300):
        size, pieces = rng.randint(1, 3), rng.randint(1, 4)
        costs = [rng.randint(0, 5) for _ in range(size * pieces - size + 1 + rng.randint(0, 6))]
        at = authorities._rarest(costs, size, pieces)
        every = [c for c in itertools.combinations(range(len(costs)), pieces) if all(b - a >= size for a, b in zip(c, c[1:]))]
        assert tuple(at) in every and sum(costs[i] for i in at) == min(sum(costs[i] for i in c) for c in every)


def test_names_that_share_their_words_meet_few_others(spark):
    """2,000 names that differ in a number alone: all four million pairs share most pieces."""
    rng = random.Random(3)
    numbers = rng.sample(range(10**6), 2000)
    name = lambda n: f"data protection supervisory office no {n:06d} of the land"
    known = spark.createDataFrame([("DE", name(n)) for n in numbers], "country string, r_plain string")
    spelt = [(n, name(n).replace("protection", "protecton").replace("office", "ofice")) for n in numbers[:1000]]
    names = spark.createDataFrame([("DE", t, t) for _, t in spelt], "country string, name string, plain string")
    for heavy in (50_000, 100):
        pairs = authorities.candidates(names, known, 2, heavy).distinct()
        found = {(r.name, r.r_plain) for r in pairs.collect()}
        assert all((t, name(n)) in found for n, t in spelt)
        assert len(found) < 40_000  # of 2,000,000


def test_a_heavy_piece_is_split(spark):
    known = spark.createDataFrame([("DE", "abc")], "country string, r_plain string")
    names = spark.createDataFrame([("DE", f"abcx{i}"[:4 + i % 2], f"abcx{i}"[:4 + i % 2]) for i in range(100)], "country string, name string, plain string").distinct()
    assert authorities.candidates(names, known, 1, heavy=3).select("name").distinct().count() == names.filter("length(plain) <= 4").count()


def test_components_equal_union_find(spark):
    rng = random.Random(11)
    path = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)]
    hub = [("a", f"h{i}") for i in range(200)]
    loose = [(f"x{rng.randrange(80)}", f"x{rng.randrange(80)}") for _ in range(45)]
    pairs = path + hub + loose + hub[:3] + [("s", "s"), ("t", None), (None, "u")]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a and b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(pairs, "a string, b string")
    got = {r.node: r.component for r in components.components(df, "a", "b").collect()}
    assert got == {n: find(n) for n in parent}
    assert components.components(df.limit(0), "a", "b").collect() == []


def test_case_links_connect_what_pairs_would(spark):
    rows = parsed(spark, *[{2: f"A{i % 3}", 7: f"Firm {i % 4}", 62: "JOINT_INVESTIGATION" if i % 5 else "UNCLEAR"} for i in range(40)])
    edges = graph.entity_edges(rows)
    groups = {r.decision: r.case_group for r in graph.case_groups(edges).collect()}
    assert len(groups) == 32 and len(set(groups.values())) == 1
    linked = components.components(graph.case_links(edges), "decision", "first_decision").select("component").distinct().count()
    assert linked == 1 and graph.case_links(edges).count() <= 2 * 32


def test_auc_counts_every_pair(spark):
    rng = random.Random(2)
    for spread in (1, 5, 1000):
        rows = [(rng.randrange(spread) / 7, rng.randrange(2)) for _ in range(300)]
        got = model.exact_auc(spark.createDataFrame(rows + [(None, 1)], "s double, y int"), "s", "y", buckets=7).first()
        pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
        wins2 = sum(2 * (p > n) + (p == n) for p in pos for n in neg)
        assert (got.n_positive, got.n_negative, int(got.wins2)) == (len(pos), len(neg), wins2)
        assert abs(got.auc - wins2 / 2 / len(pos) / len(neg)) < 1e-12
    assert model.exact_auc(spark.createDataFrame([(0.5, 1)], "s double, y int"), "s", "y").first().auc is None


def test_qa_summary(spark):
    schema = "q30_discussed_known string, q30_discussed_unknown string, q30_discussed_status string, q31_violated_known string"
    rows = [("A", "x,,y", "DISCUSSED", ""), (" ", "x", "DISCUSSED", ""), ("", " ", " ", ""), (None, None, None, None)]
    out = qa.qa_summary(spark.createDataFrame(rows, schema), 1).collect()
    assert len(out) == 1
    r = out[0]
    assert (r.field_prefix, r.total_rows, r.rows_with_known, r.rows_with_unknown, r.total_unknown_tokens) == ("q30_discussed", 4, 1, 2, 3)
    assert r.status_counts == {"DISCUSSED": 2} and [(t.token, t.n) for t in r.top_unknown_tokens] == [("x", 2)]
    empty = qa.qa_summary(spark.createDataFrame([], schema)).first()
    assert empty.total_rows == 0 and empty.status_counts == {} and empty.top_unknown_tokens == []
    text = qa.qa_summary_csv_rows(qa.qa_summary(spark.createDataFrame(rows, schema))).first()
    assert json.loads(text.status_counts_json) == {"DISCUSSED": 2}
    assert json.loads(text.top_unknown_tokens_json) == [["x", 2], ["y", 1]]


def test_top_tokens_are_cut_before_the_shuffle(spark):
    schema = "q30_discussed_known string, q30_discussed_unknown string, q30_discussed_status string"
    df = spark.createDataFrame([("", "b,a", "X"), ("", "b", "X")], schema)
    ranked = qa.top_unknown_tokens(df, 1)
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert [(r.token, r.n) for r in ranked.collect()] == [("b", 2)]


def test_codebook_of_any_size_keeps_kinds(spark):
    many = [f"T{k}" for k in range(20_001)]
    frame = spark.createDataFrame([("Q1", "ENUM", ["B", "A"]), ("Q2", "TYPE", None), ("Q3", "MULTI_SELECT", many)], "question string, kind string, options array<string>")
    book = Codebook.from_frame(frame)
    assert book.options["Q1"] == ("B", "A") and len(book.options["Q3"]) == 20_001 and book.multi_selects() == ["Q3"]
    row = spark.createDataFrame([(["T20000", "x"],)], "t array<string>").select(book.known("Q3", F.col("t")).alias("k")).first()
    assert row.k == ["T20000"]


def test_quantiles_are_exact_beyond_a_sketch(spark):
    n = 60_000
    rows = spark.range(n).select((F.pmod(F.col("id") * 7919, F.lit(n)) + 0.5).alias("fine_eur"), F.lit("s").alias("k"), (F.col("id") < 0).alias("z"))
    got = frequency.fine_quantiles(rows, ["k"]).first()
    assert (got.p25, got.p50, got.p75, got.p95) == (14999.5, 29999.5, 44999.5, 56999.5)


def test_derived_rows(spark):
    rows = parsed(spark, {
        3: "2017-12-31", 12: "6201; 47", 14: "OVER_1B", 16: "NO", 25: "ARTICLE_9_SPECIAL_CATEGORY", 30: "ACCURACY", 31: "SECURITY",
        39: "HIT_4PCT_TURNOVER_CAP", 40: "ONGOING", 53: "NONE,WARNING", 67: "Guidelines 5/2019, 07/2020", 1: "US", 49: "YES_LEAD_AUTHORITY_CASE",
    })
    d = derived.date_features(rows, "2018-01-01").first()
    assert (d.date_plausible, d.iso_week, d.month_index, d.decision_age_days) == (0, 52, -1, 1)
    s = derived.safeguards(rows).first()
    assert (s.na_conflict_flag, s.powers_audit_status, s.verification_possible) == (1, "MIXED_CONTRADICTORY", 0)
    assert (s.violated_not_discussed, s.cross_border_outside_area, s.breach_content_without_breach) == ("SECURITY", 1, 1)
    x = derived.scales(rows).first()
    assert (x.turnover_range_midpoint_eur, x.range_imputed, x.duration_ordinal, x.deadline_ordinal) == (1e9, 1, 5, None)
    assert [r.guideline for r in derived.guidelines(rows).collect()] == ["5/2019", "07/2020"]
    f = derived.all_flags(rows)
    m = derived.conflict_matrix(f).first()
    assert (m.unverifiable, m.exclusivity, m.contradiction) == (2, 1, 1)
    assert derived.quality_score(f, {"cap_hit_with_zero_fine": 0.3}).first().quality_score == 0.2
    assert {r.flag: r.n for r in derived.validation_summary(f).collect()}["(all)"] == 1
    codes = rows.select(enrich.sector_codes(F.col("answers")["Q12"]).alias("c")).first().c
    assert (codes.primary, codes.secondary, codes.multi) == ("6201", ["47"], 1)
    assert {"source_id", "codebook_version"} <= set(derived.with_provenance(f, "s", "1", "1").columns)
    assert derived.strict(f).count() == 0


def test_matrices_and_profiles(spark):
    rows = parsed(spark, {30: "SECURITY,ACCURACY,SECURITY", 31: "SECURITY"}, {30: "zz", 31: "ACCURACY"}, {})
    pairs = {(r.option_a, r.option_b): r.n for r in matrices.co_occurrence(rows, "Q30", "Q31").collect()}
    assert pairs == {("SECURITY", "SECURITY"): 1, ("ACCURACY", "SECURITY"): 1}
    m = matrices.option_matrix(rows, questions=["Q30"]).orderBy("decision_id").collect()
    assert [r.Q30_SECURITY for r in m] == [1, 0, 0] and len(m[0]) == 9
    p = {(r.question, r.status): r.n for r in matrices.missingness_profile(matrices.missingness_cells(rows)).collect()}
    assert p[("Q30", "DISCUSSED")] == 2 and p[("Q68", "NOT_MENTIONED")] == 3
    prof = {r.column_name: r for r in frequency.column_profile(spark.createDataFrame([("a", 1), ("", 2)], "s string, n int")).collect()}
    assert prof["s"].filled_rows == 1 and prof["n"].max_value == "2" and prof["n"].approx_distinct == 2


def test_graph(spark):
    rows = parsed(spark, {2: "Office", 7: "Acme", 30: "SECURITY,SECURITY", 62: "LEAD_SUPERVISORY_AUTHORITY_CASE"}, {2: "TYPE:STRING"})
    edges = {tuple(r) for r in graph.entity_edges(rows).collect()}
    assert edges == {
        ("authority:Office", "decided", "decision:D0"), ("decision:D0", "involves", "defendant:Acme"),
        ("authority:Office", "leads", "decision:D0"), ("decision:D0", "discusses", "principle:SECURITY"),
    }
    deg = {r.node: (r.out_degree, r.in_degree) for r in graph.degrees(graph.entity_edges(rows)).collect()}
    assert deg["decision:D0"] == (2, 2)


def test_retrieval(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0])], "id int, v array<float>")
    top = retrieval.most_similar(df, [1.0, 0.1], 2, "id", "v")
    assert [r.id for r in top.collect()] == [1, 3]
    assert "TakeOrderedAndProject" in top._jdf.queryExecution().executedPlan().toString()


def test_model_and_leakage_guard(spark):
    rng = random.Random(1)
    rows = [{30: "SECURITY", 31: "SECURITY" if i % 2 else "NOT_DETERMINED", 38: str(rng.randint(1, 9)),
             53: "ADMINISTRATIVE_FINE" if (i % 2 and i % 7) else "WARNING"} for i in range(120)]
    features = model.model_features(parsed(spark, *rows))
    assert "admin_fine" not in model.predictors(features, "admin_fine")
    effects, auc = model.fit_logistic(features, columns=["n_principles_violated", "turnover_log1p", "breach_case"])
    assert auc > 0.8 and {r.feature: r.effect for r in effects.collect()}["n_principles_violated"] > 0
    try:
        model.fit_logistic(features, columns=["fine_log1p"])
    except ValueError:
        return
    raise AssertionError("target-derived predictors must be refused")
