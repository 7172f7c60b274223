from pyspark.sql import functions as F

from corvane.operators import blocking, decide, diagnose, features, metrics, model, validate
from corvane.plans import queries
from corvane.sources import readers, writers

ENTITY = "entity_id string, source int, business_name string, business_address string, country string"


def entities(spark, *rows):
    return blocking.normalized(spark.createDataFrame(list(rows), ENTITY))


def keys(spark, name, address, column=None):
    rows = entities(spark, ("S1-1", 1, name, address, "us"))
    return {(r["type"], r["value"]) for r in blocking.keys(rows, column).collect()}


def test_all_key_types(spark):
    got = keys(spark, "Alpha Onp Beta Gamma Ltd", "D-162 126/4 Maple Park Road 560001 22nd Street")
    assert ("NP4", "alph") in got and ("NP6", "alphao") in got and ("NCOMP", "alphaonpbetagamma") in got
    assert ("TOK", "alpha") in got and ("TOK3", "onp") in got and ("NSORT", "alpha_beta_gamma_onp") in got
    assert ("UNIT", "d162") in got and ("PLOT", "126/4") in got and ("POSTAL", "560001_alp") in got
    assert ("ADDR", "d-162_126/4") in got and ("ADDR_LOC", "maple_park") in got
    assert not any(v == "22nd" for _, v in got)


def test_an_empty_strategy_set_means_all(spark):
    assert keys(spark, "Alpha Beta", "", blocking.key_array(set())) == keys(spark, "Alpha Beta", "")
    assert {t for t, _ in keys(spark, "Alpha Beta", "", blocking.key_array({"name_sorted"}))} == {"NSORT"}


def test_blocks_at_the_cap_stay_and_beyond_it_go(spark):
    made = [("US", "TOK", "a", f"S2-{i}", 2) for i in range(3)] + [("US", "TOK", "b", f"S3-{i}", 3) for i in range(4)]
    left = blocking.prune(spark.createDataFrame(made, "country string, type string, value string, entity_id string, source int"), 3)
    assert {r["value"] for r in left.collect()} == {"a"}


def test_ties_in_the_top_k_go_by_id(spark):
    pairs = spark.createDataFrame([("S1-1", "S2-9", "source2", 2.0), ("S1-1", "S2-1", "source2", 2.0), ("S1-1", "S3-1", "source3", 4.0)], "source1_id string, candidate_id string, candidate_source string, blocking_score double")
    got = [(r["candidate_id"], r["blocking_rank"], r["blocking_score_ratio"]) for r in blocking.top_k(pairs, 2).orderBy("blocking_rank").collect()]
    assert got == [("S3-1", 1.0, 1.0), ("S2-1", 2.0, 0.5)]


def test_features_of_unknown_sides_are_zero(spark):
    rows = entities(spark, ("S1-1", 1, "Alpha", "1 Road", "us"), ("S2-1", 2, "Alpha", "1 Rd", "us"))
    pairs = spark.createDataFrame([("S1-1", "S2-1", "source2"), ("S1-1", "S2-7", "source2")], "source1_id string, candidate_id string, candidate_source string")
    got = {r["candidate_id"]: r.asDict() for r in features.matrix(pairs, features.lookup(rows), features.COMBINED_FEATURES).collect()}
    assert got["S2-1"]["name_exact"] == 1.0 and got["S2-1"]["address_exact"] == 0.0 and got["S2-1"]["address_normalized_exact"] == 1.0
    assert got["S2-1"]["blocking_score"] == 1.0 and got["S2-1"]["locality_match"] == 0.5
    assert all(got["S2-7"][n] == 0.0 for n in features.COMBINED_FEATURES)
    assert (len(features.BASE_FEATURES), len(features.COMBINED_FEATURES), len(features.ENHANCED_FEATURES)) == (26, 37, 41)


PAIR = "source1_id string, candidate_id string, candidate_source string, probability double, building_b string"


def test_thresholds_by_rank(spark):
    df = spark.createDataFrame([(float(r), "US") for r in (1, 3, 4, 6, 7, 10, 11)], "r double, c string")
    got = [round(x[0], 2) for x in df.select(decide.rank_threshold(decide.base_threshold(0.75, F.col("c")), F.col("r"))).collect()]
    assert got == [0.78, 0.78, 0.81, 0.81, 0.84, 0.84, 0.87]


def test_vetoes(spark):
    df = spark.createDataFrame([("acme north", "acme south"), ("acme north", "acme"), ("acme retail", "acme express"), (None, "acme")], "a string, b string")
    assert [r[0] for r in df.select(decide.branch_conflict(F.col("a"), F.col("b"))).collect()] == [True, False, True, False]
    df = spark.createDataFrame([("3150", "742", "x", "y"), ("3150", "742", "x", "x"), ("", "742", "x", "y")], "a string, b string, c string, d string")
    assert [r[0] for r in df.select(decide.building_clash(*map(F.col, "abcd"))).collect()] == [True, False, False]


def test_only_the_best_of_each_source_clash(spark):
    rows = [("S1-1", "S2-1", "source2", 0.9, "1"), ("S1-1", "S3-1", "source3", 0.9, "2"), ("S1-1", "S3-2", "source3", 0.8, "3"), ("S1-2", "S2-1", "source2", 0.8, "1"), ("S1-2", "S3-1", "source3", 0.9, "2"), ("S1-3", "S2-1", "source2", 0.8, "")]
    got = {(r[0], r[1]) for r in decide.consistent(spark.createDataFrame(rows, PAIR)).select("source1_id", "candidate_id").collect()}
    assert got == {("S1-1", "S2-1"), ("S1-1", "S3-2"), ("S1-2", "S3-1"), ("S1-3", "S2-1")}


def test_lists_are_ordered_and_complete(spark):
    rows = [("S1-1", "S2-2", "source2", 0.9, ""), ("S1-1", "S2-1", "source2", 0.9, ""), ("S1-1", "S1-9", "source2", 1.0, ""), ("S1-1", "S3-1", "source3", 0.95, "")]
    required = spark.createDataFrame([("S1-1",), ("S1-2",)], "entity_id string")
    got = {r[0]: r[1] for r in decide.match_lists(spark.createDataFrame(rows, PAIR), required).collect()}
    assert got == {"S1-1": ["S3-1", "S2-1", "S2-2"], "S1-2": []}
    lists = spark.createDataFrame([("S1-1", ["S2-1"])], "source1_id string, candidates array<string>")
    made = decide.submission(decide.match_lists(spark.createDataFrame(rows, PAIR), required), lists)
    assert {r[0]: r[2] for r in made.collect()} == {"S1-1": ["S2-1", "S3-1", "S2-2"], "S1-2": []}


def test_metric_branches(spark):
    required = spark.createDataFrame([(f"S1-{i}",) for i in range(4)], "source1_id string")
    truth = spark.createDataFrame([("S1-2", "S2-1"), ("S1-3", "S2-1"), ("S1-3", "S2-2")], "source1_id string, candidate_id string")
    made = spark.createDataFrame([("S1-1", "S2-1"), ("S1-3", "S2-1"), ("S1-3", "S2-9")], "source1_id string, candidate_id string")
    rows = metrics.entity_prf(metrics.entity_counts(made, truth, required)).orderBy("source1_id").collect()
    assert [(r["precision"], r["recall"], r["f"]) for r in rows] == [(1.0, 1.0, 1.0), (0.0, 1.0, 0.0), (0.0, 0.0, 0.0), (0.5, 0.5, 0.5)]
    whole = metrics.evaluate(truth, truth, required).first()
    assert whole["macro_f05"] == 1.0 and whole["singleton_accuracy"] == 1.0 and whole["micro_f05"] == 1.0
    none = metrics.evaluate(truth.limit(0), truth.limit(0), required.limit(0)).first()
    assert none["singleton_accuracy"] == 1.0 and none["macro_f05"] == 0.0


def test_best_takes_the_lowest_threshold_of_equals(spark):
    swept = spark.createDataFrame([(0.5, 0.9), (0.4, 0.9), (0.6, 0.8)], "threshold double, macro_f05 double")
    assert metrics.best(swept, "macro_f05", ["threshold"]).first()[0] == 0.4


def test_auc(spark):
    rows = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1)], "probability double, label int")
    assert metrics.roc_auc(rows).first()[0] == 0.75
    assert metrics.roc_auc(rows.where("label = 1")).first()[0] == 0.5


def test_group_split_keeps_entities_together(spark):
    ids = spark.range(5000).select(F.concat(F.lit("S1-"), F.col("id").cast("string")).alias("source1_id"))
    made = metrics.group_split(ids.union(ids), 0.2)
    assert made.count() == 5000
    assert 0.17 < made.where("held_out").count() / 5000 < 0.23


def test_miss_categories(spark):
    rows = entities(
        spark,
        ("S1-1", 1, "Alpha Beta Works", "1 Maple Park Road", "us"), ("S2-1", 2, "टेक कंपनी", "9 Other Place", "us"), ("S2-2", 2, "Zeta Omega Mills", "", "us"),
        ("S2-3", 2, "Alfred Omega", "77 Elsewhere", "us"), ("S2-4", 2, "Xyz Qwert Uiop", "4 Maple Park Road", "us"), ("S2-5", 2, "Alpha Beta Works", "1 Maple Park Road", "us"), ("S2-6", 2, "Wxyz Qqqqq Mnbv", "77 Elsewhere", "us"),
    )
    truth = spark.createDataFrame([("S1-1", f"S2-{i}") for i in range(1, 7)], "source1_id string, candidate_id string")
    none = truth.limit(0)
    got = {r[1]: r[2] for r in diagnose.miss_reasons(truth, none, rows, 1000).collect()}
    assert got["S2-1"] == "indic script vs latin name" and got["S2-2"] == "candidate address missing" and got["S2-5"] == "truncated by top-k"
    assert got["S2-4"] in {"address similar, name alias", "truncated by top-k"} and got["S2-6"] == "severe variation"
    assert {r[1]: r[2] for r in diagnose.miss_reasons(truth, none, rows, 0).collect()}["S2-5"] == "key pruned"


def _file(tmp_path, name, lines):
    path = tmp_path / name
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def test_validator_finds_each_rule(spark, tmp_path):
    required = spark.createDataFrame([("S1-1",), ("S1-2",), ("S1-3",)], "source1_id string")
    known = spark.createDataFrame([("S2-1",), ("S3-1",)], "entity_id string")
    lines = ["source1_entity_id\tmatched_entity_ids", "S1-1\tS2-1,S2-1", "S1-1\tS1-2", "S1-2\tX-1,S2-77", "S1-9\t", "S1-8 no tab", ""]
    matching = _file(tmp_path, "m.tsv", lines)
    got = {(r[0], r[2]) for r in validate.validate(spark, matching, required, None, known).collect()}
    assert got == {("duplicate_id", "S1-1"), ("duplicate_row", "S1-1"), ("self_match", "S1-2"), ("bad_prefix", "X-1"), ("unknown_id", "S2-77"), ("missing_s1", "S1-3"), ("extra_s1", "S1-9"), ("malformed_row", "S1-8 no tab"), ("no_candidate_file", None)}
    rule = lambda text: [r[0] for r in validate.validate(spark, _file(tmp_path, "x.tsv", [text]), required.limit(0), None, known).collect() if r[0] != "no_candidate_file"]
    assert rule("a,b") == ["comma_separated"] and rule("a\tb") == ["wrong_header"] and rule("Source1_entity_id \tMATCHED_ENTITY_IDS") == []
    assert "file_not_found" in [r[0] for r in validate.validate(spark, str(tmp_path / "none.tsv"), required).collect()]


def test_submission_files_pass_the_validator(spark, tmp_path):
    made = spark.createDataFrame([("S1-1", ["S2-1"], ["S2-1", "S3-1"], 0), ("S1-2", [], [], 1)], "source1_id string, matches array<string>, candidates array<string>, ord int")
    assert writers.submission(made, str(tmp_path / "out"), "ord") == (2, 1)
    required = made.select("source1_id")
    known = spark.createDataFrame([("S2-1",), ("S3-1",)], "entity_id string")
    assert validate.validate(spark, str(tmp_path / "out/matching_results"), required, str(tmp_path / "out/candidate_pairs"), known).count() == 0


def test_readers(spark, tmp_path):
    path = _file(tmp_path, "s.tsv", ["entity_id\tbusiness_name\tbusiness_address\tcountry", 'S2-1\t"A ""q"" B"\tnull\tUS', "S2-2\tNaN\t\tFR"])
    got = [tuple(r) for r in readers.load_source(spark, path).orderBy("entity_id").collect()]
    assert got == [("S2-1", 'A "q" B', "", "US"), ("S2-2", "", "", "FR")]
    raw = [tuple(r) for r in readers.load_source(spark, path, policy=readers.NA_NONE).orderBy("entity_id").collect()]
    assert raw[0][2] == "null" and raw[1][1] == "NaN"
    assert [r[0] for r in readers.ids(spark, path).collect()] == ["S2-1", "S2-2"]
    truth = _file(tmp_path, "t.tsv", ["source1_entity_id\tmatched_entity_ids", "S1-1\tS2-1, S3-1,,S2-1", "S1-2\t"])
    assert {tuple(r) for r in readers.true_pairs(readers.load_ground_truth(spark, truth)).collect()} == {("S1-1", "S2-1"), ("S1-1", "S3-1")}


def test_models_learn_choose_and_reload(spark, tmp_path):
    rows = spark.range(400).select(F.col("id"), (F.col("id") % 2).cast("int").alias("label"), ((F.col("id") % 2) * 0.6 + (F.col("id") % 7) / 10).alias("x"), (F.col("id") % 5).cast("double").alias("y"))
    kind, fitted, t, compared = model.choose(rows.where("id % 4 < 3"), rows.where("id % 4 = 3 or id % 4 = 0"), ["x", "y"], [model.LOGISTIC, model.FOREST], small=True)
    assert kind in {model.LOGISTIC, model.FOREST} and compared.count() == 2 and 0.5 <= t <= 0.95
    model.save(spark, fitted, str(tmp_path / "m"), ["x", "y"], t)
    again, names, kept = model.load(spark, str(tmp_path / "m"))
    assert names == ["x", "y"] and kept == t
    assert model.load(spark, str(tmp_path / "m"), 0.75)[2] == 0.75
    old, new = (sorted(r["match_probability"] for r in model.score(m, rows, t, 6).collect()) for m in (fitted, again))
    assert old == new
    assert model.importances(spark, fitted, names).count() == 2


def test_the_split_for_models_moves_no_features(spark, sf_dir, capsys):
    train, held = queries._split(spark, sf_dir)
    for side in (train, held):
        side.explain("simple")
    plan = capsys.readouterr().out
    assert "Scan parquet" in plan and "Exchange" not in plan and "Join" not in plan
    sides = metrics.group_split(train.unionByName(held), 0.2).collect()
    assert {r["source1_id"] for r in sides if r["held_out"]} == {r["source1_id"] for r in held.select("source1_id").distinct().collect()}
    assert train.count() and {r["label"] for r in train.select("label").distinct().collect()} == {0, 1}


def test_pairs_are_exchanged_once_by_query(spark):
    rows = spark.createDataFrame([(f"S{s}-{i}", s, f"alpha{i % 3} beta", "", "us", f"alpha{i % 3} beta") for i in range(9) for s in (1, 2, 3)], "entity_id string, source int, norm_name string, norm_addr string, norm_country string, core_name string")
    for score in (blocking.WEIGHTED, blocking.COUNTED):
        made = blocking.candidates(rows, score, k=4)
        plan = made._jdf.queryExecution().executedPlan().toString()
        dealt = [x.split("hashpartitioning(")[1] for x in plan.splitlines() if "Exchange hashpartitioning(source1_id" in x]
        assert len(dealt) == 1 and "candidate_id" not in dealt[0]
        assert made.count() == 36 and {r["blocking_rank"] for r in made.collect()} == {1.0, 2.0, 3.0, 4.0}
