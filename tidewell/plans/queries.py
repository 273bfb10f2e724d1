"""The registered rhythm queries, on proxies that the given tables offer.

Recordings come from events (one per event type, raw or with a row for every
minute; or one per user in half-day bins), participants and per-day features
from its users, predictions from documents and labels, and model inputs from
embeddings.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import expressions as E
from tidewell.operators import binning, boosting, estimators, folds, metrics, models, prep, rhythm, sleep, summaries
from tidewell.plans import experiment
from tidewell.plans.features import extract_features
from tidewell.plans.kept import KeptFeatures
from tidewell.sources import adapters, files
from tidewell.sources.shared import new_path, written

GAIN = 4.0
PLACES = 6

#: Places beyond which digits are the order of addition; of values that aren't rounded yet, ties are rounded up from there.
NOISE = 10


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, places: int = PLACES) -> DataFrame:
    """Doubles to so many places, without negative zeros.

    Half-day sums of cents over up to 30 days are exact to seven places, so
    those are cut at eight, where no tie can be rounded either way.
    """
    return df.select(*[(F.round(c, places) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def raw(spark, sf) -> DataFrame:
    return adapters.raw_activity(_read(spark, sf, "events"))


def dense(spark, sf) -> DataFrame:
    return adapters.dense_activity(_read(spark, sf, "events"), gain=GAIN)


def by_user(spark, sf) -> DataFrame:
    return adapters.raw_activity(_read(spark, sf, "events"), "user_id")


def bins(spark, sf, width=60) -> DataFrame:
    return binning.bin_activity(raw(spark, sf), width)


def full(spark, sf, width=60) -> DataFrame:
    return binning.keep_full_days(bins(spark, sf, width), width)


def user_full(spark, sf) -> DataFrame:
    return binning.keep_full_days(binning.bin_activity(by_user(spark, sf), 720), 720)


def metadata(spark, sf) -> DataFrame:
    return adapters.cohort_metadata(_read(spark, sf, "events"))


def features(spark, sf) -> DataFrame:
    return adapters.daily_features(_read(spark, sf, "events"))


def predictions(spark, sf) -> DataFrame:
    rows = _read(spark, sf, "labels").join(_read(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return rows.select("doc_id", F.col("quality").alias("y_true"), (F.col("n_chars") >= 1000).cast("int").alias("y_pred"), F.col("n_chars").cast("double").alias("score"), "toxic")


VECTOR = [f"e{k}" for k in range(64)]


def vectors(spark, sf) -> DataFrame:
    return _read(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("pid"), F.col("label").alias("y"), *[F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate(VECTOR)])


def people(spark, sf) -> DataFrame:
    return metadata(spark, sf).select(F.col("number").cast("string").alias("pid"))


def acrophases(spark, sf) -> DataFrame:
    """Cosinor of users in half-day bins with their cohort."""
    found = rhythm.cosinor(user_full(spark, sf), 720)
    side = metadata(spark, sf).select(F.col("number").cast("string").alias("pid"), F.col("cohort").alias("class"), (F.col("gender") == 1).alias("hosp"))
    return found.join(side, "pid")


def user_temporal(spark, sf) -> DataFrame:
    """(user, variability, stability) of users in half-day bins; 0 where undefined."""
    days = user_full(spark, sf)
    found = rhythm.intradaily_variability(days, 720).join(rhythm.interdaily_stability(days, 7), "pid", "full")
    return found.select(F.col("pid").cast("long").alias("user"), F.coalesce("intradaily_variability", F.lit(0.0)).alias("variability"), F.coalesce("interdaily_stability", F.lit(0.0)).alias("stability"))


def participants(spark, sf) -> DataFrame:
    """Participants with distributional and temporal features."""
    dist = prep.to_participant_level(features(spark, sf)).fillna(0.0)
    return prep.join_features(dist, user_temporal(spark, sf)).withColumn("pid", F.col("user").cast("string"))


def study(spark, sf) -> DataFrame:
    """The same to the places that the queries show; each mean is rounded as it was added up, as the SQL rounds it."""
    return rounded(participants(spark, sf))


def entry(spark: SparkSession, sf: str) -> DataFrame:
    """The 17 features of every event type's minute recording."""
    return rounded(extract_features(dense(spark, sf)))


def _kept_features(spark, sf) -> DataFrame:
    """The same frame out of three batches of days, one after another."""
    rows = dense(spark, sf)
    first, last = rows.agg(F.min(F.to_date("ts")), F.max(F.to_date("ts"))).first()
    kept = KeptFeatures(spark, new_path(spark))
    if first is None:
        return entry(spark, sf)
    third = max(1, ((last - first).days + 1) // 3)
    for batch in range(3):
        since = F.datediff(F.to_date("ts"), F.lit(first))
        kept.add(rows.where((since >= batch * third) & (since < (batch + 1) * third if batch < 2 else F.lit(True))), batch)
    return rounded(kept.features())


def experiment_scores(spark, sf, part=1) -> DataFrame:
    """Raw scores, summary or pairs of all eight conditions over 20 repetitions of 5 folds."""
    data = written(participants(spark, sf))
    return experiment.run_experiment(data, folds.hashed_folds(data), list(prep.DISTRIBUTIONAL), ["variability", "stability"])[part]


def fold_scores(spark, sf) -> DataFrame:
    """(task, feature_set, rep, fold, macro_f1) out of a deterministic rule, for the statistics."""
    rows = _read(spark, sf, "events").select(F.when(F.col("event_id") % 2 == 0, "2class").otherwise("3class").alias("task"), F.when(F.col("user_id") % 2 == 0, "distributional").otherwise("combined").alias("feature_set"), (F.col("event_id") % 20).cast("int").alias("rep"), (F.col("user_id") % 5).cast("int").alias("fold"), "value")
    return rows.groupBy("task", "feature_set", "rep", "fold").agg(F.avg("value").alias("macro_f1"))


def rep_table(spark, sf) -> DataFrame:
    """(task, feature_set, rep, score) out of a deterministic rule, for the statistics."""
    rows = _read(spark, sf, "events").select(F.when(F.col("event_id") % 2 == 0, "2class").otherwise("3class").alias("task"), F.when(F.col("user_id") % 2 == 0, "distributional").otherwise("combined").alias("feature_set"), (F.col("event_id") % 20).cast("int").alias("rep"), "value")
    return rows.groupBy("task", "feature_set", "rep").agg(F.avg("value").alias("score"))


def _nights(spark, sf):
    activity = dense(spark, sf)
    labels = sleep.score_sleep(activity).select("pid", "ts", "label")
    return labels, sleep.rest_windows(sleep.rest_onsets(binning.keep_full_days(binning.bin_activity(activity))))


def _smoothed(spark, sf):
    activity = raw(spark, sf)
    return summaries.circular_smooth(summaries.cohort_profile(summaries.minute_profiles(activity)), ("mean", "sem"))


def _auc_macro(spark, sf):
    rows = predictions(spark, sf).select("y_true", F.col("score").alias("proba_1"), (-F.col("score")).alias("proba_0"))
    return metrics.roc_auc_macro(rows, [0, 1])


def _logistic(spark, sf):
    rows = vectors(spark, sf).withColumn("id", F.col("pid").cast("long"))
    made = models.logistic_regression(rows.where("id % 5 <> 0"), rows.where("id % 5 = 0"), VECTOR, "y")
    return metrics.macro_f1(made.select(F.col("y").alias("y_true"), "y_pred"))


def _trees(spark, sf):
    """Boosted trees of all ten labels, 200 rounds, and the rows they weren't grown on."""
    rows = vectors(spark, sf).withColumn("id", F.col("pid").cast("long"))
    made = estimators.BoostedTrees().fit(_assembled(rows.where("id % 5 <> 0")))
    return made, rows.where("id % 5 = 0")


def _assembled(rows: DataFrame) -> DataFrame:
    return rows.select("pid", F.col("y").alias("label"), array_to_vector(F.array(*VECTOR)).alias("features"))


def _boosted(spark, sf):
    model, test = _trees(spark, sf)
    return metrics.macro_f1(model.transform(_assembled(test)).select(F.col("label").alias("y_true"), F.col("prediction").cast("int").alias("y_pred")))


def _attributions(spark, sf):
    model, test = _trees(spark, sf)
    return boosting.mean_attributions(model.attributions(test, VECTOR))


def _evaluated(spark, sf):
    rows = vectors(spark, sf)
    return models.evaluate_repeated(rows, folds.hashed_folds(rows), VECTOR)


def _importance(spark, sf):
    rows = vectors(spark, sf).withColumn("id", F.col("pid").cast("long"))
    predict = models.fit_logistic(rows.where("id % 5 <> 0"), VECTOR, "y")
    return models.permutation_importance(predict, rows.where("id % 5 = 0"), VECTOR, "y")


def _confusion_fold(spark, sf):
    rows = predictions(spark, sf).withColumn("pid", F.col("doc_id").cast("string"))
    return metrics.confusion_fold(rows.join(folds.hashed_folds(rows, 5, 1), "pid"))


def cohort_files(spark, sf) -> str:
    """A folder with the metadata of all cohorts and the features, as their files."""
    root = new_path(spark)
    for cohort, name in files.METADATA_FILES.items():
        own = metadata(spark, sf).where(F.col("cohort") == cohort).drop("cohort")
        more = [c for c in files.METADATA_COLUMNS[cohort] if c not in own.columns]
        files.write_table(own.withColumns({c: F.col("number") % 7 for c in more}).select(*files.METADATA_COLUMNS[cohort]).coalesce(1), f"{root}/{name}", "csv")
    files.write_table(features(spark, sf).select(*files.FEATURE_COLUMNS), f"{root}/{files.FEATURES_FILE}", "csv")
    return root


def recording_files(spark, sf) -> str:
    """A folder of recordings, one for each event type, dealt among the cohorts with features."""
    root = new_path(spark)
    cohort = F.get(F.array(*[F.lit(c) for c in files.FEATURE_COHORTS]), F.ascii("pid") % 3)
    files.write_recordings(raw(spark, sf).withColumn("label", cohort), root)
    return root


def _whole(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("long").alias(c) if kind == "int" else F.col(c) for c, kind in df.dtypes])


def _folds_read_back(spark, sf):
    at = f"{new_path(spark)}/folds"
    files.write_fold_rows(folds.hashed_folds(people(spark, sf), 5, 2), at)
    return files.read_fold_rows(spark, at)


def _faulty_folds(spark, sf) -> DataFrame:
    """Folds in which some people are left out of a repetition, and some are tested twice."""
    made = folds.ranked_folds(people(spark, sf), 5, 4)
    number = F.col("pid").cast("long")
    return made.where(~((number % 7 == 0) & (F.col("rep") == 1))).union(made.where((number % 11 == 0) & (F.col("rep") == 2)))


def _group_loads(spark, sf) -> DataFrame:
    """Groups and rows of each fold, when users are groups of events."""
    sizes = _read(spark, sf, "events").groupBy(F.col("user_id").alias("group")).agg(F.count(F.lit(1)).alias("n"))
    return folds.balanced_groups(sizes, 5).groupBy("fold").agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("load"))


def _results_read_back(spark, sf):
    at = new_path(spark)
    made = metrics.summarize_reps(rep_table(spark, sf))
    files.write_table(made, at, "csv")
    return spark.read.schema(made.schema).csv(at, header=True)


def _predictions_read_back(spark, sf):
    at, rows = new_path(spark), predictions(spark, sf)
    files.write_predictions(rows, metrics.evaluate_predictions(rows.select("y_true", "y_pred")), at)
    return spark.read.schema(rows.schema).csv(f"{at}/predictions", header=True)


def _matrix(spark, sf):
    from pyspark.ml.functions import vector_to_array

    data = study(spark, sf)
    made = models.combined_matrix(data.select("user", "class", *prep.DISTRIBUTIONAL), data.select("user", "variability", "stability"), [*prep.DISTRIBUTIONAL, "variability", "stability"])
    return made.select("user", "class", F.transform(vector_to_array("features"), lambda x: F.round(F.round(x, NOISE), PLACES) + F.lit(0.0)).alias("features"))


def _pca(spark, sf):
    return summaries.pca_projection(features(spark, sf), list(summaries.EDA_COLUMNS), ["user", "day"])[0]


def _auc_parts(spark, sf):
    return metrics.roc_auc(predictions(spark, sf), ("toxic",))


def _fixture(spark, sf):
    rows = features(spark, sf).select(F.col("user").alias("pid"), F.datediff("day", F.lit("2024-01-01").cast("date")).alias("idx"))
    return folds.fixture_rows(folds.hashed_folds(people(spark, sf), 5, 2), rows)


def _compare_folds(spark, sf):
    """Folds of all users of events against the participants that have features, and some that have no events."""
    have = features(spark, sf).select(F.col("user").cast("string").alias("pid"))
    new = people(spark, sf).where("cast(pid as long) % 50 = 0").select(F.concat(F.lit("new"), "pid").alias("pid"))
    return folds.compare_folds(folds.hashed_folds(people(spark, sf), 5, 2), have.union(new))


PAIR = [(f"{task}/combined-distributional", f"{task}/distributional", f"{task}/combined") for task in ("2class", "3class")]

QUERIES = {
    "s4_scan_cohort": lambda s, d: _whole(files.scan_cohort(s, f"{cohort_files(s, d)}/controlinfo.csv", "control")),
    "s5_scan_metadata": lambda s, d: _whole(files.all_metadata(files.scan_metadata(s, cohort_files(s, d))).select("number", "days", "gender", "age", "acc_time", "adhd", "cohort")),
    "s6_scan_features": lambda s, d: rounded(_whole(files.load_all(s, cohort_files(s, d))[1])),
    "s8_scan_recordings": lambda s, d: files.scan_recordings(s, recording_files(s, d)),
    "s10_scan_cohort_dir": lambda s, d: files.scan_recordings(s, f"{recording_files(s, d)}/control", "mine"),
    "s11_scan_all_recordings": lambda s, d: files.scan_all_recordings(s, recording_files(s, d), ("control", "depression")),
    "s12_s13_folds_read_back": _folds_read_back,
    "s14_results_read_back": _results_read_back,
    "s15_predictions_read_back": _predictions_read_back,
    "p1_min_days_filter": lambda s, d: prep.min_days_filter(metadata(s, d), 20),
    "p2_exclude_features": lambda s, d: rounded(prep.exclude_features(features(s, d), ("q25", "absent"))),
    "p4_clip_fill": lambda s, d: rounded(raw(s, d).select("pid", "ts", E.non_negative(F.col("activity") - 20).alias("activity"))),
    "p5_relabel_binary": lambda s, d: metadata(s, d).select("number", E.binary_label(F.col("cohort")).alias("label")),
    "p6_binary_codes": lambda s, d: metadata(s, d).select("number", E.binary_code(F.col("cohort")).alias("code")),
    "p7_label_encode": lambda s, d: prep.label_codes(metadata(s, d).select("number", "cohort"), "cohort"),
    "p8_temporal_columns": lambda s, d: rounded(study(s, d).select("user", *prep.temporal_columns(study(s, d).columns))),
    "p9_distributional_columns": lambda s, d: rounded(study(s, d).select("user", *prep.distributional_columns(study(s, d).columns))),
    "p10_r2_filter": lambda s, d: rounded(prep.reliable(acrophases(s, d)), 8),
    "p11_p12_amplitudes": lambda s, d: rounded(rhythm.least_active_period(full(s, d)).join(rhythm.most_active_period(full(s, d)), "pid").select("pid", E.amplitude(F.col("l_value"), F.col("m_value")).alias("amplitude"), E.relative_amplitude(F.col("l_value"), F.col("m_value")).alias("relative_amplitude"), E.hours_of(F.col("l_onset_min")).alias("onset_hours"))),
    "j1_valid_users": lambda s, d: rounded(prep.valid_users(features(s, d), prep.min_days_filter(metadata(s, d), 20))),
    "j2_join_features": lambda s, d: rounded(prep.join_features(prep.to_participant_level(features(s, d)), user_temporal(s, d))),
    "j3_with_setting": lambda s, d: prep.with_setting(metadata(s, d).select(F.col("number").alias("user")), metadata(s, d).where("number % 3 = 0").withColumn("inpatient", F.col("gender") == 1)),
    "j4_fold_membership": lambda s, d: folds.fold_membership(folds.hashed_folds(people(s, d), 5, 2), people(s, d)),
    "j7_epochs_of_nights": lambda s, d: sleep.epochs_of_nights(*_nights(s, d)).groupBy("pid", "day").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.sum("label").cast("long").alias("awake")),
    "j8_fixture_rows": _fixture,
    "j9_compare_folds": _compare_folds,
    "t1_bin_activity": lambda s, d: rounded(bins(s, d)),
    "t2_full_day_dates": lambda s, d: binning.full_day_dates(bins(s, d)),
    "t3_count_full_days": lambda s, d: binning.count_full_days(bins(s, d)),
    "t4_keep_full_days": lambda s, d: rounded(full(s, d)),
    "t5_min_days_gate": lambda s, d: rounded(binning.gate(binning.roster_of(raw(s, d)), rhythm.intradaily_variability(full(s, d)), binning.count_full_days(bins(s, d)), 5, ["intradaily_variability"])),
    "t7_daily_profile": lambda s, d: rounded(binning.daily_profile(full(s, d))),
    "t8_circular_window": lambda s, d: rounded(binning.circular_window(binning.daily_profile(full(s, d)).withColumn("x", F.round("x", 6)), 7, "max", 24)),
    "t9_minute_profile": lambda s, d: rounded(summaries.minute_profiles(raw(s, d))),
    "t10_cohort_profile": lambda s, d: rounded(summaries.cohort_profile(summaries.minute_profiles(raw(s, d)))),
    "t11_circular_smooth": lambda s, d: rounded(_smoothed(s, d)),
    "c1_interdaily_stability": lambda s, d: rounded(rhythm.interdaily_stability(full(s, d))),
    "c1_stability_by_user": lambda s, d: rounded(rhythm.interdaily_stability(user_full(s, d), 7)),
    "c2_intradaily_variability": lambda s, d: rounded(rhythm.intradaily_variability(full(s, d))),
    "c2_variability_by_user": lambda s, d: rounded(rhythm.intradaily_variability(user_full(s, d), 720)),
    "c3_least_active_period": lambda s, d: rounded(rhythm.least_active_period(full(s, d))),
    "c4_most_active_period": lambda s, d: rounded(rhythm.most_active_period(full(s, d))),
    "c5_cosinor": lambda s, d: rounded(rhythm.cosinor(full(s, d))),
    "c5_cosinor_by_user": lambda s, d: rounded(rhythm.cosinor(user_full(s, d), 720), 8),
    "c7_extract_features": entry,
    "c7_kept_features": _kept_features,
    "z1_cole_kripke": lambda s, d: sleep.cole_kripke(dense(s, d)).select("pid", "ts", "label"),
    "z2_webster_rules": lambda s, d: sleep.score_sleep(dense(s, d)).select("pid", "ts", "label"),
    "z3_sadeh": lambda s, d: sleep.score_sleep(dense(s, d), "sadeh").select("pid", "ts", "label"),
    "z5_rest_onsets": lambda s, d: sleep.rest_onsets(binning.keep_full_days(binning.bin_activity(dense(s, d)))),
    "z6_sleep_metrics": lambda s, d: rounded(sleep.sleep_metrics(dense(s, d))),
    "a1_participant_level": lambda s, d: rounded(prep.to_participant_level(features(s, d))),
    "a2_class_balance": lambda s, d: summaries.class_balance(metadata(s, d), features(s, d)),
    "a3_days_distribution": lambda s, d: rounded(summaries.days_distribution(metadata(s, d))),
    "a4_feature_distributions": lambda s, d: rounded(summaries.feature_distributions(features(s, d))),
    "a5_feature_correlation": lambda s, d: rounded(summaries.feature_correlation(features(s, d))),
    "a6_pca_projection": lambda s, d: rounded(_pca(s, d)),
    "a7_acrophase_summary": lambda s, d: rounded(summaries.acrophase_summary(prep.reliable(acrophases(s, d)))),
    "a8_load_summary": lambda s, d: summaries.load_summary(features(s, d)),
    "a9_hosp_probe": lambda s, d: rounded(summaries.acrophase_summary(acrophases(s, d), ("class", "hosp"))),
    "a10_impute_median": lambda s, d: rounded(prep.impute_median(features(s, d).select("user", "day", "mean", "sd"), ["mean", "sd"])),
    "f1_hashed_folds": lambda s, d: folds.hashed_folds(people(s, d), 5, 4),
    "f1_repeated_folds": lambda s, d: folds.ranked_folds(people(s, d), 5, 4),
    "f2_fold_invariants": lambda s, d: folds.fold_invariants(_faulty_folds(s, d), 4),
    "f5_group_kfold": _group_loads,
    "m1_logistic_regression": _logistic,
    "m2_dummy": lambda s, d: models.stratified_predictions(vectors(s, d), folds.hashed_folds(vectors(s, d))),
    "m3_boosted_trees": _boosted,
    "m4_evaluate_repeated": _evaluated,
    "m5_macro_f1": lambda s, d: rounded(metrics.macro_f1(predictions(s, d), ("toxic",))),
    "m6_per_class_metrics": lambda s, d: rounded(metrics.per_class_metrics(predictions(s, d))),
    "m7_confusion_normalized": lambda s, d: rounded(metrics.confusion_normalized(predictions(s, d), ("toxic",))),
    "m8_confusion_fold": lambda s, d: rounded(_confusion_fold(s, d)),
    "m9_roc_auc": lambda s, d: rounded(_auc_parts(s, d)),
    "m9_roc_auc_macro": lambda s, d: rounded(_auc_macro(s, d)),
    "m10_bootstrap_ci": lambda s, d: metrics.bootstrap_ci(predictions(s, d)),
    "m11_evaluate_predictions": lambda s, d: metrics.evaluate_predictions(predictions(s, d).select("y_true", "y_pred")),
    "m12_rep_scores": lambda s, d: rounded(metrics.rep_scores(fold_scores(s, d))),
    "m13_summarize_reps": lambda s, d: metrics.summarize_reps(rep_table(s, d)),
    "m14_paired_summary": lambda s, d: metrics.paired_summary(rep_table(s, d), PAIR),
    "m15_results_tables": lambda s, d: metrics.results_tables(rep_table(s, d).select(F.concat_ws("/", "task", "feature_set").alias("condition"), "rep", "score"), PAIR)[0],
    "m15_results_tables_paired": lambda s, d: metrics.results_tables(rep_table(s, d).select(F.concat_ws("/", "task", "feature_set").alias("condition"), "rep", "score"), PAIR)[1],
    "m16_raw_scores": lambda s, d: experiment_scores(s, d, 0),
    "m16_run_experiment": lambda s, d: experiment_scores(s, d, 1),
    "m16_paired": lambda s, d: experiment_scores(s, d, 2),
    "m17_experiment_grid": lambda s, d: experiment.grid_summary(experiment.experiment_grid(features(s, d), list(prep.DISTRIBUTIONAL))),
    "m18_permutation_importance": _importance,
    "m18_tree_attributions": _attributions,
    "m19_comparison_table": lambda s, d: metrics.comparison_table(metrics.summarize_reps(rep_table(s, d))),
    "m20_combined_matrix": _matrix,
}
