from datetime import datetime, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from quotegrid.operators import calendar as cal
from quotegrid.operators import features as ft
from quotegrid.operators import models as md
from quotegrid.params import LIBRARY_FEATURES, MS

REGULAR = cal.Rule(-1, "17:00", "16:00", ((0, "15:15", "15:30"),))


def ns(text):
    return int(datetime.fromisoformat(text).replace(tzinfo=timezone.utc).timestamp()) * 1_000_000_000


def test_calendar_follows_the_clock_change(spark):
    rules = cal.CalendarRules("America/Chicago", "2025-10-30", "2025-11-04", REGULAR, closed=("2025-10-31",))
    rows = {r.segment_id: r for r in cal.expand_calendar(spark, rules).collect()}
    assert sorted(rows) == [f"{d}:{i}" for d in ("2025-10-30", "2025-11-03", "2025-11-04") for i in (0, 1)]
    assert rows["2025-10-30:0"].start_ns == ns("2025-10-29T22:00:00")
    assert rows["2025-11-03:0"].start_ns == ns("2025-11-02T23:00:00")
    assert rows["2025-11-03:1"].start_ns == ns("2025-11-03T21:30:00")
    assert rows["2025-11-03:0"].close_ns == ns("2025-11-03T22:00:00")
    assert cal.audit_calendar(cal.expand_calendar(spark, rules), rules).count() == 0
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        again = {r.segment_id: r.start_ns for r in cal.expand_calendar(spark, rules).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert again == {k: r.start_ns for k, r in rows.items()}


def test_calendar_exceptions_are_audited(spark):
    rules = cal.CalendarRules("America/Chicago", "2025-11-03", "2025-11-04", REGULAR, closed=("2025-11-08",))
    assert [r["rule"] for r in cal.audit_calendar(cal.expand_calendar(spark, rules), rules).collect()] == ["exception_not_covered"]


def test_session_assignment_boundaries(spark):
    seg = spark.createDataFrame([("s", "s:0", 100, 200, 100, 300), ("s", "s:1", 250, 300, 100, 300)],
                                "session_id string, segment_id string, start_ns bigint, end_ns bigint, open_ns bigint, close_ns bigint")
    rows = spark.createDataFrame([(100, 99), (101, 99), (102, 100), (200, 150), (201, 200), (260, 240)], "ts_ns bigint, source_recv_ns bigint")
    got = {r.ts_ns: (r.session_class, r.segment_id) for r in cal.assign_session(rows, seg).collect()}
    assert got == {100: ("outside", None), 101: ("preopen", "s:0"), 102: ("assigned", "s:0"), 200: ("assigned", "s:0"),
                   201: ("outside", None), 260: ("preopen", "s:1")}


def session_rows(spark, times, step=1, end=None):
    end = end or max(times) * MS
    data = [(1, "s", "s:0", t * MS, 100.0 + t, 0, end, end, True) for t in times]
    df = spark.createDataFrame(data, "instrument_id bigint, session_id string, segment_id string, ts_ns bigint, mid_price double, "
                                     "open_ns bigint, segment_end_ns bigint, close_ns bigint, feature_valid boolean")
    return ft.with_continuous_block(df, step * MS)


def test_labels_reasons_and_edges(spark):
    rows = session_rows(spark, [1, 2, 3, 5, 6, 7], end=9 * MS)
    got = {r.ts_ns // MS: r.label_reason for r in ft.labels(rows, (2,)).collect()}
    assert got == {1: "valid", 2: "missing_target", 3: "gap", 5: "valid", 6: "missing_target", 7: "missing_target"}
    split = {r.ts_ns // MS: r.label_reason for r in ft.labels(rows, (2,), (3 * MS,)).collect()}
    assert split[1] == "split_boundary"
    at_close = {r.ts_ns // MS: r.label_reason for r in ft.labels(session_rows(spark, [1, 2, 3]), (1,)).collect()}
    assert at_close == {1: "valid", 2: "valid", 3: "session_boundary"}


def test_purge_is_strict(spark):
    rows = session_rows(spark, [1, 2, 3, 4, 5])
    kept = [r.ts_ns // MS for r in ft.training_samples(rows, 1, 2, ["ts_ns"]).collect()]
    assert sorted(kept) == [1, 2, 3]


def test_volatility_needs_full_history(spark):
    rows = ft.with_volatility(ft.with_returns(session_rows(spark, list(range(1, 13))), (1,)), (10,))
    got = {r.ts_ns // MS: r.vol_10 for r in rows.collect()}
    assert [t for t, v in got.items() if v is not None] == [11, 12]
    mids = np.array([100.0 + t for t in range(1, 12)])
    assert got[11] == pytest.approx(np.std(mids[1:] / mids[:-1] - 1, ddof=1))


def training(spark, n=160, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, len(LIBRARY_FEATURES))) * rng.uniform(0.1, 30, len(LIBRARY_FEATURES)) + rng.normal(size=len(LIBRARY_FEATURES)) * 5
    centered = (x - x.mean(axis=0)) / x.std(axis=0)
    y = centered[:, 0] * 0.3 + np.sign(centered[:, 8]) + rng.normal(size=n) * 0.1
    rows = [(f"d{i % 2}", i, float(y[i]), *map(float, x[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "session_id string, ts_ns bigint, y double, " + ", ".join(f"{c} double" for c in LIBRARY_FEATURES))
    days = spark.createDataFrame([("u", 1, 5, "d1"), ("u", 2, 5, "d0"), ("u", 2, 5, "d1"), ("v", 1, 9, "none")],
                                 "update_session string, history_count int, available_at_ns bigint, session_id string")
    return df, days, x, y


def test_library_fits_match_numpy(spark):
    samples, days, x, y = training(spark)
    models = {r.model_id + r.version_id: r for r in md.build_library(samples, days, alpha=1.0, depth=3, min_leaf=10, sample=1000, seed=42).collect()}
    assert len(models) == 18  # twelve for u, six for v which declares one history length
    assert {r.status for k, r in models.items() if k.endswith("v")} == {"insufficient_samples"}
    fit = models["ridge-price-h2u"]
    p = x[:, :8]
    mean, std = p.mean(axis=0), p.std(axis=0)
    z = (p - mean) / std
    beta = np.linalg.solve(z.T @ z + np.eye(8), z.T @ (y - y.mean()))
    assert np.allclose(fit.coef, beta, rtol=1e-8) and fit.intercept == pytest.approx(y.mean())
    assert np.allclose(fit.mean, mean) and np.allclose(fit["scale"], std) and fit.training_rows == 160
    grown = models["tree-displayed_volume-h2u"]
    leaves = [n for n, left in zip(grown.node_rows, grown.left) if left == -1]
    assert min(leaves) >= 10 and sum(leaves) == 160 and len(grown.left) <= 15
    assert grown.feature[0] == 0  # the step in the first feature of the group

    # The prediction expression walks the tree to the leaf means it was fitted with.
    rows = samples.withColumn("j", F.lit(1)).join(
        spark.createDataFrame([(1, list(grown.mean), list(grown["scale"]), list(grown.left), list(grown.right), list(grown.feature), list(grown.threshold), list(grown.value))],
                              "j int, mean array<double>, scale array<double>, left array<int>, right array<int>, feature array<int>, threshold array<double>, value array<double>"), "j")
    m = F.struct("mean", "scale", "left", "right", "feature", "threshold", "value")
    out = rows.select("y", md.predict_tree(F.array(*LIBRARY_FEATURES[8:15]), m, 3).alias("p")).toPandas()
    assert ((out.y - out.p) ** 2).sum() < 0.6 * ((out.y - out.y.mean()) ** 2).sum()
    assert out.groupby("p").y.mean().reset_index().apply(lambda r: abs(r.p - r.y) < 1e-9, axis=1).all()


def test_moments_keep_their_digits_far_from_zero(spark):
    samples, _, x, y = training(spark)
    name, still = LIBRARY_FEATURES[0], LIBRARY_FEATURES[1]
    far = samples.withColumn(name, F.col(name) + 1e6).withColumn(still, F.lit(0.1)).repartition(7)
    unknown = far.limit(1).withColumn("y", F.lit(None).cast("double"))
    rows = md.session_moments(far.unionByName(unknown), ["session_id"])
    whole = md.normal_equations(md.merge_moments(rows.withColumn("all", F.lit(1)), ["all"]), ["all", "feature_group"])
    got = whole.where("feature_group = 'price'").first()
    assert got.n == len(y) and got["scale"][1] == 1.0 and got.zz[1] == [0.0] * 8 and got.zy[1] == 0.0
    assert got["scale"][0] == pytest.approx(x[:, 0].std(), rel=1e-9)
    keep = [0, 2, 3, 4, 5, 6, 7]
    z = (x[:, keep] - x[:, keep].mean(axis=0)) / x[:, keep].std(axis=0)
    assert np.allclose(np.array(got.zz)[np.ix_(keep, keep)], z.T @ z, rtol=1e-7, atol=1e-6)
    fit = md.ridge(md.merge_moments(rows.withColumn("all", F.lit(1)), ["all"]), ["all", "feature_group"], 1.0).where("feature_group = 'price'").first()
    assert np.allclose(np.array(fit.coef)[keep], np.linalg.solve(z.T @ z + np.eye(7), z.T @ (y - y.mean())), rtol=1e-7) and fit.coef[1] == 0.0
    assert md.session_moments(samples.where("false"), ["session_id"]).collect() == []


@pytest.mark.parametrize("digits", [1, 5])
def test_grouped_sample_is_the_smallest_priorities(spark, digits):
    df = spark.range(500).select((F.col("id") % 3 == 0).cast("string").alias("g"), F.col("id").alias("key"))
    got = {(r.g, r.key) for r in ft.bounded_sample(df, 20, 42, "key", ["g"], digits).collect()}
    everything = df.withColumn("p", F.md5(F.concat_ws("|", F.col("key").cast("string"), F.lit("42")))).collect()
    for g in ("true", "false"):
        best = sorted((r.p, r.key) for r in everything if r.g == g)[:20]
        assert {k for gg, k in got if gg == g} == {k for _, k in best}


def test_version_boundary_is_inclusive(spark):
    rows = spark.createDataFrame([(4,), (5,), (9,)], "ts_ns bigint")
    versions = spark.createDataFrame([("a", 5), ("b", 9)], "version_id string, available_at_ns bigint")
    assert {r.ts_ns: r.version_id for r in cal.asof_version(rows, versions, 100).collect()} == {4: None, 5: "a", 9: "b"}
    bad = spark.createDataFrame([("a", 5, "m"), ("b", 5, "m"), ("c", 9, "n")], "version_id string, available_at_ns bigint, model_id string")
    assert sorted(r["rule"] for r in md.audit_versions(bad).collect()) == ["model_ids_changed", "not_increasing"]


LIBRARY_SCHEMA = ("version_id string, available_at_ns bigint, model_id string, family string, feature_group string, status string, mean array<double>, scale array<double>, "
                  "coef array<double>, intercept double, left array<int>, right array<int>, feature array<int>, threshold array<double>, value array<double>")


def library_rows():
    def linear(version, at, coef, intercept=0.5, status="fitted", scale=(2.0,) * 4):
        return [version, at, "lin", "ridge", "price_volume", status, [1.0] * 4, list(scale), coef, intercept, None, None, None, None, None]

    def tree(version, at, left=(1, -1, -1), right=(2, -1, -1)):
        return [version, at, "tree", "tree", "price_volume", "fitted", [0.0] * 4, [1.0] * 4, None, None, list(left), list(right), [3, -2, -2], [0.5, -2.0, -2.0], [0.0, -7.0, 7.0]]

    return linear, tree


def test_library_is_audited(spark):
    linear, tree = library_rows()
    good = [linear("a", 5, [1.0] * 4), tree("a", 5), linear("b", 9, None, None, "insufficient_samples"), tree("b", 9)]
    audit = lambda rows: {(r["version_id"], r["model_id"], r["rule"]) for r in md.audit_library(spark.createDataFrame([tuple(r) for r in rows], LIBRARY_SCHEMA)).collect()}
    assert audit(good) == set() == audit([])
    faults = [("lin", "fit_missing", linear("c", 12, None)), ("lin", "wrong_width", linear("c", 12, [1.0] * 3)), ("lin", "bad_number", linear("c", 12, [1.0, float("nan"), 0.0, 0.0])),
              ("lin", "bad_number", linear("c", 12, [1.0] * 4, None)), ("lin", "bad_number", linear("c", 12, [1.0] * 4, scale=(1.0, 0.0, 1.0, 1.0)))]
    for model, rule, row in faults:
        assert audit([*good, row, tree("c", 12)]) == {("c", model, rule)}
    assert audit([*good, linear("c", 12, [1.0] * 4), tree("c", 12, left=(0, -1, -1))]) == {("c", "tree", "tree_not_ordered")}
    assert audit([*good, good[1]]) == {("a", "tree", "model_twice")}
    assert audit([*good, linear("c", 9, [1.0] * 4)]) & {("b", None, "not_increasing"), ("c", None, "not_increasing"), ("c", None, "model_ids_changed")}


def test_predictions_say_why_they_are_missing(spark):
    linear, tree = library_rows()
    models = spark.createDataFrame([tuple(r) for r in (linear("a", 5, [1.0, 2.0, 0.0, 0.0]), tree("a", 5), linear("b", 9, None, None, "insufficient_samples"), tree("b", 9))], LIBRARY_SCHEMA)
    x = [3.0, 5.0, 0.0, 0.25]
    rows = spark.createDataFrame([(4, x, True), (5, x, True), (6, x, False), (7, x, None), (8, x, True), (9, x, True), (13, x, True)], "ts_ns bigint, x array<double>, ok boolean")
    out = md.predict_library(rows, models, 100, {"price_volume": F.col("x")}, F.col("ok"), 4, ["ts_ns"], max_age_ns=2)
    got = {(r["ts_ns"], r["model_id"]): (r["version_id"], r["yhat"], r["reason"]) for r in out.collect()}
    y = 1.0 * (3 - 1) / 2 + 2.0 * (5 - 1) / 2 + 0.5
    assert got == {(4, None): (None, None, "no_version"), (5, "lin"): ("a", y, None), (5, "tree"): ("a", -7.0, None),
                   **{(t, m): ("a", None, "invalid_features") for t in (6, 7) for m in ("lin", "tree")}, **{(8, m): ("a", None, "stale_version") for m in ("lin", "tree")},
                   (9, "lin"): ("b", None, "not_fitted"), (9, "tree"): ("b", -7.0, None), **{(13, m): ("b", None, "stale_version") for m in ("lin", "tree")}}


def test_direction_is_strict(spark):
    rows = spark.createDataFrame([(0.5,), (0.51,), (-0.5,), (-0.6,), (None,)], "y double")
    assert [r[0] for r in rows.select(md.direction(F.col("y"), 0.5)).collect()] == [0, 1, 0, -1, None]
