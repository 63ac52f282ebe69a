"""Queries over features, labels, training sets, fits and predictions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quotegrid.functions import book as fx
from quotegrid.functions.book import r6
from quotegrid.operators import features as ft
from quotegrid.operators import models as md
from quotegrid.operators.calendar import inline
from quotegrid.params import BASE_FEATURES, DAY, FEATURE_GROUPS, LIBRARY_FEATURES
from quotegrid.plans import study
from quotegrid.plans.prepare import UNTIL, schedule
from quotegrid.plans.registry import cte, query
from quotegrid.plans.study import HORIZONS, I, SPLITS
from quotegrid.operators.calendar import training_days
from quotegrid.session import settle
from quotegrid.sources.bindings import STUDY
from quotegrid.sources.tables import require_empty

H1, PURGE = HORIZONS[0], STUDY.purge_ms


def sql_rounded(columns, source, keys=("ts_ns",)):
    return f"SELECT {', '.join(keys)}, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in columns)} FROM {source}"


def feature_query(name, columns, source, build, digits=6):
    @query(name, sql_rounded(columns, source).replace(", 6)", f", {digits})"))
    def run(spark, sf):
        return build(spark, sf).select("ts_ns", *[(F.round(c, digits) + F.lit(0.0)).alias(c) for c in columns])


feature_query("f01_mid_spread", ["mid_price", "spread", "rel_spread"], "scalar", study.blocked)
feature_query("f02_obi_l1", ["obi_l1"], "scalar", lambda s, d: fx.with_obi_l1(study.in_session(s, d)))
feature_query("f03_obi_multi", ["obi_multi"], "scalar", lambda s, d: fx.with_obi_multi(study.in_session(s, d)))
feature_query("f04_micro_dev", ["micro_dev"], "scalar", lambda s, d: fx.with_micro_dev(fx.with_mid_spread(study.in_session(s, d))))
feature_query("f05_displayed_depth", ["displayed_depth"], "scalar", lambda s, d: fx.with_displayed_depth(study.in_session(s, d)))
feature_query("f06_price_depth", ["price_diff_1_x_depth", "price_diff_1_div_depth"], "ret",
              lambda s, d: ft.with_price_volume(fx.with_displayed_depth(study.blocked(s, d))), digits=10)
feature_query("w02_lagged_returns", ["ret_lag_1", "ret_lag_5", "ret_lag_10", "ret_lag_30"], "ret", lambda s, d: ft.with_returns(study.blocked(s, d)))
feature_query("w03_volatility", ["vol_10", "vol_30"], "feat0", lambda s, d: ft.with_volatility(ft.with_returns(study.blocked(s, d))))
feature_query("w04_mid_ma_rel", ["mid_ma_rel_10"], "feat0", lambda s, d: ft.with_mid_rolling(study.blocked(s, d)))
feature_query("w05_mid_var_rel", ["mid_var_rel_10"], "feat0", lambda s, d: ft.with_mid_rolling(study.blocked(s, d)))
feature_query("w06_depth_rolling", ["depth_ma_10", "depth_var_10"], "feat0",
              lambda s, d: ft.with_depth_rolling(fx.with_displayed_depth(study.blocked(s, d))))
feature_query("w07_depth_change", ["depth_diff_1", "depth_speed_5"], "ret",
              lambda s, d: ft.with_depth_change(fx.with_displayed_depth(study.blocked(s, d)), I))


@query("f07_feature_valid", "SELECT ts_ns, feature_valid FROM feat")
def f07(spark, sf):
    return study.prepared(spark, sf).select("ts_ns", "feature_valid")


@query("f08_library_valid", "SELECT ts_ns, library_valid FROM feat")
def f08(spark, sf):
    return study.library(spark, sf).select("ts_ns", "library_valid")


@query("f09_feature_groups", " UNION ALL ".join(
    f"SELECT ts_ns, '{g}' AS feature_group, {len(c)} AS width, round({' + '.join(c)}, 6) + 0.0 AS total FROM feat WHERE library_valid"
    for g, c in FEATURE_GROUPS.items()))
def f09(spark, sf):
    rows = fx.with_feature_vectors(study.library(spark, sf)).where("library_valid")
    parts = F.array(*[F.struct(F.lit(g).alias("feature_group"), F.col(f"x_{g}").alias("x")) for g in FEATURE_GROUPS])
    rows = rows.select("ts_ns", F.inline(parts))
    return rows.select("ts_ns", "feature_group", F.size("x").alias("width"),
                       r6(F.aggregate("x", F.lit(0.0), lambda a, v: a + v)).alias("total"))


@query("w01_continuous_block", "SELECT session_id, ts_ns, continuous_block FROM blk")
def w01(spark, sf):
    return study.blocked(spark, sf).select("session_id", "ts_ns", "continuous_block")


cte("reasons", f"""
SELECT *, CASE WHEN lag(ts_ns) OVER w IS NULL THEN NULL WHEN lag(session_id) OVER w <> session_id THEN 'session_transition'
               WHEN lag(segment_id) OVER w <> segment_id THEN 'scheduled_break' WHEN ts_ns - lag(ts_ns) OVER w <> {I} THEN 'gap' END AS change_reason
FROM blk WINDOW w AS (ORDER BY ts_ns)""")


@query("w08_change_reason", "SELECT ts_ns, change_reason FROM reasons")
def w08(spark, sf):
    return ft.with_change_reason(settle(study.blocked(spark, sf)), I).select("ts_ns", "change_reason")


LABEL_COLUMNS = "session_id, ts_ns, horizon_ms, label_end_ns, label_valid, label_reason"


@query("l01_labels", f"""
SELECT {LABEL_COLUMNS}, round(future_price_diff, 6) + 0.0 AS future_price_diff, round(future_return, 6) + 0.0 AS future_return FROM lbl""")
def l01(spark, sf):
    return study.long_labels(spark, sf).select(
        *LABEL_COLUMNS.split(", "), r6(F.col("future_price_diff")).alias("future_price_diff"), r6(F.col("future_return")).alias("future_return"))


_wide = ", ".join(
    f"max(label_end_ns) FILTER (WHERE horizon_ms = {h}) AS label_end_{h}ms, bool_or(label_valid) FILTER (WHERE horizon_ms = {h}) AS label_valid_{h}ms, "
    f"max(label_reason) FILTER (WHERE horizon_ms = {h}) AS label_reason_{h}ms, round(max(future_price_diff) FILTER (WHERE horizon_ms = {h}), 6) + 0.0 AS future_price_diff_{h}ms, "
    f"round(max(future_return) FILTER (WHERE horizon_ms = {h}), 6) + 0.0 AS future_return_{h}ms" for h in HORIZONS)


@query("l01_labels_wide", f"SELECT session_id, ts_ns, {_wide} FROM lbl GROUP BY 1, 2")
def l01_wide(spark, sf):
    rows = ft.wide_labels(study.long_labels(spark, sf), HORIZONS).drop("instrument_id")
    return rows.select(*[r6(F.col(f.name)).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in rows.schema.fields])


@query("l02_label_reasons", "SELECT horizon_ms, label_reason, count(*) AS rows FROM lbl GROUP BY ALL")
def l02(spark, sf):
    return study.long_labels(spark, sf).groupBy("horizon_ms", "label_reason").agg(F.count(F.lit(1)).alias("rows"))


@query("l03_learning_ready", "SELECT ts_ns, bool_and(label_valid AND feature_valid) AS learning_ready FROM lbl0 GROUP BY 1")
def l03(spark, sf):
    return ft.learning_ready(study.long_labels(spark, sf, ())).select("ts_ns", "learning_ready")


REASONS = ["missing_target", "gap", "split_boundary", "scheduled_break", "session_boundary"]


@query("l04_label_quality", f"""
SELECT session_id, horizon_ms, count(*) FILTER (WHERE label_valid) AS valid, count(*) FILTER (WHERE label_valid AND feature_valid) AS feature_and_label_valid,
       {', '.join(f"count(*) FILTER (WHERE label_reason = '{r}') AS {r}" for r in REASONS)} FROM lbl GROUP BY 1, 2""")
def l04(spark, sf):
    return ft.label_quality(study.long_labels(spark, sf)).drop("instrument_id")


@query("l05_horizon_audit", f"""
SELECT session_id, count(*) AS observed_rows, count(*) FILTER (WHERE fv) AS feature_valid_rows, count(*) FILTER (WHERE fv AND ok) AS all_horizons_feature_valid_rows,
       {', '.join(f'CAST(sum(v{h}) AS BIGINT) AS valid_{h}ms' for h in HORIZONS)}
FROM (SELECT session_id, ts_ns, any_value(feature_valid) AS fv, bool_and(label_valid) AS ok,
             {', '.join(f'count(*) FILTER (WHERE horizon_ms = {h} AND label_valid) AS v{h}' for h in HORIZONS)} FROM lbl0 GROUP BY 1, 2) GROUP BY 1""")
def l05(spark, sf):
    return ft.audit_horizons(study.prepared(spark, sf), HORIZONS)


def samples(spark, sf):
    return ft.training_samples(study.library(spark, sf), H1, PURGE, ["instrument_id", "session_id", "ts_ns", *LIBRARY_FEATURES])


@query("l06_training_samples", "SELECT session_id, ts_ns, round(y, 6) + 0.0 AS y, round(obi_l1, 6) + 0.0 AS obi_l1 FROM train")
def l06(spark, sf):
    return samples(spark, sf).select("session_id", "ts_ns", r6(F.col("y")).alias("y"), r6(F.col("obi_l1")).alias("obi_l1"))


@query("l07_label_cache_audit", """
SELECT session_id, ts_ns, CASE WHEN ts_ns % 420000000000 = 0 THEN 'wrong_end' ELSE 'wrong_return' END AS rule
FROM lbl WHERE horizon_ms = 300000 AND label_valid AND (ts_ns % 420000000000 = 0 OR ts_ns % 660000000000 = 0)
UNION ALL SELECT session_id, ts_ns, 'no_exact_target' FROM lbl WHERE horizon_ms = 300000 AND label_reason = 'gap'""")
def l07(spark, sf):
    # A stale cache: shifted ends, altered returns and labels claimed across gaps.
    rows, ts = study.prepared(spark, sf), F.col("ts_ns")
    cached = ft.labels(rows, HORIZONS, SPLITS)
    gap = F.col("label_reason") == "gap"
    bad_return = F.coalesce(F.col("future_return"), F.lit(0.0)) + F.when(ts % 660_000_000_000 == 0, 1e-6).otherwise(0.0)
    cached = cached.withColumns({
        "label_end_ns": F.col("label_end_ns") + F.when(ts % 420_000_000_000 == 0, 1).otherwise(0),
        "future_return": bad_return, "label_valid": F.col("label_valid") | gap})
    return ft.audit_labels(rows, cached, H1).select("session_id", "ts_ns", "rule")


@query("l08_sample_counts", """
SELECT session_id, count(ts_ns) AS samples, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns
FROM (SELECT session_id FROM sess) LEFT JOIN (SELECT session_id, ts_ns FROM train) USING (session_id) GROUP BY 1""")
def l08(spark, sf):
    return ft.sample_counts(samples(spark, sf), study.cal.sessions(study.segments(spark)))


@query("l09_bounded_sample", "SELECT session_id, ts_ns FROM train ORDER BY md5('1|' || session_id || '|' || ts_ns || '|42'), session_id, ts_ns LIMIT 300")
def l09(spark, sf):
    return ft.bounded_sample(samples(spark, sf), 300, 42, ["instrument_id", "session_id", "ts_ns"]).select("session_id", "ts_ns")


TRAINING_COLUMNS = ["instrument_id", "session_id", "ts_ns", "open_ns", "close_ns", "mid_price", "continuous_block", "feature_valid", *LIBRARY_FEATURES]


def prepared_rows(spark, sf):
    return settle(study.library(spark, sf).select(*TRAINING_COLUMNS, "library_valid"), "prepared")


def training_inputs(spark, sf, rows=None):
    """Training rows and schedule of a prepared dataset that is written once and read by both."""
    rows = prepared_rows(spark, sf) if rows is None else rows
    seen = settle(rows.select("session_id", "open_ns", "close_ns").distinct(), "sessions")
    days = training_days(schedule(spark, sf, seen), seen, STUDY.history_counts, "2024-01-02")
    return ft.training_samples(rows, H1, PURGE, ["instrument_id", "session_id", "ts_ns", *LIBRARY_FEATURES]), days


def moments(spark, sf):
    rows, days = training_inputs(spark, sf)
    return md.version_moments(md.session_moments(rows, ["session_id"]), days)


cte("vtrain", "SELECT d.update_session, d.history_count, t.* FROM tdays d JOIN train t USING (session_id)")
_unpivot = " UNION ALL ".join(
    f"SELECT update_session, history_count, '{g}' AS feature_group, {i} AS i, {c} AS x, y FROM vtrain" for g, cs in FEATURE_GROUPS.items() for i, c in enumerate(cs))


@query("m01_scaler_stats", f"""
SELECT update_session, history_count, feature_group, i, count(*) AS n, round(avg(x), 6) + 0.0 AS mean,
       round(CASE WHEN stddev_pop(x) = 0 THEN 1.0 ELSE stddev_pop(x) END, 6) + 0.0 AS scale
FROM ({_unpivot}) GROUP BY ALL""")
def m01(spark, sf):
    stats = md.scaler_stats(moments(spark, sf), md.MODEL_KEYS)
    return stats.select(*md.MODEL_KEYS, "i", "n", r6(F.col("mean")).alias("mean"), r6(F.col("scale")).alias("scale"))


def _gram_sql():
    # As in m01: a constant feature has deviation zero and is scaled by one.
    sd = lambda c: f"coalesce(nullif(stddev_pop({c}), 0), 1)"
    parts = []
    for g, cs in FEATURE_GROUPS.items():
        for i, a in enumerate(cs):
            for j, b in enumerate(cs[i:], i):
                parts.append((g, i, j, f"count(*) * covar_pop({a}, {b}) / ({sd(a)} * {sd(b)})"))
            parts.append((g, i, -1, f"count(*) * covar_pop({a}, y) / {sd(a)}"))
    fields = ", ".join(f"{{'feature_group': '{g}', 'i': {i}, 'j': {j}, 'value': {v}}}" for g, i, j, v in parts)
    return f"""
SELECT update_session, history_count, n, e.feature_group, e.i, e.j, round(e.value, 4) + 0.0 AS value
FROM (SELECT update_session, history_count, count(*) AS n, unnest([{fields}]) AS e FROM vtrain GROUP BY 1, 2)"""


@query("m02_gram", _gram_sql())
def m02(spark, sf):
    entries = md.gram(moments(spark, sf), md.MODEL_KEYS)
    return entries.select(*md.MODEL_KEYS, "n", "i", "j", (F.round("value", 4) + 0.0).alias("value"))


def _ridge_sql():
    """The normal equations as lists, solved by elimination one pivot a recursion."""
    sd = lambda c: f"coalesce(nullif(stddev_pop({c}), 0), 1)"
    entry = lambda a, b: f"count(*) * covar_pop({a}, {b}) / ({sd(a)} * {sd(b)})" + (f" + {STUDY.ridge_alpha}" if a == b else "")
    row = lambda a, cs: "[" + ", ".join([*[entry(a, b) for b in cs], f"count(*) * covar_pop({a}, y) / {sd(a)}"]) + "]"
    parts = ", ".join(f"{{'g': '{g}', 'p': {len(cs)}, 'm': [{', '.join(row(a, cs) for a in cs)}]}}" for g, cs in FEATURE_GROUPS.items())
    return f"""
SELECT update_session, history_count, feature_group, CAST(u.i - 1 AS INTEGER) AS i, m[u.i][p + 1] AS coef, y_mean AS intercept FROM (
  WITH RECURSIVE solved AS (
    SELECT update_session, history_count, y_mean, e.g AS feature_group, e.p AS p, e.m AS m, 0 AS k
    FROM (SELECT update_session, history_count, avg(y) AS y_mean, unnest([{parts}]) AS e FROM vtrain GROUP BY 1, 2)
    UNION ALL
    SELECT update_session, history_count, y_mean, feature_group, p,
           list_transform(m, lambda r, i: list_transform(r, lambda v, j: CASE WHEN i = k + 1 THEN v / r[k + 1] ELSE v - r[k + 1] * m[k + 1][j] / m[k + 1][k + 1] END)), k + 1
    FROM solved WHERE k < p)
  SELECT * FROM solved WHERE k = p) s, LATERAL (SELECT unnest(range(1, p + 1)) AS i) u"""


cte("ridgefit", _ridge_sql())


@query("m03_ridge", """
SELECT update_session, history_count, feature_group, i, round(coef * 1e6, 4) + 0.0 AS coef, round(intercept * 1e6, 4) + 0.0 AS intercept FROM ridgefit""")
def m03(spark, sf):
    fits = md.ridge(moments(spark, sf), md.MODEL_KEYS, STUDY.ridge_alpha).select(*md.MODEL_KEYS, F.posexplode("coef").alias("i", "coef"), "intercept")
    return fits.select(*md.MODEL_KEYS, "i", *[(F.round(F.col(c) * 1e6, 4) + 0.0).alias(c) for c in ("coef", "intercept")])


def _library(spark, sf, min_leaf=20, rows=None):
    rows, days = training_inputs(spark, sf, rows)
    return md.build_library(settle(rows, "samples"), days, alpha=STUDY.ridge_alpha, depth=STUDY.tree_depth, min_leaf=min_leaf,
                            sample=STUDY.tree_sample, seed=STUDY.seed)


@query("m04_tree")
def m04(spark, sf):
    trees = _library(spark, sf).where("family = 'tree' and status = 'fitted'")
    nodes = trees.select("version_id", "model_id", F.posexplode(F.arrays_zip("left", "right", "feature", "threshold", "value", "node_rows")).alias("node", "n"))
    return nodes.select("version_id", "model_id", "node", "n.left", "n.right", "n.feature", "n.threshold", "n.value", "n.node_rows")


@query("m05_library", """
SELECT d.update_session AS version_id, f.family || '-' || g.feature_group || '-h' || d.history_count AS model_id, d.available_at_ns,
       d.training_sessions, coalesce(n, 0) AS training_rows, CASE WHEN n >= 2 THEN 'fitted' ELSE 'insufficient_samples' END AS status
FROM (SELECT update_session, history_count, min(available_at_ns) AS available_at_ns, count(*) AS training_sessions FROM tdays GROUP BY 1, 2) d
LEFT JOIN (SELECT update_session, history_count, count(*) AS n FROM vtrain GROUP BY 1, 2) t USING (update_session, history_count)
CROSS JOIN (VALUES ('ridge'), ('tree')) f(family) CROSS JOIN (VALUES ('price'), ('displayed_volume'), ('price_volume')) g(feature_group)""")
def m05(spark, sf):
    return _library(spark, sf).select("version_id", "model_id", "available_at_ns", "training_sessions", "training_rows", "status")


# Hand-written model versions on four book features.
VERSION_TIMES = {"v1": 1_704_672_000_000_000_000, "v2": 1_705_276_800_000_000_000, "v3": 1_705_881_600_000_000_000}
MEAN, SCALE = [0.005, 0.0, 0.0, 0.0], [0.002, 0.5, 0.4, 0.3]
COEF = {"lin0": [0.1, -0.2, 0.3, 0.05], "lin1": [0.2, 0.1, -0.1, 0.15], "lin2": [-0.3, 0.25, 0.2, -0.05], "lin3": [0.05, 0.05, -0.15, 0.1]}
INTERCEPT = {"lin0": 0.01, "lin1": -0.02, "lin2": 0.03, "lin3": 0.0}
LEFT, RIGHT = [1, 3, 5, -1, -1, -1, -1], [2, 4, 6, -1, -1, -1, -1]
SPLIT_ON, CUT, LEAF = [1, 2, 3, -2, -2, -2, -2], [0.1, -0.4, 0.2, -2.0, -2.0, -2.0, -2.0], [0.0, 0.0, 0.0, 0.5, -0.25, 0.75, -1.0]
BOOK_FEATURES = ["rel_spread", "obi_l1", "obi_multi", "micro_dev"]


def hand_models(spark):
    rows = []
    for n, (version, at) in enumerate(VERSION_TIMES.items()):
        for m, coef in COEF.items():
            rows.append((version, at, m, "ridge", "book", MEAN, SCALE, coef, INTERCEPT[m] + n, None, None, None, None, None))
        rows.append((version, at, "tree0", "tree", "book", MEAN, SCALE, None, None, LEFT, RIGHT, SPLIT_ON, CUT, [v * (n + 1) for v in LEAF]))
    df = inline(spark, "version_id, available_at_ns, model_id, family, feature_group, mean, scale, coef, intercept, left, right, feature, threshold, value", rows)
    doubles = {c: F.col(c).cast("array<double>") for c in ("mean", "scale", "coef", "threshold", "value")}
    ints = {c: F.col(c).cast("array<int>") for c in ("left", "right", "feature")}
    return df.withColumns({**doubles, **ints, "intercept": F.col("intercept").cast("double")})


_z = [f"(({c}) - {m}::DOUBLE) / {s}::DOUBLE" for c, m, s in zip(BOOK_FEATURES, MEAN, SCALE)]
_lin = " UNION ALL ".join(
    f"SELECT f.ts_ns, '{m}' AS model_id, {' + '.join(f'{z} * {w}::DOUBLE' for z, w in zip(_z, c))} + {INTERCEPT[m]}::DOUBLE AS base, 1 AS lin FROM scalar f" for m, c in COEF.items())
_f32 = [f"CAST(CAST({z} AS FLOAT) AS DOUBLE)" for z in _z]
_tree = (f"SELECT f.ts_ns, 'tree0' AS model_id, CASE WHEN {_f32[1]} <= 0.1 THEN CASE WHEN {_f32[2]} <= -0.4 THEN 0.5::DOUBLE ELSE -0.25 END "
         f"ELSE CASE WHEN {_f32[3]} <= 0.2 THEN 0.75 ELSE -1.0 END END AS base, 0 AS lin FROM scalar f")
cte("handraw", f"{_lin} UNION ALL {_tree}")
cte("handver", "SELECT * FROM (VALUES " + ", ".join(f"('{v}', CAST({t} AS BIGINT), {n})" for n, (v, t) in enumerate(VERSION_TIMES.items())) + ") v(version_id, available_at_ns, n)")


def _scored(spark, sf):
    rows = fx.with_obi_l1(study.blocked(spark, sf))
    rows = fx.with_micro_dev(fx.with_obi_multi(rows))
    return rows.withColumn("x", F.array(*BOOK_FEATURES))


def _with_models(spark, sf, family):
    folded = md.fold_versions(hand_models(spark).where(F.col("family") == family).where("version_id = 'v1'"))
    one = folded.select(F.col("models")).withColumn("_j", F.lit(1))
    return _scored(spark, sf).withColumn("_j", F.lit(1)).join(one, "_j").select("ts_ns", "x", F.explode("models").alias("m"))


@query("m06_predict_linear", "SELECT ts_ns, model_id, round(base, 6) + 0.0 AS yhat FROM handraw WHERE lin = 1")
def m06(spark, sf):
    rows = _with_models(spark, sf, "ridge")
    return rows.select("ts_ns", "m.model_id", r6(md.predict_linear(F.col("x"), F.col("m"))).alias("yhat"))


@query("m07_predict_tree", "SELECT ts_ns, model_id, round(base, 6) + 0.0 AS yhat FROM handraw WHERE lin = 0")
def m07(spark, sf):
    rows = _with_models(spark, sf, "tree")
    return rows.select("ts_ns", "m.model_id", r6(md.predict_tree(F.col("x"), F.col("m"), 2)).alias("yhat"))


@query("m08_predict_library", """
SELECT s.ts_ns, v.version_id, CASE WHEN v.version_id IS NULL THEN NULL ELSE h.model_id END AS model_id,
       CASE WHEN v.version_id IS NULL OR NOT f.feature_valid THEN NULL
            WHEN lin = 1 THEN round(base + v.n, 6) + 0.0 ELSE round(base * (v.n + 1), 6) + 0.0 END AS yhat
FROM (SELECT DISTINCT ts_ns FROM scalar) s ASOF LEFT JOIN handver v ON v.available_at_ns <= s.ts_ns
JOIN handraw h ON h.ts_ns = s.ts_ns JOIN feat f ON f.ts_ns = s.ts_ns
WHERE v.version_id IS NOT NULL OR h.model_id = 'lin0'""")
def m08(spark, sf):
    rows = study.prepared(spark, sf)
    out = md.predict_library(rows, hand_models(spark), UNTIL, {"book": F.array(*BOOK_FEATURES)}, F.col("feature_valid"), 2, ["ts_ns"])
    return out.select("ts_ns", "version_id", "model_id", r6(F.col("yhat")).alias("yhat"))


# The joined-up run: prepared rows train the library, which is audited and then forecasts the same rows.
MODEL_AGE = 4 * DAY  # versions come weekly, so the end of a week has none that is fresh enough
cte("scalers", f"""
SELECT update_session, history_count, feature_group, i, count(*) AS n, avg(x) AS mean, coalesce(nullif(stddev_pop(x), 0), 1) AS scale
FROM ({_unpivot}) GROUP BY ALL""")
cte("visible", """
SELECT ts_ns, library_valid, version_id, available_at_ns
FROM feat f ASOF LEFT JOIN (SELECT DISTINCT update_session AS version_id, available_at_ns FROM tdays) v ON v.available_at_ns <= f.ts_ns""")
cte("libx", "SELECT ts_ns, e.feature_group, e.i, e.x FROM (SELECT ts_ns, unnest([" + ", ".join(
    f"{{'feature_group': '{g}', 'i': {i}, 'x': {c}}}" for g, cs in FEATURE_GROUPS.items() for i, c in enumerate(cs)) + "]) AS e FROM feat WHERE library_valid)")
cte("fitraw", """
SELECT v.ts_ns, history_count, feature_group, sum(coef * (x - mean) / scale) + any_value(intercept) AS y
FROM visible v JOIN ridgefit r ON r.update_session = v.version_id JOIN scalers s USING (update_session, history_count, feature_group, i)
JOIN libx x USING (ts_ns, feature_group, i) WHERE s.n >= 2 GROUP BY ALL""")
cte("fitpred", f"""
SELECT *, CASE WHEN reason IS NULL THEN y END AS yhat FROM (
  SELECT v.ts_ns, v.version_id, CASE WHEN v.version_id IS NOT NULL THEN 'ridge-' || feature_group || '-h' || history_count END AS model_id, y,
         CASE WHEN v.version_id IS NULL THEN 'no_version' WHEN v.ts_ns - available_at_ns > {MODEL_AGE} THEN 'stale_version'
              WHEN NOT library_valid THEN 'invalid_features' WHEN y IS NULL THEN 'not_fitted' END AS reason
  FROM visible v LEFT JOIN (SELECT DISTINCT update_session, history_count, feature_group
                            FROM tdays CROSS JOIN (VALUES ('price'), ('displayed_volume'), ('price_volume')) g(feature_group)) w ON w.update_session = v.version_id
  LEFT JOIN fitraw USING (ts_ns, history_count, feature_group))""")


def fitted_signals(spark, sf):
    """Forecasts of the fitted linear models for every prepared row, from the version visible there."""
    rows = prepared_rows(spark, sf)
    models = settle(_library(spark, sf, rows=rows).where("family = 'ridge'"), "library")
    require_empty(md.audit_library(models), "fitted library")
    vectors = {g: F.array(*cs) for g, cs in FEATURE_GROUPS.items()}
    return md.predict_library(rows, models, UNTIL, vectors, F.col("library_valid"), STUDY.tree_depth, ["instrument_id", "ts_ns"], MODEL_AGE)


@query("m08_fitted_library", "SELECT ts_ns, version_id, model_id, round(yhat * 1e6, 4) + 0.0 AS yhat, reason FROM fitpred")
def m08_fitted(spark, sf):
    return fitted_signals(spark, sf).select("ts_ns", "version_id", "model_id", (F.round(F.col("yhat") * 1e6, 4) + 0.0).alias("yhat"), "reason")


@query("m09_fitted_available", "SELECT ts_ns, bool_and(yhat IS NOT NULL) AS decidable FROM fitpred GROUP BY 1")
def m09_fitted(spark, sf):
    return md.all_available(fitted_signals(spark, sf), ["ts_ns"])


@query("m10_fitted_ensemble", "SELECT ts_ns, CASE WHEN count(yhat) = count(*) THEN round(avg(yhat) * 1e6, 4) + 0.0 END AS yhat FROM fitpred GROUP BY 1")
def m10_fitted(spark, sf):
    return md.ensemble(fitted_signals(spark, sf), ["ts_ns"]).select("ts_ns", (F.round(F.col("yhat") * 1e6, 4) + 0.0).alias("yhat"))


@query("m11_fitted_direction", "SELECT ts_ns, model_id, CASE WHEN yhat > 1.5e-5 THEN 1 WHEN yhat < -1.5e-5 THEN -1 WHEN yhat IS NOT NULL THEN 0 END AS direction FROM fitpred")
def m11_fitted(spark, sf):
    return fitted_signals(spark, sf).select("ts_ns", "model_id", md.direction(F.col("yhat"), STUDY.threshold).alias("direction"))


cte("signal_rows", """
SELECT file_date, ts_ns, sequence, (bid_px_00 + ask_px_00) / 2 AS mid_price
FROM snapshot""")
cte("pred", """
SELECT file_date, ts_ns, mid_price, m AS model_id, CASE WHEN (sequence + m) % 17 = 0 THEN NULL ELSE ((sequence * (7 + m)) % 201 - 100) / 1e5 END AS yhat
FROM signal_rows CROSS JOIN (VALUES (0), (1), (2), (3)) models(m)""")


def predictions(spark, sf):
    """Four made-up forecasts for every snapshot."""
    rows = fx.with_mid_spread(study.snapshots(spark, sf, study.TOUCH))
    rows = rows.withColumn("model_id", F.explode(F.array(*[F.lit(m) for m in range(4)])))
    raw = ((F.col("sequence") * (7 + F.col("model_id"))) % 201 - 100) / F.lit(1e5)
    yhat = F.when((F.col("sequence") + F.col("model_id")) % 17 != 0, raw)
    return rows.select("instrument_id", "file_date", "ts_ns", "mid_price", "model_id", yhat.alias("yhat"))


@query("m09_all_available", "SELECT ts_ns, bool_and(yhat IS NOT NULL) AS decidable FROM pred GROUP BY 1")
def m09(spark, sf):
    return md.all_available(predictions(spark, sf), ["ts_ns"])


@query("m10_ensemble", "SELECT ts_ns, CASE WHEN count(yhat) = count(*) THEN round(avg(yhat) * 1e5, 6) + 0.0 END AS yhat FROM pred GROUP BY 1")
def m10(spark, sf):
    return md.ensemble(predictions(spark, sf), ["ts_ns"]).select("ts_ns", r6(F.col("yhat") * 1e5).alias("yhat"))


@query("m11_direction", "SELECT ts_ns, model_id, CASE WHEN yhat > 1.5e-5 THEN 1 WHEN yhat < -1.5e-5 THEN -1 WHEN yhat IS NOT NULL THEN 0 END AS direction FROM pred")
def m11(spark, sf):
    return predictions(spark, sf).select("ts_ns", "model_id", md.direction(F.col("yhat"), STUDY.threshold).alias("direction"))
