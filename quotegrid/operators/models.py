"""Model fits from distributed sufficient statistics, and versioned prediction.

Centred moments of disjoint rows can be merged, so training rows are reduced once per
session inside the tasks that hold them.  A version trained on the last k sessions
merges k small rows; training rows are never copied per version.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotegrid.operators.calendar import asof_version
from quotegrid.operators.features import bounded_sample
from quotegrid.params import FEATURE_GROUPS, LIBRARY_FEATURES
from quotegrid.session import settle

MODEL_KEYS = ["update_session", "history_count", "feature_group"]


def by_feature_group(samples: DataFrame, keep: list[str]) -> DataFrame:
    """One row per sample and feature group with its vector ``x``."""
    groups = F.array(*[F.struct(F.lit(n).alias("feature_group"), F.array(*c).alias("x")) for n, c in FEATURE_GROUPS.items()])
    return samples.select(*keep, F.inline(groups))


VARIABLES = [*LIBRARY_FEATURES, "y"]
Y = len(LIBRARY_FEATURES)
# Groups a task holds before it emits their partial moments.
HELD = 1024


def combine(a: tuple, b: tuple) -> tuple:
    """Count, mean and co-moments of two disjoint row sets taken together."""
    n, apart = a[0] + b[0], b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)


def session_moments(samples: DataFrame, by: list[str]) -> DataFrame:
    """Count, mean and centred co-moments of the features and ``y`` per group.

    Each task reduces its rows batch by batch with matrix products and emits a row per
    group it saw; those are merged pairwise.  Nothing is a difference of large sums, so
    features far from zero keep their digits and a constant one has a co-moment of
    exactly zero.  Rows with a NULL or NaN variable count nowhere; no rows give no groups.
    """
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in samples.select(*by).schema.fields)

    def reduce(batches):
        held = {}

        def emit():
            rows = [(*key, n, mean, list(co)) for key, (n, mean, co) in held.items()]
            held.clear()
            return pd.DataFrame(rows, columns=[*by, "n", "mean", "co"])

        for batch in batches:
            for key, rows in batch.groupby(by, sort=False, dropna=False):
                values = rows[VARIABLES].to_numpy(float)
                shifted = values - values[0]
                mean = shifted.mean(axis=0)
                shifted -= mean
                part = len(values), values[0] + mean, shifted.T @ shifted
                held[key] = combine(held[key], part) if key in held else part
            if len(held) >= HELD:
                yield emit()
        if held:
            yield emit()

    known = samples.select(*by, *VARIABLES).dropna(subset=VARIABLES)
    parts = known.mapInPandas(reduce, f"{kinds}, n bigint, mean array<double>, co array<array<double>>")
    return merge_moments(parts, by)


def merge_moments(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Moments per key from those of disjoint parts: one row per task or session and key."""

    def both(a, b):
        n = a["n"] + b["n"]
        apart = F.zip_with(a["mean"], b["mean"], lambda x, y: y - x)
        mean = F.zip_with(a["mean"], apart, lambda m, d: m + d * (b["n"] / n))
        weight = a["n"] * b["n"] / n
        co = F.transform(a["co"], lambda row, i: F.transform(row, lambda v, j: v + F.get(F.get(b["co"], i), j) + F.get(apart, i) * F.get(apart, j) * weight))
        return F.struct(n.alias("n"), mean.alias("mean"), co.alias("co"))

    # sorted, so that the order of merging doesn't depend on the shuffle
    rows = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("n", "mean", "co"))).alias("_parts"))
    rest = F.slice("_parts", F.lit(2), F.size("_parts"))
    return rows.withColumn("_all", F.aggregate(rest, F.get("_parts", F.lit(0)), both)).select(*keys, "_all.*")


def version_moments(per_session: DataFrame, days: DataFrame) -> DataFrame:
    """Moments of each (update, k) over its training sessions."""
    tagged = days.select("update_session", "history_count", "session_id").join(per_session, "session_id")
    return merge_moments(tagged, ["update_session", "history_count"])


def normal_equations(moments: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key and feature group: n, mean, population deviation ``scale`` (1 for a
    constant feature), the standardized matrix ``zz`` = z'z and ``zy`` = z'y, and ``y_mean``."""
    at = lambda column, i: F.get(column, i)

    def group(name, columns):
        where = F.array(*[F.lit(LIBRARY_FEATURES.index(c)) for c in columns])
        return F.struct(
            F.lit(name).alias("feature_group"), F.transform(where, lambda i: at(F.col("mean"), i)).alias("mean"),
            F.transform(where, lambda i: F.transform(where, lambda j: at(at(F.col("co"), i), j))).alias("zz"),
            F.transform(where, lambda i: at(at(F.col("co"), i), F.lit(Y))).alias("zy"))

    rows = moments.select(*[k for k in keys if k != "feature_group"], "n", at(F.col("mean"), F.lit(Y)).alias("y_mean"),
                          F.inline(F.array(*[group(g, c) for g, c in FEATURE_GROUPS.items()])))
    deviation = lambda row, i: F.when(at(row, i) == 0, 1.0).otherwise(F.sqrt(at(row, i) / F.col("n")))
    rows = rows.withColumn("scale", F.transform("zz", deviation))
    scale = lambda i: at(F.col("scale"), i)
    return rows.withColumns({
        "zz": F.transform("zz", lambda row, i: F.transform(row, lambda v, j: v / (scale(i) * scale(j)))),
        "zy": F.zip_with("zy", "scale", lambda v, s: v / s)})


def scaler_stats(moments: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and population deviation per feature position; zero deviation counts as one."""
    pairs = normal_equations(moments, keys).select(*keys, "n", F.posexplode(F.arrays_zip("mean", "scale")).alias("i", "_s"))
    return pairs.select(*keys, "n", "i", "_s.mean", "_s.scale")


def gram(moments: DataFrame, keys: list[str]) -> DataFrame:
    """Standardized normal-equation entries in long form: j >= i is z'z, j = -1 is z'y."""
    rows = normal_equations(moments, keys)
    rows = rows.select(*keys, "n", F.posexplode(F.zip_with("zz", "zy", lambda row, v: F.concat(F.array(v), row))).alias("i", "_row"))
    rows = rows.select(*keys, "n", "i", F.posexplode("_row").alias("j", "value")).withColumn("j", F.col("j") - 1)
    return rows.where((F.col("j") >= F.col("i")) | (F.col("j") == -1))


def solve(matrix: Column, right: Column) -> Column:
    """x of matrix x = right by elimination; stable without pivoting as the matrix is symmetric and positive definite."""
    rows = F.zip_with(matrix, right, lambda row, v: F.concat(row, F.array(v)))

    def step(state, k):
        row = F.get(state, k)
        pivot = F.transform(row, lambda v: v / F.get(row, k))
        return F.transform(state, lambda other, i: F.when(i == k, pivot).otherwise(
            F.zip_with(other, pivot, lambda v, q: v - F.get(other, k) * q)))

    done = F.aggregate(F.sequence(F.lit(0), F.size(matrix) - 1), rows, step)
    return F.transform(done, lambda row: F.element_at(row, -1))


def ridge(moments: DataFrame, keys: list[str], alpha: float) -> DataFrame:
    """(z'z + alpha I) b = z'y per key; centred z has zero sums, so the intercept is the label mean."""
    rows = normal_equations(moments, keys)
    matrix = F.transform("zz", lambda row, i: F.transform(row, lambda v, j: v + F.when(i == j, float(alpha)).otherwise(0.0)))
    return rows.select(*keys, solve(matrix, F.col("zy")).alias("coef"), F.col("y_mean").alias("intercept"))


TREE_SCHEMA = ("left array<int>, right array<int>, feature array<int>, threshold array<double>, "
               "value array<double>, node_rows array<int>")


def best_split(z: np.ndarray, y: np.ndarray, min_leaf: int):
    """Feature and threshold of the largest squared-error gain, or None."""
    n, best = len(y), (1e-15, None, None)
    total = y.sum()
    if n < 2 * min_leaf:
        return None
    counts = np.arange(1, n)
    for f in range(z.shape[1]):
        order = np.argsort(z[:, f], kind="stable")
        v, left = z[order, f], np.cumsum(y[order])[:-1]
        gain = left**2 / counts + (total - left) ** 2 / (n - counts) - total**2 / n
        ok = (v[1:] > v[:-1]) & (counts >= min_leaf) & (n - counts >= min_leaf)
        if ok.any():
            at = int(np.argmax(np.where(ok, gain, -np.inf)))
            if gain[at] > best[0]:
                best = (gain[at], f, (float(v[at]) + float(v[at + 1])) / 2)
    return best[1:] if best[1] is not None else None


def tree(samples: DataFrame, keys: list[str], depth: int, min_leaf: int) -> DataFrame:
    """Exact-threshold regression tree per group on standardized ``z``.

    ``samples`` must come from ``bounded_sample``: a group then has at most the
    sample limit of rows whatever the training set holds.
    """
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in samples.select(*keys).schema.fields)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        z = np.stack(pdf.z.to_numpy()).astype(np.float32)
        y = pdf.y.to_numpy(float)
        nodes = []

        def add(rows, level):
            at = len(nodes)
            nodes.append([-1, -1, -2, -2.0, float(y[rows].mean()), len(rows)])
            split = best_split(z[rows], y[rows], min_leaf) if level < depth else None
            if split:
                f, cut = split
                below = z[rows, f].astype(float) <= cut
                nodes[at][2:4] = [f, cut]
                nodes[at][0] = add(rows[below], level + 1)
                nodes[at][1] = add(rows[~below], level + 1)
            return at

        add(np.arange(len(y)), 0)
        columns = dict(zip(["left", "right", "feature", "threshold", "value", "node_rows"], map(list, zip(*nodes))))
        head = pdf.iloc[0]
        return pd.DataFrame([{**{k: head[k] for k in keys}, **columns}])

    return samples.groupBy(*keys).applyInPandas(grow, f"{kinds}, {TREE_SCHEMA}")


def standardized(rows: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``z``; ``stats`` has one row per key with mean and scale arrays."""
    joined = rows.join(stats.select(*keys, "mean", "scale"), keys)
    centered = F.zip_with("x", "mean", lambda v, m: v - m)
    return joined.withColumn("z", F.zip_with(centered, "scale", lambda v, s: v / s)).drop("mean", "scale")


def build_library(samples: DataFrame, days: DataFrame, *, alpha: float, depth: int, min_leaf: int, sample: int, seed: int) -> DataFrame:
    """Twelve models per version: linear and tree, three feature groups, each history length.

    ``samples`` carries session_id, ts_ns, y and the library features.  Fewer than
    two training rows give an ``insufficient_samples`` row.
    """
    # A few rows that five branches below read again.
    moments = settle(version_moments(session_moments(samples, ["session_id"]), days))
    enough = moments.where("n >= 2")
    stats = normal_equations(moments, MODEL_KEYS).select(*MODEL_KEYS, F.col("n").alias("training_rows"), "mean", "scale")
    linear = ridge(enough, MODEL_KEYS, alpha).withColumn("family", F.lit("ridge"))
    tagged = days.select("update_session", "history_count", "session_id").join(samples, "session_id")
    drawn = bounded_sample(tagged, sample, seed, [c for c in ("instrument_id", "session_id", "ts_ns") if c in tagged.columns], ["update_session", "history_count"])
    drawn = by_feature_group(drawn, ["update_session", "history_count", "ts_ns", "y"])
    trees = tree(standardized(drawn, stats.where("training_rows >= 2"), MODEL_KEYS), MODEL_KEYS, depth, min_leaf).withColumn("family", F.lit("tree"))
    fitted = linear.unionByName(trees, allowMissingColumns=True)
    kinds = F.array(F.lit("ridge"), F.lit("tree"))
    groups = F.array(*[F.lit(g) for g in FEATURE_GROUPS])
    wanted = days.groupBy("update_session", "history_count").agg(
        F.min("available_at_ns").alias("available_at_ns"), F.count("session_id").alias("training_sessions"))
    wanted = wanted.withColumn("feature_group", F.explode(groups)).withColumn("family", F.explode(kinds))
    models = wanted.join(stats, MODEL_KEYS, "left").join(fitted, [*MODEL_KEYS, "family"], "left")
    return models.withColumns({
        "version_id": F.col("update_session"),
        "model_id": F.concat_ws("-", "family", "feature_group", F.concat(F.lit("h"), F.col("history_count"))),
        "training_rows": F.coalesce("training_rows", F.lit(0)),
        "status": F.when(F.coalesce(F.col("training_rows") >= 2, F.lit(False)), "fitted").otherwise("insufficient_samples")})


def scaled(x: Column, model: Column) -> Column:
    centered = F.zip_with(x, model["mean"], lambda v, m: v - m)
    return F.zip_with(centered, model["scale"], lambda v, s: v / s)


def predict_linear(x: Column, model: Column) -> Column:
    """((x - mean) / scale) . coef + intercept; ``model`` is a struct column."""
    terms = F.zip_with(scaled(x, model), model["coef"], lambda z, c: z * c)
    return F.aggregate(terms, F.lit(0.0), lambda s, t: s + t) + model["intercept"]


def predict_tree(x: Column, model: Column, depth: int) -> Column:
    """Walk the node arrays; inputs compare as 32-bit floats, ties go left, -1 is a leaf."""
    z = scaled(x, model)

    def step(node, _):
        value = F.get(z, F.get(model["feature"], node)).cast("float").cast("double")
        leaf = F.get(model["left"], node) == -1
        return F.when(leaf, node).when(value <= F.get(model["threshold"], node), F.get(model["left"], node)).otherwise(
            F.get(model["right"], node))

    leaf = F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), step)
    return F.get(model["value"], leaf)


MODEL_FIELDS = ["model_id", "family", "feature_group", "mean", "scale", "coef", "intercept", "left", "right", "feature", "threshold", "value"]


def fold_versions(models: DataFrame) -> DataFrame:
    """One row per version with its models as an array, ready to meet rows by time."""
    return models.groupBy("version_id", "available_at_ns").agg(F.collect_list(F.struct(*MODEL_FIELDS)).alias("models"))


def predict_library(df: DataFrame, models: DataFrame, until_ns: int, vectors: dict[str, Column], valid: Column,
                    depth: int, keep: list[str], max_age_ns: int | None = None) -> DataFrame:
    """Long predictions of the version visible at each row: (keys, version, model, yhat, reason).

    ``yhat`` is NULL and ``reason`` says why where no version exists yet, the version is older than ``max_age_ns``, the
    features are not valid or the model was not fitted.  A row meets its version once; models expand from the array.
    """
    spans = asof_version(df, models.select("version_id", "available_at_ns"), until_ns)
    folded = fold_versions(models).drop("available_at_ns")
    rows = spans.join(folded, "version_id", "left").withColumn("m", F.explode_outer("models"))
    m = F.col("m")
    x = F.lit(None).cast("array<double>")
    for group, vector in vectors.items():
        x = F.when(m["feature_group"] == group, vector).otherwise(x)
    rows = rows.withColumn("_x", x)
    raw = F.when(m["family"] == "tree", predict_tree(F.col("_x"), m, depth)).otherwise(predict_linear(F.col("_x"), m))
    stale = F.lit(False) if max_age_ns is None else F.col("ts_ns") - F.col("available_at_ns") > max_age_ns
    reason = (F.when(F.col("version_id").isNull(), "no_version").when(stale, "stale_version")
              .when(~F.coalesce(valid, F.lit(False)), "invalid_features").when(raw.isNull(), "not_fitted"))
    return rows.select(*keep, "version_id", m["model_id"].alias("model_id"), F.when(reason.isNull(), raw).alias("yhat"), reason.alias("reason"))


def audit_library(models: DataFrame) -> DataFrame:
    """Violations of a fitted library before it is used: (version_id, model_id, rule).

    Versions must come in order with the same model ids; each id stands once in a version; a fitted model has as many
    parameters as its group has features, all finite, scales above zero, and a tree's children lie behind their parent.
    """
    width = F.lit(None).cast("int")
    for group, columns in FEATURE_GROUPS.items():
        width = F.when(F.col("feature_group") == group, len(columns)).otherwise(width)
    bad = lambda c: F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    nodes = F.arrays_zip("left", "right", "feature")
    backwards = F.exists(F.transform(nodes, lambda n, i: (n["left"] != -1) & ((n["left"] <= i) | (n["right"] <= i) | (n["feature"] < 0))), lambda v: v)
    linear, fitted = F.col("family") == "ridge", F.col("status") == "fitted"
    numbers = F.when(linear, bad("coef") | F.col("intercept").isNull() | F.isnan("intercept")).otherwise(bad("value") | bad("threshold"))
    shape = (F.size("mean") != width) | (F.size("scale") != width) | (linear & (F.size("coef") != width))
    rule = (F.when(F.coalesce(fitted & (F.col("mean").isNull() | F.col("scale").isNull() | F.when(linear, F.col("coef").isNull()).otherwise(F.col("value").isNull())), F.lit(False)), "fit_missing")
            .when(fitted & shape, "wrong_width")
            .when(fitted & (numbers | bad("mean") | bad("scale") | F.exists("scale", lambda v: v <= 0)), "bad_number")
            .when(fitted & ~linear & backwards, "tree_not_ordered"))
    single = models.select("version_id", "model_id", rule.alias("rule")).where("rule is not null")
    twice = models.groupBy("version_id", "model_id").count().where("count > 1").select("version_id", "model_id", F.lit("model_twice").alias("rule"))
    order = audit_versions(models).select("version_id", F.lit(None).cast("string").alias("model_id"), "rule")
    return single.unionByName(twice).unionByName(order)


def audit_versions(models: DataFrame) -> DataFrame:
    """Violations: two versions at one time, or a version with other model ids than the first."""
    versions = models.groupBy("version_id", "available_at_ns").agg(
        F.concat_ws(",", F.array_sort(F.collect_set("model_id"))).alias("ids"))
    order = Window.partitionBy(F.lit(1)).orderBy("available_at_ns", "version_id")
    seen = versions.withColumns({"_before": F.lag("available_at_ns").over(order), "_first": F.first("ids").over(order)})
    rule = (F.when(F.col("_before") >= F.col("available_at_ns"), "not_increasing")
            .when(F.col("ids") != F.col("_first"), "model_ids_changed"))
    return seen.select("version_id", rule.alias("rule")).where("rule is not null")


def audit_quote_age(df: DataFrame, max_age_ms: int) -> DataFrame:
    return df.where(F.col("age_ms") > max_age_ms)


def all_available(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Rows are decidable only when every model has a finite prediction."""
    return predictions.groupBy(*keys).agg(F.bool_and(F.col("yhat").isNotNull() & ~F.isnan("yhat")).alias("decidable"))


def ensemble(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Mean over models, NULL if any model is missing."""
    return predictions.groupBy(*keys).agg(
        F.when(F.count("yhat") == F.count(F.lit(1)), F.avg("yhat")).alias("yhat"))


def direction(yhat: Column, threshold: float) -> Column:
    return F.when(yhat > threshold, 1).when(yhat < -threshold, -1).when(yhat.isNotNull(), 0)
