"""One fit for every group at once: Newton steps whose sums are one aggregation keyed by group.

A step costs one pass and one shuffle of (terms + 1) squared numbers a group and
task, whatever the number of groups, so jobs grow with the steps and not with
the groups.  Tasks sum outer products a batch at a time; each group's system is
solved in a task of its own.  Groups are broadcast while they are few, and
joined beyond that.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.operators import metrics
from gleanery.operators.lineage import cut
from gleanery.operators.scan import small

CAP = 30.0


def _prepared(rows: DataFrame, by: str, terms: list[str], label: str, weight: str | None) -> DataFrame:
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return rows.select(F.col(by).cast("string").alias("g"), F.array(*[F.col(t).cast("double") for t in terms]).alias("x"), F.col(label).cast("double").alias("y"), w.alias("w"))


def _scales(data: DataFrame, terms: list[str]) -> DataFrame:
    """(g, total, mean, scale, penalty): a group's weight, the terms' means and deviations, and the squared weighted deviation of each standardised term."""
    x = [F.col("x")[k] for k in range(len(terms))]
    sums = [F.struct(F.avg(c).alias("m"), F.stddev_samp(c).alias("s"), F.sum(F.col("w") * c).alias("wx"), F.sum(F.col("w") * c * c).alias("wxx")).alias(f"t{k}") for k, c in enumerate(x)]
    each = data.groupBy("g").agg(F.sum("w").alias("total"), F.sum(F.col("w") * F.col("w")).alias("w2"), *sums)
    scale = lambda k: F.when(F.col(f"t{k}.s") > 0, F.col(f"t{k}.s")).otherwise(0.0)
    unbiased = F.col("total") - F.col("w2") / F.col("total")
    spread = lambda k: (F.col(f"t{k}.wxx") - F.col(f"t{k}.wx") * F.col(f"t{k}.wx") / F.col("total")) / unbiased
    penalty = lambda k: F.when((scale(k) > 0) & (unbiased > 0), spread(k) / (scale(k) * scale(k))).otherwise(0.0)
    every = range(len(terms))
    return each.select("g", "total", F.array(*[F.col(f"t{k}.m") for k in every]).alias("mean"), F.array(*[scale(k) for k in every]).alias("scale"), F.array(*[penalty(k) for k in every]).alias("penalty"))


def _standardised(batch: pa.RecordBatch, k: int):
    """(groups, rows of each, design matrix with a leading 1, y, w) of a batch (g, x, y, w, mean, scale, ...)."""
    names, code = np.unique(np.asarray(batch.column(0).to_pylist(), object).astype(str), return_inverse=True)
    flat = lambda i: np.asarray(batch.column(i).flatten(), float).reshape(batch.num_rows, k)
    scale = flat(5)
    z = np.where(scale > 0, (flat(1) - flat(4)) / np.where(scale > 0, scale, 1.0), 0.0)
    return names, code, np.concatenate([np.ones((len(z), 1)), z], axis=1), np.asarray(batch.column(2), float), np.asarray(batch.column(3), float)


def _step(data: DataFrame, state: DataFrame, n: int, k: int, reg: float) -> DataFrame:
    """The state after one Newton step, with `change`, the largest step of a coefficient."""
    upper = np.triu_indices(k + 1)

    def sums(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            names, code, z, y, w = _standardised(batch, k)
            beta = np.asarray(batch.column(6).flatten(), float).reshape(len(y), k + 1)
            p = 1 / (1 + np.exp(-np.clip((z * beta).sum(axis=1), -CAP, CAP)))
            for i, name in enumerate(names):
                own = code == i
                a, q, v = z[own], p[own], w[own]
                part = np.concatenate([a.T @ (v * (q - y[own])), ((a * (v * q * (1 - q))[:, None]).T @ a)[upper]])
                held[name] = held[name] + part if name in held else part
        for name, part in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(len(part)), pa.int32()), pa.array(part)], names=["g", "i", "v"])

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        v = rows.sort_values("i")["v"].to_numpy()
        first = rows.iloc[0]
        total, beta, penalty = first["total"], np.asarray(first["beta"], float), np.concatenate([[0.0], np.asarray(first["penalty"], float)])
        h = np.zeros((k + 1, k + 1))
        h[upper] = v[k + 1 :] / total
        h = h + h.T - np.diag(np.diag(h)) + reg * np.diag(penalty)
        g = v[: k + 1] / total + reg * penalty * beta
        fixed = np.diag(h) <= 1e-300  # a term that does not vary keeps its 0
        h[fixed, :], h[:, fixed], g[fixed] = 0.0, 0.0, 0.0
        h[fixed, fixed] = 1.0
        step = np.clip(np.linalg.lstsq(h, g, rcond=1e-13)[0], -5.0, 5.0)
        return pd.DataFrame({"g": [first["g"]], "total": [total], "mean": [first["mean"]], "scale": [first["scale"]], "penalty": [first["penalty"]], "beta": [beta - step], "change": [float(np.abs(step).max())]})

    joined = data.join(small(state.select("g", "mean", "scale", "beta"), n), "g").select("g", "x", "y", "w", "mean", "scale", "beta")
    found = joined.mapInArrow(sums, "g string, i int, v double").groupBy("g", "i").agg(F.sum("v").alias("v"))
    schema = "g string, total double, mean array<double>, scale array<double>, penalty array<double>, beta array<double>, change double"
    return cut(found.join(small(state.drop("change"), n), "g").groupBy("g").applyInPandas(solve, schema))


def logit(rows: DataFrame, by: str, terms: list[str], label: str = "label", weight: str | None = None, reg: float = 0.0, rounds: int = 25, tol: float = 1e-10) -> DataFrame:
    """(g, total, mean, scale, penalty, beta, change): a logistic regression for each group, beta led by the intercept, for terms that are standardised within the group.

    Least weighted mean log loss plus reg / 2 times the sum of squared
    coefficients in units of weighted deviation; the intercept is free.  Rows
    with a null term, label or weight take no part, nor do those without a group.  Terms that do not
    vary in a group have coefficient 0 there.
    """
    data = _prepared(rows, by, terms, label, weight)
    data = data.filter(F.col("g").isNotNull() & F.col("y").isNotNull() & F.col("w").isNotNull() & F.forall("x", lambda v: v.isNotNull())).persist(StorageLevel.MEMORY_AND_DISK)
    k = len(terms)
    state = cut(_scales(data, terms).withColumn("beta", F.array_repeat(F.lit(0.0), k + 1)).withColumn("change", F.lit(float("inf"))))
    n = state.count()
    for _ in range(rounds if n else 0):
        state = _step(data, state, n, k, reg)
        if state.agg(F.max("change")).first()[0] <= tol:
            break
    data.unpersist()
    return state


def coefficients(state: DataFrame, terms: list[str]) -> DataFrame:
    """(g, term, coefficient) of the standardised terms, and of the intercept."""
    return state.select("g", F.posexplode("beta").alias("i", "coefficient")).select("g", F.element_at(F.array(*map(F.lit, ["intercept", *terms])), F.col("i") + 1).alias("term"), "coefficient")


def scored(rows: DataFrame, state: DataFrame, by: str, terms: list[str], out: str = "score") -> DataFrame:
    """The rows whose group was fitted, with the chance of label 1 by its model; native expressions only."""
    named = state.select(F.col("g").alias("_g"), F.col("mean").alias("_m"), F.col("scale").alias("_s"), F.col("beta").alias("_b"))
    z = lambda i, t: F.when(F.col("_s")[i] > 0, (F.col(t).cast("double") - F.col("_m")[i]) / F.col("_s")[i]).otherwise(0.0)
    eta = sum((F.col("_b")[i + 1] * z(i, t) for i, t in enumerate(terms)), F.col("_b")[0])
    return rows.join(small(named, named.count()), F.col(by).cast("string") == F.col("_g")).withColumn(out, 1 / (1 + F.exp(-eta))).drop("_g", "_m", "_s", "_b")


def per_group(train: DataFrame, test: DataFrame, by: str, terms: list[str], label: str = "label", reg: float = 0.001, least_train: int = 1000, least_test: int = 200) -> tuple[DataFrame, DataFrame]:
    """(measures, coefficients) of a class-weighted logit for each group with rows enough: by, n, base_rate, pr_auc, pr_auc_lift, roc_auc; and g, term, coefficient.

    All groups share the passes: the number of jobs does not depend on theirs.
    """
    pos, neg = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    sizes = train.groupBy(F.col(by).alias("_by")).agg(F.count("*").alias("_n"), (neg / F.greatest(pos, F.lit(1))).alias("_ratio"))
    tested = test.groupBy(F.col(by).alias("_by")).agg(F.count("*").alias("_t"))
    enough = cut(sizes.join(tested, "_by").filter((F.col("_n") >= least_train) & (F.col("_t") >= least_test)).select("_by", "_ratio"))
    n = enough.count()
    chosen = train.join(small(enough, n), F.col(by) == F.col("_by")).withColumn("_w", F.when(F.col(label) == 1, F.col("_ratio")).otherwise(1.0))
    state = logit(chosen, by, terms, label, "_w", reg)
    found = scored(test, state, by, terms, "_p").select(F.col(by), F.col(label).alias("_y"), F.col("_p"))
    return metrics.evaluate_by(found, by, "_y", "_p"), coefficients(state, terms)
