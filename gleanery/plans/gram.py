"""Linear models of nested terms from one Gram matrix.

One pass sums the products of all columns; after that every model is arithmetic
on a matrix of (terms + 2) squared: the sweep operator takes a term into the
model, so linear, ridge and every nested block need no further pass over the
rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TINY = 1e-9


def gram(rows: DataFrame, terms: list[str], label: str) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, means, centred products) of the terms and, last, the label; rows with a null in any are left out.

    Tasks sum outer products of shifted rows a batch at a time; the sums are
    added by place, and (terms + 2) squared numbers reach the driver.
    """
    columns = [*terms, label]
    k = len(columns)
    data = rows.select(F.array(*[F.col(c).cast("double") for c in columns]).alias("x")).filter(F.forall("x", lambda v: v.isNotNull()))

    def sums(batches):
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            x = np.asarray(batch.column(0).flatten(), float).reshape(batch.num_rows, k)
            one = np.concatenate([np.ones((len(x), 1)), x], axis=1)
            total += one.T @ one
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], names=["i", "v"])

    found = data.mapInArrow(sums, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").toArrow()
    total = np.asarray(found["v"], float).reshape(k + 1, k + 1) if found.num_rows else np.zeros((k + 1, k + 1))
    n = int(round(total[0, 0]))
    means = total[0, 1:] / max(n, 1)
    return n, means, total[1:, 1:] - n * np.outer(means, means)


def sweep(a: np.ndarray, j: int) -> np.ndarray:
    """The matrix with term j taken into the model: the last column holds coefficients, the last cell the squared error, and the block of terms taken in is minus the inverse of their products."""
    d = a[j, j]
    out = a - np.outer(a[:, j], a[j, :]) / d
    out[:, j], out[j, :] = a[:, j] / d, a[j, :] / d
    out[j, j] = -1 / d
    return out


def nested(n: int, products: np.ndarray, blocks: list[list[int]], ridge: float = 0.0) -> list[dict]:
    """After each block: the terms in the model, their coefficients, the squared error of all rows, and r2.

    A term that the others explain (a pivot of TINY of its own spread, or less)
    stays out with coefficient 0.  `ridge` adds that share of its own spread to
    each term's product with itself; the squared error is that of the rows, as
    `products` give it, without the penalty.
    """
    k = len(products) - 1
    spread = np.diag(products)[:k].copy()
    a = products.astype(float).copy()
    a[np.arange(k), np.arange(k)] += ridge * spread
    taken: list[int] = []
    out = []
    for block in blocks:
        for j in block:
            if spread[j] > 0 and a[j, j] > TINY * spread[j]:
                a = sweep(a, j)
                taken.append(j)
        beta = np.zeros(k)
        beta[taken] = a[taken, k]
        error = float(products[k, k] - 2 * beta @ products[:k, k] + beta @ products[:k, :k] @ beta)
        out.append({"terms": len(taken), "coefficients": beta, "mse": error / max(n, 1), "r2": float(1 - error / products[k, k]) if products[k, k] > 0 else None})
    return out


def nested_models(rows: DataFrame, blocks: dict[str, list[str]], label: str, ridge: float = 0.1) -> DataFrame:
    """(model, step, block, n, n_terms, rmse, r2, marginal_r2) of linear and ridge models of the blocks taken in one by one; one pass over the rows."""
    terms = [t for block in blocks.values() for t in block]
    n, _, products = gram(rows, terms, label)
    places, at = [], 0
    for block in blocks.values():
        places.append(list(range(at, at + len(block))))
        at += len(block)
    found = []
    for model, share in (("linear", 0.0), ("ridge", ridge)):
        for step, (name, row) in enumerate(zip(blocks, nested(n, products, places, share), strict=True)):
            found.append((model, step + 1, name, n, row["terms"], float(np.sqrt(max(row["mse"], 0.0))), row["r2"]))
    table = rows.sparkSession.createDataFrame(found, "model string, step int, block string, n long, n_terms int, rmse double, r2 double")
    return table.withColumn("marginal_r2", F.col("r2") - F.coalesce(F.lag("r2").over(W.partitionBy("model").orderBy("step")), F.lit(0.0)))


def linear_coefficients(rows: DataFrame, terms: list[str], label: str, ridge: float = 0.0) -> DataFrame:
    """(term, coefficient) of one model of all terms, the intercept first."""
    n, means, products = gram(rows, terms, label)
    beta = nested(n, products, [list(range(len(terms)))], ridge)[0]["coefficients"]
    intercept = float(means[-1] - beta @ means[:-1])
    return rows.sparkSession.createDataFrame([("intercept", intercept), *zip(terms, map(float, beta), strict=True)], "term string, coefficient double")
