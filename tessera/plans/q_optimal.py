"""Whether the penalised fits are settled: a proximal step from a solution, with the slope taken from the table, must lead back to it."""

from __future__ import annotations

import numpy as np

from tessera.operators import linear as L

from .q_learning import FEATURES, design
from .q_models import GROUPS, returned
from .registry import query

LEAST = ["lasso", "elastic_net", "nonnegative", "ball", "group", "sparse_group", "fused", "path_0.1", "path_0.001"]
FITS = ["lasso", "weighted", "elastic", "nonnegative", "ball", "nonnegative_ball", "group", "sparse_group", "fused", "classes_logistic", "classes_least", "tasks_least", "hinge2_ridge"]


def holds_sql(names: list[str]) -> str:
    return f"SELECT model, true AS settled FROM (VALUES {', '.join(f"('{n}')" for n in names)}) v(model) WHERE (SELECT count(*) FROM lineitem) > 0"


def rows(t, found: dict[str, bool]):
    return t.spark.createDataFrame([(n, bool(ok)) for n, ok in found.items()], "model string, settled boolean")  # a row a model


@query("l8_least_squares_optimal", holds_sql(LEAST))
def _(t):
    """Lasso, elastic net, bounds, balls, groups, fused and path, of the least-squares design."""
    _, gram, cross, _ = L.statistics(design(t), FEATURES, "l_extendedprice")[None]
    top = np.abs(cross).max()
    step = 1 / np.linalg.eigvalsh(gram)[-1]
    nonnegative, _ = L.lasso_penalty(0.01 * top, nonnegative=True)

    def plain(lam):
        return L.lasso_penalty(lam)[0]

    cases = {
        "lasso": (plain(0.01 * top), 0.0), "elastic_net": (plain(0.01 * top), 1000.0), "nonnegative": (nonnegative, 0.0), "ball": (L.l1_ball(0.5), 0.0), "group": (L.shrink_groups(GROUPS)(0.05 * top), 0.0),
        "sparse_group": (L.shrink_groups(GROUPS, within=0.5)(0.05 * top), 0.0), "fused": (L.fused(0.01 * top, 0.05 * top), 0.0), "path_0.1": (plain(0.1 * top), 0.0), "path_0.001": (plain(0.001 * top), 0.0),
    }
    found = {}
    for name, (prox, ridge) in cases.items():
        x = L.solve(gram, cross, prox, ridge)
        back = prox(x - step * (gram @ x - cross + ridge * x), step)
        found[name] = np.abs(back - x).max() < 1e-8
    return rows(t, found)


@query("l9_classifiers_optimal", holds_sql(FITS))
def _(t):
    """Logistic, squared hinge and least squares with weights, balls, groups, fused features, classes and tasks."""
    df = returned(t)
    from pyspark.sql import functions as F

    df = df.withColumn("c", F.when(F.col("y") > 0, 3.0).otherwise(1.0))
    lasso, cost = L.lasso_penalty(0.002)
    only, only_cost = L.lasso_penalty(0.002, nonnegative=True)
    together, together_cost = L.rows_together(0.002, 3)

    def group_cost(within):
        return lambda w: 0.002 * (sum(np.sqrt(len(g)) * np.linalg.norm(w[g]) for g in GROUPS) + within * np.abs(w).sum())

    none = (lambda w: 0.0)
    cases = {
        "lasso": ("y", "logistic", lasso, cost, {}), "weighted": ("y", "logistic", lasso, cost, {"weight": "c"}), "elastic": ("y", "logistic", lasso, cost, {"ridge": 0.05}),
        "nonnegative": ("y", "logistic", only, only_cost, {}), "ball": ("y", "logistic", L.l1_ball(0.01), none, {}), "nonnegative_ball": ("y", "logistic", L.nonnegative_ball(0.01), none, {}),
        "group": ("y", "logistic", L.shrink_groups(GROUPS)(0.002), group_cost(0.0), {}), "sparse_group": ("y", "logistic", L.shrink_groups(GROUPS, 0.5)(0.002), group_cost(0.5), {}),
        "fused": ("y", "logistic", L.fused(0.001, 0.002), lambda w: 0.001 * np.abs(w).sum() + 0.002 * np.abs(np.diff(w)).sum(), {}),
        "classes_logistic": ("flag", "logistic", together, together_cost, {"mode": "class", "blocks": 3}), "classes_least": ("flag", "l2", together, together_cost, {"mode": "class", "blocks": 3}),
        "tasks_least": ("price", "l2", together, together_cost, {"mode": "task", "blocks": 3}), "hinge2_ridge": ("y", "hinge2", None, none, {"ridge": 0.1}),
    }
    found = {}
    for name, (target, loss, prox, penalty, options) in cases.items():
        w, _ = L.newton_fit(df, FEATURES, target, loss, prox, penalty, **options)
        passed = {k: v for k, v in options.items() if k in ("mode", "weight")}
        _, slope, _, total = L.second_order(df, FEATURES, target, loss, w, **passed)
        slope = slope / total
        slope[:, :-1] += options.get("ridge", 0.0) * w[:, :-1]
        inner = (w - slope)[:, :-1].ravel()
        back = inner if prox is None else prox(inner, 1.0)
        found[name] = np.abs(back - w[:, :-1].ravel()).max() < 1e-5 and np.abs(slope[:, -1]).max() < 1e-5
    return rows(t, found)
