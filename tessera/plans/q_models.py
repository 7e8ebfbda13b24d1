"""Penalised classifiers and regressions with the losses and penalties beyond least squares and the plain lasso."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import dual as S
from tessera.operators import linear as L

from .q_learning import FEATURES, design
from .registry import query
from .scratch import materialize


def returned(t) -> DataFrame:
    """The lineitem design with label 1 for returned lines, -1 for others, and its flag's number."""
    flags = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    rows = design(t).withColumns({"y": F.when(F.col("l_returnflag") == "R", 1.0).otherwise(-1.0), "flag": flags.cast("double")})
    return materialize(rows.select(*FEATURES, "l_extendedprice", "y", "flag", F.struct(flags.cast("int").alias("task"), F.col("l_extendedprice").alias("label")).alias("price"), F.struct(flags.cast("int").alias("task"), F.when(F.col("l_extendedprice") > 0, 1.0).otherwise(-1.0).alias("label")).alias("dear")), "design")


def table(t, fits: dict[str, np.ndarray], names: list[str]) -> DataFrame:
    """(model, block, feature, weight), one row a weight."""
    rows = [(m, b, f, round(float(v), 5)) for m, w in fits.items() for b, row in enumerate(np.atleast_2d(w)) for f, v in zip([*names, "intercept"], row, strict=True)]
    return t.spark.createDataFrame(rows, "model string, block int, feature string, weight double")


@query("l7_svm_losses")
def _(t):
    """hinge, squared hinge, l1, l2 and logistic loss with a ridge, label 0 against the rest."""
    n = t.embeddings.agg(F.max(F.size("embedding"))).first()[0]
    names = [f"x{i}" for i in range(n)]
    rows = materialize(t.embeddings.select(*(F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(n)), F.when(F.col("label") == 0, 1.0).otherwise(-1.0).alias("y")), "rows")
    return table(t, {loss: L.newton_fit(rows, names, "y", loss, ridge=0.1)[0] for loss in ("hinge", "hinge2", "l1", "l2", "logistic")}, names)


@query("l9_logistic_variants")
def _(t):
    """Weighted classes, elastic net, non-negative weights, and the balls of both."""
    rows = returned(t).withColumn("c", F.when(F.col("y") > 0, 3.0).otherwise(1.0))
    fits = {}
    for name, options in {"lasso": {}, "weighted": {"weight": "c"}, "elastic": {"ridge": 0.05}}.items():
        prox, penalty = L.lasso_penalty(0.002)
        fits[name] = L.newton_fit(rows, FEATURES, "y", "logistic", prox, penalty, **options)[0]
    prox, penalty = L.lasso_penalty(0.002, nonnegative=True)
    fits["nonnegative"] = L.newton_fit(rows, FEATURES, "y", "logistic", prox, penalty)[0]
    fits["ball"] = L.newton_fit(rows, FEATURES, "y", "logistic", L.l1_ball(0.01))[0]
    fits["nonnegative_ball"] = L.newton_fit(rows, FEATURES, "y", "logistic", L.nonnegative_ball(0.01))[0]
    return table(t, fits, FEATURES)


GROUPS = [[0], [1, 2], [3, 4, 5]]


@query("l10_group_logistic")
def _(t):
    rows = returned(t)
    fits = {}
    for name, within in (("group", 0.0), ("sparse_group", 0.5)):
        def penalty(w, within=within):
            return 0.002 * (sum(np.sqrt(len(g)) * np.linalg.norm(w[g]) for g in GROUPS) + within * np.abs(w).sum())

        fits[name] = L.newton_fit(rows, FEATURES, "y", "logistic", L.shrink_groups(GROUPS, within)(0.002), penalty)[0]
    return table(t, fits, FEATURES)


@query("l11_shared_support")
def _(t):
    """Classes and tasks that share their features: least squares and logistic, as a penalty and in a ball."""
    rows = returned(t)
    prox, penalty = L.rows_together(0.002, 3)
    fits = {
        "classes_logistic": L.newton_fit(rows, FEATURES, "flag", "logistic", prox, penalty, mode="class", blocks=3)[0],
        "classes_least": L.newton_fit(rows, FEATURES, "flag", "l2", prox, penalty, mode="class", blocks=3)[0],
        "tasks_least": L.newton_fit(rows, FEATURES, "price", "l2", prox, penalty, mode="task", blocks=3)[0],
        "tasks_logistic": L.newton_fit(rows, FEATURES, "dear", "logistic", prox, penalty, mode="task", blocks=3)[0],
        "classes_logistic_ball": L.newton_fit(rows, FEATURES, "flag", "logistic", L.rows_ball(0.01, 3), mode="class", blocks=3)[0],
        "tasks_least_ball": L.newton_fit(rows, FEATURES, "price", "l2", L.rows_ball(0.5, 3), mode="task", blocks=3)[0],
    }
    return table(t, fits, FEATURES)


@query("l12_fused_logistic")
def _(t):
    def penalty(w):
        return 0.001 * np.abs(w).sum() + 0.002 * np.abs(np.diff(w)).sum()

    return table(t, {"fused": L.newton_fit(returned(t), FEATURES, "y", "logistic", L.fused(0.001, 0.002), penalty)[0]}, FEATURES)


@query("l13_logistic_path")
def _(t):
    return table(t, {f"lambda={lam}": w for lam, w in L.newton_path(returned(t), FEATURES, "y", "logistic", [0.02, 0.005, 0.002, 0.0005])}, FEATURES)


@query("l14_nonconvex_classifiers")
def _(t):
    """Capped, log, SCAD and MCP penalties on logistic loss and on squared hinge."""
    rows = returned(t)
    kinds = [(loss, kind) for loss in ("logistic", "hinge2") for kind in ("capped", "log", "scad", "mcp")]
    return table(t, {f"{loss}_{kind}": L.newton_fit(rows, FEATURES, "y", loss, L.nonconvex(kind, 0.002, 3.0), L.nonconvex_penalty(kind, 0.002, 3.0))[0] for loss, kind in kinds}, FEATURES)


@query("l7_svm_dual")
def _(t):
    """Dual coordinate ascent with every loss, label 0 against the rest: weights by feature, and the gap that the fit ended with."""
    rows = materialize(t.embeddings.select(F.col("embedding").alias("x"), F.when(F.col("label") == 0, 1.0).otherwise(-1.0).alias("y")), "rows")
    fits = {loss: S.dual_fit(rows, "x", "y", loss, lam=0.01, epsilon=1e-4) for loss in S.STEPS}
    out = [(m, f"x{i}", round(float(v), 3)) for m, fit in fits.items() for i, v in enumerate([*fit.weights, fit.bias])]
    out += [(m, "gap_below", float(fit.gap <= 1e-4)) for m, fit in fits.items()]
    return t.spark.createDataFrame(out, "model string, name string, value double")  # a row a weight


@query("l7_svm_gap", "SELECT loss, true AS holds FROM (VALUES ('hinge'), ('hinge2'), ('l1'), ('l2'), ('logistic')) v(loss) WHERE (SELECT count(*) FROM embeddings) > 0")
def _(t):
    """Whether the primal fit with a free bias is as good as the dual bound allows: at most the dual fit's objective, and at
    least its bound less what that bias would cost there (hinge and l1 are rounded off over 0.01)."""
    n = t.embeddings.agg(F.max(F.size("embedding"))).first()[0]
    rows = materialize(t.embeddings.select("embedding", *(F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(n)), F.when(F.col("label") == 0, 1.0).otherwise(-1.0).alias("y")), "rows")
    out = []
    for loss in S.STEPS:
        fit = S.dual_fit(rows, "embedding", "y", loss, lam=0.1, bias_multiplier=3.0, epsilon=1e-3)
        w, history = L.newton_fit(rows, [f"x{i}" for i in range(n)], "y", loss, ridge=0.1)
        primal, bound, _ = fit.history[-1]
        out.append((loss, bool(bound - 0.05 * (w[0, -1] / 3.0) ** 2 - 0.005 <= history[-1] <= primal + 1e-6)))
    return t.spark.createDataFrame(out, "loss string, holds boolean")  # a row a loss
