"""Designs of survival models as tables: parameter index, design rows, real
parameters (survey 2.11).

A design row is the array of a parameter's values in all columns of its
model, Phi columns first; levels are read from the data. The tables have at
most models x groups x K**2 rows per dataset, whatever the number of animals,
and are made by array expressions in the cluster.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from smolt.operators.histories import first_last_occ
from smolt.operators.survival import TERMS, Z95, design_data


def model_name(phi: str, p: str) -> str:
    return f"Phi(~{phi})p(~{p})"


def group_levels(freq: DataFrame, group: str, extra: Sequence[str] = ()) -> DataFrame:
    """(extra..., levels): the sorted group levels of every dataset."""
    return freq.groupBy(*extra).agg(F.array_sort(F.collect_set(F.col(group).cast("string"))).alias("levels"))


def _terms(kind: str, own: bool, group: Column, occ: Column, levels: Column, k: int, first: int) -> tuple[Column, Column]:
    """Values and names of a kind's columns on a row; zeros if the row is not
    one of its parameter (``own``). ``first`` is the parameter's first occasion."""
    if kind not in TERMS:
        raise ValueError(f"unknown formula kind {kind!r}")
    intercept, factor = TERMS[kind]
    skip = 1 if intercept else 0
    if factor == "group":
        values = F.slice(levels, 1 + skip, F.greatest(F.size(levels) - skip, F.lit(0)))
        hit, names = (lambda v: group == v), F.transform(values, lambda v: F.concat(F.lit("group"), v))
    elif factor == "time":
        values = F.array(*[F.lit(t) for t in range(first + skip, first + k - 1)]).cast("array<int>")
        hit, names = (lambda v: occ == v), F.transform(values, lambda v: F.concat(F.lit("time"), v.cast("string")))
    else:
        values = F.array().cast("array<int>")
        hit, names = (lambda v: F.lit(False)), F.array().cast("array<string>")
    x = F.transform(values, lambda v: F.when(F.lit(own) & hit(v), 1.0).otherwise(0.0))
    if intercept:
        x, names = F.concat(F.array(F.lit(float(own))), x), F.concat(F.array(F.lit("(Intercept)")), names)
    return x, names


def _prefixed(names: Column, prefix: str) -> Column:
    return F.transform(names, lambda n: F.concat(F.lit(prefix), n))


def design_table(freq: DataFrame, group: str, k: int, models: Sequence[tuple[str, str]], extra: Sequence[str] = ()) -> DataFrame:
    """(extra..., model, param, group, occasion, x, labels): a design row for
    each parameter, group and occasion of every (Phi kind, p kind) model."""
    base = group_levels(freq, group, extra)
    base = base.select(*extra, "levels", F.explode("levels").alias(group))
    out = None
    for phi, p in models:
        for param, first in (("Phi", 1), ("p", 2)):
            rows = base.select("*", F.explode(F.sequence(F.lit(first), F.lit(first + k - 2))).alias("occasion"))
            parts = [_terms(kind, param == name, F.col(group), F.col("occasion"), F.col("levels"), k, at)
                     for kind, name, at in ((phi, "Phi", 1), (p, "p", 2))]
            labels = F.concat(*[_prefixed(names, name) for (_, names), name in zip(parts, ("Phi:", "p:"))])
            rows = rows.select(*extra, F.lit(model_name(phi, p)).alias("model"), F.lit(param).alias("param"), group, "occasion",
                               F.concat(parts[0][0], parts[1][0]).alias("x"), labels.alias("labels"))
            out = rows if out is None else out.unionByName(rows)
    return out


def design_long(table: DataFrame) -> DataFrame:
    """One row for each design row and column: ..., beta (its label), x."""
    keep = [c for c in table.columns if c not in ("x", "labels")]
    return table.select(*keep, F.explode(F.arrays_zip("labels", "x")).alias("c")).select(*keep, F.col("c.labels").alias("beta"), F.col("c.x").alias("x"))


def parameter_index(freq: DataFrame, group: str, k: int, models: Sequence[tuple[str, str]], extra: Sequence[str] = ()) -> DataFrame:
    """Index matrices: (extra..., model, param, group, cohort, occasion, age,
    different, simple).

    ``different`` numbers the cells of the triangular matrices, parameter by
    parameter, group by group, cohort by cohort. ``simple`` gives cells of
    equal design one number, densely, in the order of their first cell. The
    numbers of a dataset's designs (at most 2 x groups x K) are places in one
    sorted array, so no window numbers the cells.
    """
    extra = list(extra)
    levels = group_levels(freq, group, extra)
    cells = design_data(freq, group, k, extra).withColumn(group, F.col(group).cast("string"))
    cells = cells.join(levels, extra) if extra else cells.crossJoin(levels)  # one row of levels
    triangle = k * (k - 1) // 2
    c, at = F.col("cohort"), F.array_position("levels", F.col(group)) - 1
    start = (c - 1) * k - (c * (c - 1) / 2).cast("int")
    step = F.col("occasion") - c + F.when(F.col("param") == "Phi", 1).otherwise(0)
    block = F.when(F.col("param") == "Phi", 0).otherwise(F.size("levels")) + at
    cells = cells.withColumn("different", (block * triangle + start + step).cast("int")).drop("levels")
    rows = cells.join(design_table(freq, group, k, models, extra).drop("labels"), [*extra, "param", group, "occasion"])
    first = rows.groupBy(*extra, "model", "x").agg(F.min("different").alias("first"))
    order = first.groupBy(*extra, "model").agg(F.array_sort(F.collect_list("first")).alias("order"))
    number = first.join(order, [*extra, "model"]).select(*extra, "model", "x", F.array_position("order", F.col("first")).cast("int").alias("simple"))
    return rows.join(number, [*extra, "model", "x"]).select(
        *extra, "model", "param", group, "cohort", "occasion", "age", "different", "simple")


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def real_parameters(fits: DataFrame, design: DataFrame, by: Sequence[str] = ("dataset", "model")) -> DataFrame:
    """``design`` rows with estimate, se, lcl and ucl on the real scale.

    ``fits`` has a row for each beta: by..., beta_index, estimate, vcov (its
    row of the covariance matrix). The standard error is by the delta method,
    ``sqrt(g' V g)`` with ``g = real (1 - real) x``; the interval is the one
    of the logit, mapped. A design whose columns are not those of the fit is
    an error.
    """
    by = list(by)
    rows = F.array_sort(F.collect_list(F.struct("beta_index", "estimate", "vcov")))
    f = fits.groupBy(*by).agg(rows.alias("b")).select(
        *by, F.transform("b", lambda r: r["estimate"]).alias("beta"), F.transform("b", lambda r: r["vcov"]).alias("v"))
    j = design.join(f, by).withColumn("eta", F.when(F.size("x") == F.size("beta"), dot(F.col("x"), F.col("beta"))).otherwise(
        F.raise_error(F.lit("a design and its fit have different columns")).cast("double")))
    j = j.withColumn("logit_se", F.sqrt(F.greatest(dot(F.col("x"), F.transform("v", lambda r: dot(r, F.col("x")))), F.lit(0.0))))
    il = lambda c: 1 / (1 + F.exp(-c))
    eta, se, real = F.col("eta"), F.col("logit_se"), il(F.col("eta"))
    keep = [c for c in design.columns if c not in ("x", "labels")]
    return j.select(*keep, real.alias("estimate"), (real * (1 - real) * se).alias("se"), il(eta - Z95 * se).alias("lcl"), il(eta + Z95 * se).alias("ucl"))


def return_rates(freq: DataFrame, group: str, k: int, extra: Sequence[str]) -> DataFrame:
    """Fits in closed form, as ``real_parameters`` takes them: the share of
    each group's animals that are seen again after their first capture
    (Phi, one beta per group, treatment coding) and the share of occasions
    between first and last capture with a capture (p, one beta). Both are
    saturated logistic models with half an animal added to either side, so
    betas and covariances are expressions of the counts."""
    extra = list(extra)
    first, last = first_last_occ(F.col("ch"), k)
    f = freq.withColumns({"__f": first, "__l": last, group: F.col(group).cast("string")})
    inside = F.greatest(F.col("__l") - F.col("__f") - 1, F.lit(0))
    seen = F.length(F.regexp_replace("ch", "0", "")) - F.when(F.col("__l") > F.col("__f"), 2).otherwise(1)
    count = lambda c: F.sum(F.col("n") * c).cast("double")
    g = f.groupBy(*extra, group).agg(count(F.when(F.col("__f") < k, 1).otherwise(0)).alias("of"), count(F.when(F.col("__l") > F.col("__f"), 1).otherwise(0)).alias("hit"),
                                     count(inside).alias("gaps"), count(seen).alias("caught"))
    logit = lambda hit, of: F.log((hit + 0.5) / (of - hit + 0.5))
    spread = lambda hit, of: 1 / (hit + 0.5) + 1 / (of - hit + 0.5)
    cells = F.array_sort(F.collect_list(F.struct(F.col(group).alias("name"), logit(F.col("hit"), F.col("of")).alias("b"), spread(F.col("hit"), F.col("of")).alias("v"))))
    a = g.groupBy(*extra).agg(cells.alias("c"), logit(F.sum("caught"), F.sum("gaps")).alias("pb"), spread(F.sum("caught"), F.sum("gaps")).alias("pv"))
    c, n = F.col("c"), F.size("c")
    base = c[0]
    phi = F.transform(c, lambda x, i: F.struct(
        (i + 1).alias("beta_index"), F.lit("Phi").alias("param"),
        F.when(i == 0, "Phi:(Intercept)").otherwise(F.concat(F.lit("Phi:group"), x["name"])).alias("label"),
        F.when(i == 0, x["b"]).otherwise(x["b"] - base["b"]).alias("estimate"),
        F.concat(F.transform(c, lambda y, j: F.when((i == 0) != (j == 0), -base["v"]).otherwise(base["v"]) + F.when((i == j) & (i > 0), x["v"]).otherwise(0.0)),
                 F.array(F.lit(0.0))).alias("vcov")))
    p = F.struct((n + 1).alias("beta_index"), F.lit("p").alias("param"), F.lit("p:(Intercept)").alias("label"), F.col("pb").alias("estimate"),
                 F.concat(F.array_repeat(F.lit(0.0), n), F.array("pv")).alias("vcov"))
    return a.select(*extra, F.lit(model_name("group", "dot")).alias("model"), F.explode(F.concat(phi, F.array(p))).alias("r")).select(*extra, "model", "r.*")
