"""Encounter histories and CJS survival models (survey 2.11).

Binding: ``orders`` -> histories. Tag = customer, occasion = order year
1995..2001 (K = 7), group = market segment, dataset = region of the
customer's nation (five datasets fitted in parallel).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from smolt.operators import designs as D
from smolt.operators import histories as H
from smolt.operators import scores as C
from smolt.operators import survival as S
from smolt.plans.common import rounded
from smolt.plans.registry import query
from smolt.plans.sqlparts import OCC
from smolt.session import reuse_small
from smolt.sources import tables as T

K = len(T.OCCASIONS)
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
MODELS = [("dot", "dot"), ("group", "dot"), ("time", "dot"),
          ("dot", "time"), ("group", "time"), ("time", "time")]
HIST_SQL = (f"SELECT tag, grp, " + " || ".join(
    f"CAST(max(CASE WHEN occ = {i} THEN 1 ELSE 0 END) AS VARCHAR)" for i in range(K))
    + f" AS ch FROM ({OCC}) WHERE occ BETWEEN 0 AND {K - 1} GROUP BY tag, grp")
HIST2_SQL = (f"SELECT tag, grp, " + " || ".join(
    f"CAST(max(CASE WHEN occ = {i} THEN 1 ELSE 0 END) AS VARCHAR)" for i in range(K))
    + f" AS ch FROM (SELECT tag, grp, occ FROM ({OCC}) WHERE occ BETWEEN 0 AND {K - 1} "
      f"GROUP BY tag, grp, occ HAVING count(*) >= 2) GROUP BY tag, grp")
FREQ_SQL = f"SELECT ch, grp, CAST(count(*) AS BIGINT) AS n FROM ({HIST_SQL}) GROUP BY ch, grp"
DS_SQL = ("SELECT c.c_custkey AS tag, CAST(n.n_regionkey AS VARCHAR) AS dataset "
          "FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey")
FREQ_DS_SQL = (f"SELECT d.dataset, h.ch, h.grp, CAST(count(*) AS BIGINT) AS n FROM ({HIST_SQL}) h "
               f"JOIN ({DS_SQL}) d ON h.tag = d.tag GROUP BY d.dataset, h.ch, h.grp")


def histories(spark, d, min_count=1):
    return H.encounter_history(T.occasions_table(spark, d), "tag", "grp", "occ", K, min_count)


def frequencies(spark, d):
    return H.history_frequency(histories(spark, d), "grp")


def dataset_frequencies(spark, d):
    """(dataset, ch, grp, n): histories split by region."""
    c = T.table(spark, d, "customer").select(F.col("c_custkey").alias("tag"), "c_nationkey")
    n = T.table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"),
                                           F.col("n_regionkey").cast("string").alias("dataset"))
    ds = c.join(n, "c_nationkey").select("tag", "dataset")
    h = histories(spark, d).join(ds, "tag")
    return H.history_frequency(h, "grp", ["dataset"])


@query("encounter_history", HIST_SQL)
def encounter_history(spark, d):
    return histories(spark, d)


@query("encounter_history_min_n", HIST2_SQL)
def encounter_history_min_n(spark, d):
    return histories(spark, d, min_count=2)


@query("history_frequency", FREQ_SQL)
def history_frequency(spark, d):
    return frequencies(spark, d)


@query("history_wide_groups", f"""
SELECT ch, {', '.join(f"CAST(sum(CASE WHEN grp = '{s}' THEN n ELSE 0 END) AS BIGINT) AS n_{s}" for s in SEGMENTS)}
FROM ({FREQ_SQL}) GROUP BY ch""")
def history_wide_groups(spark, d):
    return H.history_wide(frequencies(spark, d), "grp", SEGMENTS)


@query("m_array", f"""
WITH p AS (SELECT f.ch, f.grp, f.n, CAST(i AS INTEGER) AS i FROM ({FREQ_SQL}) f, range(1, {K}) r(i)
           WHERE substr(f.ch, CAST(i AS INTEGER), 1) = '1')
SELECT grp, i AS release_occ,
       CAST(CASE WHEN instr(substr(ch, i + 1), '1') = 0 THEN NULL ELSE i + instr(substr(ch, i + 1), '1') END AS INTEGER) AS recapture_occ,
       CAST(sum(n) AS BIGINT) AS n FROM p GROUP BY 1, 2, 3""")
def m_array(spark, d):
    return H.m_array(frequencies(spark, d), "grp", K)


@query("effective_sample_size", f"""
SELECT CAST(sum(n * length(replace(substr(ch, 1, {K - 1}), '0', ''))) AS BIGINT) AS ess FROM ({FREQ_SQL})""")
def effective_sample_size(spark, d):
    return H.effective_sample_size(frequencies(spark, d), K)


@query("saturated_lnl", f"""
WITH f AS (SELECT *, instr(ch, '1') AS fo FROM ({FREQ_SQL})),
t AS (SELECT grp, fo, sum(n) AS tot FROM f GROUP BY grp, fo)
SELECT round(-2 * sum(f.n * ln(f.n / t.tot)), 6) AS neg2lnl_sat FROM f JOIN t ON f.grp = t.grp AND f.fo = t.fo""")
def saturated_lnl(spark, d):
    return rounded(H.saturated_neg2lnl(frequencies(spark, d), "grp", K), ["neg2lnl_sat"])


@query("design_data", f"""
WITH g AS (SELECT DISTINCT grp FROM ({FREQ_SQL})),
c AS (SELECT grp, CAST(cohort AS INTEGER) AS cohort FROM g, range(1, {K}) r(cohort))
SELECT grp, cohort, 'Phi' AS param, CAST(o AS INTEGER) AS occasion, CAST(o - cohort AS INTEGER) AS age
FROM c, range(1, {K}) s(o) WHERE o >= cohort
UNION ALL
SELECT grp, cohort, 'p' AS param, CAST(o AS INTEGER) AS occasion, CAST(o - cohort AS INTEGER) AS age
FROM c, range(2, {K + 1}) s(o) WHERE o >= cohort + 1""")
def design_data(spark, d):
    return S.design_data(frequencies(spark, d), "grp", K)


_LEVELS = ", ".join(f"('{g}', {i})" for i, g in enumerate(SEGMENTS))


@query("design_matrix", f"""
WITH g AS (SELECT * FROM (VALUES {_LEVELS}) AS t(grp, gi) WHERE grp IN (SELECT grp FROM ({FREQ_SQL}))),
r AS (SELECT 'Phi' AS param, grp, gi, CAST(o AS INTEGER) AS occasion, 1 AS base FROM g, range(1, {K}) s(o)
      UNION ALL SELECT 'p', grp, gi, CAST(o AS INTEGER), 2 FROM g, range(2, {K + 1}) s(o)),
one AS (SELECT f AS formula, param, grp, occasion, param || ':(Intercept)' AS beta, 1.0 AS x
        FROM r, (VALUES ('dot'), ('group'), ('time')) AS k(f)),
grps AS (SELECT 'group' AS formula, param, r.grp, occasion, param || ':group' || v.grp AS beta,
                CASE WHEN r.gi = v.i THEN 1.0 ELSE 0.0 END AS x
         FROM r, (VALUES {_LEVELS}) AS v(grp, i) WHERE v.i > 0),
tms AS (SELECT 'time' AS formula, param, grp, occasion, param || ':time' || t AS beta,
               CASE WHEN occasion = t THEN 1.0 ELSE 0.0 END AS x
        FROM r, range(2, {K + 1}) s(t) WHERE t > base AND t < base + {K - 1})
SELECT formula, param, grp, occasion, beta, CAST(x AS DOUBLE) AS x
FROM (SELECT * FROM one UNION ALL SELECT * FROM grps UNION ALL SELECT * FROM tms)""")
def design_matrix(spark, d):
    """Design rows of the three formula kinds for the groups in the data."""
    return _design(frequencies(spark, d), S.KINDS)


def _design(freq, kinds):
    """Every kind for both parameters, a row for each of its columns."""
    long = D.design_long(D.design_table(freq, "grp", K, [(kind, kind) for kind in kinds]))
    formula = F.regexp_extract("model", r"p\(~(.*)\)$", 1)
    return long.where(F.col("beta").startswith(F.concat("param", F.lit(":")))).select(formula.alias("formula"), "param", "grp", "occasion", "beta", "x")


@query("design_cell_means", f"""
WITH g AS (SELECT DISTINCT grp FROM ({FREQ_SQL})),
r AS (SELECT 'Phi' AS param, grp, CAST(o AS INTEGER) AS occasion FROM g, range(1, {K}) s(o)
      UNION ALL SELECT 'p', grp, CAST(o AS INTEGER) FROM g, range(2, {K + 1}) s(o))
SELECT '-1+group' AS formula, param, r.grp, occasion, param || ':group' || g.grp AS beta, CASE WHEN r.grp = g.grp THEN 1.0 ELSE 0.0 END::DOUBLE AS x FROM r, g
UNION ALL
SELECT '-1+time', r.param, r.grp, r.occasion, r.param || ':time' || t.occasion, CASE WHEN r.occasion = t.occasion THEN 1.0 ELSE 0.0 END::DOUBLE
FROM r JOIN (SELECT DISTINCT param, occasion FROM r) t ON r.param = t.param""")
def design_cell_means(spark, d):
    """Cell-means coding: a column for every level, no intercept."""
    return _design(frequencies(spark, d), ("-1+group", "-1+time"))


INDEXED = [("dot", "dot"), ("group", "dot"), ("group", "group"), ("time", "time"), ("group", "-1+time"), ("-1+group", "-1+time")]
_INDEXED_SQL = ", ".join(f"('{D.model_name(a, b)}', '{a[-5:]}', '{b[-5:]}')" for a, b in INDEXED)


# cells numbered by a window; a design is named by the level of its factor (all kinds have full rank)
@query("parameter_index", f"""
WITH g AS (SELECT DISTINCT dataset, grp FROM ({FREQ_DS_SQL})),
c AS (SELECT dataset, grp, CAST(c AS INTEGER) AS cohort, param, q, CAST(o AS INTEGER) AS occasion
      FROM g, range(1, {K}) r(c), range(1, {K + 1}) s(o), (VALUES ('Phi', 0), ('p', 1)) AS t(param, q)
      WHERE o >= c + q AND o < {K} + q),
n AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY q, grp, cohort, occasion) AS different FROM c),
m AS (SELECT n.*, model, param || ' ' || CASE CASE q WHEN 0 THEN fphi ELSE fp END WHEN 'group' THEN grp WHEN '+time' THEN occasion::VARCHAR
        WHEN 'time' THEN occasion::VARCHAR ELSE '' END AS design FROM n, (VALUES {_INDEXED_SQL}) AS f(model, fphi, fp)),
s AS (SELECT *, min(different) OVER (PARTITION BY dataset, model, design) AS opened FROM m)
SELECT dataset, model, param, grp, cohort, occasion, CAST(occasion - cohort AS INTEGER) AS age, CAST(different AS INTEGER) AS different,
       CAST(dense_rank() OVER (PARTITION BY dataset, model ORDER BY opened) AS INTEGER) AS simple FROM s""")
def parameter_index(spark, d):
    """Triangular index matrices of every region: all different, and
    simplified to the distinct designs of six models."""
    return D.parameter_index(dataset_frequencies(spark, d), "grp", K, INDEXED, ["dataset"])


LL_BASE = (f"SELECT dataset, ch, grp, n, instr(ch, '1') AS f, {K} + 1 - instr(reverse(ch), '1') AS l FROM ({FREQ_DS_SQL})")


def _rate_sql(a, step, occ):
    """Inverse logit of a + step * occasion + 0.07 * (position of the group)."""
    return f"1 / (1 + exp(-({a!r} + {step!r} * {occ} + 0.07 * gi)))"


# parameters that differ by occasion and group, so an index shifted by one shows
PHI_A, PHI_STEP, P_A, P_STEP = 0.3131, 0.1717, 1.1919, -0.1313


def _loglik_cte():
    """CTEs up to ``ll``: ln P(history) at the parameters above, from the definition."""
    par = ", ".join([f"{_rate_sql(PHI_A, PHI_STEP, j)} AS phi{j}" for j in range(1, K)]
                    + [f"{_rate_sql(P_A, P_STEP, j)} AS p{j}" for j in range(2, K + 1)])
    chi = f"SELECT *, 1.0 AS chi{K} FROM par"
    for j in range(K - 1, 0, -1):
        chi = f"SELECT *, 1 - phi{j} + phi{j} * (1 - p{j + 1}) * chi{j + 1} AS chi{j} FROM ({chi})"
    live = " + ".join(f"CASE WHEN {j} >= f AND {j} < l THEN ln(phi{j}) ELSE 0 END" for j in range(1, K))
    seen = " + ".join(f"CASE WHEN {j} > f AND {j} <= l THEN CASE WHEN substr(ch, {j}, 1) = '1' THEN ln(p{j}) ELSE ln(1 - p{j}) END ELSE 0 END"
                      for j in range(2, K + 1))
    last = "CASE l " + " ".join(f"WHEN {j} THEN ln(chi{j})" for j in range(1, K + 1)) + " END"
    return (f"lv AS (SELECT * FROM (VALUES {_LEVELS}) AS t(grp, gi)), par AS (SELECT *, {par} FROM lv), pc AS ({chi})", f"{live} + {seen} + {last}")


LL_CTE, LL_EXPR = _loglik_cte()


def fixed_params(freq, extra=()):
    """The parameters above as arrays per (extra, group)."""
    pos = F.create_map(*[F.lit(x) for i, g in enumerate(SEGMENTS) for x in (g, i)])
    rate = lambda a, step: lambda j: 1 / (1 + F.exp(-(a + step * j + 0.07 * F.element_at(pos, F.col("grp")))))
    none = F.array(F.lit(None).cast("double"))
    return freq.select(*extra, "grp").distinct().select(
        *extra, "grp", F.transform(F.sequence(F.lit(1), F.lit(K - 1)), rate(PHI_A, PHI_STEP)).alias("phi"),
        F.concat(none, F.transform(F.sequence(F.lit(2), F.lit(K)), rate(P_A, P_STEP))).alias("p"))


@query("cjs_loglik", f"""
WITH {LL_CTE}, b AS ({LL_BASE})
SELECT grp, round(sum(n * ({LL_EXPR})), 6) AS loglik FROM b JOIN pc USING (grp) GROUP BY grp""")
def cjs_loglik(spark, d):
    f = frequencies(spark, d)
    return rounded(S.cjs_loglik(f, fixed_params(f), "grp", K), ["loglik"])


@query("cjs_expected", f"""
WITH {LL_CTE}, b AS (SELECT ch, grp, f, l, sum(n) AS n FROM ({LL_BASE}) GROUP BY ch, grp, f, l),
t AS (SELECT grp AS tg, f AS tf, sum(n) AS cohort_n FROM b GROUP BY grp, f)
SELECT b.grp, b.ch, CAST(b.n AS BIGINT) AS n, CAST(t.cohort_n AS BIGINT) AS cohort_n, round(t.cohort_n * exp({LL_EXPR}), 6) AS expected
FROM b JOIN pc USING (grp) JOIN t ON b.grp = t.tg AND b.f = t.tf""")
def cjs_expected(spark, d):
    f = frequencies(spark, d)
    out = S.cjs_expected(f, fixed_params(f), "grp", K).withColumn("cohort_n", F.col("cohort_n").cast("long"))
    return rounded(out, ["expected"])


@query("cjs_closed_form", f"""
WITH f AS ({FREQ_SQL}),
pos AS (SELECT f.ch, f.n, CAST(i AS INTEGER) AS i FROM f, range(1, {K}) r(i) WHERE substr(f.ch, CAST(i AS INTEGER), 1) = '1'),
ma AS (SELECT i, CASE WHEN instr(substr(ch, i + 1), '1') = 0 THEN NULL ELSE i + instr(substr(ch, i + 1), '1') END AS j, n FROM pos),
rel AS (SELECT i AS occ, sum(n) AS released, sum(CASE WHEN j IS NOT NULL THEN n END) AS recaptured FROM ma GROUP BY i),
rec AS (SELECT j AS occ, sum(n) AS marked FROM ma WHERE j IS NOT NULL GROUP BY j),
zz AS (SELECT CAST(j AS INTEGER) AS occ, sum(f.n) AS between FROM f, range(1, {K + 1}) r(j)
       WHERE j > instr(f.ch, '1') AND j < {K} + 1 - instr(reverse(f.ch), '1') AND substr(f.ch, CAST(j AS INTEGER), 1) = '0' GROUP BY 1),
base AS (SELECT CAST(o AS INTEGER) AS occ FROM range(1, {K}) r(o)),
t AS (SELECT b.occ, coalesce(released, 0) AS released, coalesce(recaptured, 0) AS recaptured,
             coalesce(marked, 0) AS marked, coalesce(between, 0) AS between
      FROM base b LEFT JOIN rel USING (occ) LEFT JOIN rec USING (occ) LEFT JOIN zz USING (occ)),
u AS (SELECT *, marked + released * between / NULLIF(recaptured, 0) AS marked_pop FROM t)
SELECT occ, CAST(released AS BIGINT) AS released, CAST(recaptured AS BIGINT) AS recaptured,
       CAST(marked AS BIGINT) AS marked, CAST(between AS BIGINT) AS between, round(marked_pop, 6) AS marked_pop,
       round(CASE WHEN occ < {K - 1} THEN LEAD(marked_pop) OVER (ORDER BY occ) / NULLIF(marked_pop - marked + released, 0) END, 6) AS phi,
       round(CASE WHEN occ >= 2 THEN marked / NULLIF(marked_pop, 0) END, 6) AS p,
       round(CASE WHEN occ = {K - 1} THEN recaptured / NULLIF(released, 0) END, 6) AS last_product
FROM u""")
def cjs_closed_form(spark, d):
    t = H.closed_form_time(frequencies(spark, d), K)
    return rounded(t, ["marked_pop", "phi", "p", "last_product"])


def _fits(spark, d, models):
    return S.fit_models(dataset_frequencies(spark, d), "grp", SEGMENTS, K, models)


@query("cjs_fit")
def cjs_fit(spark, d):
    """Phi(~group)p(~1) per region, fitted in parallel (rows-only check)."""
    return _fits(spark, d, [("group", "dot")])


@query("model_grid")
def model_grid(spark, d):
    """Every Phi x p formula combination for every region."""
    return _fits(spark, d, MODELS)


RANKED = [("m1", 2, 1.0), ("m2", 5, 0.97), ("m3", 9, 0.95)]  # name, parameters, share of -2 ln L
_RANKED_SQL = ", ".join(f"('{m}', {k}, {x!r})" for m, k, x in RANKED)


@query("model_rank_fixed", f"""
WITH {LL_CTE}, b AS ({LL_BASE}),
x AS (SELECT dataset, -2 * sum(n * ({LL_EXPR})) AS dev, CAST(sum(n * length(replace(substr(ch, 1, {K - 1}), '0', ''))) AS BIGINT) AS ess
      FROM b JOIN pc USING (grp) GROUP BY dataset),
m AS (SELECT dataset, model, dev * share AS neg2lnl, CAST(k AS INTEGER) AS k, ess FROM x, (VALUES {_RANKED_SQL}) AS r(model, k, share)),
c AS (SELECT *, neg2lnl + 2 * k AS aic, neg2lnl + 2 * k + 2 * k * (k + 1) / CAST(NULLIF(ess - k - 1, 0) AS DOUBLE) AS aicc,
             neg2lnl + k * ln(ess) AS bic FROM m),
e AS (SELECT *, aicc - min(aicc) OVER (PARTITION BY dataset) AS delta_aicc FROM c)
SELECT dataset, model, round(neg2lnl, 6) AS neg2lnl, k, ess, round(aic, 6) AS aic, round(aicc, 6) AS aicc, round(bic, 6) AS bic,
       round(delta_aicc, 6) AS delta_aicc,
       round(exp(-delta_aicc / 2) / sum(exp(-delta_aicc / 2)) OVER (PARTITION BY dataset), 6) AS weight FROM e""")
def model_rank_fixed(spark, d):
    """Ranking of three models per region, on deviances at fixed parameters."""
    freq = dataset_frequencies(spark, d)
    dev = S.cjs_loglik(freq, fixed_params(freq, ["dataset"]), "grp", K, ["dataset"]).groupBy("dataset").agg((-2 * F.sum("loglik")).alias("dev"))
    spec = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(k).alias("k"), F.lit(x).alias("share")) for m, k, x in RANKED]))
    fits = dev.select("dataset", "dev", spec.alias("s")).select(
        "dataset", "s.model", (F.col("dev") * F.col("s.share")).alias("neg2lnl"), "s.k")
    t = S.model_table(fits, H.effective_sample_size(freq, K, ["dataset"]))
    return rounded(t, ["neg2lnl", "aic", "aicc", "bic", "delta_aicc", "weight"])


@query("model_rank")
def model_rank(spark, d):
    """Ranking of the six fitted models of every region."""
    # the bounded frequency table feeds the fits and the sample sizes
    freq = reuse_small(dataset_frequencies(spark, d))
    fits = S.fit_models(freq, "grp", SEGMENTS, K, MODELS)
    return S.model_table(fits, H.effective_sample_size(freq, K, ["dataset"]))


@query("real_estimates_fixed", f"""
WITH r AS (SELECT DISTINCT dataset FROM ({FREQ_DS_SQL})),
b AS (SELECT * FROM (VALUES (1, 'Phi:(Intercept)', 0.9, 0.11), (2, 'Phi:groupX', -1.7, 0.45), (3, 'p:(Intercept)', 2.3, 0.08)) AS t(i, label, b, se))
SELECT dataset, 'Phi(~group)p(~dot)' AS model, split_part(label, ':', 1) AS param, CAST(i AS INTEGER) AS beta_index, label,
       CAST(b AS DOUBLE) AS estimate, CAST(se AS DOUBLE) AS se, round(1 / (1 + exp(-b)), 6) AS real,
       round(1 / (1 + exp(-(b - {S.Z95} * se))), 6) AS real_lcl, round(1 / (1 + exp(-(b + {S.Z95} * se))), 6) AS real_ucl
FROM r, b""")
def real_estimates_fixed(spark, d):
    """Betas through the inverse logit, at fixed betas for every region."""
    beta = [(1, "Phi:(Intercept)", 0.9, 0.11), (2, "Phi:groupX", -1.7, 0.45), (3, "p:(Intercept)", 2.3, 0.08)]
    spec = F.explode(F.array(*[F.struct(F.lit(i).alias("beta_index"), F.lit(n).alias("label"), F.lit(b).alias("estimate"),
                                        F.lit(e).alias("se")) for i, n, b, e in beta]))
    fits = (dataset_frequencies(spark, d).select("dataset").distinct().select("dataset", F.lit("Phi(~group)p(~dot)").alias("model"), spec.alias("s"))
            .select("dataset", "model", F.split("s.label", ":")[0].alias("param"), "s.*"))
    fits = fits.withColumns({"lcl": F.col("estimate") - S.Z95 * F.col("se"), "ucl": F.col("estimate") + S.Z95 * F.col("se")})
    return rounded(S.real_estimates(fits), ["real", "real_lcl", "real_ucl"])


@query("real_estimates")
def real_estimates(spark, d):
    """Real-scale estimates of the fitted Phi(~group)p(~1) per region."""
    return S.real_estimates(_fits(spark, d, [("group", "dot")]))


# independent of the operator and its fits: every possible history of every cohort is listed
@query("gof_stats_fixed", f"""
WITH {LL_CTE}, b AS ({LL_BASE}),
coh AS (SELECT dataset, grp, f, sum(n) AS N FROM b GROUP BY dataset, grp, f),
poss AS (SELECT dataset, grp, f, N, repeat('0', CAST(f AS INTEGER) - 1) || '1'
                || CASE WHEN f = {K} THEN '' ELSE lpad(bin(t), {K} - CAST(f AS INTEGER), '0') END AS ch
         FROM coh, range(0, {2 ** (K - 1)}) r(t) WHERE t < pow(2, {K} - f)),
pl AS (SELECT *, {K} + 1 - instr(reverse(ch), '1') AS l FROM poss),
cell AS (SELECT pl.dataset, pl.grp, pl.f, pl.N, pl.ch, pl.N * exp({LL_EXPR}) AS E FROM pl JOIN pc USING (grp)),
o AS (SELECT c.*, coalesce(b.n, 0) AS O FROM cell c LEFT JOIN b ON b.dataset = c.dataset AND b.grp = c.grp AND b.ch = c.ch),
a AS (SELECT dataset, -2 * sum(CASE WHEN O > 0 THEN O * ln(E / N) ELSE 0 END) AS neg2lnl, CAST(count(*) AS DOUBLE) AS possible,
             sum(CASE WHEN O > 0 THEN 1 ELSE 0 END) AS cells, sum((O - E) ** 2 / E) AS pearson, sum(O / E) AS ratio,
             -2 * sum(CASE WHEN O > 0 THEN O * ln(O / N) ELSE 0 END) AS sat FROM o GROUP BY dataset),
k AS (SELECT a.*, q.cohorts, neg2lnl - sat AS dev, cells - q.cohorts - 12 AS ddf, possible - q.cohorts - 12 AS pdf,
             (ratio - possible) / (possible - q.cohorts) AS sbar
      FROM a JOIN (SELECT dataset, count(*) AS cohorts FROM coh GROUP BY dataset) q USING (dataset))
SELECT dataset, round(neg2lnl, 6) AS neg2lnl, round(dev, 6) AS deviance, CAST(ddf AS BIGINT) AS deviance_df, round(dev / NULLIF(ddf, 0), 6) AS c_hat,
       round(pearson, 5) AS pearson_chisq, possible, pdf AS pearson_df, round(pearson / pdf, 6) AS pearson_chat, round(sbar, 6) AS s_bar,
       round(pearson / pdf / (1 + sbar), 6) AS fletcher_chat FROM k""")
def gof_stats_fixed(spark, d):
    """Goodness of fit per region at fixed parameters that differ by
    occasion and group (12 counted as estimated)."""
    freq = reuse_small(dataset_frequencies(spark, d))
    kk = freq.select("dataset").distinct().withColumn("k", F.lit(12))
    g = S.gof_stats(freq, fixed_params(freq, ["dataset"]), "grp", K, kk, ["dataset"])
    return rounded(rounded(g, ["neg2lnl", "deviance", "c_hat", "pearson_chat", "s_bar", "fletcher_chat"]).withColumn(
        "pearson_chisq", F.round("pearson_chisq", 5)), [])


@query("gof_stats")
def gof_stats(spark, d):
    """Goodness of fit of the fitted Phi(~1)p(~1) per region."""
    freq = reuse_small(dataset_frequencies(spark, d))
    fits = reuse_small(S.fit_models(freq, "grp", SEGMENTS, K, [("dot", "dot")]))
    kk = fits.groupBy("dataset").agg(F.first("k").alias("k"))
    return S.gof_stats(freq, S.fitted_params(fits, K).drop("model"), "grp", K, kk, ["dataset"])


def _score_sql():
    """One SELECT per parameter: the derivative of ln P(history) in the
    parameter, history by history, times the logit's derivative."""
    out = []
    for m in range(1, K):
        tail = "CASE l " + " ".join(
            f"WHEN {j} THEN {' * '.join(['1.0'] + [f'phi{q} * (1 - p{q + 1})' for q in range(j, m)])} / chi{j}" for j in range(1, m + 1)) + " ELSE 0 END"
        live = f"CASE WHEN {m} >= f AND {m} < l THEN 1 / phi{m} ELSE 0 END + {tail} * (chi{m + 1} * (1 - p{m + 1}) - 1)"
        seen = (f"CASE WHEN {m + 1} > f AND {m + 1} <= l THEN CASE WHEN substr(ch, {m + 1}, 1) = '1' THEN 1 / p{m + 1} ELSE -1 / (1 - p{m + 1}) END "
                f"ELSE 0 END - {tail} * phi{m} * chi{m + 1}")
        for param, occ, x, body in (("Phi", m, f"phi{m}", live), ("p", m + 1, f"p{m + 1}", seen)):
            out.append(f"SELECT dataset, grp, '{param}' AS param, {occ} AS occasion, round(sum(n * {x} * (1 - {x}) * ({body})), 6) AS score "
                       "FROM b JOIN pc USING (grp) GROUP BY dataset, grp")
    return " UNION ALL ".join(out)


@query("cjs_score", f"WITH {LL_CTE}, b AS ({LL_BASE}) {_score_sql()}")
def cjs_score(spark, d):
    """Derivative of the log-likelihood in the logit of every parameter of
    every region and group, at the parameters of ``cjs_loglik``."""
    freq = reuse_small(dataset_frequencies(spark, d))
    return rounded(C.cjs_score(freq, fixed_params(freq, ["dataset"]), "grp", K, ["dataset"]), ["score"])


@query("cjs_fit_score")
def cjs_fit_score(spark, d):
    """Score and observed information at the fitted betas of every region and
    model: the check of a fit without the fitter."""
    freq = reuse_small(dataset_frequencies(spark, d))
    fits = reuse_small(S.fit_models(freq, "grp", SEGMENTS, K, MODELS))
    return C.fitted_score(freq, fits, D.design_table(freq, "grp", K, MODELS, ["dataset"]), "grp", K)


@query("real_parameters", f"""
WITH h AS ({LL_BASE}),
g AS (SELECT dataset, grp, sum(CASE WHEN f < {K} THEN n ELSE 0 END) + 1 AS of, sum(CASE WHEN l > f THEN n ELSE 0 END) + 0.5 AS hit,
             sum(n * greatest(l - f - 1, 0)) AS gaps, sum(n * length(replace(substr(ch, f + 1, greatest(l - f - 1, 0)), '0', ''))) AS caught FROM h GROUP BY dataset, grp),
q AS (SELECT dataset, sum(gaps) + 1 AS of, sum(caught) + 0.5 AS hit FROM g GROUP BY dataset),
r AS (SELECT dataset, 'Phi' AS param, grp, CAST(o AS INTEGER) AS occasion, hit::DOUBLE / of AS e, of::DOUBLE AS of FROM g, range(1, {K}) s(o)
      UNION ALL SELECT dataset, 'p', grp, CAST(o AS INTEGER), q.hit::DOUBLE / q.of, q.of::DOUBLE FROM g JOIN q USING (dataset), range(2, {K + 1}) s(o))
SELECT dataset, 'Phi(~group)p(~dot)' AS model, param, grp, occasion, round(e, 6) AS estimate, round(sqrt(e * (1 - e) / of), 6) AS se,
       round(1 / (1 + exp(-(ln(e / (1 - e)) - {S.Z95} / sqrt(of * e * (1 - e))))), 6) AS lcl,
       round(1 / (1 + exp(-(ln(e / (1 - e)) + {S.Z95} / sqrt(of * e * (1 - e))))), 6) AS ucl FROM r""")
def real_parameters(spark, d):
    """Real parameters with standard error and interval per region, group and
    occasion, from betas and covariances that the counts give in closed form;
    the SQL takes the binomial shares directly."""
    freq = reuse_small(dataset_frequencies(spark, d))
    fits = D.return_rates(freq, "grp", K, ["dataset"])
    out = D.real_parameters(fits, D.design_table(freq, "grp", K, [("group", "dot")], ["dataset"]))
    return rounded(out, ["estimate", "se", "lcl", "ucl"])


@query("real_parameters_fitted")
def real_parameters_fitted(spark, d):
    """Real parameters of the six fitted models of every region, with
    standard errors from the fits' covariances."""
    freq = reuse_small(dataset_frequencies(spark, d))
    fits = S.fit_models(freq, "grp", SEGMENTS, K, MODELS)
    return D.real_parameters(fits, D.design_table(freq, "grp", K, MODELS, ["dataset"]))
