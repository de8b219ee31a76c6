"""Queries on responses derived from the sample tables, each with SQL for an independent engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latentia.functions.special import normal_quadrature
from latentia.operators import adaptive, bias, classical, comparison, diagnosis, fit, graded, scoring, summaries
from latentia.sources import responses as src
from latentia.streaming import tracing

A1 = "r as (select l_orderkey as person_id, cast(l_linenumber as int) as item_id, max(case when l_quantity > 15 + 4*l_linenumber then 1 else 0 end) as resp from lineitem group by 1, 2)"
A2 = "g as (select l_orderkey as person_id, cast(l_linenumber as int) as item_id, cast(least(floor(min(l_quantity)/12.6), 3) as int) as resp from lineitem group by 1, 2)"
BANK = "bank as (select cast(i as int) as item_id, 0.6::double + 0.2::double*i as a, -1.5::double + 0.5::double*i as b from range(1, 8) t(i))"
#: Ability as a fixed function of the score, so that fit statistics do not hang on an estimate.
THETA = "theta as (select person_id, (sum(resp) - 1.0) / 1.5 as theta from r group by 1)"
SCORED = (
    A1 + ", " + BANK + ", " + THETA + ", s0 as (select person_id, item_id, resp, theta, least(greatest(1/(1+exp(-(a*(theta-b)))), 1e-10), 1-1e-10) as p from r join bank using (item_id) join theta using (person_id)), "
    "s as (select *, p*(1-p) as v, (resp-p)/sqrt(p*(1-p)) as z, case when resp = 1 then ln(p) else ln(1-p) end as ll from s0)"
)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in columns})


def theta_by_score(r: DataFrame) -> DataFrame:
    return r.groupBy("person_id").agg(((F.sum("resp") - 1.0) / 1.5).alias("theta"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    r = src.dichotomous(spark, d)
    return fit.scored(r, src.bank(spark), theta_by_score(r))


def _groups(r: DataFrame) -> DataFrame:
    return r.select("person_id", (F.col("person_id") % 2).cast("int").alias("g")).distinct()


def _strata(r: DataFrame) -> DataFrame:
    return r.groupBy("person_id").agg(F.sum("resp").cast("int").alias("s"))


def itemstats(spark, d):
    return rounded(classical.itemstats(src.graded(spark, d)), "mean", "sd", "skewness", "kurtosis")


def item_rest(spark, d):
    return rounded(classical.item_rest(src.dichotomous(spark, d)), "item_total", "item_rest", "difficulty")


def alpha(spark, d):
    return rounded(classical.alpha(src.dichotomous(spark, d)), "alpha")


def alpha_if_deleted(spark, d):
    return rounded(classical.alpha_if_deleted(src.dichotomous(spark, d)), "alpha_if_deleted")


def missing(spark, d):
    r = src.dichotomous(spark, d)
    n = r.select("person_id").distinct().count()
    return rounded(classical.missing(r, 7, n), "missing_rate")


def pairwise_counts(spark, d):
    return classical.pairwise_counts(src.dichotomous(spark, d))


def impute_values(spark, d):
    return classical.impute_values(src.graded(spark, d))


def patterns(spark, d):
    return classical.patterns(src.dichotomous(spark, d))


def dichotomise(spark, d):
    return classical.recode(src.graded(spark, d), 2).groupBy("item_id").agg(F.sum("resp").alias("n_right"), F.count(F.lit(1)).alias("n"))


def key_to_binary(spark, d):
    return classical.key_to_binary(src.graded(spark, d), {i: i % 4 for i in range(1, 8)}).groupBy("item_id").agg(F.sum("resp").alias("n_right"), F.count(F.lit(1)).alias("n"))


def reverse(spark, d):
    return classical.reverse(src.graded(spark, d), 3, [2, 4]).groupBy("item_id").agg(F.sum("resp").alias("total"))


def item_fit(spark, d):
    return rounded(fit.mean_squares(_scored(spark, d), "item_id"), "infit", "outfit")


def person_fit(spark, d):
    s = _scored(spark, d)
    return rounded(fit.mean_squares(s, "person_id").join(fit.zh(s).drop("n"), "person_id"), "infit", "outfit", "zh")


def residuals(spark, d):
    return rounded(fit.residual_summary(_scored(spark, d)), "mean_raw", "sd_standard", "max_abs")


def q3(spark, d):
    return rounded(fit.q3(_scored(spark, d)), "q3")


def ld_chi2(spark, d):
    return rounded(fit.ld_chi2(_scored(spark, d)), "chi2", "g2")


def binned_fit(spark, d):
    r = src.dichotomous(spark, d)
    return rounded(fit.binned_fit(r, src.bank(spark), theta_by_score(r)), "chi2", digits=5)


def eap(spark, d):
    return rounded(scoring.eap(src.dichotomous(spark, d), src.bank(spark)), "theta", "se")


def information(spark, d):
    return rounded(scoring.information_grid(src.bank(spark)), "theta", "information", "se")


def sum_scores(spark, d):
    return rounded(scoring.sum_scores(src.bank(spark)), "p", digits=9)


def mantel_haenszel(spark, d):
    r = src.dichotomous(spark, d)
    return rounded(bias.mantel_haenszel(r, _groups(r), _strata(r)), "chi2", "odds")


def sibtest(spark, d):
    r = src.dichotomous(spark, d)
    return rounded(bias.sibtest(r, _groups(r)), "beta")


def group_residuals(spark, d):
    s = _scored(spark, d)
    return rounded(bias.group_residuals(s, _groups(s)), "grdif_r", "max_msr")


def linking(spark, d):
    new = src.bank(spark).withColumn("b", F.col("b") * 1.25 - 0.3).withColumn("a", F.col("a") / 1.25)
    return rounded(bias.link_mean_sigma(src.bank(spark), new), "a_mean_sigma", "b_mean_sigma", "a_mean_mean", "b_mean_mean")


def drift(spark, d):
    new = src.bank(spark).withColumn("b", F.col("b") + F.col("item_id") * F.col("item_id") * 0.01)
    return rounded(bias.drift(src.bank(spark), new), "d", "z")


def next_item(spark, d):
    r = src.dichotomous(spark, d)
    s = r.groupBy("person_id").agg(((F.sum("resp") - 1.0) / 1.5).alias("theta"), F.collect_list("item_id").alias("used"))
    return rounded(adaptive.next_items(s, src.bank(spark)), "information")


def knowledge_tracing(spark, d):
    return rounded(tracing.trace(src.trials(spark, d)), "mastery")


def reliable_change(spark, d):
    r = src.dichotomous(spark, d)
    odd = F.col("item_id") % 2 == 1
    s = r.groupBy("person_id").agg(F.coalesce(F.sum(F.when(odd, F.col("resp"))), F.lit(0)).cast("double").alias("pre"), F.coalesce(F.sum(F.when(~odd, F.col("resp"))), F.lit(0)).cast("double").alias("post"))
    return rounded(classical.reliable_change(s, 0.8), "rci")


def null_models(spark, d):
    m = summaries.information_criteria(summaries.null_models(src.dichotomous(spark, d)))
    return rounded(m, "log_likelihood", "aic", "bic", "sabic", "aicc", "caic", "weight", digits=4)


def moment_fit(spark, d):
    return rounded(summaries.moment_fit(_scored(spark, d), 14), "statistic")


def empirical_reliability(spark, d):
    return rounded(summaries.empirical_reliability(scoring.eap(src.dichotomous(spark, d), src.bank(spark))), "reliability")


def marginal_reliability(spark, d):
    return rounded(summaries.marginal_reliability(src.bank(spark), scoring.quadrature(spark)), "reliability")


def rubin(spark, d):
    """The parts of the persons by remainder of five stand for imputations."""
    g = src.dichotomous(spark, d).groupBy("item_id", (F.col("person_id") % 5).alias("part")).agg(F.avg("resp").alias("q"), (F.var_samp("resp") / F.count("resp")).alias("u"))
    return rounded(summaries.rubin(g, "item_id"), "estimate", "within", "between", "total", "lambda", "fmi").drop("df")


def weight_efficiency(spark, d):
    w = src.dichotomous(spark, d).groupBy("person_id").agg((1.0 + F.count("resp")).alias("w"))
    return rounded(summaries.weight_efficiency(w), "ess", "deff")


def completeness(spark, d):
    return summaries.completeness(src.dichotomous(spark, d), 7)


def empirical_bins(spark, d):
    return rounded(summaries.empirical_bins(_scored(spark, d)), "observed", "expected")


def mastery(spark, d):
    """Three attributes; the bits of an item's number are those it needs."""
    return rounded(rounded(diagnosis.mastery_posterior(src.dichotomous(spark, d), {i: i for i in range(1, 8)}, 3, 0.1, 0.2), "posterior", "p0", "p1", "p2", digits=9), "posterior", "p0", "p1", "p2")


def area_between(spark, d):
    new = src.bank(spark).withColumn("b", F.col("b") + 0.2 * F.col("item_id") - 0.7).withColumn("a", F.col("a") * 1.1)
    return rounded(bias.area_between(src.bank(spark), new), "signed", "unsigned")


def crossing_sibtest(spark, d):
    r = src.dichotomous(spark, d)
    return rounded(bias.crossing_sibtest(r, _groups(r)), "beta_low", "beta_high", "beta_crossing")


def eap_by_sum(spark, d):
    return rounded(scoring.eap_by_sum(src.bank(spark)), "theta", "se")


def characteristic_curve(spark, d):
    return rounded(scoring.characteristic_curve(src.bank(spark)), "theta", "expected", "sd")


def _graded_bank(spark: SparkSession) -> DataFrame:
    return src.bank(spark).withColumn("steps", F.array(F.col("b") - 0.5, F.col("b"), F.col("b") + 0.5))


def partial_credit_fit(spark, d):
    r = src.graded(spark, d)
    theta = r.groupBy("person_id").agg((4.0 * F.sum("resp") / (3.0 * F.count("resp")) - 2.0).alias("theta"))
    return rounded(graded.partial_credit_fit(r, _graded_bank(spark), theta), "infit", "outfit")


def graded_eap(spark, d):
    return rounded(graded.graded_eap(src.graded(spark, d), _graded_bank(spark)), "theta", "se")


def adjacent(spark, d):
    return graded.adjacent(src.graded(spark, d), 3).groupBy("item_id", "step").agg(F.sum("resp").alias("n_right"), F.count(F.lit(1)).alias("n"))


def category_counts(spark, d):
    return graded.category_counts(src.graded(spark, d))


def vuong(spark, d):
    r = src.dichotomous(spark, d)
    flat = fit.scored(r, src.bank(spark).withColumn("a", F.lit(1.0)), theta_by_score(r))
    return rounded(comparison.vuong(_scored(spark, d), flat), "mean", "sd", "z")


def held_out_likelihood(spark, d):
    return rounded(comparison.held_out_likelihood(src.dichotomous(spark, d), 5), "log_likelihood", digits=4)


def calibration(spark, d):
    """Two-parameter calibration until the likelihood settles, with a column that says whether it did; rows only, as EM has no SQL form."""
    from latentia.operators.calibrate import fit_2pl

    fitted = fit_2pl(src.dichotomous(spark, d))
    return rounded(fitted.bank(spark), "a", "b", "se_a", "se_b", digits=4).withColumn("converged", F.lit(fitted.converged))


QUERIES = {f"irt_{f.__name__}": f for f in (itemstats, item_rest, alpha, alpha_if_deleted, missing, pairwise_counts, impute_values, patterns, dichotomise, key_to_binary, reverse, item_fit, person_fit, residuals, q3, ld_chi2, binned_fit, eap, information, sum_scores, mantel_haenszel, sibtest, group_residuals, linking, drift, next_item, knowledge_tracing, reliable_change, null_models, moment_fit, empirical_reliability, marginal_reliability, rubin, weight_efficiency, completeness, empirical_bins, mastery, area_between, crossing_sibtest, eap_by_sum, characteristic_curve, partial_credit_fit, graded_eap, adjacent, category_counts, vuong, held_out_likelihood, calibration)}

_x, _w = normal_quadrature(21)
QUAD = "quad(node, w) as (values " + ", ".join(f"({float(a)!r}::double, {float(b)!r}::double)" for a, b in zip(_x, _w, strict=True)) + ")"
P = "1/(1+exp(-(a*(node-b))))"
CORR = "case when n*sxx-sx*sx > 1e-12 and n*syy-sy*sy > 1e-12 then (n*sxy-sx*sy)/sqrt(greatest((n*sxx-sx*sx)*(n*syy-sy*sy), 1e-300)) else 0 end"


def _sums(x: str, y: str) -> str:
    return f"count(*)::double as n, sum({x})::double as sx, sum({y})::double as sy, sum({x}*{x})::double as sxx, sum({y}*{y})::double as syy, sum({x}*{y})::double as sxy"


TOTALS = "t as (select *, sum(resp) over (partition by person_id) as total from r)"
GROUPED = "t as (select r.*, person_id % 2 as g, sum(resp) over (partition by person_id) as s from r)"
WALK = "walk(k, node, w, score, p) as (select 0, node, w, 0, 1.0::double from quad union all select k+1, node, w, score + x, sum(pp) from (select k, node, w, score, x, p * case when x=1 then " + P + " else 1-" + P + " end as pp from walk join bank on item_id=k+1, (values (0),(1)) v(x)) group by k, node, w, score + x)"
EAP = "l as (select person_id, node, ln(max(w)) + sum(case when resp=1 then ln(least(greatest(" + P + ",1e-10),1-1e-10)) else ln(1-least(greatest(" + P + ",1e-10),1-1e-10)) end) as ll from r join bank using (item_id), quad group by 1,2), e as (select person_id, node, exp(ll - max(ll) over (partition by person_id)) as u from l), m as (select person_id, sum(u*node)/sum(u) as theta from e group by 1), sc as (select person_id, max(theta) as theta, sqrt(sum(u*(node-theta)^2)/sum(u)) as se from e join m using (person_id) group by 1)"
BINS = "tt as (select person_id, sum(resp)::double as total from s group by 1), ed as (select quantile_cont(total,0.2) as q1, quantile_cont(total,0.4) as q2, quantile_cont(total,0.6) as q3, quantile_cont(total,0.8) as q4 from tt), bb as (select person_id, cast((total>=q1)::int+(total>=q2)::int+(total>=q3)::int+(total>=q4)::int as int) as bin from tt, ed)"
OLD_NEW = "o as (select item_id, a as ao, b as bo from bank)"

ORACLES = {
    "irt_itemstats": f"with {A2}, m as (select item_id, count(*) as n, avg(resp) as mean, coalesce(stddev_samp(resp),0) as sd, min(resp) as least, max(resp) as greatest from g group by 1), c as (select item_id, avg((resp-mean)^2) as m2, avg((resp-mean)^3) as m3, avg((resp-mean)^4) as m4 from g join m using (item_id) group by 1) select item_id, n, round(mean,6) as mean, round(sd,6) as sd, least, greatest, round(case when n>2 and m2>0 then m3/m2^1.5 else 0 end,6) as skewness, round(case when n>2 and m2>0 then m4/(m2*m2)-3 else 0 end,6) as kurtosis from m join c using (item_id)",
    "irt_item_rest": f"with {A1}, {TOTALS}, x as (select item_id, {_sums('resp', 'total')}, avg(resp) as difficulty from t group by 1), y as (select item_id, {_sums('resp', '(total-resp)')} from t group by 1) select item_id, n::bigint as n, round({CORR},6) as item_total, (select round({CORR},6) from y where y.item_id = x.item_id) as item_rest, round(difficulty,6) as difficulty from x",
    "irt_alpha": f"with {A1}, i as (select count(v) as n_items, sum(v) as sv from (select var_samp(resp) as v from r group by item_id)), p as (select count(*) as n_persons, var_samp(t) as tv from (select sum(resp) as t from r group by person_id)) select n_items, n_persons, round(case when n_items<2 or tv<=0 then 0 else n_items/(n_items-1.0)*(1-sv/tv) end,6) as alpha from i, p",
    "irt_alpha_if_deleted": f"with {A1}, k as (select distinct item_id as d from r), p as (select person_id from r group by 1), o as (select d, person_id, sum(case when item_id=d then 0 else resp end) as t from r, k group by 1,2), tv as (select d, var_samp(t) as tv from o group by 1), iv as (select item_id, var_samp(resp) as v from r group by 1), s as (select d, sum(v) as sv, count(*) as j from k, iv where item_id<>d group by 1) select d as item_id, round(case when j<2 or tv<=0 then 0 else j/(j-1.0)*(1-sv/tv) end,6) as alpha_if_deleted from s join tv using (d)",
    "irt_missing": f"with {A1}, n as (select count(distinct person_id) as np from r) select item_id, count(*) as observed, round(1 - count(*)/(max(np)*(case when grouping(item_id)=1 then 7.0 else 1.0 end)),6) as missing_rate from r, n group by grouping sets ((), (item_id))",
    "irt_pairwise_counts": f"with {A1} select x.item_id as item_i, y.item_id as item_j, count(*) as n from r x join r y on x.person_id=y.person_id and x.item_id<=y.item_id group by 1,2",
    "irt_impute_values": f"with {A2}, c as (select item_id, resp, count(*) as n from g group by 1,2), k as (select item_id, resp, row_number() over (partition by item_id order by n desc, resp) as i from c) select item_id, cast(round_even(avg(resp),0) as int) as mean_value, (select resp from k where k.item_id=g.item_id and i=1) as mode_value from g group by item_id",
    "irt_patterns": f"with {A1}, p as (select person_id, string_agg(item_id || ':' || resp, ' ' order by item_id) as pattern, cast(sum(resp) as int) as score from r group by 1) select pattern, count(*) as freq, max(score) as score from p group by 1",
    "irt_dichotomise": f"with {A2} select item_id, cast(sum(case when resp>=2 then 1 else 0 end) as bigint) as n_right, count(*) as n from g group by 1",
    "irt_key_to_binary": f"with {A2} select item_id, cast(sum(case when resp = item_id % 4 then 1 else 0 end) as bigint) as n_right, count(*) as n from g group by 1",
    "irt_reverse": f"with {A2} select item_id, cast(sum(case when item_id in (2,4) then 3-resp else resp end) as bigint) as total from g group by 1",
    "irt_item_fit": f"with {SCORED} select item_id, count(*) as n, round(sum((resp-p)^2)/sum(v),6) as infit, round(avg((resp-p)^2/v),6) as outfit from s group by 1",
    "irt_person_fit": f"with {SCORED} select person_id, count(*) as n, round(sum((resp-p)^2)/sum(v),6) as infit, round(avg((resp-p)^2/v),6) as outfit, round(case when count(*)>=2 and sum(v*(ln(p)-ln(1-p))^2)>1e-10 then (sum(ll)-sum(p*ln(p)+(1-p)*ln(1-p)))/sqrt(sum(v*(ln(p)-ln(1-p))^2)) end,6) as zh from s group by 1",
    "irt_residuals": f"with {SCORED} select item_id, round(avg(resp-p),6) as mean_raw, round(stddev_pop(z),6) as sd_standard, round(max(abs(z)),6) as max_abs, count(*) filter (abs(z)>2) as n_large from s group by 1",
    "irt_q3": f"with {SCORED}, x as (select i.item_id as item_i, j.item_id as item_j, {_sums('i.z', 'j.z')} from s i join s j on i.person_id=j.person_id and i.item_id<j.item_id group by 1,2) select item_i, item_j, n::bigint as n, round(case when n>2 then {CORR} else 0 end,6) as q3 from x",
    "irt_ld_chi2": f"with {SCORED}, x as (select i.item_id as item_i, j.item_id as item_j, count(*) as n, " + ", ".join(f"count(*) filter (i.resp={a} and j.resp={b}) as o{a}{b}, greatest(sum({'i.p' if a else '(1-i.p)'}*{'j.p' if b else '(1-j.p)'}),0.5) as e{a}{b}" for a in (0, 1) for b in (0, 1)) + " from s i join s j on i.person_id=j.person_id and i.item_id<j.item_id group by 1,2) select item_i, item_j, n, round(case when n>=10 then " + "+".join(f"(o{k}-e{k})^2/e{k}" for k in ("00", "01", "10", "11")) + " end,6) as chi2, round(case when n>=10 then 2*(" + "+".join(f"case when o{k}>0 then o{k}*ln(o{k}/e{k}) else 0 end" for k in ("00", "01", "10", "11")) + ") end,6) as g2 from x",
    "irt_binned_fit": f"with {SCORED}, tt as (select person_id, sum(resp)::double as total from s group by 1), e as (select quantile_cont(total,0.2) as q1, quantile_cont(total,0.4) as q2, quantile_cont(total,0.6) as q3, quantile_cont(total,0.8) as q4 from tt), bb as (select person_id, (total>=q1)::int+(total>=q2)::int+(total>=q3)::int+(total>=q4)::int as bin from tt, e), c as (select item_id, bin, count(*) as n, avg(resp) as o, least(greatest(avg(p),0.01),0.99) as ex from s join bb using (person_id) group by 1,2 having count(*)>=5) select item_id, round(sum(n*(o-ex)^2/(ex*(1-ex))),5) as chi2, greatest(count(*)-1,1)::bigint as df from c group by 1",
    "irt_eap": f"with {A1}, {BANK}, {QUAD}, {EAP} select person_id, round(theta,6) as theta, round(se,6) as se from sc",
    "irt_information": f"with {BANK}, grid as (select -4 + 8*i/80.0::double as node from range(81) t(i)) select round(node,6) as theta, round(sum(a*a*{P}*(1-{P})),6) as information, round(1/sqrt(sum(a*a*{P}*(1-{P}))),6) as se from grid, bank group by node",
    "irt_sum_scores": f"with recursive {BANK}, {QUAD}, {WALK} select cast(score as int) as score, round(sum(w*p),9) as p from walk where k=7 group by 1",
    "irt_mantel_haenszel": f"with {A1}, {GROUPED}, c as (select item_id, s, count(*) filter (g=0 and resp=1)::double as a, count(*) filter (g=0 and resp=0)::double as b, count(*) filter (g=1 and resp=1)::double as c, count(*) filter (g=1 and resp=0)::double as d, count(*)::double as n from t group by 1,2 having count(*)>1), k as (select item_id, sum(a) as sa, sum((a+b)*(a+c)/n) as ea, sum((a+b)*(c+d)*(a+c)*(b+d)/(n*n*(n-1))) as va, sum(a*d/n) as up, sum(b*c/n) as down from c group by 1) select item_id, round(case when va>0 then (abs(sa-ea)-0.5)^2/va else 0 end,6) as chi2, round(case when down>0 then up/down else 1 end,6) as odds from k",
    "irt_sibtest": f"with {A1}, {GROUPED}, c as (select item_id, s-resp as k, avg(resp) filter (g=0) as mr, avg(resp) filter (g=1) as mf, count(*) filter (g=0)::double as nr, count(*) filter (g=1)::double as nf from t group by 1,2 having count(*) filter (g=0)>0 and count(*) filter (g=1)>0) select item_id, round(sum(2*nr*nf/(nr+nf)*(mr-mf))/sum(2*nr*nf/(nr+nf)),6) as beta, count(*) as n_scores from c group by 1",
    "irt_group_residuals": f"with {SCORED}, q as (select item_id, person_id%2 as g, count(*) as n, avg(resp-p) as mrr, avg((resp-p)^2) as msr, var_samp(resp-p) as vr from s group by 1,2), c as (select item_id, sum(n*mrr)/sum(n) as centre from q group by 1) select item_id, round(sum(case when vr>0 then (mrr-centre)^2*n/vr else 0 end),6) as grdif_r, round(max(msr),6) as max_msr from q join c using (item_id) group by 1",
    "irt_linking": f"with {BANK}, o as (select a as ao, b as bo, a/1.25 as an, b*1.25-0.3 as bn from bank) select round(stddev_samp(bo)/stddev_samp(bn),6) as a_mean_sigma, round(avg(bo)-stddev_samp(bo)/stddev_samp(bn)*avg(bn),6) as b_mean_sigma, round(avg(an)/avg(ao),6) as a_mean_mean, round(avg(bo)-avg(an)/avg(ao)*avg(bn),6) as b_mean_mean from o",
    "irt_drift": f"with {BANK}, d as (select item_id, sqrt((item_id*item_id*0.01)^2) as d from bank), m as (select median(d) as med from d), k as (select median(abs(d-med)) as mad from d, m) select item_id, round(d,6) as d, round(case when mad<1e-10 then 0 else (d-med)/(1.4826*mad) end,6) as z from d, m, k",
    "irt_next_item": f"with {A1}, {BANK}, {THETA}, f as (select t.person_id, k.item_id, a*a*(1/(1+exp(-(a*(theta-b)))))*(1-1/(1+exp(-(a*(theta-b))))) as info from theta t, bank k where not exists (select 1 from r where r.person_id=t.person_id and r.item_id=k.item_id)), n as (select *, row_number() over (partition by person_id order by info desc, item_id) as place from f) select person_id, place::int as place, item_id, round(info,6) as information from n where place=1",
    "irt_knowledge_tracing": "with recursive e as (select user_id as person_id, event_type as skill, case when value > 35 then 1 else 0 end as resp, row_number() over (partition by user_id, event_type order by ts, event_id) as k from events), w(person_id, skill, k, m) as (select person_id, skill, 0::bigint, 0.3::double from e where k=1 union all select e.person_id, e.skill, e.k, a*0.98+(1-a)*0.2 from (select w.person_id, w.skill, w.k as k0, m*(case when resp=1 then 0.9 else 0.1 end)/(m*(case when resp=1 then 0.9 else 0.1 end)+(1-m)*(case when resp=1 then 0.25 else 0.75 end)) as a, e.k from w join e on e.person_id=w.person_id and e.skill=w.skill and e.k=w.k+1) e) select person_id, skill, max(k) as n, round(arg_max(m,k),6) as mastery from w group by 1,2",
    "irt_reliable_change": f"with {A1}, c as (select person_id, coalesce(sum(resp) filter (item_id%2=1),0)::double as pre, coalesce(sum(resp) filter (item_id%2=0),0)::double as post from r group by 1), d as (select stddev_samp(pre) as sd from c), x as (select person_id, (post-pre)/(sd*sqrt(0.2)*sqrt(2)) as rci from c, d) select person_id, round(rci,6) as rci, case when rci>1.96 then 'improved' when rci<-1.96 then 'declined' else 'unchanged' end as change from x",
    "irt_null_models": f"with {A1}, i as (select item_id, count(*)::double as seen, sum(resp)::double as rt from r group by 1), c as (select *, least(greatest(rt/seen,1e-10),1-1e-10) as p, sum(rt) over ()/sum(seen) over () as q from i), np as (select count(distinct person_id) as n from r), mo as (select 'independence' as model, sum(rt*ln(p)+(seen-rt)*ln(1-p)) as ll, count(*) as k from c union all select 'pooled', sum(rt*ln(q)+(seen-rt)*ln(1-q)), 1 from c), x as (select *, -2*ll+2*k as a from mo, np) select model, round(ll,4) as log_likelihood, k, n, round(a,4) as aic, round(-2*ll+k*ln(n),4) as bic, round(-2*ll+k*ln((n+2)/24.0),4) as sabic, round(-2*ll+k*(ln(n)+1),4) as caic, round(case when n-k-1>0 then a+2*k*(k+1)/(n-k-1)::double end,4) as aicc, round(exp((min(a) over ()-a)/2)/(select sum(exp((y.least-x2.a)/2)) from x x2, (select min(a) as least from x) y),4) as weight from x",
    "irt_moment_fit": f"with {SCORED}, u as (select count(*) as n, avg(resp)-avg(p) as d from s group by item_id union all select count(*), avg(i.resp*j.resp)-avg(i.p*j.p) from s i join s j on i.person_id=j.person_id and i.item_id<j.item_id group by i.item_id, j.item_id) select round(sum(n*d*d),6) as statistic, greatest(count(*)-14,1)::bigint as df from u",
    "irt_empirical_reliability": f"with {A1}, {BANK}, {QUAD}, {EAP} select round(var_samp(theta)/(var_samp(theta)+avg(se*se)),6) as reliability from sc",
    "irt_marginal_reliability": f"with {BANK}, {QUAD}, i as (select node, max(w) as w, sum(a*a*{P}*(1-{P})) as info from quad, bank group by 1), v as (select sum(w*node*node)/sum(w)-(sum(w*node)/sum(w))^2 as v from quad) select round(sum(w*info/(info+1/v))/sum(w),6) as reliability from i, v",
    "irt_rubin": f"with {A1}, e as (select item_id, person_id%5 as part, avg(resp) as q, var_samp(resp)/count(resp) as u from r group by 1,2), g as (select item_id, count(*) as m, avg(q) as qb, avg(u) as ub, coalesce(var_samp(q),0) as b from e group by 1), h as (select *, (1+1.0::double/m)*b as x from g), k as (select *, case when ub+x>0 then x/(ub+x) else 0 end as la, case when x>0 then (m-1)*(1+ub/x)^2 else 1e10 end as dfr from h) select item_id, round(qb,6) as estimate, round(ub,6) as within, round(b,6) as between, round(ub+x,6) as total, round(la,6) as lambda, round(least(greatest(la+2/(dfr+3)*(1-la),0),1),6) as fmi from k".replace("as within", 'as "within"').replace("as between", 'as "between"'),
    "irt_weight_efficiency": f"with {A1}, w as (select 1.0::double+count(resp) as w from r group by person_id) select count(*) as n, round(sum(w)^2/sum(w*w),6) as ess, round(count(*)/(sum(w)^2/sum(w*w)),6) as deff from w",
    "irt_completeness": f"with {A1}, p as (select count(resp) as observed from r group by person_id) select observed, count(*) as persons, cast(max(case when observed=7 then 1 else 0 end) as int) as complete from p group by 1",
    "irt_empirical_bins": f"with {SCORED}, {BINS} select item_id, bin, count(*) as n, round(avg(resp),6) as observed, round(avg(p),6) as expected from s join bb using (person_id) group by 1,2",
    "irt_mastery": f"with {A1}, l as (select person_id, k, sum(ln(case when resp=1 then x else 1-x end)) as ll from (select person_id, resp, k, case when (k & item_id)=item_id then 0.9::double else 0.2::double end as x from r, range(8) t(k)) group by 1,2), e as (select person_id, k, exp(ll-max(ll) over (partition by person_id)) as u from l), p as (select person_id, k, round(u/sum(u) over (partition by person_id),9) as post from e), o as (select *, row_number() over (partition by person_id order by post desc, k) as place from p) select person_id, cast(max(k) filter (place=1) as int) as profile, round(max(post),6) as posterior, round(sum(post*(k & 1)),6) as p0, round(sum(post*((k >> 1) & 1)),6) as p1, round(sum(post*((k >> 2) & 1)),6) as p2 from o group by 1",
    "irt_area_between": f"with {BANK}, g as (select item_id, i, -4+i*(8/99.0::double) as t, a, b, a*1.1::double as an, b+0.2::double*item_id-0.7::double as bn from bank, range(100) x(i)), d as (select item_id, case when i in (0,99) then 4/99.0::double else 8/99.0::double end as w, 1/(1+exp(-(a*(t-b))))-1/(1+exp(-(an*(t-bn)))) as gap from g) select item_id, round(sum(w*gap),6) as signed, round(sum(w*abs(gap)),6) as unsigned from d group by 1".replace("as signed", 'as "signed"').replace("as unsigned", 'as "unsigned"'),
    "irt_crossing_sibtest": f"with {A1}, {GROUPED}, q as (select item_id, s-resp as k, resp, g from t), md as (select item_id, median(k) as middle from q group by 1), c as (select item_id, k, avg(resp) filter (g=0)-avg(resp) filter (g=1) as d, 2.0::double*count(*) filter (g=0)*count(*) filter (g=1)/count(*) as w from q group by 1,2 having count(*) filter (g=0)>0 and count(*) filter (g=1)>0), h as (select item_id, coalesce(sum(w*d) filter (k<=middle)/sum(w) filter (k<=middle),0) as lo, coalesce(sum(w*d) filter (k>middle)/sum(w) filter (k>middle),0) as hi from c join md using (item_id) group by 1) select item_id, round(lo,6) as beta_low, round(hi,6) as beta_high, round(hi-lo,6) as beta_crossing from h",
    "irt_eap_by_sum": f"with recursive {BANK}, {QUAD}, {WALK}, z as (select score, sum(w*p) as z, sum(w*p*node)/sum(w*p) as m, sum(w*p*node*node)/sum(w*p) as s2 from walk where k=7 group by 1) select cast(score as int) as score, round(m,6) as theta, round(sqrt(greatest(s2-m*m,0)),6) as se from z",
    "irt_characteristic_curve": f"with {BANK}, grid as (select -4 + 8*i/80.0::double as node from range(81) t(i)), p as (select node, 0.1::double+0.9::double*{P} as p from grid, bank) select round(node,6) as theta, round(sum(p),6) as expected, round(sqrt(sum(p*(1-p))),6) as sd from p group by node",
    "irt_partial_credit_fit": f"with {A2}, {BANK}, th as (select person_id, 4.0::double*sum(resp)/(3.0::double*count(resp))-2 as t from g group by 1), e as (select item_id, resp, exp(a*(t-b+0.5)) as e1, exp(a*(2*t-2*b+0.5)) as e2, exp(a*(3*t-3*b)) as e3 from g join bank using (item_id) join th using (person_id)), m as (select item_id, resp, (e1+2*e2+3*e3)/(1+e1+e2+e3) as ex, (e1+4*e2+9*e3)/(1+e1+e2+e3) as sq from e), v as (select *, greatest(sq-ex*ex,0) as v from m) select item_id, count(*) as n, round(sum((resp-ex)^2)/sum(v),6) as infit, round(avg((resp-ex)^2/v) filter (v>1e-10),6) as outfit from v group by 1",
    "irt_graded_eap": f"with {A2}, {BANK}, {QUAD}, pr as (select person_id, node, w, least(greatest(case when resp=0 then 1 else 1/(1+exp(-(a*(node-(b-1.0::double+0.5::double*resp))))) end - case when resp=3 then 0 else 1/(1+exp(-(a*(node-(b-0.5::double+0.5::double*resp))))) end,1e-10),1-1e-10) as p from g join bank using (item_id), quad), l as (select person_id, node, ln(max(w))+sum(ln(p)) as ll from pr group by 1,2), e as (select person_id, node, exp(ll-max(ll) over (partition by person_id)) as u from l), m as (select person_id, sum(u*node)/sum(u) as theta from e group by 1) select person_id, round(max(theta),6) as theta, round(sqrt(sum(u*(node-theta)^2)/sum(u)),6) as se from e join m using (person_id) group by 1",
    "irt_adjacent": f"with {A2} select item_id, cast(k as int) as step, cast(sum(case when resp>=k then 1 else 0 end) as bigint) as n_right, count(*) as n from g, range(1,4) t(k) group by 1,2",
    "irt_category_counts": f"with {A2} select item_id, resp, count(*) as n from g group by 1,2",
    "irt_vuong": f"with {SCORED}, fl as (select person_id, resp, least(greatest(1/(1+exp(-(theta-b))),1e-10),1-1e-10) as p from r join bank using (item_id) join theta using (person_id)), l1 as (select person_id, sum(ll) as x from s group by 1), l2 as (select person_id, sum(case when resp=1 then ln(p) else ln(1-p) end) as y from fl group by 1), d as (select x-y as d from l1 join l2 using (person_id)) select count(*) as n, round(avg(d),6) as mean, round(stddev_samp(d),6) as sd, round(sqrt(count(*))*avg(d)/stddev_samp(d),6) as z from d",
    "irt_held_out_likelihood": f"with {A1}, c as (select item_id, cast(person_id%5 as int) as fold, count(*) as n, sum(resp) as k from r group by 1,2), t as (select *, (sum(k) over (partition by item_id)-k)::double/(sum(n) over (partition by item_id)-n) as p from c), q as (select fold, n, k, least(greatest(coalesce(p,0.5),1e-10),1-1e-10) as p from t) select fold, cast(sum(n) as bigint) as n, round(sum(k*ln(p)+(n-k)*ln(1-p)),4) as log_likelihood from q group by 1",
}
