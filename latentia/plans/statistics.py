"""Queries of recoding, fit, differential functioning and networks, each with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from latentia.operators import diagnostics as dg
from latentia.operators import fit, recoding
from latentia.plans.queries import A1, A2, BANK, BINS, ORACLES as FIRST, SCORED, _graded_bank, _groups, _scored, rounded, theta_by_score  # noqa: F401
from latentia.sources import responses as src


def _patterns(spark, d):
    from latentia.operators import classical

    return classical.patterns(src.dichotomous(spark, d))


def expand_table(spark, d):
    """Each pattern's persons once more as rows, added up by the number of the copy and the score."""
    return recoding.expand_table(_patterns(spark, d)).groupBy("copy", "score").agg(F.count(F.lit(1)).alias("n"))


def recode(spark, d):
    return recoding.recode(src.graded(spark, d), {0: 1, 1: 0, 3: 2}, [1, 3, 5]).groupBy("item_id", "resp").agg(F.count(F.lit(1)).alias("n"))


def likert(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.col("o_orderpriority").alias("answer"))
    labels = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH"]
    return recoding.likert_to_int(o, labels).groupBy("resp").agg(F.count(F.lit(1)).alias("n"))


def dichotomise_at_median(spark, d):
    return recoding.dichotomise(src.graded(spark, d)).groupBy("item_id").agg(F.sum("resp").alias("n_right"), F.count(F.lit(1)).alias("n"))


def dichotomise_by_item(spark, d):
    return recoding.dichotomise(src.graded(spark, d), {i: 1 + i % 3 for i in range(1, 8)}).groupBy("item_id").agg(F.sum("resp").alias("n_right"), F.count(F.lit(1)).alias("n"))


def complete_rows(spark, d):
    return recoding.complete_rows(src.dichotomous(spark, d), 7).groupBy("person_id").agg(F.sum("resp").alias("score"))


def completed_by_mean(spark, d):
    return recoding.completed(src.graded(spark, d), src.bank(spark), "mean").groupBy("item_id", "imputed", "resp").agg(F.count(F.lit(1)).alias("n"))


def completed_by_mode(spark, d):
    return recoding.completed(src.graded(spark, d), src.bank(spark), "mode").groupBy("item_id", "imputed", "resp").agg(F.count(F.lit(1)).alias("n"))


def check_patterns(spark, d):
    return rounded(recoding.check_patterns(src.graded(spark, d), 7, 3), "missing_rate")


def missing_by(spark, d):
    return recoding.missing_by(src.dichotomous(spark, d), 7)


def collapse_with_groups(spark, d):
    r = src.dichotomous(spark, d)
    return recoding.collapse_with_groups(r, _groups(r))


def item_frequencies(spark, d):
    g = src.graded(spark, d)
    return rounded(recoding.item_statistics(g, g.agg(F.count_distinct("person_id").alias("persons"))), "pct_missing")


def _pre_post(spark, d):
    odd = F.col("item_id") % 2 == 1
    return src.dichotomous(spark, d).groupBy("person_id").agg(F.coalesce(F.sum(F.when(odd, F.col("resp"))), F.lit(0)).cast("double").alias("pre"), F.coalesce(F.sum(F.when(~odd, F.col("resp"))), F.lit(0)).cast("double").alias("post"))


def clinical_significance(spark, d):
    return rounded(recoding.clinical_significance(_pre_post(spark, d), 0.8, 1.0), "rci")


def change_with_errors(spark, d):
    s = _pre_post(spark, d).withColumns({"se_pre": 0.5 + 0.1 * F.col("pre"), "se_post": F.lit(0.6)})
    return rounded(recoding.change_with_errors(s), "rci")


def grouped_item_chi2(spark, d):
    s = _scored(spark, d)
    totals = s.groupBy("person_id").agg(F.sum("resp").alias("score"))
    return rounded(recoding.grouped_chi2(s, recoding.score_groups(totals, 10)), "chi2", digits=5)


def fit_indices(spark, d):
    return rounded(dg.fit_indices(_scored(spark, d), 14), "m2", "m2_0", "rmsea", "cfi", "tli", "srmsr")


def deviance_residuals(spark, d):
    r = dg.deviance_residuals(_scored(spark, d))
    return rounded(r.groupBy("item_id").agg(F.avg("raw").alias("raw"), F.avg("standard").alias("standard"), F.avg("deviance").alias("deviance")), "raw", "standard", "deviance")


def flagged_persons(spark, d):
    s = _scored(spark, d)
    return dg.flag_persons(fit.mean_squares(s, "person_id").join(fit.zh(s).drop("n"), "person_id"))


def flagged_pairs(spark, d):
    s = _scored(spark, d)
    return rounded(dg.flag_pairs(fit.q3(s), fit.ld_chi2(s), 0.05, 0.01).drop("p_value"), "q3", "chi2")


def _calibrations(spark):
    """Two fixed calibrations of the bank with errors."""
    i = F.col("item_id")
    one = src.bank(spark).withColumns({"se_a": 0.05 + 0.01 * i, "se_b": 0.04 + 0.005 * i})
    two = one.withColumns({"a": F.col("a") * (1 + 0.02 * i), "b": F.col("b") + 0.09 * i - 0.2})
    return one, two


def parameter_dif(spark, d):
    return rounded(dg.parameter_dif(*_calibrations(spark)), "statistic", "p_value", "effect")


def flagged_items(spark, d):
    return rounded(dg.flag_items(dg.parameter_dif(*_calibrations(spark)), 0.05, 0.3, "BC"), "statistic", "p_value", "effect")


def effect_sizes(spark, d):
    return rounded(dg.effect_sizes(dg.over_grid(*_calibrations(spark))), "signed", "unsigned", "rmsd", "weighted_rmsd")


def test_functioning(spark, d):
    return rounded(dg.test_functioning(dg.over_grid(*_calibrations(spark))), "signed", "unsigned", "rms")


def response_functioning(spark, d):
    return rounded(dg.response_functioning(dg.over_grid(*_calibrations(spark))), "area", "largest")


def _three_groups(r):
    return r.select("person_id", (F.col("person_id") % 3).cast("int").alias("g")).distinct()


def residual_groups(spark, d):
    s = _scored(spark, d)
    g = dg.residual_groups(s, _three_groups(s))
    return rounded(g.groupBy("item_id").agg((F.max("mrr") - F.min("mrr")).alias("effect"), F.max("msr").alias("msr"), F.sum("n").alias("n")), "effect", "msr")


def residual_pairs(spark, d):
    s = _scored(spark, d)
    return rounded(dg.residual_pairs(dg.residual_groups(s, _three_groups(s))), "difference", "statistic")


def kernel_smooth(spark, d):
    return rounded(dg.kernel_smooth(_scored(spark, d)), "theta", "smooth", "se")


def empirical_rmsea(spark, d):
    from latentia.operators import summaries

    return rounded(dg.empirical_rmsea(summaries.empirical_bins(_scored(spark, d))), "rmsea")


def pair_moments(spark, d):
    return rounded(dg.pair_moments(src.dichotomous(spark, d)), "cov", "corr", "log_odds")


def mastery_any(spark, d):
    """As irt_mastery, but any of an item's attributes is enough."""
    from latentia.operators import diagnosis

    columns = ("posterior", "p0", "p1", "p2")
    found = diagnosis.mastery_posterior(src.dichotomous(spark, d), {i: i for i in range(1, 8)}, 3, 0.1, 0.2, every=False)
    return rounded(found.withColumns({c: F.col(c) + 1e-9 for c in columns}), *columns)  # some values end in a five at the seventh digit


def partial_correlations(spark, d):
    """Edges of a Gaussian network; rows only, as the inverse of a matrix has no SQL form."""
    r = src.dichotomous(spark, d)
    return rounded(dg.partial_correlations(dg.pair_moments(r), r.groupBy("item_id").agg(F.var_pop("resp").alias("variance"))), "partial")


QUERIES = {f"irt_{f.__name__}": f for f in (expand_table, recode, likert, dichotomise_at_median, dichotomise_by_item, complete_rows, completed_by_mean, completed_by_mode, check_patterns, missing_by, collapse_with_groups, item_frequencies, clinical_significance, change_with_errors, grouped_item_chi2, fit_indices, deviance_residuals, flagged_persons, flagged_pairs, parameter_dif, flagged_items, effect_sizes, test_functioning, response_functioning, residual_groups, residual_pairs, kernel_smooth, empirical_rmsea, pair_moments, mastery_any, partial_correlations)}

PATTERNS = "pp as (select person_id, string_agg(item_id || ':' || resp, ' ' order by item_id) as pattern, cast(sum(resp) as int) as score from r group by 1)"
CELLS = "items as (select cast(i as int) as item_id from range(1, 8) t(i)), cells as (select p.person_id, i.item_id, g.resp from (select distinct person_id from g) p cross join items i left join g on g.person_id = p.person_id and g.item_id = i.item_id)"
CAL = BANK + ", cal as (select item_id, a, b, a*(1+0.02::double*item_id) as fa, b+0.09::double*item_id-0.2::double as fb, 0.05::double+0.01::double*item_id as sa, 0.04::double+0.005::double*item_id as sb from bank)"
DIF = CAL + ", st as (select item_id, (a-fa)^2/(2*sa*sa)+(b-fb)^2/(2*sb*sb) as x, abs(b-fb) as effect from cal), dif as (select item_id, round(x,6) as statistic, round(exp(-x/2),6) as p_value, round(effect,6) as effect, case when exp(-x/2) > 0.05 or effect < 0.426 then 'A' when effect < 0.638 then 'B' else 'C' end as class from st)"
CURVES = CAL + ", g0 as (select -4 + 8*i/80.0::double as theta from range(81) t(i)), gr as (select theta, exp(-0.5*theta*theta)/(select sum(exp(-0.5*theta*theta)) from g0) as w from g0), cu as (select *, 1/(1+exp(-(a*(theta-b)))) as pr, 1/(1+exp(-(fa*(theta-fb)))) as pf from cal, gr)"
PRE_POST = "c as (select person_id, coalesce(sum(resp) filter (item_id%2=1),0)::double as pre, coalesce(sum(resp) filter (item_id%2=0),0)::double as post from r group by 1)"
THIRDS = "gg as (select item_id, person_id%3 as g, count(*) as n, avg(resp-p) as mrr, avg((resp-p)^2) as msr, var_samp(resp-p) as vr from s group by 1,2)"
PAIR_SUMS = "pm as (select i.item_id as item_i, j.item_id as item_j, count(*)::double as n, sum(i.resp)::double as sx, sum(j.resp)::double as sy, sum(i.resp*i.resp)::double as sxx, sum(j.resp*j.resp)::double as syy, sum(i.resp*j.resp)::double as sxy, corr(i.p, j.p) as cp, corr(i.resp, j.resp) as cx, sum(i.p*j.p) as spq from s i join s j on i.person_id=j.person_id and i.item_id<j.item_id group by 1,2)"

ORACLES = {
    "irt_expand_table": f"with {A1}, {PATTERNS}, f as (select pattern, max(score) as score, count(*) as freq from pp group by 1) select cast(k as int) as copy, score, count(*) as n from f, range(1, (select max(freq)+1 from f)) t(k) where k <= freq group by 1, 2",
    "irt_recode": f"with {A2} select item_id, cast(case when item_id in (1,3,5) then case resp when 0 then 1 when 1 then 0 when 3 then 2 else resp end else resp end as int) as resp, count(*) as n from g group by 1, 2",
    "irt_likert": "select cast(case o_orderpriority when '5-LOW' then 0 when '4-NOT SPECIFIED' then 1 when '3-MEDIUM' then 2 when '2-HIGH' then 3 end as int) as resp, count(*) as n from orders group by 1",
    "irt_dichotomise_at_median": f"with {A2}, m as (select item_id, median(resp) as cut from g group by 1) select item_id, cast(sum(case when resp >= cut then 1 else 0 end) as bigint) as n_right, count(*) as n from g join m using (item_id) group by 1",
    "irt_dichotomise_by_item": f"with {A2} select item_id, cast(sum(case when resp >= 1 + item_id%3 then 1 else 0 end) as bigint) as n_right, count(*) as n from g group by 1",
    "irt_complete_rows": f"with {A1} select person_id, cast(sum(resp) as bigint) as score from r group by 1 having count(*) = 7",
    "irt_completed_by_mean": f"with {A2}, {CELLS}, m as (select item_id, cast(round_even(avg(resp),0) as int) as v from g group by 1) select item_id, resp is null as imputed, cast(coalesce(resp, v) as int) as resp, count(*) as n from cells join m using (item_id) group by 1, 2, 3",
    "irt_completed_by_mode": f"with {A2}, {CELLS}, k as (select item_id, resp as v, row_number() over (partition by item_id order by count(*) desc, resp) as i from g group by 1, 2) select item_id, resp is null as imputed, cast(coalesce(resp, v) as int) as resp, count(*) as n from cells join (select * from k where i = 1) using (item_id) group by 1, 2, 3",
    "irt_check_patterns": f"with {A2} select person_id, count(resp) as n, round(1-count(resp)/7.0::double,6) as missing_rate, max(resp) = 0 as all_low, min(resp) = 3 as all_high from g group by 1",
    "irt_missing_by": f"with {A1}, p as (select person_id, 7-count(resp) as n_missing from r group by 1) select n_missing, count(*) as persons from p group by 1",
    "irt_collapse_with_groups": f"with {A1}, {PATTERNS} select cast(person_id%2 as int) as g, pattern, count(*) as freq, min(person_id) as first from pp group by 1, 2",
    "irt_item_frequencies": f"with {A2}, n as (select count(distinct person_id) as np from g), c as (select item_id, resp, count(*) as k from g group by 1,2) select item_id, cast(sum(k) as bigint) as n, cast(max(np)-sum(k) as bigint) as n_missing, round((max(np)-sum(k))::double/max(np),6) as pct_missing, string_agg(resp || ':' || k, ' ' order by resp) as frequencies from c, n group by 1",
    "irt_clinical_significance": f"with {A1}, {PRE_POST}, sd as (select stddev_samp(pre) as sd from c), x as (select person_id, pre, post, (post-pre)/(sd*sqrt(2*0.2::double)) as rci from c, sd) select person_id, round(rci,6) as rci, case when rci > 1.96 and pre < 1 and post >= 1 then 'recovered' when rci > 1.96 then 'improved' when rci < -1.96 then 'deteriorated' else 'unchanged' end as outcome from x",
    "irt_change_with_errors": f"with {A1}, {PRE_POST} select person_id, round((post-pre)/sqrt((0.5::double+0.1::double*pre)^2+0.6::double*0.6::double),6) as rci from c",
    "irt_grouped_item_chi2": f"with {SCORED}, tt as (select person_id, sum(resp) as score from s group by 1), gr as (select person_id, least((row_number() over (order by score, person_id)-1)*10 // count(*) over (), 9) as grp from tt), c as (select item_id, grp, count(*) as n, sum(resp) as o, sum(p) as e, sum(v) as v from s join gr using (person_id) group by 1,2) select item_id, round(coalesce(sum((o-e)^2/v) filter (n >= 5),0),5) as chi2, greatest(count(*) filter (n >= 5)-1,1)::bigint as df from c group by 1",
    "irt_fit_indices": f"with {SCORED}, {PAIR_SUMS}, p2 as (select sum(n*(sxy/n-spq/n)^2) as s2, count(*) as k2, sum(n*(sxy/n-sx/n*sy/n)^2) as m0, sqrt(avg((cx-cp)^2)) as srmsr from pm), p1 as (select sum(n*d*d) as s1, count(*) as k1 from (select count(*) as n, avg(resp)-avg(p) as d from s group by item_id)), np as (select count(distinct person_id) as np from s), t as (select s1+s2 as m2, greatest(k1+k2-14,1)::double as df, m0, k2::double as df0, srmsr, np from p1, p2, np) select round(m2,6) as m2, df::bigint as df, round(m0,6) as m2_0, df0::bigint as df_0, round(sqrt(greatest((m2/df-1)/(np-1),0)),6) as rmsea, round(case when greatest(m0-df0,m2-df,0) <= 0 then 1 else least(greatest(1-greatest(m2-df,0)/greatest(m0-df0,m2-df,0),0),1) end,6)+0.0 as cfi, round(case when m0/df0 <= 1 then 1 else (m0/df0-m2/df)/(m0/df0-1) end,6) as tli, round(srmsr,6) as srmsr from t",
    "irt_deviance_residuals": f"with {SCORED} select item_id, round(avg(resp-p),6)+0.0 as raw, round(avg(z),6)+0.0 as standard, round(avg(sign(resp-p)*sqrt(greatest(-2*ll,0))),6)+0.0 as deviance from s group by 1",
    "irt_flagged_persons": f"with {SCORED}, f as (select person_id, sum((resp-p)^2)/sum(v) as infit, avg((resp-p)^2/v) as outfit, case when count(*)>=2 and sum(v*(ln(p)-ln(1-p))^2)>1e-10 then (sum(ll)-sum(p*ln(p)+(1-p)*ln(1-p)))/sqrt(sum(v*(ln(p)-ln(1-p))^2)) end as zh from s group by 1), w as (select person_id, concat_ws(' ', case when infit < 0.7 or infit > 1.3 then 'infit' end, case when outfit < 0.7 or outfit > 1.3 then 'outfit' end, case when zh < -2 then 'zh' end) as flags from f) select * from w where flags <> ''",
    "irt_parameter_dif": f"with {DIF} select * from dif",
    "irt_flagged_items": f"with {DIF} select * from dif where p_value <= 0.05 and effect >= 0.3 and class in ('B', 'C')",
    "irt_effect_sizes": f"with {CURVES} select item_id, round(sum(w*(pf-pr)),6)+0.0 as signed, round(sum(w*abs(pf-pr)),6) as unsigned, round(sqrt(avg((pf-pr)^2)),6) as rmsd, round(sqrt(sum(w*(pf-pr)^2)),6) as weighted_rmsd from cu group by 1",
    "irt_test_functioning": f"with {CURVES}, t as (select theta, max(w) as w, sum(pf)-sum(pr) as d from cu group by 1) select round(sum(w*d),6) as signed, round(sum(w*abs(d)),6) as unsigned, round(sqrt(sum(w*d*d)),6) as rms from t",
    "irt_response_functioning": f"with {CURVES}, x as (select item_id, theta, abs(a*a*pr*(1-pr)-fa*fa*pf*(1-pf)) as d from cu) select item_id, round(0.1*sum(case when abs(theta)>3.9999 then d/2 else d end),6) as area, round(max(d),6) as largest from x group by 1",
    "irt_residual_groups": f"with {SCORED}, {THIRDS} select item_id, round(max(mrr)-min(mrr),6) as effect, round(max(msr),6) as msr, cast(sum(n) as bigint) as n from gg group by 1",
    "irt_residual_pairs": f"with {SCORED}, {THIRDS} select x.item_id, cast(x.g as int) as g1, cast(y.g as int) as g2, round(x.mrr-y.mrr,6)+0.0 as difference, round((x.mrr-y.mrr)^2/(x.vr/x.n+y.vr/y.n),6) as statistic from gg x join gg y on x.item_id=y.item_id and x.g<y.g",
    "irt_kernel_smooth": f"with {SCORED}, pe as (select distinct person_id, theta from s), z as (select min(theta) as lo, max(theta) as hi, 1.06::double*stddev_pop(theta)*pow(count(*)::double,-0.2::double) as h from pe), gr as (select h, k, lo+k*((hi-lo)/20) as pt from z, range(21) t(k)), ce as (select item_id, theta, count(*) as n, sum(resp) as sm, sum(resp*resp) as ss from s group by 1,2), w as (select item_id, k, pt, n, sm, ss, exp(-0.5*((pt-theta)/h)^2) as w from ce, gr), q as (select item_id, k, max(pt) as pt, sum(w*n) as k1, sum(w*sm) as ks, sum(w*ss) as kss, sum(w*w*n) as kk from w group by 1,2) select item_id, cast(k as int) as point, round(pt,6)+0.0 as theta, round(ks/k1,6)+0.0 as smooth, round(sqrt(greatest(kss/k1-(ks/k1)^2,0)*kk/(k1*k1)),6)+0.0 as se from q",
    "irt_empirical_rmsea": f"with {SCORED}, {BINS}, b as (select item_id, bin, avg(resp) as observed, avg(p) as expected from s join bb using (person_id) group by 1,2) select item_id, round(sqrt(avg((observed-expected)^2)),6) as rmsea from b group by 1",
    "irt_pair_moments": f"with {A1}, x as (select i.item_id as item_i, j.item_id as item_j, count(*) as n, covar_pop(i.resp, j.resp) as cov, corr(i.resp, j.resp) as corr, count(*) filter (i.resp=1 and j.resp=1)+0.5 as c11, count(*) filter (i.resp=1 and j.resp=0)+0.5 as c10, count(*) filter (i.resp=0 and j.resp=1)+0.5 as c01, count(*) filter (i.resp=0 and j.resp=0)+0.5 as c00 from r i join r j on i.person_id=j.person_id and i.item_id<j.item_id group by 1,2) select item_i, item_j, n, round(cov,6)+0.0 as cov, round(coalesce(corr,0),6)+0.0 as corr, round(ln(c11*c00/(c10*c01)::double),6)+0.0 as log_odds from x",
    # 6.634896601 is the 99 % point of chi-square with one degree
    "irt_flagged_pairs": f"with q as ({FIRST['irt_q3']}), l as ({FIRST['irt_ld_chi2']}) select item_i, item_j, q3, chi2, abs(q3) > 0.05 as by_q3, coalesce(chi2 > 6.634896601, false) as by_chi2 from q join l using (item_i, item_j) where abs(q3) > 0.05 or chi2 > 6.634896601",
    "irt_mastery_any": FIRST["irt_mastery"].replace("(k & item_id)=item_id", "(k & item_id)>0").replace("round(u/sum(u) over (partition by person_id),9) as post", "u/sum(u) over (partition by person_id) as post").replace("order by post desc", "order by round(post,9) desc").replace("round(max(post),6)", "round(max(post)+1e-9,6)").replace("),6) as p", ")+1e-9,6) as p"),
}
