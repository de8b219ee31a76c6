"""Queries of scoring, linking, equating, simulation and draws, each with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from latentia.operators import equating, posterior, scoring
from latentia.plans.queries import A1, BANK, EAP, ORACLES as FIRST, P, QUAD, WALK, rounded
from latentia.sources import responses as src
from latentia.sources import simulation as sim


def score_ml(spark, d):
    return rounded(scoring.fscores(src.dichotomous(spark, d), src.bank(spark), "ml"), "theta", "se")


def score_map(spark, d):
    return rounded(scoring.fscores(src.dichotomous(spark, d), src.bank(spark), "map"), "theta", "se")


def score_wle(spark, d):
    return rounded(scoring.fscores(src.dichotomous(spark, d), src.bank(spark), "wle"), "theta", "se")


def score_by_sum(spark, d):
    return rounded(scoring.fscores(src.dichotomous(spark, d), src.bank(spark), "eapsum"), "theta", "se")


def eap_with_missing(spark, d):
    """Persons whose number ends in 7 have all answers missing, those in 3 the odd items'; the bank has 12,000 items."""
    r = src.dichotomous(spark, d)
    last = F.col("person_id") % 10
    r = r.withColumn("resp", F.when((last == 7) | ((last == 3) & (F.col("item_id") % 2 == 1)), F.lit(None)).otherwise(F.col("resp")))
    return rounded(scoring.eap(r, src.bank(spark, 12_000)), "theta", "se")


def _new(spark):
    return src.bank(spark).withColumns({"b": F.col("b") * 1.25 - 0.3, "a": F.col("a") / 1.25})


def link_by_curves(spark, d):
    """A form that is an exact transformation: all methods find its constants."""
    out = None
    for m in ("mean_sigma", "mean_mean", "haebara", "stocking_lord"):
        one = equating.link(src.bank(spark), _new(spark), m)
        out = one if out is None else out.unionByName(one)
    return rounded(out.select("method", "slope", "shift", "n_anchors"), "slope", "shift", digits=5)


def chain_linking(spark, d):
    b = src.bank(spark)
    third = _new(spark).withColumns({"b": F.col("b") * 0.8 + 0.5, "a": F.col("a") / 0.8})
    return rounded(equating.chain_link([b, _new(spark), third], 1), "slope", "shift")


def transformed_bank(spark, d):
    return rounded(equating.transform(src.bank(spark), 1.2, -0.4).drop("c"), "a", "b")


def _form(spark):
    return src.bank(spark).withColumns({"b": F.col("b") + 0.3, "a": F.col("a") * 0.9})


def _scores(spark):
    return spark.range(1, 7).select(F.col("id").cast("double").alias("score"))


def true_score_equating(spark, d):
    return rounded(equating.true_score_equating(src.bank(spark), _form(spark), _scores(spark)), "theta", "equated", digits=5)


def equipercentile(spark, d):
    return rounded(equating.equipercentile(scoring.sum_scores(src.bank(spark)), scoring.sum_scores(_form(spark))), "rank", "equated", digits=5)


def equating_error(spark, d):
    return rounded(equating.equating_error(src.bank(spark), _form(spark)), "theta", "see")


def theta_to_scores(spark, d):
    t = spark.range(9).select((F.col("id") * 0.5 - 2).alias("theta"))
    return rounded(equating.theta_to_scores(src.bank(spark), t), "score")


def difficulty_at(spark, d):
    return rounded(equating.difficulty_at(src.bank(spark), 0.7), "theta")


def information_area(spark, d):
    return rounded(equating.information_area(src.bank(spark)), "area")


def simulate(spark, d):
    r = sim.simulate(sim.abilities(spark, 3000, 5), src.bank(spark), 9)
    return r.groupBy("item_id").agg(F.sum("resp").alias("n_right"), F.count(F.lit(1)).alias("n"))


def simulate_graded(spark, d):
    bank = src.bank(spark).withColumn("steps", F.array(F.col("b") - 0.5, F.col("b"), F.col("b") + 0.5))
    r = sim.simulate(sim.abilities(spark, 3000, 5), bank, 9)
    return r.groupBy("item_id", "resp").agg(F.count(F.lit(1)).alias("n"))


def bootstrap_difficulty(spark, d):
    return rounded(sim.bootstrap_difficulty(src.dichotomous(spark, d), 12, 3), "difficulty", "se", "low", "high")


def impute_from_model(spark, d):
    r = src.dichotomous(spark, d)
    t = r.groupBy("person_id").agg(((F.sum("resp") - 1.0) / 1.5).alias("theta"))
    out = sim.impute_from_model(r, t, src.bank(spark), 4, 3)
    return out.groupBy("item_id", "imputation", "imputed").agg(F.count(F.lit(1)).alias("n"), F.sum("resp").alias("n_right"))


def plausible_statistics(spark, d):
    post = posterior.posterior_cdf(src.dichotomous(spark, d), src.bank(spark))
    return rounded(posterior.plausible_statistics(sim.plausible_values(post, 5, 2)), "mean", "within", "between", "se")


def plausible_regression(spark, d):
    r = src.dichotomous(spark, d)
    pv = sim.plausible_values(posterior.posterior_cdf(r, src.bank(spark)), 5, 2)
    y = r.groupBy("person_id").agg(F.count("resp").cast("double").alias("y"))
    return rounded(posterior.plausible_regression(pv, y), "slope", "intercept", "se_slope")


def _draws(spark, d):
    """Log-likelihood by person under five shifted banks."""
    return posterior.pointwise(src.dichotomous(spark, d), src.bank(spark), spark.range(5).select(F.col("id").cast("int").alias("draw"), (0.1 * F.col("id") - 0.2).alias("shift")))


def pointwise_likelihood(spark, d):
    return rounded(_draws(spark, d).groupBy("draw").agg(F.count(F.lit(1)).alias("n"), F.sum("ll").alias("ll")), "ll", digits=4)


def waic(spark, d):
    return rounded(posterior.waic(_draws(spark, d)), "lppd", "p_waic", "waic", "se", digits=4)


def dic(spark, d):
    return rounded(posterior.dic(_draws(spark, d), 2), "dic", "p_dic", digits=4)


def posterior_summary(spark, d):
    rows = src.trials(spark, d).select(F.col("skill").alias("param"), F.col("event_id").alias("draw"), F.col("resp").cast("double").alias("value"))
    return rounded(posterior.posterior_summary(rows), "mean", "sd", "low", "high")


QUERIES = {f"irt_{f.__name__}": f for f in (score_ml, score_map, score_wle, score_by_sum, eap_with_missing, link_by_curves, chain_linking, transformed_bank, true_score_equating, equipercentile, equating_error, theta_to_scores, difficulty_at, information_area, simulate, simulate_graded, bootstrap_difficulty, impute_from_model, plausible_statistics, plausible_regression, pointwise_likelihood, waic, dic, posterior_summary)}


def halving(slope: str, prior: str = "0") -> str:
    """The zero of a falling derivative by fifty halvings; s1 sums a(x-p), s2 information, s3 the third-order sum."""
    return (
        f"with recursive {A1}, {BANK}, pat as (select person_id, string_agg(item_id || ':' || resp, ' ' order by item_id) as pt from r group by 1), one as (select pt, min(person_id) as person_id from pat group by 1), cc as (select pt, a, b, resp as x from one join r using (person_id) join bank using (item_id)), "
        f"h(k, pt, lo, hi) as (select 0, pt, -6.0::double, 6.0::double from one union all select k+1, pt, case when up then mid else lo end, case when up then hi else mid end from (select k, pt, lo, hi, mid, {slope} > 0 as up from (select k, pt, max(lo) as lo, max(hi) as hi, max(mid) as mid, sum(a*(x-p)) as s1, sum(a*a*p*(1-p)) as s2, sum(a*a*a*p*(1-p)*(1-2*p)) as s3 from (select h.*, (lo+hi)/2 as mid, a, b, x, 1/(1+exp(-a*((lo+hi)/2-b))) as p from h join cc using (pt)) group by k, pt)) where k < 50), "
        f"e as (select pt, (lo+hi)/2 as theta from h where k = 50), i as (select pt, max(theta) as theta, sum(a*a*(1/(1+exp(-a*(theta-b))))*(1-1/(1+exp(-a*(theta-b))))) + {prior} as info from e join cc using (pt) group by 1) "
        "select person_id, round(theta,6)+0.0 as theta, round(1/sqrt(info),6) as se from pat join i using (pt)"
    )


def u(*parts: str) -> str:
    return "((('0x' || substr(md5(" + " || '|' || ".join(f"({p})::varchar" for p in parts) + "),1,8))::bigint)::double+0.5)/4294967296.0"


def z(*parts: str) -> str:
    return f"sqrt(-2*ln({u(*parts, '1')}))*cos(2*pi()*{u(*parts, '2')})"


FORM = "form as (select item_id, a*0.9::double as a, b+0.3::double as b from bank)"
TCC = "gd as (select -6 + 12*i/240.0::double as node from range(241) t(i)), tn as (select node, sum(1/(1+exp(-(a*(node-b))))) as e from gd, form group by 1), tw as (select node, sum(1/(1+exp(-(a*(node-b))))) as e from gd, bank group by 1)"
PEOPLE = f"pp as (select id as person_id, {z('id', '5')} as theta from range(3000) t(id))"
SIMULATED = f"{BANK}, {PEOPLE}"
POST = f"{A1}, {BANK}, {QUAD}, {EAP.split(', m as (')[0]}, cdf as (select person_id, node, sum(u) over (partition by person_id order by node)/sum(u) over (partition by person_id) as upto from e)"
DRAWS = f"{A1}, {BANK}, dr as (select cast(i as int) as draw, 0.1::double*i-0.2::double as shift from range(5) t(i)), ll as (select draw, person_id, sum(case when resp=1 then ln(p) else ln(1-p) end) as ll from (select draw, person_id, resp, least(greatest(1/(1+exp(-(a*((n_r-1.0::double)/1.5::double-b-shift)))),1e-10),1-1e-10) as p from (select *, sum(resp) over (partition by person_id) as n_r from r) join bank using (item_id), dr) group by 1,2)"
PVS = f"{POST}, pv as (select person_id, cast(k as int) as draw, coalesce(min(node) filter (upto >= uu), max(node)) as theta from (select c.*, k, {u('c.person_id', 'k', '2')} as uu from cdf c, range(5) t(k)) group by 1,2)"

ORACLES = {
    "irt_score_ml": halving("s1"),
    "irt_score_map": halving("s1 - mid", "1"),
    "irt_score_wle": halving("s1 + s3/(2*s2)"),
    "irt_score_by_sum": f"with {A1}, t as ({FIRST['irt_eap_by_sum']}), sc as (select person_id, cast(sum(resp) as int) as score from r group by 1) select person_id, theta, se from sc join t using (score)",
    "irt_eap_with_missing": f"with {A1.replace('r as (', 'r0 as (')}, r as (select person_id, item_id, case when person_id%10=7 or (person_id%10=3 and item_id%2=1) then null else resp end as resp from r0), {BANK}, {QUAD}, l as (select person_id, node, ln(max(w)) + coalesce(sum(case when resp=1 then ln(least(greatest({P},1e-10),1-1e-10)) when resp=0 then ln(1-least(greatest({P},1e-10),1-1e-10)) end),0) as ll from r join bank using (item_id), quad group by 1,2), e as (select person_id, node, exp(ll - max(ll) over (partition by person_id)) as u from l), m as (select person_id, sum(u*node)/sum(u) as theta from e group by 1) select person_id, round(max(theta),6)+0.0 as theta, round(sqrt(sum(u*(node-theta)^2)/sum(u)),6) as se from e join m using (person_id) group by 1",
    "irt_link_by_curves": f"with {BANK}, o as (select b as bo, b*1.25-0.3 as bn from bank), k as (select stddev_samp(bo)/stddev_samp(bn) as s, avg(bo) as mo, avg(bn) as mn, count(*) as n from o) select m as method, round(s,5) as slope, round(mo-s*mn,5) as shift, n as n_anchors from k, (values ('mean_sigma'),('mean_mean'),('haebara'),('stocking_lord')) t(m)",
    "irt_chain_linking": "select cast(form as int) as form, round(slope::double,6) as slope, round(shift::double,6) as shift from (values (0, 1.25, -0.3), (1, 1.0, 0.0), (2, 1.25, -0.625)) t(form, slope, shift)",
    "irt_transformed_bank": f"with {BANK} select item_id, round(a/1.2::double,6) as a, round(1.2::double*b-0.4::double,6)+0.0 as b from bank",
    "irt_true_score_equating": f"with {BANK}, {FORM}, {TCC}, pn as (select e as x0, node as y0, lead(e) over (order by node) as x1, lead(node) over (order by node) as y1 from tn), th as (select s::double as score, y0+(s-x0)/(x1-x0)*(y1-y0) as theta from pn, range(1,7) t(s) where s >= x0 and s < x1), po as (select node as x0, e as y0, lead(node) over (order by node) as x1, lead(e) over (order by node) as y1 from tw) select score, round(theta,5)+0.0 as theta, round(y0+(theta-x0)/(x1-x0)*(y1-y0),5) as equated from th, po where theta >= x0 and theta < x1",
    "irt_equipercentile": f"with recursive {BANK}, {FORM}, {QUAD}, {WALK}, {WALK.replace('walk', 'walk2').replace('join bank', 'join form')}, o as (select score, (sum(p) over (order by score)-p/2)/sum(p) over () as rk from (select score, sum(w*p) as p from walk where k=7 group by 1)), n as (select score, (sum(p) over (order by score)-p/2)/sum(p) over () as rk from (select score, sum(w*p) as p from walk2 where k=7 group by 1)), g as (select rk, avg(score) as sc from o group by 1), pc as (select rk as x0, sc as y0, lead(rk) over (order by rk) as x1, lead(sc) over (order by rk) as y1 from g) select cast(n.score as int) as score, round(n.rk,5) as rank, round(coalesce(y0+(n.rk-x0)/(x1-x0)*(y1-y0), case when n.rk <= (select min(rk) from g) then (select min(sc) from g) else (select max(sc) from g) end),5)+0.0 as equated from n left join pc on n.rk >= x0 and n.rk < x1",
    "irt_equating_error": f"with {BANK}, {FORM}, gd as (select -4 + 8*i/80.0::double as node from range(81) t(i)), v as (select node, sum({P}*(1-{P})) as v from gd, bank group by 1 union all select node, sum({P}*(1-{P})) from gd, form group by 1) select round(node,6)+0.0 as theta, round(sqrt(sum(v)),6) as see from v group by node",
    "irt_theta_to_scores": f"with {BANK}, gd as (select 0.5::double*i-2 as node from range(9) t(i)) select node as theta, round(sum({P}),6) as score from gd, bank group by 1",
    "irt_difficulty_at": f"with {BANK} select item_id, round(b+ln(((0.7::double-0.1::double)/(1-0.1::double))/(1-(0.7::double-0.1::double)/(1-0.1::double)))/a,6)+0.0 as theta from bank",
    "irt_information_area": f"with {BANK}, gd as (select -4 + 8*i/80.0::double as node, case when i in (0,80) then 0.5 else 1 end as e from range(81) t(i)) select item_id, round(0.1*sum(e*a*a*{P}*(1-{P})),6) as area from gd, bank group by 1",
    "irt_simulate": f"with {SIMULATED} select item_id, cast(sum(case when {u('person_id', 'item_id', '9')} < 0.1::double+0.9::double*(1/(1+exp(-(a*(theta-b))))) then 1 else 0 end) as bigint) as n_right, count(*) as n from pp, bank group by 1",
    "irt_simulate_graded": f"with {SIMULATED}, x as (select item_id, {u('person_id', 'item_id', '9')} as uu, a, b, theta from pp, bank) select item_id, cast((uu < 1/(1+exp(-(a*(theta-b+0.5)))))::int + (uu < 1/(1+exp(-(a*(theta-b)))))::int + (uu < 1/(1+exp(-(a*(theta-b-0.5)))))::int as int) as resp, count(*) as n from x group by 1, 2",
    "irt_bootstrap_difficulty": f"with {A1}, pe as (select distinct person_id from r), po as (select i, exp(-1::double)/gamma(i+1) as q from range(12) t(i)), cu as (select sum(q) over (order by i) as s from po), w0 as (select person_id, k, {u('person_id', 'k', '3')} as uu from pe, range(12) t(k)), w as (select person_id, k, count(*) filter (uu >= s) as wt from w0, cu group by 1,2), m as (select item_id, k, sum(wt*resp)/sum(wt)::double as m from r join w using (person_id) group by 1,2), g as (select item_id, stddev_samp(m) as se, quantile_cont(m, 0.025) as low, quantile_cont(m, 0.975) as high from m group by 1) select item_id, round((select avg(resp) from r where r.item_id = g.item_id),6) as difficulty, round(se,6) as se, round(low,6) as low, round(high,6) as high from g",
    "irt_impute_from_model": f"with {A1}, {BANK}, th as (select person_id, (sum(resp)-1.0::double)/1.5::double as theta from r group by 1), ce as (select th.person_id, bank.item_id, k, resp, {u('th.person_id', 'bank.item_id', 'k', '4')} < 1/(1+exp(-(a*(theta-b)))) as draw from th cross join bank cross join range(3) t(k) left join r on r.person_id=th.person_id and r.item_id=bank.item_id) select item_id, cast(k as int) as imputation, resp is null as imputed, count(*) as n, cast(sum(coalesce(resp, draw::int)) as bigint) as n_right from ce group by 1,2,3",
    "irt_plausible_statistics": f"with {PVS}, st as (select draw, avg(theta) as q, var_samp(theta)/count(*) as v from pv group by 1) select count(*) as n_draws, round(avg(q),6)+0.0 as mean, round(avg(v),6) as within, round(var_samp(q),6) as between, round(sqrt(avg(v)+(1+1.0::double/count(*))*var_samp(q)),6) as se from st",
    "irt_plausible_regression": f"with {PVS}, y as (select person_id, count(resp)::double as y from r group by 1), st as (select draw, regr_slope(y, theta) as s, regr_intercept(y, theta) as i, (regr_syy(y,theta)-regr_slope(y,theta)*regr_sxy(y,theta))/(count(*)-2)/regr_sxx(y,theta) as v from pv join y using (person_id) group by 1) select count(*) as n_draws, round(avg(s),6)+0.0 as slope, round(avg(i),6)+0.0 as intercept, round(sqrt(avg(v)+(1+1.0::double/count(*))*var_samp(s)),6) as se_slope from st",
    "irt_pointwise_likelihood": f"with {DRAWS} select draw, count(*) as n, round(sum(ll),4) as ll from ll group by 1",
    "irt_waic": f"with {DRAWS}, o as (select person_id, ln(avg(exp(ll))) as lp, var_samp(ll) as v from ll group by 1) select count(*) as n, round(sum(lp),4) as lppd, round(sum(v),4) as p_waic, round(-2*(sum(lp)-sum(v)),4) as waic, round(2*sqrt(count(*)*var_pop(lp-v)),4) as se from o",
    "irt_dic": f"with {DRAWS}, t as (select draw, sum(ll) as ll from ll group by 1), m as (select avg(ll) as a, max(ll) filter (draw=2) as c from t) select round(-2*c+2*2*(c-a),4) as dic, round(2*(c-a),4) as p_dic from m",
    "irt_posterior_summary": "select event_type as param, count(*) as n, round(avg(x),6) as mean, round(stddev_samp(x),6) as sd, round(quantile_cont(x,0.025),6) as low, round(quantile_cont(x,0.975),6) as high from (select event_type, case when value > 35 then 1.0::double else 0.0::double end as x from events) group by 1",
}


def expected_counts(spark, d):
    """One step of a calibration at given parameters: expected answers by item, category and node."""
    import numpy as np

    from latentia.functions.special import normal_quadrature
    from latentia.operators import models
    from latentia.operators.calibrate import weighted_patterns

    x, w = normal_quadrature(21)
    curves = []
    for i in range(1, 8):
        a, b = 0.6 + 0.2 * i, -1.5 + 0.5 * i
        above = [1 / (1 + np.exp(-a * (x - b - s))) for s in (-0.5, 0.0, 0.5)]
        curves.append(np.log(np.clip(-np.diff(np.vstack([np.ones(21), *above, np.zeros(21)]), axis=0), 1e-10, 1 - 1e-10)))
    counts, _ = models.expected_counts(weighted_patterns(src.graded(spark, d)), list(range(1, 8)), curves, w)
    rows = [(i + 1, c, q, float(counts[i, c, q])) for i in range(7) for c in range(4) for q in range(21)]
    return rounded(spark.createDataFrame(rows, "item_id int, category int, node int, n double"), "n", digits=4)


def calibrated_models(spark, d):
    """Parameters of the answers under the one-parameter and the partial credit model, whether the fit converged beside them; rows only, as EM has no SQL form."""
    from latentia.operators import models

    out = None
    for m, r in (("1PL", src.dichotomous(spark, d)), ("PCM", src.graded(spark, d))):
        f = models.fit(r, m)
        one = f.table(spark).withColumns({"model": F.lit(m), "converged": F.lit(f.converged)})
        out = one if out is None else out.unionByName(one)
    return rounded(out, "value", digits=3)


def adaptive_sessions(spark, d):
    """Simulated sessions of 300 persons on a drawn bank; rows only."""
    from latentia.operators import cat

    persons = sim.abilities(spark, 300, 8)
    return rounded(cat.simulate(persons, sim.item_parameters(spark, 200, "2PL", seed=4), 1).drop("items", "answers"), "true_theta", "theta", "se")


def smoothed_mastery(spark, d):
    from latentia.streaming import smoothing

    t = smoothing.trace_back(smoothing.sequences(src.trials(spark, d)))
    return rounded(t.select("person_id", "skill", F.size("path").alias("n"), "log_likelihood", F.element_at("mastery", 1).alias("first"), F.element_at("mastery", -1).alias("last")), "log_likelihood", "first", "last")


QUERIES |= {f"irt_{f.__name__}": f for f in (expected_counts, calibrated_models, adaptive_sessions, smoothed_mastery)}

_PR = "pr as (select person_id, item_id, resp, q, node, w, least(greatest(case when resp=0 then 1 else 1/(1+exp(-(a*(node-(b-1.0::double+0.5::double*resp))))) end - case when resp=3 then 0 else 1/(1+exp(-(a*(node-(b-0.5::double+0.5::double*resp))))) end,1e-10),1-1e-10) as p from g join bank using (item_id), qn)"
ORACLES |= {
    "irt_expected_counts": f"with {A1.replace('r as', 'r_ as')}, g as (select l_orderkey as person_id, cast(l_linenumber as int) as item_id, cast(least(floor(min(l_quantity)/12.6), 3) as int) as resp from lineitem group by 1, 2), {BANK}, {QUAD}, qn as (select cast(row_number() over (order by node)-1 as int) as q, node, w from quad), {_PR}, l as (select person_id, q, ln(max(w))+sum(ln(p)) as ll from pr group by 1,2), e as (select person_id, q, exp(ll-max(ll) over (partition by person_id)) as u from l), po as (select person_id, q, u/sum(u) over (partition by person_id) as u from e), s as (select item_id, resp, q, sum(u) as n from g join po using (person_id) group by 1,2,3) select i.i::int as item_id, c.c::int as category, n.n::int as node, round(coalesce(s.n,0),4)+0.0 as n from range(1,8) i(i), range(4) c(c), range(21) n(n) left join s on s.item_id=i.i and s.resp=c.c and s.q=n.n",
    "irt_smoothed_mastery": "with recursive e as (select user_id as person_id, event_type as skill, case when value > 35 then 1 else 0 end as x, row_number() over (partition by user_id, event_type order by ts, event_id) as k, count(*) over (partition by user_id, event_type) as n from events), "
    "f(person_id, skill, k, a0, a1, ll) as (select person_id, skill, 0::bigint, 0.7::double, 0.3::double, 0.0::double from e where k=1 union all select person_id, skill, k, u0/(u0+u1), u1/(u0+u1), ll+ln(u0+u1) from (select f.person_id, f.skill, e.k, f.ll, (case when e.k=1 then a0 else a0*0.8::double+a1*0.02::double end)*case when x=1 then 0.2::double else 0.8::double end as u0, (case when e.k=1 then a1 else a0*0.2::double+a1*0.98::double end)*case when x=1 then 0.9::double else 0.1::double end as u1 from f join e on e.person_id=f.person_id and e.skill=f.skill and e.k=f.k+1)), "
    "b(person_id, skill, k, b0, b1) as (select person_id, skill, n, 1.0::double, 1.0::double from e where k=n union all select person_id, skill, k, c0/(c0+c1), c1/(c0+c1) from (select b.person_id, b.skill, b.k-1 as k, 0.8::double*l0*b0+0.2::double*l1*b1 as c0, 0.02::double*l0*b0+0.98::double*l1*b1 as c1 from (select b.*, case when x=1 then 0.2::double else 0.8::double end as l0, case when x=1 then 0.9::double else 0.1::double end as l1 from b join e using (person_id, skill, k)) b where b.k > 1)), "
    "s as (select f.person_id, f.skill, f.k, ll, a1*b1/(a0*b0+a1*b1) as m from f join b using (person_id, skill, k)) select person_id, skill, cast(max(k) as int) as n, round(arg_max(ll, k),6)+0.0 as log_likelihood, round(arg_min(m, k),6)+0.0 as first, round(arg_max(m, k),6)+0.0 as last from s group by 1,2",
}
