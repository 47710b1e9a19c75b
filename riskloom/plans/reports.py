"""Full metrics, significance, run and join checks, and the report tables, as SQL over the other plans' CTEs."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions.dialect import Duck, Spark
from riskloom.operators.statistics import mcnemar_column, t_column
from riskloom.plans.agreement import cells, consolidated, sources, tallies
from riskloom.plans.models import CLASS, fold_scores, folds, predictions
from riskloom.plans.scoring import FACTORS, banded, documents, factor_rows, points, ranked, totals
from riskloom.sources.tables import views

CLASSES = ("low", "medium", "high")
#: Significance level, practical margin, and the family compared with TF-IDF.
ALPHA, MARGIN, FAMILY = 0.05, 0.02, ("hubert", "e5", "bge_m3", "qwen3_8b")
#: 97.5 % quantile of Student's t with 24 degrees of freedom (25 paired folds).
T_24 = 2.0638985616280205
#: Points an expert may give, by factor; all others may have 0 to 3.
ALLOWED = {"fin_form": (1, 2, 3), "konzorcium": (0, 3), "egysz_elszam": (0, 3), "biztositek": (0, 3), "tam_tevekenyseg": (0, 2, 3)}


#: Slices of scores (0 to 1) and of counts within which Spark adds up.
LOTS = 1024


def t_two_sided(t: str, df: int = 24) -> str:
    """Two-sided p of t for an even number of degrees of freedom: a finite series in the cosine of its angle."""
    cos2 = f"(1 / (1 + {t} * {t} / {df}e0))"
    series = "cast(1 as double)"
    for k in range(df // 2 - 1, 0, -1):
        series = f"(1 + {(2 * k - 1)}e0 / {2 * k}e0 * {cos2} * {series})"
    return f"greatest(cast(0 as double), 1 - sin(atan(abs({t}) / sqrt({df}e0))) * {series})"


def scoped(D) -> str:
    """CTE sc: every prediction in its pooled, repeat and fold scope."""
    if D.idiv == "div":
        return f"""{predictions(D)},
sc as (select model, explode(array('pooled', concat('repeat:', rep), concat('fold:', rep, '.', fold))) scope, doc_id, label, predicted, p_low, p_medium, p_high from pred)"""
    return f"""{predictions(D)},
sc as (select model, 'pooled' scope, doc_id, label, predicted, p_low, p_medium, p_high from pred
  union all select model, concat('repeat:', cast(rep as varchar(5))), doc_id, label, predicted, p_low, p_medium, p_high from pred
  union all select model, concat('fold:', cast(rep as varchar(5)), '.', cast(fold as varchar(5))), doc_id, label, predicted, p_low, p_medium, p_high from pred)"""


def aucs(D) -> str:
    """CTEs ovr, ovo: rank-sum AUC of each class against the rest, and of each ordered pair of classes.

    Spark counts the classes at each score once for all AUCs and adds them up within LOTS slices of the scores, so no task ranks a scope."""
    if D.idiv == "div":
        n = {c: f"count(case when label = '{c}' then 1 end) n_{c}" for c in CLASSES}
        scores = ", ".join(f"struct('{c}' cls, p_{c} p)" for c in CLASSES)
        each_of = lambda make: ", ".join(map(make, CLASSES))
        rank_sum = lambda a, others: f"cast(sum(n_{a} * (2 * ({' + '.join(f'less_{c}' for c in others)}) + {' + '.join(f'n_{c}' for c in others)} + 1)) as bigint)"
        area = lambda a, rest: f"case when {a} > 0 and {rest} > 0 then cast(u.s - {a} * ({a} + 1) as double) / (2.0 * {a} * {rest}) end auc"
        one = lambda a: f"struct(0 kind, '{a}' cls, all_{a} np, {' + '.join(f'all_{x}' for x in CLASSES if x != a)} nn, s_{a} s)"
        two = lambda a: ", ".join(f"struct(1 kind, '{a}-{b}' cls, all_{a} np, all_{b} nn, s_{a}_{b} s)" for b in CLASSES if a != b)
        every = " ".join(f"when '{c}' then array({one(c)}, {two(c)})" for c in CLASSES)
        return f"""dealt_ as (select model, scope, label, x.cls, x.p, cast(floor(x.p * {LOTS}) as int) lot from (select model, scope, label, explode(array({scores})) x from sc) z distribute by model, scope, cls, lot),
at_ as (select model, scope, cls, lot, p, {each_of(n.get)} from dealt_ group by model, scope, cls, lot, p),
lot_ as (select model, scope, cls, lot, {each_of(lambda c: f'sum(n_{c}) over (w) - n_{c} before_{c}')} from (select model, scope, cls, lot, {each_of(lambda c: f'sum(n_{c}) n_{c}')} from at_ group by model, scope, cls, lot) z window w as (partition by model, scope, cls order by lot)),
less_ as (select model, scope, cls, lot, {each_of(lambda c: f'n_{c}')}, {each_of(lambda c: f'before_{c} + sum(n_{c}) over (w) - n_{c} less_{c}')} from at_ join lot_ using (model, scope, cls, lot) window w as (partition by model, scope, cls, lot order by p)),
sums_ as (select model, scope, cls, {each_of(lambda c: f'cast(sum(n_{c}) as bigint) all_{c}')}, {each_of(lambda c: f'{rank_sum(c, CLASSES)} s_{c}')}, {', '.join(f'{rank_sum(a, (a, b))} s_{a}_{b}' for a in CLASSES for b in CLASSES if a != b)} from less_ group by model, scope, cls),
each_ as (select model, scope, u.kind, u.cls, {area('u.np', 'u.nn')} from (select model, scope, explode(case cls {every} end) u from sums_) z where u.kind = 0 or u.np + u.nn > 0),
ovr as (select model, scope, cls, auc from each_ where kind = 0),
ovo as (select model, scope, cls, auc from each_ where kind = 1)"""
    each = " union all ".join(f"select model, scope, '{c}' cls, p_{c} p, case when label = '{c}' then 1 else 0 end y from sc" for c in CLASSES)
    pairs = " union all ".join(f"select model, scope, '{a}-{b}' cls, p_{a} p, case when label = '{a}' then 1 else 0 end y from sc where label in ('{a}', '{b}')" for a in CLASSES for b in CLASSES if a != b)

    def area(name: str, rows: str) -> str:
        return f"""{name}_r as (select model, scope, cls, y, 2 * rank() over (partition by model, scope, cls order by p) + count(*) over (partition by model, scope, cls, p) - 1 r2 from ({rows}) z),
{name}_s as (select model, scope, cls, cast(sum(y) as bigint) np, cast(sum(1 - y) as bigint) nn, cast(sum(case when y = 1 then r2 else 0 end) as bigint) s from {name}_r group by model, scope, cls),
{name} as (select model, scope, cls, case when np > 0 and nn > 0 then cast(s - np * (np + 1) as double) / (2.0 * np * nn) end auc from {name}_s)"""

    return area("ovr", each) + ",\n" + area("ovo", pairs)


def nine(D) -> str:
    cells_ = ", ".join(f"count(case when label = '{a}' and predicted = '{b}' then 1 end) n{i}{j}" for i, a in enumerate(CLASSES) for j, b in enumerate(CLASSES))
    return f"nine as (select model, scope, count(*) n, {cells_} from sc group by model, scope)"


def metrics(D) -> str:
    """CTE met: every classification figure of a scope, one row each; undefined ones are null with a flag."""
    row, col = [f"(n{i}0 + n{i}1 + n{i}2)" for i in range(3)], [f"(n0{i} + n1{i} + n2{i})" for i in range(3)]
    share = lambda a, b, other: f"case when {b} = 0 then {other} else cast({a} as double) / {b} end"
    prec, rec = [share(f"n{i}{i}", col[i], "0e0") for i in range(3)], [share(f"n{i}{i}", row[i], "0e0") for i in range(3)]
    f1 = [share(f"(2 * n{i}{i})", f"({row[i]} + {col[i]})", "0e0") for i in range(3)]
    spec = [share(f"(n - {row[i]} - {col[i]} + n{i}{i})", f"(n - {row[i]})", "null") for i in range(3)]
    observed = " + ".join(f"{(i - j) ** 2} * n{i}{j}" for i in range(3) for j in range(3) if i != j)
    expected = " + ".join(f"{(i - j) ** 2} * {row[i]} * {col[j]}" for i in range(3) for j in range(3) if i != j)
    per = [f"{x} {name}_{c}" for i, c in enumerate(CLASSES) for name, x in (("precision", prec[i]), ("recall", rec[i]), ("f1", f1[i]), ("specificity", spec[i]), ("support", row[i]))]
    macro = [f"({x[0]} + {x[1]} + {x[2]}) / 3 {name}_macro" for name, x in (("precision", prec), ("recall", rec), ("f1", f1))]
    by_class = ", ".join(f"max(case when cls = '{c}' then auc end) auc_{c}" for c in CLASSES)
    return f"""{scoped(D)}, {nine(D)}, {aucs(D)},
wide_auc as (select model, scope, {by_class}, case when count(auc) = 3 then avg(auc) end auc_ovr from ovr group by model, scope),
pair_auc as (select model, scope, case when count(auc) = 6 then avg(auc) end auc_ovo from ovo group by model, scope),
met as (select c.*, cast(n00 + n11 + n22 as double) / n accuracy, {', '.join(per)}, {', '.join(macro)}, auc_low, auc_medium, auc_high, auc_ovr, auc_ovo,
  case when {expected} > 0 then 1 - cast(n * ({observed}) as double) / ({expected}) end kappa, n20 err_m2, n10 + n21 err_m1, n00 + n11 + n22 err_0, n01 + n12 err_p1, n02 err_p2, cast(n20 + n02 as double) / n error2_share,
  case when auc_ovr is null then 'a class is empty' end flag_auc, case when {col[0]} = 0 or {col[1]} = 0 or {col[2]} = 0 then 'a class is never predicted' end flag_precision
  from nine c join wide_auc w on c.model = w.model and c.scope = w.scope join pair_auc p on c.model = p.model and c.scope = p.scope)"""


FIGURES = ["accuracy", *(f"{k}_{c}" for c in (*CLASSES, "macro") for k in ("precision", "recall", "f1")), *(f"specificity_{c}" for c in CLASSES), *(f"auc_{c}" for c in CLASSES), "auc_ovr", "auc_ovo", "kappa", "error2_share"]
SHOWN = ", ".join(["model", "scope", "n", *(f"n{i}{j}" for i in range(3) for j in range(3)), *(f"round({x}, 9) {x}" for x in FIGURES), *(f"support_{c}" for c in CLASSES), "err_m2", "err_m1", "err_0", "err_p1", "err_p2", "flag_auc", "flag_precision"])


def summary(D) -> str:
    names, value = ", ".join(f"('{x}')" for x in FIGURES), " ".join(f"when '{x}' then {x}" for x in FIGURES)
    return f"""{metrics(D)}, long as (select model, scope, name, case name {value} end value from met cross join (select * from (values {names}) as x(name)) x),
lev as (select model, name, value, case when scope like 'fold:%' then 'fold' else 'repeat' end level from long where scope <> 'pooled'),
summ as (select model, name, level, avg(value) mean, stddev_samp(value) sd, count(value) n, count(*) scopes from lev group by model, name, level)"""


def compared(D) -> str:
    """CTE cmp: the best model's folds against each other model's, corrected t test, Holm over all."""
    return f"""{fold_scores(D)},
size_ as (select model, avg(cast(n as double) / (total - n)) ratio from (select model, rep, fold, n, sum(n) over (partition by model, rep) total from f) z group by model),
mean_ as (select model, round(avg(f1), 12) f1 from f group by model),
best_ as (select min(model) model from mean_ where model <> 'majority' and f1 = (select max(f1) from mean_ where model <> 'majority')),
{tested('select o.model, x.f1 - o.f1 d from f x join best_ b on x.model = b.model join f o on o.rep = x.rep and o.fold = x.fold and o.model <> b.model')}"""


def tested(pairs: str) -> str:
    """CTEs dif, tst, holm_: mean, t, p, interval and Holm's p of paired differences (model, d); size_ has the ratios."""
    return f"""dif as ({pairs}),
raw_ as (select dif.model, count(*) n, avg(d) mean, var_samp(d) v, max(ratio) ratio from dif join size_ on dif.model = size_.model group by dif.model),
tst as (select model, n, mean, sqrt(v) sd, sqrt((1e0 / n + ratio) * v) se, case when v > 1e-20 then mean / sqrt((1e0 / n + ratio) * v) end t from raw_),
pv as (select *, case when t is null then case when abs(mean) > 1e-12 then 0e0 else 1e0 end else {t_two_sided('t')} end p, mean - {T_24!r} * se ci_low, mean + {T_24!r} * se ci_high from tst),
ord_ as (select *, row_number() over (order by p, model) k, count(*) over () m from pv),
holm_ as (select *, max(least(1e0, (m - k + 1) * p)) over (order by k) p_holm from ord_)"""


def against_tfidf(D) -> str:
    family = ", ".join(f"'{m}'" for m in FAMILY)
    return f"""{fold_scores(D)},
size_ as (select model, avg(cast(n as double) / (total - n)) ratio from (select model, rep, fold, n, sum(n) over (partition by model, rep) total from f) z group by model),
{tested(f"select x.model, x.f1 - y.f1 d from f x join f y on y.model = 'tfidf' and x.rep = y.rep and x.fold = y.fold where x.model in ({family})")},
outc as (select *, case when p_holm < {ALPHA} then case when mean > 0 then 'embedding_outperforms' else 'tfidf_outperforms' end when ci_low >= -{MARGIN} and ci_high <= {MARGIN} then 'practically_equivalent' else 'inconclusive' end outcome,
  case when p_holm < {ALPHA} and ci_low >= -{MARGIN} and ci_high <= {MARGIN} then 'practically negligible' when p_holm >= {ALPHA} and (ci_low > 0 or ci_high < 0) and not (ci_low >= -{MARGIN} and ci_high <= {MARGIN}) then 'the unadjusted interval excludes 0' end note from holm_)"""


TEST = "model, n, round(mean, 9) mean, round(sd, 9) sd, round(t, 6) t, round(p, 8) p, round(ci_low, 9) ci_low, round(ci_high, 9) ci_high, round(p_holm, 8) p_holm"


def curves(D) -> str:
    """CTE points_: each class's ROC on a grid of 201 points: top of vertical rises, straight lines between.

    Spark adds up, and looks for the next point, within LOTS slices of scores and of counts, and makes a segment's own grid points alone."""
    if D.idiv == "div":
        scores = ", ".join(f"struct('{c}' cls, p_{c} p, int(label = '{c}') y)" for c in CLASSES)
        return f"""{predictions(D)}, dealt_ as (select model, u.cls, u.p, u.y, cast(floor(u.p * {LOTS}) as int) lot from (select model, explode(array({scores})) u from pred) z distribute by model, cls, lot),
cv as (select model, cls, lot, p, cast(sum(y) as bigint) y, cast(sum(1 - y) as bigint) x from dealt_ group by model, cls, lot, p),
lot_ as (select model, cls, lot, sum(y) over (w) - y y0, sum(x) over (w) - x x0, sum(y) over (partition by model, cls) np, sum(x) over (partition by model, cls) nn from (select model, cls, lot, sum(y) y, sum(x) x from cv group by model, cls, lot) z window w as (partition by model, cls order by lot desc)),
cu as (select model, cls, y0 + sum(cv.y) over (w) tp, x0 + sum(cv.x) over (w) fp, np, nn from cv join lot_ using (model, cls, lot) window w as (partition by model, cls, lot order by p desc)),
vx as (select model, cls, tp, fp, np, nn from cu union all select distinct model, cls, 0L, 0L, np, nn from lot_),
st as (select model, cls, fp, np, nn, max(tp) top, min(tp) bottom, cast(fp * {LOTS} div (nn + 1) as int) lot from vx group by model, cls, fp, np, nn),
next_ as (select model, cls, lot, lead(first_) over (partition by model, cls order by lot) next_ from (select model, cls, lot, min(struct(fp, bottom)) first_ from st group by model, cls, lot) z),
sg as (select model, cls, fp, np, nn, top, coalesce(lead(struct(fp, bottom)) over (partition by model, cls, lot order by fp), next_) after_ from st join next_ using (model, cls, lot)),
gr as (select *, after_.fp fp2, after_.bottom tp2, (200 * fp + nn - 1) div nn lo, case when after_ is null then 200L else (200 * after_.fp + nn - 1) div nn - 1 end hi from sg where np > 0 and nn > 0),
points_ as (select model, cls, id g, case when id * nn = 200 * fp or fp2 is null then cast(top as double) / np else (top + cast((id * nn - 200 * fp) as double) / (200 * (fp2 - fp)) * (tp2 - top)) / np end tpr from gr lateral view explode(sequence(lo, hi)) g_ as id where lo <= hi)"""
    each = " union all ".join(f"select model, '{c}' cls, p_{c} p, case when label = '{c}' then 1 else 0 end y from pred" for c in CLASSES)
    grid = "select explode(sequence(0, 200)) id" if D.idiv == "div" else "select unnest(generate_series(0, 200)) id"
    return f"""{predictions(D)}, u as ({each}), cv as (select model, cls, p, cast(sum(y) as bigint) y, cast(sum(1 - y) as bigint) x from u group by model, cls, p),
cu as (select model, cls, cast(sum(y) over (partition by model, cls order by p desc) as bigint) tp, cast(sum(x) over (partition by model, cls order by p desc) as bigint) fp, cast(sum(y) over (partition by model, cls) as bigint) np, cast(sum(x) over (partition by model, cls) as bigint) nn from cv),
vx as (select model, cls, tp, fp, np, nn from cu union select model, cls, cast(0 as bigint), cast(0 as bigint), max(np), max(nn) from cu group by model, cls),
st as (select model, cls, fp, np, nn, max(tp) top, min(tp) bottom from vx group by model, cls, fp, np, nn),
sg as (select *, lead(fp) over (partition by model, cls order by fp) fp2, lead(bottom) over (partition by model, cls order by fp) tp2 from st),
points_ as (select model, cls, cast(id as bigint) g, case when id * nn = 200 * fp or fp2 is null then cast(top as double) / np else (top + cast((id * nn - 200 * fp) as double) / (200 * (fp2 - fp)) * (tp2 - top)) / np end tpr from sg join ({grid}) gr on id * nn >= 200 * fp and (fp2 is null or id * nn < 200 * fp2) where np > 0 and nn > 0)"""


def run_table(D) -> str:
    """CTE runs_: a run for each model, repeat and fold, some failed."""
    return "runs_ as (select distinct model, rep, fold, mno, case when (7 * mno + 3 * rep + fold) % 11 = 0 then 'failed' else 'complete' end status from pred)"


def texts(D) -> str:
    """CTE tx: documents with their text's hash and status."""
    return f"tx as (select doc_id, source, lang, text, {D.sha256('text')} sha, case when length(trim(text)) < 40 then 'failed' else 'ok' end status from documents where text is not null)"


def pins(D) -> str:
    return f"{texts(D)}, first_ as (select sha, min(doc_id) doc_id from tx group by sha), pins_ as (select concat('call ', cast(doc_id as varchar(20))) name, case when doc_id % 7 = 0 then concat('0', substr(sha, 2, 63)) else sha end sha from first_ where doc_id % 5 = 0), gold_ as (select concat('call ', cast(doc_id as varchar(20))) name from first_ where doc_id % 10 = 0)"


def dataset(D) -> str:
    """CTE wide_: a document's ten values, points and origins beside its totals and labels."""
    per = ", ".join(f"max(case when factor = '{f}' then v end) {f}_value, max(case when factor = '{f}' then points end) {f}_points, max(case when factor = '{f}' then origin end) {f}_origin" for f in FACTORS)
    return f"{ranked(D)}, wide_ as (select doc_id, {per} from pts group by doc_id), place_ as (select num, 1 + coalesce(cast(sum(m) over (order by num desc rows between unbounded preceding and 1 preceding) as bigint), 0) place from scores)"


def chosen(D) -> str:
    """CTE docs_: documents with the best model's votes, for the tables about errors."""
    return f"""{predictions(D)}, v_ as (select doc_id, label, predicted, rep, {CLASS.format(x='predicted')} - {CLASS.format(x='label')} size from pred where model = 'e5'),
docs_ as (select doc_id, max(label) label, count(*) repeats, count(case when predicted <> label then 1 end) wrong from v_ group by doc_id),
kinds_ as (select d.doc_id, 'low_coverage' kind, case when doc_id % 9 < 2 then 'yes' else 'no' end grp, 0 kno, repeats, wrong from docs_ d union all select doc_id, 'imputed_factors', cast(doc_id % 3 as varchar(5)), 1, repeats, wrong from docs_
  union all select d.doc_id, 'period', x.lang, 2, repeats, wrong from docs_ d join documents x on d.doc_id = x.doc_id union all select d.doc_id, 'programme', x.source, 3, repeats, wrong from docs_ d join documents x on d.doc_id = x.doc_id)"""


def explained(D) -> str:
    """CTE ex: results of analyses by representation, classifier, target, setting, metric and fold."""
    return f"{fold_scores(D)}, ex as (select case when mno % 2 = 0 then 'factor_probe' else 'learning_curve' end analysis, model representation, case when rep % 2 = 0 then 'logreg' else 'svm' end classifier, 'tercile' target, case when fold < 3 then 'full' else 'half' end setting, 'macro_f1' metric, f1 value from f union all select 'context_length', model, 'logreg', 'tercile', 'full', 'folds', cast(n as double) from f)"


SQL = {
    # metrics, scopes, summaries
    "classification_all_scopes": lambda D: f"with {metrics(D)} select {SHOWN} from met",
    "summary_all_metrics": lambda D: f"with {summary(D)} select model, name, level, round(mean, 9) mean, round(sd, 9) sd, n, case when n < scopes then concat('over ', cast(n as varchar(9)), ' of ', cast(scopes as varchar(9)), '; the others are undefined') end flag from summ",
    "class_scopes": lambda D: f"with {metrics(D)} " + " union all ".join(f"select model, '{c}' class, round(precision_{c}, 9) prec, round(recall_{c}, 9) recall, round(f1_{c}, 9) f1, round(specificity_{c}, 9) specificity, round(auc_{c}, 9) auc, support_{c} / 5e0 documents, " + ", ".join(f"n{i}{j} / 5e0 as_{p}, round(case when support_{c} > 0 then cast(n{i}{j} as double) / support_{c} end, 9) share_{p}" for j, p in enumerate(CLASSES)) + " from met where scope = 'pooled'" for i, c in enumerate(CLASSES)),
    "auc_every_class": lambda D: f"with {scoped(D)}, {aucs(D)} select model, scope, cls, round(auc, 9) auc from ovr union all select model, scope, cls, round(auc, 9) from ovo",
    "roc_curves": lambda D: f"with {curves(D)} select model, cls, g, round(tpr, 9) tpr from points_ union all select model, 'macro', g, round(avg(tpr), 9) from points_ group by model, g having count(*) = 3",
    # significance
    "significance": lambda D: f"with {compared(D)} select b.model reference, {TEST.replace('model, ', 'h.model, ', 1)} from holm_ h cross join best_ b",
    "tfidf_comparison": lambda D: f"with {against_tfidf(D)} select {TEST}, outcome, note from outc",
    "tfidf_verdict": lambda D: f"with {against_tfidf(D)} select case when count(case when outcome = 'embedding_outperforms' then 1 end) > 0 then 'H1 supported' else 'H1 not supported' end verdict, count(*) comparisons, count(case when outcome = 'embedding_outperforms' then 1 end) supporting from outc",
    "corrected_t": lambda D: f"with {against_tfidf(D)} select model, n, round(mean, 9) mean, round(sd, 9) sd, round(t, 6) t, round(p, 8) p, round(ci_low, 9) ci_low, round(ci_high, 9) ci_high from holm_",
    "holm_stepdown": lambda D: f"with {against_tfidf(D)} select model, round(p, 8) p, round(p_holm, 8) p_holm from holm_",
    "outcome_classes": lambda D: f"with {against_tfidf(D)} select model, round(mean, 9) mean, round(ci_low, 9) ci_low, round(ci_high, 9) ci_high, round(p_holm, 8) p_holm, outcome, note from outc",
    # joins and checks
    "predictions_of_complete_runs": lambda D: f"with {predictions(D)}, {run_table(D)} select model, rep, cast(fold as bigint) fold, doc_id, predicted from pred join runs_ using (model, rep, fold, mno) where status = 'complete'",
    "features_without_vector": lambda D: "with feat as (select vec_id doc_id, concat('key-', cast(vec_id % 97 as varchar(9))) cache_key from embeddings), cache as (select distinct concat('key-', cast(vec_id % 97 as varchar(9))) cache_key from embeddings where vec_id % 97 < 90) select f.doc_id, f.cache_key, case when c.cache_key is null then 'missing' else 'ok' end state from feat f left join cache c on f.cache_key = c.cache_key",
    "factors_without_document": lambda D: f"with {sources(D)}, known as (select doc_id from docs where doc_id % 6 <> 0) select distinct o.doc_id from obs o where not exists (select 1 from known k where k.doc_id = o.doc_id)",
    "baseline_of_model": lambda D: f"""with {fold_scores(D)}, keyed as (select model, mno, case when mno % 3 = 0 then 'majority' else 'logreg' end classifier, avg(f1) f1 from f group by model, mno), first_ as (select min(model) model from keyed where classifier = 'majority')
select k.model, k.classifier, coalesce(s.model, first_.model) baseline, case when k.f1 <= coalesce(s.f1, b.f1) then 1 else 0 end not_above from keyed k cross join first_ join keyed b on b.model = first_.model left join keyed s on s.model = k.model and s.classifier = 'majority' where k.classifier <> 'majority'""",
    "gold_pins": lambda D: f"with {pins(D)} select coalesce(g.name, p.name) name, case when p.name is null then 'no pin' when g.name is null then 'unused pin' when f.doc_id is null then 'document not in the corpus' else 'ok' end state, f.doc_id from gold_ g full outer join pins_ p on g.name = p.name left join first_ f on f.sha = p.sha",
    "features_with_changed_text": lambda D: f"with {texts(D)}, feat as (select doc_id, case when doc_id % 50 = 0 then concat('0', substr(sha, 2, 63)) else sha end sha from tx where doc_id % 2 = 0) select t.doc_id, case when f.doc_id is null then 'no feature' when f.sha <> t.sha then 'text changed' else 'ok' end state from tx t left join feat f on f.doc_id = t.doc_id",
    "provenance_by_hash": lambda D: f"with {texts(D)}, old as (select sha, max_by(concat('https://example.org/', cast(doc_id as varchar(20))), doc_id) url from tx where doc_id % 3 <> 0 group by sha) select t.doc_id, o.url from tx t left join old o on t.sha = o.sha",
    "document_set": lambda D: f"with {texts(D)}, wanted as (select doc_id from tx where doc_id % 4 <> 3 union all select -1) select coalesce(t.doc_id, w.doc_id) doc_id, case when t.doc_id is null then 'not in the run' when w.doc_id is null then 'not asked for' when t.status <> 'ok' then concat('status ', t.status) else 'taken' end reason from tx t full outer join (select cast(doc_id as bigint) doc_id from wanted) w on t.doc_id = w.doc_id",
    "prediction_label_mismatch": lambda D: f"with {predictions(D)}, truth as (select doc_id, case when doc_id % 41 = 0 then 'high' else label end label from lab where doc_id % 37 <> 0), p as (select distinct model, doc_id, label from pred where doc_id % 43 <> 0) select p.model, coalesce(p.doc_id, t.doc_id) doc_id, case when t.doc_id is null then 'no label' when p.doc_id is null then 'no prediction' else 'other label' end problem from p full outer join truth t on p.doc_id = t.doc_id where t.doc_id is null or p.doc_id is null or p.label <> t.label",
    # projections
    "exact_numbers": lambda D: "with r as (select o_orderkey, case o_orderkey % 7 when 0 then 'abc' when 1 then 'nan' when 2 then '' when 3 then '30.01' when 4 then 'true' else cast(o_orderkey as varchar(20)) end raw from orders) select o_orderkey, raw, try_cast(case when raw in ('', 'true', 'nan') then null else raw end as decimal(28,10)) number from r",
    "fin_form_from_points": lambda D: f"with {points(D)}, p as (select doc_id, max(case when doc_id % 3 = 0 then null else fin_form end) value, max(case when factor = 'fin_form' then points end) given from pts group by doc_id) select doc_id, value, given, coalesce(value, case given when 3 then 'grant' when 2 then 'conditional_grant' when 1 then 'loan' end) fin_form from p",
    "points_not_allowed": lambda D: f"with {sources(D)}, ok as (select * from (values " + ", ".join(f"('{f}', {p})" for f in FACTORS for p in ALLOWED.get(f, (0, 1, 2, 3))) + ") as a(f, p)) select o.doc_id, o.factor, o.points from obs o left join ok on o.factor = ok.f and o.points = ok.p where o.source = 'manual' and o.points is not null and ok.f is null",
    "observed_points": lambda D: f"""with {sources(D)}, lone as (select doc_id, max(fin_form) fin_form, max(programme) programme from docs group by doc_id), o as (select s.source, d.doc_id, f.factor, f.ord, o.points given, o.doc_id seen, d.fin_form, d.programme from lone d cross join factors f cross join (select 'regex' source union all select 'llm') s left join obs o on o.source = s.source and o.doc_id = d.doc_id and o.factor = f.factor),
present as (select source, doc_id from obs group by source, doc_id)
select o.source, o.doc_id, o.factor, case when p.doc_id is null then null when o.factor = 'max_tam_int' and fin_form = 'loan' then 0 when given is null and o.factor = 'tam_osszeg' and programme = 'BUILDING' then 1 when given is null and o.factor = 'tam_osszeg' and programme = 'MACHINERY' then 2 else given end points,
case when p.doc_id is null then null when o.factor = 'max_tam_int' and fin_form = 'loan' then 'loan_rule' when given is null and o.factor = 'tam_osszeg' and programme in ('BUILDING', 'MACHINERY') then 'top_rule' when given is not null then 'given' end origin, case when p.doc_id is null then 'document_missing_from_run' end note from o left join present p on o.source = p.source and o.doc_id = p.doc_id""",
    "programme_family": lambda D: "with p as (select c_custkey, case c_custkey % 4 when 0 then ' rrf-1.2 ' when 1 then 'RRF reform' when 2 then lower(c_mktsegment) else concat(c_mktsegment, ' ') end raw from customer) select c_custkey, case when upper(trim(raw)) like 'RRF%' then 'RRF' else upper(trim(raw)) end family from p",
    "tercile_of_stored_cuts": lambda D: f"with {ranked(D)}, cut as (select max(case when tercile = 'low' then num end) last_low, max(case when tercile = 'medium' then num end) last_medium from labelled), other as (select doc_id, num + den % 7 - 3 num from totals) select o.doc_id, case when o.num <= last_low then 'low' when o.num <= last_medium then 'medium' else 'high' end tercile from other o cross join cut",
    "first_lines": lambda D: f"select doc_id, {D.join(D.slice(D.keep(D.map(D.split('text', chr(92) + 'n'), 'x', 'trim(x)'), 'x', 'length(x) > 0'), 1, 8), D.newline)} head from documents where text is not null",
    # ordered reports
    "source_order": lambda D: f"with {tallies(D)}, s as (select distinct source from tallies union all select 'old baseline' union all select 'manual' union all select 'llm:b') select source, cast(row_number() over (order by case when source = 'regex' then 0 when source like 'llm%' then 1 when source = 'old baseline' then 3 else 2 end, source) as bigint) place from s",
    "family_order": lambda D: "select model, cast(row_number() over (order by case when model in ('hubert', 'e5', 'bge_m3', 'qwen3_8b') then 0 else 1 end, case model when 'hubert' then 0 when 'e5' then 1 when 'bge_m3' then 2 when 'qwen3_8b' then 3 else 4 end, model) as bigint) place from (values ('tfidf'), ('qwen3_8b'), ('e5'), ('bge_m3'), ('hubert'), ('ada')) as m(model)",
    "canonical_order": lambda D: "select model, cast(row_number() over (order by coalesce(place, 99), model) as bigint) place from (values ('zeta'), ('tfidf'), ('qwen3_8b'), ('e5'), ('alpha'), ('bge_m3'), ('hubert')) as m(model) left join (values ('tfidf', 0), ('hubert', 1), ('e5', 2), ('bge_m3', 3), ('qwen3_8b', 4)) as c(name, place) on model = name",
    # stage reports
    "conversion_report": lambda D: f"""with {texts(D)}, w as (select doc_id, status, case when length(text) < 8000 then 1 else 0 end low_text, case when {D.like('text', '[õûÕÛ]')} then 1 else 0 end suspect from tx)
select 'status' kind, status name, count(*) n from w group by status union all select 'warning', 'low_text', cast(sum(low_text) as bigint) from w where status = 'ok' union all select 'warning', 'suspect_encoding', cast(sum(suspect) as bigint) from w where status = 'ok'""",
    "explain_summaries": lambda D: f"with {explained(D)} select analysis, representation, classifier, target, setting, metric, round(avg(value), 9) mean, round(stddev_samp(value), 9) sd, count(*) n from ex group by analysis, representation, classifier, target, setting, metric",
    "label_agreement": lambda D: f"""with {sources(D)}, t as (select source, doc_id, cast(sum(points) as bigint) total from obs where points is not null group by source, doc_id), l as (select source, doc_id, total, case when floor((20 * total + 3) / 6e0) <= 33 then 0 when floor((20 * total + 3) / 6e0) <= 66 then 1 else 2 end label from t),
p as (select s.source, g.label a, s.label b, s.total - g.total diff from l g join l s on g.doc_id = s.doc_id and g.source = 'manual' and s.source <> 'manual'),
n_ as (select source, count(*) n, count(case when a = b then 1 end) agree, cast(sum(abs(diff)) as bigint) diff, {', '.join(f"count(case when b - a = {k} then 1 end) err_{'m' if k < 0 else 'p' if k > 0 else ''}{abs(k)}" for k in range(-2, 3))}, cast(sum((a - b) * (a - b)) as bigint) o from p group by source),
e_ as (select x.source, cast(sum((x.a - y.b) * (x.a - y.b) * x.m * y.m) as bigint) e from (select source, a, count(*) m from p group by source, a) x join (select source, b, count(*) m from p group by source, b) y on x.source = y.source group by x.source)
select n_.source, n, agree, err_m2, err_m1, err_0, err_p1, err_p2, round(cast(diff as double) / n, 9) mean_diff, case when e <> 0 then round(1 - cast(n * o as double) / e, 9) end kappa from n_ join e_ on n_.source = e_.source""",
    "coverage_matrix": lambda D: f"with {points(D)} select factor, " + ", ".join(f"count(case when origin = '{o}' then 1 end) {o}" for o in ("band", "mean", "top_rule", "loan_rule")) + ", " + ", ".join(f"count(case when points = {p} then 1 end) points_{p}" for p in range(4)) + " from pts group by factor",
    "tercile_cut_report": lambda D: f"""with {ranked(D)}, n_ as (select cast(max(n) as bigint) n from cum), cuts as (select 1 no, c1 c, n from k1 cross join n_ union all select 2, c2, n from k2 cross join n_), tie as (select num, m, c hi, c - m lo from (select s.num, s.m, cum.c from scores s join cum on s.num = cum.num) z)
select no cut, c position, round(no * n / 3e0, 6) target, max(t.m) tied_group, max(case when 3 * t.hi <= 3 * c then 'below' else 'above' end) went_to from cuts left join tie t on 3 * t.lo < no * n and 3 * t.hi > no * n group by no, c, n""",
    "grouped_folds": lambda D: "with s as (select doc_id, concat('series ', cast(doc_id % 61 as varchar(9))) series from (select distinct doc_id from labels) x), g as (select series, count(*) n from s group by series), d as (select series, n, (row_number() over (order by n desc, series) - 1) i from g), k as (select series, n, case when cast(floor(i / 5) as bigint) % 2 = 0 then i % 5 else 4 - i % 5 end fold from d) select s.doc_id, s.series, cast(k.fold as bigint) fold from s join k on s.series = k.series",
    # report tables
    "risk_dataset": lambda D: f"with {dataset(D)} select w.*, l.programme, l.period, p.place, cast(l.num as double) / cast(l.den as double) total, l.rounded, l.fixed, l.tercile, l.n_determined from wide_ w join labelled l on w.doc_id = l.doc_id join place_ p on p.num = l.num",
    "model_comparison": lambda D: f"""with {summary(D)}, s as (select model, max(case when name = 'f1_macro' and level = 'fold' then mean end) f1, max(case when name = 'f1_macro' and level = 'fold' then sd end) f1_sd, max(case when name = 'accuracy' and level = 'fold' then mean end) accuracy, max(case when name = 'auc_ovr' and level = 'fold' then mean end) auc, max(case when name = 'kappa' and level = 'fold' then mean end) kappa, max(case when name = 'error2_share' and level = 'repeat' then mean end) error2 from summ group by model),
r as (select *, round(f1, 12) key_ from s) select model, round(f1, 9) f1, round(f1_sd, 9) f1_sd, round(accuracy, 9) accuracy, round(auc, 9) auc, round(kappa, 9) kappa, round(error2, 9) error2, cast(rank() over (order by key_ desc nulls last) as bigint) place, case when model <> 'majority' and key_ = max(case when model <> 'majority' then key_ end) over () then 1 else 0 end best, case when model = 'majority' then null when key_ <= max(case when model = 'majority' then key_ end) over () then 1 else 0 end not_above_baseline from r""",
    "label_distribution_margins": lambda D: f"with {ranked(D)} select coalesce(period, 'all') subset, coalesce(tercile, 'all') tercile, count(case when fixed = 'low' then 1 end) low, count(case when fixed = 'medium' then 1 end) medium, count(case when fixed = 'high' then 1 end) high, count(*) n from labelled group by grouping sets ((period, tercile), (period), (tercile), ())",
    "tuned_against_default": lambda D: f"with {fold_scores(D)}, t as (select model, rep, fold, f1, f1 + 0.01 * ((rep + 2 * fold) % 4 - 1) tuned, case (3 * rep + fold) % 5 when 0 then 0.01 when 1 then 0.1 when 2 then 1 when 3 then 10 else 100 end c from f where model <> 'majority'), c as (select model, c, count(*) n from t group by model, c), s as (select model, avg(f1) plain, avg(tuned) tuned from t group by model) select s.model, round(plain, 9) plain, round(tuned, 9) tuned, round(tuned - plain, 9) gain, c.c chosen_c, c.n folds from s join c on s.model = c.model",
    "gold_validation": lambda D: f"with {tallies(D)} select factor, subset, " + ", ".join(f"max(case when source = '{s}' then {x} end) {s}_{x}" for s in ("regex", "llm") for x in ("agree", "disagree", "not_found", "not_comparable")) + " from tallies group by factor, subset",
    "misclassified_documents": lambda D: f"with {chosen(D)}, e as (select doc_id, {D.join(f'transform(array_sort(collect_list(struct(rep, cast(size as string) s))), x -> x.s)' if D.idiv == 'div' else 'list(cast(size as varchar) order by rep)', repr(' '))} errors, max_by(predicted, {D.st}(n, {CLASS.format(x='predicted')})) modal from (select v_.*, count(*) over (partition by doc_id, predicted) n from v_) z group by doc_id) select d.doc_id, d.label, e.modal, e.errors, d.wrong, d.repeats from docs_ d join e on d.doc_id = e.doc_id where 2 * d.wrong > d.repeats",
    "error_rates": lambda D: f"with {chosen(D)} select kind, grp, count(*) documents, cast(sum(repeats) as bigint) predictions, cast(sum(wrong) as bigint) wrong, round(cast(sum(wrong) as double) / sum(repeats), 9) rate, cast(rank() over (order by max(kno), grp) as bigint) place from kinds_ group by kind, grp",
    "explain_tables": lambda D: f"with {explained(D)} select analysis, representation, " + ", ".join(f"round(avg(case when classifier = '{c}' and setting = '{s}' then value end), 9) {c}_{s}" for c in ("logreg", "svm") for s in ("full", "half")) + " from ex group by analysis, representation",
    "dashboard_payload": lambda D: f"with {tallies(D)} select 'extraction' section, concat(source, '/', factor) name, cast(agree as double) value from tallies where subset = 'all' union all (with {ranked(D)} select 'labels', concat(fixed, '/', tercile), cast(count(*) as double) from labelled group by fixed, tercile) union all (with {points(D)} select 'coverage', concat(factor, '/', origin), cast(count(*) as double) from pts group by factor, origin)",
    "disagreeing_factors": lambda D: f"with {consolidated(D)} select doc_id, count(*) n, {D.join(f'array_sort({D.list_of}(factor))' if D.idiv == 'div' else 'list_sort(list(factor))', repr(','))} factors from cons where r is not null and l is not null and r <> l group by doc_id",
    "cell_details": lambda D: f"with {cells(D)} select source, doc_id, factor, subset, gold, points, category from cells",
    "run_provenance": lambda D: f"with {predictions(D)}, {run_table(D)}, need as (select distinct model, rep from runs_) select n.model, n.rep, count(case when r.status = 'complete' then 1 end) complete, count(case when r.status = 'failed' then 1 end) failed, case when count(case when r.status = 'complete' then 1 end) = 5 then 'whole' else 'missing parts' end chain from need n left join runs_ r on n.model = r.model and n.rep = r.rep group by n.model, n.rep",
}


def discordant(D) -> str:
    """CTE bc: by model and repeat, documents that only tfidf (b) or only the model (c) has right."""
    return f"""{predictions(D)}, bc as (select x.model, x.rep, count(case when x.predicted <> x.label and y.predicted = y.label then 1 end) b, count(case when x.predicted = x.label and y.predicted <> y.label then 1 end) c from pred x join pred y on x.doc_id = y.doc_id and x.rep = y.rep and y.model = 'tfidf' and x.model <> 'tfidf' group by x.model, x.rep)"""


def fold_differences(D) -> str:
    """CTE td: by model and repeat, the paired t of its folds' F1 against tfidf's."""
    return f"""{fold_scores(D)}, dd as (select x.model, x.rep, x.f1 - y.f1 d from f x join f y on y.model = 'tfidf' and x.model <> 'tfidf' and x.rep = y.rep and x.fold = y.fold),
td as (select model, rep, cast(count(*) - 1 as int) df, avg(d) / (stddev_samp(d) / sqrt(count(*))) t from dd group by model, rep)"""


def _over(text: str, finish):
    def run(spark, sf_dir):
        views(spark, sf_dir)
        return finish(spark.sql(text))

    return run


def observed_points(D) -> str:
    """The query of that name with a document's ten bands in one row: documents are made once and their cells never shuffled.

    A band is null where the factor has none of its own (loan and TOP rule, missing value). Rows of one doc_id stay side by side, as the joins would give them; a null doc_id meets nothing."""
    own = {"fin_form": "case fin_form when 'grant' then 3 when 'conditional_grant' then 2 else 1 end", "tam_osszeg": f"case when tam_osszeg is not null then {banded('tam_osszeg', 'tam_osszeg')} end", "konzorcium": "3 * konzorcium",
        "bead_napok": banded("bead_napok", "bead_napok", 0), "max_tam_int": f"case when fin_form <> 'loan' then {banded('max_tam_int', 'max_tam_int')} end", "eloleg": banded("eloleg", "eloleg"), "idotartam": banded("idotartam", "idotartam", 3),
        "tam_tevekenyseg": "tam_tevekenyseg", "egysz_elszam": "3 - 3 * egysz_elszam", "biztositek": "3 - 3 * biztositek"}
    return f"""{documents(D)}, bands_ as (select doc_id, fin_form, programme, array({", ".join(f"cast({own[f]} as bigint)" for f in FACTORS)}) band from docs),
lone as (select doc_id, max(fin_form) fin_form, max(programme) programme, collect_list(band) held from bands_ group by doc_id),
asked as (select source, doc_id, factor, fin_form, programme, case when doc_id is not null and (source = 'regex' or doc_id % 17 <> 0 and exists(held, b -> exists(b, x -> x is not null))) then doc_id end seen,
    case when doc_id is null or source = 'llm' and doc_id % 17 = 0 then cast(array() as array<bigint>) when source = 'regex' then transform(held, b -> case when (doc_id + ord) % 7 <> 0 then b[ord] end)
      else transform(filter(held, b -> b[ord] is not null), b -> case when (doc_id + ord) % 9 = 0 then null when (doc_id + 3 * ord) % 5 = 0 then (b[ord] + 1) % 4 else b[ord] end) end found
  from lone cross join (values {factor_rows()}) as f(ord, factor) cross join (values ('regex'), ('llm')) as s(source)),
o as (select *, explode_outer(found) given from asked)
select source, doc_id, factor, case when seen is null then null when factor = 'max_tam_int' and fin_form = 'loan' then 0 when given is null and factor = 'tam_osszeg' and programme = 'BUILDING' then 1 when given is null and factor = 'tam_osszeg' and programme = 'MACHINERY' then 2 else given end points,
case when seen is null then null when factor = 'max_tam_int' and fin_form = 'loan' then 'loan_rule' when given is null and factor = 'tam_osszeg' and programme in ('BUILDING', 'MACHINERY') then 'top_rule' when given is not null then 'given' end origin, case when seen is null then 'document_missing_from_run' end note from o"""


QUERIES = {
    "observed_points": _over(f"with {observed_points(Spark)}", lambda df: df),
    "mcnemar_exact": _over(f"with {discordant(Spark)} select * from bc", lambda df: df.select("model", "rep", "b", "c", F.round(mcnemar_column(F.col("b"), F.col("c")), 6).alias("p"))),
    "fold_t": _over(f"with {fold_differences(Spark)} select * from td", lambda df: df.select("model", "rep", "df", F.round("t", 6).alias("t"), F.round(t_column(F.col("t"), F.col("df")), 6).alias("p"))),
}
# DuckDB, another way: the tail's terms one by one; with 4 degrees of freedom t has a closed form.
ORACLE = {
    "mcnemar_exact": f"with {discordant(Duck)}, n as (select *, unnest(generate_series(0, least(b, c))) k from bc) select model, rep, b, c, round(least(1e0, 2 * sum(exp(lgamma(b + c + 1) - lgamma(k + 1) - lgamma(b + c - k + 1) - (b + c) * ln(2e0)))), 6) p from n group by model, rep, b, c",
    "fold_t": f"with {fold_differences(Duck)}, s as (select *, abs(t) / sqrt(t * t + 4) x from td where df = 4) select model, rep, df, round(t, 6) t, round(1 - x * (1 + (1 - x * x) / 2), 6) p from s",
}
