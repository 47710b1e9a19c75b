"""Folds, predictions and their evaluation. Predictions are fixed pseudo-probabilities from hashes, so every figure has SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.sources.tables import table

MODELS = ("majority", "tfidf", "hubert", "e5", "bge_m3", "qwen3_8b")
CLASS = "case {x} when 'low' then 0 when 'medium' then 1 else 2 end"


def folds(D) -> str:
    """CTE folds: labelled documents dealt into five stratified folds for each of five repeats.

    Spark ranks within the hashes' first three digits and adds how many come before, so no task sorts a class."""
    key = "md5(concat('42:', cast(rep as varchar(20)), ':', cast(doc_id as varchar(20))))"
    if D.idiv == "div":
        return f"""
lab as (select doc_id, case when quality = 0 then 'high' when toxic = 1 then 'medium' else 'low' end label from (select doc_id, max(quality) quality, max(toxic) toxic from labels group by doc_id) l),
reps as (select * from (values (0), (1), (2), (3), (4)) as r(rep)),
hashed_ as (select doc_id, label, rep, {key} h, substr({key}, 1, 3) b from lab cross join reps),
lots_ as (select rep, label, b, sum(n) over (partition by rep, label order by b) - n before_ from (select rep, label, b, count(*) n from hashed_ group by rep, label, b) z),
folds as (select doc_id, label, rep, cast((before_ + row_number() over (partition by rep, label, b order by h, doc_id) - 1) % 5 as int) fold from hashed_ join lots_ using (rep, label, b))"""
    return """
lab as (select doc_id, case when quality = 0 then 'high' when toxic = 1 then 'medium' else 'low' end label from (select doc_id, max(quality) quality, max(toxic) toxic from labels group by doc_id) l),
reps as (select * from (values (0), (1), (2), (3), (4)) as r(rep)),
folds as (select doc_id, label, rep, (row_number() over (partition by rep, label order by md5(concat('42:', cast(rep as varchar(20)), ':', cast(doc_id as varchar(20)))), doc_id) - 1) % 5 fold from lab cross join reps)"""


def predictions(D) -> str:
    models = ", ".join(f"({i}, '{m}')" for i, m in enumerate(MODELS))
    h = D.hash32("concat(model, ':', cast(rep as varchar(20)), ':', cast(doc_id as varchar(20)))")
    return f"""{folds(D)},
models as (select * from (values {models}) as m(mno, model)),
raw as (select doc_id, label, rep, fold, mno, model, {h} h from folds cross join models),
abc as (select *, 1 + h % 1009 + case when label = 'low' then 300 + 60 * mno else 0 end a, 1 + h {D.idiv} 1009 % 1009 + case when label = 'medium' then 300 + 60 * mno else 0 end b, 1 + h {D.idiv} 1018081 % 1009 + case when label = 'high' then 300 + 60 * mno else 0 end c from raw),
pred as (select doc_id, label, rep, fold, mno, model, cast(a as double) / (a + b + c) p_low, cast(b as double) / (a + b + c) p_medium, cast(c as double) / (a + b + c) p_high, case when c >= a and c >= b then 'high' when b >= a then 'medium' else 'low' end predicted from abc)"""


def counts(D, keys: str, name: str = "cm") -> str:
    """CTE with the nine confusion counts by `keys` (n00: true low, predicted low)."""
    cells = ", ".join(f"count(case when label = '{a}' and predicted = '{b}' then 1 end) n{i}{j}" for i, a in enumerate(("low", "medium", "high")) for j, b in enumerate(("low", "medium", "high")))
    return f"{name} as (select {keys}, count(*) n, {cells} from pred group by {keys})"


def _f1(i: int) -> str:
    o = [j for j in range(3) if j != i]
    tp = f"n{i}{i}"
    return f"case when 2 * {tp} + n{o[0]}{i} + n{o[1]}{i} + n{i}{o[0]} + n{i}{o[1]} = 0 then 0.0 else cast(2 * {tp} as double) / (2 * {tp} + n{o[0]}{i} + n{o[1]}{i} + n{i}{o[0]} + n{i}{o[1]}) end"


MACRO = f"({_f1(0)} + {_f1(1)} + {_f1(2)}) / 3"


def classification(D, keys: str) -> str:
    per = []
    for i, c in enumerate(("low", "medium", "high")):
        o = [j for j in range(3) if j != i]
        col, row = f"(n{i}{i} + n{o[0]}{i} + n{o[1]}{i})", f"(n{i}{i} + n{i}{o[0]} + n{i}{o[1]})"
        per += [f"case when {col} = 0 then 0.0 else round(cast(n{i}{i} as double) / {col}, 9) end precision_{c}", f"case when {row} = 0 then 0.0 else round(cast(n{i}{i} as double) / {row}, 9) end recall_{c}", f"round({_f1(i)}, 9) f1_{c}", f"case when n = {row} then null else round(cast(n - {row} - {col} + n{i}{i} as double) / (n - {row}), 9) end specificity_{c}", f"{row} support_{c}"]
    return f"with {predictions(D)}, {counts(D, keys)} select {keys}, n, {', '.join(f'n{i}{j}' for i in range(3) for j in range(3))}, round(cast(n00 + n11 + n22 as double) / n, 9) accuracy, {', '.join(per)}, round({MACRO}, 9) macro_f1, n20 err_m2, n10 + n21 err_m1, n00 + n11 + n22 err_0, n01 + n12 err_p1, n02 err_p2 from cm"


def fold_scores(D) -> str:
    return f"{predictions(D)}, {counts(D, 'model, mno, rep, fold')}, f as (select model, mno, rep, fold, n, {MACRO} f1 from cm)"


def paired(D) -> str:
    return f"{fold_scores(D)}, pairs as (select x.model, x.rep, x.fold, x.f1 - y.f1 d from f x join f y on y.model = 'tfidf' and x.rep = y.rep and x.fold = y.fold where x.model in ('hubert', 'e5', 'bge_m3', 'qwen3_8b')), st as (select model, count(*) n, avg(d) m, var_samp(d) v from pairs group by model)"


def vertices(D) -> str:
    return f"""{predictions(D)},
curve as (select model, p_high p, cast(sum(case when label = 'high' then 1 else 0 end) as bigint) y, cast(sum(case when label = 'high' then 0 else 1 end) as bigint) x from pred group by model, p_high),
cumv as (select model, p, cast(sum(y) over (partition by model order by p desc) as bigint) tp, cast(sum(x) over (partition by model order by p desc) as bigint) fp, cast(sum(y) over (partition by model) as bigint) np, cast(sum(x) over (partition by model) as bigint) nn from curve)"""


SQL = {
    "period_macro": lambda D: f"with {predictions(D)}, pp as (select *, cast(doc_id % 4 as bigint) period from pred), t as (select model, period, c.label c, count(case when pp.label = c.label and predicted = c.label then 1 end) tp, count(case when pp.label = c.label then 1 end) s, count(case when predicted = c.label then 1 end) q from pp cross join (select distinct label from lab) c group by model, period, c.label) select model, period, round(avg(case when s + q > 0 then cast(2 * tp as double) / (s + q) end), 9) macro, count(case when s + q > 0 then 1 end) present from t group by model, period",
    "stratified_folds": lambda D: f"with {folds(D)} select rep, cast(fold as bigint) fold, label, count(*) n from folds group by rep, fold, label",
    "fold_assignment": lambda D: f"with {folds(D)} select doc_id, rep, cast(fold as bigint) fold from folds",
    "fold_class_range": lambda D: f"with {folds(D)}, c as (select rep, fold, label, count(*) n from folds group by rep, fold, label) select label, min(n) least, max(n) most from c group by label",
    "small_classes": lambda D: f"with {folds(D)} select label, count(*) n, case when count(*) < 25 then 1 else 0 end too_small from folds where rep = 0 group by label",
    "majority_baseline": lambda D: f"with {folds(D)}, c as (select rep, label, fold, count(*) n from folds group by rep, label, fold), t as (select rep, label, cast(sum(n) as bigint) n from c group by rep, label), tr as (select c.rep, c.fold, c.label, t.n - c.n n from c join t on c.rep = t.rep and c.label = t.label) select rep, cast(fold as bigint) fold, label, round(cast(n as double) / cast(sum(n) over (partition by rep, fold) as double), 9) share from tr",
    "learning_curve_sample": lambda D: f"with {folds(D)}, r as (select rep, fold, label, doc_id, row_number() over (partition by rep, fold, label order by md5(cast(doc_id * 31 + rep as varchar(30))), doc_id) k, count(*) over (partition by rep, fold, label) n from folds) select rep, cast(fold as bigint) fold, share, count(*) n from r cross join (select * from (values (1), (2), (3), (4)) as s(share)) s where k * 4 <= n * share + 3 group by rep, fold, share",
    "even_sample": lambda D: "with r as (select doc_id, row_number() over (order by doc_id) - 1 i, count(*) over () n from (select distinct doc_id from labels) x), w as (select * from (values (0), (1), (2), (3), (4)) as k(k)) select r.doc_id, w.k from r join w on r.i = cast(floor((2 * w.k * (n - 1) + 4) / 8) as bigint)",
    "argmax_labels": lambda D: f"with {predictions(D)} select model, label, predicted, count(*) n from pred group by model, label, predicted",
    "modal_labels": lambda D: f"with {predictions(D)}, c as (select model, doc_id, predicted, count(*) n from pred group by model, doc_id, predicted) select model, doc_id, max_by(predicted, {D.st}(n, {CLASS.format(x='predicted')})) modal, max(n) votes from c group by model, doc_id",
    "misclassified": lambda D: f"with {predictions(D)} select model, doc_id, label, count(case when predicted <> label then 1 end) wrong from pred group by model, doc_id, label having 2 * count(case when predicted <> label then 1 end) > 5",
    "classification_by_fold": lambda D: classification(D, "model, rep, fold").replace("select model, rep, fold, n, n00", "select model, rep, cast(fold as bigint) fold, n, n00"),
    "classification_by_repeat": lambda D: classification(D, "model, rep"),
    "classification_pooled": lambda D: classification(D, "model"),
    "fold_summary": lambda D: f"with {fold_scores(D)} select model, count(*) folds, round(avg(f1), 9) mean, round(stddev_samp(f1), 9) sd from f group by model",
    "model_comparison_rank": lambda D: f"with {fold_scores(D)}, s as (select model, round(avg(f1), 12) f1 from f group by model) select model, round(f1, 9) mean, cast(rank() over (order by f1 desc) as bigint) place, case when model <> 'majority' and f1 = max(case when model <> 'majority' then f1 end) over () then 1 else 0 end best from s",
    "model_grid": lambda D: f"with {fold_scores(D)}, s as (select model, case when mno % 2 = 0 then 'even' else 'odd' end kind, avg(f1) f1 from f group by model, mno) select coalesce(model, kind) key, case when model is null then 'kind' else 'model' end axis, round(avg(f1), 9) mean, count(*) n from s group by grouping sets ((model), (kind))",
    "paired_folds": lambda D: f"with {paired(D)} select model, rep, cast(fold as bigint) fold, round(d, 9) d from pairs",
    "auc_ranks": lambda D: f"with {vertices(D)} select model, round(cast(sum(y * (2 * (nn - fp) + x)) as double) / cast(2 * max(np) * max(nn) as double), 9) auc from (select v.*, c.y, c.x from cumv v join curve c on v.model = c.model and v.p = c.p) z group by model",
    "roc_grid": lambda D: f"""with {vertices(D)}, v as (select model, tp, fp, np, nn from cumv union select model, cast(0 as bigint), cast(0 as bigint), max(np), max(nn) from cumv group by model),
steps as (select model, fp, np, nn, max(tp) top, min(tp) bottom from v group by model, fp, np, nn), seg as (select *, lead(fp) over (partition by model order by fp) fp2, lead(bottom) over (partition by model order by fp) tp2 from steps),
grid as (select id g from ({'select explode(sequence(0, 200)) id' if D.idiv == 'div' else 'select unnest(generate_series(0, 200)) id'}) s)
select model, cast(g as bigint) point, round(case when g * nn = 200 * fp or fp2 is null then cast(top as double) / np else (top + cast((g * nn - 200 * fp) as double) / (200 * (fp2 - fp)) * (tp2 - top)) / np end, 9) tpr from seg join grid on g * nn >= 200 * fp and (fp2 is null or g * nn < 200 * fp2)""",
    "quadratic_kappa": lambda D: f"with {predictions(D)}, c as (select model, {CLASS.format(x='label')} a, {CLASS.format(x='predicted')} b, count(*) n from pred group by model, label, predicted), r as (select model, a, cast(sum(n) as bigint) m from c group by model, a), q as (select model, b, cast(sum(n) as bigint) m from c group by model, b), o as (select model, cast(sum(n) as bigint) n, cast(sum(n * (a - b) * (a - b)) as bigint) o from c group by model), e as (select r.model, cast(sum((a - b) * (a - b) * r.m * q.m) as bigint) e from r join q on r.model = q.model group by r.model) select o.model, n * o num, e den, round(1 - cast(n * o as double) / e, 9) kappa from o join e on o.model = e.model",
    "error_size_table": lambda D: f"with {predictions(D)}, c as (select model, rep, {CLASS.format(x='predicted')} - {CLASS.format(x='label')} size, count(*) n from pred group by model, rep, predicted, label), s as (select model, rep, size, cast(sum(n) as bigint) n from c group by model, rep, size), z as (select m.model, r.rep, x.size, coalesce(n, 0) n from models m cross join reps r cross join (select * from (values (-2), (-1), (0), (1), (2)) as x(size)) x left join s on s.model = m.model and s.rep = r.rep and s.size = x.size) select model, size, round(avg(n), 6) mean, round(stddev_samp(n), 6) sd, round(cast(sum(n) as double) / sum(cast(sum(n) as bigint)) over (partition by model), 9) share from z group by model, size",
    "error_overlap": lambda D: f"with {predictions(D)} select x.rep, count(case when x.predicted <> x.label and y.predicted <> y.label then 1 end) both_wrong, count(case when x.predicted <> x.label and y.predicted = y.label then 1 end) only_a, count(case when x.predicted = x.label and y.predicted <> y.label then 1 end) only_b, count(case when x.predicted = x.label and y.predicted = y.label then 1 end) neither from pred x join pred y on x.doc_id = y.doc_id and x.rep = y.rep and x.model = 'tfidf' and y.model = 'e5' group by x.rep",
    "error_rates_by_group": lambda D: f"with {predictions(D)}, s as (select model, 'parity' kind, cast(doc_id % 2 as varchar(10)) grp, predicted, label from pred union all select model, 'bucket', cast(doc_id % 5 as varchar(10)), predicted, label from pred union all select model, 'label', label, predicted, label from pred) select model, kind, grp, count(*) n, count(case when predicted <> label then 1 end) wrong from s group by model, kind, grp",
    "spearman": lambda D: f"with {predictions(D)}, d as (select model, doc_id, avg(p_high) p, max({CLASS.format(x='label')}) y from pred group by model, doc_id), r as (select model, rank() over (partition by model order by p) + (count(*) over (partition by model, p) - 1) / 2.0 a, rank() over (partition by model order by y) + (count(*) over (partition by model, y) - 1) / 2.0 b from d) select model, round(corr(cast(a as double), cast(b as double)), 6) rho from r group by model",
    "tuning_summary": lambda D: f"with {fold_scores(D)}, b as (select rep, fold, max_by(mno, {D.st}(round(f1, 12), -mno)) chosen from f where mno > 0 group by rep, fold) select chosen, count(*) n from b group by chosen",
    "cosine_similarity": lambda D: f"with e as (select vec_id, i, cast(x as double) x from embeddings {D.each_at('embedding', 'x', 'i')}), n as (select vec_id, sqrt(sum(x * x)) s from e group by vec_id), d as (select a.vec_id a, b.vec_id b, sum(a.x * b.x) dot from e a join e b on a.i = b.i and a.vec_id < b.vec_id and b.vec_id <= a.vec_id + 20 group by a.vec_id, b.vec_id) select d.a, d.b, round(dot / (x.s * y.s), 6) cosine from d join n x on x.vec_id = d.a join n y on y.vec_id = d.b",
    "pooled_vectors": lambda D: f"with e as (select vec_id, label, i, cast(x as double) x from embeddings {D.each_at('embedding', 'x', 'i')}) select label, cast(i as bigint) dim, round(sum(x * (1 + vec_id % 5)) / sum(1 + vec_id % 5), 6) pooled from e group by label, i",
}

#: Largest distance of two ids whose vectors are compared.
NEAR = 20


def _total(products):
    """Sum of an array without its nulls; null where there is nothing else."""
    return F.aggregate(products, F.lit(None).cast("double"), lambda s, v: F.when(v.isNull(), s).when(s.isNull(), v).otherwise(s + v))


def cosine_similarity(spark, sf_dir):
    """Cosines of vectors whose ids are NEAR or less apart: a block of NEAR ids meets itself and the next one.

    Repeated ids count as the sum of their vectors, as the SQL's sums over both copies have it."""
    rows = table(spark, sf_dir, "embeddings").where("vec_id is not null and size(embedding) > 0").selectExpr("vec_id", "cast(embedding as array<double>) x")
    repeated = rows.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("vec_id")
    once = rows.join(repeated, "vec_id", "left_anti").select("vec_id", "x", F.sqrt(_total(F.transform("x", lambda v: v * v))).alias("s"))
    parts = rows.join(repeated, "vec_id", "left_semi").select("vec_id", F.posexplode("x").alias("i", "v")).groupBy("vec_id", "i").agg(F.sum("v").alias("v"), F.sum(F.col("v") * F.col("v")).alias("vv"))
    summed = parts.groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("x"), F.sqrt(F.sum("vv")).alias("s")).select("vec_id", F.col("x.v").alias("x"), "s")
    each = once.unionByName(summed)
    a = each.selectExpr("vec_id a", "x xa", "s sa", f"vec_id div {NEAR} block")
    b = each.selectExpr("vec_id b", "x xb", "s sb", f"explode(array(vec_id div {NEAR}, vec_id div {NEAR} - 1)) block")
    met = a.join(b, "block").where(f"a < b and b <= a + {NEAR}")
    dot = _total(F.zip_with("xa", "xb", lambda x, y: x * y))
    return met.select("a", "b", F.round(dot / (F.col("sa") * F.col("sb")), 6).alias("cosine"))


QUERIES = {"cosine_similarity": cosine_similarity}
