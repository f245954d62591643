"""Evaluation queries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from replylens.functions import policy as po
from replylens.functions import stats as st
from replylens.operators import joins as jn
from replylens.operators import metrics as me
from replylens.operators import retrieval as rt
from replylens.plans import bindings as b
from replylens.plans.registry import query, table

LABELS = "(values ('en', 0), ('de', 1), ('fr', 2), ('es', 3)) l(label, ord)"
Z = "1.959963984540054::double"

CLASSES = b.GRADED + f""", configs as (select distinct config from counts),
classes as (
  select c.config, l.label,
    coalesce(sum(n) filter (where gold = label and pred = label), 0)::bigint as tp,
    coalesce(sum(n) filter (where gold <> label and pred = label), 0)::bigint as fp,
    coalesce(sum(n) filter (where gold = label and pred <> label), 0)::bigint as fn
  from configs c cross join {LABELS} left join counts k on k.config = c.config
  group by all),
scores as (
  select *, tp + fn as support,
    case when tp + fp > 0 then tp / (tp + fp)::double else 0 end as p,
    case when tp + fn > 0 then tp / (tp + fn)::double else 0 end as r,
    case when p + r > 0 then 2 * p * r / (p + r) else 0 end as f1 from classes)"""


def _counts(spark, sf):
    return me.confusion_counts(b.graded(spark, sf), by=["config"])


@query("J4_graded", f"""
with {b.GRADED} select config, id, gold, pred, should_escalate, escalated, is_hard, split from graded""")
def graded(spark, sf):
    return b.graded(spark, sf).select("config", "id", "gold", "pred", "should_escalate",
                                      "escalated", "is_hard", "split")


@query("A6_confusion_counts", f"with {b.GRADED} select config, gold, pred, n from counts")
def confusion_counts(spark, sf):
    return _counts(spark, sf)


@query("J10_confusion_grid", f"""
with {b.GRADED}, configs as (select distinct config from counts)
select c.config, g.label as gold, p.label as pred, coalesce(sum(k.n), 0)::bigint as n
from configs c, {LABELS.replace(' l(', ' g(')},
  (values ('en'), ('de'), ('fr'), ('es'), ('__other__')) p(label)
left join counts k on k.config = c.config and k.gold = g.label
  and case when k.pred in ('en', 'de', 'fr', 'es') then k.pred else '__other__' end = p.label
group by all""")
def _(spark, sf):
    return me.confusion_grid(_counts(spark, sf), b.LANGS, ["config"])


@query("A7_per_class_scores", f"""
with {CLASSES} select config, label, tp, fp, fn, support, round(p, 6) as precision,
  round(r, 6) as recall, round(f1, 6) as f1 from scores""")
def per_class(spark, sf):
    t = me.per_class(_counts(spark, sf), b.LANGS, ["config"])
    return t.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query("A8_macro_f1", f"""
with {CLASSES} select config, round(avg(f1), 6) as macro_f1 from scores group by config""")
def _(spark, sf):
    f = me.averaged_f1(me.per_class(_counts(spark, sf), b.LANGS, ["config"]), ["config"])
    return f.select("config", F.round("macro_f1", 6).alias("macro_f1"))


@query("A9_weighted_f1", f"""
with {CLASSES} select config, round(sum(f1 * support) / sum(support), 6) as weighted_f1
from scores group by config""")
def _(spark, sf):
    f = me.averaged_f1(me.per_class(_counts(spark, sf), b.LANGS, ["config"]), ["config"])
    return f.select("config", F.round("weighted_f1", 6).alias("weighted_f1"))


@query("A10_accuracy", f"""
with {b.GRADED} select config, coalesce(sum(n) filter (where gold = pred), 0)::bigint as acc_correct,
  sum(n)::bigint as acc_n, round(coalesce(sum(n) filter (where gold = pred), 0) / sum(n)::double, 6) as acc
from counts group by config""")
def _(spark, sf):
    return me.accuracy(_counts(spark, sf), ["config"]).withColumn("acc", F.round("acc", 6))


BINARY = b.GRADED + """, cells as (
  select config, count(*) filter (where should_escalate and escalated) as tp,
    count(*) filter (where not should_escalate and escalated) as fp,
    count(*) filter (where should_escalate and not escalated) as fn,
    count(*) filter (where not should_escalate and not escalated) as tn
  from graded where escalated is not null group by config),
prf as (select *, case when tp + fp > 0 then tp / (tp + fp)::double else 0 end as p,
  case when tp + fn > 0 then tp / (tp + fn)::double else 0 end as r from cells)"""


@query("A11_binary_scores", f"""
with {BINARY} select config, tp, fp, fn, tn, round(p, 6) as precision, round(r, 6) as recall,
  round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 6) as f1 from prf""")
def binary_scores(spark, sf):
    t = me.binary_counts(b.graded(spark, sf), "should_escalate", "escalated", ["config"])
    return t.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


KAPPA = b.GRADED + """, margins as (
  select config, label, sum(row_n) as row_n, sum(col_n) as col_n, sum(agree) as agree from (
    select config, gold as label, n as row_n, 0 as col_n, case when gold = pred then n else 0 end as agree from counts
    union all select config, pred, 0, n, 0 from counts) group by all),
k as (select config, sum(row_n)::bigint as n, sum(agree)::bigint as agree,
  sum(row_n * col_n)::double as chance from margins group by config),
kk as (select *, agree / n::double as raw, case when chance <> n::double * n then
  (agree / n::double - chance / (n::double * n)) / (1 - chance / (n::double * n)) end as kappa from k)"""
_BAND = """case when kappa is null then 'undefined' when kappa <= 0.2 then 'slight'
  when kappa <= 0.4 then 'fair' when kappa <= 0.6 then 'moderate' when kappa <= 0.8 then 'substantial'
  else 'almost perfect' end"""
_VERDICT = """case when kappa is null or kappa < 0.4 then 'weak' when kappa < 0.6 then 'moderate'
  else 'substantial' end"""


def _rounded(df):
    return df.withColumns({"raw": F.round("raw", 6), "kappa": F.round("kappa", 6)})


@query("A12_kappa", f"with {KAPPA} select config, n, round(kappa, 6) as kappa from kk")
def kappa(spark, sf):
    return _rounded(me.agreement(_counts(spark, sf), ["config"])).select("config", "n", "kappa")


@query("A13_raw_agreement", f"with {KAPPA} select config, n, agree, round(raw, 6) as raw from kk")
def _(spark, sf):
    return _rounded(me.agreement(_counts(spark, sf), ["config"])).select("config", "n", "agree", "raw")


@query("A17_kappa_reading", f"with {KAPPA} select config, {_BAND} as band, {_VERDICT} as verdict from kk")
def _(spark, sf):
    return me.agreement(_counts(spark, sf), ["config"]).select("config", "band", "verdict")


WILSON = f"""w as (select *, s / n::double as p from s where n > 0),
ci as (select *, (p + {Z} * {Z} / (2 * n)) / (1 + {Z} * {Z} / n) as centre,
  {Z} * sqrt(p * (1 - p) / n + {Z} * {Z} / (4 * n::double * n)) / (1 + {Z} * {Z} / n) as half from w),
b as (select *, greatest(0, centre - half) as low, least(1, centre + half) as high from ci)"""


def _by_source(spark, sf):
    key = b.answer_key(spark, sf)
    runs = b.runs(spark, sf).filter("config = 'stops'").select("id", "pred")
    src = b.documents(spark, sf).select(F.col("doc_id").alias("id"), "source")
    return key.join(runs, "id").join(src, "id").groupBy("source").agg(
        F.count_if(F.col("gold") == F.col("pred")).alias("s"), F.count(F.lit(1)).alias("n"))


BY_SOURCE = b.GRADED + """, s as (select d.source, count(*) filter (where gold = pred) as s, count(*) as n
  from graded g join documents d on d.doc_id = g.id where config = 'stops' group by d.source)"""


@query("A14_wilson_interval", f"""
with {BY_SOURCE}, {WILSON} select source, s, n, round(p, 6) as point, round(low, 6) as low,
  round(high, 6) as high from b""")
def _(spark, sf):
    t = me.with_interval(_by_source(spark, sf), "s", "n").drop("interval")
    return t.withColumns({c: F.round(c, 6) for c in ("point", "low", "high")})


@query("A15_interval_text", f"""
with {BY_SOURCE}, {WILSON} select source, concat(round_even(p * 100, 0)::int, '% +-',
  round_even((high - low) / 2 * 100, 0)::int) as interval from b""")
def _(spark, sf):
    return me.with_interval(_by_source(spark, sf), "s", "n").select("source", "interval")


def _raters(spark, sf):
    return jn.rater_pairs(b.human_ratings(spark, sf), b.judge_ratings(spark, sf), me.DIMENSIONS)


@query("J5_rater_pairs", f"""
with {b.RATINGS} select h.id, h.acceptable as human_acceptable, j.acceptable as judge_acceptable
from human h join judge j on j.id = h.id where j.error is null""")
def _(spark, sf):
    return _raters(spark, sf).select("id", "human_acceptable", "judge_acceptable")


DIMS = b.RATINGS + """, k as (select dim, count(*) as n, count(*) filter (where human = judge) as agree,
  count(*) filter (where human) as hy, count(*) filter (where judge) as jy from dims group by dim),
kk as (select *, agree / n::double as raw, hy * jy + (n - hy) * (n - jy) as chance,
  case when chance <> n * n then (agree / n::double - chance / (n * n)::double)
    / (1 - chance / (n * n)::double) end as kappa from k)"""


@query("A16_dimension_agreement", f"""
with {DIMS} select dim, n, agree, round(raw, 6) as raw, round(kappa, 6) as kappa, {_BAND} as band,
  {_VERDICT} as verdict, round(jy / n::double, 6) as judge_yes, round(hy / n::double, 6) as human_yes from kk""")
def dimension_agreement(spark, sf):
    t = _rounded(me.dimension_agreement(_raters(spark, sf)))
    return t.withColumns({c: F.round(c, 6) for c in ("judge_yes", "human_yes")})


@query("A18_bias_direction", f"""
with {b.RATINGS}, c as (select dim, count(*) filter (where human and judge) as tp,
  count(*) filter (where human and not judge) as fn, count(*) filter (where not human and judge) as fp,
  count(*) filter (where not human and not judge) as tn from dims group by dim)
select *, case when fp > fn then 'generous' when fn > fp then 'harsh' else 'symmetric' end as leans from c""")
def _(spark, sf):
    return me.bias_direction(me.long_dimensions(_raters(spark, sf)), "human", "judge", ["dim"])


@query("A19_A20_config_summary", f"""
with {CLASSES}, f as (select config, avg(f1) as macro, sum(f1 * support) / sum(support) as weighted
  from scores group by config)
select g.config, count(*) as n, count(*) filter (where error is not null) as errors,
  count(pred) as acc_n, count(*) filter (where gold = pred) as acc_correct,
  round(case when count(pred) > 0 then count(*) filter (where gold = pred) / count(pred)::double end, 6) as acc,
  count(*) filter (where pred is not null and is_hard) as n_hard,
  round(count(*) filter (where gold = pred and is_hard)
    / nullif(count(*) filter (where pred is not null and is_hard), 0)::double, 6) as acc_hard,
  round(case when count(*) filter (where escalated) > 0 then
    count(*) filter (where escalated and should_escalate) / count(*) filter (where escalated)::double else 0 end, 6) as esc_precision,
  round(count(*) filter (where escalated and should_escalate) / count(*) filter (where should_escalate)::double, 6) as esc_recall,
  count(*) filter (where should_escalate and not escalated) as esc_missed,
  round(avg((not escalated)::int), 6) as auto_rate,
  round(count(reply) / count(*)::double, 6) as reply_rate,
  round(sum(input_tokens + output_tokens) / count(*)::double, 4) as tokens,
  round(avg(latency_s), 6) as latency, round(any_value(f.macro), 6) as macro_f1,
  round(any_value(f.weighted), 6) as weighted_f1
from graded g left join f on f.config = g.config group by g.config""")
def config_summary(spark, sf):
    t = me.config_summary(b.graded(spark, sf), b.LANGS)
    six = ["acc", "acc_hard", "esc_precision", "esc_recall", "auto_rate", "reply_rate", "latency",
           "macro_f1", "weighted_f1"]
    return t.withColumns({**{c: F.round(c, 6) for c in six}, "tokens": F.round("tokens", 4)})


@query("A20_hard_subset", f"""
with {b.GRADED} select config, count(*) as n_hard, round(avg((gold = pred)::int), 6) as acc_hard
from graded where is_hard and pred is not null group by config""")
def _(spark, sf):
    t = me.config_summary(b.graded(spark, sf), b.LANGS)
    return t.filter("n_hard > 0").select("config", "n_hard", F.round("acc_hard", 6).alias("acc_hard"))


@query("A21_confused_pairs", f"""
with {b.GRADED} select config, gold, pred, n from counts where gold <> pred
qualify row_number() over (partition by config order by n desc, gold, pred) <= 8""")
def _(spark, sf):
    return me.confused_pairs(_counts(spark, sf), by=["config"])


@query("A22_unstable_boundaries", f"""
with {b.GRADED} select config, least(gold, pred) as label_a, greatest(gold, pred) as label_b, sum(n)::bigint as n
from counts where gold <> pred group by all""")
def _(spark, sf):
    return me.unstable_boundaries(_counts(spark, sf), by=["config"])


@query("U1_label_domain", f"""
with {b.GRADED} select distinct label from (select gold as label from graded union all
  select pred from graded) where label is not null""")
def _(spark, sf):
    return me.label_domain(b.graded(spark, sf))


@query("A3_value_counts", f"""
with {b.RUNS} select pred, count(*) as n, round(count(*) / sum(count(*)) over ()::double, 6) as share
from runs group by pred""")
def _(spark, sf):
    return me.value_counts(b.runs(spark, sf), "pred").withColumn("share", F.round("share", 6))


@query("A4_majority_label", f"""
with {b.ANSWER_KEY} select coalesce((select gold from answer_key where split = 'dev' group by gold
  order by count(*) desc, gold limit 1), 'product_feedback') as label""")
def _(spark, sf):
    return me.majority_label(jn.of_split(b.answer_key(spark, sf), "dev"), "gold")


@query("A24_threshold_what_if", f"""
with {b.GRADED}, t as (select range / 100.0::double as tau from range(101)),
s as (select range / 10.0::double as sigma from range(11)),
c as (select config, confidence, top_similarity, coalesce(escalated, false) as e, should_escalate as x
  from graded),
r as (select config, tau, sigma, x, e or confidence < tau or top_similarity < sigma as review from c, t, s),
g as (select config, tau, sigma, count(*) filter (where review and x) as tp, count(*) filter (where review and not x) as fp,
  count(*) filter (where not review and x) as fn from r group by all)
select config, tau, sigma, tp, fp, fn, tp + fp as review, round(tp / nullif(tp + fn, 0)::double, 6) as recall,
  round(tp / nullif(tp + fp, 0)::double, 6) as precision from g""")
def threshold_what_if(spark, sf):
    g = me.threshold_what_if(b.graded(spark, sf), [i / 100 for i in range(101)],
                             [i / 10 for i in range(11)], by=["config"])
    return g.withColumns({c: F.round(c, 6) for c in ("recall", "precision")})


@query("A27_dimension_pass_rates", f"""
with {b.RATINGS}, v as (select d.dim, case d.dim when 'grounded' then grounded when 'addresses_ask' then addresses_ask
    when 'no_overpromise' then no_overpromise when 'tone_ok' then tone_ok else acceptable end as ok
  from judge, (values ('grounded'), ('addresses_ask'), ('no_overpromise'), ('tone_ok'), ('acceptable')) d(dim)
  where error is null)
select dim, count(*) filter (where ok) as passed, count(*) as n,
  round(count(*) filter (where ok) / count(*)::double, 6) as rate from v group by dim""")
def _(spark, sf):
    return me.dimension_pass_rates(jn.usable(b.judge_ratings(spark, sf))).withColumn(
        "rate", F.round("rate", 6))


@query("A29_progress", f"""
with {b.ANSWER_KEY}, {b.RUNS}, w as (select id from answer_key where split = 'test'),
r as (select id, error from runs where config = 'marks' and confidence < 0.5)
select count(*) as wanted, count(*) filter (where r.id is not null and error is null) as done,
  count(*) filter (where error is not null) as errored from w left join r on r.id = w.id""")
def _(spark, sf):
    wanted = jn.of_split(b.answer_key(spark, sf), "test")
    return jn.progress(wanted, b.runs(spark, sf).filter("config = 'marks' and confidence < 0.5"))


@query("J3_work_remaining", f"""
with {b.ANSWER_KEY}, {b.RUNS} select id from answer_key where id not in (
  select id from runs where config = 'marks' and error is null and confidence < 0.7)""")
def _(spark, sf):
    return jn.work_remaining(b.answer_key(spark, sf), b.runs(spark, sf).filter(
        "config = 'marks' and confidence < 0.7")).select("id")


@query("J6_optional_context", f"""
with {b.RATINGS}, {b.RUNS} select h.id, h.acceptable as human, j.acceptable as judge, md5(r.reply) as reply_md5, r.pred
from human h join judge j on j.id = h.id and j.error is null and h.acceptable <> j.acceptable
left join runs r on r.id = h.id and r.config = 'marks' and r.pred is not null""")
def _(spark, sf):
    odd = _raters(spark, sf).filter("human_acceptable <> judge_acceptable").select(
        "id", F.col("human_acceptable").alias("human"), F.col("judge_acceptable").alias("judge"))
    runs = b.runs(spark, sf).filter("config = 'marks' and pred is not null")
    return jn.with_context(odd, runs.select("id", F.md5("reply").alias("reply_md5"), "pred"))


@query("P8_split_filter", f"""
with {b.ANSWER_KEY} select id, split from answer_key where split = 'test'""")
def _(spark, sf):
    return jn.only_split(jn.of_split(b.answer_key(spark, sf), "test"), "test").select("id", "split")


@query("P10_usable_results", f"with {b.RUNS} select config, id from runs where error is null")
def _(spark, sf):
    return jn.usable(b.runs(spark, sf)).select("config", "id")


CASES = b.GRADED + ", " + b.RATINGS + """, cases as (
  select g.id, g.text, g.pred, coalesce(should_escalate, false) and not coalesce(escalated, false) as is_missed,
    coalesce(escalated, false) as is_escalated, pred is distinct from gold as is_wrong,
    coalesce(h.acceptable <> j.acceptable, false) as is_disagreement
  from graded g left join human h on h.id = g.id
  left join (select * from judge where error is null) j on j.id = g.id where config = 'marks')"""


def _cases(spark, sf):
    human = b.human_ratings(spark, sf).select("id", F.col("acceptable").alias("human_acceptable"))
    judge = jn.usable(b.judge_ratings(spark, sf)).select(
        "id", F.col("acceptable").alias("judge_acceptable"))
    runs = b.graded(spark, sf).filter("config = 'marks'")
    return jn.with_context(jn.with_context(runs, human), judge)


@query("P9_case_modes", f"""
with {CASES} select id, is_missed, is_escalated, is_wrong, is_disagreement from cases""")
def _(spark, sf):
    return jn.case_flags(_cases(spark, sf)).select("id", "is_missed", "is_escalated", "is_wrong",
                                                   "is_disagreement")


@query("P9_case_search", f"""
with {CASES} select id from cases where is_wrong
  and contains(lower(concat_ws(' ', text, pred, id)), 'the')""")
def _(spark, sf):
    return jn.search_cases(_cases(spark, sf), "THE", "wrong").select("id")


@query("P14_acceptable", f"""
with {b.RATINGS} select id, acceptable from human""")
def _(spark, sf):
    return b.human_ratings(spark, sf).select("id", po.acceptable(
        F.col("grounded"), F.col("addresses_ask"), F.col("no_overpromise")).alias("acceptable"))


@query("W10_failures", f"""
with {b.GRADED}, f as (
  select config, id, concat('intent ', pred, ' want ', gold) as why, substr(text, 1, 80) as text
  from graded where pred <> gold
  union all select config, id, 'MISSED escalation', substr(text, 1, 80) from graded
  where should_escalate and not escalated)
select *, row_number() over (partition by config order by id, why) as rank from f qualify rank <= 25""")
def failures(spark, sf):
    return me.failures(b.graded(spark, sf))


@query("U3_common_ids", """
select doc_id as id from documents intersect select doc_id from labels""")
def _(spark, sf):
    return jn.common_ids(b.documents(spark, sf).select(F.col("doc_id").alias("id")),
                         table(spark, sf, "labels").select(F.col("doc_id").alias("id")))


@query("U4_missing_ids", """
select doc_id as id from documents except select doc_id from labels""")
def _(spark, sf):
    return jn.missing_ids(b.documents(spark, sf).select(F.col("doc_id").alias("id")),
                          table(spark, sf, "labels").select(F.col("doc_id").alias("id")))


@query("J12_replay_cases", f"""
with {b.KNN}, ev as (select id, string_agg(concat(neighbour_id, case when rank - 1 in (0, id % 4) then '*' else '' end),
    ',' order by rank) as evidence, max(similarity) as similarity from hits group by id),
h as (select doc_id as id, quality = 1 as ok from labels), j as (select doc_id as id, toxic = 0 as ok from labels)
select k.id, k.gold, k.pred, ev.evidence, h.ok as human_acceptable, j.ok as judge_acceptable
from knn k left join ev on ev.id = k.id left join h on h.id = k.id left join j on j.id = k.id""")
def replay_cases(spark, sf):
    v = b.vectors(spark, sf)
    hits = rt.nearest(v, v, 4, "id", "id")
    index = v.select(F.col("id").alias("tweet_id"), "label")
    gold = v.select("id", F.col("label").alias("gold"))
    runs = rt.ids_of(hits).select("id", "retrieved_ids", F.array(
        F.lit(0).cast("long"), F.col("id") % 4).alias("evidence_ids"))
    evidence = rt.evidence_by_ids(runs.select("id", "retrieved_ids"), index, fields=["label"])
    labels = table(spark, sf, "labels")
    judge = labels.select(F.col("doc_id").alias("id"), (F.col("toxic") == 0).alias("acceptable"))
    human = labels.select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("acceptable"))
    cases = jn.replay_cases(gold, runs.drop("retrieved_ids"), evidence.select("id", "evidence"),
                            judge, human)
    shown = F.transform("evidence", lambda e: F.concat(
        e["tweet_id"].cast("string"), F.when(e["cited"], "*").otherwise("")))
    return cases.select("id", "gold", F.get("evidence", F.lit(0))["label"].alias("pred"),
                        F.array_join(shown, ",").alias("evidence"), "human_acceptable",
                        "judge_acceptable")


@query("A12_nearest_label_agreement", f"""
with {b.KNN}, m as (select label, sum(r) as r, sum(c) as c, sum(a) as a from (
    select gold as label, 1 as r, 0 as c, (gold = pred)::int as a from knn
    union all select pred, 0, 1, 0 from knn) group by label),
k as (select sum(r)::double as n, sum(a)::double as a, sum(r * c)::double as e from m)
select n::bigint as n, a::bigint as agree, round(a / n, 6) as raw,
  round((a / n - e / (n * n)) / (1 - e / (n * n)), 6) as kappa from k""")
def nearest_label_agreement(spark, sf):
    knn = rt.leave_one_out_label(b.vectors(spark, sf))
    return _rounded(me.agreement(me.confusion_counts(knn))).select("n", "agree", "raw", "kappa")


@query("A14_overall_interval", f"""
with {b.GRADED}, s as (select config, sum(n)::bigint as n, coalesce(sum(n) filter (where gold = pred), 0)::bigint as s
  from counts group by config), {WILSON}
select config, round(low, 6) as low, round(high, 6) as high from b""")
def _(spark, sf):
    t = me.accuracy(_counts(spark, sf), ["config"])
    return t.select("config", st.wilson(F.col("acc_correct"), F.col("acc_n")).alias("w")).select(
        "config", F.round("w.low", 6).alias("low"), F.round("w.high", 6).alias("high"))


@query("S5_ordered_report", f"""
with {b.GRADED}, r as (select label_a, label_b, sum(n)::bigint as n from (
    select least(gold, pred) as label_a, greatest(gold, pred) as label_b, n from counts where gold <> pred) group by all)
select label_a, label_b, n, row_number() over (order by n desc, label_a, label_b) as place from r
qualify place <= 5""")
def _(spark, sf):
    top = me.unstable_boundaries(_counts(spark, sf)).orderBy(F.desc("n"), "label_a", "label_b").limit(5)
    place = Window.orderBy(F.desc("n"), "label_a", "label_b")
    return top.withColumn("place", F.row_number().over(place))


@query("J11_threshold_grid", f"""
with {b.GRADED}, t as (select range / 20.0::double as tau from range(21)),
s as (select range / 20.0::double as sigma from range(21))
select tau, sigma, count(*) filter (where coalesce(escalated, false) or confidence < tau
  or top_similarity < sigma) as review from graded, t, s where config = 'marks' group by all""")
def _(spark, sf):
    steps = [i / 20 for i in range(21)]
    return me.threshold_what_if(b.graded(spark, sf).filter("config = 'marks'"), steps, steps).select(
        "tau", "sigma", "review")
