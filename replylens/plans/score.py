"""Scoring, classifier and baseline queries."""

import pandas as pd
from pyspark.sql import functions as F

from replylens.operators import benchmark as bench
from replylens.operators import gramclassifier as gc
from replylens.operators import joins as jn
from replylens.operators import metrics as me
from replylens.operators import retrieval as rt
from replylens.operators import scoring as sc
from replylens.operators.sampling import SEED
from replylens.plans import bindings as b
from replylens.plans.registry import query, table
from replylens.session import materialise, scratch_path
from replylens.sources import results


def _mark_scorer(pdf: pd.DataFrame) -> pd.DataFrame:
    t, bad = pdf["text"], pdf["doc_id"] % 50 == 0
    got = pd.DataFrame({"pred": t.str.contains("the", regex=False).map({True: "en", False: "xx"}),
                        "n_marks": t.str.count("e").astype("Int64")}).mask(bad, None)
    return got.assign(error=bad.map({True: "ValueError: no answer", False: None}))


@query("M1_batch_scoring", """
select doc_id, case when doc_id % 50 <> 0 then case when contains(text, 'the') then 'en' else 'xx' end end as pred,
  case when doc_id % 50 <> 0 then len(text) - len(replace(text, 'e', '')) end as n_marks,
  case when doc_id % 50 = 0 then 'ValueError: no answer' end as error from documents""")
def batch_scoring(spark, sf):
    """A scorer that fails on some rows; only those rows carry an error."""
    d = b.documents(spark, sf).select("doc_id", "text")
    return sc.score_batches(d, _mark_scorer, "pred string, n_marks long").select(
        "doc_id", "pred", "n_marks", "error")


def _length_scorer(broken: bool):
    def scorer(pdf: pd.DataFrame) -> pd.DataFrame:
        bad = (pdf["id"] % 50 == 0) & broken
        return pd.DataFrame({"pred": (pdf["n_chars"] % 7).astype("Int64").mask(bad),
                             "error": bad.map({True: "TimeoutError: slow", False: None})})
    return scorer


@query("J3_M1_IO6_resumed_run", """
select doc_id as id, n_chars % 7 as pred, case when doc_id % 50 = 0 then 2 else 1 end as run_ts
from documents""")
def resumed_run(spark, sf):
    """Two runs of a scorer that fails on some rows the first time: each good row is scored once."""
    path = scratch_path(spark, "resumed")
    items = b.documents(spark, sf).select(F.col("doc_id").alias("id"), "n_chars")
    for run_ts in (1, 2):
        sc.score_remaining(items, path, "lengths", run_ts, _length_scorer(run_ts == 1), "pred long")
    return results.read_results(spark, path).select("id", "pred", F.col("run_ts").cast("int"))


def _judge_scorer(pdf: pd.DataFrame) -> pd.DataFrame:
    n, bad = pdf["n_chars"], pdf["id"] % 90 == 0
    got = pd.DataFrame({"grounded": n > 150, "addresses_ask": n > 260, "no_overpromise": n % 9 != 0,
                        "tone_ok": n % 2 == 0}).astype(object).mask(bad, None)
    return got.assign(error=bad.map({True: "TimeoutError: judge", False: None}))


@query("M5_judge_stage", """
select doc_id as id, case when doc_id % 90 <> 0 then n_chars > 260 and n_chars % 9 <> 0 end as acceptable,
  case when doc_id % 90 = 0 then 'TimeoutError: judge' end as error from documents""")
def _(spark, sf):
    d = b.documents(spark, sf).select(F.col("doc_id").alias("id"), "n_chars")
    return sc.judged(sc.score_batches(d, _judge_scorer, sc.VERDICT_FIELDS)).select(
        "id", "acceptable", "error")


def _labelled(spark, sf):
    return b.answer_key(spark, sf).select("id", "text", F.col("gold").alias("label"), "split")


@query("M2_text_classifier")
def text_classifier(spark, sf):
    items = _labelled(spark, sf)
    model = gc.fit_text_classifier(jn.of_split(items, "dev"), min_df=2.0)
    scored = gc.classify_text(model, jn.of_split(items, "test"))
    return scored.select("id", "label", "pred", F.round("confidence", 3).alias("confidence"))


@query("M2_class_mass", f"""
with {b.ANSWER_KEY}, dev as (select gold as label from answer_key where split = 'dev')
select label, round(sum(count(*)) over () / count(*) over ()::double, 2) as mass from dev group by label""")
def class_mass(spark, sf):
    """At the best fit the probabilities of a class over the training rows, each row weighted as in
    the fit, add up to the weight of the class itself, which is the same for all classes."""
    dev = jn.of_split(_labelled(spark, sf), "dev")
    model = gc.fit_text_classifier(dev, min_df=2.0, tol=1e-7)
    names = F.array(*[F.lit(x) for x in model.about()["labels"]])
    sizes = dev.groupBy("label").agg(F.count("*").alias("n"))
    whole = sizes.agg((F.sum("n") / F.count("*")).alias("even")).scalar()
    scored = gc.classify_text(model, dev).join(F.broadcast(sizes), "label")
    each = F.explode(F.arrays_zip(names.alias("label"), F.col("probabilities").alias("p"))).alias("e")
    return (scored.select((whole / F.col("n")).alias("weight"), each)
            .groupBy(F.col("e.label").alias("label")).agg(F.round(F.sum(F.col("weight") * F.col("e.p")), 2).alias("mass")))


def _letter_scorer(pdf: pd.DataFrame) -> pd.DataFrame:
    """Answers by the length of a text: at times outside the categories, at times not at all."""
    size = pdf["text"].str.len()
    names = pd.Series(["en", "de", "fr", "es", "none of these"])
    return pd.DataFrame({"pred": names[size % 5].where((size % 11 != 0).to_numpy()).to_numpy(),
                         "error": (size % 11 == 0).map({True: "TimeoutError: scorer", False: None}).to_numpy()})


CHECKED = f"""
with {b.ANSWER_KEY}, drawn as (
  select gold, length(text) as size from answer_key where split = 'test'
  qualify row_number() over (partition by gold order by md5('{SEED}:' || text), text) <= 40),
scored as (select gold, ['en', 'de', 'fr', 'es', 'none of these'][size % 5 + 1] as pred, size % 11 = 0 as failed from drawn),
graded as (select gold, pred from scored where not failed),
labels as (select gold as label from graded union select pred from graded),
f as (select label, count(*) filter (gold = label and pred = label) as tp, count(*) filter (gold = label or pred = label) as every
  from labels, graded group by label),
f1 as (select avg(2.0 * tp / (every + tp)) as macro_f1 from f)
"""


@query("IO10_external_check", CHECKED + """select 'lengths' as approach, count(*) as n,
  (select count(*) from scored where failed) as errors,
  count(*) filter (pred not in (select gold from scored)) as off_taxonomy, count(distinct gold) as classes,
  count(*) filter (gold = pred) as correct, round(any_value(macro_f1), 6) as macro_f1 from graded, f1""")
def external_sample(spark, sf):
    """Forty texts of every language through a scorer that fails and answers off the list at times."""
    test = jn.of_split(b.answer_key(spark, sf), "test").select("text", F.col("gold").alias("category"))
    scored = bench.scored_sample(test, _letter_scorer, 40).withColumn("approach", F.lit("lengths"))
    return bench.check_summary(materialise(scored, "scored")).select(
        "approach", "n", "errors", "off_taxonomy", "classes", "correct", F.round("macro_f1", 6).alias("macro_f1"))


@query("M2_external_check")
def external_check(spark, sf):
    """The classifier on all labelled texts it was not fitted on, beside the scorer's sample."""
    rows = b.answer_key(spark, sf).select("text", F.col("gold").alias("category"), "split")
    scored = bench.external_check(jn.of_split(rows, "dev"), jn.of_split(rows, "test"), {"lengths": _letter_scorer}, 40)
    return bench.check_summary(scored).select(
        "approach", "n", "errors", "off_taxonomy", "classes", "correct", "interval", F.round("macro_f1", 3).alias("macro_f1"))


@query("IO9_model_store")
def model_store(spark, sf):
    items = _labelled(spark, sf)
    path = scratch_path(spark, "model")
    gc.load_or_fit_classifier(spark, path, lambda at: gc.fit_text_classifier(jn.of_split(items, "dev"), min_df=5.0, path=at))
    model = gc.load_or_fit_classifier(spark, path, lambda at: None)
    return gc.classify_text(model, jn.of_split(items, "test")).select("id", "label", "pred")


@query("IO9_stored_idf", f"""
with {b.ANSWER_KEY}, dev as (select id, text, count(*) over () as n from answer_key where split = 'dev'),
w as (select distinct id, n, unnest(regexp_extract_all(lower(strip_accents(text)), '[\\p{{L}}\\p{{Nd}}_]{{2,}}')) as gram from dev)
select gram, round(ln((1 + max(n)) / (1 + count(*))::double) + 1, 6) as idf from w group by gram having count(*) >= 5""")
def stored_idf(spark, sf):
    """The words of a stored model, read back, with their inverse document frequencies."""
    items = _labelled(spark, sf)
    path = scratch_path(spark, "model")
    gc.fit_text_classifier(jn.of_split(items, "dev"), min_df=5.0, path=path)
    model = gc.load_or_fit_classifier(spark, path, lambda at: None)
    return model.grams().filter("not contains(gram, ' ')").select("gram", F.round("idf", 6).alias("idf"))


@query("M3_hashed_vectors")
def _(spark, sf):
    v = sc.hashed_vectors(b.documents(spark, sf).select("doc_id", "text"))
    return v.select("doc_id", "vector")


def _letters(texts: pd.Series) -> list:
    return [[t.count(c) + 1 for c in "aeiou"] for t in texts]


@query("M3_encoded_vectors", """
with c as (select doc_id, [len(text) - len(replace(text, x, '')) + 1.0::double for x in ['a', 'e', 'i', 'o', 'u']] as v
  from documents)
select doc_id, round(v[1] / sqrt(list_dot_product(v, v)), 6) as a, round(v[5] / sqrt(list_dot_product(v, v)), 6) as u
from c""")
def encoded_vectors(spark, sf):
    v = sc.encode_text(b.documents(spark, sf).select("doc_id", "text"), _letters)
    return v.select("doc_id", F.round(F.get("vector", F.lit(0)), 6).alias("a"),
                    F.round(F.get("vector", F.lit(4)), 6).alias("u"))


def _baselines(spark, sf, near=None):
    v = b.vectors(spark, sf)
    items = v.select("id")
    dev = v.filter(b.fraction("s", "id") < 0.3)
    canned = sc.top_template(b.documents(spark, sf), "text", "doc_id")
    near = rt.nearest(v, v, 1, "id", "id") if near is None else near
    reply = v.select(F.col("id").alias("neighbour_id"),
                     F.concat(F.lit("case "), "label").alias("reply"))
    retrieved = near.join(reply, "neighbour_id").select(
        "id", "reply", F.col("similarity").alias("top_similarity"))
    return sc.baseline_runs(items, me.majority_label(dev, "label"), canned, retrieved)


# The largest reply template, exactly as the canned baseline picks it.
_CANNED = r"""g as (select lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    regexp_replace(regexp_replace(text, '@[\p{L}\p{N}_]+', '', 'g'), 'https?://[^\s]+', '', 'g'),
    '^\s+|\s+$', '', 'g'), '[/^-]\s*[A-Z]{1,3}\s*$', ''), '\p{Nd}+', '', 'g'), '\s+', ' ', 'g'))) as k,
    count(*) as n, min(doc_id) as first_id from documents group by 1),
canned as (select d.text as reply from (select * from g order by n desc, first_id limit 1) t
  join documents d on d.doc_id = t.first_id),
majority as (select label::varchar as label from embeddings where FRACTION < 0.3 group by label
  order by count(*) desc, label::varchar limit 1)""".replace("FRACTION", b.sql_fraction("s", "vec_id"))

BASELINES = f"""{b.KNN}, {_CANNED}, runs as (
  select k.id, k.gold, (select label from majority) as pred, c.config,
    case c.config when 'canned' then (select reply from canned)
      when 'retrieval_verbatim' then concat('case ', k.pred) end as reply,
    case c.config when 'trivial_always_escalate' then true when 'retrieval_verbatim' then null else false end as escalated,
    case c.config when 'canned' then 'B1' when 'retrieval_verbatim' then 'B3' else 'B0' end as escalation_source,
    case when c.config = 'retrieval_verbatim' then k.similarity end as top_similarity
  from knn k, (values ('trivial_always_auto'), ('trivial_always_escalate'), ('canned'), ('retrieval_verbatim')) c(config))"""


@query("R9_baseline_runs", f"""
with {BASELINES} select config, id, pred, md5(reply) as reply_md5, escalated, escalation_source,
  round(top_similarity, 4) as top_similarity from runs""")
def baseline_runs(spark, sf):
    return _baselines(spark, sf).select(
        "config", "id", "pred", F.md5("reply").alias("reply_md5"), "escalated",
        "escalation_source", F.round("top_similarity", 4).alias("top_similarity"))


@query("M4_config_comparison", f"""
with {BASELINES}, all_runs as (select config, gold, pred, escalated, reply, id % 7 = 0 as should from runs
  union all select 'nearest_label', gold, pred, similarity < 0.35, null, id % 7 = 0 from knn)
select config, count(*) as n, count(*) filter (where gold = pred) as acc_correct,
  round(count(*) filter (where gold = pred) / count(*)::double, 6) as acc,
  count(*) filter (where should and not escalated) as missed, count(reply) as replies from all_runs
group by config""")
def config_comparison(spark, sf):
    """Baselines and a nearest-label classifier graded in one grouped aggregate."""
    v = b.vectors(spark, sf)
    key = v.select("id", F.col("label").alias("gold"), (F.col("id") % 7 == 0).alias("should_escalate"),
                   F.lit(False).alias("is_hard"))
    near = materialise(rt.nearest(v, v, 1, "id", "id"), "nearest")
    knn = rt.leave_one_out_label(v, hits=near).select(
        F.lit("nearest_label").alias("config"), "id", "pred",
        (F.col("top_similarity") < 0.35).alias("escalated"), F.lit(None).cast("string").alias("reply"))
    runs = _baselines(spark, sf, near).select("config", "id", "pred", "escalated", "reply").unionByName(knn)
    zero = {"input_tokens": F.lit(0), "output_tokens": F.lit(0), "latency_s": F.lit(0.0),
            "error": F.lit(None).cast("string")}
    t = me.config_summary(jn.graded(key, jn.without_texts(runs)).withColumns(zero), [str(i) for i in range(10)])
    return t.select("config", "n", "acc_correct", F.round("acc", 6).alias("acc"),
                    F.coalesce("esc_missed", F.lit(0).cast("long")).alias("missed"),
                    F.round(F.col("reply_rate") * F.col("n")).cast("long").alias("replies"))


STORED_RUNS = f"""
with {b.RUNS}, attempts as (
  select config, id, pred, error, 1 as run_ts from runs
  union all select config, id, pred || '+', case when id % 4 = 0 then 'again' end, 2 from runs
    where config = 'marks')
select config, id, pred, run_ts from attempts where error is null
qualify row_number() over (partition by config, id order by run_ts desc) = 1"""


def _two_runs(spark, sf, between=lambda path: None):
    path = scratch_path(spark, "results")
    runs = b.runs(spark, sf).select("config", "id", "pred", "error")
    results.append_results(runs, path, 1)
    between(path)
    again = runs.filter("config = 'marks'").select(
        "config", "id", F.concat("pred", F.lit("+")).alias("pred"),
        F.when(F.col("id") % 4 == 0, "again").alias("error"))
    results.append_results(again, path, 2)
    return results.read_results(spark, path).select("config", "id", "pred", F.col("run_ts").cast("int"))


@query("IO6_result_store", STORED_RUNS)
def result_store(spark, sf):
    return _two_runs(spark, sf)


@query("IO6_result_store_compacted", STORED_RUNS)
def result_store_compacted(spark, sf):
    """The first run is read from a base, the second beside it."""
    return _two_runs(spark, sf, lambda path: results.compact_results(spark, path))


@query("A3_training_classes", """
select label::varchar as label, count(*) as n, round(count(*) / sum(count(*)) over ()::double, 6) as share
from embeddings group by label""")
def _(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("label").cast("string").alias("label"))
    return me.value_counts(v, "label").withColumn("share", F.round("share", 6))
