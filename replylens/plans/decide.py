"""Policy, routing and admission queries."""

from pyspark.sql import functions as F

from replylens.functions import policy as po
from replylens.functions import text as tx
from replylens.operators import admission as ad
from replylens.operators import history, live, metrics, reconcile
from replylens.plans import bindings as b
from replylens.plans.registry import query
from replylens.plans.search import EVIDENCE, PASSAGES, passages
from replylens.plans.textual import SQL_REDACT, SQL_TOKENS
from replylens.streaming.triage import triage

PRIOR = f"""turns as (
  select *, count(*) filter (where role = 'user') over (
    partition by conv_id order by turn rows between unbounded preceding and 1 preceding) as prior
  from conversations),
ruled as (select conv_id, turn, role, text, prior, {b.sql_rule('rule', 0, prior='prior')},
  {b.sql_rule('reason', 1, prior='prior')} from turns where role = 'user')"""


def _user_turns(spark, sf):
    return history.prior_messages(b.conversations(spark, sf)).filter("role = 'user'")


@query("R1_policy", f"""
with {PRIOR} select conv_id, turn, rule is not null as should_escalate, reason, rule from ruled""")
def policy(spark, sf):
    v = _user_turns(spark, sf).withColumn("v", po.apply_policy(
        F.col("text"), F.col("prior_messages"), b.RULES))
    return v.select("conv_id", "turn", "v.should_escalate", "v.reason", "v.rule")


@query("R1_policy_documents", f"""
select doc_id, {b.sql_rule('rule', 0)}, {b.sql_rule('reason', 1)} from documents""")
def policy_documents(spark, sf):
    v = b.documents(spark, sf).withColumn("v", po.apply_policy(F.col("text"), None, b.RULES))
    return v.select("doc_id", "v.rule", "v.reason")


_FIRED = "concat_ws('|', " + ", ".join(
    f"case when regexp_matches(text, '{rx}') then concat('{rule}:', regexp_extract(text, '{rx}', 1)) end"
    for rule, _, rx in b.SQL_RULES) + ")"


@query("R2_explain", f"select doc_id, {_FIRED} as fired from documents")
def _(spark, sf):
    hits = po.explain_policy(F.col("text"), None, b.RULES)
    return b.documents(spark, sf).select("doc_id", F.array_join(F.transform(
        hits, lambda h: F.concat_ws(":", h["rule"], h["matched"])), "|").alias("fired"))


DECIDED = f"""decided as (
  select doc_id as id, n_chars, confidence, similarity,
    case when rule is not null then rule when confidence < 0.55 then 'R1'
      when similarity < 0.45 then 'R2' end as source,
    case when rule is not null then reason when confidence < 0.55 then 'low_confidence'
      when similarity < 0.45 then 'no_precedent' end as reason
  from (select doc_id, n_chars, {b.sql_rule('rule', 0)}, {b.sql_rule('reason', 1)},
      case when doc_id % 6 <> 0 then {b.sql_fraction('c', 'doc_id')} end as confidence,
      case when doc_id % 5 <> 0 then {b.sql_fraction('m', 'doc_id')} end as similarity
    from documents))"""


def _decided(spark, sf):
    d = b.documents(spark, sf).select(
        F.col("doc_id").alias("id"), "text", "n_chars",
        F.when(F.col("doc_id") % 6 != 0, b.fraction("c", "doc_id")).alias("confidence"),
        F.when(F.col("doc_id") % 5 != 0, b.fraction("m", "doc_id")).alias("similarity"))
    return d.withColumn("v", po.decide(F.col("text"), F.col("confidence"), F.col("similarity"),
                                       rules=b.RULES))


@query("R3_decision", f"""
with {DECIDED} select id, source is not null as should_escalate, reason, source from decided""")
def decision(spark, sf):
    return _decided(spark, sf).select("id", "v.should_escalate", "v.reason",
                                      F.col("v.rule").alias("source"))


@query("R4_second_opinion", f"""
with {DECIDED} select id, case when id % 3 <> 0 then (n_chars % 2 = 0) <> (source is not null) end
  as disagrees from decided""")
def _(spark, sf):
    opinion = F.when(F.col("id") % 3 != 0, F.col("n_chars") % 2 == 0)
    return _decided(spark, sf).select("id", po.opinion_disagrees(
        opinion, F.col("v.should_escalate")).alias("disagrees"))


@query("A23_escalation_sources", f"""
with {DECIDED} select source, count(*) as n from decided where source is not null group by source""")
def _(spark, sf):
    return metrics.sources(_decided(spark, sf).select(F.col("v.rule").alias("source")), "source")


_WORDS = ["hacked", "not hacked at all", "someone read my email", "charged twice", "delete my data",
          "plain"]


def _risky_text():
    words = F.array(*[F.lit(w) for w in _WORDS])
    return F.concat(F.element_at(words, (F.col("doc_id") % 6 + 1).cast("int")), F.lit(" "),
                    F.col("text"))


SQL_RISKY = (f"concat(([{', '.join(repr(w) for w in _WORDS)}])[(doc_id % 6 + 1)::int], ' ', text)")
SQL_SIGNAL = [
    ("Suspected account security issue",
     r"regexp_matches({t}, '(?i)\b(hack(?:ed|ing)?|phishing|fraud|unauthori[sz]ed|unrecogni[sz]ed|stolen|compromis\w*|takeover)\b')"
     r" and not regexp_matches({t}, '(?i)^\s*(?:i(?:''m| am)? )?(?:not hacked|haven''t been hacked)')"),
    ("Possible account takeover",
     r"regexp_matches({t}, '(?i)(?:email|password).{{0,65}}(?:chang|replac).{{0,65}}(?:wasn.t me|not me|without|didn.t|did not|not authoriz|unknown)|(?:someone|somebody|stranger|unknown device).{{0,65}}(?:account|log|email|password)|(?:wasn.t me|not me).{{0,65}}(?:email|password)')"),
    ("Payment dispute requires verification",
     r"regexp_matches({t}, '(?i)\b(refund|charged twice|double.?charg|charged.{{0,35}}(?:cancel|wrong|more|twice)|payment dispute|disputed charge|card.{{0,25}}(?:stolen|charge))\b')"),
    ("Safety, legal, or privacy review required",
     r"regexp_matches({t}, '(?i)\b(lawyer|lawsuit|sue you|court|legal action|kill|suicide|hurt myself|data deletion|delete my data|privacy breach)\b')"),
]
SQL_SIGNALS = "[" + ", ".join(
    f"case when {rx.format(t='t')} then '{name}' end" for name, rx in SQL_SIGNAL) + "]"


@query("R5_risk_signals", f"""
with r as (select doc_id, {SQL_RISKY} as t from documents)
select doc_id, array_to_string(list_filter({SQL_SIGNALS}, lambda x: x is not null), '|') as signals from r""")
def risk_signals(spark, sf):
    return b.documents(spark, sf).select("doc_id", F.array_join(
        po.risk_signals(_risky_text()), "|").alias("signals"))


@query("R6_routing", f"""
with r as (select doc_id, {SQL_RISKY} as t, text, doc_id % 4 = 1 as needs_human,
    case when doc_id % 8 = 1 then 'Ask billing' else '' end as handoff,
    {b.sql_fraction('c', 'doc_id')} as confidence, doc_id % 3 as n_cited,
    ([{', '.join(f"'{x}'" for x in po.INTENTS)}])[(doc_id % 11 + 1)::int] as intent from documents),
shown as (select *, case when n_cited = 0 then case when doc_id % 2 = 0 then 'Which device?'
    else '{po.NO_SUPPORT_ANSWER}' end else concat('Please try. ', text) end as shown from r),
flags as (select *, regexp_matches(shown, '(?i)https?://|[A-Za-z0-9_.+-]+@[A-Za-z0-9_.-]+\\.[A-Za-z]{{2,}}')
  or regexp_matches(shown, '(?i)\\b(?:I(?:''ve| have)|we(?:''ve| have))\\s+(?:issued|processed|cancelled|canceled|deleted|reset|refunded|sent|updated|verified)\\b') as unsafe from shown),
reasons as (select *, list_filter(list_concat({SQL_SIGNALS}, [
    case when intent in ('account_security', 'billing_charge') then '{po.R_SPECIALIST}' end,
    case when needs_human then coalesce(nullif(handoff, ''), '{po.R_MODEL}') end,
    case when confidence < 0.7 then '{po.R_CONFIDENCE}' end,
    case when n_cited = 0 then '{po.R_UNCITED}' end,
    case when unsafe then '{po.R_UNSAFE}' end]), lambda x: x is not null) as reasons from flags)
select doc_id, case when len(reasons) > 0 then 'human_review' else 'draft_ready' end as routing,
  array_to_string(reasons, '|') as reasons, len(reasons) > 0 as needs_human,
  md5(case when unsafe then '{po.WITHHELD_ANSWER}' else shown end) as answer_md5 from reasons""")
def routing(spark, sf):
    i = F.col("doc_id")
    intents = F.array(*[F.lit(x) for x in po.INTENTS])
    cited = F.slice(F.array(F.lit("KB-1"), F.lit("KB-2")), F.lit(1), (i % 3).cast("int"))
    no_history = F.array().cast("array<struct<role:string,text:string>>")
    d = b.documents(spark, sf).select(i, po.route(
        _risky_text(), no_history, F.element_at(intents, (i % 11 + 1).cast("int")), i % 4 == 1,
        F.when(i % 8 == 1, "Ask billing").otherwise(""), b.fraction("c", "doc_id"),
        F.size(cited), cited, F.concat(F.lit("Please try. "), F.col("text")),
        F.when(i % 2 == 0, "Which device?").otherwise("")).alias("r"))
    return d.select("doc_id", "r.routing", F.array_join("r.routing_reasons", "|").alias("reasons"),
                    "r.needs_human", F.md5("r.answer").alias("answer_md5"))


@query("P12_output_checks", """
with o as (select doc_id, lang, n_chars, text, doc_id % 5 = 0 as broken from documents)
select doc_id, concat_ws(',',
  case when broken or lang not in ('en', 'fr') then 'intent' end,
  case when broken or n_chars / 1000.0 > 1 then 'confidence' end,
  case when broken or len(text) > 1600 then 'answer' end,
  case when broken or len(text) > 350 then 'summary' end,
  case when broken or doc_id % 7 = 0 then 'needs_human' end,
  case when broken then 'cited_doc_ids' end,
  case when broken or doc_id % 3 = 0 then 'unknown_citation' end,
  case when broken or len(text) > 350 then 'handoff_reason' end,
  case when broken then 'clarification_question' end) as violations from o""")
def output_checks(spark, sf):
    i = F.col("doc_id")
    good = F.to_json(F.struct(
        F.col("lang").alias("intent"), (F.col("n_chars") / 1000.0).alias("confidence"),
        F.col("text").alias("answer"), F.col("text").alias("summary"),
        F.when(i % 7 != 0, True).alias("needs_human"),
        F.when(i % 3 == 0, F.array(F.lit("src0"), F.lit("fake"))).otherwise(
            F.array(F.lit("src0"))).alias("cited_doc_ids"),
        F.col("text").alias("handoff_reason"),
        F.lit("").alias("clarification_question")))
    raw = F.when(i % 5 == 0, F.lit("{oops")).otherwise(good)
    o = b.documents(spark, sf).select(i, po.parse_output(raw).alias("o"))
    allowed = F.array(F.lit("src0"), F.lit("src1"))
    return o.select("doc_id", F.array_join(po.output_violations(
        F.col("o"), allowed, ["en", "fr"]), ",").alias("violations"))


@query("P13_label_errors", f"""
with {b.LABEL_ROWS} select id, concat_ws(',',
  case when should_escalate and escalation_reason is null then 'escalate_without_reason' end,
  case when not should_escalate and escalation_reason is not null then 'reason_without_escalate' end,
  case when escalation_reason = 'low_confidence' then 'reason_not_allowed' end) as errors
from statuses""")
def _(spark, sf):
    return b.label_rows(spark, sf).select("id", F.array_join(po.label_errors(
        F.col("should_escalate"), F.col("escalation_reason")), ",").alias("errors"))


@query("R7_label_status", f"""
with {b.LABEL_ROWS} select id, status, needs_review as pending from statuses""")
def _(spark, sf):
    return reconcile.reconcile_labels(b.label_rows(spark, sf), b.RULES).select(
        "id", "status", "pending")


@query("A28_reconciliation_counts", f"""
with {b.LABEL_ROWS} select count(*) as labelled, sum(n_errors)::bigint as schema_errors,
  count(*) filter (where status = 'deliberate') as deliberate,
  count(*) filter (where status = 'unexplained') as unexplained,
  count(*) filter (where needs_review) as pending,
  (sum(n_errors) + count(*) filter (where status = 'unexplained')
    + count(*) filter (where needs_review))::bigint as problems from statuses""")
def reconciliation(spark, sf):
    return reconcile.reconciliation_counts(
        reconcile.reconcile_labels(b.label_rows(spark, sf), b.RULES))


ASKED = f"""asked as (select id, intent in ('account_security', 'billing_charge', 'plan_or_family',
  'account_access') or {' or '.join(f"regexp_matches(text, '{rx}')" for _, _, rx in b.SQL_RULES)}
  as asked from label_rows)"""


@query("R8_adjudication_queue", f"""
with {b.LABEL_ROWS}, {ASKED} select id from asked where asked""")
def _(spark, sf):
    return reconcile.adjudication_queue(b.label_rows(spark, sf), b.RULES).select("id")


@query("A30_hand_confirmed_share", f"""
with {b.LABEL_ROWS}, {ASKED} select count(*) as n, count(*) filter (where asked) as confirmed,
  round(avg(asked::int), 6) as share from asked""")
def _(spark, sf):
    return reconcile.hand_confirmed_share(b.label_rows(spark, sf), b.RULES).withColumn(
        "share", F.round("share", 6))


SMALL = ad.Caps(client_minute=1, client_day=3, all_minute=8, all_day=100, minute=3600)


@query("W11_client_caps", f"""
with {b.REQUESTS}, m as (select *, row_number() over (partition by client, ts // 3600 order by ts, "row") as a
  from requests),
d as (select "row", row_number() over (partition by client, ts // 86400 order by ts, "row") as c
  from m where a <= 1)
select r."row", r.client, coalesce(d.c <= 3, false) as admitted
from requests r left join d on d."row" = r."row" """)
def client_caps(spark, sf):
    return ad.admit_per_client(b.requests(spark, sf), SMALL).select("row", "client", "admitted")


@query("ST3_usage_counts", f"""
with {b.REQUESTS}
select 'client_minute' as scope, client, ts // 60 as bucket, count(*) as n from requests group by all
union all select 'client_day', client, ts // 86400, count(*) from requests group by all
union all select 'all_minute', null, ts // 60, count(*) from requests group by all
union all select 'all_day', null, ts // 86400, count(*) from requests group by all""")
def _(spark, sf):
    return ad.usage_counts(b.requests(spark, sf))


@query("ST1_batch_triage", f"""
with {PRIOR}, c as (select conv_id, turn, role, text,
    count(*) filter (where role = 'system') over w as bad
  from conversations window w as (partition by conv_id order by turn rows between 4 preceding and 1 preceding)),
v as (select conv_id, turn, bad > 0 as rejected, {SQL_REDACT.format("regexp_replace(text, '^[ ]+|[ ]+$', '', 'g')")} as clean
  from c where role = 'user'),
t as (select *, {b.sql_rule('rule', 0, 'clean')} from v)
select conv_id, turn, md5(clean) as message_md5, case when not rejected then rule end as rule,
  case when rejected then 'rejected' when rule is not null then 'human_review' else 'to_draft' end as routing
from t""")
def batch_triage(spark, sf):
    asked = history.recent_turns(b.conversations(spark, sf), 4).filter("role = 'user'").select(
        "conv_id", "turn", F.col("text").alias("message"), "history",
        F.lit(None).cast("string").alias("policy"))
    return triage(asked, b.RULES).select(
        "conv_id", "turn", F.md5("message").alias("message_md5"),
        F.col("verdict.rule").alias("rule"), "routing")


@query("P11_T6_style_and_redaction", f"""
select doc_id, case when doc_id % 2 = 0 then 'detailed' else 'concise' end as style,
  text <> {SQL_REDACT.format('text')} as redacted from documents""")
def _(spark, sf):
    style = F.when(F.col("doc_id") % 2 == 0, "detailed").when(F.col("doc_id") % 3 == 0, "odd")
    return b.documents(spark, sf).select(
        "doc_id", po.reply_style(style).alias("style"),
        (F.col("text") != tx.redact(F.col("text"))).alias("redacted"))


@query("R6_P12_J9_live_decision", f"""
with {PASSAGES},
c as (select *, {SQL_REDACT.format('text')} as said,
    {SQL_REDACT.format("regexp_replace(text, '^[ ]+|[ ]+$', '', 'g')")} as message from conversations),
a as (select conv_id, turn, role, message, len(text) as size, count(*) filter (where role = 'system') over w > 0 as bad,
    last_value(case when role = 'user' then said end ignore nulls) over w as previous,
    concat(message, ' ', coalesce(array_to_string(list(said) filter (where role = 'user') over w, ' '), '')) as t
  from c window w as (partition by conv_id order by turn rows between 4 preceding and 1 preceding)),
asked as (select * from a where role = 'user'),
q as (select conv_id, turn, unnest(list_distinct({SQL_TOKENS.format("concat_ws(' ', message, previous)")})) as term
  from asked), {EVIDENCE},
found as (select conv_id, turn, string_agg(ord, '|' order by rank) as ids, bool_or(ord = 1) as has_1 from top group by all),
o as (select asked.*, coalesce(ids, '') as ids, conv_id % 3 = 1 as cites,
    concat_ws(',', case when size < 4 or size > 2000 then 'invalid_message' end,
      case when bad then 'invalid_history' end) as violations,
    case when conv_id % 7 = 0 then 'intent,confidence,answer,summary,needs_human,cited_doc_ids,unknown_citation,handoff_reason,clarification_question'
      when conv_id % 3 = 1 and not coalesce(has_1, false) then 'unknown_citation' else '' end as broken,
    ([{', '.join(f"'{x}'" for x in po.INTENTS)}])[((conv_id + turn) % 11 + 1)::int] as intent
  from asked left join found using (conv_id, turn)),
r as (select *, array_to_string(list_filter(list_concat({SQL_SIGNALS}, [
    case when intent in ('account_security', 'billing_charge') then '{po.R_SPECIALIST}' end,
    case when conv_id % 4 = 1 then '{po.R_MODEL}' end,
    case when conv_id % 10 < 7 then '{po.R_CONFIDENCE}' end,
    case when not cites or ids = '' then '{po.R_UNCITED}' end]), lambda x: x is not null), '|') as reasons from o)
select conv_id, turn, ids as evidence, broken,
  case when violations <> '' then 'rejected' when broken <> '' or reasons <> '' then 'human_review' else 'draft_ready' end as routing,
  case when violations <> '' then replace(violations, ',', '|') when broken <> '' then 'invalid_model_output' else reasons end as reasons,
  case when violations = '' and broken = '' then case when cites then 'Please try this.'
    when turn % 2 = 0 then 'Which device?' else '{po.NO_SUPPORT_ANSWER}' end end as answer from r""")
def live_decision(spark, sf):
    """Customer turns as requests; the model's answers are made from the ids."""
    conv, turn = F.col("conv_id"), F.col("turn")
    intents = F.array(*[F.lit(x) for x in po.INTENTS])
    answer = F.to_json(F.struct(
        F.element_at(intents, ((conv + turn) % 11 + 1).cast("int")).alias("intent"),
        (conv % 10 / 10).alias("confidence"), F.lit("Please try this.").alias("answer"),
        F.lit("A case.").alias("summary"), (conv % 4 == 1).alias("needs_human"),
        F.when(conv % 3 == 1, F.array(F.lit("1"))).otherwise(F.array().cast("array<string>"))
        .alias("cited_doc_ids"), F.lit("").alias("handoff_reason"),
        F.when(turn % 2 == 0, "Which device?").otherwise("").alias("clarification_question")))
    asked = history.recent_turns(b.conversations(spark, sf), 4).filter("role = 'user'").select(
        "conv_id", "turn", F.col("text").alias("message"), "history",
        F.lit(None).cast("string").alias("policy"),
        F.when(conv % 7 == 0, "{oops").otherwise(answer).alias("raw"))
    d = live.live_decisions(asked, passages(spark, sf), ["conv_id", "turn"])
    return d.select(
        "conv_id", "turn",
        F.array_join(F.transform("evidence", lambda e: e["id"]), "|").alias("evidence"),
        F.array_join("output_violations", ",").alias("broken"), "decision.routing",
        F.array_join("decision.routing_reasons", "|").alias("reasons"), "decision.answer")
