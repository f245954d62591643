"""Decision columns: ordered policy, runtime gates, risk signals, routing, checks.

A rule list is a parameter everywhere: ``[(rule, reason, [patterns])]`` in the order
in which rules are tried. Each rule becomes one expression, so a row is scanned once by
JVM code and there is no join with a rule table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from replylens.functions.text import SPACE, unicode_rx, uni_trim, unsafe_draft

Rule = tuple[str, str, Sequence[str]]

# Escalation reasons; the first five may appear in an answer key.
REASONS = ["security_risk", "money_movement", "legal_or_reputational", "safety",
           "repeat_contact", "low_confidence", "no_precedent"]
LABEL_REASONS = REASONS[:5]

# Labels of the support taxonomy, in order.
INTENTS = ["playback_issue", "content_unavailable", "billing_charge", "plan_or_family",
           "account_access", "account_security", "app_bug", "product_feedback", "how_to",
           "dm_followup", "other"]
ESCALATABLE = ["account_security", "billing_charge", "plan_or_family", "account_access"]
SPECIALIST_INTENTS = ["account_security", "billing_charge"]

# Content rules E1 to E4; E5 is the number of earlier messages.
DEFAULT_RULES: list[Rule] = [
    ("E1", "security_risk", [
        r"\bhack(ed|ing)?\b", r"\bcompromis(ed|e)\b", r"\bstolen\b",
        r"someone (else )?(is |has )?(us(ing|ed)|logged|access)",
        r"\bunauthori[sz]ed\b", r"\bfraud(ulent)?\b", r"\bphish(ing)?\b",
        r"not me\b.{0,30}\b(login|log in|sign in|charge)"]),
    ("E2", "money_movement", [
        r"charg(ed|ing|e) me (twice|again|\d+ times)", r"double[- ]?charg",
        r"\bcharged\b.{0,40}\b(after|despite|even though).{0,20}cancel",
        r"\brefund\b", r"\bmoney back\b", r"\breimburse", r"\bchargeback\b",
        r"\bdispute\b.{0,20}\bcharge\b", r"billed .{0,20}(twice|again|wrong)",
        r"took .{0,15}(money|payment) .{0,15}(twice|again)"]),
    ("E3", "legal_or_reputational", [
        r"\blawyer\b", r"\bsolicitor\b", r"\battorney\b", r"\blegal action\b",
        r"\bsue\b", r"\bsuing\b", r"\bcourt\b", r"\bombudsman\b",
        r"\btrading standards\b", r"\bsmall claims\b", r"\bregulator\b",
        r"\b(bbc|watchdog|the press|the media|journalist)\b",
        r"\bgdpr\b", r"\bdata protection\b"]),
    ("E4", "safety", [
        r"\bkill (my ?self|me)\b", r"\bsuicid", r"\bend (my|it) (life|all)\b",
        r"\bself[- ]harm\b", r"\bwant to die\b",
        r"\bi.?ll (kill|hurt|find) you\b", r"\bthreaten"]),
]
REPEAT_RULE, REPEAT_REASON, REPEAT_FROM = "E5", "repeat_contact", 2

# Thresholds of the runtime gates.
TAU = 0.55
SIGMA = 0.45
REVIEW_CONFIDENCE = 0.7

# Live risk families (name, pattern, exception).
RISK_FAMILIES = [
    ("Suspected account security issue",
     r"(?i)\b(hack(?:ed|ing)?|phishing|fraud|unauthori[sz]ed|unrecogni[sz]ed|stolen|"
     r"compromis\w*|takeover)\b",
     r"(?i)^" + SPACE + r"*(?:i(?:'m| am)? )?(?:not hacked|haven't been hacked)"),
    ("Possible account takeover",
     r"(?i)(?:email|password).{0,65}(?:chang|replac).{0,65}(?:wasn.t me|not me|without|didn.t|"
     r"did not|not authoriz|unknown)|(?:someone|somebody|stranger|unknown device).{0,65}"
     r"(?:account|log|email|password)|(?:wasn.t me|not me).{0,65}(?:email|password)", None),
    ("Payment dispute requires verification",
     r"(?i)\b(refund|charged twice|double.?charg|charged.{0,35}(?:cancel|wrong|more|twice)|"
     r"payment dispute|disputed charge|card.{0,25}(?:stolen|charge))\b", None),
    ("Safety, legal, or privacy review required",
     r"(?i)\b(lawyer|lawsuit|sue you|court|legal action|kill|suicide|hurt myself|"
     r"data deletion|delete my data|privacy breach)\b", None),
]

# Texts shown when a draft is withheld, and the stated reasons.
NO_SUPPORT_ANSWER = ("I don’t have enough verified support knowledge to resolve this. "
                     "A human should review the case.")
WITHHELD_ANSWER = ("This request needs a support specialist. I cannot verify or perform "
                   "account actions in this demo.")
R_SPECIALIST = "This intent requires specialist review"
R_MODEL = "The model recommends human review"
R_CONFIDENCE = "Low self-reported classification confidence"
R_UNCITED = "No cited support knowledge"
R_UNSAFE = "Draft failed the external-action or contact-detail check"

MODEL_OUTPUT = T.StructType([
    T.StructField("intent", T.StringType()), T.StructField("confidence", T.DoubleType()),
    T.StructField("summary", T.StringType()), T.StructField("answer", T.StringType()),
    T.StructField("cited_doc_ids", T.ArrayType(T.StringType())),
    T.StructField("needs_human", T.BooleanType()),
    T.StructField("handoff_reason", T.StringType()),
    T.StructField("clarification_question", T.StringType()),
])


def rule_pattern(patterns: Sequence[str]) -> str:
    return unicode_rx("|".join(patterns))


def _verdict(rule: str, reason: str) -> Column:
    return F.struct(F.lit(True).alias("should_escalate"), F.lit(reason).alias("reason"),
                    F.lit(rule).alias("rule"))


def _no_verdict() -> Column:
    return F.struct(F.lit(False).alias("should_escalate"),
                    F.lit(None).cast("string").alias("reason"),
                    F.lit(None).cast("string").alias("rule"))


def apply_policy(text: Column, prior: Column | None = None,
                 rules: Sequence[Rule] = DEFAULT_RULES) -> Column:
    """struct(should_escalate, reason, rule) of the first rule that fires."""
    text = F.coalesce(text, F.lit(""))
    tried = [F.when(text.rlike(rule_pattern(rx)), _verdict(rule, reason))
             for rule, reason, rx in rules]
    if prior is not None:
        tried.append(F.when(prior >= REPEAT_FROM, _verdict(REPEAT_RULE, REPEAT_REASON)))
    return F.coalesce(*tried, _no_verdict())


def explain_policy(text: Column, prior: Column | None = None,
                   rules: Sequence[Rule] = DEFAULT_RULES) -> Column:
    """R2: every rule that fires, in order, with the text it matched."""
    text = F.coalesce(text, F.lit(""))
    hits = [F.when(text.rlike(rule_pattern(rx)), F.struct(
        F.lit(rule).alias("rule"), F.lit(reason).alias("reason"),
        F.regexp_extract(text, rule_pattern(rx), 0).alias("matched")))
        for rule, reason, rx in rules]
    if prior is not None:
        hits.append(F.when(prior >= REPEAT_FROM, F.struct(
            F.lit(REPEAT_RULE).alias("rule"), F.lit(REPEAT_REASON).alias("reason"),
            F.concat(prior.cast("string"), F.lit(" prior messages")).alias("matched"))))
    return F.array_compact(F.array(*hits))


def decide(text: Column, confidence: Column, top_similarity: Column,
           prior: Column | None = None, rules: Sequence[Rule] = DEFAULT_RULES,
           tau: float = TAU, sigma: float = SIGMA) -> Column:
    """The content verdict if any, else R1 (confidence), else R2 (precedent).

    A null signal never fires, and a value equal to its threshold does not either.
    """
    content = apply_policy(text, prior, rules)
    return F.coalesce(
        F.when(content["should_escalate"], content),
        F.when(confidence < tau, _verdict("R1", "low_confidence")),
        F.when(top_similarity < sigma, _verdict("R2", "no_precedent")),
        _no_verdict())


def opinion_disagrees(opinion: Column, rule_says: Column) -> Column:
    """Null without a second opinion; recorded, never obeyed."""
    return opinion != rule_says


def risk_signals(text: Column) -> Column:
    """Names of the risk families a message falls into."""
    text = F.coalesce(text, F.lit(""))
    found = []
    for name, rx, exception in RISK_FAMILIES:
        hit = text.rlike(rx)
        if exception:
            hit = hit & ~text.rlike(exception)
        found.append(F.when(hit, F.lit(name)))
    return F.array_compact(F.array(*found))


def user_history_text(history: Column) -> Column:
    turns = F.filter(F.coalesce(history, F.array().cast(
        "array<struct<role:string,text:string>>")), lambda t: t["role"] == "user")
    return F.array_join(F.transform(turns, lambda t: t["text"]), " ")


def route(message: Column, history: Column, intent: Column, needs_human: Column,
          handoff_reason: Column, confidence: Column, n_evidence: Column, cited: Column,
          answer: Column, clarification: Column, signals=risk_signals) -> Column:
    """struct(answer, needs_human, routing, routing_reasons, review_required)."""
    text = F.concat(message, F.lit(" "), user_history_text(history))
    uncited = F.size(F.coalesce(cited, F.array().cast("array<string>"))) == 0
    shown = F.when(uncited, F.coalesce(F.nullif(clarification, F.lit("")),
                                       F.lit(NO_SUPPORT_ANSWER))).otherwise(answer)
    unsafe = unsafe_draft(shown)
    reasons = F.array_distinct(F.concat(signals(text), F.array_compact(F.array(
        F.when(intent.isin(*SPECIALIST_INTENTS), F.lit(R_SPECIALIST)),
        F.when(needs_human, F.coalesce(F.nullif(handoff_reason, F.lit("")), F.lit(R_MODEL))),
        F.when(confidence < REVIEW_CONFIDENCE, F.lit(R_CONFIDENCE)),
        F.when((n_evidence == 0) | uncited, F.lit(R_UNCITED)),
        F.when(unsafe, F.lit(R_UNSAFE))))))
    # A lambda's argument is computed once however often its body names it.
    return F.transform(F.array(reasons), lambda why: F.struct(
        F.when(unsafe, F.lit(WITHHELD_ANSWER)).otherwise(shown).alias("answer"),
        (F.size(why) > 0).alias("needs_human"),
        F.when(F.size(why) > 0, F.lit("human_review"))
        .otherwise(F.lit("draft_ready")).alias("routing"),
        why.alias("routing_reasons"), F.lit(True).alias("review_required")))[0]


# Fixed value: characters of a message or of an earlier turn.
MAX_MESSAGE = 2000


def request_violations(message: Column, history: Column, policy: Column) -> Column:
    """Codes of the input limits a request breaks; empty means accepted."""
    bad_turn = F.exists(history, lambda t: F.coalesce(
        ~t["role"].isin("user", "assistant") | (F.length(t["text"]) > MAX_MESSAGE)
        | t["role"].isNull() | t["text"].isNull(), F.lit(True)))
    return F.array_compact(F.array(
        F.when(F.coalesce((F.length(uni_trim(message)) < 4) | (F.length(message) > MAX_MESSAGE),
                          F.lit(True)), F.lit("invalid_message")),
        F.when(F.length(policy) > 8000, F.lit("invalid_policy")),
        F.when(F.coalesce((F.size(history) > 4) | bad_turn, F.lit(False)),
               F.lit("invalid_history"))))


def reply_style(style: Column) -> Column:
    return F.when(style == "detailed", F.lit("detailed")).otherwise(F.lit("concise"))


def parse_output(raw: Column) -> Column:
    """One JSON answer as a typed record; malformed text gives a null record."""
    return F.from_json(raw, MODEL_OUTPUT, {"mode": "PERMISSIVE"})


def output_violations(out: Column, evidence_ids: Column,
                      intents: Sequence[str] = INTENTS) -> Column:
    """Which constraints a parsed answer breaks, citations included."""
    def bad(cond: Column, code: str) -> Column:
        return F.when(F.coalesce(cond, F.lit(True)), F.lit(code))

    allowed = F.coalesce(evidence_ids, F.array().cast("array<string>"))
    cited = out["cited_doc_ids"]
    return F.array_compact(F.array(
        bad(~out["intent"].isin(*intents), "intent"),
        bad(F.isnan(out["confidence"]) | (out["confidence"] < 0) | (out["confidence"] > 1),
            "confidence"),
        bad(F.length(out["answer"]) > 1600, "answer"),
        bad(F.length(out["summary"]) > 350, "summary"),
        bad(out["needs_human"].isNull(), "needs_human"),
        bad((F.size(cited) > 4) | cited.isNull(), "cited_doc_ids"),
        bad((F.size(F.array_except(cited, allowed)) > 0) | F.exists(cited, lambda c: c.isNull()),
            "unknown_citation"),
        bad(F.length(out["handoff_reason"]) > 350, "handoff_reason"),
        bad(F.length(out["clarification_question"]) > 300, "clarification_question")))


def label_errors(should_escalate: Column, reason: Column,
                 legal: Sequence[str] = LABEL_REASONS) -> Column:
    """Structural errors of one label row; a row may carry several."""
    escalates = F.coalesce(should_escalate, F.lit(False))
    given = F.nullif(reason, F.lit(""))
    return F.array_compact(F.array(
        F.when(escalates & given.isNull(), F.lit("escalate_without_reason")),
        F.when(~escalates & given.isNotNull(), F.lit("reason_without_escalate")),
        F.when(~given.isin(*legal), F.lit("reason_not_allowed"))))


def label_status(policy: Column, should_escalate: Column, reason: Column, notes: Column,
                 needs_review: Column) -> Column:
    """Agrees, deliberate or unexplained, against an ``apply_policy`` verdict."""
    review = F.coalesce(needs_review, F.lit(False))
    settled = F.nullif(notes, F.lit("")).isNotNull() & ~review
    escalates = F.coalesce(should_escalate, F.lit(False))
    given = F.nullif(reason, F.lit(""))
    differs = (policy["should_escalate"] != escalates) | F.coalesce(
        policy["should_escalate"] & (policy["reason"] != given), F.lit(False))
    return (F.when(~differs, F.lit("agrees")).when(settled, F.lit("deliberate"))
            .otherwise(F.lit("unexplained")))


def asks_person(policy: Column, intent: Column) -> Column:
    """A person confirms escalation only where it can arise."""
    return policy["should_escalate"] | F.coalesce(intent.isin(*ESCALATABLE), F.lit(False))


def acceptable(grounded: Column, addresses_ask: Column, no_overpromise: Column) -> Column:
    """Tone is reported but does not gate; a missing verdict counts as no."""
    return F.coalesce(grounded & addresses_ask & no_overpromise, F.lit(False))
