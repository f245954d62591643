"""Text columns: cleaning, keys, hardness, redaction, tokens, chunks, rendering.

Two families of regular expression meet here. Message-preparation rules use Unicode
letters, digits and spaces; service rules (redaction, draft checks) use ASCII word and
digit classes but Unicode spaces. Each pattern below spells out the class it needs, so
neither the JVM defaults nor the session locale change a result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Character classes.
WORD = r"[\p{L}\p{N}_]"
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
NONSPACE = r"[^\s\x1c-\x1f\x85\p{Z}]"

# Phrases that redirect the customer to a private channel.
PRIVATE_CHANNEL = (
    r"\bD\.?M\.?s?\b|direct message|private message|privately|"
    r"\be-?mail us\b|\bcall us\b|\bgive us a call\b|\bphone us\b|"
    r"\blive chat\b|\bchat with us\b|\bcontact us at\b"
)
MIN_WORDS = 15

# Awkward-message tests.
INJECTION = (
    r"ignore (all )?(previous|prior|above)|system ?(notice|prompt|message)|"
    r"you are now|disregard (your|all)"
)
SARCASM = r"\b(thanks a lot|great job|wonderful|love how)\b.*\b(not|never|still)\b"
SIGNALS = {
    "playback": r"\b(play|playing|skip|buffer|stutter|offline|download)\b",
    "access": r"\b(log ?in|login|password|locked|sign ?in|account)\b",
    "billing": r"\b(charg|paid|payment|card|bill|invoice|refund)\b",
    "subscription": r"\b(cancel|premium|subscri|upgrade|family|student|plan)\b",
    "content": r"\b(song|album|artist|podcast|playlist|removed|missing)\b",
    "app": r"\b(crash|update|app|install|version|freeze|bug)\b",
}

# Redaction patterns and replacements, applied in this order.
EMAIL = r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_.-]+\.[A-Za-z]{2,}"
PHONE = r"\+?[0-9][0-9 ()-]{8,}[0-9]"
CREDENTIAL = (r"(?i)\b(?:password|otp|one.?time code|api.?key)" + SPACE + r"*(?:is|:|=)"
              + SPACE + r"*" + NONSPACE + r"+")

# Words ignored by the passage tokenizer.
STOP_WORDS = (
    "the a an and or is are was were be been it its this that to for in on of my me i "
    "you your we our with have has had can could please not do does did but from as at "
    "so no just"
).split()

# Draft checks.
CONTACT = r"(?i)https?://|" + EMAIL
CLAIMED_ACTION = (r"(?i)\b(?:I(?:'ve| have)|we(?:'ve| have))" + SPACE + r"+(?:issued|processed|"
                  r"cancelled|canceled|deleted|reset|refunded|sent|updated|verified)\b")


def unicode_rx(pattern: str) -> str:
    """Case-insensitive, Unicode classes and boundaries, ``.`` stops only at a newline."""
    return "(?idU)" + pattern


def uni_trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def collapse(c: Column) -> Column:
    return uni_trim(F.regexp_replace(c, f"{SPACE}+", " "))


def words(c: Column) -> Column:
    return F.filter(F.split(c, f"{SPACE}+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    """Whitespace-separated words; null counts as no text."""
    return F.size(words(F.coalesce(c, F.lit(""))))


def normal_id(c: Column) -> Column:
    """Ids as trimmed text, without the ``.0`` a float column leaves behind."""
    return F.regexp_replace(uni_trim(c.cast("string")), r"\.0$", "")


def float_id(c: Column) -> Column:
    """P1 for an id column that was read as a floating-point number, without an exponent."""
    return c.cast("decimal(38,0)").cast("string")


def counted_words(c: Column) -> Column:
    """Words that are neither a mention nor a link."""
    return F.size(F.filter(words(F.lower(c)),
                           lambda w: ~(w.startswith("@") | w.startswith("http"))))


def is_private_channel(c: Column) -> Column:
    return c.rlike(unicode_rx(PRIVATE_CHANNEL))


def is_substantive(c: Column, min_words: int = MIN_WORDS, channel: str = PRIVATE_CHANNEL) -> Column:
    """Long enough to hold an instruction and not a redirect; null is false."""
    ok = (~c.rlike(unicode_rx(channel))) & (counted_words(c) >= min_words)
    return F.coalesce(ok, F.lit(False))


def has_text(c: Column) -> Column:
    """P5: present and not blank."""
    return F.coalesce(c.rlike(NONSPACE), F.lit(False))


def contains_literal(c: Column, needle: str) -> Column:
    """Case-insensitive literal search; null never matches."""
    return F.coalesce(F.contains(F.lower(c), F.lit(needle.lower())), F.lit(False))


def strip_handles(c: Column) -> Column:
    """T1."""
    return uni_trim(F.regexp_replace(c, "@" + WORD + "+", ""))


def near_dup_key(c: Column) -> Column:
    """Equal for messages that differ only by handle, link, number or spacing."""
    body = F.lower(strip_handles(c))
    body = F.regexp_replace(body, "https?://" + NONSPACE + "+", "")
    return collapse(F.regexp_replace(body, r"\p{Nd}+", "#"))


def template_key(c: Column) -> Column:
    """Reply without the parts that vary per customer or per agent."""
    body = F.regexp_replace(c, "@" + WORD + "+", "")
    body = uni_trim(F.regexp_replace(body, "https?://" + NONSPACE + "+", ""))
    body = F.regexp_replace(body, r"[/^-]" + SPACE + r"*[A-Z]{1,3}" + SPACE + r"*$", "")
    return F.lower(collapse(F.regexp_replace(body, r"\p{Nd}+", "")))


def signal_hits(body: Column, signals: dict[str, str] | None = None) -> Column:
    """T5: names of the keyword groups a message touches, in group order."""
    signals = SIGNALS if signals is None else signals
    return F.array_compact(F.array(*[
        F.when(body.rlike(unicode_rx(rx)), F.lit(name)) for name, rx in signals.items()]))


# How much each kind of awkwardness weighs, and the reason stated for it.
HARDNESS = {
    "injection": (5, "looks like prompt injection"),
    "no_words": (4, "no words at all"),
    "too_short": (3, "almost no content"),
    "non_english": (3, "largely non-English or emoji"),
    "multi_intent": (2, "signals for "),
    "very_long": (2, "very long"),
    "sarcasm": (2, "possible sarcasm"),
}
# Layout of past cases in a request, and what stands there if there are none.
CASE_SCORE, CASE_ASKED, CASE_REPLIED = "] similarity ", "\n    customer: ", "\n    brand replied: "
NO_CASES = "(no similar past cases found)"


def add_hardness(df: DataFrame, text: str, name: str = "hardness",
                 signals: dict[str, str] | None = None) -> DataFrame:
    """T4: struct(score, kind, reason) saying how awkward a message is, and why.

    The parts are columns of their own, so each text is cleaned and searched once.
    """
    body, n_words, hits = F.col("_body"), F.col("_n_words"), F.col("_hits")
    n_chars = F.length(body)
    foreign = n_chars - F.length(F.regexp_replace(body, r"[^\x00-\x7F]+", ""))
    weight = {kind: F.lit(w) for kind, (w, _) in HARDNESS.items()}
    reason = {kind: F.lit(r) for kind, (_, r) in HARDNESS.items()}
    # three kinds of signal weigh one more than two
    weight["multi_intent"] = weight["multi_intent"] + (F.size(hits) >= 3).cast("int")
    reason["multi_intent"] = F.concat(reason["multi_intent"], F.array_join(hits, ", "))
    tests = [(kind, fires, weight[kind], reason[kind]) for kind, fires in (
        ("injection", body.rlike(unicode_rx(INJECTION))),
        ("no_words", (body != "") & ~body.rlike(r"[\p{L}\p{Nl}\p{No}]")),
        ("too_short", n_words <= 3),
        ("non_english", (n_chars > 0) & (foreign / n_chars > 0.3)),
        ("multi_intent", F.size(hits) >= 2),
        ("very_long", n_words > 55),
        ("sarcasm", body.rlike(unicode_rx(SARCASM))))]
    # Heaviest first, test order on ties: the sort key is (-weight, position).
    fired = F.array_sort(F.array_compact(F.array(*[
        F.when(cond, F.struct((-weight).alias("neg"), F.lit(i).alias("ord"),
                              F.lit(kind).alias("kind"), reason.alias("reason")))
        for i, (kind, cond, weight, reason) in enumerate(tests)])))
    score = -F.aggregate(F.col("_fired"), F.lit(0), lambda acc, t: acc + t["neg"])
    return (df.withColumn("_body", strip_handles(F.coalesce(F.col(text), F.lit(""))))
            .withColumns({"_n_words": word_count(F.col("_body")),
                          "_hits": signal_hits(F.col("_body"), signals)})
            .withColumn("_fired", fired)
            .withColumn(name, F.struct(
                score.alias("score"),
                F.coalesce(F.try_element_at("_fired", F.lit(1))["kind"], F.lit("")).alias("kind"),
                F.array_join(F.transform("_fired", lambda t: t["reason"]), "; ").alias("reason")))
            .drop("_body", "_n_words", "_hits", "_fired"))


def redact(c: Column) -> Column:
    """E-mail, then long number, then credential."""
    c = F.regexp_replace(c, EMAIL, "[email removed]")
    c = F.regexp_replace(c, PHONE, "[number removed]")
    return F.regexp_replace(c, CREDENTIAL, "[credential removed]")


def tokens(c: Column) -> Column:
    """Lower-case letter/digit runs without stop words, one suffix stripped.

    A word that is nothing but a suffix stays as it is. The suffix is cut by length, which
    is several times cheaper than a pattern per word.
    """
    raw = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), 1)
    kept = F.filter(raw, lambda w: (F.length(w) > 1) & ~w.isin(*STOP_WORDS))

    def stem(w: Column) -> Column:
        cut = F.lit(None)
        for suffix in ("s", "ed", "ing"):
            cut = F.when(w.endswith(suffix) & (F.length(w) > len(suffix)),
                         F.left(w, F.length(w) - len(suffix))).otherwise(cut)
        return F.coalesce(cut, w)

    return F.transform(kept, stem)


# Fixed value: sections of a policy that a live request may bring along.
LIVE_SECTIONS = 20


def passages(c: Column, size: int = 900, limit: int | None = None) -> Column:
    """Blank-line paragraphs cut into slices, all non-blank ones or the first ``limit``."""
    paragraphs = F.filter(F.split(F.coalesce(c, F.lit("")), r"\n" + SPACE + r"*\n"),
                          lambda p: p != "")
    slices = F.flatten(F.transform(paragraphs, lambda p: F.transform(
        F.sequence(F.lit(0), F.floor((F.length(p) - 1) / size).cast("int")),
        lambda i: F.substr(p, i * size + 1, F.lit(size)))))
    kept = F.filter(slices, lambda s: s.rlike(NONSPACE))
    if limit is not None:
        kept = F.slice(kept, 1, limit)
    return F.transform(kept, lambda s, i: F.struct(
        F.concat(F.lit("CUSTOM-"), (i + 1).cast("string")).alias("id"),
        F.concat(F.lit("Your support policy · section "), (i + 1).cast("string")).alias("title"),
        uni_trim(s).alias("text")))


def preview(c: Column, n: int = 80) -> Column:
    """The first ``n`` characters, for listings only."""
    return F.substring(c, 1, n)


def hours_since(stamp: Column, as_of: Column) -> Column:
    """Hours between an ISO time and ``as_of``; a bad or missing time is very old."""
    ts = F.try_to_timestamp(stamp)
    gap = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(ts)) / F.lit(3.6e9)
    return F.coalesce(gap, F.lit(1e9))


def minute_bucket(ts: Column) -> Column:
    """T15."""
    return F.floor(F.unix_seconds(ts.cast("timestamp")) / 60)


def day_bucket(ts: Column) -> Column:
    """T15."""
    return F.floor(F.unix_seconds(ts.cast("timestamp")) / 86400)


def render_evidence(items: Column) -> Column:
    """Numbered past cases, in array order, as one block of text."""
    block = F.array_join(F.transform(items, lambda e, i: F.concat(
        F.lit("["), i.cast("string"), F.lit(CASE_SCORE),
        F.when(e["similarity"].isNull(), F.lit("nan")).otherwise(
            F.format_string("%.2f", e["similarity"])),
        F.lit(CASE_ASKED), F.coalesce(e["customer_text"], F.lit("")),
        F.lit(CASE_REPLIED), F.coalesce(e["brand_reply"], F.lit("")))), "\n\n")
    return F.when(F.size(F.coalesce(items, F.array())) == 0,
                  F.lit(NO_CASES)).otherwise(block)


def taxonomy_block(definitions: dict[str, str], rules: Sequence[str], title: str = "Intent categories:",
                   rules_title: str = "Boundary rules:") -> str:
    """Label definitions and boundary rules, as the fixed head of a request."""
    head = [title] + [f"- {k}: {v}" for k, v in definitions.items()]
    return "\n".join(head + ["", rules_title] + [f"- {r}" for r in rules])


def request_text(head: str, message: Column, evidence: Column | None = None,
                 draft: Column | None = None) -> Column:
    """The text a scorer receives for one message."""
    parts = [F.lit(head), F.concat(F.lit("Customer message:\n"), message)]
    if draft is not None:
        parts.append(F.concat(F.lit("Draft reply:\n"), draft))
    if evidence is not None:
        parts.append(F.concat(F.lit("Past cases:\n"), render_evidence(evidence)))
    return F.concat_ws("\n\n", *parts)


def unsafe_draft(c: Column) -> Column:
    """The draft names a contact point or claims an action it cannot have done."""
    return F.coalesce(c.rlike(CONTACT) | c.rlike(CLAIMED_ACTION), F.lit(False))
