"""How the given tables stand in for messages, labels, runs, ratings and requests.

Each binding is written twice: as a DataFrame and as a SQL common table expression with
the same columns, so a query and its SQL start from the same rows. All of them are
row-local or join on unique ids, over whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from replylens.functions.policy import INTENTS
from replylens.plans.registry import table

# Words that occur in the given texts, so that rules and searches find something.
CHANNEL = r"\b(thing|licen[cs]e)\b"
RULES = [
    ("E1", "security_risk", [r"\btoken\b", r"\b[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}\b"]),
    ("E2", "money_movement", [r"\blicen[cs]e\b"]),
    ("E3", "legal_or_reputational", [r"\bthing\b", r"\bune\b"]),
    ("E4", "safety", [r"\bunge\w*\b"]),
]
SIGNALS = {"articles": r"\b(the|der|le|el)\b", "joins": r"\b(and|und|et|y)\b",
           "places": r"\b(in|on|at|dans|zu)\b", "terms": r"\b(licen[cs]e|token)\b"}
LANGS = ["en", "de", "fr", "es"]
BRANDS = ["Brand0", "Brand1", "Brand2"]

# The same in RE2, which has no Unicode word boundary.
_L = r"(?:^|[^\p{L}\p{N}_])"
_R = r"(?:[^\p{L}\p{N}_]|$)"


def word_rx(body: str) -> str:
    return f"(?i){_L}({body}){_R}"


SQL_CHANNEL = word_rx("thing|licen[cs]e")
SQL_RULES = [
    ("E1", "security_risk", word_rx(r"token|[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}")),
    ("E2", "money_movement", word_rx("licen[cs]e")),
    ("E3", "legal_or_reputational", word_rx("thing|une")),
    ("E4", "safety", word_rx(r"unge[\p{L}\p{N}_]*")),
]
SQL_SIGNALS = {"articles": word_rx("the|der|le|el"), "joins": word_rx("and|und|et|y"),
               "places": word_rx("in|on|at|dans|zu"), "terms": word_rx("licen[cs]e|token")}


def sql_rule(column: str, part: int, text: str = "text", prior: str | None = None) -> str:
    """CASE over the rules giving the rule name (part 0) or its reason (part 1)."""
    arms = [f"when regexp_matches({text}, '{rx}') then '{(rule, reason)[part]}'"
            for rule, reason, rx in SQL_RULES]
    if prior:
        arms.append(f"when {prior} >= 2 then '{('E5', 'repeat_contact')[part]}'")
    return f"case {' '.join(arms)} end as {column}"


def fraction(salt: str, id_col: str) -> Column:
    """A repeatable number in [0, 1) per row."""
    digest = F.md5(F.concat(F.lit(f"{salt}:"), F.col(id_col).cast("string")))
    return F.conv(F.substring(digest, 1, 4), 16, 10).cast("int") / F.lit(65536.0)


def sql_fraction(salt: str, id_col: str) -> str:
    return (f"((('0x' || substr(md5(concat('{salt}:', {id_col})), 1, 4))::int)::double"
            " / 65536.0::double)")


def conversations(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def messages(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as linked messages: roles alternate, so a customer turn at 0 or 1 opens the
    thread and every reply of the brand points at that opening message."""
    c = conversations(spark, sf).filter("role <> 'system'")
    name = F.concat(F.when(F.col("conv_id") % 2 == 0, "Brand").otherwise("BRAND"),
                    (F.col("conv_id") % 3).cast("string"))
    brand = F.col("role") == "assistant"
    link = F.concat(F.col("conv_id").cast("string"), F.lit("-"))
    return c.select(
        F.concat(link, F.col("turn").cast("string")).alias("tweet_id"),
        F.when(brand, name).otherwise(F.concat(F.lit("user"), F.col("conv_id").cast("string")))
        .alias("author_id"),
        (~brand).alias("inbound"), F.col("turn").alias("created_at"), "text",
        F.when(brand, F.concat(link, ((F.col("turn") + 1) % 2).cast("string")))
        .when(F.col("turn") > 1, F.concat(link, (F.col("turn") - 1).cast("string")))
        .alias("in_response_to_tweet_id"))


MESSAGES = """messages as (
  select concat(conv_id, '-', turn) as tweet_id,
    case when role = 'assistant'
      then concat(case when conv_id % 2 = 0 then 'Brand' else 'BRAND' end, conv_id % 3)
      else concat('user', conv_id) end as author_id,
    role = 'user' as inbound, turn as created_at, text,
    case when role = 'assistant' then concat(conv_id, '-', (turn + 1) % 2)
      when turn > 1 then concat(conv_id, '-', turn - 1) end as in_response_to_tweet_id
  from conversations where role <> 'system')"""

REPLIES = MESSAGES + """, replies as (
  select lower(author_id) as brand, tweet_id as brand_reply_id, text as brand_reply_text,
    in_response_to_tweet_id as customer_tweet_id, created_at as replied_at
  from messages
  where lower(author_id) in ('brand0', 'brand1', 'brand2')
    and in_response_to_tweet_id is not null)"""

FIRST = REPLIES + """, firsts as (
  select * from replies
  qualify row_number() over (partition by brand, customer_tweet_id
                             order by replied_at, brand_reply_id) = 1)"""

SQL_WORDS = r"len(list_filter(regexp_split_to_array({0}, '[\s\p{{Z}}]+'), lambda w: w <> ''))"
SQL_COUNTED = (r"len(list_filter(regexp_split_to_array(lower({0}), '[\s\p{{Z}}]+'), "
               r"lambda w: w <> '' and not starts_with(w, '@') and not starts_with(w, 'http')))")
SQL_SUBSTANTIVE = (f"(not regexp_matches({{0}}, '{SQL_CHANNEL.replace('{', '{{').replace('}', '}}')}')"
                   f" and {SQL_COUNTED} >= {{1}})")

PAIRS = FIRST + f""", pairs as (
  select f.brand, f.customer_tweet_id, f.brand_reply_id, f.brand_reply_text,
    m.author_id as customer_author_id, m.text as customer_text, m.created_at,
    {SQL_SUBSTANTIVE.format('f.brand_reply_text', 140)} as is_substantive
  from firsts f join messages m on m.tweet_id = f.customer_tweet_id
  where m.inbound and m.in_response_to_tweet_id is null)"""


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Replies here run to hundreds of words, hence the longer minimum."""
    from replylens.operators.threads import reply_pairs
    return reply_pairs(messages(spark, sf), BRANDS, min_words=140, channel=CHANNEL)


def answer_key(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as labelled items: language is the gold class, toxic needs a person."""
    d, lab = documents(spark, sf), table(spark, sf, "labels")
    return d.join(lab, "doc_id", "left").select(
        F.col("doc_id").alias("id"), "text", F.col("lang").alias("gold"),
        F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("should_escalate"),
        (F.col("n_chars") < 300).alias("is_hard"),
        F.when(fraction("s", "doc_id") < 0.3, "dev").otherwise("test").alias("split"))


ANSWER_KEY = f"""answer_key as (
  select d.doc_id as id, d.text, d.lang as gold, coalesce(l.toxic = 1, false) as should_escalate,
    d.n_chars < 300 as is_hard,
    case when {sql_fraction('s', 'd.doc_id')} < 0.3 then 'dev' else 'test' end as split
  from documents d left join labels l on l.doc_id = d.doc_id)"""


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Four configs over every document: two rule classifiers (one that can answer outside
    the classes, one that abstains and fails at times), a constant, and a router."""
    d = documents(spark, sf)
    marks = (F.when(F.col("text").rlike("ß|ü|ä|ö"), "de").when(F.col("text").rlike("ñ|ó|í"), "es")
             .when(F.col("text").rlike("ç|ê|è"), "fr").otherwise("en"))
    stops = (F.when(F.col("text").rlike(r"\s(the|and|of)\s"), "en")
             .when(F.col("text").rlike(r"\s(der|die|und)\s"), "de")
             .when(F.col("text").rlike(r"\s(le|la|et)\s"), "fr")
             .when(F.col("text").rlike(r"\s(el|los|que)\s"), "es").otherwise("xx"))
    failed = F.col("doc_id") % 13 == 0

    def row(config: str, pred: Column, escalated: Column, error: Column) -> Column:
        return F.struct(F.lit(config).alias("config"), pred.cast("string").alias("pred"),
                        escalated.cast("boolean").alias("escalated"),
                        error.cast("string").alias("error"))

    null = F.lit(None)
    configs = F.array(
        row("always_en", F.lit("en"), F.lit(False), null),
        row("marks", F.when(~failed & (F.col("n_chars") >= 120), marks),
            F.col("n_chars") % 5 == 0, F.when(failed, "timeout")),
        row("router", null, F.col("n_chars") % 2 == 0, null),
        row("stops", stops, F.contains(F.col("text"), F.lit("thing")), null))
    return d.select(
        F.col("doc_id").alias("id"), F.explode(configs).alias("c"),
        fraction("c", "doc_id").alias("confidence"),
        fraction("m", "doc_id").alias("top_similarity"),
        F.when(F.col("doc_id") % 4 != 0, F.col("text")).alias("reply"),
        F.col("n_chars").alias("input_tokens"), (F.col("n_chars") % 7).alias("output_tokens"),
        ((F.col("doc_id") % 8) / F.lit(8.0)).alias("latency_s")).select(
        "id", "c.*", "confidence", "top_similarity", "reply", "input_tokens", "output_tokens",
        "latency_s")


RUNS = rf"""runs as (
  select doc_id as id, c.config, case c.config
      when 'always_en' then 'en'
      when 'marks' then case when doc_id % 13 <> 0 and n_chars >= 120 then
        case when regexp_matches(text, 'ß|ü|ä|ö') then 'de'
             when regexp_matches(text, 'ñ|ó|í') then 'es'
             when regexp_matches(text, 'ç|ê|è') then 'fr' else 'en' end end
      when 'stops' then
        case when regexp_matches(text, '\s(the|and|of)\s') then 'en'
             when regexp_matches(text, '\s(der|die|und)\s') then 'de'
             when regexp_matches(text, '\s(le|la|et)\s') then 'fr'
             when regexp_matches(text, '\s(el|los|que)\s') then 'es' else 'xx' end
    end as pred,
    case c.config when 'always_en' then false when 'marks' then n_chars % 5 = 0
      when 'router' then n_chars % 2 = 0 else contains(text, 'thing') end as escalated,
    case when c.config = 'marks' and doc_id % 13 = 0 then 'timeout' end as error,
    {sql_fraction('c', 'doc_id')} as confidence, {sql_fraction('m', 'doc_id')} as top_similarity,
    case when doc_id % 4 <> 0 then text end as reply,
    n_chars as input_tokens, n_chars % 7 as output_tokens,
    (doc_id % 8) / 8.0::double as latency_s
  from documents, (values ('always_en'), ('marks'), ('router'), ('stops')) c(config))"""

GRADED = ANSWER_KEY + ", " + RUNS + """, graded as (
  select r.*, k.text, k.gold, k.should_escalate, k.is_hard, k.split
  from runs r join answer_key k on k.id = r.id),
counts as (select config, gold, pred, count(*) as n from graded where pred is not null
           group by all)"""


def graded(spark: SparkSession, sf: str) -> DataFrame:
    from replylens.operators import joins
    return joins.graded(answer_key(spark, sf), joins.without_texts(runs(spark, sf)))


def label_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as rows of an answer key, with every kind of slip in some of them."""
    i = F.col("doc_id")
    names = F.array(*[F.lit(x) for x in INTENTS])
    return documents(spark, sf).select(
        i.alias("id"), "text", F.element_at(names, (i % 11 + 1).cast("int")).alias("intent"),
        (i % 3 == 0).alias("should_escalate"),
        F.when(i % 5 == 0, "security_risk").when(i % 5 == 1, "legal_or_reputational")
        .when(i % 5 == 2, "low_confidence").alias("escalation_reason"),
        F.when(i % 4 == 0, "checked").otherwise("").alias("notes"),
        (i % 7 == 0).alias("needs_review"), (i % 4).alias("prior_messages"))


LABEL_ROWS = f"""label_rows as (
  select doc_id as id, text,
    ([{', '.join(f"'{x}'" for x in INTENTS)}])[(doc_id % 11 + 1)::int] as intent,
    doc_id % 3 = 0 as should_escalate,
    case doc_id % 5 when 0 then 'security_risk' when 1 then 'legal_or_reputational'
      when 2 then 'low_confidence' end as escalation_reason,
    case when doc_id % 4 = 0 then 'checked' else '' end as notes,
    doc_id % 7 = 0 as needs_review, doc_id % 4 as prior_messages from documents),
judged as (
  select *, {sql_rule('rule', 0, prior='prior_messages')}, {sql_rule('reason', 1, prior='prior_messages')}
  from label_rows),
statuses as (
  select *, (should_escalate and escalation_reason is null)::int
      + (not should_escalate and escalation_reason is not null)::int
      + coalesce((escalation_reason not in ('security_risk', 'money_movement',
          'legal_or_reputational', 'safety', 'repeat_contact'))::int, 0) as n_errors,
    case when (rule is not null) = should_escalate
          and not coalesce(rule is not null and reason <> escalation_reason, false) then 'agrees'
      when notes <> '' and not needs_review then 'deliberate' else 'unexplained' end as status
  from judged)"""


def _ratings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").join(
        documents(spark, sf).select("doc_id", "n_chars"), "doc_id")


def human_ratings(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id")
    return _ratings(spark, sf).select(
        i.alias("id"), (F.col("quality") == 1).alias("grounded"),
        (F.col("n_chars") > 200).alias("addresses_ask"),
        (F.col("toxic") == 0).alias("no_overpromise"), (i % 3 != 0).alias("tone_ok"),
        ((F.col("quality") == 1) & (F.col("n_chars") > 200) & (F.col("toxic") == 0))
        .alias("acceptable"), F.lit(None).cast("string").alias("error"))


def judge_ratings(spark: SparkSession, sf: str) -> DataFrame:
    i, n = F.col("doc_id"), F.col("n_chars")
    return _ratings(spark, sf).select(
        i.alias("id"), (n > 150).alias("grounded"), (n > 260).alias("addresses_ask"),
        (n % 9 != 0).alias("no_overpromise"), F.lit(True).alias("tone_ok"),
        ((n > 260) & (n % 9 != 0)).alias("acceptable"),
        F.when(i % 17 == 0, "timeout").alias("error"))


RATINGS = """ratings as (
  select l.doc_id, l.quality, l.toxic, d.n_chars
  from labels l join documents d on d.doc_id = l.doc_id),
human as (
  select doc_id as id, quality = 1 as grounded, n_chars > 200 as addresses_ask,
    toxic = 0 as no_overpromise, doc_id % 3 <> 0 as tone_ok,
    quality = 1 and n_chars > 200 and toxic = 0 as acceptable from ratings),
judge as (
  select doc_id as id, n_chars > 150 as grounded, n_chars > 260 as addresses_ask,
    n_chars % 9 <> 0 as no_overpromise, true as tone_ok,
    n_chars > 260 and n_chars % 9 <> 0 as acceptable,
    case when doc_id % 17 = 0 then 'timeout' end as error from ratings),
dims as (
  select d.dim, h.id,
    case d.dim when 'grounded' then h.grounded when 'addresses_ask' then h.addresses_ask
      when 'no_overpromise' then h.no_overpromise when 'tone_ok' then h.tone_ok
      else h.acceptable end as human,
    case d.dim when 'grounded' then j.grounded when 'addresses_ask' then j.addresses_ask
      when 'no_overpromise' then j.no_overpromise when 'tone_ok' then j.tone_ok
      else j.acceptable end as judge
  from human h join judge j on j.id = h.id,
    (values ('grounded'), ('addresses_ask'), ('no_overpromise'), ('tone_ok'), ('acceptable')) d(dim)
  where j.error is null)"""


def request_log(events: DataFrame) -> DataFrame:
    """Events as a request log: the user is the client, the property is the request id."""
    return events.select(
        F.col("event_id").alias("row"), F.col("user_id").alias("client"),
        F.get_json_object("props", "$.k").alias("request_id"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"))


def requests(spark: SparkSession, sf: str) -> DataFrame:
    return request_log(table(spark, sf, "events"))


REQUESTS = """requests as (
  select event_id as "row", user_id as client, json_extract_string(props, '$.k') as request_id,
    epoch(date_trunc('second', ts))::bigint as ts from events)"""


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector"),
        F.col("label").cast("string").alias("label"))


NEAREST = """scored as (
  select q.vec_id as id, d.vec_id as neighbour_id,
    list_dot_product(q.embedding::double[], d.embedding::double[]) as similarity
  from embeddings q join embeddings d on q.vec_id <> d.vec_id),
hits as (
  select *, row_number() over (partition by id order by similarity desc, neighbour_id) as rank
  from scored qualify rank <= 4)"""

KNN = NEAREST + """, knn as (
  select h.id, g.label::varchar as gold, n.label::varchar as pred, h.similarity
  from hits h join embeddings g on g.vec_id = h.id join embeddings n on n.vec_id = h.neighbour_id
  where h.rank = 1)"""
