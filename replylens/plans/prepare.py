"""Conversation preparation queries."""

from pyspark.sql import functions as F

from replylens.functions import text as tx
from replylens.operators import history, metrics, scoring, threads
from replylens.plans import bindings as b
from replylens.plans.registry import query


@query("P1_id_normalise", """
select doc_id::varchar as raw, doc_id::varchar as id from documents""")
def _(spark, sf):
    raw = F.concat(F.lit(" "), F.col("doc_id").cast("string"), F.lit(".0 "))
    return b.documents(spark, sf).select(F.col("doc_id").cast("string").alias("raw"),
                                         tx.normal_id(raw).alias("id"))


@query("P1_float_ids", """
select (doc_id + 12345678)::varchar as tweet_id,
  case when doc_id % 3 > 0 then (doc_id + 90071992547)::varchar end as parent_id from documents""")
def _(spark, sf):
    """Ids in floating-point columns, as a column with missing values is often read."""
    read = b.documents(spark, sf).select(
        (F.col("doc_id") + 12345678).cast("double").alias("tweet_id"),
        F.when(F.col("doc_id") % 3 > 0, (F.col("doc_id") + 90071992547).cast("double"))
        .alias("in_response_to_tweet_id"))
    return threads.normalise_messages(read).withColumnRenamed("in_response_to_tweet_id", "parent_id")


@query("P2_substantive_reply", f"""
select conv_id, turn, {b.SQL_SUBSTANTIVE.format('text', 140)} as is_substantive,
  {b.SQL_COUNTED.format('text')} as counted from conversations where role = 'assistant'""")
def _(spark, sf):
    c = b.conversations(spark, sf).filter("role = 'assistant'")
    return c.select("conv_id", "turn", tx.is_substantive(F.col("text"), 140, b.CHANNEL)
                    .alias("is_substantive"), tx.counted_words(F.col("text")).alias("counted"))


@query("P3_brand_replies", f"""
with {b.REPLIES} select brand, brand_reply_id, customer_tweet_id, replied_at from replies""")
def _(spark, sf):
    return threads.brand_replies(b.messages(spark, sf), b.BRANDS).drop("brand_reply_text")


@query("P4_root_messages", f"""
with {b.MESSAGES} select tweet_id as customer_tweet_id, author_id as customer_author_id
from messages where inbound and in_response_to_tweet_id is null""")
def _(spark, sf):
    return threads.root_messages(b.messages(spark, sf)).select(
        "customer_tweet_id", "customer_author_id")


@query("J1_reply_pairs", f"""
with {b.PAIRS} select brand, customer_tweet_id, brand_reply_id, customer_author_id,
  md5(customer_text) as customer_md5, md5(brand_reply_text) as reply_md5, is_substantive
from pairs""")
def reply_pairs(spark, sf):
    return b.pairs(spark, sf).select(
        "brand", "customer_tweet_id", "brand_reply_id", "customer_author_id",
        F.md5("customer_text").alias("customer_md5"),
        F.md5("brand_reply_text").alias("reply_md5"), "is_substantive")


@query("J2_referenced_parents", f"""
with {b.REPLIES} select tweet_id, author_id from messages
where tweet_id in (select customer_tweet_id from replies)""")
def _(spark, sf):
    m = b.messages(spark, sf)
    return threads.referenced_parents(m, threads.brand_replies(m, b.BRANDS)).select(
        "tweet_id", "author_id")


@query("W1_first_reply", f"""
with {b.FIRST} select brand, customer_tweet_id, brand_reply_id, replied_at from firsts""")
def _(spark, sf):
    return threads.first_replies(threads.brand_replies(b.messages(spark, sf), b.BRANDS)).drop(
        "brand_reply_text")


@query("W1_first_reply_written_times", f"""
with {b.FIRST} select brand, customer_tweet_id, brand_reply_id from firsts""")
def _(spark, sf):
    """Times as exported: day and month names first, so their text order is not their order."""
    start = F.unix_seconds(F.lit("2017-10-28 12:00:00").cast("timestamp"))
    when = F.timestamp_seconds(start + F.col("created_at") * 130_000)
    messages = b.messages(spark, sf).withColumn(
        "created_at", F.date_format(when, "EEE MMM dd HH:mm:ss '+0000' yyyy"))
    return threads.first_replies(threads.brand_replies(messages, b.BRANDS)).select(
        "brand", "customer_tweet_id", "brand_reply_id")


@query("P5_usable_pairs", f"""
with {b.PAIRS} select customer_tweet_id, brand_reply_id from pairs
where regexp_matches(customer_text, '[^\\s]') and brand_reply_text is not null""")
def _(spark, sf):
    return threads.usable_pairs(b.pairs(spark, sf)).select("customer_tweet_id", "brand_reply_id")


@query("P6_indexable_pairs", f"""
with {b.PAIRS} select customer_tweet_id, brand_reply_id from pairs where is_substantive""")
def _(spark, sf):
    return threads.indexable_pairs(b.pairs(spark, sf)).select(
        "customer_tweet_id", "brand_reply_id")


@query("P7_literal_search", """
select doc_id from documents where contains(lower(text), 'thing')""")
def _(spark, sf):
    return b.documents(spark, sf).filter(tx.contains_literal(F.col("text"), "Thing")).select(
        "doc_id")


BRAND_TABLE = f"""{b.PAIRS}, brands as (
  select brand, count(*) as pairs, count(*) filter (where is_substantive) as substantive,
    trunc(median({b.SQL_WORDS.format('brand_reply_text')}))::int as median_reply_words,
    count(*) filter (where is_substantive) / count(*)::double as rate
  from pairs group by brand)"""


@query("A1_brand_comparison", f"""
with {BRAND_TABLE} select brand, pairs, substantive, median_reply_words,
  round(rate, 6) as substantive_rate from brands""")
def brand_comparison(spark, sf):
    return threads.compare_brands(b.pairs(spark, sf)).withColumn(
        "substantive_rate", F.round("substantive_rate", 6))


@query("A2_brand_pick", f"""
with {BRAND_TABLE} select brand, pairs from brands
order by (pairs >= 30) desc, rate desc, brand limit 1""")
def _(spark, sf):
    return threads.pick_brand(threads.compare_brands(b.pairs(spark, sf)), min_pairs=30).select(
        "brand", "pairs")


@query("A25_threshold_sensitivity", f"""
with {b.PAIRS}, rates as (
  select brand, t.m as min_words, count(*) as pairs,
    count(*) filter (where not regexp_matches(brand_reply_text, '{b.SQL_CHANNEL}')
      and {b.SQL_COUNTED.format('brand_reply_text')} >= t.m) as substantive
  from pairs, (values (100), (120), (140), (160), (180)) t(m) group by all)
select brand, min_words, pairs, substantive, round(substantive / pairs::double, 6) as rate,
  row_number() over (partition by min_words order by substantive / pairs::double desc, brand)
    as place from rates""")
def _(spark, sf):
    t = threads.threshold_sensitivity(b.pairs(spark, sf), [100, 120, 140, 160, 180],
                                      channel=b.CHANNEL)
    return t.select("brand", "min_words", "pairs", "substantive",
                    F.round("substantive_rate", 6).alias("rate"), "place")


@query("A26_duplicate_rate", """
with c as (select text, count(*) as n from documents where text is not null group by text)
select sum(n)::bigint as "rows", coalesce(sum(n) filter (where n > 1), 0)::bigint as duplicates,
  round(coalesce(sum(n) filter (where n > 1), 0) / sum(n)::double, 6) as duplicate_rate from c""")
def duplicate_rate(spark, sf):
    return metrics.duplicate_rate(b.documents(spark, sf), "text").withColumn(
        "duplicate_rate", F.round("duplicate_rate", 6))


SQL_TEMPLATE = (r"lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace("
                r"regexp_replace(regexp_replace({0}, '@[\p{{L}}\p{{N}}_]+', '', 'g'), "
                r"'https?://[^\s]+', '', 'g'), '^\s+|\s+$', '', 'g'), "
                r"'[/^-]\s*[A-Z]{{1,3}}\s*$', ''), '\p{{Nd}}+', '', 'g'), '\s+', ' ', 'g')))")


@query("A5_top_template", f"""
with g as (select {SQL_TEMPLATE.format('text')} as k, count(*) as n, min(doc_id) as first_id
  from documents group by 1)
select n, first_id, md5(d.text) as reply_md5
from (select * from g order by n desc, first_id limit 1) t join documents d on d.doc_id = first_id""")
def _(spark, sf):
    return scoring.top_template(b.documents(spark, sf), "text", "doc_id").select(
        "n", "first_id", F.md5("reply").alias("reply_md5"))


@query("W5_prior_messages", """
select conv_id, turn, count(*) filter (where role = 'user') over (
  partition by conv_id order by turn rows between unbounded preceding and 1 preceding)
  as prior_messages from conversations""")
def prior_messages(spark, sf):
    return history.prior_messages(b.conversations(spark, sf)).select(
        "conv_id", "turn", "prior_messages")


@query("W9_last_user_turn", """
select conv_id, turn, md5(last_value(case when role = 'user' then text end ignore nulls) over (
  partition by conv_id order by turn rows between unbounded preceding and 1 preceding))
  as previous_md5 from conversations""")
def _(spark, sf):
    return history.last_user_text(b.conversations(spark, sf)).select(
        "conv_id", "turn", F.md5("previous_user_text").alias("previous_md5"))


@query("W9_recent_turns", """
select conv_id, turn, coalesce(string_agg(concat(role, ':', md5(text)), '|') over (
  partition by conv_id order by turn rows between 4 preceding and 1 preceding), '') as history
from conversations""")
def recent_turns(spark, sf):
    h = history.recent_turns(b.conversations(spark, sf), 4)
    return h.select("conv_id", "turn", F.array_join(F.transform(
        "history", lambda t: F.concat(t["role"], F.lit(":"), F.md5(t["text"]))), "|")
        .alias("history"))


@query("T10_word_count", f"""
select doc_id, {b.SQL_WORDS.format('text')} as n_words from documents""")
def _(spark, sf):
    return b.documents(spark, sf).select(
        "doc_id", tx.word_count(F.col("text")).alias("n_words"))
