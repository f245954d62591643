"""Retrieval queries."""

from pyspark.sql import functions as F

from replylens.functions import text as tx
from replylens.operators import bm25, history, textindex, vectorindex
from replylens.operators import retrieval as rt
from replylens.plans import bindings as b
from replylens.plans.registry import query, table
from replylens.plans.textual import SQL_TOKENS


@query("J8_nearest", f"""
with {b.NEAREST} select id, neighbour_id, round(similarity, 4) as similarity, rank from hits""")
def nearest(spark, sf):
    v = b.vectors(spark, sf)
    return rt.nearest(v, v, 4, "id", "id").withColumn("similarity", F.round("similarity", 4))


@query("J8_nearest_blocked", f"""
with {b.NEAREST} select id, neighbour_id, round(similarity, 4) as similarity, rank from hits""")
def _(spark, sf):
    """The same search with a query side past the broadcast bound."""
    v = b.vectors(spark, sf)
    return rt.nearest(v, v, 4, "id", "id", block=256, index_block=1024).withColumn(
        "similarity", F.round("similarity", 4))


@query("J8_nearest_quantised", f"""
with {b.NEAREST} select id, neighbour_id, round(similarity, 4) as similarity, rank from hits""")
def nearest_quantised(spark, sf):
    """The same rows from a stored index of one byte per component."""
    v = b.vectors(spark, sf)
    return vectorindex.nearest_quantised(v, vectorindex.build_vector_index(v, row_id="id")).withColumn(
        "similarity", F.round("similarity", 4))


@query("S3_W6_top_one_quantised", f"""
with {b.NEAREST} select id, neighbour_id from hits where rank = 1""")
def _(spark, sf):
    """One neighbour each, with a query side past what every task holds."""
    v = b.vectors(spark, sf)
    return vectorindex.nearest_quantised(v, vectorindex.build_vector_index(v, row_id="id"), 1, block=300,
                                         index_block=1000).select("id", "neighbour_id")


@query("J8_nearest_approximate")
def _(spark, sf):
    v = b.vectors(spark, sf)
    return rt.nearest_approx(v, v, 4, "id", "id")


@query("S3_W6_top_one_per_query", f"""
with {b.NEAREST} select id, neighbour_id from hits where rank = 1""")
def _(spark, sf):
    v = b.vectors(spark, sf)
    return rt.nearest(v, v, 1, "id", "id").select("id", "neighbour_id")


@query("J7_ordered_lookup", """
with wanted as (
  select doc_id as id, unnest([doc_id * 7 % 1500, 3, doc_id + 1, -5]) as wanted_id,
    unnest([0, 1, 2, 3]) as pos from documents)
select id, string_agg(concat(pos, ':', d.doc_id, ':', md5(d.text)), '|' order by pos) as evidence
from wanted w join documents d on d.doc_id = w.wanted_id group by id""")
def ordered_lookup(spark, sf):
    """Every case cites document 3, so one index row takes a third of all lookups."""
    d = b.documents(spark, sf)
    i = F.col("doc_id")
    cases = d.select(i.alias("id"), F.array(i * 7 % 1500, F.lit(3).cast("long"), i + 1,
                                            F.lit(-5).cast("long")).alias("retrieved_ids"))
    index = d.select(i.alias("tweet_id"), F.md5("text").alias("digest"))
    found = rt.evidence_by_ids(cases, index, fields=["digest"])
    return found.filter(F.size("evidence") > 0).select("id", F.array_join(F.transform(
        "evidence", lambda e: F.concat_ws(":", e["pos"].cast("string"),
                                          e["tweet_id"].cast("string"), e["digest"])), "|")
        .alias("evidence"))


CASES = f"""
with {b.NEAREST}, lines as (
  select id, rank, concat('[', rank - 1, '] similarity ', printf('%.2f', similarity),
    chr(10), '    customer: label ', d.label, chr(10), '    brand replied: case ', d.vec_id) as line
  from hits h join embeddings d on d.vec_id = h.neighbour_id),
cases as (select id, string_agg(line, chr(10) || chr(10) order by rank) as evidence from lines group by id)"""


def _past_cases(spark, sf):
    v = b.vectors(spark, sf)
    hits = rt.nearest(v, v, 4, "id", "id")
    facts = v.select(F.col("id").alias("neighbour_id"),
                     F.concat(F.lit("label "), "label").alias("customer_text"),
                     F.concat(F.lit("case "), F.col("id").cast("string")).alias("brand_reply"))
    item = F.struct("rank", "similarity", "customer_text", "brand_reply")
    return hits.join(facts, "neighbour_id").groupBy("id").agg(
        F.sort_array(F.collect_list(item)).alias("items"))


@query("T16_evidence_text", f"{CASES} select id, evidence from cases")
def _(spark, sf):
    return _past_cases(spark, sf).select("id", tx.render_evidence(F.col("items")).alias("evidence"))


@query("T17_judge_request", f"""{CASES}
select e.vec_id as id, concat('Judge the reply.', chr(10), chr(10), 'Customer message:', chr(10), 'label ', e.label,
  chr(10), chr(10), 'Draft reply:', chr(10), 'case ', e.vec_id, chr(10), chr(10), 'Past cases:', chr(10),
  coalesce(c.evidence, '(no similar past cases found)')) as request
from embeddings e left join cases c on c.id = e.vec_id""")
def _(spark, sf):
    """What a judge is asked about a draft: the message, the draft, and the past cases it rests on."""
    v, cases = b.vectors(spark, sf), _past_cases(spark, sf)
    return v.join(cases, "id", "left").select("id", tx.request_text(
        "Judge the reply.", F.concat(F.lit("label "), "label"), F.col("items"),
        F.concat(F.lit("case "), F.col("id").cast("string"))).alias("request"))


BM25 = f"""d as (select doc_id, {SQL_TOKENS.format('text')} as t from documents),
q as (select item_id as query_id, list_distinct({SQL_TOKENS.format('text')}) as t from benchmark),
stats as (select count(*)::double as n, avg(len(t)) as average from d),
dt as (select doc_id, len(t) as length, unnest(t) as term from d),
tf as (select doc_id, length, term, count(*)::double as tf from dt group by all),
df as (select term, count(*)::double as df from tf group by term),
qt as (select query_id, unnest(t) as term from q)"""


@query("J9_matched_terms", f"""
with {BM25}, nq as (select term, count(*) as n_queries from qt group by term)
select tf.term, any_value(n_queries) as n_queries, sum(tf)::bigint as occurrences, count(*) as df
from tf join nq on nq.term = tf.term group by tf.term""")
def _(spark, sf):
    q = table(spark, sf, "benchmark").withColumnRenamed("item_id", "query_id")
    return bm25.matched_terms(q, b.documents(spark, sf), "query_id")


@query("A31_corpus_statistics", f"""
with {BM25} select term, df::bigint as df, n::bigint as n_docs, round(average, 6) as avg_len
from df, stats""")
def _(spark, sf):
    d = b.documents(spark, sf)
    size = bm25.corpus_size(d).select(F.struct("n_docs", "avg_len")).scalar()
    return bm25.document_frequency(d).select(
        "term", "df", size["n_docs"].alias("n_docs"),
        F.round(size["avg_len"], 6).alias("avg_len"))


SEARCH = f"""with {BM25}, scored as (
  select qt.query_id, tf.doc_id, round(sum(ln(1 + (n - df + 0.5::double) / (df + 0.5::double))
    * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * length / average))), 3) as score
  from qt join tf on tf.term = qt.term join df on df.term = qt.term, stats group by all)
select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id)
  as rank from scored where score > 0 qualify rank <= 4"""


@query("T8_S4_bm25_search", SEARCH)
def bm25_search(spark, sf):
    """Documents are stored as an index, which alone is searched."""
    q = table(spark, sf, "benchmark").withColumnRenamed("item_id", "query_id")
    return textindex.search(q, textindex.build_index(b.documents(spark, sf)))


@query("T8_S4_bm25_search_blocked", SEARCH)
def _(spark, sf):
    """The same search over many small blocks, most of which the bounds rule out."""
    q = table(spark, sf, "benchmark").withColumnRenamed("item_id", "query_id")
    return textindex.search(q, textindex.build_index(b.documents(spark, sf), block_docs=16))


PASSAGES = f"""p as (select item_id as ord, {SQL_TOKENS.format("concat('Item ', item_id, ' ', text)")} as t from benchmark),
stats as (select count(*)::double as n, avg(len(t)) as average from p),
pt as (select ord, len(t) as length, unnest(t) as term from p),
tf as (select ord, length, term, count(*)::double as tf from pt group by all),
df as (select term, count(*)::double as df from tf group by term)"""
# q: (conv_id, turn, term) of the messages; top: their best four passages.
EVIDENCE = """scored as (select conv_id, turn, tf.ord, round(sum(ln(1 + (n - df + 0.5::double) / (df + 0.5::double))
    * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * length / average))), 3) as score
  from q join tf on tf.term = q.term join df on df.term = q.term, stats group by all),
top as (select *, row_number() over (partition by conv_id, turn order by score desc, ord) as rank
  from scored where score > 0 qualify rank <= 4)"""


def passages(spark, sf):
    return table(spark, sf, "benchmark").select(
        F.col("item_id").alias("ord"), F.col("item_id").cast("string").alias("id"),
        F.concat(F.lit("Item "), F.col("item_id").cast("string")).alias("title"), "text")


@query("J9_live_passage_evidence", f"""
with {PASSAGES},
c as (select conv_id, turn, role, text, last_value(case when role = 'user' then text end ignore nulls)
  over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) as previous
  from conversations),
q as (select conv_id, turn, unnest(list_distinct({SQL_TOKENS.format("concat_ws(' ', text, previous)")})) as term
  from c where role = 'user'), {EVIDENCE}
select conv_id, turn, string_agg(concat(ord, ':', printf('%.3f', score)), '|' order by rank) as evidence
from top group by all""")
def live_passage_evidence(spark, sf):
    asked = history.last_user_text(b.conversations(spark, sf)).filter("role = 'user'").select(
        "conv_id", "turn", F.col("text").alias("message"), "previous_user_text")
    found = textindex.passage_evidence(asked, passages(spark, sf), message_id=["conv_id", "turn"],
                                  previous="previous_user_text")
    return found.filter(F.size("evidence") > 0).select("conv_id", "turn", F.array_join(F.transform(
        "evidence", lambda e: F.concat(e["id"], F.lit(":"), F.format_string("%.3f", e["score"]))),
        "|").alias("evidence"))


@query("T9_T8_own_policy_evidence", f"""
with c as (select conv_id, turn, role, text, last_value(case when role = 'user' then text end ignore nulls)
  over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) as message
  from conversations),
a as (select * from c where role = 'assistant'),
p as (select conv_id, turn, unnest(regexp_split_to_array(text, '\\n\\s*\\n')) as p,
  generate_subscripts(regexp_split_to_array(text, '\\n\\s*\\n'), 1) as i from a),
s as (select conv_id, turn, i, j, substr(p, j * 900 + 1, 900) as s
  from p, lateral unnest(range(0, ((len(p) + 899) // 900)::int)) r(j)),
n as (select *, row_number() over (partition by conv_id, turn order by i, j) as n
  from s where regexp_matches(s, '[^\\s]')),
t as (select conv_id, turn, n, {SQL_TOKENS.format("concat('Your support policy · section ', n, ' ', s)")} as t from n),
stats as (select conv_id, turn, count(*)::double as docs, avg(len(t)) as average from t group by all),
e as (select conv_id, turn, n, len(t) as length, unnest(t) as term from t),
tf as (select conv_id, turn, n, length, term, count(*)::double as tf from e group by all),
df as (select conv_id, turn, term, count(*)::double as df from tf group by all),
q as (select conv_id, turn, unnest(list_distinct({SQL_TOKENS.format('message')})) as term from a),
r as (select tf.conv_id, tf.turn, tf.n, round(sum(ln(1 + (docs - df + 0.5::double) / (df + 0.5::double)) * tf * 2.2::double
    / (tf + 1.2::double * (0.25::double + 0.75::double * length / average))), 3) as score
  from q join tf on tf.conv_id = q.conv_id and tf.turn = q.turn and tf.term = q.term
  join df on df.conv_id = tf.conv_id and df.turn = tf.turn and df.term = tf.term
  join stats on stats.conv_id = tf.conv_id and stats.turn = tf.turn group by all)
select conv_id, turn, string_agg(concat('CUSTOM-', n, ':', printf('%.3f', score)), '|' order by score desc, n) as evidence
from (select *, row_number() over (partition by conv_id, turn order by score desc, n) as place from r
  where score > 0 qualify place <= 4) group by all""")
def own_policy_evidence(spark, sf):
    """Each answer of the assistant stands for a policy, the turn before it for the message."""
    asked = history.last_user_text(b.conversations(spark, sf)).filter("role = 'assistant'").select(
        "conv_id", "turn", F.col("previous_user_text").alias("message"), F.col("text").alias("policy"))
    found = bm25.own_policy_evidence(asked)
    return found.filter(F.size("evidence") > 0).select("conv_id", "turn", F.array_join(F.transform(
        "evidence", lambda e: F.concat(e["id"], F.lit(":"), F.format_string("%.3f", e["score"]))),
        "|").alias("evidence"))
