"""Sampling queries."""

from pyspark.sql import functions as F

from replylens.functions import text as tx
from replylens.operators import sampling as sa
from replylens.plans import bindings as b
from replylens.plans.registry import query
from replylens.plans.textual import HARDNESS, SQL_NEAR
from replylens.session import materialise

SEED = sa.SEED
KEY = "md5(concat('{seed}:', doc_id))"


def _top(n: int, seed: int, source: str = "documents") -> str:
    return f"select doc_id from {source} order by {KEY.format(seed=seed)}, doc_id limit {n}"


@query("S1_seeded_sample", _top(120, SEED))
def seeded_sample(spark, sf):
    return sa.seeded_sample(b.documents(spark, sf), "doc_id", 120).select("doc_id")


@query("S2_fixed_subsets", f"""
with a as ({_top(sa.N_RELABEL, SEED + 1)}), c as ({_top(sa.N_RATED, SEED + 2)})
select 'relabel' as subset, doc_id from a union all select 'rate', doc_id from c""")
def _(spark, sf):
    d = b.documents(spark, sf)
    one = sa.relabel_subset(d, "doc_id").select(F.lit("relabel").alias("subset"), "doc_id")
    return one.union(sa.rating_subset(d, "doc_id").select(F.lit("rate"), "doc_id"))


@query("W2_per_class_sample", f"""
select doc_id, source, row_number() over (partition by source order by {KEY.format(seed=SEED)}, doc_id)
  as place from documents qualify place <= 2""")
def _(spark, sf):
    s = sa.per_class_sample(b.documents(spark, sf), "source", "doc_id", 2)
    from pyspark.sql import Window
    w = Window.partitionBy("source").orderBy(sa.draw_key("doc_id"), "doc_id")
    return s.select("doc_id", "source", F.row_number().over(w).alias("place"))


@query("W3_split_and_sequence", f"""
with pool as ({_top(200, SEED + 5)})
select doc_id, row_number() over (order by {KEY.format(seed=SEED)}, doc_id) as seq,
  case when seq <= 60 then 'dev' else 'test' end as split from pool""")
def _(spark, sf):
    pool = sa.seeded_sample(b.documents(spark, sf), "doc_id", 200, SEED + 5).select("doc_id")
    return sa.split_and_sequence(pool, "doc_id")


@query("W4_topup_plan", f"""
with chosen as (select * from documents where doc_id in ({_top(30, SEED)})),
have as (select lang, count(*) as n from chosen group by lang),
avail as (select lang, count(*) as n from documents where doc_id not in (select doc_id from chosen)
          group by lang),
plan as (select c.lang, c.ord, coalesce(h.n, 0) as have, coalesce(a.n, 0) as avail,
    greatest(least(20 - coalesce(h.n, 0), coalesce(a.n, 0)), 0) as need
  from (values ('en', 0), ('de', 1), ('fr', 2), ('es', 3)) c(lang, ord)
  left join have h on h.lang = c.lang left join avail a on a.lang = c.lang)
select lang, have, avail, need, greatest(least(need, 37 - coalesce(sum(need) over (
    order by have, ord rows between unbounded preceding and 1 preceding), 0)), 0)::bigint as take
from plan""")
def _(spark, sf):
    d = b.documents(spark, sf)
    chosen = sa.seeded_sample(d, "doc_id", 30)
    rest = sa.without(d, chosen, "doc_id")
    n = F.count(F.lit(1)).alias("n")
    return sa.topup_plan(chosen.groupBy("lang").agg(n), rest.groupBy("lang").agg(n), 37,
                         classes=b.LANGS, label="lang").drop("ord")


@query("W4_topup_stratum", f"""
with chosen as (select * from documents where doc_id in ({_top(30, SEED)})),
rest as (select * from documents where doc_id not in (select doc_id from chosen)),
have as (select lang, count(*) as n from chosen group by lang),
avail as (select lang, count(*) as n from rest group by lang),
plan as (select c.lang, c.ord, coalesce(h.n, 0) as have,
    greatest(least(20 - coalesce(h.n, 0), coalesce(a.n, 0)), 0) as need
  from (values ('en', 0), ('de', 1), ('fr', 2), ('es', 3)) c(lang, ord)
  left join have h on h.lang = c.lang left join avail a on a.lang = c.lang),
take as (select lang, greatest(least(need, 37 - coalesce(sum(need) over (
    order by have, ord rows between unbounded preceding and 1 preceding), 0)), 0) as take from plan)
select doc_id, r.lang from rest r join take t on t.lang = r.lang
qualify row_number() over (partition by r.lang order by {KEY.format(seed=SEED)}, doc_id) <= take""")
def topup_stratum(spark, sf):
    d = b.documents(spark, sf)
    chosen = sa.seeded_sample(d, "doc_id", 30)
    return sa.topup_stratum(d, "doc_id", "lang", chosen, 37, classes=b.LANGS).select(
        "doc_id", "lang")


@query("W8_disjoint_random_strata", f"""
with first as ({_top(140, SEED)}), rest as (
  select * from documents where doc_id not in (select doc_id from first)),
second as ({_top(25, SEED + 9, 'rest')})
select doc_id, 'random' as stratum from first union all select doc_id, 'extra' from second""")
def _(spark, sf):
    d = b.documents(spark, sf)
    first = sa.random_stratum(d, "doc_id").select("doc_id", "stratum")
    second = sa.seeded_sample(sa.without(d, first, "doc_id"), "doc_id", 25, SEED + 9)
    return first.unionByName(second.select("doc_id", F.lit("extra").alias("stratum")))


@query("W7_hard_candidates", f"""
with {HARDNESS}, best as (
  select kind, md5({SQL_NEAR.format('d.text')}) as key_md5, max(score) as score, count(*) as n
  from hard h join documents d on d.doc_id = h.doc_id group by all)
select kind, count(*) as n_keys, sum(n)::bigint as n_messages, max(score) as best_score
from best group by kind""")
def _(spark, sf):
    """What the round-robin pick draws from: distinct keys and messages per kind."""
    d = tx.add_hardness(b.documents(spark, sf), "text", "h", b.SIGNALS)
    picked = d.select(F.explode(F.when(F.col("h.score") > 0, F.array("h"))).alias("h"),
                      F.md5(tx.near_dup_key(F.col("text"))).alias("key_md5"))
    keys = picked.groupBy("h.kind", "key_md5").agg(F.max("h.score").alias("score"),
                                                   F.count(F.lit(1)).alias("n"))
    return keys.groupBy("kind").agg(F.count(F.lit(1)).alias("n_keys"),
                                    F.sum("n").alias("n_messages"),
                                    F.max("score").alias("best_score"))


@query("W7_hard_stratum")
def hard_stratum(spark, sf):
    return sa.hard_stratum(b.documents(spark, sf), "doc_id", "text", signals=b.SIGNALS)


@query("U2_evaluation_pool")
def evaluation_pool(spark, sf):
    d = b.documents(spark, sf).select("doc_id", "text", "lang")
    return sa.evaluation_pool(d, "doc_id", "text", "lang", classes=b.LANGS, signals=b.SIGNALS,
                              keep=materialise).drop("text")
