"""Line dedup: repeated runs of lines, found by a suffix array over line ids.

Only DataFrame operations. A line's id is a 128-bit hash; lines that occur once in the
corpus cannot lie in a repeated run and leave at once. The remaining suffixes are ordered
by prefix doubling: the rank of the first 2k lines of a suffix is the place of the pair
(rank of the first k lines, rank of the next k lines) in a distributed sort of all pairs.
Pairs are counted before they are sorted, so a pair that holds a third of all rows is one
row there, and pairs that occur once are discarded.

A run counts as repeated from ``min_words`` words on. Every suffix therefore needs its
order only to the depth at which its first lines hold that many words, at most 50 lines
deep: suffixes that agree to that depth are an interval of the suffix array with a longest
common prefix of that many words or more. In each interval the first suffix stays and the
run that starts each other suffix is a later copy. The same is done for runs that end at a
line. Together these windows cover exactly the maximal repeated runs, because any run long
enough is a union of such windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from replylens.llm.common import checkpoint, stored

KEY = ["doc_id", "version"]
# white space other than the blank and the line end
_SPACES = "\t\v\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200b))) + "\u2028\u2029\u202f\u205f\u3000"


def _join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join that also matches null ids; key columns are kept once."""
    other = right.select(*[F.col(k).alias(f"_{k}") for k in keys],
                         *[c for c in right.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) if k == "doc_id" else F.col(k) == F.col(f"_{k}")
          for k in keys]
    return left.join(other, on, how).drop(*[f"_{k}" for k in keys])


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(docs[text_col], F.lit(""))
    lines = F.split(text, "\n")
    return docs.select(docs[id_col].alias("doc_id"), F.xxhash64(text).alias("version"), lines.alias("lines"),
                       _filled(lines).alias("filled"), docs[text_col].isNull().alias("was_null"))


def _words(line: Column) -> Column:
    # tabs and other white space part words as blanks do
    bare = F.trim(F.translate(line, _SPACES, " " * len(_SPACES)))
    return F.length(bare) - F.length(F.replace(bare, F.lit(" "), F.lit(""))) + 1


def repeated_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Lines that occur more than once: (doc_id, version, idx, words, rank).

    ``idx`` counts the lines of a document that are not blank. ``rank`` orders line ids.
    """
    line = F.col("line")
    lines = (_source(docs, id_col, text_col)
             .select(*KEY, F.posexplode(F.filter("lines", lambda x: F.trim(x) != "")).alias("idx", "line"))
             .select(*KEY, "idx", _words(line).alias("words"), F.xxhash64(line).alias("h1"),
                     F.xxhash64(F.lit(1), line).alias("h2")))
    often = lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1")
    ranked = _ranked(often, ["h1", "h2"])
    return lines.join(ranked, ["h1", "h2"]).drop("h1", "h2").dropDuplicates([*KEY, "idx"])


def _ranked(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """The place of each pair in the sorted order of all pairs, as an increasing number."""
    ordered = pairs.select(*keys).orderBy(*keys)
    return checkpoint(ordered.withColumn("rank", F.monotonically_increasing_id()))


def _depth(words: Column, min_words: int) -> Column:
    """How many leading entries reach ``min_words`` together; null if all do not."""
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("n"))
    seen = F.aggregate(words, start, lambda s, w: F.when(s["sum"] >= min_words, s).otherwise(
        F.struct((s["sum"] + w).alias("sum"), (s["n"] + 1).alias("n"))))
    return F.when(seen["sum"] >= min_words, seen["n"])


def suffix_order(docs: DataFrame, min_words: int, id_col: str = "doc_id",
                 text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(windows, ranks): stretches of at least ``min_words`` repeated lines, and the order.

    ``windows``: (doc_id, version, start, n_lines, level), the shortest stretch that
    starts, and that ends, at each line. ``ranks``: (doc_id, version, idx, level, rank),
    the order of suffixes by their first 2^level lines.
    """
    run = Window.partitionBy(*KEY, "run").orderBy("idx")
    deepest = min_words - 1         # a line that is not blank has a word
    doc = Window.partitionBy(*KEY).orderBy("idx")
    lines = (repeated_lines(docs, id_col, text_col)
             .withColumn("run", F.col("idx") - F.row_number().over(doc))
             .withColumn("ahead", _depth(F.collect_list("words").over(run.rowsBetween(0, deepest)), min_words))
             .withColumn("behind", _depth(F.reverse(F.collect_list("words").over(
                 run.rowsBetween(-deepest, 0))), min_words)))
    level = F.floor(F.log2(F.greatest(F.coalesce("ahead", F.lit(0)), F.coalesce("behind", F.lit(0)))))
    lines = stored(lines.withColumn("need", F.max(level).over(Window.partitionBy(*KEY, "run")))
                   .filter("need is not null"), "lines")
    windows = (lines.filter("ahead is not null")
               .select(*KEY, F.col("idx").alias("start"), F.col("ahead").alias("n_lines"))
               .union(lines.filter("behind is not null")
                      .select(*KEY, F.expr("idx - behind + 1"), "behind")).distinct()
               .withColumn("level", F.floor(F.log2("n_lines")).cast("int")))
    levels = lines.agg(F.max("need")).first()[0]
    now = lines.select(*KEY, "idx", "need", "rank")
    ranks = now.select(*KEY, "idx", F.lit(0).alias("level"), "rank")
    for k in range(int(levels) if levels is not None else 0):
        step = 1 << k
        pairs = (now.filter(F.col("need") > k)
                 .withColumn("second", F.when(F.lead("idx", step).over(doc) == F.col("idx") + step,
                                              F.lead("rank", step).over(doc)))
                 .filter("second is not null").withColumnRenamed("rank", "first"))
        pairs = checkpoint(pairs)
        often = pairs.groupBy("first", "second").agg(F.count("*").alias("n")).filter("n > 1")
        now = checkpoint(pairs.join(_ranked(often, ["first", "second"]), ["first", "second"])
                         .drop("first", "second"))
        ranks = ranks.union(now.select(*KEY, "idx", F.lit(k + 1).alias("level"), "rank"))
    return windows, ranks


def later_copies(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Lines that belong to a later copy of a repeated run: (doc_id, version, removed).

    ``removed`` lists places among the lines that are not blank. The copy that comes first
    by (doc_id, line) stays; null ids come first of all. A copy that overlaps the first
    one is part of it and stays too.
    """
    windows, ranks = suffix_order(docs, min_words, id_col, text_col)
    # a prefix of n lines is named by its first and its last 2^level lines
    first = ranks.withColumnsRenamed({"idx": "start", "rank": "head"})
    last = ranks.withColumnsRenamed({"idx": "tail_at", "rank": "tail"})
    named = _join(windows, first, [*KEY, "level", "start"])
    named = named.withColumn("tail_at", F.expr("start + n_lines - cast(pow(2, level) as int)"))
    named = checkpoint(_join(named, last, [*KEY, "level", "tail_at"]).drop("tail_at"))
    interval = ["n_lines", "head", "tail"]
    here = F.struct("doc_id", "version", "start")
    # stored, so that the join shuffles both sides and a hot interval can be split
    firsts = checkpoint(named.groupBy(*interval).agg(F.min(here).alias("first"), F.count("*").alias("n"))
                        .filter("n > 1").drop("n"))
    same = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.version") == F.col("version"))
    later = (named.join(firsts, interval)
             .filter(~(same & (F.col("start") < F.col("first.start") + F.col("n_lines")))))
    return (later.select(*KEY, F.explode(F.expr("sequence(start, start + n_lines - 1)")).alias("idx"))
            .groupBy(*KEY).agg(F.collect_set("idx").alias("removed")))


def dedup_lines(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """Every document without the later copies of repeated runs of lines.

    Returns (doc_id, text, n_lines, n_removed), one row per input row; a null text stays
    null. Words are counted by the blanks between them. Blank lines take no part and stay.
    Rows that share id and text are one document, so repeated rows remove nothing from
    each other; rows that share only the id are told apart by their text. A text whose
    lines all go becomes empty.
    """
    source = _source(docs, id_col, text_col)
    marked = _join(source, later_copies(docs, min_words, id_col, text_col), KEY, "left")
    return marked.select("doc_id", *_kept())


def _filled(lines: Column) -> Column:
    """Places of the lines that are not blank."""
    marked = F.transform(lines, lambda x, i: F.when(F.trim(x) != "", i))
    return F.filter(marked, lambda i: i.isNotNull())


def _kept() -> list[Column]:
    """Text and counts from the columns lines, filled, was_null and removed.

    ``lines`` and ``filled`` must be columns of the input, not expressions: they are read
    once per line here.
    """
    size = F.size("lines")
    gone = F.transform("removed", lambda j: F.element_at("filled", j + 1))
    left = F.array_except(F.sequence(F.lit(0), size - 1), gone)
    kept = F.transform(left, lambda i: F.element_at("lines", i + 1))
    text = F.when(F.col("was_null"), F.lit(None)).when(
        F.col("removed").isNull(), F.array_join("lines", "\n")).otherwise(F.array_join(kept, "\n"))
    return [text.alias("text"), size.cast("long").alias("n_lines"),
            F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed")]


def remove_repeats(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text",
                   size_col: str = "n_chars") -> DataFrame:
    """``docs`` with all its columns, later copies of repeated runs removed from its texts.

    Documents that lose lines and have only blanks left go. ``size_col``, if there is one,
    becomes the new length where lines were lost. Texts that lose nothing stay as they are.
    """
    rest = F.struct(*[docs[c] for c in docs.columns if c != text_col])
    lines = F.split(F.coalesce(docs[text_col], F.lit("")), "\n")
    source = docs.select(docs[id_col].alias("doc_id"), F.xxhash64(F.coalesce(docs[text_col], F.lit(""))).alias("version"),
                         lines.alias("lines"), _filled(lines).alias("filled"),
                         docs[text_col].isNull().alias("was_null"), rest.alias("rest"))
    marked = _join(source, later_copies(docs, min_words, id_col, text_col), KEY, "left")
    marked = marked.select("rest", *_kept())
    marked = marked.filter((F.col("n_removed") == 0) | (F.trim(F.translate("text", "\n", "")) != ""))
    out = []
    for c in docs.columns:
        if c == text_col:
            out.append(F.col("text").alias(c))
        elif c == size_col:
            length = F.length("text").cast(docs.schema[c].dataType)
            out.append(F.when(F.col("n_removed") == 0, F.col("rest")[c]).otherwise(length).alias(c))
        else:
            out.append(F.col("rest")[c].alias(c))
    return marked.select(*out)


def sql(min_words: int = 50) -> str:
    """The rows of the query in SQL: windows as joined texts, told apart by equality."""
    return f"""
with l as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as line_no from documents),
f as (
  select *, row_number() over (partition by doc_id order by line_no) - 1 as idx,
    length(bare) - length(replace(bare, ' ', '')) + 1 as words
  from (select *, trim(translate(line, '{_SPACES}', repeat(' ', {len(_SPACES)}))) as bare from l)
  where trim(line) <> ''),
c as (select *, sum(words) over (partition by doc_id order by idx) as upto from f),
ahead as (
  select a.doc_id, a.idx as start, min(b.idx) as stop from c a join c b
  on a.doc_id = b.doc_id and b.idx between a.idx and a.idx + {min_words - 1}
    and b.upto - a.upto + a.words >= {min_words} group by all),
behind as (
  select a.doc_id, max(b.idx) as start, a.idx as stop from c a join c b
  on a.doc_id = b.doc_id and b.idx between a.idx - {min_words - 1} and a.idx
    and a.upto - b.upto + b.words >= {min_words} group by all),
w as (select * from ahead union select * from behind),
t as (
  select w.doc_id, w.start, w.stop, string_agg(c.line, chr(10) order by c.idx) as run
  from w join c on c.doc_id = w.doc_id and c.idx between w.start and w.stop group by all),
g as (
  select *, first_value(doc_id) over o as first_doc, first_value(start) over o as first_start
  from t window o as (partition by run order by doc_id, start)),
gone as (
  select distinct doc_id, unnest(range(start, stop + 1)) as idx from g
  where not (doc_id = first_doc and start < first_start + stop - start + 1)),
k as (
  select l.doc_id, l.line_no, l.line, x.idx is not null as removed from l
  left join f on f.doc_id = l.doc_id and f.line_no = l.line_no
  left join gone x on x.doc_id = f.doc_id and x.idx = f.idx)
select doc_id, count(*)::bigint as n_lines, count(*) filter (removed)::bigint as n_removed,
  md5(coalesce(string_agg(line, chr(10) order by line_no) filter (not removed), '')) as kept_md5
from k group by doc_id"""
