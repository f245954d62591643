"""License scan: templates with optional and replaceable regions, matched as token automata.

Template markup, in the style of public license templates:

* plain text is mandatory wording, compared word by word after lower-casing,
* ``<<beginOptional>> ... <<endOptional>>`` may be left out,
* ``<<var;words=1-4;match=[0-9]+>>`` stands for that many words, each of which must match.

A template is compiled to an automaton over words. A text is accepted where some stretch
of its words leads from the first state to the last, so the mandatory wording must stand
there exactly and in full.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from replylens.llm.common import pieces_of, words_of

# Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by",
           "mit license": "mit"}

# License texts and notices as templates, by label.
TEMPLATES: Mapping[str, tuple[str, ...]] = {
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the <<beginOptional>>\"<<endOptional>>"
        "Software), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do "
        "so, subject to the following conditions: The above copyright notice and this permission "
        "notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included "
        "in all copies or substantial portions of the Software.",),
    "mit-notice": (
        "<<beginOptional>>released<<endOptional>> <<beginOptional>>licensed<<endOptional>> under "
        "<<beginOptional>>the<<endOptional>> <<beginOptional>>terms of the<<endOptional>> "
        "MIT License",),
    "apache-2.0": (
        "<<beginOptional>>Licensed under the<<endOptional>> Apache License, "
        "<<beginOptional>>Version<<endOptional>> 2.0",),
    "gpl-3.0": (
        "<<beginOptional>>licensed under the<<endOptional>> GNU General Public License, "
        "<<beginOptional>>as published by the Free Software Foundation, either<<endOptional>> "
        "<<beginOptional>>version<<endOptional>> 3<<beginOptional>>.0<<endOptional>>",),
    "gpl-2.0": (
        "<<beginOptional>>licensed under the<<endOptional>> GNU General Public License, "
        "<<beginOptional>>as published by the Free Software Foundation, either<<endOptional>> "
        "<<beginOptional>>version<<endOptional>> 2<<beginOptional>>.0<<endOptional>>",),
    "cc-by-nc": (
        "<<beginOptional>>licensed under<<endOptional>> <<beginOptional>>the<<endOptional>> CC "
        "BY-NC <<beginOptional>><<var;words=1-1;match=sa|nd>><<endOptional>> "
        "<<var;words=1-2;match=[0-9]>>",),
    "bsd-text": (
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met: "
        "<<var;words=0-1;match=[0-9]>> Redistributions of source code must retain the above "
        "copyright notice, this list of conditions and the following disclaimer.",),
    "isc-text": (
        "Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this "
        "software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies.",),
    "all-rights-reserved": (
        "<<beginOptional>>Copyright <<beginOptional>>(c)<<endOptional>> "
        "<<var;words=1-8;match=.+>><<endOptional>> All rights reserved",),
}

_MARK = re.compile(r"<<(beginOptional|endOptional|var;words=(\d+)-(\d+);match=(.*?))>>")


@dataclass
class Automaton:
    """States are numbered; 0 is the first, ``last`` the accepting one.

    ``words[s]`` leads from state s by that word, ``any[s]`` by any word matching the
    pattern, ``free[s]`` without a word.
    """

    words: list[dict[bytes, int]] = field(default_factory=list)
    any: list[list[tuple[re.Pattern, int]]] = field(default_factory=list)
    free: list[list[int]] = field(default_factory=list)
    last: int = 0
    anchor: tuple[bytes, ...] = ()
    before: int = 0

    def state(self) -> int:
        self.words.append({})
        self.any.append([])
        self.free.append([])
        return len(self.words) - 1

    def closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def end_from(self, words: list[bytes], start: int) -> int | None:
        """The longest accepted stretch from ``start``: the place after it, else None."""
        now, found = self.closure({0}), None
        for at in range(start, len(words) + 1):
            if self.last in now:
                found = at
            if at == len(words) or not now:
                break
            word, after = words[at], set()
            for s in now:
                if word in self.words[s]:
                    after.add(self.words[s][word])
                after.update(t for rx, t in self.any[s] if rx.fullmatch(word))
            now = self.closure(after)
        return found


def compile_template(template: str) -> Automaton:
    """The automaton of one template.

    ``anchor`` is the longest stretch of mandatory words; ``before`` how many words can
    stand in front of it at most. Only stretches around an anchor are tried.
    """
    auto = Automaton()
    here = auto.state()
    open_at: list[int] = []
    longest = 0             # words read so far, at most
    run: list[bytes] = []

    def close_run():
        if len(run) > len(auto.anchor):
            auto.anchor, auto.before = tuple(run), longest - len(run)
        run.clear()

    at = 0
    for mark in [*_MARK.finditer(template), None]:
        text = template[at:mark.start() if mark else len(template)]
        for word in words_of(text):
            following = auto.state()
            auto.words[here][word] = following
            here = following
            longest += 1
            if not open_at:
                run.append(word)
        if mark is None:
            break
        at = mark.end()
        close_run()
        if mark[1] == "beginOptional":
            fresh = auto.state()
            auto.free[here].append(fresh)
            open_at.append(fresh)
            here = fresh
        elif mark[1] == "endOptional":
            following = auto.state()
            auto.free[here].append(following)
            auto.free[open_at.pop()].append(following)
            here = following
        else:
            low, high, rx = int(mark[2]), int(mark[3]), re.compile(mark[4].encode())
            end = auto.state()
            for n in range(high):
                if n >= low:
                    auto.free[here].append(end)
                following = auto.state()
                auto.any[here].append((rx, following))
                here = following
            auto.free[here].append(end)
            here = end
            longest += high
    close_run()
    if open_at or not auto.anchor:
        raise ValueError("a template needs closed regions and mandatory wording")
    auto.last = here
    return auto


def _places(words: list[bytes], phrase: tuple[bytes, ...]) -> Iterator[int]:
    at, n = -1, len(phrase)
    while True:
        try:
            at = words.index(phrase[0], at + 1)
        except ValueError:
            return
        if tuple(words[at:at + n]) == phrase:
            yield at


def scan(words: list[bytes], phrases, templates) -> tuple[list[tuple[int, str]], list[tuple[str, int, int]]]:
    """(start, label) of every phrase and (label, start, end) of every accepted stretch.

    Of the accepted stretches of a label that overlap, the longest from the first start
    is given.
    """
    joined = b" " + b" ".join(words) + b" "
    base = [(at, label) for phrase, label in phrases if b" " + b" ".join(phrase) + b" " in joined
            for at in _places(words, phrase)]
    spans = []
    for label, auto in templates:
        if b" " + b" ".join(auto.anchor) + b" " not in joined:
            continue
        taken = 0
        for anchor in _places(words, auto.anchor):
            for start in range(max(taken, anchor - auto.before), anchor + 1):
                end = auto.end_from(words, start)
                if end is not None and end > anchor:
                    spans.append((label, start, end))
                    taken = end
                    break
    return base, spans


SCHEMA = ("doc_id {id}, n_words long, n_base long, first_word long, last_word long, "
          "base_labels string, labels string, score double, "
          "spans array<struct<label:string,start:long,end:long>>")


def scan_licenses(docs: DataFrame, phrases: Mapping[str, str] = PHRASES,
                  templates: Mapping[str, tuple[str, ...]] = TEMPLATES,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """License phrases and accepted license wording of every text, one row per input row.

    ``score`` is 1 where a template is accepted, 0.5 where only a phrase stands, else 0.
    ``spans`` lists accepted stretches by word. No shuffle: each row is read alone, so
    keys, copies and hot sources do not matter. Null or wordless texts: zero words, empty
    label strings, null places. Repeated rows: repeated results.
    """
    wanted = [(tuple(words_of(p)), label) for p, label in phrases.items()]
    autos = [(label, compile_template(t)) for label, ts in templates.items() for t in ts]

    def run(batches):
        for batch in pieces_of(batches):
            out = []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                base, spans = scan(words, wanted, autos)
                places = [at for at, _ in base]
                labels = {label for _, label in base}
                out.append((len(words), len(base), min(places, default=None),
                            max(places, default=None), ",".join(sorted(labels)),
                            ",".join(sorted(labels | {s[0] for s in spans})),
                            1.0 if spans else 0.5 if base else 0.0,
                            [{"label": s[0], "start": s[1], "end": s[2]} for s in spans]))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct(
                [("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))]
            cols = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], names=NAMES)

    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return source.mapInArrow(run, SCHEMA.format(id=source.schema["doc_id"].dataType.simpleString()))


NAMES = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels",
         "score", "spans"]


def _sql_regex(template: str) -> str:
    """The template as a regular expression over words that each stand as ' word'."""
    out, at = [], 0
    for mark in [*_MARK.finditer(template), None]:
        text = template[at:mark.start() if mark else len(template)]
        out += [" " + w.decode() for w in words_of(text)]
        if mark is None:
            return "".join(out) + " "
        at = mark.end()
        out.append("(?:" if mark[1] == "beginOptional" else ")?" if mark[1] == "endOptional"
                   else "(?: (?:%s)){%s,%s}" % (mark[4].replace(".+", "[^ ]+"), mark[2], mark[3]))
    return ""


def sql() -> str:
    """The whole query in SQL: templates as regular expressions over the joined words."""
    words = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
             r"'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')")
    places = []
    for phrase, label in PHRASES.items():
        test = " and ".join(f"ws[i + {k}] = '{w.decode()}'" for k, w in enumerate(words_of(phrase)))
        places.append(f"case when contains(joined, ' {' '.join(w.decode() for w in words_of(phrase))} ') "
                      f"then list_transform(list_filter(range(1, len(ws) + 1), lambda i: {test}), "
                      f"lambda i: {{'at': i - 1, 'label': '{label}'}}) else [] end")
    more = [f"case when regexp_matches(joined, '{_sql_regex(t)}') then '{label}' end"
            for label, ts in TEMPLATES.items() for t in ts]
    return f"""
with w as (select doc_id, {words} as ws from documents),
j as (select doc_id, ws, ' ' || array_to_string(ws, ' ') || ' ' as joined from w),
p as (select doc_id, ws, flatten([{', '.join(places)}]) as base,
  list_filter([{', '.join(more)}], lambda x: x is not null) as more from j)
select doc_id, len(ws)::bigint as n_words, len(base)::bigint as n_base,
  list_min(list_transform(base, lambda x: x['at']))::bigint as first_word,
  list_max(list_transform(base, lambda x: x['at']))::bigint as last_word,
  array_to_string(list_sort(list_distinct(list_transform(base, lambda x: x['label']))), ',') as base_labels,
  array_to_string(list_sort(list_distinct(list_concat(list_transform(base, lambda x: x['label']), more))), ',') as labels,
  case when len(more) > 0 then 1.0::double when len(base) > 0 then 0.5::double else 0.0::double end as score
from p"""
