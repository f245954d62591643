"""Token counts by section: whole documents are encoded once, tokens go to sections.

The vocabulary is byte-level, so its tokens spell the text byte by byte and the running
sum of their lengths gives the byte span, and from that the character span, of every
token. Spans of tokens and of sections are both sorted, so the interval join inside a
document is a merge by binary search. Documents are independent: nothing is shuffled.

Rules for a token that crosses a boundary:

* ``start``: it belongs to the section that holds its first character,
* ``most``: to the section that holds most of its characters, the earlier one if equal,
* ``split``: to every section by its share of the token's characters.

Characters outside all sections count for the section numbered -1, so that the counts of a
document always add up to its tokens.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from replylens.llm.common import pieces_of

# Fixed value: how byte-level vocabularies of this kind split a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Fixed value: the characters that \\s stands for in it.
BLANKS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_BLANK = 10_000     # blanks in a row that are no longer left to the pattern
_ENCODERS: dict = {}


class ByteEncoder:
    def __init__(self, path: str):
        import tiktoken
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.blank = re.compile(f"[{BLANKS}]{{{LONG_BLANK},}}")
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)

    def ids(self, text: str) -> list[int]:
        """Ids of the whole text.

        The pattern cannot take blanks in a row by the million. It makes all but the last of
        them one piece, or all of them at the end of a text, so that piece is cut out here.
        """
        found, at = [], 0
        for run in self.blank.finditer(text) if len(text) >= LONG_BLANK else ():
            end = run.end() if run.end() == len(text) else run.end() - 1
            found += self.encoding.encode_ordinary(text[at:run.start()])
            found += self.encoding._encode_single_piece(text[run.start():end])
            at = end
        return found + self.encoding.encode_ordinary(text[at:] if at else text)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first characters, ends): a token covers the characters its bytes touch."""
        ids = np.array(self.ids(text), dtype=np.int64)
        ends = np.cumsum(self.lengths[ids])
        starts = ends - self.lengths[ids]
        if text.isascii():
            return ids, starts, ends
        # place of the character each byte belongs to
        data = np.frombuffer(text.encode("utf-8"), np.uint8)
        char = np.cumsum((data & 0xC0) != 0x80) - 1
        return ids, char[starts], char[ends - 1] + 1


def encoder(path: str) -> ByteEncoder:
    """One encoder per Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ByteEncoder(path)
    return _ENCODERS[path]


def line_sections(text: str) -> list[tuple[int, int]]:
    """Character spans of the lines of a text, line breaks included."""
    spans, at = [], 0
    for line in text.split("\n"):
        end = min(at + len(line) + 1, len(text))
        if end > at:
            spans.append((at, end))
        at = end
    return spans


def share_out(starts: np.ndarray, ends: np.ndarray, sections: Sequence[tuple[int, int]], rule: str):
    """(counts, crossing) per section, the last entry for characters in no section.

    ``sections`` must be sorted and must not overlap.
    """
    n = len(sections)
    opens = np.array([s for s, _ in sections], np.int64)
    closes = np.array([e for _, e in sections], np.int64)
    if (opens[1:] < closes[:-1]).any() or (closes < opens).any():
        raise ValueError("sections must be sorted and apart")
    counts, crossing = np.zeros(n + 1), np.zeros(n + 1, np.int64)
    # bounds cut the text into stretches, each a section or a gap
    cuts = np.unique(np.concatenate([opens, closes])) if n else np.zeros(0, np.int64)
    owner = np.full(len(cuts) + 1, n)
    filled = np.flatnonzero(closes > opens)
    owner[np.searchsorted(cuts, opens[filled], side="right")] = filled
    low = np.searchsorted(cuts, starts, side="right")
    high = np.searchsorted(cuts, ends - 1, side="right")
    inside = low == high
    np.add.at(counts, owner[low[inside]], 1)
    for i in np.flatnonzero(~inside):           # tokens that cross a bound are few
        edges = np.concatenate([[starts[i]], cuts[low[i]:high[i]], [ends[i]]])
        held = owner[low[i]:high[i] + 1]
        sizes = np.zeros(n + 1)
        np.add.at(sizes, held, np.diff(edges))
        touched = held[np.sort(np.unique(held, return_index=True)[1])]
        if len(touched) == 1:
            counts[touched[0]] += 1
            continue
        crossing[touched] += 1
        if rule == "start":
            counts[held[0]] += 1
        elif rule == "most":
            counts[touched[np.argmax(sizes[touched])]] += 1
        else:
            counts += sizes / sizes.sum()
    return counts, crossing


def count_tokens(docs: DataFrame, vocabulary_path: str, rule: str = "start",
                 sections: Callable[[str], Sequence[tuple[int, int]]] | str = line_sections,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every section: (doc_id, section, start, end, n_tokens, n_crossing).

    ``sections`` gives sorted character spans that do not overlap: a function of the text,
    or the name of a column array<struct<start, end>>. Sections are numbered from 0;
    section -1 (null bounds) appears if tokens lie in none. ``n_crossing`` counts tokens
    that reach into the section and another. A null or empty text has no tokens, and no
    rows unless a column names sections for it. Repeated rows give repeated results.
    """
    if rule not in ("start", "most", "split"):
        raise ValueError(f"no rule {rule!r}")
    given = isinstance(sections, str)

    def run(batches):
        enc = encoder(vocabulary_path)
        for batch in pieces_of(batches):
            rows = [[], [], [], [], [], []]
            spans = batch.column("sections").to_pylist() if given else [None] * batch.num_rows
            for at, (text, own) in enumerate(zip(batch.column("text").to_pylist(), spans)):
                text = text or ""
                own = [(s["start"], s["end"]) for s in own or []] if given else list(sections(text))
                _, starts, ends = enc.spans(text)
                counts, crossing = share_out(starts, ends, own, rule)
                n = len(own) + bool(counts[-1] or crossing[-1])
                rows[0] += [at] * n
                rows[1] += [*range(len(own)), -1][:n]
                rows[2] += [*(s for s, _ in own), None][:n]
                rows[3] += [*(e for _, e in own), None][:n]
                rows[4] += counts[:n].tolist()
                rows[5] += crossing[:n].tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()),
                 pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.int64()), pa.array(rows[4], pa.float64()),
                 pa.array(rows[5], pa.int64())],
                names=["doc_id", "section", "start", "end", "n_tokens", "n_crossing"])

    columns = [docs[id_col].alias("doc_id"), docs[text_col].alias("text")]
    source = docs.select(*columns, *([docs[sections].alias("sections")] if given else []))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, section int, start long, end long, n_tokens double, "
                                  "n_crossing long")
