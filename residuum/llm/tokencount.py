"""Token counts per section: a whole document is encoded once, tokens are attributed by their places.

Tokens of a byte-level vocabulary tile a text, so running sums of their lengths are their places. Sections
tile it as well. A token inside one section counts there; a token that crosses a boundary counts for the
section that holds most of its bytes, the earliest of equals. So counts of sections add up to the document.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

#: Fixed value: how the byte-level vocabularies cut a text before their merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ROWS = 512
#: Runs of blanks from this length on are merged here: the library's pattern search fails on runs of a million.
LONG_BLANKS = 100_000
#: Fixed value: the blanks of that pattern.
BLANK = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def merged_lengths(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Byte lengths of the tokens of one piece: the best pair first, the leftmost of equals, over a linked list."""
    after, before, stop = list(range(1, len(piece) + 1)), list(range(-1, len(piece) - 1)), list(range(1, len(piece) + 1))
    queue = [(ranks[piece[i:i + 2]], i, i + 2) for i in range(len(piece) - 1) if piece[i:i + 2] in ranks]
    heapq.heapify(queue)
    while queue:
        _, i, end = heapq.heappop(queue)
        j = after[i] if stop[i] else len(piece)
        if not stop[i] or j >= len(piece) or stop[j] != end or not stop[j]:
            continue  # one of the two symbols is another by now
        stop[i], stop[j], after[i] = end, 0, after[j]
        if after[i] < len(piece):
            before[after[i]] = i
        for a in (before[i], i):
            b = after[a] if a >= 0 else len(piece)
            if a >= 0 and b < len(piece) and (rank := ranks.get(piece[a:stop[b]])) is not None:
                heapq.heappush(queue, (rank, a, stop[b]))
    out, i = [], 0
    while i < len(piece):
        out.append(stop[i] - i)
        i = after[i]
    return out


class Counter:
    def __init__(self, path: str):
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.ranks, self.long = ranks, re.compile(f"[{BLANK}]{{{LONG_BLANKS},}}")
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        self.lengths[list(ranks.values())] = [len(k) for k in ranks]

    def spans(self, text: str) -> np.ndarray:
        """Where each token ends, in bytes."""
        parts, at = [], 0
        for run in self.long.finditer(text) if len(text) >= LONG_BLANKS else ():
            # The last blank of a run belongs to the word after it.
            end = run.end() if run.end() == len(text) else run.end() - 1
            parts += [self._lengths(text[at:run.start()]), np.array(merged_lengths(text[run.start():end].encode(), self.ranks), np.int64)]
            at = end
        return np.cumsum(np.concatenate([*parts, self._lengths(text[at:])]))

    def _lengths(self, text: str) -> np.ndarray:
        return self.lengths[np.array(self.encoding.encode_ordinary(text), np.int64)]


def attributed(token_ends: np.ndarray, section_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of them cross a boundary; both inputs are ends of tilings."""
    starts = np.concatenate([[0], token_ends[:-1]])
    first, last = np.searchsorted(section_ends, starts, "right"), np.searchsorted(section_ends, token_ends - 1, "right")
    at, crossing = first.copy(), np.flatnonzero(first != last)
    for t in crossing:
        cuts = np.concatenate([[starts[t]], section_ends[first[t]:last[t]], [token_ends[t]]])
        at[t] = first[t] + np.argmax(np.diff(cuts))
    n = len(section_ends)
    return np.bincount(at, minlength=n), np.bincount(at[crossing], minlength=n)


_COUNTERS: dict[str, Counter] = {}


def section_tokens(fields: DataFrame, path: str) -> DataFrame:
    """One row per section of each row of ``fields`` (doc_id, sections array<string>).

    Returns doc_id, section (from 0), n_chars, n_tokens, n_crossing (of those, tokens that also touch another
    section). The document is the sections one after the other. A null array is a document with one empty
    section, a null section is empty, and an empty section has no tokens. Repeated rows are counted each; an
    empty table gives no rows; further columns are ignored. ``path`` is a rank file that every executor has.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _COUNTERS:
            _COUNTERS[path] = Counter(path)
        own = _COUNTERS[path]
        for whole in batches:
            for begin in range(0, len(whole), ROWS):
                batch = whole.slice(begin, ROWS)
                docs, places, chars, counts, crossing = [], [], [], [], []
                for row, sections in enumerate(batch.column(1)):
                    texts = [t or "" for t in sections.as_py() or [""]] or [""]
                    ends = np.cumsum([len(t.encode()) for t in texts])
                    tokens, crossed = attributed(own.spans("".join(texts)), ends) if ends[-1] else (np.zeros(len(texts), np.int64),) * 2
                    docs += [row] * len(texts)
                    places += range(len(texts))
                    chars += map(len, texts)
                    counts.append(tokens)
                    crossing.append(crossed)
                number = lambda x: pa.array(x, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(docs, pa.int64())), number(places), number(chars), number(np.concatenate(counts)),
                                                  number(np.concatenate(crossing))], ["doc_id", "section", "n_chars", "n_tokens", "n_crossing"])

    return fields.select("doc_id", "sections").mapInArrow(run, f"doc_id {fields.schema['doc_id'].dataType.simpleString()}, section long, n_chars long, n_tokens long, n_crossing long")
