"""BPE encoding and decoding for a vocabulary file with word ends.

A piece of a text is a doubly linked list of symbols. A priority queue holds the merges of neighbours
by (rank, place); taking the best one links its right symbol out and queues the two new neighbours.
An entry is stale, and skipped, if its symbols have changed since. Decoding concatenates the strings
of the vocabulary, with a blank between two, as a file without a decoder asks for.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Entries of one generation of a worker's memory of pieces; two generations are kept.
GENERATION = 200_000
#: Rows of a result batch.
ROWS = 512


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself if it is printable, else the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Codec:
    """Reads a vocabulary file and holds its merges; made once per worker process."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.merges = {}
        for rank, (left, right) in enumerate(model["merges"]):
            self.merges[self.ids[left], self.ids[right]] = (rank, self.ids[left + right])
        self.strings = {i: s for s, i in self.ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings |= {i: s for s, i in self.special.items()}
        self.letters = byte_letters()
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(pattern)
        self.young: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}

    @staticmethod
    def normal(text: str) -> str:
        """NFC and lower case, each letter by itself: a final sigma gets no form of its own."""
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def merged(self, piece: str) -> list[int]:
        letters = [self.letters[b] for b in piece.encode("utf-8", "surrogatepass")]
        letters[-1] += self.end
        symbol = [self.ids[x] for x in letters]
        n, merges = len(symbol), self.merges
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = []

        def offer(i: int, j: int) -> None:
            found = merges.get((symbol[i], symbol[j]))
            if found:
                heapq.heappush(queue, (found[0], i, symbol[i], symbol[j]))

        for i in range(n - 1):
            offer(i, i + 1)
        while queue:
            _, i, left, right = heapq.heappop(queue)
            j = after[i] if symbol[i] == left else -1
            if j < 0 or symbol[j] != right:
                continue
            symbol[i], symbol[j] = merges[left, right][1], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return [s for s in symbol if s >= 0]

    def piece(self, piece: str) -> tuple[list[int], str]:
        known = self.old.get(piece)
        if known is None:
            ids = self.merged(piece)
            known = (ids, self.decode(ids))
        if len(self.young) >= GENERATION:
            self.old, self.young = self.young, {}
        self.young[piece] = known
        return known

    def encode(self, text: str) -> tuple[list[int], str]:
        """Ids of a text and their decoded string."""
        ids, strings, young = [], [], self.young
        parts = self.split_special.split(text) if self.split_special and "<|" in text else [text]
        for part in parts:
            if part in self.special:
                ids.append(self.special[part])
                strings.append(part)
                continue
            for piece in self.pieces.findall(self.normal(part)):
                known = young.get(piece)
                if known is None:
                    known = self.piece(piece)
                    young = self.young
                ids += known[0]
                strings.append(known[1])
        return ids, " ".join(strings)

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.strings[i] for i in ids])


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode_texts(docs: DataFrame, path: str) -> DataFrame:
    """Per row of ``docs``: doc_id, ids (array of int) and decoded, the text that the ids give back.

    ``path`` is a vocabulary file that every executor has. Null and empty texts have no ids and decode to an
    empty text; whole texts are encoded; characters that
    are younger than the library's Unicode tables may be cut differently by it; repeated rows are encoded each; an empty table gives no rows;
    further columns are ignored. A worker remembers the pieces it met last, never more than two generations.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for whole in batches:
            for at in range(0, len(whole), ROWS):
                batch = whole.slice(at, ROWS)
                flat, ends, decoded = [], [0], []
                for text in batch.column(1):
                    ids, string = own.encode(text.as_py() or "")
                    flat += ids
                    ends.append(len(flat))
                    decoded.append(string)
                lists = pa.ListArray.from_arrays(np.array(ends, np.int32), np.array(flat, np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")


def decode_texts(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give a null text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            texts = [None if ids.as_py() is None else own.decode(ids.as_py()) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")
