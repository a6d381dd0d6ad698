"""Word-piece counts by a linear longest-match automaton.

The vocabulary is a trie over the bytes of its pieces and one symbol for a word's end. Where no child fits, the
failure link of a node leads to where matching goes on, and the pieces that are certain by then (popped) are
known beforehand; only their number is kept. Each symbol of a word is read once, no piece is ever built, and
the words of a batch are read in step, symbol by symbol.

The end of a word that no final piece takes along counts nothing.

Defined cases: null text counts as empty and has no words; a text of white space likewise; words of any length
are read whole; repeated rows each get a row; a vocabulary without some single symbol is refused.
"""

from __future__ import annotations

import functools
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .merges import Table
from .shared import documents, pieces_of
from .words import distinct, split

BATCH_BYTES = 6_000_000
END = 256


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def normal(text: str) -> str:
    """As the vocabulary's normaliser: composed characters, each in lower case by itself."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


class Automaton:
    """Trie with failure links; ``popped`` has the number of pieces that a failure settles."""

    def __init__(self, pieces: list[tuple[int, ...]]):
        children: list[dict[int, int]] = [{}]
        final = [False]
        for piece in [*pieces, (END,)]:
            at = 0
            for c in piece:
                if c not in children[at]:
                    children[at][c] = len(children)
                    children.append({})
                    final.append(False)
                at = children[at][c]
            final[at] = True
        if any(not final[children[0].get(c, 0)] for c in range(END)):
            raise ValueError("every byte has to be a piece")
        fail, popped, level = [-1] * len(children), [0] * len(children), [0]
        while level:
            for u in level:
                for c, v in children[u].items():
                    if final[v]:
                        fail[v], popped[v] = 0, int((u, c) != (0, END))
                        continue
                    at, n = fail[u], popped[u]
                    while at >= 0 and c not in children[at]:
                        at, n = fail[at], n + popped[at]
                    fail[v], popped[v] = (children[at][c] if at >= 0 else -1), n
            level = [v for u in level for v in children[u].values()]
        edges = [(u * 512 + c, v) for u, own in enumerate(children) for c, v in own.items()]
        self.table, self.target = Table(np.array([k for k, _ in edges])), np.array([v for _, v in edges], np.int64)
        self.fail, self.popped = np.array(fail, np.int64), np.array(popped, np.int64)

    def counts(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Pieces of each word (a run of bytes, then the end)."""
        out, order = np.zeros(len(starts), np.int64), np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        at, n = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        alive = len(starts)
        for i in range(int(sizes[0]) + 1 if len(sizes) else 0):
            while alive and sizes[alive - 1] < i:
                alive = int(np.searchsorted(-sizes[:alive], -i, side="right"))
            symbol = np.where(sizes[:alive] > i, data[np.minimum(starts[:alive] + i, max(len(data) - 1, 0))].astype(np.int64) if len(data) else 0, END)
            todo = np.arange(alive)
            while len(todo):
                here = at[todo]
                edge = self.table.find((here * 512 + symbol[todo]).astype(np.uint32))
                hit = edge >= 0
                at[todo[hit]] = self.target[edge[hit]]
                todo, here = todo[~hit], here[~hit]
                n[todo] += self.popped[here]
                at[todo] = self.fail[here]
        while (on := np.flatnonzero(at > 0)).size:
            n[on] += self.popped[at[on]]
            at[on] = self.fail[at[on]]
        out[order] = n
        return out


@functools.cache
def automaton(path: str) -> Automaton:
    """Of a vocabulary file whose pieces end in </w> where they end a word."""
    letters = byte_letters()
    with open(path, encoding="utf-8") as f:
        names = json.load(f)["model"]["vocab"]
    pieces = []
    for name in names:
        body, last = (name[:-4], (END,)) if name.endswith("</w>") and len(name) > 4 else (name, ())
        if all(c in letters for c in body):
            pieces.append((*(letters[c] for c in body), *last))
    return Automaton(pieces)


def token_counts(df: DataFrame, path: str) -> DataFrame:
    """doc_id, n_words and n_tokens of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "text", BATCH_BYTES):
            words = split(list(map(normal, batch.column("text").to_pylist())), keep_spaces=False)
            codes, model = distinct(words)
            counts = automaton(path).counts(words.data, words.starts[model], words.sizes[model])
            total = np.concatenate([[0], np.cumsum(counts[codes])])
            ends = np.cumsum(words.counts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words.counts), pa.array(total[ends] - total[ends - words.counts])], ["doc_id", "n_words", "n_tokens"])

    return documents(df).mapInArrow(run, "doc_id long, n_words long, n_tokens long")
