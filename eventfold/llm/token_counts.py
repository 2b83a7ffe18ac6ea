"""Operator 4: token counts with a whole-token shortcut.

Before any text is read, each vocabulary string is merged alone; those that
become their own single token are proven whole. A pre-token of a text that is
a proven string counts one token by a table lookup, without a merge; only the
rest is merged (a worker remembers counts of short pre-tokens).

Merging takes the pair of lowest rank first, the left one of equals; a linked
list and a heap keep it at n log n, so a pre-token of any length is fine.

Rows: null text counts as empty (0 bytes, 0 tokens); any id, also a null or
repeated one, is passed through; one output row per input row.
"""

from __future__ import annotations

import heapq
import json
import sys
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from eventfold.llm.bpe import LETTER, NUMBER, SPACE, Splitter, byte_alphabet, read_text
from eventfold.llm.common import by_bytes, id_text, worker_state

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: The pre-tokens of the byte-level vocabulary (fixed by its file).
PIECES = (rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{SPACE}{LETTER}{NUMBER}]+"
          rf"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Pre-tokens a worker remembers beside the proven ones.
REMEMBERED = 1_000_000


class Merges:
    def __init__(self, text: str):
        spec = json.loads(text)
        model, alphabet = spec["model"], byte_alphabet()
        own = lambda token: bytes(alphabet[c] for c in token)
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.vocabulary = [own(token) for token in model["vocab"]]
        self.rank: dict[tuple[bytes, bytes], int] = {}
        for i, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.rank.setdefault((own(a), own(b)), i)

    def merged(self, data: bytes) -> list[bytes]:
        """The tokens of one pre-token."""
        parts = [data[i:i + 1] for i in range(len(data))]
        return self._short(parts) if len(parts) <= 40 else self._long(parts)

    def _short(self, parts: list[bytes]) -> list[bytes]:
        get, none = self.rank.get, len(self.rank)
        while len(parts) > 1:
            ranks = [get(p, none) for p in zip(parts, parts[1:], strict=False)]
            low = min(ranks)
            if low == none:
                break
            i = ranks.index(low)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _long(self, parts: list[bytes | None]) -> list[bytes]:
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := self.rank.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, size = heapq.heappop(heap)
            j = after[i]
            if parts[i] is None or j >= n or len(parts[i]) + len(parts[j]) != size or self.rank.get((parts[i], parts[j])) != r:
                continue
            parts[i], parts[j] = parts[i] + parts[j], None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := self.rank.get((parts[i], parts[k]))) is not None:
                    heapq.heappush(heap, (r, i, len(parts[i]) + len(parts[k])))
            if (h := before[i]) >= 0 and (r := self.rank.get((parts[h], parts[i]))) is not None:
                heapq.heappush(heap, (r, h, len(parts[h]) + len(parts[i])))
        return [p for p in parts if p is not None]

    def proven(self) -> list[str]:
        """Vocabulary strings that encode alone as one token."""
        out = []
        for data in self.vocabulary:
            try:
                text = data.decode()
            except UnicodeDecodeError:
                continue  # a pre-token is whole characters
            if len(self.merged(data)) == 1:
                out.append(text)
        return out


class Counts(dict):
    """Token counts by pre-token; a missing one is merged."""

    def __init__(self, merges: Merges, whole: list[str]):
        super().__init__(dict.fromkeys(whole, 1))
        self.merges, self.whole = merges, whole

    def __missing__(self, piece: str) -> int:
        n = len(self.merges.merged(piece.encode()))
        if len(self) >= REMEMBERED:
            self.clear()
            self.update(dict.fromkeys(self.whole, 1))
        if len(piece) <= 64:
            self[piece] = n
        return n


class Counter:
    def __init__(self, text: str, whole: list[str]):
        merges = Merges(text)
        self.counts = Counts(merges, whole)
        self.pieces = Splitter(PIECES)
        self.marks = merges.special
        self.special = regex.compile("|".join(map(regex.escape, merges.special))) if merges.special else None

    def count(self, text: str) -> int:
        get = self.counts.__getitem__
        if not any(s in text for s in self.marks):
            return sum(map(get, self.pieces(text)))
        parts = self.special.split(text)
        return len(parts) - 1 + sum(get(p) for part in parts for p in self.pieces(part))


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit.

    The vocabulary and the proven strings (their size is the vocabulary's)
    are broadcast; the rows are not moved.
    """
    spec = read_text(vocabulary)
    source = docs.sparkSession.sparkContext.broadcast((spec, Merges(spec).proven()))
    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_state(("counts", vocabulary), lambda: Counter(*source.value))
        for batch in by_bytes(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = [counter.count(t) for t in texts]
            size = [len(t) if t.isascii() else len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()),
                 pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return id_text(docs, id_col, text_col).mapInArrow(run, schema)
