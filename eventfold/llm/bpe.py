"""Operator 1: byte-pair encoding by backtracking, decoding by an offset table.

Encoding. Merges are replaced by a search over whole tokens. An Aho-Corasick
automaton finds every token that occurs in a word; at each position the
longest token is tried first, then the shorter ones that are its prefixes. A
token may follow another only if the pair is compatible: byte-pair merging of
the two strings together leaves the boundary between them alone. A sequence in
which all neighbours are compatible is the one that merging makes, so the
first sequence that reaches the end is exact. A position from which the end
was not reached is never tried again, which makes the search linear.

Decoding. All token strings lie in one byte array; an offset table gives the
bytes of an id, and a whole id sequence is gathered at once.

Rows: null text counts as empty (no token, empty decoded text); any id, also
a null or repeated one, is passed through; one output row per input row.
"""

from __future__ import annotations

import hashlib
import json
import sys
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from eventfold.llm.common import by_bytes, id_text, worker_state

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Marks the end of a word in the token strings held here (the files write ``</w>``).
END = "Ā"
#: Characters that the file's pattern means by white space (fixed by Unicode).
SPACE = r"\t-\r\x20\x85\xa0  -     　"
#: Letters and numbers, and the pre-tokens of the lower-case word vocabulary (fixed by its file).
LETTER, NUMBER = r"\p{L}", r"\p{N}"
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^{SPACE}{LETTER}{NUMBER}]+"
#: Letters and numbers of Unicode 16 that version 15.1 lacks (fixed values); the vocabulary's library has them.
LATE_LETTERS = (
    "\u1c89-\u1c8a\ua7cb-\ua7cd\ua7da-\ua7dc\U000105c0-\U000105f3\U00010d4a-\U00010d65\U00010d6f-\U00010d85"
    "\U00010ec2-\U00010ec4\U00011380-\U00011389\U0001138b\U0001138e\U00011390-\U000113b5\U000113b7\U000113d1\U000113d3"
    "\U00011bc0-\U00011be0\U00013460-\U000143fa\U00016100-\U0001611d\U00016d40-\U00016d6c\U00018cff"
    "\U0001e5d0-\U0001e5ed\U0001e5f0")
LATE_NUMBERS = (
    "\U00010d40-\U00010d49\U000116d0-\U000116e3\U00011bf0-\U00011bf9\U00016130-\U00016139\U00016d70-\U00016d79"
    "\U0001ccf0-\U0001ccf9\U0001e5f1-\U0001e5fa")
#: First and last capital, lower case of the first: letters whose lower case is of Unicode 16 or 17 (fixed values).
LATE_CAPITALS = [
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x0264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3),
    (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x019B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB)]
LATE_LOWER = {a + k: chr(low + k) for a, b, low in LATE_CAPITALS for k in range(b - a + 1)}
LATE_UPPER = regex.compile("[" + "".join(map(chr, LATE_LOWER)) + "]")
#: Marks (and one composed letter) that the library's normaliser, which is of an older
#: Unicode, takes as characters that neither move nor compose (fixed values).
UNMOVED = regex.compile(
    "([\u07fd\u0898-\u089f\u08ca-\u08d3\u09fe\u0c3c\u0d3b-\u0d3c\u0eba\u1715\u1abf-\u1ace\u1df6-\u1dfa\ua82c"
    "\U00010d24-\U00010d27\U00010eab-\U00010eac\U00010efd-\U00010eff\U00010f46-\U00010f50\U00010f82-\U00010f85"
    "\U00011070\U0001133b\U0001145e\U00011839-\U0001183a\U00011930\U00011938\U0001193d-\U0001193e\U00011943\U000119e0"
    "\U00011a34\U00011a47\U00011a99\U00011d42\U00011d44-\U00011d45\U00011d97\U00011f41-\U00011f42"
    "\U00016ff0-\U00016ff1\U0001e08f\U0001e130-\U0001e136\U0001e2ae\U0001e2ec-\U0001e2ef\U0001e4ec-\U0001e4ef])")
#: Words a worker remembers; the memory is emptied when it is full.
REMEMBERED = 700_000


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def is_latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def composed(text: str) -> str:
    """Canonical composition as the vocabulary's library makes it: what stands
    between characters that it leaves where they are is composed by itself."""
    if unicodedata.is_normalized("NFC", text):
        return text
    return "".join(part if k % 2 else unicodedata.normalize("NFC", part) for k, part in enumerate(UNMOVED.split(text)))


def as_of_python(pattern: str, later: str = "") -> str:
    """The pattern with the letters and numbers of Python's own Unicode version
    (15.1) and those in ``later``, a class's inside.

    ``regex`` knows later versions, in which some code points have become
    letters that the vocabulary's library still splits off.
    """
    new = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) == "Cn")
    if later:
        new = regex.sub(f"[{later}]", "", new)
    late = sorted(map(ord, regex.findall(r"[\p{L}\p{N}]", new)))
    runs = [[late[0], late[0]]] if late else []
    for c in late[1:]:
        if c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    gone = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)
    if not gone:
        return pattern
    inside = rf"[{LETTER}{NUMBER}--[{gone}]]"
    return (pattern.replace(rf"[^{SPACE}{LETTER}{NUMBER}]", rf"(?:(?!{inside})[^{SPACE}])")
            .replace(rf"[{LETTER}]", rf"[{LETTER}--[{gone}]]").replace(rf"[{NUMBER}]", rf"[{NUMBER}--[{gone}]]"))


class Splitter:
    """findall of a pre-token pattern; the exact one is made when a text needs it."""

    def __init__(self, pattern: str, later: str = ""):
        self.pattern, self.later, self.latin, self.any = pattern, later, regex.compile(pattern).findall, None

    def __call__(self, text: str) -> list[str]:
        if is_latin(text):
            return self.latin(text)
        if self.any is None:
            self.any = regex.compile(as_of_python(self.pattern, self.later), regex.V1).findall
        return self.any(text)


class Tables:
    """What encoding and decoding look up; built from a vocabulary file once."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model, alphabet = spec["model"], byte_alphabet()
        suffix = model.get("end_of_word_suffix") or ""

        def own(token: str) -> str:
            end = bool(suffix) and token.endswith(suffix) and len(token) > len(suffix)
            body = token[: -len(suffix)] if end else token
            return "".join(chr(alphabet[c]) for c in body) + (END if end else "")

        self.end = END if suffix else ""
        self.strings = {own(token): i for token, i in model["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.rank, self.parts, self.merge = {}, {}, {}
        for rank, (left, right) in enumerate(tuple(m.split(" ")) if isinstance(m, str) else m for m in model["merges"]):
            a, b = own(left), own(right)
            pair, whole = (self.strings[a], self.strings[b]), self.strings[a + b]
            self.merge.setdefault(pair, rank)
            self.rank.setdefault(whole, rank)
            self.parts.setdefault(whole, pair)
        shown = {**{i: token for token, i in model["vocab"].items()}, **{i: s for s, i in self.special.items()}}
        # decode(): no decoder is set in the file, so token strings are joined by blanks
        pieces = [(shown.get(i, "") + " ").encode() for i in range(max(shown) + 1)]
        self.offsets = np.concatenate(([0], np.cumsum([len(p) for p in pieces]))).astype(np.int64)
        self.blob = np.frombuffer(b"".join(pieces), dtype=np.uint8)


class Encoder:
    """Encodes words and texts with the tables; ``shorter`` and the automaton
    hold only tokens that their own string encodes to."""

    def __init__(self, tables: Tables):
        self.t = tables
        self.known: dict[tuple[int, int], bool] = {}
        self.length = {i: len(s) for s, i in tables.strings.items()}
        sound: set[int] = set()
        for s, i in sorted(tables.strings.items(), key=lambda x: tables.rank.get(x[1], -1)):
            if i not in tables.parts:
                if len(s.rstrip(END)) == 1:
                    sound.add(i)
                continue
            a, b = tables.parts[i]
            if a in sound and b in sound and self.compatible(a, b, tables.rank[i]):
                sound.add(i)
        self.automaton = ahocorasick.Automaton()
        self.shorter: dict[int, int] = {}
        for s, i in tables.strings.items():
            if i in sound:
                self.automaton.add_word(s, i)
                for end in range(len(s) - 1, 0, -1):
                    if (j := tables.strings.get(s[:end])) in sound:
                        self.shorter[i] = j
                        break
        self.automaton.make_automaton()
        self.words: dict[str, bytes] = {}
        special = "|".join(regex.escape(s) for s in sorted(tables.special, key=len, reverse=True))
        self.special = regex.compile(f"({special})") if special else None
        self.split = Splitter(WORDS, LATE_LETTERS + LATE_NUMBERS)

    def compatible(self, x: int, y: int, before: float = float("inf")) -> bool:
        """Whether merging the strings of x and y together keeps the boundary.

        Undo the merges next to the boundary, latest first. While two parts
        are neighbours, no merge of the two may come before the merge that
        ends their being neighbours; of equal merges the left one comes first.
        """
        rank, merge, parts = self.t.rank, self.t.merge, self.t.parts
        left_first = False
        while True:
            r = merge.get((x, y))
            if r is not None and (r < before or left_first and r == before):
                return False
            rx, ry = rank.get(x, -1), rank.get(y, -1)
            if rx < 0 and ry < 0:
                return True
            if rx > ry:
                before, x, left_first = rx, parts[x][1], False
            else:
                before, y, left_first = ry, parts[y][0], True

    def word(self, word: str) -> list[int]:
        """Ids of one word, given as one character a byte, END included."""
        n, length, shorter, known = len(word), self.length, self.shorter, self.known
        longest = [-1] * n
        reach = [0] * n
        for end, i in self.automaton.iter(word):
            if (size := length[i]) > reach[start := end + 1 - size]:
                reach[start], longest[start] = size, i
        out: list[int] = []
        open_ = bytearray(b"\x01") * (n + 1)
        pos, token = 0, longest[0]
        while True:
            last = out[-1] if out else -1
            while token >= 0:
                end = pos + length[token]
                if open_[end]:
                    if last < 0:
                        break
                    ok = known.get((last, token))
                    if ok is None:
                        ok = known[last, token] = self.compatible(last, token)
                    if ok:
                        break
                token = shorter.get(token, -1)
            if token >= 0:
                out.append(token)
                pos = end
                if pos == n:
                    return out
                token = longest[pos]
            else:
                open_[pos] = 0
                token = out.pop()
                pos -= length[token]

    def pretoken(self, text: str) -> bytes:
        ids = self.word(text.encode().decode("latin-1") + self.t.end)
        found = np.array(ids, dtype="<u4").tobytes()
        if len(self.words) >= REMEMBERED:
            self.words.clear()
        if len(self.known) >= 4 * REMEMBERED:
            self.known.clear()
        if len(text) <= 64:
            self.words[text] = found
        return found

    def plain(self, text: str) -> bytes:
        if not is_latin(text):
            text = composed(text).replace("Σ", "σ")  # lower case by single characters: no final sigma
            if LATE_UPPER.search(text):
                text = text.translate(LATE_LOWER)
        words = self.split(text.lower())
        found = list(map(self.words.get, words))
        if None in found:
            found = [self.words.get(w) or self.pretoken(w) for w in words]
        return b"".join(found)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text; special strings in it become their tokens."""
        if self.special is None or not any(s in text for s in self.t.special):
            return np.frombuffer(self.plain(text), dtype="<u4")
        special = self.t.special
        return np.frombuffer(b"".join(np.array([special[p]], dtype="<u4").tobytes() if k % 2 else self.plain(p)
                                      for k, p in enumerate(self.special.split(text))), dtype="<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the decoded text of an id sequence."""
        out = []
        for k in range(0, len(ids), 1 << 18):
            part = ids[k:k + (1 << 18)].astype(np.int64)
            start = self.t.offsets[part]
            size = self.t.offsets[part + 1] - start
            ends = np.cumsum(size)
            out.append(self.t.blob[np.repeat(start - ends + size, size) + np.arange(ends[-1])].tobytes())
        return b"".join(out)[:-1] if out else b""


def read_text(path: str) -> str:
    """A vocabulary file, read by the driver; its size is that of a vocabulary."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_documents(docs: DataFrame, vocabulary: str, ids: bool = False, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256.

    With ``ids`` also the ids themselves and the decoded text. The vocabulary
    (a few MB whatever the data) is broadcast; the rows are not moved.
    """
    spark = docs.sparkSession
    source = spark.sparkContext.broadcast(read_text(vocabulary))
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()),
              T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if ids:
        fields += [T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("decoded", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = worker_state(("bpe", vocabulary), lambda: Encoder(Tables(source.value)))
        for batch in by_bytes(batches):
            n, a, b, seqs, texts = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                found = coder.encode(text or "")
                decoded = coder.decode(found)
                n.append(len(found))
                a.append(hashlib.sha256(found.tobytes()).hexdigest())
                b.append(hashlib.sha256(decoded).hexdigest())
                if ids:
                    seqs.append(found.astype(np.int64))
                    texts.append(decoded.decode())
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            if ids:
                cols += [pa.array(seqs, pa.list_(pa.int64())), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, [f.name for f in fields])

    return id_text(docs, id_col, text_col).mapInArrow(run, T.StructType(fields))
