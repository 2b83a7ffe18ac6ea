"""Cross-tokenizer alignment against sets of ends and all pairs, with the two libraries."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

DOCS = "doc_id long, text string, slice long, figures string"
A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], DOCS).repartition(4)


def brute(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    from eventfold.llm.bpe import byte_alphabet
    a, alphabet = Tokenizer.from_file(public_tokenizers.path(A)), byte_alphabet()
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(B))
    found = []
    for _, text in rows:
        if not text:
            found.append(None)
            continue
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bx = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in x]
        by = [bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        if b"".join(bx) != (" " + text).encode() or b"".join(by) != (" " + text).encode():
            found.append(None)
            continue
        ends = [list(np.cumsum([len(t) for t in z])) for z in (bx, by)]
        both = sorted(set(ends[0]) & set(ends[1]))
        groups, i, j = [], 0, 0
        for e in both:
            p, q = ends[0].index(e) + 1, ends[1].index(e) + 1
            groups.append((x[i:p], y[j:q]))
            i, j = p, q
        found.append((len(x), len(y), groups, [(s, t) for g in groups for s in g[0] for t in g[1]]))
    count = collections.Counter(p for f in found if f for p in set(f[3]))
    top = collections.Counter()
    for (s, _), n in count.items():
        top[s] = max(top[s], n)
    out = []
    for (doc, _), f in zip(rows, found, strict=True):
        if f is None:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, pairs = f
        digest = hashlib.sha256(";".join(",".join(map(str, s)) + "|" + ",".join(map(str, t)) for s, t in groups).encode()).hexdigest()
        out.append((doc, n_a, n_b, len(groups), len(pairs), sum(count[p] == top[p[0]] for p in pairs), sum(count[p] for p in pairs), digest))
    return out


def texts():
    r = random.Random(12)
    odd = ["<|endoftext|> </s> <unk>", "naïve café 漢字 😀😀 тест", "  two  blanks ", "tab\tand\nline", "▁marked", "a" * 4000, "=" * 333 + "-" * 90,
           "１２３ ﬁne Å", "x y", "The quick brown fox.", "\x00\x01", "é", " ", " ", "\n"]
    rows = [(i, t) for i, t in enumerate(odd)] + [(None, None), (None, "again"), (7, ""), (7, "again"), (7, "again")]
    words = ["the", "ention", "Straße", "quel", "été", "running", "tokenizers", "12345", "!!", "可以", "…", "don't"]
    rows += [(100 + i, " ".join(r.choice(words) + "".join(r.choice("abcé ") for _ in range(r.randint(0, 5))) for _ in range(r.randint(1, 60)))) for i in range(150)]
    return rows


def rows_of(spark, rows):
    from eventfold.llm import alignment
    df = alignment.align(frame(spark, rows), public_tokenizers.path(A), public_tokenizers.path(B))[0]
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize(("size", "small"), [(4 << 20, 64), (700, 1)])
def test_query_against_brute_force(spark, monkeypatch, size, small):
    from eventfold.llm import alignment
    monkeypatch.setattr(alignment, "SLICE", size)
    monkeypatch.setattr(alignment, "SMALL", small)
    rows = texts()
    want = sorted(brute(rows), key=str)
    assert rows_of(spark, rows) == want
    assert sum(w[1] > 0 for w in want) > 150 and any(w[4] > w[3] for w in want)


def test_a_task_of_many_slices_is_written_and_joined_in_bounded_parts(spark, monkeypatch):
    """A reader takes all rows of a file at once: a file holds four slices at
    most, however many its task makes, and texts are aligned a chunk at a time."""
    from eventfold.llm import alignment
    from pyspark.sql import functions as F
    monkeypatch.setattr(alignment, "SLICE", 700)
    rows = texts()
    docs = frame(spark, rows).coalesce(1)
    a, b = public_tokenizers.path(A), public_tokenizers.path(B)
    parts = alignment.slices(docs, a, b, 32000, "doc_id", "text")
    most = max(r["count"] for r in parts.groupBy(F.input_file_name()).count().collect())
    assert parts.count() > 20 and most <= 4
    monkeypatch.setattr(alignment, "SLICE", 4000)
    monkeypatch.setattr(alignment, "CHUNK", 300)
    assert sorted(map(tuple, alignment.align(docs, a, b)[0].collect()), key=str) == sorted(brute(rows), key=str)


def test_packed_places_and_times():
    from eventfold.llm import alignment
    r = np.random.default_rng(3)
    for most in (1, 255, 256, 65535, 65536, 1 << 31, 1 << 40):
        for n in (0, 1, 7, 500):
            x = r.integers(0, most + 1, n)
            x[:1] = most
            assert alignment.widen(alignment.narrow(x), n).tolist() == x.tolist() == alignment.unstep(alignment.steps(x), n).tolist()
    assert len(alignment.steps(np.arange(200))) == 200 and len(alignment.narrow(np.array([1, 65536]))) == 8


def test_settings_of_a_staged_write_end_with_it(spark):
    from eventfold.llm.common import staged
    key = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(key, None)
    assert staged(spark.range(10).coalesce(1), "settings", {key: "7"}, 4).count() == 10
    assert spark.conf.get(key, None) == before


def test_cuts_against_sets():
    from eventfold.llm import alignment
    r = random.Random(5)
    for _ in range(3000):
        n = r.randint(1, 60)
        p = r.choice([0.1, 0.5, 0.9, 0.98])
        a, b = (sorted({n, *[x for x in range(1, n) if r.random() < p]}) for _ in range(2))
        cut_a, cut_b = alignment.cuts(np.array(a, "<i4"), np.array(b, "<i4"))
        both = sorted(set(a) & set(b))
        assert [a[i - 1] for i in cut_a] == both == [b[j - 1] for j in cut_b]


def test_run_length_jumps():
    from eventfold.llm import alignment
    x = np.arange(5000, dtype="<i4").tobytes()
    for at in (0, 1, 2, 3, 1000, 4999, 5000):
        y = np.arange(5000, dtype="<i4")
        y[at:] += 1
        assert alignment.run_length(x, y.tobytes(), 0, 0, 5000) == at


def test_empty_table(spark):
    assert rows_of(spark, []) == []


def test_ranks_give_the_files_ids():
    """Every code point between, beside and after letters, numbers and blanks; long pre-tokens; blanks."""
    from eventfold.llm import alignment
    from eventfold.llm.bpe import read_text
    a = alignment.ByteLevel(read_text(public_tokenizers.path(A)))
    assert a.ranks
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for s in range(0, len(points), 4096):
        texts = ["".join(f" ab{chr(c)}cd 1{chr(c)}2{chr(c)} {chr(c)}{chr(c)}'s\n" for c in points[s + k:s + k + 64]) for k in range(0, 4096, 64)]
        assert a.ids(texts) == [e.ids for e in a.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    for long in ("a" * 60000, " " * 60000, "^" * 60000, "é" * 60000, "1 " * 30000, "\n" * 50000 + "x"):
        assert a.ids([long]) == [a.tokenizer.encode(long, add_special_tokens=False).ids]
