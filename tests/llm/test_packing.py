import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lamella.llm import packing
from lamella.llm.wordids import WordTokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", " ", "a", "Hello  WORLD\nnew\r\nline\tx", "don't it's I'll", "<|startoftext|> a<|endoftext|>b", "é é ñ   x y ​\u0085z", "ﬁ ½ ①", "123 4,567.8 $$$ !!??",
         "日本 語 ไทย", "́ start", "a ́b", "word " * 9000, "😀 👩‍👩‍👧 x\u0000y", "a\x0bb\x0cc\x1cd"]


def test_words_encode_like_whole_texts():
    tok = Tokenizer.from_file(PATH)
    mine = WordTokenizer(PATH, limit=50, most=4000)
    assert mine.by_word
    rng = random.Random(0)
    more = ["".join(rng.choice("aB é́\n \t'st,.!1ß <|>") for _ in range(60)) for _ in range(500)]
    texts = [t or "" for t in TEXTS] + more + ["<|STARTOFTEXT|> ΑΣ ΣΑΣ İI", "ΑΣ, ΣΑΣ İI ÅÅ"]
    for part in (texts[:100], texts[50:300], texts[:20]):  # words are forgotten and met again
        mine.encode([t.encode() for t in part])
    assert [x.tolist() for x in mine.encode([t.encode() for t in texts])] == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_a_vocabulary_that_keeps_white_space_encodes_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    mine, tok = WordTokenizer(path), Tokenizer.from_file(path)
    assert not mine.by_word
    texts = [t or "" for t in TEXTS]
    assert [x.tolist() for x in mine.encode([t.encode() for t in texts])] == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_many_words_of_every_length_are_told_apart():
    rng = random.Random(5)
    words = ["".join(rng.choice("abé,") for _ in range(rng.randint(1, 40))) for _ in range(60_000)]
    texts = [" ".join(words[i : i + 200]) for i in range(0, len(words), 200)]
    mine, tok = WordTokenizer(PATH), Tokenizer.from_file(PATH)
    for _ in range(2):
        assert [x.tolist() for x in mine.encode([t.encode() for t in texts])] == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


def check_plan(counts, limits):
    seq = defaultdict(list)
    for length, r0, r1, q, s, off in packing.plan(counts, limits).tolist():
        for r in range(r0, r1):
            seq[s + (r - r0) // q].append((off + (r - r0) % q * length, length))
    got = defaultdict(int)
    for placed in seq.values():
        at = 0
        for off, length in sorted(placed):
            assert off == at
            at += length
            got[length] += 1
        t, d, a = limits.vector
        assert at <= t and len(placed) <= d and sum(x * x for _, x in placed) <= a
    assert dict(got) == {k: v for k, v in counts.items() if v}
    return len(seq)


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("limits", [packing.Limits(100), packing.Limits(100, rule="dot"), packing.Limits(100, documents=3), packing.Limits(100, attention=6000, rule="dot")])
def test_plan_places_everything_under_every_limit(seed, limits):
    rng = random.Random(seed)
    top = 70 if limits.attention else 100
    counts = {rng.randint(1, top): rng.randint(1, 500) for _ in range(rng.randint(1, 40))}
    n = check_plan(counts, limits)
    least = -(-sum(k * v for k, v in counts.items()) // 100)
    if not limits.documents and not limits.attention:
        one_by_one = best_fit_decreasing([k for k, v in counts.items() for _ in range(v)], 100)
        assert least <= n <= one_by_one + 1


def best_fit_decreasing(items, capacity):
    bins = []
    for x in sorted(items, reverse=True):
        fit = [i for i, r in enumerate(bins) if r >= x]
        if fit:
            bins[min(fit, key=lambda i: bins[i])] -= x
        else:
            bins.append(capacity - x)
    return len(bins)


def test_pack_documents(spark):
    rng = random.Random(1)
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(100 + i, "w " * rng.randint(0, 5000), None) for i in range(200)] + [(None, "null id", "x"), (7, "again", "x"), (7, "again", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string").repartition(6)
    out = packing.pack(packing.pieces(docs, PATH)).collect()
    tok = Tokenizer.from_file(PATH)
    want = []
    for i, t, _ in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        want += [(i, k, b, len(ids[b : b + 4096]), zlib.crc32(np.array(ids[b : b + 4096], "<u4").tobytes())) for k, b in enumerate(range(0, len(ids), 4096))]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out), key=key) == sorted(want, key=key)
    seq = defaultdict(list)
    for r in out:
        seq[r.sequence_id].append((r.offset, r.length))
    for placed in seq.values():
        at = 0
        for off, length in sorted(placed):
            assert off == at
            at += length
        assert at <= 4096
    assert len(seq) <= -(-sum(w[3] for w in want) // 4096) * 1.02 + 1


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(packing.pieces(docs, PATH)).count() == 0


def test_workers_keep_no_words_after_their_tasks(spark):
    import pyarrow as pa

    docs = spark.createDataFrame([(i, f"alpha beta gamma{i} delta") for i in range(200)], "doc_id long, text string").repartition(4)
    assert packing.pieces(docs, PATH).agg({"length": "sum"}).first()[0] > 800

    def held(batches):
        from lamella.llm import packing as own

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(t._table.n for t in own._TOKENIZERS.values())])], ["n"])

    assert {r.n for r in spark.range(0, 64, 1, 16).mapInArrow(held, "n long").collect()} == {0}
