import random
import re
from collections import Counter

from pyspark.sql import functions as F

from lamella.llm import rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def corpus():
    rng = random.Random(9)
    texts = [None, "", " \n\t", "a", "a b c", "a b c a b c", "x " * 30_000, "é|#\u0085 z\x1f a\x0bb\x0cc", "line\nline\n\nline \nother", "A" * 100_000]
    bits = ["a", "b", "the", "É", "|", "#%", "\n", "\n\n", " \t", " "]
    return texts + ["".join(rng.choice(bits) + rng.choice([" ", " ", "\n"]) for _ in range(rng.randint(1, 120))) for _ in range(400)]


def test_measurements_match_brute_force(spark):
    texts = corpus()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("n_words", F.lit("clash")).repartition(4)
    got = {r.doc_id: r for r in rules.ledger(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(t), t
        n, rep = r.n_words, r.n_repeat_words
        assert bool(r.fail_bits & 1) == (n < 50) and bool(r.fail_bits & 2) == (100 * rep > 50 * n)
    assert rules.ledger(docs.where("false")).count() == 0
    named = spark.createDataFrame([("x-1", "a b"), (None, None)], "doc_id string, text string")
    assert {(r.doc_id, r.n_words) for r in rules.ledger(named).collect()} == {("x-1", 2), (None, 0)}


def test_policies_and_ablations_read_the_ledger(spark):
    bits = [0, 1, 1, 2, 3, 4, 5, 128, 0]
    led = spark.createDataFrame([(i, b) for i, b in enumerate(bits)], "doc_id long, fail_bits long")
    assert led.where(rules.rejected(rules.BASE)).count() == sum(b & 3 > 0 for b in bits)
    assert led.where(rules.rejected(rules.STANDARD)).count() == sum(b > 0 for b in bits)
    got = {r.rule: r for r in rules.ablations(led, rules.STANDARD).collect()}
    for r in rules.RULES:
        m = 1 << r.bit
        assert (got[r.name].n_failed, got[r.name].n_failed_alone, got[r.name].n_kept_without) == (sum(b & m > 0 for b in bits), sum(b == m for b in bits), sum(b & ~m == 0 for b in bits))
    assert rules.ablations(led.where("false"), rules.BASE).count() == 0
