import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from attesta.llm import leakage as L


def words(text):
    return re.findall(r"[^\W_]+", text.lower())


def runs(text, n):
    w = words(text or "")
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}


def brute(docs, items, n):
    asked = {i: runs(t, n) for i, t in items}
    return {(d, i) for d, x in docs for own in [runs(x, n)] for i, there in asked.items() if own & there}


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(8)
    pool = ["a", "of", "queue", "ledger", "naïve", "x1", "the", "пакет", "9"]

    def text(k):
        return "".join(w + rnd.choice([" ", ", ", "\n", " - "]) for w in rnd.choices(pool, k=k))

    items = [(i, text(rnd.randint(5, 40))) for i in range(60)] + [(90, None), (91, "")]
    docs = []
    for d in range(200):
        own = text(rnd.randint(0, 60))
        if d % 2:
            w = words(items[rnd.randrange(60)][1])
            k = rnd.randint(1, len(w))
            at = rnd.randrange(len(w) - k + 1)
            own += " " + " ".join(x.upper() if rnd.random() < 0.3 else x for x in w[at : at + k]) + "; " + text(5)
        docs.append((d, own))
    return docs + [(900, None), (901, ""), (902, "z " * 100_000 + items[0][1])], items


@pytest.mark.parametrize("n", [6, 12])
def test_shared_runs_equal_brute_force(spark, corpus, n):
    docs, items = corpus
    got = L.shared_runs(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit("clash")), n)
    assert {tuple(r) for r in got.collect()} == brute(docs, items, n)


def test_blocks_of_a_long_text_change_nothing(spark, corpus, monkeypatch):
    docs, items = corpus
    known = [(i, L.words_only([t])[1:-1]) for i, t in items if t]
    every = L.stretches(ALL, ALL, 25, 0, 16)
    batch = pa.RecordBatch.from_arrays([pa.array([d for d, t in docs if t], pa.int64()), pa.array([t for _, t in docs if t])], ["doc_id", "text"])

    def pairs(block):
        monkeypatch.setattr(L, "BLOCK", block)
        out = set()
        for found in every([batch]):
            for d, text in zip(found.column(0).to_pylist(), found.column(2).to_pylist()):
                a = np.frombuffer(text.encode("utf-32-le"), np.uint32)
                out |= {(d, i) for i, b in known if len(a) < 9000 and L.verified(a, b, 25, 0, 16, 12)}
        return out

    want = {(d, i) for d, i in brute(docs, items, 12) if d != 902}
    assert pairs(40) == pairs(1 << 20) == want


ALL = b"\xff" * (1 << 21)


def distance(a, b):
    """Fewest edits that turn a into some stretch of b."""
    row = [0] * (len(b) + 1)
    for i, c in enumerate(a, 1):
        now = [i]
        for j, d in enumerate(b, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (c != d)))
        row = now
    return min(row)


def brute_regions(doc, item, length, budget):
    good = [i for i in range(len(doc) - length + 1) if distance(doc[i : i + length], item) <= budget]
    longest = run = 0
    for i in good:
        run = run + 1 if i - 1 in good else 1
        longest = max(longest, run)
    return (length + longest - 1, min(distance(doc[i : i + length], item) for i in good)) if good else None


def edited(rnd, text, n):
    chars = list(text)
    for _ in range(n):
        at = rnd.randrange(len(chars))
        chars[at : at + rnd.randint(0, 1)] = rnd.choice(["", "z", "q"])
    return "".join(chars)


@pytest.mark.parametrize("seed", range(6))
def test_regions_with_tails_equal_brute_force(spark, seed):
    """Regions of 40 characters and 2 edits, beside further text of the item with more edits."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("abcdeé", k=rnd.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(25))) for i in range(4)]
    items.append((9, items[0][1][:60] + items[1][1][:60]))
    docs = []
    for d in range(24):
        text = items[rnd.randrange(4)][1]
        at = rnd.randrange(0, 50)
        core = edited(rnd, text[at : at + 40], rnd.randint(0, 3))
        tail = "".join(c if k % 12 else rnd.choice("xyz") for k, c in enumerate(text[at + 40 : at + 40 + rnd.choice([0, 20, 40])]))
        docs.append((d, f"{word()} {word()} {core}{tail} {word()}"))
    found = L.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 40, 2, 8)
    got = {(r.doc_id, r.item_id): (r.chars, r.edits) for r in found.collect()}
    plain = lambda t: " " + " ".join(words(t)) + " "
    want = {(d, i): best for d, x in docs for i, t in items if (best := brute_regions(plain(x), plain(t), 40, 2))}
    assert got == want


def test_items_that_share_a_phrase_and_repeated_words(spark):
    phrase = "which of the following statements about the system is right "
    items = [(i, phrase + " ".join(f"w{i}x{k}" for k in range(30))) for i in range(300)] + [(1000, "z " * 5000)]
    docs = [(1, phrase * 50), (2, items[7][1]), (3, "z " * 20_000)]
    got = {tuple(r) for r in L.shared_runs(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == brute(docs, items, 12)


def test_edited_passages_are_found(spark):
    rnd = random.Random(3)
    item = " ".join("".join(rnd.choices("abcdefghij", k=rnd.randint(2, 8))) for _ in range(30))
    broken = list(item)
    for at in (20, 75, 130):
        broken[at] = "z"
    del broken[50]
    docs = [(1, "start here " + "".join(broken) + " and on"), (2, item[:60] + " something else entirely"), (3, item)]
    got = {r.doc_id: r.edits for r in L.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string"), 100, 6, 8).collect()}
    assert set(got) == {1, 3} and got[3] == 0 and 0 < got[1] <= 6


@pytest.mark.parametrize(("a", "b", "want"), [("kitten", "sitting", 2), ("abc", "xxabcxx", 0), ("abc", "axbc", 1), ("abcd", "abd", 1)])
def test_banded_alignment(a, b, want):
    x, y = (np.frombuffer(t.encode(), np.uint8).astype(np.uint32) for t in (a, b))
    assert L.banded_alignment(x, y, np.array([0]), len(x), -6, 6).tolist() == [want]


@pytest.mark.parametrize("texts", [["A  b,c", "Ωmega 𝔘x", "", "é\x01ß"]])
def test_words_only(texts):
    text = "".join(map(chr, L.words_only(texts)))
    assert text == "\x01 a b c \x01 ωmega 𝔘x \x01 \x01 é ß \x01"


def test_some_of_each_window_is_chosen():
    rnd = random.Random(1)
    for n, width, least, need in ((50, 10, 10, 1), (50, 12, 7, 1), (9, 12, 7, 3), (6, 12, 7, 1), (50, 12, 7, 7), (50, 12, 7, 4)):
        frequency = np.array([rnd.randint(1, 4) for _ in range(n)])
        chosen = set(L.rarest(frequency, width, least, need).tolist())
        for begin in range(max(1, n - width + 1)):
            window = range(begin, min(n, begin + width))
            assert len(window) < least or sum(1 for p in window if p not in chosen) <= least - need


def test_no_items(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert L.shared_runs(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_each_run_of_words_has_a_chosen_place():
    rnd = random.Random(2)
    for _ in range(50):
        codes = L.words_only([" ".join("ab"[: rnd.randint(1, 2)] * rnd.randint(1, 4) for _ in range(rnd.randint(3, 30)))])[1:-1]
        frequency = np.array([rnd.randint(1, 5) for _ in range(max(0, len(codes) - 7))])
        spaces = np.flatnonzero(codes == 32)
        chosen = L.rarest_of_runs(frequency, codes, 5, 8)
        for i in range(len(spaces) - 5):
            part = frequency[spaces[i] : spaces[i + 5] - 6]
            assert any(spaces[i] <= p <= spaces[i + 5] - 7 and frequency[p] == part.min() for p in chosen)
