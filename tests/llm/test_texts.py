"""Token ids, leaked passages and subject areas."""

import random
import unicodedata

import numpy as np
import pytest
import regex

from helixframe.llm import leaks, subjects, tokens

ODD = [
    None, "", " ", "\n\n  \t", "a", "  Hello  world  ", "I'm we'll they'd it's", "naïve café ÄÖÜ ß ſ İ ı", "日本語のテキスト", "🙂🙃👩‍👩‍👧", "x" * 3000, "AC" * 2500, "<|endoftext|> end",
    "tab\tline\r\nnext\x0bvt\x1c\x1d fs", "1234567890 ½ ² Ⅷ", "​zero­soft﻿", "á combining", "　ideographic sep", "  trailing   ", "mixed123abc!?...---", " " * 500 + "z",
]


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


def test_ids_equal_library(spark, reference):
    rng = random.Random(1)
    alphabet = "abcdefgh ACGT0123 .,-'\n\tßéλ你🙂"
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 200))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "text", "doc_id as ids", "text as id")
    got = {r["doc_id"]: list(r["ids"]) for r in tokens.encode_column(df, "doc_id", "text").collect()}
    for i, t in enumerate(texts):
        assert got[i] == (reference.encode(t, add_special_tokens=False).ids if t else []), repr(t)


def test_ids_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([(1, "same"), (1, "same"), (None, "same")], "doc_id long, text string")
    got = tokens.encode_column(df, "doc_id", "text").collect()
    assert len(got) == 3 and len({tuple(r["ids"]) for r in got}) == 1
    assert tokens.encode_column(df.limit(0), "doc_id", "text").collect() == []


def test_merge_order():
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 300, b"bc": 299, b"aa": 302}
    assert tokens.merge(b"abc", ranks) == [97, 299]
    assert tokens.merge(b"aaaaa", ranks) == [302, 302, 97]
    assert tokens.merge(b"abab", ranks) == [300, 300]


def words(s):
    s = unicodedata.normalize("NFKC", s or "")
    s = "".join(c for c in s if unicodedata.category(c) != "Cf").lower()
    return regex.findall(r"[\p{L}\p{Nd}]+", s)


def brute(docs, items):
    idx = {}
    for i, s in items:
        w = words(s)
        for k in range(len(w) - 9):
            idx.setdefault(tuple(w[k : k + 10]), set()).add(i)
    out = set()
    for d, s in docs:
        w = words(s)
        for k in range(len(w) - 9):
            out |= {(d, i) for i in idx.get(tuple(w[k : k + 10]), ())}
    return out


def test_leaks(spark):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(30)] + ["Ünïcode", "ﬁne", "x­y", "²", "１２"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.choice([5, 9, 10, 11, 30, 60]))) for i in range(60)] + [(90, None), (91, "")]
    items += [(92, items[40][1]), (93, text(12) + " " + items[41][1])]
    docs = []
    for d in range(200):
        t = text(rng.randrange(0, 60))
        if d % 3 == 0:
            w = items[rng.randrange(60)][1].split()
            k = rng.randrange(0, max(1, len(w) - 9))
            t = t + ", " + "; ".join(w[k : k + rng.choice([9, 10, 15])]).upper() + ". " + t
        docs.append((d, t))
    docs += [(900, None), (901, ""), (902, " ".join(["a"] * 40)), (903, text(20000) + " " + items[50][1])]
    di = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "text as item_id")
    it = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "text as doc_id")
    got = leaks.leaked(di, it).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == brute(docs, items)
    assert all(0 < r["passages"] <= r["item_passages"] for r in got)


def test_leaks_empty(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    i = spark.createDataFrame([], "item_id long, text string")
    assert leaks.leaked(d, i).collect() == []


def test_sentences():
    text = "One two three. Four five (n = 3.5) six!\r\n* Seven eight\n nine\nten\r\n\r\nHeading\n \n5 6\nlast but one? “Quoted to the end.” And more words"
    assert [" ".join(s) for s in subjects.sentences(text)] == ["one two three", "four five n six", "seven eight nine ten", "last but one", "quoted to the end", "and more words"]
    assert subjects.sentences(None) == [] and subjects.sentences("  ") == []


def test_subject_areas(spark):
    rng = random.Random(2)
    terms = {"law": ["contract", "liability", "patent", "licence", "court"], "sport": ["goal", "striker", "league", "referee", "match"], "bio": ["enzyme", "kinase", "helix", "residue", "protein"]}
    filler = ["Nothing else changed in this release.", "See table 4 for all entries.", "It is not clear whether this holds.", "More than 20 groups took part."]

    def sentence(a):
        x, y = rng.sample(terms[a], 2)
        return rng.choice([f"The {x} was compared with the {y} again.", f"Without a {x}, the {y} is lost.", f"We found that the {x} precedes the {y}."])

    docs, truth, labels = [], {}, []
    for d in range(600):
        areas = rng.sample(sorted(terms), rng.choice([1, 1, 2]))
        passing = rng.choice([a for a in terms if a not in areas])
        s = [sentence(a) for a in areas for _ in range(rng.randrange(3, 6))] + [sentence(passing)] + rng.sample(filler, 2)
        rng.shuffle(s)
        docs.append((d, " ".join(s)))
        truth[d] = set(areas)
        if d % 3 == 0:
            labels += [(d, rng.choice([a, a.upper(), f" {a}"])) for a in areas if rng.random() > 0.05]
    docs += [(7000, None), (7001, ""), (7002, " \n"), (7003, " ".join(filler))]
    labels += [(0, "unknown"), (99999, "law"), (3, None)]
    a = spark.createDataFrame([(x, "t", "d") for x in terms], "subject_area string, title string, description string")
    got = {}
    for r in subjects.subjects(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, subject_area string"), a).collect():
        got.setdefault(r["doc_id"], set()).add(r["subject_area"])
    held = [d for d in truth if d % 3]
    tp = sum(len(got.get(d, set()) & truth[d]) for d in held)
    assert tp >= 0.95 * sum(len(truth[d]) for d in held)
    assert tp >= 0.95 * sum(len(got.get(d, set())) for d in held)
    assert not {7000, 7001, 7002, 7003} & set(got)


def test_subjects_without_labels(spark):
    d = spark.createDataFrame([(1, "Some text here. And more.")], "doc_id long, text string")
    a = spark.createDataFrame([("law",)], "subject_area string")
    assert subjects.subjects(d, spark.createDataFrame([], "doc_id long, subject_area string"), a).collect() == []
    assert subjects.subjects(d.limit(0), spark.createDataFrame([(1, "law")], "doc_id long, subject_area string"), a).collect() == []
