"""Collocations over a prefix-free parse, against SQL and against counting every phrase of every piece."""

from __future__ import annotations

import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import collocations, queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces_of(text):
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
        if words := [w for w in re.split(r"[\x20\x09]+", piece) if w]:
            yield words


def brute(rows, least, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for w in pieces_of(text):
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    kept = {}
    for (lang, p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        cuts = [(2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
        kept[lang, p] = (*min(cuts), a)
    hidden = {}
    for (lang, p), x in kept.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                key = (lang, p[i : i + k])
                hidden[key] = max(hidden.get(key, 0), x[-1])
    out = []
    for lang in n:
        rank = sorted((-s, -a, " ".join(p).encode(), l, r) for (g, p), (s, _, l, r, a) in kept.items() if g == lang and not 100 * hidden.get((g, p), 0) >= 80 * a)
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(rank[:top])]
    return sorted(out)


@pytest.fixture(scope="module")
def odd_rows():
    rng = np.random.default_rng(5)
    words = ["Of", "the", "É", "l'an", "ſ", "\x00", "ha ha", "x", " ", "THE", "İ"]
    rows = [(["en", "de", None, ""][i % 4], "".join(str(rng.choice(words)) + str(rng.choice([" ", "\t", "  ", ". ", "\n", ", ", ";", "\x0b", "!?"], p=[0.6, 0.1, 0.1, 0.05, 0.05, 0.04, 0.02, 0.02, 0.02])) for _ in range(150))) for i in range(40)]
    return rows + [("en", None), ("en", ""), ("xx", " .\n"), ("en", "la " * 5000), ("de", "a b c d. " * 400), ("de", "a b c d. " * 400), ("und", "one two"), ("q", "y" * 100_000)]


@pytest.mark.parametrize("period", [1, 3, 8, 1000])
def test_equals_counting_every_phrase(spark, odd_rows, period, monkeypatch):
    docs = spark.createDataFrame(odd_rows, "lang string, text string").repartition(3)
    docs = docs.withColumn("phrase", F.lit(1)).withColumn("f", F.lit("x")).withColumn("n", F.lit(None).cast("int"))
    monkeypatch.setattr(collocations, "GATHER", 500)
    got = sorted(tuple(r) for r in collocations.collocations(docs, least=5, top=40, period=period).collect())
    assert got == brute(odd_rows, 5, 40)
    assert len({r[0] for r in got}) >= 4


def test_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    cur = con.execute(queries.oracle_sql()["op11_collocations"])
    names = [d[0] for d in cur.description]
    want = sorted(cur.fetchall())
    assert want and sorted(tuple(r) for r in queries.op11_collocations(spark, sf_dir).select(*names).collect()) == want


def test_no_rows(spark):
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert collocations.collocations(spark.createDataFrame([(None, None), ("en", "just once")], "lang string, text string")).count() == 0


def test_chunks_cover_every_phrase_once():
    """Starts before the shared window belong to a chunk, so that each phrase of a piece has exactly one chunk."""
    text = " ".join(f"w{i % 7}{i % 3}" for i in range(300)) + ". a b c. d"
    row, last, chunks = collocations.parsed(pa.array([text, "", text]), 4)
    found = Counter()
    for end, chunk in zip(last, chunks.to_pylist()):
        w = chunk.split(" ")
        found.update(tuple(w[i : i + k]) for k in range(1, 5) for i in range(len(w) if end else len(w) - 3) if i + k <= len(w))
    assert found == Counter(tuple(w[i : i + k]) for t in (text, text) for w in pieces_of(t) for k in range(1, 5) for i in range(len(w) - k + 1))
    assert len(set(chunks.to_pylist())) < len(chunks) and set(row) == {0, 2}


def test_scores_are_exact_beyond_64_bits(spark):
    a, l, r = 4_611_686_018_427_387_903, 4_611_686_018_427_387_905, 4_611_686_018_427_387_907
    df = spark.createDataFrame([(a, l, r), (30, 30, 31)], "a long, l long, r long")
    assert [x[0] for x in df.select(collocations.score(F.col("a"), F.col("l"), F.col("r"))).collect()] == [2_000_000 * a // (l + r), 2_000_000 * 30 // 61]


def test_ranks_beyond_the_first_of_each_salt(spark):
    """Ties in score and count are ordered by bytes, also where the first rows of several salts meet."""
    rows = [("en", 2, f"{x}{i} b", 50) for i in range(300) for x in ("é", "z", "Z")] + [("en", 1, f"{x}{i}", 60) for i in range(300) for x in ("é", "z", "Z")] + [("en", 1, "b", 60)]
    df = spark.createDataFrame(rows, "lang string, size int, phrase string, f long")
    got = [r["phrase"] for r in collocations.ranked(df, spark.createDataFrame([("en", 9)], "lang string, n long"), top=100).orderBy("rank").collect()]
    assert got == sorted((p for _, s, p, _ in rows if s == 2), key=str.encode)[:100]
