"""Operators for training data against brute force, on small fixtures with nulls, empty and long texts, ties, repeats and clashing columns."""

from __future__ import annotations

import hashlib
import html
import re
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import anchored, bpe, fingerprint, html_text, langid, mtree, near_dedup, packing, pii, queries, substring_dedup, suffix_dedup
from tidemark.operators.components import components

ODD = [(9001, None), (9002, ""), (9003, "a" * 3000), (9004, "la la " * 400), (9005, "one two"), (9005, "one two"), (None, "Of the <|endoftext|> I'LL say ΣΑΣ ½²\x1cé́ ok"), (9006, "é" * 300 + " tail"), (9007, "\n\n  \t")]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    """Real documents and odd ones, with columns named like the operators' own."""
    real = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame(ODD, "doc_id long, text string")
    return real.unionByName(odd).withColumn("part", F.lit("x")).withColumn("node", F.lit(1)).withColumn("n_removed", F.lit(None).cast("string")).withColumn("marks", F.array(F.lit(1))).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]


def same(got, want):
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_bpe_equals_the_library(docs, rows):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(queries.tokenizer_path())
    want = []
    for i, t in rows:
        ids = lib.encode(t, add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    same([tuple(r) for r in bpe.encoded_digests(docs, queries.tokenizer_path()).collect()], want)


def test_every_token_encodes_to_itself():
    table = bpe.load(queries.tokenizer_path())
    for text, token in list(table.vocab.items())[:: 97]:
        left = table.parts[token]
        assert left is None or table.may_follow(*left) is False and table.encode_piece(text) == (token,)


def test_packing_is_whole_and_full(docs, rows):
    table = bpe.load(queries.tokenizer_path())
    pieces = packing.pack(docs, queries.tokenizer_path(), block=64, step=8).collect()
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_sequence[p["sequence_id"]].append(p)
        by_doc[p["doc_id"]].append(p)
    for members in by_sequence.values():
        at = 0
        for p in sorted(members, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048 and at & (at - 1) == 0 and at == members[0]["sequence_length"]
    unique = {i: t for i, t in rows if i != 9005}
    for i, t in unique.items():
        ids = table.encode(t) + (1).to_bytes(4, "little")
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids) // 4 and p["ids_crc32"] == zlib.crc32(ids[4 * at : 4 * (at + p["length"])])
            at += p["length"]
        assert at == len(ids) // 4
    assert sum(p["length"] for p in by_doc[9005]) == 2 * by_doc[9005][0]["doc_tokens"]


def brute_strings(rows, window=200):
    seen = defaultdict(int)
    data = [(i, t.encode()) for i, t in rows]
    for _, b in data:
        for k in range(len(b) - window + 1):
            seen[hash(b[k : k + window])] += 1
    for i, b in data:
        cover = bytearray(len(b))
        for k in range(len(b) - window + 1):
            if seen[hash(b[k : k + window])] > 1:
                cover[k : k + window] = b"\1" * window
        runs = sum(1 for k in range(len(b)) if cover[k] and (k == 0 or not cover[k - 1]))
        yield i, len(b), sum(cover), runs, hashlib.sha256(bytes(c for c, m in zip(b, cover) if not m)).hexdigest()


def test_suffix_dedup_equals_brute_force(docs, rows):
    same([tuple(r) for r in suffix_dedup.deduplicate(docs).collect()], list(brute_strings(rows)))


def test_crowded_anchors_give_the_same_rows(spark, docs, rows, monkeypatch):
    """With a limit of one segment all anchors that differ are counted over all machines."""
    want = {f: sorted(map(tuple, f(docs).collect()), key=repr) for f in (suffix_dedup.deduplicate, substring_dedup.deduplicate)}
    monkeypatch.setattr(anchored, "CROWD", 1)
    for f, expected in want.items():
        assert sorted(map(tuple, f(docs).collect()), key=repr) == expected


def test_suffix_order():
    rng = np.random.default_rng(1)
    for _ in range(30):
        data = rng.integers(97, 99, rng.integers(1, 200)).astype(np.uint8).tobytes() + b"\xff"
        assert suffix_dedup.suffix_order(np.frombuffer(data, np.uint8), 208).tolist() == sorted(range(len(data)), key=lambda i: data[i:])


def test_substring_dedup_equals_brute_force(docs, rows):
    low: dict = {}
    order = [((-1 if i is None else i), i, t.encode().split()) for i, t in rows]
    for n, _, w in order:
        for k in range(len(w) - 12):
            low[tuple(w[k : k + 13])] = min(n, low.get(tuple(w[k : k + 13]), n))
    want = []
    for n, i, w in order:
        cut = [False] * len(w)
        for k in range(len(w) - 12):
            if low[tuple(w[k : k + 13])] < n:
                cut[k : k + 13] = [True] * 13
        want.append((i, len(w), sum(cut), hashlib.sha256(b" ".join(x for x, c in zip(w, cut) if not c)).hexdigest()))
    same([tuple(r) for r in substring_dedup.deduplicate(docs).collect()], want)


def brute_classes(spark, docs, rows):
    """Classes by comparing every pair of texts that share a shingle."""
    weights = near_dedup.Weights(*near_dedup.document_frequencies(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))))
    texts = sorted({t for _, t in rows})
    none = (np.zeros(0, np.uint64), np.zeros(0))
    vectors = [weights.of([b" ".join(t.encode().split()) + b" "])[:2] if t.encode().split() else none for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    having = defaultdict(list)
    for k, (s, _) in enumerate(vectors):
        for x in s.tolist():
            having[x].append(k)
    for a, b in {(a, b) for ks in having.values() for a in ks for b in ks if a < b}:
        if near_dedup.similarity(vectors[a], vectors[b]) >= near_dedup.SIMILAR:
            parent[root(a)] = root(b)
    members = defaultdict(list)
    for i, t in rows:
        members[root(texts.index(t))].append(i)
    return {(i, min((m for m in ms if m is not None), default=None)) for ms in members.values() for i in ms}


def test_near_duplicate_classes_equal_brute_force(spark, docs, rows):
    base = max((t for _, t in rows), key=lambda t: len(t.split())).split()
    more = [(7000 + k, " ".join(base[: 60 + k % 4] + [f"w{k}"] + base[61:200])) for k in range(60)]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    got = near_dedup.classes(both)
    assert {(r["doc_id"], r["class_id"]) for r in got.collect()} == brute_classes(spark, both, rows + more)


def test_copies_that_are_only_like_their_original_are_one_class(spark):
    """A star: copies are 0.84 like the original and 0.70 like each other, and hundreds of them crowd its buckets."""
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(400)]
    rows = [(500, " ".join(base))]
    for k in range(400):
        words = list(base)
        for at in rng.choice(57, 7, replace=False) * 7:
            words[at] = base[rng.integers(400)]
        rows.append((1000 + k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_classes(spark, docs, rows)
    assert sum(c == 500 for _, c in want) > 390
    assert {(r["doc_id"], r["class_id"]) for r in near_dedup.classes(docs).collect()} == want


def test_crowded_buckets_are_compared_whole(spark, monkeypatch):
    """Small blocks, some of one class and some mixed, give every agreeing pair of different classes, and no other."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rng = np.random.default_rng(6)
    signs = rng.integers(0, 2, (90, 42)).astype(np.uint8)
    classed = {k: k // 30 * 30 for k in range(60)}
    at = lambda k: [1] * (k < 70) + [2] * (k >= 20) + [3] * (k < 30)
    crowded = spark.createDataFrame([(k, b) for k in range(90) for b in at(k)], "node long, bucket long")
    signed = spark.createDataFrame([(k, s.tobytes()) for k, s in enumerate(signs)], "node long, signature binary")
    found = spark.createDataFrame(list(classed.items()), "node long, component long")
    alike = (signs[:, None] == signs[None]).sum(axis=2)
    want = [(a, b, int(alike[a, b])) for a in range(90) for b in range(a) if classed.get(a, a) != classed.get(b, b) and set(at(a)) & set(at(b)) and alike[a, b] >= near_dedup.LEAST_AGREEMENT * 42]
    same([tuple(r) for r in near_dedup.across(crowded, signed, found).collect()], want)


def test_unlike_members_of_crowded_buckets_make_no_row_for_each_pair(spark, monkeypatch):
    """Texts about 0.7 like each other crowd buckets: only the two rounds of candidates from small buckets and centres are given as rows of pairs, blocks give links alone."""
    rng = np.random.default_rng(7)
    base = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(120):
        words = list(base)
        for at in rng.choice(60, 5, replace=False) * 5:
            words[at] = f"x{rng.integers(10**9)}"
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    given, plain = [], near_dedup.verified
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    monkeypatch.setattr(near_dedup, "verified", lambda pairs, *rest: given.append(pairs.count()) or plain(pairs, *rest))
    assert {(r["doc_id"], r["class_id"]) for r in near_dedup.classes(docs).collect()} == brute_classes(spark, docs, rows)
    assert len(given) == 2, given


def test_samples_agree_as_often_as_texts_are_alike():
    rng = np.random.default_rng(2)
    s = np.sort(rng.integers(0, 2**63, 300).astype(np.uint64))
    w = rng.random(300) + 0.5
    a, b = (s[:250], w[:250]), (s[50:], w[50:] * np.where(rng.random(250) < 0.5, 1.0, 1.5))
    got = near_dedup.samples(np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]]), np.array([0, 250]), 3000)
    assert abs((got[:, 0] == got[:, 1]).mean() - near_dedup.similarity(a, b)) < 0.04


def luhn(d):
    return sum(x - 9 if x > 9 else x for x in (int(c) * (1 + k % 2) for k, c in enumerate(reversed(d)))) % 10 == 0


def brute_pii(t):
    out = []
    for k, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if not (k == "ip" and any(int(x) > 255 for x in m[0].split(".")) or k == "card" and not (13 <= len(d) <= 19 and luhn(d)) or k == "phone" and not 9 <= len(d) <= 15):
                out.append((k, m.start(), m.end()))
    return out


PARTS = ["a@b.com", "_x@y.co", "%", " ", "1.2.3.4", ".5", "..", "@", "-", "4111111111111111", "4111 1111-1111 1111", "+1 (269) 555-3296", " 4524132264652876", "é", "", "0255.1.1.1", "256.1.1.1", "x at y dot com", "+", "12", "+441234567890"]


@pytest.fixture(scope="module")
def private(spark):
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(PARTS, rng.integers(0, 12))) for _ in range(1500)]
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(-1, None), (-2, "1 " * 20000 + "+1" + "(" * 20000)], "doc_id long, text string")


def test_base_spans_equal_regular_expressions(private):
    found = pii.spans(private, pii.train(private))
    texts = {r["doc_id"]: r["text"] or "" for r in private.collect()}
    for r in pii.digest(found).collect():
        base = brute_pii(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in base) for k in pii.KINDS]
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r["spans"].split(","))
    by_id = {r["doc_id"]: r for r in pii.digest(found).collect()}
    for r in pii.redact(found, "<{}>").collect():
        out, at, text = "", 0, texts[r["doc_id"]]
        for start, kind, end in sorted(((int(a), k, int(b)) for k, a, b in (x.split(":") for x in by_id[r["doc_id"]]["spans"].split(",") if x)), key=lambda x: (x[0], x[2], pii.KINDS.index(x[1]))):
            if start >= at:
                out += text[at:start] + f"<{kind}>"
            at = max(at, end)
        assert r["text"] == out + text[at:]


HIDDEN = {
    "email": ["{w}.{w} at mail dot {w} dot org", "{w} [at] {w} [dot] com", "{w}(at){w}(dot)net", "{w} @ {w} . com"],
    "ip": ["10[.]{b}[.]7[.]{b}", "172 . {b} . {b} . 9", "8(dot)8(dot){b}(dot)8"],
    "card": ["4111.1111.1111.1111", "5500/0000/0000/0004", "4012  8888  8888  1881"],
    "phone": ["44 7700 900{c}", "0044 7700 900{c}", "269.555.3{c}"],
}
DECOYS = ["in 2024 and 2023", "version 1.2", "chapter 12.3.4", "look at home", "pages 100-120", "1999-2001", "id 12345", "40 000 people", "at 10.30 we met at noon dot", "x = 3.14159", "1234.1234.1234.1234", "5 . 6 . 700 . 8"]


def test_disguised_personal_data_is_found(spark):
    """Recall and precision of added spans on documents with planted forms that base patterns miss, among decoys."""
    rng = np.random.default_rng(11)
    words = "the of and house river stone green walk they with from under table light".split()
    some = lambda n: " ".join(rng.choice(words, n))
    open_ = ["anna.{w}@mail.{w}.org", "{w}@{w}.net", "{w}{b}@{w}.com", "10.0.{b}.7", "4111 1111 1111 1111", "+44 7700 900{c}", "+1 (269) 555-3{c}"]
    filled = lambda t: re.sub("{(.)}", lambda m: {"w": str(rng.choice(words)), "b": str(rng.integers(1, 255)), "c": str(rng.integers(100, 999))}[m[1]], t)
    rows, planted = [], {}
    for k in range(1500):
        text = f"{some(6)} {filled(str(rng.choice(open_)))} {some(5)} {rng.choice(DECOYS)} {some(4)}"
        rows.append((k, text))
    for k in range(2000, 2200):
        kind = str(rng.choice(pii.KINDS))
        head, hit = some(7) + " ", filled(str(rng.choice(HIDDEN[kind])))
        rows.append((k, head + hit + " " + some(5)))
        planted[k] = (kind, len(head), len(head) + len(hit))
    rows += [(3000 + k, f"{some(5)} {rng.choice(DECOYS)} {some(5)}") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("base", F.lit(1)).withColumn("wide", F.lit("x"))
    model = pii.train(docs.where("doc_id < 2000"))
    found = pii.digest(pii.spans(docs, model)).collect()
    extra = {r["doc_id"]: [tuple(x.split(":")) for x in r["spans"].split(",") if x] for r in found if r["doc_id"] >= 2000}
    touched = sum(any(k == p[0] and int(a) < p[2] and p[1] < int(b) for k, a, b in extra[i]) for i, p in planted.items())
    right = sum(k == planted[i][0] and int(a) < planted[i][2] and planted[i][1] < int(b) for i in planted for k, a, b in extra[i])
    every = sum(map(len, extra.values()))
    missed = [(p[0], rows[1500 + i - 2000][1][p[1] : p[2]]) for i, p in planted.items() if not any(k == p[0] and int(a) < p[2] and p[1] < int(b) for k, a, b in extra[i])]
    assert touched >= 0.9 * len(planted) and right >= 0.9 * every, (touched / len(planted), right / every, missed)
    # repeated rows repeat, ids may be missing
    twice = spark.createDataFrame([(None, "mail a@b.com"), (5, "mail a@b.com"), (5, "mail a@b.com")], "doc_id long, text string")
    assert [r["spans"] for r in pii.digest(pii.spans(twice, model)).collect()] == ["email:5:12"] * 3


def test_scores_and_choice_of_candidates_equal_plain_python(private):
    model = pii.train(private)
    model.thresholds = [model.start - 1] * 4  # lets many in
    rows = pii.with_candidates(pii.with_base(private)).select("doc_id", "base", F.col("candidates").alias("c")).withColumn("score", F.transform("c", model.score)).collect()
    extra = {r["doc_id"]: {x for x in r["spans"].split(",") if x} for r in pii.digest(pii.spans(private, model)).collect()}
    added = 0
    for r in rows:
        taken = {(pii.KINDS[b["kind"]], b["start"], b["end"]) for b in r["base"]}
        free = [c for c, score in zip(r["c"], r["score"]) if score >= model.start - 1 and not any(b["start"] < c["end"] and c["start"] < b["end"] for b in r["base"])]
        assert all(abs(model.raw(c.asDict()) - score) < 1e-9 for c, score in zip(r["c"], r["score"]))
        at = 0
        for c in sorted(free, key=lambda c: (c["start"], -c["end"], c["kind"])):
            if c["start"] >= at:
                at = c["end"]
                taken.add((pii.KINDS[c["kind"]], c["start"], c["end"]))
                added += 1
        assert extra[r["doc_id"]] == {f"{k}:{a}:{b}" for k, a, b in taken}
    assert added > 20


def test_many_spans_in_one_text(spark):
    """Thousands of spans cross the borders of the blocks and pieces that arrays and texts are built from."""
    text = "é a@b.com 10.0.0.1 x@y.org, " * 3000
    found = pii.spans(spark.createDataFrame([(1, text)], "doc_id long, text string"), pii.Model())
    r = pii.digest(found).first()
    assert (r["n_email"], r["n_ip"], r["n_spans"]) == (6000, 3000, 9000)
    assert pii.redact(found).first()["text"] == "é [email] [ip] [email], " * 3000


def test_pii_plan_has_no_python(private):
    plan = pii.digest(pii.spans(private, pii.Model()))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_pii_finds_nothing_in_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pii.digest(pii.spans(none, pii.train(none))).count() == 0


def test_fingerprints(docs, rows):
    got = fingerprint.fingerprint(docs.where("doc_id is not null and doc_id <> 9005")).collect()
    texts = sorted((i, t) for i, t in rows if i not in (None, 9005))
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(texts)
    for k, (i, t) in enumerate(texts):
        after = texts[(k + 1) % len(texts)][1]
        new = fingerprint.edited(t, after)
        a, b, c = (set(fingerprint.unit_digests(x).tolist()) for x in (t, new, after))
        r = by[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert r["near_edited"] == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0) and r["near_next"] == pytest.approx(len(a & c) / len(a | c) if a | c else 1.0)
    prints = defaultdict(set)
    for i, t in texts:
        prints[t].add(by[i]["fingerprint"])
    assert all(len(p) == 1 for p in prints.values())
    assert fingerprint.fingerprint(docs.where("doc_id = 9002")).first()["near_next"] == 1.0
    assert fingerprint.fingerprint(docs).count() == len(rows)


def test_language_is_found_on_held_out_documents(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.train(d)
    got = langid.identify(d, model).join(d.select("doc_id", "lang"), "doc_id").where(langid.held_out(F.col("doc_id"))).collect()
    assert len(got) > 20 and sum(r["lang_pred"] == r["lang"] for r in got) / len(got) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)
    odd = {r["doc_id"]: r["lang_pred"] for r in langid.identify(spark.createDataFrame([(1, None), (2, "123 !!"), (3, "")], "doc_id long, text string"), model).collect()}
    assert set(odd.values()) == {"und"}
    assert langid.train(d.limit(0)) == {}


def brute_code_length(learned: list[str], text: str) -> float:
    """Bits of a text by prediction by partial matching with exclusion, byte for byte."""
    counts = defaultdict(lambda: defaultdict(int))
    for t in learned:
        data = bytes(langid.ORDER) + t.encode()
        for at in range(langid.ORDER, len(data)):
            for back in range(langid.ORDER + 1):
                counts[data[at - back : at]][data[at]] += 1
    data, bits = bytes(langid.ORDER) + text.encode(), 0.0
    for at in range(langid.ORDER, len(data)):
        named: set = set()
        for back in range(langid.ORDER, -1, -1):
            context = data[at - back : at]
            follow = {s: n for s, n in counts[context].items() if s not in named} if context in counts else {}
            total = sum(follow.values()) + len(follow)
            if data[at] in follow:
                bits += np.log2(total / follow[data[at]])
                break
            if follow:
                bits += np.log2(total / len(follow))
                named |= set(follow)
        else:
            bits += np.log2(256 - len(named))
    return bits


def test_code_lengths_are_those_of_the_counts(spark, monkeypatch):
    """Also where documents are cut into pieces and the table of remembered grams overflows."""
    learned = {"x": ["banana bandana", "ananas", "banana bandana!"], "y": ["der Band ändert", "Ende"]}
    rows = []
    for lang, ts in learned.items():
        for t in ts:
            at = next(i for i in range(1000 * len(rows), 1000 * len(rows) + 99) if zlib.crc32(str(i).encode()) % 4 != 2)
            rows.append((at, t, lang))
    out = next(i for i in range(50000, 50099) if zlib.crc32(str(i).encode()) % 4 == 2)
    rows += [(out, "held out zzz", "x"), (7, None, "x"), (8, "no language", None), rows[0], (None, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert list(model) == ["x", "y"]
    texts = ["banana", "ändern", "a", "zz bandana Ende", "ban\x00an", "é" * 40 + "anan" * 30]
    monkeypatch.setattr(langid, "CHUNK", 16)
    units, sizes = langid.Scorer(model, remembered=8).texts(texts)
    for k, t in enumerate(texts):
        assert sizes[k] == len(t.encode())
        for j, lang in enumerate(model):
            assert units[k, j] / langid.UNIT == pytest.approx(brute_code_length(learned[lang], t), abs=1e-3)
    # repeated rows repeat, ties go to the first language, columns named like the operator's own play no part
    clash = spark.createDataFrame([(1, "Σ", "y", 2.0), (1, "Σ", "y", 3.0), (None, "banana " * 3000, None, 1.0), (3, "½ ² ①", "x", 0.0), (4, None, "x", 0.0)], "doc_id long, text string, lang_pred string, score double")
    got = langid.identify(clash, model).collect()
    likely = min(model, key=lambda lang: brute_code_length(learned[lang], "Σ"))
    assert sorted((r["doc_id"] or 0, r["lang_pred"]) for r in got) == [(0, "x"), (1, likely), (1, likely), (3, "und"), (4, "und")]
    assert langid.Scorer({"b": model["x"], "a": model["x"]}).score(["banana"])[0] == ["b"]
    assert langid.identify(clash.limit(0), model).count() == 0


def test_the_sample_is_bounded(spark):
    """Also where one id, or one row, is repeated."""
    docs = spark.createDataFrame([(3, f"text {k % 40}", "x") for k in range(300)] + [(k, "same", "y") for k in range(300)], "doc_id long, text string, lang string")
    got = langid.sampled(docs, 10).groupBy("lang").count().collect()
    assert {r["lang"] for r in got} <= {"x", "y"} and all(r["count"] <= 10 for r in got)
    assert langid.sampled(docs, 1000).where("lang = 'x'").count() == 40


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    table = [(k, rng.normal(size=8).tolist()) for k in range(400)] + [(400 + k, [1.0] * 8) for k in range(30)]
    table += [(500, None), (600, [1.0, None] + [0.0] * 6), (700, [float("nan")] * 8), (800, [float("inf")] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = mtree.top_k(df, F.col("vec_id") % 100 == 0, shard=70, block=2)
    fine = [(i, np.floor(np.array(v) * 1024).astype(int)) for i, v in table[:430]]
    want = []
    for i, q in fine:
        if i % 100 == 0:
            best = sorted((-int(q @ v), j) for j, v in fine if j != i)[:10]
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    same([tuple(r) for r in got.collect()], want)
    assert mtree.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    # rows that repeat, large components, and vectors of another length beside them
    big = [(k, (rng.normal(size=8) * 1e4).tolist()) for k in range(300)]
    big += [big[7], big[7], *[(1000 + k, rng.normal(size=3).tolist()) for k in range(0, 200, 4)]]
    fine = [(i, np.floor(np.array(v) * 1024).astype(np.int64)) for i, v in big]
    want = []
    for i, q in {i: q for i, q in fine if i % 100 == 0}.items():
        best = sorted((-int(q @ v), j) for j, v in fine if j != i and len(v) == len(q))[:10]
        want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    got = mtree.top_k(spark.createDataFrame(big, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0, shard=40, block=2, pivots=5)
    same([tuple(r) for r in got.collect()], want)


def test_bounds_avoid_computations_where_vectors_stand_in_clusters(spark):
    """Distances computed against those of a scan, for one tree and for all searches; where vectors have no structure, bounds save little."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 16)) * 2
    vectors = centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 16)) * 0.05
    tree = mtree.Tree(np.arange(4000), np.floor(vectors * 1024).astype(np.int64))
    for k in range(0, 4000, 400):
        tree.search(tree.vectors[k], 10, k)
    assert tree.computed < 0.25 * 10 * 4000
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    found = mtree.search_all(df, F.col("vec_id") % 100 == 0, 10, "vec_id", "embedding", 1024, 200, 16, 64)
    assert found.agg(F.sum("computed")).first()[0] < 0.25 * 40 * 4000


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><p>Site</p></header><nav><ul><li><a href="/x">Menu</a></ul></nav><div class="cookie-notice">We use</div>
<main><article><header><h1>Title &amp; more</h1></header><p>One <b>bo</b>ld<br>line<p>Two   words<script>var a="</p>";</script><aside>side</aside><form>f<input></form><section class="comments"><p>c1</p></section></article></main>
<div id="sidebar">s</div><div class="ad">Buy</div><footer>f</footer>"""


def test_page_text(spark, sf_dir):
    assert html_text.main_text(PAGE) == "Title & more One bold line Two words"
    assert html_text.main_text(None) == html_text.main_text("") == "" and html_text.main_text("<p>plain <i>x</i> &lt; text") == "plain x < text"
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in html_text.extract(pages).collect():
        inside = re.search(r"<article>(.*?)</article>", source[r["page_id"]], re.DOTALL)[1]
        parts = re.split(r"</?(?:p|h1|br)[^>]*>", re.sub(r"</?b>", "", inside))
        assert r["text"] == " ".join(" ".join(html.unescape(p).split()) for p in parts if p.strip()) and r["n_chars"] == len(r["text"])
    odd = spark.createDataFrame([(1, None, None, 1), (2, "x", "<p>a", 2)], "page_id long, url string, html string, host int")
    assert {r["page_id"]: r["text"] for r in html_text.extract(odd).collect()} == {1: "", 2: "a"}


def test_articles_beside_the_text_and_fixed_lines_in_articles(spark):
    """Comments that are article elements do not hide a body without one, and what most of a host's pages share goes, also within an article."""
    body = [(k, "http://a.org/x", f"<div><p>Body {k}</p></div><article class='comment'><p>Reader {k}</p></article>") for k in range(5)]
    shared = [(100 + k, "http://b.org/x", f"<article><p>Story {k}</p><div>{'Read our terms' if k % 5 < 3 else f'Own line {k}'}</div></article>") for k in range(40)]
    docs = spark.createDataFrame(body + shared, "page_id long, url string, html string")
    want = {k: f"Body {k}" for k in range(5)} | {100 + k: f"Story {k}" + ("" if k % 5 < 3 else f" Own line {k}") for k in range(40)}
    assert {r["page_id"]: r["text"] for r in html_text.extract(docs).collect()} == want


def nameless(k: int, host: str) -> tuple[str, str]:
    """A page whose marks say nothing of what is what, and its text."""
    story = [f"{host} story {k} part {j} " + "word " * (5 + (k + j) % 7) for j in range(2 + k % 3)]
    links = "".join(f"<li><a href=/{j}>{host} {k % 5} link {j}</a>" for j in range(3 + k % 4))
    notice = "<div class=qb>Site closes on Friday</div>" if k % 7 == 0 else ""
    page = f"<body><div class=qa>Welcome to {host}</div>{notice}<ul>{links}</ul><div class=qc><h1>Title {k}</h1><div class=qd>{''.join(f'<p>{p}' for p in story)}</div></div><div class=qe>Seen {k * 37 % 11} times</div>"
    return page, " ".join([f"Title {k}", *[" ".join(p.split()) for p in story]])


@pytest.mark.parametrize("limit", [html_text.BROADCAST, 0])
def test_pages_without_any_mark_go_by_their_wrapper(spark, monkeypatch, limit):
    """Also where wrappers are merged in many steps and where plans are joined instead of broadcast; other columns and repeated rows change nothing."""
    monkeypatch.setattr(html_text, "BROADCAST", limit)
    monkeypatch.setattr(html_text, "HELD", 20)
    monkeypatch.setattr(html_text, "FAN", 2)
    rows, want = [], []
    for host in ("a.org", "b.org"):
        for k in range(60):
            page, text = nameless(k, host)
            rows.append((k, f"https://{host}/x", page))
            want.append((k, f"https://{host}/x", text))
    rows.append(rows[0])
    want.append(want[0])
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("content", F.lit("x")).withColumn("n", F.lit(None).cast("int")).repartition(9)
    same([tuple(r)[:3] for r in html_text.extract(pages).collect()], want)


def test_wrappers_match_all_pages_they_come_from():
    """The wrapper is a union-free regular expression; in which order pages are aligned, and whether in parts, it matches all of them."""
    rng = np.random.default_rng(7)

    def some(depth: int = 0) -> str:
        out = ""
        for kind in rng.choice(list("abcp#"), rng.integers(0, 5)):
            out += "text<br>" if kind == "#" else f"<div class={kind}>{some(depth + 1) if depth < 3 else 't'}</div>"
        return out

    for _ in range(300):
        pages = [some() for _ in range(rng.integers(1, 6))]
        whole = html_text.infer(pages)
        parts = html_text.merged(html_text.infer(pages[::2]), html_text.infer(pages[1::2] or pages))
        assert html_text.loaded(html_text.dumped(whole)) == whole
        for wrapper in (whole, parts):
            assert "|" not in html_text.regex(wrapper)
            for page in pages:
                assert re.fullmatch(html_text.regex(wrapper), html_text.stream(html_text.parse(page)[0]))


def test_mismatches_become_repeated_and_optional_groups():
    pages = ["<ul><li>a<li>b</ul><p>x</p>", "<ul><li>c</ul><h2>only here</h2><p>x</p><p>y</p>", "<dl><dt>k<dd>v<dt>k<dd>v</dl><p>z</p>"]
    assert html_text.regex(html_text.infer(pages)).replace("(?:", "(") == "(<>(<ul>(<li>(#)</>)+</>)?(<dl>((<dt>(#)</>)(<dd>(#)</>))+</>)?(<h2>(#)</>)?(<p>(#)</>)+</>)"


def test_odd_pages(spark):
    """Empty tables, very long and deep pages, and pages that are no HTML."""
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_text.extract(none).count() == 0
    long = "<p>" + "word " * 200000
    rows = [(1, "u", long), (2, "u", "<div>" * 300 + "deep"), (3, "u", "< > </ & &amp; <!-- x"), (4, None, "\0<b>b"), (None, None, None)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, none.schema)).collect()}
    assert got[1] == long[3:].strip() and got[2] == "deep" and got[None] == "" and got[4] == "\0b"


def test_pipeline_stages(spark, sf_dir):
    """Every stage against what it should do to its own input, by plain Python."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").unionByName(spark.createDataFrame([(8001, "12 34", "en", "s", 5), (8002, None, None, "s", 0)], "doc_id long, text string, lang string, source string, n_chars long"))
    kept = corpus_pipeline.language(spark, docs, sf_dir).cache()
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {r["doc_id"] for r in kept.collect()} == {i for i, t in before.items() if t and re.search(r"[^\W\d_]", t)}
    one = corpus_pipeline.near_duplicates(spark, kept, sf_dir).cache()
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert {r["doc_id"] for r in one.collect()} == {c for _, c in brute_classes(spark, kept, rows)}
    cut = corpus_pipeline.repeated_strings(spark, one, sf_dir).cache()
    want = {i: (n, gone) for i, n, gone, *_ in brute_strings([(r["doc_id"], r["text"]) for r in one.collect()])}
    for r in cut.collect():
        n, gone = want[r["doc_id"]]
        assert n - gone <= len(r["text"].encode()) <= n - gone + 8 * (gone > 0) * (1 + gone // 200)
    clean = corpus_pipeline.personal_data(spark, cut, sf_dir).cache()
    was = {r["doc_id"]: r["text"] for r in cut.collect()}
    for r in clean.collect():
        assert not brute_pii(r["text"]) and (r["text"] == was[r["doc_id"]] or "[" in r["text"]) and r["n_chars"] == len(r["text"])
    assert clean.columns == docs.columns
    packed = corpus_pipeline.pack(spark, clean, sf_dir)
    assert packed.select("doc_id").distinct().count() == clean.count()
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, sf_dir)
    assert none.count() == 0


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    tokenizer = queries.tokenizer_path()
    operators = (suffix_dedup.deduplicate, substring_dedup.deduplicate, fingerprint.fingerprint, near_dedup.classes, lambda d: packing.pack(d, tokenizer), lambda d: bpe.encoded_digests(d, tokenizer))
    for f in operators:
        assert f(none).count() == 0
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
