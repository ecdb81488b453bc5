"""Personal data in text: candidate spans, gradient-boosted trees over their features, calibrated thresholds.

Everything on the data's path is a DataFrame expression. Fixed base patterns give spans that always count. Wider
generators propose more spans, also overlapping ones, of forms that base patterns miss: spelled-out and spaced addresses, numbers without a plus or with other separators. There are no labels for
these, so the base matches themselves, rewritten in such forms within their own contexts, are what to find, and candidates that touch no base match
are what to leave alone. Boosted trees over format and context score the candidates; a kind's threshold is calibrated on all
documents, each scored by trees that learnt on the other folds, over candidates that can be added, with hidden forms weighed by how rare they are; those over it are added where they touch no base span.
Candidates that go on in letters, digits or a longer number are none. Features are a few small integers, so
training needs one grouped count over all documents, whose groups are bounded by the product of the features' sizes.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents_of, written

#: The kinds in the order in which their spans are listed.
KINDS = ("email", "ip", "card", "phone")
#: A character that stands for a joining separator while a pattern runs, and what it becomes where a text already has it.
_JOIN, _OTHER = "\ue000", "\ue001"
_LOCAL, _HOST = "A-Za-z0-9._%+-", "A-Za-z0-9-"

#: Base patterns. Each is written so that no match and no failure takes more than linear time or a deep stack: runs are possessive, start only
#: where a run starts (or the last match ended), and inner separators are one character class by _JOIN.
BASE = {
    "email": rf"(?:(?<![{_JOIN}{_LOCAL}])|\G)[{_JOIN}{_LOCAL}]++@[{_HOST}]++{_JOIN}[{_JOIN}{_HOST}]++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": rf"[0-9][{_JOIN}0-9]++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators of further candidates, in which every repeat is bounded or possessive.
_DOT = r"(?:\.| \. | ?\[\.\] ?| ?[\[(]dot[\])] ?| dot )"
WIDER = {
    "email": rf"(?<![{_LOCAL}])[{_LOCAL}]++(?:@| @ | ?[\[(]at[\])] ?| at )[{_HOST}]++(?:{_DOT}[{_HOST}]++){{1,4}}",
    "ip": rf"(?<![0-9])[0-9]{{1,3}}{_DOT}[0-9]{{1,3}}{_DOT}[0-9]{{1,3}}{_DOT}[0-9]{{1,3}}(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ ./_-]{1,2}[0-9]{4}){2}[ ./_-]{1,2}[0-9]{1,7}|[0-9]{4}[ ./_-]{1,2}[0-9]{6}[ ./_-]{1,2}[0-9]{5})(?![0-9])",
    "phone": r"(?<![0-9])(?:\+|00)?(?:[0-9]{1,3}[ ./-]{1,2})?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ ./-]{0,2}[0-9]{3,4}[ ./-]{0,2}[0-9]{3,4}(?![0-9])",
}
#: What a text must hold for a pattern to be worth running.
BASE_HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": "[0-9][0-9 -]{11}", "phone": r"\+"}
HINTS = {"email": rf"@|[\[(]at[\])]| at [{_HOST}]+(?:\.[{_HOST}]| \. | dot | ?[\[(])", "ip": f"[0-9]{_DOT}[0-9]", "card": "[0-9]{4}[ ./_-]{0,2}[0-9]{4}", "phone": r"[0-9]{2}\)?[ ./-]{0,2}[0-9]{3}"}
#: Words that announce a kind of personal data, by kind.
CUES = {"email": r"e-?mail|mail|contact|correo|courriel", "ip": r"\bip\b|host|server|adresse?|address", "card": r"card|visa|karte|carte|tarjeta|payment", "phone": r"tel|phone|call|fax|mobil|anruf|appel|llam"}
#: What directly before or after a candidate makes it part of something longer, such as a digest, a token or a longer number; and, for numbers, digits that go on after a separator.
BEFORE, AFTER = r"[\p{L}0-9_][-_/]?$|[0-9]\.$", r"^[-_/]?[\p{L}0-9_]|^\.[0-9]"
GOES_ON = (r"[0-9][ ./-]{1,2}$", r"^[ ./-]{1,2}[0-9]")
#: Features of a candidate and how many values each has: kind; a leading plus; what separates its parts (nothing, one mark, several, two or more, brackets, words);
#: digits; groups of digits (of an address: whether it has marks or digits before the separator, and several dots); characters on both sides; length of the word before; the kind which words before it announce.
FEATURES = {"kind": 4, "plus": 2, "between": 6, "digits": 5, "groups": 5, "before": 4, "after": 4, "word": 4, "cue": 5}
#: Characters of context on either side.
CONTEXT = 40
ROUNDS, RATE, DEPTH, PRECISION = 20, 0.3, 3, 0.9
#: Folds of documents; each is scored by trees of the others.
FOLDS = 5
#: Hidden forms that calibration expects for each plain one. Examples are made of every plain match, negatives are what texts hold, so examples count this much.
HIDDEN = 0.05
SPAN = "struct<kind:int,start:int,end:int,hit:string,head:string,tail:string>"
#: Items that an array under construction is extended by in one go.
BLOCK = 256
#: Characters of a piece of text in redact().
PIECE = 4096


def scan(source: Column, start: Column, kind: str, move: Callable, emit: Callable) -> Column:
    """The array of what emit(at, x) gives (null: nothing) as at runs from start through move(at, x) for every x of source. Items gather in blocks, so that adding one does not copy all."""
    none = F.array().cast(f"array<{kind}>")

    def step(acc, x):
        item = emit(acc["at"], x)
        more = F.when(item.isNull(), none).otherwise(F.array(item))
        full = F.size(acc["block"]) >= BLOCK
        done = F.when(full, F.concat(acc["done"], F.array(acc["block"]))).otherwise(acc["done"])
        return F.struct(move(acc["at"], x).alias("at"), F.when(full, more).otherwise(F.concat(acc["block"], more)).alias("block"), done.alias("done"))

    zero = F.struct(start.alias("at"), none.alias("block"), F.array().cast(f"array<array<{kind}>>").alias("done"))
    return F.aggregate(source, zero, step, lambda acc: F.flatten(F.concat(acc["done"], F.array(acc["block"]))))


def located(df: DataFrame, name: str, sources: dict[str, Column], patterns: dict[str, str]) -> DataFrame:
    """df with name_kind for each kind: the array of (kind, start, end, hit, head, tail) of its pattern's matches in its source (null: none), in code points. What lies between matches
    gives their places and context. Each pattern runs over a source twice, in a step of its own, however often its matches are read."""
    gaps, hits = lambda k: f"{name}_gaps_{k}", lambda k: f"{name}_hits_{k}"
    df = df.withColumns({gaps(k): F.split(c, patterns[k], -1) for k, c in sources.items()} | {hits(k): F.regexp_extract_all(c, F.lit(patterns[k]), F.lit(0)) for k, c in sources.items()})

    def spans(kind: str) -> Column:
        zipped = F.arrays_zip(F.col(gaps(kind)).alias("gap"), F.col(hits(kind)).alias("hit"), F.slice(F.col(gaps(kind)), 2, 2**30).alias("next"))
        move = lambda at, x: F.coalesce(at + F.length(x["gap"]) + F.length(x["hit"]), at)

        def emit(at, x):
            begin = at + F.length(x["gap"])
            span = F.struct(
                F.lit(KINDS.index(kind)).alias("kind"), begin.alias("start"), (begin + F.length(x["hit"])).alias("end"), x["hit"].alias("hit"),
                F.right(x["gap"], F.lit(CONTEXT)).alias("head"), F.left(x["next"], F.lit(CONTEXT)).alias("tail"),
            )
            return F.when(x["hit"].isNotNull(), span)

        return F.when(F.size(F.col(hits(kind))) > 0, scan(zipped, F.lit(0), SPAN, move, emit)).otherwise(F.array().cast(f"array<{SPAN}>"))

    return df.withColumns({f"{name}_{k}": spans(k) for k in sources}).drop(*map(gaps, sources), *map(hits, sources))


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the check digit of a string of digits is right."""
    def step(acc, c):
        d = (F.ascii(c) - 48) * F.when(acc["odd"], F.lit(2)).otherwise(F.lit(1))
        return F.struct((acc["sum"] + F.when(d > 9, d - 9).otherwise(d)).alias("sum"), (~acc["odd"]).alias("odd"))

    return F.aggregate(F.split(F.reverse(number), ""), F.struct(F.lit(0).alias("sum"), F.lit(False).alias("odd")), step, lambda acc: acc["sum"] % 10 == 0)


def valid(kind: str, hit: Column) -> Column:
    """The check that a base match must pass: parts of at most 255, a right check digit, a plausible number of digits."""
    if kind == "ip":
        return F.forall(F.split(hit, "[^0-9]+"), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^([0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        number = digits(hit)
        return F.when(F.length(number).between(13, 19), luhn(number)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits(hit)).between(9, 15)
    return F.lit(True)


def passing(kind: str) -> Callable:
    return lambda s: valid(kind, s["hit"])


def joined(text: Column, between: str, separators: str) -> Column:
    return F.regexp_replace(F.translate(text, _JOIN, _OTHER), f"(?<=[{between}])[{separators}](?=[{between}])", _JOIN)


def char_class(c: Column) -> Column:
    """0 space or nothing, 1 letter, 2 digit, 3 anything else."""
    return F.when(c.isNull() | (c == "") | c.rlike(r"^\s"), 0).when(c.rlike(r"^\p{L}"), 1).when(c.rlike("^[0-9]"), 2).otherwise(3)


def described(s: Column) -> Column:
    """A candidate's place and features. Whether it passes its kind's check is none of them: all candidates do."""
    n, hit = F.length(digits(s["hit"])), s["hit"]
    dots = F.size(F.split(hit, r"\.|\bdot\b")) - 1
    groups = F.when(s["kind"] == 0, 2 * hit.rlike("^[^@ \\[(]*[._+0-9]").cast("int") + 2 * (dots > 1).cast("int") + 1).otherwise(F.size(F.split(hit, "[^0-9]+")))
    marks = F.regexp_replace(hit, r"[0-9A-Za-z+%]+", "")
    between = F.when(hit.rlike(r"[\[(]") & (s["kind"] < 2), 4).when(hit.rlike(r" at | dot ") & (s["kind"] < 2), 5).when(marks == "", 0).when(hit.rlike(r"[ ./_-]{2}"), 3).when(F.length(F.regexp_replace(marks, r"(.)(?=.*\1)", "")) > 1, 2).otherwise(1)
    word = F.length(F.regexp_extract(s["head"], r"(\p{L}+)\P{L}*$", 1))
    cue = reduce(lambda a, k: a.when(F.lower(s["head"]).rlike(CUES[k]), KINDS.index(k) + 1), KINDS[1:], F.when(F.lower(s["head"]).rlike(CUES[KINDS[0]]), 1)).otherwise(0)
    return F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), hit.rlike(r"^(\+|00)").cast("int").alias("plus"), between.alias("between"),
        F.when(n < 7, 0).when(n < 10, 1).when(n < 13, 2).when(n < 16, 3).otherwise(4).alias("digits"), F.when(groups < 2, 0).when(groups < 4, 1).when(groups < 5, 2).when(groups < 6, 3).otherwise(4).alias("groups"),
        char_class(F.right(s["head"], F.lit(1))).alias("before"), char_class(F.left(s["tail"], F.lit(1))).alias("after"), F.when(word < 1, 0).when(word < 4, 1).when(word < 8, 2).otherwise(3).alias("word"), cue.alias("cue"),
    )


def acceptable(kind: str) -> Callable:
    """Whether a candidate passes its kind's check and is no part of a longer word, token or number."""
    before, after = (BEFORE, AFTER) if kind == "email" else (f"{BEFORE}|{GOES_ON[0]}", f"{AFTER}|{GOES_ON[1]}")
    return lambda s: ~s["head"].rlike(before) & ~s["tail"].rlike(after) & valid(kind, s["hit"])


def with_candidates(df: DataFrame) -> DataFrame:
    """df with candidates: an array of those of its text that pass their kind's check, with features; spans of different generators may overlap."""
    df = located(df, "wide", {k: F.when(F.col("text").rlike(HINTS[k]), F.col("text")) for k in KINDS}, WIDER)
    parts = [F.transform(F.filter(f"wide_{k}", acceptable(k)), described) for k in KINDS]
    return df.withColumn("candidates", F.flatten(F.array(*parts))).drop(*[f"wide_{k}" for k in KINDS])


@dataclass
class Model:
    """Boosted trees (a leaf is a number, a node is (feature, value, if equal, if not)) and a threshold for each kind."""

    start: float = 0.0
    trees: list = field(default_factory=list)
    thresholds: list[float] = field(default_factory=lambda: [math.inf] * len(KINDS))

    def raw(self, cell: dict) -> float:
        return self.start + sum(_leaf(t, cell) for t in self.trees)

    def score(self, c: Column) -> Column:
        """The same sum as an expression over a candidate's features."""
        return reduce(lambda a, t: a + _expression(t, c), self.trees, F.lit(self.start))

    def accepts(self, c: Column) -> Column:
        limit = reduce(lambda a, k: a.when(c["kind"] == k, F.lit(self.thresholds[k])), range(1, len(KINDS)), F.when(c["kind"] == 0, F.lit(self.thresholds[0])))
        return self.score(c) >= limit


def _leaf(tree, cell: dict) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if cell[tree[0]] == tree[1] else tree[3]
    return tree


def _expression(tree, c: Column) -> Column:
    return F.when(c[tree[0]] == tree[1], _expression(tree[2], c)).otherwise(_expression(tree[3], c)) if isinstance(tree, tuple) else F.lit(float(tree))


def grow(cells: np.ndarray, slope: np.ndarray, curve: np.ndarray, depth: int):
    """A tree over cells (a column for each feature) by the usual second-order gain with a penalty of 1."""
    gain = lambda g, h: g**2 / (h + 1)
    g, h = slope.sum(), curve.sum()
    best = (1e-6, None)
    for k, n in enumerate(FEATURES.values()) if depth else ():
        gs, hs, rows = (np.bincount(cells[:, k], w, n) for w in (slope, curve, None))
        better = np.where((rows > 0) & (rows < len(cells)), gain(gs, hs) + gain(g - gs, h - hs) - gain(g, h), 0.0)
        if better.max() > best[0]:
            best = (better.max(), (k, int(better.argmax())))
    if best[1] is None:
        return RATE * g / (h + 1)
    k, v = best[1]
    yes = cells[:, k] == v
    return list(FEATURES)[k], v, grow(cells[yes], slope[yes], curve[yes], depth - 1), grow(cells[~yes], slope[~yes], curve[~yes], depth - 1)


def boosted(counts: list[tuple[dict, int, int]]) -> Model:
    """A model without thresholds from cells (features, rows, rows that are personal data)."""
    total, yes = sum(n for _, n, _ in counts), sum(y for *_, y in counts)
    model = Model(start=math.log((yes + 1) / (total - yes + 1)))
    if counts:
        cells = np.array([[c[f] for f in FEATURES] for c, *_ in counts])
        n, y = (np.array([x[k] for x in counts], float) for k in (1, 2))
        raw = np.full(len(counts), model.start)
        for _ in range(ROUNDS if yes else 0):
            p = 1 / (1 + np.exp(-raw))
            model.trees.append(grow(cells, y - n * p, n * p * (1 - p), DEPTH))
            raw += [_leaf(model.trees[-1], c) for c, *_ in counts]
    return model


def merged(counts: list[tuple[dict, int, int, int]]) -> list[tuple[dict, int, int]]:
    """Cells of several folds as one, in a fixed order."""
    sums: dict[tuple, list[int]] = {}
    for c, n, y, _ in counts:
        both = sums.setdefault(tuple(c[f] for f in FEATURES), [0, 0])
        both[0] += n
        both[1] += y
    return [(dict(zip(FEATURES, key)), *both) for key, both in sorted(sums.items())]


def fit(counts: list[tuple[dict, int, int, int]]) -> Model:
    """Trees from the cells (features, rows, rows that are personal data, fold) of all folds. Thresholds come from all rows too, each scored by trees of the other folds: a kind's is the
    lowest score from which on PRECISION of its rows are, where every row that is counts as HIDDEN of one. A kind that never gets there has no additions."""
    model = boosted(merged(counts))
    scored = []
    for fold in sorted({out for *_, out in counts}):
        others = boosted(merged([x for x in counts if x[3] != fold]))
        scored += [(c["kind"], others.raw(c), n, y) for c, n, y, out in counts if out == fold]
    for k in range(len(KINDS)):
        tested = sorted((x[1:] for x in scored if x[0] == k), key=lambda x: -x[0])
        rows = hits = 0
        for at, (score, n, y) in enumerate(tested):
            rows, hits = rows + n, hits + y
            if HIDDEN * hits >= PRECISION * (HIDDEN * hits + rows - hits) and hits and (at + 1 == len(tested) or tested[at + 1][0] < score):
                model.thresholds[k] = score - 1e-9
    return model


def with_base(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, columns to carry, base_kind for each kind and base: the valid base spans, by kind and start."""
    text = F.col("text")
    source = {"email": joined(text, _HOST, "."), "ip": text, "card": joined(text, "0-9", " -"), "phone": text}
    found = located(documents_of(docs, carry).select("doc_id", "text", *carry), "base", {k: F.when(text.rlike(BASE_HINTS[k]), c) for k, c in source.items()}, BASE)
    out = found.select("doc_id", "text", *carry, *[F.filter(f"base_{k}", passing(k)).alias(f"base_{k}") for k in KINDS])
    return out.withColumn("base", F.concat(*[F.col(f"base_{k}") for k in KINDS]))


def disguised(kind: str, span: Column, way: Column) -> Column:
    """A base match as people write it so that base patterns miss it, in one of four ways."""
    pick = lambda *ways: reduce(lambda a, k: a.when(way == k, ways[k]), range(1, 4), F.when(way == 0, ways[0]))
    hit = F.translate(span["hit"], _JOIN, "." if kind == "email" else " ")
    if kind == "email":
        local, host = F.substring_index(hit, "@", 1), F.substring_index(hit, "@", -1)
        return pick(*[F.concat(local, F.lit(at), F.replace(host, F.lit("."), F.lit(dot))) for at, dot in ((" [at] ", " [dot] "), (" at ", " dot "), ("(at)", "(dot)"), (" @ ", " . "))])
    if kind == "ip":
        return pick(*[F.replace(hit, F.lit("."), F.lit(dot)) for dot in ("[.]", " . ", "(dot)", " dot ")])
    if kind == "card":
        return pick(*[F.regexp_replace(digits(hit), "([0-9]{4})(?=[0-9])", f"$1{mark}") for mark in (".", "/", "  ", "_")])
    bare = F.regexp_replace(hit, r"^\+", "")
    return pick(bare, F.concat(F.lit("00"), bare), F.regexp_replace(bare, r"[ ()-]+", "."), F.regexp_replace(bare, r"^[0-9]{1,3}[ .-]+", ""))


def examples(docs: DataFrame) -> DataFrame:
    """(features, out, hit) of candidates to learn from: every base match of every document disguised, in its own context (hit), and every
    candidate of a document that touches no base match (not), by fold of the document (out)."""
    base = with_base(docs).select("doc_id", "text", "base", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("out"))
    span = base.select("doc_id", "out", F.explode("base").alias("s")).withColumn("way", F.pmod(F.xxhash64("doc_id", "s.start", F.lit(7)), F.lit(4)))
    hidden = reduce(lambda a, k: a.when(F.col("s.kind") == k, disguised(KINDS[k], F.col("s"), F.col("way"))), range(1, len(KINDS)), F.when(F.col("s.kind") == 0, disguised(KINDS[0], F.col("s"), F.col("way"))))
    clean = lambda c: F.translate(F.coalesce(c, F.lit("")), _JOIN, " ")
    # a table of some dozens of bytes for each base match, which also keeps the plan small
    text = written(span.select("out", F.col("s.kind").alias("kind"), clean(F.col("s.head")).alias("head"), hidden.alias("hidden"), clean(F.col("s.tail")).alias("tail")), "hidden")
    no_span = F.array().cast(f"array<{SPAN}>").alias("base")
    own = text.select("out", F.concat("head", "hidden", "tail").alias("text"), no_span, "kind", F.length("head").alias("start"), (F.length("head") + F.length("hidden")).alias("end"))
    # both sorts of texts go through the generators as one
    rows = base.select("out", "text", "base").withColumns({c: F.lit(None).cast("int") for c in ("kind", "start", "end")}).unionByName(own)
    found = with_candidates(rows).select("out", "kind", "start", "end", F.explode(unclaimed(F.col("candidates"), F.col("base"))).alias("c"))
    found = found.where("kind is null or c.kind = kind and c.start < end and start < c.end").withColumn("hit", F.col("kind").isNotNull().cast("int"))
    return found.select(*[F.col(f"c.{f}").alias(f) for f in FEATURES], "out", "hit")


def train(docs: DataFrame) -> Model:
    """The model of one grouped count over the examples of all documents; there are at most FOLDS times as many groups as the features have combinations, whatever the number of documents."""
    rows = examples(docs).groupBy(*FEATURES, "out").agg(F.count("*").alias("n"), F.sum("hit").alias("y")).collect()
    return fit(sorted((({f: r[f] for f in FEATURES}, r["n"], r["y"], r["out"]) for r in rows), key=str))


def unclaimed(found: Column, base: Column) -> Column:
    """Candidates that touch no base span. Both are put in order of their starts; a candidate touches an earlier span if the furthest end so far is beyond its start, and a later
    one if the next start is before its end; so one pass forward and one back settle all."""
    place = lambda mine: lambda s, k: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(F.lit(mine), k).alias("k"))
    both = F.concat(F.transform(found, place(True)), F.transform(base, place(False)))
    marks = "struct<start:int,end:int,k:int>"
    # of spans that start together, base ones come first on the way forward
    forward = F.array_sort(F.transform(both, lambda s: F.struct(s["start"].alias("start"), s["k"].isNotNull().alias("mine"), s["end"].alias("end"), s["k"].alias("k"))))
    clear = scan(
        forward, F.lit(0), marks, lambda far, s: F.when(s["mine"], far).otherwise(F.greatest(far, s["end"])),
        lambda far, s: F.when(~s["mine"] | (far <= s["start"]), F.struct(s["start"].alias("start"), s["end"].alias("end"), s["k"].alias("k"))),
    )
    kept = scan(F.reverse(clear), F.lit(2**31 - 1), "int", lambda next_, s: F.when(s["k"].isNull(), s["start"]).otherwise(next_), lambda next_, s: F.when(s["k"].isNotNull() & (s["end"] <= next_), s["k"]))
    return F.when(F.size(base) == 0, found).when(F.size(found) == 0, found).otherwise(F.transform(F.array_sort(kept), lambda k: F.get(found, k)))


def spans(docs: DataFrame, model: Model, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, base (valid base spans by kind and start) and extra (accepted candidates that touch no base span nor each other).

    Null text is empty text and has no spans. Repeated rows give repeated results, a null doc_id stays null, columns besides doc_id and text play no part.
    Of accepted candidates that overlap, the one that starts first stays; of those that start together, the longest.
    """
    out = with_candidates(with_base(docs, carry)).withColumn("wide", F.filter("candidates", model.accepts)).drop("candidates")
    out = out.withColumn("free", unclaimed(F.col("wide"), F.col("base")))
    ordered = F.array_sort(F.transform("free", lambda c: F.struct(c["start"].alias("start"), (-c["end"]).alias("back"), c["kind"].alias("kind"), c["end"].alias("end"))))
    kind = "struct<kind:int,start:int,end:int>"
    kept = scan(
        ordered, F.lit(0), kind, lambda at, c: F.when(c["start"] >= at, c["end"]).otherwise(at),
        lambda at, c: F.when(c["start"] >= at, F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))),
    )
    return out.withColumn("extra", F.when(F.size("free") > 0, kept).otherwise(F.array().cast(f"array<{kind}>")))


def listed(spans: Column) -> Column:
    """kind:start:end of spans by kind as listed and then start, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    bare = F.array_sort(F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    return F.array_join(F.transform(bare, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns: counts of base spans, a digest of the list of base spans, the list of all spans."""
    bare = lambda c: F.transform(c, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return found.select(
        "doc_id", *[F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat(bare("base"), bare("extra"))).alias("spans"),
        F.size("extra").cast("long").alias("n_extra"), (F.size("base") + F.size("extra")).cast("long").alias("n_spans"),
    )


def redact(found: DataFrame, mask: str = "[{}]", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and text with every span replaced by its kind's mark. Overlapping base spans of different kinds are replaced as one, under the first's kind."""
    bare = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    marks = F.array(*[F.lit(mask.format(k)) for k in KINDS])
    # the text in pieces, so that finding a place doesn't mean going through all that is before it
    found = found.select("doc_id", *carry, "text", F.array_sort(F.concat(bare("base"), bare("extra"))).alias("every"), F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)).alias("pieces"))

    def cut(start: Column, end: Column) -> Column:
        first = F.floor(start / PIECE).cast("int")
        some = F.slice(F.col("pieces"), first + 1, F.floor((end - 1) / PIECE).cast("int") - first + 1)
        return F.when(end > start, F.substring(F.array_join(some, ""), start % PIECE + 1, end - start)).otherwise(F.lit(""))

    stop = F.struct(F.length("text").alias("start"), F.length("text").alias("end"), F.lit(None).cast("int").alias("kind"))
    parts = scan(
        F.concat("every", F.array(stop)), F.lit(0), "string", lambda at, s: F.greatest(at, s["end"]),
        lambda at, s: F.when(s["start"] >= at, F.concat(cut(at, s["start"]), F.coalesce(F.get(marks, s["kind"]), F.lit("")))),
    )
    return found.select("doc_id", *carry, F.when(F.size("every") > 0, F.array_join(parts, "")).otherwise(F.col("text")).alias("text"))
