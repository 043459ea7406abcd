"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a classifier decides.

Base spans (email, ip, card, phone: a pattern and its check) always stay. Candidates are the base spans and what looser
patterns find beside them (a card or phone number that a greedy pattern has run together with its neighbour, an
address with (at) and (dot), a long key). Three labelers vote yes, no or abstain on each candidate:

* regex: the strict form of its kind (Luhn, octets, digits of a phone number, a mixed key);
* gazetteer: fixed lists (top-level domains, calling codes, issuers' first digits, names of keys);
* context: cue words before the span, or a letter or digit that touches it.

The votes are counted by pattern over all documents (5 kinds, 3 labelers, few shapes: a table of a fixed bound, and the
only rows that reach the driver). EM estimates each labeler's reliability and each kind's rate of true spans; a
logistic span classifier over votes, kind and shape is fitted to EM's posteriors and decides. It is applied as a
column expression, so both passes over the texts are narrow: no join, no shuffle but for the counts, no Python.

Defined results: null or empty text: no spans. Repeated rows: one result each. Offsets count code points. With no
candidates at all the classifier accepts nothing, and base spans are all there is.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import let

KINDS = ["email", "ip", "card", "phone", "secret"]
_E = "[A-Za-z0-9._%+-]"
#: Base patterns. \G and the lookbehind only spare scans from the middle of a run, and possessive repeats only spare backtracking: the matches are those of the plain patterns.
#: A card's {11,} leaves out runs with fewer than the 12 digits that its check asks for.
BASE = {
    "email": rf"(?:\G|(?<!{_E})){_E}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": rf"(?<!{_E}){_E}++\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:\x20?(?:\(dot\)|\[dot\]|\.)\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9])[0-9]{4}(?:[\x20-]?[0-9]{4}){3}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}+",
}
#: Fixed lists of the gazetteer labeler: accepted starts or ends by kind.
GAZETTEER = {
    "email": r"\.(?:com|org|net|edu|gov|info|io|de|fr|es|uk|it|nl|eu|us|ca|ch|at|be|pl|ru|br|jp|cn|in|au)$",
    "ip": r"^(?!127\.)(?:[1-9]|[1-9][0-9]|1[0-9]{2}|2[01][0-9]|22[0-3])\.",
    "card": r"^[2-6]",
    "phone": r"^\+(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
}
#: Cue words of the context labeler, looked for in the CONTEXT characters before a span.
CUES = {
    "email": r"(?i)(?:e-?mail|mail|contact|write|courriel|correo)",
    "ip": r"(?i)(?:\bip\b|address|host|server|login)",
    "card": r"(?i)(?:card|visa|master|credit|payment|carte|tarjeta|karte)",
    "phone": r"(?i)(?:phone|tel|call|mobile|fax|whatsapp)",
    "secret": r"""(?i)(?:token|secret|passw|api.?key|access.?key|private)\w*\x20*[=:]\x20*["']?$""",
}
CONTEXT = 40


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def total(r: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            d = F.substring(r, i, F.lit(1)).cast("int")
            twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
            return acc + F.when(i % 2 == 0, twice).otherwise(d)

        return F.aggregate(F.sequence(F.lit(1), F.length(r)), F.lit(0), step)

    return let(F.reverse(digits), total) % 10 == 0


def strict(kind: str, m: Column) -> Column:
    """The check that a base span of this kind passes."""
    n = F.length(_digits(m))
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
        return F.rlike(m, F.lit(rf"^{part}(?:\.{part}){{3}}$"))
    if kind == "card":
        return F.when(n.between(12, 19), luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    if kind == "secret":
        return F.rlike(m, F.lit("(?:[0-9].*){6}")) & F.rlike(m, F.lit("[A-Za-z]"))
    return F.lit(True)


def matches(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches as structs start, end, m; the texts between them give the places, in one pass."""

    def place(found: Column, between: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + F.length(x["before"])
            end = start + F.length(x["m"])
            one = F.struct(start.alias("start"), end.alias("end"), x["m"].alias("m"))
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

        return let(F.transform(found, lambda m, i: F.struct(m.alias("m"), F.get(between, i).alias("before"))), lambda xs: common.scan(xs, "struct<start:int,end:int,m:string>", step))

    none = F.array().cast("array<struct<start:int,end:int,m:string>>")
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) == 0, none).otherwise(let(F.split(text, pattern, -1), lambda between: place(found, between))))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _candidate(kind: str, base: bool, chunks: Column, x: Column) -> Column:
    """A span with its votes and shape."""
    m, start, end = x["m"], x["start"], x["end"]
    ok = strict(kind, m)
    shape = F.when(F.rlike(m, F.lit("[^A-Za-z0-9]")), "parted").otherwise("solid")

    def judged(before: Column) -> Column:
        touches = F.rlike(before, F.lit("[A-Za-z0-9]$")) | F.rlike(common.piece_of(chunks, end, end + 1), F.lit("^[A-Za-z0-9]"))
        if kind == "secret":
            listed = _vote(F.rlike(before, F.lit(CUES["secret"])), F.rlike(m, F.lit("^[A-Za-z]+$")))
            cue = _vote(F.rlike(before, F.lit("""["'=]$""")), touches)
        else:
            known = F.rlike(m, F.lit(GAZETTEER[kind]))
            listed = F.when(known, 1).when(F.lit(kind != "phone") | F.startswith(m, F.lit("+")), -1).otherwise(0)
            cue = _vote(F.rlike(before, F.lit(CUES[kind])), touches)
        return F.struct(
            start.alias("start"), F.lit(KINDS.index(kind)).alias("k"), end.alias("end"), F.lit(base).alias("base"),
            F.when(ok, 1).otherwise(-1).alias("regex"), listed.alias("gazetteer"), cue.alias("context"), shape.alias("shape"),
        )

    return let(F.greatest(start - CONTEXT, F.lit(0)), lambda first: let(common.piece_of(chunks, first, start), judged))


def _without(spans: Column, held: Column) -> Column:
    """The spans that overlap none of held (sorted, apart from one another); held is passed over by blocks."""
    overlap = lambda x, y: (x["start"] < y["end"]) & (y["start"] < x["end"])
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(held) - 1) / common.SCAN).cast("int")), lambda k: F.slice(held, k * common.SCAN + 1, common.SCAN))
    inside = lambda b, y: (F.get(b, F.lit(0))["start"] < y["end"]) & (y["start"] < F.element_at(b, -1)["end"]) & F.exists(b, lambda x: overlap(x, y))
    return F.when((F.size(held) == 0) | (F.size(spans) == 0), spans).otherwise(let(blocks, lambda bs: F.filter(spans, lambda y: ~F.exists(bs, lambda b: inside(b, y)))))


def candidates(text: Column) -> Column:
    """Base spans and looser candidates that overlap no base span of their kind; an array of structs."""
    none = F.array().cast("array<struct<start:int,k:int,end:int,base:boolean,regex:int,gazetteer:int,context:int,shape:string>>")
    text = F.coalesce(text, F.lit(""))
    any_digit, any_at = F.rlike(text, F.lit("[0-9]")), F.contains(text, F.lit("@"))
    gate = {"email": any_at, "ip": any_digit, "card": any_digit, "phone": any_digit & F.contains(text, F.lit("+")), "secret": F.rlike(text, F.lit("[A-Za-z0-9+/_-]{32}"))}
    loose_gate = gate | {"email": F.contains(text, F.lit("at)")) | F.contains(text, F.lit("at]")), "phone": any_digit}

    def judged(kind: str, base: bool, found: Column) -> Column:
        judge = lambda xs: let(common.chunks_of(text), lambda parts: F.transform(xs, lambda x: _candidate(kind, base, parts, x)))
        return let(found, lambda xs: F.when(F.size(xs) == 0, none).otherwise(judge(xs)))

    out = []
    for kind in KINDS:
        base = none
        if kind in BASE:
            base = F.when(gate[kind], judged(kind, True, F.filter(matches(text, BASE[kind]), lambda x: strict(kind, x["m"])))).otherwise(none)
        loose = lambda b: F.when(loose_gate[kind], judged(kind, False, let(matches(text, LOOSE[kind]), lambda xs: _without(xs, b)))).otherwise(none)
        out.append(let(base, lambda b: F.concat(b, loose(b))))
    return F.concat(*out)


LABELERS = ("regex", "gazetteer", "context")


def _features(row: dict) -> list[str]:
    return ["bias", f"k={row['k']}", f"shape={row['shape']}", *[f"{x}={row[x]}" for x in LABELERS]]


def expectation_maximisation(rows: list[dict], rounds: int = 100) -> list[float]:
    """Posterior that a candidate is true, for each counted pattern; rows: k, votes by LABELERS, count."""
    post = [min(max((1 + sum(r[x] for x in LABELERS) / len(LABELERS)) / 2, 0.05), 0.95) for r in rows]
    for _ in range(rounds):
        prior, rate = {}, {}
        for k in {r["k"] for r in rows}:
            n = sum(r["count"] for r in rows if r["k"] == k)
            prior[k] = (1 + sum(r["count"] * p for r, p in zip(rows, post) if r["k"] == k)) / (n + 2)
        for x in LABELERS:
            for truth in (0, 1):
                weights = [r["count"] * (p if truth else 1 - p) for r, p in zip(rows, post)]
                for v in (-1, 0, 1):
                    # better than chance beforehand: a yes is likelier for the true, a no for the false
                    pseudo = 3 if v == (1 if truth else -1) else 1
                    rate[x, truth, v] = (pseudo + sum(w for w, r in zip(weights, rows) if r[x] == v)) / (5 + sum(weights))
        new = []
        for r in rows:
            odds = math.log(prior[r["k"]] / (1 - prior[r["k"]])) + sum(math.log(rate[x, 1, r[x]] / rate[x, 0, r[x]]) for x in LABELERS)
            new.append(1 / (1 + math.exp(-max(-30, min(30, odds)))))
        if max((abs(a - b) for a, b in zip(new, post)), default=0) < 1e-6:
            return new
        post = new
    return post


def classifier(rows: list[dict], post: list[float], rounds: int = 400, l2: float = 1e-3) -> dict[str, float]:
    """Weights of a logistic span classifier fitted to the posteriors; every pattern counts by the logarithm of its count."""
    names = sorted({f for r in rows for f in _features(r)})
    w = dict.fromkeys(names, 0.0)
    load = [math.log1p(r["count"]) for r in rows]
    total = sum(load) or 1
    for _ in range(rounds):
        grad = {f: l2 * v for f, v in w.items()}
        for r, p, n in zip(rows, post, load):
            fs = _features(r)
            e = n / total * (1 / (1 + math.exp(-max(-30, min(30, sum(w[f] for f in fs))))) - p)
            for f in fs:
                grad[f] += e
        for f in names:
            w[f] -= 2.0 * grad[f]
    return w


def fit(docs: DataFrame, text_col: str = "text") -> dict[str, float]:
    """The span classifier of a corpus: votes are counted over all documents."""
    keys = ["k", "shape", *LABELERS]
    spans = docs.select(F.explode(candidates(F.col(text_col))).alias("c")).select("c.*")
    rows = [r.asDict() for r in spans.groupBy(*keys).count().collect()]  # at most 5 * 2 * 27 rows
    rows.sort(key=lambda r: [r[k] for k in keys])
    return classifier(rows, expectation_maximisation(rows))


def accepted(model: dict[str, float], c: Column) -> Column:
    def weight(name: str, value: Column) -> Column:
        out = F.lit(0.0)
        for f, w in model.items():
            if f.startswith(name + "="):
                out = F.when(value == F.lit(f.partition("=")[2]), w).otherwise(out)
        return out

    parts = [weight(x, c[x].cast("string")) for x in ("k", "shape", *LABELERS)]
    return c["base"] | (reduce(Column.__add__, parts, F.lit(model.get("bias", -1.0))) > 0)


def spans(text: Column, model: dict[str, float]) -> Column:
    """All accepted spans, sorted by start and kind; structs start, k, end, base."""
    kept = F.filter(candidates(text), lambda c: accepted(model, c))
    return F.array_sort(F.transform(kept, lambda c: F.struct(c["start"].alias("start"), c["k"].alias("k"), c["end"].alias("end"), c["base"].alias("base"))))


def _kind(k: Column) -> Column:
    return F.get(F.array(*[F.lit(x) for x in KINDS]), k)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in brackets; the same columns."""
    model = fit(docs, text_col)
    text = F.col(text_col)

    def cut(found: Column, chunks: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            inside = s["start"] < acc["at"]  # overlaps the span before: that one's mark stands for both
            piece = F.concat(common.piece_of(chunks, acc["at"], s["start"]), F.lit("["), _kind(s["k"]), F.lit("]"))
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], F.array(piece))).alias("out"))

        size = F.length(text)
        last = F.array_max(F.transform(found, lambda s: s["end"]))
        return F.concat(F.array_join(common.scan(found, "string", step), ""), common.piece_of(chunks, last, size))

    return docs.withColumn(text_col, let(spans(text, model), lambda found: F.when(F.size(found) == 0, text).otherwise(let(common.chunks_of(text), lambda chunks: cut(found, chunks)))))


def op7_personal_data(spark, sf_dir: str) -> DataFrame:
    """Every document's base counts and all spans."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = docs.select("doc_id", spans(F.col("text"), fit(docs)).alias("s"))
    told = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", _kind(s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("s", lambda s: s["base"])
    count = lambda i: F.size(F.filter("s", lambda s: s["base"] & (s["k"] == i))).cast("long")
    return found.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])], F.sha2(told(base), 256).alias("base_sha256"), told(F.col("s")).alias("spans"))
