"""Texts of 180,000 words, against plain Python."""

import re

from tessella.llm import decontam, pii

WORDS = 180_000


def long_text():
    odd = {17: "mail me{0}@place.org", 501: "ünïcode \U0001f600 {0}", 1009: "login 10.2.3.{1}", 2011: "call +49 30 1234 {0:05d}"}
    return " ".join(next((f.format(i, i % 250) for n, f in odd.items() if i % n == 0), f"w{i * 7919 % 50021}x") for i in range(WORDS))


def test_spans_and_marks(spark):
    text = long_text()
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    want = sorted([m.start(), m.end()] for m in re.finditer(pii.BASE["email"].replace(r"\G|", ""), text))
    model = {"bias": -1.0}
    got = {r.doc_id: r.s for r in docs.select("doc_id", pii.spans(docs.text, model).alias("s")).collect()}
    assert [[s.start, s.end] for s in got[1] if s.k == 0] == want and len(want) > 10_000
    assert all(text[s.start : s.end].startswith("10.2.3.") for s in got[1] if s.k == 1) and sum(s.k == 1 for s in got[1]) > 100
    assert got[2] == got[3] == []
    marked, at, out = {r.doc_id: r.text for r in pii.redact(docs).collect()}, 0, []
    for s in pii_order(got[1]):
        if s.start >= at:
            out += [text[at : s.start], f"[{pii.KINDS[s.k]}]"]
        at = max(at, s.end)
    assert marked[1] == "".join(out) + text[at:] and marked[2] == "" and marked[3] is None


def pii_order(spans):
    return sorted(spans, key=lambda s: (s.start, s.k))


def test_items_inside(spark):
    text = long_text()
    words = text.split(" ")
    items = [(k, " ".join(words[k * 4001 : k * 4001 + 20])) for k in range(30)] + [(100, "not here at all in any of these"), (101, None)]
    docs = spark.createDataFrame([(1, text), (2, "short"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contained_items(docs, bench).collect()
    assert sorted((r.doc, r.item) for r in got) == [(1, k) for k in range(30)]
    assert all(r.n_shared == r.n_item for r in got)
