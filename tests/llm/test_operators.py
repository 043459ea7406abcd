"""Each operator against brute force on small tables, with nulls, empty and repeated rows, extra columns and no rows."""

import hashlib
import math
import re
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tessella.llm import common, decontam, pii, quality, sharding, sp_codec, substring_dedup, token_output, toxicity, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = ["", None, " lead", "a  b", "<|endoftext|> a", "a <|endoftext|>", "▁a ▁b", "a▁ b", "tail  ", "\n\n a\n", "\U0001f600 é　z", "a\r\n b", "it's we'll", "x" * 3000, "The same. The same.", "The same. The same."]


def docs(spark, texts, cols="extra string"):
    return spark.createDataFrame([(i, t, "e") for i, t in enumerate(texts)], f"doc_id long, text string, {cols}")


def test_url_filter(spark):
    urls = ["http://A.example.net/en/x?q", "https://b.example.net/de/", "http://m.shop.example.com/de/1", "http://x.org/fr/", "http://x.org/de/", "http://bad.host", "http://sub.bad.host/p#f", None, "nothing", "http://x.net"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, path0 string")
    listed = spark.createDataFrame([("bad.host",), ("b.example.net",)], "key string")
    got = {r.page_id: r for r in url_filter.filter_urls(pages, listed).collect()}
    assert [got[i].rule for i in range(10)] == ["example.net/en/", "net/", "example.com/de/", "org/fr/", None, None, None, None, None, None]
    assert [got[i].verdict for i in range(10)] == ["allow", "block", "block", "allow", "allow", "block", "block", "allow", "allow", "allow"]
    assert (got[7].host, got[7].path, got[9].path) == ("", "", "")
    assert url_filter.filter_urls(pages.limit(0), listed).count() == 0


def test_cascade_is_exact(spark):
    keys = spark.range(3000).selectExpr("cast(id as string) AS key", "id % 7 = 0 AS listed")
    c = url_filter.cascade(common.save(keys, "keys"))
    from pyspark.sql import functions as F

    assert keys.where(c.has(F.col("key")) != F.col("listed")).count() == 0
    for listed in ("true", "false"):
        every = common.save(spark.range(50).selectExpr("cast(id as string) AS key", f"{listed} AS listed"), "keys")
        assert every.where(url_filter.cascade(every).has(F.col("key")) != F.col("listed")).count() == 0


def test_tokens_round_trip(spark):
    from tokenizers import Tokenizer

    P = pytest.importorskip("public_tokenizers")
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    path = common.scratch_path(spark, "tokens")
    token_output.write_tokens(docs(spark, ODD), path)
    got, start = {r.doc_id: r for r in token_output.read_tokens(spark, path).collect()}, 0
    for i, x in enumerate(ODD):
        ids = t.encode(x or "", add_special_tokens=False).ids + [0]
        assert (got[i].ids, got[i].start, got[i].n_tokens) == (ids, start, len(ids)), x
        start += len(ids)
    empty = common.scratch_path(spark, "tokens")
    token_output.write_tokens(docs(spark, []), empty)
    assert token_output.read_tokens(spark, empty).count() == 0


def test_sentencepiece(spark):
    sentencepiece, P = pytest.importorskip("sentencepiece"), pytest.importorskip("public_tokenizers")
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in sp_codec.encode_documents(docs(spark, ODD)).collect()}
    for i, x in enumerate(ODD):
        ids = sp.encode(x or "", add_bos=True, add_eos=True)
        assert np.frombuffer(got[i].ids, "<u4").tolist() == ids and got[i].decoded == sp.decode(ids), x
        raw = (x or "").encode()
        a, b = (np.frombuffer(v, "<u4").tolist() for v in (got[i].starts, got[i].ends))
        assert b"".join(raw[s:e] for s, e in zip(a[1:-1], b[1:-1])).strip(b" ") in (raw, raw.strip(b" "))
    assert sp_codec.encode_documents(docs(spark, [])).count() == 0


def test_sentencepiece_one_space_at_the_end(spark):
    sentencepiece, P = pytest.importorskip("sentencepiece"), pytest.importorskip("public_tokenizers")
    sp, texts = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model")), ["tail ", "foo bar ", " ", "a  b ", "a\n ", "mid", "é "]
    for r in sp_codec.encode_documents(docs(spark, texts)).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == sp.encode(texts[r.doc_id], add_bos=True, add_eos=True), texts[r.doc_id]
        assert np.frombuffer(r.ends, "<u4")[-2] == len(texts[r.doc_id].encode())


def test_character_map():
    m = sp_codec.CharacterMap(b"")
    assert m.longest(b"abc", 0) is None


def test_quality(spark):
    good = " ".join(f"word{i}" for i in range(30)) + "."
    texts = [good, None, "", "a " * 200 + ".", good + "\n" + "Home | News | Mail | More", "Menu\n" * 40 + good, "$$$ " * 50 + ".", good + "\n" + good]
    j = {r.doc_id: r for r in quality.judge(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        ws = WORD.findall(t or "")
        wins = [tuple(ws[k : k + 8]) for k in range(len(ws) - 7)]
        rep = {k + o for k, w in enumerate(wins) if wins.count(w) > 1 for o in range(8)}
        assert (j[i].q_n_words, j[i].q_n_repeat_words, j[i].q_word_chars) == (len(ws), len(rep), sum(map(len, ws)))
        assert j[i].q_base_failed == (len(ws) < 20 or 100 * len(rep) > 30 * len(ws))
    assert [j[i].q_keep for i in range(len(texts))] == [True, False, False, False, True, False, False, False]
    kept = {r.doc_id: r.text for r in quality.clean(docs(spark, texts)).collect()}
    assert kept[0] == good and kept[4] == good and set(docs(spark, texts).columns) == {"doc_id", "text", "extra"}


def test_decontamination(spark):
    item = " ".join(f"t{i}" for i in range(20))
    texts = ["x y z " * 50 + item + " end", item.upper(), "clean text of no such kind", None, "short one", " ".join(f"t{i}" for i in range(10))]
    bench = spark.createDataFrame([(1, item, 0), (1, item, 0), (2, "short one", 0), (3, None, 0), (4, "", 0)], "item_id long, text string, doc_id int")
    got = sorted((r.doc, r.item, r.n_shared) for r in decontam.contained_items(docs(spark, texts), bench).collect())
    assert got == [(0, 1, 16), (1, 1, 16), (4, 2, 1)]
    null_ids = docs(spark, texts).selectExpr("cast(null as long) doc_id", "text", "extra")
    assert sorted(r.text or "" for r in decontam.decontaminate(null_ids, bench).collect()) == sorted(t or "" for i, t in enumerate(texts) if i not in (0, 1, 4))
    assert decontam.contained_items(docs(spark, []), bench).count() == 0 and decontam.contained_items(docs(spark, texts), bench.limit(0)).count() == 0


def test_substrings(spark):
    r = np.random.default_rng(1)
    new = lambda n: [f"w{x}" for x in r.integers(0, 10**6, n)]
    p = new(70)
    texts = [" ".join(new(80) + p + new(30)), " ".join(new(10) + p + new(90)), " ".join(new(120)), None, "", " ".join(p[:30] + new(50)), " ".join(p)]
    got = {(x.id, x.of, x.words) for x in substring_dedup.repeated_passages(docs(spark, texts)).collect()}
    assert got == {(1, 0, 70), (6, 0, 70)}
    assert substring_dedup.repeated_passages(docs(spark, [])).count() == 0


def lost_runs(texts, got, n=50):
    """Runs of n words of a text that an earlier one holds and no passage of got covers, by brute force."""
    seen, lost = set(), []
    for i, t in enumerate(texts):
        at = [(m.start(), m.end(), m.group().lower()) for m in WORD.finditer(t or "")]
        runs = [(tuple(w for _, _, w in at[k : k + n]), at[k][0], at[k + n - 1][1]) for k in range(len(at) - n + 1)]
        lost += [(i, a, b) for w, a, b in runs if w in seen and not any(x.id == i and x.start <= a and b <= x.end for x in got)]
        seen |= {w for w, _, _ in runs}
    return lost


def test_substrings_after_partial_quotes(spark):
    r = np.random.default_rng(5)
    new = lambda n: [f"w{x}" for x in r.integers(0, 10**6, n)]
    texts = []
    for _ in range(30):
        p = new(int(r.integers(52, 110)))
        for _ in range(4):  # quotes of a part come first
            a = int(r.integers(0, len(p) - 20))
            texts.append(new(40) + p[a : a + int(r.integers(6, 60))] + new(40))
        texts += [new(30) + p + new(30) for _ in range(3)]
    texts = [" ".join(t) for t in texts]
    got = substring_dedup.repeated_passages(docs(spark, texts)).collect()
    assert lost_runs(texts, got) == []


def test_near_substring_after_a_partial_quote(spark):
    r = np.random.default_rng(6)
    new = lambda n: [f"w{x}" for x in r.integers(0, 10**6, n)]
    p = new(64)
    q = p[:31] + ["other"] + p[32:]
    texts = [" ".join(t) for t in (new(40) + p[2:30] + new(6) + p[34:62] + new(40), new(40) + p + new(40), new(40) + q + new(40))]
    got = {(x.id, x.of) for x in substring_dedup.repeated_passages(docs(spark, texts)).collect()}
    assert (2, 1) in got


def test_near_substring_between_partial_quotes(spark):
    r = np.random.default_rng(6)
    new = lambda n: [f"w{x}" for x in r.integers(0, 10**6, n)]
    p = new(64)
    q = p[:31] + ["other"] + p[32:]
    quotes = lambda: [new(40) + p[a : a + 45] + new(40) for a in (0, 6, 12, 18, 19)]  # noqa: E731  too short for a passage, but each paragraph of p is in one
    texts = [" ".join(t) for t in (*quotes(), new(40) + p + new(40), *quotes(), new(40) + q + new(40))]
    got = {(x.id, x.of) for x in substring_dedup.repeated_passages(docs(spark, texts)).collect()}
    assert got == {(11, 5)}


def test_a_text_meets_a_tile_at_once():
    r = np.random.default_rng(8)
    new = lambda n: [f"w{x}" for x in r.integers(0, 10**6, n)]
    p = new(60)
    q = p[:20] + ["other"] + p[21:]
    short = [" ".join(new(40) + p[:30] + new(60)) for _ in range(199)]  # share too little for a passage
    texts = [*short, " ".join(new(40) + p + new(40)), " ".join(new(50) + q + new(30))]
    n = len(texts) - 1
    ps = [[]] * n + [list(range(n))]
    tile = pa.RecordBatch.from_pydict({"s": [0] * (n + 1), "i": [0] * (n + 1), "j": [0] * (n + 1), "node": list(range(n + 1)), "t": [0] * (n + 1), "role": [0] * n + [1], "ps": ps, "text": texts})
    calls = []

    def count(frame, event, what):
        if event == "c_call" and getattr(what, "__name__", "") == "searchsorted":
            calls.append(event)

    sys.setprofile(count)
    try:
        got = [(x["p"], x["node"], x["a"], x["b"]) for b in substring_dedup._compare_tiles(iter([tile])) for x in b.to_pylist()]
    finally:
        sys.setprofile(None)
    assert got == [(199, 200, 50, 110)]
    assert len(calls) < 50  # one for each pair before


def test_few_texts_move_for_a_few_nodes(spark):
    some = spark.range(0, 5000, 50).selectExpr("id node", "1 role")
    got = {r.id for r in substring_dedup._among(spark.range(5000).selectExpr("if(id = 7, null, id) id", "'' text"), some).collect()}
    assert set(range(0, 5000, 50)) <= got and len(got) < 400


def test_passage_with_a_run_that_the_first_text_repeats():
    r = np.random.default_rng(7)
    one, two = r.integers(1, 2**60, 200).astype(np.uint64), r.integers(1, 2**60, 140).astype(np.uint64)
    two[40:96] = one[100:156]  # a passage of 60 words
    one[72] = one[128]  # its middle run, 30 words before it
    assert substring_dedup.passages(one, two, 144) == [(40, 100)]
    two[60] = 7  # and with an edit it is no longer equal
    assert substring_dedup.passages(one, two, 144) == [(40, 100)]


def luhn(d):
    return sum((lambda v: v - 9 if v > 9 else v)(int(c) * (1 + i % 2)) for i, c in enumerate(reversed(d))) % 10 == 0


def test_personal_data(spark):
    texts = ["mail a.b@c.example.org or x_y@d.co_z@e.fr now", "ip 1.2.3.4 and 300.1.1.1 and 9.8.7.6.5", "card 4111 1111 1111 1111 or 4111111111111112", "call +1 (743) 555-3824 ok +12", None, "", "4539578763621486 4485275742308327 end", "\U0001f600 7.7.7.7", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" x']
    model = pii.fit(docs(spark, texts))
    rows = docs(spark, texts).select("doc_id", pii.spans(common.F.col("text"), model).alias("s")).collect()
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    for row in rows:
        want = []
        for k, pattern in enumerate(plain.values()):
            for m in re.finditer(pattern, texts[row.doc_id] or ""):
                d = re.sub("[^0-9]", "", m.group())
                if k == 1 and any(int(x) > 255 for x in m.group().split(".")) or k == 2 and not (12 <= len(d) <= 19 and luhn(d)) or k == 3 and not 9 <= len(d) <= 15:
                    continue
                want.append((m.start(), k, m.end()))
        assert sorted((x.start, x.k, x.end) for x in row.s if x.base) == sorted(want)
    out = {r.doc_id: r.text for r in pii.redact(docs(spark, texts)).collect()}
    assert out[1].startswith("ip [ip] and 300.1.1.1") and out[4] is None and out[5] == "" and "[secret]" in out[8]


def test_shards(spark):
    rows = [(i, f"t{i}", None if i % 10 == 9 else "hot" if i % 3 else f"s{i % 4}", 1) for i in range(101)] + [(None, None, "hot", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, shard int")
    got = sharding.interleave(df, 8).collect()
    sizes = [sum(r.shard == k for r in got) for k in range(8)]
    assert len(got) == 102 and max(sizes) - min(sizes) <= 1
    for k in range(8):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sizes[k]))
    for src in {r.source for r in got}:
        n = sum(r.source == src for r in got)
        assert all(abs(sum(r.source == src for r in got if r.shard == k) - n / 8) <= 1.5 for k in range(8))
    assert all(r.text_crc32 == zlib.crc32((f"t{r.doc_id}" if r.doc_id is not None else "").encode()) for r in got)
    assert sharding.interleave(df.limit(0)).count() == 0


def test_toxicity(spark):
    r = np.random.default_rng(3)
    texts, labels = [], []
    for i in range(600):
        ws = [f"w{x}" for x in r.integers(0, 400, 40)]
        bad = i % 3 == 0
        texts.append(" ".join(ws[:20] + (["horrid", "nasty"] if bad else []) + ws[20:]))
        labels.append((i, int(bad)))
    texts += [None, ""]
    df = docs(spark, texts)
    lab = spark.createDataFrame([*labels, (600, None)], "doc_id long, toxic int")
    got = {x.doc_id: x.score for x in toxicity.score(df, toxicity.fit(df, lab)).collect()}
    out = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(got[i] >= 0.7) == bool(labels[i][1]) for i in out]) > 0.97
    assert got[600] == got[601] and all(0 <= v <= 1 for v in got.values()) and len(got) == 602
    none = toxicity.fit(df, lab.limit(0))
    assert math.isfinite(none[0]) and toxicity.score(df.limit(0), none).count() == 0


def test_digest():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
