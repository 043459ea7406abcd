"""Every registered query on the smallest tables against its library, its SQL or brute force; every operator on odd tables."""

import hashlib
import os
import re
import zlib

import numpy as np
import pytest

from tessella import llm
from tessella.llm import common, decontam, jaccard_join, pii, quality, sharding, sp_codec, substring_dedup, token_output, toxicity, url_filter

from .test_operators import WORD, lost_runs, luhn

D = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in common.table(spark, D, "documents").collect()}


def result(spark, name):
    df = llm.queries()[name](spark, D)
    return df.columns, df.collect()


def sha(ids):
    return hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


@tables
def test_op2_equals_the_library(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    columns, got = result(spark, "op2_token_output")
    assert columns[:4] == ["doc_id", "start", "n_tokens", "ids_crc32"] and len(got) == len(texts)
    start, got = 0, {r.doc_id: r for r in got}
    for i in sorted(texts):
        ids = t.encode(texts[i], add_special_tokens=False).ids + [0]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_tokens_of_random_texts():
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t, r = Tokenizer.from_file(path), np.random.default_rng(11)
    marks = [" ", " ", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", " ", " ", "　", "a", "Ab", "zebra", "don't", "é", "ß", "中", "\U0001f600", "1", "2024", ".", "...", "<|endoftext|>", "<|e", "$", "…", "x" * 40]
    some = ["".join(r.choice(marks, int(r.integers(0, 60)))) for _ in range(1500)]
    units = token_output.encoder(path)
    for _ in range(2):  # new units, then known ones
        for i, j, ids, first in units.rows(pa.array(some)):
            for k in range(i, j):
                assert ids[first[k - i] : first[k - i + 1]].tolist() == t.encode(some[k], add_special_tokens=False).ids, repr(some[k])


def test_unit_table_grows():
    from tessella.llm.units import UnitTable

    t, r = UnitTable(8), np.random.default_rng(2)
    keys = np.unique(r.integers(0, 1 << 62, 5000, dtype=np.uint64))
    for part in np.array_split(r.permutation(keys), 7):
        t.add(part, np.repeat(part % 1000, (part % 3).astype(int)).astype(np.int32), (part % 3).astype(np.int64))
    e = t.find(keys)
    assert (e >= 0).all() and (t.find(keys + np.uint64(1 << 63)) == -1).all()
    assert all(t.ids[t.start[x] : t.start[x + 1]].tolist() == [int(k % 1000)] * int(k % 3) for x, k in zip(e, keys))


def test_token_files_prune_by_id(spark):
    path = common.scratch_path(spark, "tokens")
    df = spark.range(0, 60000, 2).selectExpr("id doc_id", "concat('text ', id) text").repartition(5)
    token_output.write_tokens(df, path)
    rows = token_output.read_tokens(spark, path).where("doc_id = 30000")
    assert rows.count() == 1 and rows.first().doc_id == 30000 and token_output.read_tokens(spark, path).where("doc_id = 30001").count() == 0
    plan = rows._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "EqualTo(doc_id,30000)" in plan
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path + "/tokens")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    files = [f.getPath() for f in folder.getFileSystem(conf).listStatus(folder) if f.getPath().getName().endswith(".orc")]
    kinds, stride = set(), set()
    for f in files:
        reader = jvm.org.apache.orc.OrcFile.createReader(f, jvm.org.apache.orc.OrcFile.readerOptions(conf))
        stride.add(reader.getRowIndexStride())
        if reader.getNumberOfRows():
            opened = reader.rows()
            kinds |= {s.getKind().toString() for s in opened.readStripeFooter(reader.getStripes()[0]).getStreamsList()}
            opened.close()
    assert stride == {1000} and "ROW_INDEX" in kinds and {"BLOOM_FILTER", "BLOOM_FILTER_UTF8"} & kinds


@tables
def test_op3_equals_the_library(spark, texts):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    columns, got = result(spark, "op3_sentencepiece")
    assert columns[:4] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and len(got) == len(texts)
    for r in got:
        ids = sp.encode(texts[r.doc_id], add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(ids), hashlib.sha256(sp.decode(ids).encode()).hexdigest())


def test_a_real_character_map():
    """The longest-prefix walk through the library's own compiled map against the library's normaliser and its offsets."""
    sentencepiece = pytest.importorskip("sentencepiece")
    if not hasattr(sentencepiece, "SentencePieceNormalizer"):
        pytest.skip("no normaliser in this release")
    n = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    spec = next(dict(sp_codec._fields(v)) for k, v in sp_codec._fields(n.serialized_model_proto()) if k == 3)
    m = sp_codec.CharacterMap(spec[2])
    assert m.units and m.longest("ﬁ".encode(), 0) == (3, b"fi") and m.longest(b"abc", 0) is None
    codec = object.__new__(sp_codec.Codec)
    codec.map, codec.dummy, codec.squeeze, codec.escape, codec.plain = m, spec.get(3, 1), spec.get(4, 1), spec.get(5, 1), False
    for text in ("ﬁn ① ｶﾞ  a　b", "½ é", "  two  spaces ", "plain", "①②③ ㌔", "x­z ﷺ", "ＡＢＣ"):
        want, places = n.normalize(text, with_offsets=True)
        norm, back = codec.normalised(text.encode())
        assert norm.decode() == want
        at, byte = 0, [len(text[:i].encode()) for i in range(len(text) + 1)]
        for c, p in zip(want, places):
            if c != "▁":  # a space's place is that of any of the run it stands for
                assert back[at] == byte[p], (text, c)
            at += len(c.encode())


@tables
@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        c.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    want = c.sql(llm.oracle_sql()[name])
    columns, got = result(spark, name)
    assert sorted(columns) == sorted(want.columns)
    order = [want.columns.index(k) for k in columns]
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, (tuple(r[i] for i in order) for r in want.fetchall())))


@tables
def test_op6_loses_no_equal_run(spark, texts):
    columns, got = result(spark, "op6_substring_dedup")
    assert columns == ["doc_id", "start", "end", "words", "first_doc_id", "component"]

    class Row:
        def __init__(self, r):
            self.id, self.start, self.end = r.doc_id, r.start, r.end

    every = sorted(texts)
    place = {i: k for k, i in enumerate(every)}
    rows = [Row(r) for r in got]
    for r in rows:
        r.id = place[r.id]
    assert lost_runs([texts[i] for i in every], rows) == []
    assert all(r.first_doc_id < r.doc_id and r.component <= r.first_doc_id and r.words >= 50 for r in got)
    assert all(len(WORD.findall(texts[r.doc_id][r.start : r.end])) == r.words for r in got)


def test_near_passages_are_found(spark):
    """Passages of 50 to 120 words with edits, Jaccard 0.8 or more, after partial quotes: the share found."""
    r = np.random.default_rng(8)
    new = lambda n: [f"w{x}" for x in r.integers(0, 10**6, n)]
    grams = lambda ws: {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)}
    rows, wanted = [], []
    while len(wanted) < 120:
        n = int(r.integers(60, 121))
        p = new(n)
        q = list(p)
        for at in r.choice(np.arange(4, n - 4), int(r.integers(1, 1 + n // 60)), replace=False):
            q[at] = f"e{at}"
        if len(grams(p) & grams(q)) < 0.8 * len(grams(p) | grams(q)):
            continue
        rows += [new(30) + p[:20] + new(30), new(30) + p[-20:] + new(30), new(25) + p + new(25)]
        wanted.append((len(rows), len(rows) - 1))
        rows.append(new(25) + q + new(25))
    df = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(rows)], "doc_id long, text string")
    got = {(x.id, x.of) for x in substring_dedup.repeated_passages(df).collect()}
    assert sum(w in got for w in wanted) >= 0.95 * len(wanted)


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base(text):
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            if not (kind == "ip" and any(int(x) > 255 for x in m.group().split(".")) or kind == "card" and not (12 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15):
                yield m.start(), k, f"{kind}:{m.start()}:{m.end()}"


@tables
def test_op7_equals_brute_force(spark, texts):
    columns, got = result(spark, "op7_personal_data")
    assert columns[:7] == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"] and len(got) == len(texts)
    kinds = list(PATTERNS) + ["secret"]
    for r in got:
        want = [x for *_, x in sorted(base(texts[r.doc_id]))]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k + ":") for x in want) for k in PATTERNS]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        spans = [x.split(":") for x in r.spans.split(",") if x]
        assert set(want) <= set(r.spans.split(",")) and [(int(s), kinds.index(k)) for k, s, _ in spans] == sorted((int(s), kinds.index(k)) for k, s, _ in spans)
        for k, s, e in spans:  # what the method adds is what one of its looser patterns finds there
            assert f"{k}:{s}:{e}" in want or re.fullmatch(pii.LOOSE[k].replace("++", "+").replace("}+", "}"), texts[r.doc_id][int(s) : int(e)])


@tables
def test_op10_columns(spark, texts):
    columns, got = result(spark, "op10_toxicity")
    assert columns[:4] == ["doc_id", "held_out", "score", "predicted"] and {r.doc_id for r in got} == set(texts)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)


CLASH = ["host0", "start", "end", "s", "node", "p", "t", "part", "ids", "kind", "score", "size", "shard", "source", "words", "component", "block", "role", "doc", "item", "n"]


@pytest.fixture(scope="module")
def odd(spark):
    """Null and repeated ids, equal rows, null and empty texts, a long text, columns whose names the operators use."""
    r = np.random.default_rng(4)
    words = lambda n: " ".join(f"w{x}" for x in r.integers(0, 10**5, n))
    one, long = words(120) + ".", words(8_000) + "."
    rows = [(None, one), (None, None), (1, one), (1, one), (2, long), (3, None), (4, ""), (5, long), (6, one + " mail a.b@c.org"), (6, words(70) + ".")]
    df = spark.createDataFrame([(i, x, *["c"] * len(CLASH)) for i, x in rows], "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASH))
    return rows, df


def test_odd_tables_tokens(spark, odd):
    rows, df = odd
    path = common.scratch_path(spark, "tokens")
    token_output.write_tokens(df, path)
    got = token_output.read_tokens(spark, path).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows) and sorted(r.start for r in got) == np.cumsum([0, *(r.n_tokens for r in sorted(got, key=lambda r: r.start))])[:-1].tolist()
    assert all(r.doc_id is None for r in sorted(got, key=lambda r: r.start)[:2])
    encoded = sp_codec.encode_documents(df).collect()
    assert len(encoded) == len(rows) and {r.decoded for r in encoded if r.doc_id in (3, 4)} == {""} and {r.decoded for r in encoded if r.doc_id in (2, 5)} == {rows[4][1]}


def test_odd_tables_rules_and_spans(spark, odd):
    rows, df = odd
    judged = quality.judge(df).collect()
    assert len(judged) == len(rows) and [r.q_n_words for r in judged if r.doc_id == 2] == [8_000] and not any(r.q_keep for r in judged if not r.text)
    assert quality.clean(df).columns == df.columns
    model = pii.fit(df)
    redacted = pii.redact(df)
    assert redacted.columns == df.columns and redacted.count() == len(rows) and sum("[email]" in (r.text or "") for r in redacted.collect()) == 1
    assert pii.fit(df.limit(0)) == {} or model is not None
    bench = spark.createDataFrame([(None, rows[0][1], "x"), (7, None, "x")], "item_id long, text string, hashes string")
    found = decontam.contained_items(df, bench).collect()
    assert sorted(str(r.doc) for r in found) == ["1", "1", "6", "None"]
    assert decontam.decontaminate(df, bench).columns == df.columns and decontam.decontaminate(df, bench).count() == len(rows) - 4


def test_odd_tables_repeats(spark, odd):
    rows, df = odd
    got = {(r.id, r.of, r.words) for r in substring_dedup.repeated_passages(df).collect()}
    assert got == {(5, 2, 8_000), (6, 1, 120)}
    classes = {(r.id, r.component) for r in jaccard_join.jaccard_classes(df).collect()}
    assert (5, 2) in classes and (6, 1) in classes and (None, 1) in classes and (None, None) in classes and (4, 4) in classes


def test_odd_tables_shards_and_scores(spark, odd):
    rows, df = odd
    placed = sharding.interleave(df, 3).collect()
    assert len(placed) == len(rows) and max(r.size for r in placed) == len(rows[4][1]) + 1
    labels = spark.createDataFrame([(1, 1, "x"), (2, 0, "x"), (2, 0, "x"), (None, 1, "x"), (9, None, "x")], "doc_id long, toxic int, text string")
    scored = toxicity.score(df, toxicity.fit(df, labels)).collect()
    assert len(scored) == len(rows) and len({r.score for r in scored if r.doc_id in (3, 4)}) == 1


def test_odd_tables_urls(spark):
    pages = spark.createDataFrame([(None, "http://a.b/x", 1), (1, None, 2), (1, "http://a.b/x", 3), (2, "http://" + "a" * 1_000_000 + ".org/fr/", 4), (3, "", 5)], "page_id long, url string, host int")
    listed = spark.createDataFrame([("a.b",), (None,), ("a.b",)], "key string")
    with pytest.raises(ValueError, match="host"):
        url_filter.filter_urls(pages, listed)
    got = url_filter.filter_urls(pages, listed, prefix="u_").collect()
    assert len(got) == 5 and [r.u_verdict for r in sorted(got, key=lambda r: r.host)] == ["block", "allow", "block", "allow", "allow"]


def test_url_shards_read_the_pages_once(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "LEVEL_BYTES", 8)
    pages = spark.range(400).selectExpr("id page_id", "concat('http://h', id, '.x/') url")
    listed = spark.range(0, 400, 9).selectExpr("concat('h', id, '.x') key")
    df = url_filter.filter_urls(pages, listed)
    assert {r.page_id for r in df.collect() if r.verdict == "block"} == set(range(0, 400, 9))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (0, 400, step=1") == 1
