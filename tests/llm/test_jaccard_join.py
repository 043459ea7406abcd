import random
import re

from tessella.llm import jaccard_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    ws = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else ({tuple(ws)} if ws else set())


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets if i is not None}


def corpus(seed, groups, size, edits):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    passage = r.sample(vocab, 40)
    rows = []
    for _ in range(groups):
        base = [r.choice(vocab) for _ in range(r.randint(30, 90))] + passage
        for _ in range(size):
            t = list(base)
            for _ in range(r.randint(0, edits)):
                t[r.randrange(len(t))] = r.choice(vocab)
            rows.append((len(rows), " ".join(t)))
    return rows


def result(spark, rows):
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n int").repartition(3)
    return jaccard_join.jaccard_classes(df)


def test_equals_brute_force(spark):
    rows = corpus(1, 12, 9, 6)
    rows += [(5000, None), (5001, ""), (5002, "A b"), (5003, "a B"), (5004, "one"), (5005, rows[0][1]), (5006, rows[0][1].upper())]
    got = {r.id: (r.n_shingles, r.component) for r in result(spark, rows).collect()}
    assert got == brute(rows)


def test_large_regions_recurse_exactly(spark, monkeypatch):
    rows = corpus(2, 2, 60, 9)
    for block, crowd in ((6, 2048), (10, 5)):
        monkeypatch.setattr(jaccard_join, "BLOCK", block)
        monkeypatch.setattr(jaccard_join, "CROWD", crowd)
        got = {r.id: (r.n_shingles, r.component) for r in result(spark, rows).collect()}
        assert got == brute(rows)


def test_null_ids_repeated_rows_and_empty_table(spark):
    text = " ".join(f"v{i}" for i in range(30))
    got = result(spark, [(7, text), (7, text), (None, text), (None, None)]).collect()
    assert sorted((r.id is None, r.n_shingles, r.component) for r in got if r.n_shingles) == [(False, 26, 7), (False, 26, 7), (True, 26, 7)]
    assert [r.component for r in got if not r.n_shingles] == [None]
    assert result(spark, []).count() == 0
