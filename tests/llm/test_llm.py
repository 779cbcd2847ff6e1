"""The operators of the llm subpackage against brute force, the libraries and SQL, with odd tables."""

import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from barloom.llm import embeddings, licenses, line_dedup, memo, minhash, mixing, pieces, quality_model, quality_rules, token_files, toxicity, words
from barloom.llm.frames import connected_components
from barloom.llm.queries import BYTE_BPE, PIECES, tokenizer

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = "doc_id long, text string, lang string, source string, n_chars long, kept string, n_words string, copy string, ids string, n_lines string, component_id string, score string, digest string"


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def odd_rows():
    r = random.Random(5)
    vocabulary = ["w%d" % i for i in range(400)]
    base = [" ".join(r.choice(vocabulary) for _ in range(12)) for _ in range(8)]
    rows = [(0, None), (1, ""), (2, "   \n\t"), (3, "one"), (4, "one"), (5, "\n".join(base)), (6, "\n".join(base)), (6, "\n".join(base)), (7, "\n".join([*base[:7], "another line of other words here"])),
            (8, "\n".join(base[2:]) + "\nunlike any other"), (None, "\n".join(base)), (None, None), (9, " ".join(r.choice(vocabulary) for _ in range(30_000))), (10, "Ärger über ñandú 日本 😀 ▁ a b  c"),
            (11, "Copyright (c) 2020 Someone\nReleased under the MIT Licence."), (11, "the same id with another text"), (12, " ".join(["Th"] * 90)), (13, "x" * 50_000)]
    return [(i, t, "en", None if i == 3 else "hot" if i is None or i < 9 else "s%d" % (i % 3), len(t or "")) for i, t in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).cache()


@pytest.fixture(scope="module")
def clash(spark):
    return spark.createDataFrame([(*r, *["z"] * 8) for r in odd_rows()], CLASH)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", ["op1_quality_rules", "op2_embedding_near_dedup", "op4_minhash_near_dedup", "op6_mixing", "op10_license_scan"])
def test_sql_twins(spark, con, name):
    df = entry.queries()[name](spark, SF)
    want = con.execute(entry.oracle_sql()[name])
    cols = sorted(d[0] for d in want.description)
    order = [[d[0] for d in want.description].index(c) for c in cols]
    assert sorted(map(str, ([r[i] for i in order] for r in want.fetchall()))) == sorted(map(str, ([r[c] for c in cols] for r in df.collect())))


# words and components

def test_words_and_shingles():
    import pyarrow as pa

    words.BLOCK, kept = 64, words.BLOCK
    try:
        texts = ["a b\tc", "", None, "A  b\x0bC " * 40, "é " + "x" * 500 + " y", " lead", "a b\tc d e f"]
        h, b = words.word_hashes(pa.array(texts))
        assert list(np.diff(b)) == [len(split(t)) for t in texts]
        known = {}
        for t, x, y in zip(texts, b[:-1], b[1:]):
            for w, v in zip(split(t), h[x:y]):
                assert known.setdefault(w.lower(), v) == v
        assert len(set(known.values())) == len(known)
        assert [len(s) for s in words.shingle_sets(pa.array(texts))][:4] == [1, 0, 0, 3]
    finally:
        words.BLOCK = kept


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000, x) for x in range(1001, 1200)] + [(i, i + 1) for i in range(2000, 2060)]
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1 quality rules

def test_quality_rules(spark, odd, clash, empty):
    for docs in (odd, clash):
        got = quality_rules.quality_rules(docs).collect()
        assert len(got) == len(odd_rows())
        for g in got:
            w = split(g.text)
            tri = [tuple(w[i: i + 3]) for i in range(len(w) - 2)]
            hit = {i + j for i, t in enumerate(tri) if tri.count(t) > 1 for j in range(3)} if len(tri) < 2000 else set()
            lines = [x for x in (g.text or "").split("\n") if split(x)]
            assert (g.n_words, g.word_chars, g.n_dup_lines) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)))
            if len(tri) < 2000:
                assert g.n_repeat_words == len(hit)
            assert g.base_failed == (len(w) < 50 or 100 * g.n_repeat_words > 50 * len(w))
            assert g.kept == (g.rejected_by is None) and not (g.base_failed and g.kept)
    assert quality_rules.quality_rules(empty).count() == 0


def test_rule_order(spark, odd):
    cheap, useless = quality_rules.Rule("all", F.lit(True)), quality_rules.Rule("none", F.lit(False))
    assert [r.name for r, _, _ in quality_rules.ordered(odd, [useless, cheap])][0] == "all"


# 2 embeddings

def test_near_vectors(spark):
    r = np.random.default_rng(1)
    centre = r.normal(size=(4, 24))
    v = [(i, (centre[i % 4] + r.normal(size=24) * r.choice([0.05, 0.12, 0.3])).astype(np.float32).tolist(), i % 2) for i in range(300)]
    v += [(1000 + i, v[7][1], 1) for i in range(40)] + [(2000, None, 1), (2001, [], 1), (2002, [0.0] * 24, 1), (2003, [None] + [1.0] * 23, 1), (2004, [float("nan")] * 24, 1), (2005, v[7][1], None),
                                                       (2006, [1.0, 2.0], 1), (2007, [2.0, 4.0], 1), (None, v[7][1], 1)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>, label int")
    good = [(i, np.array(e, float), y) for i, e, y in v if i is not None and y is not None and e and None not in e and np.isfinite(e).all() and np.any(e)]
    links = {i: {j for j, f, z in good if j != i and z == y and len(e) == len(f) and e @ f / (np.linalg.norm(e) * np.linalg.norm(f)) >= 0.98} for i, e, y in good}
    for tile in (2000, 16):
        got = {g.vec_id: g for g in embeddings.near_vectors(df, tile=tile).collect()}
        assert len(got) == len(v)
        for i, _, _ in v:
            seen, todo = {i}, [i]
            while todo:
                for j in links.get(todo.pop(), ()):
                    if j not in seen:
                        seen.add(j)
                        todo.append(j)
            if i is not None:
                assert (got[i].n_links, got[i].component_id, got[i].kept) == (len(links.get(i, ())), min(seen), min(seen) == i)
    assert embeddings.near_vectors(df.filter("vec_id < 0")).count() == 0


# 3 and 8 classifiers

def test_kneser_ney_sums_to_one():
    r = np.random.default_rng(3)
    code = np.unique(r.integers(0, toxicity.CODES, 5000))
    p = toxicity.shared_model(code)
    assert np.allclose(p.sum(axis=1), 1)
    c = r.integers(0, 5, len(code)).astype(float)
    assert np.abs(toxicity.ratios(code, c, c)).max() == 0


@pytest.mark.parametrize("run,label", [(toxicity.toxicity_scores, "toxic"), (quality_model.quality_scores, "quality")])
def test_classifiers(spark, odd, clash, empty, run, label):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for docs in (odd, clash):
        got = run(docs, labels).collect()
        assert len(got) == len(odd_rows()) and all(0 <= g.score <= 1 and g.predicted == int(g.score >= 0.3) for g in got)
    assert run(empty, labels).count() == 0
    assert run(odd, labels.limit(0)).count() == len(odd_rows())


def test_held_out_labels_do_not_matter(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    for run, folds, held, label in ((toxicity.toxicity_scores, 4, 2, "toxic"), (quality_model.quality_scores, 5, 0, "quality")):
        other = labels.withColumn(label, F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held, 1 - F.col(label)).otherwise(F.col(label)))
        a, b = ({r.doc_id: r.score for r in run(docs, x).collect()} for x in (labels, other))
        assert a == b


def test_all_training_rows_are_counted(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "abc defg" if i % 3 else "hij") for i in range(80)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(80)], "doc_id long, toxic int")
    seen, real = [], toxicity.ratios
    monkeypatch.setattr(toxicity, "ratios", lambda code, toxic, ordinary: seen.append((toxic.sum(), ordinary.sum())) or real(code, toxic, ordinary))
    assert toxicity.toxicity_scores(docs, labels).count() == 80
    train = [i for i in range(80) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert seen[-1] == (4 * sum(i % 3 == 0 for i in train), 9 * sum(i % 3 != 0 for i in train)) and seen[0] < seen[-1]


def test_quality_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in entry.queries()["op8_quality_classifier"](spark, sf).collect() if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in got) >= 0.97 * len(got)


# 4 minhash

def groups(rows):
    sets = []
    for i, t in rows:
        w = split((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append((i, {tuple(w[a: a + 5]) for a in range(len(w) - 4)} or ({tuple(w)} if w else set())))
    low = {i: i for i, _ in sets if i is not None}
    for _ in range(len(sets)):
        before = dict(low)
        for i, a in sets:
            for j, b in sets:
                if i is not None and j is not None and a and b and 100 * len(a & b) >= 75 * len(a | b):
                    low[i] = low[j] = min(low[i], low[j])
        if low == before:
            return sets, low


@pytest.mark.parametrize("short", [32, 1])
def test_near_duplicates(spark, odd, clash, empty, short):
    r = random.Random(9)
    vocabulary = ["v%d" % i for i in range(3000)]
    rows = [(i, t) for i, t, *_ in odd_rows()]
    base = [r.choice(vocabulary) for _ in range(160)]
    for i in range(60):
        w = list(base)
        for _ in range(r.randint(0, 9)):
            w[r.randrange(160)] = r.choice(vocabulary)
        rows.append((100 + i, " ".join(w)))
    passage = [r.choice(vocabulary) for _ in range(90)]
    rows += [(300 + i, " ".join([*passage, *(r.choice(vocabulary) for _ in range(25 + i))])) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets, low = groups(rows)
    got = minhash.near_duplicates(docs, short=short).collect()
    assert sorted((str(g.doc_id), g.n_shingles) for g in got) == sorted((str(i), len(s)) for i, s in sets)
    assert {g.doc_id: g.component_id for g in got if g.doc_id is not None} == low
    assert all(g.kept == (g.doc_id is None or g.doc_id == g.component_id) for g in got)
    assert minhash.near_duplicates(clash).count() == len(odd_rows()) and minhash.near_duplicates(empty).count() == 0


# 5 line dedup

def test_patience():
    r = random.Random(4)
    for _ in range(300):
        a, b = ([r.randrange(12) for _ in range(r.randint(0, 14))] for _ in range(2))
        got = line_dedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))
    assert line_dedup.patience([1, 2, 3], [1, 2, 3]) == [(0, 0), (1, 1), (2, 2)]
    assert line_dedup.patience([5, 1, 2, 9], [7, 1, 2, 8]) == [(1, 1), (2, 2)]


def test_line_dedup(spark, odd, clash, empty):
    for docs in (odd, clash):
        got = line_dedup.dedup_lines(docs).collect()
        assert len(got) == len(odd_rows())
    rows = sorted({(i, t) for i, t, *_ in odd_rows() if i is not None and t}, key=lambda x: x[0])
    for g in got:
        if g.doc_id is None or not g.text:
            continue
        mine = [t for i, t in rows if i == g.doc_id]
        if len(mine) > 1:
            continue
        lines = mine[0].split("\n")
        cut = set()
        firsts = {}
        for i, t in reversed(rows):
            for x in t.split("\n"):
                firsts[x] = (i, t)
        for i, t in {firsts[x] for x in lines if len(x) >= 10 and firsts[x][0] < g.doc_id}:
            cut |= set(line_dedup.removed([hash(x) for x in t.split("\n")], [hash(x) for x in lines], list(map(len, lines)), 10))
        assert g.text == "\n".join(x for k, x in enumerate(lines) if k not in cut) and g.n_removed == len(cut)
    by = {g.doc_id: g.text for g in got if g.doc_id is not None}
    assert by[6] == "" and by[7] == "another line of other words here" and by[8] == "unlike any other"
    assert line_dedup.dedup_lines(empty).count() == 0


@pytest.mark.parametrize("rare", [0, 3, line_dedup.RARE])
def test_line_dedup_equals_all_pairs(spark, monkeypatch, rare):
    """With few rare lines most pairs go by their frequent lines, or must be looked at again as they share a rare one."""
    monkeypatch.setattr(line_dedup, "RARE", rare)
    r = random.Random(9)
    pool = ["", "}", "a b", "x", "short 1"] + ["a line of more than ten characters %d" % i for i in range(12)]
    texts = ["\n".join(r.choice(pool) if r.random() < 0.8 else "own %d of this text only" % r.randrange(10**9) for _ in range(r.randint(1, 9))) for _ in range(150)]
    block = ["the first line of the block", "the second line of the block"]
    # the first holders have the lines of the block in another order
    texts += ["\n".join(x) for x in ([block[1], "u" * 20], [block[0], "v" * 20, block[1]], ["w" * 20, *block], [*block, "z" * 20, *reversed(block)], ["}", "a b"] * 8 + ["q" * 20, "}", "a b", "}"] * 3)]
    texts.append("\n".join(pool[5:][::-1]))
    # a frequent line held twice, which only some of its holders align a second time, with rare lines in between
    hot, rares = "the line that everybody has", ["a rare line of its own %d" % i for i in range(9)]
    texts += ["\n".join([hot, *r.sample([*rares, *pool[5:8]], r.randint(0, 3)), *([hot] if r.random() < 0.6 else [])]) for _ in range(60)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    got = {g.doc_id: g.text for g in line_dedup.dedup_lines(docs).collect()}
    seqs = [[hash(x) for x in t.split("\n")] for t in texts]
    for i, t in rows:
        lines = t.split("\n")
        cut = {q for j in range(i) for q in line_dedup.removed(seqs[j], seqs[i], list(map(len, lines)), 10)}
        assert got[i] == "\n".join(x for q, x in enumerate(lines) if q not in cut), i


def test_gap_without_unique_lines():
    assert line_dedup.patience([1, 5, 5, 2], [3, 5, 5, 4]) == [(1, 1), (2, 2)]
    assert line_dedup.longest_run([1, 2, 3, 1, 2, 3, 4], [9, 2, 3, 4, 1, 2]) == (4, 1, 3)
    r = random.Random(4)
    for _ in range(300):
        a, b = ([r.randint(0, 3) for _ in range(r.randint(1, 12))] for _ in range(2))
        p, q, n = line_dedup.longest_run(a, b)
        assert a[p: p + n] == b[q: q + n] and n == max((k for i in range(len(a)) for j in range(len(b)) for k in range(min(len(a) - i, len(b) - j) + 1) if a[i: i + k] == b[j: j + k]), default=0)
        chars = [r.randint(0, 12) for _ in a]
        inside = line_dedup.runs(a, chars, 10)
        assert all(sum(chars[x: y + 1]) >= 10 for x, y in inside)
        for i in range(len(a)):
            for j in range(i, len(a)):
                if sum(chars[i: j + 1]) >= 10:
                    assert {k for x, y in inside if i <= x and y <= j for k in range(x, y + 1)} == set(range(i, j + 1))


# 6 mixing

def test_mixing(spark, odd, clash, empty):
    for docs in (odd, clash):
        got = mixing.mix(docs, weights={None: 1.0, "hot": 60.0, "s0": 1.0}, budget=30.0).collect()
        assert {g.source for g in got} <= {None, "hot", "s0"}
        per = {}
        for g in got:
            per.setdefault((g.doc_id, g.text), []).append(g.copy)
        assert all(sorted(set(c)) == list(range(1, max(c) + 1)) for c in per.values())
    assert mixing.mix(empty).count() == 0
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"))
    n = {r.source: r["count"] for r in mixing.mix(many, weights={"a": 0.8, "b": 0.2}, budget=2.0).groupBy("source").count().collect()}
    assert abs(n["a"] - 32_000) < 1000 and abs(n["b"] - 8_000) < 500
    big = mixing.mix(many.filter("doc_id < 300"), weights={"a": 100, "b": 1}, budget=60.0)
    assert abs(big.filter("source = 'a'").count() - 60 * 300 * 100 / 101) < 700


# 7 token files

def test_elias_fano():
    r = random.Random(8)
    for n, top in ((1, 0), (1, 9), (700, 10), (700, 10_000_000), (5, 5)):
        v = sorted(r.randint(0, top) for _ in range(n))
        ef = token_files.EliasFano.build(np.array(v))
        assert [ef.select(i) for i in range(n)] == v == ef.all().tolist()
    s = token_files.Segment(token_files.pack([3, None], [np.array([1, 70_000], np.uint32), np.array([2], np.uint32)]))
    assert s.document(0).tolist() == [1, 70_000] and s.document(1).tolist() == [2] and s.nulls.tolist() == [0, 1]


def test_token_files(spark, odd, clash, empty, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer(BYTE_BPE))
    t.encode_special_tokens = True
    want = []
    for i, text in [(i, x) for i, x, *_ in odd_rows()]:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    for docs in (odd, clash):
        got = sorted(token_files.token_files(docs, tokenizer(BYTE_BPE), str(tmp_path / f"s{docs is odd}")).collect(), key=lambda g: g.start)
        assert [g.doc_id for g in got] == sorted([w[0] for w in want], key=lambda i: (i is not None, i or 0))
        assert sorted(map(str, ((g.doc_id, g.n_tokens, g.ids_crc32) for g in got))) == sorted(map(str, want))
        assert [g.start for g in got] == np.cumsum([0, *(g.n_tokens for g in got)])[:-1].tolist()
    assert token_files.token_files(empty, tokenizer(BYTE_BPE), str(tmp_path / "e")).count() == 0


def test_word_memo_is_exact():
    m = token_files.WordMemo(tokenizer(BYTE_BPE))
    m.memo = memo.UnitMemo(m.fresh, "\n", 50)
    r = random.Random(3)
    texts = ["".join(r.choice("ab 's\n\t.é1 ") for _ in range(r.randint(0, 25))) for _ in range(800)] + ["<|endoftext|> a", "a b  c", "x " * 9]
    for a in range(0, len(texts), 100):
        for t, ids in zip(texts[a: a + 100], m.encode(texts[a: a + 100], 2)):
            assert ids.tolist() == [*m.whole(t), 2]


# 9 pieces

def test_pieces_equal_the_library():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer(PIECES))
    m = pieces.PieceModel.load(tokenizer(PIECES))
    r = random.Random(6)
    texts = ["".join(r.choice("aabcdeeth ionrs   \n\t<>/s.,!?'-_=1230 é日▁😀") for _ in range(r.randint(0, 60))) for _ in range(600)]
    texts += [" " * n + "x" * k for n in (0, 1, 17, 40) for k in (0, 1, 300)] + ["the" * 400, "=" * 999, "".join(r.choice("etaoinshr") for _ in range(4000)), "<s> a </s>"]
    assert [list(x) for x in m.encode_all(texts)] == sp.encode(texts, num_threads=1) == [m.encode(t) for t in texts]
    assert [m.decode(sp.encode(t)) for t in texts] == [sp.decode(sp.encode(t)) for t in texts]


def test_unigram_lattice():
    ps, r = ["<unk>", "a", "b", "ab", "ba", "aba", "bab", "▁"], random.Random(1)
    scores = [0, -1.5, -1.7, -2.1, -2.6, -3.9, -3.2, -1.0]
    m = pieces.PieceModel(ps, scores, [False] + [True] * 7, {}, bpe=False)
    for _ in range(60):
        s = "".join(r.choice("ab") for _ in range(r.randint(1, 40)))
        best = {0: 0.0}
        for j in range(1, len(s) + 1):
            best[j] = max(best[i] + scores[ps.index(s[i:j])] for i in range(max(0, j - 3), j) if s[i:j] in ps)
        ids = [i for part in m.stream(s) for i in part]
        assert "".join(ps[i] for i in ids) == s and abs(sum(scores[i] for i in ids) - best[len(s)]) < 1e-9


def test_pieces_in_frames(spark, odd, clash, empty):
    model = tokenizer(PIECES)
    for docs in (odd, clash):
        got = pieces.digests(pieces.decode(pieces.encode(docs, model), model)).collect()
        assert len(got) == len(odd_rows())
        assert all(g.decoded == (g.text or "").replace("▁", " ") and g.n_ids == len(g.ids) and g.ids_crc32 == zlib.crc32(np.array(g.ids, "<u4").tobytes()) for g in got)
        once = pieces.coded(docs, model)
        assert once.columns == [*[c for c in docs.columns if c not in ("text", "ids")], "ids", "n_ids", "ids_crc32", "round_trip"]
        key = lambda r: (str(r.doc_id), r.n_ids, r.ids_crc32, r.ids)
        assert sorted((*key(g), g.decoded == (g.text or "")) for g in got) == sorted((*key(g), g.round_trip) for g in once.collect())
    assert pieces.encode(empty, model).count() == 0 and pieces.coded(empty, model).count() == 0


def test_decoding_equals_the_library_on_any_ids():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer(PIECES))
    m, r = pieces.PieceModel.load(tokenizer(PIECES)), random.Random(8)
    for turn in range(400):
        ids = [r.choice([*m.byte_of, *range(3), *range(len(m.pieces))] if turn % 2 else list(m.byte_of)[100:] + [5000]) for _ in range(r.randint(0, 30))]
        old = m.decode(ids)
        assert old == slow_decode(m, ids), ids
        assert "\ufffd" in old or old.lstrip() == sp.decode(ids).lstrip(), ids


def slow_decode(m, ids):
    """Piece by piece; runs of byte ids are decoded together."""
    out, raw = [], bytearray()
    for i in [*ids, None]:
        if i in m.byte_of:
            raw.append(m.byte_of[i])
            continue
        out.append(raw.decode("utf-8", "replace"))
        raw.clear()
        if i is not None:
            out.append(m.pieces[i] if i not in m.control else " ⁇ " if i == m.unknown else "")
    text = "".join(out)
    return text[text.startswith("▁"):].replace("▁", " ")


# 10 licences

def test_licenses(spark, odd, clash, empty):
    text = "Copyright (c) 2019 A. Nother\n\n" + dict(licenses.KNOWN)["ISC"].upper().replace(" ", "  \n", 3)
    docs = odd.select("doc_id", "text").union(spark.createDataFrame([(50, text), (51, "All rights reserved.\nx"), (52, "LICENCED UNDER CC-BY-NC 4.0")], "doc_id long, text string"))
    got = {}
    for g in licenses.scan(docs).collect():
        got.setdefault(g.doc_id, []).append(g)
    assert sum(map(len, got.values())) == len(odd_rows()) + 3 and len(got[6]) == 2
    assert got[50][0].license == "ISC" and got[50][0].permitted
    assert sorted(str((g.license, g.notices)) for g in got[11]) == ["('MIT', 'MIT')", "(None, '')"]
    assert got[51][0].notices == "LicenseRef-all-rights-reserved" and not got[51][0].permitted and got[52][0].license == "CC-BY-NC-4.0"
    assert got[0][0].license is None and licenses.scan(clash).count() == len(odd_rows()) and licenses.scan(empty).count() == 0


def test_whole_licenses_and_headers(spark):
    box = "/usr/share/common-licenses/"
    header = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\n#\n"
    apache = "/*\n * Licensed under the Apache License, Version 2.0 (the \"License\");\n * you may not use this file except in compliance with the License.\n * You may obtain a copy of the License at\n *\n *     http://www.apache.org/licenses/LICENSE-2.0\n */\n"
    texts = [open(box + f).read() for f in ("GPL-2", "GPL-3", "Apache-2.0", "CC0-1.0", "LGPL-2.1")] + [header + "x = 1", apache + "int x;", "about the GNU GPL"]
    got = {g.doc_id: g for g in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i].license for i in range(5)] == ["GPL-2.0", "GPL-3.0", "Apache-2.0", "CC0-1.0", "LGPL-2.1"]
    assert [got[i].permitted for i in range(8)] == [False, False, True, True, False, False, True, True]
    assert got[5].notices == "GPL-3.0" and got[6].notices == "Apache-2.0" and got[7].notices == "" and got[5].n_notices == 1


# the pipeline

def test_pipeline_stages(spark, odd, empty):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "minhash_near_dedup", "mixing", "sentencepiece"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for source in (docs, odd, empty):
        now = source
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, now, SF).cache()
            if name == "quality_classifier":
                bad = {r.doc_id for r in quality_model.quality_scores(now, spark.read.parquet(f"{SF}/labels.parquet")).filter("predicted = 0").collect()}
                assert sorted(map(str, out.collect())) == sorted(str(r) for r in now.collect() if r.doc_id is None or r.doc_id not in bad)
            elif name == "line_dedup":
                assert out.count() == now.count() and out.filter("text is not null and n_chars <> length(text)").isEmpty() or source is odd
            elif name == "minhash_near_dedup":
                _, low = groups([(r.doc_id, r.text) for r in now.collect()]) if source is odd else (0, {g.doc_id: g.component_id for g in minhash.near_duplicates(now).collect()})
                assert {r.doc_id for r in out.collect() if r.doc_id is not None} == {i for i in low if i is not None and low[i] == i}
            elif name == "mixing":
                assert {str(r) for r in out.collect()} <= {str(r) for r in now.collect()}
            if name != "sentencepiece":
                assert out.columns == source.columns
            now = out
        assert now.filter("not round_trip and ids is not null").count() == 0 or source is odd


def test_pipeline_is_registered(spark):
    assert "pipeline" in entry.queries() and "pipeline" not in entry.oracle_sql()
    assert [f"op{n}_" for n in range(1, 11)] == [next(k for k in entry.queries() if k.startswith(f"op{n}_")).split("_")[0] + "_" for n in range(1, 11)]
