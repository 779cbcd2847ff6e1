"""Merkle manifest, spelling variants and language identification against brute force and SQL, with odd tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from barloom.llm import language, manifest, spelling
from barloom.llm.frames import CRC_TABLE, crc_sql, numbered
from tests.llm.test_llm import CLASH, SCHEMA, SF, odd_rows


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).cache()


@pytest.fixture(scope="module")
def clash(spark):
    return spark.createDataFrame([(*r, *["z"] * 8) for r in odd_rows()], CLASH)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_spelling_variants"])
def test_sql_twins(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = entry.queries()[name](spark, SF)
    want = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, want.fetchall())) == sorted(map(str, (tuple(r[c] for c in names) for r in df.collect())))


def test_crc_sql():
    for s in ["", "0", "12345", "Ärger:日本"]:
        assert duckdb.sql(f"WITH {CRC_TABLE} SELECT {crc_sql('?', 'crc_table.t')} FROM crc_table".replace("?", f"'{s}'")).fetchall()[0][0] == zlib.crc32(s.encode())


def test_numbered(spark):
    r = random.Random(1)
    rows = [(r.choice(["hot", "hot", "hot", "b", None]), r.choice([None, *range(300)])) for _ in range(3000)]
    got = numbered(spark.createDataFrame(rows, "g string, v long").repartition(6), ["v"], "g").collect()
    for g in ("hot", "b", None):
        mine = sorted((x["i"], -1 if x["v"] is None else x["v"]) for x in got if x["g"] == g)
        assert [i for i, _ in mine] == list(range(len(mine))) and {x["n"] for x in got if x["g"] == g} == {len(mine)}
        assert [v for _, v in mine] == sorted(v for _, v in mine)
    assert numbered(spark.createDataFrame([], "g string, v long"), ["v"], "g").count() == 0


# manifest

def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def frame(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][k: k + 3])) for k in range(0, len(out[-1]), 3)])
    return out


def brute_manifest(rows):
    """leaf, subroot, root, proof digest, folded root by the contract's words; rows are (doc_id, text, lang, source, n_chars)."""
    first = lambda v: (v is not None, v if v is not None else 0)
    leaves = [(source, doc_id, sha("".join(map(frame, (doc_id, source, lang, n, text)))),
               sha("".join(map(frame, (doc_id, source, lang, n, text.replace("\n", "") if text is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 else text)))))
              for doc_id, text, lang, source, n in rows]
    sources = sorted({x[0] for x in leaves}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: sorted((x for x in leaves if x[0] == s), key=lambda x: (first(x[1]), x[2])) for s in sources}
    built = {s: levels([x[2] for x in t]) for s, t in trees.items()}
    upper = levels([built[s][-1][0] for s in sources]) if sources else [[]]
    out = []
    for k, s in enumerate(sources):
        for i, (_, doc_id, leaf, tampered) in enumerate(trees[s]):
            h, beside = tampered, []
            for tree, at in ((built[s], i), (upper, k)):
                for level in tree[:-1]:
                    lo = at - at % 3
                    run = level[lo: lo + 3]
                    beside += run[: at - lo] + run[at - lo + 1:]
                    h = sha("".join([*run[: at - lo], h, *run[at - lo + 1:]]))
                    at //= 3
            out.append((doc_id, leaf, built[s][-1][0], upper[-1][0], sha("".join(beside)), h, h == upper[-1][0]))
    return out


def proofs_of(docs):
    text = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    m = manifest.manifest(docs, extra={"tampered": manifest.leaf_digest(*[text if c == "text" else F.col(c) for c in manifest.COLUMNS])})
    out = m.proofs().withColumn("folded", manifest.folded(F.col("tampered"), F.col("path")))
    return m, [(r["id"], r["digest"], r["subroot"], m.root, r["p"], r["folded"], r["folded"] == m.root) for r in out.withColumn("p", F.sha2(manifest.siblings(F.col("path")), 256)).collect()]


@pytest.mark.parametrize("deep", [1, 2, 7])
def test_manifest_equals_brute_force(spark, odd, deep, monkeypatch):
    monkeypatch.setattr(manifest, "LEVELS", deep)
    r = random.Random(deep)
    rows = odd_rows() + [(r.choice([i, i, 7]), f"line {i}\nand {i % 5}\n", None, r.choice(["hot", "hot", "s1", "ü", "", None, f"x{i}"]), i) for i in range(400)]
    _, got = proofs_of(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert sorted(map(str, got)) == sorted(map(str, brute_manifest(rows)))


def test_manifest_positions_are_those_of_the_log(spark, monkeypatch):
    """The log, sorted by position, is the postorder of the tree; positions have no gaps."""
    for n in (1, 2, 3, 4, 9, 10, 28, 81, 100):
        h = manifest.height(n)
        order = [(k, j) for k, j, _ in manifest.appended(["%064x" % i for i in range(n)], h)]
        assert [manifest.position(k, j, n) for k, j in order] == list(range(len(order)))
    monkeypatch.setattr(manifest, "LEVELS", 2)
    docs = spark.createDataFrame([(i, f"t{i}", "en", "one", i) for i in range(200)], SCHEMA)
    m = manifest.manifest(docs)
    rows = sorted((r["first"], bytes(r["digests"]).hex()) for r in m.log.collect())
    whole = list(manifest.appended([r["digest"] for r in m.leaves.orderBy("i").collect()], manifest.height(200)))
    assert "".join(d for _, d in rows) == "".join(d for _, _, d in whole)
    at = 0
    for first, d in rows:
        assert first == at
        at += len(d) // 64
    sql = spark.range(200).selectExpr("id", f"{manifest._position('1', 'id', '600L')} as p", f"{manifest._before('id')} as b", f"{manifest._height('id + 1')} as h").collect()
    assert all((r["p"], r["b"], r["h"]) == (manifest.position(1, r["id"], 600), manifest.before(r["id"]), manifest.height(r["id"] + 1)) for r in sql)


def test_manifest_odd_tables(spark, odd, clash, empty):
    assert proofs_of(empty)[1] == [] and manifest.manifest(empty).root is None
    assert sorted(map(str, proofs_of(odd)[1])) == sorted(map(str, proofs_of(clash)[1])) == sorted(map(str, brute_manifest(odd_rows())))
    one = [(5, "alone", None, None, None)]
    assert proofs_of(spark.createDataFrame(one, SCHEMA))[1] == brute_manifest(one)


# spelling

def brute_words(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(rows):
    n = brute_words(rows)
    by_length = {}
    for w in n:
        by_length.setdefault(len(w), []).append(w)
    links = {w: [v for k in (-1, 0, 1) for v in by_length.get(len(w) + k, []) if near(w, v)] for w in n}
    form = {}
    for w, around in links.items():
        best = min(around, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(links[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=str)


def variant_rows(seed):
    r = random.Random(seed)
    base = ["spelling", "commonest", "aaaaaaaa", "Ärgerlich", "ÀÿÀÿÀÿÀ", "wordword", "q" * 80, "".join(r.choice("abc") for _ in range(64)), "".join(r.choice("abc") for _ in range(65))]
    words = []
    for b in base:
        words += [b] * 400
        for k in range(60):
            i = r.randrange(len(b))
            c = r.choice("abcxyzéÿ")
            w = r.choice([b[:i] + c + b[i + 1:], b[:i] + b[i + 1:], b[:i] + c + b[i:]])
            words += [w] * r.choice([1, 2, 3, 30])
    r.shuffle(words)
    return [(i % 97 if i % 50 else None, r.choice([" ", "_", "\n", "1"]).join(words[i: i + 40])) for i in range(0, len(words), 40)] + [(1, None), (2, ""), (3, "x" * 5000 + " " + "x" * 5000), (4, "x" * 4999), (5, "x" * 4999)]


def variants_of(docs):
    return sorted(((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.spelling_variants(docs).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_variants_equal_brute_force(spark, seed):
    rows = variant_rows(seed)
    want = brute_variants(rows)
    assert any(r[1] for r in want) and any(r[1] and r[1] != r[2] for r in want) and max(len(r[0]) for r in want) > 4000
    assert variants_of(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == want


def test_every_prefix_agrees():
    """Short and long prefixes: a word and its variants share exactly the prefix that skips the edited letter."""
    for n in (7, 63, 64, 65, 66):
        w = "".join(random.Random(n).choice("abcd") for _ in range(n))
        skip, whole = [], []
        for p, letter, _ in spelling.entries(w, step=10):
            (whole if letter[0] == 0 else skip).extend(p)
        for i in range(n):
            v = w[:i] + "z" + w[i + 1:]
            mine = [p for p, letter, _ in spelling.entries(v) for p, x in zip(p, letter) if x]
            assert [a == b for a, b in zip(skip, mine)].count(True) == 1 and skip[i] == mine[i]
            shorter = [p for part, letter, _ in spelling.entries(w[:i] + w[i + 1:]) for p, x in zip(part, letter) if not x]
            assert skip[i] == shorter[i]


def test_scan_crosses_batches(spark):
    """Groups that go on in the next Arrow batch."""
    words = spark.createDataFrame([(i, w, i + 1) for i, w in enumerate(sorted({"abcdefg" + c for c in "abcdefghijklmnop"} | {"abcdefg"}))], "id long, word string, n long").coalesce(1)
    got = {r["id"]: (r["n_near"], r["best_n"], r["best"]) for r in spelling.neighbours(words).collect()}
    assert got[0] == (16, 17, 16) and got[16] == (16, 16, 15) and len(got) == 17 and got[3] == (16, 17, 16)


def test_variants_odd_tables(spark, odd, clash, empty):
    assert variants_of(empty) == []
    assert variants_of(odd) == variants_of(clash) == brute_variants([(r[0], r[1]) for r in odd_rows()])


# language

def symbols(text):
    """Lower-cased letters and bytes of other alphabets; the rest is one break, none at the beginning."""
    return re.sub(rb"[^a-z\x80-\xff]+", b"\0", (text or "").encode().lower()).lstrip(b"\0")


def brute_phrases(text, learned, segment):
    """Greedy longest matches of a text's symbols, segment by segment."""
    n = 0
    for lo in range(0, len(text), segment):
        part, i = text[lo: lo + segment], 0
        while i < len(part):
            k = 1
            while part[i: i + k] in learned and i + k < len(part) and part[i: i + k + 1] in learned:
                k += 1
            i, n = i + k, n + 1
    return n


def test_phrases_equal_brute_force(monkeypatch):
    r = random.Random(3)
    learned = {k: language.joined([" ".join("".join(r.choice(s) for _ in range(r.randint(2, 6))) for _ in range(300))]) for k, s in (("a", "abcde"), ("b", "cdefgé"))}
    fits = []
    for k, t in learned.items():
        s, b, to = language.automaton(t)
        fits.append({"lang": k, "size": len(t), "source": s.tobytes(), "byte": b.tobytes(), "target": to.tobytes()})
    texts = ["abc abd, cde", "", None, "!!", "éfg" * 200, "zzz abc zabc", " ".join("".join(r.choice("abcdefg") for _ in range(5)) for _ in range(400)), "x"]
    want = np.array([[brute_phrases(symbols(t), lt, language.SEGMENT) for t in texts] for lt in learned.values()])
    parser = language.Parser(fits)
    import barloom.llm.words as words
    got, size = parser.phrases(pa.array(texts))
    assert (got == want).all() and size.tolist() == [len(symbols(t)) for t in texts]
    monkeypatch.setattr(words, "BLOCK", 64)
    cut, _ = parser.phrases(pa.array(texts))
    assert ((cut > 0) == (got > 0)).all() and (cut <= 2 * got + 1).all()


def test_automaton_accepts_exactly_the_substrings():
    text = b"abcabxabcd"
    source, byte, target = language.automaton(text)
    step = {(int(s), int(b)): int(t) for s, b, t in zip(source, byte, target)}
    parts = {text[i:j] for i in range(len(text)) for j in range(i + 1, len(text) + 1)}

    def accepted(w):
        s = 0
        for c in w:
            if (s, c) not in step:
                return False
            s = step[s, c]
        return True

    assert all(map(accepted, parts))
    r = random.Random(2)
    for _ in range(300):
        w = bytes(r.choice(b"abcdx") for _ in range(r.randint(1, 5)))
        assert accepted(w) == (w in text)


def test_languages_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r["held_out"]]
    assert len(held) > 100 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.98
    assert all(0 <= r["score"] <= 1 for r in out)


def test_languages_learn_nothing_from_held_out_rows(spark):
    rows = [(i, "wort und satz " * 20 if i % 2 else "word and sentence " * 20, "de" if i % 2 else "en", "s", 1) for i in range(200)]
    flipped = [(i, t, ("en" if lang == "de" else "de") if zlib.crc32(str(i).encode()) % 5 == 0 else lang, s, n) for i, t, lang, s, n in rows]
    a, b = (sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in language.languages(spark.createDataFrame(x, SCHEMA)).collect()) for x in (rows, flipped))
    assert a == b and {p for _, p, _ in a} == {"de", "en"} and all((p == "de") == bool(i % 2) for i, p, _ in a)


def test_languages_odd_tables(spark, odd, clash, empty):
    assert language.languages(empty).count() == 0
    got = {}
    for d in (odd, clash):
        rows = language.languages(d).collect()
        assert len(rows) == len(odd_rows())
        got[d] = sorted(map(str, rows))
        for r in rows:
            texts = [t for i, t, *_ in odd_rows() if i == r["doc_id"]]
            if not any(c.isalpha() for t in texts for c in t or ""):
                assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    assert got[odd] == got[clash]
    unlabelled = language.languages(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r["lang_pred"], r["score"]) for r in unlabelled} == {("und", 0.0)}
    only_long = spark.createDataFrame([(1, "lang " * 30_000, "xx", "s", 1), (2, "short text", None, "s", 1)], SCHEMA)
    assert {r["lang_pred"] for r in language.languages(only_long).collect()} == {"xx"}


def test_without_a_checkpoint_folder(tmp_path):
    """A local session that names no shared folder gets one of its own, which goes with it."""
    import os
    import subprocess
    import sys

    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert not spark.conf.get("spark.checkpoint.dir", None)
from barloom.llm.frames import numbered, saved
assert sorted(r["i"] for r in numbered(spark.range(20), ["id"]).collect()) == list(range(20))
print("OK", saved(spark.range(3), "x").inputFiles()[0])
"""
    out = subprocess.run([sys.executable, "-c", code], env={**os.environ, "SPARK_CONF_DIR": str(tmp_path)}, capture_output=True, text=True, timeout=600, check=False)
    assert out.returncode == 0, out.stderr[-2000:]
    assert not os.path.exists(next(x for x in out.stdout.splitlines() if x.startswith("OK")).split()[1].removeprefix("file://"))
