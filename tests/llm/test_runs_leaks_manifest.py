"""Periodic runs, contamination and the manifest against brute force, and on odd inputs."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.llm.contamination import contamination, decontaminate
from rankloom.llm.merkle import audit
from rankloom.llm.queries import op11_periodic_runs, op12_contamination, op13_merkle_manifest, with_repeats
from rankloom.llm.runs import periodic_runs, seed_words, word_runs
from rankloom.llm.texts import word_hashes

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SF = "/root/testdata/sf0.001"


def brute_runs(w, min_words=6, min_periods=4):
    out, seen = [], set()
    for q in range(1, len(w) // min_periods + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(min_words, min_periods * q) and (i, n) not in seen:
                seen.add((i, n))
                out.append((i, n, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("limits", [(6, 4), (2, 2), (4, 2), (10, 3), (6, 6)])
def test_runs_are_those_of_brute_force(limits):
    rng = random.Random(repr(limits))
    assert seed_words(6, 4) == 5
    for _ in range(150):
        docs = []
        for _ in range(rng.randrange(1, 6)):
            n = rng.choice([0, 1, 5, rng.randrange(60), rng.randrange(200)])
            k = rng.choice([1, 2, 2, 3, 50])
            w = [str(rng.randrange(k)) for _ in range(n)]
            if n and rng.random() < 0.6:
                a, p = rng.randrange(n), rng.randrange(1, n // 4 + 2)
                w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
            docs.append(w)
        texts = [" ".join(w).encode() for w in docs]
        words, rows = word_hashes(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
        assert list(word_runs(words, rows, *limits)) == [brute_runs(w, *limits) for w in docs]


def test_long_runs_take_little_time():
    for p in (1, 7, 1000):
        text = " ".join(f"w{i % p}" for i in range(60_000)).encode()
        words, rows = word_hashes(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        assert list(word_runs(words, rows)) == [[(0, 60_000, p)]]


def test_query_of_runs(spark):
    got = {r.doc_id: tuple(r)[1:] for r in op11_periodic_runs(spark, SF).collect()}
    n_with = 0
    for doc_id, text in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        w = SPACED.findall(text or "")
        h, n = zlib.crc32(str(doc_id).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        if n > 1500:
            continue  # brute force takes the square of the words
        runs = brute_runs(w)
        n_with += bool(runs)
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        assert got[doc_id] == (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
    assert n_with > 5


def test_runs_on_odd_rows(spark):
    long = " ".join(["one", "two"] * 40_000)
    rows = [(1, None, "x"), (2, "", "x"), (3, "a " * 9, "x"), (3, "a " * 9, "x"), (None, "b\tb\nb b\x0bb b\x85b", "x"), (4, long, "x"), (5, "short", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs(df).collect()]
    assert (1, 0, [], "") in got and (2, 0, [], "") in got and got.count((3, 9, [(0, 9, 1)], "a")) == 2
    assert (None, 6, [], "b b b b b b\x85b") in got and (4, 80_000, [(0, 80_000, 2)], "one two") in got and (5, 1, [], "short") in got
    assert periodic_runs(df.where("false")).count() == 0
    assert with_repeats(df).columns == df.columns and with_repeats(df).where("doc_id is null").first().text == rows[4][1]
    with pytest.raises(ValueError):
        periodic_runs(df, min_periods=1)


def brute_hits(docs, items, size=10):
    words = lambda t: PLAIN.findall((t or "").translate(LOWER))
    held = defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            held[tuple(w[i : i + n])].add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in held}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in held:
                    hit.update(range(i, i + n))
                    found |= held[tuple(w[i : i + n])]
        out.append((doc, len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_contamination_is_that_of_brute_force(spark, broadcast):
    rng = random.Random(3)
    word = lambda: rng.choice(["a", "B", "É", "é", "7", "x1", "ß"])
    sep = lambda: rng.choice([" ", ", ", "\n", "--", "_"])
    prose = lambda n: "".join(word() + sep() for _ in range(n))
    items = [(i, prose(rng.randrange(1, 8))) for i in range(12)] + [(20, None), (21, "!!"), (None, prose(4)), (3, prose(5))]
    items += [(30 + i, prose(14)) for i in range(6)]
    docs = [(i, prose(rng.randrange(0, 60)) + (rng.choice(items)[1] or "") + prose(rng.randrange(0, 9))) for i in range(60)]
    docs += [(1, docs[0][1]), (None, items[-1][1].upper()), (98, None), (99, ""), (97, prose(3000))]
    left = spark.createDataFrame([(*d, "n") for d in docs], "doc_id long, text string, items string")
    right = spark.createDataFrame(items, "item_id long, text string")
    got = contamination(left, right, window=7, broadcast=broadcast)
    assert got.columns == ["doc_id", "text", "n_words", "n_hit", "hits", "items"]
    rows = got.collect()
    assert all(r.n_hit == sum(h.end - h.start for h in r.hits) for r in rows)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in rows), key=repr) == brute_hits(docs, items, 7)


def test_removal_and_empty_tables(spark):
    passage = "The quick, brown fox: jumps OVER the lazy dog (again)"
    docs = spark.createDataFrame([(1, f"Before it. {passage}! And after."), (2, "Clean text."), (3, None), (4, passage)], "doc_id long, text string")
    items = spark.createDataFrame([(7, passage.lower())], "item_id long, text string")
    cut = {r.doc_id: r.text for r in decontaminate(docs, items).collect()}
    assert cut == {1: "Before it)! And after.", 2: "Clean text.", 3: None, 4: ")"}
    assert sorted(r.doc_id for r in decontaminate(docs, items, remove="documents").collect()) == [2, 3]
    assert contamination(docs, items.where("false")).where("n_hit = 0 and size(items) = 0").count() == 4
    assert contamination(docs.where("false"), items).count() == 0
    with pytest.raises(ValueError):
        decontaminate(docs, items, remove="rows")


def test_query_of_contamination(spark):
    read = lambda t: [tuple(r) for r in spark.read.parquet(f"{SF}/{t}.parquet").select(*({"documents": ("doc_id", "text"), "benchmark": ("item_id", "text")}[t])).collect()]
    expected = [(d, n, h, len(i), sha(",".join(i)), h > 0) for d, n, h, i in brute_hits(read("documents"), read("benchmark"))]
    assert sorted(tuple(r) for r in op12_contamination(spark, SF).collect()) == sorted(expected) and any(e[-1] for e in expected)


def brute_manifest(rows, tampered):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: sha("".join(map(field, r)))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
        return out

    trees = defaultdict(list)
    for r in rows:
        trees[r[2]].append(r)
    names = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    for t in names:
        trees[t].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    built = {t: levels([leaf(r) for r in trees[t]]) for t in names}
    over = levels([built[t][-1][0] for t in names])
    out = []
    for k, t in enumerate(names):
        for i, r in enumerate(trees[t]):
            bad = tampered(r[0]) and r[3] is not None
            now, proof = leaf((*r[:3], r[3] + 1, r[4])) if bad else leaf(r), []
            for tree, at in ((built[t], i), (over, k)):
                for level in tree[:-1]:
                    other = level[at ^ 1] if at ^ 1 < len(level) else ""
                    proof.append(other)
                    now = sha(other + now if at & 1 else now + other)
                    at >>= 1
            out.append((r[0], leaf(r), built[t][-1][0], over[-1][0], sha("".join(proof)), now, now == over[-1][0]))
    return sorted(out, key=repr)


def _tampered(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0


@pytest.mark.parametrize("stride", [None, 1, 3])
def test_manifest_is_that_of_brute_force(spark, stride):
    rows = [(i, f"s{i % 3}", ["de", "en", "", None, "日本"][min(i % 11, 4)], None if i % 9 == 4 else i, "é" * (i % 5)) for i in range(90)]
    rows += [(None, None, "en", 4, None), (5, "s2", "en", 5, ""), (5, "s2", "en", 5, ""), (5, "s2", "en", 6, "other"), (200, "s", "lone", 1, "x" * 300_000)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, tree string, idx int")
    where = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    got = audit(df, changed={"n_chars": F.col("n_chars") + 1}, where=where, stride=stride)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_manifest(rows, _tampered)


def test_manifest_of_none_and_one(spark):
    df = spark.createDataFrame([(1, "s", "en", 3, "abc")], "doc_id long, source string, lang string, n_chars long, text string")
    assert audit(df.where("false")).count() == 0
    r = audit(df).first()
    assert r.leaf == r.subroot == r.root == r.folded_root and r.proof_sha256 == sha("") and r.verified


def test_query_of_manifest(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = sorted((tuple(r) for r in op13_merkle_manifest(spark, SF).collect()), key=repr)
    assert got == brute_manifest(rows, _tampered) and 0 < sum(g[-1] for g in got) < len(got)
