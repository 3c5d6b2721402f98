"""The similarity join, the lexical search and the manifest against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyray.llm import lexical_search, merkle, ngram_join

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def some_texts(seed=5):
    rng = random.Random(seed)
    word = lambda: rng.choice("Red green BLUE wort Ärger naïve 7up été x-y a b c d e f g h".split()) + str(rng.randrange(400))
    texts = [" ".join(word() for _ in range(rng.choice([1, 2, 3, 40, 130, 400]))) for _ in range(60)]
    for base in (texts[3], " ".join(word() for _ in range(200)), " ".join(word() for _ in range(90))):
        for _ in range(14):  # families around the threshold
            own = base.split()
            for _ in range(rng.randrange(6)):
                own[rng.randrange(len(own))] = word()
            texts.append(" ".join(own))
    texts += [texts[0], texts[0].upper(), texts[62], texts[62].replace(" ", "\n\t"), "", "  \n ", None, "two words", "two  words", "words two", "straße STRASSE"]
    return texts


def shingle_set(text):
    w = [x.translate(LOWER) for x in WORDS.findall(text or "")]
    return {tuple(w)} if 0 < len(w) < 3 else set(zip(w, w[1:], w[2:]))


def brute_components(rows):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(find(i), []).append(d)
    ids = [[d for d in least[find(i)] if d is not None] for i in range(len(rows))]
    return sorted(((d, len(sets[i]), min(ids[i], default=None)) for i, (d, _) in enumerate(rows)), key=str)


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(d, t, "en", s, n) for d, t, s, n in rows], DOCS).repartition(parts)


@pytest.mark.parametrize("tile", [ngram_join.TILE, 8])
def test_join_equals_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(ngram_join, "TILE", tile)  # small tiles: blocks are cut into parts that all meet
    texts = some_texts()
    rows = [(None if i % 17 == 5 else i - i % 2 if i % 19 == 7 else i, t) for i, t in enumerate(texts)]
    got = ngram_join.components(frame(spark, [(d, t, "s", 1) for d, t in rows]).withColumn("n", F.lit(1)).withColumn("prefix", F.lit("x")))
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == brute_components(rows)
    assert len({r[2] for r in brute_components(rows)}) < len(rows) - 20


def test_join_of_nothing(spark):
    assert ngram_join.components(frame(spark, [])).count() == 0
    got = ngram_join.components(frame(spark, [(1, None, None, None), (1, None, None, None), (None, "", None, None)])).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in got) == [(0, 0, 0), (1, 0, 1), (1, 0, 1)]


def test_bounds_lose_no_link():
    rng = np.random.default_rng(3)
    for n in (1, 2, 9, 10, 50, 700, 4000):
        for _ in range(12):
            base = rng.integers(0, 1 << 63, n + n // 8 + 2).astype(np.uint64)
            a = np.unique(base[: n])
            b = np.unique(base[rng.integers(0, n // 9 + 2): n + rng.integers(0, n // 9 + 2)])
            both = len(np.intersect1d(a, b))
            link = 100 * both >= 90 * (len(a) + len(b) - both)
            assert ngram_join.overlapping([a, b], np.array([0]), np.array([1]))[0] == link
            counts = rng.integers(0, 5, 1 << ngram_join.BIN_BITS)
            i, _, _ = ngram_join.close_pairs(np.array([len(a), len(b)]), [ngram_join.parity(a), ngram_join.parity(b)], np.array([0, 1]),
                                          np.array([0, 0]), np.array([True, False]), np.array([4, 9]), None)
            if link:
                assert len(i) == 1 and len(np.intersect1d(ngram_join.prefix(a, counts), ngram_join.prefix(b, counts)))


def brute_search(docs, items):
    bags = [(d, [x.translate(LOWER) for x in TERMS.findall(t or "")]) for d, t in docs]
    n_docs, n_terms = sum(bool(b) for _, b in bags), sum(len(b) for _, b in bags)
    df = {}
    for _, b in bags:
        for t in set(b):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        own = {x.translate(LOWER) for x in TERMS.findall(text or "")}
        scored = []
        for d, b in bags:
            if not b:
                continue
            m = 100 - 90 + (90 * len(b) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * b.count(t)) // (1000 * b.count(t) + 8 * m))
                    for t in own & set(b))
            if s > 0:
                scored.append((-s, d is None, d))
        out += [(item, k, d, -s) for k, (s, _, d) in enumerate(sorted(scored, key=lambda r: (r[0], r[1], r[2] or 0))[:10], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("bucket, block", [(lexical_search.BUCKET, lexical_search.BLOCK_BYTES), (16, 2000)])
def test_search_equals_brute_force(spark, monkeypatch, bucket, block):
    monkeypatch.setattr(lexical_search, "BUCKET", bucket)  # many buckets, several blocks of items
    monkeypatch.setattr(lexical_search, "BLOCK_BYTES", block)
    texts = some_texts(8)
    docs = [(None if i % 23 == 5 else i % 90, t) for i, t in enumerate(texts)]
    items = [(i, " ".join((texts[3 * i] or "").split()[:9])) for i in range(25)] + [(None, texts[4]), (3, texts[4]), (3, texts[4]), (90, None), (91, "nothing here"), (92, "")]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, score int")
    got = lexical_search.ranked(frame(spark, [(d, t, "s", 1) for d, t in docs], 5).withColumn("norm", F.lit(2)), bench)
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in got.collect()), key=str) == brute_search(docs, items)


def test_search_of_nothing(spark):
    bench = spark.createDataFrame([(1, "red")], "item_id long, text string")
    assert lexical_search.ranked(frame(spark, []), bench).count() == 0
    assert lexical_search.ranked(frame(spark, [(1, "red", "s", 1)]), bench.limit(0)).count() == 0
    assert lexical_search.ranked(frame(spark, [(1, None, "s", 1)]), bench).count() == 0


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_manifest(rows):
    """Sequential: levels as lists, proofs by walking up."""
    def leaf(d, t, s, n):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d, s, "en", n, t)))

    def climb(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i: i + 16])) for i in range(0, len(levels[-1]), 16)])
        return levels

    def path(levels, i):
        out = []
        for level in levels[:-1]:
            at = i - i % 16
            out.append(("".join(level[at: i]), "".join(level[i + 1: at + 16])))
            i //= 16
        return out

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(*r), r))
    order = sorted(groups, key=lambda s: b"" if s is None else b"s" + s.encode())
    trees = {s: climb([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in order}
    tops = climb([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, (_, _, own, r) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            steps = path(trees[s], i) + path(tops, k)
            node = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                node = leaf(r[0], r[1] and r[1].translate(LOWER), r[2], r[3])
            for left, right in steps:
                node = sha(left + node + right)
            out.append((r[0], own, trees[s][-1][0], tops[-1][0], sha("".join(a + b for a, b in steps)), node, node == tops[-1][0]))
    return sorted(out, key=str)


def manifest_rows():
    texts = some_texts(11)
    rows = [(None if i % 31 == 3 else i, t, ["big", "big", None, "é", "Z", "z"][i % 6], None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [(1000 + i, f"Row {i}", "big", i) for i in range(300)] + [(2000 + i, None, f"only{i}", 0) for i in range(20)]
    return rows + rows[:3] + [(7, "another Text", "big", 3)] + [(5000, "Copy", "copies", 4)] * 40


def test_manifest_equals_brute_force(spark):
    rows = manifest_rows()
    got = merkle.verified(frame(spark, rows, 4).withColumn("idx", F.lit(1)).withColumn("leaf", F.lit("x")))
    got = sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got.collect()), key=str)
    assert got == brute_manifest(rows)
    assert 0 < sum(not r[-1] for r in got) < len(got)


def test_requested_proofs(spark):
    rows = manifest_rows()
    whole = {(r[0], r[1]): r for r in brute_manifest(rows)}
    asked = spark.createDataFrame([(d,) for d in (4, 1007, 2003, 2003, 5000, 99999)], "doc_id long")
    found = merkle.proofs(merkle.manifest(frame(spark, rows)), asked)
    got = found.withColumn("up", merkle.folded(F.col("leaf"), F.col("path"))).collect()
    assert sorted(r.doc_id for r in got) == [4, 1007, 2003] + [5000] * 40
    assert all(r.up == whole[r.doc_id, r.leaf][3] and r.subroot == whole[r.doc_id, r.leaf][2] for r in got)


@pytest.mark.parametrize("rows", [[], [(1, "Alone", "s", 5)], [(None, None, None, None)] * 2])
def test_small_manifests(spark, rows):
    got = merkle.verified(frame(spark, rows, 1)).collect()
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got), key=str) == brute_manifest(rows) if rows else not got
