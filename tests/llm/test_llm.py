"""The training-data operators against brute force, libraries and planted cases."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions

import corpus_pipeline
from tallyray.llm import (bpe, line_dedup, mixing, quality_classifier, quality_rules, sharding, token_counts, topk_search,
                          toxicity, weighted_minhash)
from tallyray.llm.queries import tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, row string, class string"
PROSE = "The quick brown fox number {} jumps over lazy dogs, and then the {} story goes on with other words entirely."


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, clashing extra columns."""
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000)) + "."
    base = "\n".join(" ".join(f"line{k}word{j}" for j in range(12)) + "." for k in range(12))
    rows = [(1, base), (2, base), (3, base.replace("line5word5", "changed")), (4, ""), (5, None), (6, long), (6, long),
            (7, "| Home | About | News | Shop | Contact | Help\n" * 9), (8, "All the shared boilerplate line of every site.\nOwn text a."),
            (9, "All the shared boilerplate line of every site.\nOwn text b."), (10, "x"), (None, "no id here but some text"), (None, None)]
    rows += [(20 + i, PROSE.format(i, i * 7) + f"\nAll the shared boilerplate line of every site.\n{PROSE.format(i + 1, i)} {i}") for i in range(30)]
    data = [(i, t, "en" if k % 3 else None, f"s{k % 5}" if k % 7 else None, len(t) if t else None, "x", "y", "z") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_bpe_equals_library(docs):
    from tokenizers import Tokenizer
    path = tokenizer("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    got = collections.Counter(map(tuple, bpe.digests(docs, path).collect()))
    want = collections.Counter()
    for r in docs.collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        text = lib.decode(ids, skip_special_tokens=False)
        want[r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert got == want
    assert all(r.round_trip for r in bpe.encoded_documents(docs, path).collect())


ODD = ["", " ", "a  b\n\n c", "don't WE'LL İSTANBUL ΑΣ", "x" * 700, "<|endoftext|>a<|endoftext|>", "é́　１²Ⅷ😀\x1c\x85", "'s're''ll", "ab" * 400]


def test_tokenizers_on_odd_texts():
    from tokenizers import Tokenizer
    p1, p2 = tokenizer("byte_bpe_50k.json"), tokenizer("word_bpe_49k.json")
    m1, m2, small = bpe.ByteBpe(bpe.read_spec(p1)), token_counts.Counter(bpe.read_spec(p2)), token_counts.Counter(bpe.read_spec(p2), chunk=3)
    for t in ODD:
        assert list(m1.encode(t)) == Tokenizer.from_file(p1).encode(t, add_special_tokens=False).ids
        n = len(Tokenizer.from_file(p2).encode(t, add_special_tokens=False).ids)
        assert (m2.count(t), small.count(t)) == (n, n)


def test_token_counts(docs):
    from tokenizers import Tokenizer
    path = tokenizer("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    got = collections.Counter(map(tuple, token_counts.counted(docs, path).collect()))
    want = collections.Counter()
    for r in docs.collect():
        n = len(lib.encode(r.text or "", add_special_tokens=False).ids)
        want[r.doc_id, len((r.text or "").encode()), n, n > 2048] += 1
    assert got == want


def test_sharding_is_proportional(docs):
    rows = sharding.interleaved(docs, shards=4).collect()
    size = collections.Counter(r.shard for r in rows)
    assert len(rows) == docs.count() and max(size.values()) - min(size.values()) <= 1
    for s in size:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(size[s]))
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == collections.Counter(
        (r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())


def brute_targets(sizes):
    names = sorted(k for k in sizes if k is not None) + [None] * (None in sizes)
    weight, total, capped = {k: i % 3 + 1 for i, k in enumerate(names)}, sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[k] for k in capped)
        share = {k: 3 * sizes[k] if k in capped else rest * weight[k] / sum(weight[j] for j in names if j not in capped) for k in names}
        more = {k for k in names if k not in capped and share[k] > 3 * sizes[k] + 1e-9}
        if not more:
            return share
        capped |= more


def test_mixing(docs):
    rows = mixing.mixed(docs).collect()
    sizes, taken = collections.Counter(), collections.Counter()
    source = {}
    for r in docs.collect():
        sizes[r.source] += len(words(r.text))
        source.setdefault((r.doc_id, len(words(r.text))), r.source)
    target = brute_targets(sizes)
    assert len(rows) == docs.count()
    for r in rows:
        assert 0 <= r.taken <= 3 * r["size"]
        assert any(sizes[k] == r.source_size and abs(target[k] - r.target) < 1e-6 for k in sizes)
    by = collections.defaultdict(set)
    for r in rows:
        taken[r.source_size] += r.taken
        by[r.source_size].add(r.target)
    for s, t in by.items():
        if len(t) == 1 and sum(v == s for v in sizes.values()) == 1:
            assert abs(taken[s] - min(t)) <= 3 * mixing.BLOCK_WORDS
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mixed(docs).collect()), key=str)


def test_quotas_are_sainte_lague(spark):
    seats = {"a": 1000, "b": 610, "c": 87, "d": 3}
    src = spark.createDataFrame([(k, i + 1, float(v), 1700, 4) for i, (k, v) in enumerate(seats.items())],
                                "skey string, place int, target double, words long, sources long")
    got = collections.Counter()
    for r in mixing.quotas(src, block_words=17, shards=3).collect():
        assert r.quota >= 0
        got[r.skey] += r.quota
    want = collections.Counter(k for _, k in sorted(((-v / (2 * j + 1), k) for k, v in seats.items() for j in range(100)))[:100])
    assert got == want


def test_quality_rules(docs):
    rows = {r.doc_id: r for r in quality_rules.judged(docs).collect()}
    for d in docs.collect():
        t, w = d.text or "", words(d.text)
        c = collections.Counter(tuple(w[i: i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if c[tuple(w[i: i + 8])] > 1 for j in range(i, i + 8)}
        seen, dup = set(), 0
        for s in t.split("\n"):
            if words(s):
                dup += s in seen
                seen.add(s)
        if d.doc_id is not None:
            r = rows[d.doc_id]
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
                len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered))
            assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
    assert not rows[7].kept and not rows[20].kept and rows[1].kept  # 20 repeats its own sentence
    assert quality_rules.kept_documents(docs).columns == docs.columns


def test_shouting_with_lower_case_letters():
    rule = lambda line: quality_rules.failed_rule(line, line.split())
    assert rule(b"BUY the BEST DEALS IN TOWN TODAY ONLY") == "shouting"
    assert rule(b"it began as a calm line " + b"AND THEN IT SHOUTED " * 20) == "shouting"
    assert rule(b"the NEW plan of the EU and the UN was read today.") is None
    assert quality_rules.judge("BUY the BEST DEALS IN TOWN TODAY ONLY").n_failed_lines == 1


def test_line_dedup(docs):
    rows = {r.doc_id: r for r in line_dedup.deduped(docs).collect()}
    assert "shared boilerplate" in rows[8].clean_text
    assert all("shared boilerplate" not in rows[20 + i].clean_text and rows[20 + i].n_removed == 1 for i in range(30))
    assert rows[10].clean_text == "x" and rows[4].clean_text == "" and rows[5].clean_text is None
    assert line_dedup.deduped_documents(docs).columns == docs.columns


def test_near_duplicates(docs):
    rows = weighted_minhash.classes(docs).collect()
    cls = {r.doc_id: r.class_id for r in rows}
    assert len(rows) == docs.count() and cls[1] == cls[2] == cls[3] == 1 and cls[4] == cls[5] == 4 and cls[6] == 6
    assert len({cls[20 + i] for i in range(30)}) == 30
    kept = weighted_minhash.representatives(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.select("doc_id").collect() if r.doc_id is not None and r.doc_id < 7) == [1, 4, 6]


def test_block_search_skips_tested_and_own_class():
    import pyarrow as pa
    rng = np.random.default_rng(5)
    n = 40
    ids, key = rng.permutation(1000)[:n].astype(np.int64), np.sort(rng.integers(0, 2, (n, 1)), 0)
    group, samples = rng.integers(0, 6, n), rng.integers(0, 2, (n, 30)) * (rng.random((n, 30)) < 0.3)
    past = [[int(v) for v in rng.choice(ids, 5)] if k % 3 else None for k in range(n)]
    got = {tuple(r[:2]) for r in np.concatenate(weighted_minhash._partners(key, ids, group, samples, pa.array(past, pa.list_(pa.int64())), n))}
    want = set()
    for i in range(n):
        peers = [j for j in range(n) if key[j, 0] == key[i, 0]]
        count = collections.Counter(group[j] for j in peers)
        if group[i] == min(count, key=lambda g: (-count[g], g)):
            continue  # the largest class is only sought
        want |= {(ids[i], ids[j]) for j in peers if group[j] != group[i] and int(ids[j]) not in (past[i] or [])
                 and (samples[i] == samples[j]).sum() >= weighted_minhash.AGREE}
    assert got == want and want


def _node_classes(spark, bands, samples, texts):
    """The classes of nodes with given bands, samples and texts."""
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    nodes = spark.createDataFrame([(i, [int(v) for v in b], bytearray(np.asarray(s, "<u2").tobytes())) for i, (b, s) in enumerate(zip(bands, samples))],
                                  "id long, bands array<long>, samples binary")
    idf = spark.sparkContext.broadcast(np.ones(1 << weighted_minhash.BIN_BITS, np.float32))
    return {r["id"]: r["class"] for r in weighted_minhash.node_classes(nodes, docs, idf).collect()}


def _text(i, n=40):
    return " ".join(f"n{i}w{j}" for j in range(n))


def test_nodes_of_a_large_bucket_all_meet(spark):
    """Two like nodes that share one bucket of 1,500 and no next band."""
    rng, n = np.random.default_rng(11), 1500
    bands = rng.integers(0, 1 << 60, (n, weighted_minhash.BANDS))
    bands[:, 3] = 5
    samples = rng.integers(0, 1 << 16, (n, 30))
    samples[1400, :20] = samples[7, :20]
    texts = [_text(i) for i in range(n)]
    texts[1400] = texts[7] + " end"
    label = _node_classes(spark, bands, samples, texts)
    assert label[7] == label[1400] == 7 and len(set(label.values())) == len(label) - 1


def test_spans_bring_all_classes_of_a_bucket_together(spark):
    from pyspark.sql import functions as F
    rng, n = np.random.default_rng(12), 2600
    group = np.where(rng.random(n) < 0.5, 0, rng.integers(1, 40, n))
    rows = spark.createDataFrame([(1, i, int(group[i])) for i in range(n)] + [(2, i, i) for i in range(5)] + [(3, i, 1) for i in range(9)],
                                 "key long, id long, class long").withColumns({"samples": F.lit(b""), "sketch": F.lit(b""), "tested": F.lit(None).cast("array<long>")})
    dealt = weighted_minhash.spans(rows)
    met = {}
    for r in dealt.select("key", "block", "id", "seek", "sought").collect():
        sides = met.setdefault((r.key, r.block), ([], []))
        for side, there in zip(sides, (r.seek, r.sought)):
            side.extend([r.id] * there)
    seen = np.zeros((n, n), bool)
    small = set()
    for (key, _), (seek, sought) in met.items():
        assert key != 3
        if key == 1:
            seen[np.ix_(seek, sought)] = True
        else:
            small |= {frozenset((x, y)) for x in seek for y in sought if x != y}
    assert (seen | seen.T | (group[:, None] == group[None])).all() and len(small) == 10
    assert len(met) == 1 + -(-n // weighted_minhash.TILE) * -(-int((group != 0).sum()) // weighted_minhash.TILE)


def test_sketches_bound_the_similarity():
    rng, idf = np.random.default_rng(13), np.linspace(1, 1.15, 1 << weighted_minhash.BIN_BITS).astype(np.float32)
    texts = [" ".join(w) for k in (3, 60, 2000) for w in rng.choice([f"w{i}" for i in range(9 * k)], (6, k))]
    texts += ["", " ".join(texts[7].split()[:50])]
    full = [weighted_minhash.weighted(t, idf) for t in texts]
    rows = weighted_minhash.unpacked([weighted_minhash.sketch(t, idf) for t in texts])
    for i in range(len(texts)):
        for j in range(len(texts)):
            if len(full[i][0]) and len(full[j][0]):
                assert weighted_minhash.at_most_similar(rows[i: i + 1], rows[j: j + 1])[0] >= weighted_minhash.jaccard(full[i], full[j]) - 1e-4


def test_search_goes_on_without_links(spark):
    """The one like pair ranks below many unlike partners, and no round finds a link before it."""
    rng, n = np.random.default_rng(14), 60
    bands = rng.integers(0, 1 << 60, (n, weighted_minhash.BANDS))
    bands[:, 0] = 5
    samples = np.tile(rng.integers(0, 1 << 16, 30), (n, 1))
    samples[:, 28:] = rng.integers(0, 1 << 16, (n, 2))
    samples[50, 20:], samples[9, 18:20] = 1, 2
    texts = [_text("", 40) + " " + _text(i, 14) for i in range(n)]
    texts[50] = _text(9, 14) + " " + _text("", 40)
    texts[9] = texts[50] + " end"
    label = _node_classes(spark, bands, samples, texts)
    assert label[9] == label[50] == 9 and len(set(label.values())) == len(label) - 1


def test_texts_under_one_id_and_without_id(spark):
    long = [_text(i) for i in range(6)]
    rows = [(1, long[0]), (1, long[1]), (1, long[0]), (2, long[1] + " end"), (3, long[2]), (None, long[2] + " end"), (None, long[3]), (None, long[3] + " end"),
            (9, long[4]), (None, long[5]), (8, long[5] + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = collections.Counter(map(tuple, weighted_minhash.classes(docs).collect()))
    assert got == collections.Counter([(1, 1)] * 3 + [(2, 1), (3, 3), (None, 3), (None, None), (None, None), (9, 9), (None, 8), (8, 8)])
    kept = collections.Counter(map(tuple, weighted_minhash.representatives(docs).collect()))
    without = [t for i, t in kept if i is None]  # a class without any id keeps one row
    assert len(without) == 1 and without[0] in (long[3], long[3] + " end")
    assert kept == collections.Counter([(1, long[0]), (1, long[1]), (3, long[2]), (9, long[4]), (8, long[5] + " end"), (None, without[0])])


def test_rows_without_id_stay(spark):
    rows = [(i if i % 3 == 0 else None, _text(i)) for i in range(60)]
    docs = spark.createDataFrame(rows + rows[:5], "doc_id long, text string").repartition(4)
    assert collections.Counter(map(tuple, weighted_minhash.representatives(docs).collect())) == collections.Counter(rows)


def test_top_k_keeps_rows_that_repeat_an_id(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.0]), (1, [0.5, 0.0]), (2, [0.25, 1.0]), (2, [0.75, 0.0]), (100, [0.0, 1.0]), (100, [0.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk_search.top_k(df, functions.col("vec_id") % 100 == 0).collect()
    want = []
    for q in (0, 100):
        scores = [(-sum(int(1024 * a) * int(1024 * b) for a, b in zip(x, y)), i) for j, x in rows if j == q for i, y in rows if i != q]
        want += [(q, k, i, -s) for k, (s, i) in enumerate(sorted(scores)[:10], 1)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_shingle_hashes_follow_words():
    a = weighted_minhash.word_hashes(b"one two  three\none")
    assert len(a) == 4 and a[0] == a[3] and len(set(a.tolist())) == 3
    data = b" ".join(b"w%d" % i for i in range(300_000))
    assert len(set(weighted_minhash.word_hashes(data).tolist())) == 300_000


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 0.2, (700, 24))
    x[5] = x[7]
    rows = [(i, [float(v) for v in x[i]], "extra") for i in range(700)] + [(900, None, "n"), (901, [1.0, None], "n"), (902, [float("nan")] * 24, "n"), (None, [0.1] * 24, "n")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, dim string")
    from pyspark.sql import functions as F
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk_search.top_k(df, F.col("vec_id") % 100 == 0, block_rows=150, block_queries=3).collect()}
    q = np.floor(1024 * x).astype(np.int64)
    for i in range(0, 700, 100):
        s = q @ q[i]
        order = sorted((j for j in range(700) if j != i), key=lambda j: (-s[j], j))[:10]
        assert [got[i, k + 1] for k in range(10)] == [(j, s[j]) for j in order]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_trie_and_automaton():
    rng = np.random.default_rng(1)
    word = lambda lo, hi, letters: "".join(rng.choice(list(letters), rng.integers(lo, hi)))
    for _ in range(40):
        terms = {word(4, 9, "abc"): float(rng.random()) for _ in range(12)}
        trie = toxicity.Trie(terms)
        for _ in range(100):
            w = word(1, 10, "abcd")
            near = [t for t in terms if len(t) >= toxicity.FUZZY_FROM and edits(w, t) == 1]
            assert trie.near(w) == ((w, 0) if w in terms else (max(near, key=lambda t: (terms[t], t)), 1) if near else None)


def test_misspelled_hits_have_a_context():
    scorer = toxicity.Scorer({"idiot": 2.0, "moron": 1.5}, None)
    figures = lambda t: dict(zip(toxicity.FIGURES, scorer.figures(t)))
    open_, quoted, plain = figures("you idiat, you morxn"), figures('you "idiat", you "morxn"'), figures("you idiot, you moron")
    assert quoted["abuse"] == 0 < open_["abuse"] < plain["abuse"] and 0 < quoted["quoted"]
    assert quoted["window"] < open_["window"] < plain["window"] and 0 < open_["density"] < plain["density"]
    terms = lambda t: [(h.term, h.fuzzy) for h in scorer.hits(t)[0]]
    for w in ("id1ot", "id*ot", "idi-ot", "You.Id!ot", "m0ron"):
        assert terms(f"such an {w} here") == [("moron" if "m0" in w else "idiot", True)]
    assert terms("idiot_moron idiot2x 3idiot id-card a1b") == [("idiot", False), ("moron", False), ("idiot", False), ("idiot", False)]
    assert [h.quoted for h in scorer.hits('an "id1ot" and an id1ot')[0]] == [True, False]


def test_classifiers_on_held_out_rows(spark):
    from tallyray.llm.common import table
    sf = "/root/testdata/sf0.01"
    d, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    rows = toxicity.scored(d, labels).join(labels, "doc_id").where("held_out").collect()
    assert all(0 <= r.score <= 1 for r in rows) and sum(r.predicted == r.toxic for r in rows) >= 0.9 * len(rows)
    rows = quality_classifier.scored(d, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for f in (sharding.interleaved, mixing.mixed, quality_rules.judged, line_dedup.deduped, weighted_minhash.classes,
              lambda d: toxicity.scored(d, labels), lambda d: quality_classifier.scored(d, labels),
              lambda d: bpe.digests(d, tokenizer("byte_bpe_50k.json"))):
        assert f(empty).count() == 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0


def test_stages_keep_columns(spark, docs):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns


def test_every_text_is_judged_once(docs):
    out = quality_rules.kept_documents(docs)
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    want = collections.Counter()
    for r in docs.collect():
        v = quality_rules.judge(r.text)
        if v.kept:
            want[r.doc_id, v.clean_text] += 1
    assert collections.Counter((r.doc_id, r.text) for r in out.collect()) == want
