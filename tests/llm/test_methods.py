"""Tests that fail when the dealt method of mixing or line dedup is taken out."""

import collections
import re
import time

import pytest
from pyspark.sql import functions as F

from tallyray.llm import line_dedup, mixing
from tallyray.llm.common import table

SF = "/root/testdata/sf0.001"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def shared_lines(n, docs=3):
    return [(d, f"s{d}", "\n".join(f"the shared line number {i} of every site" for i in range(n)) + f"\nown words of document {d}") for d in range(docs)]


def brute(rows, min_sites):
    """Line dedup by dictionaries: (doc_id, clean text) of every row."""
    sites, first = collections.defaultdict(set), {}

    def counts(t):
        return len(t) >= 20 and len(words(t)) >= 3

    for i, s, t in rows:
        for x in (t or "").split("\n"):
            x = x.strip(" \t\r")
            if counts(x):
                sites[x].add("null" if s is None else "s:" + s)
                if i is not None:
                    first[x] = min(first.get(x, i), i)
    out = collections.Counter()
    for i, s, t in rows:
        if t is None:
            out[i, None] += 1
            continue
        seen, left = set(), []
        for raw in t.split("\n"):
            x = raw.strip(" \t\r")
            gone = counts(x) and len(sites[x]) >= min_sites and x in first and (i != first[x] or x in seen)
            seen.add(x)
            if not gone:
                left.append(raw)
        out[i, "\n".join(left)] += 1
    return out


@pytest.mark.parametrize("min_sites", [2, 3, 7, 40])
def test_line_dedup_equals_brute_force(spark, min_sites):
    line = "a line of site count {} that is shared by sites"
    rows = [(100 * k + j, f"s{j % k}" if (j + k) % 11 else None, f"{line.format(k)}\n own {j} {k}\n\t{line.format(k)} \n{line.format(k + 1)}")
            for k in (1, 2, 3, 6, 7, 8, 39, 40, 41, 60) for j in range(2 * k)]
    rows += [(None, "x", line.format(40)), (None, "y", line.format(40)), (7, "z", None), (8, "z", ""), (300, "q", line.format(3)), (300, "q", line.format(3))]
    rows += [(None, f"n{j}", "this line lies in rows without id only") for j in range(50)]
    got = collections.Counter((r.doc_id, r.clean_text) for r in line_dedup.deduped(
        spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4), min_sites).collect())
    assert got == brute(rows, min_sites)


def test_line_sketches_stay_in_their_bound(spark):
    rows = [(k * 1000 + j, f"site {j}", f"line of exactly {k} sites on the whole web") for k in (1, 50, 400, 900) for j in range(k)]
    lines = line_dedup.counted_lines(spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5))
    plan = line_dedup.sketched(lines)._jdf.queryExecution().executedPlan().toString()
    assert "partial_hll_sketch_agg" in plan
    got = sorted(r.sites for r in line_dedup.sketched(lines).collect())
    for k, n in zip((1, 50, 400, 900), got):
        assert abs(n - k) <= line_dedup.margin(k, line_dedup.LG_K)


def test_long_documents_are_linear(spark):
    schema = "doc_id long, source string, text string"

    def seconds(n):
        df = spark.createDataFrame(shared_lines(n), schema)
        t = time.time()
        rows = {r.doc_id: r.n_removed for r in line_dedup.deduped(df).collect()}
        assert rows == {0: 0, 1: n, 2: n}
        return time.time() - t

    seconds(100)
    assert seconds(48_000) < 20 + 4 * seconds(4_000)


def test_shards_decide_block_selection(spark):
    docs = table(spark, SF, "documents")
    taken, totals, sources = {}, {}, {}
    for shards in (1, 8):
        rows = mixing.mixed(docs, shards=shards).collect()
        taken[shards] = {r.doc_id: r.taken for r in rows}
        assert {r.shard for r in rows if r.taken} == set(range(shards)) and all(r.shard is None for r in rows if not r.taken)
        by = collections.Counter()
        for r in rows:
            assert 0 <= r.taken <= mixing.MAX_PASSES * r["size"]
            by[r.source_size] += r.taken
            sources[r.source_size] = r.target
        totals[shards] = by
        for s, t in sources.items():
            assert abs(by[s] - t) <= 3 * mixing.BLOCK_WORDS + shards
    assert taken[1] != taken[8]


def test_runs_take_their_quotas(spark):
    """Every (source, shard) run holds its Sainte-Lague quota of blocks, give or take a word."""
    docs = table(spark, SF, "documents")
    sources = mixing.targets(mixing._base(docs, F.struct("doc_id"), "mix")).cache()
    size = {r.skey: r for r in sources.collect()}
    quota = {(r.skey, r.shard): (r.quota, r.blocks) for r in mixing.quotas(sources, shards=4).collect()}
    rows = mixing.runs(sources, shards=4).collect()
    assert {(r.skey, r.shard) for r in rows} == set(quota)
    ends = collections.defaultdict(int)
    for r in sorted(rows, key=lambda r: (r.skey, r.shard)):
        n, blocks = quota[r.skey, r.shard]
        assert r.low == ends[r.skey] and r.low <= r.first <= max(r.low, r.high - 1) and 0 <= r.rest <= r.high - r.low
        ends[r.skey] = r.high
        if size[r.skey].target < mixing.MAX_PASSES * size[r.skey].source_size:
            assert abs(r.passes * (r.high - r.low) + r.rest - n * size[r.skey].words / blocks) <= 4
    assert all(ends[k] == size[k].source_size for k in ends)


def test_near_duplicates_store_names_without_texts(spark):
    from tallyray.llm import weighted_minhash as wm
    words = [" ".join(f"w{(i * k) % 97}" for k in range(60)) for i in (3, 5, 7)]
    docs = spark.createDataFrame([(1, words[0]), (2, words[0] + " more"), (3, words[1]), (4, words[2]), (5, words[2]), (6, None)], "doc_id long, text string")
    rows, _ = wm._named_classes(docs)
    assert rows.columns == ["doc_id", "x1", "x2", "bands", "samples"]
    assert {r.doc_id: r.class_id for r in wm.classes(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 6}
