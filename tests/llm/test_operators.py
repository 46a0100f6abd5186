"""The ten operators against plain brute force on a small awkward corpus, and on empty tables."""

import base64
import hashlib
import math
import re
import tempfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

BLANK, ALNUM = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def split(t, pattern, low=True):
    return re.findall(pattern, lower(t) if low else (t or ""))


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_tokens_equal_the_library(documents, empty, vocabulary):
    from tokenizers import Tokenizer

    from pozo.llm.token_counts import RankMerger, token_counts
    lib = Tokenizer.from_file(vocabulary)
    want = sorted(((r["doc_id"], len((r["text"] or "").encode()), n := len(lib.encode(r["text"] or "", add_special_tokens=False).ids),
                    n > 1024) for r in documents.collect()), key=repr)
    assert rows_of(token_counts(documents, vocabulary), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    assert token_counts(empty, vocabulary).count() == 0
    odd = ["", "<|endoftext|>a<|endoftext|>", "aaaa" * 300, "  a \n\n  b", "日本語🎉", "it's 'S", "\x00\x85"]
    assert RankMerger(vocabulary).count(odd) == [len(e.ids) for e in lib.encode_batch(odd, add_special_tokens=False)]


def test_long_pretokens_equal_the_library(vocabulary):
    import random
    import time

    from tokenizers import Tokenizer

    from pozo.llm.token_counts import LONG, RankMerger
    lib, own, rnd = Tokenizer.from_file(vocabulary), RankMerger(vocabulary), random.Random(4)
    for letters in ("a", "ab", "abc", "theandof", "abcdefghijklmnopqrstuvwxyz", "é日a", "=-_", "01"):
        for n in (LONG - 1, LONG, 700, 5001):
            text = "".join(rnd.choices(letters, k=n))
            assert own.count([text]) == [len(lib.encode(text, add_special_tokens=False).ids)], (letters, n)
    for n in range(2, 40):      # the same way on short strings
        b = "".join(rnd.choices("aab", k=n)).encode()
        assert own.merge_long(b) == own.merge([b])[0]
    blob = base64.b64encode(rnd.randbytes(200_000)).decode().replace("+", "p").replace("/", "s")
    words = "".join(x for x in blob if x.isalpha())
    start = time.monotonic()
    assert own.count([words]) == [len(lib.encode(words, add_special_tokens=False).ids)]
    assert time.monotonic() - start < 10


def test_shards_follow_the_key(documents, empty):
    from pozo.llm.hash_tree import Shard, descend, grown_tree, shard_rows, uniform_tree
    got = shard_rows(documents, 40).collect()
    assert len(got) == documents.count() and shard_rows(empty, 40).count() == 0
    by_id, slots = defaultdict(set), defaultdict(list)
    for r in got:
        assert 0 <= r["shard"] < 40 and r["grown_shard"] in (r["shard"], 40) and r["rack"] == r["shard"] // 4
        by_id[r["doc_id"]].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
    assert all(len(s) == 1 for s in by_id.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted((r["size"], r["text_crc32"]) for r in got) == sorted(
        (16 + len((r["text"] or "").encode()), zlib.crc32((r["text"] or "").encode())) for r in documents.collect())
    assert all(r["region"] == r["shard"] // 8 for r in got)
    # every shard that is added alone takes rows only into itself
    ids = documents.sparkSession.range(20000)
    key = [F.col("id")]
    at = [descend(key, uniform_tree(n))["shard"].alias(f"s{n}") for n in range(8, 12)]
    moved = ids.select(*at).collect()
    assert all(b in (a, n) for r in moved for n, (a, b) in zip((8, 9, 10), zip(r[:3], r[1:4])))
    share = Counter(r["s8"] for r in moved)
    assert max(abs(c - 2500) for c in share.values()) < 250
    # a heavier shard draws rows only into the subtrees on its path
    tree = uniform_tree(24)
    heavy = [Shard(n.region, n.rack, n.shard, 3.0 if n.shard == 2 else 1.0) for n in tree]
    moved = ids.select(descend(key, tree).alias("a"), descend(key, heavy).alias("b")).collect()
    assert all(r["b"] == r["a"] or (r["b"]["region"] == 0 and (r["a"]["region"] != 0 or r["b"]["rack"] == 0)) for r in moved)
    assert abs(sum(r["b"]["shard"] == 2 for r in moved) - 20000 * 3 / 26) < 400
    assert grown_tree(uniform_tree(40)) == uniform_tree(41)


def test_shards_equal_a_plain_tree(documents):
    import struct

    import xxhash

    from pozo.llm.hash_tree import LEVELS, Shard, descend, grown_tree, shard_rows, uniform_tree

    def draw(level, node, weight, key):
        h = 42
        for value, kind in ((0, "<i"), (level, "<i"), (node, "<i"), (key, "<q")):
            if value is not None:
                h = xxhash.xxh64(struct.pack(kind, value), seed=h).intdigest()
        return -math.log(((h >> 11) + 0.5) / (1 << 53)) / weight

    def walk(tree, key):
        nodes, path = [n for n in tree if n.weight > 0], []
        for level, name in enumerate(LEVELS):
            weights = Counter()
            for n in nodes:
                weights[getattr(n, name)] += n.weight
            path.append(min(weights, key=lambda i: (draw(level, i, weights[i], key), i)))
            nodes = [n for n in nodes if getattr(n, name) == path[-1]]
        return tuple(path)

    odd = [Shard(0, 0, 5, 2.5), Shard(0, 0, 1, 0.0), Shard(0, 3, 9, 1.0), Shard(4, 7, 2, 0.25), Shard(4, 8, 3, 4.0)]
    for tree in (uniform_tree(40), uniform_tree(11), uniform_tree(1), odd):
        got = documents.sparkSession.range(500).select("id", descend([F.col("id")], tree).alias("p")).collect()
        assert all(tuple(r["p"]) == walk(tree, r["id"]) for r in got)
    for r in shard_rows(documents, 40).collect():
        assert (r["region"], r["rack"], r["shard"]) == walk(uniform_tree(40), r["doc_id"])
        assert r["grown_shard"] == walk(grown_tree(uniform_tree(40)), r["doc_id"])[2]


def test_warc_round_trip(spark, corpus):
    from pozo.llm.warc import read_archives, write_archives
    html = [t for t in corpus] + ["WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n", "\r\n\r\n", None, "é\r\n\r\n"]
    rows = [(i, f"http://x/{i}\r\ny", h) for i, h in enumerate(html)] + [(None, None, "only"), (None, "u", "é\r\n\r\n"), (3, "v", "one")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = tempfile.mkdtemp(prefix="pozo-warc-", dir="/tmp") + "/w"
    got = rows_of(read_archives(spark, write_archives(pages, path)), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    top = {}
    for i, _, h in rows:
        if i is not None:
            top[h or ""] = max(i, top.get(h or "", i))
    want = []
    for i, _, h in rows:
        p = (h or "").encode()
        first = top.get(h or "")
        again = first is not None and i != first
        want.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", first if again else None))
    assert got == sorted(want, key=repr)
    none = write_archives(pages.where("false"), path + "0")
    assert read_archives(spark, none).count() == 0


def plain_targets(sizes):
    """The sharing rule, word by word: share out, stop at the caps, share the excess again."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target = {s: 0.0 for s in order}
    pot, open_ = 1.5 * sum(sizes.values()), set(order)
    while pot > 1e-9 and open_:
        whole = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += pot * weight[s] / whole
        pot = 0.0
        for s in list(open_):
            if target[s] >= 2 * sizes[s] - 1e-12:
                pot += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
    return target


def test_any_number_of_disjoint_sources(spark):
    from pozo.llm.mixing import mix_disjoint, spark_targets
    import random
    rnd = random.Random(12)
    names = [None, "", "é", "Z"] + [f"host{i}" for i in range(400)]
    sizes = {s: rnd.choice([0, 1, 5, 50, 3000, 10 ** 6]) for s in names}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long").repartition(7)
    got = {r["source"]: (r["size"], r["target"]) for r in spark_targets(df).collect()}
    want = plain_targets(sizes)
    assert {s: n for s, (n, _) in got.items()} == sizes
    assert {s: t for s, (_, t) in got.items()} == pytest.approx(want, rel=1e-6, abs=1e-3)
    assert spark_targets(df.where("false")).count() == 0 and spark_targets(df.where("size = 0")).where("target > 0").count() == 0
    # every document of every source, chosen in hash order to the nearest document
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("h"), F.col("id") % 700).alias("source"),
                                    F.repeat(F.lit("w "), (F.col("id") * 7919 % 13).cast("int")).alias("text"))
    rows = mix_disjoint(docs, F.col("source")).collect()
    per = defaultdict(list)
    for r in rows:
        per[r["members"][0]].append(r)
    want = plain_targets({s: sum(r["size"] for r in x) for s, x in per.items()})
    assert len(rows) == 6000
    for s, x in per.items():
        assert abs(sum(r["taken"] for r in x) - want[s]) <= max(r["size"] for r in x) / 2 + 1 and all(r["copies"] <= 2 for r in x)
        assert all(r["target"] == pytest.approx(want[s]) for r in x)


def test_mix_reaches_targets(documents, empty):
    from pozo.llm.mixing import route, source_report, weighted_targets
    got = source_report(documents).collect()
    again = source_report(documents).collect()
    key = lambda r: (r["doc_id"], r["size"], r["taken"])
    assert sorted(map(key, got), key=repr) == sorted(map(key, again), key=repr)
    assert len(got) == documents.count() and source_report(empty).count() == 0
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        assert r["taken"] <= 2 * r["size"]
    want = plain_targets(dict(sizes))
    assert want == pytest.approx(weighted_targets(dict(sizes)))
    assert abs(sum(want.values()) - 1.5 * sum(sizes.values())) < 1e-6
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1
    assert all(r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]] for r in got)
    # overlapping sources: convex costs spread before they repeat
    flow = route({("a",): 10, ("a", "b"): 10, ("b",): 10}, {"a": 15, "b": 15})
    assert all(sum(f.values()) == 10 for f in flow.values())
    flow = route({("a",): 10, ("a", "b"): 10}, {"a": 25, "b": 10})
    assert sum(f.get("a", 0) for f in flow.values()) == 25 and sum(f.get("b", 0) for f in flow.values()) == 10


def flowing(monkeypatch):
    """The flow of every network is replaced by half of its words (by value: tasks don't import this file)."""
    from pozo.llm import mixing
    namespace: dict = {}
    exec("half = lambda patterns, quotas, repeats=2: {p: {s: n // 2 for s in p} for p, n in patterns.items()}", namespace)
    monkeypatch.setattr(mixing, "route", namespace["half"])


def test_networks_are_solved_by_the_flow(spark, documents, monkeypatch):
    from pozo.llm.mixing import network_flows, route, source_report
    networks = [([((0,), 10), ((0, 1), 10), ((1,), 10)], [15.0, 15.0]), ([((0,), 10), ((0, 1), 10)], [25.0, 10.0]),
                ([((0,), 7)], [3.5]), ([((0,), 7)], [99.0]), ([((0,), 0)], [0.0]), ([], [])]
    df = spark.createDataFrame(networks, "p array<struct<members: array<int>, size: long>>, q array<double>").repartition(3)
    for r in df.select("p", "q", network_flows(F.col("p"), F.col("q")).alias("give")).collect():
        flows = route({tuple(x["members"]): x["size"] for x in r["p"]}, dict(enumerate(r["q"])))
        assert r["give"] == [sum(flows[tuple(x["members"])].values()) for x in r["p"]]
        assert sum(r["give"]) == min(sum(round(q) for q in r["q"]), 2 * sum(x["size"] for x in r["p"]))
    # the report's words come from the flow
    flowing(monkeypatch)
    size, taken, largest = Counter(), Counter(), Counter()
    for r in source_report(documents).collect():
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert size and all(abs(taken[s] - size[s] // 2) <= largest[s] / 2 + 1 for s in size)


@pytest.mark.parametrize("hot", [20_000, 1])
def test_repeated_windows(documents, empty, hot):
    from pozo.llm.super_kmers import drop_repeats
    rows = documents.collect()
    texts = [split(r["text"], BLANK, low=False) for r in rows]
    seen = Counter(tuple(w[i:i + 35]) for w in texts for i in range(len(w) - 34))
    want = []
    for r, w in zip(rows, texts):
        gone = {j for i in range(len(w) - 34) if seen[tuple(w[i:i + 35])] > 1 for j in range(i, i + 35)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        want.append((r["doc_id"], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    assert rows_of(drop_repeats(documents, hot=hot), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(want, key=repr)
    assert sum(x[2] for x in want) > 300 and drop_repeats(empty).count() == 0


def test_benchmark_windows(spark, documents, empty, corpus):
    from pozo.llm.winnowing import clean_rows, decontaminate
    some = [t for t in corpus if t and len(t.split()) > 60]
    items = [(1, " ".join(some[3].split()[5:40])), (10, " ".join(some[5].split()[:10])), (2, " ".join(some[3].split()[20:50]).upper()),
             (3, None), (4, ""), (5, "a b c d"), (None, " ".join(some[6].split()[:12])), (7, "one"), (7, " ".join(some[7].split()[:9]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    wins = defaultdict(set)
    for i, t in items:
        w = split(t, ALNUM)
        n = min(10, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            wins[tuple(w[a:a + n])].add(i)
    want = []
    for r in documents.collect():
        w = split(r["text"], ALNUM)
        hit, ids = set(), set()
        for n in {len(k) for k in wins}:
            for a in range(len(w) - n + 1):
                if tuple(w[a:a + n]) in wins:
                    hit |= set(range(a, a + n))
                    ids |= {str(i) for i in wins[tuple(w[a:a + n])] if i is not None}
        want.append((r["doc_id"], len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert rows_of(decontaminate(documents, bench), *cols) == sorted(want, key=repr)
    assert sum(x[5] for x in want) >= 6
    assert decontaminate(empty, bench).count() == 0
    assert decontaminate(documents, bench.where("false")).where("contaminated").count() == 0
    assert clean_rows(documents, bench).count() == sum(not x[5] for x in want)


def brute_classes(rows, k, percent):
    sets = []
    for r in rows:
        w = split(r["text"], BLANK)
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a
    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        if r["doc_id"] is not None:
            low[find(i)] = min(r["doc_id"], low.get(find(i), r["doc_id"]))
    return sorted(((r["doc_id"], len(sets[i]), low.get(find(i)) if sets[i] else r["doc_id"]) for i, r in enumerate(rows)), key=repr)


@pytest.mark.parametrize("k,percent,block", [(4, 85, 3000), (5, 80, 4)])
def test_shingle_classes(documents, empty, k, percent, block):
    from pozo.llm.jaccard import classes
    want = brute_classes(documents.collect(), k, percent)
    assert rows_of(classes(documents, k, percent, block=block), "doc_id", "n_shingles", "component_id") == want
    if block == 4:
        assert classes(empty).count() == 0


def test_common_lines_and_large_cells_do_not_meet_in_one_task(spark, words):
    import random

    from pozo.llm.jaccard import Rule, _describe, classes, deal, small_places
    from pozo.llm.frames import row_key
    rnd = random.Random(8)
    line = " ".join(rnd.choices(words, k=14))
    texts = [f"{line} {' '.join(rnd.choices(words, k=18))}" for _ in range(200)]
    texts += [" ".join([*t.split()[:-1], "other"]) for t in texts[:20]]          # one shingle of 28 differs
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    base = docs.select(F.col("doc_id").alias("_id"), *row_key("doc_id", "text"), "text")
    slim = base.mapInArrow(_describe(5, Rule(80)), "_id long, _k1 long, _k2 long, n long, s1 long, s2 long, sketch binary, few binary")
    places = small_places(slim, Rule(80)).groupBy("place").count().agg(F.max("count")).first()[0]
    assert places == 2                                                             # the line's shingles are in 220 sets
    got = {r["doc_id"]: r["component_id"] for r in classes(docs, block=7).collect()}
    assert got == {i: i - 200 if i >= 200 else i for i in range(220)}
    rows = spark.range(100).select(F.lit(1).alias("cell"), F.col("id").alias("s1")).union(spark.range(100, 103).select(F.lit(2), "id"))
    met = defaultdict(set)
    for r in deal(rows, "cell", ["s1"], 20).collect():
        met[r["cell"], r["_i"], r["_j"]].add(r["s1"])
    assert met.pop((2, 0, 0)) == {100, 101, 102} and max(map(len, met.values())) < 80
    assert {(a, b) for s in met.values() for a in s for b in s} == {(a, b) for a in range(100) for b in range(100)}


def test_rows_without_words_are_all_kept(spark):
    from pozo.llm.jaccard import one_per_class
    rows = [(1, None, "a"), (1, None, "b"), (1, None, "b"), (2, " \t\x0b\n", "a"), (2, " \t\x0b\n", "b"), (None, "", "a"), (None, "", "c"),
            (3, "some words", "a"), (3, "some words", "b"), (4, "Some  words", "a"), (5, "\x85", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = Counter((r["doc_id"], r["text"], r["source"]) for r in one_per_class(docs).collect())
    assert sum(n for r, n in got.items() if r[0] == 3) == 1 and (4, "Some  words", "a") not in got
    assert +Counter({r: n for r, n in got.items() if r[0] != 3}) == Counter([*rows[:7], rows[10]])


def test_region_join_is_exact():
    from pozo.llm.jaccard import Region, Rule
    rng = np.random.default_rng(3)
    rule = Rule(85)
    base = [np.unique(rng.integers(0, 1 << 60, 200, dtype=np.uint64)) for _ in range(6)]
    sets = []
    for i in range(140):
        s = base[i % 6].copy()
        keep = rng.random(len(s)) > rng.choice([0.0, 0.05, 0.1, 0.2])
        sets.append(np.unique(np.r_[s[keep], rng.integers(0, 1 << 60, int(rng.integers(0, 12)), dtype=np.uint64)]))
    join = Region(sets, rule)
    join.join(limit=8)
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            n = len(np.intersect1d(sets[i], sets[j]))
            if rule.linked(n, len(sets[i]) + len(sets[j])) and root[i] != root[j]:
                root = [root[j] if x == root[i] else x for x in root]
    groups = lambda r: sorted(sorted(np.flatnonzero(np.array(r) == x).tolist()) for x in set(np.array(r).tolist()))
    assert groups(root) == groups(join.root)


def test_regions_of_long_sets_are_compared_in_pieces():
    import tracemalloc

    from pozo.llm.jaccard import Region, Rule
    gen = np.random.default_rng(4)
    base = np.unique(gen.integers(0, 2**63, 20000, dtype=np.uint64))
    sets = [np.sort(np.r_[base[i:], gen.integers(0, 2**63, i, dtype=np.uint64)]) for i in range(300)]
    join = Region(sets, Rule(80))
    tracemalloc.start()
    inter = join.shared(0, np.arange(300))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert inter.tolist() == [len(np.intersect1d(sets[0], x)) for x in sets] and peak < 64 << 20   # all at once: 189 MB
    assert len(join.join()) == 299


def test_vectors(spark):
    from pozo.llm.rp_forest import near_duplicates
    rng = np.random.default_rng(1)
    rows = []
    for i in range(300):
        v = rng.standard_normal(16) if i % 3 or i < 6 else rows[i - 6][1] + 0.08 * rng.standard_normal(16)
        rows.append((i, v, i % 2))
    rows += [(300 + i, rows[5][1], 1) for i in range(4)]
    data = [(i, [float(x) for x in v], lab) for i, v, lab in rows]
    nan, inf = float("nan"), float("inf")
    odd = [(400, None, 0), (401, [0.0] * 16, 0), (402, [nan] * 16, 0), (403, [inf] + [0.0] * 15, 0), (404, [None] + [1.0] * 15, 0),
           (405, data[5][1], None), (406, [], 0), (None, data[7][1], 1), (407, [1.0, 2.0], 0), (408, [2.0, 4.0], 0)]
    df = spark.createDataFrame(data + odd, "vec_id long, embedding array<double>, label int").withColumn("n_links", F.lit("x"))
    got = {r["vec_id"]: r for r in near_duplicates(df, leaf=40, block=16).collect()}
    good = [(i, np.array(v), lab) for i, v, lab in data + [odd[7], odd[8], odd[9]]]
    near = defaultdict(set)
    for a, (i, v, lab) in enumerate(good):
        for b, (j, w, lab2) in enumerate(good):
            if a != b and lab == lab2 and len(v) == len(w) and v @ w / (np.linalg.norm(v) * np.linalg.norm(w)) >= 0.93:
                near[i].add(b)
    total = sum(map(len, near.values()))
    assert total > 100 and all(got[i]["n_links"] <= len(near[i]) for i, _, _ in good)
    assert sum(got[i]["n_links"] for i, _, _ in good) >= 0.95 * total
    assert got[407]["component_id"] == got[408]["component_id"] == 407 and not got[408]["kept"]
    assert got[300]["component_id"] <= 5 and not got[300]["kept"]
    for i in range(400, 407):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert near_duplicates(df.where("false")).count() == 0


def test_license_phrases(documents, empty):
    from pozo.llm.license_scan import PASSAGES, Template, scan
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    extra = documents.sparkSession.createDataFrame(
        [(900, "cc by nc cc by nc CC_BY-NC under the mit under the MIT license"), (901, "x " + PASSAGES[0].text.replace("free of", "free very of")),
         (902, None)], "doc_id long, text string")
    df = documents.select("doc_id", "text").unionByName(extra)
    want = []
    for r in df.collect():
        w = split(r["text"], ALNUM)
        at = sorted((i, lab) for p, lab in phrases.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split())
        want.append((r["doc_id"], len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at}))))
    got = scan(df)
    assert rows_of(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted(want, key=repr)
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[901]["labels"] == "mit" and by[901]["base_labels"] == "" and by[901]["score"] >= 0.8   # merged over an added word
    assert by[900]["labels"] == "cc-by-nc,mit" and all(0 <= r["score"] <= 1 for r in by.values())
    assert scan(empty).count() == 0
    with pytest.raises(ValueError):
        scan(df, passages=[Template("x", "too short")]).count()


def test_license_bodies(spark):
    from pozo.llm.license_scan import scan, template_words
    from pozo.llm.license_texts import BODIES
    noise = "one two three four five six seven "
    names = list(BODIES)
    rows = [(i, noise * 3 + "Copyright Ana. All rights reserved. " + BODIES[n].upper() + " " + noise) for i, n in enumerate(names)]
    rows += [(100 + i, "# " + BODIES[n].replace("\n", "\n# ").replace("software", "very software", 1)) for i, n in enumerate(names)]
    rows += [(200 + i, " ".join(template_words(BODIES[n])[::-1])) for i, n in enumerate(names)]
    rows += [(300, "the software is provided to the public and the use of this software is free, without warranty of any kind"),
             (301, "in no event shall the author be liable; redistribution in binary form is permitted for any purpose")]
    got = {r["doc_id"]: r for r in scan(spark.createDataFrame(rows, "doc_id long, text string"), base=[]).collect()}
    also = {"bsd-2": {"bsd"}, "bsd-3": {"bsd"}}
    for i, n in enumerate(names):
        assert set(got[i]["labels"].split(",")) == {n, "all-rights-reserved"} | also.get(n, set())
        whole = max(f["last"] - f["lo"] + 1 for f in got[i]["found"] if f["label"] == n)
        assert whole == len(template_words(BODIES[n]))
        assert set(got[100 + i]["labels"].split(",")) == {n} | also.get(n, set())
    assert all(got[i]["labels"] == "" for i in got if i >= 200)


def test_languages(spark):
    from pozo.llm.language_id import held_out, identify, learn
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = learn(docs.where(~held_out()))
    got = identify(docs, model, [F.col("doc_id"), held_out().alias("held_out")]).join(docs.select("doc_id", "lang"), "doc_id").collect()
    test = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == r["lang"] for r in test) >= 0.95 * len(test)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 %% 34"), (4, "la maison"), (None, "the")], "doc_id long, text string")
    by = {r["doc_id"]: r for r in identify(odd, model, [F.col("doc_id")]).collect()}
    assert all(by[i]["lang_pred"] == "und" and by[i]["rejected"] and by[i]["score"] == 0 for i in (1, 2, 3))
    assert by[4]["lang_pred"] in model.languages and not math.isnan(by[None]["score"])
    assert learn(docs.where("false")) is None and identify(docs.where("false"), model).count() == 0
    assert identify(odd, None).where("lang_pred != 'und'").count() == 0


def test_far_texts_are_rejected_and_short_clean_ones_stay(spark):
    import random
    import string

    import corpus_pipeline
    from pozo.llm.language_id import held_out, identify, learn
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = learn(docs.where(~held_out()))
    rnd = random.Random(3)
    junk = ["Все счастливые семьи похожи друг на друга, каждая несчастливая семья несчастлива по-своему.",
            "모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다.",
            "كل إنسان يولد حرا ومتساويا في الكرامة والحقوق وقد وهبوا عقلا وضميرا.",
            "人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心。", "すべての人間は、生まれながらにして自由である。"]
    junk += ["".join(rnd.choices(string.ascii_lowercase, k=n)) for n in (60, 120, 500, 5000)]
    junk += [" ".join("".join(rnd.choices(string.ascii_lowercase, k=rnd.randint(2, 9))) for _ in range(n)) for n in (15, 80, 800)]
    junk += [base64.b64encode(rnd.randbytes(n)).decode() for n in (60, 600)]
    clean = [r["text"][:n] for r in docs.where(held_out() & F.col("text").rlike("^[^0-9]{60}")).collect() for n in (8, 16, 32, 60)]
    rows = spark.createDataFrame([(i, x, len(junk) > i) for i, x in enumerate(junk + clean)], "doc_id long, text string, junk boolean")
    by = {r["doc_id"]: r for r in identify(rows, model, [F.col("doc_id")]).collect()}
    assert [junk[i] for i in range(len(junk)) if not by[i]["rejected"]] == []
    assert len(clean) > 100 and sum(by[i]["rejected"] for i in range(len(junk), len(by))) <= 0.01 * len(clean)
    # in the stage: the junk goes, labelled documents stay
    mixed = docs.select("doc_id", "text", "lang").unionByName(rows.where("junk").selectExpr("-1 - doc_id as doc_id", "text", "null as lang"))
    kept = corpus_pipeline.language(spark, mixed, "").collect()
    assert not [r["text"] for r in kept if r["doc_id"] < 0] and len(kept) >= 0.99 * docs.where("text rlike '\\\\p{L}'").count()


def test_mixture_stage_takes_what_the_flow_gives(spark, documents, monkeypatch):
    import corpus_pipeline
    docs = documents.where("doc_id is not null").dropDuplicates(["doc_id"]).cache()
    size, largest = Counter(), Counter()
    for r in docs.collect():
        n = len(split(r["text"], BLANK, low=False))
        size[r["source"]] += n
        largest[r["source"]] = max(largest[r["source"]], n)
    flowing(monkeypatch)
    taken = Counter()
    for r in corpus_pipeline.mixture(spark, docs, "").collect():
        taken[r["source"]] += len(split(r["text"], BLANK, low=False))
    assert size and all(abs(taken[s] - size[s] // 2) <= largest[s] / 2 + 1 for s in size)


def test_route_is_a_largest_flow_of_least_cost():
    import random
    from pozo.llm.mixing import route
    rnd = random.Random(3)
    for _ in range(300):
        k, repeats = rnd.randint(1, 5), rnd.randint(1, 3)
        quotas = {s: rnd.uniform(0, 80) for s in range(k)}
        pats = {tuple(sorted(rnd.sample(range(k), rnd.randint(1, k)))): rnd.randint(0, 30) for _ in range(rnd.randint(0, 9))}
        flow = route(pats, quotas, repeats)
        assert all(sum(f.get(s, 0) for f in flow.values()) <= round(quotas[s]) for s in quotas)
        assert all(set(f) <= set(p) and sum(f.values()) <= repeats * pats[p] for p, f in flow.items())
        # the smallest cut with r copies of every pattern
        cut = lambda r, s: sum(round(quotas[i]) for i in s) + sum(r * n for p, n in pats.items() if not set(p) <= s)
        sides = [{i for i in range(k) if b >> i & 1} for b in range(2 ** k)]
        most = [min(cut(r, s) for s in sides) for r in range(repeats + 1)]
        give = {p: sum(f.values()) for p, f in flow.items()}
        cost = sum(min(max(g - r * pats[p], 0), pats[p]) * r ** 2 for p, g in give.items() for r in range(repeats))
        assert sum(give.values()) == most[-1] and cost == sum((most[r + 1] - most[r]) * r ** 2 for r in range(repeats))
    # thousands of patterns in one network, as many words as the quotas want
    pats = {}
    while len(pats) < 6000:
        pats[tuple(sorted(rnd.sample(range(400), 2)))] = rnd.randint(1, 5000)
    quotas = {s: 1.2 * sum(pats.values()) / 400 for s in range(400)}
    assert sum(sum(f.values()) for f in route(pats, quotas).values()) == sum(round(q) for q in quotas.values())


def listed_documents(spark):
    """Documents of one source, of several (a row for each), twice under one, without an id, without words."""
    rows, text = [], lambda i: f"t{i} " * (5 + i * 7 % 11)
    for lo, hi, sources in [(0, 300, ["a"]), (300, 800, ["a", "b"]), (800, 950, ["b"]), (950, 1100, ["b", None]), (1100, 1200, [None]),
                            (1200, 1500, ["x"]), (1500, 1600, ["x", "y"]), (1600, 1900, ["y"]), (1900, 2100, ["z", "z"])]:
        rows += [(i, text(i), s) for i in range(lo, hi) for s in sources]
    rows += [(None, text(3), "z"), (None, text(4), "z"), (7, text(8), "z")] + [(5000, " ", s) for s in ("a", "x", "z", "w")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)


def mixed_by_hand(rows):
    """Words of sources and of (sorted) patterns, and the flow over all patterns at once."""
    from pozo.llm.mixing import route
    size, listed, of = Counter(), defaultdict(set), Counter()
    for i, t, s in rows:
        size[s] += len(t.split())
        listed[i, t].add(s)
        of[i, t] += len(t.split())
    pattern = {d: tuple(sorted(s, key=lambda x: (x is None, x or ""))) for d, s in listed.items()}
    words = Counter()
    for d, p in pattern.items():
        words[p] += of[d]
    flows = route({p: n for p, n in words.items() if n}, plain_targets(dict(size)))
    return size, pattern, of, words, {p: sum(f.values()) for p, f in flows.items()}


def copy_cost(give, words):
    return sum(max(0, g - words[p]) for p, g in give.items())


def test_networks_of_overlapping_sources_flow_as_one(spark):
    from pozo.llm.mixing import mix_networks, network_words
    rows, docs = listed_documents(spark)
    size, pattern, of, words, flow = mixed_by_hand(rows)
    df = spark.createDataFrame([(list(p), n, 1) for p, n in words.items()], "members array<string>, size long, n long").repartition(4)
    aim = spark.createDataFrame([(s, size[s], t) for s, t in plain_targets(dict(size)).items()], "source string, size long, target double")
    give = {tuple(r["members"]): r["give"] for r in network_words(df, aim).collect()}
    assert set(give) == set(words) and all(0 <= g <= 2 * words[p] for p, g in give.items())
    # a least-cost flow of the networks costs what that of the whole does, and is as large
    for net in ({"a", "b", None}, {"x", "y"}, {"z"}, {"w"}):
        mine, plain = ({p: g for p, g in f.items() if words[p] and set(p) <= net} for f in (give, flow))
        assert sum(mine.values()) == sum(plain.values()) and copy_cost(mine, words) == copy_cost(plain, words)
    # documents come once, with the words of all their rows and the sources of all
    got = mix_networks(docs, F.col("source")).collect()
    again = mix_networks(docs.repartition(2), F.col("source")).collect()
    plain = lambda r: (r["doc_id"], tuple(r["text_key"]), r["size"], r["members"], r["copies"], r["taken"])
    assert sorted(map(plain, got), key=repr) == sorted(map(plain, again), key=repr)
    assert Counter((tuple(r["members"]), r["size"]) for r in got) == Counter((p, of[d]) for d, p in pattern.items())
    taken = Counter()
    for r in got:
        assert r["copies"] in (0, 1, 2)
        taken[tuple(r["members"])] += r["taken"]
    assert all(abs(taken[p] - give[p]) <= max(of[d] for d in of if pattern[d] == p) / 2 + 1 for p in words)
    assert mix_networks(docs.where("false"), F.col("source")).count() == 0


def test_mixture_stage_mixes_documents_of_several_sources(spark):
    import corpus_pipeline
    rows, docs = listed_documents(spark)
    size, pattern, of, words, flow = mixed_by_hand(rows)
    listed = Counter(rows)
    out = Counter(map(tuple, corpus_pipeline.mixture(spark, docs, "").collect()))
    taken = Counter()
    for (i, t, s), n in out.items():
        assert n % listed[i, t, s] == 0 and n // listed[i, t, s] in (1, 2)
        assert all(out[i, t, x] * listed[i, t, s] == n * listed[i, t, x] for x in pattern[i, t])
        taken[pattern[i, t]] += n * len(t.split())
    # as many words as the flow gives, network by network
    for net in ({"a", "b", None}, {"x", "y"}, {"z"}, {"w"}):
        inside = [p for p in words if set(p) <= net]
        slack = sum(max(of[d] for d in of if pattern[d] == p) / 2 + 1 for p in inside)
        assert abs(sum(taken[p] for p in inside) - sum(flow.get(p, 0) for p in inside)) <= slack


def test_pipeline_on_awkward_rows(spark, documents, empty, tmp_path):
    import corpus_pipeline
    bench = spark.createDataFrame([(1, "no such words in any text of this small test corpus here")], "item_id long, text string")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == documents.columns and docs.count() > 0
    kept = spark.read.parquet(str(tmp_path / "near_duplicates"))
    assert kept.groupBy("text").count().where("count > 1").count() == 0
    assert corpus_pipeline.sharding(spark, docs, str(tmp_path)).count() == docs.count()
