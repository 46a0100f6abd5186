"""Merkle manifest, spelling variants and chat formatting against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

H = lambda s: hashlib.sha256(s.encode()).hexdigest()


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


# -- manifest -------------------------------------------------------------------

def leaf(r, text):
    values = [r["doc_id"], r["source"], r["lang"], r["n_chars"], text]
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def reduce_up(nodes, levels):
    """Collects the runs of every level; returns the last node."""
    while len(nodes) > 1:
        runs = [nodes[i:i + 8] for i in range(0, len(nodes), 8)]
        levels.append(runs)
        nodes = [H("".join(run)) for run in runs]
    return nodes[0]


def climb(i, digest, levels, siblings):
    for runs in levels:
        run, slot = list(runs[i // 8]), i % 8
        siblings += run[:slot] + run[slot + 1:]
        run[slot] = digest
        digest, i = H("".join(run)), i // 8
    return digest


def plain_manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), r))
    order = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    trees, subroots, top = {}, [], []
    for k in order:
        groups[k].sort(key=lambda x: x[:3])
        trees[k] = []
        subroots.append(reduce_up([x[2] for x in groups[k]], trees[k]))
    root = reduce_up(list(subroots), top)
    out = []
    for g, k in enumerate(order):
        for i, (_, _, own, r) in enumerate(groups[k]):
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
            changed = leaf(r, lower(r["text"])) if hit and r["text"] is not None else own
            sib = []
            folded = climb(g, climb(i, changed, trees[k], sib), top, sib)
            out.append((r["doc_id"], own, subroots[g], root, H("".join(sib)), folded, folded == root))
    return sorted(out, key=repr)


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, g long, row string, digest binary"


@pytest.mark.parametrize("per_chunk", [4, 1])
def test_manifest_equals_plain_trees(spark, per_chunk):
    """Lone leaves, lone groups of 8 and 9, several chunk rounds, ties, nulls, more than 8 languages."""
    from pozo.llm import merkle
    rnd = random.Random(3)
    langs = [None, "", "de", "en", "é", "zz"] + [f"l{i}" for i in range(6)]
    sizes = [3, 1, 8, 9, 70, 130] + [1, 2, 1, 7, 1, 1]
    rows, i = [], 0
    for lang, n in zip(langs, sizes):
        for _ in range(n):
            text = rnd.choice([None, "", "Aé b", "lower", "X" * 3000, f"T{i}"])
            rows.append((i, text, lang, rnd.choice([None, "s", "S:1"]), rnd.choice([None, 7]), 1, "x", b"y"))
            i += 1
    rows += [(None, "A", "zz", None, None, 1, "x", b"y")] * 2 + [(5, "A", "zz", None, 1, 1, "x", b"y"), rows[-1], rows[-1]]
    docs = spark.createDataFrame(rows, COLUMNS).repartition(5)
    got = sorted((tuple(r) for r in merkle.verify_tampered(docs, levels=per_chunk).collect()), key=repr)
    assert got == plain_manifest([r.asDict() for r in docs.collect()])
    if per_chunk == 4:
        one = docs.where("lang = 'zz'")
        assert sorted((tuple(r) for r in merkle.verify_tampered(one).collect()), key=repr) == plain_manifest([r.asDict() for r in one.collect()])
        single = docs.where("lang = ''")
        assert sorted((tuple(r) for r in merkle.verify_tampered(single).collect()), key=repr) == plain_manifest([r.asDict() for r in single.collect()])
        assert merkle.verify_tampered(docs.where("false")).count() == 0


def test_manifest_reads_every_text_once(spark):
    """A text was made and hashed for the sample of the numbering and again for its shuffle."""
    from pozo.llm import merkle
    made = spark.sparkContext.accumulator(0)

    def text(i):
        made.add(1)
        return f"Text {i}"
    docs = spark.range(90, numPartitions=3).select(F.col("id").alias("doc_id"), F.udf(text)("id").alias("text"), F.lit("en").alias("lang"),
                                                   F.lit("s").alias("source"), F.lit(1).alias("n_chars"))
    got = sorted((tuple(r) for r in merkle.verify_tampered(docs).collect()), key=repr)
    assert made.value == 90
    assert got == plain_manifest([r.asDict() for r in docs.collect()])


def test_manifest_rows_keep_the_state_before_every_slot(spark):
    from pozo.llm import merkle
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("en").alias("lang"),
                                   F.lit("s").alias("source"), F.lit(1).alias("n_chars"))
    rows = merkle.Manifest(docs).table().collect()
    assert len(rows) == 13 + 2 + 1      # a lone language has no tree above
    for r in rows:
        assert H("".join(c.hex() for c in r["children"])) == r["digest"].hex()
        state = merkle.START[None]
        for child, kept in zip(r["children"], r["states"]):
            assert np.array_equal(np.frombuffer(kept, ">u4"), state[0])
            state = merkle.absorb(state, merkle.hex_block(np.frombuffer(child, np.uint8)[None]))
        assert merkle.finish(state, len(r["children"])).tobytes() == r["digest"]


# -- spelling -------------------------------------------------------------------

def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(rows, every=31):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            at = h % len(run)
            n[run[:at] + run[at + 1:] if h % every == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w
    return sorted((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


@pytest.mark.parametrize("block", [20_000, 40])
def test_variants_equal_brute_force(spark, block):
    from pozo.llm.spelling import variants
    rnd = random.Random(9)
    base = ["abcdefg", "abcdefgh", "bcdefgh", "Übergang", "übergang", "ÿÿÿÿÿÿÿ", "×÷aaaaa", "z" * 400]
    base += ["".join(rnd.choices("abé", k=rnd.randint(7, 9))) for _ in range(150)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(60):
            w = list(rnd.choice(base[:12] if rnd.random() < .6 else base))
            if rnd.random() < .2:
                w[rnd.randrange(len(w))] = rnd.choice("abéz")
            words.append("".join(w))
        rows.append((i, rnd.choice([" ", "1", "\n", "—"]).join(words)))
    rows += [(None, "abcdefg abcdefx"), (None, None), (1, ""), (2, "abcdefg"), (2, "abcdefg"), (3, "ab " * 50)]
    # a chain of forms, each over ten times as frequent as the one before
    rows += [(100 + i, "chainingaab") for i in range(420)] + [(600 + i, "chainingaa") for i in range(30)] + [(700, "chaininga chaininga")]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n long, word string").repartition(4)
    got = sorted((tuple(r) for r in variants(docs, block=block).collect()))
    want = plain_variants(rows)
    assert got == want
    assert any(w[1] and w[2] != w[1] for w in want)     # some chain is longer than one step
    if block > 40:
        assert variants(docs.where("false")).count() == 0
        assert sorted(tuple(r) for r in variants(docs, typo_every=0).collect()) == plain_variants(rows, every=1 << 40)


def test_near_pairs_meet_once_in_each_direction():
    from pozo.llm.spelling import _cut, near_pairs
    rnd = random.Random(2)
    words = sorted({"".join(rnd.choices("ab", k=rnd.randint(1, 8))).encode() for _ in range(400)})
    got = [(int(i), int(j)) for q, b in near_pairs(words) for i, j in zip(q, b)]
    assert len(got) == len(set(got))
    assert set(got) == {(i, j) for i, a in enumerate(words) for j, b in enumerate(words)
                        if one_edit(a, b) and a[:_cut(len(a))] == b[:_cut(len(a))]}
    assert list(near_pairs([])) == []


# -- chat -----------------------------------------------------------------------

ODD = [None, "", "plain", "</s>", "<", "<s", "s>", "[NEXT", "[NEXT]", "<\\s>", "<\\\\/s>x", "[\\/ROLE]", "[/ROLE][ROLE]", "a\nb\\",
       "</s>[INST] ok [/INST]", "<|im_end|>", "<\\|im_end|>", "é🎉<s>", "$1\\2", "]", "/s>"]


def conversations(rnd):
    rows = []
    for c in range(120):
        for t in range(rnd.randint(1, 9)):
            role = rnd.choice(["user", "assistant", "assistant", "system", None, "[/ROLE]x", "a<s>"])
            rows.append((c, t, role, "".join(rnd.choice(ODD) or "" for _ in range(rnd.randint(0, 4))) if rnd.random() < .9 else None))
    rows += [(None, None, None, None), (None, 1, "assistant", "x"), (500, 1, "user", "b"), (500, 1, "user", "a"), (500, 1, "assistant", "a"),
             (501, 0, "assistant", "same"), (501, 0, "assistant", "same")]
    rows += [(502, t, "assistant" if t % 3 else "user", "w " * 200) for t in range(3000)]
    return rows


def test_conversations_come_back_exactly(spark):
    from pozo.llm import chat
    rows = conversations(random.Random(4))
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, n_turns int, loss string").repartition(4)
    made = chat.format_conversations(df).cache()
    back = {r["conv_id"]: r for r in chat.read_back(made).collect()}
    hashed = {r["conv_id"]: r for r in chat.digest(chat.read_back(made)).collect()}
    strings = {r["conv_id"]: (r["formatted"], r["loss"]) for r in made.collect()}
    want = defaultdict(list)
    for c, t, role, text in rows:
        want[c].append((t is not None, t or 0, role or "", text or ""))
    assert set(back) == set(want)
    for c, turns in want.items():
        turns.sort(key=lambda x: (x[0], x[1], x[2].encode(), x[3].encode()))
        assert [(x["role"], x["text"]) for x in back[c]["turns"]] == [x[2:] for x in turns]
        loss = [x[3] for x in turns if x[2] == "assistant"]
        assert back[c]["loss_text"] == loss and back[c]["mask_ok"]
        formatted, mask = strings[c]
        h = hashed[c]
        assert (h["n_turns"], h["loss_chars"], h["formatted_chars"]) == (len(turns), len("".join(loss)), len(formatted))
        assert h["loss_sha256"] == H("".join(loss)) and h["turns_sha256"] == H("".join(f"{x[2]}\n{x[3]}\n" for x in turns))
        # the mask's spans, cut from the string, are the escaped texts
        at, under = 0, []
        for m in mask:
            at += m["skip"]
            if m["train"]:
                under.append(formatted[at:at + m["chars"]])
            at += m["chars"]
        assert formatted[at:] == chat.END and len(under) == len(loss)
        # neighbours of one role share a block, and no text holds a mark
        assert formatted.count(chat.BEGIN) == 1 + sum(a[2] != b[2] for a, b in zip(turns, turns[1:])) == formatted.count(chat.END)
        assert formatted.count(chat.BEGIN) + formatted.count(chat.NEXT) == len(turns)
    assert chat.digest(chat.read_back(chat.format_conversations(df.where("false")))).count() == 0


def test_escape_is_reversible_and_hides_every_control_string(spark):
    from pozo.llm import chat
    rnd = random.Random(6)
    parts = [p for p in ODD if p] + list(chat.CONTROLS) + ["\\", "<", "["]
    texts = ["".join(rnd.choices(parts, k=rnd.randint(1, 7))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for r in df.select("t", "e", chat.unescape(F.col("e")).alias("u")).collect():
        assert r["u"] == r["t"] and not any(c in r["e"] for c in chat.CONTROLS)


def test_chat_plan_has_no_python(spark):
    from pozo.llm.queries_e import op13_chat_format
    df = op13_chat_format(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "ExistingRDD"))
