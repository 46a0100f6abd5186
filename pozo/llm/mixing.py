"""Mix overlapping sources to target weights by a min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong
to), a table as small as the number of patterns. A min-cost flow routes the
patterns' words to the sources' quotas; every further repetition of a pattern
costs more than the one before, so nothing is repeated while unused words
would do. The flow says how many words each pattern gives; documents are then
chosen in a seeded order until the pattern's words are reached.

Only patterns that overlap compete. Sources that share no pattern with others
are a network of their own, and the flow of the whole is that of its networks.
So targets, patterns, networks and selection are Spark tables, and tasks solve the
flow of each network (:func:`mix_networks`; :func:`mix_disjoint` where a row has one
source only). :func:`mix` takes any quotas, and one flow on the driver solves all
patterns, whose number is bounded there.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pozo.llm.frames import connected, cut_lineage, shuffle_tasks

WORDS = "[^\\x20\\x09-\\x0D]+"


def weighted_targets(sizes: dict, weights: Sequence[float] = (5, 2, 1), share: float = 1.5,
                     most: float = 2.0) -> dict:
    """Target words of every source.

    Sources in code-point order (null last) weigh ``weights``, repeating, and
    share ``share`` times all words. A target stops at ``most`` times its
    source's words; the excess is shared anew by weight until none is above.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    left, target, open_ = share * sum(sizes.values()), {}, list(order)
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not full:
            target.update((s, left * weight[s] / total) for s in open_)
            break
        for s in full:
            target[s] = most * sizes[s]
        left -= sum(target[s] for s in full)
        open_ = [s for s in open_ if s not in target]
    return target


def min_cost_flow(arcs: list[tuple[int, int, int, float]], nodes: int, source: int, sink: int) -> list[int]:
    """Flow on every arc (from, to, capacity, cost) of a largest flow of least cost: shortest
    paths, of those the ones with fewest arcs, all filled before distances are taken again."""
    head: list[list[int]] = [[] for _ in range(nodes)]
    to, room, cost = [], [], []
    for a, b, capacity, price in arcs:
        for x, y, c, p in ((a, b, capacity, price), (b, a, 0, -price)):
            head[x].append(len(to))
            to.append(y), room.append(c), cost.append(p)
    while True:
        dist, steps = [float("inf")] * nodes, [nodes + 1] * nodes
        dist[source], steps[source], queue, queued = 0.0, 0, deque([source]), [False] * nodes
        while queue:
            x = queue.popleft()
            queued[x] = False
            for e in head[x]:
                y, d = to[e], dist[x] + cost[e]
                if room[e] > 0 and (d < dist[y] - 1e-9 or (d < dist[y] + 1e-9 and steps[x] + 1 < steps[y])):
                    dist[y], steps[y] = d, steps[x] + 1
                    if not queued[y]:
                        queued[y] = True
                        queue.append(y)
        if dist[sink] == float("inf"):
            return room[1::2]
        # Steps rise along every path, so no node is met twice; its arcs are tried once.
        tried, path, x = [0] * nodes, [], source
        while x != source or tried[x] < len(head[x]):
            if x == sink:
                push = min(room[e] for e in path)
                for e in path:
                    room[e] -= push
                    room[e ^ 1] += push
                full = next(i for i, e in enumerate(path) if room[e] <= 0)
                x = to[path[full] ^ 1]
                del path[full:]
            elif tried[x] == len(head[x]):
                x = to[path.pop() ^ 1]
                tried[x] += 1
            else:
                e = head[x][tried[x]]
                if room[e] > 0 and steps[to[e]] == steps[x] + 1 and abs(dist[x] + cost[e] - dist[to[e]]) < 1e-9:
                    path.append(e)
                    x = to[e]
                else:
                    tried[x] += 1


def route(patterns: dict[tuple, int], quotas: dict, repeats: int = 2) -> dict[tuple, dict]:
    """Words each membership pattern gives to each source.

    ``patterns`` maps a tuple of sources to its words. The r-th copy of a
    pattern costs (r - 1) squared a word: convex, so copies fill level by level.
    """
    names, pats = list(quotas), [p for p in patterns if p]
    at = {s: 2 + len(pats) + i for i, s in enumerate(names)}
    arcs = [(0, 2 + i, int(patterns[p]), float((r - 1) ** 2))
            for i, p in enumerate(pats) for r in range(1, repeats + 1)]
    cross = [(i, s) for i, p in enumerate(pats) for s in p if s in at]
    arcs += [(2 + i, at[s], repeats * int(patterns[pats[i]]), 0.0) for i, s in cross]
    arcs += [(at[s], 1, int(round(quotas[s])), 0.0) for s in names]
    flow = min_cost_flow(arcs, 2 + len(pats) + len(names), 0, 1)
    out: dict[tuple, dict] = {p: {} for p in patterns}
    for (i, s), f in zip(cross, flow[repeats * len(pats):]):
        if f:
            out[pats[i]][s] = f
    return out


def network_flows(patterns: Column, quotas: Column, repeats: int = 2) -> Column:
    """Words given by every pattern of a row's network, in their order: :func:`route` in tasks.

    ``patterns`` is an array of (members: places in ``quotas``, size), ``quotas`` the
    words wanted from the network's sources. A row holds its whole network.
    """
    def give(pats, wanted):
        flows = route({tuple(p["members"]): p["size"] for p in pats}, dict(enumerate(wanted)), repeats)
        return [sum(flows[tuple(p["members"])].values()) for p in pats]
    return F.udf(give, "array<bigint>")(patterns, quotas)


def network_words(patterns: DataFrame, targets: DataFrame, repeats: int = 2) -> DataFrame:
    """Add ``give``, the words of the flow, to patterns (members, size, n); ``targets`` is (source, size, target).

    Sources that meet in a pattern, directly or by others, are one network: one row,
    solved by one task. Patterns without words link nothing and give nothing. A
    network is sorted by names, so reruns agree where several flows cost the least.
    """
    pats = cut_lineage(patterns.withColumn("_p", F.monotonically_increasing_id()))
    aim = cut_lineage(targets.select("source", F.coalesce("target", repeats * F.col("size")).cast("double").alias("target"))
                      .withColumn("_s", F.monotonically_increasing_id()))
    lines = cut_lineage(pats.where("size > 0").select("_p", F.size("members").alias("_k"), F.explode("members").alias("_m"))
                        .join(aim, F.col("_m").eqNullSafe(F.col("source"))).drop("_m"))
    # Patterns that join sources are the nodes below zero.
    roots = connected(lines.where("_k > 1").select((-1 - F.col("_p")).alias("a"), F.col("_s").alias("b")))
    lines = lines.join(roots, F.col("_s") == F.col("node"), "left").withColumn("_net", F.coalesce("root", "_s"))
    quotas = lines.groupBy("_net").agg(F.sort_array(F.collect_set(F.struct("source", "_s", "target"))).alias("q"))
    nets = (lines.groupBy("_net", "_p").agg(F.collect_list("_s").alias("_at")).join(pats, "_p")
            .groupBy("_net").agg(F.sort_array(F.collect_list(F.struct("members", "size", "_p", "_at"))).alias("p"))
            .join(quotas, "_net").withColumn("_order", F.col("q._s")))
    places = F.transform("p", lambda p: F.struct(
        F.array_sort(F.transform(p["_at"], lambda s: (F.array_position("_order", s) - 1).cast("int"))).alias("members"),
        p["size"].alias("size")))
    given = (nets.select(F.col("p._p").alias("_p"), network_flows(places, F.col("q.target"), repeats).alias("give"))
             .select(F.explode(F.arrays_zip("_p", "give")).alias("g")).select("g._p", "g.give"))
    return pats.join(given, "_p", "left").select("members", "size", "n", F.coalesce("give", F.lit(0)).alias("give"))


def choose(slim: DataFrame, words: DataFrame, seed_bits: int = 12) -> DataFrame:
    """Add ``copies`` to rows (members, size, _h, ...): whole documents in hash order until
    the words their pattern gives are reached, to the nearest document.

    ``words`` has a row per pattern: (members, size, n, give). No task holds a
    pattern: totals per (pattern, hash range) are partial aggregates, and only the
    one range in which a pattern's quota ends is sorted, about 50,000 rows. Both
    tables of patterns are read from checkpoints: small ones are broadcast by the
    planner's measure, others joined by shuffles that Spark splits at a large pattern.
    """
    # A power of two of hash ranges per pattern, by its own number of rows.
    bits = F.greatest(F.lit(seed_bits), F.ceil(F.log2(F.col("n") / 50_000 + 1))).cast("int")
    plan = cut_lineage(words.select(
        F.col("members").alias("_m"), F.xxhash64("members").alias("_pat"), bits.alias("_bits"),
        F.when(F.col("size") > 0, F.floor(F.col("give") / F.col("size"))).otherwise(0).cast("long").alias("_whole"),
        F.when(F.col("size") > 0, F.col("give") % F.col("size")).otherwise(0).cast("long").alias("_rest")))
    rows = (slim.join(plan, slim["members"].eqNullSafe(plan["_m"])).drop("_m")
            .withColumn("_b", F.call_function("shiftrightunsigned", F.col("_h"), 64 - F.col("_bits"))))
    key = ["members", "_pat"]
    sums = rows.where("_rest > 0").groupBy(*key, "_rest", "_b").agg(F.sum("size").alias("s"))
    run = sums.withColumn("_before", F.sum("s").over(Window.partitionBy(*key).orderBy("_b")) - F.col("s"))
    # The range a pattern's quota ends in: one row per pattern.
    last = cut_lineage(run.where("_before < _rest and _before + s >= _rest")
                       .select(F.col("members").alias("_m"), F.col("_pat").alias("_p"), F.col("_b").alias("_end"), "_before"))
    rows = rows.join(last, (F.col("_pat") == F.col("_p")) & F.col("members").eqNullSafe(F.col("_m")), "left").drop("_m", "_p")
    before = rows.where("_end is null or _b != _end").withColumn("_one", (F.col("_b") < F.col("_end")).cast("long"))
    edge = rows.where("_b = _end")
    w = Window.partitionBy(*key).orderBy("_h", "_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    run_before = F.col("_before") + F.coalesce(F.sum("size").over(w), F.lit(0))
    edge = edge.withColumn("_one", (2 * (F.col("_rest") - run_before) >= F.col("size")).cast("long"))
    return before.unionByName(edge).withColumn("copies", F.col("_whole") + F.coalesce("_one", F.lit(0)))


def spark_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """:func:`weighted_targets` for any number of sources: (source, size, target) from (source, size).

    Sources get their place in code-point order by a count per range of the sorted
    names. Each round of resharing is one sum over the sources; rounds follow the
    number of times that a new excess arises.
    """
    tasks = shuffle_tasks(sizes.sparkSession)
    sorted_ = cut_lineage(sizes.repartitionByRange(tasks, F.col("source").asc_nulls_last())
                          .sortWithinPartitions(F.col("source").asc_nulls_last())
                          .withColumn("_row", F.monotonically_increasing_id()))
    part = F.shiftright("_row", 33)
    starts = sorted_.groupBy(part.alias("_p")).agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    # One row per partition.
    starts = F.broadcast(starts.select("_p", "_first", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_start")))
    place = F.col("_start") + F.col("_row") - F.col("_first")
    ranked = cut_lineage(sorted_.join(starts, part == F.col("_p")).select(
        "source", "size", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (place % len(weights) + 1).cast("int")).alias("w")))
    total = ranked.agg(F.sum("size")).first()[0] or 0
    # Targets are the smaller of the cap and rate * weight; the rate rises as sources fill up.
    all_w = ranked.agg(F.sum("w")).first()[0]
    rate, full = (share * total / all_w if all_w else 0.0), 0
    while True:
        capped = F.col("w") * F.lit(rate) > most * F.col("size")
        n, taken, w = ranked.agg(F.count_if(capped), F.sum(F.when(capped, most * F.col("size"))), F.sum(F.when(~capped, F.col("w")))).first()
        if n <= full or not w:
            break
        full, rate = n, (share * total - (taken or 0)) / w
    target = F.when(F.col("w") * F.lit(rate) > most * F.col("size"), most * F.col("size")).otherwise(F.col("w") * F.lit(rate))
    return ranked.select("source", "size", target.cast("double").alias("target"))


def _measured(docs: DataFrame, members: Column, seed: int, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("_id"), F.array_sort(F.array_distinct(F.coalesce(members, F.array()))).alias("members"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORDS)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("_h"),
        F.xxhash64(F.col(text_col), F.lit(seed), F.col(id_col)).alias("_h2"))


def _slim(docs: DataFrame, members: Column, seed: int, id_col: str, text_col: str) -> DataFrame:
    return cut_lineage(_measured(docs, members, seed, id_col, text_col))


def _named(out: DataFrame, id_col: str) -> DataFrame:
    return out.select(F.col("_id").alias(id_col), F.struct("_h", "_h2").alias("text_key"), "size", "members", "copies",
                      (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, members: Column, quotas: Callable[[dict], dict] | dict, repeats: int = 2,
        seed: int = 0, id_col: str = "doc_id", text_col: str = "text",
        max_patterns: int = 20_000) -> DataFrame:
    """Words the mix takes of every document: (id, text key, size, members, copies, taken).

    ``members`` is the array of sources a row belongs to; ``quotas`` the words
    wanted from each source, or a function of {source: its words}. A document
    is taken in whole copies, at most ``repeats`` of them; a pattern's total is
    the nearest that whole documents in seeded order reach. The order hangs on
    seed, id and text alone, so reruns agree.

    Null texts have no words and add nothing; a null source is a source of its
    own; equal ids are separate rows; fully equal rows may swap places; an
    empty table gives an empty result. Here sources may overlap: the totals of
    all patterns come to the driver, and more than ``max_patterns`` of them raise an
    error, nothing is dropped. For sources that do not overlap there is no such
    bound: :func:`mix_disjoint`, :func:`mix_networks`.
    """
    slim = _slim(docs, members, seed, id_col, text_col)
    got = slim.groupBy("members").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(max_patterns + 1).collect()
    if len(got) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns; mix_disjoint takes any number of sources that do not overlap")
    sizes: dict = {}
    for r in got:
        for s in r["members"]:
            sizes[s] = sizes.get(s, 0) + r["size"]
    want = quotas(sizes) if callable(quotas) else quotas
    flows = route({tuple(r["members"]): r["size"] for r in got}, want, repeats)
    kind = slim.schema["members"].dataType.simpleString()
    words = docs.sparkSession.createDataFrame(
        [(list(r["members"]), r["size"], r["n"], int(sum(flows[tuple(r["members"])].values()))) for r in got],
        f"members {kind}, size long, n long, give long")
    return _named(choose(slim, words), id_col)


def mix_disjoint(docs: DataFrame, source: Column, targets: Callable[[DataFrame], DataFrame] = spark_targets,
                 repeats: int = 2, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`mix` for documents of one source each, with ``source_size`` and ``target``.

    ``targets`` maps (source, size) to (source, size, target). Each source is a network
    of its own, with one pattern, whose flow a task solves. Sources, targets and flows
    stay in Spark, whatever their number. Nulls, ties and empties as in :func:`mix`.
    """
    slim = _slim(docs, F.array(source), seed, id_col, text_col)
    sizes = cut_lineage(slim.groupBy("members").agg(F.sum("size").alias("size"), F.count("*").alias("n")))
    aim = targets(sizes.select(F.get("members", F.lit(0)).alias("source"), "size")).select(
        F.array("source").alias("_a"), F.col("target"))
    pattern = F.struct(F.array(F.lit(0)).alias("members"), "size")
    words = cut_lineage(sizes.join(aim, F.col("members").eqNullSafe(F.col("_a"))).drop("_a").withColumn(
        "give", network_flows(F.array(pattern), F.array(F.coalesce("target", repeats * F.col("size"))), repeats)[0]))
    facts = words.select(F.col("members").alias("_a"), F.col("size").alias("source_size"), "target")
    out = _named(choose(slim, words), id_col)
    return out.join(facts, F.col("members").eqNullSafe(F.col("_a"))).drop("_a")


def mix_networks(docs: DataFrame, source: Column, targets: Callable[[DataFrame], DataFrame] = spark_targets,
                 repeats: int = 2, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`mix` for documents listed under any number of sources: (id, text key, size, members, copies, taken).

    Rows of equal id and text are one document, which belongs to the sources of all its
    rows; its size is the words of its rows, which are taken equally often, at most
    ``repeats`` times. ``targets`` maps (source, words of its rows) to (source, size,
    target). Sources, patterns, networks and flows stay in Spark, whatever their number;
    a task holds the patterns of one network. Nulls, ties and empties as in :func:`mix`.
    """
    key = ["_id", "_h", "_h2"]
    rows = _measured(docs, F.array(source), seed, id_col, text_col)
    # Copies of a row are counted first: a group of the second aggregate holds a row per source.
    parts = rows.groupBy(*key, F.get("members", F.lit(0)).alias("source")).agg(F.sum("size").alias("words"))
    slim = cut_lineage(parts.groupBy(*key).agg(F.collect_list(F.struct("source", "words")).alias("parts"), F.sum("words").alias("size"))
                       .withColumn("members", F.array_sort(F.col("parts.source"))))
    sizes = cut_lineage(slim.select(F.explode("parts").alias("p")).groupBy(F.col("p.source").alias("source"))
                        .agg(F.sum("p.words").alias("size")))
    slim = slim.drop("parts")
    patterns = slim.groupBy("members").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    return _named(choose(slim, network_words(patterns, targets(sizes), repeats)), id_col)


def source_report(docs: DataFrame, source_col: str = "source", seed: int = 0, id_col: str = "doc_id", **options) -> DataFrame:
    """:func:`mix_disjoint` to :func:`spark_targets`:
    (id, size, source_size, target, taken, source, copies, text_key)."""
    out = mix_disjoint(docs, F.col(source_col), seed=seed, id_col=id_col, **options)
    return out.select(id_col, "size", "source_size", "target", "taken", F.get("members", F.lit(0)).alias("source"), "copies", "text_key")


def taken_rows(docs: DataFrame, mixed: DataFrame, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, unchanged, each in as many copies as ``mixed`` (of :func:`mix`,
    :func:`mix_disjoint` or :func:`mix_networks` with the same seed) takes of it.

    Rows of equal id and text are treated alike. Rows without words add
    nothing to a mix and are left out.
    """
    taken = cut_lineage(mixed.where("taken > 0").groupBy(F.col("text_key").alias("_pz_key"))
                        .agg(F.max("copies").cast("int").alias("_pz_copies")))
    keyed = docs.withColumn("_pz_key", F.struct(
        F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("_h"), F.xxhash64(F.col(text_col), F.lit(seed), F.col(id_col)).alias("_h2")))
    rows = keyed.join(taken, "_pz_key")
    return rows.withColumn("_pz_copy", F.explode(F.sequence(F.lit(1), F.col("_pz_copies")))).select(docs.columns)


def mix_rows(docs: DataFrame, members: Column, quotas: Callable[[dict], dict] | dict, repeats: int = 2, seed: int = 0,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`taken_rows` of :func:`mix`."""
    return taken_rows(docs, mix(docs, members, quotas, repeats, seed, id_col, text_col), seed, id_col, text_col)
