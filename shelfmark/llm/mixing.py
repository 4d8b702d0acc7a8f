"""Mixing overlapping sources to target weights by min-cost flow."""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.running import sums_before
from shelfmark.llm.text import words
from shelfmark.operators import stage

WEIGHTS = (5, 2, 1)
SHARE = 1.5  # of all words
MOST = 2  # times a document, and times a source
BROADCAST_ROWS = 100_000  # of numbers: some 10 MB; more meet the rows in a salted join
SALTS = 16


def targets(sizes: Sequence[int], weights: Sequence[float], share: float = SHARE, most: float = MOST) -> list[float]:
    """Words per source: by weight, none above ``most`` times its size, the excess reshared."""
    left = share * sum(sizes)
    out = [0.0] * len(sizes)
    ends = {i: most * s for i, s in enumerate(sizes)}
    while ends:
        unit = left / sum(weights[i] for i in ends)
        full = [i for i, cap in ends.items() if weights[i] * unit >= cap]
        for i in full:
            out[i] = float(ends.pop(i))
            left -= out[i]
        if not full:
            for i in ends:
                out[i] = weights[i] * unit
            break
    return out


def least_cost_flow(
    unique: Sequence[int], arcs: Sequence[tuple[int, int, int]], quotas: Sequence[int]
) -> dict[tuple[int, int], int]:
    """Words from pattern to source that meet the quotas at least repetition cost.

    ``unique[p]``: words of pattern p's texts, each text once. ``arcs``: (pattern,
    source, capacity). The first ``unique[p]`` words drawn from a pattern cost 0
    each, the next as many 1, the next two times as many 2, and so on: convex, so
    every text is used once before any is repeated, and repetition is spread.
    Only the first arc of a path costs anything, so successive cheapest paths are
    one maximum flow per cost level, each on top of the last.
    """
    flow = {(p, s): 0 for p, s, _ in arcs}
    capacity = {(p, s): c for p, s, c in arcs}
    of_pattern: dict[int, list[int]] = {}
    of_source: dict[int, list[int]] = {}
    for p, s, _ in arcs:
        of_pattern.setdefault(p, []).append(s)
        of_source.setdefault(s, []).append(p)
    need = list(quotas)
    limit = {p: sum(capacity[p, s] for s in ss) for p, ss in of_pattern.items()}
    given = dict.fromkeys(of_pattern, 0)
    width = 1
    while True:
        level = {p: min(unique[p] * width, limit[p]) for p in of_pattern}
        spare = {p: level[p] - given[p] for p in of_pattern}
        for p, ss in of_pattern.items():  # straight to the source
            for s in ss:
                step = min(spare[p], need[s], capacity[p, s] - flow[p, s])
                if step > 0:
                    flow[p, s] += step
                    given[p] += step
                    spare[p] -= step
                    need[s] -= step
        while path := _path(spare, need, flow, capacity, of_pattern, of_source):
            step = min(spare[path[0]], need[path[-1]])
            hops = list(zip(path, path[1:], strict=False))
            for i, (a, b) in enumerate(hops):
                step = min(step, capacity[a, b] - flow[a, b] if i % 2 == 0 else flow[b, a])
            for i, (a, b) in enumerate(hops):
                if i % 2 == 0:
                    flow[a, b] += step
                else:
                    flow[b, a] -= step
            spare[path[0]] -= step
            given[path[0]] += step
            need[path[-1]] -= step
        if not any(n > 0 for n in need) or all(level[p] >= limit[p] for p in of_pattern):
            return flow
        width *= 2


def passes_over(texts: Sequence[tuple[int, int]], drawn: int, most: int) -> tuple[int, int, int]:
    """Whole passes over texts that ``drawn`` words make, words left, and words of the next pass.

    ``texts``: (copies, words of the texts with so many copies, each once). A
    text takes part in ``most * copies`` passes.
    """
    passes, width = 0, sum(once for _, once in texts)
    for copies, once in sorted(texts):
        whole = most * copies - passes
        if drawn < whole * width:
            return passes + drawn // width, drawn % width, width
        drawn -= whole * width
        passes, width = most * copies, width - once
    return passes, 0, 0


def _path(spare, need, flow, capacity, of_pattern, of_source) -> list[int] | None:
    """A shortest way pattern, source, pattern, ... source with room all along."""
    came: dict[tuple[str, int], tuple[str, int] | None] = {("p", p): None for p, x in spare.items() if x > 0}
    queue = deque(came)
    while queue:
        kind, at = node = queue.popleft()
        if kind == "s" and need[at] > 0:
            out = []
            step: tuple[str, int] | None = node
            while step is not None:
                out.append(step[1])
                step = came[step]
            return out[::-1]
        if kind == "p":
            following = [("s", s) for s in of_pattern[at] if flow[at, s] < capacity[at, s]]
        else:
            following = [("p", p) for p in of_source[at] if flow[p, at] > 0]
        for other in following:
            if other not in came:
                came[other] = node
                queue.append(other)
    return None


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    seed: int = 17,
) -> DataFrame:
    """doc_id, size, source_size, target, taken, and text_hash (MD5) per row of docs.

    Size is the number of words, 0 for NULL and empty texts. Sources are taken
    in code point order, NULL last, with ``weights`` repeating. Equal texts found
    in several sources form a membership pattern. The words of each pattern and
    source, and each pattern's words with every text counted once, make the flow
    graph. Its solution says how many words a source draws from a pattern: whole passes over
    its texts, each text once a pass and at most ``most`` times a row, then texts
    in a seeded order of the pattern's, which goes round. Each source goes on
    where the one before ended, so texts of a pattern are all drawn once before
    any is drawn again, from whatever source; the last one may be drawn in part.
    A text's draws go to its rows in the source in turn, in the order of a
    seeded hash of doc_id.

    The driver holds the flow graph, all of it: a number per source, and per
    pattern, source and number of copies, but nothing per text. Patterns are sets
    of sources, so they are far fewer than texts (1,010 of 10,511 shared texts
    on 256,410 documents of 20 sources). Repeated rows are copies of a text like
    any other; no rows, or none with words, give no draws.
    """
    spark = docs.sparkSession
    size = F.size(words(F.col("text"))).cast("long")
    text = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    rows = docs.select("doc_id", "source", size.alias("size"), text.alias("text_hash"))
    rows = stage(rows.withColumn("row_", F.monotonically_increasing_id()), "mix")

    by_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    sized = by_source.orderBy(F.asc_nulls_last("source")).collect()  # one row per source
    sizes = [r["source_size"] for r in sized]
    wanted = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share, most)
    quotas = spark.createDataFrame(
        [(i, r["source"], r["source_size"], t) for i, (r, t) in enumerate(zip(sized, wanted, strict=True))],
        "source_no int, source_ string, source_size long, target double",
    )
    rows = _met(rows, quotas, len(sized), F.col("source").eqNullSafe(F.col("source_"))).drop("source_")

    per_text = rows.groupBy("text_hash", "source_no").agg(
        F.max("size").alias("once"), F.count(F.lit(1)).alias("copies"), F.min("row_").alias("row_")
    )
    per_text = stage(per_text, "mix")
    shared = (
        per_text.groupBy("text_hash")
        .agg(F.sort_array(F.collect_list("source_no")).alias("pattern"), F.max("once").alias("once"))
        .where(F.size("pattern") > 1)
    )
    top = (
        shared.groupBy("pattern")
        .agg(F.sum("once").alias("unique"))
        .orderBy(F.desc("unique"), "pattern")
        .collect()  # one row per set of sources
    )
    numbers = {tuple(r["pattern"]): len(sized) + i for i, r in enumerate(top)}
    numbered = spark.createDataFrame(
        [(list(k), v) for k, v in numbers.items()], "pattern array<int>, pattern_no int"
    )
    numbered = numbered.withColumnRenamed("pattern", "pattern_")
    known = _met(shared, numbered, len(top), F.col("pattern") == F.col("pattern_"), "text_hash")
    known = known.select("text_hash", "pattern_no")
    texts = per_text.join(known, "text_hash", "left")
    texts = stage(texts.withColumn("pattern_no", F.coalesce("pattern_no", "source_no")), "mix")

    arcs: dict[tuple[int, int], list[tuple[int, int]]] = {}  # (copies, words of the texts that have so many)
    for r in texts.groupBy("pattern_no", "source_no", "copies").agg(F.sum("once").alias("once")).collect():
        arcs.setdefault((r["pattern_no"], r["source_no"]), []).append((r["copies"], r["once"]))
    unique = {p: sum(once for _, once in found) for (p, _), found in arcs.items() if p < len(sized)}
    unique |= {numbers[tuple(r["pattern"])]: r["unique"] for r in top}
    edges = sorted(arcs)
    flow = least_cost_flow(
        {p: max(unique[p], 1) for p in sorted({p for p, _ in edges})},
        [(p, s, most * sum(k * once for k, once in arcs[p, s])) for p, s in edges],
        [int(t) for t in wanted],
    )

    plan, begin, drawn_before = [], 0, dict.fromkeys(unique, 0)
    for number, (p, s) in enumerate(edges):
        passes, rest, width = passes_over(arcs[p, s], flow[p, s], most)
        start = 0
        if passes < most and width:  # all sources of the pattern go round the same texts
            start = drawn_before[p] % width
            drawn_before[p] += rest
        plan.append((p, s, number, begin, passes, start, rest, width))
        begin += width
    plan = spark.createDataFrame(
        plan,
        "pattern_no int, source_no int, edge int, begin long, passes long, start long, rest long, width long",
    )
    plan = plan.withColumnsRenamed({"pattern_no": "pattern_", "source_no": "source_"})
    same = (F.col("pattern_no") == F.col("pattern_")) & (F.col("source_no") == F.col("source_"))
    texts = _met(texts, plan, len(edges), same).drop("pattern_", "source_")
    goes_on = most * F.col("copies") > F.col("passes")
    order = [F.col("edge"), F.xxhash64(F.lit(seed), "text_hash"), F.col("text_hash")]
    texts = sums_before(texts, order, {"before": F.when(goes_on, F.col("once")).otherwise(0)})
    at = F.col("before") - F.col("begin")

    def overlap(low: Column, high: Column) -> Column:
        return F.greatest(F.least(high, at + F.col("once")) - F.greatest(low, at), F.lit(0))

    end = F.col("start") + F.col("rest")
    part = overlap(F.col("start"), F.least(end, F.col("width"))) + overlap(F.lit(0), end - F.col("width"))
    drawn = F.least("passes", most * F.col("copies")) * F.col("once") + F.when(goes_on, part).otherwise(0)
    texts = stage(texts.select("text_hash", "source_no", "copies", "row_", drawn.alias("drawn")), "mix")

    by_text = [F.col("text_hash"), F.col("source_no")]
    several = sums_before(texts.where("copies > 1"), by_text, {"first": F.col("copies")})
    texts = texts.where("copies = 1").withColumn("first", F.lit(0).cast("long")).unionByName(several)
    # a text of one row meets it alone; salts spread the rows of the others
    one, every = F.array(F.pmod("row_", F.lit(SALTS))), F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))
    salted = texts.withColumn("salt", F.explode(F.when(F.col("copies") > 1, every).otherwise(one))).drop("row_")
    rows = rows.withColumn("salt", F.pmod("row_", F.lit(SALTS))).join(salted, ["text_hash", "source_no", "salt"])
    rows = stage(rows, "mix")

    order = [*by_text, F.xxhash64(F.lit(seed), "doc_id"), F.col("row_")]
    copied = sums_before(rows.where("copies > 1"), order, {"at": F.lit(1).cast("long")})
    copied = copied.withColumns({"copy": F.col("at") - F.col("first"), "uses": F.expr("if(size > 0, drawn div size, 0)")})
    turn = F.col("uses") % F.col("copies")
    taken = F.expr("uses div copies") * F.col("size") + (
        F.when(F.col("copy") < turn, F.col("size"))
        .when(F.col("copy") == turn, F.col("drawn") - F.col("uses") * F.col("size"))
        .otherwise(0)
    )
    out = ("doc_id", "size", "source_size", "target", "taken", "text_hash", "source")
    alone = rows.where("copies = 1").withColumn("taken", F.col("drawn"))
    return alone.select(*out).union(copied.withColumn("taken", taken.cast("long")).select(*out))


def _met(rows: DataFrame, numbers: DataFrame, n: int, same: Column, spread: str = "row_") -> DataFrame:
    """Inner join with a table of n rows from the driver: broadcast if it is small, salted if it is not.

    One key may hold a third of the rows; ``spread`` is a column to salt them by.
    """
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(numbers), same)
    salted = numbers.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    return rows.join(salted, same & (F.col("salt") == F.col("salt_"))).drop("salt", "salt_")


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """docs as the mix takes them: a document once per time it is taken, with its columns.

    Times taken is ``taken / size`` to the nearest whole number, half up;
    documents drawn for less than half of their words go. Rows equal in doc_id,
    source and text are taken equally often, by the mean of what they draw.
    """
    keys = ("doc_id", "source", "text_hash")
    times = F.floor(F.sum("taken") / F.sum("size") + F.lit(0.5)).cast("int")
    mixed = mix(docs, **options).where("size > 0").groupBy(*keys).agg(times.alias("times"))
    mixed = mixed.where("times > 0").withColumnsRenamed({k: f"{k}_" for k in keys})
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    body = F.coalesce(F.col("doc.text"), F.lit(""))
    joined = named.withColumn("text_hash", F.md5(body.cast("binary"))).join(
        mixed,
        F.col("doc.doc_id").eqNullSafe(F.col("doc_id_"))
        & F.col("doc.source").eqNullSafe(F.col("source_"))
        & (F.col("text_hash") == F.col("text_hash_")),
    )
    return joined.select("doc", F.explode(F.sequence(F.lit(1), F.col("times")))).select("doc.*")
