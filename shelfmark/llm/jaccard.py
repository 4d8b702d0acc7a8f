"""Exact Jaccard join of n-gram sets by vertical partitioning of the n-gram order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.components import components
from shelfmark.llm.text import (
    bit_filter,
    drop_tables,
    in_filter,
    long_lists,
    release,
    run_hashes,
    slices,
    small_batches,
    word_hashes,
)
from shelfmark.operators import stage
from shelfmark.operators.bloom import might_contain

N_GRAM = 3
PERCENT = 90  # of the union
COUNTERS = 18  # log2 of the counters that tell rare n-grams from frequent ones
SAMPLED = 2  # log2: of so many n-grams one is counted exactly, or more of them (see ``counted_share``)
STEPS = (2, 16, 128, 1024)  # classes of exact counts
FRAGMENTS = 4  # cuts of the global order
LOG_BITS = (23, 28)  # of filters: 1 MB to 32 MB, by what is in them
WIDTH = 4  # size bands span so many steps of the smallest ratio of sizes that can link
HEAVY = 32  # members of a bucket from which on its classes are compared in blocks
BLOCK = 256  # classes of a block
SLACK = 1.01  # size bands of a family are so much wider than sets that link can be apart, so rounding does not matter
COLUMNS = 4096  # n-grams of a partial overlap count in a block
SALTS = 16
CHUNK = 4096


def gram_sets(texts: pa.Array, n: int) -> tuple[list[np.ndarray], list[str]]:
    """n-gram sets of texts as sorted distinct 64-bit hashes, and their 128-bit digests."""
    import xxhash

    lowered = [text.encode("utf-8").lower() if text else b"" for text in texts.to_pylist()]  # ASCII alone
    found = [np.unique(run_hashes(h, min(n, len(h)))) if len(h) else h for h in word_hashes(lowered)]
    return found, [xxhash.xxh3_128_hexdigest(x.tobytes()) for x in found]


def counted_share(percent: int) -> int:
    """log2: of so many n-grams one is counted exactly.

    At least twice the share of a set that is in its prefix. Then a set has
    frequent n-grams in its prefix only if half its n-grams or more are in
    other documents, too.
    """
    return max(s for s in range(SAMPLED + 1) if s == 0 or 50 >= (100 - percent) << s)


def _log_bits(rows: int) -> int:
    """log2 of the bits of a filter: 8 to 16 a row, within LOG_BITS."""
    return min(max((8 * rows).bit_length(), LOG_BITS[0]), LOG_BITS[1])


class Order:
    """The global n-gram order: by class of rarity, then by hash; and its cuts.

    A fixed fraction of all n-grams, chosen by hash, is counted exactly, and
    comes first: those of one document, then those of more and more. The others
    follow by the binary magnitude of a counter they share. Any fixed order
    gives the same links; this one leaves prefixes with n-grams that no other
    document has, wherever there are some.
    """

    def __init__(
        self, shared: np.ndarray, mass: np.ndarray, frequent: list[np.ndarray], fragments: int, sampled: int = SAMPLED
    ):
        self.shared, self.frequent, self.fragments, self.sampled = shared, frequent, fragments, sampled
        self.before, self.mass = np.cumsum(mass) - mass, mass
        self.total = max(mass.sum(), 1)

    def classes(self, hashes: np.ndarray) -> np.ndarray:
        """0: in one document for sure."""
        out = self.shared[(hashes >> np.uint64(64 - COUNTERS)).astype(np.int64)].astype(np.int64)
        counted = np.flatnonzero(_one_of(hashes, self.sampled))
        exact = hashes[counted]
        kind = np.zeros(len(counted), dtype=np.int64)
        for i, bits in enumerate(self.frequent):
            kind += in_filter(exact, bits)
        out[counted] = kind
        return out

    def sorted(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The hashes in global order, with their classes."""
        kind = self.classes(hashes)
        at = np.lexsort((hashes, kind))
        return hashes[at], kind[at]

    def fragment(self, hashes: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Cuts of the order: counted n-grams are the first, one in 2 ** SAMPLED of all; the others have about equal shares."""
        counted, part = kind <= len(self.frequent), hashes.astype(np.float64) / 2.0**64
        place = np.where(counted, part, (self.before[kind] + self.mass[kind] * part) / self.total)
        cut = np.minimum(1 + place * (self.fragments - 1), self.fragments - 1).astype(np.int64)
        return np.where(counted & _one_of(hashes, SAMPLED), 0, cut)


def _one_of(hashes: np.ndarray, log: int) -> np.ndarray:
    """Marks of one in 2 ** log n-grams; those of a larger log are among them."""
    return (hashes & np.uint64((1 << log) - 1)) == 0


def summaries(docs: DataFrame, n: int) -> DataFrame:
    """Per document its set size, the digest of its set and a hash of its text; per task the n-gram counters."""

    def run(batches):
        counters = np.zeros(1 << COUNTERS, dtype=np.int64)
        names = ["doc_id", "text_no", "n", "digest", "chunk", "counts"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.list_(pa.int64())]
        for batch in slices(batches):
            found, digests = gram_sets(batch.column("text"), n)
            top = np.concatenate([*found, np.empty(0, dtype=np.uint64)]) >> np.uint64(64 - COUNTERS)
            counters += np.bincount(top.astype(np.int64), minlength=1 << COUNTERS)
            columns = [
                batch.column("doc_id"),
                batch.column("text_no"),
                pa.array([len(x) for x in found], pa.int64()),
                pa.array(digests, pa.string()),
                pa.nulls(len(found), kinds[4]),
                pa.nulls(len(found), kinds[5]),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)
        cuts = [c for c in np.split(np.arange(1 << COUNTERS), (1 << COUNTERS) // CHUNK) if counters[c].any()]
        columns = [pa.nulls(len(cuts), kind) for kind in kinds[:4]]
        chunks = pa.array([int(c[0]) // CHUNK for c in cuts], pa.int32())
        yield pa.RecordBatch.from_arrays([*columns, chunks, long_lists([counters[c] for c in cuts])], names)

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_no")).mapInArrow(
        run, "doc_id long, text_no long, n long, digest string, chunk int, counts array<long>"
    )


def counted_grams(docs: DataFrame, n: int, sampled: int = SAMPLED) -> DataFrame:
    """h, times: documents that hold each of the n-grams that are counted exactly."""

    def run(batches):
        for batch in slices(batches):
            found, _ = gram_sets(batch.column("text"), n)
            every = np.concatenate([*found, np.empty(0, dtype=np.uint64)])
            h, times = np.unique(every[_one_of(every, sampled)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(times)], ["h", "times"])

    each = docs.select("text").mapInArrow(run, "h long, times long")
    return each.groupBy("h").agg(F.sum("times").alias("times")).where(F.col("times") >= STEPS[0])


def global_order(
    summary: DataFrame, docs: DataFrame, n: int, fragments: int = FRAGMENTS, sampled: int = SAMPLED
) -> tuple:
    """What makes an ``Order``: adds up the counters, and marks frequent n-grams in filters of bounded size."""
    each = summary.where("chunk IS NOT NULL").select("chunk", F.posexplode("counts").alias("at", "n"))
    totals = each.groupBy((F.col("chunk") * CHUNK + F.col("at")).alias("i")).agg(F.sum("n").alias("n")).toArrow()
    counters = np.zeros(1 << COUNTERS)
    counters[totals.column("i").to_numpy()] = totals.column("n").to_numpy()
    several = stage(counted_grams(docs, n, sampled), "frequent")
    rows = several.agg(*[F.count_if(F.col("times") >= step) for step in STEPS]).first()
    frequent = [
        bit_filter(several.where(F.col("times") >= step), _log_bits(m)) for step, m in zip(STEPS, rows, strict=True)
    ]
    drop_tables(docs.sparkSession, [several])
    magnitude = np.floor(np.log2(np.maximum(counters, 1))).astype(np.uint8)
    shared = magnitude + np.uint8(len(frequent) + 1)  # classes, below 128
    return shared, np.bincount(shared, counters, 128), frequent, fragments, sampled


def prefixes(docs: DataFrame, order: Broadcast, n: int, percent: int) -> DataFrame:
    """digest, places, prefix: the first n - ceil(percent * n / 100) + 1 n-grams of each set in global order.

    Without those that no other document has; ``places`` says where the rest stand.
    """

    def run(batches):
        known = Order(*order.value)
        for batch in slices(batches):
            digests, places, firsts = [], [], []
            for found, digest in zip(*gram_sets(batch.column("text"), n), strict=True):
                found, kind = known.sorted(found)
                size = len(found) + percent * len(found) // -100 + 1 if len(found) else 0
                at = np.flatnonzero(kind[:size])
                if len(at):
                    digests.append(digest)
                    places.append(at)
                    firsts.append(found[at])
            yield pa.RecordBatch.from_arrays(
                [pa.array(digests, pa.string()), long_lists(places), long_lists(firsts)], ["digest", "places", "prefix"]
            )

    return docs.select("text").mapInArrow(run, "digest string, places array<long>, prefix array<long>")


def segments(docs: DataFrame, wanted: Broadcast, order: Broadcast, n: int) -> DataFrame:
    """digest, fragments, parts: the sets of wanted texts, cut by the global order."""

    def run(batches):
        known = Order(*order.value)
        for batch in slices(batches):
            hashes = batch.column("text_no").to_numpy(zero_copy_only=False).view(np.uint64)
            may = batch.filter(pa.array(in_filter(hashes, wanted.value)))
            digests, fragments, parts = [], [], []
            for found, digest in zip(*gram_sets(may.column("text"), n), strict=True):
                found, kind = known.sorted(found)
                cut = known.fragment(found, kind)
                for f in np.unique(cut).tolist():
                    digests.append(digest)
                    fragments.append(f)
                    parts.append(found[cut == f])
            yield pa.RecordBatch.from_arrays(
                [pa.array(digests, pa.string()), pa.array(fragments, pa.int32()), long_lists(parts)],
                ["digest", "fragment", "part"],
            )

    return docs.select("text", F.xxhash64("text").alias("text_no")).mapInArrow(
        run, "digest string, fragment int, part array<long>"
    )


def linked(pairs: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that link: common n-grams counted per fragment, summed per pair.

    Counted first are those of the first fragment, a part of every set by hash.
    A pair that would not link if all its other n-grams were common goes; the
    other fragments move only for classes of pairs that are left.
    """
    may = stage(_open_pairs(pairs, parts.where("fragment = 0").drop("fragment"), percent), "open_pairs")
    named = may.select(F.explode(F.array("a", "b")).alias("class_id"))
    rest = parts.where("fragment > 0").where(might_contain(named, "class_id", F.col("class_id")))
    of_a = rest.select(F.col("class_id").alias("a"), "fragment", F.col("part").alias("part_a"))
    of_b = rest.select(F.col("class_id").alias("b"), "fragment", F.col("part").alias("part_b"))
    counts = (
        _shuffled(may.drop("common"))
        .join(of_a, "a")
        .join(of_b, ["b", "fragment"])
        .select("a", "b", "na", "nb", F.size(F.array_intersect("part_a", "part_b")).alias("common"))
    )
    counts = may.unionByName(counts).groupBy("a", "b", "na", "nb").agg(F.sum("common").alias("common"))
    return counts.where(_enough(F.col("common"), percent)).select("a", "b")


def _open_pairs(pairs: DataFrame, firsts: DataFrame, percent: int) -> DataFrame:
    """Pairs with what they have in common in the first fragment, but those that the others cannot make link."""
    none = F.array().cast("array<long>")
    of_a = firsts.select(F.col("class_id").alias("a"), F.col("part").alias("part_a"))
    of_b = firsts.select(F.col("class_id").alias("b"), F.col("part").alias("part_b"))
    met = pairs.join(of_a, "a", "left").join(of_b, "b", "left")
    met = met.withColumns({c: F.coalesce(c, none) for c in ("part_a", "part_b")})
    common = F.size(F.array_intersect("part_a", "part_b"))
    others = F.least(F.col("na") - F.size("part_a"), F.col("nb") - F.size("part_b"))
    met = met.select("a", "b", "na", "nb", common.alias("common"), others.alias("others"))
    return met.where(_enough(F.col("common") + F.col("others"), percent)).drop("others")


def _enough(common: Column, percent: int) -> Column:
    return 100 * common >= percent * (F.col("na") + F.col("nb") - common)


def _bucketed(tokens: DataFrame, percent: int) -> DataFrame:
    """Rows per token and size band: a set's own band, and that of the smallest set it can link with."""

    def band(n: Column) -> Column:
        return F.floor(F.log(n) / F.lit(WIDTH * float(np.log(100 / percent)))).cast("int")

    own = band(F.col("n") + F.lit(0.5))
    below = band(F.col("n") * F.lit(percent / 100 - 1e-9) + F.lit(0.5))
    return tokens.withColumn("band", F.explode(F.array_distinct(F.array(own, below))))


def _shuffled(df: DataFrame) -> DataFrame:
    """For joins with a table that grows with the input: df is not broadcast.

    Spark takes a table for as large as its files, which hold ids in a fraction
    of their bytes in memory, and for no larger after an explode.
    """
    return df.hint("merge")


def _pairs_with(members: DataFrame, leaders: DataFrame, percent: int) -> DataFrame:
    """Each member with its bucket's leader; salts spread a large bucket."""
    salted = _shuffled(leaders.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    met = members.withColumn("salt", F.pmod(F.xxhash64("class_id"), F.lit(SALTS)).cast("int")).join(
        salted, ["token", "band", "salt"]
    )
    met = met.where(F.col("class_id") != F.col("leader"))
    first, other = F.struct("class_id", "n"), F.struct(F.col("leader").alias("class_id"), F.col("leader_n").alias("n"))
    met = met.select(F.least(first, other).alias("x"), F.greatest(first, other).alias("y"))
    sized = met.select(
        F.col("x.class_id").alias("a"),
        F.col("y.class_id").alias("b"),
        F.col("x.n").alias("na"),
        F.col("y.n").alias("nb"),
    )
    return sized.where(_sizes_fit(percent)).distinct()


def _sizes_fit(percent: int) -> Column:
    return 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")


def near_duplicate_classes(docs: DataFrame, n: int = N_GRAM, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs.

    Two documents link when their sets of n-word shingles (A-Z lower-cased, words
    parted by ASCII white space; under n words the whole sequence is one) have
    ``100 * common >= percent * union``. ``component_id`` is the smallest doc_id
    reachable over links.

    1. Documents with equal sets are one class.
    2. The shingles of a class in one global order, rarest first; two sets that
       link share a shingle of their prefixes, and their sizes are near.
    3. Three rounds of candidates. Sets that share a prefix shingle and a size
       band are a bucket. First each member is compared with the bucket's
       class of smallest doc_id; then, where a bucket still holds several components,
       with a leader chosen by hash per bucket. What is still open is compared
       in full, which decides every possible link: pairs of different components
       in small buckets, and families - classes that large buckets connect - block
       by block inside tasks, which give back no more links than classes.
    4. The global order is cut into fragments; a pair's common shingles are
       counted in each apart and summed. The first fragment rules out most pairs.

    Sets are compared by 64-bit hashes of shingles, classes by 128 bits.

    NULL, empty and blank texts have the empty set and link with nothing; their
    component is their doc_id. Repeated rows are one class, and so are texts of
    equal sets under one doc_id. A NULL doc_id has the component of its class,
    NULL if no row there has a doc_id. Other columns of docs are not read.
    """
    return _with_components(*_near_classes(docs, n, percent))


def _near_classes(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, n, digest, text_no), their classes, and the label of every linked class."""
    small_batches(docs.sparkSession)
    summary = stage(summaries(docs, n), "summaries")
    rows = summary.where("chunk IS NULL").select("doc_id", "n", "digest", "text_no")
    classes = rows.where("n > 0").groupBy("n", "digest").agg(
        F.min("doc_id").alias("first"),
        F.min("text_no").alias("text_no"),
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_no")).alias("least"),
        F.count(F.lit(1)).alias("members"),
    )
    classes = stage(classes.withColumn("class_id", F.monotonically_increasing_id()), "classes")
    # sent once for both passes over the texts; the filters in it are of bounded size
    context = docs.sparkSession.sparkContext
    order = context.broadcast(global_order(summary, docs, n, sampled=counted_share(percent)))

    release(docs.sparkSession)

    firsts = prefixes(docs, order, n, percent).dropDuplicates(["digest"])
    firsts = firsts.join(_shuffled(classes), "digest").select("class_id", "first", "n", "places", "prefix")
    firsts = stage(firsts, "prefixes")
    zipped = F.explode(F.arrays_zip("places", "prefix")).alias("x")
    tokens = firsts.select("class_id", "first", "n", zipped).select(
        "class_id", "first", "n", F.col("x.places").alias("place"), F.col("x.prefix").alias("token")
    )
    buckets = _bucketed(tokens, percent)

    least = F.min(F.struct("first", "class_id", "n")).alias("least")
    leaders = buckets.groupBy("token", "band").agg(least, F.count(F.lit(1)).alias("members")).where("members > 1")
    leaders = leaders.select("token", "band", F.col("least.class_id").alias("leader"), F.col("least.n").alias("leader_n"))
    leaders = stage(leaders, "leaders")
    members = buckets.drop("first").join(_shuffled(leaders.select("token", "band")), ["token", "band"], "left_semi")
    members = stage(members, "members")
    drop_tables(docs.sparkSession, [firsts])

    involved = classes.join(_shuffled(members.select("class_id").distinct()), "class_id", "left_semi")
    involved = stage(involved.select("class_id", "digest", "text_no"), "involved")
    wanted = context.broadcast(bit_filter(involved.select(F.col("text_no").alias("h")), _log_bits(involved.count())))
    parts = segments(docs, wanted, order, n).groupBy("digest", "fragment").agg(F.first("part").alias("part"))
    parts = stage(parts.join(_shuffled(involved), "digest").select("class_id", "fragment", "part"), "segments")
    drop_tables(docs.sparkSession, [involved])
    for sent in (order, wanted):  # what follows reads written tables
        sent.destroy()
    del order, wanted

    release(docs.sparkSession)

    links = stage(linked(_pairs_with(members, leaders, percent), parts, percent), "links")
    labels = components(links)
    left, second = _open_buckets(members, labels)
    drop_tables(docs.sparkSession, [members, leaders])
    release(docs.sparkSession)

    links = stage(links.union(linked(_pairs_with(left, second, percent), parts, percent)), "links")
    labels = components(links)
    before = [left, second]
    left, second = _open_buckets(left.drop("label"), labels)
    drop_tables(docs.sparkSession, [*before, second])
    release(docs.sparkSession)

    sizes = left.groupBy("token", "band").agg(F.count(F.lit(1)).alias("members"), F.min("class_id").alias("least"))
    sizes = stage(sizes, "sizes")
    heavy = left.join(sizes.where(F.col("members") >= HEAVY), ["token", "band"])
    families = components(heavy.select(F.col("class_id").alias("a"), F.col("least").alias("b")).distinct())
    light = _shuffled(sizes.where(F.col("members") < HEAVY).select("token", "band"))
    light = left.join(light, ["token", "band"], "left_semi")
    found = linked(_cross_pairs(light, percent), parts, percent)
    links = stage(links.union(found).union(_family_links(left, families, parts, percent)), "links")
    drop_tables(docs.sparkSession, [left, sizes, parts])
    release(docs.sparkSession)
    return rows, classes, components(links)


def _open_buckets(members: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (with label) of buckets that hold several components, and a leader per bucket by hash."""
    known = labels.withColumnRenamed("id", "class_id")
    labelled = members.join(known, "class_id", "left").withColumn("label", F.coalesce("label", "class_id"))
    pick = F.min_by(F.struct("class_id", "n"), F.xxhash64("token", "class_id"))
    several = (
        labelled.groupBy("token", "band")
        .agg(F.min("label").alias("low"), F.max("label").alias("high"), pick.alias("first"))
        .where("low < high")
        .select("token", "band", F.col("first.class_id").alias("leader"), F.col("first.n").alias("leader_n"))
    )
    several = stage(several, "open")
    left = labelled.join(_shuffled(several.select("token", "band")), ["token", "band"], "left_semi")
    return stage(left, "open"), several


def _cross_pairs(members: DataFrame, percent: int) -> DataFrame:
    """All pairs of one small bucket in different components that sizes and places do not rule out."""
    x = members.select("token", "band", *[F.col(c).alias(f"{c}_x") for c in ("class_id", "n", "place", "label")])
    y = members.select("token", "band", *[F.col(c).alias(f"{c}_y") for c in ("class_id", "n", "place", "label")])
    # common ones lie before this token in both sets, or from it on
    most = F.least("place_x", "place_y") + F.least(F.col("n_x") - F.col("place_x"), F.col("n_y") - F.col("place_y"))
    needed = F.ceil(percent * (F.col("n_x") + F.col("n_y")) / F.lit(100 + percent))
    fit = 100 * F.least("n_x", "n_y") >= percent * F.greatest("n_x", "n_y")
    met = x.join(_shuffled(y), ["token", "band"]).where(
        (F.col("class_id_x") < F.col("class_id_y")) & (F.col("label_x") != F.col("label_y")) & (most >= needed) & fit
    )
    return met.select(
        F.col("class_id_x").alias("a"), F.col("class_id_y").alias("b"), F.col("n_x").alias("na"), F.col("n_y").alias("nb")
    ).distinct()


def _block_links(percent: int):
    def run(table: pa.Table) -> pa.Table:
        """Links between two blocks of a family, or inside one, that connect what labels do not."""
        table = table.combine_chunks()
        ids, sizes, labels, blocks = (table.column(c).to_numpy() for c in ("class_id", "n", "label", "block"))
        lists = table.column("grams").combine_chunks()
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.chunk(0)
        rows = np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy()))
        _, grams, times = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
        several = np.cumsum(times > 1) - 1  # n-grams of one class add nothing
        rows, grams = rows[times[grams] > 1], several[grams[times[grams] > 1]]
        at = np.argsort(grams, kind="stable")
        rows, grams = rows[at], grams[at]
        common = np.zeros((len(ids), len(ids)), dtype=np.float32)
        for begin in range(0, int(grams[-1]) + 1 if len(grams) else 0, COLUMNS):
            low, high = np.searchsorted(grams, (begin, begin + COLUMNS))
            part = np.zeros((len(ids), COLUMNS), dtype=np.float32)
            part[rows[low:high], grams[low:high] - begin] = 1
            common += part @ part.T
        common = np.rint(common).astype(np.int64)
        link = 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)
        if blocks.min() != blocks.max():
            link &= blocks[:, None] != blocks[None, :]
        a, b = np.nonzero(np.triu(link, 1))
        root = {}

        def find(x):
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        out = []
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            p, q = find(labels[x]), find(labels[y])
            if p != q:
                root[p] = q
                out.append((ids[x], ids[y]))
        columns = [pa.array([int(o[i]) for o in out], pa.int64()) for i in (0, 1)]
        return pa.Table.from_arrays(columns, ["a", "b"])

    return run


def _family_links(members: DataFrame, families: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """Links between classes of a family: blocks of classes, compared two by two.

    The blocks of a large family are cut by size bands, and meet those of their
    own band and of the two next to it, as sets of other bands cannot link. A
    band of m classes makes about (m / BLOCK) ** 2 / 2 tasks' work, and twice
    that with a next one as large. Common n-grams are counted per cut of the
    order of n-grams, and summed.
    """
    band = F.floor(F.log("n") / F.lit(SLACK * float(np.log(100 / percent)))).cast("long")
    sizes = families.groupBy("label").agg(F.count(F.lit(1)).alias("m"))
    known = members.groupBy("class_id").agg(F.first("n").alias("n"), F.first("label").alias("label"))
    banded = (
        families.join(sizes.withColumnRenamed("label", "family"), F.col("label") == F.col("family"))
        .select(F.col("id").alias("class_id"), "family", "m")
        .join(known, "class_id")
        .withColumn("band", F.when(F.col("m") > BLOCK, band).otherwise(F.lit(0).cast("long")))
    )
    blocks = banded.groupBy("family", "band").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    around = F.explode(F.array(*[F.col("band") + i for i in (-1, 0, 1)])).alias("near")
    near = blocks.select("family", "band", "blocks", around)
    own = F.when(F.col("near") == F.col("band"), F.col("blocks"))
    near = near.groupBy("family", F.col("near").alias("band")).agg(
        F.max(own).alias("blocks"), F.collect_list(F.struct(F.col("band").alias("of"), "blocks")).alias("met")
    )
    placed = banded.join(near, ["family", "band"]).withColumn(
        "own", _block(F.col("band"), F.pmod(F.xxhash64("class_id"), F.col("blocks")))
    )

    def numbers(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(0).cast("long"), x["blocks"] - 1), lambda i: _block(x["of"], i))

    every = F.flatten(F.transform("met", numbers))
    grams = parts.join(families.select(F.col("id").alias("class_id")), "class_id", "left_semi")
    grams = grams.groupBy("class_id").agg(F.flatten(F.collect_list("part")).alias("grams"))
    rows = placed.join(grams, "class_id").withColumn("other", F.explode(every))
    rows = rows.select(
        "family",
        F.least("own", "other").alias("low"),
        F.greatest("own", "other").alias("high"),
        "class_id",
        "n",
        "label",
        F.col("own").alias("block"),
        "grams",
    )
    return rows.groupBy("family", "low", "high").applyInArrow(_block_links(percent), "a long, b long")


def _block(band: Column, number: Column) -> Column:
    """A block's number in its family."""
    return F.shiftleft(band, 32) + number


def _labelled(classes: DataFrame, labels: DataFrame) -> DataFrame:
    """classes with their label, the smallest class_id of the component."""
    return classes.join(labels, F.col("class_id") == F.col("id"), "left").withColumn(
        "label", F.coalesce("label", "class_id")
    )


def _with_components(rows: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row the smallest doc_id of the classes its own is connected with; salts spread a large class."""
    labelled = _labelled(classes, labels)
    smallest = labelled.groupBy("label").agg(F.min("first").alias("component"))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    one = F.array(F.pmod(F.xxhash64("first"), F.lit(SALTS)).cast("int"))  # its only row has this salt
    every = F.sequence(F.lit(0), F.lit(SALTS - 1))
    salted = labelled.join(smallest, "label").select(
        "digest", "component", F.explode(F.when(F.col("members") > 1, every).otherwise(one)).alias("salt")
    )
    met = rows.withColumn("salt", salt).join(_shuffled(salted), ["digest", "salt"], "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return met.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_one_of_each(docs: DataFrame, n: int = N_GRAM, percent: int = PERCENT) -> DataFrame:
    """One row of docs per component, and every row without words.

    The row of smallest doc_id (NULL last), of these that of smallest text hash,
    of these that of smallest hash of its other columns (but maps); rows equal
    in all that are equal, and one stays. Rows of one doc_id with different
    texts are apart.
    """
    rows, classes, labels = _near_classes(docs, n, percent)
    chosen = _labelled(classes, labels).groupBy("label").agg(F.min("least").alias("least"))
    chosen = chosen.select(F.col("least.doc_id").alias("doc_id_"), F.col("least.text_no").alias("text_no_"))
    times = rows.where("n > 0").groupBy("doc_id", "text_no").agg(F.count(F.lit(1)).alias("times"))
    same = F.col("doc_id").eqNullSafe(F.col("doc_id_")) & (F.col("text_no") == F.col("text_no_"))
    # what a key's rows come to: none stays, or one of several
    keys = times.join(chosen, same, "left").where("text_no_ IS NULL OR times > 1")
    keys = stage(keys.select("doc_id", "text_no", F.col("text_no_").isNotNull().alias("stays")), "keys")
    drop_tables(docs.sparkSession, [rows, classes])
    release(docs.sparkSession)

    others = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    named = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        F.xxhash64("text").alias("text_no_"),
        F.xxhash64(*others).alias("rest"),
        F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("salt_"),
    )
    salted = _shuffled(keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    met = F.col("doc.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("text_no_") == F.col("text_no"))
    met = met & (F.col("salt_") == F.col("salt"))
    left = named.join(salted, met, "left_anti").select("doc")
    repeated = _shuffled(salted.where("stays"))
    if repeated.isEmpty():
        return left.select("doc.*")
    several = named.join(repeated, met, "left_semi")
    once = several.groupBy("doc.doc_id", "text_no_").agg(F.min_by("doc", "rest").alias("doc"))
    return left.union(once.select("doc")).select("doc.*")
