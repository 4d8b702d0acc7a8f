"""SimHash near-duplicates through an inverted index of the fingerprints' byte positions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.components import components
from shelfmark.llm.text import slices, small_batches
from shelfmark.operators import stage

SHINGLE = 4  # words
DISTANCE = 4  # bits that linked fingerprints differ in, at most
BYTES = 8
SHARED = BYTES - DISTANCE  # positions that linked fingerprints share, at least
# Of any four of the eight positions two lie in the same of these three parts, so the
# lists of pairs inside the parts cover all links.
PARTS = ((0, 1, 2), (3, 4, 5), (6, 7))
LIST = 1_024  # a longer list is split by one more position
SALTS = 16
SEED = 42
AT_ONCE = 1 << 14  # shingles whose bits are counted at once


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Bit by bit the majority of the shingles' XXH64; 0 without words."""
    import xxhash

    found = text.lower().split()  # bytes: ASCII alone
    if not found:
        return 0
    k = min(shingle, len(found))
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    begins = np.append(0, ends[:-1] + 1)
    spans = zip(begins[: len(found) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    hashes = np.array([xxhash.xxh64_intdigest(joined[b:e], SEED) for b, e in spans], dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), AT_ONCE):
        part = hashes[at : at + AT_ONCE]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, BYTES), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint16 if len(part) < 1 << 16 else np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp: one row per row of docs."""
    small_batches(docs.sparkSession)
    schema = docs.select("doc_id", F.lit(0).cast("long").alias("fp")).schema

    def run(batches):
        for batch in slices(batches):
            found = [fingerprint((t or "").encode("utf-8")) for t in batch.column("text").to_pylist()]
            fps = pa.array(np.array(found, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), fps], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _bytes_of(positions: int) -> int:
    """The bits of the byte positions (a bit set of them), as a signed 64-bit number."""
    bits = sum(255 << (8 * p) for p in range(BYTES) if positions >> p & 1)
    return bits - (1 << 64) if bits >> 63 else bits


def _listed(fps: DataFrame, positions: Column) -> DataFrame:
    """fp in the lists of several sets of byte positions: (positions, value, fp)."""
    masks = F.array(*[F.lit(_bytes_of(p)).cast("long") for p in range(1 << BYTES)])
    rows = fps.select("fp", F.explode(positions).alias("positions"))
    value = F.col("fp").bitwiseAND(F.get(masks, F.col("positions")))
    return rows.select("positions", value.alias("value"), "fp")


def _salted(lists: DataFrame, long_ones: DataFrame, how: str) -> DataFrame:
    """Semi or anti join of list rows with long lists, whose rows are spread over salts."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    rows = lists.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int"))
    return rows.join(long_ones.withColumn("salt", salts), ["positions", "value", "salt"], how).drop("salt")


def _whole_groups(batches, names: list[str]) -> Iterator[list[np.ndarray]]:
    """Columns of sorted batches, cut where the value of the columns but the last changes."""
    kept = None
    for batch in batches:
        now = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        if kept is not None:
            now = [np.append(a, b) for a, b in zip(kept, now, strict=True)]
        if not len(now[0]):
            continue
        same = np.ones(len(now[0]), dtype=bool)
        for column in now[:-1]:
            same &= column == column[-1]
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield [c[:cut] for c in now]
        kept = [c[cut:] for c in now]
    if kept is not None:
        yield kept


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those links that connect what the ones before do not."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    chosen = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        p, q = find(x), find(y)
        if p != q:
            root[p] = q
            chosen.append(i)
    return a[chosen], b[chosen]


def _link_lists(batches):
    """Links within lists: shared positional bytes tallied per pair, enough of them verified bit by bit."""
    for positions, value, fp in _whole_groups(batches, ["positions", "value", "fp"]):
        fp = fp.view(np.uint64)
        new = np.append(True, (positions[1:] != positions[:-1]) | (value[1:] != value[:-1]))
        group = np.cumsum(new)
        left, right = [], []
        at, step = np.arange(len(fp)), 1
        while len(at):
            at = at[at + step < len(fp)]
            at = at[group[at] == group[at + step]]
            differ = fp[at] ^ fp[at + step]
            tally = (differ.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
            enough = np.flatnonzero(tally >= SHARED)
            enough = enough[np.bitwise_count(differ[enough]) <= DISTANCE]
            left.append(fp[at[enough]])
            right.append(fp[at[enough] + step])
            step += 1
        a, b = _forest(np.concatenate(left), np.concatenate(right))
        yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], ["a", "b"])


def _link_stars(batches):
    """Links between the fingerprints around each midpoint, all to the first."""
    for middle, fp in _whole_groups(batches, ["middle", "fp"]):
        first = np.flatnonzero(np.append(True, middle[1:] != middle[:-1]))
        hub = np.repeat(fp[first], np.diff(np.append(first, len(fp))))
        pairs = np.unique(np.stack([hub, fp], axis=1)[hub != fp], axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _in_order(rows: DataFrame, keys: list[str], link: Callable) -> DataFrame:
    """``link`` over rows dealt by keys and sorted."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = rows.repartition(n, *keys).sortWithinPartitions(*keys, "fp")
    return sorted_.mapInArrow(link, "a long, b long")


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints (column ``fp``) at DISTANCE or less.

    Two such fingerprints share SHARED of their 8 bytes, position by position.
    The inverted index has a list per value of two byte positions, of the seven
    pairs that cover any four positions. The fingerprints of a list meet in one
    task, shared positions are tallied per pair, and pairs that reach SHARED are
    verified. A task gives back no more links than fingerprints.

    A list longer than LIST is not compared but split by each further position,
    up to four: a link's other shared positions lead it into one of the
    splits. Fingerprints of lists that are long even then lie about each other
    in the remaining 32 bits. They are linked by midpoints: those at distance 4
    or less have a number at distance 2 or less of both, and all around
    one number are within 4. So every fingerprint meets at most LIST others in
    each of at most 7 + 30 + 70 lists, or 2,081 midpoints, however many there are.
    """
    pairs = [(1 << a) | (1 << b) for part in PARTS for a, b in combinations(part, 2)]
    lists = _listed(fps, F.array(*[F.lit(p) for p in pairs]))
    links = None
    for depth in range(2, SHARED + 1):
        sizes = lists.groupBy("positions", "value").agg(F.count(F.lit(1)).alias("members"))
        long_ones = stage(sizes.where(F.col("members") > LIST).select("positions", "value"), "long-lists")
        some = not long_ones.isEmpty()
        short = _salted(lists, long_ones, "left_anti") if some else lists
        found = _in_order(short, ["positions", "value"], _link_lists)
        links = found if links is None else links.union(found)
        if not some:
            return links
        members = _salted(lists, long_ones, "left_semi")
        if depth < SHARED:
            more = F.filter(
                F.array(*[F.col("positions").bitwiseOR(F.lit(1 << p)) for p in range(BYTES)]),
                lambda p: p != F.col("positions"),
            )
            wider = members.select("fp", F.explode(more).alias("p")).groupBy("fp").agg(F.collect_set("p").alias("ps"))
            lists = stage(_listed(wider.select("fp", "ps"), F.col("ps")), "lists")
    one = [0, *[1 << i for i in range(64)], *[(1 << i) | (1 << j) for i, j in combinations(range(64), 2)]]
    signed = F.array(*[F.lit(x - (1 << 64) if x >> 63 else x).cast("long") for x in one])
    around = members.select("fp").distinct().select("fp", F.explode(signed).alias("by"))
    around = around.select(F.col("fp").bitwiseXOR(F.col("by")).alias("middle"), "fp")
    return links.union(_in_order(around, ["middle"], _link_stars))


def near_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of docs.

    A fingerprint bit is set if more than half of a text's 4-word shingles
    (A-Z lower-cased, words parted by ASCII white space, joined by one space;
    fewer words: the whole sequence) have it set in their XXH64 of seed 42.
    Fingerprints link at four or fewer differing bits; ``component_id`` is the
    smallest doc_id reachable over links.

    Documents of one fingerprint are one class, so copies cost one row each;
    classes are linked by ``fingerprint_links``.

    NULL, empty and blank texts have fingerprint zero and link like any other.
    Repeated rows have equal results. A NULL doc_id gets the component of its
    class, NULL if nobody there has a doc_id. Other columns are not read. An
    empty table gives an empty one.
    """
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    rows = stage(fingerprints(docs).withColumn("salt", salt), "fingerprints")
    classes = rows.groupBy("fp").agg(
        F.min("doc_id").alias("first"), F.min("salt").alias("salt"), F.count(F.lit(1)).alias("members")
    )
    classes = stage(classes, "classes")
    labels = components(fingerprint_links(classes.select("fp")))
    labelled = classes.join(labels, F.col("fp") == F.col("id"), "left").select(
        "fp", "first", "salt", "members", F.coalesce("label", "fp").alias("label")
    )
    smallest = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    # a class of one row is met by that row's salt, others by all
    salts = F.when(F.col("members") > 1, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array("salt"))
    known = labelled.withColumn("salt", F.explode(salts)).select("fp", "salt", "label").join(smallest, "label")
    return rows.join(known.drop("label"), ["fp", "salt"]).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
