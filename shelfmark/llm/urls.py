"""Listed URLs found by a blocked Bloom filter and an exact join behind it."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.operators import stage

LOG_BLOCKS = 15  # 2 ** 15 blocks of 512 bits: 2 MB, whatever the number of listed URLs
PROBES = 6
SALTS = 32


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """The key of a page: its host without a leading www, m or blog label; its path without .html and end slashes.

    It ends in ``?``, which no host or path contains, so it is never a rule's key.
    """
    return F.concat(F.regexp_replace(host, r"^(www|m|blog)\.", ""), _without_end(path), F.lit("?"))


def _without_end(path: Column) -> Column:
    """Without all slashes at the end, or without .html or .htm if it ends so."""
    cut = F.when(path.endswith(".html"), F.expr("5")).when(path.endswith(".htm"), F.expr("4")).otherwise(F.expr("0"))
    return F.when(path.endswith("/"), F.rtrim(path, F.lit("/"))).otherwise(
        F.substring(path, F.lit(1), F.length(path) - cut)
    )


def _blocks_and_masks(hashes: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """Block number, and the bits (word and bit in the block) of each key's probes."""
    block = (hashes >> np.uint64(64 - LOG_BLOCKS)).astype(np.int64)
    bits = np.empty((len(hashes), probes), dtype=np.int64)
    state = hashes
    for i in range(probes):
        state = (state ^ (state >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        bits[:, i] = (state >> np.uint64(40)).astype(np.int64) & 511
    return block, bits


def bloom_filter(listed: DataFrame, probes: int = PROBES) -> np.ndarray:
    """The filter's words, (blocks, 8) of 64 bits, from the ``key`` column of listed.

    Keys are hashed and their bits merged on the executors; one row per block,
    2 ** LOG_BLOCKS at most, comes back.
    """

    def bits(batches):
        for pdf in batches:
            hashes = pdf["h"].to_numpy(dtype=np.int64).view(np.uint64)
            block, at = _blocks_and_masks(hashes, probes)
            rows = np.zeros((len(hashes), 8), dtype=np.uint64)
            for i in range(probes):
                np.bitwise_or.at(
                    rows, (np.arange(len(hashes)), at[:, i] >> 6), np.uint64(1) << (at[:, i] & 63).astype(np.uint64)
                )
            yield pd.DataFrame({"block": block} | {f"w{i}": rows[:, i].view(np.int64) for i in range(8)})

    schema = "block long, " + ", ".join(f"w{i} long" for i in range(8))
    merged = (
        listed.select(F.xxhash64("key").alias("h"))
        .mapInPandas(bits, schema)
        .groupBy("block")
        .agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(8)])
    )
    out = np.zeros((1 << LOG_BLOCKS, 8), dtype=np.uint64)
    for row in merged.collect():
        out[row["block"]] = np.array(row[1:], dtype=np.int64).view(np.uint64)
    return out


def maybe_listed(keys: Column, bloom: np.ndarray, probes: int = PROBES) -> Column:
    """Elements of an array of keys that the filter does not rule out, as indexes."""

    @F.pandas_udf("array<int>")
    def test(hashes: pd.Series) -> pd.Series:
        lengths = hashes.map(len).to_numpy()
        flat = np.concatenate([*hashes, np.empty(0, dtype=np.int64)]).astype(np.int64).view(np.uint64)
        block, at = _blocks_and_masks(flat, probes)
        hit = np.ones(len(flat), dtype=bool)
        for i in range(probes):
            word = bloom[block, at[:, i] >> 6]
            hit &= (word >> (at[:, i] & 63).astype(np.uint64)) & np.uint64(1) == 1
        ends = np.cumsum(lengths)
        return pd.Series([np.flatnonzero(hit[e - n : e]).tolist() for e, n in zip(ends, lengths, strict=True)])

    return test(F.transform(keys, lambda k: F.xxhash64(k)))


def candidate_keys(host: Column, path: Column, shapes: Sequence[tuple[int, int]]) -> Column:
    """Every key a rule could have for this URL.

    ``shapes``: (labels of the host, length of the path) of the rules there are.
    A host gives one suffix per number of labels and a path one beginning per
    length, so the work is in proportion to the URL, however many labels it has.
    """
    labels = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
    keys = [
        F.when(
            (labels >= n) & (F.length(path) >= size),
            F.concat(F.substring_index(host, ".", -n), F.substring(path, 1, size)),
        )
        for n, size in shapes
    ]
    none = F.array().cast("array<string>")
    return F.when(host != "", F.filter(F.array(*keys), lambda k: k.isNotNull())).otherwise(none) if keys else none


def judge_urls(pages: DataFrame, rules: DataFrame, listed: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict (replacing columns of these names).

    ``rules``: host, path, verdict; a rule fits its host and all subdomains if
    the page's path starts with the rule's, and the longest one wins (of equals,
    ``block``). Pages without a rule are blocked if their canonical URL is
    in ``listed`` (host, path of listed pages), else get ``default``.

    A page's possible keys - host suffixes with path prefixes of the sizes that
    some rule has, and its canonical URL - are tested against one Bloom filter of
    fixed size over all listed keys. What passes meets the list in an exact
    join. Rules are salted, as one may fit a third of all pages; one URL on a
    third of the rows is left to the adaptive skew split. A fuller filter passes
    more; results stay exact.
    NULL URLs, and those without ``://``, have an empty host and path and no key.
    URLs of any length cost in proportion to their length. Repeated rows are
    judged one by one, repeated rules and listed pages count once. No rules and
    no list: all ``default``. No pages: no rows.
    """
    keyed_rules = rules.select(
        F.concat("host", "path").alias("key"), F.concat("host", "path").alias("rule"), "verdict"
    )
    keyed_pages = listed.select(
        canonical(F.col("host"), F.col("path")).alias("key"),
        F.lit(None).cast("string").alias("rule"),
        F.lit("block").alias("verdict"),
    )
    best = F.max(F.struct("verdict", "rule"))  # block above allow
    entries = stage(keyed_rules.union(keyed_pages).groupBy("key").agg(best.alias("e")).select("key", "e.*"), "listed")
    bloom = bloom_filter(entries)
    # distinct shapes of rules: few, as hosts have 127 labels and paths some length
    size = F.length("host") - F.length(F.replace("host", F.lit("."), F.lit(""))) + 1
    shapes = rules.where("host IS NOT NULL AND path IS NOT NULL").select(size, F.length("path")).distinct()
    shapes = sorted((r[0], r[1]) for r in shapes.collect())

    named = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("page"))
    host, path = F.col("host"), F.col("path")
    rows = named.select(
        "page",
        url_host(F.col(f"page.{url}")).alias("host"),
        url_path(F.col(f"page.{url}")).alias("path"),
        F.monotonically_increasing_id().alias("row_"),
    )
    rows = stage(rows, "urls")
    own = F.when(host != "", F.array(canonical(host, path))).otherwise(F.array().cast("array<string>"))
    keyed = rows.select("row_", F.concat(candidate_keys(host, path, shapes), own).alias("keys"))
    passed = keyed.select("row_", "keys", maybe_listed(F.col("keys"), bloom).alias("hits"))
    passed = passed.select("row_", F.explode("hits").alias("i"), "keys").select(
        "row_", F.get("keys", F.col("i")).alias("key")
    )
    salt = F.when(F.col("key").endswith("?"), 0).otherwise(F.pmod("row_", F.lit(SALTS)).cast("int"))
    passed = passed.withColumn("salt", salt)
    salts = F.when(F.col("rule").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    salted = entries.withColumn("salt", F.explode(salts))
    found = (
        passed.join(salted, ["key", "salt"])
        .groupBy("row_")
        .agg(F.max(F.struct(F.coalesce(F.length("rule"), F.lit(-1)).alias("n"), "verdict", "rule")).alias("best"))
    )
    added = ("host", "path", "rule", "verdict")
    return rows.join(found, "row_", "left").select(
        *[F.col(f"page.`{c}`") for c in pages.columns if c not in added],
        host,
        path,
        F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"),
    )


# The rules of the registered query, and labels of the hosts its list starts from.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
LISTED_LABELS = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")


def article(html: Column) -> Column:
    """What stands in the page's (first) article element; NULL without one, or with nothing in it."""
    html = html.cast("string")
    begins = F.substring_index(html, "</article>", 1)
    inside = F.substring_index(begins, "<article>", -1)
    there = html.contains("</article>") & begins.contains("<article>") & (inside != "")
    return F.when(there, inside)


def listed_pages(pages: DataFrame) -> DataFrame:
    """host, path of the pages to list: those of listed host families, and mirrors of their articles on any host.

    Articles are compared by MD5. Pages without an article mirror nothing; NULL
    URLs list nothing. Copies of one article are told apart only by host, so
    the join's left side may be split where one article is on many pages.
    """
    rows = pages.select(
        url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), F.md5(article(F.col("html"))).alias("body")
    )
    on_list = F.arrays_overlap(F.split("host", r"\."), F.array(*[F.lit(x) for x in LISTED_LABELS]))
    rows = stage(rows.withColumn("known", on_list).where("host <> ''"), "bodies")
    bodies = rows.where("known AND body IS NOT NULL").select("body").distinct()
    mirrors = rows.where("NOT known").join(bodies, "body", "left_semi")
    return rows.where("known").select("host", "path").union(mirrors.select("host", "path"))


def judge_pages(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict by RULES and ``listed_pages``."""
    rules = pages.sparkSession.createDataFrame(list(RULES), "host string, path string, verdict string")
    return judge_urls(pages.select("page_id", "url"), rules, listed_pages(pages)).drop("url")
