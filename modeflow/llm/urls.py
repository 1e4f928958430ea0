"""URL filters: a blocked Bloom filter of listed keys passes possible hits to an exact hash join.

Listed are canonical URLs and rules (host, path, verdict). A url asks for its canonical form and for each rule that could fit
it (suffixes of its host with prefixes of its path); the filter answers nearly all of these in the task that reads the row.
What it lets pass is joined, by the whole key, with the list, which removes the false positives.

Scale: the filter has BITS_A_KEY bits for each key up to MOST_BLOCKS blocks of 64 bytes; a longer list fills it more, so more
false positives reach the join, and the result stays the same. Rows without a possible hit are never shuffled. The keys asked
for are made distinct before they meet the list, so a host of a third of all rows asks once; the keys found return by a
broadcast if they are counted to be few and short, else by a join that Spark can split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as T
from .common import cut, table

#: Filter bits for each listed key; blocks of 64 bytes at most; keys and bytes that return by a broadcast at most.
BITS_A_KEY, MOST_BLOCKS, BROADCAST_KEYS, BROADCAST_BYTES = 16, 1 << 17, 50_000, 4 << 20
_WORDS, _BLOCK_BITS = 8, 512
# Query parameters that do not tell pages apart, and default ports.
TRACKING, PORTS = r"^(utm_[^=]*|gclid|fbclid|ref)(=|\z)", r":(80|443)\z"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rest_of(url: Column) -> Column:
    """What follows the first `://`; null without one."""
    return F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(rest_of(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(rest_of(url), r"^[^/?#]*(/[^?#]*)?", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host in lower case without `www.` and default port, path without slashes at its end, the other parameters in order.

    Scheme and fragment do not count; null for a null url or one without `://`.
    """
    rest = rest_of(url)
    host = F.regexp_replace(F.regexp_replace(host_of(url), PORTS, ""), r"^www\.", "")
    query = F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)
    asked = F.array_sort(F.filter(F.split(query, "&", -1), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.when(rest.isNotNull(), F.concat(host, F.regexp_replace(path_of(url), r"/+\z", ""), F.when(F.size(asked) > 0, F.concat(F.lit("?"), F.array_join(asked, "&"))).otherwise("")))


def hashes(keys: pa.Array) -> np.ndarray:
    """64-bit hashes of the keys; null counts as empty."""
    out = [np.zeros(0, np.uint64)]
    for _, _, data, offs in T.steps(keys):
        out.append(T.word_hashes(data, offs[:-1], offs[1:]))
    return np.concatenate(out)


def bits(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each key, and one bit in each of the block's eight words."""
    at = (T.mix(h) % np.uint64(blocks)).astype(np.int64)
    shifts = (h[:, None] >> np.arange(0, 6 * _WORDS, 6, dtype=np.uint64)) & np.uint64(63)
    return at, np.uint64(1) << shifts


def bloom(entries: DataFrame, keys: int) -> np.ndarray:
    """The blocked filter of the column `key`, (blocks, 8) words. Tasks send the words of the blocks they set."""
    blocks = int(min(MOST_BLOCKS, max(1, -(-keys * BITS_A_KEY // _BLOCK_BITS))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, words = bits(hashes(batch.column(0)), blocks)
            yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(words[:, i].view(np.int64)) for i in range(_WORDS)]], ["block", *(f"w{i}" for i in range(_WORDS))])

    schema = "block bigint, " + ", ".join(f"w{i} bigint" for i in range(_WORDS))
    set_ = entries.select("key").mapInArrow(run, schema).groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(_WORDS)]).toArrow()
    out = np.zeros((blocks, _WORDS), np.uint64)
    out[set_["block"].to_numpy()] = np.column_stack([set_[f"w{i}"].to_numpy() for i in range(_WORDS)]).view(np.uint64)
    return out


def passed(words: np.ndarray, keys: pa.Array) -> np.ndarray:
    """Which keys may be listed: all that are, and few others."""
    at, want = bits(hashes(keys), len(words))
    return ((words[at] & want) == want).all(axis=1)


def fitting(rules: DataFrame) -> DataFrame:
    """The rules that can fit a url: with a host, a verdict, and a path that is empty or begins as paths do."""
    return rules.where((F.col("host") != "") & F.col("path").isNotNull() & F.col("verdict").isNotNull() & ((F.col("path") == "") | F.col("path").startswith("/")))


def listing(rules: DataFrame, listed: DataFrame) -> DataFrame:
    """key, rule and verdict of all listed keys, one row each: rules (r:), their hosts (h:, for the filter), urls (u:)."""
    good = fitting(rules).select(F.translate("host", _UPPER, _LOWER).alias("host"), "path", "verdict")
    named = F.concat("host", "path")
    keys = good.select(F.concat(F.lit("r:"), named).alias("key"), F.when(F.col("verdict") == "block", 0).otherwise(1).alias("soft"))
    keys = keys.union(good.select(F.concat(F.lit("h:"), "host"), F.lit(0)))
    keys = keys.union(listed.select(F.concat(F.lit("u:"), canonical(F.col("url"))).alias("key"), F.lit(0)).where("key is not null"))
    one = keys.groupBy("key").agg(F.min("soft").alias("soft"))  # of rules that differ in the verdict alone, the one that blocks
    return one.select("key", F.when(F.col("key").startswith("r:"), F.substring("key", 3, 1 << 30)).alias("rule"), F.when(F.col("soft") == 0, "block").otherwise("allow").alias("verdict"))


def asked(labels: int, lengths: list[int]) -> Column:
    """What a row with url, host and path asks the filter for: its canonical form and suffixes of its host."""
    parts = F.split("host", r"\.", -1)
    last = F.slice(parts, F.greatest(F.lit(1), F.size(parts) - labels + 1), F.lit(max(labels, 1)))
    suffixes = F.transform(F.sequence(F.lit(1), F.size(last)), lambda i: F.concat(F.lit("h:"), F.array_join(F.slice(last, i, F.size(last)), ".")))
    return F.concat(F.when(F.col("canonical").isNotNull(), F.array(F.concat(F.lit("u:"), "canonical"))).otherwise(F.array().cast("array<string>")), F.when(F.col("host") != "", suffixes).otherwise(F.array().cast("array<string>")) if lengths else F.array().cast("array<string>"))


def probed(rows: DataFrame, words: np.ndarray, labels: int, lengths: list[int]) -> DataFrame:
    """id, url and `maybe`, the keys that the filter lets pass: rules are asked for only under hosts that pass."""
    context = rows.sparkSession.sparkContext
    held, sizes = context.broadcast(words), sorted(set(lengths))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column(2).to_pylist()
            flat, owner = batch.column(3).flatten(), np.repeat(np.arange(batch.num_rows), batch.column(3).value_lengths().to_numpy())
            ok = passed(held.value, flat)
            owner, keys = owner[ok], flat.filter(pa.array(ok)).to_pylist()
            ask = [(r, k if k[0] == "u" else f"r:{k[2:]}{paths[r][:n]}") for r, k in zip(owner.tolist(), keys, strict=True) for n in (sizes if k[0] == "h" else (0,)) if n <= len(paths[r])]
            ok = passed(held.value, pa.array([k for _, k in ask], pa.string()))
            found: list[list[str]] = [[] for _ in paths]
            for (r, k), good in zip(ask, ok.tolist(), strict=True):
                if good:
                    found[r].append(k)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.string()))], ["id", "url", "maybe"])

    ready = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url")), "canonical": canonical(F.col("url"))})
    return ready.select("id", "url", "path", asked(labels, lengths).alias("asked")).mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, url string, maybe array<string>")


def judge(df: DataFrame, rules: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule, verdict (allow or block) and listed (whether the canonical url is) of every row.

    rules: host, path, verdict; a rule fits its host and all subdomains if the url's path starts with its path. The longest rule
    (host and path together, then host) gives the verdict, of equal rules one that blocks. Without a rule a listed url is
    blocked, any other allowed. listed: urls in any spelling, compared as `canonical` writes them. A null url or one without
    `://` has an empty host and path, no rule, and is allowed. Rules without a host, path or verdict fit nothing. Repeated rows
    give repeated results, null ids stay, other columns are ignored.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    entries = cut(listing(rules, listed))
    host = F.when(F.col("key").startswith("h:"), F.col("key"))
    keys, labels = entries.agg(F.count(F.lit(1)), F.max(F.size(F.split(host, r"\.", -1)))).first()
    # lengths of paths: as many numbers as the longest path has letters, at most
    lengths = [r[0] for r in fitting(rules).select(F.length("path")).distinct().collect()]
    words = bloom(entries, keys)
    found = probed(rows, words, labels or 0, lengths)
    maybe = cut(found.where(F.size("maybe") > 0))
    wanted = maybe.select(F.explode("maybe").alias("key")).distinct()
    hits = cut(entries.join(wanted.hint("shuffle_hash"), "key"))
    n, size = hits.agg(F.count(F.lit(1)), F.sum(F.octet_length("key"))).first()
    few = n <= BROADCAST_KEYS and (size or 0) <= BROADCAST_BYTES
    pairs = maybe.select("id", "url", F.size("maybe").alias("n"), F.explode("maybe").alias("key")).join(F.broadcast(hits) if few else hits, "key", "left")
    rule = F.when(F.col("rule").isNotNull(), F.struct(F.length("rule").alias("n"), F.length(F.regexp_extract("rule", r"^[^/]*", 0)).alias("h"), "rule", "verdict"))
    best = pairs.groupBy("id", "url", "n").agg(F.max(rule).alias("best"), F.max(F.col("key").startswith("u:") & F.col("verdict").isNotNull()).alias("listed"), F.count(F.lit(1)).alias("all"))
    judged = best.select("id", "url", "best", "listed", F.explode(F.sequence(F.lit(1), (F.col("all") / F.col("n")).cast("int")))).drop("col")
    clear = found.where(F.size("maybe") == 0).select("id", "url", F.lit(None).cast(judged.schema["best"].dataType).alias("best"), F.lit(False).alias("listed"))
    verdict = F.coalesce(F.col("best.verdict"), F.when(F.col("listed"), "block").otherwise("allow"))
    return judged.union(clear).select(F.col("id").alias(id_col), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("best.rule").alias("rule"), verdict.alias("verdict"), "listed")


# Fixed values of the contract.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
# Fixed words: names of junk hosts. The tables hold no list of urls, so the query lists the pages of hosts with such a part.
JUNK = r"(^|[.-])(casino|pills|bets|spam)([.-]|\z)"


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    listed = pages.where(host_of(F.col("url")).rlike(JUNK)).select("url")
    return judge(pages, spark.createDataFrame(RULES, "host string, path string, verdict string"), listed)


OP12_SQL = f"""
WITH cutting AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), parsed AS (
  SELECT page_id, url, rest,
         coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0), '{_UPPER}', '{_LOWER}'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1), '') AS path,
         list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '{TRACKING}'))) AS asked
  FROM cutting
), canon AS (
  SELECT *, CASE WHEN rest IS NOT NULL THEN regexp_replace(regexp_replace(host, '{PORTS}', ''), '^www\\.', '') || regexp_replace(path, '/+\\z', '')
                || CASE WHEN len(asked) > 0 THEN '?' || array_to_string(asked, '&') ELSE '' END END AS canonical
  FROM parsed
), rules(rhost, rpath, rverdict) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}),
fitting AS (
  SELECT DISTINCT host, path, arg_max(rhost || rpath, length(rhost || rpath)) OVER (PARTITION BY host, path) AS rule,
         arg_max(rverdict, length(rhost || rpath)) OVER (PARTITION BY host, path) AS rverdict
  FROM (SELECT DISTINCT host, path FROM canon) u JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
), junk AS (SELECT DISTINCT canonical FROM canon WHERE regexp_matches(host, '{JUNK}'))
SELECT c.page_id, c.host, c.path, f.rule, j.canonical IS NOT NULL AS listed,
       coalesce(f.rverdict, CASE WHEN j.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM canon c LEFT JOIN fitting f ON f.host = c.host AND f.path = c.path LEFT JOIN junk j ON j.canonical = c.canonical
"""
