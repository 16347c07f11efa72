"""Deduplicating new batches against all history (problem 1).

The accepted lines live in an inverted index, a folder that outlives the session.  A line has two token sets: its hash, one
token, and its download, the tokens host, path and document id.  The index holds

``ranks``     tokens with their measured frequency in the first load; tokens that are not in it are rarer than those that are.
              This order is frozen with the index, and building the index anew measures it again;
``postings``  each distinct set of accepted lines under the tokens of its prefix, the rarest ones: two sets that overlap by a
              share ``t`` share a token of the first ``n - ceil(t * n) + 1``.  Partitioned by bucket of the token;
``sightings`` the fetch times of accepted lines by download and half-day slot.  Partitioned by bucket of the download.

A batch is reduced to its distinct sets, which probe the postings of their prefix tokens, in the buckets that these fall
into and no others; partners of another length are dropped, the overlap of all tokens is verified, and what is new is
appended.  A token of more than ``HOT`` lines is salted, and a hot set is one posting, however many lines hold it.
The rules of this problem ask for the whole set, an overlap of 1, so that the prefix is the rarest token.

Within a batch, lines depend on each other in arrival order.  A line is accepted as soon as no undecided earlier
line shares its hash or lies near it in its download; what the accepted ones cover is a case; the rest takes another
round.  Nearness uses half-day slots: at most one line of a download and slot can be accepted, so a hot download is
pre-aggregated to one candidate a slot, and waiting for two slots either way is enough.  Every round settles the
earliest open line at least; there are as many rounds as the longest chain of lines that decide over each other.

Defined results: null or blank hash, or ``n_bytes`` 0: no hash.  Null or blank url: no download.  Unreadable or null
``fetched_at``: never within 24 hours.  A line with neither hash nor download is accepted.  Repeated rows count once; different
rows under one ``record_no`` arrive together.  Appending a batch twice changes no result.  Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from actmill.session import cut, discard, scratch, table

DAY_US = 24 * 3600 * 1_000_000
SLOT_US = DAY_US // 2
#: Query parameters that name the document.
ID_PARAMS = ("dok", "doc", "id")
#: Lines of the first load for each bucket of the index, and the least number of buckets.
PER_BUCKET, LEAST_BUCKETS = 100_000, 8
#: Lines from which a token has a rank of its own, and lines per salt of a token.
RANKED, HOT = 16, 100_000
#: Lines of a batch from which its plans are worth compiling.
COMPILED = 100_000
CODEGEN = "spark.sql.codegen.wholeStage"
#: Parts of a batch when the manifest is laid out by batch.
PARTS = 64


def clean_hash(sha256: Column, n_bytes: Column) -> Column:
    """Lower-case digest without spaces and algorithm prefix; null when absent."""
    h = F.regexp_replace(F.lower(F.regexp_replace(sha256, r"(?U)^\s+|\s+$", "")), r"^sha-?256\s*[:=]\s*", "")
    return F.when((h != "") & ~F.coalesce(n_bytes == 0, F.lit(False)), h)


def download_tokens(url: Column) -> Column:
    """The tokens id, path and host of a url however it is spelt; null when there is none."""
    u = F.regexp_replace(F.regexp_replace(url, r"(?U)\s+", ""), "#.*$", "")
    u = F.regexp_replace(u, r"^(?i)([a-z][a-z0-9+.-]*:)?//", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(u, r"^([^/?]*)", 1)), r"^.*@|^www\.|:\d*$|\.$", "")
    host = F.regexp_replace(host, r"^www\.", "")
    raw_path = F.regexp_extract(u, r"^[^/?]*([^?]*)", 1)
    path = F.lower(F.coalesce(F.try_url_decode(F.replace(raw_path, F.lit("+"), F.lit("%2B"))), raw_path))
    path = F.regexp_replace(F.regexp_replace(path, "/+", "/"), "/$", "")
    query = F.regexp_extract(u, r"\?(.*)$", 1)
    query = F.lower(F.coalesce(F.try_url_decode(query), query))
    named = F.regexp_extract(query, rf"(?:^|&)(?:{'|'.join(ID_PARAMS)})=0*([^&]*)", 1)
    number = F.when(named != "", named).otherwise(F.regexp_extract(path, r".*?0*(\d+)[^\d/]*$", 1))
    tokens = F.array_compact(F.array(F.when(number != "", F.concat(F.lit("d:"), number)), F.concat(F.lit("p:"), path), F.concat(F.lit("h:"), host)))
    return F.when((host != "") | (path != ""), tokens)


def lines(records: DataFrame) -> DataFrame:
    """``record_no, hash, url, url_tokens, at, slot`` of each manifest line; ``url`` names the download."""
    at = F.unix_micros(F.try_to_timestamp(F.trim("fetched_at")))
    toks = download_tokens(F.col("url"))
    df = records.filter("record_no is not null").select("record_no", clean_hash(F.col("sha256"), F.col("n_bytes")).alias("hash"), toks.alias("url_tokens"), at.alias("at"))
    return df.select("record_no", "hash", F.array_join("url_tokens", "\n").alias("url"), "url_tokens", "at", F.floor(F.col("at") / SLOT_US).alias("slot")).distinct()


def token_sets(batch: DataFrame) -> DataFrame:
    """``set, tokens`` of the lines: a row per distinct hash and download, and the number of lines that hold it."""
    of_hash = F.concat(F.lit("s:"), F.col("hash"))
    both = F.array(F.struct(of_hash.alias("set"), F.array(of_hash).alias("tokens")), F.struct(F.col("url").alias("set"), F.col("url_tokens").alias("tokens")))
    return batch.select(F.explode(both).alias("s")).select("s.*").filter("set is not null").groupBy("set", "tokens").agg(F.count(F.lit(1)).alias("n_lines"))


class Index:
    """The inverted index in a folder; ``create`` it from a first load, open it by its path."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        shape = spark.read.parquet(f"{self.path}/shape").first()
        self.buckets, self.overlap = shape.buckets, shape.overlap  # overlap: the least one that can be asked for

    @classmethod
    def create(cls, first: DataFrame, path: str, buckets: int | None = None, overlap: float = 1.0) -> Index:
        """An empty index whose order of tokens is measured in ``first``, the lines of the first load."""
        spark, path = first.sparkSession, path.rstrip("/")
        buckets = buckets or max(LEAST_BUCKETS, -(-first.count() // PER_BUCKET))
        ranks = token_sets(first).select(F.explode("tokens").alias("token"), "n_lines").groupBy("token").agg(F.sum("n_lines").alias("df")).filter(F.col("df") >= RANKED)
        ranks.write.parquet(f"{path}/ranks")
        spark.createDataFrame([(buckets, overlap)], "buckets int, overlap double").coalesce(1).write.parquet(f"{path}/shape")
        for name, fields in (("postings", "token string, salt int, set string, tokens array<string>, n int, bucket int"), ("sightings", "u binary, slot long, at long, bucket int")):
            spark.createDataFrame([], fields).write.partitionBy("bucket").parquet(f"{path}/{name}")
        return cls(spark, path)

    def _stored(self, name: str, fields: str, buckets: list[int]) -> DataFrame:
        """A table of the index, of these buckets only."""
        return self.spark.read.schema(f"{fields}, bucket int").parquet(f"{self.path}/{name}").filter(F.col("bucket").isin(buckets))

    def postings(self, buckets: list[int]) -> DataFrame:
        return self._stored("postings", "token string, salt int, set string, tokens array<string>, n int", buckets)

    def sightings(self, buckets: list[int]) -> DataFrame:
        return self._stored("sightings", "u binary, slot long, at long", buckets)

    def _bucket(self, *key: str) -> Column:
        return F.pmod(F.xxhash64(*key), F.lit(self.buckets)).cast("int")

    def buckets_of(self, prefixes: DataFrame, batch: DataFrame) -> tuple[list[int], list[int]]:
        """Numbers of the buckets of postings and of sightings that a batch asks for."""
        of_urls = _times(batch).select(F.lit(1).alias("kind"), self._bucket("u").alias("bucket"))
        rows = prefixes.select(F.lit(0).alias("kind"), "bucket").unionByName(of_urls).distinct().collect()
        return [r.bucket for r in rows if not r.kind], [r.bucket for r in rows if r.kind]

    def prefixes(self, sets: DataFrame, overlap: float) -> DataFrame:
        """``set, tokens, n, token, salt, bucket``: the rarest tokens of each set, as many as a partner must share one of.

        Below an overlap of 1 a partner may lie under any salt of a token, so that a set probes all of them.
        """
        single = F.size("tokens") == 1  # its token is the prefix, and no other set has it
        alone = sets.filter(single).select("set", "tokens", F.lit(1).alias("n"), F.element_at("tokens", 1).alias("token"), F.lit(0).alias("own"), F.lit(0).alias("salt"))
        ranks = self.spark.read.schema("token string, df long").parquet(f"{self.path}/ranks")
        flat = sets.filter(~single).select("set", "tokens", F.explode("tokens").alias("token")).join(ranks, "token", "left")
        ordered = flat.groupBy("set", "tokens").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token"))).alias("o"))
        n = F.size("tokens")
        first = ordered.select("set", "tokens", n.alias("n"), F.explode(F.slice("o", F.lit(1), (n - F.ceil(n * overlap - 1e-9) + 1).cast("int"))).alias("o"))
        salts = F.greatest(F.lit(1), F.ceil(F.col("o.df") / HOT)).cast("int")
        own = F.pmod(F.xxhash64("set"), salts).cast("int")
        rows = first.select("set", "tokens", "n", F.col("o.token").alias("token"), own.alias("own"), F.explode(F.array(own) if overlap >= 1 else F.sequence(F.lit(0), salts - 1)).alias("salt"))
        return alone.unionByName(rows).withColumn("bucket", self._bucket("token", "salt"))

    def probe(self, prefixes: DataFrame, overlap: float, buckets: list[int]) -> DataFrame:
        """``set, partner``: sets of the index that overlap with a probing one by ``overlap`` of all their tokens at least."""
        asked = prefixes.drop("bucket")
        p = self.postings(buckets).select("token", "salt", F.col("set").alias("partner"), F.col("tokens").alias("p_tokens"), F.col("n").alias("m"))
        long_enough = (F.col("m") >= F.col("n") * overlap - 1e-9) & (F.col("n") >= F.col("m") * overlap - 1e-9)
        both = F.size(F.array_intersect("tokens", "p_tokens"))
        pairs = asked.join(p, ["token", "salt"]).filter(long_enough).filter(both >= overlap * (F.col("n") + F.col("m") - both) - 1e-9)
        return pairs.select("set", "partner").distinct()

    def append(self, prefixes: DataFrame, seen: DataFrame) -> None:
        """Add the sets of accepted lines that are new, and where and when the lines were fetched."""
        prefixes.filter("salt = own").select("token", "salt", "set", "tokens", "n", "bucket").repartition("bucket").sortWithinPartitions("bucket", "token").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/postings")
        times = _times(seen).groupBy("u", "slot").agg(F.min("at").alias("at"))  # at most one a slot is accepted
        times.withColumn("bucket", self._bucket("u")).repartition("bucket").sortWithinPartitions("bucket", "u").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/sightings")


def _digest(c: Column) -> Column:
    """16 bytes that stand for a string."""
    return F.unhex(F.md5(c))


def keyed(batch: DataFrame) -> DataFrame:
    """Lines with a key for each thing they can share: hash ``h``, download ``u``, download and slot ``t``; a line without it has a key of its own.

    Keys are digests of 16 bytes, so that what crosses the shuffles is small.
    """
    own = F.concat(F.lit("\0"), F.col("record_no"))
    d = batch.select("record_no", F.col("hash").isNotNull().alias("hashed"), F.col("url").isNotNull().alias("placed"), _digest(F.coalesce(F.concat(F.lit("s:"), F.col("hash")), own)).alias("h"), _digest(F.coalesce("url", own)).alias("u"), "slot", "at")
    return d.withColumn("t", F.when(F.col("placed") & F.col("slot").isNotNull(), _spot(F.col("slot"))).otherwise(_digest(own)))


def _spot(slot: Column) -> Column:
    return _digest(F.concat(F.hex("u"), F.lit(" "), slot))


def _around(rows: DataFrame, *values: str) -> DataFrame:
    """Rows of a download and slot under the keys of all slots that may be less than a day away."""
    slots = F.sequence(F.col("slot") - 2, F.col("slot") + 2)
    return rows.select(F.explode(F.transform(slots, _spot)).alias("t"), *values)


def _covered(d: DataFrame, hashes: DataFrame, urls: DataFrame, times: DataFrame) -> DataFrame:
    """``d`` with ``hit``: whether accepted hashes ``h``, downloads ``u`` or fetch times ``u, slot, at`` make a line a case, and ``known``: whether its download is known."""
    near = _around(times, "at").groupBy("t").agg(F.collect_set("at").alias("ats"))  # five at most: one a slot
    rows = d.join(hashes.distinct().withColumn("a", F.lit(True)), "h", "left").join(urls.distinct().withColumn("b", F.lit(True)), "u", "left").join(near, "t", "left")
    close = F.coalesce(F.exists("ats", lambda x: F.abs(F.col("at") - x) < DAY_US), F.lit(False))
    known = F.col("b").isNotNull()
    return rows.select(*d.columns, F.when(F.col("hashed"), F.col("a").isNotNull() | close).otherwise(known).alias("hit"), known.alias("known"))


def _settle(d: DataFrame) -> DataFrame:
    """Open lines with ``done``: true where no undecided earlier line can decide the fate of the line."""
    first_hash = d.groupBy("h").agg(F.min("record_no").alias("m_hash"))
    first_url = d.groupBy("u").agg(F.min("record_no").alias("m_url"))
    slots = d.filter("placed and slot is not null").groupBy("u", "slot").agg(F.min("record_no").alias("m"))
    near = _around(slots, "m").groupBy("t").agg(F.min("m").alias("m_near"))
    rows = d.join(first_hash, "h").join(first_url, "u").join(near, "t", "left")
    free = F.when(F.col("hashed"), F.coalesce(F.col("record_no") <= F.col("m_near"), F.lit(True))).otherwise(F.col("record_no") <= F.col("m_url"))
    return rows.select(*d.columns, ((F.col("record_no") <= F.col("m_hash")) & free).alias("done"))


def _hashes(d: DataFrame) -> DataFrame:
    return d.filter("hashed").select("h")


def _urls(d: DataFrame) -> DataFrame:
    return d.filter("placed").select("u")


def _times(d: DataFrame) -> DataFrame:
    return d.filter("placed and slot is not null").select("u", "slot", "at")


def near_sets(index: Index, batch: DataFrame, overlap: float) -> DataFrame:
    """``set, partner``: the hashes and downloads of a batch of ``lines`` that are nearly those of accepted lines."""
    prefixes = cut(index.prefixes(token_sets(batch), overlap))
    return index.probe(prefixes, overlap, index.buckets_of(prefixes, keyed(batch))[0])


def take(index: Index, batch: DataFrame) -> DataFrame:
    """Judge the ``lines`` of a new batch against the index, append what is accepted, and give the ``record_no`` of the cases."""
    prefixes = cut(index.prefixes(token_sets(batch), index.overlap))
    state = cut(keyed(batch))
    asked, seen = index.buckets_of(prefixes, state)
    met = cut(index.probe(prefixes, 1.0, asked).select("set").distinct())
    key = _digest(F.col("set"))  # of a hash or a download
    state = cut(_covered(state, met.filter("set like 's:%'").select(key.alias("h")), met.filter("set not like 's:%'").select(key.alias("u")), index.sightings(seen)))
    cases, accepted, open_lines = state.filter("hit").select("record_no"), None, state.filter("not hit").drop("hit")
    while not open_lines.isEmpty():
        settled = cut(_settle(open_lines))
        fresh, rest = settled.filter("done").drop("done"), settled.filter("not done").drop("done", "known")
        accepted = fresh if accepted is None else accepted.unionByName(fresh)
        if rest.isEmpty():
            break
        rest = cut(_covered(rest, _hashes(fresh), _urls(fresh), _times(fresh)))
        cases = cases.unionByName(rest.filter("hit").select("record_no"))
        open_lines = rest.filter("not hit").drop("hit")
    if accepted is not None:
        held = _hashes(accepted).select(F.col("h").alias("k")).unionByName(_urls(accepted).select(F.col("u").alias("k"))).distinct()
        index.append(prefixes.join(met, "set", "left_anti").join(held, _digest(F.col("set")) == F.col("k"), "left_semi"), accepted)
    return cases


@contextmanager
def _plans_for(spark: SparkSession, n: int) -> Iterator[None]:
    """Plans over ``n`` lines: those of small batches run as they are, since a batch has more kinds of stages than compiled code is kept for, and compiling them for each batch again fills the driver."""
    before = spark.conf.get(CODEGEN)
    try:
        if n < COMPILED:
            spark.conf.set(CODEGEN, "false")
        yield
    finally:
        spark.conf.set(CODEGEN, before)


def duplicates(records: DataFrame, path: str | None = None, buckets: int | None = None) -> DataFrame:
    """``record_no`` of the lines that bring nothing new, batch by batch in arrival order; the index is dropped unless ``path`` names a place for it."""
    spark = records.sparkSession
    parted, found, home = scratch(spark, "batches"), scratch(spark, "found"), path or scratch(spark, "index")
    no = F.coalesce("batch_no", F.lit(0)).alias("batch")
    records.select(no, "record_no", "sha256", "url", "n_bytes", "fetched_at").repartition("batch", F.pmod(F.xxhash64("record_no"), F.lit(PARTS))).write.partitionBy("batch").parquet(parted)
    stored = spark.read.schema("record_no long, sha256 string, url string, n_bytes long, fetched_at string, batch int").parquet(parted)
    sizes = {r.batch: r.n for r in stored.groupBy("batch").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per batch
    records.select("record_no").limit(0).write.parquet(found)
    index = None
    for b, n in sorted(sizes.items()):
        with _plans_for(spark, n):
            batch = cut(lines(stored.filter(F.col("batch") == b)))
            if index is None:
                index = Index.create(batch, home, buckets)
            take(index, batch).write.mode("append").parquet(found)
    discard(spark, parted)
    if path is None:
        discard(spark, home)
    return spark.read.schema("record_no long").parquet(found)


def p1_found(spark, root: str) -> DataFrame:
    return duplicates(table(spark, root, "records"))


QUERIES = {"p1_found": p1_found}
ORACLES: dict[str, str] = {}
