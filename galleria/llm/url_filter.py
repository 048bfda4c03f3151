"""URL filters: a sort-merge range join of canonical host keys with a sorted sweep over nested rules. DataFrame-native.

A host is written with its labels reversed and each closed by a full stop ("www.example.net" -> "net.example.www."), so a
host and all its subdomains are one interval of keys, and intervals of two rules are nested or apart. Rules become events
(interval start, interval end). Rules and URLs are sorted together by key, and a running `last` carries, at every URL, the
stack of rules whose intervals are open there. Among them the longest rule (host and path; then by host) whose path the
URL's path starts with decides.

Scale: the URLs are not sorted as one table. They are dealt evenly to `chunks` sorted runs by a hash of their place
in the input, and the rules' events are in every run; so a host that a third of all rows share makes no run larger,
and each run is one streaming merge. A rule table of more than RULES_PER_RUN rules is first dealt by top-level label.

Defined results: null URL or one without "://" has an empty host and path, which no rule fits; ties in host and path keep
the rule that blocks; repeated rows are judged each; extra columns pass by; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import literal_rows

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rules that are dealt to every sorted run; a larger table is dealt by top-level label, so each run gets about as many.
RULES_PER_RUN = 100_000


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first "://" up to "/", "?", "#" or the end; then up to "?", "#" or the end."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def host_key(host: Column) -> Column:
    """Labels reversed, each closed by a full stop; an empty host has an empty key."""
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


def _stacks(rules: DataFrame) -> DataFrame:
    """(key, open): from this key on, the rules whose intervals are open, as an array of structs. rules: rule, host, path, verdict.

    Intervals of keys nest, so the stack at an event is every rule whose key is a prefix of the event's key (at a start:
    itself and its ancestors; at an end: the ancestors left)."""
    r = rules.select("rule", "path", "verdict", host_key(F.col("host")).alias("key"), (F.length("host") + F.length("path")).alias("len"), F.length("host").alias("host_len"))
    one = F.struct(F.col("len"), F.col("host_len"), F.col("verdict"), F.col("rule"), F.col("path"))
    hosts = r.groupBy("key").agg(F.collect_list(one).alias("own"))
    #: Ancestor keys of a key: its prefixes that end at a full stop.
    steps = F.expr(r"transform(sequence(1, size(split(key, '\\.', -1)) - 1), k -> concat(substring_index(key, '.', k), '.'))")
    up = hosts.select("key", F.explode(steps).alias("up"))
    full = up.join(hosts.select(F.col("key").alias("up"), "own"), "up").groupBy("key").agg(F.flatten(F.collect_list("own")).alias("open"))
    parents = (
        up.filter(F.col("up") != F.col("key")).join(hosts.select(F.col("key").alias("up"), "own"), "up")
        .groupBy("key").agg(F.flatten(F.collect_list("own")).alias("open"))
    )
    label = F.substring_index("key", ".", 1).alias("tld")
    starts = full.select(label, "key", F.lit(1).alias("kind"), F.length("key").alias("depth"), "open")
    # An interval ends before the first key that doesn't start with its own: the closing "." becomes "/", the next sign.
    ends = hosts.join(parents, "key", "left").select(
        label, F.concat(F.expr("left(key, length(key) - 1)"), F.lit("/")).alias("key"), F.lit(0).alias("kind"), (-F.length("key")).alias("depth"),
        F.coalesce("open", F.slice("own", 1, 0)).alias("open"),
    )
    return starts.unionByName(ends.select(*starts.columns))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", chunks: int | None = None) -> DataFrame:
    """id, host, path, rule, verdict per row of pages. rules: rule, host, path and verdict (allow or block)."""
    spark = pages.sparkSession
    chunks = chunks or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    host, path = split_url(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    # Rows are dealt in turn: monotonically_increasing_id counts rows of an input partition, whose files and order are fixed.
    parts = max(1, min(chunks, rules.count() // RULES_PER_RUN))
    salts = -(-chunks // parts)
    part = F.pmod(F.xxhash64("tld"), F.lit(parts)) * salts
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts))
    rows = rows.withColumn("salt", salt).withColumn("key", host_key(F.col("host"))).withColumn("tld", F.substring_index("key", ".", 1))
    probes = rows.select((part + F.col("salt")).cast("int").alias("chunk"), "key", F.lit(2).alias("kind"), F.lit(0).alias("depth"), id_col, "host", "path")
    events = _stacks(rules).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    events = events.withColumn("chunk", (part + F.col("salt")).cast("int")).drop("tld", "salt")
    both = probes.unionByName(events, allowMissingColumns=True)
    sweep = Window.partitionBy("chunk").orderBy("key", "kind", "depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = both.withColumn("open", F.last("open", ignorenulls=True).over(sweep)).filter(F.col("kind") == 2)
    fits = F.filter("open", lambda r: F.startswith(F.col("path"), r["path"]))
    best = F.array_max(fits)
    return swept.withColumn("best", best).select(
        id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )


def rule_table(spark, rules: list[tuple[str, str]]) -> DataFrame:
    """(verdict, "host/path") pairs as a rule table: the host ends at the first slash, which begins the path."""
    rows = [(r, r.partition("/")[0].lower(), "/" + r.partition("/")[2], v) for v, r in rules]
    return literal_rows(spark, rows, "rule: string, host: string, path: string, verdict: string")
