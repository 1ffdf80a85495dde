"""URL filters by a temporal list join.

List entries carry a date. For each list, scope and key an entry holds from its date until the next entry of
the same list, scope and key; an entry with action ``remove`` ends the one before it. A capture is tested
against the entries in force when it was fetched: all keys of its URL (path prefixes, host, parent domains)
are joined to the intervals that hold its fetch time. The most specific scope decides (prefix, then host,
then domain; longer keys first); within one key ``allow`` beats ``block``.

Entries of one date for the same key: ``allow`` beats ``block`` beats ``remove``; repeated entries count once. Keys
of one length and action that several lists name: the list whose name comes last in code point order decides.
A capture without match, with a null URL or null fetch time, or with a URL without host is ``keep`` with a
null key. Repeated captures give repeated rows. URLs of any length count whole; a URL has as
many keys as it has labels and path parts. Entries with a null date or key are ignored. Empty tables:
no captures give no rows, no entries give ``keep``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import own_name, write_table
from .graph import look_up

#: Bytes of a table that is broadcast at most, counted as its strings and 64 bytes a row.
BROADCAST = 32 << 20
#: Fixed ranks of scopes and actions.
SCOPES = {"prefix": 3, "host": 2, "domain": 1}
ACTIONS = {"allow": 2, "block": 1, "remove": 0}


def _rank(values: dict[str, int], column: str) -> Column:
    out = F.lit(None).cast("int")
    for k, v in values.items():
        out = F.when(F.col(column) == k, v).otherwise(out)
    return out


def host_of(url: Column) -> Column:
    """Lowered host without user and port; null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.when(host != "", host)


def validity(entries: DataFrame) -> DataFrame:
    """Intervals [valid_from, valid_to) of (list_name, scope, key, action); an open end is null."""
    known = entries.select("list_name", "scope", F.lower("key").alias("key"), "action", F.col("listed_at").cast("timestamp").alias("valid_from"))
    known = known.where(F.col("key").isNotNull() & F.col("valid_from").isNotNull()).withColumn("rank", _rank(ACTIONS, "action")).where("rank is not null")
    one = known.groupBy("list_name", "scope", "key", "valid_from").agg(F.max_by("action", "rank").alias("action"))
    order = Window.partitionBy("list_name", "scope", "key").orderBy("valid_from")
    return one.withColumn("valid_to", F.lead("valid_from").over(order)).where("action <> 'remove'")


def keys_of(url: Column) -> Column:
    """All (scope, key) under which a list may name the URL."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    prefixes = F.transform(parts, lambda _, i: F.struct(F.lit("prefix").alias("scope"), F.lower(F.concat_ws("/", F.array(host), F.slice(parts, F.lit(1), i + 1))).alias("key")))
    domains = F.transform(labels, lambda _, i: F.struct(F.lit("domain").alias("scope"), F.concat_ws(".", F.slice(labels, i + 1, F.size(labels))).alias("key")))
    return F.concat(prefixes, F.array(F.struct(F.lit("host").alias("scope"), host.alias("key"))), domains)


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """All columns of ``captures`` (url, fetched_at, ...) with decision, list_name, scope, key, valid_from.

    Clashing columns of ``captures`` keep their place and get ``_in`` added to their name (and underscores where that
    name is taken too).
    """
    added, names = ["decision", "list_name", "scope", "key", "valid_from"], []
    for c in captures.columns:
        names.append(own_name([*captures.columns, *added, *names], f"{c}_in") if c.lower() in added else c)
    own = captures.toDF(*names)
    # the same URL at the same time needs one look-up, however often it was captured
    asked = own.select(F.col("url").alias("url"), F.col("fetched_at").cast("timestamp").alias("at")).where(host_of(F.col("url")).isNotNull() & F.col("at").isNotNull()).distinct()
    probes = asked.select("url", "at", F.inline(keys_of(F.col("url"))))
    held = write_table(validity(entries).withColumnsRenamed({"scope": "s", "key": "k"}), "validity")
    during = (F.col("at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("at") < F.col("valid_to")))
    size = held.agg(F.sum(F.lit(64) + F.octet_length("k") + F.octet_length("list_name"))).first()[0] or 0
    if size <= BROADCAST:
        active = probes.join(F.broadcast(held), (F.col("scope") == F.col("s")) & (F.col("key") == F.col("k")) & during)
    else:
        # Each key brings its whole history; keys that very many captures have, such as a public suffix, are broadcast.
        sk = write_table(probes.withColumn("sk", F.concat("scope", F.lit("|"), "key")), "probes")
        history = held.groupBy(F.concat("s", F.lit("|"), "k").alias("sk")).agg(F.sort_array(F.collect_list(F.struct("list_name", "action", "valid_from", "valid_to"))).alias("history"))
        met = look_up(sk, "sk", write_table(history, "history"), sk.count(), "history")
        active = met.select("url", "at", "scope", "key", F.inline("history")).where(during)
    best = F.struct(_rank(SCOPES, "scope").alias("a"), F.length("key").alias("b"), _rank(ACTIONS, "action").alias("c"), "list_name", "action", "scope", "key", "valid_from")
    u, at, won = (own_name([*own.columns, *added], x) for x in ("u", "at", "best"))
    decided = active.groupBy("url", "at").agg(F.max(best).alias("best")).toDF(u, at, won)
    joined = own.join(decided, (F.col("url") == F.col(u)) & (F.col("fetched_at").cast("timestamp") == F.col(at)), "left")
    return joined.select(*own.columns, F.coalesce(f"{won}.action", F.lit("keep")).alias("decision"), *(F.col(f"{won}.{c}").alias(c) for c in added[1:]))
