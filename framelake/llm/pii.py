r"""Personal data by bootstrapped contextual extraction.

Base entities (email, ip, card, phone) come from fixed patterns, leftmost and without overlap. They seed a
bootstrap over candidates: the runs of adjacent words that hold a digit or an @, without punctuation around them
(so numbers in groups and handles count, a word of letters only does not). The words before and after a candidate
are its lexical patterns; an instance is trusted as the best of its patterns, seeds fully. A pattern's confidence is the
trust in its distinct instances against what speaks against it: an instance that is not trusted counts UNSEEN, since
identifiers that no rule knows are what patterns are for, but 1 where it stands in COMMON patterns or more, as plain
numbers do. Patterns of CONFIDENCE with at least SUPPORT distinct trusted instances discover further identifiers, which
are reported as kind ``context``; turns go on until no pattern and no instance is added. Base entities always stay, and
no discovered span overlaps one.

Offsets count code points, ends are exclusive. Null and empty texts have no spans. Texts count whole; the work on
one text grows a little faster than its length (positions are summed in blocks). Rows that share a doc_id have each
the spans of its own text. Repeated rows give repeated rows and count as one instance; a null doc_id has base spans
only. Equal scores count alike; an empty table gives an empty table. Everything is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_key, write_table
from .decontaminate import small
from .graph import look_up

#: Fixed patterns of the base kinds, in order. Those with a run in front start only where the run does, or
#: where the last match ended, which finds the same and takes linear time; inner loops don't give back.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind to be looked for.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: A run of adjacent words that hold a digit or an @; starts only where a word does, so it takes linear time.
_WORD = r"[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
RUN = rf"(?<![^\x20\x09-\x0D]){_WORD}(?:\x20{_WORD})*+"
CONFIDENCE, SUPPORT = 0.6, 3
#: What an unseen instance counts against a pattern, and the patterns of a value that is common and counts in full.
UNSEEN, COMMON = 0.1, 20
SPANS = "array<struct<start:int,place:int,stop:int,kind:string,value:string>>"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def part(i: Column) -> Column:
        d = F.substring(digits, F.lit(1), n).substr(n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), part), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    if kind == "card":
        digits = _digits(x)
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(x)).between(9, 15)
    if kind == "ip":
        short = F.transform(F.split(x, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(short, lambda p: F.when(F.length(p) <= 3, F.coalesce(F.try_to_number(F.when(p == "", "0").otherwise(p), F.lit("999")), F.lit(0)) <= 255).otherwise(False))
    return F.lit(True)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def located(text: Column, pattern: str) -> Column:
    """All matches as array<struct<start, stop, value>>: pieces between matches and matches take turns.

    Positions are sums of lengths; they are summed in blocks of sqrt(n) matches and over the blocks, since the
    running state of an aggregate is copied at every step.
    """
    pairs = _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found, lambda p, v: F.struct(F.length(p).alias("gap"), F.length(v).alias("n"), v.alias("value"))))
    return _let(pairs, positions)


def positions(pairs: Column) -> Column:
    """Array of (gap, n, value) as (start, stop, value)."""
    none = F.array().cast("array<struct<start:int,stop:int,value:string>>")

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + x["gap"]
        one = F.struct(begin.alias("start"), (begin + x["n"]).alias("stop"), x["value"].alias("value"))
        return F.struct((begin + x["n"]).alias("at"), F.concat(state["out"], F.array(one)).alias("out"))

    def add(state: Column, block: Column) -> Column:
        moved = F.transform(block["out"], lambda x: F.struct((x["start"] + state["at"]).alias("start"), (x["stop"] + state["at"]).alias("stop"), x["value"].alias("value")))
        return F.struct((state["at"] + block["at"]).alias("at"), F.concat(state["out"], F.array(moved)).alias("out"))

    width = F.greatest(F.ceil(F.sqrt(F.size(pairs).cast("double"))).cast("int"), F.lit(1))
    block = lambda b: F.aggregate(F.slice(pairs, b * width + 1, width), F.struct(F.lit(0).alias("at"), none.alias("out")), step)
    blocks = F.transform(F.sequence(F.lit(0), width - 1), block)
    whole = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,stop:int,value:string>>>").alias("out")), add, lambda s: F.flatten(s["out"]))
    return F.when(F.size(pairs) > 0, whole).otherwise(none)


def _checker(kind: str) -> Callable[[Column], Column]:
    return lambda x: _valid(kind, x["value"])


def _named(spans: Column, place: int, kind: str) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(place).alias("place"), x["stop"].alias("stop"), F.lit(kind).alias("kind"), x["value"].alias("value")))


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")


def base_spans(text: Column) -> Column:
    """Valid base entities by start, then kind."""
    every = []
    none = F.array().cast(SPANS)
    for place, (kind, pattern) in enumerate(KINDS.items()):
        named = _named(F.filter(located(text, pattern), _checker(kind)), place, kind)
        needed = text.contains(NEEDS[kind]) if NEEDS[kind] else text.rlike("[0-9]")
        every.append(F.when(needed, named.cast(SPANS)).otherwise(none))
    return F.array_sort(F.concat(*every))


def _masked(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), "[0-9]", "0")


def _runs(text: Column) -> Column:
    """Candidates as array<struct<gap, n, value>>, value: struct of the run and the texts before and after it."""

    def parts(found: Column) -> Column:
        n = F.size(found)
        pieces = F.split(text, RUN, -1)
        shifted = F.concat(F.array(F.lit("")), found)
        return F.arrays_zip(found.alias("run"), F.slice(pieces, F.lit(1), n).alias("piece"), F.slice(shifted, F.lit(1), n).alias("before"), F.slice(pieces, F.lit(2), n).alias("next"), F.slice(F.concat(found, F.array(F.lit(""))), F.lit(2), n).alias("after"))

    return _let(F.regexp_extract_all(text, F.lit(RUN), F.lit(0)), parts)


def _occurrences(found: DataFrame) -> DataFrame:
    """Candidates, each with its patterns; seeds are those that hold a valid base entity."""
    # Outer explodes: else filters are inferred below them and the expressions are computed again.
    runs = found.select("doc_id", "key", _runs(F.col("text")).alias("runs"))
    placed = positions(F.transform("runs", lambda x: F.struct(F.length(x["piece"]).alias("gap"), F.length(x["run"]).alias("n"), x["run"].alias("value"))))
    rows = runs.select("doc_id", "key", F.explode_outer(F.arrays_zip(placed.alias("at"), F.col("runs").alias("r"))).alias("x")).where("x is not null")
    rows = rows.select("doc_id", "key", "x.at.start", "x.at.value", "x.r.piece", "x.r.before", "x.r.next", "x.r.after")
    lead = F.length("value") - F.length(F.regexp_replace("value", r"^[^\p{L}\p{N}+@]+", ""))
    rows = rows.withColumn("start", F.col("start") + lead).withColumn("value", F.regexp_replace("value", r"^[^\p{L}\p{N}+@]+|(?<=[\p{L}\p{N}])[^\p{L}\p{N}]++$", "")).where(F.col("value").rlike(r"[\p{L}\p{N}]"))
    head = _masked(F.concat("before", "piece"))
    two = F.regexp_extract(head, r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]++[\x20\x09-\x0D]++[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+)$", 1)
    last = F.regexp_extract(head, r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]++[\x20\x09-\x0D]*+)$", 1)
    tail = F.regexp_extract(_masked(F.concat("next", "after")), r"^([\x20\x09-\x0D]*+[^\x20\x09-\x0D]++)", 1)
    seed = F.size(base_spans(F.col("value"))) > 0
    context = rows.select("doc_id", "key", "start", (F.col("start") + F.length("value")).alias("stop"), "value", seed.alias("seed"), two.alias("b"), last.alias("l"), tail.alias("a"))
    patterns = F.array(F.when(F.col("b") != "", F.concat(F.lit("2|"), "b")), F.when((F.col("l") != "") & (F.trim("a") != ""), F.concat(F.lit("11|"), "l", F.lit("|"), "a")))
    return context.select("doc_id", "key", "start", "stop", "value", "seed", F.explode_outer(patterns).alias("pattern")).where("pattern is not null")


def find_personal_data(docs: DataFrame, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """doc_id, base and discovered (arrays of start, place, stop, kind, value) of every row of ``docs``."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = texts.select("doc_id", text_key(F.col("text")).alias("key"), "text", base_spans(F.col("text")).alias("base"))
    base = write_table(found.withColumn("text", F.when(F.col("doc_id").isNotNull() & F.col("text").rlike("[0-9@]"), F.col("text"))), "base")
    seen = write_table(_occurrences(base.where("text is not null").select("doc_id", "key", "text")), "occurrences")

    graph = write_table(seen.groupBy("pattern", "value").agg(F.max("seed").alias("seed")), "graph")
    trust = write_table(graph.groupBy("value").agg(F.max(F.col("seed").cast("double")).alias("trust"), (F.count("*") >= COMMON).alias("common")), "trust")
    links, before, good = graph.count(), None, None
    while True:
        known = look_up(graph, "value", trust.select("value", F.struct("trust", "common").alias("known")), links, "known").select("pattern", "known.*")
        sure = F.col("trust") >= confidence
        against = F.sum(F.when(sure, 0.0).when(F.col("common"), 1.0).otherwise(UNSEEN))
        scored = known.groupBy("pattern").agg(F.sum(F.when(sure, F.col("trust")).otherwise(0.0)).alias("for"), against.alias("against"), F.count_if(sure).alias("trusted"))
        scored = scored.where("trusted > 0").withColumn("confidence", F.col("for") / (F.col("for") + F.col("against")))
        good = write_table(scored.where((F.col("confidence") >= confidence) & (F.col("trusted") >= support)).select("pattern", "confidence"), "patterns")
        reached = graph.join(small(good, "pattern"), "pattern").groupBy("value").agg(F.max("confidence").alias("reached"))
        trust = write_table(trust.join(reached, "value", "left").select("value", F.greatest("trust", F.coalesce("reached", F.lit(0.0))).alias("trust"), "common"), "trust")
        now = (good.count(), trust.where(F.col("trust") >= confidence).count())
        if now == before:
            break
        before = now
    new = seen.where("not seed").join(small(good, "pattern"), "pattern").select("doc_id", "key", "start", "stop", "value").distinct()
    span = F.struct("start", F.lit(len(KINDS)).alias("place"), "stop", F.lit("context").alias("kind"), "value")
    more = new.groupBy("doc_id", "key").agg(F.sort_array(F.collect_list(span)).cast(SPANS).alias("discovered")).toDF("d", "k", "discovered")
    out = base.select("doc_id", "key", "base").join(more, (F.col("doc_id") == F.col("d")) & (F.col("key") == F.col("k")), "left")
    free = F.filter("discovered", lambda x: ~F.exists("base", lambda b: (b["start"] < x["stop"]) & (x["start"] < b["stop"])))
    return out.select("doc_id", "base", F.coalesce(free, F.array().cast(SPANS)).alias("discovered"))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, counts by kind, base_sha256, spans, n_context."""
    return found.select("doc_id", *map(_count, KINDS), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.array_sort(F.concat("base", "discovered"))).alias("spans"), F.size("discovered").cast("long").alias("n_context"))
