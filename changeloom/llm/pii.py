r"""Personal data: fixed patterns plus bootstrapped contextual extraction, with
DataFrame functions only.

Base. Matches come from regexp_extract_all and the gaps between them from split
with the same expression; their running lengths are the spans, in code points.
The expressions are possessive and guarded at their left, so that one pass over
a text is linear; they find what the plain expressions find.

Bootstrapping. An instance is a word with a digit or an `@`. Its patterns are the
one, two and three words before it (digits as 0, with a letter at least), or the
key where it is joined to one (`key=value`). Seed instances lie on base spans or
are long hexadecimal secrets. Patterns and instance values form a graph: a
pattern's score is the mean score of the distinct values found behind it; a value
takes the best score of its patterns, and a seed has score 1. After a few rounds,
patterns of high score that several distinct seeds support yield new spans: the
identifier-like values behind them. Both sides are aggregated with map-side
combine and joined as written tables. Work on one text is in proportion to its
length: spans are built in blocks, and instances meet base spans in a window over
both in their order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from changeloom.llm.common import cut, texts

B = r"\x20\x09-\x0D"
#: Base kinds in order: name, expression, what a text must contain.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: A word with a digit or an at sign; a key joined to its value.
WORD = rf"(?<![^{B}])(?=[^{B}]*?[0-9@])[^{B}]++"
JOINED = r"^[^\p{L}\p{N}]*(\p{L}[\p{L}\p{N}_.-]*+(?:=|:(?!/)))[^\p{L}\p{N}]*[\p{L}\p{N}]"
CONTEXT, BLOCK = 3, 256
KINDS = ["email", "ip", "card", "phone", "id"]
SPAN = "array<struct<start:int,end:int,rank:int,said:string>>"


def _digits(said: Column) -> Column:
    return F.regexp_replace(said, "[^0-9]", "")


def _no_check(said: Column) -> Column:
    return F.lit(True)


def _ip_ok(said: Column) -> Column:
    part = lambda p: F.ltrim(p, F.lit("0"))
    return F.forall(F.split(said, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255))


def _card_ok(said: Column) -> Column:
    return F.length(_digits(said)).between(14, 19) & F.call_function("luhn_check", _digits(said))


def _phone_ok(said: Column) -> Column:
    return F.length(_digits(said)).between(10, 15)


BASE = [
    (EMAIL, lambda t: F.contains(t, F.lit("@")), _no_check),
    (IP, lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]"), _ip_ok),
    (CARD, lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"), _card_ok),
    (PHONE, lambda t: t.rlike(r"\+[0-9]"), _phone_ok),
]


def _found(df: DataFrame, out: str, rank: int, pattern: str, guard: Column) -> DataFrame:
    """Adds the array `out` of (start, end, rank, said) for the matches in text."""
    empty = F.array().cast("array<string>")
    df = df.withColumn("__m", F.when(guard, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(empty))
    df = df.withColumn("__g", F.when(F.size("__m") > 0, F.split("text", pattern, -1)).otherwise(empty))

    # An array that grows by one is copied each time, so blocks are built first.
    def step(acc: Column, i: Column) -> Column:
        start = acc["at"] + F.length(F.get("__g", i))
        end = start + F.length(F.get("__m", i))
        one = F.struct(start.alias("start"), end.alias("end"), F.lit(rank).alias("rank"), F.get("__m", i).alias("said"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    none, last = F.array().cast(SPAN), F.size("__m") - 1

    def block(acc: Column, b: Column) -> Column:
        inner = F.aggregate(F.sequence(b * BLOCK, F.least(b * BLOCK + BLOCK - 1, last)), F.struct(acc["at"].alias("at"), none.alias("out")), step)
        grown = lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], F.array(x["out"])).alias("out"))
        return F.get(F.transform(F.array(inner), grown), F.lit(0))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))
    blocks = F.aggregate(F.sequence(F.lit(0), F.floor(last / BLOCK).cast("int")), zero, block)["out"]
    spans = F.when(F.size("__m") > 0, F.flatten(blocks)).otherwise(none)
    return df.withColumn(out, spans)


def _passing(spans: str, valid: Callable[[Column], Column]) -> Column:
    return F.filter(spans, lambda s: valid(s["said"]))


def _base(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) with `base`, the valid base spans of all kinds."""
    df = docs
    for rank, (pattern, guard, valid) in enumerate(BASE):
        df = _found(df, f"__s{rank}", rank, pattern, guard(F.col("text")))
        df = df.withColumn(f"__s{rank}", _passing(f"__s{rank}", valid)).drop("__m", "__g")
    spans = F.array_sort(F.transform(F.concat(*(f"__s{k}" for k in range(len(BASE)))), lambda s: F.struct(s["start"], s["rank"], s["end"])))
    return df.withColumn("base", spans).drop(*(f"__s{k}" for k in range(len(BASE))))


def _with_instances(df: DataFrame) -> DataFrame:
    """Adds `instances`: patterns, value, start, end of each word with a digit or
    an at sign, without the quotes and other punctuation around it."""
    df = _found(df, "__words", 9, WORD, F.col("text").rlike("[0-9@]"))
    plain = lambda s: F.translate(F.lower(s), "123456789", "000000000")

    def one(word: Column, i: Column) -> Column:
        said = word["said"]
        key = F.regexp_extract(said, JOINED, 1)
        shift = F.when(key == "", 0).otherwise(F.length(F.regexp_extract(said, r"^[^\p{L}\p{N}]*", 0)) + F.length(key))
        rest = F.substring(said, shift + 1, F.length(said))
        value = F.regexp_extract(rest, r"[\p{L}\p{N}](?:.*[\p{L}\p{N}])?", 0)
        start = word["start"] + shift + F.length(F.regexp_extract(rest, r"^[^\p{L}\p{N}]*", 0))
        before = F.concat(F.coalesce(F.get("__m", i - 1), F.lit("")), F.get("__g", i))
        tail = F.regexp_extract(before, rf"(?:[^{B}]++[{B}]++){{0,{CONTEXT}}}$", 0)
        words = F.filter(F.split(plain(tail), rf"[{B}]+"), lambda w: w != "")
        runs = F.transform(F.sequence(F.lit(1), F.lit(CONTEXT)), lambda k: F.when(k <= F.size(words), F.array_join(F.slice(words, -k, k), " ")).otherwise(""))
        patterns = F.when(key != "", F.array(plain(key))).otherwise(F.filter(F.array_distinct(runs), lambda p: p.rlike(r"\p{L}")))
        return F.struct(patterns.alias("patterns"), value.alias("value"), start.alias("start"), (start + F.length(value)).alias("end"))

    return df.withColumn("instances", F.filter(F.transform("__words", one), lambda x: F.length(x["value"]) > 0)).drop("__m", "__g", "__words")


def _seeded(seen: DataFrame) -> DataFrame:
    """(doc_id, tid, patterns, value, start, end, on_base, seed): instances that
    have a pattern, and whether a base span overlaps them. In the order of base
    starts and instance ends, that is told by the largest base end so far."""
    held = seen.filter("doc_id IS NOT NULL AND size(instances) > 0")
    found = held.select("doc_id", "tid", F.inline("instances")).filter("size(patterns) > 0").distinct()
    base = held.select("doc_id", "tid", F.inline("base")).select("doc_id", "tid", F.col("start").alias("at"), F.lit(1).alias("turn"), F.col("end").alias("reach")).distinct()
    rows = found.withColumns({"at": F.col("end"), "turn": F.lit(0), "reach": F.lit(0)}).unionByName(base, allowMissingColumns=True)
    so_far = W.partitionBy("doc_id", "tid").orderBy("at", "turn").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("reach", F.max("reach").over(so_far)).filter("turn = 0").withColumn("on_base", F.col("reach") > F.col("start"))
    secret = F.col("value").rlike("^[0-9A-Fa-f]{32,}$") & F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Fa-f]")
    return rows.withColumn("seed", F.col("on_base") | secret).drop("at", "turn", "reach")


def _like(value: str) -> Column:
    return (F.length(F.regexp_replace(value, r"[^\p{L}\p{N}]", "")) >= 6) & F.col(value).rlike("[0-9]")


def _patterns(instances: DataFrame, rounds: int, min_score: float, min_support: int) -> DataFrame:
    """The patterns accepted after some rounds over the pattern-value graph."""
    links = instances.filter(F.col("seed") | _like("value")).select(F.explode("patterns").alias("pattern"), "value", "seed")
    links = links.groupBy("pattern", "value").agg(F.max("seed").alias("seed"))
    links = cut(links, "pattern-links")
    values = links.groupBy("value").agg(F.max(F.col("seed").cast("double")).alias("score"))
    for _ in range(rounds):
        scored = links.join(cut(values, "value-scores"), "value")
        patterns = scored.groupBy("pattern").agg(
            F.avg("score").alias("pattern_score"),
            F.sum(F.col("seed").cast("long")).alias("support"),
        )
        patterns = cut(patterns, "pattern-scores")
        sure = patterns.filter((F.col("pattern_score") >= min_score) & (F.col("support") >= min_support)).select("pattern", "pattern_score")
        told = links.join(sure, "pattern", "left")
        values = told.groupBy("value").agg(F.greatest(F.max(F.col("seed").cast("double")), F.coalesce(F.max("pattern_score"), F.lit(0.0))).alias("score"))
    return sure.select("pattern")


def find_pii(docs: DataFrame, rounds: int = 3, min_score: float = 0.6, min_support: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, base (array of start, rank, end by
    start and kind) and found (the same with the method's spans, rank 4, `id`).

    A value is identifier-like if it has six letters or digits, one digit at
    least. Spans the method finds on a base span are not added. Defined cases: a
    null or empty text has no spans; rows without doc_id get base spans alone;
    equal rows get equal spans; a very long text costs in proportion to its
    length; an empty table gives an empty one."""
    source = texts(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    seen = _with_instances(_base(source)).select("doc_id", F.xxhash64("text").alias("tid"), "base", "instances")
    seen = cut(seen, "pii")
    instances = cut(_seeded(seen), "instances")
    sure = cut(_patterns(instances, rounds, min_score, min_support), "patterns")
    new = (
        instances.filter(~F.col("on_base") & _like("value"))
        .select("doc_id", "tid", "start", "end", F.explode("patterns").alias("pattern"))
        .join(sure, "pattern", "left_semi")
        .groupBy("doc_id", "tid")
        .agg(F.collect_set(F.struct("start", F.lit(4).alias("rank"), "end")).alias("new"))
    )
    both = F.when(F.col("new").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "new")))
    return seen.join(new, ["doc_id", "tid"], "left").select("doc_id", "base", both.alias("found"))


def of_kind(spans: str, rank: int) -> Column:
    return F.filter(spans, lambda s: s["rank"] == rank)


def told(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ",")
