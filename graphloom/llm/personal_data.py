"""Personal data by bootstrapped contextual extraction, in DataFrame functions alone.

Base spans come from four forms (email, ip, card, phone), leftmost and non-overlapping per
kind; a match that fails its test (parts, digits, Luhn) is dropped without another try.
They, and values of the form of a key (long hexadecimal), are the seeds.

Seeds induce lexical patterns: the one, two or three words before a value, with the marks
between them (`token = "`, `mail: `, `call me at `), and the word before with the word behind
it (`call _ today`).  Spark counts what
else stands in the place of each pattern that has enough distinct seeds, in one pass over all
texts, and scores the graph of patterns and instances (values) in rounds: a pattern is as sure
as the share of its distinct values that are believed, an instance outside the seeds as sure as
the patterns that it stands in make it.  Only what stands in the place of a sure pattern is
added; a lone value is not, whatever its form.

A pattern takes part if seeds stand in START of its places.  Of those that do not, a sample of an
eighth of the documents shows most beforehand: what a sample counts is never more than there is.
The others are a table that the contexts of
all texts are joined to by hash, in one pass at any number of patterns; a map of BITS bits rules
out most contexts before the join decides.  The tables that go round have a row for each distinct pattern and
value; what a third of all rows share is summed before it is shuffled.

Null texts are empty; empty texts have no spans; repeated rows and null ids are documents
like others; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.session import stage

KINDS = ("email", "ip", "card", "phone")
#: Distinct seeds of a pattern, least score of a pattern, rounds; least share of seeds in a pattern's places.
SUPPORT, SURE, ROUNDS, START = 5, 0.7, 3, 0.1
#: Documents of the sample that rules common words out, at least, and its share of all; bits of a map of hashes; characters around a seed that are looked at first (where its contexts go on beyond, all are).
SAMPLE, SHARE, BITS, AROUND = 5_000, 1 / 8, 1 << 20, 240

# The same matches as the plain forms, for any length of text: possessive, as nothing that
# follows could use what they give back, and tried once for a run of characters, as a run
# that fails at its start fails everywhere (a match may start where the last one ended).
_LOCAL = r"A-Za-z0-9._%+-"
FORMS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What is between words, a word with what follows it, and a value of the form of a key.
_MARKS = r"\s:=#\x22'<>(){}\[\],;"
ELEMENT = rf"[^{_MARKS}]++[{_MARKS}]*+"
KEY = r"(?=[0-9]*[a-fA-F])(?=[a-fA-F]*[0-9])[0-9a-fA-F]{32,64}"
KEYS = rf"(?<![^{_MARKS}]){KEY}(?=[.!?]*(?:[{_MARKS}]|\z))"

SPAN = "struct<kind:string,start:int,end:int>"


def running(sizes: Column, join=lambda a, b: a + b) -> Column:
    """Sums (or another `join` from 0 on) of all before each, of an array of ints: blocks, then inside of each block."""
    side = 256
    empty = F.array().cast("array<int>")

    def sums(a):
        return F.aggregate(a, F.struct(empty.alias("a"), F.lit(0).alias("n")), lambda s, x: F.struct(F.concat(s["a"], F.array(s["n"])).alias("a"), join(s["n"], x).alias("n")))["a"]

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / side).cast("int")), lambda b: F.slice(sizes, b * side + 1, side))
    starts = sums(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), join)))
    return F.when(F.size(sizes) > 0, F.flatten(F.zip_with(blocks, starts, lambda b, at: F.transform(sums(b), lambda x: join(x, at))))).otherwise(empty)


def matches(text: Column, form: str, needs: str | None = None) -> Column:
    """Array of (match, start, end) of a form in the order of the text; `needs` is a string that every match has."""
    found = F.regexp_extract_all(text, F.lit(form), F.lit(0))
    between = F.split(text, form, -1)
    starts = running(F.zip_with(F.slice(between, 1, F.size(found)), F.concat(F.array(F.lit("")), F.slice(found, 1, F.greatest(F.size(found) - 1, F.lit(0)))), lambda gap, before: F.length(gap) + F.length(before)))
    # starts[i] has the gaps and matches before gap i: add gap i and match i - 1
    gaps = F.zip_with(F.slice(between, 1, F.size(found)), F.concat(F.array(F.lit("")), F.slice(found, 1, F.greatest(F.size(found) - 1, F.lit(0)))), lambda gap, before: F.length(gap) + F.length(before))
    at = F.zip_with(starts, gaps, lambda s, g: s + g)
    spans = F.zip_with(found, at, lambda m, s: F.struct(m.alias("match"), s.alias("start"), (s + F.length(m)).alias("end")))
    none = F.array().cast("array<struct<match:string,start:int,end:int>>")
    has = F.regexp_count(text, F.lit(form)) > 0 if needs is None else F.contains(text, F.lit(needs))
    return F.when(has, F.when(F.size(found) > 0, spans).otherwise(none)).otherwise(none)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)
    doubled = F.lit("0246813579")

    def add(total, i):
        d = F.substring(back, i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(F.substring(doubled, d + 1, F.lit(1)).cast("int"))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _holds(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike(r"^([0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))
    n = F.length(_digits(m))
    if kind == "card":
        return F.when(n.between(13, 19), _luhn(_digits(m))).otherwise(False)
    return n.between(9, 15)


def base_spans(text: Column, kind: str) -> Column:
    needs = {"email": "@", "ip": ".", "card": None, "phone": "+"}[kind]
    kept = F.filter(matches(text, FORMS[kind], needs), lambda x: _holds(kind, x["match"]))
    return F.transform(kept, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))


def as_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _plain(element: Column) -> Column:
    # white space as one blank; where it is that already nothing is put together anew
    return F.lower(F.regexp_replace(element, r"\s{2,}|[^\S ]", " "))


def _patterns(before: Column, at: Column, after: Column) -> list[Column]:
    """The patterns of a value behind element `at` of `before` (an array of hashes of elements) and in front of element `after`."""
    one, two, three = F.get(before, at), F.get(before, at - 1), F.get(before, at - 2)
    return [
        F.when(one.isNotNull(), F.xxhash64(F.lit(1), one)),
        F.when(two.isNotNull(), F.xxhash64(F.lit(2), two, one)),
        F.when(three.isNotNull(), F.xxhash64(F.lit(3), three, two, one)),
        F.when(one.isNotNull() & after.isNotNull(), F.xxhash64(F.lit(4), one, after)),
    ]


def _let(value: Column, use) -> Column:
    """`use` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def seeds(text: Column, spans: Column) -> Column:
    """Array of (kind, value, word, patterns) of the spans that begin behind white space or a mark, or with the text."""
    elements = lambda t: F.regexp_extract_all(t, F.lit(ELEMENT), F.lit(0))
    follows = rf"\A[.!?]*[{_MARKS}]+({ELEMENT})"

    def last(x):
        # the first element may be cut: more than three have three whole ones
        near = elements(F.substring(text, F.greatest(x["start"] - AROUND + 1, F.lit(1)), F.least(x["start"], F.lit(AROUND))))
        whole = lambda e: F.when((x["start"] <= AROUND) | (F.size(e) > 3), e).otherwise(elements(F.substring(text, F.lit(1), x["start"])))
        return _let(_let(near, whole), lambda e: F.transform(F.slice(e, F.greatest(F.size(e) - 2, F.lit(1)), 3), lambda w: F.xxhash64(_plain(w))))

    def behind(x):
        def whole(back):
            # the window shows it whole, unless it cuts a match or what comes before one
            inside = (F.length(back) < AROUND) | F.length(F.regexp_extract(back, follows, 0)).between(1, AROUND - 1) | ~back.rlike(rf"\A[.!?]*[{_MARKS}]*\z")
            return F.when(inside, back).otherwise(F.substring(text, x["end"] + 1, F.length(text)))

        after = _let(F.substring(text, x["end"] + 1, F.lit(AROUND)), lambda back: F.regexp_extract(whole(back), follows, 1))
        return _let(after, lambda e: F.when(e != "", F.xxhash64(_plain(e))))

    starts = lambda x: (x["start"] == 0) | F.substring(text, x["start"], F.lit(1)).rlike(rf"[{_MARKS}]")
    around = lambda x: F.struct(x["kind"].alias("kind"), F.substring(text, x["start"] + 1, x["end"] - x["start"]).alias("value"), last(x).alias("last"), behind(x).alias("after"))
    found = F.transform(F.filter(spans, starts), around)
    return F.transform(found, lambda x: F.struct(x["kind"], x["value"], F.get(x["last"], F.size(x["last"]) - 1).alias("word"), F.array(*_patterns(x["last"], F.size(x["last"]) - 1, x["after"])).alias("patterns")))


def extract(docs: DataFrame) -> DataFrame:
    """key (of id and text), doc_id, base (array of spans by kind), seeds: a row for each row, without its text."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    for kind in KINDS:
        rows = rows.withColumn(kind, base_spans(F.col("text"), kind))
    rows = rows.select("doc_id", "text", F.concat(*KINDS).alias("base"))
    keys = F.when(F.col("text").rlike("[0-9a-fA-F]{32}"), F.transform(matches(F.col("text"), KEYS), lambda x: F.struct(F.lit("key").alias("kind"), x["start"].alias("start"), x["end"].alias("end"))))
    rows = rows.withColumn("keys", F.coalesce(keys, F.array().cast(f"array<{SPAN}>")))
    return rows.select(row_key().alias("key"), "doc_id", "base", seeds(F.col("text"), F.concat("base", "keys")).alias("seeds"))


def _hashed(docs: DataFrame) -> DataFrame:
    """key, text and h: hashes of the elements of each text, as `_plain` has them (white space and case change no bounds of elements)."""
    rows = docs.select(row_key().alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumn("h", F.transform(F.regexp_extract_all(_plain(F.col("text")), F.lit(ELEMENT), F.lit(0)), lambda e: F.xxhash64(e)))


def _bitmap(hashes: DataFrame, bits: int) -> Column:
    """The bits that the hashes (the only column) set, as a literal of bits / 64 numbers whatever their count."""
    bit = hashes.toDF("h").select(F.col("h").bitwiseAND(F.lit(bits - 1)).alias("bit"))
    words = bit.groupBy(F.shiftright("bit", 6).alias("slot")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("w")).collect()
    full = [0] * (bits // 64)
    for r in words:
        full[r.slot] = r.w
    return F.split(F.lit(",".join(map(str, full))), ",").cast("array<bigint>")


def _maybe(bitmap: Column, h: Column, bits: int) -> Column:
    """False for most hashes that are not in the map."""
    bit = h.bitwiseAND(F.lit(bits - 1))
    return F.getbit(F.get(bitmap, F.shiftright(bit, 6).cast("int")), bit.bitwiseAND(F.lit(63)).cast("int")) == 1


def places(docs: DataFrame, wanted: DataFrame, bits: int = BITS) -> DataFrame:
    """key, pattern, value, start, end: what stands in the places of the patterns of `wanted` (pattern, word: the hash of its last one) in all texts."""
    h, e, text, at = F.col("h"), F.col("e"), F.col("text"), F.col("at")
    words, patterns = _bitmap(wanted.select("word"), bits), _bitmap(wanted.select("pattern"), bits)
    # a filter, or the one that Spark infers for explode, would be moved below all that it is made of, and that into the lambdas
    rows = _hashed(docs).withColumn("at", F.filter(F.transform("h", lambda x, i: F.when(_maybe(words, x, bits), i)), lambda i: i.isNotNull()))
    some_of = lambda i: F.filter(F.array(*_patterns(h, i, F.get(h, i + 2))), lambda p: _maybe(patterns, p, bits))
    found = F.filter(F.transform(at, lambda i: F.struct(i.alias("i"), F.when(i + 1 < F.size(h), some_of(i)).alias("patterns"))), lambda x: F.size(x["patterns"]) > 0)
    rows = rows.withColumn("hits", F.when(F.size(at) > 0, found))
    some = F.size("hits") > 0
    rows = rows.withColumn("e", F.when(some, F.regexp_extract_all(text, F.lit(ELEMENT), F.lit(0))))
    rows = rows.withColumn("starts", F.when(some, running(F.transform(e, lambda x: F.length(x))))).withColumn("lead", F.when(some, F.length(F.regexp_extract(text, rf"\A[{_MARKS}]*", 0))))

    def value(x):
        start = F.get(F.col("starts"), x["i"] + 1) + F.col("lead")
        quote = F.regexp_extract(F.get(e, x["i"]), r"[\x22']\z", 0)
        rest = F.when(quote != "", F.substring(text, start + 1, F.length(text))).otherwise("")
        quoted = F.when(quote == "'", F.regexp_extract(rest, r"\A[^'\r\n]++(?=')", 0)).otherwise(F.regexp_extract(rest, r"\A[^\x22\r\n]++(?=\x22)", 0))
        word = F.regexp_replace(F.get(e, x["i"] + 1), rf"[.!?]*[{_MARKS}]*\z", "")
        return F.struct(x["patterns"].alias("patterns"), start.alias("start"), F.when(quoted != "", quoted).otherwise(word).alias("value"))

    found = rows.select("key", F.explode_outer(F.transform("hits", value)).alias("v")).where("v is not null")
    found = found.select("key", F.explode("v.patterns").alias("pattern"), "v.value", "v.start", (F.col("v.start") + F.length("v.value")).alias("end"))
    return found.join(wanted.select("pattern").distinct(), "pattern", "left_semi").select("key", "pattern", "value", "start", "end")


def candidates(docs: DataFrame, found: DataFrame, support: int = SUPPORT) -> DataFrame:
    """pattern, word (its last one), value, kind, times: the seeds of patterns that have `support` distinct ones, as a table."""
    each = found.select(F.explode("seeds").alias("s")).select(F.posexplode("s.patterns").alias("level", "pattern"), "s.word", "s.value", "s.kind").where("pattern is not null")
    graph = stage(each.groupBy("level", "pattern", "word", F.xxhash64("value").alias("value")).agg(F.max("kind").alias("kind"), F.count("*").alias("times")), "seeds")
    enough = graph.groupBy("level", "pattern").agg(F.count("*").alias("n"), F.sum("times").alias("times")).where(F.col("n") >= support)
    # ruled out where a sample already has too many places of it
    share = min(1.0, max(SHARE, SAMPLE / max(1, found.count())))
    some = _hashed(docs.sample(share, seed=11) if share < 1 else docs)
    of = lambda i: F.array(*_patterns(F.col("h"), i, F.get("h", i + 2)))
    contexts = F.when(F.size("h") > 1, F.flatten(F.transform(F.sequence(F.lit(0), F.size("h") - 2), of)))
    each = some.select(F.explode_outer(contexts).alias("pattern")).where(_maybe(_bitmap(enough.select("pattern"), BITS), F.col("pattern"), BITS))
    common = each.groupBy("pattern").agg(F.count("*").alias("seen"))
    kept = enough.join(common, "pattern", "left").where(F.coalesce("seen", F.lit(0)) * START <= F.col("times")).select("pattern")
    return stage(graph.join(kept, "pattern", "left_semi").select("pattern", "word", "value", "kind", "times"), "candidates")


def row_key() -> Column:
    return F.sha2(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce("text", F.lit(""))), 256)


def discover(docs: DataFrame, found: DataFrame, support: int = SUPPORT, sure: float = SURE, rounds: int = ROUNDS, bits: int = BITS) -> DataFrame:
    """key, spans (array, by start): what stands in the places of sure patterns, outside of the base spans."""
    seeded = candidates(docs, found, support)
    here = stage(places(docs, seeded.select("pattern", "word").distinct(), bits), "places")
    inside = F.exists("base", lambda b: (b["start"] < F.col("end")) & (F.col("start") < b["end"]))
    taking = here.groupBy("pattern").agg(F.count("*").alias("n")).join(seeded.groupBy("pattern").agg(F.sum("times").alias("times")), "pattern").where(F.col("times") >= START * F.col("n")).select("pattern")
    taking = stage(taking, "taking")
    seeded = seeded.join(taking, "pattern", "left_semi").select("pattern", "value", "kind")
    here = here.join(taking, "pattern", "left_semi").where("value <> ''")
    outside = here.join(found.select("key", "base").dropDuplicates(["key"]), "key").where(~inside)
    form = F.when(F.col("value").rlike(rf"\A{KEY}\z"), "key")
    outside = stage(outside.select("key", "pattern", "start", "end", F.xxhash64("value").alias("value"), form.alias("kind")), "outside")
    edges = seeded.unionByName(outside.select("pattern", "value", "kind")).groupBy("pattern", "value").agg(F.max("kind").alias("seed"))
    edges = stage(edges, "graph")
    values = edges.groupBy("value").agg(F.max("seed").alias("seed")).withColumn("belief", F.when(F.col("seed").isNotNull(), 1.0).otherwise(0.0))
    # without values that are no seeds nothing changes behind the first round
    patterns, rounds = None, 1 if edges.where("seed is null").isEmpty() else rounds
    for i in range(rounds):
        scored = edges.select("pattern", "value").join(values, "value")
        patterns = scored.groupBy("pattern").agg(
            (F.sum("belief") / (F.count("*") + 0.5)).alias("score"), F.count("seed").alias("seeds")
        ).where((F.col("seeds") >= support) & (F.col("score") >= sure))
        patterns = stage(patterns, f"patterns-{i}")
        if i + 1 < rounds:
            doubt = edges.join(patterns, "pattern").groupBy("value").agg(F.sum(F.log(1 - F.least("score", F.lit(0.99)))).alias("doubt"))
            values = edges.groupBy("value").agg(F.max("seed").alias("seed")).join(doubt, "value", "left")
            values = stage(values.select("value", "seed", F.when(F.col("seed").isNotNull(), 1.0).otherwise(F.coalesce(1 - F.exp("doubt"), F.lit(0.0))).alias("belief")), f"values-{i}")
    # a pattern's kind is the one that most of its seeds have
    kinds = edges.where("seed is not null").groupBy("pattern", "seed").agg(F.count("*").alias("n")).groupBy("pattern").agg(F.max_by("seed", F.struct("n", "seed")).alias("kind"))
    named = patterns.join(kinds, "pattern").select("pattern", "score", F.col("kind").alias("named"))
    best = outside.join(named, "pattern").groupBy("key", "start", "end").agg(F.max_by("named", F.struct("score", "pattern")).alias("kind"))
    return best.groupBy("key").agg(_apart(F.array_sort(F.collect_list(F.struct("kind", "start", "end")), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))).alias("spans"))


def _apart(ordered: Column) -> Column:
    """Of spans by start those that do not overlap one before."""
    start = F.struct(F.array().cast(f"array<{SPAN}>").alias("a"), F.lit(0).alias("n"))
    put = lambda s, x: F.when(x["start"] >= s["n"], F.struct(F.concat(s["a"], F.array(x)).alias("a"), x["end"].alias("n"))).otherwise(s)
    return F.aggregate(ordered, start, put, lambda s: s["a"])


def find(docs: DataFrame) -> DataFrame:
    """key, doc_id, base and spans (arrays of kind, start, end) of each row; spans has all, those of
    the base first, and of the others those that do not overlap one before."""
    found = stage(extract(docs), "base-spans")
    more = discover(docs, found)
    # a few rows have more; a key stands for rows that are the same
    return found.select("key", "doc_id", "base").join(more, "key", "left").select("key", "doc_id", "base", F.concat("base", F.coalesce("spans", F.array().cast(f"array<{SPAN}>"))).alias("spans"))


def masked(text: Column, spans: Column) -> Column:
    """The text with each span, or spans that overlap, replaced by its kind in angle brackets."""
    ordered = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    # how far the spans before each one reach, and all of them: one that begins behind that begins a mark
    reach = running(F.concat(F.transform(ordered, lambda x: x["end"]), F.array(F.lit(0))), lambda a, b: F.greatest(a, b))
    apart = F.filter(F.zip_with(ordered, F.slice(reach, 1, F.size(ordered)), lambda x, n: F.struct(x.alias("x"), n.alias("n"))), lambda y: y["x"]["start"] >= y["n"])
    ends = F.concat(F.transform(apart, lambda y: y["n"]), F.array(F.element_at(reach, -1)))
    apart = F.transform(apart, lambda y: y["x"])
    begins = F.concat(F.transform(apart, lambda x: x["start"]), F.array(F.length(text)))
    gaps = F.zip_with(ends, begins, lambda e, b: F.substring(text, e + 1, F.greatest(b - e, F.lit(0))))
    marks = F.concat(F.transform(apart, lambda x: F.concat(F.lit("<"), F.upper(x["kind"]), F.lit(">"))), F.array(F.lit("")))
    return F.when(F.size(spans) == 0, text).otherwise(F.array_join(F.zip_with(gaps, marks, lambda g, m: F.concat(g, m)), ""))


def redact(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, with all their columns, and all spans of their texts masked."""
    spans = find(docs).select("key", "spans").dropDuplicates(["key"])
    keyed = docs.select(row_key().alias("key"), F.struct(*docs.columns).alias("row"))
    text = F.when(F.col("row.text").isNotNull(), masked(F.col("row.text"), F.col("spans")))
    return keyed.join(spans, "key").select(*((text if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns))
