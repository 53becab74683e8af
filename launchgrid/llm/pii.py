"""Personal data in texts, in DataFrame functions and MLlib only.

Base spans come from four fixed patterns. High-recall generators propose more spans, which may
overlap those and each other: runs of digits with separators, numbers in the shape of a
local phone number, names joined to a host by an at sign in any spelling, four numbers joined by
dots in any spelling, and groups of digits with any separator. Boosted trees see each
candidate's format (digits, separators, groups, length, check sums) and context (the characters and
the hashed words around it).

What they learn from is made from the corpus itself. Right examples are its base spans, where they
stand, in other spellings: a phone number without its plus or with 00, an address with "(at)",
a network address with "[.]", a card number with dots between its groups. Wrong examples are
candidates whose form fails (no check sum, a part above 255, a host without a dot, a run of
digits that is no number to call), as they are and regrouped like the right ones, and base
spans broken in these ways. Candidates that touch a base span have no part in it; the rest, odd
spellings in the text itself, are what may be added.

Each kind has its own threshold, calibrated on held-out examples: the least score from which
PRECISION of them are right. Candidates that reach their kind's are added. The trees are fitted to at
most MOST_EXAMPLES examples of each kind and label, those of least hash; the calibration
counts all that are held out.

Offsets are code points. A pattern's matches and the text between them are taken apart by the
same expression, so positions are running sums of lengths, added up in blocks: a text's work
stays near linear in its matches.

Defined results: a null text is empty; rows are told apart by id and text, so repeated rows have
the same spans each; to a kind without right or wrong examples nothing is added. Other columns
are never read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from launchgrid.llm.storage import fresh, written

# The base patterns (the same matches as their plain forms: runs are taken
# whole, so a long run without a match is read once). \G allows a match right after another.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(BASE)

# The generators, and the kind that an added span of each is given.
NUMBER = r"\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,}+"
LOCAL = r"\(?(?<![0-9])[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"
AT_SIGN, DOT = r"\x20?(?:@|\(at\)|\[at\])\x20?", r"\x20?(?:\.|\(\.\)|\[\.\]|\(dot\)|\[dot\])\x20?"
AT = rf"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++{AT_SIGN}[A-Za-z0-9-]++(?:{DOT}[A-Za-z0-9-]++)*+"
FOUR = rf"(?<![0-9])[0-9]{{1,4}}(?:{DOT}[0-9]{{1,4}}){{3}}(?![0-9])"
GROUPS = r"(?<![0-9])[0-9]{2,7}(?:[\x20._/-]{1,2}[0-9]{1,7}){1,7}+(?![0-9])"
GENERATORS = {"number": NUMBER, "local": LOCAL, "at": AT, "four": FOUR, "groups": GROUPS}
KIND_OF = {"number": "phone", "local": "phone", "at": "email", "four": "ip", "groups": "card"}

# What lacks only a base span's sign: a plain address's form, and phone numbers without +.
ADDRESS = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+$"
UNSIGNED = rf"^(?:(?:00)?[0-9]{{1,3}}[\x20.-]{{1,2}})?{LOCAL}$|^00[1-9][0-9]*[\x20().-]"

MOST_EXAMPLES = 2_500
PRECISION = 0.98
TREES, DEPTH = 16, 4
CONTEXT, CONTEXT_WORDS = 24, 16
BLOCK, CELL = 256, 4096
SPAN = "struct<start: bigint, rank: int, end: bigint, kind: string>"
FOUND = "array<struct<start: bigint, end: bigint, m: string, before: string, after: string>>"
BASE_SPAN = "struct<start: bigint, rank: int, end: bigint, kind: string, m: string, before: string, after: string>"
CANDIDATE = "struct<gen: string, start: bigint, end: bigint, m: string, before: string, after: string>"


def running(lengths: Column) -> Column:
    """The sums of an array of numbers before each of them; blocks first, so no long array grows by one."""
    block = lambda b: F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK))

    def sums(values: Column, start: Column) -> Column:
        zero = F.struct(start.cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("all"))
        return F.aggregate(values, zero, lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all")), lambda s: s["all"])

    numbers = F.sequence(F.lit(0), F.ceil((F.size(lengths) - 1) / F.lit(float(BLOCK))).cast("int"))
    each = F.transform(numbers, lambda b: F.aggregate(block(b), F.lit(0).cast("bigint"), lambda s, x: s + x))
    return F.flatten(F.transform(sums(each, F.lit(0)), lambda start, b: sums(block(b), start)))


def matches(text: Column, pattern: str) -> Column:
    """(start, end, m, before, after) of each match, with the characters around it."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast(FOUND)

    def placed(hits: Column) -> Column:
        def each(parts: Column) -> Column:
            lengths = F.transform(hits, lambda m, i: F.struct(F.char_length(F.get(parts, i)).cast("bigint").alias("gap"), F.char_length(m).cast("bigint").alias("own")))

            def at(sizes: Column) -> Column:
                def add(before: Column) -> Column:
                    def one(m: Column, i: Column) -> Column:
                        start = F.get(before, i) + F.get(sizes, i)["gap"]
                        return F.struct(start.alias("start"), (start + F.get(sizes, i)["own"]).alias("end"), m.alias("m"), F.right(F.get(parts, i), F.lit(CONTEXT)).alias("before"), F.left(F.get(parts, i + 1), F.lit(CONTEXT)).alias("after"))

                    return F.transform(hits, one)

                return _bound(running(F.transform(sizes, lambda x: x["gap"] + x["own"])), add)

            return _bound(lengths, at)

        return F.when(F.size(hits) == 0, none).otherwise(_bound(F.split(text, pattern, -1), each))

    return _bound(found, placed)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def add(s: Column, i: Column) -> Column:
        d = F.substring(number, -i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return s + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.char_length(number)), F.lit(0), add) % 10 == 0


def octets(m: Column) -> Column:
    """Whether all four numbers are 255 at most; leading zeros don't count."""
    return F.forall(F.split(m, r"\.", -1), lambda p: _bound(F.regexp_replace(p, "^0+", ""), lambda n: (F.char_length(n) < 4) & (F.concat(F.lit("0"), F.left(n, F.lit(3))).cast("int") <= 255)))


def checked(m: Column) -> Column:
    """Whether the digits are as many as a card has and pass the Luhn check."""
    return F.when(F.char_length(digits(m)).between(12, 19), luhn(digits(m))).otherwise(F.lit(False))


def _valid(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return octets(m)
    return F.char_length(digits(m)).between(9, 15) if kind == "phone" else checked(m)


def base_spans(text: Column) -> Column:
    """The base spans, by start and then kind as listed, with their texts and what is around them."""

    def of(kind: str) -> Column:
        ok = F.filter(matches(text, BASE[kind]), lambda x: _valid(kind, x["m"]))
        return F.transform(ok, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"), *(x[c].alias(c) for c in ("m", "before", "after"))))

    need = {"email": F.contains(text, F.lit("@")), "ip": F.lit(True), "card": F.lit(True), "phone": F.contains(text, F.lit("+"))}
    none = F.array().cast(f"array<{BASE_SPAN}>")
    return F.array_sort(F.concat(*(F.when(need[k], of(k)).otherwise(none) for k in KINDS)))


def candidates(text: Column) -> Column:
    """The generators' spans with their context: an array of CANDIDATE."""

    def of(gen: str) -> Column:
        return F.transform(matches(text, GENERATORS[gen]), lambda x: F.struct(F.lit(gen).alias("gen"), *(x[c].alias(c) for c in ("start", "end", "m", "before", "after"))))

    none = F.array().cast(f"array<{CANDIDATE}>")
    at = F.when(F.contains(text, F.lit("@")) | F.contains(text, F.lit("(at)")) | F.contains(text, F.lit("[at]")), of("at")).otherwise(none)
    return F.concat(*(of(g) for g in GENERATORS if g != "at"), at)


def plain(m: Column) -> Column:
    """A span with its at and dot signs in their usual spelling."""
    return F.regexp_replace(F.regexp_replace(m, AT_SIGN, "@"), DOT, ".")


def possible(m: Column, gen: Column, before: Column, after: Column) -> Column:
    """Whether a candidate's form lets it be personal data."""
    number = m.rlike(UNSIGNED) & F.char_length(digits(m)).between(9, 15)
    local = ~before.rlike(r"[0-9]{2}[\x20.-]?$") & ~after.rlike("^[.-]?[0-9]")
    return F.when(gen == "at", plain(m).rlike(ADDRESS)).when(gen == "local", local).when(gen == "four", octets(plain(m))).when(gen == "groups", checked(m)).otherwise(number)


def features(m: Column, gen: Column, before: Column, after: Column) -> dict[str, Column]:
    """Numbers about a candidate's format and context."""
    flag = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    m = F.when(gen.isin("at", "four"), plain(m)).otherwise(m)
    count = lambda chars: (F.char_length(m) - F.char_length(F.regexp_replace(m, chars, ""))).cast("double")
    word = lambda text, pattern: F.pmod(F.xxhash64(F.lower(F.regexp_extract(text, pattern, 1))), F.lit(CONTEXT_WORDS))
    last, next_ = word(before, r"(\p{L}+)[^\p{L}]*$"), word(after, r"^[^\p{L}]*(\p{L}+)")
    return {
        **{f"is_{g}": flag(gen == g) for g in GENERATORS},
        "length": F.char_length(m).cast("double"),
        "digits": count("[0-9]"),
        "spaces": count(" "),
        "dots": count(r"\."),
        "dashes": count("-"),
        "parens": count("[()]"),
        "slashes": count("[/_]"),
        "groups": F.size(F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0))).cast("double"),
        "first_group": F.char_length(F.regexp_extract(m, "^[^0-9]*([0-9]+)", 1)).cast("double"),
        "last_group": F.char_length(F.regexp_extract(m, "([0-9]+)[^0-9]*$", 1)).cast("double"),
        "host_dot": flag(m.rlike(r"@.*\.")),
        "octets": flag(F.when(gen == "four", octets(m))),
        "check_sum": flag(checked(m)),
        "word_before": flag(before.rlike(r"[\p{L}0-9_]$")),
        "word_after": flag(after.rlike(r"^[\p{L}0-9_]")),
        "sign_before": flag(before.rlike(r"[=:#/.-]\s?$")),
        **{f"before_{k}": flag(last == k) for k in range(CONTEXT_WORDS)},
        **{f"after_{k}": flag(next_ == k) for k in range(CONTEXT_WORDS)},
    }


def _grouped(number: Column, size: int, sign: str) -> Column:
    return F.regexp_replace(number, f"([0-9]{{{size}}})(?=[0-9])", f"$1{sign}")


def respelt(kind: Column, m: Column) -> Column:
    """A base span in other spellings: an array of (gen, label, m), 1 right, 0 broken."""
    form = lambda gen, label, m: F.struct(F.lit(gen).alias("gen"), F.lit(label).alias("label"), m.alias("m"))
    name, host = F.regexp_extract(m, "^(.*)@", 1), F.regexp_extract(m, "@(.*)$", 1)
    short = F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)
    joined = lambda at, dot, host=host: F.concat(name, F.lit(at), F.replace(host, F.lit("."), F.lit(dot)))
    email = [form("at", 1.0, joined(*x, h)) for h in (host, short) for x in ((" (at) ", " (dot) "), ("[at]", "[dot]"), (" @ ", "."), (" (at) ", "."), ("(at)", "(dot)"))] + [form("at", 0.0, joined(at, "")) for at in (" (at) ", " @ ", "[at]", "@")]
    dotted = lambda m, sign: F.replace(m, F.lit("."), F.lit(sign))
    beyond = F.regexp_replace(m, "^[0-9]+", (F.regexp_extract(m, "^([0-9]+)", 1).cast("int") + 256).cast("string"))
    ip = [form("four", float(right), dotted(x, sign)) for right, x in ((True, m), (False, beyond)) for sign in ("[.]", "(.)", " . ", "(dot)", " [dot] ")]
    d = digits(m)
    wrong = F.concat(F.substring(d, F.lit(1), F.char_length(d) - 1), ((F.right(d, F.lit(1)).cast("int") + 1) % 10).cast("string"))
    card = [form("groups", 1.0, _grouped(d, 4, sign)) for sign in (".", "/", "_", "  ", " . ")] + [form("groups", 0.0, _grouped(wrong, 4, sign)) for sign in (".", "/", "-")] + [form("groups", 0.0, _grouped(d, 3, sign)) for sign in (".", " ")]
    unsigned = F.regexp_replace(m, r"^\+", "")
    local = F.regexp_replace(unsigned, r"^[0-9]+[\x20.-]+", "")
    bare = F.regexp_replace(local, r"[()]", "")
    phone = [form("number", 1.0, unsigned), form("number", 1.0, F.concat(F.lit("00"), unsigned)), form("local", 1.0, local), *(form("local", 1.0, F.regexp_replace(bare, r"[\x20.-]+", sign)) for sign in ("-", ".", " "))]
    made = F.when(kind == "email", F.array(*email)).when(kind == "ip", F.array(*ip)).when(kind == "card", F.array(*card)).otherwise(F.array(*phone))
    return F.filter(made, lambda x: (x["label"] == 0) | (x["gen"].isin("at", "four", "groups")) | F.when(x["gen"] == "local", x["m"].rlike(f"^{LOCAL}$")).otherwise(x["m"].rlike(UNSIGNED)))


def regrouped(m: Column, gen: Column) -> Column:
    """A wrong candidate as it is and, if a run of digits, in the groups that right ones have."""
    form = lambda gen, m: F.struct(gen.alias("gen"), F.lit(0.0).alias("label"), m.alias("m"))
    d = digits(m)
    cards = F.when(gen.isin("number", "groups") & F.char_length(d).between(12, 19) & ~checked(m), F.array(*(form(F.lit("groups"), _grouped(d, 4, sign)) for sign in (".", "-", " "))))
    phones = F.when(gen.isin("number", "groups") & (F.char_length(d) == 10), F.array(form(F.lit("local"), F.regexp_replace(d, "^(...)(...)", "$1-$2-"))))
    none = F.array().cast("array<struct<gen: string, label: double, m: string>>")
    return F.concat(F.array(form(gen, m)), F.coalesce(cards, none), F.coalesce(phones, none))


def _rows(found: DataFrame, column: str) -> DataFrame:
    """One row per distinct entry of an array column, with the row's key."""
    return found.filter(F.size(column) > 0).select("row", "same", F.explode(column).alias("x")).select("row", "same", "x.*").distinct()


def examples(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(examples, open candidates): row, same, start, gen, m, before, after, and the label of an example."""
    base, proposed = _rows(found, "base"), _rows(found, "candidates")
    cells = lambda df: df.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / CELL), F.floor((F.col("end") - 1) / CELL))))
    near = cells(base.select("row", "same", "start", "end")).withColumnsRenamed({"start": "s", "end": "e"})
    touched = cells(proposed.select("row", "same", "gen", "start", "end")).join(near, ["row", "same", "cell"]).filter("start < e and s < end").select("row", "same", "gen", "start", "end").distinct()
    apart = proposed.join(touched, ["row", "same", "gen", "start", "end"], "left_anti").withColumn("possible", possible(F.col("m"), F.col("gen"), F.col("before"), F.col("after")))
    apart = written(apart, "apart")
    keep = ("row", "same", "start", "before", "after")
    right = base.select(*keep, F.explode(respelt(F.col("kind"), F.col("m"))).alias("x"))
    wrong = apart.filter(~F.col("possible")).select(*keep, F.explode(regrouped(F.col("m"), F.col("gen"))).alias("x"))
    return right.unionByName(wrong).select(*keep, "x.*"), apart.filter("possible").drop("possible")


def _kind(gen: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in KIND_OF.items() for x in pair)), gen)


def _measured(rows: DataFrame) -> DataFrame:
    return rows.withColumns(features(F.col("m"), F.col("gen"), F.col("before"), F.col("after")))


def _names() -> list[str]:
    empty = F.lit("")
    return list(features(empty, empty, empty, empty))


def fit(known: DataFrame, most: int = MOST_EXAMPLES, precision: float = PRECISION):
    """(assembler, trees, threshold of each kind) from examples, or None without both labels.

    A span's spellings are all fitted to or all held out. Fitted are the ``most`` examples of the least hashes of each kind and label. They are
    counted first, and only those whose hash is under a bound that half as many again will pass are put in order, so what is
    ranked stays as small when examples grow; features are worked out for these alone.
    """
    span = F.xxhash64("row", "same", "start")
    known = written(known.withColumns({"kind": _kind(F.col("gen")), "span": span, "key": F.xxhash64(span, "gen", "m")}), "known")
    fitted = known.filter("span % 3 <> 0")
    counts = fitted.groupBy("kind", "label").count().collect()  # two a kind
    bounds = {(r.kind, r.label): min(2**63 - 1, int(1.5 * most / r["count"] * 2**63)) for r in counts}
    under = reduce(lambda seen, x: F.when((F.col("kind") == x[0][0]) & (F.col("label") == x[0][1]), F.lit(x[1])).otherwise(seen), bounds.items(), F.lit(-1))
    place = F.row_number().over(Window.partitionBy("kind", "label").orderBy("rank", "key", "m"))
    few = fitted.withColumn("rank", F.shiftrightunsigned("key", 1)).filter(F.col("rank") <= under)
    sample = written(_measured(few.withColumn("place", place).filter(F.col("place") <= most)), "examples")
    seen = sample.agg(F.count_if(F.col("label") == 1).alias("ones"), F.count_if(F.col("label") == 0).alias("zeros")).first()
    if not seen.ones or not seen.zeros:
        return None
    join = VectorAssembler(inputCols=_names(), outputCol="features")
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=1, featureSubsetStrategy="onethird").fit(join.transform(sample))
    tested = _scored(_measured(known.filter("span % 3 = 0")), join, trees).groupBy("kind", F.floor(F.col("p") * 50).alias("bin")).agg(F.sum("label").alias("right"), F.count("*").alias("all")).orderBy(F.desc("bin")).collect()
    bars = {kind: _threshold([t for t in tested if t.kind == kind], precision) for kind in KINDS}
    return join, trees, {kind: bar for kind, bar in bars.items() if bar is not None}


def _threshold(bins: list, precision: float) -> float | None:
    """The least score, 0.5 at least, from which ``precision`` of the examples are right; None if there is none.

    ``bins``: (bin, right, all) of fiftieths of the score that have examples, highest first.
    """
    right, every, bar = 0.0, 0, None
    for t, lower in zip(bins, [*(b.bin for b in bins[1:]), -1], strict=False):
        right, every = right + t.right, every + t["all"]
        if right and right >= precision * every:
            bar = (lower + 1) / 50
    return None if bar is None else max(bar, 0.5)


def _scored(rows: DataFrame, join: VectorAssembler, trees) -> DataFrame:
    return trees.transform(join.transform(rows)).withColumn("p", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def _added(found: DataFrame) -> DataFrame:
    """(row, same, more): the spans added to each row's base spans."""
    known, open_ = examples(found)
    model = fit(known)
    if model is None or not model[2]:
        return found.limit(0).select("row", "same", F.array().cast(f"array<{SPAN}>").alias("more"))
    join, trees, thresholds = model
    kind = _kind(F.col("gen"))
    bar = F.create_map(*(F.lit(x) for pair in thresholds.items() for x in pair))
    picked = _scored(_measured(open_), join, trees).withColumn("kind", kind).filter(F.col("p") >= F.try_element_at(bar, F.col("kind")))
    rank = F.array_position(F.array(*(F.lit(k) for k in KINDS)), F.col("kind")) - 1
    return picked.groupBy("row", "same").agg(F.collect_set(F.struct("start", rank.cast("int").alias("rank"), "end", "kind")).alias("more"))


def _text(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, same (hash of the text), base and spans (all), arrays of SPAN by start."""
    texts = docs.select(F.col(id_col).alias("id"), _text(text_col).alias("text")).withColumn("same", F.xxhash64("text"))
    found = written(texts.select("id", "same", F.xxhash64("id", "same").alias("row"), base_spans(F.col("text")).alias("base"), candidates(F.col("text")).alias("candidates")), "found")
    out = found.join(_added(found), ["row", "same"], "left")
    base = F.transform("base", lambda b: F.struct(*(b[c].alias(c) for c in ("start", "rank", "end", "kind"))))
    both = F.when(F.col("more").isNull(), base).otherwise(F.array_sort(F.concat(base, "more")))
    return out.select(F.col("id").alias(id_col), "same", base.alias("base"), both.alias("spans"))


def span_text(found: Column) -> Column:
    """kind:start:end joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(docs: DataFrame) -> DataFrame:
    """Per document: counts of the base kinds, the digest of base spans, and all spans."""

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return spans(docs).select("doc_id", *map(count, KINDS), F.sha2(span_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


def redacted(text: Column, found: Column) -> Column:
    """The text with every span, or run of overlapping spans, replaced by its kind in brackets."""

    def add(s: Column, x: Column) -> Column:
        fresh = x["start"] >= s["at"]
        between = F.substring(text, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int"))
        out = F.when(fresh, F.concat(s["out"], between, F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise(s["out"])
        return F.struct(out.alias("out"), F.greatest(s["at"], x["end"]).alias("at"))

    zero = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))
    done = F.aggregate(found, zero, add)
    return F.when(F.size(found) == 0, text).otherwise(_bound(done, lambda s: F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), F.char_length(text)))))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all spans replaced in the text column; a null text stays null."""
    key, same, hits = fresh(docs, "_key", "_same", "_hits")
    found = spans(docs, id_col, text_col).filter(F.size("spans") > 0)
    found = found.select(F.col(id_col).alias(key), F.col("same").alias(same), F.col("spans").alias(hits)).dropDuplicates([key, same])
    here = F.col(id_col).eqNullSafe(F.col(key)) & (F.xxhash64(_text(text_col)) == F.col(same))
    out = docs.join(found.hint("shuffle_hash"), here, "left")
    text = F.when(F.col(hits).isNull(), F.col(text_col)).otherwise(redacted(F.col(text_col), F.col(hits)))
    return out.withColumn(text_col, text).select(*docs.columns)
