"""Fingerprints of documents by invertible Bloom lookup tables, in DataFrame functions only.

A text's keys are the distinct 64-bit hashes of its paragraph pieces. A piece is a run of words
within a line that ends with a word whose last character is one of ENDS, or with the
PIECE_WORDSth word. The letter among ENDS is there for texts without sentences: where a piece ends is then told by the words
too, not by their number alone, so an edit changes the pieces around it and leaves the others. A table has
three parts of equal size; a key is added to one cell of each: the cell's count goes up, and the
key and its check hash are XORed in. Two versions' tables of one size subtract cell by cell;
keys that both have cancel. Peeling then reads a key from any cell with a count of one whose
check fits, and takes it out of its other cells, until nothing is left: what was read are the
keys in which the texts differ, each with the side that has it.

The fingerprint shown is the smallest table. If the difference of two fingerprints does not peel,
larger sketches are tried: each version's keys are dealt among as many small tables as the
two versions' keys need (in two steps, so work stays near linear in the text), which are
subtracted one by one; a table that does not peel is made again with four times the cells, up to
MOST_BITS, and compared key by key if even that should fail. All the keys in which the versions
differ are recovered either way.
Likeness is shared keys over all keys: (a + b - d) / (a + b + d).

The next document is found without a global sort in one task: rows are dealt into ranges of
ids; the first row of a range is copied to the range before it. Cuts between ranges are ids of
the table: up to OUTER of them are on the driver, and within each of those ranges as many more
as its rows need are made in the cluster. Ranges are so as many as the rows ask for.

Defined results: a null text is empty; two texts without pieces are alike (1.0); rows of
one id follow each other by text, in one range; a row whose id is null, or no whole number, has no
next document but itself; neither has a single row. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ENDS, PIECE_WORDS = ".!?k", 24
_WORD, _SPACE = r"\S++", r"[^\S\n]*+"
PIECE = rf"(?:{_WORD}(?<![{ENDS}]){_SPACE}){{0,{PIECE_WORDS - 1}}}+{_WORD}{_SPACE}|(?:{_WORD}{_SPACE}){{1,{PIECE_WORDS - 1}}}+"
BITS, MOST_BITS = 3, 9  # a table is three parts of 2^BITS cells
PER_TABLE = 8  # keys of both versions for each small table
ROUNDS = 8
ROWS_PER_RANGE, OUTER, INNER = 500, 1024, 4096
DIFFERENCE = "array<struct<k: bigint, c: int>>"


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def keys(text: Column) -> Column:
    """The distinct piece hashes of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), lambda p: F.xxhash64(F.rtrim(p))))


def _check(key: Column) -> Column:
    return F.xxhash64(key).bitwiseAND(F.lit(0xFFFFFFFF))


def _last_cell(bits: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), bits) - 1


def _slots(key: Column, bits: Column) -> list[Column]:
    """The cell of a key within each of the three parts: other bits of the key for each part."""
    return [F.call_function("shiftrightunsigned", key, bits * p).bitwiseAND(_last_cell(bits)).alias(f"s{p}") for p in range(3)]


def table(own: Column, bits: Column | int = BITS, other: Column | None = None) -> Column:
    """The cells of a version's keys, three parts of 2^bits: three arrays of (count, key, check).

    With ``other``'s keys the table of theirs is subtracted as it is filled.
    """
    bits = F.lit(bits) if isinstance(bits, int) else bits
    keyed = lambda ks, sign: F.transform(ks, lambda k: F.struct(F.lit(sign).alias("c"), k.alias("k"), _check(k).alias("h"), *_slots(k, bits)))

    def cells(entries: Column) -> Column:
        def part(p: int) -> Column:
            def cell(at: Column) -> Column:
                here = F.filter(entries, lambda x: x[f"s{p}"] == at)
                empty = F.struct(F.lit(0).alias("c"), F.lit(0).cast("bigint").alias("k"), F.lit(0).cast("bigint").alias("h"))
                return F.aggregate(here, empty, lambda s, x: F.struct((s["c"] + x["c"]).alias("c"), s["k"].bitwiseXOR(x["k"]).alias("k"), s["h"].bitwiseXOR(x["h"]).alias("h")))

            return F.transform(F.sequence(F.lit(0).cast("bigint"), _last_cell(bits)), cell)

        return F.struct(*(part(p).alias(f"p{p}") for p in range(3)))

    return _bound(keyed(own, 1) if other is None else F.concat(keyed(own, 1), keyed(other, -1)), cells)


def subtract(a: Column, b: Column) -> Column:
    less = lambda x, y: F.struct((x["c"] - y["c"]).alias("c"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["h"].bitwiseXOR(y["h"]).alias("h"))
    return F.struct(*(F.zip_with(a[f"p{p}"], b[f"p{p}"], less).alias(f"p{p}") for p in range(3)))


def peeled(cells: Column, bits: Column | int = BITS, rounds: int = ROUNDS) -> Column:
    """The keys that a difference of tables holds, with 1 (first version's) or -1; null if it does not peel."""
    bits = F.lit(bits) if isinstance(bits, int) else bits

    def pure(state: Column) -> Column:
        alone = F.filter(F.concat(*(state[f"p{p}"] for p in range(3))), lambda c: (F.abs(c["c"]) == 1) & (c["h"] == _check(c["k"])))
        return F.transform(F.array_distinct(alone), lambda c: F.struct(c["c"].alias("c"), c["k"].alias("k"), c["h"].alias("h"), *_slots(c["k"], bits)))

    def step(state: Column, _: Column) -> Column:
        def taken(found: Column) -> Column:
            def part(p: int) -> Column:
                def cell(c: Column, at: Column) -> Column:
                    mine = F.filter(found, lambda f: f[f"s{p}"] == at)
                    return F.aggregate(mine, c, lambda s, f: F.struct((s["c"] - f["c"]).alias("c"), s["k"].bitwiseXOR(f["k"]).alias("k"), s["h"].bitwiseXOR(f["h"]).alias("h")))

                return F.transform(state[f"p{p}"], cell)

            got = F.concat(state["got"], F.transform(found, lambda f: F.struct(f["k"].alias("k"), f["c"].alias("c"))))
            return F.struct(*(part(p).alias(f"p{p}") for p in range(3)), got.alias("got"), F.lit(False).alias("stuck"))

        stuck = F.struct(*(state[n].alias(n) for n in ("p0", "p1", "p2", "got")), F.lit(True).alias("stuck"))
        return F.when(state["stuck"], state).otherwise(_bound(pure(state), lambda found: F.when(F.size(found) == 0, stuck).otherwise(taken(found))))

    start = F.struct(*(cells[f"p{p}"].alias(f"p{p}") for p in range(3)), F.array().cast(DIFFERENCE).alias("got"), F.lit(False).alias("stuck"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step)
    return _bound(end, lambda s: F.when(~F.exists(s["p0"], lambda c: (c["c"] != 0) | (c["k"] != 0)), s["got"]))


def dealt(own: Column, tables: Column) -> Column:
    """A version's keys in ``tables`` squared lists by their hash, in two steps."""
    each = F.sequence(F.lit(0).cast("bigint"), tables - 1)
    by = lambda ks, shift: F.transform(each, lambda at: F.filter(ks, lambda k: F.pmod(F.shiftrightunsigned(k, shift), tables) == at))
    return F.flatten(F.transform(by(own, 44), lambda ks: by(ks, 28)))


def _small(a: Column, b: Column) -> Column:
    """What two short key lists differ in, by tables of growing size."""
    left = lambda x, y, c: F.transform(F.array_except(x, y), lambda k: F.struct(k.alias("k"), F.lit(c).alias("c")))
    sizes = F.array(*map(F.lit, range(BITS, MOST_BITS + 1, 2)))
    grown = F.aggregate(sizes, F.lit(None).cast(DIFFERENCE), lambda found, bits: F.coalesce(found, peeled(table(a, bits, b), bits)))
    # Tables of equal lists cancel in every cell.
    return F.when(a == b, F.array().cast(DIFFERENCE)).otherwise(F.coalesce(grown, F.concat(left(a, b, 1), left(b, a, -1))))


def difference(a: Column, b: Column, table_a: Column | None = None, table_b: Column | None = None) -> Column:
    """The keys in which two versions differ, each with 1 (only the first has it) or -1.

    From the fingerprints where they are given and peel, else from larger sketches.
    """
    side = F.greatest(F.lit(1.0), F.ceil(F.pow((F.size(a) + F.size(b)) / F.lit(float(PER_TABLE)), F.lit(0.5)))).cast("bigint")
    larger = _bound(side, lambda s: F.flatten(F.zip_with(dealt(a, s), dealt(b, s), _small)))
    if table_a is None:
        return larger
    # A table cannot give more keys than it has cells.
    few = F.abs(F.size(a) - F.size(b)) <= 3 << BITS
    return F.coalesce(F.when(few, peeled(subtract(table_a, table_b))), larger)


def recovered(found: Column) -> Column:
    """A difference as two arrays of digests: those only the first version has, and only the second."""
    side = lambda c: F.transform(F.filter(found, lambda x: x["c"] == c), lambda x: x["k"])
    return F.struct(side(1).alias("first"), side(-1).alias("second"))


def likeness(a: Column, b: Column, d: Column) -> Column:
    """Shared keys over all keys of two versions of ``a`` and ``b`` keys that differ in ``d``."""
    return F.when(a + b + d == 0, F.lit(1.0)).otherwise((a + b - d) / (a + b + d).cast("double"))


def shown(n_chars: Column, cells: Column) -> Column:
    """A table as text: the length, then each cell's count, key and check in hex."""
    every = F.concat(*(cells[f"p{p}"] for p in range(3)))
    return F.concat_ws(":", n_chars.cast("string"), F.array_join(F.transform(every, lambda c: F.concat(F.hex(c["c"]), F.lit("."), F.hex(c["k"]), F.lit("."), F.hex(c["h"]))), "-"))


def _upto(cuts: Column, id_col: str) -> Column:
    """The place of the last of ascending ``cuts`` that is not above the id, 0 at least; two short steps for a long list."""
    side = F.ceil(F.sqrt(F.size(cuts).cast("double"))).cast("int")
    last = lambda xs: F.greatest(F.size(F.filter(xs, lambda c: c <= F.col(id_col))) - 1, F.lit(0))
    heads = lambda s: F.transform(F.sequence(F.lit(1), F.size(cuts), s), lambda i: F.element_at(cuts, i))
    return _bound(side, lambda s: _bound(last(heads(s)), lambda i: i * s + last(F.slice(cuts, i * s + 1, s))))


def with_next(docs: DataFrame, id_col: str, columns: list[str], rows_per_range: int = ROWS_PER_RANGE, most_outer: int = OUTER) -> DataFrame:
    """``docs`` with next_<column> for each of ``columns``: that of the row with the next id."""
    size = docs.agg(F.count(id_col).alias("n"), F.min(id_col).alias("low")).first()
    outer = max(1, min(most_outer, -(-size.n // rows_per_range)))
    inner = max(1, min(INNER, -(-size.n // (outer * rows_per_range))))
    shares = lambda n: [i / n for i in range(n)]
    found = docs.agg(F.percentile_approx(id_col, shares(outer), max(10_000, 20 * outer)).alias("cuts")).first().cuts
    bounds = sorted({size.low, *(found or [])} - {None}) or [0]
    docs = docs.withColumn("_outer", F.when(F.col(id_col).isNotNull(), _upto(F.array(*(F.lit(b).cast("bigint") for b in bounds)), id_col)))
    if inner > 1:
        # INNER cuts in each of most_outer ranges are 32 MB at most.
        cuts = docs.filter("_outer is not null").groupBy("_outer").agg(F.array_sort(F.array_distinct(F.concat(F.array(F.min(id_col)), F.percentile_approx(id_col, shares(inner), 20 * inner)))).alias("_cuts"))
        before = Window.orderBy("_outer")  # most_outer rows in all
        cuts = cuts.withColumn("_behind", F.coalesce(F.lag(F.size("_cuts")).over(before), F.last(F.size("_cuts")).over(before.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
        docs = docs.join(F.broadcast(cuts), "_outer", "left")
    else:
        docs = docs.withColumns({"_cuts": F.element_at(F.array(*(F.array(F.lit(b).cast("bigint")) for b in bounds)), F.col("_outer") + 1), "_behind": F.lit(1)})
    docs = docs.withColumn("_inner", F.when(F.col("_outer").isNotNull(), _upto(F.col("_cuts"), id_col)))
    at = lambda o, i, copy: F.struct(o.cast("int").alias("outer"), i.cast("int").alias("inner"), F.lit(copy).alias("copy"))
    spread = F.pmod(F.xxhash64(*columns[:1]), F.lit(max(1, outer)))  # rows without an id meet no other
    own = F.when(F.col("_outer").isNull(), at(F.lit(-1), spread, False)).otherwise(at(F.col("_outer"), F.col("_inner"), False))
    last = F.col("_inner") == 0
    before = at(F.when(last, F.pmod(F.col("_outer") - 1, F.lit(len(bounds)))).otherwise(F.col("_outer")), F.when(last, F.col("_behind") - 1).otherwise(F.col("_inner") - 1), True)
    first = F.coalesce(F.element_at("_cuts", F.col("_inner") + 1) == F.col(id_col), F.lit(False))
    docs = docs.withColumn("_at", F.explode(F.when(first, F.array(own, before)).otherwise(F.array(own))))
    docs = docs.select(id_col, *columns, F.col("_at.outer").alias("_outer"), F.col("_at.inner").alias("_inner"), F.col("_at.copy").alias("_copy"))
    order = Window.partitionBy("_outer", "_inner").orderBy("_copy", id_col, *columns[:1])
    out = docs.withColumn("_next", F.when(F.col("_outer") >= 0, F.lead(F.struct(*columns)).over(order))).filter(~F.col("_copy"))
    return out.select(id_col, *columns, *(F.when(F.col("_next").isNotNull(), F.col(f"_next.{c}")).otherwise(F.col(c)).alias(f"next_{c}") for c in columns))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and how many
    digests the recovered difference to the edited text has that only the text (pieces_lost) or only the edited one has (pieces_gained).

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many
    of the next document.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("keys", keys(F.col("text")))
    rows = with_next(texts.withColumn("cells", table(F.col("keys"))), "id", ["text", "keys", "cells"])  # a text's own table is made once
    rows = rows.withColumn("n_chars", F.char_length("text").cast("bigint")).withColumn("half", F.floor(F.col("n_chars") / 2).cast("int"))
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - F.col("half")).cast("int")), F.substring("next_text", F.lit(1), F.col("half")))
    rows = rows.withColumn("edited", edited).select("id", "n_chars", "keys", "cells", "next_keys", "next_cells", F.char_length("edited").alias("edited_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), keys(F.col("edited")).alias("edited_keys"))
    rows = rows.withColumn("edited_cells", table(F.col("edited_keys")))
    others = F.array(*(F.struct(F.col(f"{v}_keys").alias("keys"), F.col(f"{v}_cells").alias("cells")) for v in ("edited", "next")))
    found = F.transform(others, lambda x: difference(F.col("keys"), x["keys"], F.col("cells"), x["cells"]))
    rows = rows.select("id", "n_chars", "edited_chars", "edited_sha256", "cells", "edited_cells", *(F.size(f"{v}keys").alias(f"{v}n") for v in ("", "edited_", "next_")), found.alias("found"))
    side = lambda c: F.size(F.filter(F.element_at("found", 1), lambda x: x["c"] == c)).cast("bigint")
    return rows.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256",
        shown(F.col("n_chars"), F.col("cells")).alias("fingerprint"),
        shown(F.col("edited_chars"), F.col("edited_cells")).alias("edited_fingerprint"),
        likeness(F.col("n"), F.col("edited_n"), F.size(F.element_at("found", 1))).alias("near_edited"),
        likeness(F.col("n"), F.col("next_n"), F.size(F.element_at("found", 2))).alias("near_next"),
        side(1).alias("pieces_lost"),
        side(-1).alias("pieces_gained"),
    )
