"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

Method.  A text is cut into paragraphs by its content: at line ends, and from ``LEAST_CHARS`` characters on
after a sentence mark or a word with a certain last letter, in runs without spaces after certain characters, so that an
insertion moves only the cuts near it.  Each distinct paragraph has a 64-bit digest.  The digests' leading bits deal them over blocks of at
most ``BLOCK`` on average, and each block has a sketch of three sub-tables of cells; a digest falls
into one cell of each, and a cell holds a count, the xor of its digests and the xor of their checks.

A fingerprint is these cells as text, for each block at the least width at which its sketch peels: it
grows with the text, and its digests can be recovered from it (``recovered``).  Two documents are compared
by subtracting their sketches of equal size cell by cell: common digests cancel, and peeling recovers the
others: a cell whose count is 1 or -1 and whose check fits holds one digest, which is then taken out of
its other cells.  Where a block does not peel clean it is built again at twice the width with another
salt, up to ``LEVELS`` times (a block that fails then, which needs that many independent failures, is
compared digest by digest).  Of the differing digests d and the a and b digests of both, likeness is
(a + b - d) / (a + b + d), the Jaccard index; it follows from the two fingerprints alone.

All of it is array functions within a document's row: nothing but the texts is shuffled.  A row holds some
hundred bytes for each digest of its document while it is worked on.

Defined results
* null text: as the empty text; without paragraphs the sketch is empty, and two such are alike (1.0);
* only the set of a text's paragraphs matters; rows with equal doc_id and text are worked on once
  and returned each;
* with several texts under one doc_id, the next document is the one with the next larger doc_id, by
  its least text; a null doc_id sorts first (a text id equal to the empty text counts as null);
* a table with one doc_id only: its next document is itself;
* no rows: no rows.  Columns other than doc_id and text are neither read nor needed.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Characters of a paragraph before it is cut within a line, and at most.
LEAST_CHARS, MOST_CHARS = 80, 400
#: Digests of a block on average at most, least cells of a sub-table in a comparison, levels, rounds of peeling.
BLOCK, WIDTH, LEVELS, ROUNDS = 24, 4, 10, 24
#: Least digests from which a comparison's first width is estimated.
BOTTOM = 12
#: Blocks of scripts that are written without spaces: first and last code point, and of how many characters the first eighth or so may end a paragraph.
UNSPACED = [(0x0E00, 0x0EFF, 32, 4), (0x1000, 0x109F, 32, 4), (0x1780, 0x17FF, 32, 4), (0x3040, 0x30FF, 32, 4), (0x3400, 0x9FFF, 1024, 64)]
_MAY_END = "gwGW37" + "".join(f"{chr(c)}-{chr(c + n - 1)}" for first, last, step, n in UNSPACED for c in range(first, last, step))
#: Characters without a space before one of those ends a paragraph.
RUN_CHARS = 24
#: Words that end in g or w end a paragraph too, as not all texts have sentence marks; and, within a long run without spaces, some characters.
PARAGRAPH = (
    rf"[^\n]{{{LEAST_CHARS},{MOST_CHARS}}}?(?:[.!?…।gw](?=\s)|[。！？]|[{_MAY_END}](?<=[^ \t\r\n]{{{RUN_CHARS}}}))|[^\n]{{1,{MOST_CHARS}}}"
)
#: A cell as text: its count, xor of digests and xor of checks, big-endian.
CELL = np.dtype([("n", ">u2"), ("x", ">i8"), ("c", ">u4")])


def digests(text: Column) -> Column:
    """Distinct 64-bit digests of a text's paragraphs, in order of the digests."""
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PARAGRAPH), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(parts, lambda p: F.xxhash64(p))))


# --- sketches within a row ------------------------------------------------------------------


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit(101)).bitwiseAND(F.lit(0xFFFFFFFF))


def _bits(keys: Column) -> Column:
    """How many leading bits deal ``keys`` over blocks: the least with at most BLOCK in a block on average."""
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.size(keys), F.lit(1)) / F.lit(float(BLOCK)))).cast("int"))


def _split(rows: Column, bits: Column) -> Column:
    """Rows (key, side) in order of the key, dealt over their blocks: an array of arrays."""

    def block(row: Column) -> Column:
        return F.call_function("shiftrightunsigned", F.shiftrightunsigned(row["key"], 1), 63 - bits)

    def pieces(rows: Column) -> Column:
        first = F.filter(F.sequence(F.lit(1), F.size(rows)), lambda i: (i == 1) | (block(F.get(rows, i - 1)) != block(F.get(rows, i - 2))))
        return _let(first, lambda at: F.transform(at, lambda i, k: F.slice(rows, i, F.coalesce(F.get(at, k + 1), F.size(rows) + 1) - i)))

    kind = "array<array<struct<key:bigint,side:int>>>"
    return F.when(F.size(rows) > 0, _let(rows, pieces)).otherwise(F.array().cast(kind))


def _sided(keys: Column, side: int) -> Column:
    return F.transform(keys, lambda k: F.struct(k.alias("key"), F.lit(side).alias("side")))


def _levels(width: Column) -> Column:
    """(salt, width): widths from the given one, each twice the one before."""
    return F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda k: F.struct(k.alias("salt"), (width * F.pow(F.lit(2), k)).cast("int").alias("width")))


def _room(keys: Column) -> Column:
    """For a number of keys, the least width that is a power of two and has three cells for each two of them."""
    return F.pow(F.lit(2), F.ceil(F.log2(F.greatest(keys, F.lit(2)) / F.lit(2.0)))).cast("int")


def _placed(keys: Column, level: Column, sign: int = 1) -> Column:
    """Of each sub-table its entries (at, n, key, check), one for each of ``keys``."""
    mask = (level["width"] - 1).cast("long")
    hashed = F.transform(keys, lambda k: F.struct(k.alias("key"), F.xxhash64(k, level["salt"]).alias("h"), _check(k).alias("check")))
    entry = lambda t, mask, r: F.struct(F.shiftrightunsigned(r["h"], 16 * t).bitwiseAND(mask).alias("at"), F.lit(sign).alias("n"), r["key"].alias("key"), r["check"].alias("check"))
    of = lambda rows, mask: F.array(*[F.transform(rows, functools.partial(entry, t, mask)) for t in range(3)])
    return _let(hashed, lambda rows: _let(mask, lambda m: of(rows, m)))


def _cell(n: Column, x: Column, c: Column) -> Column:
    return F.struct(n.alias("n"), x.alias("x"), c.alias("c"))


def _slots(level: Column) -> Column:
    """Of each cell its sub-table and its place there."""
    return F.transform(F.sequence(F.lit(0), 3 * level["width"] - 1), lambda i: F.struct(F.floor(i / level["width"]).cast("int").alias("t"), (i % level["width"]).cast("long").alias("at")))


def _sums(entries: Column, slot: Column) -> Column:
    """Sums of the entries in one cell."""
    own = F.filter(entries[slot["t"]], lambda e: e["at"] == slot["at"])
    return F.aggregate(own, _cell(F.lit(0), F.lit(0).cast("long"), F.lit(0).cast("long")), lambda c, e: _cell(c["n"] + e["n"], c["x"].bitwiseXOR(e["key"]), c["c"].bitwiseXOR(e["check"])))


def _cells(keys: Column, level: Column, slots: Column) -> Column:
    """The sketch of ``keys``."""
    return _let(_placed(keys, level), lambda entries: F.transform(slots, lambda s: _sums(entries, s)))


def _subtracted(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: _cell(a["n"] - b["n"], a["x"].bitwiseXOR(b["x"]), a["c"].bitwiseXOR(b["c"])))


def _peeled(cells: Column, level: Column, slots: Column) -> Column:
    """(cells, plus, minus, live): what peeling leaves, and the digests recovered by the sign of their count."""

    def state(cells: Column, plus: Column, minus: Column, live: Column) -> Column:
        return F.struct(cells.alias("cells"), plus.alias("plus"), minus.alias("minus"), live.alias("live"))

    def clean(cells: Column) -> Column:
        pure = F.filter(cells, lambda c: (F.abs(c["n"]) == 1) & (c["c"] == _check(c["x"])))
        side = lambda p, sign: F.array_distinct(F.transform(F.filter(p, lambda c: c["n"] == sign), lambda c: c["x"]))
        return _let(pure, lambda p: F.struct(side(p, 1).alias("plus"), side(p, -1).alias("minus")))

    def take(s: Column, found: Column) -> Column:
        signed = F.zip_with(_placed(found["plus"], level), _placed(found["minus"], level, -1), lambda a, b: F.concat(a, b))
        cells = _let(signed, lambda entries: _subtracted(s["cells"], F.transform(slots, lambda slot: _sums(entries, slot))))
        return state(cells, F.concat(s["plus"], found["plus"]), F.concat(s["minus"], found["minus"]), F.lit(True))

    def turn(s: Column, _: Column) -> Column:
        over = state(s["cells"], s["plus"], s["minus"], F.lit(False))
        one = _let(clean(s["cells"]), lambda f: F.when(F.size(f["plus"]) + F.size(f["minus"]) > 0, take(s, f)).otherwise(over))
        return F.when(s["live"], one).otherwise(s)

    none = F.array().cast("array<bigint>")
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), state(cells, none, none, F.lit(True)), turn)


def _clean(cells: Column) -> Column:
    return F.forall(cells, lambda c: (c["n"] == 0) & (c["x"] == 0) & (c["c"] == 0))


def _first_clean(width: Column, start: Column, attempt: Callable[[Column, Column], Column]) -> Column:
    """``attempt`` (level, slots) at ``width`` and at wider and wider levels until its field ``done`` holds."""
    return F.aggregate(_levels(width), start, lambda s, level: F.when(s["done"], s).otherwise(_let(_slots(level), lambda slots: attempt(level, slots))))


def _block_print(rows: Column) -> Column:
    """A block as text: its level, and its cells at the least level at which they peel."""
    kind = "struct<done:boolean,salt:int,cells:array<struct<n:int,x:bigint,c:bigint>>>"

    def attempt(keys: Column, level: Column, slots: Column) -> Column:
        return _let(_cells(keys, level, slots), lambda cells: F.struct(_clean(_peeled(cells, level, slots)["cells"]).alias("done"), level["salt"].alias("salt"), cells.alias("cells")))

    start = F.struct(F.lit(False).alias("done"), F.lit(0).alias("salt"), F.array().cast("array<struct<n:int,x:bigint,c:bigint>>").alias("cells")).cast(kind)
    sketch = _let(F.transform(rows, lambda r: r["key"]), lambda keys: _first_clean(_room(F.size(keys)), start, lambda *level: attempt(keys, *level)))
    digits = lambda x, n: F.lpad(F.hex(x), n, "0")
    packed = lambda s: F.array_join(F.transform(s["cells"], lambda c: F.concat(digits(c["n"].cast("long"), 4), digits(c["x"], 16), digits(c["c"], 8))), "")
    return _let(sketch, lambda s: F.concat(s["salt"].cast("string"), F.lit(":"), F.translate(F.base64(F.unhex(packed(s))), "\r\n", "")))


def printed(keys: Column) -> Column:
    """A document's sketches as text: how many digests, how many leading bits, then each block that is not empty."""
    blocks = F.transform(_split(_sided(keys, 1), _bits(keys)), _block_print)
    return F.concat_ws(" ", F.concat(F.size(keys).cast("string"), F.lit("/"), _bits(keys).cast("string")), blocks)


def _apart(left: Column, right: Column) -> Column:
    """About which share of the digests of both differ: from the least ``BOTTOM`` of each."""
    low = F.array(F.slice(left, 1, BOTTOM), F.slice(right, 1, BOTTOM))

    def share(low: Column) -> Column:
        both = F.slice(F.array_sort(F.array_union(low[0], low[1])), 1, BOTTOM)
        return _let(both, lambda b: F.size(F.array_except(b, F.array_intersect(low[0], low[1]))) / F.greatest(F.size(b), F.lit(1)))

    return _let(low, lambda x: _let(share(x), lambda j: 2 * j / (1 + j)))


def difference(left: Column, right: Column) -> Column:
    """(plus, minus): the digests that only ``left`` or only ``right`` has, recovered from the difference of their sketches."""

    def attempt(sides: Column, level: Column, slots: Column) -> Column:
        apart = _subtracted(_cells(sides["plus"], level, slots), _cells(sides["minus"], level, slots))
        return _let(_peeled(apart, level, slots), lambda p: F.struct(_clean(p["cells"]).alias("done"), p["plus"].alias("plus"), p["minus"].alias("minus")))

    def block(rows: Column, share: Column) -> Column:
        sides = F.struct(*[F.transform(F.filter(rows, lambda r: r["side"] == s), lambda r: r["key"]).alias(n) for s, n in ((1, "plus"), (-1, "minus"))])  # noqa: B023
        none = F.array().cast("array<bigint>")
        start = F.struct(F.lit(False).alias("done"), none.alias("plus"), none.alias("minus"))
        width = F.greatest(F.lit(WIDTH), _room(F.size(rows) * share))

        def found(k: Column) -> Column:
            last = F.struct(F.array_except(k["plus"], k["minus"]).alias("plus"), F.array_except(k["minus"], k["plus"]).alias("minus"))
            return _let(_first_clean(width, start, lambda *level: attempt(k, *level)), lambda f: F.when(f["done"], F.struct(f["plus"].alias("plus"), f["minus"].alias("minus"))).otherwise(last))

        return _let(sides, found)

    bits = F.greatest(_bits(left), _bits(right))
    rows = _split(F.array_sort(F.concat(_sided(left, 1), _sided(right, -1))), bits)
    blocks = _let(_apart(left, right), lambda share: F.transform(rows, lambda r: block(r, share)))
    return _let(blocks, lambda b: F.struct(F.flatten(F.transform(b, lambda x: x["plus"])).alias("plus"), F.flatten(F.transform(b, lambda x: x["minus"])).alias("minus")))


def _likeness(left: Column, right: Column, d: Column) -> Column:
    total = F.size(left) + F.size(right)
    return F.when(total == 0, F.lit(1.0)).otherwise((total - d) / (total + d))


# --- fingerprints as text -------------------------------------------------------------------


def cells_of(fingerprint: str) -> list[tuple[int, np.ndarray]]:
    """A printed fingerprint's blocks: (level, cells)."""
    blocks = [b.split(":") for b in fingerprint.split(" ")[1:]]
    return [(int(level), np.frombuffer(base64.b64decode(data), dtype=CELL)) for level, data in blocks]


# --- the operator ---------------------------------------------------------------------------


def _links(docs: DataFrame) -> DataFrame:
    """(key, chars, next_key) over distinct ids in ascending order; the last one's next is the first.

    Ids are range-partitioned and ordered within each part; the parts' first ids link them.
    """
    ids = docs.groupBy("doc_id", "key").agg(F.max(F.char_length("text")).alias("chars"))
    parts = stored(ids.repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()), "fingerprint-ids")
    place = F.struct(F.col("doc_id").isNotNull().alias("full"), F.col("doc_id").alias("id"))
    heads = parts.groupBy("part").agg(F.min(F.struct(place.alias("place"), "key"))["key"].alias("head"))
    order = Window.partitionBy().orderBy("part")  # one row for each partition
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select("part", F.coalesce(F.lead("head").over(order), F.first("head").over(whole)).alias("head"))
    within = Window.partitionBy("part").orderBy(place)
    out = parts.withColumn("later", F.lead("key").over(within)).join(F.broadcast(heads), "part")
    return stored(out.select("key", "chars", F.coalesce("later", "head").alias("next_key")), "fingerprint-links")


def _quarter(text: str, chars: str) -> Column:
    return F.expr(f"substring({text}, 1, cast(floor({chars} / 4) as int))")


def _documents(docs: DataFrame) -> DataFrame:
    """Distinct (key, text): times, text, head (as much of the next text as any edit here wants), next_keys; partitioned by key.

    ``key`` is the id as text, empty for null.  Texts travel once by key; of the next text only its
    head and digests travel to the document before.
    """
    one = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    links = _links(one)
    own = one.select("key", "text").repartition("key").groupBy("key", F.xxhash64("text").alias("print")).agg(F.first("text").alias("text"), F.count("*").alias("times"))
    back = links.select(F.col("next_key").alias("key"), F.col("key").alias("before"), F.col("chars").alias("wanted"))
    heads = own.groupBy("key").agg(F.min("text").alias("text")).join(back, "key")
    heads = heads.select(F.col("before").alias("key"), _quarter("text", "wanted").alias("head"), digests(F.col("text")).alias("next_keys"))
    return own.join(heads, "key")


def fingerprints(docs: DataFrame, recovered: bool = False) -> DataFrame:
    """The operator: every row with its fingerprint, its edited text's, and the likeness to that and to the next document.

    With ``recovered`` there are edited_difference and next_difference too, (plus, minus): the paragraph digests
    that only the text, and only the other, has.
    """
    edited = F.concat(F.expr("substring(text, 1, char_length(text) - cast(floor(char_length(text) / 4) as int))"), _quarter("head", "char_length(text)"))
    base = _documents(docs).withColumn("edited", edited)
    base = base.select("key", "times", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), digests(F.col("text")).alias("keys"), digests(F.col("edited")).alias("edited_keys"), "next_keys")

    prints = F.transform(F.array("keys", "edited_keys"), printed)
    pairs = F.array(*[F.struct(F.col("keys").alias("own"), F.col(f"{k}_keys").alias("other")) for k in ("edited", "next")])

    def compared(pair: Column) -> Column:
        def answer(d: Column) -> Column:
            return F.struct(d.alias("difference"), _likeness(pair["own"], pair["other"], F.size(d["plus"]) + F.size(d["minus"])).alias("near"))

        return _let(difference(pair["own"], pair["other"]), answer)

    base = base.select("*", prints.alias("_prints"), F.transform(pairs, compared).alias("_pairs"))
    named = [F.col("_prints")[k].alias(n) for k, n in enumerate(("fingerprint", "edited_fingerprint"))]
    named += [F.col("_pairs")[k]["near"].alias(n) for k, n in enumerate(("near_edited", "near_next"))]
    if recovered:
        named += [F.col("_pairs")[k]["difference"].alias(n) for k, n in enumerate(("edited_difference", "next_difference"))]
    doc_id = F.when(F.col("key") != "", F.col("key").cast(docs.schema["doc_id"].dataType)).alias("doc_id")
    out = base.select(doc_id, "n_chars", "edited_sha256", *named, "times")
    return out.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("_", "times")
