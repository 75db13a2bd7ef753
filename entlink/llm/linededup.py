"""Near-duplicate lines by segment partition, in DataFrame functions only.

Two lines within ``tau`` edits have lengths that differ by ``tau`` at most, and
if the shorter is cut into ``tau + 1`` segments, one of them occurs unchanged in
the longer, moved by a few characters at most. So each distinct line is indexed
by its segments, and probes, for every length that a partner may have, the few
substrings that may equal a segment there. The index key holds length, segment
number and the segment's hash. Pairs that meet are verified by a banded
bit-parallel edit distance.

Only hashes are shuffled for the search, a key and a line's hash, once: an
aggregate finds the keys that different lines share. Lines that are left get their texts and a parity
mask of their characters, which most false pairs fail. A pair belongs to the
first of the index keys it shares, so it is found and counted once. Where a key
has few lines, its pairs are rows. Where it has many (a template with numbers in
it, say), they are not: the lines of one side are gathered in blocks of bounded
size, each line of the other side meets the blocks, and what leaves such a row
is the number of its partners and the earliest of them, so rows grow with the
lines and not with their square. Equal lines are one line before the search, so
a line that a third of all documents hold has one set of keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entlink.llm.common import computed, prepare
from entlink.operators.linking import key_filter, mark_possible
from entlink.session import persist_table

TAU = 2
#: Policy of ``dedup_lines``: duplicates with fewer characters stay, as clean documents share them by chance.
CUT_CHARS = 16
#: Tables that are broadcast take no more than this, by their counted rows.
BROADCAST_BYTES = 32 << 20
#: Lines in a block, and pairs for each line of a key up to which they are rows.
BLOCK = 256
FEW = 16


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, row, line_no, line)``, by ``\\n``, from 0; a null or empty text
    has none. ``row`` is a hash of the whole text: rows are told apart by it and their id."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter(F.col("text") != "")
    return rows.select("doc_id", F.xxhash64("text").alias("row"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def parity_mask(line: Column) -> Column:
    """32 bits: whether a character class occurs an odd number of times. An edit changes two bits at most."""
    return F.aggregate(F.split(line, ""), F.lit(0), lambda m, c: m.bitwiseXOR(F.call_function("shiftleft", F.lit(1), F.ascii(c).bitwiseAND(31))))


def _segment(length: Column, i: Column, tau: int) -> tuple[Column, Column]:
    """Start (from 0) and size of segment ``i`` of a line of ``length``: ``i / n``
    of the line lie before it, rounded down."""
    n = tau + 1
    start, end = (F.call_function("div", length * x, F.lit(n)).cast("int") for x in (i, i + 1))
    return start, end - start


def _key(wide: Column, length: Column, i: Column, start: Column, size: Column) -> Column:
    """``wide``: the line in UTF-32, where a character's place needs no search."""
    return F.xxhash64(length, i, F.substring(wide, 4 * start + 1, 4 * size))


def index_keys(wide: Column, length: Column, tau: int) -> Column:
    return F.array(*[_key(wide, length, F.lit(i), *_segment(length, F.lit(i), tau)) for i in range(tau + 1)])


def probe_keys(wide: Column, length: Column, tau: int) -> Column:
    """Keys under which partners of the same or a smaller length are indexed.
    With ``i`` segments before it matching loosely, segment ``i`` is moved by
    ``i`` places at most, and seen from the end by ``tau - i`` at most."""
    places = [F.struct(F.lit(shorter).alias("shorter"), F.lit(i).alias("i"), F.lit(move).alias("move"))
              for shorter in range(tau + 1) for i in range(tau + 1)
              for move in range(max(-i, shorter - (tau - i)), min(i, shorter + (tau - i)) + 1)]

    # a lambda, run for each place: written out, they would make a method too large to be compiled
    def key(place: Column) -> Column:
        other = length - place["shorter"]
        start, end = (F.call_function("div", other * x, F.lit(tau + 1)).cast("int") for x in (place["i"], place["i"] + 1))
        at, size = start + place["move"], end - start
        inside = (at >= 0) & (at + size <= length) & (other > 0)
        return F.when((length > 4 * (tau + 1)) | inside, _key(wide, other, place["i"], at, size))

    return F.array_distinct(F.array_compact(F.transform(F.array(*places), key)))


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), f), 0)


def banded_distance(a: str | Column, b: str | Column, tau: int) -> Column:
    """Edit distance of two columns of characters (arrays) where it is ``tau`` at
    most, else some larger number; their sizes must not differ by more.

    Bit ``x`` of the band stands for row ``j - tau + x`` of the matrix in its
    column ``j``; ``vp`` and ``vn`` have the vertical steps up and down, moved
    one row along for the next column. The distance is followed down the band's
    lowest diagonal to the last row, then along it. Cells of the band differ by
    its width at most: once the distance is beyond ``tau`` by more, it stays so
    and the columns left are passed over.
    """
    (a_, b_), k = (F.col(x) if isinstance(x, str) else x for x in (a, b)), tau
    width = 2 * k + 1
    ones = F.lit((1 << width) - 1)
    inverse = lambda x: x.bitwiseXOR(ones)
    down = lambda x: F.call_function("shiftright", x, F.lit(1))
    bit = lambda x, at: F.call_function("shiftright", x, at).bitwiseAND(1)
    m, n = F.size(a_), F.size(b_)

    def step(s: Column, j: Column) -> Column:
        return F.when(s["dist"] > tau + width, s).otherwise(column(s, j))

    def column(s: Column, j: Column) -> Column:
        vp, vn, dist = s["vp"], s["vn"], s["dist"]
        equal = F.lit(0)
        for x in range(width):
            equal = equal + F.when(F.get(a_, j - 1 - k + x) == F.get(b_, j - 1), 1 << x).otherwise(0)

        def with_d0(d0: Column) -> Column:
            hp = vn.bitwiseOR(inverse(d0.bitwiseOR(vp)))

            def with_hp(hp: Column) -> Column:
                hn = d0.bitwiseAND(vp)
                row = m - j + k  # the last row's bit, once the band has reached it
                moved = F.when(row >= 2 * k, 1 - bit(d0, F.lit(2 * k))).otherwise(bit(hp, row) - bit(hn, row))
                return F.struct(hn.bitwiseOR(inverse(down(d0).bitwiseOR(hp))).alias("vp"), down(d0).bitwiseAND(hp).alias("vn"), (dist + moved).alias("dist"))

            return _let(hp, with_hp)

        return _let(equal, lambda eq: _let((eq.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(eq).bitwiseOR(vn).bitwiseAND(ones), with_d0))

    start = F.struct(F.lit(((1 << (k + 1)) - 1) << k).alias("vp"), F.lit(0).alias("vn"), F.lit(k).alias("dist"))
    # a line shorter than the band starts in its last row
    start = F.struct(start["vp"].alias("vp"), start["vn"].alias("vn"), F.least(F.lit(k), m).alias("dist"))
    walked = F.aggregate(F.sequence(F.lit(1), n), start, step)["dist"]
    return F.when(n == 0, m).otherwise(walked)


def _common(a: Column, b: Column, most: Column, part: Callable[[Column, Column, Column], Column]) -> Column:
    """How many characters, ``most`` at most, two texts have in common at an end,
    by binary search; ``part(text, from, size)`` counts from that end."""
    powers = F.transform(F.sequence(F.lit(0), F.floor(F.log2(F.greatest(most, F.lit(1)))).cast("int")), lambda e: F.call_function("shiftleft", F.lit(1), e))
    longer = lambda n, x: F.when((n + x <= most) & (part(a, n, x) == part(b, n, x)), n + x).otherwise(n)
    return F.aggregate(F.reverse(powers), F.lit(0), longer)


def within(a: Column, b: Column, n_a: Column, n_b: Column, tau: int) -> Column:
    """Whether texts of ``n_a`` and ``n_b`` characters, ``tau`` apart at most, are
    within ``tau`` edits: ends that they share are left out, the rest is verified."""
    front = lambda t, at, size: F.substring(t, at + 1, size)

    def trimmed(head: Column) -> Column:
        most = F.least(n_a, n_b) - head
        back = lambda t, at, size: F.substring(t, F.char_length(t) - at - size + 1, size)

        def verified(tail: Column) -> Column:
            left = lambda t, n: F.filter(F.split(F.substring(t, head + 1, n - head - tail), ""), lambda c: c != "")
            sides = F.struct(left(a, n_a).alias("a"), left(b, n_b).alias("b"))
            return _let(sides, lambda x: banded_distance(x["a"], x["b"], tau) <= tau)

        return _let(_common(a, b, most, back), verified)

    return _let(_common(a, b, F.least(n_a, n_b), front), trimmed)


def is_pair(a: Column, b: Column, tau: int) -> Column:
    """Whether index entry ``a`` and probe entry ``b`` of one key are a link that
    is to be counted here: in these roles, at their first shared key, and by text."""
    roles = (a["n"] < b["n"]) | ((a["n"] == b["n"]) & (a["h"] < b["h"]))
    near = (F.abs(a["n"] - b["n"]) <= tau) & (F.bit_count(a["mask"].bitwiseXOR(b["mask"])) <= 2 * tau)
    return roles & near & ~F.arrays_overlap(a["before"], b["probes"]) & within(a["line"], b["line"], a["n"], b["n"], tau)


def _small(rows: DataFrame, n: int, width: int) -> DataFrame:
    return F.broadcast(rows) if n * width <= BROADCAST_BYTES else rows


def _among(rows: DataFrame, keys: DataFrame, n: int, name: str) -> DataFrame:
    """The rows whose column ``name`` is among the ``n`` values of ``keys``: by
    broadcast while those are small; beyond, a Bloom filter of them is broadcast
    and only rows that pass it are shuffled."""
    if n * 16 <= BROADCAST_BYTES:
        return rows.join(F.broadcast(keys), name, "left_semi")
    bloom = persist_table(key_filter(keys.withColumnRenamed(name, "_k"), n), "line-filter")
    passed = mark_possible(rows.withColumn("_k", F.col(name)), bloom, n).filter("_possible").drop("_k", "_possible")
    return passed.join(keys, name, "left_semi")


def _met_blocks(own: DataFrame, other: DataFrame, ok: Callable[[Column, Column], Column]) -> DataFrame:
    """``(h, n, first)``: for each entry of ``own`` its partners among the blocks
    of ``other``'s entries with the same key: how many, and the earliest place."""
    sizes = other.groupBy("key").count()
    blocks = other.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("e.h"), F.ceil(F.col("count") / BLOCK)))
    blocks = blocks.groupBy("key", "block").agg(F.collect_list("e").alias("others"))
    met = own.join(blocks, "key").select(F.col("e.h").alias("h"), computed(F.filter("others", lambda x: ok(F.col("e"), x))).alias("found"))
    return met.filter(F.size("found") > 0).select("h", F.size("found").alias("n"), F.array_min(F.transform("found", lambda x: x["first"])).alias("first"))


def near_lines(texts: DataFrame, lines: DataFrame, tau: int) -> DataFrame:
    """``(h, n_links, earlier)`` of every line that has a link. ``texts`` has
    ``keys`` (the line's hash, ``tau + 1`` index keys, probe keys) and ``first``
    of each distinct line; ``lines`` has all lines, to read texts from."""
    h = F.get("keys", 0)
    entries = texts.select(h.alias("h"), F.posexplode(F.slice("keys", 2, 10 ** 6)).alias("at", "key")).select("key", "h", (F.col("at") > tau).cast("int").alias("side"))
    # keys under which different lines meet, one as index entry and one as probe: one shuffle of hashes
    met = entries.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b"), F.min("side").alias("x"), F.max("side").alias("y"))
    met = persist_table(met.filter("a <> b and x = 0 and y = 1").select("key"), "line-met")
    entries = persist_table(_among(entries, met, met.count(), "key"), "line-entries")

    # what the comparison needs of the lines that met another
    wanted = persist_table(entries.select("h").distinct(), "line-wanted")
    n_wanted = wanted.count()
    found = _among(lines.select(F.xxhash64("line").alias("h"), "line"), wanted, n_wanted, "h").distinct()
    known = _among(texts.select(h.alias("h"), "first", "keys"), wanted, n_wanted, "h")
    known = known.join(found, "h").select("h", "first", "keys", "line", F.char_length("line").alias("n"), parity_mask(F.col("line")).alias("mask"))
    known = persist_table(known, "line-known")
    index, probe = (entries.filter(F.col("side") == k).select("key", "h") for k in (0, 1))
    at = F.array_position(F.slice("keys", 2, tau + 1), F.col("key")).cast("int")
    none = F.array().cast("array<bigint>")
    entry = lambda before, probes: F.struct("h", "n", "mask", "line", "first", before.alias("before"), probes.alias("probes"))
    index = index.join(known, "h").select("key", entry(F.slice("keys", 2, at - 1), none).alias("e"))
    probe = probe.join(known, "h").select("key", entry(none, F.slice("keys", tau + 3, 10 ** 6)).alias("e"))
    index, probe = persist_table(index, "line-index"), persist_table(probe, "line-probe")

    # keys with more pairs than a few for each line are compared in blocks
    count = lambda rows, name: rows.groupBy("key").agg(F.count("*").alias(name))
    crowded = count(index, "x").join(count(probe, "y"), "key").filter(F.col("x") * F.col("y") > FEW * (F.col("x") + F.col("y"))).select("key")
    crowded = persist_table(crowded, "line-crowded")
    n_crowded = crowded.count()
    side = lambda rows, how: rows.join(_small(crowded, n_crowded, 16), "key", how)
    ok = lambda a, b: is_pair(a, b, tau)
    pairs = side(index, "left_anti").withColumnRenamed("e", "a").join(side(probe, "left_anti").withColumnRenamed("e", "b"), "key")
    near = (F.col("a.h") != F.col("b.h")) & (F.bit_count(F.col("a.mask").bitwiseXOR(F.col("b.mask"))) <= 2 * tau)
    pairs = pairs.filter(near).withColumn("ok", computed(ok(F.col("a"), F.col("b")))).filter("ok")
    pairs = persist_table(pairs.select(F.struct("a.h", "a.first").alias("a"), F.struct("b.h", "b.first").alias("b")), "line-pairs")
    one = lambda x, y: pairs.select(F.col(f"{x}.h").alias("h"), F.lit(1).alias("n"), F.col(f"{y}.first").alias("first"))
    links = one("a", "b").union(one("b", "a"))
    if n_crowded:
        index, probe = side(index, "left_semi"), side(probe, "left_semi")
        links = links.union(_met_blocks(probe, index, lambda own, x: ok(x, own))).union(_met_blocks(index, probe, ok))
    return links.groupBy("h").agg(F.sum("n").cast("bigint").alias("n_links"), F.min("first").alias("earlier"))


def line_classes(docs: DataFrame, tau: int = TAU, exact_chars: int = 1, edit_chars: int | None = None,
                 id_col: str = "doc_id", text_col: str = "text", blank: bool = True) -> DataFrame:
    """``(doc_id, line_no, first_doc_id, first_line_no, n_links, kept)`` of every
    line of at least ``exact_chars`` characters; without ``blank``, lines of
    white space only have no row.

    ``first_*``: the earliest place, by id and line number, of this line or of a
    line linked to it; ``n_links``: other texts within ``tau`` edits, for lines
    of ``edit_chars`` characters or more (all longer than ``tau`` where not given;
    others are duplicates only of equal lines). A line is kept where no equal or
    linked line comes before it. Null ids come first. Rows are told apart by id
    and text: rows equal in both are one document, whose lines stay or go
    together; of rows that only share an id the one with the smaller hash comes
    first at the same line number. Null and empty texts have no lines. Other
    columns are not read. An empty table gives an empty result. Lines are told
    apart by 128-bit hashes, and by 64 bits in the search, whose links are
    verified on the texts.
    """
    return row_line_classes(docs, tau, exact_chars, edit_chars, id_col, text_col, blank).drop("row")


def row_line_classes(docs: DataFrame, tau: int, exact_chars: int, edit_chars: int | None, id_col: str, text_col: str, blank: bool) -> DataFrame:
    """``line_classes`` with the hash ``row`` of the text that a line stands in."""
    prepare(docs.sparkSession)
    lines = lines_of(docs, id_col, text_col).withColumn("length", F.char_length("line")).filter(F.col("length") >= exact_chars)
    if not blank:
        lines = lines.filter(F.col("line").rlike("[^ \\t-\\r]"))
    fuzzy = F.col("length") >= max(tau + 1, edit_chars or 0)
    hashed = lines.select("doc_id", "row", "line_no", F.unhex(F.md5("line")).alias("content"), "line", "length")
    places = persist_table(hashed.select("doc_id", "row", "line_no", "content"), "lines")

    # One row for each distinct line: its first place, and its keys where it is long enough: its own
    # hash, tau + 1 index keys, then probe keys. Both aggregates need the column, so it is made before the sort.
    wide = hashed.withColumn("wide", F.encode("line", "UTF-32"))
    own = F.concat(F.array(F.xxhash64("line")), index_keys(F.col("wide"), F.col("length"), tau), probe_keys(F.col("wide"), F.col("length"), tau))
    place = F.struct("doc_id", "line_no", "row")
    local = wide.select(place.alias("place"), "content", F.when(fuzzy, own).otherwise(F.array().cast("array<bigint>")).alias("keys"))
    texts = persist_table(local.groupBy("content").agg(F.min("place").alias("first"), F.first("keys").alias("keys")), "line-texts")
    linked = near_lines(texts.filter(F.size("keys") > 0), lines.filter(fuzzy), tau)

    # For each distinct line its class: lines with links are few beside the others.
    linked = persist_table(linked, "line-linked")
    firsts = texts.select("content", "first", F.get("keys", 0).alias("h"))
    classes = firsts.join(_small(linked, linked.count(), 128), "h", "left").select(
        "content", "first", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), F.least("first", "earlier").alias("class"))
    classes = persist_table(classes, "line-classes")
    kept = place.eqNullSafe(F.col("first")) & F.col("first").eqNullSafe(F.col("class"))
    return places.join(classes, "content").select("doc_id", "row", F.col("line_no").cast("bigint").alias("line_no"), F.col("class.doc_id").alias("first_doc_id"),
                                                  F.col("class.line_no").cast("bigint").alias("first_line_no"), "n_links", kept.alias("kept"))


def all_line_classes(docs: DataFrame, tau: int = TAU, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``line_classes`` of every line that isn't blank."""
    return line_classes(docs, tau, id_col=id_col, text_col=text_col, blank=False)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = TAU, cut_chars: int = CUT_CHARS) -> DataFrame:
    """``docs`` with its columns: lines of at least ``cut_chars`` characters that
    stand, equal or within ``tau`` edits, in an earlier place are cut from the
    texts, and documents of which no word is left go; all others, null and empty
    texts too, stay. See ``line_classes`` for ties and nulls.

    Documents with cuts are found by id and text. While their cuts fit
    ``BROADCAST_BYTES``, texts stay where they are; beyond, a Bloom filter of them
    is broadcast, and only documents that pass it are shuffled to meet their cuts."""
    least = max(1, cut_chars - tau)  # all that a line of cut_chars can be linked to
    gone = (row_line_classes(docs, tau, least, least, id_col, text_col, True).filter(~F.col("kept"))
            .groupBy("doc_id", "row").agg(F.collect_set("line_no").alias("cut")))
    gone = persist_table(gone, "line-cuts")
    n, n_cuts = gone.agg(F.count("*"), F.coalesce(F.sum(F.size("cut")), F.lit(0))).first()
    names = [f"c{i}" for i in range(len(docs.columns))]
    id_, text = (names[docs.columns.index(c)] for c in (id_col, text_col))
    rows = docs.toDF(*names).withColumn("of_text", F.xxhash64(text))
    same = F.col(id_).eqNullSafe(F.col("doc_id")) & (F.col("of_text") == F.col("row"))
    if 32 * n + 8 * n_cuts <= BROADCAST_BYTES:
        return _cut(rows.join(F.broadcast(gone), same, "left"), text, cut_chars, names).toDF(*docs.columns)
    bloom = persist_table(key_filter(gone.select(F.xxhash64("doc_id", "row").alias("_k")), n), "line-cut-filter")
    rows = mark_possible(rows.withColumn("_k", F.xxhash64(id_, "of_text")), bloom, n)
    cut = _cut(rows.filter("_possible").join(gone, same, "left"), text, cut_chars, names)
    return rows.filter("not _possible").select(*names).union(cut).toDF(*docs.columns)


def _cut(rows: DataFrame, text: str, cut_chars: int, names: list[str]) -> DataFrame:
    """Rows without the lines ``cut`` that have ``cut_chars`` characters, and without rows of which no word is left."""
    rows = rows.withColumn("lines", F.split(F.col(text), "\n"))
    is_long = lambda i: F.char_length(F.get("lines", i.cast("int"))) >= cut_chars
    rows = rows.withColumn("cut", computed(F.when(F.exists("cut", is_long), F.filter("cut", is_long))))
    places = F.array_except(F.sequence(F.lit(0).cast("bigint"), F.size("lines").cast("bigint") - 1), "cut")
    left = F.array_join(F.transform(places, lambda i: F.get("lines", i.cast("int"))), "\n")
    rows = rows.withColumn(text, computed(F.when(F.col("cut").isNull(), F.col(text)).otherwise(left)))
    return rows.filter(F.col("cut").isNull() | F.col(text).rlike("[^ \\t-\\r]")).select(*names)
