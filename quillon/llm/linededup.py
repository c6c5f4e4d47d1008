"""Line dedup: a segment-partition edit join, in DataFrame functions only.

A line goes if an earlier line of the corpus (by doc_id, text hash, place) is within
``max_edits`` edits of it.  Lines of fewer than ``min_chars`` code points always stay.

1. Equal lines become one, with the place of the first.
2. A line of the index is cut into ``max_edits + 1`` segments by its length; each edit spoils one
   segment at most, so two lines within the limit share a whole segment.  A probing line looks,
   for each length up to ``max_edits`` below its own and each segment, at the few substrings of
   its own that a match could use.
3. Candidates are verified by a banded bit-parallel automaton: a bit row over the
   2 * max_edits + 1 diagonals for each number of errors, moved along one code point at a time.
4. A segment that more than HOT_LINES lines share (a template with one changing number) is taken out
   before pairs are made.  What is left of its lines when the segment is cut out is cut into
   max_edits + 1 segments in turn, and so on, until few lines share a segment or max_edits code
   points are left.  Lines that differ in so few places only are all within the limit, so each is a
   candidate with the first of them alone.  Each round halves what is left (for one edit), so the
   bytes of all rounds are a small multiple of those of the lines, however long.

Null and empty texts have no lines to lose.  Repeated rows: rows equal in doc_id and text
cannot be told apart and each keeps what the first keeps; with other doc_ids the smaller
one keeps its lines.  A null doc_id sorts first.  Very long lines are lines like others.  A
carriage return is part of its line.  A text that loses nothing is returned unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import discard, kept, written

MIN_CHARS, MAX_EDITS, HOT_LINES = 20, 1, 16
#: Up to how many keys or ids are broadcast.
SENT_IDS = 200_000
PLACE = ("d", "h", "k")


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("d"), F.xxhash64("text").alias("h"), "text")


def occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    """d, h, k, line, id (a 128-bit hash of the line)."""
    lines = keyed(docs).select("d", "h", F.posexplode(F.split("text", "\n", -1)).alias("k", "line")).where(F.length("line") >= min_chars)
    return lines.withColumn("id", F.unhex(F.md5("line")))


def distinct_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """id, first and last place, line, n (its length)."""
    groups = occurrences(docs, min_chars).groupBy("id").agg(F.min(F.struct(*PLACE)).alias("first"), F.max(F.struct(*PLACE)).alias("last"), F.first("line").alias("line"))
    return groups.withColumn("n", F.length("line"))


def _start(length: Column, segment: int, segments: int) -> Column:
    """Where a segment of a line of that length begins."""
    return F.floor(length * segment / F.lit(segments)).cast("int")


def cuts(line: Column, n: Column, edits: int) -> list[tuple[int, int, int, Column, Column, Column]]:
    """(d, segment, shift, fits, piece, rest) for each substring of a line that may equal a segment of a line shorter
    by d: the segment's own place if d and shift are 0.

    Segment i moved by x needs abs(x) edits on its left and abs(d - x) on its right.  Of the
    whole segments the one is sought that has at most i edits on its left and edits - i on its
    right; there always is one."""
    out, s = [], edits + 1
    for d in range(edits + 1):
        length = n - d
        for i in range(s):
            a, b = _start(length, i, s), _start(length, i + 1, s)
            for x in range(-edits, edits + 1):
                if abs(x) <= i and abs(d - x) <= edits - i:
                    out.append((d, i, x, (a + x >= 0) & (b + x <= n) & (b > a), F.substring(line, a + x + 1, b - a), F.concat(F.substring(line, F.lit(1), a + x), F.substring(line, b + x + 1, n - b - x))))
    return out


def probe_keys(line: Column, n: Column, edits: int) -> list[Column]:
    """Null where a substring would leave the line."""
    return [F.when(fits, F.xxhash64(n - d, F.lit(i), piece)) for d, i, _, fits, piece, _ in cuts(line, n, edits)]


def numbered(lines: DataFrame, edits: int) -> DataFrame:
    """``distinct_lines`` with a number as id (their hash: ``hash``) and their keys, to be written: each key is computed once."""
    keys = {f"key{k}": key for k, key in enumerate(probe_keys(F.col("line"), F.col("n"), edits))}
    return lines.withColumnRenamed("id", "hash").withColumn("id", F.monotonically_increasing_id()).withColumns(keys)


def within(ca: str, cb: str, edits: int) -> Column:
    """Is the edit distance of two columns of characters (array<string>, not empty) at most ``edits``?

    Bit d + edits of row e says: the first j characters of b and the first j + d of a agree with e
    errors.  A character of b keeps a bit on its diagonal if it matches or is substituted,
    moves it down one as an insertion; a deletion moves it up one within the new rows."""
    width, bits = 2 * edits + 1, (1 << (2 * edits + 1)) - 1
    begin = ", ".join(f"{((1 << (e + 1)) - 1) << edits & bits}" for e in range(edits + 1))
    match = " | ".join(f"if(get({ca}, j - 1 + {d - edits}) <=> c, {1 << d}, 0)" for d in range(width))
    row = ["(r[0] & m)"]
    for e in range(1, edits + 1):
        row.append(f"(((r[{e}] & m) | r[{e - 1}] | shiftright(r[{e - 1}], 1) | shiftleft({row[e - 1]}, 1)) & {bits})")
    masks = f"transform({cb}, (c, i) -> transform(array(i + 1), j -> {match})[0])"
    last = f"aggregate({masks}, array({begin}), (r, m) -> array({', '.join(row)}))[{edits}]"
    shift = f"size({ca}) - size({cb})"
    return F.expr(f"case when abs({shift}) > {edits} then false else (shiftright({last}, {shift} + {edits}) & 1) = 1 end")


def _hot(own: DataFrame) -> tuple[DataFrame, int]:
    """The keys that many lines of the index share, and how many they are."""
    hot = kept(own.groupBy("key").agg(F.count("*").alias("lines")).where(F.col("lines") > HOT_LINES).select("key"))
    return hot, hot.count()


def _sent(keys: DataFrame, n: int) -> DataFrame:
    """Few keys (counted) are sent to the rows, else both are shuffled."""
    return F.broadcast(keys) if n <= SENT_IDS else keys


def near_pairs(lines: DataFrame, edits: int) -> DataFrame:
    """Candidates: a, b (ids) among ``numbered`` lines."""
    n = F.col("n")
    codes = [(f"key{k}", d == x == 0) for k, (d, _, x, *_) in enumerate(cuts(F.col("line"), n, edits))]
    exploded = lambda names: lines.select("id", "n", F.explode(F.array(*names)).alias("key")).where("key is not null")
    index, probe = exploded([name for name, own in codes if own]), exploded([name for name, _ in codes])
    hot, many = _hot(index)
    cold = index.join(_sent(hot, many), "key", "left_anti") if many else index
    pairs = probe.alias("p").join(cold.alias("i"), "key").where("p.n > i.n or p.id > i.id").select(F.col("p.id").alias("a"), F.col("i.id").alias("b"))
    if not many:
        return pairs.distinct()
    coded = lines.select("id", "first", "line", "n", F.posexplode(F.array(*(name for name, _ in codes))).alias("code", "key")).where("key is not null")
    rows, parts = coded.join(_sent(hot, many), "key"), [pairs]
    choice = lambda value, otherwise: F.coalesce(*(F.when(F.col("code") == k, value(c)) for k, c in enumerate(cuts(F.col("line"), n, edits))), F.lit(otherwise))
    rows = rows.select("id", "first", "key", choice(lambda c: c[5], "").alias("rest"), choice(lambda c: F.lit(c[0]), 0).alias("d"), choice(lambda c: F.lit(c[0] == c[2] == 0), False).alias("own"))
    while many:
        rows = kept(rows)
        left = F.length("rest") - F.col("d")
        parts.append(_last_pairs(rows.where(left <= edits), edits))
        deeper = kept(_cut_again(rows.where(left > edits), edits))
        own = deeper.where("own")
        hot, many = _hot(own)
        parts.append(_paired(deeper, own.join(_sent(hot, many), "key", "left_anti") if many else own))
        rows = deeper.join(_sent(hot, many), "key")
    for part in parts[1:]:
        pairs = pairs.unionByName(part)
    return pairs.distinct()


def _paired(rows: DataFrame, own: DataFrame) -> DataFrame:
    """A row of the first with one of the second of the same key."""
    return rows.alias("p").join(own.alias("i"), "key").where("p.id <> i.id and (p.d > 0 or not p.own or p.id > i.id)").select(F.col("p.id").alias("a"), F.col("i.id").alias("b"))


def _cut_again(rows: DataFrame, edits: int) -> DataFrame:
    """The same rows with a segment of the rest in the key, once for each segment."""
    rest, options = F.col("rest"), []
    for d, i, x, fits, piece, left in cuts(rest, F.length("rest"), edits):
        new = F.struct(F.xxhash64("key", F.length("rest") - d, F.lit(i), piece).alias("key"), left.alias("rest"), (F.col("own") & F.lit(x == 0)).alias("own"))
        options.append(F.when((F.col("d") == d) & fits, new))
    return rows.select("id", "first", "d", F.inline(F.array_compact(F.array(*options))))


def _last_pairs(rows: DataFrame, edits: int) -> DataFrame:
    """Of rows with ``edits`` code points left or fewer: each line of the index with the first of its key, and each
    longer or shifted line with those of the index that have one of its code points (one edit) or
    with all of them (more edits: the count grows with the lines that differ in so few places only)."""
    own, other = rows.where("own"), rows.where("not own")
    first = own.groupBy("key").agg(F.min(F.struct("first", "id")).alias("least")).select("key", F.col("least.id").alias("b"))
    stars = own.join(first, "key").where("id <> b").select(F.col("id").alias("a"), "b")
    if edits == 1:
        chars = lambda df: df.select("id", "d", "own", F.explode(F.array_distinct(F.split("rest", ""))).alias("c"), "key").select("id", "d", "own", F.xxhash64("key", "c").alias("key"))
        own, other = chars(own), chars(other)
    return stars.unionByName(_paired(other, own))


def near_lines(lines: DataFrame, edits: int) -> DataFrame:
    """id of each distinct line that has an earlier line within the limit."""
    pairs = kept(near_pairs(lines, edits))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = kept(lines.join(_sent(ends, pairs.count()), "id", "left_semi").select("id", "first", "line"))
    side = lambda name: texts.select(F.col("id").alias(name), F.col("first").alias(f"f{name}"), F.split("line", "").alias(f"c{name}"))
    linked = pairs.join(side("a"), "a").join(side("b"), "b").where(within("ca", "cb", edits))
    return linked.select(F.when(F.col("fa") < F.col("fb"), F.col("b")).otherwise(F.col("a")).alias("id")).distinct()


def removed_lines(docs: DataFrame, min_chars: int = MIN_CHARS, max_edits: int = MAX_EDITS) -> DataFrame:
    """d, h, exact, near: for each text that loses lines, the numbers of its lines that equal an
    earlier one, and of those that are only near to one."""
    lines = written(numbered(distinct_lines(docs, min_chars), max_edits))
    near = kept(near_lines(lines, max_edits)).withColumn("near", F.lit(True))
    # Written, so that adaptive execution can split the places of a very common line in the join below.
    first = kept(lines.select("id", "hash", "first", "last").join(near, "id", "left").where("first <> last or near").select(F.col("hash").alias("id"), "first", "near"))
    discard(lines)
    places = occurrences(docs, min_chars).select(*PLACE, "id").distinct().join(first, "id")
    not_first = F.struct(*PLACE) != F.col("first")
    gone = places.where(not_first | F.col("near")).select("d", "h", "k", not_first.alias("copy"))
    return gone.groupBy("d", "h").agg(F.collect_list(F.when(F.col("copy"), F.col("k"))).alias("exact"), F.collect_list(F.when(~F.col("copy"), F.col("k"))).alias("near"))


def with_removed(docs: DataFrame, min_chars: int, max_edits: int) -> DataFrame:
    """row (struct of all columns), lines, and gone (exact + near; null: none)."""
    gone = removed_lines(docs.select("doc_id", "text"), min_chars, max_edits)
    row = docs.select(F.struct("*").alias("row")).withColumns({"d": F.coalesce(F.col("row.doc_id"), F.lit(-(2**63))), "h": F.xxhash64("row.text")})
    # Line numbers alone are hashed, so the texts need no sort.
    return row.join(gone.hint("shuffle_hash"), ["d", "h"], "left").select("row", "exact", "near")


def _kept_text() -> Column:
    def without(lines: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.concat("exact", "near"))
        return F.array_join(F.transform(F.sort_array(left), lambda i: F.get(lines, i)), "\n")

    # The lines are an argument: named inside the inner function, they would be split anew for each line.
    lines = F.array(F.split("row.text", "\n", -1))
    return F.when(F.col("exact").isNull(), F.col("row.text")).otherwise(F.get(F.transform(lines, without), F.lit(0)))


def _n_lines(text: Column) -> Column:
    return F.when(text.isNull(), 0).otherwise(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)


def digest(docs: DataFrame, min_chars: int = MIN_CHARS, max_edits: int = MAX_EDITS) -> DataFrame:
    """doc_id, n_lines, n_exact, n_near, kept_sha256 of every row."""
    rows = with_removed(docs.select("doc_id", "text"), min_chars, max_edits)
    return rows.select(
        "row.doc_id",
        _n_lines(F.col("row.text")).cast("long").alias("n_lines"),
        F.coalesce(F.size("exact"), F.lit(0)).cast("long").alias("n_exact"),
        F.coalesce(F.size("near"), F.lit(0)).cast("long").alias("n_near"),
        F.sha2(F.coalesce(_kept_text(), F.lit("")), 256).alias("kept_sha256"),
    )


def remove_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, max_edits: int = MAX_EDITS) -> DataFrame:
    """``docs`` without those lines, all columns."""
    rows = with_removed(docs, min_chars, max_edits).withColumn("new", _kept_text())
    return rows.select(*(F.col("new").alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
