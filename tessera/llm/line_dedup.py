"""Line dedup: lines equal or nearly equal to an earlier line go.

Two lines are near if their edit distance (in characters) is at most
``threshold`` and both have at least ``MIN_CHARS`` characters; shorter lines
are only compared for equality. A line goes if an equal or near line stands
earlier, in order of (doc_id, text hashes, line number), judged on the input.

Near lines are found by segment partition. A line of length l is cut into
threshold + 1 segments; of two lines within the threshold, at least one
segment of the shorter stands unchanged in the longer, shifted by few places.
Segments are indexed by (length, number, characters); every line probes the
indexes of lengths l - threshold .. l with the substrings at the places the
shift bound allows. A line goes as soon as one earlier near line is known, so
no pairs are ever written; both passes are left semi joins, whose output is at
most one row for each segment of a line:

1. Segments carry names: hash bits of the line, and its counts of letters and
   digits modulo 4, which an edit changes by two at most. A segment stays if
   another line whose counts allow the threshold has it. Lines that share a
   name by chance are marked and count as another line, so none is lost.
2. The segments that stay get the characters and the first place of their
   lines, and a line goes if an earlier one meets it there and Spark's
   ``levenshtein(a, b, threshold)``, the built-in with the cut-off band, allows
   it.

All of it is DataFrame functions. Equal lines are one row before the joins, and
a segment that very many different lines share is split between tasks by
adaptive execution; it costs a comparison of two longs for each pair of lines
until one is found that the counts allow.

Edge cases. A null text has no lines and stays null; blank lines (no word)
are kept and never compared. A document is known by its doc_id and two hashes
of its text: rows equal in both are one document given more than once, and
keep and lose the same line numbers; rows that share an id (or have none) but
not the text are documents of their own, in order of the hashes. Null ids sort
after all others.
An empty table gives an empty result. Extra columns are carried along
untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import let, text_key
from tessera.session import materialize

THRESHOLD = 2
MIN_CHARS = 24
MAX_BROADCAST_IDS = 4_000_000
# The fifteen most frequent letters, counted to reject pairs early.
LETTERS = ("e", "t", "a", "o", "i", "n", "s", "h", "r", "d", "l", "c", "u", "m", "w")
DIGITS = ("0", "2", "4", "6", "8")  # each with the digit after it
HASH_SHIFT = 2 * (len(LETTERS) + len(DIGITS)) + 2  # what a name's hash bits stand above
INDEXED, SEVERAL = 1, 2


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> list[Column]:
    """128-bit stand-in for a line."""
    return [F.xxhash64(line).alias("a"), F.xxhash64(F.lit(3), line).alias("b")]


def _bounds(length: Column, k: int, parts: int) -> tuple[Column, Column]:
    """(start from 0, size) of segment ``k``: even sizes, the longer ones last."""
    small = F.floor(length / parts).cast("int")
    longer = length - small * parts  # segments that are one longer
    start = k * small + F.greatest(F.lit(0), longer - (parts - k))
    return start, small + F.when(F.lit(k) >= parts - longer, 1).otherwise(0)


def _index(line: Column, length: Column, threshold: int) -> Column:
    """Segment keys of a line."""
    keys = []
    for k in range(threshold + 1):
        start, size = _bounds(length, k, threshold + 1)
        keys.append(F.xxhash64(length, F.lit(k), F.substring(line, start + 1, size)))
    return F.array(*keys)


def _probes(line: Column, length: Column, threshold: int) -> Column:
    """Keys under which a line's shorter (or as long) partners are indexed.

    Segment k (from 0) of a partner d characters shorter can stand only where
    both the edits before it (at most k) and after it (at most
    threshold - k) explain its shift."""
    keys = []
    for d in range(threshold + 1):
        other = length - d
        for k in range(threshold + 1):
            start, size = _bounds(other, k, threshold + 1)
            low = max(-k, d - (threshold - k))
            high = min(k, d + (threshold - k))
            keys += [F.xxhash64(other, F.lit(k), F.substring(line, start + 1 + s, size)) for s in range(low, high + 1)]
    return F.array(*keys)


def occurrences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, k1, k2, no, line) of the lines that hold a word."""
    text = F.col(f"`{text_col}`").cast("string")
    # Hashed once for each row, below the explode.
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), *text_key(text), text.alias("text"))
    return (rows.select("doc_id", "k1", "k2", F.posexplode(_lines(F.col("text"))).alias("no", "line"))
            .where(F.col("line").rlike(r"[^\x20\x09-\x0D]")))


def _name(line: Column) -> Column:
    """62-bit name of a line, above two bits for flags: 22 hash bits, and its
    counts of the letters and of pairs of digits modulo 4. Each is counted by
    removing it from what the one before has left, so scans get shorter."""
    out, rest = F.shiftrightunsigned(F.xxhash64(line), HASH_SHIFT), line
    for c in (*LETTERS, *DIGITS):
        if c == DIGITS[0]:
            rest = F.translate(rest, "13579", "02468")
        left = F.replace(rest, F.lit(c), F.lit(""))
        n = F.octet_length(rest) - F.octet_length(left)
        out, rest = F.shiftleft(out, 2).bitwiseOR(n.bitwiseAND(3).cast("long")), left
    return F.shiftleft(out, 2)


def _bits(name: Column, bits: int) -> Column:
    return name.bitwiseAND(F.lit(bits).cast("long"))


def _counts_allow(x: Column, y: Column, threshold: int) -> Column:
    """An edit changes the counts by two in all; more cannot be explained."""
    total = F.lit(0)
    for i in range(1, len(LETTERS) + len(DIGITS) + 1):
        d = _bits(_bits(F.shiftright(x, 2 * i), 3) - _bits(F.shiftright(y, 2 * i), 3), 3)
        total = total + F.least(d, 4 - d)
    return total <= 2 * threshold


def _long(found: DataFrame, threshold: int) -> DataFrame:
    return found.where(F.length("line") >= max(MIN_CHARS, threshold + 1))


def shared_segments(found: DataFrame, threshold: int) -> DataFrame:
    """(seg, name): segments that a line shares with another one where the
    bounds allow, and whose counts allow the threshold; at most one row for
    each segment of a line. Flag INDEXED: the segment is one of the line's own
    partition; SEVERAL: more lines have the name."""
    long = _long(found, threshold).withColumn("len", F.length("line"))
    line, size = F.col("line"), F.col("len")
    own, probes = _index(line, size, threshold), _probes(line, size, threshold)
    keys = long.select(_name(line).alias("name"), F.xxhash64(line).alias("a"),
                       F.concat(own, F.array_except(probes, own)).alias("segs"))
    lines = keys.groupBy("name").agg((F.min("a") != F.max("a")).alias("several"), F.collect_set("segs").alias("sets"))
    flag = F.when(F.col("several"), F.lit(SEVERAL).cast("long")).otherwise(F.lit(0).cast("long"))
    segs = (lines.select(F.col("name").bitwiseOR(flag).alias("name"), F.explode("sets").alias("segs"))
            .select("name", F.posexplode("segs").alias("no", "seg")))
    # The first threshold + 1 are the index; a line probes with these and the others.
    rows = segs.select("seg", F.when(F.col("no") <= threshold, F.col("name").bitwiseOR(F.lit(INDEXED).cast("long")))
                       .otherwise(F.col("name")).alias("name"))
    x, y = F.col("name"), F.col("other")
    differ = (F.shiftright(x, 2) != F.shiftright(y, 2)) | (_bits(x, SEVERAL) != 0)
    met = (F.col("seg") == F.col("seg2")) & differ & (_bits(x.bitwiseOR(y), INDEXED) != 0)
    return rows.join(rows.select(F.col("seg").alias("seg2"), F.col("name").alias("other")),
                     met & _counts_allow(x, y, threshold), "left_semi")


def _few(ids: DataFrame) -> DataFrame:
    """Broadcast ids if they are few; a shuffle join serves else."""
    return F.broadcast(ids) if ids.count() <= MAX_BROADCAST_IDS else ids


def _place() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "k1", "k2", "no")


def near_earlier(found: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Keys (a, b) of the lines in ``found`` that are within the threshold of a
    different line whose first place is earlier."""
    shared = materialize(shared_segments(found, threshold), "line-segments")
    plain = F.col("name").bitwiseAND(F.lit(~(INDEXED | SEVERAL)).cast("long"))
    names = shared.select(plain.alias("name")).distinct()
    hashes = names.select(F.shiftrightunsigned("name", HASH_SHIFT).alias("h")).distinct()
    line = F.col("line")
    # The hash bits alone tell most lines; counts are made for the rest.
    some = (_long(found, threshold).withColumn("h", F.shiftrightunsigned(F.xxhash64(line), HASH_SHIFT))
            .join(_few(hashes), "h", "left_semi"))
    texts = (some.withColumn("name", _name(line)).join(_few(names), "name", "left_semi")
             .groupBy("name", "line").agg(F.min(_place()).alias("first")))
    rows = shared.select("seg", F.col("name").alias("flags"), plain.alias("name")).join(texts, "name")
    other = rows.select(F.col("seg").alias("seg2"), F.col("flags").alias("flags2"), F.col("line").alias("line2"),
                        F.col("first").alias("first2"))
    met = ((F.col("seg") == F.col("seg2")) & (_bits(F.col("flags").bitwiseOR(F.col("flags2")), INDEXED) != 0)
           & (F.col("first2") < F.col("first")) & _counts_allow(F.col("flags"), F.col("flags2"), threshold)
           & (F.levenshtein(line, F.col("line2"), threshold) >= 0))
    return rows.join(other, met, "left_semi").select(*_key(line)).distinct()


def removed_lines(docs: DataFrame, threshold: int = THRESHOLD, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """(doc_id, k1, k2, no) of the lines that go; no counts from 0. A document
    that is given more than once has its lines as often."""
    found = occurrences(docs, id_col, text_col)
    goes = _few(materialize(near_earlier(found, threshold), "line-near")).withColumn("goes", F.lit(True))
    at = found.select("doc_id", "k1", "k2", "no", *_key(F.col("line")))
    # A line that stands once and is near no earlier one stays; it needs no look-up.
    verdict = (at.groupBy("a", "b").agg(F.min(_place()).alias("first"), F.count("*").alias("n"))
               .join(goes, ["a", "b"], "left").where("n > 1 or goes")
               .select("a", "b", F.when(F.col("goes").isNull(), F.col("first")).alias("stays")))
    return (at.join(verdict, ["a", "b"])
            .where(F.col("stays").isNull() | ~(F.col("doc_id").eqNullSafe(F.col("stays.doc_id"))
                                               & (F.col("k1") == F.col("stays.k1"))
                                               & (F.col("k2") == F.col("stays.k2"))
                                               & (F.col("no") == F.col("stays.no"))))
            .select("doc_id", "k1", "k2", "no"))


def dedup(docs: DataFrame, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text",
          out: str = "dedup") -> DataFrame:
    """``docs`` plus a struct column ``out``: n_lines, n_removed and text (the
    kept lines joined by a line break; null for a null text)."""
    gone = (removed_lines(docs, threshold, id_col, text_col)
            .groupBy(F.col("doc_id").alias("__doc"), F.col("k1").alias("__k1"), F.col("k2").alias("__k2"))
            .agg(F.sort_array(F.collect_set("no")).alias("__gone")))
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"))
    text = F.col(f"__row.`{text_col}`").cast("string")
    k1, k2 = text_key(text)
    same = F.col(f"__row.`{id_col}`").eqNullSafe(F.col("__doc")) & (k1 == F.col("__k1")) & (k2 == F.col("__k2"))
    joined = row.join(gone, same, "left")

    def rebuilt(ls):
        kept = F.when(F.col("__gone").isNull(), ls).otherwise(_without(ls, F.col("__gone")))
        return F.struct(F.size(ls).cast("long").alias("n_lines"),
                        F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_removed"),
                        F.array_join(kept, "\n").alias("text"))

    empty = F.struct(F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed"),
                     F.lit(None).cast("string").alias("text"))
    made = F.when(text.isNull(), empty).otherwise(let(_lines(text), rebuilt))
    return joined.select("__row.*", made.alias(out))


def _without(lines: Column, gone: Column) -> Column:
    """``lines`` without the numbers in ``gone`` (sorted): the slices between them."""
    edges = F.concat(F.array(F.lit(-1)), gone, F.array(F.size(lines)))
    return let(edges, lambda e: F.flatten(F.transform(
        F.sequence(F.lit(0), F.size(e) - 2),
        lambda i: F.slice(lines, F.get(e, i) + 2, F.get(e, i + 1) - F.get(e, i) - 1))))


def clean(docs: DataFrame, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text",
          chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with the lines removed from the text. A document that loses
    all its lines goes; a count of characters is brought up to date."""
    name = "__dedup"
    while name in docs.columns:
        name += "_"
    found = dedup(docs, threshold, id_col, text_col, name)
    text = F.col(name)["text"]
    left = found.where((F.col(name)["n_removed"] == 0) | text.rlike(r"[^\x20\x09-\x0D]"))
    kinds = dict(docs.dtypes)

    def column(c):
        if c == text_col:
            return text.alias(c)
        if c == chars_col:
            return F.when(F.col(name)["n_removed"] == 0, F.col(f"`{c}`")).otherwise(
                F.length(text).cast(kinds[c])).alias(c)
        return F.col(f"`{c}`")

    return left.select(*(column(c) for c in docs.columns))
