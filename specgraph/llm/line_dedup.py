"""Removal of repeated and near-repeated lines by an exact set-similarity join.

A line is the set of its tokens. Tokens are ordered by rarity, so that two sets with a Jaccard similarity of
at least t share a token within their first n - ceil(t n) + 1. Sets that share one there are
candidates if their sizes (length filter), the tokens left after the shared one (positional filter) and the
parities of 64 groups of their tokens (256 of large sets) allow the overlap that t asks for; the tokens themselves then decide.
The smaller set of a pair needs a shorter prefix, and a pair meets once a run of prefix tokens that follow one another in both.

A line goes if one earlier line matches it, so that not all pairs of a group of copies are needed. Lines first
meet the earliest lines of two pairs of neighbours in their prefix: one candidate a line, however large the
group. Only lines that this leaves unmatched are then joined, as the later side, with all earlier ones.
DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _util

#: Token counts are kept in buckets by hash, one to TEXT_PER_BUCKET bytes of distinct lines; the powers of two between which their number lies.
TEXT_PER_BUCKET, LEAST_BUCKETS, MOST_BUCKETS = 256, 10, 25
#: Pairs of neighbours in the prefix whose earliest lines a line meets first, and of how many parts of the lines (a power of two) it meets the earliest.
SEEDS, CHOICES = 2, 4
#: Sets of more tokens than this also have the parities of 256 groups, in three more words.
LONG = 112
_MORE = ("w1", "w2", "w3")
_SHIFT, _HALF = 4294967296, 2147483648
_KEY = ["doc_id", "line_no"]
#: ASCII white space.
_SPACES = " \t\n\x0b\f\r"
#: A code holds the level of its bucket above this bit and the end of the token's hash below. Codes under _ALONE stand in one line only.
_LEVEL_BIT = 56
_ALONE = 1 << _LEVEL_BIT


def _norm(line: Column) -> Column:
    """Lower case, any ASCII white space as a space, none at the ends."""
    low = F.lower(line)
    plain = low
    for c in _SPACES[1:]:
        plain = F.replace(plain, F.lit(c), F.lit(" "))
    return F.trim(F.when(low.rlike(f"[{_SPACES[1:]}]"), plain).otherwise(low))


def _blank(line: Column) -> Column:
    """Whether there is nothing but ASCII white space; looks no further than the first other character."""
    return F.ltrim(line, F.lit(_SPACES)) == ""


def _tokens(norm: Column) -> Column:
    return F.array_remove(F.array_distinct(F.split(norm, " ")), "")


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, norm) of every line that isn't blank."""
    # Blank lines are told by the line itself: a condition on ``norm`` would make each one twice.
    parts = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).filter(~_blank(F.col("line")))
    return parts.select("doc_id", "line_no", _norm(F.col("line")).alias("norm"))


def distinct_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, norm): each line text where it stands first; summed up before the shuffle, so that frequent lines travel once a task."""
    least, most = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    if least is None or (least >= -_HALF and most < _HALF):  # ids of 32 bits: a place is one number of 64
        place = F.shiftleft(F.col("doc_id").cast("bigint"), 32).bitwiseOR(F.col("line_no").cast("bigint"))
        first = _lines(docs).groupBy("norm").agg(F.min(place).alias("place"))
        return first.select(F.shiftright("place", 32).alias("doc_id"), F.col("place").bitwiseAND(F.lit(_SHIFT - 1)).cast("int").alias("line_no"), "norm")
    place = F.col("doc_id").cast("decimal(20,0)") * F.lit(_SHIFT).cast("decimal(11,0)") + F.col("line_no")
    first = _lines(docs).groupBy("norm").agg(F.min(place.cast("decimal(38,0)")).alias("place"))
    number = F.pmod("place", F.lit(_SHIFT).cast("decimal(11,0)"))
    return first.select(((F.col("place") - number) / F.lit(_SHIFT).cast("decimal(11,0)")).cast("bigint").alias("doc_id"), number.cast("int").alias("line_no"), "norm")


def _buckets(lines: DataFrame) -> int:
    """Logarithm of the number of buckets: as many as the text asks for, up to what every task can hold (a byte each)."""
    size = lines.agg(F.sum(F.octet_length("norm"))).first()[0] or 0
    return min(MOST_BUCKETS, max(LEAST_BUCKETS, math.ceil(math.log2(size / TEXT_PER_BUCKET + 1))))


def _rarity(lines: DataFrame, k: int) -> tuple[Column, str]:
    """The levels (half powers of two) of the counts of all 2^k buckets, a byte each."""
    h = F.xxhash64("t")
    tokens = lines.select(F.explode(F.split("norm", " ")).alias("t")).select(F.shiftrightunsigned(h, 64 - k).cast("int").alias("b"))
    level = (F.log2(F.col("count").cast("double")) * 2).cast("int").cast("bigint")
    levels = tokens.groupBy("b").count().select(F.shiftright("b", 3).alias("w"), F.call_function("shiftleft", level, F.col("b").bitwiseAND(F.lit(7)) * 8).alias("v"))
    return _util.constant(levels, 1 << (k - 3), lambda words: F.flatten(F.transform(words, lambda x: F.array(*[F.shiftrightunsigned(x, 8 * i).bitwiseAND(F.lit(127)).cast("tinyint") for i in range(8)]))), "ARRAY<TINYINT>")


def _parities(codes: Column) -> Column:
    """Bit i tells whether the number of codes that end in the six bits of i is odd."""
    return F.aggregate(codes, F.lit(0).cast("bigint"), lambda a, c: a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), c.bitwiseAND(F.lit(63)).cast("int"))))


def line_sets(lines: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, line_no, n, bits, wide, first): size of each line's set, parities of its tokens by group (wide: null but for large sets), and its prefix by rarity; written out."""
    k = _buckets(lines)
    levels, name = _rarity(lines, k)

    def code(h: Column) -> Column:
        level = F.coalesce(F.get(levels, F.shiftrightunsigned(h, 64 - k).cast("int")), F.lit(0).cast("tinyint"))  # never null, which keeps arrays of codes plain
        return F.shiftleft(level.cast("bigint"), _LEVEL_BIT).bitwiseOR(h.bitwiseAND(F.lit(_ALONE - 1)))

    hashes = F.array_distinct(F.transform(F.array_remove(F.split("norm", " "), ""), lambda t: F.xxhash64(t)))  # distinct before their levels are looked up
    codes = F.sort_array(F.transform(hashes, code))
    each = lines.select(*_KEY, codes.alias("codes"))  # costly and used more than once, so that the optimizer leaves it where it is
    n = F.size("codes")
    part = lambda i: _parities(F.filter("codes", lambda c: F.shiftright(c, 6).bitwiseAND(F.lit(3)) == i))
    words = [_parities(F.col("codes")).alias("bits"), F.when(n > LONG, F.struct(*[part(i).alias(w) for i, w in enumerate(_MORE, 1)])).alias("wide")]
    out = _util.cut(each.select(*_KEY, n.alias("n"), *words, F.slice("codes", F.lit(1), n - F.ceil(n * threshold - 1e-9).cast("int") + 1).alias("first")), "line-sets")
    _util.forget(lines.sparkSession, name)
    return out


def _need(na: Column, nb: Column, threshold: float) -> Column:
    """Tokens that two sets of these sizes must share."""
    return F.ceil((na + nb) * (threshold / (1 + threshold)) - 1e-9)


def _apart(a: str, b: str) -> Column:
    """Groups of tokens with another parity in two sets, each of which holds a token that is in one set only; a and b name the rows."""
    whole = F.col(f"{a}bits").bitwiseXOR(F.col(f"{b}bits"))
    more = [F.col(f"{a}wide.{w}").bitwiseXOR(F.col(f"{b}wide.{w}")) for w in _MORE]
    first = whole.bitwiseXOR(more[0]).bitwiseXOR(more[1]).bitwiseXOR(more[2])  # the first of the four words: together they give ``bits``
    return F.coalesce(F.bit_count(first) + F.bit_count(more[0]) + F.bit_count(more[1]) + F.bit_count(more[2]), F.bit_count(whole))


def _plausible(na: Column, nb: Column, apart: Column, threshold: float) -> Column:
    """Whether sizes and parities allow a match."""
    length = F.least(na, nb) >= F.greatest(na, nb) * threshold - 1e-9
    return length & (apart <= na + nb - 2 * _need(na, nb, threshold))


def _earlier(a: str, b: str) -> Column:
    """Whether line ``a`` stands before line ``b``; both name rows."""
    doc, line = (F.col(f"{a}doc_id"), F.col(f"{b}doc_id")), (F.col(f"{a}line_no"), F.col(f"{b}line_no"))
    return (doc[0] < doc[1]) | ((doc[0] == doc[1]) & (line[0] < line[1]))


def first_candidates(sets: DataFrame, threshold: float) -> DataFrame:
    """(a_doc, a_line, b_doc, b_line): for each line b the most alike of the earliest lines, CHOICES at most, of each of its SEEDS.

    Seeds are neighbours in the prefix, without tokens that stand in one line only; those with the smallest hashes, which similar lines choose alike.
    """
    live = sets.select(*_KEY, "n", "bits", "wide", _once(F.filter("first", lambda c: c >= _ALONE)).alias("live"))
    rest = F.greatest(F.size("live") - 1, F.lit(0))
    next_to = F.zip_with(F.slice("live", F.lit(1), rest), F.slice("live", F.lit(2), rest), lambda x, y: F.xxhash64(x, y))
    own = live.select(F.explode(F.slice(F.sort_array(F.when(F.size("live") > 1, next_to).otherwise(F.col("live"))), 1, SEEDS)).alias("seed"), *_KEY, "n", "bits", "wide")
    line, part = F.struct(*_KEY, "n", "bits", "wide"), F.xxhash64(*_KEY).bitwiseAND(F.lit(CHOICES - 1))
    # A window deals the lines out once, where a join with the earliest ones would make the seeds and deal them out twice.
    group = Window.partitionBy("seed")
    earliest = own.select("*", *[F.min(F.when(part == i, line)).over(group).alias(f"a{i}") for i in range(CHOICES)], F.count("*").over(group).alias("c")).filter("c > 1")
    met = earliest.select(*_KEY, "n", "bits", "wide", F.explode(F.array_compact(F.array(*[f"a{i}" for i in range(CHOICES)]))).alias("a"))
    apart = _apart("a.", "")
    met = met.filter(_earlier("a.", "") & _plausible(F.col("a.n"), F.col("n"), apart, threshold))
    best = met.groupBy(*_KEY).agg(F.min(F.struct(apart.alias("apart"), F.col("a.doc_id").alias("doc_id"), F.col("a.line_no").alias("line_no"))).alias("a"))
    return best.select(F.col("a.doc_id").alias("a_doc"), F.col("a.line_no").alias("a_line"), F.col("doc_id").alias("b_doc"), F.col("line_no").alias("b_line"))


def candidates(sets: DataFrame, matched: DataFrame, threshold: float) -> DataFrame:
    """(a_doc, a_line, b_doc, b_line): pairs, the earlier line first, that the filters leave of lines not in ``matched`` with all earlier ones; written out."""
    # Most lines a filter by hash knows to be unmatched; the others are looked up.
    maybe, name = _util.among(matched, F.xxhash64(*_KEY))
    one = F.lit(1).cast("bigint")
    known = sets.filter(maybe).join(matched.select(*_KEY, F.lit(0).cast("bigint").alias("open")), _KEY, "left").withColumn("open", F.coalesce("open", one))
    flagged = sets.filter(~maybe).withColumn("open", one).unionByName(known)
    low = F.lit(0xFFFFFFFF)
    p = flagged.select(*_KEY, "n", "open", "bits", "wide", "first", F.posexplode("first").alias("at", "code")).filter(F.col("code") >= _ALONE)
    before = F.get("first", F.col("at") - 1)
    prev = F.when(before >= _ALONE, before.bitwiseAND(low)).otherwise(F.lit(0).cast("bigint"))
    # Rows of the shuffle are many: the end of the token's hash (others that share it are candidates too), that of the token before it
    # (0: none) with the line's number, and size, position and openness in one number.
    token = F.shiftright(F.shiftleft("code", 32), 32).cast("int")
    place = F.shiftleft(F.col("line_no").cast("bigint"), 32).bitwiseOR(prev)
    about = F.shiftleft(F.col("n").cast("bigint"), 32).bitwiseOR(F.shiftleft(F.col("at").cast("bigint"), 1)).bitwiseOR(F.col("open"))
    p = p.select(token.alias("token"), "doc_id", place.alias("place"), about.alias("about"), "bits", "wide").repartition("token")
    half = lambda s, c: (F.shiftright(f"{s}{c}", 32), F.col(f"{s}{c}").bitwiseAND(low))
    at_of = lambda x: F.shiftright(x, 1)
    # The smaller set's prefix is cut to what it needs behind the shuffle that both sides read. A plain condition on one side would go
    # before it and part the two, so that these name the partition, and each below names both sides.
    n = F.shiftright("about", 32)
    short = n - at_of(F.col("about").bitwiseAND(low)) >= _need(n, n, threshold)
    a, b = p.filter(F.when(short, F.spark_partition_id()).otherwise(-1) >= 0).alias("a"), p.filter(F.spark_partition_id() >= 0).alias("b")
    (na, rest_a), (nb, rest_b), (line_a, prev_a), (line_b, prev_b) = half("a.", "about"), half("b.", "about"), half("a.", "place"), half("b.", "place")
    earlier = (F.col("a.doc_id") < F.col("b.doc_id")) | ((F.col("a.doc_id") == F.col("b.doc_id")) & (line_a < line_b))
    smaller = (na < nb) | ((na == nb) & earlier)
    positional = F.least(na - at_of(rest_a), nb - at_of(rest_b)) >= _need(na, nb, threshold)
    # Where the tokens before meet as well, so does the pair, with more tokens to come on both sides.
    starts = (prev_a != prev_b) | (prev_a == 0)
    later_open = F.when(earlier, rest_b).otherwise(rest_a).bitwiseAND(F.lit(1)) == 1
    # What costs least and tells most comes first: nearly all pairs that share a token end at their sizes or at the 64 parities.
    sizes = (na <= nb) & (na >= nb * threshold - 1e-9)
    parities = F.bit_count(F.col("a.bits").bitwiseXOR(F.col("b.bits"))) <= (na + nb) * ((1 - threshold) / (1 + threshold)) + 1e-6
    met = b.join(a, (F.col("a.token") == F.col("b.token")) & sizes & parities & starts & smaller & later_open & positional & _plausible(na, nb, _apart("a.", "b."), threshold))
    ends = {"a": (F.col("a.doc_id"), line_a.cast("int")), "b": (F.col("b.doc_id"), line_b.cast("int"))}
    turned = [F.when(earlier, ends[s][i]).otherwise(ends[o][i]).alias(f"{s}_{c}") for s, o in ("ab", "ba") for i, c in enumerate(("doc", "line"))]
    out = _util.cut(met.select(*turned).distinct(), "line-pairs")
    _util.forget(sets.sparkSession, name)
    return out


def verified(pairs: DataFrame, lines: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, line_no) of the later lines of candidate pairs whose tokens have a Jaccard similarity of ``threshold`` or more; written out.

    Only lines that are in a pair are dealt out, but for a few that a filter by hash lets through.
    """
    ends = pairs.select(F.col("a_doc").alias("doc_id"), F.col("a_line").alias("line_no")).unionByName(pairs.select(F.col("b_doc").alias("doc_id"), F.col("b_line").alias("line_no")))
    wanted, name = _util.among(ends, F.xxhash64(*_KEY))
    some = _util.cut(lines.filter(wanted), "paired-lines")  # both sides read it
    sides = pairs
    for s in ("a", "b"):
        sides = sides.join(some.select(F.col("doc_id").alias(f"{s}_doc"), F.col("line_no").alias(f"{s}_line"), F.col("norm").alias(s)), [f"{s}_doc", f"{s}_line"])
    sides = sides.select("b_doc", "b_line", F.inline(F.array(F.struct(_tokens(F.col("a")).alias("x"), _tokens(F.col("b")).alias("y")))))
    both = F.size(F.array_intersect("x", "y"))
    found = sides.filter(both >= (F.size("x") + F.size("y") - both) * threshold - 1e-9).select(F.col("b_doc").alias("doc_id"), F.col("b_line").alias("line_no")).distinct()
    out = _util.cut(found, "gone-lines")
    _util.forget(lines.sparkSession, name)
    _util.drop(some)
    return out


def later_matches(lines: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, line_no) of lines that match an earlier one."""
    sets = line_sets(lines, threshold)
    met = _util.cut(first_candidates(sets, threshold), "line-pairs")
    first = verified(met, lines, threshold)
    pairs = candidates(sets, first, threshold)
    rest = verified(pairs, lines, threshold)
    gone = _util.cut(first.unionByName(rest), "gone-lines")
    _util.drop(sets, met, first, pairs, rest)
    return gone


def kept_lines(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(doc_id, kept): the numbers (from 0, ascending) of the lines that stay, blank ones aside.

    A line goes if any earlier one, by doc_id and then line number, has a Jaccard similarity of ``threshold`` or more, whether
    that one stays or not. Tokens are runs of characters other than ASCII white space, in lower case.
    """
    lines = _util.cut(distinct_lines(_util.only(docs, "doc_id", "text").filter("doc_id is not null")), "lines")
    gone = later_matches(lines, threshold)
    maybe, name = _util.among(gone, F.xxhash64(*_KEY))
    places = lines.select(*_KEY)
    stay = places.filter(~maybe).unionByName(places.filter(maybe).join(gone, _KEY, "left_anti"))
    kept = _util.cut(stay.groupBy("doc_id").agg(F.array_sort(F.collect_set("line_no")).alias("kept")), "kept-lines")
    _util.forget(docs.sparkSession, name)
    _util.drop(lines, gone)
    return kept


def _full(parts: Column) -> Column:
    """Numbers of the lines that aren't blank."""
    return F.array_compact(F.transform(parts, lambda x, i: F.when(~_blank(x), i)))


def _parts(text: str = "text") -> Column:
    return F.coalesce(F.split(text, "\n"), F.array().cast("array<string>"))


def _gone(full: str, kept: str) -> Column:
    """Numbers of the lines that go; none in rows without an id."""
    none = F.array().cast("array<int>")
    return F.when(F.col("doc_id").isNull(), none).otherwise(F.array_except(full, F.coalesce(kept, none)))


def _once(value: Column) -> Column:
    """A generator of one row, so that ``value`` is made once and not once per use."""
    return F.explode(F.array(value))


def dedup_lines(docs: DataFrame, threshold: float = 0.8, emptied: bool = True) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``; other columns stay as they are.

    Blank lines and null texts stay. A document of which no line is left keeps its row, with what blank lines it has;
    without ``emptied`` such rows go, and those that had blank lines only stay.
    Rows without an id stay as they are. Rows that repeat an id count as one document: what holds for a line number in one
    of them holds in all.
    """
    kept = kept_lines(docs, threshold).select(F.col("doc_id").alias("__id"), F.col("kept").alias("__kept"))
    rows = docs.join(kept, docs["doc_id"] == kept["__id"], "left").select("*", _once(_parts()).alias("__parts"))
    rows = rows.select("*", _once(_full(F.col("__parts"))).alias("__full")).select("*", _once(_gone("__full", "__kept")).alias("__gone"))
    if not emptied:
        rows = rows.filter((F.size("__gone") == 0) | (F.size("__gone") < F.size("__full")))
    stay = F.array_except(F.sequence(F.lit(0), F.size("__parts") - 1), "__gone")
    text = F.when(F.size("__gone") == 0, F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("__parts", i)), "\n"))
    return rows.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def removed_lines(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(doc_id, n_lines, n_removed, removed): per document the numbers of the lines that go; null texts have no lines."""
    kept = kept_lines(docs, threshold)
    # What the lines are is told before the join, so that texts stay where they are.
    about = docs.select("doc_id", _once(_parts()).alias("parts")).select("doc_id", F.size("parts").alias("n_lines"), _full(F.col("parts")).alias("full"))
    rows = about.join(kept, "doc_id", "left").select("doc_id", "n_lines", _once(_gone("full", "kept")).alias("removed"))
    return rows.select("doc_id", "n_lines", F.size("removed").alias("n_removed"), "removed")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = removed_lines(_util.read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.array_join("removed", ",").alias("removed"))


#: The same by plain SQL: equal lines first, then pairs that share one of their rarest tokens.
SQL = r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
l AS (SELECT doc_id, i - 1 AS line_no, trim(regexp_replace(lower(ls[i]), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
f AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY doc_id, line_no) AS k FROM l WHERE norm <> ''),
s AS (SELECT doc_id, line_no, list_distinct(string_split(norm, ' ')) AS t FROM f WHERE k = 1),
x AS (SELECT doc_id, line_no, len(t) AS n, unnest(t) AS w FROM s),
c AS (SELECT w, count(*) AS df FROM x GROUP BY w),
o AS (SELECT x.*, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY df, w) AS p FROM x JOIN c USING (w)),
q AS (SELECT * FROM o WHERE p <= n - ceil(0.8 * n - 1e-9) + 1),
j AS (SELECT DISTINCT a.doc_id AS ad, a.line_no AS al, b.doc_id AS bd, b.line_no AS bl FROM q a JOIN q b ON a.w = b.w AND (a.doc_id < b.doc_id OR (a.doc_id = b.doc_id AND a.line_no < b.line_no)) WHERE least(a.n, b.n) >= 0.8 * greatest(a.n, b.n) - 1e-9),
v AS (SELECT bd, bl, len(a.t) + len(b.t) AS n, len(list_intersect(a.t, b.t)) AS c FROM j JOIN s a ON a.doc_id = ad AND a.line_no = al JOIN s b ON b.doc_id = bd AND b.line_no = bl),
g AS (SELECT DISTINCT bd AS doc_id, bl AS line_no FROM v WHERE c >= 0.8 * (n - c) - 1e-9 UNION SELECT doc_id, line_no FROM f WHERE k > 1),
r AS (SELECT doc_id, count(*) AS n_removed, string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY line_no) AS removed FROM g GROUP BY doc_id)
SELECT documents.doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed FROM documents LEFT JOIN r USING (doc_id)
"""
