"""Item ids in texts, links between items, document types, chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import ontology as O

#: Characters of a chunk, and those that a piece shares with the one before.
CHUNK, OVERLAP = 3500, 100


def family_regex(family: str) -> str:
    """Pattern of a family's ids: prefix and three digits or more, or prefix, words and a number."""
    if family == "US_PROSE":
        return r"(?:User Story|Story)\s+\d+\b"
    _, numeric, wordy = next(f for f in O.ID_FAMILIES if f[0] == family)
    return rf"(?:(?:{'|'.join(numeric)})-?\d{{3,}}|(?:{'|'.join(wordy)})[_-](?:[A-Za-z]+[_-])+\d+)\b"


_FAMILIES = [(f[0], re.compile(r"(?<![A-Za-z0-9])" + family_regex(f[0]), re.I)) for f in O.ID_FAMILIES]


def mentions(text: str | None) -> list[tuple[str, str, int]]:
    """(family, text, position) of ids in a text; where matches overlap, the family with precedence has it."""
    taken: list[tuple[int, int]] = []
    out = []
    for family, pattern in _FAMILIES:
        for m in pattern.finditer(text or ""):
            a, b = m.span()
            if all(b <= x or a >= y for x, y in taken):
                taken.append((a, b))
                out.append((family, m.group().strip(), a))
    return sorted(out, key=lambda x: x[2])


def find_mentions(items: DataFrame, text: str = "content") -> DataFrame:
    """Rows of ``items`` per mention, with family_of, mention and pos. Overlaps are resolved by rank, which takes more than one regular expression."""
    keep = [c for c in items.columns if c != text]
    schema = ", ".join(f"`{c}` {t}" for c, t in items.dtypes if c != text) + ", family_of string, mention string, pos int"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(*own, *m) for own, t in zip(f[keep].itertuples(index=False, name=None), f[text]) for m in mentions(t)]
            yield pd.DataFrame(rows, columns=[*keep, "family_of", "mention", "pos"])

    return items.mapInPandas(run, schema)


def canonical(c: Column) -> Column:
    return F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z0-9]", ""))


def link_items(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, broken references) between items (item_id, family, content, ord) by the ids that they mention.

    Of items with equal ids the last is linked to; an item's own id is no mention, and a repeated one counts once.
    """
    m = find_mentions(items.select("item_id", "family", "content")).withColumn("key", canonical(F.col("mention"))).filter(F.col("key") != canonical(F.col("item_id")))
    first = m.groupBy("item_id", "family", "key").agg(F.min_by("mention", "pos").alias("evidence"))
    known = items.groupBy(canonical(F.col("item_id")).alias("key")).agg(F.max_by(F.struct("item_id", "family"), "ord").alias("t"))
    j = first.join(known, "key", "left")
    rules = F.create_map(*[F.lit(x) for (a, b), t in O.LINK_TYPES.items() for x in (f"{a}>{b}", t)])
    kind = F.when(F.col("family") == F.col("t.family"), "REFERENCES").otherwise(F.coalesce(F.try_element_at(rules, F.concat_ws(">", "family", F.col("t.family"))), F.lit("RELATES_TO")))
    links = j.filter("t is not null").select(F.col("item_id").alias("source_id"), F.col("t.item_id").alias("target_id"), kind.alias("link_type"), "evidence")
    return links, j.filter("t is null").select(F.col("item_id").alias("source_id"), F.col("evidence").alias("referenced_text"))


def family_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, family, n): ids of each family in a text, each family counted by itself."""
    each = F.array(*[F.struct(F.lit(f[0]).alias("family"), F.regexp_count(text, F.lit("(?i)(?<![A-Za-z0-9])" + family_regex(f[0]))).alias("n")) for f in O.ID_FAMILIES])
    return docs.select("doc_id", F.explode(each).alias("x")).select("doc_id", "x.family", "x.n").filter("n > 0")


def detect_type(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, doc_type, score): 0.65 of the share of id families and 0.35 of the share of key words; UNKNOWN under 0.35, MIXED within 0.10 of the second."""
    counts = {f[0]: F.regexp_count(F.col(text), F.lit("(?i)(?<![A-Za-z0-9])" + family_regex(f[0]))) for f in O.ID_FAMILIES}
    low = F.lower(text)
    raw = {t: (sum((counts[f] for f in O.DOC_TYPE_FAMILIES[t]), F.lit(0)), sum((F.when(F.contains(low, F.lit(w)), 1).otherwise(0) for w in words), F.lit(0))) for t, words in O.DOC_TYPE_WORDS.items()}
    d = docs.select("doc_id", *[c.alias(f"{k}_{t}") for t, pair in raw.items() for k, c in zip(("i", "w"), pair)])
    ids, words = sum((F.col(f"i_{t}") for t in raw), F.lit(0)), sum((F.col(f"w_{t}") for t in raw), F.lit(0))
    share = lambda c, total: F.when(total > 0, c / total).otherwise(0.0)
    scores = F.array(*[F.struct((0.65 * share(F.col(f"i_{t}"), ids) + 0.35 * share(F.col(f"w_{t}"), words)).alias("s"), F.lit(t).alias("t")) for t in raw])
    d = d.withColumn("r", F.reverse(F.array_sort(scores)))
    best, second = F.col("r")[0], F.col("r")[1]
    kind = F.when(best["s"] < 0.35, "UNKNOWN").when(best["s"] - second["s"] < 0.10, "MIXED").otherwise(best["t"])
    return d.select("doc_id", kind.alias("doc_type"), F.round(best["s"], 4).alias("score"))


def completeness(pairs: DataFrame) -> DataFrame:
    """(doc_id, lost, ratio, flagged) for a text before and after rewriting: ids lost, words kept; flagged where ids are lost or under 0.6 of the words stay."""
    ids = F.array_distinct(F.transform(F.regexp_extract_all("before", F.lit(r"(?i)\b([A-Z]{1,4}-\d{3,})\b"), F.lit(1)), lambda x: F.upper(x)))
    lost = F.filter(ids, lambda x: ~F.contains(F.upper("after"), x))
    n = lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    ratio = F.when(n("before") > 0, F.round(n("after") / n("before"), 3)).otherwise(1.0)
    return pairs.select("doc_id", F.size(lost).alias("lost"), ratio.alias("ratio")).withColumn("flagged", (F.col("lost") > 0) | (F.col("ratio") < 0.6))


def split_text(text: str, size: int = CHUNK, overlap: int = OVERLAP, marks: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> list[str]:
    """Pieces of at most ``size`` characters, cut at the coarsest mark that does; a piece begins with up to ``overlap`` characters of whole parts of the last."""
    mark = next(m for m in marks if m == "" or m in text)
    rest = marks[marks.index(mark) + 1 :]
    parts = list(text) if mark == "" else [p for p in text.split(mark) if p]
    out: list[str] = []
    held: list[str] = []
    length = 0

    def close() -> None:
        nonlocal held, length
        if held and (piece := mark.join(held).strip()):
            out.append(piece)
        while held and (length > overlap):
            length -= len(held[0]) + (len(mark) if len(held) > 1 else 0)
            held = held[1:]

    for p in parts:
        if len(p) > size:
            close()
            held, length = [], 0
            out += split_text(p, size, overlap, rest)
            continue
        if held and length + len(mark) + len(p) > size:
            close()
            while held and length + len(mark) + len(p) > size:
                length -= len(held[0]) + (len(mark) if len(held) > 1 else 0)
                held = held[1:]
        length += len(p) + (len(mark) if held else 0)
        held.append(p)
    if held and (piece := mark.join(held).strip()):
        out.append(piece)
    return out


def chunks(items: DataFrame, size: int = CHUNK) -> DataFrame:
    """(doc_id, item_id, chunk_id, is_split, text): one chunk per item with content; longer ones in numbered pieces."""
    @F.pandas_udf("array<string>")
    def pieces(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_text(t, size))

    full = items.filter(F.trim(F.coalesce("content", F.lit(""))) != "").withColumn("is_split", F.length("content") > size)
    whole = full.filter("not is_split").select("doc_id", "item_id", F.col("item_id").alias("chunk_id"), "is_split", F.col("content").alias("text"))
    cut = full.filter("is_split").select("doc_id", "item_id", "is_split", F.posexplode(pieces("content")).alias("n", "text"))
    return whole.unionByName(cut.select("doc_id", "item_id", F.concat("item_id", F.lit("#"), F.col("n") + 1).alias("chunk_id"), "is_split", "text"))


def look_back(chunk: DataFrame) -> DataFrame:
    """Chunks (doc_id, item_id, ord, is_split, text) with the text before and whether it continues the same split item."""
    w = W.partitionBy("doc_id").orderBy("ord")
    return chunk.withColumn("previous", F.lag("text").over(w)).withColumn("continues", F.coalesce((F.lag("item_id").over(w) == F.col("item_id")) & F.col("is_split"), F.lit(False)))


def first_of_prefix(chunk: DataFrame, chars: int = 100) -> DataFrame:
    """The first chunk of each document among those with the same first ``chars`` characters."""
    w = W.partitionBy("doc_id", F.substring("text", 1, chars)).orderBy("ord")
    return chunk.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
