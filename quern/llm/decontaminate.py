"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Words are the runs of letters and digits of the lower-cased text; in scripts that write without spaces each
letter is a word. A seed is the hash of the words at the
positions that a fixed mask keeps; the words between them may differ. Test seeds and document seeds are
joined, and around each hit the words are compared position by position: an overlap is a window of
WINDOW aligned words of which at least NEED agree. The masks are chosen so that every window with up to
WINDOW - NEED substituted words holds a seed whose kept positions all agree, so no overlap is missed.
Items of fewer than SPAN words hold no seed: the hash of all their words is joined with those of the document's
runs of as many words.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

MASKS = ((0, 1, 2, 5, 7, 8), (0, 2, 3, 4, 7, 8))
SPAN, WINDOW, NEED = 9, 13, 11
#: words before and after a seed's first word that a window around it can reach
BEFORE, AFTER = WINDOW - SPAN, WINDOW - 1
#: test seeds up to which they are sent to every executor (about 200 bytes each); beyond it both sides are shuffled
BROADCAST_SEEDS = 200_000
#: letters of scripts that write without spaces: Thai, Lao, Tibetan, Burmese, Khmer, kana, Bopomofo, Yi, Han
UNSPACED = r"[\u0E00-\u0FFF\u1000-\u109F\u1780-\u17FF\u2E80-\u312F\u31A0-\u31FF\u3400-\u4DBF\u4E00-\uA4CF\uF900-\uFAFF\uFF66-\uFF9F\x{20000}-\x{3FFFF}]"


def _words(text: Column) -> Column:
    text = F.coalesce(text.cast("string"), F.lit(""))
    # one range decides fast that a text has none of them
    spaced = F.when(text.rlike(r"[\u0E00-\x{3FFFF}]"), F.regexp_replace(text, UNSPACED, " $0 ")).otherwise(text)
    words = F.filter(F.split(F.lower(spaced), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _seed(mask: int, words: Column, at: Column) -> Column:
    return F.xxhash64(F.lit(mask), *(F.get(words, at + o) for o in MASKS[mask]))


def _positions(df: DataFrame) -> DataFrame:
    """A row for each position at which a mask fits."""
    # a condition on h before the rows are made would be moved down and compute the words twice
    return df.withColumn("at", F.explode_outer(F.expr(f"if(size(h) >= {SPAN}, sequence(0, size(h) - {SPAN}), null)"))).where("at is not null")


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, matched: the most agreeing words of a window, for each document and item that overlap.

    Items of fewer than NEED words must agree in full.
    Null and empty texts match nothing. Rows that repeat an id count as one text set of that id.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), _words(F.col("text")).alias("h"))
    seeds = _positions(items).select(
        "item_id",
        F.least(F.lit(NEED), F.size("h")).alias("need"),
        F.array(*(F.get("h", F.col("at") + o) for o in range(-BEFORE, AFTER + 1))).alias("around"),
        F.explode(F.array(*(_seed(m, F.col("h"), F.col("at")) for m in range(len(MASKS))))).alias("seed"),
    )
    seeds = cut(seeds)
    small = seeds.limit(BROADCAST_SEEDS + 1).count() <= BROADCAST_SEEDS
    here = _positions(docs.select(F.col("doc_id").cast("long").alias("doc_id"), _words(F.col("text")).alias("h")))
    here = here.select("doc_id", "h", "at", F.explode(F.array(*(_seed(m, F.col("h"), F.col("at")) for m in range(len(MASKS))))).alias("seed"))
    if small:
        hits = here.join(F.broadcast(seeds), "seed")
    else:  # only the words around a hit travel
        near = F.slice("h", F.greatest(F.col("at") - BEFORE, F.lit(0)) + 1, F.lit(BEFORE + AFTER + 1))
        here = here.select("doc_id", "seed", near.alias("h"), F.least(F.col("at"), F.lit(BEFORE)).alias("at"))
        hits = here.join(seeds, "seed")
    # one bit for each aligned position whose words agree
    equal = [F.coalesce((F.get("h", F.col("at") + (j - BEFORE)) == F.get("around", F.lit(j))).cast("int"), F.lit(0)) * (1 << j) for j in range(BEFORE + AFTER + 1)]
    hits = hits.select("doc_id", "item_id", "need", reduce(add, equal).alias("bits"))
    windows = [F.bit_count(F.shiftright("bits", s).bitwiseAND(F.lit((1 << WINDOW) - 1))) for s in range(BEFORE + 1)]
    # the comparison is asked of the groups: asked of the rows it would move into the join's condition, whose code is then too long to be compiled
    found = hits.groupBy("doc_id", "item_id", "need").agg(F.max(F.greatest(*windows)).cast("long").alias("matched"))
    found = found.where("matched >= need").select("doc_id", "item_id", "matched")
    short = _short_overlaps(docs, items)
    if short is not None:
        found = found.unionByName(short)
    return found.groupBy("doc_id", "item_id").agg(F.max("matched").alias("matched"))


def _runs(n: int) -> Column:
    """The hashes of all runs of n words."""
    runs = F.transform(F.sequence(F.lit(1), F.size("h") - (n - 1)), lambda at: F.xxhash64(F.lit(n), F.slice("h", at, n)))
    return F.when(F.size("h") >= n, runs).otherwise(F.array().cast("array<bigint>"))


def _short_overlaps(docs: DataFrame, items: DataFrame) -> DataFrame | None:
    """doc_id, item_id, matched of the items below SPAN words that stand in a document as a whole; None without such items."""
    items = items.where(F.size("h").between(1, SPAN - 1))
    lengths = {r["n"]: r["count"] for r in items.groupBy(F.size("h").alias("n")).count().collect()}
    if not lengths:
        return None
    items = items.select("item_id", F.size("h").cast("long").alias("matched"), F.xxhash64(F.size("h"), "h").alias("run")).distinct()
    runs = F.concat(*(_runs(n) for n in sorted(lengths)))
    here = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _words(F.col("text")).alias("h"))
    here = here.select("doc_id", F.explode(F.array_distinct(runs)).alias("run"))
    small = sum(lengths.values()) <= BROADCAST_SEEDS
    return here.join(F.broadcast(items) if small else items, "run").select("doc_id", "item_id", "matched")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_items, first_item, matched, contaminated for every row of docs (doc_id, text).

    n_items: benchmark items that the document overlaps; first_item: the least of them or null; matched:
    the most agreeing words of a window (0 without overlap). Empty tables give no overlaps.
    """
    found = overlaps(docs, benchmark).groupBy("doc_id").agg(F.count("*").alias("n_items"), F.min("item_id").alias("first_item"), F.max("matched").alias("matched"))
    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"))
        .join(found, "doc_id", "left")
        .select(
            "doc_id",
            F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
            "first_item",
            F.coalesce("matched", F.lit(0)).cast("long").alias("matched"),
            F.col("n_items").isNotNull().alias("contaminated"),
        )
    )


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _sql(name: str, key: str, source: str) -> str:
    return rf"""{name} AS (
  SELECT {key}, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS h FROM {source}
)"""


def _sql_seeds(name: str, key: str, source: str) -> str:
    ahead = ", ".join(f"lead(w, {o}) OVER p AS w{o}" for o in range(1, SPAN))
    one = " UNION ALL ".join(
        f"SELECT {key}, pos, concat_ws(' ', {m}, {', '.join(f'w{o}' if o else 'w' for o in mask)}) AS seed FROM {source}_at WHERE w{SPAN - 1} IS NOT NULL"
        for m, mask in enumerate(MASKS)
    )
    return f"""{source}_at AS (
  SELECT {key}, pos, w, {ahead}
  FROM (SELECT {key}, unnest(h) AS w, unnest(range(0, len(h))) AS pos FROM {source})
  WINDOW p AS (PARTITION BY {key} ORDER BY pos)
),
{name} AS ({one})"""


def oracle_parts(documents: str = "documents") -> str:
    """Common table expressions up to `found` (doc_id, n_items, first_item, matched)."""
    return f"""{_sql("doc_words", "doc_id", documents)},
{_sql("item_words", "item_id", "benchmark")},
{_sql_seeds("doc_seeds", "doc_id", "doc_words")},
{_sql_seeds("item_seeds", "item_id", "item_words")},
diagonals AS (
  SELECT doc_id, item_id, dw.h AS dh, iw.h AS ih, shift
  FROM (SELECT DISTINCT d.doc_id, i.item_id, d.pos - i.pos AS shift FROM doc_seeds d JOIN item_seeds i USING (seed))
  JOIN doc_words dw USING (doc_id) JOIN item_words iw USING (item_id)
),
scored AS (
  SELECT doc_id, item_id, len(ih) AS n,
    list_transform(range(-{WINDOW - 1}, len(ih)), lambda s: list_sum(list_transform(range(s, s + {WINDOW}),
      lambda i: CASE WHEN i >= 0 AND i < len(ih) AND i + shift >= 0 AND i + shift < len(dh) AND ih[i + 1] = dh[i + shift + 1] THEN 1 ELSE 0 END))) AS sums
  FROM diagonals
),
overlap AS (SELECT doc_id, item_id, max(list_max(sums)) AS matched FROM scored WHERE list_max(sums) >= least({NEED}, n) GROUP BY ALL),
found AS (SELECT doc_id, count(*) AS n_items, min(item_id) AS first_item, CAST(max(matched) AS BIGINT) AS matched FROM overlap GROUP BY doc_id)"""


ORACLE = f"""WITH {oracle_parts()}
SELECT d.doc_id, coalesce(n_items, 0) AS n_items, first_item, coalesce(matched, 0) AS matched, n_items IS NOT NULL AS contaminated
FROM documents d LEFT JOIN found USING (doc_id)"""
