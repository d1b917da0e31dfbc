"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations alone.

Method. Texts are cut into words (lower case, ASCII signs and blanks separate). A
seed is a mask over ``SPAN`` consecutive words; the words at its set positions are
hashed, the others ignored, so that a substituted word spoils the seeds that select
it and no more. Seeds of the benchmark are joined with those of the documents at
every position. Each hit aligns an item with a document; around it, in a window of
``MARGIN`` words to both sides within the item, aligned words are compared, and the
hit counts if at least ``LEAST_MATCH`` of the window's words agree. Comparing also
removes hits that rest on equal hashes of different words.

The benchmark's seeds are broadcast in blocks of a bounded number of words, so that
the corpus is never shuffled: a benchmark beyond the bound takes several passes over
the documents. What is shuffled is verified hits, summed before they move.

Cases. Null and empty texts, items without words and null ids on either side give
no row. An item shorter than a seed's span is cut in as many pieces as leave one
unspoiled by the substitutions that ``LEAST_MATCH`` allows; these are its seeds, and
it is verified whole. One of fewer than eight words is sought as a whole, without
substitutions; items of fewer than ``least_words`` words say too little and are not
sought. A repeated
document id counts as one document, a repeated item likewise. Empty tables give an
empty result. Other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, without_ids

#: Set positions of the masks: 8 or 6 of 12 words. Any two substitutions among the 12 leave one mask whole.
MASKS = (
    (0, 1, 2, 3, 4, 5, 6, 7),
    (0, 1, 3, 4, 6, 8, 10, 11),
    (0, 2, 3, 5, 7, 8, 9, 11),
    (0, 1, 4, 5, 6, 9, 10, 11),
    (2, 6, 7, 8, 9, 10),
    (3, 4, 5, 8, 9, 11),
    (0, 1, 2, 4, 7, 11),
    (2, 3, 5, 6, 10, 11),
    (0, 1, 5, 8, 9, 10),
)
SPAN = 12
MARGIN = 4
LEAST_MATCH = 0.8
#: Words of the shortest items that are sought.
LEAST_WORDS = 5
#: Words of the shortest items in which words may differ.
LEAST_TOLERANT = 8
#: Words of benchmark items whose seeds are broadcast at once: with nine masks
#: some 40 MB of hash table.
BLOCK_WORDS = 90_000
SEPARATORS = "[^a-z0-9\\x{80}-\\x{10FFFF}]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), SEPARATORS), "")


def _hash(mask: int, columns: list[Column]) -> Column:
    return F.xxhash64(F.lit(mask), *columns)


def segments(n: int) -> list[tuple[int, int]]:
    """The seeds (start, words) of an item of ``n`` words, fewer than ``SPAN``."""
    pieces = 1 if n < LEAST_TOLERANT else n - math.ceil(round(LEAST_MATCH * n, 9)) + 1
    edges = [n * k // pieces for k in range(pieces + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _item_seeds(items: DataFrame, short: list[int]) -> DataFrame:
    """(seed, item, at): a row for each mask and position of each item (array ``w`` of word hashes), for each piece of a short one."""
    n = F.size("w")
    at = items.where(n >= SPAN).select("item", "w", F.explode(F.sequence(F.lit(0), n - SPAN)).alias("at"))
    seeds = [_hash(k, [F.get("w", F.col("at") + o) for o in mask]) for k, mask in enumerate(MASKS)]
    found = at.select(F.explode(F.array(*seeds)).alias("seed"), "item", "at")
    for length in short:
        pieces = [F.struct(_hash(100 + m, [F.get("w", F.lit(a + o)) for o in range(m)]).alias("seed"), F.lit(a).alias("at")) for a, m in segments(length)]
        of = items.where(n == length).select("item", F.explode(F.array(*pieces)).alias("s"))
        found = found.unionByName(of.select("s.seed", "item", "s.at"))
    return found.distinct()


def find_leaks(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, item_id, n_matched, n_compared): the best verified hit of each pair.

    Best is the hit with most matching words, then with fewest compared.
    """
    hashed = F.transform(words(F.col("text")), lambda w: F.xxhash64(w))
    items = benchmark.where("item_id is not null and text is not null").select("item_id", hashed.alias("w"))
    items = items.where(F.size("w") >= max(least_words, 1)).select(
        "item_id", "w", F.xxhash64("item_id", "w").alias("item")
    ).distinct()
    totals = items.agg(F.sum(F.size("w")).alias("n"), F.array_distinct(F.collect_set(F.least(F.size("w"), F.lit(SPAN)))).alias("s")).first()
    blocks = max(1, math.ceil((totals.n or 0) / block_words))
    short = sorted(n for n in totals.s if n < SPAN)
    pieces = [
        _block_hits(docs, items if blocks == 1 else items.where(F.pmod(F.col("item"), F.lit(blocks)) == b), hashed, short)
        for b in range(blocks)
    ]
    hits = pieces[0]
    for more in pieces[1:]:
        hits = hits.unionByName(more)
    # most matches, then fewest compared, in one number, so that sums stay plain
    best = F.max(F.col("n_matched") * 1000 - F.col("n_compared"))
    out = hits.groupBy("doc_id", "item_id").agg(best.alias("best"))
    matched = F.ceil(F.col("best") / 1000).cast("int")
    return out.select(
        "doc_id", "item_id", matched.alias("n_matched"), (matched * 1000 - F.col("best")).cast("int").alias("n_compared")
    )


def _block_hits(docs: DataFrame, items: DataFrame, hashed: Column, short: list[int]) -> DataFrame:
    """Verified hits of one block of items, a row each; ``short``: the items' numbers of words under ``SPAN``."""
    corpus = docs.where("doc_id is not null and text is not null").select("doc_id", hashed.alias("dw"))
    corpus = corpus.select("doc_id", "dw", F.explode(F.sequence(F.lit(0), F.size("dw"))).alias("p"))
    seeds = [_hash(k, [F.get("dw", F.col("p") + o) for o in mask]) for k, mask in enumerate(MASKS)]
    for m in sorted({m for n in short for _, m in segments(n)}):
        seeds.append(_hash(100 + m, [F.get("dw", F.col("p") + o) for o in range(m)]))
    corpus = corpus.select("doc_id", "dw", "p", F.explode(F.array(*seeds)).alias("seed"))
    hits = corpus.join(F.broadcast(_item_seeds(items, short)), "seed")
    hits = hits.join(F.broadcast(items.select("item", "item_id", "w")), "item")
    low = F.when(F.size("w") < SPAN, 0).otherwise(F.greatest(F.lit(0), F.col("at") - MARGIN))
    high = F.least(F.size("w"), F.col("at") + SPAN + MARGIN) - 1
    shift = F.col("p") - F.col("at")
    # compared word by word as rows that are summed at once, without a lambda: so it all
    # stays in the generated code of the join, and no row with a document's words leaves it
    hits = hits.select("doc_id", "item", "item_id", "at", shift.alias("shift"), "dw", "w", F.explode(F.sequence(low, high)).alias("q"))
    same = F.coalesce(F.get("dw", F.col("q") + F.col("shift")) == F.get("w", F.col("q")), F.lit(False))
    sums = hits.groupBy("doc_id", "item", "item_id", "at", "shift").agg(
        F.sum(same.cast("int")).alias("same"), F.count("*").alias("n"), F.min("q").alias("low"), F.max("q").alias("high")
    )
    compared = F.col("high") - F.col("low") + 1  # each mask that hits here has given as many rows
    found = sums.select("doc_id", "item_id", (F.col("same") * compared / F.col("n")).cast("int").alias("n_matched"), compared.alias("n_compared"))
    return found.where(F.col("n_matched") >= F.lit(LEAST_MATCH) * F.col("n_compared"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` without the documents that hold a passage of the benchmark."""
    leaks = materialize(find_leaks(docs, benchmark, least_words=least_words).select("doc_id").distinct(), "leaks")
    return without_ids(docs, leaks)


def oracle_sql() -> str:
    """The same by comparing every aligned word, without hashes (DuckDB)."""
    offsets = [f"({k}, {o}, {len(mask)})" for k, mask in enumerate(MASKS) for o in mask]
    tokens = "list_filter(regexp_split_to_array(lower(text), '[^a-z0-9\\x{80}-\\x{10FFFF}]+'), lambda x: x <> '')"
    return f"""
    WITH items AS (SELECT item_id, {tokens} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
    long_items AS (SELECT item_id, w, len(w) AS n FROM items WHERE len(w) >= {LEAST_WORDS}),
    iw AS (SELECT item_id, n, unnest(w) AS word, unnest(range(n)) AS q FROM long_items),
    d AS (SELECT doc_id, {tokens} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
    dw AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS p FROM d),
    m AS (SELECT doc_id, item_id, n, p - q AS shift, q FROM dw JOIN iw USING (word)),
    dense AS (
        SELECT doc_id, item_id, n, shift FROM m GROUP BY ALL
        HAVING count(*) >= CASE WHEN n < {LEAST_TOLERANT} THEN n WHEN n < {SPAN} THEN ceil({LEAST_MATCH} * n) ELSE {min(map(len, MASKS))} END
    ),
    kept AS (SELECT m.* FROM m SEMI JOIN dense USING (doc_id, item_id, shift)),
    masks(mask, o, weight) AS (VALUES {", ".join(offsets)}),
    seeds AS (
        SELECT DISTINCT doc_id, item_id, n, shift, q - o AS pos FROM kept, masks
        WHERE n >= {SPAN} AND q - o BETWEEN 0 AND n - {SPAN}
        GROUP BY doc_id, item_id, n, shift, mask, weight, q - o HAVING count(*) = weight
        UNION
        SELECT doc_id, item_id, n, shift, 0 AS pos FROM dense WHERE n < {SPAN}
    ),
    spans AS (
        SELECT *, greatest(0, pos - {MARGIN}) AS low, least(n, pos + {SPAN + MARGIN}) - 1 AS high FROM seeds
    ),
    hits AS (
        SELECT s.doc_id, s.item_id, s.shift, s.pos, count(*) AS n_matched, any_value(high - low + 1) AS n_compared
        FROM spans s JOIN kept k ON k.doc_id = s.doc_id AND k.item_id = s.item_id AND k.shift = s.shift
             AND k.q BETWEEN s.low AND s.high
        GROUP BY s.doc_id, s.item_id, s.shift, s.pos
    ),
    best AS (
        SELECT doc_id, item_id, max(n_matched * 1000 - n_compared) AS best FROM hits
        WHERE n_matched >= {LEAST_MATCH} * n_compared GROUP BY doc_id, item_id
    )
    SELECT doc_id, item_id, CAST(ceil(best / 1000.0) AS INTEGER) AS n_matched,
           CAST(ceil(best / 1000.0) * 1000 - best AS INTEGER) AS n_compared
    FROM best
    """
