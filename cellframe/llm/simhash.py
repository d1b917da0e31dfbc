"""SimHash near-duplicates: 64-bit fingerprints linked by a binary trie self-join.

Method. A fingerprint is the bitwise majority of the XXH64 hashes of a text's
word 3-grams. Two fingerprints link at ``max_bits`` differing bits or fewer. The
distinct fingerprints form a binary trie (sorted, a node is a range of rows); the
self-join walks pairs of nodes together, adds one where their next bits differ,
and drops a pair as soon as the sum exceeds the budget. To spread that walk over
tasks, each fingerprint goes to ``max_bits + 1`` subtries, by the bits of one of
as many equal blocks: two fingerprints within the budget agree on one block at
least (pigeonhole), so no link is lost. Within a task linked fingerprints are
merged, so what leaves it is at most one link for each row, never all pairs.

Cases. A null or empty text, or one of blanks only, has fingerprint zero and is
linked like any other. One or two words make a single shingle. Repeated rows are
separate rows with the same result. A null ``doc_id`` keeps its row and counts
for no component's name; where no document of a component has an id, the
component is null. An empty table gives an empty result. Columns beside
``doc_id`` and the text are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..links import components, join_hot, roots_of_pairs
from .blocks import deal, group_starts
from .common import map_rows, materialize, release, without_ids
from .passages import BANDS, SIMILARITY, link_paragraphs, minhash

SEED = 42
BITS = 64
#: Pairs of nodes are compared row by row once they span this many pairs of rows.
LEAF = 16
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_hashes(text: str | None, words: int = 3) -> np.ndarray:
    """XXH64 of the word n-grams of ``text``, repeats included."""
    w = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not w:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(w)
    if len(w) <= words:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = list(itertools.accumulate([len(x) + 1 for x in w]))
    starts = [0, *ends[: len(w) - words]]
    hashes = [digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[words - 1 :], strict=True)]
    return np.array(hashes, np.uint64)


def majority(h: np.ndarray) -> int:
    """Signed 64 bits: a bit is set that is in over half the hashes; of none it is zero."""
    if not len(h):
        return 0
    count = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 65_536):
        part = h[at : at + 65_536]
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
            axis=0, dtype=np.int64
        )
    return int(np.packbits(2 * count > len(h), bitorder="little").view(np.int64)[0])


def fingerprint(text: str | None, words: int = 3) -> int:
    """The fingerprint as a signed 64-bit integer: a bit is set in over half the hashes."""
    return majority(shingle_hashes(text, words))


def with_fingerprints(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with a column ``fingerprint`` (long; its 64 bits are the fingerprint's)."""

    def make():
        return lambda cols: [pa.array([fingerprint(t) for t in cols[0]], pa.int64())]

    return map_rows(docs, [text], T.StructType([T.StructField("fingerprint", T.LongType())]), make, keep)


def trie_pairs(
    values: np.ndarray, starts: np.ndarray, max_bits: int
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one group whose values differ in ``max_bits`` bits or fewer.

    ``values`` (uint64) are sorted within each group; ``starts`` has the first row
    of each. All groups are walked at once, a level of the trie at a time. A pair
    of nodes is two ranges of rows that share the bits above the level.
    """
    ends = np.append(starts[1:], len(values))
    many = ends - starts > 1
    a0, a1 = starts[many], ends[many]
    b0, b1 = a0, a1
    diff = np.zeros(len(a0), np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for bit in range(BITS - 1, -1, -1):
        if not len(a0):
            break
        small = (a1 - a0) * (b1 - b0) <= LEAF
        if small.any():
            found.append(_leaves(values, a0[small], a1[small], b0[small], b1[small], max_bits))
            a0, a1, b0, b1, diff = (x[~small] for x in (a0, a1, b0, b1, diff))
            if not len(a0):
                break
        zeros = np.zeros(len(values) + 1, np.int64)
        np.cumsum(1 - ((values >> np.uint64(bit)) & np.uint64(1)).astype(np.int64), out=zeros[1:])
        am, bm = a0 + zeros[a1] - zeros[a0], b0 + zeros[b1] - zeros[b0]
        own = a0 == b0
        rest = ~own
        parts = [
            (a0, am, b0, bm, diff),
            (am, a1, bm, b1, diff),
            (a0, am, bm, b1, diff + 1),
            (am[rest], a1[rest], b0[rest], bm[rest], diff[rest] + 1),
        ]
        a0, a1, b0, b1, diff = (np.concatenate(x) for x in zip(*parts, strict=True))
        live = (diff <= max_bits) & (a1 > a0) & (b1 > b0) & ~((a0 == b0) & (a1 - a0 == 1))
        a0, a1, b0, b1, diff = (x[live] for x in (a0, a1, b0, b1, diff))
    if len(a0):  # equal values
        found.append(_leaves(values, a0, a1, b0, b1, max_bits))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def _leaves(values, a0, a1, b0, b1, max_bits) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows of small pairs of nodes, compared by their differing bits."""
    na, nb = a1 - a0, b1 - b0
    n = na * nb
    at = np.repeat(np.arange(len(n)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    a, b = a0[at] + k // nb[at], b0[at] + k % nb[at]
    ok = a < b
    a, b = a[ok], b[ok]
    ok = np.bitwise_count(values[a] ^ values[b]) <= max_bits
    return a[ok], b[ok]


def _link_groups(max_bits: int):
    """For mapInArrow over dealt rows: (src, dst) links that keep each group's components."""

    def links(bucket, i, j, value) -> pa.RecordBatch:
        order = np.lexsort((value.view(np.uint64), j, i, bucket))
        bucket, i, j, value = bucket[order], i[order], j[order], value[order]
        a, b = trie_pairs(value.view(np.uint64), group_starts(bucket, i, j), max_bits)
        root = roots_of_pairs(len(value), a, b)
        src = np.flatnonzero(root != np.arange(len(value)))
        return pa.RecordBatch.from_arrays(
            [pa.array(value[src]), pa.array(value[root[src]])], names=["src", "dst"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        names = ("bucket", "i", "j", "value")
        for batch in batches:
            cols = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
            starts = group_starts(*cols[:3])
            if len(starts) and starts[-1] >= 50_000:  # whole groups that came so far
                yield links(*[c[: starts[-1]] for c in cols])
                cols = [c[starts[-1] :] for c in cols]
            rest = cols
        if rest is not None and len(rest[0]):
            yield links(*rest)

    return run


def link_fingerprints(distinct: DataFrame, max_bits: int = 3) -> DataFrame:
    """(src, dst) links between distinct values of ``fingerprint``.

    Not all pairs: enough that two fingerprints are connected by them exactly if
    they are by pairs of at most ``max_bits`` differing bits.
    """
    n = max_bits + 1
    fp = F.col("fingerprint")
    buckets = []
    for k in range(n):
        low, high = BITS * k // n, BITS * (k + 1) // n
        bits = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << (high - low)) - 1))
        buckets.append(F.shiftleft(F.lit(k).cast("long"), 56).bitwiseOR(bits))
    rows = distinct.select(fp.alias("value"), F.explode(F.array(*buckets)).alias("bucket"))
    dealt = deal(rows, "value").select("bucket", "i", "j", "value")
    return dealt.mapInArrow(_link_groups(max_bits), "src long, dst long")


def near_duplicates(
    prints: DataFrame, max_bits: int = 3, id_col: str = "doc_id"
) -> DataFrame:
    """``prints`` (id and ``fingerprint``, materialized) with ``component_id``.

    Exact copies share a fingerprint and are one node; ``component_id`` is the
    smallest id that links reach.
    """
    grouped = prints.groupBy("fingerprint").agg(F.min(id_col).alias("least"), F.count("*").alias("n"))
    classes = materialize(grouped, "classes")
    roots = components(link_fingerprints(classes.select("fingerprint"), max_bits))
    return _named(prints, classes, roots, "fingerprint")


def _named(prints: DataFrame, classes: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """``prints`` with ``component_id``; ``classes`` (key, least, n) are linked by ``roots`` (node, root)."""
    linked = classes.join(roots, classes[key] == roots.node).select(key, "least", "root")
    smallest = linked.groupBy("root").agg(F.min("least").alias("smallest"), F.count("*").alias("n"))
    named = join_hot(linked.select(key, "root"), smallest, "root", roots.count())
    names = classes.join(named, key, "left").select(
        key, F.coalesce("smallest", "least").alias("component_id"), "n"
    )
    names = materialize(names, "names")
    kept = [c for c in prints.columns if c != "component_id"]
    total = names.agg(F.sum("n")).first()[0] or 0
    return join_hot(prints.select(*kept), names, key, total).select(*kept, "component_id")


def hex_digits(fingerprint: Column) -> Column:
    """16 lowercase hexadecimal digits."""
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


def _xxh64_sql(rows: str, seed: int = SEED) -> str:
    """Common table expressions that hash ``rows`` (column ``s``, text) as ``hashed`` (``s``, ``h``), in DuckDB.

    XXH64 by its public definition, in 128-bit integers of which the low 64 bits count.
    """
    # The five primes of XXH64.
    p = [11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261]
    p1, p2, p3, p4, p5 = (f"{x}::UHUGEINT" for x in p)
    low = f"{2**64 - 1}::UHUGEINT"

    def turn(x: str, r: int) -> str:
        return f"(({x} * {1 << r}::UHUGEINT & {low}) | ({x} >> {64 - r}::UHUGEINT))"

    def mix(x: str) -> str:
        return f"({turn(f'({x} * {p2} & {low})', 31)} * {p1} & {low})"

    def word(at: str, size: int) -> str:
        """``size`` bytes from byte ``at``, the first one lowest: hex digits read backwards, halves of each byte swapped."""
        odd, even = int("F0" * size, 16), int("0F" * size, 16)
        v = f"('0x' || substr(back, 2 * (n - {at} - {size}) + 1, {2 * size}))::UBIGINT"
        return f"((({v} & {odd}::UBIGINT) >> 4) | (({v} & {even}::UBIGINT) << 4))::UHUGEINT"

    starts = [(seed + p[0] + p[1]) % 2**64, (seed + p[1]) % 2**64, seed, (seed - p[0]) % 2**64]
    lanes = ", ".join(
        f"list_reduce(list_transform(range(n // 32), lambda k: {word(f'(32 * k + {8 * i})', 8)}), "
        f"lambda a, x: {turn(f'((a + x * {p2}) & {low})', 31)} * {p1} & {low}, {start}::UHUGEINT) AS v{i}"
        for i, start in enumerate(starts)
    )
    merged = "(" + " + ".join(turn(f"v{i}", r) for i, r in enumerate((1, 7, 12, 18))) + f") & {low}"
    for i in range(4):
        merged = f"(xor({merged}, {mix(f'v{i}')}) * {p1} + {p4}) & {low}"
    rest = "(n - n % 32)"
    eights = f"list_transform(range(n % 32 // 8), lambda k: {word(f'({rest} + 8 * k)', 8)})"
    ones = f"list_transform(range(n % 4), lambda k: {word('(n - n % 4 + k)', 1)})"
    eight = turn(f"xor(a, {mix('x')})", 27)
    four = turn(f"xor(h, {word('(n - n % 8)', 4)} * {p1} & {low})", 23)
    one = turn(f"xor(a, x * {p5} & {low})", 11)
    return f"""
    bytes AS (SELECT s, hex(s) AS hx, strlen(s) AS n FROM ({rows})),
    back AS (SELECT s, n, reverse(hx) AS back, {seed}::UHUGEINT AS seed FROM bytes),
    lanes AS (SELECT *, {lanes} FROM back),
    begun AS (SELECT s, n, back, ((CASE WHEN n >= 32 THEN {merged} ELSE seed + {p5} END) + n::UHUGEINT) & {low} AS h FROM lanes),
    by_eight AS (SELECT s, n, back, list_reduce({eights}, lambda a, x: ({eight} * {p1} + {p4}) & {low}, h) AS h FROM begun),
    by_four AS (SELECT s, n, back, CASE WHEN n % 8 >= 4 THEN ({four} * {p2} + {p3}) & {low} ELSE h END AS h FROM by_eight),
    by_one AS (SELECT s, list_reduce({ones}, lambda a, x: {one} * {p1} & {low}, h) AS h FROM by_four),
    shaken AS (SELECT s, xor(h, h >> 33::UHUGEINT) * {p2} & {low} AS h FROM by_one),
    stirred AS (SELECT s, xor(h, h >> 29::UHUGEINT) * {p3} & {low} AS h FROM shaken),
    hashed AS (SELECT s, xor(h, h >> 32::UHUGEINT)::UBIGINT AS h FROM stirred)"""


def oracle_sql(words: int = 3, max_bits: int = 3) -> str:
    """Fingerprints and components by comparing all pairs and following links (DuckDB)."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    run = f"concat_ws(' ', w, {', '.join(f'lead(w, {i}) OVER o' for i in range(1, words))})"
    set_bits = ", ".join(f"sum((h >> {b}) & 1) AS b{b}" for b in range(BITS))
    value = " + ".join(f"CASE WHEN 2 * b{b} > n THEN {1 << b}::UHUGEINT ELSE 0 END" for b in range(BITS))
    return f"""
    WITH RECURSIVE docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
    words AS (
        SELECT row, unnest(w) AS w, generate_subscripts(w, 1) AS k, len(w) AS n
        FROM (SELECT row, regexp_extract_all(translate(text, '{upper}', '{upper.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM docs)
    ),
    runs AS (SELECT row, k, n, {run} AS s FROM words WINDOW o AS (PARTITION BY row ORDER BY k)),
    shingles AS (SELECT row, s FROM runs WHERE k <= greatest(n - {words - 1}, 1)),
    {_xxh64_sql("SELECT DISTINCT s FROM shingles")},
    counts AS (SELECT row, count(*) AS n, {set_bits} FROM shingles JOIN hashed USING (s) GROUP BY row),
    prints AS (SELECT doc_id, coalesce(({value})::UBIGINT, 0::UBIGINT) AS f FROM docs LEFT JOIN counts USING (row)),
    classes AS (SELECT f, min(doc_id) AS least FROM prints GROUP BY f),
    pairs AS (SELECT a.f AS a, b.f AS b FROM classes a JOIN classes b ON a.f <> b.f AND bit_count(xor(a.f, b.f)::BIT) <= {max_bits}),
    reach AS (SELECT f AS node, f AS seen FROM classes UNION SELECT r.node, p.b FROM reach r JOIN pairs p ON p.a = r.seen),
    named AS (SELECT node, min(least) AS component_id FROM reach JOIN classes ON f = seen GROUP BY node)
    SELECT doc_id, lpad(lower(hex(f)), 16, '0') AS fingerprint, component_id FROM prints JOIN named ON node = f
    """


def _units(words: int):
    """For map_rows: a text's shingle set as a hash, its fingerprint, MinHash bands and 32-bit shingles."""

    def work(cols: list[list]) -> list[pa.Array]:
        h, prints, sets = [], [], []
        for text in cols[0]:
            hashes = shingle_hashes(text, words)
            distinct = np.unique(hashes)
            h.append(xxhash.xxh64_intdigest(distinct.tobytes()))
            prints.append(majority(hashes))
            # no words: a set of one, so that such texts are copies of one another
            sets.append(np.unique(distinct.astype(np.uint32)) if len(distinct) else np.zeros(1, np.uint32))
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint32)
        edges = np.cumsum([0, *map(len, sets)])
        keys = minhash(flat, edges[:-1]) if sets else np.zeros((0, BANDS), np.int64)
        return [
            pa.array(np.array(h, np.uint64).view(np.int64)), pa.array(prints, pa.int64()),
            pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), pa.array(keys.ravel())),
            pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(flat.view(np.int32))),
        ]

    return lambda: work


_UNIT = T.StructType([
    T.StructField("h", T.LongType()), T.StructField("fingerprint", T.LongType()),
    T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("shingles", T.ArrayType(T.IntegerType())),
])


def near_copies(units: DataFrame, similarity: float = SIMILARITY, max_bits: int = 3) -> DataFrame:
    """``units`` (doc_id and the columns of ``_UNIT``, materialized) as (doc_id, h, component_id).

    Two texts link if the exact Jaccard similarity of their shingle sets is
    ``similarity`` or more. At 0.8 some 10 of 64 bits differ, a budget at which the
    trie join would compare nearly all pairs; so the candidates that the trie join
    finds within ``max_bits`` are joined by those of MinHash bands (which find a pair
    of similarity 0.8 with probability 0.991).
    """
    prints = units.groupBy("fingerprint").agg(F.min("h").alias("least"), F.max("h").alias("most"))
    prints = materialize(prints, "classes")
    links = link_fingerprints(prints.select("fingerprint"), max_bits)
    least = prints.select("fingerprint", "least")
    near = links.join(least.toDF("src", "a"), "src").join(least.toDF("dst", "b"), "dst").select("a", "b")
    # texts of one fingerprint that differ
    same = units.join(prints.where("least != most"), "fingerprint").where("h != least")
    pairs = near.unionByName(same.select(F.col("h").alias("a"), F.col("least").alias("b"))).where("a != b").distinct()
    found = link_paragraphs(units, similarity, materialize(pairs, "pairs"))
    release(units.sparkSession)
    classes = units.groupBy("h").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    return _named(units.select("doc_id", "h"), materialize(classes, "classes"), found, "h")


def deduplicate(docs: DataFrame, words: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each group of near copies (``near_copies``), the one with the smallest id.

    Rows are judged each by its own text: one goes if its group has a smaller id. Of
    rows of one group that share the smallest id one stays, the first by text, then by
    a hash of all columns that can be hashed; rows of one id in different groups are
    different documents. Rows without an id stay.
    """
    texts = docs.select("doc_id", "text")
    units = materialize(map_rows(texts, ["text"], _UNIT, _units(words), keep=["doc_id"]), "prints")
    found = materialize(near_copies(units, similarity).where("doc_id is not null"), "named")
    release(docs.sparkSession)
    many = F.count("*") > 1
    flagged = found.groupBy("doc_id").agg(many.alias("many"), F.max(F.col("doc_id") != F.col("component_id")).alias("gone"))
    flagged = materialize(flagged.where("many or gone"), "flagged")
    kept = without_ids(docs, flagged.select("doc_id"))
    twice = flagged.where("many").select("doc_id")
    if twice.isEmpty():
        return kept
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("doc_id"), F.col("text").alias("text"))
    rows = map_rows(rows.join(twice, "doc_id", "left_semi"), ["text"], _UNIT, _units(words), keep=["row", "doc_id"])
    stay = found.join(twice, "doc_id", "left_semi").where("doc_id = component_id").select(F.col("doc_id").alias("id"), F.col("h").alias("g")).distinct()
    rows = rows.join(stay, (F.col("doc_id") == F.col("id")) & (F.col("h") == F.col("g")))
    plain = [f"row.`{c}`" for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    order = F.struct(F.col("row.text"), F.xxhash64(*plain))
    again = rows.groupBy("doc_id").agg(F.min_by("row", order).alias("row"))
    return kept.unionByName(again.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns]))
