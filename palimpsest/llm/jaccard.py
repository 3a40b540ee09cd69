"""Exact n-gram Jaccard self-join by vertical partitioning.

The word n-grams of a document form a set of 64-bit hashes.  A global order on
the n-grams (rare before frequent, then by hash) is cut into fragments: the
frequent n-grams are the last one, the others are parted by hash range.  The
overlap of a pair is counted in each fragment on its own and summed per pair.

1. Documents with equal sets are one class; its smallest id stands for it.
2. Classes that agree in enough of a sketch form families around one root each,
   the member whose sketch is the most common.
   The overlap with the root, and the n-grams lost and added against it, are
   computed for every member: one row for each, no pairs inside a group.
3. Within a family, |x & y| = |root| - |lost x| - |lost y| + what x and y have
   lost or added in common.  Members that reach the threshold without anything
   in common both link to the root.  All others must share enough of their
   differences, so these short lists are joined, rare entries first, with the
   bounds that size and position give.
4. Between families, a pair with the wanted similarity shares n-grams in the
   prefixes of its sets under the global order.  Prefixes are joined, and a pair
   goes on only if what they share and what lies behind can reach the threshold.
5. Candidates of 3 and 4 are counted exactly, fragment by fragment; connected
   components come from alternating large and small stars.

Texts are hashed twice as a whole (sets and their sketches; prefixes) and a third
time where a family or a candidate pair needs them; no text crosses a shuffle
below ``broadcast_rows`` pairs.  A wrong guess about which n-grams are frequent
costs time, never a link: any global order is exact.  Broadcasts happen only
below a counted size; beyond it, the same joins shuffle.  Tables are dropped
when nothing reads them any more.

Cases: null or empty text, or text of white space, has an empty set and no
links; text with fewer words than n is one n-gram; an id that repeats is one
document, whose links come from its smallest text; a null id has no links and
a null component; similarities equal to the threshold link; very long texts are
hashed in pieces; only the id and the text are read, so further columns of any
name do no harm; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, released


@dataclass(frozen=True)
class Similarity:
    """n-gram length, threshold as a fraction, and the knobs of the plan."""

    ngram: int = 5
    numerator: int = 80
    denominator: int = 100
    #: The last fragment holds the frequent n-grams.
    fragments: int = 4
    #: A document joins the family of a root that agrees in this part of the sketch.
    sketches: int = 8
    agreement: float = 0.375
    #: Prefix n-grams put last in the order; only efficiency depends on it.
    frequent_bound: int = 200_000
    frequent_from: int = 8
    #: N-grams a task holds before it gives out those that it saw twice.
    counted_at_once: int = 1_000_000
    #: Rows of two longs that may be broadcast (16 MB); more are shuffled.
    broadcast_rows: int = 1_000_000


_FACTOR = np.uint64(0x9E3779B97F4A7C15)  # odd; its powers keep the order of words, and of bytes within one
_NONE = np.empty(0, np.uint64)
_SHORT = 64  # bytes of a word up to which its hash is a weighted sum; longer ones are rare
_BLOCK = 1 << 20  # bytes of a text that are hashed at once
SLICE_ROWS = 500  # rows whose n-gram sets a worker gives out together


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_IS_WORD = np.ones(256, bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_VALUE = _mix((_LOWER.astype(np.uint64) + np.uint64(1)) * _FACTOR)
_WEIGHT = np.multiply.accumulate(np.full(_SHORT, _FACTOR))


def _word_hashes(raw: bytes) -> np.ndarray:
    """One hash for each word of ``raw``, in order; A-Z count as a-z."""
    data = np.frombuffer(raw, np.uint8)
    inside = _IS_WORD[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    edge = np.concatenate(([0] * bool(inside[:1].any()), edge, [len(data)] * bool(inside[-1:].any()))).astype(np.int64)
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return _NONE
    lengths = ends - starts
    firsts = np.cumsum(lengths) - lengths
    offset = np.arange(int(lengths.sum())) - np.repeat(firsts, lengths)
    h = np.add.reduceat(_VALUE[data[inside]] * _WEIGHT[np.minimum(offset, _SHORT - 1)], firsts)
    h = _mix(h + lengths.astype(np.uint64))
    for k in np.flatnonzero(lengths > _SHORT):
        h[k] = xxhash.xxh3_64_intdigest(raw[starts[k] : ends[k]].lower())
    return h


def _blocks(raw: bytes):
    """``raw`` in pieces of about ``_BLOCK`` bytes, cut only at white space."""
    at = 0
    while len(raw) - at > _BLOCK:
        data = np.frombuffer(raw, np.uint8, offset=at + _BLOCK)
        gap = next((k + int(np.argmin(w)) for k in range(0, len(data), _BLOCK) if not (w := _IS_WORD[data[k : k + _BLOCK]]).all()), len(data))
        yield raw[at : at + _BLOCK + gap]
        at += _BLOCK + gap
    yield raw[at:]


def ngram_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams; A-Z are lower-cased, nothing else is."""
    h = np.concatenate([_word_hashes(b) for b in _blocks((text or "").encode("utf-8", "surrogatepass"))])
    if not len(h):
        return _NONE
    width = min(n, len(h))
    count = len(h) - width + 1
    total = np.full(count, width, np.uint64)
    for k, factor in enumerate(np.multiply.accumulate(np.full(width, _FACTOR))):
        total += h[k : k + count] * factor
    total = np.sort(_mix(total))
    return total[np.append(True, total[1:] != total[:-1])]


def _limit(n: int, sim: Similarity) -> int:
    """Prefix length of a set of n: n less the least overlap, plus one."""
    return n - (n * sim.numerator + sim.denominator - 1) // sim.denominator + 1


def _signatures(docs: DataFrame, sim: Similarity) -> DataFrame:
    """(doc_id, n, signature, sketch): one narrow row for every document; and (token, rows) with a null n.

    The sketch holds the smallest hash in each of ``sketches`` hash ranges,
    so two sets agree in a place with about the chance of their similarity.
    The other rows count the n-grams near the front of the hash order, in a
    window somewhat wider than the prefixes, that a task saw in two documents
    or more.  A common n-gram is so in most tasks; one that no task sees twice is rare.
    """

    def run(batches):
        edges = (np.arange(sim.sketches, dtype=np.uint64) << np.uint64(64 - sim.sketches.bit_length() + 1))
        names = ["doc_id", "n", "signature", "sketch", "token", "rows"]
        heads, held = [], 0

        def counted():
            tokens, counts = np.unique(np.concatenate([_NONE, *heads]).view(np.int64), return_counts=True)
            twice = counts > 1
            tokens, counts = tokens[twice], counts[twice]
            empty = [pa.nulls(len(tokens), kind) for kind in (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays([*empty, pa.array(tokens), pa.array(counts.astype(np.int64))], names)

        for batch in batches:
            sizes, marks, sketches = [], [], []
            for text in batch.column(1):
                s = ngram_set(text.as_py(), sim.ngram)
                at = np.searchsorted(s, edges)
                ends = np.append(at[1:], len(s))
                sizes.append(len(s))
                marks.append(xxhash.xxh3_128_digest(s.tobytes()))
                sketches.append([int(np.int64(s[a].view(np.int64))) if a < b else None for a, b in zip(at, ends, strict=True)])
                heads.append(s[: 4 + _limit(len(s), sim) * 8 // 5].copy())
                held += len(heads[-1])
                if held > sim.counted_at_once:
                    yield counted()
                    heads.clear()
                    held = 0
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(marks, pa.binary()), pa.array(sketches, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(sizes), pa.int64()), pa.nulls(len(sizes), pa.int64())], names)
        yield counted()

    return docs.mapInArrow(released(run), "doc_id long, n long, signature binary, sketch array<long>, token long, rows long")


def _frequent(counted: DataFrame, sim: Similarity) -> np.ndarray:
    """The most frequent n-grams of (token, rows), sorted; at most ``frequent_bound`` of them are kept."""
    seen = counted.groupBy("token").agg(F.sum("rows").alias("rows"))
    kept = seen.where(F.col("rows") >= sim.frequent_from).orderBy(F.desc("rows"), "token").limit(sim.frequent_bound).select("token")
    return np.sort(kept.toPandas()["token"].to_numpy(np.int64).view(np.uint64))


def _is_frequent(s: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    if not len(frequent):
        return np.zeros(len(s), bool)
    return frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] == s


def _hint(df: DataFrame, rows: int, sim: Similarity) -> DataFrame:
    """``df``, to be broadcast if its counted rows are few."""
    return F.broadcast(df) if rows <= sim.broadcast_rows else df


def _fragments(docs: DataFrame, pairs: DataFrame, sim: Similarity, frequent: np.ndarray, tables: Tables) -> DataFrame:
    """(x, y, nx, ny, a, b): for every pair and fragment of the global order, the n-grams of both sides, by hash.

    ``pairs`` is a written table.  Only n-grams move: those of x once for each
    of its pairs, those of y once.
    """
    edges = np.array([(k << 64) // (sim.fragments - 1) for k in range(1, sim.fragments - 1)], np.uint64)

    def cut(text):
        s = ngram_set(text.as_py(), sim.ngram)
        often = _is_frequent(s, frequent)
        rare = s[~often]
        return [part.tobytes() for part in [*np.split(rare, np.searchsorted(rare, edges)), s[often]]]

    def sides(count):
        """Rows of all columns but the text, once for each fragment."""

        def run(batches):
            last, parts = None, []
            for batch in (b.slice(k, SLICE_ROWS) for b in batches for k in range(0, b.num_rows, SLICE_ROWS)):
                out = []
                for key, text in zip(batch.column(0), batch.column(1), strict=True):
                    if last is None or not key.equals(last):  # the pairs of a document come one after the other
                        last, parts = key, cut(text)
                    out += parts
                n = batch.num_rows
                rows = pa.array(np.repeat(np.arange(n), sim.fragments))
                kept = [batch.column(k).take(rows) for k in (0, *range(2, 2 + count))]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(np.tile(np.arange(sim.fragments, dtype=np.int32), n)), pa.array(out, pa.binary())], names)

        names = ["key", *("y", "nx", "ny")[:count], "fragment", "part"]
        return run

    n = pairs.count()
    ids = tables.write(pairs.select(F.col("y").alias("doc_id")).distinct(), "jaccard-sides")
    left = docs.join(_hint(pairs.withColumnRenamed("x", "doc_id"), n, sim), "doc_id").select("doc_id", "text", "y", "nx", "ny")
    right = docs.join(_hint(ids, n, sim), "doc_id").select("doc_id", "text")
    left = left.mapInArrow(released(sides(3)), "key long, y long, nx long, ny long, fragment int, part binary").withColumnRenamed("key", "x").withColumnRenamed("part", "a")
    right = right.mapInArrow(released(sides(0)), "key long, fragment int, part binary").withColumnRenamed("key", "y").withColumnRenamed("part", "b")
    return left.hint("merge").join(right, ["y", "fragment"]).select("x", "y", "nx", "ny", "a", "b")


def _sides(batch: pa.RecordBatch):
    for a, b in zip(batch.column(4), batch.column(5), strict=True):
        a, b = a.as_py(), b.as_py()
        yield (np.frombuffer(a, np.uint64) if a else _NONE), (np.frombuffer(b, np.uint64) if b else _NONE)


def _overlaps(docs: DataFrame, pairs: DataFrame, sim: Similarity, frequent: np.ndarray, tables: Tables) -> DataFrame:
    """The pairs (x, y, nx, ny) whose similarity reaches the threshold."""

    def count(batches):
        for batch in batches:
            shared = [len(np.intersect1d(a, b, assume_unique=True)) for a, b in _sides(batch)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(shared, pa.int64())], ["x", "y", "nx", "ny", "shared"])

    partial = _fragments(docs, pairs, sim, frequent, tables).mapInArrow(released(count), "x long, y long, nx long, ny long, shared long")
    return partial.groupBy("x", "y", "nx", "ny").agg(F.sum("shared").alias("shared")).where(_enough(F.col("shared"), F.col("nx") + F.col("ny"), sim))


def _enough(shared, sizes, sim: Similarity):
    """shared / (sizes - shared) >= threshold, in whole numbers."""
    return shared * F.lit(sim.denominator + sim.numerator) >= F.lit(sim.numerator) * sizes


def _differences(docs: DataFrame, pairs: DataFrame, sim: Similarity, frequent: np.ndarray, tables: Tables) -> DataFrame:
    """(x, y, nx, ny, shared, lost, added): for every fragment, what x has, lacks and adds against y."""

    def compare(batches):
        kind = pa.list_(pa.int64())
        for batch in (b.slice(k, SLICE_ROWS) for b in batches for k in range(0, b.num_rows, SLICE_ROWS)):
            shared, lost, added = [], [], []
            for a, b in _sides(batch):
                out = np.setdiff1d(b, a, assume_unique=True)
                shared.append(len(b) - len(out))
                lost.append(out.view(np.int64))
                added.append(np.setdiff1d(a, b, assume_unique=True).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(shared, pa.int64()), pa.array(lost, kind), pa.array(added, kind)],
                ["x", "y", "nx", "ny", "shared", "lost", "added"],
            )

    return _fragments(docs, pairs, sim, frequent, tables).mapInArrow(
        released(compare), "x long, y long, nx long, ny long, shared long, lost array<long>, added array<long>"
    )


def _family_pairs(found: DataFrame, totals: DataFrame, sim: Similarity, tables: Tables) -> DataFrame:
    """Pairs of one family, of different components, that can reach the threshold by what they share against the root.

    ``totals`` has a row (x, y, nx, ny, l, part) for each member x of root y.
    Families of one member, or of one component, have no such pairs.
    """
    several = tables.write(totals.groupBy("y").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p < q").select("y"), "jaccard-several")
    found = found.join(_hint(several, several.count(), sim), "y", "left_semi")
    sign = F.explode(F.array(F.struct(F.lit(False).alias("plus"), F.col("lost").alias("t")), F.struct(F.lit(True).alias("plus"), F.col("added").alias("t"))))
    rows = found.select("x", "y", sign.alias("s")).select("x", "y", F.col("s.plus").alias("plus"), F.explode("s.t").alias("token"))
    often = tables.write(rows.groupBy("y", "plus", "token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "jaccard-often")
    rows = rows.join(_hint(often, often.count(), sim), ["y", "plus", "token"])
    own = Window.partitionBy("x")
    rows = rows.select("*", (F.row_number().over(own.orderBy("df", "plus", "token")) - 1).alias("at"), F.count(F.lit(1)).over(own).alias("c"))
    rows = rows.join(_hint(totals.drop("y"), totals.count(), sim), "x")
    # The least that x must share with any member is what it must share with a copy of the root.
    rows = rows.where(_enough(F.col("c") - F.col("at") + F.col("ny") - F.col("l"), F.col("nx") + F.col("ny"), sim))
    a, b = rows.alias("a"), rows.alias("b")
    most = F.least(F.col("a.c") - F.col("a.at"), F.col("b.c") - F.col("b.at")) + F.col("a.ny") - F.col("a.l") - F.col("b.l")
    return (
        a.join(b, (F.col("a.y") == F.col("b.y")) & (F.col("a.plus") == F.col("b.plus")) & (F.col("a.token") == F.col("b.token")))
        .where("a.x < b.x and a.part != b.part")
        .where(_enough(most, F.col("a.nx") + F.col("b.nx"), sim))
        .select(F.col("a.x").alias("x"), F.col("b.x").alias("y"), F.col("a.nx").alias("nx"), F.col("b.nx").alias("ny"))
        .distinct()
    )


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(id, component) for every node of the edges (x, y); component: its smallest node.

    Alternating large and small stars; each round is written to the shared
    folder, and the loop ends when a round leaves the edges as they were.
    """
    spark = edges.sparkSession
    tables = Tables(spark)
    now = tables.write(edges.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).where("u > v").distinct(), label)

    def mark(df):
        r = df.agg(F.count(F.lit(1)).alias("n"), F.sum((F.xxhash64("u", "v") % 1_000_003).cast("long")).alias("h")).first()
        return r["n"], r["h"]

    last = mark(now)
    while last[0]:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        rounds, tables = tables, Tables(spark)
        now = tables.write(small, label)
        rounds.drop()
        new = mark(now)
        if new == last:
            break
        last = new
    roots = now.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)


def _families(classes: DataFrame, sim: Similarity, tables: Tables) -> DataFrame:
    """(x, y, nx, ny): the root y of each class x that has one and is none."""
    places = classes.select("id", "n", F.posexplode("sketch").alias("place", "value")).where("value is not null")
    shared = tables.write(places.groupBy("place", "value").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"), "jaccard-shared")
    places = tables.write(places.join(_hint(shared, shared.count(), sim), ["place", "value"]), "jaccard-places")
    # The more common its sketch, the nearer a class is to what its family was made from.
    ranked = places.groupBy("id").agg(F.sum("rows").alias("weight"))
    ranked = tables.write(places.join(ranked, "id").select("id", "n", "place", "value", "weight"), "jaccard-ranked")
    heads = ranked.groupBy("place", "value").agg(F.max(F.struct("weight", (-F.col("id")).alias("id"), "n")).alias("head"))
    heads = tables.write(heads.select("place", "value", F.col("head.weight").alias("top"), (-F.col("head.id")).alias("y"), F.col("head.n").alias("ny")), "jaccard-heads")
    near = (
        ranked.join(_hint(heads, heads.count(), sim), ["place", "value"])
        .where("top > weight or top = weight and y < id")
        .groupBy(F.col("id").alias("x"), F.col("n").alias("nx"), "y", "ny", "top")
        .agg(F.count(F.lit(1)).alias("agree"))
        .where(f"agree >= least({sim.sketches}, nx, ny) * {sim.agreement}")
    )
    lead = near.groupBy("x").agg(F.max(F.struct("agree", "top", (-F.col("y")).alias("y"))).alias("b"))
    lead = tables.write(lead.select("x", (-F.col("b.y")).alias("y")), "jaccard-leaders")
    for _ in range(3):  # leaders of leaders; their weight rises, or the id falls, along the way
        above = lead.select(F.col("x").alias("y"), F.col("y").alias("z"))
        lead = lead.join(above, "y", "left").select("x", F.coalesce("z", "y").alias("y"))
    sizes = classes.select("id", "n")
    lead = lead.join(sizes.select(F.col("id").alias("x"), F.col("n").alias("nx")), "x").join(sizes.select(F.col("id").alias("y"), F.col("n").alias("ny")), "y")
    return tables.write(lead.select("x", "y", "nx", "ny"), "jaccard-families")


def near_duplicates(documents: DataFrame, sim: Similarity = Similarity(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``documents``; ids must be whole numbers."""
    if documents.schema[key].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"near_duplicates needs whole numbers in {key}: give texts a number of their own first")
    docs = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    tables = Tables(docs.sparkSession)
    written = tables.write(_signatures(docs, sim), "jaccard-signatures")
    frequent = _frequent(written.where("n is null"), sim)
    signed = rows = written.where("n is not null").drop("token", "rows")
    repeats = bool(signed.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").head(1))
    if repeats:
        docs = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min("text").alias("text"))
        signed = tables.write(_signatures(docs, sim).where("n is not null").drop("token", "rows"), "jaccard-signatures")
    usable = signed.where("n > 0 and doc_id is not null")
    classes = tables.write(
        usable.groupBy("signature").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch")),
        "jaccard-classes",
    )

    scratch = Tables(docs.sparkSession)
    lead = _families(classes, sim, scratch)
    found = scratch.write(_differences(docs, lead, sim, frequent, scratch), "jaccard-differences")
    totals = found.groupBy("x", "y", "nx", "ny").agg((F.col("ny") - F.sum("shared")).alias("l"))
    first = tables.write(totals.where(_enough(F.col("ny") - F.col("l"), F.col("nx") + F.col("ny"), sim)).select("x", "y"), "jaccard-links")
    grouped = components(first, "jaccard-stars").withColumnRenamed("component", "part")
    totals = totals.join(grouped.withColumnRenamed("id", "x"), "x", "left").withColumn("part", F.coalesce("part", "x"))
    within = tables.write(_family_pairs(found, scratch.write(totals, "jaccard-totals"), sim, scratch), "jaccard-within")

    # Prefix join between families.
    members = scratch.write(
        classes.select("id").join(grouped, "id", "left").join(lead.select(F.col("x").alias("id"), F.col("y").alias("root")), "id", "left")
        .select(F.col("id").alias("doc_id"), F.coalesce("part", "id").alias("part"), F.coalesce("root", "id").alias("family")),
        "jaccard-members",
    )
    tokens = _prefixes(docs, sim, frequent).join(_hint(members, members.count(), sim), "doc_id")
    tokens = tokens.select("doc_id", "part", "family", "n", F.posexplode("prefix").alias("at", "token"))
    a, b = tokens.alias("a"), tokens.alias("b")
    reach = F.least(F.col("a.n") - F.col("a.at"), F.col("b.n") - F.col("b.at"))
    # All that a pair shares up to the last of these places is counted, as both follow one order.
    behind = F.least(F.col("nx") - F.col("i"), F.col("ny") - F.col("j")) - 1
    between = (
        a.hint("merge").join(b, F.col("a.token") == F.col("b.token"))
        .where("a.doc_id < b.doc_id and a.part != b.part and a.family != b.family")
        .where(_enough(reach, F.col("a.n") + F.col("b.n"), sim))
        .groupBy(F.col("a.doc_id").alias("x"), F.col("b.doc_id").alias("y"), F.col("a.n").cast("long").alias("nx"), F.col("b.n").cast("long").alias("ny"))
        .agg(F.count(F.lit(1)).alias("c"), F.max("a.at").alias("i"), F.max("b.at").alias("j"))
        .where(_enough(F.col("c") + behind, F.col("nx") + F.col("ny"), sim))
        .select("x", "y", "nx", "ny")
    )
    pairs = tables.write(within.union(between).distinct(), "jaccard-pairs")
    scratch.drop()
    second = tables.write(_overlaps(docs, pairs, sim, frequent, tables).select("x", "y"), "jaccard-links")
    linked = components(first.union(second), "jaccard-stars")

    named = classes.select("signature", "id").join(linked, "id", "left").select("signature", F.coalesce("component", "id").alias("component_id"))
    if repeats:
        by_id = usable.select("doc_id", "signature").join(named, "signature").select("doc_id", "component_id")
        out = rows.join(by_id, "doc_id", "left")
    else:
        out = rows.withColumn("signature", F.when(F.col("n") > 0, F.col("signature"))).join(named, "signature", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def _prefixes(docs: DataFrame, sim: Similarity, frequent: np.ndarray) -> DataFrame:
    """(doc_id, n, prefix): the prefix of each set, rare n-grams first."""

    def run(batches):
        for batch in batches:
            tokens, sizes = [_NONE], []
            for text in batch.column(1):
                s = ngram_set(text.as_py(), sim.ngram)
                often = _is_frequent(s, frequent)
                tokens.append(np.concatenate((s[~often], s[often]))[: _limit(len(s), sim)])
                sizes.append(len(s))
            ends = np.cumsum([len(t) for t in tokens]).astype(np.int32)
            prefix = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(tokens).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), prefix], ["doc_id", "n", "prefix"])

    return docs.mapInArrow(released(run), "doc_id long, n int, prefix array<long>")
