"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints link at 2 or fewer differing bits. A 64-bit fingerprint is cut
into two halves, fewer than the three that would leave one untouched; of two
linked ones, one half differs by one bit at most. So each half is indexed 32
times, each time with one bit wiped out: linked fingerprints share such a
variant. Variants are compared by an equality-join and the pairs verified.

A variant shared by more than `most` different fingerprints isn't joined with
itself. Its fingerprints send themselves to all their one-bit neighbours
instead: two of them meet there exactly if they differ by 2 bits or fewer, and
no more than 65 can meet, so the links are the same without squares of groups.

Equal texts are one fingerprint throughout; links and components are made of
distinct fingerprints.

Defined cases: a null or empty text, or one of white space, has fingerprint
zero, linked like any other; null ids take part, and a component's id is its
smallest that isn't null.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .common import written
from .components import connected_components

#: Shingles hashed at once, so that a very long text needs no more memory.
CHUNK = 1 << 16
#: Of the long fingerprints: their 64-bit lanes, and the bits of a segment. And
#: the 64-bit words of the parities that go with them.
LANES, SEGMENT, PARITIES = 5, 20, 4


def shingle_hashes(text: str | None, words: int) -> Iterator[np.ndarray]:
    """XXH64 of a text's shingles, repeats included, CHUNK at a time."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return
    n = max(1, len(found) - words + 1)
    whole, end = b" ".join(found), np.cumsum([len(w) + 1 for w in found]) - 1
    start = np.concatenate(([0], end[:-1] + 1))
    starts, ends = start[:n].tolist(), end[min(words, len(found)) - 1 :].tolist()
    h = xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        yield np.array([h(whole[s:e], 42) for s, e in zip(starts[at : at + CHUNK], ends[at : at + CHUNK], strict=True)], dtype=np.uint64)


def bits_set(hashes: np.ndarray) -> np.ndarray:
    """In how many of the hashes each bit is 1, the highest bit first."""
    return np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)


def fingerprint(text: str | None, words: int = 3) -> int:
    """64-bit SimHash of the shingles, repeats included, as a signed long."""
    set_in, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, words):
        set_in, n = set_in + bits_set(hashes), n + len(hashes)
    return int(np.packbits(2 * set_in > n).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """id, fp (signed long) for every row; no shuffle."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([fingerprint(x.as_py(), words) for x in batch.column(1)], pa.int64())
            yield pa.record_batch([batch.column(0), fps], names=["id", "fp"])

    return rows.mapInArrow(made, f"id {rows.schema['id'].dataType.simpleString()}, fp bigint")


def half(fp: Column, k: Column) -> Column:
    return F.when(k == 0, F.shiftrightunsigned(fp, 32)).otherwise(fp.bitwiseAND(F.lit(0xFFFFFFFF)))


def variants(fps: DataFrame) -> DataFrame:
    """64 rows for each fp: variant (half, wiped bit, other bits) and fp."""
    out = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("v"))
    k, bit = F.shiftright("v", 5), F.col("v").bitwiseAND(F.lit(31))
    wiped = half(F.col("fp"), k).bitwiseAND(F.bitwise_not(F.expr("shiftleft(1L, v & 31)")))
    return out.select("fp", k.alias("k"), bit.alias("bit"), (F.col("v").cast("long") * F.lit(1 << 32)).bitwiseOR(wiped).alias("variant"))


def neighbours(fps: DataFrame) -> DataFrame:
    """65 rows for each fp: itself and the fingerprints one bit away."""
    out = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(64))).alias("v"))
    return out.select("fp", F.when(F.col("v") == 64, F.col("fp")).otherwise(F.col("fp").bitwiseXOR(F.expr("shiftleft(1L, v)"))).alias("near"))


def links(fps: DataFrame, most: int = 32) -> DataFrame:
    """Pairs a, b that connect all fingerprints that are linked. fps: distinct
    fp. Every pair differs by 2 bits or fewer; pairs that only hot variants
    hold are replaced by chains of such pairs through a shared one."""
    meet = Window.partitionBy("variant")
    shared = written(variants(fps).withColumn("n", F.count(F.lit(1)).over(meet)).filter("n > 1"), "simhash-shared")

    few = shared.filter(F.col("n") <= most)
    a, b = few.alias("a"), few.alias("b")
    differ = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    in_half = half(differ, F.col("a.k"))
    # halves that are equal share all variants of that half: one of them is enough
    once = (in_half != 0) | (F.col("a.bit") == 0)
    pairs = a.join(b, (F.col("a.variant") == F.col("b.variant")) & (F.col("a.fp") < F.col("b.fp"))).filter(once & (F.bit_count(differ) <= 2))

    # an fp of a hot variant may meet any other there; least() of those that share a neighbour stands for all of them
    hot = shared.filter(F.col("n") > most).select("fp").distinct()
    met = neighbours(hot).withColumn("least", F.min("fp").over(Window.partitionBy("near")))
    return pairs.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b")).union(met.filter("least < fp").select(F.col("least"), F.col("fp"))).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """id, fp (signed long), component (smallest id reachable) for every row."""
    fps = written(fingerprints(docs, id_col, text_col, words), "simhash")
    each = fps.groupBy("fp").agg(F.min("id").alias("first"))
    roots = connected_components(links(each.select("fp")))
    rooted = each.join(roots, each["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component"))
    classes = rooted.join(least, "root").select("fp", "component")
    return fps.join(classes, "fp").select(F.col("id").alias(id_col), "fp", "component")


def parities(hashes: np.ndarray) -> list[int]:
    """PARITIES * 64 bits, as signed longs: of each class of hashes, if their
    number is odd. Of two sets, no more bits differ than the sets have hashes
    that the other lacks."""
    odd = np.bincount((hashes % np.uint64(64 * PARITIES)).astype(np.int64), minlength=64 * PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view(">i8").tolist()


def wide_fingerprint(text: str | None, words: int) -> tuple[list[int], int, list[int]]:
    """LANES * 64 bits of SimHash over the distinct shingles, as signed longs,
    the number of shingles, and their parities. Each lane spreads the hashes anew."""
    parts = list(shingle_hashes(text, words))
    if not parts:
        return [0] * LANES, 0, [0] * PARITIES
    hashes, lanes = np.unique(np.concatenate(parts)), []
    for lane in range(LANES):
        set_in = np.zeros(64, np.int64)
        for at in range(0, len(hashes), CHUNK):
            x = hashes[at : at + CHUNK] * np.uint64(0x9E3779B97F4A7C15 + 2 * lane)
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            set_in += bits_set(x ^ (x >> np.uint64(32)))
        lanes.append(int(np.packbits(2 * set_in > len(hashes)).view(">i8")[0]))
    return lanes, len(hashes), parities(hashes)


def wide_fingerprints(rows: DataFrame, words: int) -> DataFrame:
    """rows: at, body. Returns at, w (lanes), n (shingles) and p (parities) for every row; no shuffle."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [wide_fingerprint(x.as_py(), words) for x in batch.column(1)]
            longs = lambda k: pa.array([f[k] for f in found], pa.list_(pa.int64()))  # noqa: B023,E731
            yield pa.record_batch([batch.column(0), longs(0), pa.array([f[1] for f in found], pa.int64()), longs(2)], names=["at", "w", "n", "p"])

    schema = StructType([rows.schema["at"], StructField("w", ArrayType(LongType())), StructField("n", LongType()), StructField("p", ArrayType(LongType()))])
    return rows.select("at", "body").mapInArrow(made, schema)


def may_be_similar(na: Column, pa: Column, nb: Column, pb: Column, similarity: float) -> Column:
    """False only where sets of na and nb hashes with these parities can't have
    that Jaccard similarity: more than a share of all hashes is in one alone."""
    differ = sum((F.bit_count(pa[k].bitwiseXOR(pb[k])) for k in range(PARITIES)), F.lit(0))
    return F.greatest(differ, F.abs(na - nb)) <= (1 - similarity) / (1 + similarity) * (na + nb) + 1e-6


def other_lanes() -> list[Column]:
    """The lanes of w but for the first, which is the node: w1 and so on."""
    return [F.col("w")[k].alias(f"w{k}") for k in range(1, LANES)]


def wide_variants(nodes: DataFrame, similarity: float) -> DataFrame:
    """nodes: node, w, n. One row for each segment of SEGMENT bits and each bit
    of it wiped out: variant, node, and the node's other lanes. Texts whose numbers of shingles can't give
    the similarity are mostly kept apart: a variant holds the band of fourfold
    sizes, and a text near a band's upper end stands in the next one too."""
    size = F.greatest("n", F.lit(1)).cast("double")
    band = lambda x: F.floor(F.log2(x) / 2).cast("bigint")
    own = nodes.select("node", "w", F.explode(F.array_distinct(F.array(band(size), band(size / similarity)))).alias("band"))
    per_lane = 64 // SEGMENT
    own = own.select("node", "w", "band", F.explode(F.sequence(F.lit(0), F.lit(LANES * per_lane - 1))).alias("s"))
    bits = F.expr(f"shiftrightunsigned(w[s div {per_lane}], cast(s % {per_lane} * {SEGMENT} as int))").bitwiseAND(F.lit((1 << SEGMENT) - 1))
    own = own.select("node", *other_lanes(), "band", "s", bits.alias("bits"), F.explode(F.sequence(F.lit(0), F.lit(SEGMENT - 1))).alias("bit"))
    wiped = F.col("bits").bitwiseAND(F.bitwise_not(F.expr("shiftleft(1L, bit)")))
    place = (F.col("band") * (LANES * per_lane) + F.col("s")) * SEGMENT + F.col("bit")
    return own.select((place * F.lit(1 << SEGMENT) + wiped).alias("variant"), "node", *(f"w{k}" for k in range(1, LANES)))


#: Nodes of a variant that all meet; of larger variants, each node meets the
#: first. And the first ones of its large variants that a node is compared with.
#: Both are about what is compared early; unlinked() compares all the rest.
ALL_MEET, CENTRES = 9, 3


class _Sharing:
    """Goes through a task's rows, which are sorted by variant. Nodes are near if
    they differ by most_bits or fewer; and where most_wide is given, their other
    lanes are too and all lanes differ by that many or fewer. (The first lane
    alone says little of two nodes that share a segment of it.)"""

    def __init__(self, most_bits: int, most_wide: int | None = None):
        self.most_bits, self.most_wide = most_bits, most_wide
        self.key, self.centre = None, None  # of the last variant, and its first node and that one's lanes if it's known to be large
        self.held, self.held_lanes = np.zeros(0, np.int64), None  # the last variant's nodes while it's small: it may go on

    def near(self, a: np.ndarray, b: np.ndarray, lanes_a: Callable, lanes_b: Callable) -> np.ndarray:
        differ = np.bitwise_count((a ^ b).view(np.uint64)).astype(np.int64)
        found = differ <= self.most_bits
        if self.most_wide is not None:
            at = np.flatnonzero(found)
            found[at] = differ[at] + np.bitwise_count((lanes_a(at) ^ lanes_b(at)).view(np.uint64)).sum(axis=1, dtype=np.int64) <= self.most_wide
        return found

    def rows(self, key: np.ndarray, node: np.ndarray, lanes: np.ndarray | None = None, end: bool = False) -> pa.RecordBatch:
        """Of variants with more than one node: variant, node, whom it meets, large,
        near (there's another node near it in the variant, or it's large). Where
        lanes are compared, rows without a near one don't go on."""
        lanes = np.zeros((len(key), 0 if self.most_wide is None else LANES - 1), np.int64) if lanes is None else lanes
        lanes = lanes if self.held_lanes is None else np.concatenate((self.held_lanes, lanes))
        key, node = np.concatenate((np.full(len(self.held), self.key or 0, np.int64), key)), np.concatenate((self.held, node))
        begins = np.flatnonzero(np.diff(key, prepend=key[:1] ^ 1))
        size = np.diff(np.append(begins, len(key)))
        group, first, first_lanes, large = np.repeat(np.arange(len(begins)), size), node[begins], lanes[begins], size > ALL_MEET
        if self.centre is not None and len(key) and key[0] == self.key:
            (first[0], first_lanes[0]), large[0] = self.centre, True
        told = len(key)
        if len(key):
            told = len(key) if end or large[-1] else int(begins[-1])
            self.key, self.centre = int(key[-1]), (int(first[-1]), first_lanes[-1]) if large[-1] else None
        self.held, self.held_lanes = node[told:], lanes[told:]
        rank = np.arange(len(key)) - begins[group]
        hot = large[group]
        is_told = np.arange(len(key)) < told
        i = np.flatnonzero(hot & is_told & (node != first[group]))
        i = i[self.near(node[i], first[group[i]], lambda x, i=i: lanes[i[x]], lambda x, i=i: first_lanes[group[i[x]]])]
        at, other, meets = [i], [first[group[i]]], hot.copy()
        for k in range(1, ALL_MEET):
            i = np.flatnonzero(~hot & is_told & (rank >= k))
            i = i[self.near(node[i], node[i - k], lambda x, i=i: lanes[i[x]], lambda x, i=i, k=k: lanes[i[x] - k])]
            at.append(i)
            other.append(node[i - k])
            meets[i], meets[i - k] = True, True
        at, other = np.concatenate(at), np.concatenate(other)
        by = np.argsort(at, kind="stable")
        kept = np.flatnonzero(is_told & (hot | (size[group] > 1)) & (meets | (self.most_wide is None)))
        ends = np.concatenate(([0], np.cumsum(np.bincount(at, minlength=len(key))[kept])))
        return pa.record_batch([pa.array(key[kept]), pa.array(node[kept]), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(other[by])), pa.array(hot[kept]), pa.array(meets[kept])], names=["variant", "node", "others", "large", "near"])


def shared(variants: DataFrame, most_bits: int, turn: int = 0, most_wide: int | None = None) -> DataFrame:
    """node, and of its variants that it shares with others: variants (the large
    ones, and those with a node near it), large (those of more than ALL_MEET
    nodes), few (the nodes that it meets in small ones), centres (CENTRES of the
    first nodes of its large ones, at most).

    First lanes of nodes that meet differ by most_bits or fewer, and all lanes by
    most_wide or fewer, if that's given; variants then have the other lanes too.
    Nodes have an order of the turn's own, the same in all variants, so that the
    large variants of one group of copies have few different first nodes. Rows
    are dealt by range, so that a variant with many nodes is worked on by many
    tasks."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _Sharing(most_bits, most_wide)
        for batch in batches:
            key, node, *lanes = (c.to_numpy() for c in batch.columns)
            yield own.rows(key, node, np.stack(lanes, axis=1) if lanes else None)
        yield own.rows(np.zeros(0, np.int64), np.zeros(0, np.int64), end=True)

    lanes = [] if most_wide is None else [f"w{k}" for k in range(1, LANES)]
    dealt = variants.select("variant", "node", *lanes).repartitionByRange("variant", "node").sortWithinPartitions("variant", F.xxhash64("node", F.lit(turn)), "node")
    rows = dealt.mapInArrow(told, "variant bigint, node bigint, others array<bigint>, large boolean, near boolean")
    centre = F.when(F.col("large"), F.get("others", F.lit(0)))
    least = [F.min(F.when(centre.isNotNull(), F.struct(F.xxhash64(centre, F.lit(turn), *[F.lit(k)] * (k > 0)), centre.alias("c"))))["c"] for k in range(CENTRES)]
    few = F.array_distinct(F.flatten(F.collect_list(F.when(~F.col("large"), F.col("others")))))
    return rows.groupBy("node").agg(F.collect_list(F.when(F.col("near"), F.col("variant"))).alias("variants"), F.collect_list(F.when(F.col("large"), F.col("variant"))).alias("large"), few.alias("few"), F.array_distinct(F.array_compact(F.array(*least))).alias("centres"))


def bits_for(similarity: float, bits: int, slack: float = 0.0) -> int:
    """How many of `bits` differ, on average, between texts of equal size with
    that Jaccard similarity; and `slack` standard deviations more."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(bits * p + slack * math.sqrt(bits * p * (1 - p)))


#: Rows of a table that are broadcast at most: 16 MB of numbers.
MOST_SENT = 1 << 20


def sized(rows: DataFrame) -> DataFrame:
    """A written table of numbers, to be broadcast if it's small; else Spark chooses."""
    return F.broadcast(rows) if rows.count() <= MOST_SENT else rows


def shingle_sets(rows: DataFrame, words: int) -> DataFrame:
    """tie and its text's distinct shingles, as hashes. rows: tie, body."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(np.concatenate([*shingle_hashes(x.as_py(), words), np.zeros(0, np.uint64)])).view(np.int64) for x in batch.column(1)]
            ends = np.concatenate(([0], np.cumsum([len(x) for x in sets])))
            yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets) if sets else []))], names=["tie", "s"])

    return rows.select("tie", "body").mapInArrow(made, "tie bigint, s array<bigint>")


def similar_only(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The rows of pairs whose texts, by their ties ta and tb, have shingles of
    that Jaccard similarity or more. Only texts of some pair are read."""
    asked = written(pairs.select(F.col("ta").alias("tie")).union(pairs.select("tb")).distinct(), "simhash-asked")
    sets = written(shingle_sets(texts.join(sized(asked), "tie"), words), "simhash-sets")
    both = pairs.join(sets.toDF("ta", "sa"), "ta").join(sets.toDF("tb", "sb"), "tb")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.filter(common + 1e-9 >= similarity * (F.size("sa") + F.size("sb") - common)).select(pairs.columns)


def verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs a, b of nodes whose texts are similar. Pairs whose fingerprints
    differ by far more bits than that gives aren't looked at further."""
    w = nodes.select("node", "w", "tie", "n", "p")
    both = pairs.join(w.toDF("a", "wa", "ta", "na", "pa"), "a").join(w.toDF("b", "wb", "tb", "nb", "pb"), "b")
    both = both.filter(may_be_similar(F.col("na"), F.col("pa"), F.col("nb"), F.col("pb"), similarity))
    differ = F.aggregate(F.zip_with("wa", "wb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    near = written(both.filter(differ <= bits_for(similarity, 64 * LANES, 4)).select("a", "b", "ta", "tb"), "simhash-near")
    return written(similar_only(near, texts, words, similarity).select("a", "b"), "simhash-links")


def in_groups(own: DataFrame, found: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """The rows of own with the group that the links found put their node in;
    and each node's link to its group, which connect the same and are soon read
    through when more are found."""
    if found is None:
        return own.withColumn("group", F.col("node")), None
    roots = connected_components(found)
    stars = roots.filter("node != root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    return own.join(roots, "node", "left").withColumn("group", F.coalesce("root", "node")).drop("root"), stars


def unlinked(grouped: DataFrame, most_bits: int, similarity: float) -> DataFrame:
    """grouped: node, group, w, n, p, variants. Pairs a, b of all nodes of
    different groups that share a variant and whose first lanes differ by
    most_bits or fewer, but for those that can't be similar.

    Of each variant, the nodes outside its largest group are joined with all of
    its nodes, so a large group isn't joined with itself. Segments that are equal
    share all of their variants, so the first bit's is enough for them: in the
    others a node only stays if a node of another group there differs in that bit."""
    per_lane = 64 // SEGMENT
    rows = grouped.select("node", "group", "w", "n", "p", F.explode("variants").alias("variant"))
    bit, s = F.expr(f"shiftright(variant, {SEGMENT}) % {SEGMENT}"), f"shiftright(variant, {SEGMENT}) div {SEGMENT} % {LANES * per_lane}"
    wiped = F.expr(f"shiftrightunsigned(w[cast({s} div {per_lane} as int)], cast({s} % {per_lane} * {SEGMENT} + shiftright(variant, {SEGMENT}) % {SEGMENT} as int)) & 1")
    rows = written(rows.select("variant", "node", "group", "n", "p", (bit == 0).alias("first_bit"), wiped.alias("wiped")), "simhash-shared")
    ones = F.count_if(F.col("wiped") == 1)
    each = rows.groupBy("variant", "group").agg(F.count(F.lit(1)).alias("size"), ones.alias("ones"))
    # of each bit's nodes, the least and the largest group
    ends = [f(F.when(has, F.col("group"))).alias(f"{name}{x}") for x, has in ((0, F.expr("size > ones")), (1, F.expr("ones > 0"))) for name, f in (("least", F.min), ("largest", F.max))]
    mixed = each.groupBy("variant").agg(F.max(F.struct("size", "group"))["group"].alias("main"), F.count(F.lit(1)).alias("groups"), *ends).filter("groups > 1")
    other = lambda x: F.coalesce((F.col(f"least{x}") != F.col("group")) | (F.col(f"largest{x}") != F.col("group")), F.lit(False))
    needed = F.col("first_bit") | F.when(F.col("wiped") == 1, other(0)).otherwise(other(1))
    left = rows.alias("r").join(mixed.alias("m"), (F.col("r.variant") == F.col("m.variant")) & needed)
    left = written(left.select("r.*", "main"), "simhash-unlinked")
    a, b = left.filter("group != main").alias("a"), left.alias("b")
    once = (F.col("a.wiped") != F.col("b.wiped")) | F.col("a.first_bit")
    apart = (F.col("a.group") < F.col("b.group")) | ((F.col("b.group") == F.col("b.main")) & (F.col("a.group") != F.col("b.group")))
    near = F.bit_count(F.col("a.node").bitwiseXOR(F.col("b.node"))) <= most_bits
    similar = may_be_similar(F.col("a.n"), F.col("a.p"), F.col("b.n"), F.col("b.p"), similarity)
    pairs = a.join(b, (F.col("a.variant") == F.col("b.variant")) & apart & near & once & similar)
    return pairs.select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")).distinct()


def similar_links(nodes: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """nodes: node (the first lane), w, n, p, tie. texts: tie, body. Pairs a, b of
    nodes that connect all that meet and are similar.

    At first only nodes of large variants meet, each a few first ones. What is
    linked then is one group, and each group stands in a variant with one node:
    so a group of many copies isn't compared pair by pair where its nodes share
    small variants too. Then the nodes of small variants all meet, and those of
    large ones meet first ones anew. That spares comparisons, but one node isn't
    its group: so at last all nodes that share a variant and aren't in one group
    yet are compared, with no limit."""
    most_bits, most_wide = bits_for(similarity, 64, 4), bits_for(similarity, 64 * LANES, 4)

    def linked(near: DataFrame, found: DataFrame | None) -> DataFrame | None:
        pairs = written(near, "simhash-pairs")
        if pairs.isEmpty():
            return found
        fresh = verified(pairs, nodes, texts, words, similarity)
        return fresh if found is None else found.union(fresh)

    ordered = lambda rows: rows.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    whole = written(shared(wide_variants(nodes, similarity), most_bits, 0, most_wide), "simhash-met")
    whole, found = whole.filter(F.size("variants") > 0), linked(ordered(whole.select("node", F.explode("centres").alias("other"))), None)
    grouped, found = in_groups(whole, found)
    each = grouped.select("node", "group", F.explode("variants").alias("variant")).groupBy("variant", "group")
    level = written(each.agg(F.min_by("node", F.xxhash64("node", F.lit(1))).alias("node")).select("variant", "node"), "simhash-level")
    own = shared(level.join(nodes.select("node", *other_lanes()), "node"), most_bits, 1, most_wide)
    found = linked(ordered(own.select("node", F.explode(F.array_union("centres", "few")).alias("other"))), found)
    rest, found = in_groups(whole.select("node", "variants").join(nodes.select("node", "w", "n", "p"), "node"), found)
    found = linked(unlinked(rest, most_bits, similarity), found)
    return nodes.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0) if found is None else found


def keep_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each group of texts with that Jaccard similarity of their word
    shingles, or more: the smallest by id (nulls last), a hash of the row's id and
    text, and a number that tells equal rows apart.

    Such texts differ in far more bits than deletion variants of halves allow, so
    fingerprints are LANES times as long and cut into segments of SEGMENT bits,
    and it's enough if one segment differs by one bit at most: a pair at exactly
    0.8 meets with a probability of 0.94, at 0.9 of 0.999. All texts that meet are
    linked if their shingles have the similarity, so none goes without a text that
    is similar, or a chain of such."""
    key = F.xxhash64(F.col(id_col).cast("string"), F.col(id_col).isNull(), F.col(text_col), F.col(text_col).isNull())
    numbered = written(docs.select(F.struct("*").alias("row"), key.alias("key"), F.monotonically_increasing_id().alias("tie")), "simhash-rows")
    id_of, text_of = F.col("row")[id_col], F.col("row")[text_col]
    at = F.struct(id_of.isNull().alias("none"), id_of.alias("id"), "key", "tie")
    fps = written(wide_fingerprints(numbered.select(at.alias("at"), text_of.alias("body")), words), "simhash")
    texts = numbered.select("tie", text_of.alias("body"))
    # a node is all that has its first lane: its least fingerprint, and the others there whose texts are similar to that one's
    first_lane, print_of = F.col("w")[0].alias("node"), F.struct("w", "n", "p").alias("x")
    prints = written(fps.groupBy(first_lane, print_of).agg(F.min("at").alias("first")), "simhash-prints")
    least = prints.groupBy("node").agg(F.min(F.struct("x", "first")).alias("m"))
    nodes = written(least.select("node", F.col("m.first").alias("first"), "m.x.w", "m.x.n", "m.x.p", F.col("m.first.tie").alias("tie")), "simhash-nodes")
    others = prints.join(nodes.select("node", F.col("tie").alias("ta")), "node").withColumn("tb", F.col("first.tie")).filter("ta != tb")
    members = nodes.select("node", F.struct("w", "n", "p").alias("x"), "first").union(similar_only(written(others, "simhash-others"), texts, words, similarity).select("node", "x", "first"))
    roots = connected_components(similar_links(nodes, texts, words, similarity))
    rooted = members.join(roots, "node", "left").select("node", F.xxhash64("x").alias("h"), "x", "first", F.coalesce("root", "node").alias("root"))
    winners = rooted.groupBy("root").agg(F.min("first").alias("winner"))
    groups = written(rooted.join(winners, "root").select("node", "h", "x", "winner"), "simhash-groups")
    rows = fps.select(first_lane, F.xxhash64(F.struct("w", "n", "p")).alias("h"), F.struct("w", "n", "p").alias("own"), "at").join(groups, ["node", "h"])
    losers = written(rows.filter((F.col("own") == F.col("x")) & (F.col("at") != F.col("winner"))).select("at.tie"), "simhash-losers")
    return numbered.join(sized(losers), "tie", "left_anti").select("row.*")
