"""Near-duplicate texts: MinHash bands find candidates, odd sketches and then whole shingle sets confirm them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluicebox.llm.common import list_array, map_batches, materialise_texts, release_arrow, schema_of, text_slices, with_possible
from sluicebox.llm.components import connected_components
from sluicebox.operators.sampling import first_rows
from sluicebox.session import materialise

SAMPLES = 192
#: Two texts that are just similar enough share no band with this probability at most; see :func:`banding`.
MISSED = 1e-6
SKETCH_BITS = 512
#: Members of a candidate cluster that are compared in one task are two blocks of about this many, or of about so many
#: bytes of shingle sets if that is less.
BLOCK, BLOCK_BYTES = 4096, 32 << 20
TILE, COLUMNS = 512, 16384
#: After a group of more bytes a task gives back the memory that Arrow keeps.
RELEASED_BYTES = 1 << 20
#: Rows that look up the same class or component are divided among so many tasks.
LANES = 64
#: Members of a cluster that all others meet first.
LEADERS = 256

M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)  # fixed values: a published 64-bit mixer
_random = np.random.default_rng(20240229)
ODD = _random.integers(0, 1 << 63, SAMPLES, np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _random.integers(0, 1 << 63, SAMPLES, np.uint64)
PLACE = _random.integers(0, 1 << 63, 4, np.uint64) * np.uint64(2) + np.uint64(1)

SIGNED = "n_shingles long, set_a long, set_b long, sketch array<long>, bands array<long>"


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def shingles(text: str, words: int) -> np.ndarray:
    """The distinct shingles of a whole text as sorted 64-bit numbers; a shorter text is one shingle."""
    found = text.encode().lower().split()  # of bytes: only A-Z, and only the white space of ASCII
    if not found:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    size = min(words, len(found))
    count = len(found) - size + 1
    total = np.full(count, size, np.uint64)
    for i in range(size):
        total = mix(total * M2 + hashes[i : i + count])
    return np.unique(total)


def least_samples(items: np.ndarray) -> np.ndarray:
    """The least value of the set under each of SAMPLES hash functions.

    A product and a sum alone would make the samples depend on each other; folding and multiplying again does not.
    """
    least = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(items), 256):
        values = np.multiply.outer(ODD, items[start : start + 256])
        values += ADD[:, None]
        values ^= values >> np.uint64(32)
        values *= M1
        values ^= values >> np.uint64(29)
        values *= M2
        np.minimum(least, values.min(axis=1), out=least)
    return least


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """A bitmap for each row of samples, in which a bit is the parity of the samples that fall on it."""
    place = mix(samples * PLACE[0] + np.arange(SAMPLES, dtype=np.uint64) * PLACE[1]) % np.uint64(SKETCH_BITS)
    rows = np.arange(len(samples), dtype=np.int64)[:, None] * SKETCH_BITS
    counts = np.bincount((rows + place.astype(np.int64)).ravel(), minlength=len(samples) * SKETCH_BITS)
    bits = (counts & 1).astype(np.uint8).reshape(len(samples), SKETCH_BITS)
    return np.packbits(bits, axis=1).view(np.int64)


def banding(percent: int) -> tuple[int, int]:
    """Bands, and samples a band, for sets that are ``percent`` similar: as selective as MISSED allows.

    32 bands of 6 at 85 %, which miss 3 in 10 million pairs just at the threshold, and 38 of 5 at 80 %, as many. Below
    7 % even bands of one sample miss more than MISSED, which is an error.
    """
    for rows in range(SAMPLES, 0, -1):
        bands = SAMPLES // rows
        if (1 - (percent / 100) ** rows) ** bands <= MISSED:
            return bands, rows
    raise ValueError(f"{SAMPLES} samples cannot find sets that are only {percent} % similar")


def band_keys(samples: np.ndarray, bands: int, size: int) -> np.ndarray:
    keys = np.broadcast_to(np.arange(bands, dtype=np.uint64) * PLACE[2], (len(samples), bands)).copy()
    parts = samples[:, : bands * size].reshape(len(samples), bands, size)
    for i in range(size):
        keys = mix(keys * PLACE[3] + parts[:, :, i])
    return keys.view(np.int64)


def sketch_limit(percent: int) -> int:
    """The greatest distance of two sketches whose sets may be ``percent`` similar.

    Of the samples of such sets fewer than the mean less six standard deviations agree with a probability of about one
    in a billion; the same holds for the bits on which the others may fall, beyond four.
    """
    share = percent / 100
    differ = 2 * (SAMPLES * (1 - share) + 6 * np.sqrt(SAMPLES * share * (1 - share)))
    odd = SKETCH_BITS / 2 * (1 - np.exp(-2 * differ / SKETCH_BITS))
    return int(np.ceil(odd + 4 * np.sqrt(odd)))


def signatures(docs: DataFrame, key: str, text: str, words: int, percent: int) -> DataFrame:
    """Key, text checksum, set size, a 128-bit name of the set, odd sketch and band keys of each text."""
    bands, size = banding(percent)
    ddl = f"`{key}` {docs.schema[key].dataType.simpleString()}, text_hash long, {SIGNED}"
    arrow = schema_of(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, text):
            sets = [shingles(t or "", words) for t in batch.column(text).to_pylist()]
            samples = np.array([least_samples(s) for s in sets], np.uint64).reshape(-1, SAMPLES)
            made = [
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([int(s.sum().view(np.int64)) for s in sets], pa.int64()),
                pa.array([int(mix(s).sum().view(np.int64)) for s in sets], pa.int64()),
                list_array(list(odd_sketches(samples)), pa.int64()),
                list_array(list(band_keys(samples, bands, size)), pa.int64()),
            ]
            columns = [batch.column(key), batch.column("text_hash"), *made]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    hashed = docs.select(key, F.xxhash64(text).alias("text_hash"), text)
    return map_batches(hashed, run, ddl)


def shingle_sets(named: DataFrame, words: int) -> DataFrame:
    """``set_a``, cluster columns and the whole shingle set of each row's text."""
    names = [c for c in named.columns if c != "text"]
    ddl = ", ".join(f"{n} {named.schema[n].dataType.simpleString()}" for n in names) + ", items array<long>"
    arrow = schema_of(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            sets = [shingles(t or "", words).view(np.int64) for t in batch.column("text").to_pylist()]
            columns = [*(batch.column(n) for n in names), list_array(sets, pa.int64())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return map_batches(named, run, ddl)


class Forest:
    """Labels of connected members; merging two labels says that an edge is new."""

    def __init__(self, known: np.ndarray):
        self.label = np.unique(known, return_inverse=True)[1]

    def merge(self, a: int, b: int) -> None:
        old, new = self.label[a], self.label[b]
        self.label[self.label == old] = new


def shared_counts(left: list[np.ndarray], right: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """The sizes of the intersections of all left with all right sets; zero where ``pairs`` is false."""
    counts = np.zeros(pairs.shape, np.int64)
    at = np.argwhere(pairs)
    if len(at) <= 4 * TILE:
        for i, j in at:
            counts[i, j] = len(np.intersect1d(left[i], right[j], assume_unique=True))
        return counts
    common = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)))
    for start in range(0, len(common), COLUMNS):
        part = common[start : start + COLUMNS]
        sides = []
        for sets in (left, right):
            matrix = np.zeros((len(sets), len(part)), np.float32)
            for i, s in enumerate(sets):
                inside = s[np.searchsorted(s, part[0]) : np.searchsorted(s, part[-1], "right")]
                place = np.searchsorted(part, inside)
                matrix[i, place[part[place] == inside]] = 1
            sides.append(matrix)
        counts += (sides[0] @ sides[1].T).astype(np.int64)
    return counts


def linked_pairs(
    sets: list[np.ndarray],
    sketches: np.ndarray,
    first: np.ndarray,
    second: np.ndarray,
    percent: int,
    known: np.ndarray,
) -> list[tuple[int, int]]:
    """A forest that connects what the links between the members ``first`` and ``second`` connect.

    Members with the same label in ``known`` are connected already.
    """
    limit, sizes = sketch_limit(percent), np.array([len(s) for s in sets], np.int64)
    forest, edges = Forest(known), []
    for a in range(0, len(first), TILE):
        left = first[a : a + TILE]
        for b in range(0, len(second), TILE):
            right = second[b : b + TILE]
            if first is second and b < a:
                continue
            distance = np.zeros((len(left), len(right)), np.uint16)
            for word in range(sketches.shape[1]):
                distance += np.bitwise_count(sketches[left, word][:, None] ^ sketches[right, word][None, :])
            sums = sizes[left][:, None] + sizes[right][None, :]
            least = np.minimum(sizes[left][:, None], sizes[right][None, :])
            near = (distance <= limit) & (100 * least >= percent * (sums - least))
            near &= forest.label[left][:, None] != forest.label[right][None, :]
            if not near.any():
                continue
            shared = shared_counts([sets[i] for i in left], [sets[j] for j in right], near)
            links = near & (100 * shared >= percent * (sums - shared))
            for row in np.flatnonzero(links.any(axis=1)):
                i = left[row]
                for j in right[links[row]]:
                    if forest.label[i] != forest.label[j]:
                        forest.merge(i, j)
                        edges.append((int(i), int(j)))
    return edges


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80
) -> DataFrame:
    """``key``, ``text_hash``, ``n_shingles``, ``component_id`` and ``kept`` for every row.

    Two texts are linked if their sets of ``words``-word shingles have 100 * intersection >= ``percent`` * union. The
    component is the smallest key that links reach, the key itself included; ``kept`` marks the rows with that key.

    1. Each text's set gives a size, a name, an odd sketch and band keys. Equal sets are one class, so that a third of
       all rows being copies is one row from here on.
    2. Classes that share a band are joined through the band's least member, never in pairs: clusters of candidates.
    3. Only texts of clusters are read again for their whole sets. Two blocks of about BLOCK members or BLOCK_BYTES meet
       in a task, which compares all their sketches and then the sets of the pairs that the sketches leave. It returns a forest of
       the links, at most one row a member, not the pairs. See :func:`confirmed_links` for which blocks have to meet.
    4. Components of these links.

    A null text, or one without words, has no shingles and is linked with nothing. Rows with the same key are separate
    texts; a null key is never the smallest unless all are null. An empty table gives no row.
    """
    signed = materialise_texts(signatures(docs, key, text, words, percent), "signatures")
    name = ["set_a", "set_b"]
    some = F.struct("sketch", "bands", F.col(key).alias("key"), "text_hash")
    classes = materialise(
        signed.where("n_shingles > 0")
        .groupBy(*name)
        .agg(F.min(key).alias("least_key"), F.first(some).alias("some"))
        .select("set_a", "least_key", "some.*"),
        "classes",
    )
    clusters = candidate_clusters(classes)
    links = materialise(confirmed_links(docs, classes, clusters, key, text, words, percent), "links")
    roots = connected_components(links).select(F.col("node").alias("set_a"), "root")
    joined = classes.select("set_a", "least_key").join(roots, "set_a")
    components = joined.groupBy("root").agg(F.min("least_key").alias("component_id"))
    linked = looked_up(joined, components, "root").select("set_a", "component_id")
    whole = classes.select("set_a", "least_key").join(linked, "set_a", "left")
    of_class = whole.select("set_a", F.coalesce("component_id", "least_key").alias("component_id"))
    rows = looked_up(signed.where("n_shingles > 0").select(key, "text_hash", "n_shingles", "set_a"), of_class, "set_a")
    empty = signed.where("n_shingles = 0").select(key, "text_hash", "n_shingles", F.col(key).alias("component_id"))
    every = rows.select(key, "text_hash", "n_shingles", "component_id").unionByName(empty)
    return every.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


def looked_up(rows: DataFrame, table: DataFrame, by: str) -> DataFrame:
    """Join rows with the one row that ``table`` has for their value of ``by``.

    A value of many rows is divided by a hash of the row into LANES lanes, and the table's row is copied only to those
    lanes that hold one.
    """
    dealt = rows.withColumn("LANE", F.pmod(F.xxhash64(*rows.columns), F.lit(LANES)))
    lanes = dealt.select(by, "LANE").distinct().join(table, by)
    return dealt.join(lanes, [by, "LANE"]).drop("LANE")


def blocks(members: str, size: str) -> Column:
    """Over how many blocks a cluster's members, and the bytes of their sets, are to be spread."""
    return F.ceil(F.greatest(F.col(members) / BLOCK, F.col(size) * 8 / BLOCK_BYTES, F.lit(1))).cast("int")


def candidate_clusters(classes: DataFrame) -> DataFrame:
    """``node``, a class, and ``root``, its cluster, for the classes that share a band with another one."""
    members = classes.select("set_a", F.explode("bands").alias("band"))
    bands = members.groupBy("band").agg(F.min("set_a").alias("least"), F.count(F.lit(1)).alias("n"))
    shared = materialise(bands.where("n > 1").drop("n"), "bands")
    met = with_possible(members, shared, ["band"]).where("POSSIBLE").drop("POSSIBLE")
    edges = met.join(shared, "band").where("set_a <> least")
    return materialise(connected_components(edges.select(F.col("set_a").alias("u"), F.col("least").alias("v"))), "clusters")


def confirmed_links(
    docs: DataFrame, classes: DataFrame, clusters: DataFrame, key: str, text: str, words: int, percent: int
) -> DataFrame:
    """A forest of the links between classes, as edges u, v.

    Within each cluster: (1) a member is alone for certain if too many of its shingles are in no other member's set.
    (2) The others meet the cluster's leaders, the LEADERS members with the fewest shingles of their own, or as many of
    them as BLOCK_BYTES hold; these are the texts that most others are variants of. Where all members are leaders, all
    pairs have met. (3) Members that are not linked with the largest component yet meet all members that they are not
    linked with.
    """
    members = materialise_texts(cluster_sets(docs, classes, clusters, key, text, words), "members")
    items = members.select("root", "set_a", F.explode("items").alias("item"))
    single = items.groupBy("root", "item").agg(F.count(F.lit(1)).alias("n"), F.min("set_a").alias("set_a")).where("n = 1")
    own = single.groupBy("set_a").agg(F.count(F.lit(1)).alias("own"))
    size = F.size("items")
    scored = members.select("set_a", "root", size.alias("size")).join(own, "set_a", "left").na.fill(0, ["own"])
    live = materialise(scored.where(100 * (F.col("size") - F.col("own")) >= percent * F.col("size")), "live")
    grouped = live.groupBy("root").agg(F.count(F.lit(1)).alias("members"), F.sum("size").alias("total"))
    sizes = materialise(grouped.where("members > 1"), "sizes")
    met = first_rows(live.join(sizes.select("root"), "root"), ["root"], LEADERS, ["own", "set_a"], lanes=16)
    before = F.sum("size").over(Window.partitionBy("root").orderBy("own", "set_a").rowsBetween(Window.unboundedPreceding, -1))
    fitting = met.withColumn("before", F.coalesce(before, F.lit(0))).where((F.col("before") + F.col("size")) * 8 <= BLOCK_BYTES)
    leaders = materialise(fitting.select("root", "set_a"), "leaders")
    sets = members.join(live.select("set_a"), "set_a").join(sizes, "root")

    count = blocks("members", "total")
    every = sets.withColumn("low", F.pmod(F.xxhash64("set_a"), count).cast("int")).withColumn("side", F.lit(0))
    # A cluster that is one block of leaders is compared with itself.
    several = sets.where((F.col("members") > LEADERS) | (count > 1))
    first = several.join(leaders.select("set_a"), "set_a").withColumn("low", F.explode(F.sequence(F.lit(0), count - 1)))
    columns = ["root", "low", "side", "set_a", "sketch", "items"]
    dealt = every.select(columns).unionByName(first.withColumn("side", F.lit(1)).select(columns))
    dealt = dealt.withColumn("label", F.col("set_a"))
    found = materialise(compared(dealt, ["root", "low"], percent), "found")

    led = leaders.groupBy("root").agg(F.count(F.lit(1)).alias("led"))
    left = sets.join(led, "root", "left").where(F.col("members") > F.coalesce("led", F.lit(0)))
    labels = connected_components(found).select(F.col("node").alias("set_a"), F.col("root").alias("label"))
    named = left.join(labels, "set_a", "left").withColumn("label", F.coalesce("label", "set_a"))
    named = materialise(named.select("root", "set_a", "label", size.alias("size")), "labels")
    counts = named.groupBy("root", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"))
    home = counts.groupBy("root").agg(
        F.max(F.struct("n", "label", "total")).alias("home"), F.sum("n").alias("all"), F.sum("total").alias("total")
    )
    home = home.select(
        "root",
        F.col("home.label").alias("home"),
        "home.n",
        F.col("home.total").alias("home_total"),
        (F.col("all") - F.col("home.n")).alias("rest"),
        (F.col("total") - F.col("home.total")).alias("rest_total"),
    )
    home = materialise(home.where("rest > 0"), "home")
    parts = home.select("root", "home", blocks("n", "home_total").alias("homes"), blocks("rest", "rest_total").alias("rests"))
    open_members = named.drop("size").join(parts, "root").join(members.select("set_a", "sketch", "items"), "set_a")
    at_home = F.col("label") == F.col("home")
    count = F.when(at_home, F.col("homes")).otherwise(F.col("rests"))
    own_block = F.pmod(F.xxhash64("set_a"), count).cast("int") + F.when(at_home, F.col("rests")).otherwise(0)
    # Blocks of the rest come first; they meet one another and those of the largest component.
    rests, both = F.sequence(F.lit(0), F.col("rests") - 1), F.sequence(F.lit(0), F.col("rests") + F.col("homes") - 1)
    others = F.when(at_home, rests).otherwise(both)
    placed = open_members.withColumn("block", own_block).withColumn("other", F.explode(others))
    placed = placed.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    placed = placed.withColumn("side", F.when(F.col("block") == F.col("low"), 0).otherwise(1))
    rest = compared(placed.select("root", "low", "high", "side", "set_a", "sketch", "items", "label"), ["root", "low", "high"], percent)
    return found.unionByName(rest)


def cluster_sets(
    docs: DataFrame, classes: DataFrame, clusters: DataFrame, key: str, text: str, words: int
) -> DataFrame:
    """``set_a``, ``root``, ``sketch`` and the whole shingle set of each class that is in a cluster.

    Texts that are in no cluster are left out by a filter before the join, most of them without a shuffle.
    """
    wanted = clusters.select(F.col("node").alias("set_a"), "root").join(classes, "set_a")
    wanted = materialise(wanted.select("set_a", "root", "sketch", "key", "text_hash"), "wanted")
    texts = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    texts = with_possible(texts, wanted, ["key", "text_hash"]).where("POSSIBLE").drop("POSSIBLE")
    same = F.col("w.key").eqNullSafe(F.col("t.key")) & (F.col("w.text_hash") == F.col("t.text_hash"))
    found = texts.alias("t").join(wanted.alias("w"), same).select("w.set_a", "w.root", "w.sketch", "t.text")
    return shingle_sets(found.dropDuplicates(["set_a"]), words)


def compared(dealt: DataFrame, group: list[str], percent: int) -> DataFrame:
    """A forest of the links between side 0 and side 1 of each group, among members that differ in ``label``.

    A group without a side 1 is compared with itself. A member may stand on both sides.
    """
    arrow = schema_of("u long, v long")

    def compare(rows: pa.Table) -> pa.Table:
        names, index, back = np.unique(rows.column("set_a").to_numpy(), return_index=True, return_inverse=True)
        side = rows.column("side").to_numpy()
        first, second = np.unique(back[side == 0]), np.unique(back[side == 1])
        members = rows.take(pa.array(index))
        sets = [x.values.to_numpy().view(np.uint64) for x in members.column("items")]
        sketches = np.array(members.column("sketch").to_pylist(), np.int64).view(np.uint64)
        known = members.column("label").to_numpy()
        edges = linked_pairs(sets, sketches, first, second if len(second) else first, percent, known)
        u, v = ([int(names[e[side]]) for e in edges] for side in (0, 1))
        if rows.nbytes > RELEASED_BYTES:
            del rows, members, sets
            release_arrow()
        return pa.Table.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], schema=arrow)

    return dealt.groupBy(*group).applyInArrow(compare, "u long, v long")
