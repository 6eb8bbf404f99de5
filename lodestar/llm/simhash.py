"""SimHash near-duplicates with BK-trees.

A document's fingerprint has a bit set where over half of its shingles' XXH64 have it. Two fingerprints that differ in at
most `radius` bits agree in one of radius + 1 bands, so the distinct fingerprints are dealt into shards by (band, its value);
a crowded shard is dealt again by bands of its remaining bits. Each shard is one BK-tree: children are keyed by integer Hamming
distance to the parent, and a search follows only the edges within the radius. Shard trees reach the tasks by a shuffle rather
than a broadcast, whose size would grow with the corpus. A shard gives one link a fingerprint, to the smallest of its component
there, never the pairs of a group; the links' components are found by rounds of smallest labels over written tables.

keep_one() removes documents, so it takes fingerprint links as candidates only (see there): wide fingerprints, BK-trees that
give each text its nearest, and the exact similarity of every candidate link before components. The nearest is not every
partner, and near sets may have far fingerprints, so an exact join of shingles then finds what links are left between groups.

Defined cases: a null or wordless text has fingerprint zero, linked like any other; fewer words than a shingle: the whole
sequence is the only shingle; repeated rows and exact copies share a fingerprint; a null doc_id is never a component's id
unless all of its are null; an empty table gives an empty result. Added columns replace input columns of the same names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .common import MADE, NARROW_ROWS, literals, materialize, remove, remove_since, small, table

SEED = 42
SHARD = 2048  # fingerprints in a shard; a larger one is dealt again
_BYTE_LANES = np.uint64(0x0101010101010101)
_CHUNK = 255  # rows that a byte lane can count


def fingerprint(text: str | None, width: int = 4, seed: int = SEED) -> int:
    """The unsigned 64-bit fingerprint of a whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends - lengths + 1
    n = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    last = ends[min(width, len(words)) - 1 :].tolist()
    h = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), last)), np.uint64, n)
    padded = np.zeros(-(-n // _CHUNK) * _CHUNK, np.uint64)
    padded[:n] = h
    out = 0
    for bit in range(8):  # eight bits at a time, each counted in a byte of its own
        lanes = ((padded >> np.uint64(bit)) & _BYTE_LANES).reshape(-1, _CHUNK).sum(axis=1, dtype=np.uint64)
        counts = lanes.astype("<u8").view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
        for byte in np.flatnonzero(2 * counts > n):
            out |= 1 << (8 * int(byte) + bit)
    return out


def fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id_col and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), width) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], [id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fp long")


class BKTree:
    """A BK-tree whose items leave it as they are found, so that a component is read off once however dense it is."""

    def __init__(self, items: list[int]):
        self.items, self.children = items, [{} for _ in items]
        self.parent, self.alive, self.live = [-1] * len(items), [True] * len(items), [1] * len(items)
        for i in range(1, len(items)):
            self._insert(i)

    def _insert(self, i: int) -> None:
        at, item = 0, self.items[i]
        while True:
            self.live[at] += 1
            d = (self.items[at] ^ item).bit_count()
            child = self.children[at].get(d)
            if child is None:
                self.children[at][d] = i
                self.parent[i] = at
                return
            at = child

    def remove(self, i: int) -> None:
        self.alive[i] = False
        while i >= 0:
            self.live[i] -= 1
            i = self.parent[i]

    def take(self, item: int, radius: int) -> list[int]:
        """Removes and returns the items within the radius, following only edges that can lead to one."""
        found, stack = [], [0] if self.live and self.live[0] else []
        while stack:
            at = stack.pop()
            d = (self.items[at] ^ item).bit_count()
            if d <= radius and self.alive[at]:
                found.append(at)
            children = self.children[at]
            if len(children) <= 2 * radius + 1:
                stack += [c for e, c in children.items() if -radius <= e - d <= radius and self.live[c]]
            else:
                stack += [c for e in range(max(1, d - radius), d + radius + 1) if (c := children.get(e)) is not None and self.live[c]]
        for i in found:
            self.remove(i)
        return found


def shard_links(items: list[int], radius: int) -> list[tuple[int, int]]:
    """(item, smallest item of its component in this shard) for the items of components of two or more."""
    if len(items) == 2:
        a, b = sorted(items)
        return [(b, a)] if (a ^ b).bit_count() <= radius else []
    tree, out = BKTree(items), []
    for i in range(len(items)):
        if not tree.alive[i]:
            continue
        tree.remove(i)
        members, todo = [i], [i]
        while todo:
            got = tree.take(items[todo.pop()], radius)
            members += got
            todo += got
        if len(members) > 1:
            least = min(items[m] for m in members)
            out += [(items[m], least) for m in members if items[m] != least]
    return out


def bands(n_bits: list[int], radius: int) -> list[int]:
    """Bit masks of radius + 1 bands of these bits: two values that differ in at most radius of them agree in some band."""
    edges = [round(len(n_bits) * i / (radius + 1)) for i in range(radius + 2)]
    return [sum(1 << b for b in n_bits[x:y]) for x, y in zip(edges, edges[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def deal(distinct: DataFrame, radius: int, shard: int) -> list[DataFrame]:
    """(fp, choice, value) tables whose shards (choice, value) together hold each pair within the radius in one shard at least.

    A shard's fingerprints agree in the bands chosen so far and differ elsewhere only, so a shard of more than `shard` of them is
    dealt again by bands of the remaining bits, until no shard is crowded or fewer bits than bands are left.
    """
    masked = lambda mask: F.col("fp").bitwiseAND(mask).alias("value")
    level = [(str(i), m) for i, m in enumerate(bands(list(range(64)), radius))]
    out, keyed = [], distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(c).alias("choice"), masked(F.lit(_signed(m)))) for c, m in level])).alias("k")).select("fp", "k.*")
    while True:
        left = {c: [b for b in range(64) if not m >> b & 1] for c, m in level}
        below = [(c, f"{c}.{i}", mask | m) for c, mask in level if len(left[c]) > radius for i, m in enumerate(bands(left[c], radius))]
        crowded = keyed.groupBy("choice", "value").count().filter((F.col("count") > shard) & F.col("choice").isin([c for c, _, _ in below])).drop("count")
        crowded = materialize(crowded, "crowded-shards")
        if crowded.isEmpty():
            return [*out, keyed]
        marked = keyed.join(small(crowded.withColumn("many", F.lit(True))), ["choice", "value"], "left")
        out.append(marked.filter(F.col("many").isNull()).select("fp", "choice", "value"))
        again = literals(distinct.sparkSession, [(c, d, _signed(m)) for c, d, m in below], "choice string, next string, mask long")
        keyed = materialize(marked.filter("many").join(F.broadcast(again), "choice").select("fp", F.col("next").alias("choice"), masked(F.col("mask"))), "dealt-again")
        level = [(d, m) for _, d, m in below]


def links(distinct: DataFrame, radius: int = 4, shard: int = SHARD) -> DataFrame:
    """(fp, root) links between distinct fingerprints whose components are those of all pairs within the radius."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[int] = []
        last = None

        def flush(found: list[tuple[int, int]]) -> pa.RecordBatch:
            both = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["fp", "root"])

        for batch in batches:
            fp, choice, value = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cut = np.flatnonzero((choice[1:] != choice[:-1]) | (value[1:] != value[:-1])) + 1
            found: list[tuple[int, int]] = []
            starts, ends = [0, *cut.tolist()], [*cut.tolist(), len(fp)]
            for a, b in zip(starts, ends):
                if a == b:
                    continue
                if (key := (choice[a], value[a])) != last:
                    if len(own) > 1:
                        found += shard_links(own, radius)
                    own, last = [], key
                if len(own) or b - a > 1 or b == len(fp):
                    own += fp[a:b].view(np.uint64).tolist()
            if found:
                yield flush(found)
        if len(own) > 1 and (found := shard_links(own, radius)):
            yield flush(found)

    dealt = [k.select("fp", "choice", "value").repartition("choice", "value").sortWithinPartitions("choice", "value") for k in deal(distinct, radius, shard)]
    return reduce(DataFrame.unionByName, [d.mapInArrow(run, "fp long, root long") for d in dealt]).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(fp, root) links -> (fp, label): label is the smallest fp of the component. Each round's labels are a written table.

    A round lowers a fingerprint's label to its neighbours' least, tells the same to the fingerprint that its old label names,
    and then takes the label of its label, so that trees of labels merge and flatten and rounds stay few on long chains.
    """
    # one row a fingerprint, its smallest root; its other roots are linked to that one, which leaves few of a dense group's links
    edges = materialize(edges, "shard-links")
    first = materialize(edges.groupBy("fp").agg(F.min("root").alias("least")), "first-roots")
    others = edges.join(first, "fp").filter("root <> least").select(F.greatest("root", "least").alias("fp"), F.least("root", "least").alias("root")).distinct()
    edges = first.withColumnRenamed("least", "root").unionByName(others).distinct()
    both = materialize(edges.unionByName(edges.select(F.col("root").alias("fp"), F.col("fp").alias("root"))), "links")
    labels = materialize(both.groupBy("fp").agg(F.min(F.least("fp", "root")).alias("label")), "labels")
    changed = True
    while changed:  # labels only fall, so this ends
        near = both.join(labels.select(F.col("fp").alias("root"), "label"), "root").groupBy("fp").agg(F.min("label").alias("near"))
        least = materialize(labels.select("fp", "label").join(near, "fp").select("fp", F.col("label").alias("old"), F.least("label", "near").alias("via")), "least-labels")
        hooks = least.filter("via < old").groupBy(F.col("old").alias("fp")).agg(F.min("via").alias("hook"))
        hooked = least.join(hooks, "fp", "left").select("fp", "old", F.least("via", "hook").alias("via"))
        jumped = hooked.join(least.select(F.col("fp").alias("via"), F.col("via").alias("jump")), "via", "left")
        after = materialize(jumped.select("fp", "old", F.coalesce("jump", "via").alias("label")), "labels")
        changed = not after.filter("label <> old").isEmpty()
        for done in (labels, least):
            remove(edges.sparkSession, done.scratch_path)
        labels = after
    labels = after.select("fp", "label")
    return labels


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = 4, shard: int = SHARD) -> DataFrame:
    """One row a document: doc_id, fp, component_id (the smallest doc_id of its component) and group_rows (rows of its fingerprint)."""
    fps = materialize(fingerprints(docs, width), "fingerprints")
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("group_rows")), "distinct")
    labels = components(links(distinct.select("fp"), radius, shard))
    # only fingerprints with a link have labels; their components' ids are combined before the shuffle
    linked = materialize(labels.join(distinct.select("fp", "first_id"), "fp"), "linked")
    ids = small(materialize(linked.groupBy("label").agg(F.min("first_id").alias("component_id")), "component-ids"))
    named = linked.join(ids, "label").select("fp", "component_id", F.lit(True).alias("named"))
    owners = distinct.join(named, "fp", "left").select("fp", F.when(F.col("named"), F.col("component_id")).otherwise(F.col("first_id")).alias("component_id"), "group_rows")
    return fps.join(owners, "fp")


# --- removal: wide fingerprints for candidates, exact similarity for links

WIDE_BITS, WIDE_RADIUS = 128, 20  # texts that share 0.8 of their five-word shingles differ in 12 of 128 bits on average
WIDE_KEYS, KEY_BITS = 40, 24  # shards a text is in; bits of the fingerprint that a shard agrees in
CHUNK = 4096  # texts in one tree
SAMPLE, OFTEN, MOST = 10_000, 3, 200_000  # texts looked at for common shingles, how many of them have one, shingles listed
BUCKET = 2000  # texts whose first shingles fill a bucket


def key_masks() -> list[tuple[int, int]]:
    """For each shard key the bits of the two halves that it takes, chosen by md5."""
    chosen = [sorted(range(WIDE_BITS), key=lambda b: hashlib.md5(f"{k}|{b}".encode()).digest())[:KEY_BITS] for k in range(WIDE_KEYS)]
    return [(sum(1 << b for b in bits if b < 64), sum(1 << (b - 64) for b in bits if b >= 64)) for bits in chosen]


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z lower-cased, one after another, and the bounds of each text among them."""
    runs = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    flat, bounds = runs.flatten(), runs.offsets.to_numpy()
    coded = flat.dictionary_encode()
    distinct = coded.dictionary.cast(pa.large_binary()).to_pylist()  # lower() of bytes changes A-Z alone
    own = np.fromiter((xxhash.xxh3_64_intdigest(w.lower()) for w in distinct), np.uint64, len(distinct))
    words = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(words)])
    return own[coded.indices.to_numpy()][words], before[bounds - bounds[0]]


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, width: int) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, sorted; the whole sequence where it has fewer words, none where it has no word."""
    n = max(0, len(words) - width + 1)
    h = words[:n].copy()
    for j in range(1, width):
        h = _mix(h) + words[j : j + n]
    h = _mix(h)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= width or a == b:
            out.append(np.unique(h[a : max(a, b - width + 1)]))
        else:
            own = words[a : a + 1]
            for j in range(a + 1, b):
                own = _mix(own) + words[j : j + 1]
            out.append(_mix(own))
    return out


def majority(h: np.ndarray) -> int:
    """The 64 bits that over half of the hashes have."""
    n, out = len(h), 0
    padded = np.zeros(max(1, -(-n // _CHUNK)) * _CHUNK, np.uint64)
    padded[:n] = h
    padded = padded.reshape(-1, _CHUNK)
    for bit in range(8):
        lanes = ((padded >> np.uint64(bit)) & _BYTE_LANES).sum(axis=1, dtype=np.uint64)
        counts = lanes.astype("<u8").view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
        for byte in np.flatnonzero(2 * counts > n):
            out |= 1 << (8 * int(byte) + bit)
    return out


def common_shingles(docs: DataFrame, width: int) -> np.ndarray:
    """Hashes, sorted, of the shingles that several of a sample of texts have. They only order shingles: any list gives the same links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 0):
                sets = shingle_hashes(*word_hashes(batch.column(0)), width)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64) if sets else [], pa.int64())], ["shingle"])

    every = max(1, docs.count() // SAMPLE)
    sample = docs.filter(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).select("text").distinct()
    counts = sample.mapInArrow(run, "shingle long").groupBy("shingle").count().filter(F.col("count") >= OFTEN)
    return np.sort(np.array([r["shingle"] for r in counts.orderBy(F.desc("count"), "shingle").limit(MOST).collect()], np.int64).view(np.uint64))


def prefix(shingles: np.ndarray, common: np.ndarray, least: float) -> np.ndarray:
    """The first shingles of a set, common ones last, so many that sets of a Jaccard similarity of `least` or more share one of theirs.

    Such sets share ceil(least * size) shingles at least, so that the others of a set are too few to fill this.
    """
    n = len(shingles)
    if not n:
        return shingles
    if len(common):
        often = common[np.minimum(np.searchsorted(common, shingles), len(common) - 1)] == shingles
        shingles = np.concatenate([shingles[~often], shingles[often]])
    return shingles[: n - math.ceil(least * n - 1e-9) + 1]


def odd_bits(shingles: np.ndarray) -> bytes:
    """For each remainder of the hashes a bit: are the set's hashes of it odd in number? As many bits as shingles, up to a power of two."""
    bits = max(64, 1 << (len(shingles) - 1).bit_length())
    counts = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits(counts.astype(np.uint8) & 1, bitorder="little").tobytes()


def sets_may_be_similar(size: int, odd: bytes, other_size: int, other_odd: bytes, least: float) -> bool:
    """Can sets of these sizes and odd_bits() be similar? A bit in which they differ is of a shingle that one alone has."""
    x, y = (odd, other_odd) if len(odd) >= len(other_odd) else (other_odd, odd)
    x, y = int.from_bytes(x, "little"), int.from_bytes(y, "little")
    for half in (8 * max(len(odd), len(other_odd)) >> i for i in range(1, 64)):
        if half < 8 * min(len(odd), len(other_odd)):
            break
        x = (x >> half) ^ (x & ((1 << half) - 1))  # the remainders by half as many
    shared = min(size, other_size, (size + other_size - (x ^ y).bit_count()) // 2)
    return shared >= (least - 1e-9) * (size + other_size - shared)


def text_sets(docs: DataFrame, width: int, least: float) -> DataFrame:
    """One row a document: doc_id, text_hash, number (its own), node (hash of its set of shingles), hi, lo (its wide fingerprint over
    pairs of words), size (shingles in its set), odd, the odd_bits() of the set, and first_shingles, the bytes of its prefix()."""
    common = common_shingles(docs, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for whole in batches:
            for batch in slices(whole, 2):
                words, bounds = word_hashes(batch.column(2))
                sets = shingle_hashes(words, bounds, width)
                node = np.fromiter((xxhash.xxh3_64_intdigest(x.tobytes()) for x in sets), np.uint64, batch.num_rows)
                firsts = pa.array([prefix(x, common, least).tobytes() for x in sets], pa.binary())
                pairs = shingle_hashes(words, bounds, 2)
                hi = np.fromiter((majority(x) for x in pairs), np.uint64, batch.num_rows)
                lo = np.fromiter((majority(_mix(x)) for x in pairs), np.uint64, batch.num_rows)
                size, odd = pa.array([*map(len, sets)], pa.int64()), pa.array([*map(odd_bits, sets)], pa.binary())
                numbers = pa.array(np.arange(number, number + batch.num_rows))
                number += batch.num_rows
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), numbers, *(pa.array(x.view(np.int64)) for x in (node, hi, lo)), size, odd, firsts], ["doc_id", "text_hash", "number", "node", "hi", "lo", "size", "odd", "first_shingles"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, f"doc_id {kind}, text_hash long, number long, node long, hi long, lo long, size long, odd binary, first_shingles binary")


class NearestTree:
    """A BK-tree of wide fingerprints that finds an item's nearest."""

    def __init__(self) -> None:
        self.items: list[int] = []
        self.children: list[dict[int, int]] = []

    def insert(self, item: int) -> None:
        at, new = 0, len(self.items)
        self.items.append(item)
        self.children.append({})
        while new:
            d = (self.items[at] ^ item).bit_count()
            child = self.children[at].setdefault(d, new)
            if child == new:
                return
            at = child

    def nearest(self, item: int, radius: int, but: int = -1) -> tuple[int, int] | None:
        """(distance, place) of the nearest item within the radius other than place `but`, the earliest of equal ones."""
        best, stack = None, [0] if self.items else []
        while stack:
            at = stack.pop()
            d = (self.items[at] ^ item).bit_count()
            if d <= radius and at != but and (best is None or (d, at) < best):
                best, radius = (d, at), d
            stack += [c for e, c in self.children[at].items() if -radius <= e - d <= radius]
        return best


def shard_candidates(items: list[int], radius: int = WIDE_RADIUS) -> tuple[list[tuple[int, int]], list[int]]:
    """Pairs of places (a text, its nearest of all and its nearest before it) and the places of leaders, which no leader before is near."""
    leaders, pairs, leading = NearestTree(), set(), []
    for start in range(0, len(items), CHUNK):
        tree, own = NearestTree(), items[start : start + CHUNK]
        for i, item in enumerate(own):
            if got := tree.nearest(item, radius):
                pairs.add((start + i, start + got[1]))
            tree.insert(item)
            if got := leaders.nearest(item, radius):
                pairs.add((start + i, leading[got[1]]))
            else:
                leading.append(start + i)
                leaders.insert(item)
        for i, item in enumerate(own):
            if got := tree.nearest(item, radius, but=i):
                pairs.add((start + i, start + got[1]))
    return sorted((a, b) for a, b in pairs if a != b), leading


def candidate_links(nodes: DataFrame) -> DataFrame:
    """nodes: node, hi, lo, one row a distinct set -> (a, b) pairs of nodes that may be similar.

    A text is in WIDE_KEYS shards, each of those texts that agree in KEY_BITS bits of the wide fingerprint, and in each it is
    linked to its nearest within WIDE_RADIUS. Shards are looked through where the rows are first; only leaders go on to the shuffle
    by key, so a group of any size is a few rows a task there. Links and rows a text are the same at any size.
    """
    masks = key_masks()
    keys = [np.array(x, np.uint64) for x in zip(*masks)]
    salt = _mix(np.arange(1, WIDE_KEYS + 1, dtype=np.uint64))

    def pairs_of(key: np.ndarray, hi: np.ndarray, lo: np.ndarray, node: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
        """Pairs of nodes of equal keys, which come together, and a mask of rows that do not lead their shard."""
        cut = np.flatnonzero(key[1:] != key[:-1]) + 1
        starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(key)]])
        found, follows = [], np.zeros(len(key), bool)
        for a, b in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist()):
            got, leading = shard_candidates([x << 64 | y for x, y in zip(hi[a:b].tolist(), lo[a:b].tolist())])
            own = node[a:b].tolist()
            found += [(own[i], own[j]) for i, j in got]
            follows[a:b] = True
            follows[a + np.array(leading)] = False
        return found, follows

    def both(found: list[tuple[int, int]]) -> tuple[pa.Array, pa.Array]:
        x = np.array(sorted({(max(p), min(p)) for p in found}), np.uint64).reshape(-1, 2).view(np.int64)
        return pa.array(x[:, 0]), pa.array(x[:, 1])

    names = ["a", "b", "node", "hi", "lo", "leads"]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, hi, lo = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(3))
            if not len(node):
                continue
            key = _mix(_mix((hi[:, None] & keys[0]) + salt) + (lo[:, None] & keys[1])).ravel()
            order = np.argsort(key, kind="stable")
            row = order // WIDE_KEYS
            found, follows = pairs_of(key[order], hi[row], lo[row], node[row])
            leads = np.full(len(node), (1 << WIDE_KEYS) - 1, np.int64)
            np.bitwise_and.at(leads, row[follows], ~(np.int64(1) << (order[follows] % WIDE_KEYS)))
            a, b = both(found)
            none = lambda k: pa.nulls(k, pa.int64())
            yield pa.RecordBatch.from_arrays([a, b, none(len(a)), none(len(a)), none(len(a)), none(len(a))], names)
            yield pa.RecordBatch.from_arrays([none(len(node)), none(len(node)), *(batch.column(i) for i in range(3)), pa.array(leads)], names)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last shard of a batch may go on in the next
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            if held is not None:
                columns = [np.concatenate([x, y]) for x, y in zip(held, columns)]
            key = columns[0]
            if not len(key):
                continue
            last = int(np.searchsorted(key, key[-1]))
            held = [x[last:] for x in columns]
            if last:
                found, _ = pairs_of(key[:last], *(x[:last].view(np.uint64) for x in columns[1:]))
                if found:
                    yield pa.RecordBatch.from_arrays(list(both(found)), ["a", "b"])
        if held is not None:
            found, _ = pairs_of(held[0], *(x.view(np.uint64) for x in held[1:]))
            if found:
                yield pa.RecordBatch.from_arrays(list(both(found)), ["a", "b"])

    near = materialize(nodes.select("node", "hi", "lo").mapInArrow(local, "a long, b long, node long, hi long, lo long, leads long"), "local-links")
    each = F.array(*[F.when(F.col("leads").bitwiseAND(F.lit(1 << k)) != 0, F.xxhash64(F.lit(k), F.col("hi").bitwiseAND(F.lit(_signed(x))), F.col("lo").bitwiseAND(F.lit(_signed(y))))) for k, (x, y) in enumerate(masks)])
    keyed = near.filter("node IS NOT NULL").select(F.explode(F.array_compact(each)).alias("key"), "hi", "lo", "node")
    far = keyed.repartition("key").sortWithinPartitions("key", "hi", "lo", "node").mapInArrow(shards, "a long, b long")
    return near.filter("a IS NOT NULL").select("a", "b").unionByName(far).distinct()


def may_be_similar(size: np.ndarray, place: np.ndarray, other_size: np.ndarray, other_place: np.ndarray, least: float) -> np.ndarray:
    """Can sets of these sizes, whose first common shingle is at these places, be similar? What follows there is all they can share."""
    shared = np.minimum(size - place, other_size - other_place)
    return shared >= (least - 1e-9) * (size + other_size - shared)


def shingle_pairs(shingle: np.ndarray, node: np.ndarray, label: np.ndarray, size: np.ndarray, place: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of nodes of different labels that have a shingle in common, in order of it, and may be similar; all of them, in parts.

    A size of 0 is not known."""
    cut = np.flatnonzero(shingle[1:] != shingle[:-1]) + 1
    counts = np.diff(np.concatenate([[0], cut, [len(shingle)]]))
    ends = np.repeat(np.cumsum(counts), counts)
    crowded = np.repeat(counts > 64, counts)

    def of(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keep = (label[i] != label[j]) & ((size[i] == 0) | (size[j] == 0) | may_be_similar(size[i], place[i], size[j], place[j], least))
        a, b = node[i[keep]], node[j[keep]]
        return np.maximum(a, b), np.minimum(a, b)

    at, step = np.flatnonzero(~crowded), 1
    while len(at := at[at + step < ends[at]]):
        yield of(at, at + step)
        step += 1
    # of a shingle that many have, what is not of its largest label meets all others
    for b in np.unique(ends[crowded]).tolist():
        a = b - int(counts[np.searchsorted(np.cumsum(counts), b)])
        values, own = np.unique(label[a:b], return_inverse=True)
        for i in np.flatnonzero(own != np.bincount(own, minlength=len(values)).argmax()).tolist():
            yield of(np.full(b - a, a + i), np.arange(a, b))


def remaining_pairs(rows: DataFrame, nodes: DataFrame, labels: DataFrame, least: float) -> DataFrame:
    """(a, b) pairs of numbers of documents whose nodes have different labels, all those that may have a Jaccard similarity of `least`
    or more. Documents of a node have one number here, their smallest.

    Two such sets have a shingle in common among the first of both. Shingles are dealt into buckets by hash, a bucket for each
    BUCKET texts, and go there packed, under 32 bits of their hashes: equal bits of two shingles make a pair too many, never one too
    few. A shingle takes ten bytes whatever the buckets: of a set that is alone, whose label is its own, the lower 16 bits of its
    number go with it, and node, text and bits are looked up for the pairs; only other sets take the whole number and the label.
    """
    buckets = max(1, rows.count() // BUCKET)
    named = nodes.join(labels.withColumnRenamed("fp", "node"), "node", "left").filter("n > 1 OR label IS NOT NULL")
    named = small(materialize(named.select("node", F.col("number").alias("named"), F.coalesce("label", "node").alias("label")), "named-sets"), NARROW_ROWS)
    own = rows.join(named, "node", "left").select("number", F.coalesce("named", "number").alias("named"), "label", "size", "first_shingles")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 4):
                number, node = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
                alone = pc.is_null(batch.column(2)).to_numpy(zero_copy_only=False)
                label = pc.fill_null(batch.column(2), 0).to_numpy(zero_copy_only=False)
                size = batch.column(3).to_numpy(zero_copy_only=False)
                size = np.where(size > 65535, 0, size).astype("<u2")
                lengths = pc.binary_length(batch.column(4)).to_numpy(zero_copy_only=False) // 8
                shingle = np.frombuffer(b"".join(batch.column(4).to_pylist()), "<u8")
                text = np.repeat(np.arange(len(number)), lengths)
                place = np.arange(len(shingle)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                once = np.zeros(len(number), bool)
                once[np.unique(node, return_index=True)[1]] = True  # of equal sets one
                upper, kind = np.unique(np.where(alone, number >> 16, -1), return_inverse=True)
                for own_upper in range(len(upper)):
                    take = np.flatnonzero((once & (kind == own_upper))[text])
                    if not len(take):
                        continue
                    bucket = ((shingle[take] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
                    order = np.argsort(bucket, kind="stable")
                    bucket, at = bucket[order], take[order]
                    starts = np.flatnonzero(np.insert(bucket[1:] != bucket[:-1], 0, True))
                    packed = lambda x: pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer((np.append(starts, len(x)) * x.itemsize).astype("<i4")), pa.py_buffer(x.tobytes())])  # noqa: B023, E731
                    columns = [(shingle[at] & np.uint64(0xFFFFFFFF)).astype("<u4"), np.minimum(place[at], 65535).astype("<u2"), size[text[at]]]
                    if upper[own_upper] < 0:
                        columns += [node[text[at]].astype("<i8"), label[text[at]].astype("<i8")]
                    else:
                        columns.append((number[text[at]] & 0xFFFF).astype("<u2"))
                    columns = [*map(packed, columns), pa.nulls(len(starts), pa.binary())][:5]
                    yield pa.RecordBatch.from_arrays([pa.array(bucket[starts]), pa.array(np.full(len(starts), upper[own_upper])), *columns], ["bucket", "upper", "shingles", "places", "sizes", "numbers", "labels"])

    def found(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        shingle, place, size = (np.frombuffer(b"".join(x), kind) for x, kind in zip([*zip(*held)][1:4], ("<u4", "<u2", "<u2")))
        # the label of a set that is alone is its number
        number = np.concatenate([np.frombuffer(x[4], "<i8") if x[0] < 0 else np.frombuffer(x[4], "<u2") + (np.int64(x[0]) << 16) for x in held])
        label = np.concatenate([np.frombuffer(x[5], "<i8") if x[0] < 0 else np.frombuffer(x[4], "<u2") + (np.int64(x[0]) << 16) for x in held])
        order = np.argsort(shingle, kind="stable")
        same = shingle[order][1:] == shingle[order][:-1]
        order = order[np.append(same, False) | np.insert(same, 0, False)] if len(order) else order  # shingles of several rows
        order = order[np.lexsort((place[order], number[order], label[order], shingle[order]))]
        columns = shingle[order].astype(np.int64), number[order], label[order], size[order].astype(np.int64), place[order].astype(np.int64)
        new = np.insert((columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1]), 0, True) if len(order) else np.empty(0, bool)
        columns = [x[new] for x in columns]
        if not len(columns[0]):
            return
        starts = np.flatnonzero(np.insert(columns[0][1:] != columns[0][:-1], 0, True))
        ends = np.append(starts[1:], len(columns[0]))
        several = np.repeat(columns[2][starts] != columns[2][ends - 1], ends - starts)  # labels are in order
        some, n = [], 0
        for pair in shingle_pairs(*(x[several] for x in columns), least):
            some.append(np.stack(pair))
            n += len(pair[0])
            if n > 1 << 20:
                yield distinct(some)
                some, n = [], 0
        if n:
            yield distinct(some)

    def distinct(some: list[np.ndarray]) -> pa.RecordBatch:
        a, b = np.concatenate(some, axis=1)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.insert((a[1:] != a[:-1]) | (b[1:] != b[:-1]), 0, True)
        return pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new])], ["a", "b"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            for bucket, *packed in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if bucket != last and held:
                    yield from found(held)
                    held = []
                held.append(packed)
                last = bucket
        if held:
            yield from found(held)

    dealt = own.mapInArrow(deal, "bucket long, upper long, shingles binary, places binary, sizes binary, numbers binary, labels binary")
    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(gather, "a long, b long").distinct()


def possible_pairs(rows: DataFrame, pairs: DataFrame, key: str, least: float) -> DataFrame:
    """pairs, (a, b) of the key column of rows -> those of their nodes whose sets may be similar by size and odd_bits().

    The bits are a 64th of the set or little more, and tell unlike sets apart: few whole sets then meet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, *marks = (batch.column(i) for i in range(6))
            keep = [sets_may_be_similar(*x, least) for x in zip(*(m.to_pylist() for m in marks))]
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    ends = small(pairs.select(F.explode(F.array("a", "b")).alias(key)).distinct(), NARROW_ROWS)
    marks = materialize(rows.select(key, F.col("node").alias("own_node"), "size", "odd").join(ends, key, "left_semi").dropDuplicates([key]), "marks")
    left, right = (marks.select(F.col(key).alias(c), *(F.col(x).alias(f"{c}_{x}") for x in ("own_node", "size", "odd"))) for c in "ab")
    both = pairs.join(left, "a").join(right, "b").select(F.greatest("a_own_node", "b_own_node").alias("a"), F.least("a_own_node", "b_own_node").alias("b"), "a_size", "a_odd", "b_size", "b_odd")
    return both.mapInArrow(run, "a long, b long")


def similar_links(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, width: int, least: float) -> DataFrame:
    """The (fp, root) pairs of nodes whose sets of shingles have a Jaccard similarity of `least` or more.

    A set is made once, from the text of its node's first document, and meets its partners by two joins: one pair a row.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("end")).distinct()
    firsts = materialize(nodes.join(ends, nodes["node"] == ends["end"]).select("node", F.col("first.doc_id").alias("first_id"), F.col("first.text_hash").alias("first_hash")), "compared")
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    chosen = texts.join(small(firsts, NARROW_ROWS), F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_hash") == F.col("first_hash"))).select("node", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                got = [x.tobytes() for x in shingle_hashes(*word_hashes(batch.column(1)), width)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.binary())], ["node", "shingles"])

    made = materialize(chosen.mapInArrow(sets, "node long, shingles binary"), "shingle-sets")
    made = made.dropDuplicates(["node"])  # repeated rows

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), "u8"), np.frombuffer(y.as_buffer(), "u8")
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(shared >= (least - 1e-9) * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["fp", "root"]).filter(pa.array(keep, pa.bool_()))

    left, right = (made.select(F.col("node").alias(c), F.col("shingles").alias(f"{c}_set")) for c in "ab")
    compared = pairs.join(left, "a").join(right, "b").select("a", "b", "a_set", "b_set")
    return compared.mapInArrow(same, "fp long, root long")


def keep_one(docs: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """docs with one document of each group of near-duplicates, its smallest doc_id; one row of it if it is repeated.

    Documents with equal sets of shingles, and those linked by pairs of a Jaccard similarity of `least` or more, transitively, are a
    group. Candidates come from BK-trees of wide fingerprints and every link is checked on the texts, so nothing goes without a
    partner that similar. What these miss - a pair that shares none of the shards, or whose nearest are others - is between two
    groups: all pairs of different groups that can be similar are then checked too. Texts stay where they are: the ids to remove, and those to compare, are joined to them, by broadcast up to
    NARROW_ROWS counted rows, by a shuffle beyond. A repeated row is one with equal doc_id and text.
    """
    bare = docs.select("doc_id", "text")
    rows = materialize(text_sets(bare, width, least), "text-sets")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    nodes = materialize(rows.groupBy("node", "hi", "lo").agg(first, F.count("*").alias("n"), F.min("number").alias("number")), "nodes")

    def similar(pairs: DataFrame, key: str, name: str) -> DataFrame:
        possible = materialize(possible_pairs(rows, pairs, key, least), f"possible-{name}")
        return materialize(similar_links(bare, nodes, possible, width, least), name)

    mark = len(MADE)
    near = similar(materialize(candidate_links(nodes), "candidate-links"), "node", "similar-links")
    remove_since(docs.sparkSession, mark, near.scratch_path)
    labels = components(near)
    mark = len(MADE)
    pairs = materialize(remaining_pairs(rows, nodes, labels, least), "remaining-pairs")
    if not pairs.isEmpty():
        rest = similar(pairs, "number", "remaining-links")
        remove_since(docs.sparkSession, mark, rest.scratch_path)
        if not rest.isEmpty():
            labels = components(near.unionByName(rest))
    linked = materialize(labels.join(nodes, labels["fp"] == nodes["node"]).select("label", "node", "first"), "linked-sets")
    heads = small(materialize(linked.groupBy("label").agg(F.min("first").alias("head")), "heads"))
    headed = linked.join(heads, "label").select(F.col("node").alias("linked_node"), "head")
    # the rows to remove: all but the first of every set that has several rows or a link
    several = nodes.join(headed, nodes["node"] == headed["linked_node"], "left").filter("n > 1 OR head IS NOT NULL")
    several = several.select(F.col("node").alias("own_node"), F.coalesce("head", "first").alias("head"))
    others = rows.join(small(materialize(several, "several")), F.col("node") == F.col("own_node")).filter(~(F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("text_hash") == F.col("head.text_hash"))))
    gone = materialize(others.select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct(), "removed-ids")
    again = materialize(rows.groupBy("doc_id", "text_hash").count().filter("count > 1").select(F.col("doc_id").alias("again_id"), F.col("text_hash").alias("again_hash")), "repeated-ids")
    # columns by number, so that those added can't clash with them
    names = docs.columns
    numbered = docs.select(*[docs[c].alias(f"c{i}_") for i, c in enumerate(names)])
    own, text = F.col(f"c{names.index('doc_id')}_"), F.xxhash64(f"c{names.index('text')}_")
    is_in = lambda keys, name: own.eqNullSafe(keys[f"{name}_id"]) & (text == keys[f"{name}_hash"])
    gone = small(gone, NARROW_ROWS)
    stay = numbered.join(gone, is_in(gone, "gone"), "left_anti")
    if not again.isEmpty():
        again = small(again, NARROW_ROWS)
        once = stay.withColumn("hash_", text).join(again, is_in(again, "again"), "left_semi").dropDuplicates([f"c{names.index('doc_id')}_", "hash_"]).drop("hash_")
        stay = stay.join(again, is_in(again, "again"), "left_anti").unionByName(once)
    return stay.toDF(*names)


def op3_simhash(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
