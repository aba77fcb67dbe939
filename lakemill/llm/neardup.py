"""Near-duplicate documents by an LSH forest over MinHash signatures (operator 10)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakemill.llm.common import dropped, narrow, staged, tidy
from lakemill.llm.graph import components

#: Trees of the forest and MinHashes in the order of each. With REGION of them in common in a tree, documents share a
#: region there: two with a similarity of 0.8 do in one of the trees with a probability of 1 - (1 - 0.8 ** 4) ** 20 > 0.99997.
TREES, DEPTH, REGION = 20, 8, 4
#: Rows above which a region is split by one MinHash more, down to the whole order of a tree. Where all 20 trees are
#: crowded to the bottom, a pair of similarity 0.8 still meets in one of them with a probability of 1 - (1 - 0.8 ** 8) ** 20 > 0.97.
LEAF = 2048
#: In a region that is crowded at full depth, a document is compared at first with so many neighbours of longest common prefix.
NEIGHBOURS = 32
#: In the passes between components, so many pairs of two components in a region are tested at first, and so many times more in each further pass.
PAIRS, GROWTH = 4, 8
#: Candidates' estimated similarity lies so far below the threshold at most: over four standard errors of the estimate.
SLACK = 0.15
#: Bits of a set's parity map, in which every shingle flips one bit: two maps differ in no more bits than the sets in shingles.
PARITY = 1024
#: Rows of a region above which it is dealt out: by its deeper regions first; at full depth in the first pass by blocks of
#: so many rows that share the region's first row, in the passes between components by pairs of such blocks.
HOT = 50_000
#: Rows up to which a table of region keys, nodes or their texts' digests (at most 66 bytes each) is broadcast.
KEYS = 500_000
K = TREES * DEPTH
#: Bytes of a node: a flag for a null id, the least document id, a digest.
NODE = 25
_rng = np.random.default_rng(20)
_A = _rng.integers(0, 2**32, K, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 2**32, K, dtype=np.uint32)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, n: int = 2) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its ``n``-word shingles; of the whole sequence if it has fewer words; none without words."""
    whole = pa.concat_arrays([texts]).cast(pa.large_string()).fill_null("")  # kernels misread some slices; a copy is safe
    words = pc.ascii_split_whitespace(pc.ascii_lower(whole))
    coded, ends = words.flatten(), np.asarray(words.offsets) - words.offsets[0].as_py()
    coded = coded.dictionary_encode()
    hashes = np.asarray([xxhash.xxh64_intdigest(x) for x in coded.dictionary.to_pylist()], np.uint64)
    empty = np.asarray([x == "" for x in coded.dictionary.to_pylist()], bool)
    order = coded.indices.to_numpy(zero_copy_only=False)
    flat = hashes[order] if len(hashes) else np.empty(0, np.uint64)
    void = empty[order] if len(hashes) else np.empty(0, bool)
    out = []
    for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        own = flat[lo:hi]
        if len(own) and (void[lo] or void[hi - 1]):  # white space at the ends leaves empty words there
            own = own[~void[lo:hi]]
        m = min(n, len(own))
        if not m:
            out.append(own)
            continue
        x = np.full(len(own) - m + 1, m, np.uint64)
        for k in range(m):
            x = _mixed(x * np.uint64(0x9E3779B97F4A7C15) + own[k : len(own) - m + 1 + k])
        out.append(np.unique(x))
    return out


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Per set its MinHashes' low 16 bits, and two mixed bits of each packed 32 to a word."""
    sig = np.full((len(sets), K), 2**32 - 1, np.uint32)
    for k, x in enumerate(sets):
        h = (x >> np.uint64(32)).astype(np.uint32)
        for lo in range(0, len(h), 4096):
            sig[k] = np.minimum(sig[k], (((h[lo : lo + 4096, None] ^ _B) * _A)).min(0))
    mixed = (sig ^ (sig >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    two = ((mixed >> np.uint32(12)) & np.uint32(3)).astype(np.uint64).reshape(len(sets), K // 32, 32)
    packed = (two << (2 * np.arange(32, dtype=np.uint64))).sum(2, dtype=np.uint64)
    return ((mixed >> np.uint32(16)).astype(">u2")), packed


def parity_map(shingles: np.ndarray) -> bytes:
    odd = np.bincount((shingles & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def document_signatures(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, digest (128 bits of the set; null if empty), forest (all trees' orders), bits, parity and text_hash (128 bits), a narrow row a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, len(whole), 1024):
                b = whole.slice(lo, 1024)
                sets = shingle_sets(b.column(1), shingle)
                orders, packed = signatures(sets)
                yield pa.RecordBatch.from_arrays([
                    b.column(0), pa.array([len(x) for x in sets], pa.int64()),
                    pa.array([xxhash.xxh128_digest(x.tobytes()) if len(x) else None for x in sets], pa.binary()),
                    pa.array([x.tobytes() for x in orders], pa.binary()), pa.array([x.tobytes() for x in packed], pa.binary()), pa.array([parity_map(x) for x in sets], pa.binary()), b.column(2),
                ], ["doc_id", "n_shingles", "digest", "forest", "bits", "parity", "text_hash"])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long"), text.alias("text"), text_digest(text).alias("text_hash"))
    return rows.mapInArrow(tidy(run), "doc_id long, n_shingles long, digest binary, forest binary, bits binary, parity binary, text_hash binary")


def text_digest(text: Column) -> Column:
    """128 bits that stand for a text; null for null."""
    return F.unhex(F.md5(text.cast("binary")))


def node_of(least: Column, digest: Column) -> Column:
    """A class of equal sets as bytes that sort by its least document id, null last, then by digest."""
    ordered = F.lpad(F.hex(F.coalesce(least, F.lit(0)).bitwiseXOR(F.lit(-(2**63)))), 16, "0")
    return F.concat(F.unhex(F.concat(F.when(least.isNull(), "01").otherwise("00"), ordered)), digest)


def least_of(node: Column) -> Column:
    """The document id that ``node_of`` put first."""
    value = F.conv(F.hex(F.substring(node, 2, 8)), 16, 10).cast("decimal(20,0)") - F.lit(str(2**63)).cast("decimal(20,0)")
    return F.when(F.hex(F.substring(node, 1, 1)) == "00", value.cast("long"))


def by_tree(rows: DataFrame) -> DataFrame:
    """A row for each tree with its order."""
    trees = F.explode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.struct(t.alias("tree"), F.substring("forest", t * 2 * DEPTH + 1, F.lit(2 * DEPTH)).alias("order"))))
    return rows.withColumn("x", trees).drop("forest").select("*", "x.tree", "x.order").drop("x")


def region_key(depth: int) -> Column:
    return F.xxhash64(F.lit(depth), "tree", F.substring("order", 1, 2 * depth))


def crowded(rows: DataFrame, hot: int) -> list[DataFrame]:
    """For each depth from REGION on the keys of the regions of more than ``hot`` rows, as far as there are any; those of full depth with their blocks and first node.

    Few enough to broadcast: ``hot`` is at least a hundred-thousandth of all trees' rows, which only sets how finely work is dealt.
    """
    trees = by_tree(rows.select("node", "forest"))
    hot = max(hot, TREES * rows.count() // 100_000)
    levels: list[DataFrame] = []
    for depth in range(REGION, DEPTH + 1):
        own = trees
        if levels:
            own = own.withColumn("key", region_key(depth - 1)).join(F.broadcast(levels[-1].select("key")), "key", "left_semi")
        last = (F.min("node").alias("first"),) if depth == DEPTH else ()
        large = own.groupBy(region_key(depth).alias("key")).agg(F.count("*").alias("n"), *last).filter(F.col("n") > hot)
        large = staged(large.select("key", F.ceil(F.col("n") / hot).alias("blocks"), *(["first"] if last else [])), "forest-crowded")
        if large.isEmpty():
            break
        levels.append(large)
    return levels


def dealt_regions(rows: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """A row for each tree with the key of its region: the first depth at which that isn't crowded; ``blocks`` and ``first`` of crowded ones of full depth."""
    rows = by_tree(rows)
    key = region_key(REGION)
    if not levels:
        return rows.select("*", key.alias("key"), F.lit(None).cast("long").alias("blocks"), F.lit(None).cast("binary").alias("first"))
    for n, large in enumerate(levels):
        depth = REGION + n
        here = large.select(F.col("key").alias(f"k{depth}"), *([F.col("blocks"), F.col("first")] if depth == DEPTH else []))
        rows = rows.join(F.broadcast(here), region_key(depth) == F.col(f"k{depth}"), "left")
        if depth < DEPTH:
            key = F.when(F.col(f"k{depth}").isNull(), key).otherwise(region_key(depth + 1)) if n == 0 else F.when(F.col(f"k{depth}").isNotNull(), region_key(depth + 1)).otherwise(key)
    if "blocks" not in rows.columns:
        rows = rows.withColumns({"blocks": F.lit(None).cast("long"), "first": F.lit(None).cast("binary")})
    return rows.withColumn("key", key).drop(*(f"k{REGION + n}" for n in range(len(levels))))


def _binary(x: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(x.dtype.itemsize), len(x), [None, pa.py_buffer(np.ascontiguousarray(x).tobytes())]).cast(pa.binary())


def _fixed(column: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), f"S{size}")


class Regions:
    """Rows of whole regions, sorted by key and order: where each region starts and ends, split by depth where crowded."""

    def __init__(self, key: np.ndarray, order: np.ndarray, leaf: int):
        n = len(key)
        border = np.concatenate([[True], key[1:] != key[:-1]])
        words = order.view(">u2").reshape(n, DEPTH)
        for depth in range(REGION, DEPTH + 1):
            starts = np.flatnonzero(border)
            sizes = np.diff(np.append(starts, n))
            wide = np.repeat(sizes > leaf, sizes)
            if depth == DEPTH or not wide.any():
                break
            border[1:] |= wide[1:] & (words[1:, depth] != words[:-1, depth])
        self.starts, self.sizes = starts, sizes
        self.end = np.repeat(starts + sizes, sizes)
        self.wide = wide


def spanning(i: np.ndarray, j: np.ndarray, s: np.ndarray, n: int) -> np.ndarray:
    """Indices of a forest of greatest similarity among the edges, round by round: each component takes its best edge."""
    rank = np.empty(len(i), np.int64)
    rank[np.lexsort((j, i, -s))] = np.arange(len(i))
    by_rank = np.argsort(rank)
    label, alive, kept = np.arange(n), np.arange(len(i)), []
    while True:
        x, y = label[i[alive]], label[j[alive]]
        apart = x != y
        alive, x, y = alive[apart], x[apart], y[apart]
        if not len(alive):
            return np.concatenate(kept) if kept else alive
        ends, other, r = np.concatenate([x, y]), np.concatenate([y, x]), np.concatenate([rank[alive]] * 2)
        order = np.lexsort((r, ends))
        first = order[np.concatenate([[True], ends[order][1:] != ends[order][:-1]])]
        kept.append(by_rank[np.unique(r[first])])
        parent = np.arange(n)
        parent[ends[first]] = other[first]
        turn = ends[first][(parent[parent[ends[first]]] == ends[first]) & (ends[first] < parent[ends[first]])]
        parent[turn] = turn  # two components that chose each other: the smaller is the root
        while not np.array_equal(up := parent[parent], parent):
            parent = up
        label = parent[label]


def region_forests(rows: DataFrame, levels: list[DataFrame], least: float, percent: int, leaf: int = LEAF) -> DataFrame:
    """Candidate pairs a < b of nodes with the region's key and the estimated similarity; a = b marks a region in which not all were compared.

    In the sorted order of every tree, all rows of a region are compared and a forest that spans what is similar is
    returned. In regions crowded at full depth, rows are compared with their neighbours in the order (longest common prefix).
    If all edges of a forest are links, none is missing between its rows; else ``between`` searches the region again.
    """
    rows = dealt_regions(rows.drop("parity"), levels)
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    cells = F.when(F.col("blocks").isNull(), F.array(F.lit(None).cast("long"))).when(F.col("node") == F.col("first"), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array(own))
    dealt = rows.withColumns({"cell": F.explode(cells), "of": F.col("key")}).withColumn("key", F.when(F.col("cell").isNull(), F.col("key")).otherwise(F.xxhash64("key", "cell")))
    dealt = dealt.select("key", "order", "node", "bits", F.col("n_shingles").alias("n"), F.col("blocks").isNotNull().alias("open"), "of")

    def searched(key: np.ndarray, order: np.ndarray, nodes: np.ndarray, bits: np.ndarray, sizes: np.ndarray, dealt_out: np.ndarray, of: np.ndarray) -> Iterator[pa.RecordBatch]:
        regions = Regions(key, order, leaf)
        rest, o = np.flatnonzero(np.repeat(regions.sizes > 1, regions.sizes)), 0
        open_ = regions.starts[regions.wide[regions.starts] | dealt_out[regions.starts]]
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def forest() -> tuple[np.ndarray, ...]:
            i, j, s = (np.concatenate(x) for x in zip(*held, strict=True))
            at = spanning(i, j, s, len(key))
            return i[at], j[at], s[at]

        while True:
            o += 1
            rest = rest[rest + o < regions.end[rest]]
            if o == NEIGHBOURS + 1:
                rest = rest[~regions.wide[rest]]
            if not len(rest):
                break
            for lo in range(0, len(rest), 1 << 18):
                x = rest[lo : lo + (1 << 18)]
                x = x[100 * np.minimum(sizes[x], sizes[x + o]) >= percent * np.maximum(sizes[x], sizes[x + o])]
                s = estimate(bits[x], bits[x + o])
                x, s = x[s >= least], s[s >= least]
                if len(x):
                    held.append((x, x + o, s))
                    size += len(x)
            if size > 1 << 20:
                held = [forest()]
                size = len(held[0][0])
        i, j, s = forest() if held else (np.empty(0, int), np.empty(0, int), np.empty(0, np.float32))
        swap = nodes[i] > nodes[j]
        a, b = np.where(swap, nodes[j], nodes[i]), np.where(swap, nodes[i], nodes[j])
        a, b, at = np.concatenate([a, nodes[open_]]), np.concatenate([b, nodes[open_]]), np.concatenate([i, open_])
        yield pa.RecordBatch.from_arrays([_binary(a), _binary(b), pa.array(of[at]), pa.array(np.concatenate([s, np.ones(len(open_), np.float32)]))], ["a", "b", "key", "similar"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from whole_regions(batches, lambda b: (np.asarray(b.column(0)), _fixed(b.column(1), 2 * DEPTH), _fixed(b.column(2), NODE), _words(b.column(3)), np.asarray(b.column(4)), b.column(5).to_numpy(zero_copy_only=False), np.asarray(b.column(6))), searched)

    return dealt.repartition("key").sortWithinPartitions("key", "order", "node").mapInArrow(tidy(run), "a binary, b binary, key long, similar float")


def _words(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


def whole_regions(batches: Iterator[pa.RecordBatch], read, searched) -> Iterator[pa.RecordBatch]:
    """Calls ``searched`` with the columns of rows up to where a key (the first column) ends."""
    held: list[tuple[np.ndarray, ...]] = []
    for b in batches:
        if not len(b):
            continue
        new = read(b)
        last = int(np.searchsorted(new[0], new[0][-1]))  # its region may go on
        if last or (held and held[-1][0][-1] != new[0][0]):
            yield from searched(*(np.concatenate(x) for x in zip(*held, tuple(x[:last] for x in new), strict=True)))
            held = []
        held.append(tuple(x[last:] for x in new))
    if held:
        yield from searched(*(np.concatenate(x) for x in zip(*held, strict=True)))


def between(rows: DataFrame, levels: list[DataFrame], least: float, percent: int, most: int, only: DataFrame, leaf: int = LEAF) -> DataFrame:
    """Candidate pairs a < b of nodes of different components that share a region: every two of its rows are compared.

    ``rows`` has node, bits, parity, forest, n_shingles and label (of the component). Pairs that cannot reach ``percent`` by the
    sizes and parity maps are out for certain, others by their estimate. Of two components, the ``most`` similar pairs
    of a region are returned, with its key; ``more`` says that there are others. ``only`` has the keys to search (of
    ``dealt_regions``). What is crowded at full depth and dealt out meets by pairs of blocks; regions of one component are passed over.
    """
    rows = dealt_regions(rows, levels).join(narrow(only, KEYS), "key", "left_semi")
    if len(levels) <= DEPTH - REGION:
        dealt = rows.withColumn("side", F.lit(0).cast("byte"))
    else:
        mixed = rows.filter("blocks is not null").groupBy("key").agg((F.min("label") != F.max("label")).alias("mixed")).filter("not mixed")
        rows = rows.join(F.broadcast(staged(mixed.select("key"), "forest-single")), "key", "left_anti")
        own = F.pmod(F.xxhash64("node"), F.col("blocks"))
        cells = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda t: F.struct(F.least(own, t).alias("lo"), F.greatest(own, t).alias("hi"), F.when(own == t, 0).when(own < t, 1).otherwise(2).cast("byte").alias("side")))
        alone = F.array(F.struct(F.lit(None).cast("long").alias("lo"), F.lit(None).cast("long").alias("hi"), F.lit(0).cast("byte").alias("side")))
        dealt = rows.withColumn("cell", F.explode(F.when(F.col("blocks").isNull(), alone).otherwise(cells)))
        dealt = dealt.withColumns({"side": F.col("cell.side"), "of": F.col("key"), "key": F.when(F.col("blocks").isNull(), F.col("key")).otherwise(F.xxhash64("key", "cell.lo", "cell.hi"))})
    if "of" not in dealt.columns:
        dealt = dealt.withColumn("of", F.col("key"))
    dealt = dealt.select("key", "order", "label", "side", "node", "bits", F.col("n_shingles").alias("n"), "of", "parity")

    def cut(i: np.ndarray, j: np.ndarray, s: np.ndarray, key: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, ...]:
        """The most similar pairs of each two components of a region, and whether these have more."""
        x, y = np.minimum(label[i], label[j]), np.maximum(label[i], label[j])
        order = np.lexsort((-s, y, x, key[i]))
        i, j, s, x, y = i[order], j[order], s[order], x[order], y[order]
        new = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (key[i[1:]] != key[i[:-1]])]))
        n = np.diff(np.append(new, len(i)))
        keep = np.arange(len(i)) - np.repeat(new, n) < most
        return i[keep], j[keep], s[keep], np.repeat(n > most, n)[keep]

    def searched(key, order, label, side, nodes, bits, sizes, of, parity) -> Iterator[pa.RecordBatch]:
        regions = Regions(key, order, leaf)
        mixed = np.minimum.reduceat(label, regions.starts) != np.maximum.reduceat(label, regions.starts)
        end, rest, o = regions.end, np.flatnonzero(np.repeat(mixed, regions.sizes)), 0
        if not len(rest):
            return
        held: list[tuple[np.ndarray, ...]] = []
        cutoff: set[tuple[int, int, int]] = set()

        def told() -> pa.RecordBatch:
            i, j, s, more = cut(*(np.concatenate(x) for x in zip(*held, strict=True)), key, label)
            if cutoff:  # pairs were left out before
                more = more | np.asarray([(int(key[p]), *sorted((int(label[p]), int(label[q])))) in cutoff for p, q in zip(i, j, strict=True)], bool)
            swap = nodes[i] > nodes[j]
            a, b = np.where(swap, nodes[j], nodes[i]), np.where(swap, nodes[i], nodes[j])
            return pa.RecordBatch.from_arrays([_binary(a), _binary(b), pa.array(of[i]), pa.array(more, pa.bool_())], ["a", "b", "key", "more"])

        size = 0
        while True:
            o += 1
            rest = rest[rest + o < end[rest]]
            if not len(rest):
                break
            i = rest[(label[rest] != label[rest + o]) & ((side[rest] == 0) | (side[rest] != side[rest + o]))]
            i = i[100 * np.minimum(sizes[i], sizes[i + o]) >= percent * np.maximum(sizes[i], sizes[i + o])]
            for lo in range(0, len(i), 1 << 18):
                x = i[lo : lo + (1 << 18)]
                s = estimate(bits[x], bits[x + o])
                x, s = x[s >= least], s[s >= least]
                differ = np.bitwise_count(parity[x] ^ parity[x + o]).sum(1, dtype=np.int64)
                near = (100 + percent) * differ <= (100 - percent) * (sizes[x] + sizes[x + o])
                x, s = x[near], s[near]
                if len(x):
                    held.append((x, x + o, s))
                    size += len(x)
            if size > 1 << 20:
                x, y, s, more = cut(*(np.concatenate(z) for z in zip(*held, strict=True)), key, label)
                cutoff |= {(int(key[p]), *sorted((int(label[p]), int(label[q])))) for p, q in zip(x[more], y[more], strict=True)}
                held, size = [(x, y, s)], len(x)
                if size > 1 << 19:  # pairs of many components
                    yield told()
                    held, size = [], 0
        if held:
            yield told()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from whole_regions(batches, lambda b: (np.asarray(b.column(0)), _fixed(b.column(1), 2 * DEPTH), np.asarray(b.column(2)), np.asarray(b.column(3)), _fixed(b.column(4), NODE), _words(b.column(5)), np.asarray(b.column(6)), np.asarray(b.column(7)), _words(b.column(8))), searched)

    return dealt.repartition("key").sortWithinPartitions("key", "order", "node").mapInArrow(tidy(run), "a binary, b binary, key long, more boolean")


def estimate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The similarity estimated from two bits of each MinHash, which agree by chance in a quarter of the cases."""
    apart = x ^ y
    apart = (apart | (apart >> np.uint64(1))) & np.uint64(0x5555555555555555)
    same = 1 - np.bitwise_count(apart).sum(1) / K
    return ((same - 0.25) / 0.75).astype(np.float32)


def confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs of nodes whose full shingle sets have 100 * intersection >= percent * union. ``texts``: node, text."""
    a, b = (texts.select(F.col("node").alias(k), F.col("text").alias(f"text_{k}")) for k in ("a", "b"))
    both = pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, len(whole), 1024):
                x = whole.slice(lo, 1024)
                keep = []
                for p, q in zip(shingle_sets(x.column(2), shingle), shingle_sets(x.column(3), shingle), strict=True):
                    joint = len(p) + len(q) - len(np.union1d(p, q))
                    keep.append(100 * joint >= percent * (len(p) + len(q) - joint))
                yield x.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(tidy(run), "a binary, b binary")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, leaf: int = LEAF) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, node and text_hash of every document.

    Documents with equal sets are one class at once, by a 128-bit digest. Classes' candidates come from the forest and are
    confirmed on the full sets read from the texts: first each class's most similar candidate, then every candidate
    that still joins two components. Regions with a candidate that was no link are searched again between components,
    until no two components share a region with a candidate that was not tested.
    A text without words (or a null one) has no set and no links; its component is its own id. Null ids never become a
    component's id while there is another; rows of a null id get the component of their text. Repeated rows are one class,
    ties go to the smaller id, very long texts are taken whole, further columns don't matter, an empty table gives no rows.
    """
    with dropped(docs.sparkSession) as keep:
        return keep(_near_duplicates(docs, shingle, percent, id_col, text_col, hot, leaf), "near-duplicates")


def _near_duplicates(docs: DataFrame, shingle: int, percent: int, id_col: str, text_col: str, hot: int, leaf: int) -> DataFrame:
    known = staged(document_signatures(docs, shingle, id_col, text_col), "forest-signatures")
    of_set = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash", "n_shingles", "forest", "bits", "parity"))
    classes = known.filter("digest is not null").groupBy("digest").agg(of_set.alias("x"))
    classes = staged(classes.select("digest", node_of(F.col("x.doc_id"), F.col("digest")).alias("node"), F.col("x.doc_id").alias("doc_id"), F.col("x.text_hash").alias("text_hash"), "x.n_shingles", "x.forest", "x.bits", "x.parity"), "forest-classes")
    single = classes.select("node", "n_shingles", "forest", "bits", "parity")
    levels = crowded(single, hot)
    least = percent / 100 - SLACK
    pairs = staged(region_forests(single, levels, least, percent, leaf), "forest-pairs")
    text = F.col(text_col).cast("string")
    own = docs.select(F.col(id_col).cast("long").alias("d"), text.alias("text"), text_digest(text).alias("h"))

    def texts_of(pairs: DataFrame) -> DataFrame:
        used = classes.select("node", F.col("doc_id").alias("own_id"), "text_hash").join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi")
        used = narrow(staged(used, "forest-used"), KEYS)
        texts = own.join(used, F.col("d").eqNullSafe(F.col("own_id")) & (F.col("h") == F.col("text_hash"))).groupBy("node").agg(F.min("text").alias("text"))
        return staged(texts, "forest-texts")

    def apart(pairs: DataFrame) -> DataFrame:
        """The pairs of different components."""
        for k in ("a", "b"):
            pairs = pairs.join(found.select(F.col("node").alias(k), F.col("root").alias(f"root_{k}")), k, "left")
        return pairs.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).drop("root_a", "root_b")

    every = staged(pairs.filter("a <> b").groupBy("a", "b").agg(F.max("similar").alias("similar")), "forest-pairs")
    texts = texts_of(every)
    nearest = every.select(F.explode(F.array(F.struct(F.col("a").alias("of"), F.col("b").alias("to"), "similar"), F.struct(F.col("b").alias("of"), F.col("a").alias("to"), "similar"))).alias("x")).groupBy("x.of").agg(F.max(F.struct("x.similar", "x.to")).alias("best"))
    first = nearest.select(F.least("of", "best.to").alias("a"), F.greatest("of", "best.to").alias("b")).distinct()
    links = staged(confirmed(first, texts, shingle, percent), "forest-links")
    found = components(links)
    more = staged(confirmed(apart(every.join(first, ["a", "b"], "left_anti")), texts, shingle, percent), "forest-links")
    if not more.isEmpty():
        found = components(links.union(more))
    tested, most = every.select("a", "b"), PAIRS
    only = staged(apart(pairs.filter("a <> b")).select("key").union(pairs.filter("a = b").select("key")).distinct(), "forest-open")
    while not only.isEmpty():
        labelled = single.join(narrow(found, KEYS), "node", "left").select("node", "n_shingles", "bits", "parity", "forest", F.xxhash64(F.coalesce("root", "node")).alias("label"))
        near = staged(between(labelled, levels, least, percent, most, only, leaf), "forest-between")
        new = staged(near.select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"), "forest-pairs")
        if not new.isEmpty():
            more = staged(confirmed(new, texts_of(new), shingle, percent), "forest-links")
            if not more.isEmpty():
                found = components(found.select(F.col("root").alias("a"), F.col("node").alias("b")).union(more))
            tested = tested.union(new)
        only = staged(apart(near.filter("more")).select("key").distinct(), "forest-open")
        most *= GROWTH
    grouped = staged(classes.select("digest", "node").join(found, "node", "left").select("digest", "node", least_of(F.coalesce("root", "node")).alias("component")), "forest-components")
    out = known.select("doc_id", "n_shingles", "digest", "text_hash").join(grouped, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), F.col("digest").alias("node"), "text_hash")
    return out
