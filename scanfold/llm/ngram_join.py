"""Near duplicates by Jaccard similarity of word n-grams, with a count-vector R-tree.

A document is the set of its distinct shingles. Two link when their sets' intersection is at least
``percent`` of their union; documents that links connect are a component.

1. Equal sets become one node. A shingle's rank is how common it is (from counts over all
   documents, in a table of one size) and then its hash. Linked sets share a shingle among the
   lowest ranked of each, so nodes meet at those keys. Ranking common shingles last keeps passages
   that many documents share from being keys.
2. Shingles are hashed into groups, and a set's counts by group are its point. The sum of the
   smaller counts of two points bounds the overlap of their sets. At each key, every node is first
   held against one of them, which joins dense groups in linear time.
3. Where nodes of different components still meet at a key, their points go into an R-tree. The
   smaller counts of two boxes' upper corners bound all pairs between them, so pairs of boxes are
   left out whole; what survives is verified. Keys with many nodes are cut into tiles and each pair of tiles is a
   task's work, so that no group meets in one place.

A pair is verified by the sets themselves. Words are runs without the six ASCII white-space characters, A-Z
in lower case; a text of fewer words than ``words`` has one shingle of them all; a null or empty
text has none and links with nothing. A null id gets no component. Rows that share an id are one document's
versions: a link of any of them is its link. An empty table gives an empty result. Texts are
read whole and only the two named columns are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanfold.llm.bpe import in_small_batches
from scanfold.llm.common import text_of
from scanfold.llm.components import connected
from scanfold.sources.workspace import stored

GROUPS = 64
CELLS = 1 << 22
LEAF = 32
TILE = 2000
FILTER_BITS = 1 << 24
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, words: int) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    if not len(hashes):
        return hashes
    width = min(words, len(hashes))
    folded = np.full(len(hashes) - width + 1, width, np.uint64)
    for k in range(width):
        folded = _mix(folded * _ODD + hashes[k:len(hashes) - width + 1 + k])
    return np.unique(folded)


def pack_counts(own: np.ndarray) -> bytes:
    """A set's counts by group of hashes, 64 groups or more for larger sets: a byte for the width
    of a count, then the counts. Groups are the hashes' leading bits, so neighbours can be added up
    to the counts of half as many groups."""
    bits = 6 + (len(own) // 256).bit_length()
    counts = np.bincount((own >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    width = 1 if counts.max() < 256 else 4
    return bytes([width]) + counts.astype(f"<u{width}").tobytes()


def unpack_counts(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def overlap_bound(x: np.ndarray, y: np.ndarray) -> int:
    """The sum of the smaller counts, over as many groups as both have."""
    groups = min(len(x), len(y))
    return int(np.minimum(x.reshape(groups, -1).sum(axis=1), y.reshape(groups, -1).sum(axis=1)).sum())


class Box:
    """A node of the R-tree: the upper corner of its points, and the range of their sizes."""

    __slots__ = ("rows", "children", "corner", "least", "most")

    def __init__(self, points: np.ndarray, sizes: np.ndarray, rows: np.ndarray):
        self.rows, self.children = rows, ()
        self.corner, self.least, self.most = points[rows].max(axis=0), sizes[rows].min(), sizes[rows].max()
        if len(rows) > LEAF:
            # Halve at the median of the coordinate that spreads most, the size being one of them.
            own = np.column_stack([sizes[rows], points[rows]])
            axis = int((own.max(axis=0) - own.min(axis=0)).argmax())
            order = rows[np.argsort(own[:, axis], kind="stable")]
            self.children = tuple(Box(points, sizes, x) for x in (order[:len(order) // 2], order[len(order) // 2:]))


def tree_pairs(points: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int):
    """(i, j) of rows, i from left and j from right, whose counts allow a link. Yields arrays."""
    if not len(left) or not len(right):
        return
    same = left is right
    a = Box(points, sizes, left)
    stack = [(a, a if same else Box(points, sizes, right))]
    while stack:
        a, b = stack.pop()
        # Overlap needed: percent / (100 + percent) of both sizes together.
        if 100 * a.most < percent * b.least or 100 * b.most < percent * a.least or \
                (100 + percent) * int(np.minimum(a.corner, b.corner).sum()) < percent * int(a.least + b.least):
            continue
        if a.children and (not b.children or len(a.rows) >= len(b.rows)):
            if a is b:
                x, y = a.children
                stack += [(x, x), (x, y), (y, y)]
            else:
                stack += [(x, b) for x in a.children]
        elif b.children:
            stack += [(a, x) for x in b.children]
        else:
            bound = np.minimum(points[a.rows][:, None, :], points[b.rows][None, :, :]).sum(axis=2)
            m, n = sizes[a.rows][:, None], sizes[b.rows][None, :]
            fits = ((100 + percent) * bound >= percent * (m + n)) & (100 * np.minimum(m, n) >= percent * np.maximum(m, n))
            if a is b:
                fits &= np.arange(len(a.rows))[:, None] < np.arange(len(b.rows))[None, :]
            i, j = np.nonzero(fits)
            if len(i):
                yield a.rows[i], b.rows[j]


def _common(texts: DataFrame, words: int) -> np.ndarray:
    """How common the shingles of each cell are, in powers of two; cells that stand out in no task have 0."""

    def run(batches):
        counts = np.zeros(CELLS, np.int32)
        for batch in in_small_batches(batches, 0):
            own = [(shingle_set(x, words) % np.uint64(CELLS)).astype(np.int64) for x in batch.column(0).to_pylist()]
            own = np.concatenate(own) if own else np.zeros(0, np.int64)
            cells, n = np.unique(own, return_counts=True)
            counts[cells] += n.astype(np.int32)
        cells = np.flatnonzero(counts >= 8 + 4 * counts.mean())
        yield pa.RecordBatch.from_pydict({"cell": cells, "n": counts[cells].astype(np.int64)})

    told = texts.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    level = np.zeros(CELLS, np.uint8)
    level[told["cell"].to_numpy(np.int64)] = np.ceil(np.log2(told["n"].to_numpy(float) + 1)).astype(np.uint8)
    return level


def _sketches(rows: DataFrame, words: int, percent: int, level: np.ndarray, seed: int) -> DataFrame:
    """id, node, proof (two hashes of the set), n, keys, counts of each row."""

    def run(batches):
        for batch in in_small_batches(batches, 1):
            nodes, proofs, sizes, keys, ends, counts = [], [], [], [], [0], []
            for text in batch.column(1).to_pylist():
                own = shingle_set(text, words)
                node, proof = _named(own, seed)
                nodes.append(node)
                proofs.append(proof)
                sizes.append(len(own))
                taken = len(own) - -(-percent * len(own) // 100) + 1 if len(own) else 0
                rank = np.lexsort((own, level[(own % np.uint64(CELLS)).astype(np.int64)]))
                keys.append(own[rank[:taken]].view(np.int64))
                ends.append(ends[-1] + taken)
                counts.append(pack_counts(own))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(nodes, pa.int64()), pa.array(proofs, pa.int64()), pa.array(sizes, pa.int64()),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))),
                pa.array(counts, pa.binary())], ["id", "node", "proof", "n", "keys", "counts"])

    return rows.mapInArrow(run, "id long, node long, proof long, n long, keys array<long>, counts binary")


def _named(own: np.ndarray, seed: int) -> tuple[int, int]:
    """128 bits for a set, as two numbers: its node and a proof."""
    digest = hashlib.md5(own.tobytes() + bytes([seed])).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _sets(rows: DataFrame, wanted: DataFrame, words: int, seed: int) -> DataFrame:
    """node, set of the wanted nodes (node, id): the sets are made again from the texts, where they are.

    A bit array of one size, by hashed id, leaves out most other rows before their text is split.
    """
    spot = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    told = wanted.select(F.shiftright(spot, 5).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(id), {FILTER_BITS}) & 31 as int))").alias("bit")).groupBy(
        "word").agg(F.bit_or("bit").alias("bits")).toPandas()
    bits = np.zeros(FILTER_BITS // 32, np.uint32)
    bits[told["word"].to_numpy(np.int64)] = told["bits"].to_numpy(np.int64).astype(np.uint32)

    def run(batches):
        for batch in in_small_batches(batches, 1):
            at = batch.column(2).to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array((bits[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1))
            own = [shingle_set(x, words) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([_named(x, seed)[0] for x in own], pa.int64()), pa.array([x.tobytes() for x in own], pa.binary())], ["id", "node", "set"])

    made = rows.withColumn("at", spot).mapInArrow(run, "id long, node long, set binary")
    return made.join(wanted, ["id", "node"]).select("node", "set")


def _verified(pairs: DataFrame, rows: DataFrame, heads: DataFrame, words: int, percent: int, seed: int) -> DataFrame:
    """The pairs (a, b) of nodes that link. ``heads``: node, id, n."""
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = stored(heads.join(ends, "node"), "jaccard-wanted")
    sets = stored(_sets(rows, wanted.select("id", "node"), words, seed).dropDuplicates(["node"]), "jaccard-sets")

    def run(batches):
        for batch in in_small_batches(batches, 2):
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    full = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b").select("a", "b", "x", "y")
    return stored(full.mapInArrow(run, "a long, b long"), "jaccard-links")


def _bounded(pairs: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sizes, and whose summed smaller counts, allow a link."""
    def side(node: str, n: str, counts: str) -> DataFrame:
        return heads.select(F.col("node").alias(node), F.col("n").alias(n), F.col("counts").alias(counts))

    full = pairs.join(side("a", "m", "x"), "a").join(side("b", "n", "y"), "b").filter(
        f"100 * least(m, n) >= {percent} * greatest(m, n)").select("a", "b", "m", "n", "x", "y")

    def run(batches):
        for batch in batches:
            keep = pa.array([(100 + percent) * overlap_bound(unpack_counts(x), unpack_counts(y)) >= percent * (m + n)
                             for m, n, x, y in zip(*(batch.column(c).to_pylist() for c in range(2, 6)))], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return full.mapInArrow(run, "a long, b long")


def _rest(members: DataFrame, roots: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes of different components that meet at a key and whose counts allow a link."""
    placed = stored(members.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")), "jaccard-members")
    # Keys with the same nodes are one group.
    groups = placed.groupBy("key").agg(F.count("*").alias("size"), F.sum(F.shiftright(F.xxhash64("node"), 20)).alias("sum"), F.bit_xor(F.xxhash64("node")).alias("xor"),
                                       F.min("root").alias("low"), F.max("root").alias("high"))
    groups = groups.filter("size > 2 and low < high").groupBy("size", "sum", "xor").agg(F.min("key").alias("key"))
    groups = stored(groups.select("key", F.ceil(F.col("size") / TILE).cast("int").alias("tiles")), "jaccard-groups")
    points = heads.select("node", "n", "counts")
    open_ = placed.join(groups, "key")
    open_ = stored(open_.join(points.join(open_.select("node").distinct(), "node", "left_semi"), "node"), "jaccard-open")
    tile = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    work = open_.withColumn("tile", tile).withColumn("other", other).select(
        "key", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "node", "root", "n", "counts")

    def run(batches):
        held: list[pa.RecordBatch] = []
        unit = None

        def pairs():
            table = pa.Table.from_batches(held)
            side = table.column("tile").to_numpy() == unit[1]
            nodes, roots, sizes = (table.column(c).to_numpy() for c in ("node", "root", "n"))
            counts = [unpack_counts(x) for x in table.column("counts").to_pylist()]
            points = np.stack([x.reshape(GROUPS, -1).sum(axis=1) for x in counts])
            every = np.arange(len(nodes))
            left, right = (every, every) if unit[1] == unit[2] else (every[side], every[~side])
            if unit[1] == unit[2]:
                right = left
            for x, y in tree_pairs(points, sizes, left, right, percent):
                apart = roots[x] != roots[y]
                # What the tree leaves is bounded once more by all groups that both points have.
                apart[apart] = [(100 + percent) * overlap_bound(counts[i], counts[j]) >= percent * (sizes[i] + sizes[j]) for i, j in zip(x[apart], y[apart])]
                if apart.any():
                    x, y = nodes[x[apart]], nodes[y[apart]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in (0, 1, 2)])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if stop == start:
                    continue
                now = tuple(int(x) for x in keys[:, start])
                if unit is not None and now != unit:
                    yield from pairs()
                    held = []
                unit = now
                held.append(batch.slice(start, stop - start))
        if held:
            yield from pairs()

    return work.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, percent: int = 85) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (the smallest id that links reach)."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    level = _common(rows.select("text"), words)
    for seed in range(256):
        sketches = stored(_sketches(rows, words, percent, level, seed), "jaccard-sketches")
        heads = stored(sketches.filter("n > 0 and id is not null").groupBy("node").agg(
            F.min("id").alias("id"), F.max("n").alias("n"), F.any_value("counts").alias("counts"), (F.min("proof") != F.max("proof")).alias("mixed")), "jaccard-heads")
        if heads.filter("mixed").isEmpty():
            break  # else two different sets share 64 bits, and another seed tells them apart
    heads = heads.drop("mixed")
    entries = sketches.filter("n > 0 and id is not null").select(F.explode("keys").alias("key"), "node")
    shared = stored(entries.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).filter("pivot < last"), "jaccard-keys")
    members = stored(entries.join(shared, "key").select("key", "node", "pivot").distinct(), "jaccard-meet")
    first = members.filter("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    first = stored(_bounded(first, heads, percent), "jaccard-first")
    # Texts of one id that differ are versions of one document.
    versions = sketches.filter("n > 0 and id is not null").select("id", "node").distinct()
    several = versions.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a < z")
    own = versions.join(several, "id").filter("a <> node").select("a", F.col("node").alias("b"))
    links = stored(_verified(first, rows, heads, words, percent, seed).unionByName(own), "jaccard-star")
    roots = connected(links)
    rest = stored(_rest(members.select("key", "node"), roots, heads, percent).join(first, ["a", "b"], "left_anti"), "jaccard-rest")
    if not rest.isEmpty():
        roots = connected(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(_verified(rest, rows, heads, words, percent, seed)))
    labels = heads.join(roots, "node", "left").select("node", "id", F.coalesce("root", "node").alias("root"))
    least = labels.groupBy("root").agg(F.min("id").alias("component_id"))
    labels = stored(labels.join(least, "root").select("node", "component_id"), "jaccard-labels")
    return sketches.select("id", "n", F.when(F.col("n") > 0, F.col("node")).alias("node")).join(labels, "node", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all their columns, one document of each component: that with the
    smallest id. Rows without an id have no component and stay."""
    kept = stored(near_duplicates(docs, id_col, text_col, words, percent).filter(
        F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("gone")).distinct(), "near-duplicates")
    return docs.join(kept, docs[id_col] == kept["gone"], "left_anti")
