"""N-gram Jaccard join: documents whose sets of word shingles are at least 0.8 alike.

Words are runs without ASCII white space, A-Z lower-cased; a document's set holds
its distinct shingles of five words (all its words if fewer).  Every pair with
Jaccard similarity of at least ``percent`` / 100 is found; the result gives connected components.

1. Documents with equal sets become one node.  A sketch of fixed size counts
   every shingle of every document; shingles in crowded cells are the frequent
   class, the others the rare one.  Sets are ordered by class, then by hash.
2. Prefixes: of a set of n, at most t = n - need elements may be missing from the
   other, so t + 1 leading rare elements are indexed singly.  Where rare ones
   don't suffice, the prefix is extended into the frequent class, whose elements are
   indexed by pairs: they are dealt to M classes, and a class with k elements in
   the prefix withstands k - 1 losses.  The prefix ends when the losses it
   withstands reach t + 1.  M depends on the size only by powers of two, and a set is
   indexed for every power that a partner may have, so partners meet.
3. Nodes that share an index entry are candidates.  For single entries, shared
   entries are counted by pair, and pairs that can't reach the need are dropped.
   Entries of pairs of frequent elements only link nodes of like size in a star.
   The components of these candidates are blocks.  All links lie inside blocks.
4. Blocks are cut into tiles of about TILE nodes.  For each tile one task counts
   the shared elements of all its nodes as a matrix product, compares exactly,
   and returns a spanning forest of the links.  What is linked is contracted: in blocks
   of several tiles, one node of each component goes on to a new round of tiles, until
   rounds find no more.  Blocks that are then one component are done; in the others
   every pair of tiles is compared in the same way.

Nothing is sampled or capped: the sketch and the tiles bear on cost alone.
Elements are 64-bit hashes.

Null or blank text: no shingles, component of its own.  Rows that repeat get
equal rows.  Null doc_id: takes part, and is never a component's name unless all
its members are null.  Empty table: empty result.  Other columns are ignored.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import byte_kernel as bk
from .common import at_most, map_arrow, row_key, share, shared, small_side, written
from .components import components

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CELL_BITS, CHUNK_BITS = 22, 16
TILE = 256
#: Shingles whose entries one task of the candidate search holds, about.
TASK_SHINGLES = 4_000_000
#: Candidates up to so many rows are broadcast to find their texts (24 bytes each).
BROADCAST_ROWS = 500_000
U = np.uint64


def need_of(n, percent: int):
    """The least overlap with which a set of n can have a partner: |x & y| >= percent / 100 * n."""
    return -(-n * percent // 100)


def _sets(column):
    for lo, hi, data, offsets in bk.slices(column):
        starts, ends, firsts = bk.word_bounds(data, offsets)
        yield lo, hi, *bk.shingle_sets(bk.word_hashes(data, starts, ends), firsts)


def node_ids(shingles: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit id of each set; 0 for empty ones."""
    with np.errstate(over="ignore"):
        sums = np.zeros(len(shingles) + 1, U)
        np.cumsum(bk.mix(shingles ^ U(0x5851F42D4C957F2D)), out=sums[1:])
        n = np.diff(offsets).astype(U)
        ids = bk.mix(sums[offsets[1:]] - sums[offsets[:-1]] + n * U(0x8BB84B93962EACC9))
    return np.where(n > 0, ids | U(1), U(0)).view(np.int64)


FIRST = "chunk int, doc_id long, row_key long, node long, n int, counts binary"


def _first_pass(batches):
    """A row per document (chunk null), then the task's cell counts by chunk of cells."""
    cells, waiting, held, seen = np.zeros(1 << CELL_BITS, np.int32), [], 0, set()
    null = lambda k, t: pa.nulls(k, t)
    names = ["chunk", "doc_id", "row_key", "node", "n", "counts"]
    for b in batches:
        for lo, hi, shingles, offsets in _sets(b.column(2)):
            nodes, n = node_ids(shingles, offsets), np.diff(offsets)
            fresh = np.zeros(len(nodes), bool)  # of equal sets, a task counts one
            for i, v in enumerate(nodes.tolist()):
                if v not in seen:
                    seen.add(v)
                    fresh[i] = True
            waiting.append((shingles[np.repeat(fresh, n)] >> U(64 - CELL_BITS)).astype(np.int64))
            held += len(waiting[-1])
            if held > 1_000_000:
                cells += np.bincount(np.concatenate(waiting), minlength=len(cells)).astype(np.int32)
                waiting, held = [], 0
            k = hi - lo
            yield pa.RecordBatch.from_arrays([null(k, pa.int32()), b.column(0).slice(lo, k), b.column(1).slice(lo, k), pa.array(nodes), pa.array(n.astype(np.int32)), null(k, pa.binary())], names)
    if waiting:
        cells += np.bincount(np.concatenate(waiting), minlength=len(cells)).astype(np.int32)
    parts = np.minimum(cells, 255).astype(np.uint8).reshape(-1, 1 << CHUNK_BITS)
    for at in range(0, len(parts), 8):
        some = [i for i in range(at, min(at + 8, len(parts))) if parts[i].any()]
        k = len(some)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), null(k, pa.int64()), null(k, pa.int64()), null(k, pa.int64()), null(k, pa.int32()), pa.array([parts[i].tobytes() for i in some], pa.binary())], names)


def _sum_cells(batches):
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for chunk, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x = np.frombuffer(counts, np.uint8)
            total[chunk] = total[chunk] + x if chunk in total else x.astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([np.minimum(x, 2**32 - 1).astype("<u4").tobytes() for x in total.values()], pa.binary())], ["chunk", "counts"])


def frequency_classes(counts: DataFrame, shingles: int) -> np.ndarray:
    """A class for each of the sketch's cells: 0 rare, then by powers of two of the count.  The sketch has a fixed size (4 M cells)."""
    cells = np.zeros((1 << (CELL_BITS - CHUNK_BITS), 1 << CHUNK_BITS), np.int64)
    summed = map_arrow(counts.repartition(at_most(counts, len(cells)), "chunk"), _sum_cells, "chunk int, counts binary")
    for r in summed.toLocalIterator():
        cells[r["chunk"]] = np.frombuffer(r["counts"], "<u4")
    load = shingles / cells.size
    limit = load + 6 * load**0.5 + 24
    return np.where(cells.ravel() <= limit, 0, 1 + np.log2(np.maximum(1, cells.ravel() / limit)).astype(np.int64)).astype(np.uint8)


SIGNATURE = "sig long, node long, n int, rare int, kind byte"
#: kind of an entry: of a set indexed by single elements only; single, of a set with pairs; a pair.
PLAIN, SINGLE, PAIR = 0, 1, 2


def levels(n: int, percent: int) -> range:
    """The powers of two that a set of n or a partner of it may have."""
    return range(need_of(n, percent).bit_length() - 1, (n * 100 // percent).bit_length())


def classes_at(level: int, percent: int) -> int:
    return max(1, (percent << level) // 400)


def pair_entries(frequent: np.ndarray, rare: int, n: int, percent: int) -> np.ndarray:
    """Hashes of the pairs that index a set: frequent elements in order, after so many rare ones."""
    lost, out = n - need_of(n, percent) + 1, []
    for level in levels(n, percent):
        m = classes_at(level, percent)
        own = (frequent >> U(7)) % U(m)
        _, first = np.unique(own, return_index=True)
        gain = np.ones(len(own), np.int64)
        gain[first] = 0
        end = int(np.searchsorted(rare + np.cumsum(gain), lost)) + 1
        order = np.argsort(own[:end], kind="stable")
        own, x = own[:end][order], frequent[:end][order]
        for d in range(1, len(x)):
            same = own[d:] == own[:-d]
            if not same.any():
                break
            a, b = x[:-d][same], x[d:][same]
            with np.errstate(over="ignore"):
                out.append(bk.mix(np.minimum(a, b) * bk.PLACES[40] + np.maximum(a, b) * bk.PLACES[41] + U(level + 1) * bk.PLACES[42]))
    return np.concatenate(out) if out else frequent[:0]


def _signatures(batches, classes, percent: int):
    classes, seen = shared(classes), set()
    names = ["sig", "node", "n", "rare", "kind"]
    for b in batches:
        for _, _, shingles, offsets in _sets(b.column(0)):
            nodes, n = node_ids(shingles, offsets), np.diff(offsets)
            owner = np.repeat(np.arange(len(n)), n)
            kind = classes[(shingles >> U(64 - CELL_BITS)).astype(np.int64)]
            order = np.argsort(owner * 256 + kind, kind="stable")
            shingles, kind = shingles[order], kind[order]
            rare = np.bincount(owner[kind == 0], minlength=len(n)) if len(owner) else np.zeros(len(n), np.int64)
            need = n - need_of(n, percent) + 1
            leading = np.minimum(need, rare)
            fresh = np.zeros(len(n), bool)
            for i, v in enumerate(nodes.tolist()):
                if n[i] >= 4 and v not in seen:  # sets of up to three have no partners but equal ones
                    seen.add(v)
                    fresh[i] = True
            place = np.arange(len(shingles)) - np.repeat(offsets[:-1], n)
            take = (place < np.repeat(leading, n)) & np.repeat(fresh, n)
            who = owner[take]
            yield pa.RecordBatch.from_arrays(
                [pa.array(shingles[take].view(np.int64)), pa.array(nodes[who]), pa.array(n[who].astype(np.int32)), pa.array(leading[who].astype(np.int32)), pa.array(np.where(rare < need, SINGLE, PLAIN)[who].astype(np.int8))], names
            )
            for i in np.flatnonzero(fresh & (rare < need)):
                sig = pair_entries(shingles[offsets[i] + rare[i] : offsets[i + 1]], int(rare[i]), int(n[i]), percent)
                k = len(sig)
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(np.full(k, nodes[i])), pa.array(np.full(k, n[i], np.int32)), pa.array(np.full(k, rare[i], np.int32)), pa.array(np.full(k, PAIR, np.int8))], names)


CANDIDATE = "x long, y long, shared int, nx int, rx int, kx byte, ny int, ry int, ky byte"


def _runs(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1], True]) if len(sig) else np.zeros(1, np.int64)
    return edge[:-1], np.diff(edge)


def _candidates(batches, percent: int):
    """Of one partition of entries: pairs with the count of shared single entries (kx < PAIR), and stars of pair entries (kx = PAIR)."""
    parts = [[b.column(i).to_numpy(zero_copy_only=False) for i in range(5)] for b in batches if b.num_rows]
    if not parts:
        return
    sig, node, n, rare, kind = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((node, n, sig))
    sig, node, n, rare, kind = (x[order] for x in (sig, node, n, rare, kind))
    keep = np.ones(len(sig), bool)
    keep[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])  # equal sets of several tasks
    start, length = _runs(sig[keep])
    many = np.repeat(length > 1, length)
    sig, node, n, rare, kind = (x[keep][many] for x in (sig, node, n, rare, kind))
    single = kind < PAIR
    first, second, shared = [], [], []

    def out(i, j, count):
        columns = [node[i], node[j], count.astype(np.int32), n[i], rare[i], kind[i], n[j], rare[j], kind[j]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [f.split()[0] for f in CANDIDATE.split(", ")])

    # Stars: in a run in order of size, the centre is the first node as long as sizes allow; the next centre is tied to the node before it.
    at = np.flatnonzero(~single & (100 * (n - rare).astype(np.int64) >= percent * n.astype(np.int64)))
    begin, size = _runs(sig[at])
    for s, k in zip(begin.tolist(), size.tolist()):
        if k > 1:
            run = at[s : s + k]
            c = 0
            while c < k:
                end = c + int(np.searchsorted(n[run[c:]], n[run[c]] * 100 // percent, side="right"))
                first.append(np.full(end - c - 1, run[c]))
                second.append(run[c + 1 : end])
                if end < k and 100 * int(n[run[end - 1]]) >= percent * int(n[run[end]]):
                    first.append(run[end - 1 : end])
                    second.append(run[end : end + 1])
                c = end
    if first:
        i, j = np.concatenate(first), np.concatenate(second)
        _, one = np.unique(np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j])]), axis=1, return_index=True)
        yield out(i[one], j[one], np.zeros(len(one)))
    # Pairs of single entries, by distance within the run; counts are summed here before the shuffle.
    at = np.flatnonzero(single)
    sigs = sig[at]
    first, second, held, d = [], [], 0, 0
    live = np.arange(len(at))
    while len(live):
        d += 1
        live = live[live + d < len(at)]
        live = live[sigs[live] == sigs[live + d]]
        i, j = at[live], at[live + d]
        fits = 100 * n[i].astype(np.int64) >= percent * n[j].astype(np.int64)  # n rises within a run
        first.append(i[fits])
        second.append(j[fits])
        live = live[fits]
        held += len(first[-1])
        if held > 2_000_000 or not len(live):
            i, j = np.concatenate(first), np.concatenate(second)
            if len(i):
                swap = node[i] > node[j]
                i, j = np.where(swap, j, i), np.where(swap, i, j)
                o = np.lexsort((node[j], node[i]))
                i, j = i[o], j[o]
                edge = np.flatnonzero(np.r_[True, (node[i][1:] != node[i][:-1]) | (node[j][1:] != node[j][:-1]), True])
                yield out(i[edge[:-1]], j[edge[:-1]], np.diff(edge))
            first, second, held = [], [], 0


def _texts_to_sets(batches):
    for b in batches:
        for lo, hi, shingles, offsets in _sets(b.column(0)):
            data, o = pa.py_buffer(np.ascontiguousarray(shingles)), pa.py_buffer((offsets * 8).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(1).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), b.column(3).slice(lo, hi - lo), pa.Array.from_buffers(pa.binary(), hi - lo, [None, o, data])], ["node", "block", "tiles", "elements"])


def _links(group, percent: int):
    """A spanning forest of the links of one pair of tiles."""
    node, one = np.unique(group.column("node").to_numpy(), return_index=True)  # rows that repeat
    elements = group.column("elements")
    sets = [np.frombuffer(elements[i].as_buffer(), U) for i in one.tolist()]
    tile = group.column("tile").to_numpy()[one]
    n = np.array([len(s) for s in sets], np.int64)
    elements, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    _, column, count = np.unique(elements, return_inverse=True, return_counts=True)
    column, owner = column[keep := count[column] > 1], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    column = np.cumsum(np.r_[0, column[1:] != column[:-1]]) if len(column) else column
    common, width = np.zeros((len(sets), len(sets)), np.int64), max(64, min(8192, 8_000_000 // len(sets)))
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (lo, lo + width))
        m = np.zeros((len(sets), width), np.float32)
        m[owner[a:b], column[a:b] - lo] = 1
        common += (m @ m.T).astype(np.int64)
    link = (100 + percent) * common >= percent * (n[:, None] + n[None, :])
    if tile.min() != tile.max():
        link &= tile[:, None] != tile[None, :]
    np.fill_diagonal(link, True)
    label = np.arange(len(sets), dtype=np.int32)
    while True:
        low = np.where(link, label[None, :], np.int32(len(sets))).min(axis=1)
        low = np.minimum(low, low[low])
        if (low == label).all():
            break
        label = low
    far = label != np.arange(len(sets))
    return pa.table([pa.array(node[far]), pa.array(node[label[far]])], ["x", "y"])


FOREST = "x long, y long"
ELEMENTS = "node long, block long, tiles int, elements binary"


def block_links(docs: DataFrame, wanted: DataFrame, percent: int) -> DataFrame:
    """A spanning forest (x, y) of the links inside blocks.  wanted: rep_id, rep_key, node, block, tiles."""

    def sets_of(some: DataFrame) -> DataFrame:
        """One row of each candidate node brings its text; rows that share a doc_id are told apart by their text's hash."""
        texts = docs.join(small_side(some, BROADCAST_ROWS), F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("row_key") == F.col("rep_key")))
        return map_arrow(texts.select("text", "node", "block", "tiles"), _texts_to_sets, ELEMENTS)

    compare = lambda rows: rows.groupBy("block", "a", "b").applyInArrow(lambda t: _links(t, percent), FOREST)
    tile = F.pmod(F.xxhash64("node"), "tiles").cast("int")
    one = lambda rows: compare(rows.select("block", tile.alias("a"), tile.alias("b"), "node", tile.alias("tile"), "elements"))
    forest = written(one(sets_of(wanted)), "forest")
    big = wanted.filter("tiles > 1")
    if big.isEmpty():
        return forest
    big = written(sets_of(big).dropDuplicates(["block", "node"]), "big_blocks")
    counted = None
    while True:
        label = components(forest).select(F.col("v").alias("node"), "component")
        named = big.select("node", "block").join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
        nodes = written(named.groupBy("block", "component").agg(F.min("node").alias("node")), "contracted")
        left = nodes.groupBy("block").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        left = written(left.select("block", "n", F.ceil(F.col("n") / TILE).cast("int").alias("tiles")), "open_blocks")
        total, many = left.agg(F.sum("n"), F.max("tiles")).first()
        if not total:
            return forest
        if total == counted:
            break
        counted = total
        chosen = big.drop("tiles").join(nodes.join(left, "block").select("node", "tiles"), "node")
        forest = written(forest.union(one(chosen)), "forest")
    # Blocks in which a round linked nothing more: every pair of tiles, but those compared above.
    still = big.join(left.select("block"), "block", "left_semi").withColumn("tile", tile)
    still = still.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).filter("tile <> other")
    return forest.union(compare(still.select("block", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), "node", "tile", "elements")))


def jaccard_components(df: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """One row per row of df: doc_id, n_shingles, component_id."""
    spark = df.sparkSession
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), row_key(doc_id, text).alias("row_key"), F.col(text).alias("text"))
    first = written(map_arrow(docs, _first_pass, FIRST), "sets")
    members = first.filter("chunk is null").select("doc_id", "row_key", "node", "n")
    nodes = members.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("name"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("rep"), F.first("n").alias("n"))
    total = nodes.agg(F.sum(F.col("n").cast("long"))).first()[0] or 0
    classes = share(spark, frequency_classes(first.filter("chunk is not null").select("chunk", "counts"), total))
    entries = map_arrow(docs.select("text"), lambda b: _signatures(b, classes, percent), SIGNATURE)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // TASK_SHINGLES)
    pairs = written(map_arrow(entries.repartition(tasks, "sig"), lambda b: _candidates(b, percent), CANDIDATE), "candidates")
    classes.destroy()
    both = (F.col("kx") == SINGLE) & (F.col("ky") == SINGLE)
    restx, resty = F.col("nx") - F.col("rx"), F.col("ny") - F.col("ry")
    rest = F.when(both, F.least(restx, resty)).when(F.col("kx") == SINGLE, resty).when(F.col("ky") == SINGLE, restx).otherwise(F.greatest(restx, resty))
    counted = pairs.filter(F.col("kx") < PAIR).groupBy("x", "y").agg(F.sum("shared").alias("shared"), *[F.first(c).alias(c) for c in ("nx", "rx", "kx", "ny", "ry", "ky")])
    alike = counted.filter((100 + percent) * (F.col("shared") + rest) >= percent * (F.col("nx") + F.col("ny"))).select("x", "y")
    blocks = components(alike.union(pairs.filter(F.col("kx") == PAIR).select("x", "y"))).select(F.col("v").alias("node"), F.col("component").alias("block"))
    tiles = blocks.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"))
    wanted = written(blocks.join(tiles, "block").join(nodes, "node").select(F.col("rep.doc_id").alias("rep_id"), F.col("rep.row_key").alias("rep_key"), "node", "block", "tiles"), "wanted")
    found = components(block_links(docs, wanted, percent)).select(F.col("v").alias("node"), "component")
    named = nodes.join(found, "node", "left").select("node", "name", F.coalesce("component", "node").alias("component"))
    names = named.groupBy("component").agg(F.min("name").alias("least"))
    named = named.join(names, "component").select("node", "least")
    return members.join(named, "node", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))
