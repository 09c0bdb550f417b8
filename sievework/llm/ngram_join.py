"""Similarity join on word shingles with vertical partitioning.

Texts with equal shingle sets are one node. The n-grams stand in one global order, that of their hashes, and pivots cut this
order into fragments; a set falls into segments, one for each fragment.

1. Candidates. If two sets of n and m n-grams are similar enough, they differ in at most d = (n + m) (1 - s) / (1 + s)
   n-grams, so at most d segments differ. Sets of one size class are cut at the same pivots, into somewhat more than d
   fragments. Each set hands on its first d + 1 segments of two n-grams or more: of these at least one is equal to the
   other's, which hands it on too. Sets of two classes meet on a third grid, that of the boundary between the classes. A set
   with too few such segments hands on single n-grams, those of a prefix filter; if both sets of a pair are like that
   they meet there. So no similar pair is missed, and hardly any others meet: the n-grams of a passage that thousands of texts
   share are spread over the fragments, among other n-grams of each text.
2. Partial overlaps. Nodes that share segments form groups around a hub, the group's most central node; a group is
   dealt into blocks of at most BLOCK nodes, with the hub in each. Fragments of a block are tasks of their own: each counts the
   overlaps within its fragment for all pairs of the block, as one matrix.
3. Sums. The matrices of a block's fragments are summed per pair; in a block the nodes of each component point at the
   least of them, so links grow with the members of a group, not with their pairs. The blocks of a
   group share its hub and some landmarks.
4. In groups that stay open, that is, have several blocks and nodes outside their largest component, these nodes are compared with all of the
   group, if that sends a set to few blocks, or few sets in all beside the table. Larger ones (pages of one template, say) are grouped anew by
   single n-grams: the n-grams of their sets are put in order of frequency among them, and each set hands on as many of its rarest as it may
   differ in, and one more. What a template gives all of its pages is frequent and makes none of them meet. Steps 2 to 4 follow once more on the new groups.

Defined cases: null and blank texts have an empty set, are linked with nothing and are their own component; repeated rows and
identifiers are fine, a null identifier counts as least; an empty table gives an empty result; other columns, whatever their
names, are not read. Sets are compared by 64-bit hashes of n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytestrings import mixed, ragged, utf8
from .components import connected_components
from .scratch import Scratch, release
from .shingles import shingle_sets
from .text import whole

#: Nodes of a block; n-grams of a fragment when overlaps are counted; least n-grams of a segment that is handed on.
BLOCK, FRAGMENT, SEGMENT = 256, 256, 2
#: Segments are deduplicated among so many at a time before they are shuffled.
COMBINE = 1 << 20
#: Nodes of a group, about, that stand in each of its blocks, so that what is linked at all is one component after one turn.
LANDMARKS = 16
#: Blocks that a set of an open group goes to, on average, before the group is grouped anew instead.
COPIES = 8
#: Sets that all such groups together may send to blocks without being grouped anew, as a share of the table's rows.
SHARE = 0.75
#: Frequent n-grams of open groups that travel to the sets are fewer than this.
FREQUENT = 1 << 16
_ROOM = 1.15  # fragments for each segment that is needed: some are too small to be handed on


def _sets(batch: pa.RecordBatch, words: int) -> Iterator[tuple[int, np.ndarray]]:
    data, off = utf8(batch.column("text"))
    return shingle_sets(data, off, words)


def _node(h: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(h.tobytes()) - (1 << 63)


def _grids(n: np.ndarray, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Which sets are cut on which grid: sets (indices into n), grid (a number for each), fragments of it, and how many segments
    may differ between the set and a similar one on that grid.

    Class c holds the sizes from 2**c to 2**(c+1) - 1. Grid 2c is that of class c; grid 2c - 1 that of sizes on both sides of 2**c.
    """
    c = np.frexp(n.astype(float))[1].astype(np.int64) - 1
    edge = np.int64(1) << c
    largest = n * high // low  # of a similar set
    least = -(-n * low // high)

    def differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a + b) * (high - low) // (high + low)

    def fragments(size: np.ndarray) -> np.ndarray:
        return np.ceil((differ(size, size) + 1) * _ROOM).astype(np.int64) + 1

    every = np.arange(len(n))
    yield every, 2 * c, fragments(2 * edge - 1), differ(n, np.minimum(2 * edge - 1, largest))
    up = np.flatnonzero(largest >= 2 * edge)
    yield up, 2 * c[up] + 1, fragments((2 * edge[up] - 1) * high // low), differ(n[up], largest[up])
    down = np.flatnonzero(least < edge)
    yield down, 2 * c[down] - 1, fragments((edge[down] - 1) * high // low), differ(n[down], edge[down] - 1)


def segments(sets: list[np.ndarray], low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """token, set: what the sets hand on; similar sets have a token in common."""
    n = np.array([len(h) for h in sets], np.int64)
    starts = np.cumsum(n) - n
    grams = np.concatenate(sets)
    spread = mixed(grams)
    token, owner = [], []
    short = np.zeros(len(sets), bool)
    for which, grid, fragments, differ in _grids(n, low, high):
        if not len(which):
            continue
        size = n[which]
        at = ragged(starts[which], size)
        own = np.repeat(np.arange(len(which)), size)
        fragment = (grams[at] >> np.uint64(32)) * fragments[own].astype(np.uint64) >> np.uint64(32)
        opens = np.flatnonzero(np.append(True, (fragment[1:] != fragment[:-1]) | (own[1:] != own[:-1])))
        content = np.add.reduceat(spread[at], opens)
        fit = np.diff(np.append(opens, len(at))) >= SEGMENT
        who = own[opens]
        turn = np.cumsum(fit) - fit  # segments that fit, before this one
        turn -= turn[np.flatnonzero(np.append(True, who[1:] != who[:-1]))][who]
        use = fit & (turn <= differ[who])
        short[which] |= np.bincount(who, weights=fit, minlength=len(which)) <= differ
        place = mixed(grid.astype(np.uint64)[who[use]] << np.uint64(40) | fragment[opens][use])
        token.append(mixed(content[use] ^ place))
        owner.append(which[who[use]])
    few = np.flatnonzero(short)
    first = n[few] - -(-low * n[few] // high) + 1
    token.append(mixed(grams[ragged(starts[few], first)] ^ np.uint64(0x5851F42D4C957F2D)))
    owner.append(np.repeat(few, first))
    return np.concatenate(token), np.concatenate(owner)


_NAMES = ["id", "n", "token", "hub", "node"]


def _handed_on(words: int, low: int, high: int):
    """Rows (id, n, node) of all texts, and rows (token, hub, node). Of nodes with one token only the least goes on to be matched
    (hub is null); the others are bound to it here, so that a token of very many nodes comes as a few rows."""

    def combined(token: np.ndarray, node: np.ndarray, id_type: pa.DataType) -> pa.RecordBatch:
        order = np.lexsort((node, token))
        token, node = token[order], node[order]
        fresh = np.append(True, (token[1:] != token[:-1]) | (node[1:] != node[:-1]))
        token, node = token[fresh], node[fresh]
        first = np.append(True, token[1:] != token[:-1])
        hub = node[np.flatnonzero(first)][np.cumsum(first) - 1]
        none = len(token)
        return pa.record_batch([pa.nulls(none, id_type), pa.nulls(none, pa.int64()), pa.array(token), pa.array(hub, mask=first), pa.array(node)], names=_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, node, held, id_type = [], [], 0, pa.null()
        for batch in batches:
            sets = [h for _, h in _sets(batch, words)]
            n, own = np.array([len(h) for h in sets], np.int64), np.array([_node(h) for h in sets], np.int64)
            none, id_type = batch.num_rows, batch.column("id").type
            yield pa.record_batch([batch.column("id"), pa.array(n), pa.nulls(none, pa.int64()), pa.nulls(none, pa.int64()), pa.array(own)], names=_NAMES)
            sets, own = [h for h in sets if len(h)], own[n > 0]
            if not sets:
                continue
            t, owner = segments(sets, low, high)
            token.append((t >> np.uint64(16)).astype(np.int64)), node.append(own[owner])
            held += len(t)
            if held >= COMBINE:
                yield combined(np.concatenate(token), np.concatenate(node), id_type)
                token, node, held = [], [], 0
        if held:
            yield combined(np.concatenate(token), np.concatenate(node), id_type)

    return run


def _bind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by token and node: of a token's rows the first is the hub of the others; rows of texts and bound ones stay."""
    last, top = None, 0
    for batch in batches:
        token, hub = batch.column("token"), batch.column("hub")
        free = token.is_valid().to_numpy(zero_copy_only=False) & hub.is_null().to_numpy(zero_copy_only=False)
        yield batch.filter(pa.array(~free))
        token, node = token.filter(pa.array(free)).to_numpy(), batch.column("node").to_numpy()[free]
        if not len(token):
            continue
        first = np.append(token[0] != last, token[1:] != token[:-1])
        hub = np.append(top, node[first])[np.cumsum(first)]
        last, top = token[-1], hub[-1]
        other = node != hub
        if other.any():
            none = int(other.sum())
            yield pa.record_batch([pa.nulls(none, batch.column("id").type), pa.nulls(none, pa.int64()), pa.array(token[other]), pa.array(hub[other]), pa.array(node[other])], names=_NAMES)


def _arrays(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(_node(h), len(h), h.tobytes()) for _, h in _sets(batch, words) if len(h)]
            if found:
                node, n, grams = zip(*found)
                yield pa.record_batch([pa.array(node, pa.int64()), pa.array(n, pa.int64()), pa.array(grams, pa.binary())], names=["node", "n", "grams"])

    return run


_PIECE = "hub long, i int, j int, fragment int, side byte, node long, comp long, n long, grams binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every set of a block into the block's fragments, empty ones too, so that all fragments have the same rows."""
    keys = ("hub", "i", "j", "side", "node", "comp", "n")
    for batch in batches:
        rows, fragment, piece = [], [], []
        for r, (f, grams) in enumerate(zip(batch.column("fragments").to_pylist(), batch.column("grams").to_pylist())):
            h = np.frombuffer(grams, np.uint64)
            cuts = np.searchsorted((h >> np.uint64(32)) * np.uint64(f) >> np.uint64(32), np.arange(f + 1, dtype=np.uint64)).tolist()
            rows += [r] * f
            fragment += range(f)
            piece += [grams[8 * a : 8 * b] for a, b in zip(cuts, cuts[1:])]
            if len(rows) >= 4096:
                yield _taken(batch, keys, rows, fragment, piece)
                rows, fragment, piece = [], [], []
        if rows:
            yield _taken(batch, keys, rows, fragment, piece)


def _taken(batch: pa.RecordBatch, keys: tuple, rows: list, fragment: list, piece: list) -> pa.RecordBatch:
    part = batch.select(keys).take(pa.array(rows))
    columns = {k: part.column(k) for k in keys} | {"fragment": pa.array(fragment, pa.int32()), "grams": pa.array(piece, pa.binary())}
    return pa.record_batch({k: columns[k] for k in ("hub", "i", "j", "fragment", "side", "node", "comp", "n", "grams")})


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups of rows that come sorted by keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(c).to_numpy() for c in keys])
        cuts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            own = tuple(k[:, a].tolist())
            if held and own != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = own
    if held:
        yield pa.Table.from_batches(held)


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """|a & b| for every a of left and b of right, within one fragment."""
    every = np.concatenate(left + right)
    owner = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in left + right])
    order = np.argsort(every, kind="stable")
    gram, owner = every[order], owner[order]
    column = np.cumsum(np.append(True, gram[1:] != gram[:-1])) - 1 if len(gram) else np.zeros(0, np.int64)
    shared = (np.bincount(column, weights=owner < len(left)) > 0) & (np.bincount(column, weights=owner >= len(left)) > 0)
    use = shared[column]
    owner, column = owner[use], (np.cumsum(shared) - 1)[column[use]]
    sums = np.zeros((len(left), len(right)), np.float32)
    for f in range(0, int(shared.sum()), 4096):
        a, b = np.searchsorted(column, (f, f + 4096))
        present = np.zeros((len(left) + len(right), 4096), np.float32)
        present[owner[a:b], column[a:b] - f] = 1
        sums += present[: len(left)] @ present[len(left) :].T
    return sums.astype(np.int32)


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per fragment of a block: the overlaps of its pairs as one matrix. Side 0 is compared with side 1, side 2 with itself."""
    for t in _groups(batches, ["hub", "i", "j", "fragment"]):
        side, node, comp, n = (t.column(c).to_numpy() for c in ("side", "node", "comp", "n"))
        grams = [np.frombuffer(x, np.uint64) for x in t.column("grams").to_pylist()]
        lists = []
        for other in (1, 0):  # a node that comes twice, from repeated identifiers, counts once
            at = np.flatnonzero(side != other)
            lists.append(at[np.unique(node[at], return_index=True)[1]])
        left, right = lists
        if not len(left) or not len(right):
            continue
        both = overlaps([grams[r] for r in left], [grams[r] for r in right])
        names = np.concatenate([x[s] for s in (left, right) for x in (node, comp, n)])
        one = lambda c: [t.column(c)[0]]
        yield pa.record_batch([*(pa.array(one(c)) for c in ("hub", "i", "j")), pa.array([len(left)], pa.int32()), pa.array([names.tobytes()], pa.binary()), pa.array([both.tobytes()], pa.binary())], names=["hub", "i", "j", "left", "nodes", "both"])


def _summed(low: int, high: int):
    """Per block: the fragments' matrices summed per pair; components so far that are linked point at the least of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, ["hub", "i", "j"]):
            k = t.column("left")[0].as_py()
            names = np.frombuffer(t.column("nodes")[0].as_py(), np.int64)
            (node, comp, n), m = names[: 3 * k].reshape(3, -1), len(names) // 3 - k
            node2, comp2, n2 = names[3 * k :].reshape(3, -1)
            both = np.zeros((k, m), np.int64)
            for x in t.column("both"):
                both += np.frombuffer(x.as_buffer(), np.int32).reshape(k, m)
            union = n[:, None] + n2[None, :] - both
            a, b = np.nonzero((high * both >= low * union) & (comp[:, None] != comp2[None, :]))
            parent: dict[int, int] = {}

            def root(x: int) -> int:
                while parent.setdefault(x, x) != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            for x, y in zip(comp[a].tolist(), comp2[b].tolist()):
                p, q = root(x), root(y)
                parent[max(p, q)] = min(p, q)
            edges = [(x, r) for x in list(parent) if (r := root(x)) != x]
            if edges:
                x, y = zip(*edges)
                yield pa.record_batch([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])

    return run


def _links(blocks: DataFrame, arrays: DataFrame, low: int, high: int) -> DataFrame:
    """a, b: links within blocks. blocks: hub, i, j, side, node, comp, hub_n."""
    width = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fragments = F.ceil(F.col("hub_n") / FRAGMENT).cast("int")
    sets = blocks.join(arrays, "node").select("hub", "i", "j", "side", "node", "comp", "n", fragments.alias("fragments"), "grams")
    pieces = sets.mapInArrow(_cut, _PIECE).repartition(width, "hub", "i", "j", "fragment").sortWithinPartitions("hub", "i", "j", "fragment")
    partial = pieces.mapInArrow(_partial, "hub long, i int, j int, left int, nodes binary, both binary")
    return partial.repartition(width, "hub", "i", "j").sortWithinPartitions("hub", "i", "j").mapInArrow(_summed(low, high), "a long, b long")


def _around(members: DataFrame, scratch: Scratch, name: str = "") -> DataFrame:
    """hub, node: groups such that two nodes with a token in common stand in one."""
    # What a step needs of a token's rows, or a node's, is worked out where these rows meet, so a step is one shuffle.
    members = members.repartition(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), "token").distinct()
    # Tokens of the same nodes are one: near copies share most of their segments.
    tokens = members.groupBy("token").agg(F.count(F.lit(1)).alias("met"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(2))).alias("y"))
    tokens = tokens.groupBy("met", "x", "y").agg(F.min("token").alias("token"), F.count(F.lit(1)).alias("times")).select("token", "met", "times")
    met = scratch.write(members.join(tokens, "token"), f"met{name}")
    token, node = Window.partitionBy("token"), Window.partitionBy("node")
    # A text that others were made from shares most with them: a token's hub is its most central node.
    seen = met.withColumn("central", F.sum(F.col("met") * F.col("times")).over(node)).withColumn("top", F.max(F.struct("central", "node")).over(token))
    # Each node looks to its most central hub; a token whose nodes all look to one hub takes that one.
    seen = seen.withColumn("to", F.max("top").over(node)["node"])
    seen = seen.select("node", F.col("top.node").alias("hub"), F.min("to").over(token).alias("a"), F.max("to").over(token).alias("b"))
    return scratch.write(seen.select(F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("hub")).alias("hub"), "node").distinct(), f"around{name}")


def _with_size(around: DataFrame, arrays: DataFrame) -> DataFrame:
    """hub, node, hub_n: with the size of the hub's set."""
    return around.join(arrays.select(F.col("node").alias("hub"), F.col("n").alias("hub_n")), "hub")


def _spot(salt: int, parts: str) -> Column:
    return F.pmod(F.xxhash64("node", F.lit(salt)), F.col(parts)).cast("int")


def _block_links(around: DataFrame, arrays: DataFrame, low: int, high: int) -> DataFrame:
    """Links within blocks: every group in blocks of about BLOCK nodes; the hub and a few landmarks of the group stand in all of them."""
    sizes = around.groupBy("hub").agg(F.count(F.lit(1)).alias("m"))
    dealt = around.join(sizes, "hub").withColumn("parts", F.ceil(F.col("m") / BLOCK).cast("int"))
    every = (F.col("hub") == F.col("node")) | ((F.col("parts") > 1) & (_spot(0, "m") < LANDMARKS))
    places = F.when(every, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(_spot(1, "parts")))
    blocks = dealt.select("hub", F.explode(places).alias("i"), F.lit(0).alias("j"), F.lit(2).cast("byte").alias("side"), "node", F.col("node").alias("comp"), "hub_n")
    return _links(blocks, arrays, low, high)


def _open_groups(around: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes with their group and component, groups of several blocks with nodes outside their largest component: hub, main, parts, strips, copies, wide).

    copies: how many sets would be sent to blocks if these nodes were compared with all of the group; wide: these are more than COPIES
    for each set of the group.
    """
    labelled = around.join(roots, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
    main = labelled.groupBy("hub", "comp").agg(F.count(F.lit(1)).alias("k")).groupBy("hub").agg(F.max(F.struct("k", "comp")).alias("top"), F.sum("k").alias("m")).filter(f"m > {BLOCK} and m > top.k")
    outside = F.col("m") - F.col("top.k")
    sized = main.select("hub", F.col("top.comp").alias("main"), "m", outside.alias("outside"), F.ceil(F.col("m") / BLOCK).cast("int").alias("parts"), F.ceil(outside / BLOCK).cast("int").alias("strips"))
    copies = F.col("outside") * F.col("parts") + F.col("m") * F.col("strips")
    return labelled, sized.select("hub", "main", "parts", "strips", copies.alias("copies"), (copies > COPIES * F.col("m")).alias("wide"))


def _unsettled(labelled: DataFrame, main: DataFrame) -> DataFrame:
    """node, outside: nodes of open groups, and whether any of these has them outside its largest component."""
    return labelled.join(main, "hub").groupBy("node").agg(F.max(F.col("comp") != F.col("main")).alias("outside"))


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """token, row: the n-grams of a batch's sets."""
    sets = [np.frombuffer(x, np.int64) for x in batch.column("grams").to_pylist()]
    return np.concatenate([*sets, np.zeros(0, np.int64)]), np.repeat(np.arange(len(sets)), [len(x) for x in sets])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """token, met, any_outside: how many sets of a batch have an n-gram, and whether one of them is outside."""
    for batch in batches:
        every, own = _flat(batch)
        token, at, met = np.unique(every, return_inverse=True, return_counts=True)
        outside = batch.column("outside").to_numpy(zero_copy_only=False).astype(bool)
        yield pa.record_batch([pa.array(token), pa.array(met.astype(np.int64)), pa.array(np.bincount(at, weights=outside[own], minlength=len(token)) > 0)], names=["token", "met", "any_outside"])


def _rarest(token: np.ndarray, met: np.ndarray, any_outside: np.ndarray, low: int, high: int):
    """Rows (token, node, n, before) of sets, given the frequent n-grams. Of these a set hands on what its place leaves to it (before is null); its
    other n-grams stand behind as many as it has of the frequent ones (before)."""
    by_token = np.argsort(token)
    token, any_outside = token[by_token], any_outside[by_token]
    place = np.empty(len(token), np.int64)
    place[np.lexsort((token, met[by_token]))[::-1]] = np.arange(len(token))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every, own = _flat(batch)
            n = batch.column("n").to_numpy()
            at = np.searchsorted(token, every)
            often = np.append(token, 0)[at] == every
            often &= at < len(token)
            who, which = own[often], at[often]
            order = np.lexsort((place[which], who))
            who, which = who[order], which[order]
            before = np.bincount(who, minlength=batch.num_rows)
            behind = np.arange(1, len(who) + 1) - (np.cumsum(before) - before)[who]
            use = (behind > -(-n * low // high)[who] - 1) & any_outside[which]
            for t, o, b in ((token[which[use]], who[use], pa.nulls(int(use.sum()), pa.int64())), (every[~often], own[~often], pa.array(before[own[~often]].astype(np.int64)))):
                yield pa.record_batch([pa.array(t), batch.column("node").take(pa.array(o)), pa.array(n[o]), b], names=["token", "node", "n", "before"])

    return run


def _rare_members(unsettled: DataFrame, arrays: DataFrame, low: int, high: int, scratch: Scratch) -> DataFrame:
    """token, node: for each unsettled node as many of its rarest n-grams as a similar set may lack, and one more; tokens that only one node has,
    or none that is outside, make no pair and are left out.

    An n-gram of more than a block of nodes (a template's) would come as a row for each of them, of which hardly any is handed on. Such n-grams
    are fewer than FREQUENT: they travel to the sets, and only the others are joined with their counts.
    """
    sets = scratch.write(arrays.join(unsettled, "node").select("node", "outside", "n", "grams"), "open_sets")
    counts = sets.mapInArrow(_counted, "token long, met long, any_outside boolean").groupBy("token").agg(F.sum("met").alias("met"), F.max("any_outside").alias("any_outside"))
    counts = scratch.write(counts.filter("met > 1"), "counts")
    most = max(BLOCK, (counts.agg(F.sum("met")).first()[0] or 0) // FREQUENT)
    frequent = counts.filter(F.col("met") > most).toArrow()  # fewer than FREQUENT, as each has more than that share of all
    table = (frequent.column(c).to_numpy() for c in ("token", "met", "any_outside"))
    handed = scratch.write(sets.mapInArrow(_rarest(*table, low, high), "token long, node long, n long, before long"), "grams")
    # n-grams that nobody else has come first, so a node's shared ones stand behind as many as it has of those
    shared = handed.filter("before is not null").join(counts.filter(F.col("met") <= most), "token")
    order = Window.partitionBy("node").orderBy(F.desc("met"), F.desc("token"))
    spare = F.ceil(F.col("n") * F.lit(low) / F.lit(high)) - 1
    rest = shared.withColumn("behind", F.col("before") + F.row_number().over(order)).filter((F.col("behind") > spare) & F.col("any_outside"))
    return handed.filter("before is null").select("token", "node").union(rest.select("token", "node"))


def _strip_links(labelled: DataFrame, main: DataFrame, arrays: DataFrame, low: int, high: int) -> DataFrame:
    """In open groups: links between what is outside the largest component and the whole group."""
    labelled = labelled.join(main, "hub")
    left = labelled.filter("comp <> main").select("hub", _spot(2, "strips").alias("i"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("j"), F.lit(0).cast("byte").alias("side"), "node", "comp", "hub_n")
    right = labelled.select("hub", F.explode(F.sequence(F.lit(0), F.col("strips") - 1)).alias("i"), _spot(3, "parts").alias("j"), F.lit(1).cast("byte").alias("side"), "node", "comp", "hub_n")
    return _links(left.unionByName(right), arrays, low, high)


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """Per row: id_col, n_shingles, component_id. Texts link when high * intersection >= low * union."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "ngrams")
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).alias("id"), whole(F.col(text_col)).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    kind = f"id {id_type}, n long, token long, hub long, node long"
    handed = rows.mapInArrow(_handed_on(words, low, high), kind)
    key = F.when(F.col("token").isNull(), F.xxhash64("id", "node")).when(F.col("hub").isNull(), F.col("token")).otherwise(F.col("node"))
    bound = scratch.write(handed.repartition(width, key).sortWithinPartitions("token", "node").mapInArrow(_bind, kind), "bound")
    texts = bound.filter("token is null").select("id", "n", "node")
    bound = bound.filter("token is not null")
    members = bound.select("token", "node").union(bound.select("token", "hub"))
    around = _around(members, scratch)
    scratch.drop("met")
    release(spark)

    named = around.select("node").distinct()
    owners = texts.join(named, "node", "left_semi").groupBy("node").agg(F.min(F.struct("id")).alias("own")).select(F.col("own.id").alias("rep")).distinct()
    # What grows with the corpus is never broadcast, however few texts a run has here.
    picked = rows.join(owners.hint("merge"), F.col("id").eqNullSafe(F.col("rep"))).select("text")
    arrays = scratch.write(picked.mapInArrow(_arrays(words), "node long, n long, grams binary").join(named, "node", "left_semi"), "arrays")
    release(spark)
    around = _with_size(around, arrays)
    links = scratch.write(_block_links(around, arrays, low, high), "links")
    roots = connected_components(links, scratch, "cc")
    labelled, main = _open_groups(around, roots)
    main = scratch.write(main, "open")
    cost, more = {r.wide: r.copies for r in main.groupBy("wide").agg(F.sum("copies").alias("copies")).collect()}, False
    if True in cost and cost[True] <= SHARE * texts.count():  # few beside the whole table: compared at once, which is fewer passes
        main, cost = main.withColumn("wide", F.lit(False)), {False: sum(cost.values())}
    if False in cost:
        found = scratch.write(_strip_links(labelled, main.filter("not wide"), arrays, low, high), "strips")
        if not found.isEmpty():
            links, more = links.unionByName(found), True
    if True in cost:
        rare = scratch.write(_rare_members(scratch.write(_unsettled(labelled, main.filter("wide")), "unsettled"), arrays, low, high, scratch), "rare")
        around = _with_size(_around(rare, scratch, "again"), arrays)
        found = scratch.write(_block_links(around, arrays, low, high), "links_again")
        if more or not found.isEmpty():
            links, more = links.unionByName(found), False
            roots = connected_components(links, scratch, "cc_again")
        labelled, main = _open_groups(around, roots)
        main = scratch.write(main, "open_again")
        if not main.isEmpty():
            found = scratch.write(_strip_links(labelled, main, arrays, low, high), "strips_again")
            if not found.isEmpty():
                links, more = links.unionByName(found), True
    if more:
        roots = connected_components(links, scratch, "cc_rest")
    scratch.drop("arrays")

    named_texts = texts.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named_texts.filter("n > 0").groupBy("root").agg(F.min(F.struct("id")).alias("c")).select(F.col("root").alias("r"), F.col("c.id").alias("component_id"))
    out = named_texts.join(least, (F.col("root") == F.col("r")) & (F.col("n") > 0), "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=3, low=90)


#: All pairs counted outright, and components by following links.
SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM words)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y WHERE 100 * o >= 90 * (s.n + t.n - o)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.c AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN (SELECT x, min(y) AS c FROM reach GROUP BY x) r ON r.x = d.doc_id
"""
