"""N-gram Jaccard join: MinHash LSH forest and exact verification.

Each tree of the forest is a sorted prefix trie: a text's label in it is a sequence of ``MAX_DEPTH`` MinHash
values, kept as bytes that sort in trie order. Matched prefixes start at full depth and are shortened level by
level, for each class of text lengths apart, until the recall that probes of that class measure reaches the
target; every text is probed: its probe has a fifth of its shingles taken away, and must meet its original.
Texts that meet in a trie node and whose sketches agree are candidates; components of those are verified
on exact shingle sets, block by block, and components of the links are the classes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundshift.operators.components import connected_components

from .common import checked_side, join_hot, materialize, small_batches
from .shingles import WIDTH, chunks, distinct_sorted, mix, shingles

SIMILARITY = 0.8
TREES = 24
MAX_DEPTH = 8
TARGET_RECALL = 0.9999
#: A class with fewer probes goes by those of all classes.
CLASS_PROBES = 50
#: Share of equal sketch bytes (one for each of the trees' MinHash values) of a candidate pair. At a similarity of 0.8
#: the share is 0.80 with a deviation of 0.03, so a linked pair falls below with a chance of about 1e-11.
SCREEN = 0.6
#: Distinct texts of a candidate group, or of a trie node, that one task compares with as many others.
BLOCK = 256
#: Counted rows of ids up to which they are broadcast to the scan of the texts (about 60 bytes each).
IDS_BROADCAST = 400_000
_COLUMNS = 4096


def _signatures(values: np.ndarray, offsets: np.ndarray, trees: int) -> np.ndarray:
    """(texts, trees * MAX_DEPTH) MinHash values; texts must have a shingle."""
    low = (values >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(offsets) - 1, trees * MAX_DEPTH), dtype=np.uint32)
    seeds = mix(np.arange(1, 2 * out.shape[1] + 1, dtype=np.uint64)).astype(np.uint32)
    for k in range(out.shape[1]):
        hashed = (low ^ seeds[2 * k]) * (seeds[2 * k + 1] | np.uint32(1))
        hashed ^= hashed >> np.uint32(15)
        out[:, k] = np.minimum.reduceat(hashed, offsets[:-1])
    return out


def _change(one: np.ndarray, similarity: float) -> tuple[bool, np.ndarray] | None:
    """Whether they are taken away or added, and the shingles, chosen by a hash, that leave the set at least that similar, whichever
    makes it less like; None where every other set is less like."""
    gone, more = int(len(one) * (1 - similarity) + 1e-9), int(len(one) * (1 / similarity - 1) + 1e-9)
    if not gone and not more:
        return None
    if gone and (len(one) - gone) / len(one) <= len(one) / (len(one) + more):
        return True, one[np.argpartition(mix(one ^ np.uint64(0xA0761D6478BD642F)), gone - 1)[:gone]]
    return False, mix(one[:1] + np.arange(1, more + 1, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB))


def _probe(one: np.ndarray, similarity: float) -> np.ndarray | None:
    """The set after its ``_change``."""
    change = _change(one, similarity)
    if change is None:
        return None
    return np.setdiff1d(one, change[1]) if change[0] else np.concatenate((one, change[1]))


def _followed(found: np.ndarray, changes: list[tuple[bool, np.ndarray]], trees: int) -> np.ndarray:
    """(texts, trees) levels to which the texts with signatures ``found`` and their probes agree.

    A probe keeps a MinHash value unless that is of a shingle taken away, or one added has a lesser value; so only the changed shingles are hashed again.
    """
    moved = _signatures(np.concatenate([c for _, c in changes]), np.concatenate(([0], np.cumsum([len(c) for _, c in changes]))), trees)
    same = np.where(np.array([gone for gone, _ in changes])[:, None], moved > found, moved >= found)
    return np.cumprod(same.reshape(len(changes), trees, MAX_DEPTH), axis=2).sum(axis=2)


_PROFILE = "doc_id long, th long, h1 long, h2 long, n long, signature binary, sketch binary, shared array<int>"


def _profiler(trees: int, width: int, similarity: float, rate: float = 1.0):
    """doc_id, th and text to rows of _PROFILE; ``shared`` is the depth to which a probe follows its original in each tree, for so many of the texts."""
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("n", pa.int64()), ("signature", pa.binary()), ("sketch", pa.binary()), ("shared", pa.list_(pa.int32()))])
    cut = int(rate * (1 << 63))  # 1: no hash is above

    def run(batches):
        for batch in small_batches(batches):
            texts = batch.column(2).to_pylist()
            for a, b in chunks(texts):
                values, offsets = shingles(texts[a:b], width)
                sets = distinct_sorted(values, offsets)
                full = np.flatnonzero(np.diff(offsets))
                found = _signatures(values, np.concatenate((offsets[:-1][full], offsets[-1:])), trees) if len(full) else np.zeros((0, trees * MAX_DEPTH), np.uint32)
                at = dict(zip(full.tolist(), range(len(full)), strict=True))
                sums = [[int(mix(one ^ np.uint64(x)).sum(dtype=np.uint64).view(np.int64)) for x in (0, 0xD1B54A32D192ED03)] for one in sets]
                changes = {i: c for i in full.tolist() if sums[i][0] & ((1 << 63) - 1) < cut and (c := _change(sets[i], similarity)) is not None}
                followed = _followed(found[[at[i] for i in changes]], list(changes.values()), trees).tolist() if changes else ()
                shared = dict(zip(changes, followed, strict=True))
                rows = []
                for i, (text, one) in enumerate(zip(texts[a:b], sets, strict=True)):
                    if text is None:
                        rows.append((None,) * 6)
                    elif not len(one):  # no words: equal to identical texts only
                        digest = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                        rows.append((int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True), 0, None, None, None))
                    else:
                        sign = found[at[i]]
                        rows.append((*sums[i], len(one), sign.astype(">u4").tobytes(), sign.astype(np.uint8).tobytes(), shared.get(i)))
                columns = [pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), list(schema)[2:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *columns], schema=schema)

    return run


def size_class(n: Column) -> Column:
    """Class of lengths: texts of similar sets are in the same or in neighbouring ones."""
    return F.floor(F.log2(n.cast("double")) + 1e-9).cast("int")


def measured_depths(firsts: DataFrame, trees: int = TREES, target: float = TARGET_RECALL) -> dict[int, int]:
    """Depth at which each class of lengths stops, from full depth shortened until its probes reach the target.

    Two measures must reach it: the number of probes that follow their original to that depth in no tree must not be more
    than chance makes of the target's, by three deviations and one; and, as so rare a miss is not seen in few probes of a small class, the recall of
    ``trees`` tries whose chance of a shared prefix is that of the class's probes in one tree must reach it too.
    At most a row for each class reaches the driver.
    """
    levels = range(1, MAX_DEPTH + 1)
    met = [F.count_if(F.array_max("shared") >= d).alias(f"met{d}") for d in levels]
    shared = [F.sum(F.when(F.col("shared").isNotNull(), F.expr(f"size(filter(shared, x -> x >= {d}))"))).alias(f"shared{d}") for d in levels]
    rows = firsts.where("n > 0").groupBy(size_class(F.col("n")).alias("class")).agg(F.count("shared").alias("probes"), *met, *shared).collect()
    every = {k: sum(r[k] or 0 for r in rows) for k in ("probes", *[f"{what}{d}" for what in ("met", "shared") for d in levels])}

    def stop(tally) -> int:
        for depth in range(MAX_DEPTH, 1, -1):
            missed = 1 - tally[f"shared{depth}"] / (tally["probes"] * trees)
            due = (1 - target) * tally["probes"]
            if tally["probes"] - tally[f"met{depth}"] <= due + 3 * due**0.5 + 1 and 1 - missed**trees >= target:
                return depth
        return 1

    return {r["class"]: (stop(r if r["probes"] >= CLASS_PROBES else every) if every["probes"] else 1) for r in rows}


def emitted_depths(depths: dict[int, int]) -> dict[int, list[int]]:
    """Depths at which the texts of each class enter the tries: their own, and the shorter of it and a neighbouring class's."""
    return {c: sorted({d, *(min(d, depths[x]) for x in (c - 1, c + 1) if x in depths)}) for c, d in depths.items()}


def trie_nodes(firsts: DataFrame, depths: dict[int, list[int]], trees: int = TREES) -> DataFrame:
    """(node, sid) of every trie prefix that a text enters; a node is a hash of tree, depth and prefix."""
    entered = F.lit(None).cast("array<int>")
    for c, ds in depths.items():
        entered = F.when(size_class(F.col("n")) == c, F.array(*[F.lit(d) for d in ds])).otherwise(entered)
    rows = firsts.select("sid", "signature", F.explode(entered).alias("depth"))
    prefix = lambda t: F.xxhash64(F.lit(t), "depth", F.substring(F.col("signature"), F.lit(4 * MAX_DEPTH * t + 1), 4 * F.col("depth")))
    return rows.select("sid", F.explode(F.array(*[prefix(t) for t in range(trees)])).alias("node"))


def _signed_runs(batches, key: int):
    """Tables that end where a run of equal keys (the first ``key`` columns) ends; input is sorted by them."""
    held = None
    for batch in batches:
        part = pa.Table.from_batches([batch])
        held = part if held is None else pa.concat_tables([held, part])
        marks = np.stack([held.column(c).to_numpy() for c in range(key)])
        border = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0))
        if len(border) and held.num_rows >= 4096:
            yield held.slice(0, border[-1] + 1), marks[:, : border[-1] + 1]
            held = held.slice(border[-1] + 1)
    if held is not None and held.num_rows:
        yield held, np.stack([held.column(c).to_numpy() for c in range(key)])


def _screen(share: float):
    """Rows (node, lo, hi, blk, sid, sketch) sorted by the first three, to edges that span the texts that agree in each run."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for part, marks in _signed_runs(batches, 3):
            group = np.concatenate(([0], np.cumsum((marks[:, 1:] != marks[:, :-1]).any(axis=0))))
            blk, sid = part.column("blk").to_numpy(), part.column("sid").to_numpy()
            sketch = np.frombuffer(b"".join(part.column("sketch").to_pylist()), dtype=np.uint8).reshape(len(sid), -1)
            across = marks[1] != marks[2]
            root, edges, step = np.arange(len(sid)), [], 1
            while True:
                i = np.flatnonzero(group[step:] == group[:-step]) if step < len(sid) else ()
                if not len(i):
                    break
                j = i + step
                ask = (root[i] != root[j]) & ~(across[i] & (blk[i] == blk[j]))  # blocks have met themselves elsewhere
                i, j = i[ask], j[ask]
                like = (sketch[i] == sketch[j]).mean(axis=1) >= share
                if like.any():
                    i, j = i[like], j[like]
                    edges.append(np.stack((sid[i], sid[j])))
                    root = _roots(len(sid), np.stack((root[i], root[j]), axis=1))[root]
                step += 1
            if edges:
                a, b = np.concatenate(edges, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)

    return run


def candidates(nodes: DataFrame, firsts: DataFrame, block: int = BLOCK, share: float = SCREEN) -> DataFrame:
    """Edges (a, b) between texts that share a node and whose sketches agree; they span all such meetings.

    Only texts that meet another fetch their sketches from ``firsts``. A crowded node is dealt into blocks of about ``block`` texts, of which each pair is compared apart.
    """
    sizes = nodes.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / F.lit(2 * block)).cast("int").alias("nb"), F.count(F.lit(1)).alias("in_node"))
    sizes = materialize(sizes.where("in_node > 1"), "near-nodes")
    rows = join_hot(nodes, sizes, "node", f"in_node > {2 * block}")
    rows = rows.join(firsts.select("sid", "sketch").hint("merge"), "sid")
    rows = rows.withColumn("nb", F.when(F.col("nb") > 1, 2 * F.col("nb")).otherwise(1)).withColumn("blk", F.pmod(F.xxhash64("sid"), "nb").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    rows = rows.select("node", F.least("blk", "other").alias("lo"), F.greatest("blk", "other").alias("hi"), "blk", "sid", "sketch")
    return rows.repartition("node", "lo", "hi").sortWithinPartitions("node", "lo", "hi").mapInArrow(_screen(share), "a long, b long")


def _shared(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the left sets with the right ones, in exact counts."""
    sizes = np.array([len(s) for s in sets])
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    often = np.bincount(column) > 1
    place = np.cumsum(often) - 1
    keep = often[column]
    row, column = row[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    for lo in range(0, int(often.sum()), _COLUMNS):
        a, b = np.searchsorted(column, (lo, lo + _COLUMNS))
        dense = np.zeros((len(sets), _COLUMNS), dtype=np.float32)
        dense[row[a:b], column[a:b] - lo] = 1
        out += dense[left] @ dense[right].T
    return out


def _roots(n: int, pairs: np.ndarray) -> np.ndarray:
    """Least index of each index's component."""
    root = np.arange(n)
    while len(pairs):
        low = np.minimum(root[pairs[:, 0]], root[pairs[:, 1]])
        before = root.copy()
        np.minimum.at(root, pairs[:, 0], low)
        np.minimum.at(root, pairs[:, 1], low)
        root = root[root]
        if (before == root).all():
            break
    return root


_VERIFIED = "sid long, root long, links long"


def _verifier(similarity: float, width: int):
    schema = pa.schema([("sid", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by([("sid", "ascending"), ("text", "ascending")])
        rep, copies, blk = (part.column(c).to_numpy() for c in ("sid", "copies", "blk"))
        fresh = np.concatenate(([True], rep[1:] != rep[:-1]))  # repeated rows once
        rep, copies, blk = rep[fresh], copies[fresh], blk[fresh]
        texts = [t for t, new in zip(part.column("text").to_pylist(), fresh, strict=True) if new]
        sets = []
        for a, b in chunks(texts):
            sets += distinct_sorted(*shingles(texts[a:b], width))
        low, high = part.column("lo")[0].as_py(), part.column("hi")[0].as_py()
        left, right = np.flatnonzero(blk == low), np.flatnonzero(blk == high)
        sizes = np.array([len(s) for s in sets], dtype=np.float64)
        both = _shared(sets, left, right).astype(np.float64)
        linked = both * (1 + similarity) >= similarity * (sizes[left][:, None] + sizes[right][None, :]) - 1e-6
        if low == high:
            np.fill_diagonal(linked, False)
        links = np.zeros(len(rep), dtype=np.int64)
        links[left] += linked @ copies[right]
        if low != high:
            links[right] += copies[left] @ linked
        i, j = np.nonzero(linked)
        root = _roots(len(rep), np.stack((left[i], right[j]), axis=1))
        return pa.table([pa.array(rep), pa.array(rep[root]), pa.array(links)], schema=schema)

    return run


def classify(docs: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH, trees: int = TREES, target: float = TARGET_RECALL, block: int = BLOCK) -> DataFrame:
    """doc_id, th (a hash of the text), class_id and n_links of every row; see ``near_duplicates``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    prof = materialize(docs.mapInArrow(_profiler(trees, width, similarity), _PROFILE).withColumn("sid", F.monotonically_increasing_id()), "near-profiles")
    usable = prof.where("doc_id is not null and h1 is not null")
    # of each set one row stands for all; its number names the set
    sets = materialize(usable.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min("sid").alias("sid")), "near-sets")
    firsts = usable.where("signature is not null").join(sets.select("sid", "copies").hint("merge"), "sid")
    firsts = materialize(firsts.select("sid", "doc_id", "th", "copies", "n", "signature", "sketch", "shared"), "near-firsts")

    depths = measured_depths(firsts, trees, target)
    nodes = materialize(trie_nodes(firsts, emitted_depths(depths), trees), "near-trie")
    groups = materialize(connected_components(candidates(nodes, firsts, block)), "near-groups")
    sized = groups.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("nb"))
    members = join_hot(groups, sized, "root", "nb > 1").join(firsts.select(F.col("sid").alias("node"), "doc_id", "th", "copies").hint("merge"), "node")
    members = materialize(members.select(F.col("node").alias("sid"), F.col("doc_id").alias("of_id"), F.col("th").alias("of_th"), "copies", F.col("root").alias("grp"), "nb", F.pmod(F.xxhash64("node"), "nb").cast("int").alias("blk")), "near-members")
    again = materialize(usable.groupBy(F.col("doc_id").alias("of_id"), F.col("th").alias("of_th")).agg(F.count(F.lit(1)).alias("n_same")).where("n_same > 1"), "near-repeats")
    members = materialize(members.join(checked_side(again, again.count(), IDS_BROADCAST), ["of_id", "of_th"], "left"), "near-members")
    texts = docs.join(checked_side(members, members.count(), IDS_BROADCAST), (F.col("doc_id") == F.col("of_id")) & (F.col("th") == F.col("of_th"))).select("sid", "copies", "grp", "blk", "nb", "n_same", "text")
    texts = texts.where("n_same is null").unionByName(texts.where("n_same is not null").distinct())  # equal rows once, before they meet the blocks
    pairs = texts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select("sid", "copies", "grp", "blk", "text", F.least("blk", "other").alias("lo"), F.greatest("blk", "other").alias("hi"))
    checked = materialize(pairs.groupBy("grp", "lo", "hi").applyInArrow(_verifier(similarity, width), _VERIFIED), "near-verified")

    classes = materialize(connected_components(checked.selectExpr("sid as a", "root as b")), "near-components")
    links = checked.groupBy("sid").agg(F.sum("links").alias("links"))
    named = sets.join(links.hint("merge"), "sid", "left").join(classes.select(F.col("node").alias("sid"), "root").hint("merge"), "sid", "left")
    named = materialize(named.select("h1", "h2", "rep", F.coalesce("root", "sid").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "near-named")
    least = named.groupBy("root").agg(F.min("rep").alias("class_id"), F.count(F.lit(1)).alias("in_class"))
    named = materialize(join_hot(named, least, "root", f"in_class > {2 * block}").select("h1", "h2", "class_id", "n_links"), "near-classes")
    out = prof.select("doc_id", "th", F.when(F.col("doc_id").isNotNull(), F.col("h1")).alias("h1"), "h2").join(named.hint("merge"), ["h1", "h2"], "left")
    return out.select("doc_id", "th", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH, trees: int = TREES, target: float = TARGET_RECALL, block: int = BLOCK) -> DataFrame:
    """Class and number of links of every document: doc_id, class_id, n_links.

    Two documents are linked if the Jaccard similarity of their sets of ``width``-word shingles is
    at least ``similarity``; a class is a component of links, named by its least doc_id.
    ``n_links`` counts the other documents linked to one, copies included. Texts of fewer words
    are one shingle; texts without words are linked to identical ones only; a null text, and a row
    without doc_id, to none (its class is its own id). Different texts of one doc_id are documents of
    their own; repeated rows stay and are each other's copies. Other columns are ignored; an empty table gives an empty result.

    Copies collapse to one set before anything else. No pair is ever a row: trie nodes and groups are
    compared in blocks of ``block`` texts; a node sends back edges that span what agrees, a group one
    row per text and block. Groups join only texts whose sketches agree, so that boilerplate does not chain them.
    The work within a group is quadratic in its number of different texts, spread over its block pairs.
    """
    return classify(docs, similarity, width, trees, target, block).select("doc_id", "class_id", "n_links")


def keep_one(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """One row of each class of ``classify``, with all columns: of the least doc_id and hash of the text.

    Of rows equal in both, one stays. Rows without doc_id, of no class, stay.
    """
    keys = classes.where("doc_id is not null").groupBy("doc_id", "class_id", "th").agg(F.count(F.lit(1)).alias("n_rows"))
    lead = keys.where("doc_id = class_id").groupBy("doc_id").agg(F.min("th").alias("lead"))
    keys = keys.join(lead.hint("merge"), "doc_id", "left").select(F.col("doc_id").alias("of_id"), F.col("th").alias("of_th"), "n_rows", F.coalesce((F.col("doc_id") == F.col("class_id")) & (F.col("th") == F.col("lead")), F.lit(False)).alias("stays"))
    keys = materialize(keys, "near-keys")

    def side(rows: DataFrame) -> DataFrame:
        rows = rows.select("of_id", "of_th")
        return checked_side(rows, rows.count(), IDS_BROADCAST)

    def on(rows: DataFrame):  # by table: documents may have columns of these names
        return (docs["doc_id"] == rows["of_id"]) & (F.xxhash64(docs["text"]) == rows["of_th"])

    gone, twins = side(keys.where("not stays")), side(keys.where("stays and n_rows > 1"))
    kept = docs.join(gone, on(gone), "left_anti")
    once = kept.join(twins, on(twins), "left_anti")
    return once.unionByName(kept.join(twins, on(twins), "left_semi").dropDuplicates(["doc_id", "text"]))
