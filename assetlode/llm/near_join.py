"""Jaccard self-join of documents on word five-grams by a MinHash LSH forest.

1. Every text becomes a set of shingles, a MinHash signature and, for each tree of
   the forest, a label: ``LABEL`` values of the signature, the first ``OWN`` of
   which no other tree has. Documents of one shingle set are a class with one
   representative.
2. The least prefix on which documents can meet is the longest one at which the
   trees together reach the target recall at the threshold (``prefix_length``);
   thresholds too low for any are refused. Representatives that share it in a tree
   are a node of its trie. There labels are sorted and the matched prefix shortens
   from the full label on: neighbours in the order, which share the longest
   prefixes, are compared first, and shorter ones are left only for documents that
   are still apart, down to the least prefix, at which every pair between different
   groups is compared. So a node full of near copies costs about one comparison a
   document. Each node gives a star of edges for every group it finds.
3. The components of these edges are verified with exact sets, every pair of a
   component whose sizes can reach the threshold once, in blocks of bounded size. A
   block returns one row a document: its number of links there and the least
   document it is connected with.

Pairs are compared inside blocks only and never written out, so what moves grows
with the documents; only the links of a group of near copies, each of which counts
in the result, are compared in proportion to the square of its distinct texts.

Defined results: words are runs of anything but ASCII white space, case kept; a
text of one to four words has one shingle, all its words; a null text is an empty
one, and all texts without words are one class without links; repeated rows are
copies of each other; a null doc_id is a value like any other, and the class id
is the least doc_id that isn't null; an empty table gives no rows; columns other
than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetlode.llm.arrow import lists, list_array, longs, map_rows, sorted_groups
from assetlode.llm.hot import MARK, lookup, only_one_of_each, row_mark
from assetlode.operators.components import connected_components
from assetlode.plans.staging import materialize

WORDS, THRESHOLD = 5, 0.8
#: Trees, values of a label, and how many of them are the tree's own; the others are drawn from all.
TREES, LABEL, OWN = 32, 16, 4
RECALL = 1 - 1e-6
#: Pairs whose signatures agree in a smaller share are not similar: over five standard errors below the threshold.
MARGIN = 0.2
#: Documents of a block, where signatures meet and where sets are verified.
BLOCK, VERIFY_BLOCK = 512, 128
#: Shingles of a block of sets, unless one set alone has more: sets of very long texts meet in smaller blocks.
BLOCK_SHINGLES = 1 << 22
SEED = 6

_rng = np.random.default_rng(SEED)
MULTIPLY = _rng.integers(0, 1 << 63, TREES * OWN, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _rng.integers(0, 1 << 63, TREES * OWN, dtype=np.uint64)
POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(WORDS)], dtype=np.uint64)


#: For each tree, the places in the signature of its label.
LABELS = np.array([[*range(t * OWN, (t + 1) * OWN), *_rng.choice(np.delete(np.arange(TREES * OWN), np.s_[t * OWN : (t + 1) * OWN]), LABEL - OWN, replace=False)] for t in range(TREES)])


def prefix_length(threshold: float, trees: int = TREES, own: int = OWN, recall: float = RECALL) -> int:
    """The longest prefix of trees' own values with which a pair at the threshold meets in some tree with probability ``recall``."""
    length = own
    while length > 1 and 1 - (1 - threshold**length) ** trees < recall:
        length -= 1
    if 1 - (1 - threshold**length) ** trees < recall:
        raise ValueError(f"{trees} trees miss a recall of {recall} at a threshold of {threshold}")
    return length


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word five-grams."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    n = len(words)
    if not n:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=n)
    k = min(n, WORDS)
    total = np.zeros(n - k + 1, dtype=np.uint64)
    for i in range(k):
        total += h[i : n - k + 1 + i] * POWERS[i]
    return np.unique(mix(total + np.uint64(k)))


def signature(hashes: np.ndarray) -> np.ndarray:
    low = np.full(len(MULTIPLY), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 512):
        low = np.minimum(low, (hashes[at : at + 512, None] * MULTIPLY + ADD).min(axis=0))
    return low


def prefixes(low: np.ndarray, length: int) -> np.ndarray:
    """For each tree, a hash of its number and the first ``length`` values of its label."""
    labels = low[LABELS[:, :length]]
    key = mix(np.arange(TREES, dtype=np.uint64) + np.uint64(1))
    for k in range(length):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + labels[:, k])
    return key.view(np.int64)


def sketch(docs: DataFrame, length: int) -> DataFrame:
    """row, doc_id, mark (of doc_id and text), digest of the shingle set, its size, bytes of the signature, prefixes."""
    id_type = dict(docs.dtypes)["doc_id"]

    def run(part: pa.RecordBatch) -> dict:
        digests, sizes, signs, keys = [], [], [], []
        for text in part.column("text").to_pylist():
            own = shingles(text)
            low = signature(own)
            digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
            sizes.append(len(own))
            # Low bytes: the high ones of a minimum are nearly always zero where a text has many shingles.
            signs.append((low & np.uint64(0xFF)).astype(np.uint8).tobytes() if len(own) else b"")
            keys.append(prefixes(low, length) if len(own) else np.empty(0, dtype=np.int64))
        return {"row": part.column("row"), "doc_id": part.column("doc_id"), "mark": part.column("mark"), "digest": pa.array(digests, pa.binary()), "size": longs(sizes),
                "sign": pa.array(signs, pa.binary()), "prefixes": list_array(keys, pa.int64())}

    source = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", row_mark().alias("mark"), "text")
    return map_rows(source, run, f"row long, doc_id {id_type}, mark {MARK}, digest binary, size long, sign binary, prefixes array<long>")


def least_connected(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each row of a symmetric 0/1 matrix the least id it is connected with."""
    low = ids.copy()
    while True:
        now = np.where(linked, low[None, :], np.iinfo(np.int64).max).min(axis=1)
        now = np.minimum(low, now)
        if (now == low).all():
            return low
        low = now


def in_blocks(members: DataFrame, group: str, size: str) -> DataFrame:
    """Each row once for every pair of blocks it takes part in: ``bi`` <= ``bj``, its own ``block`` one of them."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col(size) / BLOCK)).cast("int")
    dealt = members.withColumn("block", F.pmod(F.xxhash64("rep", F.lit(1)), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return dealt.withColumns({"bi": F.least("block", "other"), "bj": F.greatest("block", "other")}).drop("other")


def agreeing(a: np.ndarray, b: np.ndarray, need: float) -> np.ndarray:
    return (a == b).sum(axis=-1) >= need


def chains(own: np.ndarray, need: float) -> np.ndarray:
    """A number for each row of a sorted run: neighbours that agree, which share the deepest prefixes, have the same."""
    return np.concatenate([[0], np.cumsum(~agreeing(own[1:], own[:-1], need))])


def descend(sign: np.ndarray, tree: int, need: float, block: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each document of a trie node its chain and its group: what is tied by signatures that agree in ``need`` values.

    With ``block``, which has two values, chains are within blocks and only pairs
    between blocks tie them: pairs within a block meet elsewhere.
    """
    order = np.lexsort(sign[:, LABELS[tree][::-1]].T)
    own = sign[order]
    if block is None:
        chain, ties = chains(own, need), []
    else:
        blocks = block[order]
        sides = [np.flatnonzero(blocks == b) for b in np.unique(blocks)]
        chain, count = np.empty(len(own), dtype=np.int64), 0
        for side in sides:
            chain[side] = chains(own[side], need) + count
            count = int(chain[side[-1]]) + 1
        next_to = agreeing(own[1:], own[:-1], need) & (blocks[1:] != blocks[:-1])
        ties = list(zip(chain[:-1][next_to].tolist(), chain[1:][next_to].tolist()))
    root = list(range(int(chain.max()) + 1))

    def find(g: int) -> int:
        while root[g] != g:
            root[g] = root[root[g]]
            g = root[g]
        return g

    for i, j in set(ties):
        root[find(i)] = find(j)
    group = np.array([find(g) for g in range(len(root))])[chain]
    if (group != group[0]).any():
        # Down to the node's own prefix: all that isn't in the largest group meets every other one.
        apart = np.flatnonzero(group != np.bincount(group).argmax())
        for at in range(0, len(apart), 32):
            rows = apart[at : at + 32]
            met = agreeing(own[rows, None, :], own[None, :, :], need) & (group[rows, None] != group[None, :])
            if block is not None:
                met &= blocks[rows, None] != blocks[None, :]
            i, j = met.nonzero()
            for a, b in set(zip(chain[rows][i].tolist(), chain[j].tolist())):
                root[find(a)] = find(b)
        group = np.array([find(g) for g in range(len(root))])[chain]
    out = np.empty((2, len(sign)), dtype=np.int64)
    out[:, order] = chain, group
    return out[0], out[1]


def stars(ids: np.ndarray, group: np.ndarray) -> list[tuple[int, int]]:
    """An edge from the least id of each group to each other one of it."""
    order = np.lexsort((ids, group))
    ids, group = ids[order], group[order]
    first = np.concatenate([[True], group[1:] != group[:-1]])
    low = ids[np.flatnonzero(first)][np.cumsum(first) - 1]
    return list(zip(low[~first].tolist(), ids[~first].tolist()))


def may_link(part: pa.RecordBatch, least: float) -> list[tuple[int, int]]:
    """Edges for each group of documents whose signatures agree enough: a star of them, or of chains' firsts between two blocks."""
    rep = part.column("rep").to_numpy()
    if len(rep) < 2:
        return []
    sign = np.frombuffer(b"".join(part.column("sign").to_pylist()), dtype=np.uint8).reshape(len(rep), -1)
    need, tree = least * sign.shape[1], part.column("tree")[0].as_py()
    if part.column("bi")[0].as_py() == part.column("bj")[0].as_py():
        if len(rep) == 2:
            return [(int(rep.min()), int(rep.max()))] if agreeing(sign[0], sign[1], need) else []
        return stars(rep, descend(sign, tree, need)[1])
    chain, group = descend(sign, tree, need, part.column("block").to_numpy())
    order = np.lexsort((rep, chain))
    first = order[np.concatenate([[True], chain[order][1:] != chain[order][:-1]])]
    return stars(rep[first], group[first])


def in_size_blocks(members: DataFrame, threshold: float) -> DataFrame:
    """Each row of (component, members, classes, size, rep) once for every pair of blocks it takes part in.

    ``class`` numbers sizes so that sets of similar size are of one class or of
    neighbouring ones; ``classes`` has a component's count of each. Blocks are cut
    within classes, by sets and by shingles, and only those that can have links
    meet. A component that fits into one block is one.
    """
    largest = lambda c: F.exp((c + 1) * size_step(threshold))
    room = lambda c: F.greatest(F.lit(1), F.least(F.lit(VERIFY_BLOCK), F.floor(BLOCK_SHINGLES / largest(c))))
    blocks = lambda c: F.ceil(F.coalesce(F.element_at("classes", c), F.lit(0)) / room(c)).cast("long")
    code = lambda c: F.transform(F.sequence(F.lit(0).cast("long"), blocks(c) - 1), lambda b: c.cast("long") * (1 << 32) + b)
    listed = lambda c: F.when(blocks(c) > 0, code(c)).otherwise(F.array().cast("array<long>"))
    own = F.col("class")
    mine = own.cast("long") * (1 << 32) + F.pmod(F.xxhash64("rep", F.lit(1)), F.greatest(blocks(own), F.lit(1)))
    shingled = F.aggregate(F.map_entries("classes"), F.lit(0.0), lambda total, e: total + e["value"] * largest(e["key"]))
    whole = (F.col("members") <= VERIFY_BLOCK) & (shingled <= BLOCK_SHINGLES)
    dealt = members.withColumn("class", size_class(F.col("size"), threshold))
    dealt = dealt.withColumn("block", F.when(whole, F.lit(0).cast("long")).otherwise(mine))
    others = F.when(whole, F.array(F.lit(0).cast("long"))).otherwise(F.concat(listed(own - 1), listed(own), listed(own + 1)))
    dealt = dealt.withColumn("other", F.explode(others))
    return dealt.withColumns({"bi": F.least("block", "other"), "bj": F.greatest("block", "other")}).drop("other", "class")


def size_step(threshold: float) -> float:
    """The logarithm of the ratio of the sizes of neighbouring classes: at least what the threshold allows."""
    return max(math.log(1 / threshold) * (1 + 1e-9), 0.01)


def size_class(size: F.Column, threshold: float) -> F.Column:
    """A number that differs by at most one between sets whose sizes allow a similarity of ``threshold``."""
    return F.floor(F.log(size) / size_step(threshold)).cast("int")


def verify(part: pa.RecordBatch, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """rep, its links in this block and the least document it is connected with, from exact sets."""
    rep, block = part.column("rep").to_numpy(), part.column("block").to_numpy()
    sets = lists(part.column("hashes"))
    sizes = np.array([len(s) for s in sets], dtype=np.float64)
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    start = np.concatenate([[True], every[1:] != every[:-1]])
    number = np.cumsum(start) - 1
    shared = np.bincount(number) > 1
    column = np.cumsum(shared) - 1
    use = shared[number]
    owner, place = owner[use], column[number[use]]
    both = np.zeros((len(sets), len(sets)), dtype=np.float32)
    width = 4096
    cuts = np.searchsorted(place, np.arange(0, int(shared.sum()) + width, width))
    for k in range(len(cuts) - 1):
        a, z = cuts[k], cuts[k + 1]
        if z > a:
            m = np.zeros((len(sets), min(width, int(place[z - 1]) - k * width + 1)), dtype=np.float32)
            m[owner[a:z], place[a:z] - k * width] = 1
            both += m @ m.T
    union = sizes[:, None] + sizes[None, :] - both
    linked = both >= threshold * union - 1e-6
    np.fill_diagonal(linked, False)
    if part.column("bi")[0].as_py() != part.column("bj")[0].as_py():
        linked &= block[:, None] != block[None, :]
    found = linked.any(axis=1)
    if not found.any():
        return rep[:0], rep[:0], rep[:0]
    return rep[found], linked.sum(axis=1)[found], least_connected(linked, rep)[found]


def join(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, n_links (other shingle sets linked), copies (documents of its own set), class_size per row of ``docs``."""
    return _classes(docs, threshold).select(
        "doc_id", "class_id", F.col("n_links").cast("long").alias("n_links"), F.col("copies").cast("long").alias("copies"), F.col("class_size").cast("long").alias("class_size"))


def _classes(docs: DataFrame, threshold: float) -> DataFrame:
    """Each row, with its mark, and its class, a number that is the class's own also where its class id is null or stands for other texts too."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sketches = materialize(sketch(docs, prefix_length(threshold)), "sketches", compression="zstd")
    total = sketches.count()

    # One representative for each shingle set
    sets = materialize(sketches.groupBy("digest").agg(F.min("row").alias("rep"), F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("copies")), "sets")
    reps = sketches.join(sets.select(F.col("rep").alias("row")), "row", "left_semi").where("size > 0").withColumnRenamed("row", "rep")

    # Meetings in the forest
    reps = materialize(reps, "representatives", compression="zstd")
    keys = reps.select("rep", F.posexplode("prefixes").alias("tree", "prefix"))
    full = keys.groupBy("prefix").agg(F.count(F.lit(1)).alias("met")).where("met > 1")
    met = lookup(keys, materialize(full, "prefixes"), "prefix", "met", max(1, total * TREES))
    blocks = in_blocks(met, "prefix", "met").join(reps.select("rep", "sign"), "rep")
    least = threshold - MARGIN

    def meet(batches):
        edges: list[tuple[int, int]] = []
        for part in sorted_groups(batches, ["prefix", "bi", "bj"]):
            edges += may_link(part, least)
            if len(edges) >= 20_000:
                yield pa.RecordBatch.from_arrays([longs(c) for c in zip(*set(edges))], names=["src", "dst"])
                edges = []
        if edges:
            yield pa.RecordBatch.from_arrays([longs(c) for c in zip(*set(edges))], names=["src", "dst"])

    candidates = (
        blocks.select("prefix", "tree", "bi", "bj", "block", "rep", "sign").repartition(parts, "prefix", "bi", "bj").sortWithinPartitions("prefix", "bi", "bj")
        .mapInArrow(meet, "src long, dst long").distinct()
    )
    near = connected_components(candidates)
    nodes = near.withColumnRenamed("node", "rep").join(reps.select("rep", F.col("mark").alias("of_mark"), "digest", "size"), "rep")
    nodes = materialize(nodes, "candidates")
    classes = nodes.groupBy("component", size_class(F.col("size"), threshold).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    # A component has as many classes as sizes have orders of magnitude.
    groups = materialize(
        classes.groupBy("component").agg(F.sum("n").alias("members"), F.map_from_entries(F.collect_list(F.struct("class", "n"))).alias("classes")), "candidate-groups")

    # Exact verification
    known = lookup(nodes, groups, "component", "members", total)

    def measure(part: pa.RecordBatch) -> dict:
        made = [shingles(t) for t in part.column("text").to_pylist()]
        same = [hashlib.blake2b(m.tobytes(), digest_size=16).digest() == d for m, d in zip(made, part.column("digest").to_pylist())]
        keep = [k for k, s in enumerate(same) if s]
        return {c: part.column(c).take(longs(keep)) for c in ("component", "members", "classes", "size", "rep")} | {"hashes": list_array([made[k].view(np.int64) for k in keep], pa.int64())}

    # Texts are shuffled once at every size: what they meet grows with them.
    texts = known.withColumnRenamed("of_mark", "mark").hint("shuffle_hash").join(docs.select(row_mark().alias("mark"), "text"), "mark")
    texts = texts.select("component", "members", "classes", "size", "rep", "digest", "text")
    exact = map_rows(texts, measure, "component long, members long, classes map<int,long>, size long, rep long, hashes array<long>").dropDuplicates(["rep"])

    def check(batches):
        for part in sorted_groups(batches, ["component", "bi", "bj"]):
            rep, links, low = verify(part, threshold)
            if len(rep):
                yield pa.RecordBatch.from_arrays([longs(rep), longs(links), longs(low)], names=["rep", "links", "low"])

    links = materialize(
        in_size_blocks(exact, threshold).repartition(parts, "component", "bi", "bj").sortWithinPartitions("component", "bi", "bj")
        .select("component", "bi", "bj", "block", "rep", "hashes").mapInArrow(check, "rep long, links long, low long"),
        "links",
    )
    classes = connected_components(links.select(F.col("rep").alias("src"), F.col("low").alias("dst")))
    counts = links.groupBy("rep").agg(F.sum("links").alias("n_links"))

    # From sets back to documents
    own = (
        sets.join(classes.withColumnRenamed("node", "rep"), "rep", "left").join(counts, "rep", "left")
        .select("digest", "least_id", "copies", F.coalesce("component", "rep").alias("class"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )
    own = materialize(own, "set-classes")
    whole = own.groupBy("class").agg(F.min("least_id").alias("class_id"), F.sum("copies").alias("class_size"), F.count(F.lit(1)).alias("sets"))
    verdict = materialize(lookup(own, whole, "class", "sets", total), "set-verdicts")
    return lookup(sketches.select("row", "doc_id", "mark", "digest"), verdict, "digest", "copies", total)


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each class, the first under the class id; all columns stay."""
    found = _classes(docs, threshold)
    first = found.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("class").agg(F.min(F.struct("row", "mark")).getField("mark").alias("mark"))
    return only_one_of_each(docs, found.select("mark"), first.select("mark").distinct())
