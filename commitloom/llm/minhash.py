"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

A text is the weighted set of its five-word shingles (A-Z lowered): 1 + ln(count) times an inverse document
frequency that is damped to 0.9..1, so the threshold keeps its meaning next to plain Jaccard. Document
frequencies are counted over all documents in a table of hashed shingles of fixed size. Each text gets
BANDS x ROWS consistent weighted samples; texts that agree in a band meet in a group.

Every group has one hub, the member that shares bands with the most texts, and each member is compared with it
by exact weighted Jaccard. Members of one hub that are still apart are compared where a link is possible at all.
Seen from the hub a text has shingles inside and outside the hub's set. Two texts that are similar share one of
their first outside shingles, rare ones first, which hold just over 1 - SIMILAR of each text's weight, early enough
that what is left from there on suffices, or their inside weights alone reach the overlap they need. Pairs ruled out by
that, by their weights, or by the triangle inequality of the distance to the hub are not compared, nor are pairs that
other links have connected. This is done in blocks of a hub's members, each two of which meet in one task that passes on
only links that join components. So two rounds settle groups of every size and lose no link between components. Texts with
equal words are one node from the start.

Null and empty texts have no shingles; they are copies of each other. Texts of fewer than five words have
one shingle of all their words. A class is named by its least doc_id; rows without doc_id come last.

An empty table gives an empty result; repeated rows are handled one by one, as rows of equal texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitloom.llm.components import components, shortened
from commitloom.llm.hashing import LETTER, mixed, range_hashes, runs, word_spans
from commitloom.llm.tables import in_batches, per_batch, stored, text_of, texts

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 14, 4
#: Counters of the hashed document-frequency table: the fixed size of what is broadcast.
COUNTERS = 1 << 16
IDF_FLOOR = 0.9
#: Members of a group that one task compares with a hub, or of a block that meets another.
MEMBERS = 512
#: Bytes of text of a block.
BLOCK_BYTES = 8 << 20
#: Room for rounding in bounds that rule pairs out.
SLACK = 1e-3
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@lru_cache(maxsize=1)
def _draws() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """1/r, r, ln c - r and beta of the sampling scheme, looked up by 16 bits of a shingle's hash."""
    rng = np.random.default_rng(5)
    r, c = rng.gamma(2, 1, 1 << 16), rng.gamma(2, 1, 1 << 16)
    odd = rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    beta = rng.random(1 << 16)
    return (1 / r).astype(np.float32), np.stack([r, np.log(c) - r + r * beta, beta]).astype(np.float32), odd, rng.integers(0, 1 << 63, BANDS, dtype=np.uint64)


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash and text number of each word, first and last word of each text, and a 128-bit hash of its words."""
    lowered = _LOWER[data]
    starts, ends, text = word_spans(lowered, offsets)
    words = range_hashes(LETTER[lowered], starts, ends)
    counts = np.bincount(text, minlength=len(offsets) - 1)
    last = np.cumsum(counts)
    first = last - counts
    return words, text, first, last, np.stack([range_hashes(words, first, last), range_hashes(mixed(words), first, last)], axis=1)


def _node(column: pa.Array) -> pa.Array:
    """The hash of the words of each text, which names its node."""
    return pa.array([row.tobytes() for _, data, offsets in runs(column) for row in _words(data, offsets)[4]], pa.binary())


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: (hash, count, text number), and a 128-bit hash of its words."""
    words, text, first, last, same = _words(data, offsets)
    here = np.arange(len(words))
    begin = here[(here == first[text]) | (here + SHINGLE <= last[text])]
    hashes = range_hashes(words, begin, np.minimum(begin + SHINGLE, last[text[begin]]))
    order = np.lexsort((hashes, text[begin]))
    hashes, owner = hashes[order], text[begin][order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return hashes[at], np.diff(np.append(at, len(hashes))), owner[at], same


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """Inverse document frequency per counter, from all documents; COUNTERS rows reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for _, data, offsets in runs(batch.column("text")):
                total += np.bincount((shingles(data, offsets)[0] >> np.uint64(48)).astype(np.int64), minlength=COUNTERS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["counter", "n"])

    rows = docs.select("text").mapInArrow(count, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toPandas()
    found = np.zeros(COUNTERS)
    found[rows["counter"]] = rows["n"]
    known = 1 + np.maximum(0, found - found.mean())  # other shingles share the counter
    total = max(2, docs.count())
    return (IDF_FLOOR + (1 - IDF_FLOOR) * np.clip(np.log(total / known) / np.log(total), 0, 1)).astype(np.float32)


def weighted(data: np.ndarray, offsets: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    hashes, counts, owner, same = shingles(data, offsets)
    return hashes, ((1 + np.log(counts)) * idf[(hashes >> np.uint64(48)).astype(np.int64)]).astype(np.float32), owner, same


def band_keys(hashes: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """One key per text and band from the consistent weighted samples; texts without shingles get 0."""
    keys = np.zeros((n, BANDS), np.uint64)
    if not len(hashes):
        return keys
    inverse, (r, shifted, beta), odd, salts = _draws()
    logs = np.log(weights)
    begins = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    names = (mixed(hashes) & np.uint64(0xFFFFFFFF))
    for band in range(BANDS):
        for row in range(ROWS):
            at = ((hashes * odd[band * ROWS + row]) >> np.uint64(48)).astype(np.int64)
            step = np.floor(logs * inverse[at] + beta[at])
            bits = (shifted[at] - r[at] * step).view(np.uint32)
            bits = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31)).astype(np.uint64)
            name = (names + step.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B1)) & np.uint64(0xFFFFFFFF)
            least = np.minimum.reduceat((bits << np.uint64(32)) | name, begins)
            keys[owner[begins], band] = mixed(keys[owner[begins], band] * np.uint64(0x9E3779B97F4A7C15) + (least & np.uint64(0xFFFFFFFF)) + salts[band])
    return keys


def sampled(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """doc_id, node (hash of the words) and band keys of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        nodes, keys = [], []
        for _, data, offsets in runs(batch.column("text")):
            hashes, weights, owner, same = weighted(data, offsets, shared.value)
            nodes += [row.tobytes() for row in same]
            keys.append(band_keys(hashes, weights, owner, len(same)).view(np.int64))
        flat = pa.array(np.concatenate(keys).ravel())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS, dtype=np.int32)), flat)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(nodes, pa.binary()), lists], names=["doc_id", "node", "keys"])

    return docs.mapInArrow(per_batch(step), "doc_id long, node binary, keys array<long>")


def similarities(pairs: DataFrame, found: DataFrame, idf: np.ndarray, outside: bool = False) -> DataFrame:
    """``pairs`` (hub, node) with their exact weighted Jaccard similarity.

    ``found`` (node, text) holds every text asked for. A hub's members are dealt over as many tasks as they
    need, the hub's text goes to each of them, and a task holds one hub at a time. Also the node's weight, the
    part of it ``inside`` the hub's shingles and, where asked for, the first shingles ``outside`` them, rare ones
    first and else by their hashes, up to just over 1 - SIMILAR of the weight, each with the outside weight
    ``left`` from it on.
    """
    shared = pairs.sparkSession.sparkContext.broadcast(idf)
    shares = pairs.groupBy("hub").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("shares"))
    members = (
        pairs.join(shares, "hub").join(found, "node")
        .select("hub", F.pmod(F.hash("node"), F.col("shares")).alias("share"), F.lit(1).alias("part"), "node", "text"))
    hubs = (
        shares.join(found.withColumnRenamed("node", "hub"), "hub")
        .select("hub", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(0).alias("part"), F.col("hub").alias("node"), "text"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub: tuple | None = None
        for batch in batches:
            a, b, out, weight, inside, first_outside, left = [], [], [], [], [], [], []
            names, nodes, parts = (batch.column(c).to_pylist() for c in ("hub", "node", "part"))
            for first, data, offsets in runs(batch.column("text")):
                hashes, weights, owner, _ = weighted(data, offsets, shared.value)
                bounds = np.searchsorted(owner, np.arange(len(offsets)))
                for i in range(len(offsets) - 1):
                    h, w = hashes[bounds[i]:bounds[i + 1]], weights[bounds[i]:bounds[i + 1]]
                    if parts[first + i] == 0:
                        hub = (h, w, w.sum())
                        continue
                    place = np.searchsorted(hub[0], h)
                    hit = np.flatnonzero(place < len(hub[0]))
                    hit = hit[hub[0][place[hit]] == h[hit]]
                    both = np.minimum(w[hit], hub[1][place[hit]]).sum()
                    a.append(names[first + i])
                    b.append(nodes[first + i])
                    out.append(float(both / max(1e-9, hub[2] + w.sum() - both)))
                    weight.append(float(w.sum()))
                    inside.append(float(w[hit].sum()))
                    other = np.ones(len(h) if outside else 0, bool)
                    other[hit[:len(hit) if outside else 0]] = False
                    other = np.flatnonzero(other)
                    other = other[np.argsort(-shared.value[(h[other] >> np.uint64(48)).astype(np.int64)], kind="stable")]
                    before = np.cumsum(w[other], dtype=np.float64) - w[other]
                    near = before <= (1 - SIMILAR + SLACK) * w.sum()
                    first_outside.append(h[other[near]].view(np.int64))
                    left.append(w[other].sum() - before[near])
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, pa.binary()), pa.array(b, pa.binary()), *(pa.array(x, pa.float64()) for x in (out, weight, inside)), pa.array(first_outside, pa.list_(pa.int64())), pa.array(left, pa.list_(pa.float64()))],
                names=["hub", "node", "similarity", "weight", "inside", "outside", "left"])

    return (
        hubs.unionByName(members).repartition("hub", "share").sortWithinPartitions("hub", "share", "part")
        .mapInArrow(compare, "hub binary, node binary, similarity double, weight double, inside double, outside array<long>, left array<double>"))


def _stars(members: DataFrame) -> DataFrame:
    """(hub, node): every member of a group beside the group's hub, the one that shares bands with the most texts."""
    central = members.groupBy("node").agg(F.sum("n").alias("central"))
    hubs = (
        members.join(central, "node").groupBy("group").agg(F.min(F.struct((-F.col("central")).alias("central"), "node")).alias("hub"))
        .select("group", F.col("hub.node").alias("hub")))
    return members.join(hubs, "group").where(F.col("hub") != F.col("node")).select("hub", "node").distinct()


def _apart(stars: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows of hubs whose members are not all connected, with their component and whether it is the hub's largest.

    A node goes by its least neighbour in ``edges``: a chain not yet short may keep a hub open, never close it.
    """
    parts = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    rows = stars.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    own = rows.groupBy("hub", "component").agg(F.count("*").alias("own"))
    largest = own.groupBy("hub").agg(F.max(F.struct("own", "component")).alias("top"), F.count("*").alias("parts")).where(F.col("parts") > 1)
    return rows.join(largest.select("hub", F.col("top.component").alias("top")), "hub").withColumn("main", F.col("component") == F.col("top")).drop("top")


class _Sets:
    """Union-find over the numbers 0 .. n - 1."""

    def __init__(self, names: list):
        first: dict = {}
        self.up = [first.setdefault(name, i) for i, name in enumerate(names)]

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        self.up[self.find(x)] = self.find(y)


def _earlier(rows: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """For each member of a hub the members before it, of other blocks where there are two, that can be similar to it."""
    similarity, weight, inside = (rows.column(c).to_numpy() for c in ("similarity", "weight", "inside"))
    block, cross = rows.column("block").to_numpy(), rows.column("i")[0].as_py() != rows.column("j")[0].as_py()
    lists = rows.column("outside").combine_chunks()
    shingle = lists.flatten().to_numpy()
    left = rows.column("left").combine_chunks().flatten().to_numpy()
    owner = np.repeat(np.arange(len(weight)), lists.value_lengths().to_numpy())
    order = np.lexsort((owner, shingle))
    shingle, left, owner = shingle[order], left[order], owner[order]
    begins = np.flatnonzero(np.append(True, shingle[1:] != shingle[:-1])) if len(shingle) else np.zeros(0, np.int64)
    begin = np.repeat(begins, np.diff(np.append(begins, len(shingle))))
    places = np.argsort(owner, kind="stable")
    bounds = np.searchsorted(owner[places], np.arange(len(weight) + 1))
    share = SIMILAR / (1 + SIMILAR) * (1 - SLACK)
    for x in range(1, len(weight)):
        needed = (weight[:x] + weight[x]) * share
        both = np.minimum(inside[:x], inside[x])
        possible = (
            (np.minimum(weight[:x], weight[x]) >= np.maximum(weight[:x], weight[x]) * (SIMILAR - SLACK))
            & (np.abs(similarity[:x] - similarity[x]) <= 1 - SIMILAR + SLACK)
            & (both + np.minimum(weight[:x] - inside[:x], weight[x] - inside[x]) >= needed))
        if cross:
            possible &= block[:x] != block[x]
        if not possible.any():
            continue
        # their inside weights suffice, or they share one of their first outside shingles early enough
        met = both >= needed
        for p in places[bounds[x]:bounds[x + 1]]:
            others = owner[begin[p]:p]
            met[others] |= both[others] + np.minimum(left[begin[p]:p], left[p]) >= needed[others]
        yield x, np.flatnonzero(met & possible)


def _links(rows: DataFrame, found: DataFrame, idf: np.ndarray) -> DataFrame:
    """(hub, node): links between members of one hub that connect what is not yet connected; ``rows`` are those of _apart.

    The members of a hub are dealt into blocks of at most MEMBERS rows and BLOCK_BYTES of text, and each two blocks meet in
    one task. There pairs of different components that can be similar are compared, until their components are joined;
    only the links that join some are passed on, fewer than there are members. No link between components is lost.
    """
    shared = found.sparkSession.sparkContext.broadcast(idf)
    sizes = rows.select("hub", "node").join(found.select("node", F.octet_length("text").alias("bytes")), "node").groupBy("hub").agg(
        F.greatest(F.ceil(F.count("*") / MEMBERS), F.ceil(F.sum("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
    dealt = rows.join(sizes, "hub").withColumn("block", F.pmod(F.hash("node"), F.col("blocks")))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "hub", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "component", "similarity", "weight", "inside", "outside", "left")

    def connect(table: pa.Table) -> pa.Table:
        names = table.column("node").to_pylist()
        sets, known, out = _Sets(table.column("component").to_pylist()), {}, []

        def shingled(x: int) -> tuple[np.ndarray, np.ndarray, float]:
            if x not in known:
                data = np.frombuffer(table.column("text")[x].as_py().encode(), np.uint8)
                hashes, weights, _, _ = weighted(data, np.array([0, len(data)]), shared.value)
                known[x] = hashes, weights, weights.sum()
            return known[x]

        for x, others in _earlier(table):
            for y in others.tolist():
                if sets.find(x) != sets.find(y):
                    (h, w, a), (g, v, b) = shingled(x), shingled(y)
                    at = np.searchsorted(g, h)
                    hit = np.flatnonzero(at < len(g))
                    hit = hit[g[at[hit]] == h[hit]]
                    both = np.minimum(w[hit], v[at[hit]]).sum()
                    if both / max(1e-9, a + b - both) >= SIMILAR:
                        sets.join(x, y)
                        out.append((names[x], names[y]))
        return pa.table({"hub": pa.array([r[0] for r in out], pa.binary()), "node": pa.array([r[1] for r in out], pa.binary())})

    return pairs.join(found, "node").groupBy("hub", "i", "j").applyInArrow(connect, "hub binary, node binary")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (least doc_id of its class), class_size, kept."""
    return _decided(docs).drop("node")


def _decided(docs: DataFrame) -> DataFrame:
    """``near_duplicates`` with the node of each row."""
    given = texts(docs)
    idf = document_frequencies(given)
    rows = stored(sampled(given, idf))
    # a text's keys do not depend on the row, so the least array is every row's array
    nodes = stored(rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"), F.min("keys").alias("keys")))
    banded = nodes.select("node", F.posexplode("keys")).where(F.col("col") != 0).select("node", F.xxhash64("pos", "col").alias("group"))
    full = banded.groupBy("group").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    members = stored(banded.join(full, "group"))
    wanted = members.select("node").distinct().join(nodes.select("node", "least"), "node")
    found = stored(
        rows.select("doc_id", "node").join(wanted, "node").where(F.col("doc_id").eqNullSafe(F.col("least"))).select("doc_id", "node").distinct()
        .join(given.withColumnRenamed("doc_id", "own"), F.col("doc_id").eqNullSafe(F.col("own"))).select("node", "text"))
    ids = rows.agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("own")).first()
    if ids["own"] < ids["n"]:  # nulls are not counted as ids
        found = stored(_matching(found))
    stars = stored(similarities(stored(_stars(members)), found, idf, outside=True))
    alike = F.col("similarity") >= SIMILAR
    ends = [F.col("hub").alias("a"), F.col("node").alias("b")]
    edges = shortened(stars.where(alike).select(*ends))
    edges = edges.unionByName(_links(stored(_apart(stars, edges)), found, idf).select(*ends))
    joined = nodes.select("node", "least", "n")
    joined = joined.join(components(edges), "node", "left").withColumn("component", F.coalesce("component", "node"))
    classes = joined.groupBy("component").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_size"))
    named = joined.select("node", "component").join(classes, "component").select("node", "class_id", "class_size")
    return rows.select("doc_id", "node").join(named, "node").select(
        "doc_id", "node", "class_id", "class_size", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def _matching(found: DataFrame) -> DataFrame:
    """Only texts whose words hash to the node: doc_ids that repeat or are null bring other rows' texts along."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        names = _node(batch.column("text")).to_pylist()
        return batch.filter(pa.array([a == b for a, b in zip(names, batch.column("node").to_pylist())], pa.bool_()))

    return found.mapInArrow(per_batch(step), found.schema)


def without_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of each class the one with the least doc_id.

    A row goes by doc_id and node, so rows of other texts under the same doc_id, or without one, stay.
    """
    gone = _decided(docs).where(~F.col("kept")).select(F.col("doc_id").alias("__gone"), F.col("node").alias("__node")).distinct()
    named = in_batches(docs).withColumn("__own", F.arrow_udf(_node, "binary")(text_of()))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__gone")) & (F.col("__own") == F.col("__node"))
    return named.join(gone, same, "left_anti").drop("__own")
