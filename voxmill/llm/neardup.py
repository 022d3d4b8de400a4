"""Near duplicates: an inverted join of MinHash coordinates, links confirmed on full sets.

1. Every document becomes a set of hashed word shingles, a digest of the set
   and a signature of ``COORDINATES`` minima.  Documents with equal sets are
   one node from here on.
2. A node is posted under each (coordinate, value) pair.  Two sets of
   similarity 0.8 agree in 26 of 32 coordinates on average and in fewer than
   ``MATCHES`` with a chance of about 1 in 70,000, so pairs are sought that
   agree in ``MATCHES`` or more.  Such a pair meets in the ``32 - MATCHES + 1``
   rarest lists of either node (prefix); the frequent lists are skipped.
3. Agreement is counted on signatures packed into four longs.  Short lists
   compare all their nodes.  Long lists compare each node with two hubs only;
   then just the nodes that are not in the list's main group, with the rest.
   What agrees forms loose groups.
4. Inside a loose group similarity is computed on full sets, in blocks of
   bounded size, and never for two nodes that are already connected.  In a
   group of many blocks a hub takes in what is linked with it first, and only
   the rest is compared with all.  The links give the components.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.llm.shared import only
from voxmill.operators.components import components
from voxmill.session import cut_lineage, scratch, ship_with_tasks

ship_with_tasks(__name__)

COORDINATES = 32
MATCHES = 16
SHORT_LIST = 64  # nodes of a list that are all compared with each other
BLOCK_NODES = 512  # of one comparing task
BLOCK_SHINGLES = 300_000
MEMO_WORDS = 300_000  # hashes a worker remembers
SLICE = 8_192  # shingles hashed at once

_PACKED = [f"p{i}" for i in range(COORDINATES // 8)]
_SIGNED = "id long, key binary, node binary, n long, sig array<int>"
_NONE = np.empty(0, np.uint64)
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


class _WordHashes(dict):
    """Word to 64-bit hash; starts afresh when it holds MEMO_WORDS."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_HASHES = _WordHashes()


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20240229).integers(0, 2**63, (2, COORDINATES), dtype=np.uint64)
    return draw[0] * np.uint64(2) + np.uint64(1), draw[1]


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words.

    ASCII letters are lower-cased; words end at the six ASCII white-space
    characters.  A shorter text is one run; a text without words has none.
    """
    words = text.lower().split() if text else []
    if not words:
        return _NONE
    hashes = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    runs = max(1, len(words) - size + 1)
    mixed = np.full(runs, min(size, len(words)), np.uint64)
    for k in range(min(size, len(words))):
        mixed = (mixed ^ hashes[k : k + runs]) * _MIX[0]
        mixed ^= mixed >> np.uint64(29)
    mixed *= _MIX[1]
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def signature(shingles: np.ndarray) -> np.ndarray:
    scale, shift = _multipliers()
    parts = [
        (shingles[at : at + SLICE, None] * scale + shift).min(axis=0) for at in range(0, len(shingles), SLICE)
    ]
    return (np.minimum.reduce(parts) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _signer(size: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, counts, sigs = [], [], []
            for text in batch.column("text").to_pylist():
                shingles = shingle_set(text, size)
                counts.append(len(shingles))
                nodes.append(xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None)
                sigs.append(signature(shingles) if len(shingles) else None)
            columns = [
                batch.column("id"),
                batch.column("key"),
                pa.array(nodes, pa.binary()),
                pa.array(counts, pa.int64()),
                pa.array(sigs, pa.list_(pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "key", "node", "n", "sig"])

    return sign


def _set_maker(size: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sets of the nodes, each once a task however many rows repeat its id and text."""
        seen = set()
        for batch in batches:
            rest = batch.select([name for name in batch.schema.names if name != "text"])
            sets, own = [], []
            for text, node in zip(batch.column("text").to_pylist(), batch.column("node").to_pylist(), strict=True):
                sets.append(_NONE if node in seen else shingle_set(text, size))
                own.append(node not in seen and xxhash.xxh3_128_digest(sets[-1].tobytes()) == node)
                if own[-1]:
                    seen.add(node)
            made = rest.append_column("shingles", pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())))
            yield made.filter(pa.array(own, pa.bool_()))

    return make


def _packed(sig: Column) -> list[Column]:
    """The low bytes of the coordinates, eight to a long."""

    def word(first: int) -> Column:
        bytes_ = (
            F.shiftleft(sig[first + k].bitwiseAND(F.lit(255)).cast("long"), 8 * k) for k in range(8)
        )
        return reduce(lambda a, b: a.bitwiseOR(b), bytes_)

    return [word(8 * i).alias(name) for i, name in enumerate(_PACKED)]


def _agreeing(left: list[Column], right: list[Column]) -> Column:
    """In how many bytes two packed signatures agree: the zero bytes of their difference."""
    folds = ((4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))

    def zero_bytes(x: Column) -> Column:
        # Fold each byte onto its lowest bit, which then says whether any bit was set.
        for bits, mask in folds:
            x = x.bitwiseOR(F.shiftrightunsigned(x, bits).bitwiseAND(F.lit(mask)))
        return F.lit(8) - F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))

    return reduce(lambda a, b: a + b, (zero_bytes(a.bitwiseXOR(b)) for a, b in zip(left, right, strict=True)))


def _prefix_postings(nodes: DataFrame) -> DataFrame:
    """Rows ``(key, members, node, p0...)``: each node under its rarest lists.

    Lists of one node link nothing and count for no prefix.
    """
    key = F.shiftleft(F.col("place").cast("long"), 32).bitwiseOR(
        F.col("value").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    )
    posted = nodes.select("node", F.posexplode("sig").alias("place", "value")).select("node", key.alias("key"))
    members = posted.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    listed = (
        posted.join(members, "key")
        .groupBy("node")
        .agg(F.sort_array(F.collect_list(F.struct("members", "key"))).alias("lists"))
        .where(F.size("lists") >= MATCHES)
        .select("node", F.explode(F.slice("lists", 1, F.size("lists") - (MATCHES - 1))).alias("list"))
        .select("node", "list.key", "list.members")
    )
    return listed.join(nodes.select("node", *_packed(F.col("sig"))), "node")


def _pairs(left: DataFrame, right: DataFrame, condition: Column) -> DataFrame:
    """Distinct ``(a, b)`` of two posting tables that share a list and agree enough."""
    a, b = left.alias("a"), right.alias("b")
    agree = _agreeing([F.col(f"a.{p}") for p in _PACKED], [F.col(f"b.{p}") for p in _PACKED]) >= MATCHES
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & condition & agree)
    return met.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct()


def loose_groups(nodes: DataFrame) -> DataFrame:
    """Rows ``(node, grp)`` of the nodes that agree with another one, by connection."""
    with scratch(nodes.sparkSession) as hand_over:
        return hand_over(_by_connection(nodes))


def _by_connection(nodes: DataFrame) -> DataFrame:
    postings = cut_lineage(_prefix_postings(nodes))
    short = postings.where(F.col("members") <= SHORT_LIST)
    long = postings.where(F.col("members") > SHORT_LIST)
    pairs = _pairs(short, short, F.col("a.node") < F.col("b.node"))
    for seed in (1, 2):
        ranked = F.struct(F.xxhash64("key", "node", F.lit(seed)).alias("r"), "node", *_PACKED)
        hubs = long.groupBy("key").agg(F.min(ranked).alias("hub")).select("key", "hub.*")
        pairs = pairs.unionByName(_pairs(long, hubs, F.col("a.node") != F.col("b.node")))
    pairs = cut_lineage(pairs)
    groups = cut_lineage(components(pairs).toDF("node", "grp"))

    # Long lists whose nodes are in more than one group: those outside the largest one are
    # compared with all nodes of other groups.
    seen = long.join(groups, "node", "left").withColumn("grp", F.coalesce("grp", "node"))
    sizes = seen.groupBy("key", "grp").agg(F.count("*").alias("size"))
    mains = sizes.groupBy("key").agg(
        F.max(F.struct("size", "grp"))["grp"].alias("main"), F.count("*").alias("groups")
    )
    mixed = cut_lineage(seen.join(mains.where("groups > 1"), "key"))
    apart = mixed.where(F.col("grp") != F.col("main"))
    more = _pairs(
        apart.withColumn("node", F.col("grp")), mixed.withColumn("node", F.col("grp")), F.col("a.grp") != F.col("b.grp")
    )
    more = cut_lineage(more)
    if more.isEmpty():
        return groups
    merged = cut_lineage(components(more).toDF("grp", "larger"))
    known = groups.unionByName(merged.select(F.col("grp").alias("node"), "grp")).distinct()
    return known.join(merged, "grp", "left").select("node", F.coalesce("larger", "grp").alias("grp"))


def _enough(shared: Column, a: Column, b: Column, similarity: int) -> Column:
    return 100 * shared >= similarity * (a + b - shared)


class _Joined:
    """Which nodes are connected already."""

    def __init__(self, count: int) -> None:
        self.parent = list(range(count))

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, x: int, y: int) -> None:
        self.parent[self.root(x)] = self.root(y)


def _block_links(rows: pd.DataFrame, similarity: int) -> list[tuple[bytes, bytes]]:
    """Links of one block or pair of blocks, best agreement first; none that closes a circle."""
    rows = rows.drop_duplicates("node").reset_index(drop=True)
    packed = np.ascontiguousarray(rows[_PACKED].to_numpy(np.int64)).view(np.uint8).reshape(len(rows), COORDINATES)
    is_left = rows["left"].to_numpy()
    left, right = np.flatnonzero(is_left), np.flatnonzero(rows["right"].to_numpy())
    node, count, known = rows["node"].tolist(), rows["n"].to_numpy(), rows["known"].tolist()
    place = {name: i for i, name in enumerate(dict.fromkeys(node + known))}
    joined = _Joined(len(place))
    for name, hub in zip(node, known, strict=True):
        joined.join(place[name], place[hub])
    sets: dict[int, frozenset] = {}
    members = lambda i: sets.get(i) or sets.setdefault(i, frozenset(rows["shingles"][i].tolist()))
    found: list[tuple[int, int, int]] = []
    for i in left.tolist():
        agree = (packed[right] == packed[i]).sum(axis=1)
        sized = 100 * np.minimum(count[right], count[i]) >= similarity * np.maximum(count[right], count[i])
        for k in right[(agree >= MATCHES) & sized & ~(is_left[right] & (right <= i))].tolist():
            found.append((-int((packed[k] == packed[i]).sum()), i, k))
    found.sort()
    links = []
    for _, i, j in found:
        x, y = place[node[i]], place[node[j]]
        if joined.root(x) == joined.root(y):
            continue
        shared = len(members(i) & members(j))
        if 100 * shared >= similarity * (count[i] + count[j] - shared):
            joined.join(x, y)
            links.append((node[i], node[j]))
    return links


def _linker(similarity: int):
    def link(task: pd.DataFrame) -> pd.DataFrame:
        links = [
            pair
            for _, rows in task.groupby(["grp", "first", "second"], sort=False)
            for pair in _block_links(rows, similarity)
        ]
        return pd.DataFrame(links, columns=["a", "b"])

    return link


def confirmed_links(texts: DataFrame, nodes: DataFrame, groups: DataFrame, size: int, similarity: int) -> DataFrame:
    """Rows ``(a, b)``: links on full sets that connect what any such links connect."""
    placed = nodes.join(groups, "node").select("id", "key", "node", "n", "grp", *_packed(F.col("sig")))
    shapes = placed.groupBy("grp").agg(F.count("*").alias("nodes"), F.sum("n").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("nodes") / BLOCK_NODES), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    placed = placed.join(shapes.select("grp", blocks.alias("blocks")), "grp")
    same = F.col("t.id").eqNullSafe(F.col("p.id")) & (F.col("t.key") == F.col("p.key"))
    joined = texts.alias("t").join(placed.alias("p"), same).select("t.text", "p.*").drop("id", "key")
    fields = [f.simpleString().replace(":", " ", 1) for f in joined.schema.fields if f.name != "text"]
    sets = cut_lineage(joined.mapInArrow(_set_maker(size), ", ".join([*fields, "shingles array<long>"])))

    # Groups of many blocks: one hub each takes in what is linked with it.
    large = sets.where("blocks > 1")
    ranked = F.struct(F.xxhash64("node").alias("r"), "node", "n", "shingles")
    hubs = large.groupBy("grp").agg(F.min(ranked).alias("hub"))
    shared = F.size(F.array_intersect("shingles", "hub.shingles"))
    near = _enough(shared.cast("long"), F.col("n"), F.col("hub.n"), similarity)
    known = large.join(hubs, "grp").withColumn("known", F.when(near, F.col("hub.node")).otherwise(F.col("node")))
    known = known.drop("hub").withColumn("open", F.col("known") == F.col("node"))
    every = sets.where("blocks = 1").withColumns({"known": F.col("node"), "open": F.lit(True)}).unionByName(known)

    # Task (first, second) compares the open nodes of block ``first`` with those of ``second``, or
    # with the closed ones only where the blocks have met the other way round.
    spread = every.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    )
    as_left = F.struct(
        F.col("block").alias("first"),
        F.col("other").alias("second"),
        F.lit(True).alias("left"),
        (F.col("block") == F.col("other")).alias("right"),
        F.col("open").alias("use"),
    )
    as_right = F.struct(
        F.col("other").alias("first"),
        F.col("block").alias("second"),
        F.lit(False).alias("left"),
        F.lit(True).alias("right"),
        ((F.col("other") < F.col("block")) | ~F.col("open")).alias("use"),
    )
    sides = F.filter(F.array(as_left, as_right), lambda side: side["use"])
    tasks = spread.withColumn("side", F.explode(sides)).select(
        "grp", "node", "n", "known", "blocks", "shingles", *_PACKED, "side.*"
    )
    total = sets.agg(F.sum("n")).first()[0] or 0
    buckets = int(total // BLOCK_SHINGLES) * 2 + 64
    bucket = F.when(F.col("blocks") > 1, F.xxhash64("grp", "first", "second")).otherwise(
        F.pmod(F.xxhash64("grp"), F.lit(buckets))
    )
    return (
        tasks.withColumn("bucket", bucket)
        .groupBy("bucket")
        .applyInPandas(_linker(similarity), "a binary, b binary")
        .unionByName(known.where(~F.col("open")).select(F.col("node").alias("a"), F.col("known").alias("b")))
    )


def _text_key(text: Column) -> Column:
    """Digest of a text; a null text counts as an empty one."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))


def _found(documents: DataFrame, words: int, similarity: int) -> DataFrame:
    """Rows ``(id, key, n, root, component_id)``, one per document; no root for an empty set."""
    texts = only(documents, id="doc_id", text="text").select(
        F.col("id").cast("long"), _text_key(F.col("text")).alias("key"), F.col("text").cast("string").cast("binary")
    )
    signed = cut_lineage(texts.mapInArrow(_signer(words), _SIGNED))
    nodes = cut_lineage(
        signed.where(F.col("node").isNotNull())
        .groupBy("node")
        .agg(
            F.min(F.struct(F.col("id").isNull().alias("absent"), "id", "key")).alias("row"),
            F.first("n").alias("n"),
            F.first("sig").alias("sig"),
        )
        .select("row.id", "row.key", "node", "n", "sig")
    )
    with scratch(documents.sparkSession) as hand_over:
        links = hand_over(confirmed_links(texts, nodes, loose_groups(nodes), words, similarity))
    linked = components(links).toDF("node", "root")
    rooted = nodes.select("node", "id").join(linked, "node", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "node"))
    smallest = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    named = rooted.join(smallest, "root").select("node", "root", "component_id")
    found = signed.select("id", "key", "n", "node").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return found.select("id", "key", "n", "root", component.alias("component_id"))


def near_duplicates(documents: DataFrame, words: int = 5, similarity: int = 80) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    Linked are two documents whose sets of runs of ``words`` words have
    ``100 * shared >= similarity * united``.  ``component_id`` is the smallest
    id of a component; ``kept`` marks the document of that id.  A document
    without words or text has an empty set and is linked with nothing.  Rows
    that repeat an id are documents of their own (all carry ``kept`` if it is
    the smallest); a null id is larger than any other, and a component of null
    ids only has a null ``component_id`` and keeps them.
    """
    with scratch(documents.sparkSession) as hand_over:
        return hand_over(
            _found(documents, words, similarity).select(
                F.col("id").alias("doc_id"),
                F.col("n").alias("n_shingles"),
                "component_id",
                F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
            )
        )


def keep_one_each(documents: DataFrame, words: int = 5, similarity: int = 80) -> DataFrame:
    """One document of each component, with its own columns: that of the smallest id.

    A null id is larger than any other.  Of several rows of a component with
    its smallest id, the one with the smallest text stays (then the smallest
    other columns).  Rows of different components never fall together, whatever
    their ids; rows without words are linked with nothing and all stay.
    """
    with scratch(documents.sparkSession) as hand_over:
        found = _found(documents, words, similarity)
        first = found.where(F.col("id").eqNullSafe(F.col("component_id")))
        firsts = hand_over(first.groupBy("id", "key", "root").agg(F.count("*").alias("rows")))
    counts = firsts.where("root IS NOT NULL").groupBy("root").agg(F.sum("rows").alias("rows")).where("rows > 1")
    repeated = cut_lineage(counts.select("root"))

    whole = documents.select(F.struct(*(F.col(f"`{name}`") for name in documents.columns)).alias("row"))
    keyed = whole.select("row", F.col("row.doc_id").cast("long").alias("id"), _text_key(F.col("row.text")).alias("key"))
    same = F.col("d.id").eqNullSafe(F.col("f.id")) & (F.col("d.key") == F.col("f.key"))
    if repeated.isEmpty():
        return keyed.alias("d").join(firsts.alias("f"), same, "left_semi").select("row.*")
    alone = firsts.join(repeated, "root", "left_anti")
    again = firsts.join(repeated, "root", "left_semi")
    # Rows are ordered by what they print as, so columns that have no order (maps) do no harm.
    values = (F.coalesce(F.to_json(F.struct(F.col(f"row.`{name}`"))), F.lit("")) for name in documents.columns)
    least = F.min_by("row", F.struct(F.col("row.text").alias("text"), F.concat(*values).alias("rest"))).alias("row")
    chosen = keyed.alias("d").join(again.alias("f"), same).groupBy("f.root").agg(least)
    columns = (F.col(f"row.`{name}`").alias(name) for name in documents.columns)
    return (
        keyed.alias("d")
        .join(alone.alias("f"), same, "left_semi")
        .select("row.*")
        .unionByName(chosen.select(*columns))
    )
