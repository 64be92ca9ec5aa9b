"""MinHash near-dedup by a signature-coordinate inverted join.

A document's set of distinct word shingles gets a signature of 128 coordinates.  Sets that are equal are one node.
Each node is posted under its coordinate-value pairs, rarest first; two nodes that agree in at least ``matches``
coordinates share one of any 128 - matches + 1 of them, so only that prefix of the rarest pairs is posted, and
values that nobody shares fill it first.  Collisions are counted on the whole signatures, and pairs above the
match threshold are confirmed on the full sets.

A posting list is not expanded into pairs at once.  First every member meets the list's most central member; the
links so confirmed join nodes into components.  Lists that hold several components are then merged in blocks: the nodes
outside of a list's largest component meet all others, skipping pairs that are joined already, until no pair between
different components is left untested.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm._common import Scratch, hot_keys, join_spread, map_arrow, mix, shingle_pieces, slices, text_bytes, word_hashes

COORDINATES = 128
#: Bound of the probability that the signature test misses a pair at the very threshold.
MISS = 1e-5
#: Most rows of a posting list, and most shingles (about), that meet as one block.
_BLOCK, _BLOCK_SHINGLES = 1024, 1 << 21
_MOST_STARS = 200
_FACTORS = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64)) | np.uint64(1)
_TERMS = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) + np.uint64(1 << 40))


def sets(raw: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, and their offsets."""
    parts = list(shingle_pieces(*word_hashes(raw, offsets), width))
    if len(parts) > 1:  # one long text
        h = np.unique(np.concatenate([np.unique(x) for x, _ in parts]))
        return h, np.array([0, len(h)])
    h, doc = parts[0]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(offsets))).astype(np.int64)


def nodes_of(h: np.ndarray, at: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit name of each set, for equal sets equal; another salt gives an independent one."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h + np.uint64(salt)), dtype=np.uint64)])
    return mix(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)).view(np.int64)


_CHECK = 0x5851F42D4C957F2D  # salt of the second name, by which sets that share the first are told apart


def apart(named: DataFrame, clashes: list[int]) -> DataFrame:
    """Without column ``check``; where different sets share a name (``clashes``), both names make a new one."""
    node = F.when(F.col("node").isin(clashes), F.xxhash64("node", "check")).otherwise(F.col("node")) if clashes else F.col("node")
    return named.withColumn("node", node).drop("check")


def signatures(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Low 32 bits of the least value in each coordinate, (texts, COORDINATES); zeros for empty sets."""
    full = np.flatnonzero(np.diff(at))
    out = np.zeros((len(at) - 1, COORDINATES), np.uint32)
    if len(full):
        for j in range(COORDINATES):
            least = np.minimum.reduceat(h * _FACTORS[j] + _TERMS[j], at[full])
            out[full, j] = (mix(least) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return out


def matches_at(percent: int, miss: float = MISS) -> int:
    """The most coordinates to ask for so that a pair of similarity percent / 100 is missed with ``miss`` at most (85: 90)."""
    p, below = percent / 100, 0.0
    for k in range(COORDINATES + 1):
        below += comb(COORDINATES, k) * p**k * (1 - p) ** (COORDINATES - k)
        if below > miss:
            return max(1, k)
    return COORDINATES


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Connected components of edges (a, b): node, root (the least node); by alternating large and small stars."""
    now = scratch.save(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), f"{name}0")
    mark = None
    for i in range(1, _MOST_STARS + 1):
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.where("a > m").select("a", F.col("m").alias("b"))).where("a > b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()
        now = scratch.save(small, f"{name}{i}")
        scratch.drop(f"{name}{i - 1}")
        found = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if found == mark:
            break
        mark = found
    else:
        raise RuntimeError(f"components aren't settled after {_MOST_STARS} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows with equal values in the first columns, of batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        key = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(keys)], 1)
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:], strict=False):
            if start == end:
                continue
            if last is not None and tuple(key[start]) != last:
                yield pa.Table.from_batches(held)
                held = []
            last = tuple(key[start])
            held.append(batch.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held)


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of a column of lists."""
    sizes = np.concatenate([chunk.value_lengths().to_numpy() for chunk in column.chunks]).astype(np.int64)
    flat = np.concatenate([chunk.flatten().to_numpy() for chunk in column.chunks])
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)]), flat


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, percent: int = 85, matches: int | None = None, width: int = 5, bits: int = 27) -> DataFrame:
    """Returns id_col (long), n_shingles, component_id, kept: one row per row of ``docs``.

    A-Z count as a-z; words are runs without ASCII white space; a text with fewer than ``width`` words is one
    shingle, one without words (or null) is empty and linked with nothing.  Nodes are linked if
    100 * intersection >= percent * union; ``matches`` follows from ``percent``.  component_id is the least id reachable; kept marks the row with that
    id.  Rows with a null id are linked like others, but have no say in component_id (and are kept only where
    no id can be reached).  Rows that repeat an id and text are all kept or not.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    matches = matches_at(percent) if matches is None else matches
    prefix = COORDINATES - matches + 1
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def sign(batches):
        for batch in slices(batches, "text"):
            h, at = sets(*text_bytes(batch.column(2)), width)
            sig = signatures(h, at)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes_of(h, at)), pa.array(nodes_of(h, at, _CHECK)), pa.array(np.diff(at)), pa.array([s.tobytes() for s in sig], pa.binary())], names=["id", "text_key", "node", "check", "n", "sig"])

    base = scratch.save(map_arrow(source, sign, "id long, text_key long, node long, check long, n long, sig binary"), "signed")
    # 64 bits name a set; of n sets about n * n / 2 ** 65 share a name by chance (tens at 50 billion), and 128 bits tell them apart.
    known = base.where("n > 0").groupBy("node").agg(F.min("check").alias("c0"), F.max("check").alias("c1"))
    clashes = [r["node"] for r in known.where("c0 <> c1").select("node").collect()]
    base = apart(base, clashes)
    nodes = base.where("n > 0").groupBy("node").agg(F.min(F.struct("text_key", "n", "sig")).alias("x"), F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
    nodes = scratch.save(nodes.select("node", "x.text_key", "x.n", "x.sig", "id", "copies"), "nodes")

    def pairs_of(batches):
        """The coordinate-value pairs of each node."""
        coordinate = np.arange(COORDINATES, dtype=np.int16)
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                sig = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint32).reshape(-1, COORDINATES)
                token = mix(sig.astype(np.uint64) | (np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32))).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), COORDINATES)), pa.array(token.ravel()), pa.array(np.tile(coordinate, part.num_rows))], names=["node", "token", "c"])

    tokens = map_arrow(nodes.select("node", "sig"), pairs_of, "node long, token long, c short")
    shared = tokens.groupBy("token").count().where("count > 1")
    # A node's shared pairs (128 at most), rarest first; those that nobody shares come before and need no posting.
    own = tokens.join(shared, "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("count", "token", "c"))).alias("own"), F.count(F.lit(1)).alias("m"))
    own = own.withColumn("room", F.lit(prefix) - (F.lit(COORDINATES) - F.col("m"))).where("room > 0").select("node", "m", F.expr("slice(own, 1, cast(room as int))").alias("own"))
    posted = scratch.save(own.select("node", "m", F.col("own.c").alias("cs"), "own"), "posted")
    posts = posted.select("node", "m", F.explode("own").alias("o")).select("node", "m", F.col("o.token").alias("token"), F.col("o.c").alias("c"))
    lists = posts.groupBy("token").agg(F.min(F.struct((-F.col("m")).alias("far"), "node")).alias("p"), F.count(F.lit(1)).alias("size")).where("size > 1")
    posts = scratch.save(posts.join(lists.select("token", F.col("p.node").alias("pivot"), "size"), "token"), "posts")

    # A bitmap of fixed size marks the candidates' texts: a full one only costs sets that no pair needs.
    slots = posts.select("node").distinct().join(nodes.select("node", "text_key"), "node").select(F.pmod("text_key", F.lit(1 << bits)).alias("slot"))
    marked = slots.groupBy(F.expr("slot div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("mask")).toPandas()
    bitmap = np.zeros(max(1, 1 << (bits - 6)), np.int64)  # 2 ** bits bits: 16 MB by default
    bitmap[marked["word"].to_numpy(np.int64)] = marked["mask"].to_numpy(np.int64)
    held = spark.sparkContext.broadcast(cloudpickle.dumps(bitmap))

    def whole_sets(batches):
        words, met = cloudpickle.loads(held.value), set()
        for batch in slices(batches, "text"):
            slot = batch.column(0).to_numpy() & ((1 << bits) - 1)
            hit = np.flatnonzero(words[slot >> 6].view(np.uint64) >> (slot & 63).astype(np.uint64) & np.uint64(1))
            # Of equal texts, one a task.
            keys = batch.column(0).to_numpy()
            hit = [i for i in hit.tolist() if (k := int(keys[i])) not in met and not met.add(k)]
            if not hit:
                continue
            h, at = sets(*text_bytes(batch.column(1).take(pa.array(hit))), width)
            yield pa.RecordBatch.from_arrays([pa.array(nodes_of(h, at)), pa.array(nodes_of(h, at, _CHECK)), pa.array(np.diff(at)), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(h.view(np.int64)))], names=["node", "check", "n", "shingles"])

    full = apart(map_arrow(source.select("text_key", "text"), whole_sets, "node long, check long, n long, shingles array<long>"), clashes)
    full = scratch.save(full.dropDuplicates(["node"]), "sets")
    held.destroy()

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b) whose full sets are near enough."""
        x = full.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
        y = full.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
        both = pairs.join(x, "a").join(y, "b").withColumn("i", F.size(F.array_intersect("sa", "sb")).cast("long"))
        return scratch.save(both.where(100 * F.col("i") >= percent * (F.col("na") + F.col("nb") - F.col("i"))).select("a", "b"), name)

    # Each node with the centre it shares most lists with.
    met = posts.where("node <> pivot").groupBy("node", "pivot").count().groupBy("node").agg(F.max_by("pivot", F.struct("count", "pivot")).alias("b"))
    links = confirmed(met.select(F.col("node").alias("a"), "b"), "links1")
    joined = components(links, scratch, "stars")

    # Lists that still hold several components.
    roots = posts.join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    roots = scratch.save(roots.select("token", "c", "node", "root", "size"), "roots")
    scratch.drop("posts")
    open_lists = roots.groupBy("token").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("token")
    rows = roots.join(open_lists, "token", "left_semi").join(nodes.select("node", "n", "sig"), "node").join(posted.select("node", "cs"), "node")
    rows = scratch.save(rows.select("token", "c", "node", "root", "size", "n", "sig", "cs"), "open")
    scratch.drop("roots", "posted")
    # A pair of two components has one node outside of the list's largest: those meet all, in blocks on either side.
    sums = rows.groupBy("token", "root").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("weight"))
    sums = sums.groupBy("token").agg(F.max(F.struct("k", "weight", "root")).alias("most"), F.sum("k").alias("ks"), F.sum("weight").alias("weights"))
    blocks = lambda k, weight: F.greatest(F.ceil(k / _BLOCK), F.ceil(weight / _BLOCK_SHINGLES), F.lit(1)).cast("int")
    sums = sums.select("token", F.col("most.root").alias("major"), blocks(F.col("ks"), F.col("weights")).alias("all_blocks"), blocks(F.col("ks") - F.col("most.k"), F.col("weights") - F.col("most.weight")).alias("minor_blocks"))
    rows = rows.join(sums, "token").withColumn("minor", F.col("root") != F.col("major"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = rows.withColumns({"asks": F.lit(False), "b0": F.pmod(F.xxhash64("node"), F.col("all_blocks")).cast("int"), "b1": each("minor_blocks")})
    asking = rows.where("minor").withColumns({"asks": F.lit(True), "b0": each("all_blocks"), "b1": F.pmod(F.xxhash64("node", F.lit(1)), F.col("minor_blocks")).cast("int")})
    spread = held.unionByName(asking).select("token", "b0", "b1", "asks", "minor", "c", "node", "root", "n", "sig", "cs")
    dealt = spread.repartition("token", "b0", "b1").sortWithinPartitions("token", "b0", "b1", "asks", "node")

    def merge(batches):
        """Nodes of a block that asks with their partners in other components, in another block, that agree often enough."""
        for t in _groups(batches, 3):
            c = t.column("c")[0].as_py()
            asks, minor, node, root, n = (t.column(x).to_numpy() for x in ("asks", "minor", "node", "root", "n"))
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint32).reshape(-1, COORDINATES)
            mask = np.zeros(sig.shape, bool)
            for i, cs in enumerate(t.column("cs").to_pylist()):
                mask[i, cs] = True
            ask, have = np.flatnonzero(asks), np.flatnonzero(~asks)
            left, right = [], []
            for start in range(0, len(ask), 32):
                a = ask[start : start + 32]
                fits = (root[a][:, None] != root[have]) & (100 * np.minimum(n[a][:, None], n[have]) >= percent * np.maximum(n[a][:, None], n[have]))
                fits &= ~minor[have] | (node[a][:, None] < node[have])  # each pair once
                i, j = np.nonzero(fits)
                i, j = a[i], have[j]
                for s in range(0, len(i), 20_000):
                    p, q = i[s : s + 20_000], j[s : s + 20_000]
                    same = sig[p] == sig[q]
                    near = same.sum(1) >= matches
                    # In the first list that both are posted in.
                    near &= ~(same[:, :c] & mask[p, :c] & mask[q, :c]).any(1)
                    left.append(p[near])
                    right.append(q[near])
            p, q = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
            if len(p):
                order = np.argsort(node[p], kind="stable")
                p, q = p[order], q[order]
                own, at = np.unique(node[np.concatenate([p, q])], return_index=True)
                to = np.append(np.searchsorted(node[p], own), len(p)).astype(np.int32)
                same = [pa.array([t.column(x)[0].as_py()] * len(own), pa.int64() if x == "token" else pa.int32()) for x in ("token", "b0", "b1")]
                yield pa.RecordBatch.from_arrays([*same, pa.array(own), pa.array(root[np.concatenate([p, q])[at]]), pa.ListArray.from_arrays(pa.array(to), pa.array(node[q]))], names=["token", "b0", "b1", "node", "root", "partners"])

    rest = scratch.save(map_arrow(dealt, merge, "token long, b0 int, b1 int, node long, root long, partners array<long>"), "rest")
    scratch.drop("open")
    with_sets = rest.join(full, "node").select("token", "b0", "b1", "node", "root", "partners", "n", "shingles")
    with_sets = with_sets.repartition("token", "b0", "b1").sortWithinPartitions("token", "b0", "b1", "node")

    def settle(batches):
        """Links between components, each confirmed on the full sets; components once joined are skipped."""
        for t in _groups(batches, 3):
            node, root, n = (t.column(x).to_numpy() for x in ("node", "root", "n"))
            at, flat = _lists(t.column("shingles"))
            to, partners = _lists(t.column("partners"))
            partners = np.searchsorted(node, partners)
            flat = flat.view(np.uint64)
            above: dict[int, int] = {}

            def top(r: int) -> int:
                while r in above:
                    r = above[r]
                return r

            for i in range(len(node)):
                own, mates = flat[at[i] : at[i + 1]], partners[to[i] : to[i + 1]]
                mates = mates[[top(int(root[j])) != top(int(root[i])) for j in mates.tolist()]] if len(mates) else mates
                for part in np.array_split(mates, max(1, int((at[mates + 1] - at[mates]).sum()) >> 20)) if len(mates) else ():
                    sizes = at[part + 1] - at[part]
                    every = np.concatenate([flat[at[j] : at[j + 1]] for j in part])
                    place = np.minimum(np.searchsorted(own, every), len(own) - 1)
                    common = np.add.reduceat((own[place] == every).astype(np.int64), np.cumsum(sizes) - sizes)
                    for j in part[100 * common >= percent * (n[i] + n[part] - common)].tolist():
                        x, y = top(int(root[i])), top(int(root[j]))
                        if x != y:
                            above[max(x, y)] = min(x, y)
                            yield pa.RecordBatch.from_arrays([pa.array([node[i]]), pa.array([node[j]])], names=["a", "b"])

    more = scratch.save(map_arrow(with_sets, settle, "a long, b long"), "links2")
    scratch.drop("sets", "rest")
    final = components(links.union(more), scratch, "final")
    # The least id of each component, then of each node, then of each row: big components and common texts are dealt out.
    rooted = scratch.save(nodes.select("node", "id", "copies").join(final, "node", "left").select("node", "id", "copies", F.coalesce("root", "node").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    named = join_spread(rooted, least, "root", hot_keys(rooted, "root"), F.xxhash64("node"))
    named = scratch.save(named.select("node", "copies", "component_id"), "named")
    scratch.drop("nodes", "rooted", "links1", "links2")
    total = base.agg(F.count(F.lit(1)).alias("__all"))
    most = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    common = named.crossJoin(F.broadcast(total)).where(F.col("copies") * most > F.col("__all")).select("node")  # most rows at most
    out = join_spread(base.select("id", "node", "n", "text_key"), named.select("node", "component_id"), "node", common, F.xxhash64("id", "text_key"))
    out = out.withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull())
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs``, all columns, without the rows whose id isn't their component's (null ids always stay)."""
    gone = near_duplicates(docs, id_col, text_col, **options).where(~F.col("kept") & F.col(id_col).isNotNull()).select(id_col).distinct()
    gone = Scratch(docs.sparkSession, "near").save(gone.select(F.col(id_col).alias("__gone")), "gone")
    return docs.join(gone, docs[id_col].cast("long") == F.col("__gone"), "left_anti")
