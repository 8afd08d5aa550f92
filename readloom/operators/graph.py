"""Read graphs: closure, reduction, paths, chain covers."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from heapq import nsmallest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.operators.state import durable

BATCH = 20_000  # rows that a task returns at once

def closure(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(anc, desc): all pairs joined by a path of a DAG. Path lengths double each round, until no pair is new."""
    pairs = durable(edges.select(F.col("src").alias("anc"), F.col("dst").alias("desc")).distinct())
    n = pairs.count()
    for _ in range(most_rounds):
        more = pairs.alias("a").join(pairs.alias("b"), F.col("a.desc") == F.col("b.anc")).select(F.col("a.anc").alias("anc"), F.col("b.desc").alias("desc"))
        pairs = durable(pairs.unionByName(more).distinct())
        m = pairs.count()
        if m == n:
            return pairs
        n = m
    raise ValueError("the graph has paths longer than 2 ** most_rounds")


def reduction(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Edges whose end can't be reached through another child."""
    around = edges.select("src", F.col("dst").alias("mid")).join(pairs, F.col("mid") == F.col("anc")).select("src", F.col("desc").alias("dst"))
    return edges.join(around, ["src", "dst"], "left_anti")


def with_ends(edges: DataFrame, nodes: DataFrame, source: int = -1, sink: int = -2) -> DataFrame:
    """Edges with one source before all nodes without parents and one sink after all without children."""
    ids = nodes.select("read_id")
    first = ids.join(edges.select(F.col("dst").alias("read_id")), "read_id", "left_anti").select(F.lit(source).cast("long").alias("src"), F.col("read_id").alias("dst"))
    last = ids.join(edges.select(F.col("src").alias("read_id")), "read_id", "left_anti").select(F.col("read_id").alias("src"), F.lit(sink).cast("long").alias("dst"))
    return edges.select("src", "dst").unionByName(first).unionByName(last)


def path_counts(edges: DataFrame, source: int = -1) -> DataFrame:
    """(node, paths): number of paths from the source. Walks of every length are counted by node, never listed."""
    level = edges.sparkSession.range(1).select(F.lit(source).cast("long").alias("node"), F.lit(1).cast("double").alias("n"))
    total = level
    while True:
        level = durable(level.join(edges, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.sum("n").alias("n")))
        if level.isEmpty():
            return total.groupBy("node").agg(F.sum("n").alias("paths"))
        total = durable(total.unionByName(level))


def all_paths(edges: DataFrame, source: int = -1, sink: int = -2, most: int | None = None) -> DataFrame:
    """(path): every path from source to sink as an array of nodes. They are counted first; with ``most``, more than so many
    are an error. Paths grow by one node a round, all at once."""
    if most is not None:
        n = path_counts(edges, source).where(F.col("node") == sink).select("paths").first()
        if n is not None and n[0] > most:
            raise ValueError(f"{n[0]:.0f} paths; cover the graph by chains instead")
    grow = edges.sparkSession.range(1).select(F.array(F.lit(source).cast("long")).alias("path"))
    done = edges.sparkSession.createDataFrame([], "path array<long>")
    while not grow.isEmpty():
        grow = durable(grow.join(edges, F.element_at("path", -1) == F.col("src")).select(F.concat("path", F.array("dst")).alias("path")))
        done = done.unionByName(grow.where(F.element_at("path", -1) == sink))
        grow = grow.where(F.element_at("path", -1) != sink)
    return done


def one_path(edges: DataFrame, source: int = -1, sink: int = -2) -> list[int]:
    """One path, by the smallest child of each node. The ways from all nodes double their length each round; only the one
    from the source is fetched."""
    way = durable(edges.groupBy("src").agg(F.min("dst").alias("to")).withColumn("way", F.array("to")))
    while True:
        own = way.where(F.col("src") == source).select("to", "way").first()
        if own is None:
            return [source]
        more = way.select(F.col("src").alias("to"), F.col("to").alias("then"), F.col("way").alias("rest"))
        if own["to"] == sink or more.where(F.col("to") == own["to"]).isEmpty():
            return [source, *own["way"]]
        way = durable(way.join(more, "to", "left").select("src", F.coalesce("then", "to").alias("to"), F.when(F.col("rest").isNull(), F.col("way")).otherwise(F.concat("way", "rest")).alias("way")))


def _stars(links: DataFrame) -> DataFrame:
    """(src, dst): each node of a task's links with the smallest node that it is connected to there, which is linked to itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := to.setdefault(x, x)) != x:
                to[x] = x = to[y]
            return x

        for batch in batches:
            for a, b in zip(batch.column("src").to_pylist(), batch.column("dst").to_pylist()):
                a, b = root(a), root(b)
                to[max(a, b)] = min(a, b)
        nodes = list(to)
        for lo in range(0, len(nodes), BATCH):
            some = nodes[lo : lo + BATCH]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([root(x) for x in some], pa.int64())], ["src", "dst"])

    return links.mapInArrow(run, "src long, dst long")


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(read_id, component): smallest node that is connected. Edges become stars task by task. The stars' centres are linked by
    the nodes that they share; then each centre's larger and its smaller neighbours are linked to its smallest in turn, until
    no link changes: few rounds, however long the paths are."""
    w = Window.partitionBy("src")
    ids = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    stars = durable(_stars(ids.repartitionByRange("src")).withColumn("low", F.min("dst").over(w)))
    links, state = durable(stars.where("dst > low").select(F.col("dst").alias("src"), F.col("low").alias("dst")).distinct()), None
    while True:
        both = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        large = both.withColumn("low", F.least("src", F.min("dst").over(w))).where("dst > src").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        low = large.withColumn("low", F.min("dst").over(w))
        links = durable(low.select(F.explode(F.array(F.struct("src", F.col("low").alias("dst")), F.struct(F.col("dst").alias("src"), F.col("low").alias("dst")))).alias("x")).select("x.*").where("src > dst").distinct())
        now = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("src", "dst"))).first()
        if now == state:
            break
        state = now
    centre = stars.where("dst = low").select(F.col("src").alias("read_id"), "low").distinct()
    own = nodes.select("read_id").join(centre, "read_id", "left").select("read_id", F.coalesce("low", "read_id").alias("low"))
    return own.join(links.withColumnsRenamed({"src": "low", "dst": "least"}), "low", "left").select("read_id", F.coalesce("least", "low").alias("component"))


def _ordered(children: list[list[int]]) -> list[int]:
    """Nodes of a DAG, parents before their children."""
    waiting = [0] * len(children)
    for some in children:
        for v in some:
            waiting[v] += 1
    order = [u for u, n in enumerate(waiting) if not n]
    for u in order:
        for v in children[u]:
            waiting[v] -= 1
            if not waiting[v]:
                order.append(v)
    if len(order) < len(children):
        raise ValueError("the graph has a cycle")
    return order


def _reach(children: list[list[int]]) -> list[int]:
    """For each node those that can be reached from it, as bits."""
    reach = [0] * len(children)
    for u in reversed(_ordered(children)):
        for v in children[u]:
            reach[u] |= reach[v] | 1 << v
    return reach


def _bits(x: int) -> Iterator[int]:
    while x:
        low = x & -x
        yield low.bit_length() - 1
        x ^= low


def bipartite_matching(adjacent: list[int]) -> dict[int, int]:
    """Maximum matching of a bipartite graph (for each left node its right nodes as bits): phases of shortest augmenting paths.
    Right nodes are taken from the smallest; a set of them is looked at as a whole."""
    mate_l: dict[int, int] = {}
    mate_r: dict[int, int] = {}
    free = (1 << max((x.bit_length() for x in adjacent), default=0)) - 1
    for u, some in enumerate(adjacent):  # a greedy start
        if some & free:
            low = (some & free) & -(some & free)
            mate_l[u], mate_r[low.bit_length() - 1] = low.bit_length() - 1, u
            free ^= low
    while True:
        roots = [u for u in range(len(adjacent)) if u not in mate_l]
        dist, level, unseen, found = dict.fromkeys(roots, 0), roots, ~free, False
        layers = [0]  # right nodes by the distance of their mates
        while level:
            more, then = 0, []
            for u in level:
                found = found or adjacent[u] & free != 0
                new = adjacent[u] & unseen
                unseen &= ~new
                more |= new
                for v in _bits(new):
                    dist[mate_r[v]] = len(layers)
                    then.append(mate_r[v])
            layers.append(more)
            level = then
        if not found:
            return mate_l
        layers.append(0)
        for root in roots:
            stack, path = [(root, 0)], []
            while stack:
                u, seen = stack[-1]
                d = len(stack) - 1
                open_ = (adjacent[u] & (free | layers[d + 1])) >> seen
                if not open_:
                    if u in mate_l:
                        layers[d] &= ~(1 << mate_l[u])
                    stack.pop()
                    if path:
                        path.pop()
                    continue
                v = seen + (open_ & -open_).bit_length() - 1
                stack[-1] = (u, v + 1)
                path.append((u, v))
                if free >> v & 1:
                    free ^= 1 << v
                    for k, (a, b) in enumerate(path):  # b's mate is a now, at distance k
                        if k + 1 < len(path):
                            layers[k + 1] &= ~(1 << b)
                        layers[k] |= 1 << b
                        mate_l[a], mate_r[b] = b, a
                    break
                stack.append((mate_r[v], 0))


def _chains(reach: list[int]) -> list[list[int]]:
    """Fewest chains of a closure that hold all nodes."""
    nxt = bipartite_matching(reach)
    out = []
    for h in sorted(set(range(len(reach))) - set(nxt.values())):
        chain = [h]
        while chain[-1] in nxt:
            chain.append(nxt[chain[-1]])
        out.append(chain)
    return out


def _paths(children: list[list[int]], names: list[int]) -> list[list[int]]:
    """Such chains as paths of the graph, each step by the smallest children that lead to its end, then on from either
    end by the smallest parent or child until there is none."""
    reach, name = _reach(children), names.__getitem__
    down = [min(some, key=name, default=None) for some in children]
    up: list[int | None] = [None] * len(children)
    for u, some in enumerate(children):
        for v in some:
            if up[v] is None or names[u] < names[up[v]]:
                up[v] = u
    out = []
    for chain in _chains(reach):
        path = chain[:1]
        for goal in chain[1:]:
            while path[-1] != goal:
                some = children[path[-1]]
                path.append(goal if goal in some else min((v for v in some if reach[v] >> goal & 1), key=name))
        before, at = [], up[path[0]]
        while at is not None:
            before.append(at)
            at = up[at]
        at = down[path[-1]]
        while at is not None:
            path.append(at)
            at = down[at]
        out.append(before[::-1] + path)
    return out


def _count(children: list[list[int]]) -> int:
    """Number of paths from a node without parents to one without children."""
    n = [0] * len(children)
    for u in reversed(_ordered(children)):
        n[u] = sum(n[v] for v in children[u]) or 1
    return sum(n[u] for u in set(range(len(children))).difference(*children))


def _listed(children: list[list[int]]) -> list[list[int]]:
    """All those paths."""
    out, todo = [], [[h] for h in sorted(set(range(len(children))).difference(*children))]
    while todo:
        path = todo.pop()
        todo += [[*path, v] for v in children[path[-1]]]
        if not children[path[-1]]:
            out.append(path)
    return out


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[list[int]], list[int]]]:
    """Components with the children of their nodes and the ids, of rows (component, by, anc, desc) sorted by component. A pair
    is held as two small numbers."""
    c, at, first, pairs = None, {}, {}, []

    def made() -> tuple[int, list[list[int]], list[int]]:
        names = sorted(at, key=lambda i: (first[i], i))
        place = [0] * len(names)
        for k, i in enumerate(names):
            place[at[i]] = k
        children: list[list[int]] = [[] for _ in names]
        while pairs:
            for a, d in zip(*pairs.pop(0).tolist()):
                if a != d:
                    children[place[a]].append(place[d])
        return c, children, names

    for batch in batches:
        rows = np.column_stack([x.to_numpy() for x in batch.columns])
        cuts = [0, *(np.flatnonzero(np.diff(rows[:, 0])) + 1).tolist(), len(rows)]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo == hi:
                continue
            if c is not None and rows[lo, 0] != c:
                yield made()
                at, first = {}, {}
            (c, *_), by, anc, desc = rows[lo:hi].T.tolist()
            first.update(zip(anc, by))
            pairs.append(np.array([[at.setdefault(i, len(at)) for i in some] for some in (anc, desc)], dtype=np.int32))
        del batch, rows
        pa.default_memory_pool().release_unused()
    if c is not None:
        yield made()


def _labelled(pairs: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(component, anc, desc): each node with the ones that it points to, or itself if there are none."""
    own = components(edges, nodes).withColumnRenamed("read_id", "anc").join(pairs.select("anc", "desc"), "anc", "left")
    return own.select(*[F.coalesce(c, "anc").cast("long").alias(c) for c in ("component", "anc", "desc")])


def _each(labelled: DataFrame, work: Callable[[int, list[list[int]], list[int]], Iterable[tuple]], schema: str, seed: int | None = None) -> DataFrame:
    """Rows that ``work`` makes of a component, the children of its nodes and their ids, one component at a time. Nodes are in
    the order of their ids, or with a ``seed`` of a seeded hash."""
    rank = (lambda c: F.col(c)) if seed is None else (lambda c: F.xxhash64(c, F.lit(seed)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"long": pa.int64(), "int": pa.int32()}
        named = [x.split() for x in schema.split(", ")]
        out = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), named)], [n for n, _ in named])
        rows: list[tuple] = []
        for c, children, names in _apart(batches):
            for row in work(c, children, names):
                rows.append(row)
                if len(rows) == BATCH:
                    yield out(rows)
                    rows = []
        if rows:
            yield out(rows)

    own = labelled.select("component", rank("anc").alias("by"), "anc", "desc").repartition("component").sortWithinPartitions("component")
    return own.mapInArrow(run, schema)


def chain_cover(pairs: DataFrame, nodes: DataFrame, edges: DataFrame, seed: int | None = None) -> DataFrame:
    """(chain, place, read_id): fewest chains that cover all nodes, by matching in the closure, one component at a time.
    ``pairs`` (anc, desc) are the closure or any pairs that it is made of, as the edges are: a component's closure is made in its
    task, a bit a pair. There are many such covers; with a ``seed`` nodes are taken in the order of a seeded hash, and another
    cover comes out."""

    def cover(_: int, children: list[list[int]], names: list[int]) -> Iterator[tuple]:
        return ((names[chain[0]], place, names[u]) for chain in _chains(_reach(children)) for place, u in enumerate(chain))

    return _each(_labelled(pairs, nodes, edges), cover, "chain long, place int, read_id long", seed)


def haplotypes(reads: DataFrame, edges: DataFrame, length: int | None = None, most: int = 200, restarts: int = 50, seed: int = 1) -> DataFrame:
    """(seq): different haplotypes of a read graph, at most ``most`` (the limit is the feature; smallest sequences go first).

    With fewer paths than that, all paths are taken. Otherwise chain covers of randomly relabelled graphs are extended to
    paths and united, until there are ``most``, or ``restarts`` covers, or two covers in a row that bring nothing new."""
    at = durable(placed(reads))
    own = durable(_labelled(edges.select(F.col("src").alias("anc"), F.col("dst").alias("desc")).distinct(), at, edges))

    def laid(ways: Callable[[list[list[int]], list[int]], list[list[int]]], seed: int | None = None) -> DataFrame:
        work = lambda c, children, names: ((c, k, place, names[u]) for k, way in enumerate(ways(children, names)) for place, u in enumerate(way))
        numbered_ways = _each(own, work, "component long, way long, place int, read_id long", seed)
        return path_sequences(numbered_ways.withColumn("chain", F.struct("component", "way")), reads, length, at).select("seq")

    n = _each(own, lambda c, children, names: [(min(_count(children), most),)], "paths long").agg(F.sum("paths")).first()[0]
    if n is None or n < most:
        return laid(lambda children, names: _listed(children)).distinct()

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: set[str] = set()
        for batch in batches:
            held.update(batch.column("seq").to_pylist())
            if len(held) > 2 * most:
                held = set(nsmallest(most, held))
        yield pa.RecordBatch.from_arrays([pa.array(nsmallest(most, held), pa.string())], ["seq"])

    found, size, idle = None, 0, 0
    for k in range(restarts):
        new = laid(_paths, None if k == 0 else seed + k).mapInArrow(smallest, "seq string")
        found = durable((new if found is None else found.unionByName(new)).distinct().orderBy("seq").limit(most))  # no more are looked at
        now = found.count()
        idle = idle + 1 if now == size else 0
        size = now
        if size >= most or idle == 2:
            break
    return found


def placed(reads: DataFrame) -> DataFrame:
    """(read_id, start, n): reads without their letters."""
    return reads.select("read_id", "start", F.length("seq").alias("n"))


def path_sequences(chains: DataFrame, reads: DataFrame, length: int | None = None, at: DataFrame | None = None) -> DataFrame:
    """(chain, seq): reads of a chain laid on their coordinates, each up to the start of the next; uncovered places are dots.
    ``at`` are the reads as ``placed``, where they have been kept."""
    w = Window.partitionBy("chain").orderBy("place")
    n = F.greatest(F.coalesce(F.lead("start").over(w) - F.col("start"), "n"), F.lit(0))
    laid = chains.join(placed(reads) if at is None else at, "read_id").withColumn("n", n)
    laid = laid.join(reads.select("read_id", "seq"), "read_id")  # texts move with their chains only as far as they are needed
    piece = F.rpad(F.substring(F.col("seq"), F.lit(1), F.col("n")), F.col("n").cast("int"), ".")
    parts = laid.select("chain", "place", "start", piece.alias("piece")).groupBy("chain").agg(F.min("start").alias("lead"), F.array_sort(F.collect_list(F.struct("place", "piece"))).alias("p"))
    seq = F.concat(F.repeat(F.lit("."), F.col("lead").cast("int")), F.array_join(F.transform("p", lambda x: x["piece"]), ""))
    return parts.select("chain", seq.alias("seq") if length is None else F.rpad(seq, length, ".").alias("seq"))
