"""Prize-collecting Steiner trees: which nodes are worth connecting, by moat growing, a Steiner tree on what
stays alive, and the same again without the prizes of what died; the cheapest of the three.

Spark reduces the graph, cutting off what leads nowhere and making one edge of every run of nodes without a prize, splits
it into connected components, and each component is solved by itself in a worker, with a heap of events.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .graphs import components

TINY = 1e-10


@dataclass
class Instance:
    """Nodes 0..n-1, edges (u, v, cost), penalties of leaving nodes out, and a root that must stay, if any."""

    n: int
    edges: list[tuple[int, int, float]]
    prizes: list[float]
    root: int | None = None

    def scaled(self, by: float) -> Instance:
        return Instance(self.n, self.edges, [p * by for p in self.prizes], self.root)

    def without(self, nodes: set[int]) -> Instance:
        return Instance(self.n, self.edges, [0.0 if i in nodes else p for i, p in enumerate(self.prizes)], self.root)

    def price(self, chosen: frozenset[int]) -> float:
        """Cost of edges (by index) and of the nodes that they leave out."""
        kept = self.nodes(chosen)
        return sum(self.edges[e][2] for e in chosen) + sum(p for i, p in enumerate(self.prizes) if i not in kept)

    def nodes(self, chosen: frozenset[int]) -> set[int]:
        kept = {x for e in chosen for x in self.edges[e][:2]}
        return kept | ({self.root} if self.root is not None else set())


class Moats:
    """Groups of nodes with what each node has paid, as a union-find whose links carry offsets: a node's payment is
    the sum of the numbers on its way to the root, whose own grows with time while the group is active."""

    def __init__(self, prizes: list[float], active: list[bool]):
        n = len(prizes)
        self.parent, self.offset = list(range(n)), [0.0] * n
        self.left, self.active, self.since = list(prizes), list(active), [0.0] * n
        self.size, self.version = [1] * n, [0] * n
        self.members: list[list[int]] = [[i] for i in range(n)]

    def find(self, x: int) -> tuple[int, float]:
        """Root of x, and what the links from x up to it, without the root's own number, add up to."""
        way = []
        while self.parent[x] != x:
            way.append(x)
            x = self.parent[x]
        total = 0.0
        for y in reversed(way):
            total += self.offset[y]
            self.parent[y], self.offset[y] = x, total
        return x, total

    def paid(self, x: int, now: float) -> tuple[int, float]:
        root, above = self.find(x)
        own = self.offset[root] + (now - self.since[root] if self.active[root] else 0.0)
        return root, above + own

    def settle(self, root: int, now: float) -> None:
        """Write down what the group has paid and what it has left up to now."""
        if self.active[root]:
            self.offset[root] += now - self.since[root]
            self.left[root] -= now - self.since[root]
        self.since[root] = now

    def stop(self, root: int, now: float) -> None:
        self.settle(root, now)
        self.active[root] = False
        self.version[root] += 1

    def join(self, a: int, b: int, now: float) -> int:
        """One group of two; it is not active yet."""
        self.stop(a, now)
        self.stop(b, now)
        if self.size[a] < self.size[b]:
            a, b = b, a
        self.parent[b] = a
        self.offset[b] -= self.offset[a]
        self.size[a] += self.size[b]
        self.left[a] += self.left[b]
        self.members[a] += self.members[b]
        self.members[b] = []
        return a

    def start(self, root: int, now: float) -> None:
        self.active[root], self.since[root] = True, now


def grow(inst: Instance) -> tuple[frozenset[int], set[int]]:
    """Moats grow around active groups until edges are paid for (groups merge) or prizes are spent (groups
    die). Dead groups that hang by one edge are cut off. Edges kept, and nodes of dead groups.

    Events wait in one heap: when an active group's prize is spent, and when an edge is paid for at the present
    rates. Rates only fall without notice, so an edge's event may come early, never late; it is then put back. An edge
    is told anew when a sleeping group at its end becomes part of an active one."""
    moats = Moats(inst.prizes, [i != inst.root and p > TINY for i, p in enumerate(inst.prizes)])
    near: list[list[int]] = [[] for _ in range(inst.n)]
    for k, (u, v, _) in enumerate(inst.edges):
        near[u].append(k)
        near[v].append(k)
    heap: list[tuple[float, int, int, int]] = []  # at equal times a spent prize comes before a paid edge

    def tell_edge(k: int, now: float) -> None:
        u, v, cost = inst.edges[k]
        (a, p), (b, q) = moats.paid(u, now), moats.paid(v, now)
        if a != b and (rate := moats.active[a] + moats.active[b]):
            heapq.heappush(heap, (round(now + max(0.0, cost - p - q) / rate, 12), 1, k, 0))

    def tell_group(g: int, now: float) -> None:
        heapq.heappush(heap, (round(now + moats.left[g], 12), 0, g, moats.version[g]))

    for i in range(inst.n):
        if moats.active[i]:
            tell_group(i, 0.0)
    for k in range(len(inst.edges)):
        tell_edge(k, 0.0)
    forest, died = [], []
    while heap:
        now, kind, what, version = heapq.heappop(heap)
        if kind == 0:
            if moats.active[what] and moats.version[what] == version:
                moats.stop(what, now)
                died.append(list(moats.members[what]))
            continue
        u, v, cost = inst.edges[what]
        (a, p), (b, q) = moats.paid(u, now), moats.paid(v, now)
        if a == b or not moats.active[a] + moats.active[b]:
            continue
        if cost - p - q > 1e-9:
            tell_edge(what, now)
            continue
        forest.append(what)
        asleep = [x for g in (a, b) if not moats.active[g] for x in moats.members[g]]
        rooted = inst.root is not None and moats.find(inst.root)[0] in (a, b)
        g = moats.join(a, b, now)
        if moats.left[g] > TINY and not rooted:
            moats.start(g, now)
            tell_group(g, now)
            for x in asleep:
                for k in near[x]:
                    tell_edge(k, now)
    if inst.root is not None:  # what the root's own group did not reach is not connected to it
        own = moats.find(inst.root)[0]
        forest = [e for e in forest if moats.find(inst.edges[e][0])[0] == own]
    return frozenset(pruned(inst, forest, died)), {i for d in died for i in d}


def pruned(inst: Instance, forest: list[int], died: list[list[int]]) -> set[int]:
    """forest without the dead groups that hang by one edge, the earliest first, until none does."""
    inside: list[set[int]] = [set() for _ in range(inst.n)]  # the dead groups of each node
    for k, d in enumerate(died):
        for i in d:
            inside[i].add(k)
    kept, touching = set(forest), [set() for _ in range(inst.n)]
    crossing = [0] * len(died)
    for e in forest:
        u, v, _ = inst.edges[e]
        touching[u].add(e)
        touching[v].add(e)
        for k in inside[u] ^ inside[v]:
            crossing[k] += 1
    ready = [k for k, n in enumerate(crossing) if n == 1]
    heapq.heapify(ready)
    while ready:
        cut = heapq.heappop(ready)
        if crossing[cut] != 1:
            continue
        for e in sorted({e for i in died[cut] for e in touching[i]}):
            u, v, _ = inst.edges[e]
            kept.discard(e)
            touching[u].discard(e)
            touching[v].discard(e)
            for k in inside[u] ^ inside[v]:
                crossing[k] -= 1
                if crossing[k] == 1:
                    heapq.heappush(ready, k)
    return kept


def stripped(inst: Instance, chosen: frozenset[int]) -> frozenset[int]:
    """chosen without branches that end in nodes without a prize (and aren't the root): never dearer."""
    touching: dict[int, set[int]] = {}
    for e in chosen:
        for x in inst.edges[e][:2]:
            touching.setdefault(x, set()).add(e)
    bare = [x for x, own in touching.items() if len(own) == 1 and inst.prizes[x] <= TINY and x != inst.root]
    kept = set(chosen)
    while bare:
        x = bare.pop()
        for e in touching.pop(x, set()):
            kept.discard(e)
            u, v, _ = inst.edges[e]
            y = u if x == v else v
            touching[y].discard(e)
            if len(touching[y]) == 1 and inst.prizes[y] <= TINY and y != inst.root:
                bare.append(y)
    return frozenset(kept)


def connect(inst: Instance, terminals: set[int]) -> frozenset[int]:
    """Edges of shortest paths that join the terminals of each connected part: a minimum spanning tree of
    their distances, grown from the least terminal.

    A terminal that joins the tree looks only at nodes that it is nearer to than all before it: through any other node
    it can't be a terminal's nearest. So every node knows the nearest terminal of the tree, and the edge towards it."""
    near: list[list[tuple[int, int]]] = [[] for _ in range(inst.n)]
    for e, (u, v, _) in enumerate(inst.edges):
        near[u].append((v, e))
        near[v].append((u, e))
    chosen: set[int] = set()
    waiting = set(terminals)
    far, by = [float("inf")] * inst.n, [-1] * inst.n
    for first in sorted(terminals):
        if first not in waiting:
            continue
        ready = [(0.0, first)]  # terminals by their distance from the tree; what was nearer later is passed over
        while ready:
            d, x = heapq.heappop(ready)
            if x not in waiting or (x != first and d > far[x]):
                continue
            waiting.discard(x)
            at = x
            while by[at] >= 0:
                chosen.add(by[at])
                u, v, _ = inst.edges[by[at]]
                at = u if at == v else v
            far[x], by[x], queue = 0.0, -1, [(0.0, x)]
            while queue:
                d, u = heapq.heappop(queue)
                if d > far[u]:
                    continue
                for v, e in near[u]:
                    if (new := d + inst.edges[e][2]) < far[v] - TINY:
                        far[v], by[v] = new, e
                        heapq.heappush(queue, (new, v))
                        if v in waiting:
                            heapq.heappush(ready, (new, v))
    return frozenset(chosen)


def solve(inst: Instance, beta: float = 2.0, depth: int = 10) -> frozenset[int]:
    """Edges of the cheapest tree or forest found; none, where nothing is worth its edges."""
    if not inst.edges:
        return frozenset()
    grown, dead = grow(inst.scaled(beta) if depth else inst)
    grown = stripped(inst, grown)
    if not depth:
        return grown
    alive = {i for i in range(inst.n) if i not in dead and inst.prizes[i] > TINY} | ({inst.root} if inst.root is not None else set())
    found = [grown, connect(inst, alive), frozenset()]
    if any(inst.prizes[i] > TINY for i in dead):
        found.append(solve(inst.without(dead), beta, depth - 1))
    return min(found, key=lambda s: (round(inst.price(s), 9), sorted(s)))


def grown_only(inst: Instance) -> frozenset[int]:
    return grow(inst)[0]


def joined_only(inst: Instance) -> frozenset[int]:
    """The Steiner tree of all nodes with a prize."""
    return connect(inst, {i for i, p in enumerate(inst.prizes) if p > TINY})


def reduced(pairs: DataFrame, special: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A smaller graph with the same best trees, and which of its edges each edge of pairs is part of (null: of none).

    pairs: id, source, target, cost, one a pair of nodes; special: node, those with a prize and the root. A node that
    isn't special is cut off with its edge where it has one edge only; a run of nodes that have two edges each becomes one
    edge of their whole cost; of parallel edges the cheapest stays. Rounds go on until none changes anything; each takes
    whole runs at once (their connected components), so a tree of any depth takes a few."""
    special = written(special.select("node").distinct(), "special")
    edges, part = written(pairs.select("id", "source", "target", "cost"), "edges"), written(pairs.select("id", F.col("id").alias("now")), "part")
    while True:
        ends = edges.select("id", F.col("source").alias("node")).unionByName(edges.select("id", F.col("target").alias("node")))
        free = ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree")).where("degree <= 2").join(special, "node", "left_anti")
        free = written(free, "free")
        if not free.limit(1).count():
            return edges, part
        leaf, middle = free.where("degree = 1").select("node"), free.where("degree = 2").select("node")
        gone = ends.join(leaf, "node").select("id").distinct()
        left = written(edges.join(gone, "id", "left_anti"), "left")
        one, two = (middle.select(F.col("node").alias(c), F.lit(True).alias(f"{c}_mid")) for c in ("source", "target"))
        marked = left.join(one, "source", "left").join(two, "target", "left").withColumn("runs", F.coalesce("source_mid", F.lit(False)) | F.coalesce("target_mid", F.lit(False)))
        marked = written(marked, "marked")
        between = marked.where("source_mid AND target_mid").select("source", "target")
        found = between.limit(1).count() > 0
        inner = components(between, "source", "target") if found else between.select(F.col("source").alias("node"), F.col("source").alias("component"))
        run = marked.where("runs").select("*", F.when(F.col("source_mid"), F.col("source")).otherwise(F.col("target")).alias("mid"))
        run = run.join(inner.select(F.col("node").alias("mid"), "component"), "mid", "left").withColumn("run", F.coalesce("component", "mid"))
        outer = F.flatten(F.collect_list(F.array_compact(F.array(F.when(F.col("source_mid").isNull(), F.col("source")), F.when(F.col("target_mid").isNull(), F.col("target"))))))
        run = written(run.select("id", "source", "target", "source_mid", "target_mid", "cost", "run"), "runs")
        whole = run.groupBy("run").agg(F.min("id").alias("now"), F.sum("cost").alias("cost"), F.sort_array(outer).alias("outer"))
        joined = whole.where((F.size("outer") == 2) & (F.col("outer")[0] != F.col("outer")[1]))
        joined = joined.select(F.col("now").alias("id"), F.col("outer")[0].alias("source"), F.col("outer")[1].alias("target"), "cost")
        every = marked.where("NOT runs").select("id", F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target"), "cost").unionByName(joined)
        best = every.groupBy("source", "target").agg(F.min(F.struct("cost", "id")).alias("x")).select("x.id", "source", "target", "x.cost")
        after = written(best, "edges")
        moved = run.join(whole.select("run", F.col("now").alias("to")), "run").select(F.col("id").alias("now"), "to")
        part = part.join(moved, "now", "left").select("id", F.coalesce("to", "now").alias("now"))
        part = written(part.join(after.select(F.col("id").alias("now"), F.lit(True).alias("_there")), "now", "left").select("id", F.when(F.col("_there"), F.col("now")).alias("now")), "part")
        if after.count() == edges.count():
            return after, part
        edges = after


def steiner(edges: DataFrame, prizes: DataFrame, root: str | None = None, solver=solve, reduce: bool = True) -> DataFrame:
    """component, source, target, cost of the edges worth their price, by solver(instance) of each component.

    edges: source, target, cost (undirected; of repeats the cheapest); prizes: id, prize. The graph is reduced first
    (see reduced), which no best tree notices (a lone node with a prize is a tree without edges), and components without a
    prize are left out. What is left of a component has to fit a worker: its nodes with prizes, and those where three
    ways meet; ten thousand nodes and twice as many edges take under a second to grow."""
    pairs = edges.where("source <> target").groupBy(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")).agg(F.min("cost").alias("cost"))
    pairs = written(pairs.withColumn("id", F.monotonically_increasing_id()), "pairs")
    paying = prizes.where("prize > 0").select("id", "prize")
    special = paying.select(F.col("id").alias("node"))
    if root is not None:
        special = special.unionByName(edges.sparkSession.createDataFrame([(root,)], "node string"))
    small, part = reduced(pairs, special) if reduce else (pairs, pairs.select("id", F.col("id").alias("now")))
    named = components(small, "source", "target")
    worth = paying.join(named, paying["id"] == named["node"]).select("component", paying["id"].alias("node"), "prize")
    worth = written(worth, "worth")
    rows = small.join(named.withColumnRenamed("node", "source"), "source").join(worth.select("component").distinct(), "component", "left_semi").select("component", "id", "source", "target", "cost")

    def run(key, own: pd.DataFrame, gain: pd.DataFrame) -> pd.DataFrame:
        if own.empty:
            return pd.DataFrame(columns=["component", "now"])
        own = own.sort_values(["source", "target"])
        ids = sorted({*own["source"], *own["target"]})
        at = {x: i for i, x in enumerate(ids)}
        prize = [0.0] * len(ids)
        for x, p in zip(gain["node"], gain["prize"], strict=True):
            prize[at[x]] += float(p)
        inst = Instance(len(ids), [(at[u], at[v], float(c)) for u, v, c in zip(own["source"], own["target"], own["cost"], strict=True)], prize, at.get(root))
        return own.iloc[sorted(solver(inst))][["component", "id"]].rename(columns={"id": "now"})

    chosen = rows.groupBy("component").cogroup(worth.groupBy("component")).applyInPandas(run, "component string, now bigint")
    return chosen.join(part, "now").join(pairs, "id").select("component", "source", "target", "cost")
