"""Moats against the plain scan of all edges, reductions and trees against every tree of small graphs."""

import itertools
import random
import time

import pytest

from storyspark.operators import steiner as op


def slow_grow(inst):
    """The same growth, looking at every edge and every member at each event."""
    group = list(range(inst.n))
    left = {i: p for i, p in enumerate(inst.prizes)}
    active = {i for i in range(inst.n) if i != inst.root and inst.prizes[i] > op.TINY}
    paid, forest, died = [0.0] * inst.n, [], []
    while active:
        steps = [(left[g], 0, g) for g in active]
        for k, (u, v, cost) in enumerate(inst.edges):
            rate = (group[u] in active) + (group[v] in active)
            if group[u] != group[v] and rate:
                steps.append((max(0.0, cost - paid[u] - paid[v]) / rate, 1, k))
        step, kind, what = min(steps, key=lambda s: (round(s[0], 9), s[1], s[2]))
        for i in range(inst.n):
            paid[i] += step * (group[i] in active)
        for g in active:
            left[g] -= step
        if kind == 0:
            active.discard(what)
            died.append([i for i in range(inst.n) if group[i] == what])
            continue
        a, b = (group[x] for x in inst.edges[what][:2])
        forest.append(what)
        rooted = inst.root is not None and group[inst.root] in (a, b)
        group = [a if g == b else g for g in group]
        left[a] += left.pop(b)
        active -= {a, b}
        if left[a] > op.TINY and not rooted:
            active.add(a)
    if inst.root is not None:
        forest = [e for e in forest if group[inst.edges[e][0]] == group[inst.root]]
    kept = set(forest)
    while cut := next((set(d) for d in died if sum((inst.edges[e][0] in d) != (inst.edges[e][1] in d) for e in kept) == 1), None):
        kept = {e for e in kept if not {*inst.edges[e][:2]} & cut}
    return frozenset(kept), {i for d in died for i in d}


def instance(rng, n, edges, root=False):
    pairs = rng.sample(list(itertools.combinations(range(n), 2)), min(edges, n * (n - 1) // 2))
    # prizes and costs that rarely tie: ties may be broken either way
    return op.Instance(n, [(u, v, round(rng.uniform(0.1, 5), 4)) for u, v in pairs], [round(rng.uniform(0.1, 6), 4) if rng.random() < 0.6 else 0.0 for _ in range(n)], 0 if root else None)


@pytest.mark.parametrize("root", [False, True])
def test_heap_grows_like_the_scan(root):
    rng = random.Random(11 + root)
    for _ in range(400):
        inst = instance(rng, rng.randrange(1, 12), rng.randrange(0, 24), root)
        assert op.grow(inst) == slow_grow(inst), inst


def cheapest(inst):
    """Price of the best tree (that holds the root, if there is one), by trying all."""
    best = inst.price(frozenset())
    for size in range(1, inst.n):
        for chosen in itertools.combinations(range(len(inst.edges)), size):
            name = list(range(inst.n))
            for e in chosen:
                u, v, _ = inst.edges[e]
                if name[u] == name[v]:
                    break
                name = [name[u] if x == name[v] else x for x in name]
            else:
                touched = {x for e in chosen for x in inst.edges[e][:2]} | ({inst.root} if inst.root is not None else set())
                if len({name[x] for x in touched}) == 1:
                    best = min(best, inst.price(frozenset(chosen)))
    return best


def test_price_of_rooted_trees_against_all_trees():
    """Twice the best price is what the method promises; on average it comes much closer."""
    rng = random.Random(3)
    ratio = []
    while len(ratio) < 80:
        inst = instance(rng, rng.randrange(2, 7), rng.randrange(1, 10), True)
        name = list(range(inst.n))
        for u, v, _ in inst.edges:
            name = [name[u] if x == name[v] else x for x in name]
        if len(set(name)) > 1:
            continue
        best, got = cheapest(inst), inst.price(op.solve(inst))
        assert got <= 2 * best + 1e-9, inst
        ratio.append(got / best if best else 1.0)
    assert sum(ratio) / len(ratio) < 1.05


def frame(spark, inst):
    edges = spark.createDataFrame([(f"n{u:03}", f"n{v:03}", c) for u, v, c in inst.edges], "source string, target string, cost double")
    return edges, spark.createDataFrame([(f"n{i:03}", p) for i, p in enumerate(inst.prizes)], "id string, prize double")


def price(inst, rows):
    at = {(u, v): k for k, (u, v, _) in enumerate(inst.edges)} | {(v, u): k for k, (u, v, _) in enumerate(inst.edges)}
    return inst.price(frozenset(at[int(r["source"][1:]), int(r["target"][1:])] for r in rows))


def test_reductions_keep_the_best_price(spark):
    """Runs, dangling trees, rings and parallel ways: the reduced graph holds a best tree, and few nodes."""
    rng = random.Random(5)
    edges, n = [], 6
    for u, v in [(0, 1), (1, 2), (0, 2), (2, 3), (3, 4), (4, 5), (3, 5)]:
        for _ in range(2):  # two runs between the same ends
            stops = list(range(n, n + rng.randrange(1, 6)))
            n += len(stops)
            way = [u, *stops, v]
            edges += [(a, b, round(rng.uniform(0.1, 1), 3)) for a, b in zip(way, way[1:], strict=False)]
    for _ in range(30):  # trees that lead nowhere
        edges.append((rng.randrange(n), n, 0.5))
        n += 1
    ring = list(range(n, n + 5))
    edges += [(a, b, 0.1) for a, b in zip(ring, [*ring[1:], ring[0]], strict=True)]
    n += 5
    inst = op.Instance(n, edges, [4.0 if i in (0, 3, 5) else 0.0 for i in range(n)])
    frames = frame(spark, inst)
    pairs = frames[0].select(*frames[0].columns, op.F.monotonically_increasing_id().alias("id"))
    small, part = op.reduced(pairs, frames[1].where("prize > 0").select(op.F.col("id").alias("node")))
    left = small.collect()
    assert len({x for r in left for x in (r["source"], r["target"])}) <= 6 and len(left) <= 7
    assert part.count() == len(edges)
    whole = op.steiner(*frames).collect()
    plain = op.steiner(*frames, reduce=False).collect()
    assert price(inst, whole) <= price(inst, plain) + 1e-9
    tiny = op.Instance(6, [(int(r["source"][1:]), int(r["target"][1:]), r["cost"]) for r in left], inst.prizes[:6])
    assert price(inst, whole) == pytest.approx(cheapest(tiny))


def test_reduced_random_graphs_are_hardly_dearer(spark):
    """With a root, as a lone prize without an edge is a tree of its own there and here."""
    rng = random.Random(9)
    inst = instance(rng, 40, 60, True)
    inst.prizes[:] = [p * 2 if rng.random() < 0.4 else 0.0 for p in inst.prizes]
    frames = frame(spark, inst)
    got = [price(inst, op.steiner(*frames, root="n000", reduce=r).where("component = 'n000'").collect()) for r in (True, False)]
    assert got[0] <= got[1] * 1.05 + 1e-9


def test_a_large_component_by_the_heap():
    """A grid of 10,000 nodes; the plain scan would look at two hundred million edges."""
    rng, side = random.Random(1), 100
    edges = [(i, i + 1, rng.uniform(0.5, 1.5)) for i in range(side * side) if (i + 1) % side] + [(i, i + side, rng.uniform(0.5, 1.5)) for i in range(side * (side - 1))]
    inst = op.Instance(side * side, edges, [rng.uniform(0, 4) if rng.random() < 0.05 else 0.0 for _ in range(side * side)])
    kept, _ = op.grow(inst)
    assert 0 < inst.price(op.stripped(inst, kept)) < inst.price(kept)


def slow_connect(inst, terminals):
    """Distances from every terminal over the whole graph, then the nearest terminal by turns."""
    ways = {}
    for t in terminals:
        far, by, ready = {t: 0.0}, {}, [(0.0, t)]
        while ready:
            d, u = op.heapq.heappop(ready)
            for e, (a, b, c) in enumerate(inst.edges):
                for x, y in ((a, b), (b, a)):
                    if x == u and d == far[u] and d + c < far.get(y, float("inf")) - op.TINY:
                        far[y], by[y] = d + c, e
                        op.heapq.heappush(ready, (d + c, y))
        ways[t] = far, by
    chosen, joined = set(), []
    while len(joined) < len(terminals):
        steps = [(ways[s][0][x], x, s) for s in joined for x in terminals if x not in joined and x in ways[s][0]]
        if not steps:
            joined.append(min(t for t in terminals if t not in joined))
            continue
        _, x, s = min(steps)
        joined.append(x)
        at = x
        while at != s:
            e = ways[s][1][at]
            chosen.add(e)
            at = sum(inst.edges[e][:2]) - at
    return chosen


def test_terminals_are_joined_by_their_distances():
    rng = random.Random(21)
    for _ in range(300):
        inst = instance(rng, rng.randrange(1, 12), rng.randrange(0, 24))
        terminals = set(rng.sample(range(inst.n), rng.randrange(inst.n + 1)))
        assert op.connect(inst, terminals) == slow_connect(inst, terminals), (inst, terminals)


def test_thousands_of_terminals_are_joined_in_seconds():
    """A search of the whole graph from each of them would look at over a billion edges."""
    rng, side = random.Random(2), 100
    edges = [(i, i + 1, rng.uniform(0.5, 1.5)) for i in range(side * side) if (i + 1) % side] + [(i, i + side, rng.uniform(0.5, 1.5)) for i in range(side * (side - 1))]
    terminals = set(rng.sample(range(side * side), 3000))
    began = time.monotonic()
    chosen = op.connect(op.Instance(side * side, edges, [0.0] * side**2), terminals)
    assert time.monotonic() - began < 30 and terminals <= {x for e in chosen for x in edges[e][:2]}
