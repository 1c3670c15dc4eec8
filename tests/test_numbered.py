"""Graphs as numbers against plain searches, and operators on more edges than a worker once was given."""

import random

import numpy as np
import pyarrow as pa
import pytest

from sparkloom.operators import graph as G
from sparkloom.operators import numbered as N


def numbered(rows):
    return N.Numbered(iter([pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[at : at + 7]]) for k in range(3)], ["src", "dst", "weight"]) for at in range(0, len(rows), 7)]))


def plain_greedy(rows, power, passes):
    near = {}
    for a, b, w in rows:
        near.setdefault(a, {})[b] = near.get(a, {}).get(b, 0.0) + w
        near.setdefault(b, {})[a] = near.get(b, {}).get(a, 0.0) + w
    order = sorted(near)
    of = {node: node for node in order}
    size, inner = dict.fromkeys(order, 1), dict.fromkeys(order, 0.0)
    whole = float(len(order)) ** power
    held = lambda n, w: w * (float(n) ** power - whole)
    for _ in range(passes):
        moved = False
        for node in order:
            own, to = of[node], {}
            for other, w in near[node].items():
                to[of[other]] = to.get(of[other], 0.0) + w
            mine = to.get(own, 0.0)
            leave = held(size[own] - 1, inner[own] - mine) - held(size[own], inner[own])
            best, goal = -1e-9, own
            for cluster in sorted(to):
                if cluster != own:
                    gain = leave + held(size[cluster] + 1, inner[cluster] + to[cluster]) - held(size[cluster], inner[cluster])
                    if gain < best:
                        best, goal = gain, cluster
            if goal != own:
                size[own], inner[own] = size[own] - 1, inner[own] - mine
                size[goal], inner[goal] = size[goal] + 1, inner[goal] + to[goal]
                of[node], moved = goal, True
        if not moved:
            break
    least = {}
    for node in order:
        least.setdefault(of[node], node)
    return {node: least[of[node]] for node in order}


@pytest.mark.parametrize("seed", range(12))
def test_moves_are_those_of_looking_at_every_node(seed):
    rng = random.Random(seed)
    n = rng.choice((5, 40, 300))
    rows = list({(a, b): (f"n{a:03d}", f"n{b:03d}", float(rng.randrange(1, 6))) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(2 * n)) if a != b}.values())
    g = numbered(rows)
    for passes in (1, 3, 50):
        found = dict(zip(g.labels.to_pylist(), g.labels.take(pa.array(N.greedy(g, 2.0, passes))).to_pylist()))
        assert found == plain_greedy(rows, 2.0, passes)


@pytest.mark.parametrize("seed", range(12))
def test_components_levels_and_pairs(seed):
    rng = random.Random(seed)
    n = rng.choice((4, 30, 80))
    rows = list({(a, b): (f"n{a:03d}", f"n{b:03d}", 1.0) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(rng.choice((n // 2, n, 2 * n)))) if a != b}.values())
    g = numbered(rows)
    reach = np.zeros((g.n, g.n), bool)
    reach[g.src, g.dst] = True
    for k in range(g.n):
        reach |= reach[:, k : k + 1] & reach[k : k + 1, :]
    of, level = N.ranked(g)
    assert list(of) == [min([x, *np.flatnonzero(reach[x] & reach[:, x])]) for x in range(g.n)]
    longest = dict.fromkeys(range(g.n), 0)
    for _ in range(g.n):
        for a, b in zip(of[g.src], of[g.dst]):
            if a != b:
                longest[a] = max(longest[a], longest[b] + 1)
    assert list(level) == [longest[c] for c in of]
    _, members, after = N.condensed(g)
    labels = members.flatten().to_pylist()
    table = N.Reach(np.diff(members.offsets.to_numpy()), after.offsets.to_numpy(), after.flatten().to_numpy())
    for rows_at_once in (3, N.ROWS):
        N.ROWS, kept = rows_at_once, N.ROWS
        found = [(labels[a], labels[b]) for x, y in table.pairs(list(range(len(members)))) for a, b in zip(x, y)]
        N.ROWS = kept
        assert sorted(found) == sorted((g.labels[int(a)].as_py(), g.labels[int(b)].as_py()) for a, b in np.argwhere(reach))
    marked = np.arange(g.n) % 5 == 0
    assert list(N.reached(g, marked)) == list(marked | reach[marked].any(axis=0))


def test_more_edges_than_a_worker_once_took(spark):
    """250,000 edges, for which a search for clusters raised."""
    edges = spark.range(1, 250_001).selectExpr("'n' || id AS src", "'n' || (id DIV 2) AS dst", "1L AS weight")
    assert G.search_clusters(edges).count() == 250_001
