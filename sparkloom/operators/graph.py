"""Dependency graphs as edge tables (src, dst, weight): never a dense matrix.

Iterative operators first look at the size of the graph: one of at most BOUND distinct edges is handled by a single worker
in linear time, as numbers (`numbered`; only the edges go there, never pairs). Pairs are made by all tasks, each of which is
given the edges between components. Larger graphs are handled by joins: components by colouring forwards and backwards, layers
by peeling, reachability by a frontier of what the last round found; every round is cut.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.shared import cut
from sparkloom.operators import numbered as N

#: Distinct edges, and marked nodes, that one worker is given.
BOUND = 20_000_000
#: Components that one task looks for what they reach.
STARTS = 20_000


def kind_of(edges: DataFrame) -> str:
    """Type of the nodes: string, int or long."""
    return {"bigint": "long"}.get(kind := dict(edges.dtypes)["src"], kind)


def alone(edges: DataFrame, work: Callable[[N.Numbered], list[pa.Array]], schema: str) -> DataFrame:
    """Rows, as columns, that one worker makes of all edges (src, dst, and a weight if there is one), which are at most BOUND."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.RecordBatch.from_arrays(work(N.Numbered(batches)), names)
        for at in range(0, max(len(whole), 1), N.ROWS):
            yield whole.slice(at, N.ROWS)

    return edges.coalesce(1).mapInArrow(run, schema)


def fits(rows: DataFrame) -> bool:
    return rows.count() <= BOUND


def by_merge(rows: DataFrame) -> DataFrame:
    """Rows that grow with the graph: joins with them send nothing through the driver."""
    return rows.hint("merge")


def adjacency(edges: DataFrame) -> DataFrame:
    """Distinct edges between different nodes."""
    return edges.where("src <> dst").select("src", "dst").distinct()


def weighted(edges: DataFrame) -> DataFrame:
    """Summed weights of edges between different nodes."""
    return edges.where("src <> dst").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def with_prefix(edges: DataFrame, prefix: str) -> DataFrame:
    return edges.where(F.col("src").startswith(prefix) & F.col("dst").startswith(prefix))


def aggregate(edges: DataFrame, depth: int) -> DataFrame:
    """Edges between the first `depth` dotted parts of labels."""
    up = lambda c: F.substring_index(c, ".", depth)
    return weighted(edges.select(up("src").alias("src"), up("dst").alias("dst"), "weight"))


def transpose(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])


def merge(edges: DataFrame) -> DataFrame:
    """One edge for each pair: weights summed, the kind of the first by `seq`, but a foreign or process call if there is one."""
    strong = F.min_by("kind", "seq")
    special = F.max(F.when(F.col("kind").isin("ffi", "ipc"), F.struct("seq", "kind")))["kind"]
    return edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight"), F.coalesce(special, strong).alias("kind"))


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()


def condensed_table(step: DataFrame) -> DataFrame:
    """Components (c, members, next) of edges, at most BOUND, by number."""
    return cut(alone(step, N.condensed, f"c int, members array<{kind_of(step)}>, next array<int>"))


def reach_of(table: DataFrame) -> N.Reach:
    """Sizes of components (c, size, next) and edges between them, on the driver: eight bytes each."""
    rows = table.toArrow().sort_by("c").combine_chunks()
    after = rows["next"].combine_chunks()
    first = np.concatenate([[0], np.cumsum(after.value_lengths().to_numpy())])
    return N.Reach(rows["size"].to_numpy(), first, after.flatten().to_numpy())


def from_each(step: DataFrame, table: DataFrame, rows_of: Callable[[list[int]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Rows made from the numbers of all components (c, ...), which are dealt to tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from rows_of(batch.column(0).to_pylist())

    n = table.count()
    tasks = max(step.sparkSession.sparkContext.defaultParallelism, n // STARTS + 1)
    return step.sparkSession.range(0, n, 1, tasks).mapInArrow(run, schema)


def closure(edges: DataFrame) -> DataFrame:
    """All pairs (src, dst) with a path of at least one edge."""
    step = cut(adjacency(edges))
    if fits(step):
        table, context = condensed_table(step), step.sparkSession.sparkContext
        reach = context.broadcast(reach_of(table.select("c", F.size("members").alias("size"), "next")))
        labels = context.broadcast(table.select("c", "members").toArrow().sort_by("c")["members"].combine_chunks().flatten())

        def pairs(numbers: list[int]) -> Iterator[pa.RecordBatch]:
            for a, b in reach.value.pairs(numbers):
                yield pa.RecordBatch.from_arrays([labels.value.take(pa.array(a)), labels.value.take(pa.array(b))], ["src", "dst"])

        return from_each(step, table, pairs, f"src {kind_of(step)}, dst {kind_of(step)}")
    seen, frontier = step, step
    while True:
        new = frontier.alias("f").join(step.alias("e"), F.col("f.dst") == F.col("e.src")).select("f.src", "e.dst").distinct()
        frontier = cut(new.join(seen, ["src", "dst"], "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Nodes that `starts` (node) reach, themselves included."""
    step, seen = cut(adjacency(edges)), cut(starts.select("node").distinct())
    if fits(step) and fits(seen):

        def search(g: N.Numbered) -> list[pa.Array]:
            marked = np.zeros(g.n, bool)
            marked[g.src[g.src == g.dst]] = True
            return [g.labels.filter(pa.array(N.reached(g, marked)))]

        # An edge from a node to itself marks it.
        return alone(step.unionByName(seen.select(F.col("node").alias("src"), F.col("node").alias("dst"))), search, f"node {kind_of(step)}")
    frontier = seen
    while True:
        new = frontier.join(step, frontier.node == step.src).select(F.col("dst").alias("node")).distinct()
        frontier = cut(new.join(seen, "node", "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)


def cyclic_core(edges: DataFrame) -> DataFrame:
    """Edges left when nodes without predecessors or successors are taken away again and again: all cycles are among them."""
    core, n = cut(adjacency(edges)), -1
    while True:
        kept = core.join(core.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(core.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        core = cut(kept.select("src", "dst"))
        last, n = n, core.count()
        if n in (last, 0):
            return core


def coloured(core: DataFrame) -> DataFrame:
    """(node, component) of one component at least for every colour: the greatest node that reaches a node is its colour, and the nodes that reach back are its component."""
    colours = cut(nodes(core).withColumn("colour", F.col("node")))
    changed = -1
    while changed:
        passed = core.join(colours, core.src == colours.node).groupBy("dst").agg(F.max("colour").alias("above"))
        new = cut(colours.join(passed, colours.node == passed.dst, "left").select("node", F.greatest("colour", F.coalesce("above", "colour")).alias("colour"), (F.coalesce("above", "colour") > F.col("colour")).alias("new")))
        changed = new.where("new").limit(1).count()
        colours = new.drop("new")
    of = lambda end: colours.select(F.col("node").alias(end), F.col("colour").alias(f"of_{end}"))
    inside = cut(core.join(of("src"), "src").join(of("dst"), "dst").where("of_src = of_dst").select("src", "dst", F.col("of_src").alias("colour")))
    seen = cut(colours.where("node = colour"))
    frontier = seen
    while True:
        back = frontier.withColumnsRenamed({"node": "dst"}).join(inside, ["dst", "colour"]).select(F.col("src").alias("node"), "colour").distinct()
        frontier = cut(back.join(seen, ["node", "colour"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = cut(seen.unionByName(frontier))
    return seen.join(seen.groupBy("colour").agg(F.min("node").alias("component")), "colour").select("node", "component")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of strongly connected components with several members; named by their least member."""
    core, found = cut(adjacency(edges)), []
    while not fits(core):
        core = cyclic_core(core)
        if fits(core):
            break
        part = cut(coloured(core))
        found.append(part)
        rest = core.join(part.select(F.col("node").alias("src")), "src", "left_anti").join(part.select(F.col("node").alias("dst")), "dst", "left_anti")
        core = cut(rest.select("src", "dst"))

    def several_of(g: N.Numbered) -> list[pa.Array]:
        of = N.components(g.n, g.src, g.dst)
        at = np.flatnonzero(np.bincount(of, minlength=g.n)[of] > 1)
        return [g.labels.take(pa.array(at)), g.labels.take(pa.array(of[at]))]

    out = alone(core, several_of, f"node {kind_of(core)}, component {kind_of(core)}")
    if not found:
        return by_merge(cut(out))
    for part in found:
        out = out.unionByName(part)
    several = out.groupBy("component").count().where("count > 1").select("component")
    return by_merge(cut(out.join(several, "component", "left_semi").select("node", "component")))


def condensed(edges: DataFrame, of: DataFrame) -> DataFrame:
    """Edges between components, each node of no larger one for itself."""
    up = lambda end: of.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
    joined = adjacency(edges).join(up("src"), "src", "left").join(up("dst"), "dst", "left")
    return joined.select(F.coalesce("of_src", "src").alias("src"), F.coalesce("of_dst", "dst").alias("dst")).where("src <> dst").distinct()


def cycles(edges: DataFrame) -> DataFrame:
    """Components with their members and number of inner edges."""
    of = components(edges)
    inner = adjacency(edges).join(of.select(F.col("node").alias("src"), F.col("component").alias("a")), "src").join(of.select(F.col("node").alias("dst"), F.col("component").alias("b")), "dst").where("a = b").groupBy(F.col("a").alias("component")).agg(F.count("*").alias("inner_edges"))
    return of.groupBy("component").agg(F.count("*").alias("size"), F.array_sort(F.collect_list("node")).alias("members")).join(inner, "component")


def tears(edges: DataFrame) -> DataFrame:
    """The edge of least weight inside each component (ties by labels)."""
    of = components(edges)
    inner = weighted(edges).join(of.select(F.col("node").alias("src"), F.col("component").alias("a")), "src").join(of.select(F.col("node").alias("dst"), F.col("component").alias("b")), "dst").where("a = b")
    return inner.groupBy(F.col("a").alias("component")).agg(F.min(F.struct("weight", "src", "dst")).alias("t")).select("component", "t.src", "t.dst", "t.weight")


def propagation_cost(edges: DataFrame) -> DataFrame:
    """Share of pairs, each node with itself included, that a change can pass between.

    Pairs of components stand for those of their members, and what each reaches is only counted.
    """
    step = cut(adjacency(edges))
    n = nodes(step).agg(F.count("*").alias("n"))
    if fits(step):
        table = condensed_table(step)
        reach = step.sparkSession.sparkContext.broadcast(reach_of(table.select("c", F.size("members").alias("size"), "next")))

        def counted(numbers: list[int]) -> Iterator[pa.RecordBatch]:
            size = reach.value.size
            k = sum(int(size[c]) * (int(size[c]) - 1 + int(size[list(seen)].sum())) for c, seen in reach.value.each(numbers))
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64())], ["k"])

        pairs = from_each(step, table, counted, "k long").agg(F.coalesce(F.sum("k"), F.lit(0)).alias("pairs"))
    else:
        of = components(step)
        sizes = of.groupBy("component").agg(F.count("*").alias("size"))
        size = lambda end: sizes.select(F.col("component").alias(end), F.col("size").alias(f"size_{end}"))
        one = lambda end: F.coalesce(f"size_{end}", F.lit(1))
        between = closure(condensed(step, of)).join(size("src"), "src", "left").join(size("dst"), "dst", "left").select((one("src") * one("dst")).alias("k"))
        pairs = between.unionByName(sizes.select((F.col("size") * (F.col("size") - 1)).alias("k"))).agg(F.coalesce(F.sum("k"), F.lit(0)).alias("pairs"))
    return pairs.crossJoin(F.broadcast(n)).select("n", "pairs", F.when(F.col("n") > 0, (F.col("pairs") + F.col("n")) / (F.col("n") * F.col("n"))).otherwise(0.0).alias("cost"))


def degrees(edges: DataFrame) -> DataFrame:
    """Fan-in, fan-out and instability of each node."""
    plain = adjacency(edges)
    out = plain.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("fan_out"))
    into = plain.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("fan_in"))
    joined = out.join(into, "node", "full").select("node", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out"))
    return joined.withColumn("instability", F.col("fan_out") / (F.col("fan_in") + F.col("fan_out")))


def rate(value: Column, good: Column | float, warning: Column | float, rising: bool = False, equal: bool = False) -> Column:
    """good, warning or critical by two limits; `rising`: more is better; `equal`: a limit itself still counts."""
    within = (lambda x: value > x) if rising else (lambda x: value <= x) if equal else (lambda x: value < x)
    return F.when(within(good), "good").when(within(warning), "warning").otherwise("critical")


def ratings(edges: DataFrame, of: DataFrame) -> DataFrame:
    """One row: propagation cost, members of the largest cycle, share of edges inside clusters (node, cluster), and how each is rated."""
    largest = components(edges).groupBy("component").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("largest_cycle"))
    tagged = adjacency(edges).join(of.select(F.col("node").alias("src"), F.col("cluster").alias("a")), "src").join(of.select(F.col("node").alias("dst"), F.col("cluster").alias("b")), "dst")
    quality = tagged.agg(F.coalesce(F.avg((F.col("a") == F.col("b")).cast("double")), F.lit(1.0)).alias("quality"))
    row = propagation_cost(edges).select("cost").crossJoin(F.broadcast(largest)).crossJoin(F.broadcast(quality))
    return row.select("cost", rate(F.col("cost"), 0.10, 0.30).alias("cost_rating"), "largest_cycle", rate(F.col("largest_cycle"), 2, 10, equal=True).alias("cycle_rating"), "quality", rate(F.col("quality"), 0.80, 0.50, rising=True).alias("quality_rating"))


def ranked(g: N.Numbered) -> list[pa.Array]:
    """(node, component, level) of all nodes."""
    of, level = N.ranked(g)
    return [g.labels, g.labels.take(pa.array(of)), pa.array(level)]


def levels(edges: DataFrame) -> DataFrame:
    """Layers (node, component, level): components that depend on nothing are level 0, each other one is one above the highest it depends on; members of a component share its level."""
    step = cut(adjacency(edges))
    if fits(step):
        return alone(step, ranked, f"node {kind_of(step)}, component {kind_of(step)}, level int")
    of = components(step)
    left = cut(condensed(step, of))
    rest = cut(nodes(step).join(of, "node", "left").select(F.coalesce("component", "node").alias("node")).distinct())
    done, level = None, 0
    while not rest.isEmpty():
        free = cut(rest.join(left.select(F.col("src").alias("node")).distinct(), "node", "left_anti").withColumn("level", F.lit(level)))
        done = free if done is None else done.unionByName(free)
        rest = cut(rest.join(free, "node", "left_anti"))
        left = cut(left.join(free.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst"))
        level += 1
    named = nodes(step).join(of, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    return named.join(done.withColumnsRenamed({"node": "component"}), "component").select("node", "component", "level")


def partition(edges: DataFrame) -> DataFrame:
    """Order of the partitioned matrix: level, and place in it by component and node; and how many edges of the node point to a later place (feedback), which only those inside a component can."""
    ranks = cut(levels(edges))
    place = F.row_number().over(Window.partitionBy("level").orderBy("component", "node")) - 1
    of = lambda end: ranks.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
    back = adjacency(edges).join(of("src"), "src").join(of("dst"), "dst").where("of_src = of_dst and src < dst").groupBy(F.col("src").alias("node")).agg(F.count("*").alias("feedback"))
    return ranks.withColumn("place", place).join(back, "node", "left").select("node", "level", "place", F.coalesce("feedback", F.lit(0)).alias("feedback"))


def bands(edges: DataFrame) -> DataFrame:
    """Two readings of bands (node, band, longest): 1 for components that depend on another one and 0 for the others, and the longest path below."""
    return levels(edges).select("node", F.when(F.col("level") > 0, 1).otherwise(0).alias("band"), F.col("level").alias("longest"))


def search_clusters(edges: DataFrame, power: float = 2.0, passes: int = 50) -> DataFrame:
    """Assignment (node, cluster) of low coordination cost by deterministic moves, one after the other, so one worker makes them all; a cluster is named by its least node."""

    def search(g: N.Numbered) -> list[pa.Array]:
        return [g.labels, g.labels.take(pa.array(N.greedy(g, power, passes)))]

    step = cut(weighted(edges))
    return alone(step.select("src", "dst", F.col("weight").cast("double").alias("weight")), search, "node string, cluster string")


def clusters(edges: DataFrame, of: DataFrame) -> DataFrame:
    """Report of an assignment (node, cluster): size, inner edges, cohesion, edges in and out."""
    tagged = adjacency(edges).join(of.select(F.col("node").alias("src"), F.col("cluster").alias("a")), "src").join(of.select(F.col("node").alias("dst"), F.col("cluster").alias("b")), "dst")
    size = of.groupBy("cluster").agg(F.count("*").alias("size"))
    inner = tagged.where("a = b").groupBy(F.col("a").alias("cluster")).agg(F.count("*").alias("inner_edges"))
    out = tagged.where("a <> b").groupBy(F.col("a").alias("cluster")).agg(F.count("*").alias("outgoing"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    joined = size.join(inner, "cluster", "left").join(out, "cluster", "left").select("cluster", "size", zero("inner_edges"), zero("outgoing"))
    return joined.withColumn("cohesion", F.col("inner_edges") / F.greatest(F.lit(1), F.col("size") * (F.col("size") - 1)))


def cluster_cost(edges: DataFrame, of: DataFrame, power: float = 2.0) -> DataFrame:
    """Coordination cost: weight times size to the power inside a cluster, times all nodes to the power between clusters."""
    sizes = of.groupBy("cluster").agg(F.count("*").alias("size"))
    n = of.agg(F.count("*").alias("n"))
    tagged = weighted(edges).join(of.select(F.col("node").alias("src"), F.col("cluster").alias("a")), "src").join(of.select(F.col("node").alias("dst"), F.col("cluster").alias("b")), "dst").join(sizes, F.col("a") == F.col("cluster")).crossJoin(F.broadcast(n))
    return tagged.agg(F.sum(F.col("weight") * F.pow(F.when(F.col("a") == F.col("b"), F.col("size")).otherwise(F.col("n")), F.lit(power))).alias("cost"))


def dead_code(declarations: DataFrame, references: DataFrame, include_tests: bool = False) -> DataFrame:
    """Declarations (name, visibility, file, is_entry, is_test) that no entry point reaches.

    A reference (file, symbol) is an edge from each declaration of the file to those whose name ends in the symbol after
    `::`. Private and internal ones are definitely dead, others possibly.
    """
    suffixes = declarations.select("name", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("name", "::"))), lambda k: F.array_join(F.slice(F.split("name", "::"), -k, k), "::"))).alias("symbol"))
    edges = references.join(suffixes, "symbol").join(declarations.select(F.col("name").alias("from"), "file"), "file").select(F.col("from").alias("src"), F.col("name").alias("dst"))
    live = reachable(edges, declarations.where("is_entry").select(F.col("name").alias("node")))
    dead = declarations.join(live, declarations.name == live.node, "left_anti")
    if not include_tests:
        dead = dead.where("not is_test")
    return dead.select("name", "file", F.when(F.col("visibility").isin("private", "internal"), "definite").otherwise("possible").alias("confidence"))


def ready(items: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Pending items (id, status) all of whose dependencies (id, needs) are completed."""
    open_ = dependencies.join(items.where("status <> 'completed'").select(F.col("id").alias("needs")), "needs", "left_semi")
    return items.where("status = 'pending'").join(open_, "id", "left_anti")


def dependency_errors(items: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Empty and repeated ids, and dependencies on itself, repeated, or on nothing."""
    empty = items.where("trim(id) = ''").select("id", F.lit("empty_id").alias("error"))
    twice = items.groupBy("id").count().where("count > 1").select("id", F.lit("duplicate_id").alias("error"))
    own = dependencies.where("id = needs").select("id", F.lit("self").alias("error"))
    again = dependencies.groupBy("id", "needs").count().where("count > 1").select("id", F.lit("repeated").alias("error"))
    missing = dependencies.join(items.select(F.col("id").alias("needs")), "needs", "left_anti").select("id", F.lit("missing").alias("error"))
    return empty.unionByName(twice).unionByName(own).unionByName(again).unionByName(missing)


def directed(edges: DataFrame, of: DataFrame) -> DataFrame:
    """Report of modules (node, module): members, inner edges, neighbours outside, edges that leave, cohesion and coupling."""
    plain = cut(adjacency(edges))
    n = nodes(plain).agg(F.count("*").alias("n"))
    module = lambda end, name: of.select(F.col("node").alias(end), F.col("module").alias(name))
    tagged = plain.join(module("src", "a"), "src", "left").join(module("dst", "b"), "dst", "left")
    own = tagged.where("a is not null").groupBy(F.col("a").alias("module")).agg(F.count_if(F.col("a").eqNullSafe(F.col("b"))).alias("inner_edges"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("boundary_edges"))
    crossing = tagged.where("not a <=> b").select("src", "dst", "a", "b")
    ends = crossing.select(F.col("src").alias("x"), F.col("dst").alias("y"), F.col("a").alias("module")).unionByName(crossing.select(F.col("dst").alias("x"), F.col("src").alias("y"), F.col("b").alias("module"))).where("module is not null").distinct()
    outside = ends.groupBy("module").agg(F.count("*").alias("outside"))
    size = of.groupBy("module").agg(F.count("*").alias("size"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    rows = size.join(own, "module", "left").join(outside, "module", "left").crossJoin(F.broadcast(n)).select("module", "size", "n", zero("inner_edges"), zero("boundary_edges"), zero("outside"))
    k = F.col("size")
    cohesion = F.col("inner_edges") / F.greatest(F.lit(1), k * (k - 1))
    return rows.select("module", "size", "inner_edges", "boundary_edges", cohesion.alias("cohesion"), (F.col("outside") / F.greatest(F.lit(1), k * (F.col("n") - k) * 2)).alias("coupling"))


def affinity(edges: DataFrame, of: DataFrame) -> DataFrame:
    """For each node of no module, the module it has most edges with, in either direction (ties by name)."""
    both = adjacency(edges).select(F.col("src").alias("node"), F.col("dst").alias("other")).unionByName(adjacency(edges).select(F.col("dst").alias("node"), F.col("src").alias("other")))
    loose = both.join(of, "node", "left_anti").join(of.select(F.col("node").alias("other"), "module"), "other")
    return loose.groupBy("node", "module").agg(F.count("*").alias("n")).groupBy("node").agg(F.min(F.struct((-F.col("n")).alias("m"), "module")).alias("best")).select("node", "best.module", (-F.col("best.m")).alias("n"))


def quorum(members: DataFrame) -> DataFrame:
    """Health of boards (board, up): healthy if more than half are up, degraded if some, else critical."""
    counted = members.groupBy("board").agg(F.count("*").alias("total"), F.count_if(F.col("up")).alias("n_up"))
    return counted.withColumn("health", F.when(F.col("n_up") * 2 > F.col("total"), "healthy").when(F.col("n_up") > 0, "degraded").otherwise("critical"))


def violations(edges: DataFrame, of: DataFrame) -> DataFrame:
    """(kind, element, module, target, details) of elements of modules (node, module).

    wrong_module: some neighbours in its own module, but more in another one (a row for each such); god_element: needed from
    three modules or more; cross_module_cycle: members of a cycle over several modules.
    """
    module = lambda end, name: of.select(F.col("node").alias(end), F.col("module").alias(name))
    tagged = cut(adjacency(edges).join(module("src", "a"), "src").join(module("dst", "b"), "dst"))
    both = tagged.unionByName(tagged.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    counted = both.groupBy("src", "a", "b").agg(F.count("*").alias("n"))
    own = counted.where("a = b").select("src", F.col("n").alias("own"))
    row = lambda df, kind, target, details: df.select(F.lit(kind).alias("kind"), F.col("src").alias("element"), F.col("a").alias("module"), target.alias("target"), details.alias("details"))
    wrong = row(counted.where("a <> b").join(own, "src").where("n > own"), "wrong_module", F.col("b"), F.col("n"))
    needed = tagged.groupBy(F.col("dst").alias("src"), F.col("b").alias("a")).agg(F.count_distinct("a").alias("modules")).where("modules >= 3")
    god = row(needed, "god_element", F.col("a"), F.col("modules"))
    ring = components(edges).join(of, "node")
    wide = ring.groupBy("component").agg(F.count_distinct("module").alias("modules")).where("modules > 1")
    cycle = ring.join(wide, "component").select(F.col("node").alias("src"), F.col("module").alias("a"), "modules")
    return wrong.unionByName(god).unionByName(row(cycle, "cross_module_cycle", F.col("a"), F.col("modules")))


def migration_plan(edges: DataFrame, of: DataFrame, fit: float = 0.6) -> DataFrame:
    """Steps (phase, action, element, from_module, to_module, risk) in the order of phase and element.

    1 break cycles over modules, 2 move misplaced elements, 3 assign elements of no module of which more than `fit` of the
    dependencies are with one, 4 split god elements that no earlier step names.
    """
    found = cut(violations(edges, of))
    step = lambda df, phase, action, risk: df.select(F.lit(phase).alias("phase"), F.lit(action).alias("action"), "element", F.col("module").alias("from_module"), F.col("target").alias("to_module"), F.lit(risk).alias("risk"))
    both = adjacency(edges)
    ends = both.select(F.col("src").alias("node"), F.col("dst").alias("other")).unionByName(both.select(F.col("dst").alias("node"), F.col("src").alias("other"))).join(of, "node", "left_anti")
    of_all = ends.groupBy("node").agg(F.count("*").alias("whole"))
    loose = affinity(edges, of).join(of_all, "node").where(F.col("n") / F.col("whole") > fit)
    assign = loose.select(F.lit(3).alias("phase"), F.lit("move_element").alias("action"), F.col("node").alias("element"), F.lit(None).cast("string").alias("from_module"), F.col("module").alias("to_module"), F.lit("low").alias("risk"))
    breaks = step(found.where("kind = 'cross_module_cycle'"), 1, "extract_interface", "medium")
    moves = step(found.where("kind = 'wrong_module'"), 2, "move_element", "low")
    earlier = breaks.unionByName(moves).unionByName(assign)
    splits = step(found.where("kind = 'god_element'"), 4, "split_element", "high").join(earlier.select("element").distinct(), "element", "left_anti")
    return earlier.unionByName(splits.select(*earlier.columns))


def suggestions(edges: DataFrame, of: DataFrame, modules: DataFrame | None = None) -> DataFrame:
    """What to change first (priority, kind, source, target): priority 0 critical, 1 high, 2 medium, 3 low.

    Tear edges of cycles (critical if a cycle has over 10 members), pairs of clusters (node, cluster) with 3
    edges or more, clusters of over 15 elements with cohesion below 0.3, elements with fan-in over 20, unstable ones
    with fan-in over 5, edges against the order of the partition, and the steps of the migration to `modules`.
    """
    d, text = degrees(edges), lambda c: F.lit(c).cast("string")
    row = lambda df, priority, kind, source, target: df.select(priority.alias("priority"), F.lit(kind).alias("kind"), source.alias("source"), target.alias("target"))
    high, medium, none = F.lit(1), F.lit(2), F.lit("")
    ring = cut(components(edges))
    largest = ring.groupBy("component").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("largest"))
    out = row(tears(edges).crossJoin(F.broadcast(largest)), F.when(F.col("largest") > 10, 0).otherwise(1), "extract_interface", F.col("src"), F.col("dst"))
    tagged = weighted(edges).join(of.select(F.col("node").alias("src"), F.col("cluster").alias("a")), "src").join(of.select(F.col("node").alias("dst"), F.col("cluster").alias("b")), "dst").where("a <> b")
    out = out.unionByName(row(tagged.groupBy("a", "b").count().where("count >= 3"), medium, "create_module_boundary", text(F.col("a")), text(F.col("b"))))
    out = out.unionByName(row(clusters(edges, of).where("size > 15 and cohesion < 0.3"), medium, "split_package", text(F.col("cluster")), none))
    out = out.unionByName(row(d.where("fan_in > 20"), high, "extract_interface", F.col("node"), none))
    out = out.unionByName(row(d.where("instability > 0.8 and fan_in > 5"), medium, "internalize_detail", F.col("node"), none))
    inside = lambda end: ring.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
    against = adjacency(edges).join(inside("src"), "src").join(inside("dst"), "dst").where("of_src = of_dst and src < dst")
    out = out.unionByName(row(against, medium, "introduce_layer", F.col("src"), F.col("dst")))
    if modules is None:
        return out
    return out.unionByName(row(migration_plan(edges, modules), F.when(F.col("risk") == "low", 3).when(F.col("risk") == "medium", 2).otherwise(1), "migration_step", F.col("element"), F.col("to_module")))


def batches(items: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(id, batch): items (id) without dependencies (id, needs) are batch 0, each other one is one after the last it needs. Raises, with the errors, if the dependencies are in error or go in a circle."""
    errors = dependency_errors(items, dependencies)
    edges = dependencies.select(F.col("id").alias("src"), F.col("needs").alias("dst"))
    circle = components(edges).select(F.col("node").alias("id"), F.lit("cycle").alias("error"))
    first = errors.unionByName(circle).orderBy("error", "id").limit(20).collect()
    if first:
        raise ValueError("; ".join(f"{r.error}: {r.id}" for r in first))
    return items.select("id").join(levels(edges).select(F.col("node").alias("id"), "level"), "id", "left").select("id", F.coalesce("level", F.lit(0)).alias("batch"))


def tag_cycles(edges: DataFrame) -> DataFrame:
    """Chains (chain) of tags (child, parent) that are their own ancestors: one of each circle, a shortest one from its least tag, which begins and ends it."""
    pairs = cut(adjacency(edges.select(F.col("child").alias("src"), F.col("parent").alias("dst"))))
    of = components(pairs)
    tagged = pairs.join(of.select(F.col("node").alias("src"), F.col("component").alias("a")), "src").join(of.select(F.col("node").alias("dst"), F.col("component").alias("b")), "dst").where("a = b")
    inner = cut(tagged.select("src", "dst", F.col("a").alias("component")))
    found, ahead = None, inner.where("src = component").select("component", F.array("src", "dst").alias("chain"))
    while True:
        ahead = cut(ahead)
        closed = ahead.where(F.element_at("chain", -1) == F.col("component"))
        best = closed.groupBy("component").agg(F.min("chain").alias("chain"))
        found = best if found is None else found.unionByName(best)
        rest = ahead.join(closed.select("component").distinct(), "component", "left_anti")
        if rest.isEmpty():
            return found.select("chain")
        grown = rest.join(inner, (F.element_at("chain", -1) == inner.src) & (rest.component == inner.component)).where(~F.array_contains("chain", F.col("dst")) | (F.col("dst") == rest.component))
        # Of the chains of equal length to one tag, the least.
        ahead = grown.select(rest.component.alias("component"), F.concat("chain", F.array("dst")).alias("chain")).groupBy("component", F.element_at("chain", -1).alias("last")).agg(F.min("chain").alias("chain")).drop("last")


def tag_orphans(edges: DataFrame, known: DataFrame) -> DataFrame:
    """Tags of edges (child, parent) that are not among the known ones (tag)."""
    return edges.select(F.explode(F.array("child", "parent")).alias("tag")).distinct().join(known, "tag", "left_anti")


def all_tags(top: DataFrame, skills: DataFrame) -> DataFrame:
    """Top-level tags (tag), and of skills (category, tags) the dashed category and each tag, without empty ones."""
    dashed = F.trim(F.regexp_replace(F.regexp_replace(F.lower("category"), "[^a-z0-9]+", "-"), "-+", "-"), F.lit("-"))
    return top.select("tag").unionByName(skills.select(dashed.alias("tag"))).unionByName(skills.select(F.explode("tags").alias("tag"))).where("tag <> ''").distinct()
