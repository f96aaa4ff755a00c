"""Word graphs per id: nodes, edges with multiplicity, connectivity and shortest paths.

Counts are aggregates of the distributed edge table. Only connectivity and paths need a graph in one place: an id's distinct
edges, bounded by the square of its vocabulary and not by the number of words. Walks of large graphs are split over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocalith.functions import text as tx
from vocalith.functions.stats import ratio


def pairs(tokens: DataFrame) -> DataFrame:
    """(id, ws array) -> (id, src, dst): neighbours within a segment; a segment of one word gives (word, null)."""
    near = F.when(F.size("ws") > 1, F.transform(F.sequence(F.lit(1), F.size("ws") - 1), lambda i: F.struct(F.element_at("ws", i).alias("src"), F.element_at("ws", i + 1).alias("dst"))))
    alone = F.when(F.size("ws") == 1, F.array(F.struct(F.element_at("ws", F.lit(1)).alias("src"), F.lit(None).cast("string").alias("dst"))))
    return tokens.select("id", F.explode(F.coalesce(near, alone)).alias("e")).select("id", "e.src", "e.dst")


def naive_tokens(segments: DataFrame, text: str = "text") -> DataFrame:
    """Lower-cased words of the cleaned text."""
    return segments.select("id", tx.words_any_space(tx.clean(tx.text_or_nan(text))).alias("ws"))


def edges(tokens: DataFrame) -> DataFrame:
    """(id, src, dst, mult); dst null for words that stand alone. Repeated edges are added up before the shuffle."""
    return pairs(tokens).groupBy("id", "src", "dst").agg(F.count("*").alias("mult"))


def graph_counts(e: DataFrame, suffix: str = "_naive") -> DataFrame:
    """num_nodes, num_edges, ave_degree (2E/N), num_p_edges, l1 (loops), d (distinct pairs without loops / N^2)."""
    e = e.where("mult > 0")  # a plan that needs the multiplicity, too, shares the edges' shuffle with the others
    nodes = e.select("id", F.explode(F.array("src", "dst")).alias("v")).where("v is not null").distinct().groupBy("id").agg(F.count("*").alias("n"))
    real = F.col("dst").isNotNull()
    loop = F.col("src") == F.col("dst")
    sums = e.groupBy("id").agg(F.sum(F.when(real, F.col("mult")).otherwise(0)).alias("m"), F.sum(F.when(real, F.col("mult") - 1).otherwise(0)).alias("p"), F.sum(F.when(loop, F.col("mult")).otherwise(0)).alias("l1"), F.sum(F.when(real & ~loop, 1).otherwise(0)).alias("pairs"))
    both = nodes.join(sums, "id")
    name = lambda c, k: c.alias(f"{k}{suffix}")
    return both.select("id", name(F.col("n"), "num_nodes"), name(F.col("m"), "num_edges"), name(ratio(2 * F.col("m"), F.col("n")), "ave_degree"), name(F.col("p"), "num_p_edges"), name(F.col("l1"), "l1"), name(ratio(F.col("pairs"), F.col("n") * F.col("n")), "d"))


def graph_loops(e: DataFrame, suffix: str = "_naive") -> DataFrame:
    """l2 and l3: closed walks of two and three different steps, by multiplicity, each counted once.

    A walk of three steps is looked for from its vertex of fewest neighbours: only steps into and out of that vertex are
    joined, so that a word with very many neighbours makes no paths of its own.
    """
    x = e.where("dst is not null and src <> dst").select("id", "src", "dst", "mult")
    back = x.select("id", F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("mult").alias("mult2"))
    l2 = x.where("src < dst").join(back, ["id", "src", "dst"]).groupBy("id").agg(F.sum(F.col("mult") * F.col("mult2")).cast("double").alias("l2"))
    degree = x.select("id", F.explode(F.array("src", "dst")).alias("v")).groupBy("id", "v").agg(F.count("*").alias("deg"))
    of = lambda end: degree.select("id", F.col("v").alias(end), F.col("deg").alias(f"{end}_deg"))
    ranked = x.join(of("src"), ["id", "src"]).join(of("dst"), ["id", "dst"])
    first, last = F.struct("src_deg", "src"), F.struct("dst_deg", "dst")
    # into and out of the least vertex (mid), and the step that closes the walk
    into = ranked.where(last < first).select("id", F.col("dst").alias("mid"), F.col("src").alias("a"), F.col("mult").alias("m1"))
    out = ranked.where(first < last).select("id", F.col("src").alias("mid"), F.col("dst").alias("c"), F.col("mult").alias("m2"))
    closing = x.select("id", F.col("src").alias("c"), F.col("dst").alias("a"), F.col("mult").alias("m3"))
    l3 = into.join(out, ["id", "mid"]).join(closing, ["id", "c", "a"]).groupBy("id").agg(F.sum(F.col("m1") * F.col("m2") * F.col("m3")).cast("double").alias("l3"))
    ids = e.select("id").distinct()
    return ids.join(l2, "id", "left").join(l3, "id", "left").select("id", *(F.coalesce(k, F.lit(0.0)).alias(f"{k}{suffix}") for k in ("l2", "l3")))


def strong_sizes(out: list[list[int]]) -> list[int]:
    """Sizes of strongly connected components, without recursion."""
    n = len(out)
    low, number, on, stack, sizes, count = [0] * n, [0] * n, [False] * n, [], [], 0
    for root in range(n):
        if number[root]:
            continue
        work: list[tuple[int, Iterator[int]]] = []
        count += 1
        number[root] = low[root] = count
        stack.append(root)
        on[root] = True
        work.append((root, iter(out[root])))
        while work:
            v, rest = work[-1]
            for w in rest:
                if not number[w]:
                    count += 1
                    number[w] = low[w] = count
                    stack.append(w)
                    on[w] = True
                    work.append((w, iter(out[w])))
                    break
                if on[w]:
                    low[v] = min(low[v], number[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == number[v]:
                    size = 0
                    while True:
                        w = stack.pop()
                        on[w] = False
                        size += 1
                        if w == v:
                            break
                    sizes.append(size)
    return sizes


#: Sources of shortest paths that are walked at once: bits of one number a vertex.
SOURCES = 4096
#: Distinct edges of an id beyond which its sources are split over tasks.
SPLIT_EDGES = 50_000


def _adjacency(edge_list: list[tuple[str, str | None]]) -> tuple[list[list[int]], list[list[int]]]:
    """Vertices in order of their names, so that every task numbers them alike: directed and undirected neighbours."""
    names = {v: i for i, v in enumerate(sorted({v for pair in edge_list for v in pair if v is not None}))}
    out: list[list[int]] = [[] for _ in names]
    near: list[set[int]] = [set() for _ in names]
    for x, y in edge_list:
        if y is not None:
            a, b = names[x], names[y]
            out[a].append(b)
            if a != b:
                near[a].add(b)
                near[b].add(a)
    return out, [list(x) for x in near]


def distances(near: list[list[int]], sources: range) -> tuple[int, int, int, int]:
    """Largest component, diameter, sum of distances and number of reached pairs, over breadth-first walks from ``sources``.

    All walks of a batch go on together: bit i of a vertex's number says whether source i has reached it, and a step is an
    OR over neighbours.
    """
    n, lcc, diameter, total, reached = len(near), 0, 0, 0, 0
    for first in range(0, len(sources), SOURCES):
        batch = sources[first : first + SOURCES]
        seen = [0] * n
        for bit, v in enumerate(batch):
            seen[v] = 1 << bit
        front, step = {v: seen[v] for v in batch}, 0
        found = len(batch)
        while front:
            step += 1
            ahead: dict[int, int] = {}
            for v, bits in front.items():
                for w in near[v]:
                    ahead[w] = ahead.get(w, 0) | bits
            front = {}
            for w, bits in ahead.items():
                if fresh := bits & ~seen[w]:
                    seen[w] |= fresh
                    front[w] = fresh
            if front:
                many = sum(bits.bit_count() for bits in front.values())
                total += step * many
                found += many
                diameter = step if step > diameter else diameter
        reached += found - len(batch)
    if len(sources):
        lcc = largest_component(near)
    return lcc, diameter, total, reached


def largest_component(near: list[list[int]]) -> int:
    seen, most = [False] * len(near), 0
    for root in range(len(near)):
        if not seen[root]:
            seen[root], stack, size = True, [root], 0
            while stack:
                v = stack.pop()
                size += 1
                for w in near[v]:
                    if not seen[w]:
                        seen[w] = True
                        stack.append(w)
            most = max(most, size)
    return most


def connectivity(edge_list: list[tuple[str, str | None]]) -> tuple[int, int, int, float]:
    """lcc, lsc, diameter and average shortest path (over unordered pairs of one component); zeros for nothing."""
    lcc, lsc, diameter, total, reached = partial_connectivity(edge_list, 0, 1)
    return lcc, lsc, diameter, total / reached if reached else 0.0


def partial_connectivity(edge_list: list[tuple[str, str | None]], part: int, parts: int) -> tuple[int, int, int, int, int]:
    """lcc, lsc, diameter, sum of distances, reached pairs: those of every ``parts``-th source, from ``part`` on; lsc only in part 0."""
    out, near = _adjacency(edge_list)
    if not out:
        return 0, 0, 0, 0, 0
    lcc, diameter, total, reached = distances(near, range(part, len(near), parts))
    return lcc, max(strong_sizes(out)) if part == 0 else 0, diameter, total, reached


def graph_connectivity(e: DataFrame, suffix: str = "_naive", split_edges: int = SPLIT_EDGES) -> DataFrame:
    """lcc, lsc, di, asp of each id.

    Edges are sorted by id within partitions and streamed in batches, so any number of small graphs costs no call each;
    one graph at a time is held. An id with more than ``split_edges`` distinct edges is split by sources: each part has all
    edges and a share of the walks, and sums of distances are added up.
    """
    schema = "id string, lcc bigint, lsc bigint, di bigint, total bigint, reached bigint"
    names = [x.split()[0] for x in schema.split(", ")]

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, []
        for batch in batches:
            out = []
            for key, part, parts, a, b in zip(batch["id"], batch["part"], batch["parts"], batch["src"], batch["dst"]):
                if (key, part, parts) != at:
                    if held:
                        out.append((at[0], *partial_connectivity(held, *at[1:])))
                    at, held = (key, part, parts), []
                held.append((a, b if isinstance(b, str) else None))
            if out:
                yield pd.DataFrame(out, columns=names)
        if held:
            yield pd.DataFrame([(at[0], *partial_connectivity(held, *at[1:]))], columns=names)

    distinct = (e.where("mult > 0") if "mult" in e.columns else e).select(F.col("id").cast("string").alias("id"), "src", "dst")
    large = distinct.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") > split_edges).select("id", F.ceil(F.col("n") / split_edges).cast("int").alias("parts"))
    cut = distinct.join(large, "id", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    parts = cut.repartition("id", "part").sortWithinPartitions("id", "part").select("id", "part", "parts", "src", "dst").mapInPandas(measure, schema)
    whole = parts.groupBy("id").agg(F.max("lcc").alias("lcc"), F.max("lsc").alias("lsc"), F.max("di").alias("di"), F.sum("total").alias("total"), F.sum("reached").alias("reached"))
    return whole.select("id", *(F.col(c).alias(f"{c}{suffix}") for c in ("lcc", "lsc", "di")), F.coalesce(ratio(F.col("total"), F.col("reached")), F.lit(0.0)).alias(f"asp{suffix}"))


def normalised(features: DataFrame, size: DataFrame) -> DataFrame:
    """Each feature again as ``<feature>_norm``: over ``size`` (id, n), characters or words of the id's segments."""
    names = [c for c in features.columns if c != "id"]
    return features.join(size, "id").select("id", *names, *(ratio(F.col(c), F.col("n")).alias(f"{c}_norm") for c in names))


def segment_size(segments: DataFrame, by: str = "chars", text: str = "text") -> DataFrame:
    body = tx.clean(tx.text_or_nan(text))
    n: Column = F.length(body) if by == "chars" else F.size(tx.words(body))
    return segments.groupBy("id").agg(F.sum(n).alias("n"))


def graph_features(segments: DataFrame, graphs: dict[str, DataFrame] | None = None, norm_by: str = "chars") -> DataFrame:
    """All graph features of all graphs (name -> tokens (id, ws)), and their normalised twins."""
    graphs = graphs or {"naive": naive_tokens(segments)}
    # all graphs go through the same stages, as ids of their own
    tokens = reduce(DataFrame.unionByName, (t.select(F.concat(F.lit(f"{name}\x01"), F.col("id").cast("string")).alias("id"), "ws") for name, t in graphs.items()))
    e = edges(tokens)
    each = graph_counts(e, "").join(graph_connectivity(e, ""), "id")
    named = each.withColumn("graph", F.substring_index("id", "\x01", 1)).withColumn("id", F.expr("substring(id, length(graph) + 2)"))
    values = [c for c in each.columns if c != "id"]
    wide = named.groupBy("id").agg(*(F.max(F.when(F.col("graph") == name, F.col(c))).alias(f"{c}_{name}") for name in graphs for c in values), F.count("*").alias("_n")).where(F.col("_n") == len(graphs)).drop("_n")
    return normalised(wide, segment_size(segments, norm_by))
