"""Junction graphs: connectivity, simple paths with limits, circuits, shortest fills, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.operators.components import connected_components
from strandweave.runtime import cut

FOR, BAK, OUT, IN = 0, 1, 2, 3

def junction_edges(junctions: DataFrame) -> DataFrame:
    """Both ways through each junction (a, b): FOR a to FOR b, and BAK b to BAK a."""
    e = F.array(
        F.struct(F.lit(FOR).alias("src_dir"), F.col("a").alias("src"), F.lit(FOR).alias("dst_dir"), F.col("b").alias("dst")),
        F.struct(F.lit(BAK).alias("src_dir"), F.col("b").alias("src"), F.lit(BAK).alias("dst_dir"), F.col("a").alias("dst")),
    )
    return junctions.select(F.explode(e).alias("e")).select("e.*").distinct()


def connectivity(ends: DataFrame, same_chromosome_only: bool = False) -> DataFrame:
    """Edges between junction ends (node, contig, role f/b, strand, chr, st, nd) of different contigs on one chromosome.

    An end is open to one side of the reference: the front of a + row and the back of a - row to smaller positions, the
    others to larger ones. It is open at st in front, at nd in back. Two ends connect when they face each other, the one
    that is open upwards first, or when their spans overlap. A path leaves a front backwards and enters it forwards, and
    the other way round at a back, so each pair gives two edges.
    same_chromosome_only: only junctions whose two ends share a chromosome take part (column same_chr).
    """
    d = ends.where("same_chr") if same_chromosome_only else ends
    front = F.col("role") == "f"
    d = d.withColumn("up", front != (F.col("strand") == "+")).withColumn("at", F.when(front, F.col("st")).otherwise(F.col("nd")))
    d = d.withColumn("leave", F.when(front, BAK).otherwise(FOR)).withColumn("enter", F.when(front, FOR).otherwise(BAK))
    held = ("node", "contig", "st", "nd", "at", "leave", "enter")
    low, high = (d.where(F.col("up") == up).select("chr", *[F.col(c).alias(f"{p}_{c}") for c in held]) for p, up in (("l", True), ("h", False)))
    overlap = F.greatest("l_st", "h_st") < F.least("l_nd", "h_nd")
    pairs = low.join(high, "chr").where((F.col("l_contig") != F.col("h_contig")) & ((F.col("h_at") > F.col("l_at")) | overlap))

    def way(a: str, b: str) -> Column:
        return F.struct(F.col(f"{a}_leave").alias("src_dir"), F.col(f"{a}_node").cast("long").alias("src"), F.col(f"{b}_enter").alias("dst_dir"), F.col(f"{b}_node").cast("long").alias("dst"))

    return pairs.select(F.explode(F.array(way("l", "h"), way("h", "l"))).alias("e")).select("e.*").distinct()


def telomere_edges(telomeres: DataFrame, ends: DataFrame) -> DataFrame:
    """Edges of telomere nodes (node, chr, side f/b, st, nd) with junction ends on the same chromosome, and of the two
    telomeres of a chromosome with each other.

    Start and end must be ordered alike (before or after), and as the side asks for: front before, back after.
    """
    t = telomeres.select(F.col("node").alias("t"), "chr", F.col("side").alias("side"), F.col("st").alias("t_st"), F.col("nd").alias("t_nd"))
    p = t.join(ends, "chr")
    order = F.when((F.col("t_st") < F.col("st")) & (F.col("t_nd") < F.col("nd")), "inc").when((F.col("t_st") > F.col("st")) & (F.col("t_nd") > F.col("nd")), "dec")
    p = p.withColumn("o", order).where("(side = 'f' and o = 'inc') or (side = 'b' and o = 'dec')")
    kind = F.concat("role", "strand")
    p = p.where(((F.col("o") == "inc") & kind.isin("f+", "b-")) | ((F.col("o") == "dec") & kind.isin("b+", "f-")))
    f = F.col("role") == "f"

    def edge(a, b, c, d):
        return F.struct(a.alias("src_dir"), b.cast("long").alias("src"), c.alias("dst_dir"), d.cast("long").alias("dst"))

    out = F.array(
        edge(F.lit(OUT), F.col("t"), F.when(f, FOR).otherwise(BAK), F.col("node")),
        edge(F.when(f, BAK).otherwise(FOR), F.col("node"), F.lit(IN), F.col("t")),
    )
    a = t.where("side = 'f'").select("chr", F.col("t").alias("x"))
    b = t.where("side = 'b'").select("chr", F.col("t").alias("y"))
    ends_edges = a.join(b, "chr").select(F.explode(F.array(edge(F.lit(OUT), F.col("x"), F.lit(IN), F.col("y")), edge(F.lit(OUT), F.col("y"), F.lit(IN), F.col("x")))).alias("e"))
    return p.select(F.explode(out).alias("e")).unionByName(ends_edges).select("e.*").distinct()


class TooManyPaths(RuntimeError):
    """An attempt at path enumeration went over its total."""


def simple_paths(
    edges: DataFrame,
    sources: DataFrame,
    targets: DataFrame,
    max_steps: int,
    max_chr_changes: int | None = None,
    max_dir_changes: int | None = None,
    per_pair: int | None = None,
    total: int | None = None,
    node_reuse: bool = False,
) -> DataFrame:
    """(src, dst, nodes, length) of paths from each source to each target that use no node twice.

    edges: src, dst, and optionally dist, chr_change, dir_change (0 or 1 each). One join per level; partial paths from
    which no target can be reached in the steps left are dropped before they grow, and levels are written to the shared
    folder. per_pair keeps the shortest, then first, paths of each pair; total raises TooManyPaths when passed.
    """
    cols = edges.columns
    e = edges.select("src", "dst", (F.col("dist") if "dist" in cols else F.lit(1)).cast("double").alias("dist"),
                     (F.col("chr_change") if "chr_change" in cols else F.lit(0)).cast("int").alias("cc"), (F.col("dir_change") if "dir_change" in cols else F.lit(0)).cast("int").alias("dc"))
    e = cut(e.distinct(), "edges")
    goal = targets.select(F.col("node").alias("dst")).distinct()
    reach = [cut(goal.select(F.col("dst").alias("n")), "reach")]  # nodes from which a target is at most k steps away
    for _ in range(max_steps - 1):
        reach.append(cut(reach[-1].unionByName(e.join(reach[-1], e["dst"] == reach[-1]["n"]).select(F.col("src").alias("n"))).distinct(), "reach"))
    front = sources.select(F.col("node").alias("src"), F.col("node").alias("at"), F.array("node").alias("nodes"), F.lit(0.0).alias("length"), F.lit(0).alias("cc"), F.lit(0).alias("dc"))
    done: DataFrame | None = None
    for step in range(max_steps):
        nxt = e.select(F.col("src").alias("at"), F.col("dst").alias("to"), F.col("dist").alias("d"), F.col("cc").alias("ec"), F.col("dc").alias("ed"))
        grown = front.join(nxt, "at").join(reach[max_steps - 1 - step].select(F.col("n").alias("to")), "to", "left_semi")
        if not node_reuse:
            grown = grown.where(~F.array_contains("nodes", F.col("to")))
        grown = grown.select("src", F.col("to").alias("at"), F.concat("nodes", F.array("to")).alias("nodes"), (F.col("length") + F.col("d")).alias("length"), (F.col("cc") + F.col("ec")).alias("cc"), (F.col("dc") + F.col("ed")).alias("dc"))
        if max_chr_changes is not None:
            grown = grown.where(F.col("cc") <= max_chr_changes)
        if max_dir_changes is not None:
            grown = grown.where(F.col("dc") <= max_dir_changes)
        front = cut(grown, "paths")
        n = front.count()
        if total is not None and n > total:
            raise TooManyPaths(f"{n} partial paths at step {step + 1}")
        if not n:
            break
        hit = front.join(goal.select(F.col("dst").alias("at")), "at", "left_semi")
        done = hit if done is None else done.unionByName(hit)
    out = (done if done is not None else front).select("src", F.col("at").alias("dst"), "nodes", "length", "cc", "dc")
    if per_pair is not None:
        from pyspark.sql import Window

        w = Window.partitionBy("src", "dst").orderBy("length", "nodes")
        out = out.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= per_pair).drop("_k")
    return out


def limit_search(depth: int, busy: bool, attempt, enough: int):
    """Result of attempt(chr_limit, dir_limit) with the largest limits that succeed; attempt raises TooManyPaths to fail.

    Limits are (c, 1) for c up to depth, then (1, 0). The search starts at c = 2 where the graph is busy, else at depth;
    success goes up, failure goes down; it stops when a success has `enough` paths or a failure follows a success.
    """
    ladder = [(1, 0), *((c, 1) for c in range(1, depth + 1))]
    at = ladder.index((min(2, depth), 1)) if busy else len(ladder) - 1
    best, tried = None, set()
    while 0 <= at < len(ladder) and at not in tried:
        tried.add(at)
        try:
            got = attempt(*ladder[at])
        except TooManyPaths:
            if best is not None:
                break
            at -= 1
            continue
        best = (ladder[at], got)
        if got[0] >= enough:
            break
        at += 1
    return best


def accepted_paths(paths: DataFrame, composition: DataFrame, lengths: DataFrame, terminals: DataFrame, least_part: int = 50_000, least_total: int = 5_000_000) -> DataFrame:
    """path_id of paths whose make-up is plausible.

    composition: path_id, chr, bp; lengths: chr, len; terminals: path_id, chr (of its two ends, chrY as chrX). Parts
    under least_part are left out. Asked for: something is left; as many terminal ranks among the top 3 as there are
    distinct ones, or one within the top 2; the top 2 hold half; their chromosomes sum to at least the path; and a total
    of least_total.
    """
    from strandweave.operators.aggregates import composition as compose

    c = compose(composition, "path_id", "chr", "bp", least_part)
    t = terminals.distinct().join(c.select("path_id", "chr", "rank"), ["path_id", "chr"], "left")
    t = t.groupBy("path_id").agg(F.countDistinct("chr").alias("ends"), F.count(F.when(F.col("rank") <= 3, 1)).alias("in3"), F.count(F.when(F.col("rank") <= 2, 1)).alias("in2"))
    top = c.join(lengths, "chr").groupBy("path_id").agg(
        F.sum("amount").alias("total"), F.sum(F.when(F.col("rank") <= 2, F.col("share"))).alias("top_share"), F.sum(F.when(F.col("rank") <= 2, F.col("len"))).alias("top_len")
    )
    ok = (F.col("top_share") >= 0.5) & (F.col("top_len") >= F.col("total")) & (F.col("total") >= least_total)
    ends_ok = ((F.col("ends") == 2) & (F.col("in3") == 2)) | ((F.col("ends") == 1) & (F.col("in2") == 1))
    return paths.select("path_id").join(top.where(ok), "path_id").join(t.where(ends_ok), "path_id").select("path_id", "total")


def circuits_of_four(edges: DataFrame) -> DataFrame:
    """Directed circuits of four different nodes as their sorted tuple (n1 < n2 < n3 < n4), each once.

    A circuit is read from its smallest node, so no rotation is listed twice.
    """
    e = edges.select("src", "dst").where("src <> dst").distinct()
    a, b, c, d = (e.select(F.col("src").alias(f"s{k}"), F.col("dst").alias(f"d{k}")) for k in range(4))
    j = a.join(b, F.col("d0") == F.col("s1")).where("s1 > s0 and d1 > s0").join(c, F.col("d1") == F.col("s2")).where("d2 > s0 and d2 <> s1")
    j = j.join(d, (F.col("d2") == F.col("s3")) & (F.col("d3") == F.col("s0")))
    s = F.array_sort(F.array("s0", "s1", "s2", "s3"))
    return j.select(*[s[k].alias(f"n{k + 1}") for k in range(4)]).distinct()


def circuit_length(n: list[tuple[Column, Column]]) -> Column:
    """Sum over nodes (st, nd) of their span and the gap from their end to the next one's start, in order, around."""
    total = F.lit(0)
    for (st, nd), (nst, _) in zip(n, n[1:] + n[:1], strict=True):
        total = total + F.abs(nd - st) + F.abs(nd - nst)
    return total


def shortest_distances(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(src, dst, dist) of pairs that are connected: relaxation from all their sources at once.

    edges: src, dst, dist >= 0. Each round is written to the shared folder; it ends when no distance falls, after as many
    rounds as the longest of the shortest paths has steps.
    """
    e = cut(edges.groupBy("src", "dst").agg(F.min("dist").alias("dist")), "edges")
    best = cut(pairs.select("src").distinct().select("src", F.col("src").alias("at"), F.lit(0.0).alias("d")), "best")
    front = best
    while True:
        step = front.join(e.select(F.col("src").alias("at"), F.col("dst").alias("to"), "dist"), "at").groupBy("src", F.col("to").alias("at")).agg(F.min(F.col("d") + F.col("dist")).alias("n"))
        better = step.join(best, ["src", "at"], "left").where("d is null or n < d").select("src", "at", F.col("n").alias("d"))
        front = cut(better, "front")
        if not front.limit(1).count():
            break
        best = cut(best.unionByName(front).groupBy("src", "at").agg(F.min("d").alias("d")), "best")
    return pairs.join(best.select("src", F.col("at").alias("dst"), F.col("d").alias("dist")), ["src", "dst"])


def extreme_edges(edges: DataFrame) -> DataFrame:
    """Edges of each contig pair (contig_a, contig_b) that touch the smallest or largest node of either side."""
    g = edges.groupBy("contig_a", "contig_b").agg(F.min("src").alias("_s0"), F.max("src").alias("_s1"), F.min("dst").alias("_d0"), F.max("dst").alias("_d1"))
    return edges.join(g, ["contig_a", "contig_b"]).where("src in (_s0, _s1) or dst in (_d0, _d1)").select(edges.columns)


def nearest_neighbours(links: DataFrame, by: list[str], distance: str, node: str) -> DataFrame:
    """Of links that don't overlap the nearest one for each direction and node; all that overlap."""
    over = links.where(F.col(distance) == 0)
    near = links.where(F.col(distance) > 0).groupBy(*by, node).agg(F.min_by(F.struct(*links.columns), F.struct(distance, *[c for c in links.columns if c not in (distance,)])).alias("_b"))
    return over.unionByName(near.select("_b.*"))


def path_steps(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """Steps of each path (path_id, nodes) with the columns of their node, and those of the step before as prev_."""
    from pyspark.sql import Window

    s = paths.select("path_id", F.posexplode("nodes").alias("step", "node")).join(nodes, "node")
    w = Window.partitionBy("path_id").orderBy("step")
    for c in nodes.columns:
        s = s.withColumn(f"prev_{c}", F.lag(c).over(w))
    return s


def step_keys(paths: DataFrame) -> DataFrame:
    """Typed keys of each path: TEL for its ends, BND between neighbours, CTG_IN for neighbours of one contig."""
    from pyspark.sql import Window

    s = paths.select("path_id", F.posexplode("nodes").alias("step", "n"))
    w = Window.partitionBy("path_id").orderBy("step")
    s = s.withColumn("p", F.lag("n").over(w)).withColumn("last", F.lead("n").over(w).isNull())
    kind = F.when(F.col("n.contig") == F.col("p.contig"), "CTG_IN").otherwise("BND")
    keys = F.array_compact(
        F.array(
            F.when(F.col("p").isNull() | F.col("last"), F.struct(F.lit("TEL").alias("kind"), F.col("n.node").alias("a"), F.lit(None).cast("bigint").alias("b"))),
            F.when(F.col("p").isNotNull(), F.struct(kind.alias("kind"), F.least("p.node", "n.node").alias("a"), F.greatest("p.node", "n.node").alias("b"))),
        )
    )
    return s.select("path_id", "step", F.explode(keys).alias("k")).select("path_id", "step", "k.*")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of the ends of edges, those of self-edges too: the smallest id that each reaches."""
    ends = edges.select(F.col(a).alias("id")).unionByName(edges.select(F.col(b).alias("id"))).where("id is not null").distinct()
    return ends.join(connected_components(edges, a, b), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def recursive_paths_sql(spark: SparkSession, edges_view: str, max_steps: int) -> DataFrame:
    """Simple paths of at most max_steps steps by a recursive query; for graphs within its row limit."""
    return spark.sql(
        f"""WITH RECURSIVE p(src, dst, nodes, steps) AS (
        SELECT src, dst, array(src, dst), 1 FROM {edges_view} WHERE src <> dst UNION ALL
        SELECT p.src, e.dst, concat(p.nodes, array(e.dst)), p.steps + 1 FROM p JOIN {edges_view} e ON p.dst = e.src
        WHERE p.steps < {int(max_steps)} AND NOT array_contains(p.nodes, e.dst)) SELECT src, dst, nodes, steps FROM p"""
    )
