"""Typed property-graph operators: nodes(key, type, ...), edges(src, dst, type, weight, ...). Edges may have an edge_id and string properties (map column props).

Expansions run level by level in a driver loop. Edges are read and cut to the columns that are walked once; each level is one join of the frontier with them, in which the frontier is broadcast
while its count is within MAX_FRONTIER, so that the edges stay where they are, and dealt by key beyond. Only frontiers and visited nodes are written between levels. All of them take many
seeds at once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.session import freed, settled

UNKNOWN = "unknown"
#: Rows of a frontier up to which it is broadcast; longer ones are joined by shuffle.
MAX_FRONTIER = 200_000
#: Bits of a sieve, of 64 to a row; its broadcast is never longer.
SIEVE = 1 << 26


def directed(edges: DataFrame, direction: str = "OUT") -> DataFrame:
    """(src, dst, type, weight) as walked in a direction: OUT, IN or BOTH."""
    out = edges.select("src", "dst", "type", "weight")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type", "weight")
    kinds = {"OUT": lambda: out, "IN": lambda: back, "BOTH": lambda: out.unionByName(back)}
    if direction.upper() not in kinds:
        raise ValueError(f"direction is one of {sorted(kinds)}")
    return kinds[direction.upper()]()


def _of_types(edges: DataFrame, types: Sequence[str] | None) -> DataFrame:
    return edges if types is None else edges.where(F.col("type").isin(*types))


# -- changes --------------------------------------------------------------------------------------------------------------------


def add_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """nodes with those of new whose key isn't taken; of equal new keys the least row stays."""
    rest = [c for c in nodes.columns if c != "key"]
    # Maps have no order; their sorted entries do.
    order = F.struct(*(F.array_sort(F.map_entries(c)).alias(c) if isinstance(nodes.schema[c].dataType, T.MapType) else F.col(c) for c in rest))
    fresh = new.join(nodes.select("key"), "key", "left_anti").groupBy("key").agg(F.min_by(F.struct(*rest), order).alias("r")).select("key", "r.*")
    return nodes.unionByName(fresh.select(*nodes.columns))


def upsert_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """Create or keep: a node keeps its type; string properties (map column props) are merged, new values winning. Of several new rows of a key the first gives the type and the last a property:
    by column seq if there is one, then by type and properties."""
    seq = F.col("seq").cast("long") if "seq" in new.columns else F.lit(0).cast("long")
    both = nodes.select("key", "type", "props", F.lit(-1).cast("long").alias("late"), F.lit(0).cast("long").alias("seq")).unionByName(new.select("key", "type", "props", F.lit(1).cast("long").alias("late"), seq.alias("seq")))
    said = F.struct("late", "seq", "type", F.array_sort(F.map_entries("props")).alias("e"))
    merged = both.groupBy("key").agg(F.min(said)["type"].alias("type"), F.sort_array(F.collect_list(said)).alias("all"))
    entries = F.flatten(F.transform("all", lambda x: F.coalesce(x["e"], F.array().cast("array<struct<key:string,value:string>>"))))
    return merged.select("key", "type", F.aggregate(entries, F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["key"]), F.create_map(e["key"], e["value"]))).alias("props"))


def set_property(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """Properties (key, prop, value, seq) written in order; the last write of each wins. Changes of unknown nodes are dropped."""
    last = changes.groupBy("key", "prop").agg(F.max_by("value", "seq").alias("value")).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("prop", "value"))).alias("new"))
    empty = F.create_map().cast("map<string,string>")
    old, new = F.coalesce("props", empty), F.coalesce("new", empty)
    kept = F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k))
    return nodes.join(last, "key", "left").withColumn("props", F.map_concat(kept, new)).drop("new")


def _fixed(edges: DataFrame) -> DataFrame:
    """edges, written if their ids may differ each time they are computed (as those of monotonically_increasing_id() do); new ids that go on from the largest could meet them otherwise."""
    same = edges._jdf.queryExecution().optimizedPlan().deterministic()
    return edges if same or "edge_id" not in edges.columns else settled(edges)


def numbered(new: DataFrame, edges: DataFrame) -> DataFrame:
    """new edges with the ids that they lack, on from the largest there is; spread over tasks, so ids may have gaps. Missing properties are empty."""
    if "edge_id" in edges.columns:
        least = (edges.agg(F.max("edge_id")).first()[0] or 0) + 1
        own = F.lit(least) + F.monotonically_increasing_id()
        new = new.withColumn("edge_id", F.coalesce("edge_id", own) if "edge_id" in new.columns else own)
    if "props" in edges.columns:
        none = F.create_map().cast("map<string,string>")
        new = new.withColumn("props", F.coalesce("props", none) if "props" in new.columns else none)
    return new


def add_edges(edges: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges with those of new whose ends both exist (see unknown_ends() for the others). A weight that isn't a number is 1.0; parallel edges are allowed."""
    edges = _fixed(edges)
    known = new.join(nodes.select(F.col("key").alias("src")), "src", "left_semi").join(nodes.select(F.col("key").alias("dst")), "dst", "left_semi")
    fresh = numbered(known.withColumn("weight", F.coalesce(F.expr("try_cast(weight AS double)"), F.lit(1.0))), edges)
    return edges.unionByName(fresh.select(*edges.columns))


def unknown_ends(new: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges of new that add_edges() refuses, as an end isn't a node."""
    ends = nodes.select("key")
    found = new.join(ends.withColumnRenamed("key", "src"), "src", "left_semi").join(ends.withColumnRenamed("key", "dst"), "dst", "left_semi")
    return new.exceptAll(found.select(*new.columns))


def _merged(old, new):
    """Properties with new ones, which win."""
    empty = F.create_map().cast("map<string,string>")
    old, new = F.coalesce(old, empty), F.coalesce(new, empty)
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k)), new)


def upsert_edges(nodes: DataFrame, edges: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after upserts (src, dst, type; maybe props, of which the least row's count where a link repeats): missing ends become nodes of type unknown; an edge with the same ends and
    type is kept, with its weight, and takes new properties over."""
    edges = _fixed(edges)
    ends = new.select(F.explode(F.array("src", "dst")).alias("key")).distinct().join(nodes.select("key"), "key", "left_anti")
    blank = [F.lit(UNKNOWN).alias("type") if f.name == "type" else F.lit(None).cast(f.dataType).alias(f.name) for f in nodes.schema.fields if f.name != "key"]
    link = ["src", "dst", "type"]
    said = "props" in edges.columns and "props" in new.columns
    if said:
        once = new.groupBy(*link).agg(F.min_by("props", F.to_json("props")).alias("new_props"))
    else:
        once = new.select(*link).distinct()
    fresh = once.join(edges.select(*link), link, "left_anti").withColumn("weight", F.lit(1.0))
    fresh = numbered(fresh.withColumnRenamed("new_props", "props") if said else fresh, edges)
    kept = edges
    if said:
        kept = edges.join(once, link, "left").withColumn("props", _merged(F.col("props"), F.col("new_props"))).select(*edges.columns)
    return nodes.unionByName(ends.select("key", *blank)), kept.unionByName(fresh.select(*edges.columns))


def set_edge_property(edges: DataFrame, changes: DataFrame) -> DataFrame:
    """Properties (edge_id, prop, value, seq) of edges written in order; the last write of each wins. Changes of unknown edges are dropped."""
    last = changes.groupBy("edge_id", "prop").agg(F.max_by("value", "seq").alias("value")).groupBy("edge_id").agg(F.map_from_entries(F.collect_list(F.struct("prop", "value"))).alias("new_props"))
    return edges.join(last, "edge_id", "left").withColumn("props", _merged(F.col("props"), F.col("new_props"))).select(*edges.columns)


def delete_nodes(nodes: DataFrame, edges: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the given keys, and without edges at them."""
    gone = keys.select("key").distinct()
    rest = edges.join(gone.withColumnRenamed("key", "src"), "src", "left_anti").join(gone.withColumnRenamed("key", "dst"), "dst", "left_anti")
    return nodes.join(gone, "key", "left_anti"), rest.select(*edges.columns)


def delete_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    return edges.join(ids.select("edge_id").distinct(), "edge_id", "left_anti")


INGEST = T.StructType([
    T.StructField("nodes", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("id", "node_type", "type")] + [T.StructField("metadata", T.MapType(T.StringType(), T.StringType()))]))),
    T.StructField("edges", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("from_id", "from", "to_id", "to", "edge_type", "type")] + [T.StructField("metadata", T.MapType(T.StringType(), T.StringType()))]))),
])


def ingest(nodes: DataFrame, edges: DataFrame, payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after JSON payloads (column json) in both spellings of their fields. Items without an id, type or end are skipped."""
    read = payloads.select(F.from_json("json", INGEST).alias("j"), F.get_json_object("json", "$.nodes").alias("raw_nodes"), F.get_json_object("json", "$.edges").alias("raw_edges"))

    def strings(metadata: str, raw: str):
        # Only metadata that are strings in the JSON count; from_json would turn numbers to strings, so their raw text is looked at.
        text = F.from_json(raw, "array<struct<metadata:map<string,variant>>>")
        is_text = lambda k: F.coalesce(F.schema_of_variant(F.element_at(F.get(text, F.col("i"))["metadata"], k)) == "STRING", F.lit(False))
        return F.map_filter(F.coalesce(metadata, F.create_map().cast("map<string,string>")), lambda k, _: is_text(k)).alias("props")

    found = read.select(F.posexplode("j.nodes").alias("i", "n"), "raw_nodes")
    new_nodes = found.select(F.col("n.id").alias("key"), F.coalesce("n.node_type", "n.type").alias("type"), strings("n.metadata", "raw_nodes")).where("key IS NOT NULL AND type IS NOT NULL")
    linked = read.select(F.posexplode("j.edges").alias("i", "e"), "raw_edges")
    new_edges = linked.select(F.coalesce("e.from_id", "e.from").alias("src"), F.coalesce("e.to_id", "e.to").alias("dst"), F.coalesce("e.edge_type", "e.type").alias("type"), strings("e.metadata", "raw_edges")).where("src IS NOT NULL AND dst IS NOT NULL AND type IS NOT NULL")
    return upsert_edges(upsert_nodes(nodes, new_nodes), edges, new_edges)


# -- reads ----------------------------------------------------------------------------------------------------------------------


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts of nodes and edges by type, and in all (type null)."""
    count = lambda df, what: df.groupingSets([["type"], []], "type").agg(F.count("*").alias("cnt")).select(F.lit(what).alias("what"), "type", "cnt")
    return count(nodes, "node").unionByName(count(edges, "edge"))


def list_by_type(nodes: DataFrame, kind: str, limit: int | None = None) -> DataFrame:
    found = nodes.where(F.col("type") == kind)
    return found if limit is None else found.orderBy("key").limit(limit)


def neighbors(nodes: DataFrame, edges: DataFrame, keys: DataFrame, direction: str = "OUT") -> DataFrame:
    """(seed, key, type): distinct neighbours of each seed (column key)."""
    walked = directed(edges, direction).join(keys.select(F.col("key").alias("src")), "src").select(F.col("src").alias("seed"), F.col("dst").alias("key")).distinct()
    return walked.join(nodes.select("key", "type"), "key").select("seed", "key", "type")


def _near(frontier: DataFrame) -> DataFrame:
    """A written frontier, marked for broadcast if its count is within MAX_FRONTIER."""
    return F.broadcast(frontier) if frontier.count() <= MAX_FRONTIER else frontier


def sieved(rows: DataFrame, wanted: DataFrame, on: Sequence[str]) -> DataFrame:
    """rows without most of those whose values in columns `on` aren't among wanted's; none that is among them is lost. Joins that follow shuffle what is left. wanted's hashes are the bits that are sent."""
    place = F.pmod(F.xxhash64(*on), F.lit(SIEVE))
    marks = wanted.select(place.alias("h")).groupBy(F.shiftright("h", 6).alias("__slot")).agg(F.expr("bit_or(shiftleft(1L, CAST(h & 63 AS INT)))").alias("__bits"))
    held = rows.withColumn("__place", place).withColumn("__slot", F.shiftright("__place", 6)).join(F.broadcast(marks), "__slot")
    return held.where("shiftrightunsigned(__bits, CAST(__place & 63 AS INT)) & 1 = 1").select(*rows.columns)


def traverse(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = 10, direction: str = "OUT", edge_types: Sequence[str] | None = None, node_type: str | None = None, strict_compat: bool = False, limit: int | None = None) -> DataFrame:
    """(seed, key, type, depth): breadth-first expansion of each seed (column key), every node once at its least depth.

    node_type prunes: other nodes are neither returned nor expanded; seeds are exempt. An unknown node_type matches nothing, unless
    strict_compat, which then doesn't filter. limit: the first rows by seed, depth and key; the expansion stops at the level that fills it for every seed.
    """
    if node_type is not None and strict_compat and nodes.where(F.col("type") == node_type).isEmpty():
        node_type = None
    walked = _of_types(directed(edges, direction), edge_types).select("src", "dst")
    allowed = nodes.select("key", "type")
    start = _near(settled(seeds.select("key").distinct()))
    seen = settled(allowed.join(start, "key").select(F.col("key").alias("seed"), "key", "type", F.lit(0).alias("depth")))
    if node_type is not None:
        allowed = allowed.where(F.col("type") == node_type)
    frontier = seen
    for level in range(1, depth + 1):
        reached = walked.join(_near(frontier.select("seed", F.col("key").alias("src"))), "src").select("seed", F.col("dst").alias("key")).distinct()
        new = reached.join(seen.select("seed", "key"), ["seed", "key"], "left_anti")
        frontier = settled(new.join(allowed, "key").select("seed", "key", "type", F.lit(level).alias("depth")))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if limit is not None and seen.groupBy("seed").count().where(F.col("count") < limit).isEmpty():
            break
    if limit is None:
        return seen
    return seen.withColumn("rank", F.row_number().over(Window.partitionBy("seed").orderBy("depth", "key"))).where(F.col("rank") <= limit).drop("rank")


def impact(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = 10, edge_types: Sequence[str] | None = None, node_types: Sequence[str] | None = None) -> DataFrame:
    """(seed, type, cnt) of what lies downstream, without the seed, with a row of type total. node_types filters what is counted, not what is walked."""
    found = traverse(nodes, edges, seeds, depth, "OUT", edge_types).where("depth > 0")
    if node_types is not None:
        found = found.where(F.col("type").isin(*node_types))
    return found.groupingSets([["seed", "type"], ["seed"]], "seed", "type").agg(F.count("*").alias("cnt"), F.grouping("type").alias("g")).select("seed", F.when(F.col("g") == 1, F.lit("total")).otherwise(F.col("type")).alias("type"), "cnt")


def _ways(steps: DataFrame, ends: DataFrame) -> DataFrame:
    """Paths of ends (source, target, key) back to their sources, by steps (source, key, before), written once for all rounds: (source, target, way), from the source to key."""
    way = settled(ends.select("source", "target", F.col("key").alias("at"), F.array("key").alias("way")))
    done, back = None, steps.select("source", F.col("key").alias("at"), "before")
    while not way.isEmpty():
        home = way.where("at = source").select("source", "target", "way")
        done = home if done is None else done.unionByName(home)
        rest = way.where("at <> source")
        if rest.count() <= MAX_FRONTIER:
            step = back.join(F.broadcast(rest), ["source", "at"])
        else:
            step = sieved(back, rest, ["source", "at"]).join(rest, ["source", "at"])
        way = settled(step.select("source", "target", F.col("before").alias("at"), F.concat(F.array("before"), "way").alias("way")))
    return done if done is not None else way.select("source", "target", "way")


def _outlook(walked: DataFrame, step: DataFrame, size: int) -> float:
    """About how many rows (source, key) a step of `size` rows (source, src) leads to: as many as its links, or every source with every node that they lead to."""
    sources, keys = step.agg(F.approx_count_distinct("source"), F.approx_count_distinct("src")).first()
    links, ends = sieved(walked, step, ["src"]).agg(F.count("*"), F.approx_count_distinct("dst")).first()
    return min(size * links / max(keys, 1), sources * ends)


def shortest_paths(nodes: DataFrame, edges: DataFrame, pairs: DataFrame, max_depth: int = 20) -> DataFrame:
    """(source, target, hops, path): an undirected path of fewest edges for each pair (source, target) that has one of up to max_depth; of equal ones
    the middle and then each step is the node with the least key.

    The search goes from both ends, for all pairs at once, a level at a time on the side that has less to go on from (or, where that is much, about less to come to), until the levels meet; each visited node is kept with the one before it, and
    paths are put together at the end.
    """
    walked = directed(edges, "BOTH").select("src", "dst")
    ends = settled(pairs.select("source", "target").distinct())
    asked = settled(ends.join(nodes.select(F.col("key").alias("source")), "source", "left_semi").join(nodes.select(F.col("key").alias("target")), "target", "left_semi"))
    start = lambda c: settled(asked.select(F.col(c).alias("source")).distinct().select("source", F.col("source").alias("key"), F.lit(None).cast("string").alias("before"), F.lit(0).alias("level")))
    seen, levels = [start("source"), start("target")], [0, 0]
    frontier, found, open_, side = list(seen), None, asked, 0
    while True:
        # Pairs whose sides have a node in common: a new one of the side that has grown, so the way over it is the shortest.
        own, other = ("source", "target") if side == 0 else ("target", "source")
        one = frontier[side].select(F.col("source").alias(own), "key", F.col("level").alias("a"))
        two = seen[1 - side].select(F.col("source").alias(other), "key", F.col("level").alias("b"))
        # By pairs first where an end has few partners, else by the common node; either way the other condition follows.
        reached, pairs_left = one.count(), open_.count()
        asks = one.groupBy(own).count().join(open_.groupBy(own).agg(F.count("*").alias("partners")), own).agg(F.sum(F.col("count") * F.col("partners"))).first()[0] or 0
        if asks <= 20 * (reached + pairs_left):
            both = one.join(_near(open_), own).join(two, [other, "key"])
        else:
            both = one.join(two, "key").join(open_, ["source", "target"], "left_semi")
        met = both.groupBy("source", "target").agg(F.min(F.struct((F.col("a") + F.col("b")).alias("hops"), "key")).alias("m"))
        hits = settled(met.select("source", "target", "m.hops", F.col("m.key").alias("key")))
        found = hits if found is None else found.unionByName(hits)
        open_ = settled(open_.join(hits, ["source", "target"], "left_anti"))
        if sum(levels) >= max_depth or open_.isEmpty():
            break
        # The side with fewer nodes to go on from grows; it may be the same one again. Beyond MAX_FRONTIER, that with fewer to come to.
        steps = []
        for c, rows in zip(("source", "target"), frontier, strict=True):
            still = settled(open_.select(F.col(c).alias("source")).distinct())
            steps.append(rows.join(_near(still), "source", "left_semi").select("source", F.col("key").alias("src")))
        sizes = [s.count() for s in steps]
        large = max(sizes) > MAX_FRONTIER
        grown = [_outlook(walked, s, n) for s, n in zip(steps, sizes, strict=True)] if large else sizes
        side = 0 if grown[0] <= grown[1] else 1
        step = steps[side]
        nexts = walked.join(F.broadcast(step), "src") if sizes[side] <= MAX_FRONTIER else sieved(walked, step, ["src"]).join(step, "src")
        found_next = nexts.groupBy("source", F.col("dst").alias("key")).agg(F.min("src").alias("before"))
        levels[side] += 1
        frontier[side] = settled(found_next.join(seen[side].select("source", "key"), ["source", "key"], "left_anti").select("source", "key", "before", F.lit(levels[side]).alias("level")))
        if large:
            freed(nodes.sparkSession)
        if frontier[side].isEmpty():  # all that these ends reach was seen, and the other ends weren't among it
            break
        seen[side] = seen[side].unionByName(frontier[side])
    found = settled(found)
    to = _ways(seen[0], found).select("source", "target", F.col("way").alias("first"))
    back = _ways(seen[1].withColumnRenamed("source", "target").select(F.col("target").alias("source"), "key", "before"), found.select(F.col("target").alias("source"), F.col("source").alias("target"), "key"))
    back = back.select(F.col("target").alias("source"), F.col("source").alias("target"), F.reverse("way").alias("second"))
    return found.join(to, ["source", "target"]).join(back, ["source", "target"]).select("source", "target", "hops", F.concat("first", F.slice("second", 2, 1 << 30)).alias("path"))


def distances(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, key, weight): the least total weight from each source to every node that it reaches, itself included; weights must not be negative."""
    if edges.where("weight < 0").limit(1).count():
        raise ValueError("weights must not be negative")
    walked = settled(directed(edges).groupBy("src", "dst").agg(F.min("weight").alias("weight")))
    best = frontier = settled(sources.select("source").distinct().select("source", F.col("source").alias("key"), F.lit(0.0).alias("weight")))
    while (size := frontier.count()) > 0:
        near = frontier.select("source", F.col("key").alias("src"), F.col("weight").alias("so_far"))
        step = walked.join(F.broadcast(near) if size <= MAX_FRONTIER else near, "src").groupBy("source", F.col("dst").alias("key")).agg(F.min(F.col("so_far") + F.col("weight")).alias("weight"))
        frontier = settled(step.join(best.withColumnRenamed("weight", "old"), ["source", "key"], "left").where("old IS NULL OR weight < old").select("source", "key", "weight"))
        best = settled(best.join(frontier.select("source", "key"), ["source", "key"], "left_anti").unionByName(frontier))
    return best


#: Nodes that distances are kept for.
LANDMARKS = 16


@dataclass
class DistanceCache:
    """Distances from and to a bounded number of landmarks, the nodes with most links, which bound the search for cheapest paths: no way over a landmark is better than the best.

    out, into: (landmark, key, weight) from and to each landmark; mark: what the edges were when it was built, so that a change makes it stale.
    """

    out: DataFrame
    into: DataFrame
    mark: tuple

    @staticmethod
    def marked(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("src", "dst", "weight").cast("decimal(38,0)"))).first())

    @classmethod
    def build(cls, edges: DataFrame, landmarks: int = LANDMARKS) -> DistanceCache:
        degree = edges.select(F.explode(F.array("src", "dst")).alias("source")).groupBy("source").count()
        chosen = settled(degree.orderBy(F.desc("count"), "source").limit(landmarks).select("source"))
        back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type", "weight")
        out, into = (distances(e, chosen).withColumnRenamed("source", "landmark") for e in (edges, back))
        return cls(out, into, cls.marked(edges))

    def fresh(self, edges: DataFrame) -> bool:
        return self.marked(edges) == self.mark

    def stats(self, edges: DataFrame) -> DataFrame:
        """(state, edges, landmarks, entries)."""
        both = self.out.unionByName(self.into)
        return both.agg(F.lit("fresh" if self.fresh(edges) else "stale").alias("state"), F.lit(self.mark[0]).alias("edges"), F.countDistinct("landmark").alias("landmarks"), F.count("*").alias("entries"))

    def bounds(self, asked: DataFrame) -> DataFrame:
        """(source, bound) of the sources all of whose targets are reached over some landmark: no target is farther."""
        to, on = self.into.select("landmark", F.col("key").alias("source"), F.col("weight").alias("a")), self.out.select("landmark", F.col("key").alias("target"), F.col("weight").alias("b"))
        ways = asked.join(to, "source", "left").join(on, ["landmark", "target"], "left").groupBy("source", "target").agg(F.min(F.col("a") + F.col("b")).alias("way"))
        # A way's sum may differ from the best one's in the last digits.
        return ways.groupBy("source").agg(F.when(F.count("way") == F.count("*"), F.max("way") * (1 + 1e-9) + 1e-9).alias("bound")).where("bound IS NOT NULL")


def weighted_paths(nodes: DataFrame, edges: DataFrame, pairs: DataFrame, max_rounds: int | None = None, cache: DistanceCache | None = None) -> DataFrame:
    """(source, target, weight, path): a directed path of least total weight for each pair; weights must not be negative. Rounds of relaxation, which
    drop what can't beat the target's best so far, until nothing gets better; if max_rounds are given and don't suffice, that is an error. Each node is kept with the one before it
    (of equal ways the least), and paths are put together at the end. cache: distances by way of landmarks, which bound the search from the start; a stale one is an error."""
    if cache is not None and not cache.fresh(edges):
        raise ValueError("the distance cache is stale")
    walked = directed(edges).select("src", "dst", "weight")
    if edges.where("weight < 0").limit(1).count():
        raise ValueError("weights must not be negative")
    asked = settled(pairs.select("source", "target").distinct().join(nodes.select(F.col("key").alias("source")), "source", "left_semi").join(nodes.select(F.col("key").alias("target")), "target", "left_semi"))
    best = settled(asked.select("source").distinct().select("source", F.col("source").alias("key"), F.lit(0.0).alias("weight"), F.lit(None).cast("string").alias("before")))
    wanted = settled(asked.groupBy("source").agg(F.count("*").alias("targets")))
    few = wanted.count() <= MAX_FRONTIER
    frontier, first = best, settled(cache.bounds(asked)) if cache is not None and few else None
    bound, rounds = first, 0
    while (size := frontier.count()) > 0:
        if rounds == max_rounds:
            raise ValueError(f"paths aren't settled after {max_rounds} rounds")
        rounds += 1
        near = frontier.select("source", F.col("key").alias("src"), F.col("weight").alias("so_far"))
        nexts = walked.join(F.broadcast(near), "src") if size <= MAX_FRONTIER else sieved(walked, near, ["src"]).join(near, "src")
        step = nexts.select("source", F.col("dst").alias("key"), (F.col("so_far") + F.col("weight")).alias("weight"), F.col("src").alias("before"))
        if bound is not None:
            step = step.join(F.broadcast(bound), "source", "left").where("bound IS NULL OR weight <= bound").drop("bound")
        least = step.groupBy("source", "key").agg(F.min(F.struct("weight", "before")).alias("new")).select("source", "key", "new.*")
        old = best.select("source", "key", F.col("weight").alias("old"))
        frontier = settled(least.join(old, ["source", "key"], "left").where("old IS NULL OR weight < old").drop("old"))
        best = settled(best.join(frontier.select("source", "key"), ["source", "key"], "left_anti").unionByName(frontier))
        # Beyond the farthest target known, nothing matters; sources with a target not reached yet have no bound. A row for each source.
        reached = best.join(asked.select("source", F.col("target").alias("key")), ["source", "key"]).groupBy("source").agg(F.count("*").alias("n"), F.max("weight").alias("bound"))
        if few:
            found = wanted.join(reached, "source").where("n = targets").select("source", "bound")
            bound = settled(found if first is None else found.unionByName(first).groupBy("source").agg(F.min("bound").alias("bound")))
    ends = settled(asked.join(best.select("source", F.col("key").alias("target"), "weight"), ["source", "target"]))
    ways = _ways(best, ends.select("source", "target", F.col("target").alias("key")))
    return ends.join(ways, ["source", "target"]).select("source", "target", "weight", F.col("way").alias("path"))


def paths(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, target_type: str, depth: int = 10, edge_types: Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
    """(seed, path, types): simple directed paths of up to depth edges that stop at the first node of a type; parallel edges give a path each."""
    walked = _of_types(directed(edges), edge_types).select("src", "dst")
    kinds = nodes.select(F.col("key").alias("dst"), F.col("type").alias("dst_type"))
    growing = settled(seeds.select("key").distinct().join(nodes.select("key", "type"), "key").select(F.col("key").alias("seed"), F.array("key").alias("path"), F.array("type").alias("types")))
    found = growing.limit(0)
    for _ in range(depth):
        step = growing.withColumn("src", F.element_at("path", -1)).join(walked, "src").where(~F.array_contains("path", F.col("dst"))).join(kinds, "dst")
        grown = settled(step.select("seed", F.concat("path", F.array("dst")).alias("path"), F.concat("types", F.array("dst_type")).alias("types")))
        at_target = F.element_at("types", -1) == target_type
        found = found.unionByName(grown.where(at_target))
        growing = grown.where(~at_target)
        if growing.isEmpty():
            break
    return found if limit is None else found.orderBy("seed", F.size("path"), "path").limit(limit)


def cooccur(members: DataFrame, weight: float = 1.0, window: int = 50, existing: DataFrame | None = None, increment: bool = False) -> DataFrame:
    """(src, dst, weight): links between all members (columns grp, key) of each group of 2 to `window` distinct members, from the lower key to the higher.

    A pair's weight is weight times the groups it shares. existing (src, dst, weight): pairs that are linked already get the weight added if
    increment, else stay as they are. A group has `window` members at most when it is paired, so it gives a bounded number of pairs.
    """
    once = members.select("grp", "key").distinct()
    sized = once.groupBy("grp").agg(F.count("*").alias("n")).where(F.col("n").between(2, window)).select("grp")
    inside = once.join(sized, "grp", "left_semi")
    pairs = inside.select("grp", F.col("key").alias("src")).join(inside.select("grp", F.col("key").alias("dst")), "grp").where("src < dst")
    new = pairs.groupBy("src", "dst").agg((F.count("*") * weight).alias("weight"))
    if existing is None:
        return new
    merged = existing.select("src", "dst", F.col("weight").alias("old")).join(new, ["src", "dst"], "full")
    return merged.select("src", "dst", F.when(F.col("old").isNull(), F.col("weight")).otherwise(F.col("old") + (F.coalesce("weight", F.lit(0.0)) if increment else F.lit(0.0))).alias("weight"))
