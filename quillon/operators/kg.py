"""A relationship graph over an edge table, its query algebra, and set enrichment."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.scalar import hypergeometric_p
from quillon.operators.robust import back
from quillon.operators.store import stored


def aggregate_edges(edges: DataFrame) -> DataFrame:
    """Evidence summed per (source, target, relationship)."""
    return edges.groupBy("source", "target", "relationship").agg(F.sum("evidence_count").alias("evidence_count"))


def regulation_type(statement: F.Column | str, activating: list[str], repressing: list[str]):
    """activation, repression, or other: no statement is discarded for its type."""
    c = F.col(statement) if isinstance(statement, str) else statement
    return F.when(c.isin(activating), "activation").when(c.isin(repressing), "repression").otherwise("other")


@dataclass(frozen=True)
class Query:
    """A composable neighbourhood query; every step returns a new one and nothing runs before ``entities`` or ``edges``."""

    seeds: tuple[str, ...]
    direction: str = "downstream"
    relationships: tuple[str, ...] | None = None
    min_evidence: int = 0
    min_confidence: float = 0.0
    universe: DataFrame | None = field(default=None, compare=False)
    operations: tuple = ()

    def relationship(self, *kinds: str) -> Query:
        return replace(self, relationships=kinds)

    def evidence(self, n: int) -> Query:
        return replace(self, min_evidence=n)

    def confidence(self, x: float) -> Query:
        return replace(self, min_confidence=x)

    def within(self, universe: DataFrame) -> Query:
        return replace(self, universe=universe)

    def union(self, other: Query) -> Query:
        return replace(self, operations=(*self.operations, ("union", other)))

    def intersection(self, other: Query) -> Query:
        return replace(self, operations=(*self.operations, ("intersect", other)))

    def difference(self, other: Query) -> Query:
        return replace(self, operations=(*self.operations, ("subtract", other)))

    def _own_edges(self, edges: DataFrame) -> DataFrame:
        s, t = F.col("source").isin(*self.seeds), F.col("target").isin(*self.seeds)
        e = edges.filter({"downstream": s, "upstream": t, "bidirectional": s | t}[self.direction]).filter(F.col("evidence_count") >= self.min_evidence)
        if self.relationships is not None:
            e = e.filter(F.col("relationship").isin(*self.relationships))
        return e.filter(F.coalesce(F.col("confidence"), F.lit(1.0)) >= self.min_confidence) if "confidence" in edges.columns else e

    def _own(self, edges: DataFrame) -> DataFrame:
        e = self._own_edges(edges)
        down, up = e.filter(F.col("source").isin(*self.seeds)).select(F.col("target").alias("entity")), e.filter(F.col("target").isin(*self.seeds)).select(F.col("source").alias("entity"))
        return {"downstream": down, "upstream": up, "bidirectional": down.union(up)}[self.direction].distinct()

    def entities(self, edges: DataFrame) -> DataFrame:
        """entity; nested operations and universes of other queries are honoured, the universe comes last."""
        out = self._own(edges)
        for kind, other in self.operations:
            o = other.entities(edges)
            out = {"union": lambda a, b: a.union(b).distinct(), "intersect": DataFrame.intersect, "subtract": DataFrame.subtract}[kind](out, o)
        return out if self.universe is None else out.join(self.universe.select(F.col("feature_id").alias("entity")), "entity", "left_semi")

    def edges(self, edges: DataFrame) -> DataFrame:
        """The edges: all of both sides for a union or intersection; a difference drops edges by target."""
        out = self._own_edges(edges)
        for kind, other in self.operations:
            if kind == "subtract":
                out = out.join(other.entities(edges).withColumnRenamed("entity", "target"), "target", "left_anti").select(*out.columns)
            else:
                out = out.unionByName(other.edges(edges)).dropDuplicates(["source", "target", "relationship"])
        return out if self.universe is None else out.join(self.universe.select(F.col("feature_id").alias("target")), "target", "left_semi").select(*out.columns)


def targets_of(*regulators: str) -> Query:
    return Query(regulators, "downstream")


def regulators_of(*targets: str) -> Query:
    return Query(targets, "upstream")


def by_relationship(edges: DataFrame) -> DataFrame:
    """relationship, entities (sources and targets), n_edges."""
    e = edges.select("relationship", F.explode(F.array("source", "target")).alias("entity"))
    n = edges.groupBy("relationship").agg(F.count("*").alias("n_edges"))
    return e.groupBy("relationship").agg(F.array_sort(F.collect_set("entity")).alias("entities")).join(n, "relationship")


def modules(edges: DataFrame, universe: DataFrame | None = None, min_targets: int = 10, max_targets: int | None = None, min_evidence: int = 2, max_regulators: int | None = None) -> DataFrame:
    """source, n_targets, n_activated, n_repressed of regulators with enough distinct targets in the universe."""
    e = edges.filter(F.col("evidence_count") >= min_evidence)
    if universe is not None:
        e = e.join(universe.select(F.col("feature_id").alias("target")).distinct(), "target", "left_semi")
    # a row a pair first: distinct counts side by side would repeat every edge for each of them
    pairs = e.filter("target is not null").groupBy("source", "target").agg(*(F.max((F.col("relationship") == k).cast("int")).alias(k) for k in ("activation", "repression")))
    total = lambda k: F.coalesce(F.sum(k), F.lit(0)).cast("long")
    m = pairs.groupBy("source").agg(F.count("*").alias("n_targets"), total("activation").alias("n_activated"), total("repression").alias("n_repressed")).filter(F.col("n_targets") >= min_targets)
    m = m if max_targets is None else m.filter(F.col("n_targets") <= max_targets)
    direction = F.when(F.col("n_activated") > F.col("n_repressed"), "activating").when(F.col("n_repressed") > F.col("n_activated"), "repressing").otherwise("mixed")
    m = m.withColumn("direction", direction)
    return m if max_regulators is None else m.orderBy(F.col("n_targets").desc(), "source").limit(max_regulators)


def module_sets(edges: DataFrame, found: DataFrame, min_evidence: int = 2) -> DataFrame:
    return edges.filter(F.col("evidence_count") >= min_evidence).join(found.select("source"), "source", "left_semi").select(F.col("source").alias("set_id"), F.col("target").alias("feature_id")).distinct()


def enrichment(study: DataFrame, annotations: DataFrame, background: DataFrame | None = None) -> DataFrame:
    """term, study_count, pathway_size, study_size, background_size, expected, ratio, odds_ratio, p of a study set (feature_id).

    Study and terms are taken within the background (all annotated features by default)."""
    bg = (annotations if background is None else background).select("feature_id").distinct()
    a = annotations.select("term", "feature_id").distinct().join(bg, "feature_id", "left_semi")
    s = study.select("feature_id").distinct().join(bg, "feature_id", "left_semi").withColumn("_in", F.lit(1))
    sizes = bg.agg(F.count("*").alias("background_size")).crossJoin(s.agg(F.count("*").alias("study_size")))
    g = back(a.join(s, "feature_id", "left").groupBy("term").agg(F.count("_in").alias("study_count"), F.count("*").alias("pathway_size")), sizes, [])
    k, m, n, total = (F.col(c) for c in ("study_count", "pathway_size", "study_size", "background_size"))
    b, c, d = n - k, m - k, total - m - (n - k)
    odds = F.when((b > 0) & (c > 0), k * d / (b * c)).when(k > 0, F.lit(float("inf"))).otherwise(0.0)
    g = g.withColumn("expected", n * m / total).withColumn("ratio", F.coalesce(F.try_divide(k, n * m / total), F.lit(0.0))).withColumn("odds_ratio", odds)
    return g.withColumn("p", F.when((n == 0) | (m == 0), 1.0).otherwise(hypergeometric_p(k, total, m, n)))


def _numbered(ids: DataFrame) -> DataFrame:
    """id, code (int): distinct ids numbered within parts of some thousands, so that no window spans them all."""
    ids = stored(ids.distinct(), "ids")
    parts = max(1, -(-ids.count() // 4096))
    part = F.pmod(F.xxhash64("id"), F.lit(parts))
    at = F.row_number().over(Window.partitionBy("_part").orderBy("id")) - 1
    return stored(ids.withColumn("_part", part).select("id", (at * parts + F.col("_part")).cast("int").alias("code")), "codes")


def _holders(sets: DataFrame, codes: DataFrame) -> DataFrame:
    """member, codes: the sorted codes of the sets that hold it."""
    return stored(sets.join(codes, "id").groupBy("member").agg(F.array_sort(F.collect_set("code")).alias("codes")), "holders")


def _set_sizes(holders: DataFrame, name: str) -> DataFrame:
    return holders.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias(name))


def jaccard_matches(a: DataFrame, b: DataFrame, least: float = 0.3) -> DataFrame:
    """id_a, id_b, jaccard of sets (id, member) that share members.

    A set goes, once a member, with the list of sets that hold this member too; pairs are made and counted where all rows
    of their first set are, so that lists of numbers are shuffled and no pairs. If both sides are the same
    DataFrame, a pair is counted once and given in both orders."""
    same = a is b
    sides = [x.select("id", "member").filter("id is not null and member is not null") for x in ((a,) if same else (a, b))]
    codes = [_numbered(x.select("id")) for x in sides]
    held = [_holders(x, c) for x, c in zip(sides, codes)]
    if same:
        later = held[0].select("codes", F.posexplode("codes").alias("at", "x")).filter(F.col("at") + 1 < F.size("codes"))
        lists = later.select("x", F.slice("codes", F.col("at") + 2, F.size("codes")).alias("ys"))
    else:
        lists = held[0].select("member", F.explode("codes").alias("x")).join(held[1].withColumnRenamed("codes", "ys"), "member").select("x", "ys")
    na, nb = (stored(_set_sizes(h, n), "sizes").withColumnRenamed("code", c) for h, n, c in ((held[0], "na", "x"), (held[-1], "nb", "y")))
    both = lists.repartition("x").select("x", F.explode("ys").alias("y")).groupBy("x", "y").agg(F.count("*").alias("shared"))
    # the first size alone drops most pairs before they are moved for the second
    j = both.join(na, "x").filter(F.col("shared") / F.col("na") >= least).join(nb, "y")
    j = j.select("x", "y", (F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("jaccard")).filter(F.col("jaccard") >= least)
    if same:
        j = j.select(F.explode(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))).alias("p"), "jaccard").select("p.*", "jaccard")
        j = j.unionByName(na.select("x", F.col("x").alias("y"), F.lit(1.0).alias("jaccard")).filter(F.lit(1.0) >= least))
    name = lambda c, x: c.select(F.col("id").alias(f"id_{x}"), F.col("code").alias("x" if x == "a" else "y"))
    return j.join(name(codes[0], "a"), "x").join(name(codes[-1], "b"), "y").select("id_a", "id_b", "jaccard")


def features_of_classes(members: DataFrame, classes: list[str]) -> DataFrame:
    """feature_id of a table of regulator classes (class, feature_id): the union of the named ones; an unknown name is an error."""
    known = {r["class"] for r in members.select("class").distinct().filter(F.col("class").isin(classes)).collect()}  # the asked ones at most
    if unknown := sorted(set(classes) - known):
        raise ValueError(f"unknown classes: {', '.join(unknown)}")
    return members.filter(F.col("class").isin(classes)).select("feature_id").distinct()
