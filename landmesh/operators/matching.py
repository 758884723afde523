"""From candidates to one-to-one matches, conflicts and golden records."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from landmesh.functions import scoring as sc
from landmesh.sources.scratch import dropped, written


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where that is unset, a session on one machine gets a temporary folder; on a cluster that is an
    error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the cluster's shared folder and read again, so that its lineage ends there."""
    return written(df, f"{shared_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new put over those of equal keys; the last of equal new rows can't be told, so keys of new must be unique."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    last = Window.partitionBy(*keys).orderBy(F.desc("__new"))
    return both.withColumn("__n", F.row_number().over(last)).filter("__n = 1").drop("__n", "__new")


def unordered(df: DataFrame, a: str = "a_id", b: str = "b_id") -> DataFrame:
    return df.withColumn("__low", F.least(a, b)).withColumn("__high", F.greatest(a, b))


def without_rejected(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """pairs without those that an officer rejected, in either order."""
    rejected = unordered(labels.filter("not label")).select("__low", "__high").distinct()
    return unordered(pairs).join(rejected, ["__low", "__high"], "left_anti").drop("__low", "__high")


def with_locked(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """pairs with `locked`, whether an officer confirmed them."""
    confirmed = unordered(labels.filter("label")).select("__low", "__high", F.lit(True).alias("locked")).distinct()
    return unordered(pairs).join(confirmed, ["__low", "__high"], "left").withColumn("locked", F.coalesce("locked", F.lit(False))).drop("__low", "__high")


def one_to_one(edges: DataFrame) -> DataFrame:
    """Greedy best-first selection: a feature keeps at most one partner of each other source.

    edges: a_id, b_id, a_source, b_source, match_score, locked. In the strict order locked first,
    score descending, ids, an edge is in the greedy result if none of the better ones that share an
    end of the same sources is. Each pass takes the edges that are best at both ends and drops
    their neighbours, in one written table. Where that settles less than half of the edges, as with
    long chains of rising scores, the next pass follows pointers along the chains.
    """
    turn = F.col("a_source") > F.col("b_source")  # so that the features of a source stand on one side
    side = lambda p, q, c: F.when(turn, F.col(f"{q}_{c}")).otherwise(F.col(f"{p}_{c}")).alias(f"__{p}_{c}")
    spark, folder = edges.sparkSession, f"{shared_root(edges.sparkSession)}/pairs-{uuid.uuid4().hex}"
    # Written first, so that the shuffle files of what makes the edges are gone before theirs come.
    left = written(edges.select("match_score", F.coalesce("locked", F.lit(False)).alias("locked"), side("a", "b", "id"), side("b", "a", "id"), side("a", "b", "source"), side("b", "a", "source"), F.coalesce(turn, F.lit(False)).alias("__turn")), folder)
    kept, n = None, None
    while True:
        state = _best_at_both(left)
        dropped(spark, [folder])
        count = state.groupBy("__taken").count().collect()
        now, left = state.filter("__taken").drop("__taken"), state.filter("not __taken").drop("__taken")
        open_ = sum(r["count"] for r in count if not r["__taken"])
        kept = now if kept is None else kept.unionByName(now)
        if open_ and n is not None and 2 * open_ > n:
            now, left = _along_chains(left)
            kept = kept.unionByName(now)
            open_ = left.count()
        if not open_:
            return kept.select(*(_given(p, c).alias(f"{p}_{c}") for c in ("id", "source") for p in "ab"), "match_score", "locked")
        n = open_


#: Ends of the edges, and what names them and the better one, within one_to_one.
_ENDS = [["__a_id", "__b_source"], ["__b_id", "__a_source"]]
_OWN, _TO = ["__a_id", "__b_id"], ["to_a", "to_b"]


def _given(p: str, c: str):
    """A column of an edge as it was given, before its sides were turned."""
    return F.when(F.col("__turn"), F.col(f"__{'b' if p == 'a' else 'a'}_{c}")).otherwise(F.col(f"__{p}_{c}"))


def _at_end(i: int):
    """The edges at an end, best first; equal rows stand in one order at both ends."""
    return Window.partitionBy(*_ENDS[i]).orderBy(F.desc("locked"), F.desc_nulls_last("match_score"), _given("a", "id"), _given("b", "id"), *["__rank0"][:i])


def _best_at_both(left: DataFrame) -> DataFrame:
    """The edges that are best at both ends (`__taken`), and those that share no end with them."""
    first = left
    for i in range(2):
        first = first.withColumn(f"__rank{i}", F.row_number().over(_at_end(i)))
    first = first.withColumn("__taken", (F.col("__rank0") == 1) & (F.col("__rank1") == 1)).drop("__rank0", "__rank1")
    for i in (1, 0):
        first = first.withColumn(f"__gone{i}", F.max("__taken").over(Window.partitionBy(*_ENDS[i])))
    return stored(first.filter("__taken or not (__gone0 or __gone1)").drop("__gone0", "__gone1"), "edges")


def _along_chains(left: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges taken, and edges left over.

    An edge with a single better one has the opposite fate of that: a chain of them is read by
    pointers that double their reach, in as many rounds as its length has binary digits. Edges with
    several better ones that share no end with a taken edge are left.
    """
    ranked = left
    for i in range(2):
        at = _at_end(i)
        ranked = ranked.withColumn(f"__up{i}", F.lag(F.struct(*_OWN)).over(at)).withColumn(f"__rank{i}", F.row_number().over(at) - 1)
    better, up = F.col("__rank0") + F.col("__rank1"), F.coalesce("__up0", "__up1")
    state = stored(ranked.select(*left.columns, F.least(better, F.lit(2)).alias("__better"), up["__a_id"].alias("to_a"), up["__b_id"].alias("to_b")), "edges")
    heads = state.filter("__better = 0").drop(*_TO)
    links = _followed(state.filter("__better = 1").select(*_OWN, *_TO, F.lit(True).alias("odd")), _OWN, _TO)
    ends_at_head = links.filter("not odd").join(heads.select(*(F.col(c).alias(t) for c, t in zip(_OWN, _TO, strict=True))), _TO, "left_semi")
    taken = heads.unionByName(state.filter("__better = 1").drop(*_TO).join(ends_at_head.select(*_OWN), _OWN, "left_semi"))
    now = stored(taken.drop("__better"), "taken")
    rest = state.filter("__better > 0").drop("__better", *_TO)
    for end in _ENDS:
        rest = rest.join(now.select(*end).distinct(), end, "left_anti")
    return now, stored(rest, "edges")


def _followed(links: DataFrame, own: list[str], to: list[str]) -> DataFrame:
    """Pointers with the end of their chain as `to`, and whether it is an odd number of steps away."""
    while True:
        # A copy under other names, as both sides are the same table.
        on = links.select(*(F.col(c).alias(t) for c, t in zip(own, to, strict=True)), *(F.col(t).alias(f"next_{t}") for t in to), F.col("odd").alias("next_odd"))
        far = links.join(on, to, "left")
        links = stored(far.select(*own, *(F.coalesce(f"next_{t}", t).alias(t) for t in to), F.when(F.col("next_odd").isNull(), F.col("odd")).otherwise(F.col("odd") != F.col("next_odd")).alias("odd"), F.col("next_odd").isNotNull().alias("moved")), "links")
        if links.filter("moved").isEmpty():
            return links.drop("moved")
        links = links.drop("moved")


def components(edges: DataFrame, a: str = "a_id", b: str = "b_id") -> DataFrame:
    """node and cluster (smallest node reachable), by alternating large and small stars."""
    spark, folders = edges.sparkSession, []

    def put(df: DataFrame) -> DataFrame:
        folders.append(f"{shared_root(spark)}/stars-{uuid.uuid4().hex}")
        return written(df, folders[-1])

    tree = put(edges.select(F.greatest(a, b).alias("node"), F.least(a, b).alias("to")).filter("node > to").distinct())
    before = None
    while True:
        both = tree.unionByName(tree.select(F.col("to").alias("node"), F.col("node").alias("to")))
        least = both.groupBy("node").agg(F.min("to").alias("m")).select("node", F.least("node", "m").alias("m"))
        large = both.filter("to > node").join(least, "node").select(F.col("to").alias("node"), F.col("m").alias("to")).distinct()
        small = large.join(large.groupBy("node").agg(F.min("to").alias("m")), "node")
        small = small.select(F.when(F.col("to") != F.col("m"), F.col("to")).otherwise(F.col("node")).alias("node"), F.col("m").alias("to"))
        tree = put(small.filter("node > to").distinct())
        dropped(spark, [folders.pop(0)])  # nothing reads the round before
        now = tree.agg(F.count("*").alias("n"), F.sum(F.xxhash64("node", "to").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            return tree.select("node", F.col("to").alias("cluster")).unionByName(tree.select(F.col("to").alias("node"), F.col("to").alias("cluster")).distinct())
        before = now


def rename_keys(properties, renames):
    """A bag with the keys that `renames` (a map) names replaced; the last of clashing keys stays."""
    entries = F.transform(F.map_entries(properties), lambda e: F.struct(F.coalesce(F.try_element_at(renames, e["key"]), e["key"]).alias("key"), e["value"].alias("value")))
    one = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(one)


def attribute_scores(pairs: DataFrame, keys: list[str], keep: bool = False) -> DataFrame:
    """pairs with attr_score, the mean similarity over shared keys, and n_shared.

    pairs: the key columns, a_properties and b_properties. Keys that begin with _ and bookkeeping
    keys don't count; without shared keys the score is 0.5. With keep the scores are written before
    they are joined, so that less is on disk at a time.
    """
    shared = F.filter(F.array_intersect(F.map_keys("a_properties"), F.map_keys("b_properties")), lambda k: ~k.startswith("_") & ~F.lower(k).isin(sc.IGNORED_KEYS))
    cells = pairs.select(*keys, F.explode(shared).alias("key"), "a_properties", "b_properties").select(*keys, F.col("a_properties")[F.col("key")].alias("a"), F.col("b_properties")[F.col("key")].alias("b"))
    done = cells.withColumn("simple", sc.simple_similarity("a", "b"))
    x, y = (F.lower(F.trim(F.col(c))) for c in ("a", "b"))
    # Texts are compared once for each distinct pair.
    texts = done.filter("simple is null").select(x.alias("x"), y.alias("y")).distinct().withColumn("ratio", sc.sequence_ratio("x", "y"))
    scored = done.withColumn("x", F.when(F.col("simple").isNull(), x)).withColumn("y", F.when(F.col("simple").isNull(), y)).join(texts, ["x", "y"], "left")
    mean = scored.groupBy(*keys).agg(F.avg(F.coalesce("simple", "ratio")).alias("attr_score"), F.count("*").alias("n_shared"))
    mean = stored(mean, "means") if keep else mean
    return pairs.join(mean, keys, "left").withColumns({"attr_score": F.coalesce("attr_score", F.lit(0.5)), "n_shared": F.coalesce("n_shared", F.lit(0))})


def disagreeing(a: str = "a_properties", b: str = "b_properties"):
    """Shared keys whose trimmed lower-case texts differ, and all shared keys; raw keys count."""
    shared = F.array_intersect(F.map_keys(a), F.map_keys(b))
    text = lambda bag, k: F.lower(F.trim(F.coalesce(F.col(bag)[k], F.lit("None"))))
    return F.array_sort(F.filter(shared, lambda k: text(a, k) != text(b, k))), shared


def conflicts(matches: DataFrame, features: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Conflicts of matches that have none yet.

    matches: a_id, b_id, ward, iou, match_score; features: feature_id, properties.
    """
    new = matches if known is None else matches.join(known.select("a_id", "b_id"), ["a_id", "b_id"], "left_anti")
    bag = lambda p: features.select(F.col("feature_id").alias(f"{p}_id"), F.col("properties").alias(f"{p}_properties"))
    rows = new.join(bag("a"), "a_id").join(bag("b"), "b_id")
    fields, shared = disagreeing()
    rows = rows.withColumn("fields", fields).withColumn("n_shared", F.size(shared))
    rows = rows.withColumn("conflict_type", sc.conflict_type(F.size("fields"), "iou")).filter("conflict_type is not null")
    share = F.size("fields") / F.greatest(F.col("n_shared"), F.lit(1))
    # The suggestion's sentence is a fixed value.
    return rows.select(
        "a_id", "b_id", "ward", "conflict_type", sc.severity("match_score", share, "iou").alias("severity"), "fields", "iou",
        F.concat(F.lit("Reconcile "), F.when(F.size("fields") > 0, F.array_join("fields", ", ")).otherwise("geometry"), F.lit("; trust the higher-reliability source.")).alias("suggestion"),
        F.lit("open").alias("status"),
    )


def golden_records(matches: DataFrame, features: DataFrame, found: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """One record for each cluster of matched features that has a polygon.

    Field by field the most reliable source wins (ties: type, then id), blanks are skipped; the
    geometry is that of the most reliable polygon, its box in `geom` and, where features have a
    `geom`, its shape in `geom.shape`; confidence is the mean match score, conflict_count
    all conflicts of the cluster's matches that are not resolved. nodes: components of the matches,
    where they are known. Features without `properties` give no attributes and no provenance.
    """
    nodes = components(matches) if nodes is None else nodes
    members = features.join(nodes.withColumnRenamed("node", "feature_id"), "feature_id").withColumn("rel", sc.reliability("source_type"))
    used = ["cluster", "ward", "is_polygon", "rel", "source_type", "feature_id", "x0", "y0", "x1", "y1", "geom", "properties"]
    members = stored(members.select(*(c for c in used if c in members.columns)), "members")
    shape = [F.col("geom").alias("shape")] if "geom" in features.columns else []
    base = members.groupBy("cluster").agg(
        F.first("ward").alias("ward"),
        F.count("*").alias("n_members"),
        F.min(F.when(F.col("is_polygon"), F.struct((-F.col("rel")).alias("r"), "source_type", "feature_id", "x0", "y0", "x1", "y1", *shape))).alias("geom"),
    ).filter("geom is not null")
    of_match = matches.join(nodes.withColumnRenamed("node", "a_id"), "a_id")
    # Few columns, written so that the shuffle files of the properties that they come from are gone.
    bad = stored(found.filter(F.col("status") != "resolved").groupBy("a_id", "b_id").agg(F.count("*").alias("c")), "bad")
    scores = of_match.join(bad, ["a_id", "b_id"], "left").groupBy("cluster").agg(F.bround(F.avg("match_score") / 100, 4).alias("confidence"), F.coalesce(F.sum("c"), F.lit(0)).alias("conflict_count"))
    scores = stored(scores, "scores")
    if "properties" not in features.columns:
        return base.join(scores, "cluster")
    cells = members.select("cluster", "rel", "source_type", "feature_id", F.explode("properties").alias("key", "value")).filter("trim(value) <> ''")
    first = Window.partitionBy("cluster", "key").orderBy(F.desc("rel"), "source_type", "feature_id")
    best = cells.withColumn("n", F.row_number().over(first)).filter("n = 1")
    bags = best.groupBy("cluster").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("attributes"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", F.col("source_type").alias("value"))))).alias("provenance"),
    )
    return base.join(bags, "cluster", "left").join(scores, "cluster")


def with_open_issues(golden: DataFrame, nodes: DataFrame, issues: DataFrame) -> DataFrame:
    """golden with the number of open topology issues that touch any member."""
    touched = issues.filter("status = 'open'").select("issue_id", F.explode("feature_ids").alias("node")).join(nodes, "node").groupBy("cluster").agg(F.countDistinct("issue_id").alias("topology_open"))
    return golden.join(touched, "cluster", "left").withColumn("topology_open", F.coalesce("topology_open", F.lit(0)))


def readiness_summary(golden: DataFrame) -> DataFrame:
    """Counts of the classes by ward, and over all wards (ward null)."""
    rows = golden.withColumn("readiness", sc.readiness("confidence", "conflict_count", "topology_open"))
    is_ = lambda k: F.count_if(F.col("readiness") == k).alias(k)
    out = rows.rollup("ward").agg(F.count("*").alias("total"), *map(is_, ("ready", "blocked_conflict", "blocked_topology", "low_confidence")))
    return out.withColumn("ready_pct", F.round(F.lit(1000.0) * F.col("ready") / F.col("total")) / 10)
