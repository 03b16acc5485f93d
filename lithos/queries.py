"""Registered queries: the engine's operators over the test tables.

A table is an archetype whose key is the entity id. Each query goes through the
engine's own API and stays one lazy frame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithos import observe
from lithos.functions.torus import wrap
from lithos.lineage import shared_folder
from lithos.operators import changes, changeset, kernels, reducers
from lithos.operators.transactions import Access, Durable, Optimistic, colour
from lithos.plans.aggregates import AggregateExpr as Agg
from lithos.plans.planner import QueryPlanner
from lithos.plans.predicates import Predicate as P
from lithos.sources import checkpoint, lsm, snapshot, wal
from lithos.world import ID, Changed, Mut, Opt, World

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

KEYS = {"customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "lineitem": "l_orderkey", "events": "event_id", "documents": "doc_id", "labels": "doc_id", "embeddings": "vec_id", "pages": "page_id", "nation": "n_nationkey", "region": "r_regionkey"}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def world(spark: SparkSession, sf_dir: str, *tables: str) -> World:
    w = World(spark)
    for t in tables:
        w.add_table(t, read(spark, sf_dir, t), KEYS[t])
    return w


def planner(spark: SparkSession, sf_dir: str, *tables: str) -> QueryPlanner:
    return QueryPlanner(world(spark, sf_dir, *tables))


def estimated(p: QueryPlanner, *terms):
    """A scan with a given estimate, so that building it runs no job."""
    return p.scan_with_estimate(1e9, *terms)


# ------------------------------------------------------------------- scans


@query
def scan_all(spark, sf_dir):
    return estimated(planner(spark, sf_dir, "orders"), "o_totalprice").build().entities()


def _accounts(spark, sf_dir) -> World:
    w = World(spark)
    w.add_table("customer", read(spark, sf_dir, "customer"), "c_custkey", {"acctbal": "c_acctbal", "mktsegment": "c_mktsegment"})
    w.add_table("supplier", read(spark, sf_dir, "supplier"), "s_suppkey", {"acctbal": "s_acctbal"})
    return w


@query
def scan_multi_archetype(spark, sf_dir):
    return _accounts(spark, sf_dir).scan(["acctbal"]).select("archetype", ID, "acctbal")


@query
def scan_optional_component(spark, sf_dir):
    return _accounts(spark, sf_dir).scan(["acctbal", Opt("mktsegment")]).select("archetype", ID, "mktsegment")


@query
def get_batch_order_dups(spark, sf_dir):
    asks = spark.sql(f"SELECT pos, {ID} FROM VALUES (0, 5L), (1, 5L), (2, -1L), (3, 1L) AS t(pos, {ID})")
    return world(spark, sf_dir, "part").get_batch(asks, "p_size").withColumnRenamed("value", "p_size")


# ----------------------------------------------------------------- filters


@query
def filter_eq(spark, sf_dir):
    return estimated(planner(spark, sf_dir, "orders"), "o_orderpriority").filter(P.eq("o_orderpriority", "1-URGENT")).build().entities()


@query
def filter_range_halfopen(spark, sf_dir):
    return estimated(planner(spark, sf_dir, "part"), "p_size").filter(P.range("p_size", 10, 20)).build().entities()


@query
def filter_range_unbounded(spark, sf_dir):
    return estimated(planner(spark, sf_dir, "part"), "p_size").filter(P.range("p_size", 40, low_open=True)).build().entities()


@query
def filter_multi_and(spark, sf_dir):
    scan = estimated(planner(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority", "o_totalprice")
    price = P.custom_column("o_totalprice", "price > 1000", 0.9, lambda c: c > 1000)
    return scan.filter(P.eq("o_orderstatus", "F")).filter(P.eq("o_orderpriority", "2-HIGH")).filter(price).build().entities()


@query
def filter_custom_column(spark, sf_dir):
    scan = estimated(planner(spark, sf_dir, "lineitem"), "l_quantity", "l_returnflag", "l_linenumber")
    scan.filter(P.custom_column("l_quantity", "2q > 60", 0.4, lambda c: c * 2 > 60)).filter(P.custom_column("l_returnflag", "not N", 0.6, lambda c: c != "N"))
    return scan.build().rows("l_linenumber").select(F.col(ID).alias("order_id"), F.col("l_linenumber").alias("line"))


@query
def filter_custom_cross_entity(spark, sf_dir):
    poor = P.semi("o_custkey", "customer in debt", 0.1, lambda w: w.scan(["c_acctbal"]).where("c_acctbal < 0"))
    return estimated(planner(spark, sf_dir, "orders", "customer"), "o_custkey").filter(poor).build().entities()


@query
def spatial_within(spark, sf_dir):
    return estimated(planner(spark, sf_dir, "embeddings"), "embedding").filter(P.within("embedding", (0.1, 0.0), 0.1)).build().entities()


@query
def spatial_intersects(spark, sf_dir):
    return estimated(planner(spark, sf_dir, "embeddings"), "embedding").filter(P.intersects("embedding", (-0.1, 0.0), (0.1, 0.2))).build().entities()


# ------------------------------------------------------------------- joins


def _documents_with_labels(spark, sf_dir) -> World:
    """Label components live in a sparse store beside the documents."""
    w = world(spark, sf_dir, "documents")
    labels = read(spark, sf_dir, "labels")
    for c in ("quality", "toxic"):
        w.insert_sparse(c, labels.select(F.col("doc_id").alias(ID), F.col(c).alias("value")))
    return w


@query
def join_inner_presence(spark, sf_dir):
    return estimated(QueryPlanner(_documents_with_labels(spark, sf_dir)), "n_chars").join("quality").build().entities()


@query
def join_left_noop(spark, sf_dir):
    return QueryPlanner(_documents_with_labels(spark, sf_dir)).scan_with_estimate(1e6, "n_chars").join("quality", kind="left").with_right_estimate(1e5).build().entities()


@query
def join_batched_columns(spark, sf_dir):
    plan = estimated(QueryPlanner(_documents_with_labels(spark, sf_dir)), "n_chars").join("quality").build()
    return plan.batched("n_chars", "quality").select(ID, "n_chars", "quality")


@query
def join_inner_filtered(spark, sf_dir):
    scan = estimated(QueryPlanner(_documents_with_labels(spark, sf_dir)), "lang").join("quality")
    return scan.filter(P.eq("quality", 1)).filter(P.eq("lang", "en")).build().entities()


def _orders_of(spark, sf_dir, condition: str) -> QueryPlanner:
    """Orders and customers; those that meet the condition carry a tag."""
    w = world(spark, sf_dir, "orders")
    customers = read(spark, sf_dir, "customer")
    w.add_table("tagged", customers.where(condition), "c_custkey", {"Tagged": F.lit(True)})
    return QueryPlanner(w)


@query
def er_inner(spark, sf_dir):
    return estimated(_orders_of(spark, sf_dir, "c_acctbal > 9000"), "o_custkey").er_join("o_custkey", "Tagged").with_right_estimate(1e9).build().entities()


@query
def er_left_noop(spark, sf_dir):
    return estimated(_orders_of(spark, sf_dir, "c_acctbal > 9000"), "o_custkey").er_join("o_custkey", "Tagged", kind="left").build().entities()


@query
def er_dead_reference(spark, sf_dir):
    return estimated(_orders_of(spark, sf_dir, "c_custkey % 10 <> 0"), "o_custkey").er_join("o_custkey", "Tagged").with_right_estimate(1e9).build().entities()


@query
def er_chained(spark, sf_dir):
    w = world(spark, sf_dir, "lineitem")
    w.add_table("solvent", read(spark, sf_dir, "supplier").where("s_acctbal > 0"), "s_suppkey", {"Solvent": F.lit(True)})
    w.add_table("small", read(spark, sf_dir, "part").where("p_size < 10"), "p_partkey", {"Small": F.lit(True)})
    scan = estimated(QueryPlanner(w), "l_suppkey", "l_partkey", "l_linenumber")
    plan = scan.er_join("l_suppkey", "Solvent").with_right_estimate(1e9).er_join("l_partkey", "Small").with_right_estimate(1e9).build()
    return plan.rows("l_linenumber", "l_suppkey").select(F.col(ID).alias("order_id"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("supp"))


@query
def er_multi_hop(spark, sf_dir):
    w = world(spark, sf_dir, "customer", "nation")
    w.add_table("near", read(spark, sf_dir, "region").where("r_regionkey < 2"), "r_regionkey", {"Near": F.lit(True)})
    p = QueryPlanner(w)
    nations = estimated(p, "n_regionkey").er_join("n_regionkey", "Near").with_right_estimate(10).build()
    there = P.semi("c_nationkey", "nation is near", 0.4, lambda _: nations.entities())
    return estimated(p, "c_nationkey").filter(there).build().entities()


# -------------------------------------------------------------- aggregates


@query
def agg_all(spark, sf_dir):
    q = "l_quantity"
    scan = estimated(planner(spark, sf_dir, "lineitem"), q)
    for a in (Agg.count(), Agg.sum(q), Agg.min(q), Agg.max(q), Agg.avg(q)):
        scan.aggregate(a)
    return scan.build().aggregate_frame("cnt", "sum_qty", "min_qty", "max_qty", "avg_qty").withColumn("avg_qty", F.round("avg_qty", 6))


@query
def agg_filtered(spark, sf_dir):
    scan = estimated(planner(spark, sf_dir, "orders"), "o_totalprice").filter(P.eq("o_orderstatus", "F")).aggregate(Agg.count()).aggregate(Agg.sum("o_totalprice"))
    return scan.build().aggregate_frame("cnt", "sum_price").withColumn("sum_price", F.round("sum_price", 2))


@query
def agg_empty(spark, sf_dir):
    none = P.custom_column("l_quantity", "q < 0", 0.0, lambda c: c < 0)
    return estimated(planner(spark, sf_dir, "lineitem"), "l_quantity").filter(none).aggregate(Agg.count()).aggregate(Agg.sum("l_quantity")).build().aggregate_frame("cnt", "sum_qty")


@query
def agg_partial_presence(spark, sf_dir):
    scan = estimated(QueryPlanner(_accounts(spark, sf_dir)), "acctbal").aggregate(Agg.count()).aggregate(Agg.sum("mktsegment", value=F.length))
    return scan.build().aggregate_frame("cnt", "sum_seg_len")


@query
def agg_er_join(spark, sf_dir):
    scan = estimated(_orders_of(spark, sf_dir, "c_acctbal > 9000"), "o_totalprice").filter(P.eq("o_orderpriority", "1-URGENT"))
    scan.er_join("o_custkey", "Tagged").with_right_estimate(1e9).aggregate(Agg.count()).aggregate(Agg.sum("o_totalprice"))
    return scan.build().aggregate_frame("cnt", "sum_price").withColumn("sum_price", F.round("sum_price", 2))


# ----------------------------------------------------------------- changes


def _since(text: str):
    return F.lit(text).cast("timestamp_ntz")


@query
def changed_archetype_granular(spark, sf_dir):
    rows = read(spark, sf_dir, "events")
    return changes.changed_archetypes(rows, "event_type", "ts", _since("2024-01-30 23:28:00")).select(F.col("event_id").alias(ID))


@query
def changed_row_granular(spark, sf_dir):
    return changes.changed_rows(read(spark, sf_dir, "events"), "ts", _since("2024-01-30 00:00:00")).select(F.col("event_id").alias(ID))


@query
def subscription_eq_changed(spark, sf_dir):
    rows = changes.changed_archetypes(read(spark, sf_dir, "events"), "event_type", "ts", _since("2024-01-15 00:00:00"))
    return rows.where(F.col("event_type") == "purchase").select(F.col("event_id").alias(ID))


@query
def debounce_hash(spark, sf_dir):
    return changes.debounce(read(spark, sf_dir, "events"), "user_id", "event_type", ["ts", "event_id"]).select(F.col("event_id").alias(ID))


# --------------------------------------------------------- logs and storage


@query
def retention_after_10(spark, sf_dir):
    return reducers.countdown(read(spark, sf_dir, "part").select(F.col("p_partkey").alias(ID), F.col("p_size").alias("remaining")), "remaining", 10)


@query
def changeset_fold(spark, sf_dir):
    log = read(spark, sf_dir, "events").select(F.col("user_id").alias(ID), F.col("event_id").alias("last_seq"), "event_type")
    return changeset.fold_last(log, ID, ["last_seq"], "event_type", "error").select(ID, "last_seq")


@query
def wal_replay_from(spark, sf_dir):
    log = read(spark, sf_dir, "events").where("event_id >= 500").select(F.col("user_id").alias(ID), F.col("event_id").alias("last_seq"), F.lit("insert").alias("op"))
    return changeset.fold_last(log, ID, ["last_seq"], "op", "despawn").select(ID, "last_seq")


@query
def lsm_compact_newest_wins(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.col("event_type").alias("archetype"), F.col("user_id").alias(ID), F.col("event_id").alias("row_id"), (F.col("event_id") % 4).alias("run"))
    return lsm.newest_wins(rows, ["archetype", ID], ["run", "row_id"]).drop("run")


@query
def blob_orphans(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("page_id", F.col("url").alias("blob_key"))
    return snapshot.orphans(pages.where("page_id % 5 = 0"), pages.where("page_id % 5 <> 0"), "blob_key")


@query
def metrics_archetypes(spark, sf_dir):
    return world(spark, sf_dir, "customer", "supplier", "part").counts()


# ----------------------------------------------------------------- kernels


@query
def move_wrap(spark, sf_dir):
    rows = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias(ID), F.col("s_acctbal").alias("pos_x"), F.lit(0.0).alias("pos_y"), F.col("s_nationkey").alias("heading"))
    return kernels.movement(rows, dt=10, world_size=500).select(ID, F.round("pos_x", 4).alias("pos_x"))


@query
def worm_metabolism(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias(ID), F.col("p_size").alias("energy"), F.lit(1.0).alias("worm_size"))
    return kernels.worm_metabolism(rows, rate=5, dt=1)


@query
def life_step(spark, sf_dir):
    """Cells in order of their keys, ten to a row. Keys are dense from the
    smallest, so the rank is a difference; the last row may be short."""
    part = read(spark, sf_dir, "part")
    low, n = part.agg(F.min("p_partkey"), F.count(F.lit(1))).first()
    cells = part.select((F.col("p_partkey") - low).alias(ID), (F.col("p_size") % 2 == 0).alias("alive"))
    return kernels.life_step(cells, 10, n // 10).select(ID, F.col("alive").cast("int").alias("alive"))


@query
def torus_radius(spark, sf_dir):
    from lithos.operators.spatial import SpatialGrid

    grid = SpatialGrid(500, 100)
    grid.rebuild(read(spark, sf_dir, "supplier"), "s_suppkey", "s_acctbal", "s_suppkey")
    return grid.query_radius(5, 5, 100)


# ------------------------------------------- the engine's own moving parts


@query
def scan_counted(spark, sf_dir):
    """A scan whose estimate is counted."""
    return planner(spark, sf_dir, "part").scan("p_size").filter(P.eq("p_size", 7)).build().entities()


@query
def query_table_exact(spark, sf_dir):
    """Rows with exactly these components: customers have one more."""
    return _accounts(spark, sf_dir).query_table("acctbal").select(ID, "acctbal")


@query
def query_flat_structs(spark, sf_dir):
    w = World(spark)
    place = F.struct(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    w.add_table("supplier", read(spark, sf_dir, "supplier"), "s_suppkey", {"Place": place})
    return w.query_flat("Place")


@query
def query_changed_since(spark, sf_dir):
    """Of two archetypes with balances only the one written later."""
    w = _accounts(spark, sf_dir)
    seen = max(a.ticks["acctbal"] for a in w.archetypes.values())
    w.touch(next(a for a in w.archetypes.values() if a.name == "supplier"), ["acctbal"])
    return w.query_changed_since("acctbal", seen).select("archetype", ID)


@query
def iter_sparse(spark, sf_dir):
    return _documents_with_labels(spark, sf_dir).iter_sparse("quality")


@query
def get_batch_unique(spark, sf_dir):
    asks = spark.sql(f"SELECT pos, {ID} FROM VALUES (0, 5L), (1, 5L), (2, 1L) AS t(pos, {ID})")
    return world(spark, sf_dir, "part").get_batch(asks, "p_size", unique=True).withColumnRenamed("value", "p_size")


@query
def index_btree_range(spark, sf_dir):
    p = planner(spark, sf_dir, "part")
    p.add_btree_index("p_size")
    return estimated(p, "p_size").filter(P.range("p_size", 3, 9)).build().entities()


@query
def index_hash_eq(spark, sf_dir):
    p = planner(spark, sf_dir, "part")
    p.add_hash_index("p_brand")
    return estimated(p, "p_brand").filter(P.eq("p_brand", "Brand#12")).build().rows("p_size").select(ID, "p_size")


@query
def index_updated(spark, sf_dir):
    """Sizes are written after the index was built; it is brought up to date."""
    p = planner(spark, sf_dir, "part")
    index = p.indexes[p.add_btree_index("p_size").component]["btree"]
    p.world.insert_batch(p.world.scan(["p_size"]).where("p_size < 5").select(ID, (F.col("p_size") + 100).alias("p_size")))
    index.update()
    return index.range(100)


@query
def index_stale_revalidated(spark, sf_dir):
    """The same, asked for through a plan with the index as it was."""
    p = planner(spark, sf_dir, "part")
    p.add_btree_index("p_size")
    p.world.insert_batch(p.world.scan(["p_size"]).where("p_size < 5").select(ID, (F.col("p_size") + 100).alias("p_size")))
    return estimated(p, "p_size").filter(P.range("p_size", 100)).build().entities()


class _Cells:
    """A user's spatial index: suppliers by the hundred of their balance."""

    def __init__(self, rows: DataFrame):
        self.rows = rows.withColumn("cell", F.floor(F.col("s_acctbal") / 100))

    def supports(self, predicate) -> float | None:
        return 10.0 if predicate.kind == "intersects" else None

    def candidates(self, predicate) -> DataFrame:
        return self.rows.where("cell BETWEEN 9 AND 20").select(F.col("s_suppkey").alias(ID))


@query
def spatial_index_candidates(spark, sf_dir):
    p = planner(spark, sf_dir, "supplier")
    p.add_spatial_index("s_acctbal", _Cells(read(spark, sf_dir, "supplier")))
    return estimated(p, "s_acctbal").filter(P.intersects("s_acctbal", (1000.0,), (2000.0,))).build().entities()


@query
def subscription_built(spark, sf_dir):
    """Orders that changed, of one status, through the subscription builder."""
    p = planner(spark, sf_dir, "orders")
    plan = p.subscribe(Changed("o_orderstatus")).where_eq(p.add_hash_index("o_orderstatus"), "P").build()
    return plan.entities()


@query
def view_of_last_delta(spark, sf_dir):
    """A view over changes: after a write to suppliers alone, only those."""
    w = _accounts(spark, sf_dir)
    view = changes.MaterializedView(QueryPlanner(w).scan_with_estimate(10, Changed("acctbal")).build())
    view.refresh(w)
    w.touch(next(a for a in w.archetypes.values() if a.name == "supplier"), ["acctbal"])
    view.refresh(w)
    return view.entities()


@query
def aggregate_result(spark, sf_dir):
    """Labels and values as the caller gets them."""
    scan = estimated(planner(spark, sf_dir, "part"), "p_size").aggregate(Agg.count()).aggregate(Agg.max("p_size"))
    out = scan.build().aggregate()
    return spark.createDataFrame([(k, float(v)) for k, v in out], "label string, value double")


@query
def execute_collect(spark, sf_dir):
    plan = planner(spark, sf_dir, "nation").scan("n_regionkey").filter(P.eq("n_regionkey", 1)).build()
    return spark.createDataFrame([(i,) for i in plan.execute_collect()], f"{ID} bigint")


@query
def execute_stream(spark, sf_dir):
    seen: list[tuple[int]] = []
    planner(spark, sf_dir, "nation").scan("n_regionkey").build().execute_stream(lambda i: seen.append((i,)))
    return spark.createDataFrame(seen, f"{ID} bigint")


@query
def plan_chunks(spark, sf_dir):
    """Arrow batches of fetched columns through a function."""

    def double(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pc.multiply(b.column(2), 2).cast(pa.int64())], names=["entity_id", "twice"])

    return estimated(planner(spark, sf_dir, "part"), "p_size").build().chunks(double, "entity_id bigint, twice bigint", "p_size")


@query
def changeset_applied(spark, sf_dir):
    """Ops on nations, as one change set: two change, one goes, one comes."""
    w = world(spark, sf_dir, "nation")
    c = changeset.ChangeSet()
    c.insert(1, n_regionkey=100)
    c.insert(2, n_regionkey=101)
    c.insert(2, n_regionkey=102)
    c.despawn(3)
    c.spawn(1000, n_name="NOWHERE", n_regionkey=103)
    c.remove(4, "n_regionkey")
    c.apply(w)
    return w.scan(["n_name", Opt("n_regionkey")]).select(ID, "n_name", "n_regionkey")


@query
def batch_mutations(spark, sf_dir):
    """Spawn a batch, despawn by a frame, write a column."""
    w = world(spark, sf_dir, "part")
    w.despawn(w.scan(["p_size"]).where("p_size > 25").select(ID))
    w.write_column("p_size", w.scan(["p_size"]).where("p_size < 10").select(ID, (F.col("p_size") + 1000).alias("value")))
    return w.scan(["p_size"]).select(ID, "p_size")


def _raise(writer, by):
    writer.modify(s_acctbal=F.col("s_acctbal") + by)


def _raises() -> reducers.ReducerRegistry:
    r = reducers.ReducerRegistry()
    r.register("raise", "query_writer", _raise, Mut("s_acctbal"))
    return r


@query
def reducer_call_optimistic(spark, sf_dir):
    w = world(spark, sf_dir, "supplier")
    _raises().call(Optimistic(), w, "raise", by=100)
    return w.scan(["s_acctbal"]).select(ID, F.round("s_acctbal", 2).alias("balance"))


@query
def reducer_durable_recovered(spark, sf_dir):
    """The same through a log; the state is what recovery makes of it."""
    folder = f"{shared_folder(spark)}/durable-{uuid.uuid4().hex}"
    w, log = world(spark, sf_dir, "supplier"), wal.Wal(spark, f"{folder}/log")
    snapshot.save(w, f"{folder}/snapshot")
    _raises().call(Durable(Optimistic(), log), w, "raise", by=100)
    got = checkpoint.recover(spark, f"{folder}/snapshot", wal.Wal(spark, f"{folder}/log"), World(spark))
    return got.scan(["s_acctbal"]).select(ID, F.round("s_acctbal", 2).alias("balance"))


@query
def wal_state_folded(spark, sf_dir):
    """Two records of balances; the later one has those of one nation."""
    w, log = world(spark, sf_dir, "supplier"), wal.Wal(spark, f"{shared_folder(spark)}/log-{uuid.uuid4().hex}")
    rows = w.scan(["s_acctbal", "s_nationkey"])
    log.append(changeset.ChangeSet(), w, [rows.select(ID, "s_acctbal")])
    log.append(changeset.ChangeSet(), w, [rows.where("s_nationkey = 1").select(ID, (F.col("s_acctbal") + 1).alias("s_acctbal"))])
    return log.state().select(ID, F.round(F.get_json_object("payload", "$.v").cast("double"), 2).alias("balance"))


@query
def retention_run(spark, sf_dir):
    """Two runs over the world."""
    w = World(spark)
    w.add_table("part", read(spark, sf_dir, "part"), "p_partkey", {"Expiry": F.col("p_size")})
    reducers.run_retention(w)
    reducers.run_retention(w)
    return w.scan(["Expiry"]).select(ID, F.col("Expiry").alias("remaining"))


@query
def snapshot_round_trip(spark, sf_dir):
    folder = f"{shared_folder(spark)}/snapshot-{uuid.uuid4().hex}"
    snapshot.save(_documents_with_labels(spark, sf_dir), folder)
    w = snapshot.load(spark, folder)
    return w.scan(["n_chars", "quality"]).select(ID, "n_chars", "quality")


@query
def lsm_store_scanned(spark, sf_dir):
    """Four runs of one archetype, compacted: the newest run wins."""
    store = lsm.LsmStore(spark, f"{shared_folder(spark)}/lsm-{uuid.uuid4().hex}")
    rows = lsm.newest_wins(read(spark, sf_dir, "events").select((F.col("event_id") % 4).alias("run"), F.col("user_id").alias(ID), F.col("event_id").alias("row_id")), ["run", ID], ["row_id"])
    for k in range(4):
        store.add_run("events", rows.where(F.col("run") == k).select(ID, "row_id"), k, k)
    store.compact_one()
    return store.scan("events")


@query
def metrics_change(spark, sf_dir):
    """Differences of two snapshots of a world's metrics."""
    w = world(spark, sf_dir, "supplier")
    before = observe.MetricsSnapshot.capture(w)
    w.despawn(w.scan(["s_nationkey"]).where("s_nationkey = 1").select(ID))
    d = observe.MetricsDiff.compute(before, observe.MetricsSnapshot.capture(w))
    return spark.createDataFrame([(d.entity_delta, d.archetype_delta)], "entities bigint, archetypes bigint")


# ------------------------------------------------------------ without SQL


@query
def boids_step(spark, sf_dir):
    """Forces and integration over the suppliers as boids."""
    rows = read(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias(ID), wrap(F.col("s_acctbal"), 500).alias("pos_x"), wrap(F.col("s_suppkey") * 37.5, 500).alias("pos_y"),
        F.cos("s_nationkey").alias("vel_x"), F.sin("s_nationkey").alias("vel_y"),
    )
    out = kernels.boids_integrate(kernels.boids_forces(rows))
    return out.select(ID, *[F.round(c, 6).alias(c) for c in ("pos_x", "pos_y", "vel_x", "vel_y")])


@query
def gravity_step(spark, sf_dir):
    """One step of the bodies that the regions' nations are."""
    rows = read(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("long").alias(ID), (F.col("n_nationkey") * 19.5).alias("pos_x"), (F.col("n_regionkey") * 97.0).alias("pos_y"),
        F.lit(0.0).alias("vel_x"), F.lit(0.0).alias("vel_y"), (1.0 + F.col("n_regionkey")).alias("mass"),
    )
    out = kernels.gravity(rows)
    zero = lambda c: F.when(F.round(c, 6) == 0, 0.0).otherwise(F.round(c, 6)).alias(c)  # noqa: E731  no negative zero
    return out.select(ID, *[zero(c) for c in ("pos_x", "pos_y", "vel_x", "vel_y")])


@query
def worm_step(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias(ID), wrap(F.col("p_partkey") * 7.0, 500).alias("pos_x"), F.lit(1.0).alias("pos_y"), (F.col("p_size") / 8).alias("heading"), F.col("p_size").cast("double").alias("energy")
    )
    return kernels.worm_move(rows).select(ID, F.round("pos_x", 4).alias("pos_x"), F.round("pos_y", 4).alias("pos_y"))


@query
def neighbours_within(spark, sf_dir):
    """Pairs of suppliers within 20 on a torus of 500."""
    from lithos.operators.spatial import SpatialGrid

    grid = SpatialGrid(500, 20)
    grid.rebuild(read(spark, sf_dir, "supplier"), "s_suppkey", "s_acctbal", "s_suppkey")
    return grid.neighbours(20).select(ID, "other", F.round("d2", 4).alias("d2"))


@query
def circuit_waveform(spark, sf_dir):
    """A supply voltage for each region."""
    sets = read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("sim"), (9.0 + F.col("r_regionkey")).alias("vcc"), F.lit(1e-7).alias("dt"))
    return kernels.circuit(sets, 4000)


@query
def plan_explain(spark, sf_dir):
    """Lines of a plan's tree and its warnings."""
    p = _orders_of(spark, sf_dir, "c_acctbal > 9000")
    plan = p.scan_with_estimate(1000, "o_custkey").filter(P.eq("o_orderpriority", "1-URGENT")).join("o_totalprice").er_join("o_custkey", "Tagged").with_right_estimate(10).build()
    return spark.createDataFrame(list(enumerate(plan.explain().splitlines())), "line int, text string")


@query
def access_conflicts(spark, sf_dir):
    """Batches of reducers that may run together."""
    a = {"move": Access(frozenset({"Velocity"}), frozenset({"Position"})), "decay": Access(frozenset(), frozenset({"Energy"})), "draw": Access(frozenset({"Position"})), "reap": Access(despawns=True)}
    return spark.createDataFrame([(n, k) for k, names in enumerate(colour(a)) for n in names], "name string, batch int")

