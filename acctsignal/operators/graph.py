"""Follow graphs: bounded walks, node and edge tables, export.

Edges are ``source_id`` follows ``target_id``, each pair once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from acctsignal.functions import xml_escape
from acctsignal.operators.hops import BucketTable, HopTable, bucket_count
from acctsignal.operators.ordered import first_per_key
from acctsignal.session import materialize

# Fixed value: connections that a crawl reads per account and direction.
MAX_CONNECTIONS = 25_000
# Connections per direction in one adjacency record.
PER_RECORD = 25_000
# Connections of one account that lie together.
ROWS_PER_CHUNK = 1_000_000
EXPORT_TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss"


def unique_edges(edges: DataFrame, seen: str = "created_date") -> DataFrame:
    """Each directed pair once, with the time it was first seen."""
    return edges.groupBy("source_id", "target_id").agg(F.min(seen).alias(seen))


def unique_nodes(nodes: DataFrame, seen: str = "created_date") -> DataFrame:
    """Each node once, with its first-seen time and the name it had then."""
    return nodes.groupBy("id").agg(
        F.min_by("screen_name", F.struct(seen, "screen_name")).alias("screen_name"),
        F.min(seen).alias(seen))


def nodes_of(edges: DataFrame, accounts: DataFrame, seen: str = "created_date") -> DataFrame:
    """The known accounts at the ends of edges, with the time each was first seen.

    An account with many edges is one row before it is joined.
    """
    ends = edges.select(F.col("source_id").alias("id"), seen).unionByName(
        edges.select(F.col("target_id").alias("id"), seen))
    first = ends.groupBy("id").agg(F.min(seen).alias(seen))
    return first.join(accounts.select("id", "screen_name"), "id")


def both_ways(edges: DataFrame) -> DataFrame:
    """Every edge from both its ends: ``id, direction, other``."""
    ends = F.array(*[F.struct(F.col(a).alias("id"), F.lit(d).alias("direction"), F.col(b).alias("other"))
                     for a, d, b in (("source_id", "friend", "target_id"), ("target_id", "follower", "source_id"))])
    return edges.select(F.inline(ends))


def connections(edges: DataFrame, accounts: DataFrame, max_connections: int | None = None) -> DataFrame:
    """Friends and followers of ``accounts(id)``: ``id, direction, other``.

    Of every account and direction all, or the first ``max_connections`` by the other's id.
    """
    found = both_ways(edges).join(accounts.select("id"), "id", "left_semi")
    return found if max_connections is None else capped(materialize(found, "connections"), max_connections)


def capped(found: DataFrame, max_connections: int) -> DataFrame:
    """The first ``max_connections`` connections per account and direction."""
    return first_per_key(found, ["id", "direction"], "other", max_connections)


def directed(found: DataFrame) -> DataFrame:
    """Connections as edges, from follower to followed."""
    is_friend = F.col("direction") == "friend"
    return found.select(
        F.when(is_friend, F.col("id")).otherwise(F.col("other")).alias("source_id"),
        F.when(is_friend, F.col("other")).otherwise(F.col("id")).alias("target_id"))


@dataclass(frozen=True)
class EgoNetwork:
    """``nodes(id, distance)`` and ``edges(source_id, target_id)`` around one account."""

    nodes: DataFrame
    edges: DataFrame


class Adjacency:
    """Connections of all accounts, stored for walks: a hop over them shuffles only its frontier.

    The table is bucketed by (account, chunk). An account with more than ``rows_per_chunk`` connections has them in
    several chunks, told by the other's hash, so it is not one bucket's; the accounts with several are few, at
    most connections / rows_per_chunk.
    """

    def __init__(self, edges: DataFrame, max_connections: int | None = None, rows_per_chunk: int = ROWS_PER_CHUNK,
                 buckets: int | None = None):
        spark = edges.sparkSession
        found = both_ways(edges)
        if max_connections is not None:
            found = capped(materialize(found, "connections"), max_connections)
        self.hubs = materialize(
            found.groupBy("id").count().where(F.col("count") > rows_per_chunk)
            .select("id", F.expr(f"cast((count - 1) div {rows_per_chunk} as int) as last_chunk")), "hubs")
        chunk = F.pmod(F.xxhash64("other"), F.coalesce("last_chunk", F.lit(0)) + 1).cast("int")
        chunked = found.join(self.hubs, "id", "left").withColumn("chunk", chunk).drop("last_chunk")
        self.buckets = buckets or bucket_count(spark, 2 * edges.count())
        table = BucketTable(spark, "adjacency", ["id", "chunk"], self.buckets)
        table.add(chunked)
        self.rows = table.all().drop("hop")

    def of(self, accounts: DataFrame) -> DataFrame:
        """``id, direction, other`` of ``accounts(id)``."""
        chunks = F.sequence(F.lit(0), F.coalesce("last_chunk", F.lit(0)))
        asked = accounts.select("id").join(self.hubs, "id", "left").select("id", F.explode(chunks).alias("chunk"))
        return self.rows.join(asked, ["id", "chunk"]).select("id", "direction", "other")


def ego_network(edges: DataFrame | Adjacency, root: int, degree: int = 1, max_connections: int | None = None,
                root_only: bool = False) -> EgoNetwork:
    """Accounts and edges met when every account up to ``degree`` hops away is expanded.

    Nodes therefore reach distance ``degree + 1``. ``root_only`` keeps the edges among the
    root and its direct neighbours. Walks from several roots may share an ``Adjacency`` in place of the edges.
    """
    graph = edges if isinstance(edges, Adjacency) else Adjacency(edges, max_connections)
    spark = graph.rows.sparkSession
    nodes = BucketTable(spark, "ego_nodes", ["id"], graph.buckets)
    met = HopTable(spark, "ego-connections", "id bigint, direction string, other bigint")
    frontier = nodes.add(spark.createDataFrame([(root,)], "id bigint"))
    for hop in range(degree + 1):
        found = met.add(graph.of(frontier))
        frontier = nodes.add(
            found.select(F.col("other").alias("id")).distinct().join(nodes.all(), "id", "left_anti"), hop + 1)
        if frontier.isEmpty():
            break
    all_nodes = nodes.all().withColumnRenamed("hop", "distance")
    all_edges = directed(met.all()).distinct()
    if root_only:
        all_nodes = all_nodes.where("distance <= 1")
        inner = all_nodes.select("id")
        all_edges = (
            all_edges.join(inner.withColumnRenamed("id", "source_id"), "source_id", "left_semi")
            .join(inner.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
            .select("source_id", "target_id")
        )
    return EgoNetwork(all_nodes, all_edges)


def adjacency_records(edges: DataFrame, accounts: DataFrame, crawled: DataFrame, max_connections: int | None = None,
                      per_record: int = PER_RECORD) -> DataFrame:
    """Records of crawled accounts, each with up to ``per_record`` friends and as many followers, as arrays of accounts.

    An account with more connections has several records, told apart by ``chunk`` (0, 1, …, dealt by the other's hash), so
    no account's connections are ever in one row. Every account has a record 0. ``joined_records`` gives them as
    rows again. Connections of unknown accounts are left out.
    """
    profile = F.struct(*[F.col(c) for c in accounts.columns]).alias("profile")
    found = connections(edges, crawled, max_connections)
    most = found.groupBy("id", "direction").count().groupBy("id").agg(
        F.expr(f"(max(count) - 1) div {max(1, per_record // 2)} + 1").alias("chunks"))
    chunk = F.pmod(F.xxhash64("other"), F.when(F.col("chunks") <= 2, 1).otherwise(F.col("chunks")))
    lists = (
        found.join(most, "id").select("id", "direction", "other", chunk.alias("chunk"))
        .join(accounts.select(F.col("id").alias("other"), profile), "other")
        .groupBy("id", "chunk")
        .agg(*[
            F.array_sort(F.collect_list(F.when(F.col("direction") == d, F.col("profile")))).alias(f"{d}s")
            for d in ("friend", "follower")
        ])
    )
    none = F.array().cast(lists.schema["friends"].dataType)
    heads = crawled.select("id").distinct().withColumn("chunk", F.lit(0).cast("bigint"))
    return (
        accounts.join(lists.join(heads, ["id", "chunk"], "full"), "id")
        .withColumns({c: F.coalesce(c, none) for c in ("friends", "followers")})
    )


def write_records(records: DataFrame, path: str) -> None:
    """Adjacency records as gzip JSON, one per line."""
    records.write.mode("append").option("compression", "gzip").json(path)


def read_records(spark: SparkSession, path: str, accounts: DataFrame) -> DataFrame:
    """Adjacency records as ``write_records`` wrote them; ``accounts`` has the profiles' columns."""
    profiles = ArrayType(accounts.schema)
    schema = StructType([*accounts.schema.fields, StructField("chunk", LongType()),
                         StructField("friends", profiles), StructField("followers", profiles)])
    return spark.read.schema(schema).json(path)


def joined_records(records: DataFrame) -> DataFrame:
    """The accounts in the records, one row each: ``id, direction, other`` and the other's ``profile``.

    The rows of a hub come from all its records; nothing is put into one array.
    """
    ends = [records.select("id", F.lit(d).alias("direction"), F.explode(f"{d}s").alias("profile"))
            for d in ("friend", "follower")]
    both = ends[0].unionByName(ends[1])
    return both.select("id", "direction", F.col("profile.id").alias("other"), "profile")


def _element(tag: str, **attributes: Column) -> Column:
    parts: list[Column] = [F.lit(f"<{tag}")]
    for name, value in attributes.items():
        parts += [F.lit(f' {name}="'), xml_escape(F.coalesce(value, F.lit(""))), F.lit('"')]
    return F.concat(*parts, F.lit("/>"))


def _kind_id(kind: str, column: str) -> Column:
    return F.concat(F.lit(f"{kind}-"), F.col(column).cast("string"))


def export_nodes(nodes: DataFrame, kind: str, key: str = "id", label: str = "screen_name",
                 start: str = "created_date") -> DataFrame:
    """Node rows ``id, kind, label, start`` and the rendered ``element``.

    Ids carry their kind, so accounts and posts never meet in one id space.
    """
    table = nodes.select(
        _kind_id(kind, key).alias("id"), F.lit(kind).alias("kind"), F.col(label).alias("label"),
        F.date_format(start, EXPORT_TIME_FORMAT).alias("start"))
    return table.withColumn("element", _element(
        "node", id=F.col("id"), label=F.col("label"), start=F.col("start")))


def export_edges(edges: DataFrame, source: tuple[str, str], target: tuple[str, str],
                 start: str | None = "created_date") -> DataFrame:
    """Edge rows ``id, source, target, start`` and the rendered ``element``.

    ``source`` and ``target`` are (kind, column).
    """
    ends = edges.withColumns({"source": _kind_id(*source), "target": _kind_id(*target)})
    at = F.date_format(start, EXPORT_TIME_FORMAT) if start else F.lit(None).cast("string")
    table = ends.select(F.concat("source", F.lit(">"), "target").alias("id"),
                        "source", "target", at.alias("start"))
    attributes = {"id": F.col("id"), "source": F.col("source"), "target": F.col("target")}
    if start:
        attributes["start"] = F.col("start")
    return table.withColumn("element", _element("edge", **attributes))


def named_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the screen names of both ends; unknown ends drop out."""
    name = nodes.select("id", "screen_name")
    return (
        edges.join(name.select(F.col("id").alias("source_id"), F.col("screen_name").alias("source_name")),
                   "source_id")
        .join(name.select(F.col("id").alias("target_id"), F.col("screen_name").alias("target_name")),
              "target_id")
    )
