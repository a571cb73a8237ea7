"""Named networks as partitioned Parquet tables under one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("coefs", "gof", "modules", "module_members", "network_features", "params",
          "nodes", "edges", "tf_edges")


class NetworkStore:
    """Reads and writes the parts of networks; several networks coexist.

    Tables are partitioned by ``network`` (graphs also by ``graph``), so a lookup
    reads only its own folders and a rewrite replaces only its own partition.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, table: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _read(self, table: str) -> DataFrame:
        if not self._exists(table):
            raise KeyError(f"nothing stored for {table!r}")
        return self.spark.read.parquet(f"{self.path}/{table}")

    def put(self, table: str, df: DataFrame, **keys: str) -> None:
        for k, v in keys.items():
            df = df.withColumn(k, F.lit(v))
        (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(*keys).parquet(f"{self.path}/{table}"))

    def get(self, table: str, **keys: str) -> DataFrame:
        df = self._read(table)
        for k, v in keys.items():
            df = df.filter(F.col(k) == v)
        if df.limit(1).isEmpty():
            raise KeyError(f"{table} holds nothing for {keys}")
        return df.drop(*keys)

    def save_network(self, name: str, coefs: DataFrame, gof: DataFrame, targets: DataFrame,
                     params: dict, activate: bool = True) -> None:
        """Store a fitted network and make it the active one."""
        self.put("coefs", coefs, network=name)
        self.put("gof", gof, network=name)
        self.put("network_features", targets, network=name)
        self.save_params(name, "fit", params)
        if activate:
            self.activate(name)

    def save_params(self, name: str, step: str, params: dict) -> None:
        rows = [(k, None if v is None else str(v)) for k, v in params.items()]
        df = self.spark.createDataFrame(rows, "key string, value string")
        self.put("params", df, network=name, step=step)

    def activate(self, name: str) -> None:
        (self.spark.createDataFrame([(name,)], "network string").coalesce(1)
         .write.mode("overwrite").parquet(f"{self.path}/active"))

    def networks(self) -> list[str]:
        """Names from the partition folders of the parameter table."""
        return sorted(r[0] for r in self._read("params").select("network").distinct().collect())

    def default_network(self) -> str:
        if not self._exists("active"):
            raise KeyError("no network has been stored yet")
        return self._read("active").first()[0]

    def _name(self, network: str | None) -> str:
        return network or self.default_network()

    def params(self, network: str | None = None, step: str = "fit") -> dict:
        rows = self.get("params", network=self._name(network), step=step).collect()
        return {r["key"]: r["value"] for r in rows}

    def coefs(self, network: str | None = None) -> DataFrame:
        return self.get("coefs", network=self._name(network))

    def gof(self, network: str | None = None) -> DataFrame:
        return self.get("gof", network=self._name(network))

    def targets(self, network: str | None = None) -> DataFrame:
        return self.get("network_features", network=self._name(network))

    def save_modules(self, network: str, modules: DataFrame, members: DataFrame,
                     params: dict) -> None:
        self.put("modules", modules, network=network)
        self.put("module_members", members, network=network)
        self.save_params(network, "modules", params)

    def modules(self, network: str | None = None) -> tuple[DataFrame, DataFrame]:
        n = self._name(network)
        return self.get("modules", network=n), self.get("module_members", network=n)

    def save_graph(self, network: str, nodes: DataFrame, edges: DataFrame,
                   graph: str = "module_graph") -> None:
        self.put("nodes", nodes, network=network, graph=graph)
        self.put("edges", edges, network=network, graph=graph)

    def graph(self, network: str | None = None,
              graph: str = "module_graph") -> tuple[DataFrame, DataFrame]:
        n = self._name(network)
        return (self.get("nodes", network=n, graph=graph),
                self.get("edges", network=n, graph=graph))

    def assay_summary(self, assay: str, group: str, compute) -> DataFrame:
        """Stored group summary of an assay, computed on the first read."""
        try:
            return self.get("summaries", assay=assay, group_name=group)
        except KeyError:
            self.put("summaries", compute(), assay=assay, group_name=group)
            return self.get("summaries", assay=assay, group_name=group)


def network_summary(coefs: DataFrame) -> DataFrame:
    """Numbers shown when a network is printed."""
    return coefs.agg(F.count_distinct("tf").alias("n_tfs"),
                     F.count_distinct("target").alias("n_targets"),
                     F.count_distinct("region").alias("n_regions"),
                     F.count(F.lit(1)).alias("n_coefs"))


def module_summary(modules: DataFrame) -> DataFrame:
    return modules.agg(F.count_distinct("tf").alias("n_modules"),
                       F.count_distinct("target").alias("n_genes"))


def region_summary(regions: DataFrame, motif_tf: DataFrame | None = None) -> DataFrame:
    d = regions.agg(F.count_distinct("region_id").alias("n_regions"),
                    F.count_distinct("peak_id").alias("n_peaks"))
    if motif_tf is None:
        return d
    return d.withColumn("n_tfs", motif_tf.agg(F.count_distinct("tf").alias("n")).scalar())
