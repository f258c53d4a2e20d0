"""Files and folders: the layout document, persisted state, recordings, and the shared work folder."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double>"
RECEIVER = "struct<entity_id:string,cords:struct<x:double,y:double>,height:double,correction:double,scanner_uid:string>"
ZONE = f"struct<zone_id:string,entity_id:string,cords:array<{POINT}>,poly:boolean,no_go:boolean,color:string>"
SUBZONE = f"struct<sub_zone_id:string,entity_id:string,parent:string,cords:array<{POINT}>,poly:boolean>"
FLOOR = f"struct<name:string,scale:double,receivers:array<{RECEIVER}>,zones:array<{ZONE}>,subzones:array<{SUBZONE}>>"
LAYOUT = f"floor array<{FLOOR}>, tracker_height double, position_timeout double, auto_calibration boolean, tracker_icons map<string,string>, __broken string"


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the place that driver and executors share; a local one only where all run on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = os.path.join(os.environ.get("TMPDIR", "/tmp"), "checkpoints")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class WorkTables:
    """Tables that an operator writes into the shared folder on its way; whatever it drops is deleted there."""

    def __init__(self):
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` as written and read back: lineage is cut by files that outlive any executor."""
        path = work_folder(df.sparkSession, name)
        df.write.parquet(path)
        out = df.sparkSession.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = out, path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            _, path = self.paths.pop(id(df))
            drop_path(df.sparkSession, path)

    def keep_only(self, *tables: DataFrame) -> None:
        stay = {id(t) for t in tables}
        self.drop(*[df for key, (df, _) in list(self.paths.items()) if key not in stay])


class Parts:
    """Tables of a streaming job under one folder, a part for each micro-batch that writes one.

    A batch reads parts from before it and overwrites its own, so one that is run again after a failure does the same.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, name: str, batch: int) -> str:
        return f"{self.folder}/{name}/batch={batch}"

    def write(self, df: DataFrame, name: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(self.path(name, batch))

    def batches(self, name: str) -> list[int]:
        """Those whose part is committed."""
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/batch=*/_SUCCESS")
        found = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
        return sorted(int(d.getPath().getParent().getName().split("=")[1]) for d in found or [])

    def newest(self, name: str, before: int, schema: str) -> DataFrame:
        """The newest part before a batch; without one, no rows."""
        earlier = [b for b in self.batches(name) if b < before]
        return self.spark.read.schema(schema).parquet(self.path(name, earlier[-1])) if earlier else self.spark.createDataFrame([], schema)

    def some(self, name: str, batches: list[int], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[self.path(name, b) for b in batches]) if batches else self.spark.createDataFrame([], schema)

    def forget(self, name: str, before: int) -> None:
        """Delete parts of batches before ``before``."""
        for b in self.batches(name):
            if b < before:
                drop_path(self.spark, self.path(name, b))

    def forget_replaced(self, name: str, batch: int) -> None:
        """Delete all but a batch's own part and the one before, which it would need to be run again."""
        earlier = [b for b in self.batches(name) if b < batch]
        if earlier:
            self.forget(name, earlier[-1])


def parse_layout(texts: DataFrame, column: str = "value") -> DataFrame:
    """Layouts of JSON texts; a broken text has no floors instead of failing."""
    parsed = F.from_json(F.col(column), LAYOUT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__broken"})
    return texts.select(parsed.alias("l")).select("l.*")


def read_layout(spark: SparkSession, path: str) -> DataFrame:
    """The layout stored at ``path``; without a usable file an empty one."""
    from pyspark.errors import AnalysisException

    try:
        return parse_layout(spark.read.text(path, wholetext=True))
    except AnalysisException:
        return parse_layout(spark.createDataFrame([], "value string"))


def _floors(layout: DataFrame) -> DataFrame:
    return layout.select(F.posexplode("floor").alias("floor_seq", "f"))


def floors(layout: DataFrame) -> DataFrame:
    return _floors(layout).select("floor_seq", F.col("f.name").alias("floor"), F.col("f.scale").alias("scale"))


def receivers(layout: DataFrame) -> DataFrame:
    """Placed receivers, whatever else is wrong with their floor: those with a non-empty id."""
    r = _floors(layout).select("floor_seq", F.col("f.name").alias("floor"), F.col("f.scale").alias("scale"), F.posexplode("f.receivers").alias("rec_seq", "r"))
    return r.filter("r.entity_id <> ''").select("floor_seq", "floor", "rec_seq", F.col("r.entity_id").alias("scanner"), F.col("r.cords.x").alias("x"), F.col("r.cords.y").alias("y"), "r.height", "r.correction", F.col("r.scanner_uid").alias("uid"), "scale")


def calibration_receivers(layout: DataFrame) -> DataFrame:
    """Receivers with a scale and a position, plausible heights only; of one id the last placed."""
    r = receivers(layout).filter("scale <> 0 and x is not null and y is not null")
    r = r.withColumn("height", F.when(~F.isnan("height") & F.col("height").between(0, 10), F.col("height")))
    cols = [c for c in r.columns if c != "scanner"]
    last = r.groupBy("scanner").agg(F.max_by(F.struct(*cols), F.struct("floor_seq", "rec_seq")).alias("v"))
    return last.select("scanner", *[F.col("v")[c].alias(c) for c in cols])


def selftest_receivers(layout: DataFrame) -> DataFrame:
    r = calibration_receivers(layout)
    return r.withColumn("correction", F.coalesce(F.when((F.col("correction") > 0) & ~F.isnan("correction"), F.col("correction")), F.lit(1.0)))


def placed_slugs(layout: DataFrame) -> DataFrame:
    return receivers(layout).select("scanner").distinct()


def zones(layout: DataFrame) -> DataFrame:
    z = _floors(layout).select("floor_seq", F.col("f.name").alias("floor"), F.posexplode("f.zones").alias("zone_seq", "z"))
    return z.select("floor_seq", "floor", "zone_seq", "z.zone_id", F.col("z.entity_id").alias("zone"), F.coalesce("z.poly", F.lit(False)).alias("poly"), F.coalesce("z.no_go", F.lit(False)).alias("no_go"), F.coalesce("z.cords", F.expr("cast(array() as array<struct<x:double,y:double>>)")).alias("ring"))


def subzones(layout: DataFrame) -> DataFrame:
    z = _floors(layout).select("floor_seq", F.col("f.name").alias("floor"), F.posexplode("f.subzones").alias("sub_seq", "z"))
    return z.select("floor_seq", "floor", "sub_seq", "z.sub_zone_id", F.col("z.entity_id").alias("sub_zone"), "z.parent", F.coalesce("z.cords", F.expr("cast(array() as array<struct<x:double,y:double>>)")).alias("ring"))


def save_layout(layout: DataFrame, path: str) -> None:
    """One JSON document; Spark's committer puts it in place only when it is whole."""
    layout.drop("__broken").coalesce(1).write.mode("overwrite").json(path)


def import_once(text: DataFrame, path: str) -> str:
    """Import a legacy layout text into an empty store: 'imported', 'blank', 'broken' or 'kept' (the store has one)."""
    spark = text.sparkSession
    if read_layout(spark, path).filter("floor is not null").limit(1).count():
        return "kept"
    value = text.select(F.trim("value").alias("value")).first()
    if value is None or not value[0]:
        return "blank"
    parsed = parse_layout(text)
    if not parsed.filter("__broken is null and floor is not null").limit(1).count():
        return "broken"
    save_layout(parsed, path)
    return "imported" if read_layout(spark, path).filter("floor is not null").limit(1).count() else "broken"


def child_path(folder: str, name: str, extensions: tuple[str, ...] = ()) -> str:
    """``name`` inside ``folder``; ValueError for anything that leaves it or has another extension."""
    base = os.path.basename(name or "")
    if not base or base in (".", "..") or base != name or "\0" in name or (extensions and not base.lower().endswith(extensions)):
        raise ValueError(f"not a file name: {name!r}")
    return os.path.join(folder, base)
