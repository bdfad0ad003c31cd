"""Readers and writers: occurrence files, named layers, GeoJSON, patches, listings."""

from __future__ import annotations

import io
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType

from terraloom.scale import global_row_number

# Canonical column names of an occurrence table, in file order.
OCCURRENCE_COLUMNS = [
    "No", "Source", "Species", "Common_Name", "Status", "Year", "Month", "Month_Year", "Survey_Method",
    "Location", "Latitude", "Longitude",
]
_TYPES = {"No": "bigint", "Year": "int", "Month": "int", "Latitude": "double", "Longitude": "double"}


def load_occurrences(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Read a 12-column table, name its columns and drop rows without usable coordinates."""
    schema = ", ".join(f"{c} string" for c in OCCURRENCE_COLUMNS)
    raw = spark.read.csv(path, header=True, schema=schema) if fmt == "csv" else spark.read.format(fmt).load(path).toDF(*OCCURRENCE_COLUMNS)
    typed = raw.withColumns({c: F.col(c).cast("string").try_cast(t) for c, t in _TYPES.items()})
    return typed.dropna(subset=["Latitude", "Longitude"])


class LayerStore:
    """Named Parquet layers in one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def read_layer(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def write_layers(self, layers: Mapping[str, DataFrame]) -> DataFrame:
        """Replace each layer; rows are counted while they are written."""
        counts = []
        for name, df in layers.items():
            seen = Observation()
            df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{self.path}/{name}")
            counts.append((name, seen.get["n"]))
        return self.spark.createDataFrame(counts, "layer string, n bigint")

    def cached_layer(self, name: str, builder: Callable[[], DataFrame]) -> DataFrame:
        """The stored layer when complete, else the builder's result, stored first."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        done = hadoop.Path(f"{self.path}/{name}/_SUCCESS")
        fs = done.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(done):
            builder().write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.read_layer(name)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def to_feature(geometry: Column, properties: Sequence[str]) -> Column:
    """One GeoJSON Feature as text; geometry is a struct (type, coordinates)."""
    return F.to_json(F.struct(
        F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties")))


def point_geometry(x: str, y: str) -> Column:
    return F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates"))


def polygon_geometry(ring: str) -> Column:
    coords = F.array(F.transform(ring, lambda p: F.array(p["x"], p["y"])))
    return F.struct(F.lit("Polygon").alias("type"), coords.alias("coordinates"))


def write_geojson(df: DataFrame, geometry: Column, properties: Sequence[str], path: str) -> None:
    """One Feature per line."""
    df.select(to_feature(geometry, properties).alias("value")).write.mode("overwrite").text(path)


def export_attributes(df: DataFrame, path: str | None = None, geometry: Sequence[str] = ("geometry",)) -> DataFrame:
    """The table without its geometry, also written as CSV when a path is given."""
    out = df.drop(*geometry)
    if path:
        write_csv(out, path)
    return out


def write_stats_json(stats: DataFrame, path: str) -> None:
    stats.write.mode("overwrite").json(path)


def create_table_as(df: DataFrame, cols: Sequence[str], path: str) -> DataFrame:
    """Store a projection of a table and read it back."""
    df.select(*cols).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def create_view(df: DataFrame, name: str) -> DataFrame:
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def filter_collection(px: DataFrame, bbox: Sequence[float], date_from: str, date_to: str, max_cloud: float) -> DataFrame:
    """Scenes in a half-open date range whose bounds meet the box and whose cloud share is low."""
    x0, y0, x1, y1 = (float(v) for v in bbox)
    return px.where(
        (F.col("dt") >= F.lit(date_from).cast("date")) & (F.col("dt") < F.lit(date_to).cast("date"))
        & (F.col("x0") <= x1) & (F.col("x1") >= x0) & (F.col("y0") <= y1) & (F.col("y1") >= y0)
        & (F.col("cloud") <= max_cloud))


RUNNING = object()


def resolve_columns(
    df: DataFrame, wanted: Mapping[str, Sequence[str]], defaults: Mapping[str, object], order: Sequence[str] = ()
) -> DataFrame:
    """The first alias present supplies each wanted column, else its default.

    A default of ``RUNNING`` numbers the rows 1..n in ``order``.
    """
    cols = []
    for name, aliases in wanted.items():
        hit = next((a for a in [name, *aliases] if a in df.columns), None)
        if hit is None and defaults.get(name) is RUNNING:
            df, hit = global_row_number(df, list(order), "_running"), "_running"
        cols.append((F.col(hit) if hit else F.lit(defaults.get(name))).alias(name))
    return df.select(*cols)


def flatten_properties(df: DataFrame, json_col: str, fields: str) -> DataFrame:
    """JSON property text to columns; ``fields`` is a schema such as 'k int, name string'."""
    keep = [c for c in df.columns if c != json_col]
    return df.select(*keep, F.from_json(json_col, fields).alias("p")).select(*keep, "p.*")


def pick_properties(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select(*names)


def flatten_collections(df: DataFrame, array_col: str) -> DataFrame:
    """One row per element of an array of structs."""
    keep = [c for c in df.columns if c != array_col]
    return df.select(*keep, F.explode(array_col).alias("e")).select(*keep, "e.*")


# --- patch files -------------------------------------------------------------------------

_PATCH = "stem string, shape array<int>, data array<float>"


def encode_patch(data: Column, height: Column, width: Column) -> Column:
    """Flat values to the bytes of a float32 .npy file."""

    @pandas_udf(BinaryType())
    def encode(values: pd.Series, heights: pd.Series, widths: pd.Series) -> pd.Series:
        out = []
        for v, h, w in zip(values, heights, widths):
            buf = io.BytesIO()
            np.save(buf, np.asarray(v, dtype=np.float32).reshape(-1, h, w))
            out.append(buf.getvalue())
        return pd.Series(out)

    return encode(data, height, width)


def decode_patches(files: DataFrame) -> DataFrame:
    """(path, content) of .npy files to (stem, shape, flat values); 2-D arrays gain a band axis."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                a = np.load(io.BytesIO(content), allow_pickle=False)
                a = a[None] if a.ndim == 2 else a
                stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                rows.append((stem, list(a.shape), a.astype(np.float32).ravel()))
            yield pd.DataFrame(rows, columns=["stem", "shape", "data"])

    return files.select("path", "content").mapInPandas(decode, _PATCH)


def pair_patches(lr: DataFrame, hr: DataFrame) -> DataFrame:
    """Patches of both resolutions that share a stem."""
    return lr.select("stem", F.col("shape").alias("lr_shape"), F.col("data").alias("lr")).join(
        hr.select("stem", F.col("shape").alias("hr_shape"), F.col("data").alias("hr")), "stem")


def write_patches(patches: DataFrame, folder: str) -> DataFrame:
    """Write each patch to ``folder`` (a URI or path that all executors reach) as ``<stem>.npy``.

    ``patches``: stem, content (bytes).  A file is written under a temporary name and then
    renamed, so a task that is run again replaces it by the same bytes.  Returns one row:
    files, n_bytes; nothing is written before it is read.
    """
    local = folder.startswith(("/", "file:/"))
    target = "file:///" + folder.removeprefix("file:").lstrip("/") if local else folder

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = fs.FileSystem.from_uri(target)
        store.create_dir(path, recursive=True)
        for pdf in batches:
            for stem, content in zip(pdf["stem"], pdf["content"]):
                temporary = f"{path}/.{stem}.{uuid.uuid4().hex}"
                with store.open_output_stream(temporary) as out:
                    out.write(content)
                store.move(temporary, f"{path}/{stem}.npy")
            yield pd.DataFrame({"files": [len(pdf)], "n_bytes": [int(pdf["content"].map(len).sum())]})

    done = patches.select("stem", "content").mapInPandas(write, "files bigint, n_bytes bigint")
    return done.agg(F.sum("files").alias("files"), F.sum("n_bytes").alias("n_bytes"))


def read_patches(spark: SparkSession, lr_dir: str, hr_dir: str) -> DataFrame:
    files = lambda d: spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(d)
    return pair_patches(decode_patches(files(lr_dir)), decode_patches(files(hr_dir)))
