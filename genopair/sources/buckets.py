"""Tables laid out in buckets, so that joins and groups on their keys need no shuffle.

The layout is told by a small file beside the data; a session that opens the table tells Spark's
catalog about it. Parquet alone does not carry buckets.
"""

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession

from genopair.storage import file_size, read_range, write_file

LAYOUT = "_buckets.json"


def write_bucketed(df: DataFrame, path: str, keys: tuple = ("chrom", "variant_idx"), buckets: int | None = None, sort_by: tuple = (), mode: str = "errorifexists") -> None:
    """``df`` in ``buckets`` buckets by ``keys``, one file each, sorted inside by the keys and then ``sort_by``.

    ``buckets`` is the number of shuffle partitions unless given. Rows are shuffled once, here.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = _name(path)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    # repartition deals rows as bucketBy does, so every task holds whole buckets
    dealt = df.repartition(buckets, *keys)
    dealt.write.mode(mode).format("parquet").bucketBy(buckets, *keys).sortBy(*keys, *sort_by).option("path", path).saveAsTable(name)
    layout = {"keys": list(keys), "sort_by": [*keys, *sort_by], "buckets": buckets}
    write_file(f"{path.rstrip('/')}/{LAYOUT}", json.dumps(layout).encode())


def read_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """The table, with its buckets known to Spark."""
    name = _name(path)
    if not spark.catalog.tableExists(name):
        place = f"{path.rstrip('/')}/{LAYOUT}"
        layout = json.loads(read_range(place, 0, file_size(place)))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema.fields)
        quoted = lambda names: ", ".join(f"`{n}`" for n in names)
        spark.sql(
            f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({quoted(layout['keys'])}) SORTED BY ({quoted(layout['sort_by'])}) INTO {layout['buckets']} BUCKETS LOCATION '{path}'"
        )
    return spark.table(name)


def _name(path: str) -> str:
    return "bucketed_" + hashlib.sha256(path.rstrip("/").encode()).hexdigest()[:24]
