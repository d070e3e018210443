"""Tables of rows of megabytes: row groups bounded by bytes, however few rows there are."""

import glob

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from postsift.tables import Tables


def test_row_groups_of_large_rows(spark):
    tables = Tables(spark, "large")
    rows = spark.range(0, 24, 1, 1).select("id", F.concat_ws("", F.transform(F.sequence(F.lit(1), F.lit(15_000)), lambda i: F.sha2(F.concat_ws("-", "id", i), 512))).alias("payload"))
    assert tables.write(rows, "rows", large_rows=True).count() == 24
    groups = [pq.ParquetFile(f).metadata.row_group(i) for f in glob.glob(f"{tables.root}/rows/*.parquet") for i in range(pq.ParquetFile(f).metadata.num_row_groups)]
    assert len(groups) > 1 and max(g.total_byte_size for g in groups) < 40 << 20
