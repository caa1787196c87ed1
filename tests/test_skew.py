"""A value holding a third of the rows must not land in one task."""

from pyspark.sql import functions as F

from cloudsift.operators import palette as PL
from cloudsift.operators import profile as PF
from cloudsift.roles import BINDING_ROLES as R

SKEW_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.shuffle.partitions": "16",
}


def test_hot_value_palette_join_is_split(spark):
    old = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    for k, v in SKEW_CONF.items():
        spark.conf.set(k, v)
    try:
        n = 30000
        rows = spark.range(n).select(
            F.col("id").alias("row_idx"),
            F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("g"), (F.col("id") % 997).cast("string")))
            .alias("gene"))
        pal = PL.build_palette(PF.attribute_domain(rows, R, ("gene",)), "gene")
        out = PL.palette_join(rows, "gene", pal, max_broadcast_rows=0)  # force the shuffle path
        assert len(out.collect()) == n  # runs this plan, so AQE finalises it
        final = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in final and "skew=true" in final, final[:2000]
        hot = out.where(F.col("gene") == "hot").select("r", "g", "b").distinct().count()
        assert hot == 1
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
