"""Session defaults; on a cluster the submit command's own settings win."""

from pyspark.sql import SparkSession

# Values only for keys the launcher left unset.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Small files still give a split per core; large ones are cut by size as usual.
    "spark.sql.files.openCostInBytes": "1m",
    # Call-site capture per column expression makes wide expressions slow to build.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: str = "8", memory: str = "12g", partitions: int = 8, name: str = "brevis") -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
