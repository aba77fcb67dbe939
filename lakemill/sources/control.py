"""Control tables: the work queue and statistics of runs."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakemill.operators.cleaning import dedup_latest


def latest_executions(executions: DataFrame, key: str, time: str, id_: str) -> DataFrame:
    """Each key's latest execution, with the newest time of all of its executions."""
    rows = executions.withColumn("high_water_mark", F.max(time).over(W.partitionBy(key)))
    return dedup_latest(rows, [key], [F.desc(time), F.desc(id_)])


def run_statistics(executions: DataFrame, run: str, app: str, minutes: str) -> DataFrame:
    q = lambda p: F.percentile(minutes, F.lit(p))
    return executions.groupBy(run).agg(
        F.count("*").alias("loads"), F.count_distinct(app).alias("apps"), F.min(minutes).alias("min_minutes"), q(0.25).alias("p25_minutes"),
        F.avg(minutes).alias("avg_minutes"), q(0.75).alias("p75_minutes"), F.max(minutes).alias("max_minutes"),
    )


def boundary_minutes(start: str, end: str) -> Column:
    """Minute boundaries between two times, as SQL's datediff counts them: 1 from :50 to the next minute's :10."""
    minute = lambda c: F.unix_seconds(F.date_trunc("minute", F.col(c).cast("timestamp")))
    return F.try_divide(minute(end) - minute(start), F.lit(60)).cast("long")


def load_run_statistics(executions: DataFrame) -> DataFrame:
    """A run's times, minutes of its executions, volume, apps, empty loads and failures.

    ``executions``: run_id, app_id, execution_start_time, execution_end_time, retrieved, execution_status. Executions
    that haven't ended have no minutes; they count as running, not as failed.
    """
    rows = executions.withColumn("__m", boundary_minutes("execution_start_time", "execution_end_time"))
    status, q = F.col("execution_status"), lambda p: F.percentile("__m", F.lit(p))
    mean = F.avg(F.col("__m").cast("decimal(10,2)")).cast("decimal(10,2)")
    out = rows.groupBy("run_id").agg(
        F.min("execution_start_time").alias("run_start_time"), F.max("execution_end_time").alias("run_end_time"),
        F.min("__m").alias("min_duration"), q(0.25).alias("p25_duration"), mean.alias("avg_duration"), q(0.75).alias("p75_duration"), F.max("__m").alias("max_duration"),
        F.sum("retrieved").alias("retrieved"), F.count_distinct("app_id").alias("processed_apps"),
        F.count_if(status == "empty").alias("empty_loads"), F.count_if(~status.isin("success", "empty", "in-progress")).alias("failed_executions"),
    )
    return out.withColumn("run_duration", boundary_minutes("run_start_time", "run_end_time"))


def work_queue(orchestrator: DataFrame, executions: DataFrame) -> DataFrame:
    """Loads with their priority, last execution, high-water mark and the cursor to go on from.

    Retries come first (-1), then ongoing loads (0), then by priority (1 to 3), completed ones last (99). A failed,
    empty or retried load without a cursor of its own goes on from the last successful one's.
    """
    keys = ["app_id", "execution_type"]
    newest = [F.desc("execution_start_time"), F.desc("execution_id")]
    success = executions.filter("execution_status = 'success'")
    last = dedup_latest(executions, keys, newest).withColumnRenamed("execution_type", "load_type")
    good = dedup_latest(success, keys, newest).select("app_id", F.col("execution_type").alias("load_type"), F.col("execution_id").alias("__good"), F.col("last_retrieved_cursor").alias("__cursor"))
    marks = success.groupBy("app_id").agg(F.max("first_retrieved_timestamp").alias("high_water_mark"))
    rows = orchestrator.join(marks, "app_id", "left").join(last, ["app_id", "load_type"], "left").join(good, ["app_id", "load_type"], "left")
    status, cursor = F.col("load_status"), F.col("last_retrieved_cursor")
    order = F.when(status == "retry", -1).when(F.coalesce("execution_id", "__good").isNotNull() & (status != "completed"), 0).when(status == "completed", 99)
    for n, name in enumerate(("High", "Medium", "Low"), 1):
        order = order.when(F.col("priority") == name, n)
    lost = status.isin("empty", "failed", "retry") & (cursor.isNull() | (cursor == "*")) & F.col("__cursor").isNotNull()
    go_on = F.when(lost, F.col("__cursor")).when(status.isin("completed", "pending"), "*").otherwise(F.coalesce(cursor, F.lit("*")))
    return rows.withColumns({"priority_order": order, "last_retrieved_cursor": go_on, "high_water_mark_date": F.timestamp_seconds("high_water_mark")}).drop("__good", "__cursor")
