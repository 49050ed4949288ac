"""Event topics: Kafka where its connector is on the classpath, otherwise folders of Parquet files, partitioned by the same keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTITIONS = 10
#: Topic and the column its messages are keyed by.
KEYS = {"delay-events": "route_id", "transfer-impacts": "station_id", "network-predictions": "source_stop_id"}


def has_kafka(spark: SparkSession) -> bool:
    try:
        spark._jvm.java.lang.Class.forName("org.apache.spark.sql.kafka010.KafkaSourceProvider")
        return True
    except Exception:
        return False


def messages(df: DataFrame, key: str) -> DataFrame:
    """(key, value) with the row as JSON."""
    return df.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))


def decoded(stream: DataFrame, schema: str) -> DataFrame:
    """Rows of JSON messages; undecodable messages are skipped."""
    got = stream.select(F.from_json(F.col("value").cast("string"), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("x"))
    return got.where("x is not null").select("x.*").dropna("all")


def create(spark: SparkSession, topic: str, partitions: int = PARTITIONS, replication: int = 1, brokers: str | None = None, folder: str | None = None) -> bool:
    """Make a topic; False where it is there already. In a folder the number of partitions is kept in its properties."""
    if brokers:
        jvm = spark._jvm
        props = jvm.java.util.Properties()
        props.setProperty("bootstrap.servers", brokers)
        admin = jvm.org.apache.kafka.clients.admin.AdminClient.create(props)
        try:
            if admin.listTopics().names().get().contains(topic):
                return False
            made = jvm.org.apache.kafka.clients.admin.NewTopic(topic, partitions, spark._sc._gateway.jvm.java.lang.Short(str(replication)).shortValue())
            admin.createTopics(jvm.java.util.Collections.singleton(made)).all().get()
            return True
        finally:
            admin.close()
    if partition_count(spark, topic, folder) is not None:
        return False
    spark.createDataFrame([(partitions,)], "partitions int").coalesce(1).write.json(f"{folder}/{topic}/_topic")
    return True


def partition_count(spark: SparkSession, topic: str, folder: str) -> int | None:
    """Partitions of a topic's folder; None where it wasn't made."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{topic}/_topic")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return None
    return spark.read.schema("partitions int").json(f"{folder}/{topic}/_topic").first()[0]


def write(df: DataFrame, topic: str, brokers: str | None = None, folder: str | None = None):
    """A batch to a topic: messages of one key go to one partition (in a folder, one of a fixed number of directories)."""
    key, spark = KEYS[topic], df.sparkSession
    if brokers:
        return messages(df, key).write.format("kafka").option("kafka.bootstrap.servers", brokers).option("topic", topic).option("kafka.acks", "1").save()
    create(spark, topic, folder=folder)
    place = F.pmod(F.xxhash64(F.coalesce(F.col(key), F.lit(""))), F.lit(partition_count(spark, topic, folder))).cast("int")
    return df.withColumn("partition", place).write.mode("append").partitionBy("partition").parquet(f"{folder}/{topic}")


def read_stream(spark: SparkSession, topic: str, schema: str, brokers: str | None = None, folder: str | None = None, files_per_trigger: int = 100) -> DataFrame:
    """A topic as a stream, from its newest messages in Kafka or from the start of a folder."""
    if brokers:
        raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", brokers).option("subscribe", topic).option("startingOffsets", "latest").load()
        return decoded(raw, schema)
    return spark.readStream.schema(f"{schema}, partition int").option("maxFilesPerTrigger", files_per_trigger).parquet(f"{folder}/{topic}").drop("partition")
