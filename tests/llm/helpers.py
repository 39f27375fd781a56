from pyspark.sql.types import LongType, StringType, StructField, StructType

DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType())])
PROSE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree near the quiet river bend".split()


def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def clash(df, *names):
    """The frame with extra columns of names the operator itself uses."""
    from pyspark.sql import functions as F
    for n in names:
        if n not in df.columns:
            df = df.withColumn(n, F.lit("extra"))
    return df
