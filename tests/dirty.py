"""The smallest tables made worse: rows of nulls only, repeated rows, empty and very long texts, further columns; or no rows at all."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = "telemetry incident_meta human_actions verifier_output action_catalog model_registry log_sources documents eval_items mix_targets".split()


def write(spark, small, target, empty):
    for name in TABLES:
        df = spark.read.parquet(f"{small}/{name}.parquet")
        if empty:
            df = df.limit(0)
        else:
            texts = [f.name for f in df.schema if f.dataType == T.StringType()]
            one = df.limit(1)
            nulls = one.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema])
            blank = one.withColumns({t: F.lit("") for t in texts})
            long = one.withColumns({t: F.repeat(F.lit("wörd {[x "), F.lit(3000)) for t in texts if t in ("text", "raw", "timestamp", "event_type")})
            df = df.unionByName(nulls).unionByName(nulls).unionByName(blank).unionByName(long).unionByName(one)
            df = df.withColumns({c: F.lit("clash") for c in ("instant_us", "actor", "n", "value", "words") if c not in df.columns})
        df.coalesce(1).write.parquet(f"{target}/{name}.parquet")
    return str(target)
