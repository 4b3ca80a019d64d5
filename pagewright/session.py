"""Session defaults of the engine."""

from pyspark.sql import SparkSession


def session(app: str = "pagewright", master: str | None = None, **conf) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    own = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.mapKeyDedupPolicy": "LAST_WIN"}
    for k, v in (own | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()
