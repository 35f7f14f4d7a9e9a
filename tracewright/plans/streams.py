"""Registered queries that run a stream to its end over files made from the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources import formats
from ..sources.scratch import scratch_dir
from ..streaming import ledger
from .files import access_files
from .registry import query
from .tables import table

LIMIT, SECONDS = 260, 172_800


@query(f"""
    with recursive acts as (
        select user_id, epoch_us(ts) as tm, event_id as seq, case event_type when 'purchase' then 'commit' when 'error' then 'release' else 'reserve' end as action,
            case when event_type in ('purchase', 'error') then lag(event_id) over (partition by user_id order by ts, event_id) else event_id end as req,
            case when event_id % 50 = 0 then null when event_id % 31 = 0 then {LIMIT} + 1 else event_id % 90 + 1 end as tokens,
            row_number() over (partition by user_id order by ts, event_id) as k
        from events
    ), run as (
        select distinct user_id, 0::bigint as k, null::bigint as seq, ''::varchar as action, ''::varchar as outcome, 0::bigint as used, []::struct(tm bigint, req bigint, n bigint, done boolean)[] as held from events
        union all
        select user_id, k, seq, action, outcome,
            (used + case outcome when 'granted' then tokens when 'committed' then case when mine.tm > tm - {SECONDS}000000 then coalesce(tokens, mine.n) - mine.n else 0 end
                when 'released' then case when mine.tm > tm - {SECONDS}000000 then -mine.n else 0 end else 0 end)::bigint,
            case outcome when 'granted' then list_append(h, {{'tm': tm, 'req': req, 'n': tokens, 'done': false}})
                when 'committed' then list_transform(h, lambda x: case when x.req = req then {{'tm': x.tm, 'req': x.req, 'n': coalesce(tokens, x.n), 'done': true}} else x end)
                when 'released' then list_filter(h, lambda x: x.req <> req) else h end
        from (select *, case when action = 'reserve' then case when tokens is null then 'invalid' when tokens > {LIMIT} then 'over_limit' when tokens > {LIMIT} - used then 'refused' else 'granted' end
                when mine is null then 'unknown' when action = 'commit' then 'committed' else 'released' end as outcome
            from (select *, coalesce(list_sum(list_transform(list_filter(h, lambda x: x.tm > tm - {SECONDS}000000), lambda x: x.n)), 0)::bigint as used, list_filter(h, lambda x: x.req = req and not x.done)[1] as mine
                from (select a.*, list_filter(r.held, lambda x: x.tm > a.tm - 2 * {SECONDS}000000) as h from run r join acts a on a.user_id = r.user_id and a.k = r.k + 1)))
    )
    select seq as event_id, action, outcome, used from run where k > 0
""")
def q_token_ledger(spark, d):
    """Events as reservations and settlements of the event before, through the streaming ledger; late rows come in a second batch."""
    at = f"{scratch_dir(spark)}/ledger-{uuid.uuid4().hex}"
    e = table(spark, d, "events").withColumn("account", F.col("user_id").cast("string"))
    before = F.lag("event_id").over(Window.partitionBy("account").orderBy("ts", "event_id"))
    action = F.when(F.col("event_type") == "purchase", "commit").when(F.col("event_type") == "error", "release").otherwise("reserve")
    tokens = F.when(F.col("event_id") % 50 == 0, None).when(F.col("event_id") % 31 == 0, LIMIT + 1).otherwise(F.col("event_id") % 90 + 1)
    rows = e.select("account", F.to_utc_timestamp("ts", "UTC").alias("at"), F.col("event_id").alias("seq"), action.alias("action"), F.when(action == "reserve", F.col("event_id")).otherwise(before).cast("string").alias("request_id"), tokens.alias("tokens"))
    late = F.col("seq") % 5 == 0
    rows.where(~late).write.parquet(f"{at}/in")
    closing = rows.agg((F.max("at") + F.expr("interval 90 days")).alias("at")).select(F.lit("").alias("account"), "at", F.lit(0).cast("long").alias("seq"), F.lit("end").alias("action"), F.lit("").alias("request_id"), F.lit(1).cast("long").alias("tokens"))
    rows.where(late).write.mode("append").parquet(f"{at}/in")
    closing.write.mode("append").parquet(f"{at}/in")
    kept = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ledger.STORE)
    try:
        stream = spark.readStream.schema(rows.schema).parquet(f"{at}/in")
        out = ledger.token_ledger(stream, LIMIT, SECONDS, "60 days").writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start()
        out.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", kept)
    return spark.read.schema(ledger.RESULT).parquet(f"{at}/out").where("account <> ''").select(F.col("seq").alias("event_id"), "action", "outcome", "used")


@query("""
    select case when event_id % 11 = 0 then null when event_type = 'error' then '500' when event_type = 'purchase' then '201' else '200' end as status, count(*) as lines,
        sum(case when event_id % 11 = 0 then null else event_id end)::bigint as ids from events group by 1
""")
def q_log_stream(spark, d):
    """The same logs followed as a stream until all that is there has been read."""
    formats.register(spark)
    at, out = access_files(spark, d), f"{scratch_dir(spark)}/log-stream-{uuid.uuid4().hex}"
    stream = spark.readStream.format(formats.NAME).option("kind", "access").option("rangeBytes", 1 << 18).load(at)
    rows = stream.select("status", F.regexp_extract("target", r"id=(\d+)$", 1).alias("id"))
    rows.writeStream.format("parquet").option("path", f"{out}/out").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema("status string, id string").parquet(f"{out}/out")
    return got.groupBy("status").agg(F.count("*").alias("lines"), F.sum(F.expr("try_cast(id as long)")).alias("ids"))
