"""Detection tables derived from the driver's `events`, for the checked queries.

The three statements read the same in Spark and DuckDB: a user is a video, the
rank of an event is a frame. They are fixed definitions of test data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FX_FRAMES = "select user_id as video_id, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as int) as frame, event_id, event_type, ts from events"

FX_VEHICLES = """with s as (
  select f.*, t.slot, cast(f.event_id % 1000 as int) as e from fx_frames f
  cross join (select 0 as slot union all select 1 union all select 2) t
  where not (f.video_id % 3 = 0 and f.frame between 20 and 54)),
b as (
  select video_id, frame, slot as ord, e, event_type,
    case when slot = 1 then 2 when slot = 2 then 5 when e % 13 = 0 then 7 else 3 end as cls,
    60 + 600*slot + (frame*6) % 180 + e % 5 as x1,
    300 + 20*slot + (frame*3) % 90 as y1,
    case when e % 17 = 0 then 60 else 150 + 60*slot end as w,
    case when e % 17 = 0 then 80 else 260 - 30*slot end as h,
    cast(20 + (e*7 + slot*11) % 75 as double) / cast(100 as double) as conf
  from s where (e + slot*3) % 7 <> 0),
d as (
  select video_id, frame, ord + 3 as ord, e, event_type, cls, x1 + 10 as x1, y1 + 8 as y1, w - 20 as w, h - 60 as h, cast(conf * 100 - 10 as double) / cast(100 as double) as conf
  from b where e % 9 = 0 and w > 100)
select video_id, frame, ord, cls, x1, y1, x1 + w as x2, y1 + h as y2, conf from (select * from b union all select * from d) u"""

FX_PLATES = """with f as (select video_id, frame, event_type, cast(event_id % 1000 as int) as e from fx_frames),
j as (
  select v.video_id, v.frame, v.ord, v.x1 as vx, v.y1 as vy, v.x2 - v.x1 as w, v.y2 - v.y1 as h, f.e, f.event_type
  from fx_vehicles v join f on f.video_id = v.video_id and f.frame = v.frame where v.ord < 3 and (f.e + v.ord) % 4 <> 0),
a as (
  select video_id, frame, ord as pord, vx + cast(floor(w / 3) as int) as x1, vy + cast(floor(h / 2) as int) as y1,
    case when e % 11 = 0 then 14 else 40 end as w, case when e % 11 = 0 then 11 else 36 end as h,
    cast(10 + (e*3 + ord*7) % 80 as double) / cast(100 as double) as conf,
    case when event_type = 'error' then 'sahi' when ord = 0 and e % 2 = 0 then 'crop_moto' else 'crop' end as src
  from j),
n as (select a.video_id, a.frame, pord + 10 as pord, x1 + 4 as x1, y1 + 3 as y1, w - 10 as w, h - 8 as h, cast(conf * 100 + 5 as double) / cast(100 as double) as conf, src
      from a join f on f.video_id = a.video_id and f.frame = a.frame where f.e % 5 = 0 and w > 20),
o as (select j.video_id, j.frame, ord + 20 as pord, vx + 2 as x1, vy + 2 as y1, 50 as w, 44 as h, cast(22 as double) / cast(100 as double) as conf, 'crop' as src from j where e % 6 = 0 and w > 100),
z as (select video_id, frame, 30 as pord, 2500 as x1, 40 as y1, 30 as w, 20 as h, cast(90 as double) / cast(100 as double) as conf, 'crop' as src from f where e % 19 = 0),
u as (select * from a union all select * from n union all select * from o union all select * from z)
select video_id, frame, pord, x1, y1, x1 + w as x2, y1 + h as y2, conf, src from u"""

#: The tables as leading common table expressions of a statement, each worked out once.
CTE = f"with fx_frames as materialized ({FX_FRAMES}), fx_vehicles as materialized ({FX_VEHICLES}), fx_plates as materialized ({FX_PLATES})"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    found = spark.sql(f"with events as (select * from {{events}}), fx_frames as ({FX_FRAMES}), fx_vehicles as ({FX_VEHICLES}), fx_plates as ({FX_PLATES}) select * from {name}", events=events)
    return found.withColumn("video_id", found["video_id"].cast("long"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "fx_frames")


def vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "fx_vehicles")


def plates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "fx_plates")
