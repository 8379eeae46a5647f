"""Test tables in the shapes that the operators take, as plain SQL that Spark and DuckDB both run.

`{conversations}` and the like stand for the stored tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("conversations", "documents", "embeddings", "events", "pages")
VIEWS = {
    "segments_raw": """
with b as (
  select conv_id, turn, role, text, length(text)*60 as len_ms, (turn*37 % 11)*150 as gap_ms,
         cast(floor(turn/2.0) as bigint) as half
  from {conversations}),
t as (
  select *, sum(len_ms+gap_ms) over (partition by conv_id order by turn rows between unbounded preceding and current row) as en from b),
r as (
  select conv_id as meeting_id, turn as ord,
    case when (conv_id+half)%4=0 then 'Alice' when (conv_id+half)%4=1 then 'Bob' when (conv_id+half)%4=2 then null else ' ' end as speaker,
    case when turn%6=5 then '  ' else text end as text,
    case when conv_id%3=1 then 'en' when conv_id%3=2 then '' else null end as language,
    case when (conv_id+turn)%7=0 then false when (conv_id+turn)%3=0 then null else true end as completed,
    case when conv_id%11=0 and turn%4=3 then null
         else concat('turn:', cast(half as varchar(20)), ':', case when conv_id%3=0 and turn%2=0 then 'p0' else cast(turn%2 as varchar(20)) end) end as segment_id,
    cast(1704067200000 + en - len_ms as double)/1000 as start_epoch,
    cast(1704067200000 + en as double)/1000 as end_epoch,
    case when conv_id%4=3 then null when conv_id%4=2 then cast(1704067260 as double) else cast(1704067196107 as double)/1000 end as start_time_epoch
  from t)
select * from r
union all
select meeting_id, ord+1000, speaker, concat(text,' (revised)'), language, true, segment_id, start_epoch, end_epoch, start_time_epoch
from r where meeting_id%5=0 and ord%4=1 and segment_id is not null
""",
    "lifecycle_events": """
select concat(cast(user_id as varchar(20)), '-', cast(cast(floor(extract(day from ts)/5.0) as bigint) as varchar(20))) as meeting_id,
  event_id as seq, ts,
  case event_type when 'signup' then 'joining' when 'view' then 'waiting_for_admission' when 'click' then 'in_progress'
       when 'purchase' then case when event_id%3=1 then 'completed' else 'processing' end
       else case when event_id%5=0 then 'failed' when event_id%5=1 then 'cancelled' else 'joining' end end as target_status
from {events}
""",
    "meeting_urls": """
select page_id,
  case page_id%10
    when 0 then concat('https://meet.google.com/abc-', cast(page_id as varchar(20)))
    when 1 then concat('https://us02web.zoom.us/j/84', cast(page_id as varchar(20)), '?pwd=abc')
    when 2 then 'https://zoom.us/my/room'
    when 3 then concat('https://teams.microsoft.com/l/meetup-join/', cast(page_id as varchar(20)), '/0')
    when 4 then concat('https://meet.jit.si/Room', cast(page_id as varchar(20)))
    when 5 then concat('https://Jitsi.example.org/Room', cast(page_id as varchar(20)), '/')
    when 6 then 'https://meet.example.org/a/b'
    when 7 then 'not a url'
    when 8 then 'ftp://meet.example.org/room'
    else url end as meeting_url,
  case when page_id%20=19 then 'jitsi' when page_id%20=9 then 'zoom' else null end as platform_override
from {pages}
""",
    "create_requests": """
select event_id as seq, ts, user_id%5 as project_id,
  case when event_id%5=0 then null else concat(cast(user_id%100 as varchar(20)), ':', cast(event_id%3 as varchar(20))) end as idempotency_key,
  case event_id%9
    when 0 then '{{"meeting_url": "https://a.example/r", "metadata": {{"n": 100, "b": {{"y": 1, "x": [1, 0.5]}}}}}}'
    when 1 then '{{"metadata":{{"b":{{"x":[1.0,5e-1],"y":1}},"n":1e2}},"meeting_url":"https://a.example/r"}}'
    when 2 then '{{"meeting_url": "https://b.example", "meeting_url": "https://a.example/r", "metadata": {{"n": 1, "n": 100, "b": {{"y": 1, "x": [1, 0.5]}}}}}}'
    when 3 then '{{"meeting_url": "https://a.example/r", "bot_name": null, "other": 5, "metadata": {{"n": 100, "b": {{"y": 1, "x": [1, 0.5]}}}}}}'
    when 4 then '{{"meeting_url": "https://a.example/r", "metadata": {{"n": 100, "b": {{"y": 1, "x": [0.5, 1]}}}}}}'
    when 5 then '{{"meeting_url": "https://a.example/r", "bot_name": ""}}'
    when 6 then 'no json'
    when 7 then null
    else concat('{{"meeting_url": "https://a.example/', cast(user_id%3 as varchar(20)), '"}}') end as body
from {events}
""",
    "delivery_attempts": """
select cast(floor(event_id/6.0) as bigint) as delivery_id, event_id%6 + 1 as attempt, ts as attempted_at,
  case event_type when 'error' then 500 when 'view' then null when 'click' then 404 when 'signup' then 503 else 204 end as response_code
from {events}
""",
    "recordings": """
select doc_id as recording_id, doc_id%100 as meeting_id, doc_id*37%1000003 as pos, case when doc_id%13=0 then null else concat('file:', cast(doc_id as varchar(20))) end as raw_url, case when doc_id%7=0 then 'video' else 'audio' end as media_type,
  n_chars as size_bytes, case when doc_id%9=0 then null else cast(doc_id%40 as double) end as meeting_duration_s
from {documents}
""",
    "provider_results": """
select conv_id as meeting_id, turn + 1 as turn_idx, case when (conv_id*7+turn*3)%10 < 6 then 'ok' when (conv_id*7+turn*3)%10 < 8 then 'http_4xx' else 'unavailable' end as outcome,
  case when (conv_id*7+turn*3)%10 < 6 then upper(role) else null end as result_text, case when (conv_id*7+turn*3)%10 < 8 then 1 + turn%2 else 3 end as attempts
from {conversations}
""",
    "signal_windows": """
select vec_id as recording_id, label, embedding as samples from {embeddings}
""",
}


def text(name: str, **tables: str) -> str:
    """SQL of a view; tables go by their own names unless given others."""
    return VIEWS[name].format(**({t: t for t in TABLES} | tables))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(text(name, **{t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}))
