"""Landed snapshots of the capture provider: one JSON document per meeting and poll, read with a fixed schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MEDIA = "array<struct<id:bigint,type:string,format:string,is_final:boolean,storage_path:string,file_size_bytes:bigint,duration_seconds:double>>"
#: The fields that operators use; others in a document are ignored.
SNAPSHOT_DDL = f"""id bigint, platform string, native_meeting_id string, constructed_meeting_url string, status string, completion_reason string,
start_time string, end_time string, recordings array<struct<id:bigint,meeting_id:bigint,status:string,created_at:string,media_files:{_MEDIA}>>,
data struct<stop_requested:boolean,completion_reason:string,segments_captured:int,status_transition:array<struct<`from`:string,`to`:string,source:string,timestamp:string,completion_reason:string>>>,
segments array<struct<start:double,`end`:double,text:string,language:string,speaker:string,completed:boolean,segment_id:string>>"""


def read_snapshots(spark: SparkSession, path: str, *, stream: bool = False, most_files: int = 1000) -> DataFrame:
    """Snapshots under a path, one document per line; a line that isn't one has only `_corrupt`. polled_at is when its file
    was landed."""
    reader = spark.readStream.option("maxFilesPerTrigger", most_files) if stream else spark.read
    return reader.schema(SNAPSHOT_DDL + ", _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path).select("*", F.col("_metadata.file_modification_time").alias("polled_at"))


def segments_of(snapshots: DataFrame) -> DataFrame:
    """Segments in order of arrival (ord), as operators.segments takes them; the time of day is cut to milliseconds."""
    from palaver.functions.text import epoch_seconds

    rows = snapshots.select(F.col("id").alias("meeting_id"), epoch_seconds(F.col("start_time")).alias("start_time"), F.posexplode("segments").alias("ord", "s"))
    return rows.select("meeting_id", F.col("ord").cast("long"), "s.start", "s.end", "s.speaker", "s.text", "s.language", "s.completed", "s.segment_id", "start_time")


def completion_reason(nested: Column, top: Column) -> Column:
    """The nested reason counts first."""
    return F.coalesce(nested, top)


def status_changes(snapshots: DataFrame) -> DataFrame:
    """Statuses that the provider reports, mapped: meeting_id, seq, ts, target_status, and polled_at if snapshots have it.
    Each snapshot repeats its meeting's whole list."""
    from palaver.functions.lookups import capture_status

    polled = [c for c in ("polled_at",) if c in snapshots.columns]
    rows = snapshots.select(F.col("id").alias("meeting_id"), *polled, F.posexplode("data.status_transition").alias("seq", "t"))
    return rows.select("meeting_id", F.col("seq").cast("long"), F.try_to_timestamp("t.timestamp").alias("ts"), capture_status(F.col("t.to")).alias("target_status"), *polled)


def recordings_of(snapshots: DataFrame) -> DataFrame:
    """Recordings that belong to their snapshot's meeting: recording_id, meeting_id, pos (place in its list), media_type,
    raw_url (of its first sound file), size_bytes, meeting_duration_s."""
    from palaver.functions.text import epoch_seconds

    took = epoch_seconds(F.col("end_time")) - epoch_seconds(F.col("start_time"))
    rows = snapshots.select(F.col("id").alias("meeting_id"), took.alias("meeting_duration_s"), F.posexplode("recordings").alias("pos", "r")).filter(F.col("r.meeting_id") == F.col("meeting_id"))
    sound = F.filter("r.media_files", lambda f: f["type"] == "audio")
    kind = F.when(F.size(F.coalesce(sound, F.array().cast(_MEDIA))) > 0, F.lit("audio")).otherwise(F.lit("video"))
    return rows.select(F.col("r.id").alias("recording_id"), "meeting_id", "pos", kind.alias("media_type"), F.get(sound, F.lit(0))["storage_path"].alias("raw_url"), F.aggregate(F.coalesce(sound, F.array().cast(_MEDIA)), F.lit(0).cast("long"), lambda a, f: a + F.coalesce(f["file_size_bytes"], F.lit(0))).alias("size_bytes"), "meeting_duration_s")
