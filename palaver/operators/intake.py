"""Intake of requests: meeting links to platforms, validation, idempotent creation, authentication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from palaver.functions.canonical import canonical_request
from palaver.functions.lookups import PLATFORMS
from palaver.functions.text import non_empty

_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@\s]*@)?([^/?#@:\s]+)(?::[0-9]*)?(/[^?#\s]*)?(?:[?#].*)?$"


def _part(url: Column, group: int) -> Column:
    return F.when(url.rlike(_URL), F.regexp_extract(url, _URL, group))


def web_url(url: Column) -> Column:
    """Whether a text is an absolute http or https URL without white space in host or path."""
    return F.coalesce(F.lower(_part(url, 1)).isin("http", "https"), F.lit(False))


def classify(links: DataFrame, url: str = "meeting_url", override: str = "platform_override") -> DataFrame:
    """links with platform, native_id and error_code; the first rule that matches decides.

    Known hosts come first and no override changes them; a host with a label `meet` or `jitsi` is self-hosted, as is
    any host whose override says so, and its rooms are named room@host. Where a room must be named, the path must be
    one segment. URLs are taken as written: nothing is percent-encoded or converted to punycode.
    """
    u = F.col(url)
    ok = web_url(u)
    host, path = F.lower(_part(u, 2)), F.coalesce(_part(u, 3), F.lit(""))
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    room = F.when(F.size(parts) == 1, F.get(parts, F.lit(0)))
    labels = F.split(host, r"\.")
    digits = non_empty(F.regexp_extract(path, r"/j/([0-9]+)", 1))
    hit = lambda p, native: F.struct(F.lit(p).cast("string").alias("platform"), native.cast("string").alias("native_id"), F.lit(None).cast("string").alias("error_code"))
    miss = lambda e: F.struct(F.lit(None).cast("string").alias("platform"), F.lit(None).cast("string").alias("native_id"), F.lit(e).alias("error_code"))
    none = F.lit(None)
    needs_room = lambda p, native: F.when(room.isNotNull(), hit(p, native)).otherwise(miss("invalid_meeting_url"))
    own = F.array_contains(labels, "jitsi") | F.array_contains(labels, "meet") | F.coalesce(F.col(override) == "jitsi", F.lit(False))
    asked = F.struct(F.col(override).alias("platform"), F.lit(None).cast("string").alias("native_id"), F.lit(None).cast("string").alias("error_code"))
    out = (
        F.when(~ok, miss("invalid_meeting_url"))
        .when(host == "meet.google.com", needs_room("google_meet", room))
        .when((host == "zoom.us") | host.endswith(".zoom.us"), hit("zoom", digits))
        .when(host.isin("teams.microsoft.com", "teams.live.com") | host.endswith(".teams.microsoft.com"), hit("microsoft_teams", none))
        .when(host == "meet.jit.si", needs_room("jitsi", room))
        .when(own, needs_room("jitsi", F.concat(room, F.lit("@"), host)))
        .when(F.coalesce(F.col(override).isin(*PLATFORMS), F.lit(False)), asked)
        .otherwise(miss("unsupported_platform"))
    )
    return links.withColumn("_c", out).select(*links.columns, "_c.platform", "_c.native_id", "_c.error_code")


def gate(classified: DataFrame, enabled: tuple[str, ...]) -> DataFrame:
    """Recognised links of platforms that are not enabled get unsupported_platform; adds accepted."""
    off = F.col("platform").isNotNull() & ~F.col("platform").isin(*enabled)
    out = classified.withColumn("error_code", F.when(off, F.lit("unsupported_platform")).otherwise(F.col("error_code")))
    return out.withColumn("accepted", F.col("error_code").isNull())


def validate(requests: DataFrame, body: str = "body") -> DataFrame:
    """requests (JSON text in `body`) with error_code, the first check that fails, or null; and the fields as strings."""
    v = F.try_parse_json(F.col(body))
    rows = requests.withColumn("_v", v)
    field = lambda k: F.try_variant_get("_v", f"$.{k}", "string")
    kind = lambda k: F.schema_of_variant(F.try_variant_get("_v", f"$.{k}", "variant"))
    is_object = F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False))
    given = lambda k: kind(k).isNotNull() & (kind(k) != "VOID")
    not_text = lambda k: given(k) & (kind(k) != "STRING")
    code = (
        F.when(~is_object, F.lit("invalid_request"))
        .when(not_text("meeting_url"), F.lit("invalid_request"))
        .when(non_empty(field("meeting_url")).isNull(), F.lit("invalid_meeting_url"))
        .when(not_text("platform"), F.lit("invalid_request"))
        .when(non_empty(field("platform")).isNotNull() & ~field("platform").isin(*PLATFORMS), F.lit("unsupported_platform"))
        .when(not_text("webhook_url"), F.lit("invalid_request"))
        .when(non_empty(field("webhook_url")).isNotNull() & ~web_url(field("webhook_url")), F.lit("invalid_request"))
        .when(kind("metadata").isNotNull() & ~kind("metadata").startswith("OBJECT"), F.lit("invalid_request"))
        .when(not_text("bot_name") | not_text("language"), F.lit("invalid_request"))
    )
    return rows.withColumns({"error_code": code, "meeting_url": field("meeting_url"), "platform": field("platform")}).drop("_v")


def canonical_hash(body: Column) -> Column:
    """SHA-256 of a request's accepted fields in canonical form, so that equal requests have equal hashes however they are
    written; of the text itself if it is no request, and null for null."""
    return F.sha2(F.coalesce(canonical_request(body), body), 256)


def resolve_creates(requests: DataFrame) -> DataFrame:
    """Create requests (seq, project_id, idempotency_key, body) with outcome created, replayed or conflict, and the seq
    of the request that created the meeting. Requests without a key always create. The first of a key wins; it is a
    partial aggregate joined back, so a key that many requests share is split by AQE."""
    rows = requests.withColumn("_hash", canonical_hash(F.col("body")))
    keyed = rows.filter(F.col("idempotency_key").isNotNull())
    first = keyed.groupBy("project_id", "idempotency_key").agg(F.min(F.struct("seq", "_hash")).alias("_f"))
    out = rows.join(first, ["project_id", "idempotency_key"], "left")
    what = F.when(F.col("_f").isNull() | (F.col("_f.seq") == F.col("seq")), F.lit("created")).when(F.col("_f._hash").eqNullSafe(F.col("_hash")), F.lit("replayed")).otherwise(F.lit("conflict"))
    return out.select("seq", "project_id", "idempotency_key", what.alias("outcome"), F.when(what != "conflict", F.coalesce("_f.seq", "seq")).alias("created_seq"))


def insert_new(existing: DataFrame, rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Insert or do nothing: existing with the first of each new key; keys with a null never collide."""
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    first = rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(order))).filter(null | (F.col("_n") == 1)).drop("_n")
    return existing.unionByName(first.filter(~null).join(existing.select(*keys), keys, "left_anti").select(*existing.columns)).unionByName(first.filter(null).select(*existing.columns))


def authenticate(calls: DataFrame, keys: DataFrame, prefix: str = "sk_") -> DataFrame:
    """calls (authorization header) joined with keys (key_hash, project_id); error_code unauthorized if none matches.

    The header is split at single blanks: a scheme, `bearer` in any case, then the key, which begins with `prefix`."""
    said = F.split("authorization", " ")
    token = F.when((F.lower(F.get(said, F.lit(0))) == "bearer") & F.get(said, F.lit(1)).startswith(prefix), F.get(said, F.lit(1)))
    out = calls.withColumn("key_hash", F.sha2(token, 256)).join(keys, "key_hash", "left").drop("key_hash")
    return out.withColumn("error_code", F.when(F.col("project_id").isNull(), F.lit("unauthorized")))
