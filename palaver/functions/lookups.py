"""The statuses, codes and schedules that results depend on, each in one place."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STATUS_RANK = {"queued": 0, "joining": 1, "waiting_for_admission": 2, "in_progress": 3, "processing": 4, "completed": 5, "failed": 5, "cancelled": 5}
TERMINAL = ("completed", "failed", "cancelled")
PLATFORMS = ("google_meet", "zoom", "microsoft_teams", "jitsi")
CAPTURE_STATUS = {
    "requested": "joining", "joining": "joining", "awaiting_admission": "waiting_for_admission", "needs_help": "waiting_for_admission",
    "needs_human_help": "waiting_for_admission", "active": "in_progress", "stopping": "processing", "completed": "processing", "failed": "failed",
}
FAILURE_CODE = {
    "awaiting_admission_timeout": "waiting_room_timeout", "awaiting_admission_rejected": "meeting_join_failed", "join_failure": "meeting_join_failed",
    "auth_session_missing": "meeting_join_failed", "validation_error": "meeting_join_failed", "evicted": "bot_removed", "left_alone": "meeting_ended",
    "startup_alone": "meeting_ended", "max_bot_time_exceeded": "meeting_ended", "stopped_with_no_audio": "capture_failed", "stopped_before_admission": "capture_failed",
}
#: What clients are told of a failure, by its reason; the provider's own words are not passed on.
FAILURE_MESSAGE = {
    "awaiting_admission_timeout": "The bot was not admitted to the meeting in time.", "awaiting_admission_rejected": "The bot could not join the meeting.", "join_failure": "The bot could not join the meeting.",
    "auth_session_missing": "The bot could not join the meeting.", "validation_error": "The bot could not join the meeting.", "evicted": "The bot was removed from the meeting.",
    "left_alone": "The meeting ended before a transcript could be captured.", "startup_alone": "The meeting ended before a transcript could be captured.", "max_bot_time_exceeded": "The meeting ended before a transcript could be captured.",
    "stopped_with_no_audio": "No audio was captured for this meeting.", "stopped_before_admission": "No audio was captured for this meeting.",
}
CAPTURE_FAILED = "Meeting capture failed."
INTERNAL = "An internal error occurred"
ERROR_TYPE = {
    "invalid_meeting_url": "invalid_request_error", "unsupported_platform": "invalid_request_error", "invalid_request": "invalid_request_error",
    "idempotency_conflict": "invalid_request_error", "unauthorized": "authentication_error", "meeting_not_found": "not_found_error",
    "meeting_join_failed": "meeting_join_failed", "waiting_room_timeout": "meeting_join_failed", "bot_removed": "capture_error", "meeting_ended": "capture_error",
    "capture_failed": "capture_error", "transcription_failed": "transcription_error", "provider_timeout": "provider_error",
    "provider_unavailable": "provider_error", "internal_error": "internal_error",
}
HTTP_STATUS = {
    "invalid_meeting_url": 400, "unsupported_platform": 400, "invalid_request": 400, "unauthorized": 401, "meeting_not_found": 404,
    "idempotency_conflict": 409, "provider_unavailable": 503, "provider_timeout": 504,
}
CAPTURE_PLATFORM = {"microsoft_teams": "teams"}
#: Seconds to wait before attempts 1 to 5 of a delivery.
DELIVERY_DELAYS = (0, 60, 300, 1800, 7200)
RETRYABLE = ("provider_unavailable", "provider_timeout")
MOST_ATTEMPTS = 3
JOIN_DEADLINE_S = 600
#: Seconds to wait before a meeting is finalized again, times the attempts so far.
FINALIZE_RETRY_S = 30


def lookup(table: dict, key: Column, otherwise=None) -> Column:
    """A literal map applied to a column; `otherwise` for keys that it lacks and for null."""
    found = F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.coalesce(key, F.lit("")))
    return found if otherwise is None else F.coalesce(found, F.lit(otherwise))


def capture_status(c: Column) -> Column:
    return lookup(CAPTURE_STATUS, c, "joining")


def failure_code(c: Column) -> Column:
    return lookup(FAILURE_CODE, c, "capture_failed")


def failure_message(c: Column) -> Column:
    return lookup(FAILURE_MESSAGE, c, CAPTURE_FAILED)


def error_type(c: Column) -> Column:
    return lookup(ERROR_TYPE, c)


def http_status(c: Column) -> Column:
    return lookup(HTTP_STATUS, c, 500)


def dispatch_error(code: Column, http: Column) -> Column:
    """Why a bot could not be sent: a typed error keeps its code, a conflict means it can't join, the rest is an outage."""
    return F.coalesce(code, F.when(http == 409, F.lit("meeting_join_failed")).otherwise(F.lit("provider_unavailable")))


def provider_error(http: Column, timed_out: Column) -> Column:
    """Code of a provider call: null if it went well; a null status is a network failure."""
    return (
        F.when(timed_out, F.lit("provider_timeout"))
        .when(http.isNull() | (http >= 500) | (http == 429), F.lit("provider_unavailable"))
        .when((http < 200) | (http >= 300), F.lit("transcription_failed"))
    )


def call_delay_ms(attempt: Column) -> Column:
    """Wait after the attempt-th failed call; null after the last."""
    return F.when(attempt < MOST_ATTEMPTS, F.lit(250) * F.pow(F.lit(4), attempt - 1).cast("int"))


def start_delay_ms(attempt: Column) -> Column:
    """Wait after the attempt-th failure to send a bot."""
    return F.when(attempt < MOST_ATTEMPTS, (1000 * attempt).cast("int"))


def finalize_delay_ms(attempt: Column) -> Column:
    """Wait after the attempt-th failure to finalize a meeting."""
    return F.when(attempt < MOST_ATTEMPTS, (1000 * FINALIZE_RETRY_S * attempt).cast("int"))


def retryable_fetch(code: Column, http: Column) -> Column:
    """Whether fetching a recording may work later."""
    return F.coalesce(code.isin(*RETRYABLE), F.lit(False)) | F.coalesce((http >= 500) | http.isin(404, 429), F.lit(False))
