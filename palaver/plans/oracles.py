"""DuckDB forms of the queries, written from the rules and not from the operators, to hold results against."""

from __future__ import annotations

import re

from palaver.sources.views import text

_TRIM = r"regexp_replace({0}, '^[\s\x0B\p{{Z}}\x{{FEFF}}]+|[\s\x0B\p{{Z}}\x{{FEFF}}]+$', '', 'g')"


def _trim(c: str) -> str:
    return _TRIM.format(c)


def _r3(c: str) -> str:
    return f"floor(({c}) * 1000 + 0.5) / 1000"


# Requests, reasons, capture statuses and endings as both engines make them.
REQUESTS = """
select page_id, case page_id % 13
  when 0 then '[1]' when 1 then 'nope' when 2 then '{{"platform": "zoom"}}' when 3 then '{{"meeting_url": 5}}'
  when 4 then '{{"meeting_url": "https://meet.example.org/r", "platform": "other"}}'
  when 5 then '{{"meeting_url": "https://meet.example.org/r", "webhook_url": "ftp://x/y"}}'
  when 6 then '{{"meeting_url": "https://meet.example.org/r", "metadata": [1]}}'
  when 7 then '{{"meeting_url": "https://meet.example.org/r", "metadata": null}}'
  when 8 then '{{"meeting_url": "https://meet.example.org/r", "bot_name": 3}}'
  when 9 then '{{"meeting_url": "https://meet.example.org/r", "webhook_url": "https://x.example/y", "metadata": {{"a": 1}}}}'
  when 10 then '{{"meeting_url": "", "bot_name": 3}}' when 11 then '{{"meeting_url": null}}'
  else concat('{{"meeting_url": "', url, '", "platform": null}}') end as body
from {pages}"""
REASONS = """
select event_id, case event_id % 13 when 0 then 'awaiting_admission_timeout' when 1 then 'awaiting_admission_rejected' when 2 then 'join_failure'
  when 3 then 'auth_session_missing' when 4 then 'validation_error' when 5 then 'evicted' when 6 then 'left_alone' when 7 then 'startup_alone'
  when 8 then 'max_bot_time_exceeded' when 9 then 'stopped_with_no_audio' when 10 then 'stopped_before_admission' when 11 then 'stopped' end as reason
from {events}"""
CAPTURES = """
select event_id, case event_id % 11 when 0 then 'requested' when 1 then 'joining' when 2 then 'awaiting_admission' when 3 then 'needs_help'
  when 4 then 'needs_human_help' when 5 then 'active' when 6 then 'stopping' when 7 then 'completed' when 8 then 'failed' when 9 then 'odd' end as capture_status,
  case event_id % 4 when 0 then 'google_meet' when 1 then 'zoom' when 2 then 'microsoft_teams' else 'jitsi' end as platform
from {events}"""
ENDED = """
select event_id, case when event_id % 7 = 0 then 'native' else 'batch' end as provider, event_id % 2 = 0 as live_words, user_id % 3 as attempts,
  case when event_id % 5 = 0 then null when event_id % 5 = 1 then 'evicted' when event_id % 5 = 2 then 'left_alone' else 'stopped' end as reason,
  case event_type when 'view' then 'usable' when 'click' then 'usable' when 'signup' then 'none' when 'error' then 'provider_unavailable'
    else case event_id % 5 when 0 then 'http_404' when 1 then 'http_403' when 2 then 'http_503' when 3 then 'http_429' else 'capture_failed' end end as audio,
  case user_id % 8 when 0 then 'ok' when 1 then 'ok' when 2 then 'provider_timeout' when 3 then 'provider_unavailable' when 4 then 'undecodable'
    when 5 then 'turns_failed' when 6 then 'capture_failed' else 'transcription_failed' end as result,
  case when event_id % 3 = 0 then '  ' else 'words' end as result_text
from {events}"""

_CTE = {n: text(n) for n in ("segments_raw", "lifecycle_events", "meeting_urls", "create_requests", "delivery_attempts", "recordings", "provider_results", "signal_windows")}
_ID = r"'^turn:(\d+):(p?)(\d+)$'"
_CTE["live"] = f"""
select *, nullif(segment_id, '') as sid, case when regexp_matches(nullif(segment_id, ''), {_ID}) then regexp_extract(segment_id, {_ID}, 1) end as turn_of,
  case when regexp_matches(nullif(segment_id, ''), {_ID}) then regexp_extract(segment_id, {_ID}, 2) end as draft
from segments_raw where completed is not false"""
_CTE["deduped"] = """
select l.*, row_number() over (partition by l.meeting_id order by l.sid is not null, coalesce(k.first_ord, l.ord)) - 1 as pos
from live l left join (select meeting_id, sid, min(ord) as first_ord, max(ord) as last_ord from live where sid is not null group by all) k
  on k.meeting_id = l.meeting_id and k.sid = l.sid
where (l.sid is null or l.ord = k.last_ord)
  and not (l.draft is not null and l.draft = 'p' and exists (select 1 from live c where c.meeting_id = l.meeting_id and c.turn_of = l.turn_of and c.draft = ''))"""
_CTE["relative"] = f"""
select d.*, {_r3("greatest(0, start_epoch - o.origin)")} as start_s, {_r3("greatest(0, end_epoch - o.origin)")} as end_s
from deduped d join (select meeting_id, case when max(start_time_epoch) <= min(start_epoch) then max(start_time_epoch) else min(start_epoch) end as origin from deduped group by 1) o using (meeting_id)"""
_CTE["spoken"] = f"""
select meeting_id, pos, start_s, end_s, {_trim("text")} as words, coalesce(nullif({_trim("speaker")}, ''), 'Unknown') as speaker_name, language,
  row_number() over (partition by meeting_id order by start_s, end_s, pos) as n
from relative where {_trim("text")} <> ''"""
_CTE["normalized"] = """
select s.meeting_id, s.n, 'seg_' || case when s.n < 1000 then lpad(cast(s.n as varchar), 3, '0') else cast(s.n as varchar) end as id, 'speaker_' || cast(f.k as varchar) as speaker_id,
  s.speaker_name, s.start_s, s.end_s, s.words as text, s.language
from spoken s join (select meeting_id, speaker_name, row_number() over (partition by meeting_id order by min(n)) - 1 as k from spoken group by meeting_id, speaker_name) f using (meeting_id, speaker_name)"""
_CTE["lined"] = f"""
select *, nullif({_trim("speaker")}, '') as who, row_number() over (partition by meeting_id order by start_s, end_s, pos) as i from relative where end_s >= start_s"""
# A turn begins where no earlier segment of an unbroken run of the same speaker reaches within the gap.
_CTE["runs"] = """
select *, i - row_number() over (partition by meeting_id, who order by i) as run from lined"""
_CTE["marked"] = """
select *, case when start_s - max(end_s) over (partition by meeting_id, who, run order by i rows between unbounded preceding and 1 preceding) <= 0.75 then 0 else 1 end as new_turn from runs"""
_CTE["numbered"] = """
select *, sum(new_turn) over (partition by meeting_id order by i rows between unbounded preceding and current row) - 1 as turn_no from marked"""
_CTE["turn_rows"] = f"""
select meeting_id, cast(turn_no as bigint) as turn_no, max(who) as speaker, {_r3("min(start_s)")} as start_s, {_r3("max(end_s)")} as end_s,
  coalesce(string_agg({_trim("text")}, ' ' order by i) filter (where {_trim("text")} <> ''), '') as text, arg_min(language, i) filter (where language is not null) as language
from numbered group by meeting_id, turn_no"""
_RANK = "case {0} when 'queued' then 0 when 'joining' then 1 when 'waiting_for_admission' then 2 when 'in_progress' then 3 when 'processing' then 4 end"
_ENDS = "('completed', 'failed', 'cancelled')"
_CTE["ranked"] = f"""
select *, row_number() over (partition by meeting_id order by ts, seq) as i, {_RANK.format("target_status")} as r from lifecycle_events"""
_CTE["standing"] = """
select *, coalesce(max(r) over (partition by meeting_id order by i rows between unbounded preceding and 1 preceding), 0) as held from ranked"""
_CTE["judged"] = """
select *, case target_status when 'failed' then true when 'cancelled' then held < 3 when 'completed' then held = 4 else r > held end as ok from standing"""
_CTE["moves"] = f"""
select j.meeting_id, j.seq, j.ts, j.target_status as to_status, j.ok and (e.at is null or j.i <= e.at) as accepted,
  case when e.at < j.i then e.how else case j.held when 0 then 'queued' when 1 then 'joining' when 2 then 'waiting_for_admission' when 3 then 'in_progress' else 'processing' end end as from_status, j.i
from judged j left join (select meeting_id, min(i) as at, arg_min(target_status, i) as how from judged where ok and target_status in {_ENDS} group by 1) e using (meeting_id)"""
_CTE["finals"] = f"""
select meeting_id, coalesce(arg_max(to_status, i) filter (where accepted), 'queued') as status, count(*) as n_events, count(*) filter (where accepted) as n_accepted, min(ts) as created_at,
  min(ts) filter (where accepted and to_status = 'in_progress') as started_at, min(ts) filter (where accepted and to_status in ('processing', 'completed', 'failed', 'cancelled')) as ended_at,
  min(ts) filter (where accepted and to_status = 'completed') as completed_at
from moves group by 1"""
_CTE["meetings"] = """
select *, cast(split_part(meeting_id, '-', 1) as bigint) as u, cast(split_part(meeting_id, '-', 1) as bigint) % 5 as project_id,
  case when status = 'failed' and cast(split_part(meeting_id, '-', 1) as bigint) % 3 > 0 then 'capture_failed' end as error_code from finals"""
_CTE["stored"] = """
select meeting_id, 'en' as language, cast(n_events * 1.5 as double) as duration_seconds, case when u % 3 = 0 then 'native' else 'batch' end as provider,
  case when u % 3 = 0 then 'batch' end as fallback_from, case when u % 3 = 0 then 'no_turns' end as fallback_reason
from meetings where status = 'completed' or u % 4 = 0"""
_CTE["endings"] = """
select m.meeting_id, v.seq, v.ts, v.to_status as status, m.error_code, s.provider, s.fallback_from, s.fallback_reason, m.project_id
from moves v join meetings m using (meeting_id) left join stored s using (meeting_id) where v.accepted and v.to_status in ('completed', 'failed')"""
_URL = r"'^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@\s]*@)?([^/?#@:\s]+)(?::[0-9]*)?(/[^?#\s]*)?(?:[?#].*)?$'"
_CTE["parsed"] = f"""
select *, case when regexp_matches(meeting_url, {_URL}) and lower(regexp_extract(meeting_url, {_URL}, 1)) in ('http', 'https') then lower(regexp_extract(meeting_url, {_URL}, 2)) end as host,
  regexp_extract(meeting_url, {_URL}, 3) as path from meeting_urls"""
_CTE["roomed"] = """
select *, case when len(list_filter(string_split(path, '/'), lambda x: x <> '')) = 1 then list_filter(string_split(path, '/'), lambda x: x <> '')[1] end as room from parsed"""
_CTE["branched"] = """
select *, case when host is null then 'bad' when host = 'meet.google.com' then 'google_meet' when host = 'zoom.us' or host like '%.zoom.us' then 'zoom'
  when host in ('teams.microsoft.com', 'teams.live.com') or host like '%.teams.microsoft.com' then 'microsoft_teams' when host = 'meet.jit.si' then 'public'
  when list_contains(string_split(host, '.'), 'jitsi') or list_contains(string_split(host, '.'), 'meet') or platform_override = 'jitsi' then 'own'
  when platform_override in ('google_meet', 'zoom', 'microsoft_teams', 'jitsi') then 'asked' else 'none' end as branch from roomed"""
_CTE["classified"] = """
select page_id,
  case when branch in ('google_meet', 'public', 'own') and room is null then null when branch in ('public', 'own') then 'jitsi' when branch = 'asked' then platform_override
    when branch in ('bad', 'none') then null else branch end as platform,
  case branch when 'google_meet' then room when 'public' then room when 'own' then room || '@' || host when 'zoom' then nullif(regexp_extract(path, '/j/([0-9]+)', 1), '') end as native_id,
  case when branch = 'bad' or (branch in ('google_meet', 'public', 'own') and room is null) then 'invalid_meeting_url' when branch = 'none' then 'unsupported_platform' end as error_code from branched"""
_CTE["attempts_made"] = """
select a.* from delivery_attempts a where attempt <= 5 and not exists
  (select 1 from delivery_attempts b where b.delivery_id = a.delivery_id and b.attempt < a.attempt and b.response_code between 200 and 299)"""
_CTE["scheduled"] = """
select delivery_id, attempt, response_code, case when response_code between 200 and 299 then 'delivered' when attempt = 5 then 'failed' else 'pending' end as status,
  case when response_code between 200 and 299 or attempt = 5 then null
    else attempted_at + case attempt when 1 then interval 60 seconds when 2 then interval 300 seconds when 3 then interval 1800 seconds else interval 7200 seconds end end as next_attempt_at from attempts_made"""
# What a request means: the first four kinds of body are one request, differently written.
_CTE["meant"] = """
select *, case when seq % 9 < 4 then '0' when seq % 9 < 8 then cast(seq % 9 as varchar) else body end as meant from create_requests"""
_CTE["clip_lengths"] = """
select meeting_id, count(*) as turns, cast(greatest(1, floor((max(end_s) - 1.0) * 40)) as bigint) as n from turn_rows group by 1"""
_CTE["clip_rows"] = """
select *, z - a as len, (select sum((i * 37 + meeting_id * 11) % 2001 - 1000) from unnest(range(a, z)) u(i)) as total from (
  select t.*, greatest(0, cast(floor(greatest(0.0, start_s - 0.25) * 40) as bigint)) as a, least(n, cast(ceil(least(n / 40.0::double, end_s + 0.25) * 40) as bigint)) as z
  from turn_rows t join clip_lengths using (meeting_id) where end_s - start_s >= 0.4 and least(n / 40.0::double, end_s + 0.25) > greatest(0.0, start_s - 0.25))"""
_CTE["clip_told"] = f"""
select *, case when len % 7 = 2 then '' when len % 7 > 2 then 'heard ' || len || ' ' || cast(total as bigint) else text end as words, case when len % 7 > 1 and len % 3 = 0 then 'de' else language end as told,
  case len % 7 when 0 then 3 else 1 end as tries, row_number() over (partition by meeting_id order by start_s, end_s, turn_no) as i from clip_rows"""
_CTE["clip_sums"] = f"""
select meeting_id, count(*) as eligible, count(*) filter (where len % 7 < 2) as failed, cast(sum(tries) as bigint) as calls,
  case when count(*) filter (where len % 7 = 0) = count(*) then 'provider_unavailable' when count(*) filter (where len % 7 < 2) * 2 > count(*) then 'turns_failed' else 'ok' end as verdict,
  arg_min(told, i) filter (where nullif(told, '') is not null and {_trim("words")} <> '') as language, max(end_s) filter (where {_trim("words")} <> '') as until, count(*) filter (where {_trim("words")} <> '') as n_segments,
  string_agg(coalesce(speaker, 'Unknown') || ': ' || {_trim("words")}, chr(10) order by i) filter (where {_trim("words")} <> '') as text
from clip_told group by 1"""
_CTE["whole_lengths"] = """
select *, n - 722 * (k - 1) as last_n from (select *, 1 + greatest(0, cast(ceil((n - 800) / 722.0) as bigint)) as k from (
  select meeting_id, 500 + meeting_id % 500 as v, cast(greatest(1, floor(max(end_s) * 40)) as bigint) as n from relative group by 1))"""
_CTE["whole_chunks"] = """
select meeting_id, n, v, i, i * 722 / 40.0::double as a, case when i = k - 1 then n / 40.0::double else (i + 1) * 722 / 40.0::double end as z, case when i = k - 1 then last_n else 722 end as size from (select *, unnest(range(k)) as i from whole_lengths)"""
_CTE["whole_said"] = """
select meeting_id, i, j, a + s as start_s, least(z, a + e) as end_s, a + e as until_s, words from (
  select *, 0 as j, 0.0::double as s, 2.5::double as e, concat('first ', size) as words from whole_chunks where v % 3 = 0
  union all select *, 1, 2.5, 60.0, concat('then ', v) from whole_chunks where v % 3 = 0
  union all select *, 0, 0.0, case when v % 3 = 1 then 5.0 else 7.0 end, concat('heard ', size, ' ', v) from whole_chunks where v % 3 > 0)"""
_CTE["whole_named"] = f"""
select s.*, (select arg_max(r.speaker, (least(s.until_s, r.end_s) - greatest(s.start_s, r.start_s), -r.pos)) from relative r
  where r.meeting_id = s.meeting_id and r.meeting_id % 2 = 0 and nullif(r.speaker, '') is not null and least(s.until_s, r.end_s) - greatest(s.start_s, r.start_s) > 0 and r.end_s > r.start_s) as who from whole_said s"""
_CTE["whole_texts"] = f"""
select meeting_id, count(*) as n_segments, {_r3("max(end_s)")} as until, string_agg(concat(coalesce(nullif({_trim("who")}, ''), 'Unknown'), ': ', words), chr(10) order by start_s, end_s, i, j) as said,
  (select 'de' from whole_chunks c where c.meeting_id = t.meeting_id and size % 3 = 0 limit 1) as told from whole_named t group by 1"""
_ORDER = list(_CTE)
_NEEDS = {n: [m for m in _ORDER if m != n and re.search(rf"\b(from|join) {m}\b", q)] for n, q in _CTE.items()}


def _sql(select: str) -> str:
    """The select with the common tables that it needs, in order."""
    need: set[str] = set()
    todo = [m for m in _ORDER if re.search(rf"\b(from|join) {m}\b", select)]
    while todo:
        n = todo.pop()
        if n not in need:
            need.add(n)
            todo += _NEEDS[n]
    return ("with " + ",\n".join(f"{n} as ({_CTE[n]})" for n in _ORDER if n in need) + "\n" if need else "") + select


_TYPES = """case {0} when 'unauthorized' then 'authentication_error' when 'meeting_not_found' then 'not_found_error' when 'meeting_join_failed' then 'meeting_join_failed'
  when 'waiting_room_timeout' then 'meeting_join_failed' when 'bot_removed' then 'capture_error' when 'meeting_ended' then 'capture_error' when 'capture_failed' then 'capture_error'
  when 'transcription_failed' then 'transcription_error' when 'provider_timeout' then 'provider_error' when 'provider_unavailable' then 'provider_error' when 'internal_error' then 'internal_error'
  else 'invalid_request_error' end"""
_FAIL = """case {0} when 'awaiting_admission_timeout' then 'waiting_room_timeout' when 'awaiting_admission_rejected' then 'meeting_join_failed' when 'join_failure' then 'meeting_join_failed'
  when 'auth_session_missing' then 'meeting_join_failed' when 'validation_error' then 'meeting_join_failed' when 'evicted' then 'bot_removed' when 'left_alone' then 'meeting_ended'
  when 'startup_alone' then 'meeting_ended' when 'max_bot_time_exceeded' then 'meeting_ended' else 'capture_failed' end"""
_ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"
_PAYLOAD = f"""
select meeting_id, 'meeting.' || status as event_type, project_id, ts,
  '{{"id":"' || 'evt_' || left(sha256(meeting_id || '|' || cast(seq as varchar)), 26) || '","type":"meeting.' || status || '","created_at":"' || {_ISO.format("ts")} || '","data":{{"meeting_id":"' || meeting_id || '","status":"' || status || '","metadata":'
  || case when cast(split_part(meeting_id, '-', 1) as bigint) % 2 = 0 then '{{"n":' || split_part(meeting_id, '-', 1) || ',"team":{{"id":"t"}}}}' else '{{}}' end
  || case when status = 'completed' then coalesce(',"transcript_provider":"' || provider || '"', '') || coalesce(',"fallback_from":"' || fallback_from || '","fallback_reason":"' || fallback_reason || '"', '') else '' end
  || case when status = 'failed' and error_code is not null then ',"error":{{"code":"' || error_code || '","message":""}}' else '' end || '}}}}' as payload
from endings"""

_BODIES = REQUESTS.format(pages="pages")
_JT = "json_type(body, '$.{0}')"
_JV = "(body ->> '$.{0}')"


def _not_text(k: str) -> str:
    return f"coalesce({_JT.format(k)} not in ('VARCHAR', 'NULL'), false)"


_D_PARTS = """split_part(d, '|', 1) as action, nullif(split_part(d, '|', 2), '') as error_code, nullif(split_part(d, '|', 3), '') as fallback_reason,
  case when d like 'retry%' then cast(30 * (attempts + 1) as integer) end as retry_s"""


def _decided(ended: str) -> str:
    """Endings with what becomes of them, as text of three parts."""
    return f"""select *, case
  when not live_words and provider = 'batch' and audio not in ('usable', 'none') then case when (audio like 'provider%' or audio in ('http_404', 'http_429', 'http_503')) and attempts < 2 then 'retry||' else 'fail|transcription_failed|' end
  when not live_words and (provider = 'native' or audio = 'none') then 'fail|' || {_FAIL.format("reason")} || '|'
  when result = 'ok' then case when trim(result_text) = '' then 'fail|transcription_failed|' else 'complete||' end
  when result like 'provider%' and attempts < 2 then 'retry||'
  when live_words and provider = 'batch' and audio = 'none' then 'fall_back||no_usable_recording'
  when live_words and provider = 'batch' and result in ('undecodable', 'turns_failed') then 'fall_back||' || result
  when live_words and provider = 'batch' and result like 'provider%' then 'fall_back||provider_unavailable_after_retries'
  when result in ('undecodable', 'turns_failed') or result like 'provider%' then 'fail|transcription_failed|' else 'fail|' || result || '|' end as d from ({ended})"""


#: The sum of squares of the first x samples of a signal of m samples that repeats, and the next cut after sample a.
_UPTO = "(({x}) // m * whole + c[({x}) % m + 1])"
_FROM = "(a + greatest(160, 3200 - 640))"
_CUT = f"""greatest(a + 160, least(a + 3200, 16 + list_reduce(list_transform(range({_FROM}, least(n, a + 3200) - 31, 16), lambda x: {{'x': x, 'e': {_UPTO.format(x="x + 32")} - {_UPTO.format(x="x")}}}), lambda p, q: case when q.e < p.e then q else p end).x))"""


SQL = {
    "segments_deduped": _sql("select meeting_id, pos, ord, segment_id, speaker, text from deduped"),
    "segments_relative": _sql("select meeting_id, pos, start_s, end_s from relative"),
    "segments_normalized": _sql("select * from normalized"),
    "speakers": _sql("select meeting_id, speaker_id, speaker_name, count(*) as n_segments from normalized group by all"),
    "transcripts": _sql(
        f"""select m.meeting_id, coalesce(arg_min(nullif(n.language, ''), n.n) filter (where nullif(n.language, '') is not null), 'en') as language, {_r3("coalesce(max(n.end_s), 0)")} as duration_seconds,
  count(distinct n.speaker_id) as n_speakers, count(n.n) as n_segments, coalesce(string_agg(n.speaker_name || ': ' || n.text, chr(10) order by n.n), '') as text
from (select distinct meeting_id from segments_raw) m left join normalized n using (meeting_id) group by 1"""
    ),
    "turns": _sql("select * from turn_rows"),
    "turns_eligible": _sql(
        """select meeting_id, turn_no, greatest(0.0, start_s - 0.25) as clip_from, least(seconds, end_s + 0.25) as clip_to
from turn_rows join (select meeting_id, max(end_s) - 1 as seconds from turn_rows group by 1) using (meeting_id) where end_s - start_s >= 0.4 and least(seconds, end_s + 0.25) > greatest(0.0, start_s - 0.25)"""
    ),
    "speaker_overlap": _sql(
        """select t.meeting_id, t.turn_no, b.speaker, b.overlap from turn_rows t left join (
  select *, row_number() over (partition by meeting_id, turn_no order by overlap desc, pos) as k from (
    select t.meeting_id, t.turn_no, r.pos, r.speaker, least(t.end_s + 0.5, r.end_s) - greatest(t.start_s + 0.5, r.start_s) as overlap
    from turn_rows t join relative r using (meeting_id) where r.speaker <> '') where overlap > 0) b
on b.meeting_id = t.meeting_id and b.turn_no = t.turn_no and b.k = 1"""
    ),
    "chunk_rebase": """select doc_id as meeting_id, doc_id % 4 * 600.0::double + case when doc_id % 5 > 2 then doc_id % 30 else 0 end as start_s,
  least(doc_id % 4 * 600.0::double + 600, doc_id % 4 * 600.0::double + case doc_id % 5 when 0 then 600 when 1 then n_chars::double / 100 when 2 then 7.0 else doc_id % 30 + n_chars % 700 end) as end_s,
  case when doc_id % 5 > 2 then 'a' else 'b' end as text from documents""",
    "platforms": _sql("select * from classified"),
    "platform_gate": _sql(
        """select page_id, platform, error_code is null and platform in ('jitsi', 'google_meet') as accepted,
  case when platform not in ('jitsi', 'google_meet') then 'unsupported_platform' else error_code end as error_code from classified"""
    ),
    "request_validation": f"""select page_id, case when not json_valid(body) or json_type(body) <> 'OBJECT' then 'invalid_request' when {_not_text("meeting_url")} then 'invalid_request'
  when coalesce({_JV.format("meeting_url")}, '') = '' then 'invalid_meeting_url' when {_not_text("platform")} then 'invalid_request'
  when coalesce({_JV.format("platform")}, '') not in ('', 'google_meet', 'zoom', 'microsoft_teams', 'jitsi') then 'unsupported_platform' when {_not_text("webhook_url")} then 'invalid_request'
  when coalesce({_JV.format("webhook_url")}, '') <> '' and not regexp_matches({_JV.format("webhook_url")}, '^(?i:https?)://[^/?#@:\\s]+') then 'invalid_request'
  when {_JT.format("metadata")} is not null and {_JT.format("metadata")} <> 'OBJECT' then 'invalid_request' when {_not_text("bot_name")} or {_not_text("language")} then 'invalid_request' end as error_code,
  case when json_valid(body) then {_JV.format("meeting_url")} end as meeting_url from (select page_id, case when json_valid(b.body) then b.body else '0' end as body from ({_BODIES}) b)""",
    "idempotency": _sql(
        """select r.seq, r.project_id, case when f.seq is null or f.seq = r.seq then 'created' when f.meant = r.meant then 'replayed' else 'conflict' end as outcome,
  case when f.seq is null then r.seq when f.meant = r.meant then f.seq end as created_seq
from meant r left join (select project_id, idempotency_key, min(seq) as seq, arg_min(meant, seq) as meant from meant where idempotency_key is not null group by 1, 2) f
on f.project_id = r.project_id and f.idempotency_key = r.idempotency_key"""
    ),
    "meeting_inserts": _sql("select seq, project_id, idempotency_key from create_requests qualify idempotency_key is null or row_number() over (partition by project_id, idempotency_key order by seq) = 1"),
    "api_key_auth": """select event_id, case when event_id % 11 not in (0, 2, 3, 5) and user_id % 7 < 5 then user_id % 7 end as project_id, case when event_id % 11 in (0, 2, 3, 5) or user_id % 7 >= 5 then 'unauthorized' end as error_code from events""",
    "lifecycle_transitions": _sql("select meeting_id, seq, from_status, to_status, accepted from moves"),
    "lifecycle_final": _sql("select meeting_id, status, n_events, n_accepted from finals"),
    "lifecycle_timestamps": _sql("select meeting_id, started_at, ended_at, completed_at from finals"),
    "join_deadlines": _sql(
        """select meeting_id, status, case status when 'joining' then 'meeting_join_failed' when 'waiting_for_admission' then 'waiting_room_timeout' end as error_code from (
  select meeting_id, coalesce(arg_max(to_status, i) filter (where accepted and ts <= deadline), 'queued') as status
  from (select *, min(ts) over (partition by meeting_id) + interval 600 seconds as deadline from moves) group by 1)"""
    ),
    "terminal_events": _sql(f"select meeting_id, seq, to_status as status from moves where accepted and to_status in {_ENDS}"),
    "stop_and_recover": _sql(
        f"""select meeting_id, case when status in ('processing', 'completed', 'failed', 'cancelled') then status when status = 'in_progress' then 'processing' else 'cancelled' end as stopped,
  case when status = 'failed' and n_events % 2 = 0 then 'processing' else status end as recovered,
  case when status in ('completed', 'processing') or (status = 'failed' and n_events % 2 = 0) then null else 'invalid_request' end as recover_error from finals"""
    ),
    "failure_codes": f"""select event_id, code as error_code, {_TYPES.format("code")} as error_type, 500 as http_status,
  '{{"error":{{"type":"' || {_TYPES.format("code")} || '","code":"' || code || '","message":"' || case when code = 'waiting_room_timeout' then 'The bot was not admitted to the meeting in time.' when code = 'meeting_join_failed' then 'The bot could not join the meeting.'
    when code = 'bot_removed' then 'The bot was removed from the meeting.' when code = 'meeting_ended' then 'The meeting ended before a transcript could be captured.' when reason in ('stopped_with_no_audio', 'stopped_before_admission') then 'No audio was captured for this meeting.' else 'Meeting capture failed.' end || '"}}}}' as body
  from (select event_id, reason, {_FAIL.format("reason")} as code from ({REASONS.format(events="events")}))""",
    "status_map": f"""select event_id, case when capture_status in ('awaiting_admission', 'needs_help', 'needs_human_help') then 'waiting_for_admission' when capture_status = 'active' then 'in_progress'
  when capture_status in ('stopping', 'completed') then 'processing' when capture_status = 'failed' then 'failed' else 'joining' end as status,
  case platform when 'microsoft_teams' then 'teams' else platform end as capture_platform from ({CAPTURES.format(events="events")})""",
    "call_errors": _sql(
        f"""select delivery_id, attempt, provider_code, dispatch_code, {_TYPES.format("coalesce(provider_code, dispatch_code)")} as error_type,
  case coalesce(provider_code, dispatch_code) when 'unsupported_platform' then 400 when 'provider_unavailable' then 503 when 'provider_timeout' then 504 else 500 end as http_status from (
  select delivery_id, attempt, case when attempt = 6 then 'provider_timeout' when response_code is null or response_code >= 500 or response_code = 429 then 'provider_unavailable' when response_code not between 200 and 299 then 'transcription_failed' end as provider_code,
    case when attempt = 1 then 'unsupported_platform' when response_code = 503 then 'meeting_join_failed' else 'provider_unavailable' end as dispatch_code from delivery_attempts)"""
    ),
    "recording_usable": _sql(
        """select meeting_id, recording_id, size_bytes from recordings where media_type = 'audio' and raw_url is not null and size_bytes > 0 and not coalesce(meeting_duration_s > 5 and size_bytes / meeting_duration_s < 1000, false)
qualify row_number() over (partition by meeting_id order by pos) = 1"""
    ),
    "recording_source": _sql(
        """select meeting_id, recording_id from recordings r where (recording_id % 3 = 0 and meeting_id % 2 = 0) or not exists (select 1 from recordings e where e.meeting_id = r.meeting_id and e.recording_id % 3 = 0 and e.meeting_id % 2 = 0)"""
    ),
    "provider_outcome": _sql(
        """select *, case when unavailable = eligible then 'provider_unavailable' when failed * 2 > eligible then 'turns_failed' else 'ok' end as outcome from (
  select meeting_id, count(*) as eligible, count(*) filter (where outcome = 'ok') as transcribed, count(*) filter (where outcome <> 'ok') as failed, count(*) filter (where outcome = 'unavailable') as unavailable from provider_results group by 1)"""
    ),
    "result_merge": _sql(
        """select t.meeting_id, t.turn_no, case when p.turn_idx is null then t.text else coalesce(p.result_text, '') end as text, p.turn_idx is not null as from_provider
from (select *, row_number() over (partition by meeting_id order by turn_no) as k from turn_rows join (select meeting_id, max(end_s) - 1 as seconds from turn_rows group by 1) using (meeting_id) where end_s - start_s >= 0.4 and least(seconds, end_s + 0.25) > greatest(0.0, start_s - 0.25)) t left join provider_results p on p.meeting_id = t.meeting_id and p.turn_idx = t.k and p.outcome = 'ok'"""
    ),
    "turn_stats": _sql(
        """select meeting_id, turns, turns - coalesce(asked, 0) as skipped_short, coalesce(ok, 0) as transcribed, coalesce(bad, 0) as failed, coalesce(n, 0) as calls from (select meeting_id, count(*) as turns from turn_rows group by 1)
left join (select meeting_id, count(*) as asked from (select *, row_number() over (partition by meeting_id order by turn_no) as k from turn_rows join (select meeting_id, max(end_s) - 1 as seconds from turn_rows group by 1) using (meeting_id) where end_s - start_s >= 0.4 and least(seconds, end_s + 0.25) > greatest(0.0, start_s - 0.25)) group by 1) using (meeting_id)
left join (select meeting_id, count(*) filter (where outcome = 'ok') as ok, count(*) filter (where outcome <> 'ok') as bad, cast(sum(attempts) as bigint) as n from provider_results group by 1) using (meeting_id)"""
    ),
    "finalize_decisions": f"select event_id, {_D_PARTS} from ({_decided(ENDED.format(events='events'))})",
    "finalize_tries": f"""select meeting_id, event_id as seq, cast(k as integer) as attempt, {_D_PARTS} from (select *, coalesce(bool_and(d like 'retry%') over (partition by meeting_id order by event_id rows between unbounded preceding and 1 preceding), true) as waited
  from ({_decided(f"select * exclude (attempts), k - 1 as attempts from (select *, event_id // 4 as meeting_id, row_number() over (partition by event_id // 4 order by event_id) as k from ({ENDED.format(events='events')})) where k <= 3")})) where waited""",
    "webhook_schedule": _sql("select * from scheduled"),
    "webhook_state": _sql("select * from scheduled qualify row_number() over (partition by delivery_id order by attempt desc) = 1"),
    "webhook_events": _sql(f"select meeting_id, event_type, payload from ({_PAYLOAD})"),
    "webhook_outbox": _sql(
        f"""select meeting_id, event_type, 'https://hooks.example.org/' || case u % 3 when 1 then meeting_id else 'all' end as endpoint, payload, 0 as attempt, 'pending' as status, ts as next_attempt_at
from (select *, cast(split_part(meeting_id, '-', 1) as bigint) as u from ({_PAYLOAD})) where u % 3 <> 2"""
    ),
    "delivery_secret_join": _sql("select meeting_id, project_id, sha256('whsec_' || cast(project_id as varchar)) as secret_sha256 from endings where project_id < 4"),
    "meeting_view": _sql(
        f"""select m.meeting_id as id, 'meeting' as object, project_id, status, case when u % 2 = 0 then 'jitsi' else 'zoom' end as platform, 'https://meet.example.org/' || m.meeting_id as meeting_url,
  case when u % 3 > 0 then 'Scribe' end as bot_name, {_ISO.format("started_at")} as bot_joined_at, {_ISO.format("created_at")} as created_at, case when u % 2 = 0 then '{{"n": ' || u || ', "team": {{"id": "t"}}}}' else '{{}}' end as metadata,
  case when status = 'failed' and error_code is not null then case when u % 4 = 0 then 'left the call' else '' end end as error_message, case when status = 'completed' and provider is not null then 'completed' when status = 'processing' then status when status in ('failed', 'cancelled') then 'unavailable' else 'pending' end as transcript_status,
  {_ISO.format("started_at")} as started_at, {_ISO.format("ended_at")} as ended_at, {_ISO.format("completed_at")} as completed_at, case when status = 'completed' then provider end as transcript_provider,
  case when status = 'completed' then fallback_from end as fallback_from, case when status = 'completed' and fallback_from is not null then fallback_reason end as fallback_reason,
  case when status = 'failed' and error_code is not null then 'capture_error' end as error_type, case when status = 'failed' then error_code end as error_code
from meetings m left join stored s using (meeting_id)"""
    ),
    "transcript_view": _sql(
        """select m.meeting_id, project_id, status, case when status in ('failed', 'cancelled') or (status = 'completed' and provider is not null) then 200 else 202 end as http_status,
  case when status = 'completed' then language end as language, case when status = 'completed' then duration_seconds end as duration_seconds, case when status = 'completed' then provider end as provider,
  case when status = 'completed' then fallback_from end as fallback_from, case when status = 'completed' and fallback_from is not null then fallback_reason end as fallback_reason,
  case when status = 'completed' and provider is not null then m.meeting_id || ': yes' end as text, case when status = 'completed' and provider is not null then '2024-02-01T10:00:00.000Z' end as created_at,
  case when status = 'completed' and provider is not null then m.meeting_id end as speaker, case when status = 'completed' and provider is not null then 'seg_001' end as segment_id, case when status = 'completed' then duration_seconds end as segment_end
from meetings m left join stored s using (meeting_id)"""
    ),
    "tenant_lookup": _sql(
        """select project_id, meeting_id, status, null::varchar as error_code from meetings union all select (project_id + 1) % 5, meeting_id, null, 'meeting_not_found' from meetings"""
    ),
    "transcript_upsert": _sql(
        """select meeting_id, case when max(seq) filter (where seq % 2 = 1) is not null then arg_max(target_status, seq) filter (where seq % 2 = 1) else arg_max(target_status, seq) filter (where seq % 2 = 0) end as provider,
  coalesce(max(ts) filter (where seq % 2 = 0), arg_min(ts, seq) filter (where seq % 2 = 1)) as created_at from lifecycle_events group by 1"""
    ),
    "delete_cascade": _sql(
        """select 'meetings' as what, project_id, count(*) as n from meetings where u % 3 <> 1 group by 2 union all select 'transcripts', -1, count(*) from stored join meetings using (meeting_id) where u % 3 <> 1
union all select 'orphans', -1, count(*) from endings join meetings using (meeting_id) where u % 3 = 1"""
    ),
    "health_rollup": """select event_id, case when event_id % 5 = 0 or event_id % 7 = 0 then 'error' when event_id % 3 = 0 then 'degraded' else 'ok' end as status, case when event_id % 5 = 0 or event_id % 7 = 0 then 503 else 200 end as http_status from events""",
    "due_jobs": """select queue, job_id, row_number() over (partition by queue order by run_at nulls first, job_id) as position from (
  select event_type as queue, event_id as job_id, case when event_id % 4 > 0 then ts end as run_at from events) where run_at is null or run_at <= timestamp '2024-01-15 00:00:00'""",
    "rms_dbfs": _sql(
        """select recording_id, cast(len(samples) as bigint) as n_samples, round(20 * log10(sqrt(list_sum(list_transform(samples, lambda x: x::double * x::double)) / len(samples))), 6) as rms_dbfs from signal_windows"""
    ),
}
# Each chunk from the one before, windows of 32 samples 16 apart in the last 2 of 10 seconds at 320 samples a second.
SQL["quiet_chunks"] = f"""with recursive one as (select recording_id, len(s) * 200 as n, s, list_transform(range(len(s) + 1), lambda i: coalesce(list_sum(list_transform(s[1:i], lambda x: x * x)), 0)::bigint) as c
  from (select recording_id, list_transform(samples, lambda x: round(x * 1000)::bigint) as s from ({text("signal_windows")}))),
r as (select recording_id, n, len(s) as m, c, c[len(s) + 1] as whole from one),
k as (select recording_id, 0 as chunk_no, 0::bigint as a, n, m, c, whole, case when n > 3200 then 3200 else n end as z0, n > 3200 as more from r),
cut as (
  select recording_id, chunk_no, a, case when more then {_CUT} else n end as z, n, m, c, whole, more from k
  union all
  select recording_id, chunk_no + 1, z, case when n - z > 3200 then {_CUT.replace("a + ", "z + ")} else n end, n, m, c, whole, n - z > 3200 from cut where more)
select recording_id, cast(chunk_no as bigint) as chunk_no, a / 320.0::double as chunk_from, z / 320.0::double as chunk_to from cut"""
# Clips of 40 samples a second whose lengths and sums a provider answers by.
SQL["transcribe_turns"] = _sql(
    f"""select l.meeting_id, why as outcome, l.turns, case when why in ('undecodable', 'silent_recording') then 0 else coalesce(b.eligible, 0) end as eligible, case when why in ('undecodable', 'silent_recording') then 0 else coalesce(b.failed, 0) end as failed,
  case when why in ('undecodable', 'silent_recording') then 0 else coalesce(b.calls, 0) end as calls, case when why = 'ok' then coalesce(b.language, 'en') end as language,
  case when why = 'ok' then greatest(coalesce(b.until, 0), {_r3("l.n / 40.0::double")}) end as duration_seconds, case when why = 'ok' then coalesce(b.n_segments, 0) else 0 end as n_segments, case when why = 'ok' then coalesce(b.text, '') end as text
from (select *, case when meeting_id % 7 = 0 then 'undecodable' when n < 20 or meeting_id % 7 = 1 then 'silent_recording' else coalesce((select verdict from clip_sums s where s.meeting_id = v.meeting_id), 'no_turns') end as why from clip_lengths v) l left join clip_sums b using (meeting_id)"""
)
# At even loudness the first of all windows is the quietest: chunks of 722 samples until 800 or fewer are left.
SQL["transcribe_whole"] = _sql(
    f"""select meeting_id, outcome, chunks, calls, case when outcome = 'ok' then coalesce(told, 'en') end as language, case when outcome = 'ok' then greatest(until, {_r3("n / 40.0::double")}) end as duration_seconds,
  case when outcome = 'ok' then n_segments else 0 end as n_segments, case when outcome = 'ok' then said end as text
from (
  select meeting_id, n, case when meeting_id % 7 = 0 then 'undecodable' when meeting_id % 7 = 1 or n < 20 then 'silent_recording' when v % 11 = 3 then 'provider_unavailable' when v % 11 = 5 or (v % 11 = 7 and last_n < 722) then 'transcription_failed' else 'ok' end as outcome,
    case when meeting_id % 7 < 2 or n < 20 then 0 else k end as chunks, case when meeting_id % 7 < 2 or n < 20 then 0 when v % 11 = 3 then 3 * least(k, 3) when v % 11 = 5 then least(k, 3) else k end as calls
  from whole_lengths) join whole_texts using (meeting_id)"""
)
SQL["finalize_stream"] = SQL["finalize_tries"]
SQL["snapshot_stream"] = _sql("select cast(split_part(meeting_id, '-', 1)::bigint * 100 + split_part(meeting_id, '-', 2)::bigint as varchar) as meeting_id, status, n_accepted from finals where n_accepted > 0").replace(
    _CTE["lifecycle_events"], f"select * replace (case target_status when 'completed' then 'processing' when 'cancelled' then 'joining' else target_status end as target_status) from ({_CTE['lifecycle_events']})"
)
SQL["poll_stream"] = """select event_id, event_type, http_status, case when http_status is null then case when event_id % 11 = 3 then 'provider_timeout' else 'provider_unavailable' end when http_status = 404 then 'meeting_not_found' when http_status > 299 then 'provider_unavailable' end as error_code,
  http_status is null or http_status in (404, 503) as retryable, case when http_status = 200 and event_id % 5 > 0 then case event_id % 3 when 0 then 'active' when 1 then 'stopping' else 'completed' end end as status, case when http_status = 200 then event_id % 5 = 0 end as corrupt
from (select event_id, event_type, case when event_id % 11 in (3, 7) then null when event_id % 11 = 5 then 503 when event_id % 13 = 4 then 404 when event_id % 17 = 2 then 401 when event_id % 19 = 1 then 204 else 200 end as http_status from events)"""
SQL["turns_by_ranges"] = SQL["turns"]
SQL["segments_by_ranges"] = SQL["segments_normalized"]
SQL["segments_stream"] = SQL["segments_deduped"]
SQL["delivery_stream"] = SQL["webhook_schedule"]
SQL["lifecycle_stream"] = _sql("select meeting_id, status, n_accepted from finals where n_accepted > 0")
SQL["deadline_stream"] = f"""select meeting_id, status as from_status, error_code from ({SQL["join_deadlines"]}) where error_code is not null"""
SQL["transcript_documents"] = _sql(
    """select n.meeting_id, any_value(s.speakers) as speakers, string_agg(n.id || '/' || n.speaker_id || '/' || n.text, chr(10) order by n.n) as segments
from normalized n join (select meeting_id, '[' || string_agg('{"id":"' || speaker_id || '","name":"' || speaker_name || '"}', ',' order by first_n) || ']' as speakers
  from (select meeting_id, speaker_id, speaker_name, min(n) as first_n from normalized group by all) group by 1) s using (meeting_id) group by 1"""
)
SQL["retry_delays"] = _sql(
    """select delivery_id, attempt, case attempt when 1 then 250 when 2 then 1000 end as call_ms, case attempt when 1 then 1000 when 2 then 2000 end as start_ms,
  case attempt when 1 then 30000 when 2 then 60000 end as finalize_ms from delivery_attempts"""
)
SQL["queue_sizes"] = """select event_type as queue, count(*) filter (where event_id % 4 = 0 or ts is null) as ready, count(*) filter (where event_id % 4 > 0 and ts is not null) as delayed from events group by 1"""
# One step of the recursion is one event of every meeting.
_STEP = f"""case when {{0}} in {_ENDS} then {{0}} = 'failed' and {{1}} = 'reopen' when {{1}} = 'reopen' then false when {{1}} = 'stop' then {{0}} <> 'processing' when {{1}} = 'failed' then true
  when {{1}} = 'cancelled' then {_RANK.format("{0}")} < 3 when {{1}} = 'completed' then {{0}} = 'processing' else coalesce({_RANK.format("{1}")} > {_RANK.format("{0}")}, false) end"""
SQL["lifecycle_reopened"] = f"""with recursive e as (select meeting_id, seq, case seq % 9 when 0 then 'reopen' when 4 then 'stop' else target_status end as t, row_number() over (partition by meeting_id order by ts, seq) as i from ({text("lifecycle_events")})),
w as (select meeting_id, i, seq, 'queued' as s, t, {_STEP.format("'queued'", "t")} as ok from e where i = 1
  union all select e.meeting_id, e.i, e.seq, n.s, e.t, {_STEP.format("n.s", "e.t")} from e join (
    select meeting_id, i, case when not ok then s when t = 'reopen' then 'processing' when t = 'stop' then case s when 'in_progress' then 'processing' else 'cancelled' end else t end as s from w) n on e.meeting_id = n.meeting_id and e.i = n.i + 1)
select meeting_id, seq, s as from_status, t as to_status, ok as accepted, ok and t = 'reopen' as error_cleared from w"""
SQL["lifecycle_by_ranges"] = SQL["lifecycle_reopened"]
# HMAC by its definition: the key, padded to 64 bytes with zeros, xor 0x36 (54) before the body and xor 0x5c (92) before that hash.
_PAD = "(list_aggregate(list_transform(string_split(secret, ''), lambda c: chr(xor(ascii(c), {0}))), 'string_agg', '') || repeat(chr({0}), 64 - length(secret)))"
SQL["webhook_signatures"] = _sql(
    f"""select meeting_id, event_type, 'sha256=' || sha256(encode({_PAD.format(92)}) || unhex(sha256({_PAD.format(54)} || payload))) as signature
from (select *, 'whsec_' || cast(project_id as varchar) as secret from ({_PAYLOAD})) where project_id < 4"""
)
SQL["start_retries"] = _sql(
    """select meeting_id, seq, cast(n as integer) as attempt, case when kind = 'again' and n < 3 then 'retry' when kind = 'sent' then kind else 'fail' end as action, case when kind = 'again' and n < 3 then cast(n * 1000 as integer) end as wait_ms,
  case when kind = 'sent' or (kind = 'again' and n < 3) then null when code is not null then code when http = 409 then 'meeting_join_failed' else 'provider_unavailable' end as error_code
from (select *, row_number() over (partition by meeting_id order by seq) as n, min(case when kind <> 'again' then seq end) over (partition by meeting_id) as last from (
  select *, case when code = 'provider_timeout' or (code is null and (http is null or http >= 500)) then 'again' when code is null and http between 200 and 299 then 'sent' else 'no' end as kind from (
    select delivery_id as meeting_id, attempt as seq, response_code as http, case when delivery_id % 7 = 0 then 'unsupported_platform' when delivery_id % 5 = 0 and attempt = 1 then 'provider_timeout' end as code from delivery_attempts)))
where n <= 3 and (last is null or seq <= last)"""
)
