"""The twelve checks of outgoing messages over one table of letters."""

from __future__ import annotations

from docketmill.operators import checks, mail, outgoing
from docketmill.operators.routing import INTERNAL
from docketmill.plans.claims import MARKED, MISSING, STILL
from docketmill.plans.registry import query
from docketmill.plans.views import base

LETTERS = """letters as (select conv_id * 100 + turn as msg_id, concat('u', cast(conv_id % 7 as varchar(10)), '@firm.example') as sender,
 case (conv_id + turn) % 5 when 0 then 'Legal <legal@acme.example>' when 1 then concat('u', cast(conv_id % 7 as varchar(10)), '@gmail.com') when 2 then 'office@strand.example' when 3 then 'legal@northgate.example' end as external,
 case turn % 3 when 0 then 'Agreement (clean).docx' when 1 then 'Lease v2.docx' else 'Agreement final.docx' end as filename, turn % 2 = 0 as tracked, conv_id % 3 = 0 as comments,
 concat(case conv_id % 9 when 0 then 'Please find attached version 3 of the lease.' when 1 then 'Attached is the agreement with Bluewater Ports Limited.' when 2 then 'I removed the exclusivity  period wording.' when 3 then 'Here are Schedules 2-3; Schedule 4 will follow.' when 4 then 'The minutes are attached.' when 5 then 'Enclosed is a clean copy of the agreement and the power of attorney.'
  when 6 then 'The final lease. See attached.' when 7 then 'The exclusivity period was taken out.' else 'Nothing to add.' end, chr(10), 'Regards') as body,
 concat('This agreement is between Acme Mills Limited and Northgate Freight Limited. ', case when conv_id % 4 = 0 then 'The exclusivity period runs for a year. ' else '' end, case when turn % 5 = 0 then 'Internal only. ' when turn % 5 = 1 then 'Privileged and confidential draft. ' else '' end, 'It ends.') as doc from conversations)"""
_kinds = lambda x: "list_filter([" + ", ".join(f"case when regexp_matches(lower({x}), '{p}') then '{k}' end" for k, p in mail.KINDS.items()) + "], lambda k: k is not null)"
ADDRESS = "lower(trim(case when external like '%<%' then regexp_extract(external, '<([^>]+)>', 1) else external end))"
CARRIES = "concat_ws(', ', case when tracked then 'changes' end, case when comments then 'comments' end)"
HANDED = r"(select string_agg(s, ' ') from (select unnest(string_split(regexp_replace(regexp_replace(body, '\s+', ' ', 'g'), '([.!?]) ', '\1' || chr(10), 'g'), chr(10))) as s) where regexp_matches(s, '(?i)\b(?:attach|enclos|find)') and not regexp_matches(s, '(?i)\b(?:will follow|to follow|not yet|later)\b'))"
FOUND = rf"""with {LETTERS}, d as (select msg_id, doc, regexp_replace(split_part({ADDRESS}, '@', 2), '\.[a-z]+$', '') as domain from letters where external is not null and regexp_matches(doc, '{checks.COMPANY}')),
 k as (select msg_id, {_kinds('body')} as said, {_kinds('filename')} as sent, {_kinds(f"coalesce({HANDED}, '')")} as handed from letters),
 v as (select msg_id, try_cast(regexp_extract(lower(body), '\b(?:v|version ?|draft ?)(\d+)\b', 1) as int) as said, try_cast(regexp_extract(lower(filename), '\b(?:v|version ?|draft ?)(\d+)\b', 1) as int) as sent from letters),
 r as (select msg_id, filename, unnest(regexp_extract_all(body, '\bSchedules? (\d+(?:-\d+)?)', 1)) as r from letters), n as (select msg_id, filename, unnest(range(cast(split_part(r, '-', 1) as int), cast(split_part(r, '-', -1) as int) + 1)) as n from r)
 select distinct msg_id, 'another recipient' as kind, domain as note from d where not exists (select 1 from (select unnest(regexp_extract_all(d.doc, '{checks.COMPANY}', 1)) as name) where contains(lower(name), domain))
 union select msg_id, 'claim about file', case when contains(lower(filename), 'final') and regexp_matches(lower(body), '\bversion \d') then 'called final but numbered' else 'promises more' end from letters where (contains(lower(filename), 'final') and regexp_matches(lower(body), '\bversion \d')) or regexp_matches(lower(body), '\bwill follow\b')
 union select msg_id, 'still there', phrase from ({STILL.replace('from notes', 'from letters')}) union select msg_id, 'not clean', carries from ({MARKED.replace('from notes', 'from letters')}) union select msg_id, 'another company', company from ({MISSING.replace('from notes', 'from letters')})
 union select msg_id, 'another kind', concat_ws(' and ', array_to_string(said, ', '), array_to_string(sent, ', ')) from k where len(said) > 0 and len(sent) > 0 and not list_has_any(said, sent)
 union select msg_id, 'companion missing', unnest(list_filter(handed, lambda x: not list_contains(sent, x))) from k where list_has_any(handed, sent)
 union select msg_id, 'own webmail', {ADDRESS} from letters where regexp_matches({ADDRESS}, '@(gmail|outlook|hotmail|yahoo|icloud)\.com$')
 union select msg_id, 'schedule not there', concat('Schedule ', cast(n as varchar)) from n where not contains(lower(filename), concat('schedule ', cast(n as varchar)))
 union select msg_id, 'final but marked', {CARRIES} from letters where (regexp_matches(lower(filename), '{outgoing.CALLED_FINAL}') or regexp_matches(lower(body), '{outgoing.CALLED_FINAL}')) and {CARRIES} <> ''
 union select msg_id, 'another version', concat_ws(' and ', cast(said as varchar), cast(sent as varchar)) from v where said <> sent
 union select msg_id, 'internal marking', unnest(regexp_extract_all(lower(doc), '{INTERNAL}')) from letters where external is not null"""


@query(FOUND)
def outgoing_findings(spark, sf_dir):
    """Every check of every letter."""
    c = base(spark, sf_dir, "conversations")
    letters = spark.sql(f"with {LETTERS.replace('from conversations', 'from {c}')} select * from letters", c=c)
    return outgoing.findings(letters)
