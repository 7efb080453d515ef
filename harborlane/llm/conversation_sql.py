"""SQL for the repair of conversations: dynamic programming over the turns."""

from __future__ import annotations


def _step(value: str, edit: str, cost: str) -> str:
    cost = f"lpad((substr({value}, 1, 9)::bigint + {cost})::varchar, 9, '0')"
    return f"{cost} || substr({value}, 10) || '{edit}'"


def _least(*values: str) -> str:
    return f"least({', '.join(values)})"


def _insert(value: str) -> str:
    return _step(value, "I", "3")


def _delete(value: str) -> str:
    return _step(value, "D", "4")


def _keep(value: str, kind: str) -> str:
    return f"case when kind = '{kind}' and not gone then {_step(value, 'K', 'more')} end"


def _rename(value: str) -> str:
    return f"case when not gone then {_step(value, 'R', '(3 + more)')} end"


def _inserted(source: str) -> str:
    """The states after up to two insertions; a third only comes back to a state it costs more in."""
    user = _least("v2", _insert("v0"), _insert("v1"), _insert("v3"))
    assistant = _least("v3", _insert("v2"))
    return f"""
        (select *, {_least('b2', _insert('b3'))} as c2, {_least('b3', _insert('b2'))} as c3
         from (select *, {user} as b2, {assistant} as b3 from {source}))"""


def repair_sql() -> str:
    """A state's value is nine digits of cost followed by the audit, so that the least text is the
    cheapest audit, and of those the first. States: v0 nothing written yet, v1 a system turn, v2 a
    user turn, v3 an assistant turn."""
    bits = "list_transform(range(8), lambda j: (ascii(ch) >> j) & 1)"
    user = _least(
        _delete("c2"), _rename("v0"), _rename("v1"), _rename("c3"),
        _keep("v0", "u"), _keep("v1", "u"), _keep("c3", "u"),
    )
    assistant = _least(_delete("c3"), _rename("c2"), _keep("c2", "a"))
    here = """(select w.conv_id, t.i, t.kind, t.gone, t.more, w.v0, w.v1, w.v2, w.v3
               from walk w join turns t
                 on w.conv_id is not distinct from t.conv_id and t.i = w.i + 1)"""
    last = """(select conv_id, v0, v1, v2, v3 from walk
               qualify row_number() over (partition by conv_id order by i desc) = 1)"""
    return f"""
        with recursive keyed as (
            select *, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as name
            from conversations
        ), hit as (
            select *, xor(list_reduce(
                list_prepend(4294967295::bigint, flatten(list_transform(
                    string_split(name, ''), lambda ch: {bits}))),
                lambda c, b: xor(c >> 1, 3988292384::bigint * (xor(c, b) & 1))),
                4294967295::bigint) % 20 as k
            from keyed
        ), damaged as (
            select conv_id, turn,
                   coalesce(case when k = 4 then 'user' else role end, ' ') as role,
                   case k when 1 then '' when 2 then translate(coalesce(text, ' '), '.!?', '')
                   else coalesce(text, ' ') end as text,
                   unnest(range(case k when 0 then 0 when 3 then 2 else 1 end)) as copy
            from hit
        ), placed as (
            select *, substr(role, 1, 1) as kind,
                   trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as bare,
                   row_number() over w as i,
                   lag(substr(role, 1, 1)) over w as before
            from damaged
            window w as (partition by conv_id
                         order by turn nulls first, role, substr(text, 1, 64), md5(text))
        ), judged as (
            select *, bare = '' as blank, bare <> '' and again as duplicate,
                   bare <> '' and not again and right(bare, 1) not in ('.', '!', '?') as cut
            from (select *, row_number() over (partition by conv_id, role, text order by i) > 1
                            as again
                  from placed)
        ), turns as (
            select *, blank or duplicate as gone, case when cut then 3 else 0 end as more
            from judged
        ), walk as (
            select conv_id, 0::bigint as i, '000000000' as v0, null::varchar as v1,
                   null::varchar as v2, null::varchar as v3
            from (select distinct conv_id from conversations)
            union all
            select conv_id, i, {_delete('v0')}, {_least(_delete('v1'), _keep('v0', 's'))},
                   {user}, {assistant}
            from {_inserted(here)}
        ), ended as (
            select conv_id, {_least('v0', 'c3')} as best from {_inserted(last)}
        ), edits as (
            select conv_id, edit, place, count(*) filter (where edit <> 'I') over w as i,
                   count(*) filter (where edit <> 'D') over w as n
            from (select conv_id, unnest(string_split(substr(best, 10), '')) as edit,
                         generate_subscripts(string_split(substr(best, 10), ''), 1) as place
                  from ended where length(best) > 9)
            window w as (partition by conv_id order by place)
        ), written as (
            select e.*, t.role, t.text,
                   max(case when n = 1 and edit = 'K' and kind = 's' then 1 else 0 end)
                   over (partition by e.conv_id) as system
            from edits e left join turns t
              on e.conv_id is not distinct from t.conv_id and e.i = t.i and edit <> 'I'
            where edit <> 'D'
        ), repaired as (
            select conv_id, string_agg(
                case edit when 'K' then role
                     else case when (n - system) % 2 = 1 then 'user' else 'assistant' end end
                || ':' || case edit when 'I' then '' else text end, chr(10) order by place) as body
            from written group by conv_id
        ), counts as (
            select conv_id,
                   coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
                   count(*) filter (where blank) as blank,
                   count(*) filter (where duplicate) as duplicate,
                   count(*) filter (where cut) as truncated,
                   count(*) filter (where before || kind not in ('su', 'ua', 'au')) as illegal
            from turns group by conv_id
        )
        select ended.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank,
               coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
               coalesce(illegal, 0) as illegal, substr(best, 1, 9)::bigint as cost,
               substr(best, 10) as audit, sha256(coalesce(body, '')) as repaired_sha256
        from ended
        left join counts on ended.conv_id is not distinct from counts.conv_id
        left join repaired on ended.conv_id is not distinct from repaired.conv_id
    """
