"""The conversation repair in SQL: damage, faults, and a pass over each conversation's rows that keeps the least (cost, audit) of every state."""


def _add(x: str, cost: str, letter: str) -> str:
    """A state's value is six digits of cost, then the audit; text order is the order of (cost, audit)."""
    return f"(lpad(cast(cast(left({x}, 6) as int) + {cost} as varchar), 6, '0') || substr({x}, 7) || '{letter}')"


def _step() -> str:
    """The four states after a row: v[1] nothing yet, v[2] system, v[3] user, v[4] assistant; e[1] initial, e[2] fault."""
    price, never = "case e[2] when 't' then 3 else 0 end", "'900000'"

    def kept(role: str, x: str) -> str:
        rerole = _add(x, f"3 + {price}", "R") if role in "ua" else never
        return f"case when e[2] in ('b', 'd') then {never} when e[1] = '{role}' then {_add(x, price, 'K')} else {rerole} end"

    gone = [_add(f"v[{i}]", "4", "D") for i in range(1, 5)]
    return f"[{gone[0]}, least({gone[1]}, {kept('s', 'v[1]')}), least({gone[2]}, {', '.join(kept('u', f'v[{i}]') for i in (1, 2, 4))}), least({gone[3]}, {kept('a', 'v[3]')})]"


def _closed(states: str) -> str:
    """The states after turns inserted there; two are enough, since two lead back to where they began."""
    user = "least(v[3], " + ", ".join(_add(f"v[{i}]", "3", "I") for i in (1, 2, 4)) + ")"
    done = f"least(v[4], {_add('v[3]', '3', 'I')})"
    return f"list_transform(list_transform([{states}], lambda v: [v[1], v[2], {user}, v[4]]), lambda v: [v[1], v[2], v[3], {done}])[1]"


OP11_SQL = rf"""
with crc_table as (select list(c order by n) t from (select n, list_reduce(list_prepend(n, list_transform(range(8), lambda i: cast(0 as bigint))), lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) c from range(256) r(n))),
keyed as (select conv_id, turn, coalesce(role, ' ') role, coalesce(text, ' ') txt, coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') k from conversations),
coded as (select conv_id, turn, role, txt, xor(list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(range(1, length(k) + 1), lambda i: cast(ascii(substr(k, i, 1)) as bigint))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 code from keyed, crc_table),
damaged as (select conv_id, turn, case when code = 4 then 'user' else role end role, case code when 1 then '' when 2 then regexp_replace(txt, '[.!?]', '', 'g') else txt end txt, unnest(range(case code when 3 then 2 else 1 end)) cp from coded where code <> 0),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, txt, cp) pos, row_number() over (partition by conv_id, role, txt order by turn nulls first, cp) nth from damaged),
judged as (select *, left(role, 1) ini, case when not regexp_matches(txt, '[^\x20\x09-\x0D]') then 'b' when nth > 1 then 'd' when not regexp_matches(txt, '[.!?][\x20\x09-\x0D]*\z') then 't' else 'n' end fault, lag(left(role, 1)) over (partition by conv_id order by pos) before from placed),
folded as (select conv_id, cast(coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as bigint) gaps, count(*) filter (fault = 'b') blank, count(*) filter (fault = 'd') dup, count(*) filter (fault = 't') truncated,
  count(*) filter (before is not null and before || ini not in ('su', 'ua', 'au')) illegal, list([ini, fault] order by pos) rows_ from judged group by conv_id),
solved as (select conv_id, list_reduce(list_prepend({_closed("['000000', '900000', '900000', '900000']")}, rows_), lambda v, e: {_closed(_step())}) v from folded),
best as (select conv_id, least(v[1], v[4]) b from solved),
audits as (select conv_id, cast(left(b, 6) as bigint) cost, substr(b, 7) audit from best),
letters as (select conv_id, i, substr(audit, i, 1) e, length(replace(substr(audit, 1, i), 'I', '')) pos, length(replace(audit, 'D', '')) % 2 odd from (select conv_id, audit, unnest(range(1, length(audit) + 1)) i from audits)),
kept as (select *, row_number() over (partition by conv_id order by i) place from letters where e <> 'D'),
lines as (select k.conv_id, k.place, case when e = 'K' then role when (k.place - k.odd) % 2 = 1 then 'user' else 'assistant' end || ':' || case when e = 'I' then '' else txt end line
  from kept k left join placed p on k.conv_id is not distinct from p.conv_id and k.pos = p.pos and e <> 'I'),
texts as (select conv_id, string_agg(line, chr(10) order by place) body from lines group by conv_id)
select o.conv_id, coalesce(gaps, 0) gaps, coalesce(blank, 0) blank, coalesce(dup, 0) duplicate, coalesce(truncated, 0) truncated, coalesce(illegal, 0) illegal, coalesce(cost, 0) cost, coalesce(audit, '') audit, sha256(coalesce(body, '')) repaired_sha256
from (select distinct conv_id from conversations) o left join folded f on o.conv_id is not distinct from f.conv_id left join audits a on o.conv_id is not distinct from a.conv_id left join texts t on o.conv_id is not distinct from t.conv_id
"""
