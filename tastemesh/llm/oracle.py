"""The queries that SQL can express, for DuckDB, written from their definitions."""

from __future__ import annotations

from tastemesh.llm.url_filter import PATTERN_RULES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower(x: str) -> str:
    return f"translate({x}, '{_UPPER}', '{_LOWER}')"


def _words(text: str, pattern: str = r"[^\x20\x09-\x0D]+", table: str = "documents", key: str = "doc_id") -> str:
    """``rid``, key, ``i``, ``a``: the words of each row."""
    return f"""
rows_of_{table} as (select row_number() over () as rid, * from {table}),
lists_of_{table} as (select rid, {key}, regexp_extract_all({text}, '{pattern}') as ws from rows_of_{table}),
words_of_{table} as (select rid, {key}, unnest(ws) as a, generate_subscripts(ws, 1) as i from lists_of_{table})"""


_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

CONTAMINATION = f"""with {_words(_lower("coalesce(text, '')"), _ALNUM)}, {_words(_lower("coalesce(text, '')"), _ALNUM, "benchmark", "item_id")},
wins as (select distinct item_id, ws[s : s + 9] as win from
    (select item_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 9))) as s from lists_of_benchmark where len(ws) > 0)),
threes as (select rid, i, a, lead(a, 1) over o as b, lead(a, 2) over o as c from words_of_documents window o as (partition by rid order by i)),
begun as (select rid, i, win, item_id from threes join wins on a = win[1] and b = win[2] and c = win[3]
    union all select rid, i, win, item_id from threes join (from wins where len(win) < 3) on a = win[1]),
met as (select rid, i, len(win) as size, item_id from begun join lists_of_documents using (rid) where ws[i : i + len(win) - 1] = win),
hits as (select rid, count(distinct p) as n_hit from (select rid, unnest(generate_series(i, i + size - 1)) as p from met) group by 1),
found as (select rid, count(distinct item_id) as n_items, list_sort(list(distinct cast(item_id as varchar))) as items from met group by 1),
totals as (select a as term, count(*) as total from words_of_documents group by 1),
places as (select item_id, win, unnest(win) as term, generate_subscripts(win, 1) as place from wins),
anchors as (select item_id, win, term from (select *, row_number() over w as nth, count(total) over (partition by item_id, win) as known
    from places left join totals using (term) window w as (partition by item_id, win order by total, place))
    where nth = 1 and known = len(win)),
close as (select distinct rid, item_id from words_of_documents join anchors on a = term join lists_of_documents using (rid)
    where list_has_all(ws[greatest(1, i - 20) : i + 20], win)),
near as (select rid, count(*) as n_near, list_sort(list(cast(item_id as varchar))) as near_items from close group by 1)
select doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
    sha256(coalesce(array_to_string(items, ','), '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated,
    coalesce(n_near, 0) as n_near_items, sha256(coalesce(array_to_string(near_items, ','), '')) as near_sha256
from lists_of_documents left join hits using (rid) left join found using (rid) left join near using (rid)"""

_RULES = {
    "short": "n_words < 10", "repeats": "100 * n_repeat_words > 20 * n_words", "symbols": "10 * n_symbols > n_words",
    "lines": "100 * n_dup_lines > 30 * n_lines",
}
_BY_RULE = " union all ".join(
    f"select source, '{name}' as rule, count(*) as n, cast(count(*) filter ({rule}) as double) as failed from measured group by 1"
    for name, rule in _RULES.items())

QUALITY = f"""with {_words("coalesce(text, '')")},
windows as (select rid, i, a || ' ' || lead(a, 1) over o || ' ' || lead(a, 2) over o || ' ' || lead(a, 3) over o || ' ' || lead(a, 4) over o as x
    from words_of_documents window o as (partition by rid order by i)),
twice as (select rid, i from windows where x is not null qualify count(*) over (partition by rid, x) > 1),
repeats as (select rid, count(distinct p) as n from (select rid, unnest(generate_series(i, i + 4)) as p from twice) group by 1),
lines as (select rid, count(*) as n, count(*) - count(distinct line) as dup
    from (select rid, unnest(string_split(coalesce(text, ''), chr(10))) as line from rows_of_documents)
    where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by 1),
chars as (select rid, cast(sum(length(a)) as bigint) as n from words_of_documents group by 1),
measured as (select d.doc_id, d.source, cast(len(ws) as bigint) as n_words, coalesce(c.n, 0) as word_chars,
        cast(length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
        coalesce(l.n, 0) as n_lines, coalesce(l.dup, 0) as n_dup_lines, coalesce(r.n, 0) as n_repeat_words
    from rows_of_documents d join lists_of_documents using (rid) left join chars c using (rid) left join lines l using (rid)
    left join repeats r using (rid)),
by_rule as ({_BY_RULE}),
corpus as (select rule, sum(n) as docs, count(*) as hosts, sum(failed) / sum(n) as rate from by_rule group by 1),
spread as (select rule, any_value(rate) as rate,
        sum(n * pow(failed / n - rate, 2)) / any_value(docs) - any_value(rate * (1 - rate) * (hosts - 1) / docs) as between_hosts
    from by_rule join corpus using (rule) group by 1),
prior as (select rule, rate, greatest(1.0, least(10000.0, rate * (1 - rate) / greatest(between_hosts, 1e-9) - 1)) as strength from spread),
shrunk as (select source, rule, rate, (failed + strength * rate) / (n + strength) as p, n + strength + 1 as weight
    from by_rule join prior using (rule)),
sure as (select source, rate, p - 2 * sqrt(p * (1 - p) / weight) as low from shrunk),
hosts as (select source, case when max(low) > 0.6 then 'reject' when bool_or(low > 0.2 and low > 2 * rate) then 'strict'
    else 'normal' end as verdict from sure group by 1)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({_RULES["short"]}) or ({_RULES["repeats"]}) as base_failed,
    not (({_RULES["short"]}) or ({_RULES["repeats"]})) and (verdict = 'normal'
        or (verdict = 'strict' and not ({" or ".join(f"({r})" for r in _RULES.values())}))) as kept, verdict
from measured m join hosts h on m.source is not distinct from h.source"""

SUBSTRINGS = f"""with {_words("coalesce(text, '')")},
windows as (select rid, doc_id, i, list(a) over (partition by rid order by i rows between current row and 19 following) as win
    from words_of_documents),
later as (select rid, i from windows where len(win) = 20
    qualify (doc_id, i) > min((doc_id, i)) over (partition by array_to_string(win, ' '))),
gone as (select distinct rid, p as i from (select rid, unnest(generate_series(i, i + 19)) as p from later)),
kept as (select rid, string_agg(a, ' ' order by i) as text from words_of_documents anti join gone using (rid, i) group by 1),
lost as (select rid, count(*) as n from gone group by 1)
select doc_id, cast(len(ws) as bigint) as n_words, coalesce(n, 0) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
from lists_of_documents left join kept using (rid) left join lost using (rid)"""

_HOST_RULES = (("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("net", "/", "block"))
_FITS = [(f"(host = '{h}' or host like '%.{h}') and starts_with(path, '{p}')", h + p, v) for h, p, v in _HOST_RULES]
# The same patterns; DuckDB's expressions cannot look behind.
_PATTERNS = ", ".join(
    "case when regexp_matches(whole, '{}') then '{}' end".format(
        rule.pattern.replace("(?<![a-z0-9])", "(?:^|[^a-z0-9])").replace("(?![a-z0-9])", "(?:$|[^a-z0-9])"), rule.name)
    for rule in PATTERN_RULES)

URLS = f"""with parts as (select page_id, {_lower("coalesce(url, '')")} as whole,
    {_lower(r"regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1)")} as host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) as path from pages),
judged as (select page_id, host, path, case {" ".join(f"when {fit} then '{name}'" for fit, name, _ in _FITS)} end as rule,
    case {" ".join(f"when {fit} then '{verdict}'" for fit, _, verdict in _FITS)} end as ruled, list_min([{_PATTERNS}]) as pattern_rule from parts)
select page_id, host, path, rule, pattern_rule, coalesce(ruled, case when pattern_rule is null then 'allow' else 'block' end) as verdict from judged"""

JACCARD = f"""with recursive {_words(_lower("coalesce(text, '')"))},
shingles as (select distinct rid, array_to_string(ws[s : s + 4], ' ') as x from
    (select rid, ws, unnest(generate_series(1, greatest(1, len(ws) - 4))) as s from lists_of_documents where len(ws) > 0)),
sizes as (select rid, count(*) as n from shingles group by 1),
common as (select a.rid as a, b.rid as b, count(*) as n from shingles a join shingles b on a.x = b.x and a.rid <> b.rid group by 1, 2),
links as (select a, b from common c join sizes x on x.rid = c.a join sizes y on y.rid = c.b where 100 * c.n >= 80 * (x.n + y.n - c.n)),
reach as (select rid as a, rid as b from rows_of_documents union select r.a, l.b from reach r join links l on l.a = r.b),
named as (select r.a as rid, min(d.doc_id) as component_id from reach r join rows_of_documents d on d.rid = r.b group by 1)
select doc_id, coalesce(n, 0) as n_shingles, component_id from rows_of_documents left join sizes using (rid) join named using (rid)"""

# crc32 of ASCII text: the table of its polynomial, then a fold over the characters.
_CRC_TABLE = """crc_table as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))) as crcs)"""


def _crc32(text: str) -> str:
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: cast(ascii(substr({text}, cast(i as int), 1)) as bigint))"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295)"


_WHITE = r"[\x20\x09-\x0D]"
# The best way so far to each state, as cost and letters: nothing yet, after the system turn, a user, an assistant.
_FAR = "{'cost': 1000000000, 'audit': ''}"


def _way(state: str, cost: str, letter: str) -> str:
    return f"{{'cost': {state}.cost + {cost}, 'audit': {state}.audit || '{letter}'}}"


def _best(*ways: str) -> str:
    return f"list_min([{', '.join(ways)}])"


_INSERTED = f"""select *, {_best("s2", _way("s0", "3", "I"), _way("s1", "3", "I"), _way("s3", "3", "I"))} as i2,
    {_best("s3", _way("s2", "3", "I"), _way("s0", "6", "II"), _way("s1", "6", "II"))} as i3"""


def _edit(state: str, cost: str, letter: str, when: str) -> str:
    return f"case when {when} then {_way(state, cost, letter)} else {_FAR} end"


_STAYS = "fault in ('', 'truncated')"
_ROW = {
    "s0": [_way("s0", "4", "D")],
    "s1": [_way("s1", "4", "D"), _edit("s0", "more", "K", f"{_STAYS} and initial = 's'")],
    "s2": [_way("i2", "4", "D"), *(w for s in ("s0", "s1", "i3") for w in (
        _edit(s, "more", "K", f"{_STAYS} and initial = 'u'"), _edit(s, "3 + more", "R", _STAYS)))],
    "s3": [_way("i3", "4", "D"), _edit("i2", "more", "K", f"{_STAYS} and initial = 'a'"), _edit("i2", "3 + more", "R", _STAYS)],
}

REPAIR = f"""with recursive {_CRC_TABLE},
original as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as name from conversations),
marked as (select o.* , {_crc32("name")} % 20 as hurt from original o, crc_table),
damaged as (select conv_id, turn, case when hurt = 4 then 'user' else role end as role,
        case hurt when 1 then '' when 2 then translate(text, '.!?', '') else text end as text,
        unnest(range(case hurt when 0 then 0 when 3 then 2 else 1 end)) as copy from marked),
ordered as (select *, row_number() over (partition by conv_id order by turn nulls first, role, md5(text), copy) as i,
    left(role, 1) as initial, right(regexp_replace(text, '{_WHITE}+$', ''), 1) as final from damaged),
faulty as (select *, case when final = '' then 'blank' when i > min(i) over (partition by conv_id, role, text) then 'duplicate'
        when final not in ('.', '!', '?') then 'truncated' else '' end as fault,
    lag(initial) over (partition by conv_id order by i) as initial_before from ordered),
counts as (select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
        count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
        count(*) filter (fault = 'truncated') as truncated,
        count(*) filter (i > 1 and (initial_before || initial) not in ('su', 'ua', 'au')) as illegal from faulty group by 1),
ways as (select conv_id, cast(0 as bigint) as i, {{'cost': 0, 'audit': ''}} as s0, {_FAR} as s1, {_FAR} as s2, {_FAR} as s3 from counts
    union all
    select conv_id, i, {", ".join(f"{_best(*ways)} as {state}" for state, ways in _ROW.items())} from (
        select w.conv_id, f.i, f.fault, f.initial, case f.fault when 'truncated' then 3 else 0 end as more, w.s0, w.s1, w.i2, w.i3
        from ({_INSERTED} from ways) w join faulty f on f.conv_id is not distinct from w.conv_id and f.i = w.i + 1)),
done as (select w.conv_id, {_best("s0", "i3")} as best from ({_INSERTED} from ways) w join counts c
    on c.conv_id is not distinct from w.conv_id and c.n = w.i),
-- Each letter but an inserted one takes the next row; the letters kept so far alternate.
letters as (select conv_id, best.audit as audit, unnest(range(1, length(best.audit) + 1)) as k from done),
placed as (select conv_id, k, substr(audit, cast(k as int), 1) as letter,
    cast(sum(case when substr(audit, cast(k as int), 1) <> 'I' then 1 else 0 end) over (partition by conv_id order by k) as bigint) as i from letters),
lines as (select p.conv_id, k, letter, f.role, f.text, row_number() over (partition by p.conv_id order by k) as line,
        max(case when letter = 'K' and f.initial = 's' then 1 else 0 end) over (partition by p.conv_id) as lead
    from placed p join (select conv_id, i, role, text, initial from faulty union all
            select distinct conv_id, cast(0 as bigint), null, null, null from faulty) f
        on f.conv_id is not distinct from p.conv_id and f.i = p.i where letter <> 'D'),
repaired as (select conv_id, string_agg(case when letter = 'K' then role || ':' || text
        else (case when (line - lead) % 2 = 1 then 'user:' else 'assistant:' end) || (case letter when 'R' then text else '' end) end,
        chr(10) order by k) as text from lines group by 1)
select o.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
    coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, cast(coalesce(best.cost, 0) as bigint) as cost,
    coalesce(best.audit, '') as audit, sha256(coalesce(r.text, '')) as repaired_sha256
from (select distinct conv_id from conversations) o left join counts c on c.conv_id is not distinct from o.conv_id
left join done d on d.conv_id is not distinct from o.conv_id left join repaired r on r.conv_id is not distinct from o.conv_id"""

TRIE = f"""with {_CRC_TABLE},
turns as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (
        partition by conv_id order by turn nulls first, coalesce(role, ''), md5(coalesce(text, ''))) as pos
    from conversations where conv_id is not null),
ids as (select conv_id, conv_id - conv_id % 100 as base, {_crc32("cast(conv_id as varchar)")} % 6 as h
    from (select distinct conv_id from turns), crc_table),
raw as (select i.conv_id, 0 as part, t.pos, t.role, t.text from ids i join turns t on t.conv_id = i.base and t.pos <= h
    union all select i.conv_id, 1, t.pos, t.role, t.text from ids i join turns t on t.conv_id = i.conv_id and t.pos > h),
placed as (select conv_id, row_number() over o as depth, text, sha256(string_agg(length(role) || ':' || length(text) || ':' || role || text, '|') over o) as path
    from raw window o as (partition by conv_id order by part, pos rows between unbounded preceding and current row)),
spots as (select conv_id, depth, path, length(text) as chars, lag(path, 1, '') over (partition by conv_id order by depth) as parent from placed
    union all select conv_id, 0, '', 0, null from ids),
ended as (select conv_id, arg_max(path, depth) as path from spots group by 1),
ends as (select path, string_agg(cast(conv_id as varchar), ',' order by conv_id) as ids from ended group by 1),
nodes as (select path, any_value(parent) as parent, any_value(depth) as depth, any_value(chars) as chars, min(conv_id) as conv_id, count(*) as n
    from spots group by 1),
kids as (select parent as path, count(*) as n from nodes where parent is not null group by 1),
leaves as (select path from nodes anti join kids using (path)),
under as (select s.path, count(distinct e.path) as n from spots s join ended e using (conv_id) where e.path in (select path from leaves) group by 1),
chain as (select distinct a.path as top, b.path from spots a join spots b on a.conv_id = b.conv_id and b.depth >= a.depth),
saved as (select top as path, sum((n.n - 1) * n.chars) as n from chain c join nodes n on n.path = c.path group by 1)
select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n as n_convs, coalesce(k.n, 0) as n_children, u.n as n_leaves,
    cast(s.n as bigint) as saved_tokens, sha256(coalesce(e.ids, '')) as ends_sha256
from nodes n left join nodes p on p.path = n.parent left join kids k on k.path = n.path join under u on u.path = n.path
join saved s on s.path = n.path left join ends e on e.path = n.path"""

ORACLE: dict[str, str] = {
    "op1_decontamination": CONTAMINATION, "op2_quality_rules": QUALITY, "op6_substring_dedup": SUBSTRINGS, "op7_url_filters": URLS,
    "op8_jaccard_join": JACCARD, "op12_conversation_repair": REPAIR, "op13_prefix_trie": TRIE,
}
