"""The same results as SQL for another engine, where SQL can say them."""

from __future__ import annotations

STRENGTH = """
    (select round(1 / least(greatest(coalesce(
        (sum(pow(bad - n * prior, 2)) - sum(n * prior * (1 - prior)))
        / nullif(sum(n * (n - 1) * prior * (1 - prior)), 0), 0.001), 0.001), 0.5) - 1, 6) from {level})
"""

URLS = f"""
    with cut as (
        select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest
        from pages
    ), named as (
        select page_id, regexp_extract(rest, '^[^/?#]*') as raw,
            regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') as path
        from cut
    ), placed as (
        select page_id, path,
            translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host
        from named
    ), outcomes as (
        select doc_id, max(case when quality = 0 or toxic = 1 then 1 else 0 end) as bad
        from labels where doc_id is not null and quality is not null and toxic is not null group by doc_id
    ), counts as (
        select host, count(o.bad) as n, coalesce(sum(o.bad), 0)::bigint as bad
        from placed left join outcomes o on placed.page_id = o.doc_id group by host
    ), split_counts as (
        select *, string_split(host, '.') as labels,
            list_aggregate(list_slice(string_split(host, '.'), -2, -1), 'string_agg', '.') as two
        from counts
    ), levels as (
        select host, n, bad,
            case when len(labels) > 1 and two in ('ac.uk', 'co.jp', 'co.nz', 'co.uk', 'com.au', 'com.br', 'gov.uk', 'org.uk')
                then two else labels[-1] end as suffix,
            case when len(labels) > 2 and two in ('ac.uk', 'co.jp', 'co.nz', 'co.uk', 'com.au', 'com.br', 'gov.uk', 'org.uk')
                then list_aggregate(list_slice(labels, -3, -1), 'string_agg', '.')
                when len(labels) > 1 then two else host end as domain
        from split_counts
    ), suffixes as (
        select suffix, sum(n) as n, sum(bad) as bad,
            (select (sum(bad) + 0.5::double) / (sum(n) + 1) from levels) as prior
        from levels group by suffix
    ), suffix_means as (
        select suffix, (bad + strength * prior) / (n + strength) as mean
        from (select *, {STRENGTH.format(level="suffixes")} as strength from suffixes)
    ), domains as (
        select d.domain, d.n, d.bad, m.mean as prior
        from (select domain, suffix, sum(n) as n, sum(bad) as bad from levels group by domain, suffix) d
        join suffix_means m on d.suffix = m.suffix
    ), domain_means as (
        select domain, (bad + strength * prior) / (n + strength) as mean
        from (select *, {STRENGTH.format(level="domains")} as strength from domains)
    ), hosts as (
        select l.host, l.n, l.bad, m.mean as prior from levels l join domain_means m on l.domain = m.domain
    ), posterior as (
        select host, bad + strength * prior as a, n - bad + strength * (1 - prior) as b
        from (select *, {STRENGTH.format(level="hosts")} as strength from hosts)
    ), bounds as (
        select host, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) as low_bound from posterior
    ), ruled as (
        select p.*, b.low_bound, case
            when (host = 'example.org' or host like '%.example.org') and starts_with(path, '/en/1') then 'example.org/en/1'
            when (host = 'example.org' or host like '%.example.org') and starts_with(path, '/es/') then 'example.org/es/'
            when (host = 'com' or host like '%.com') and starts_with(path, '/fr/') then 'com/fr/'
            when (host = 'com' or host like '%.com') and starts_with(path, '/de/') then 'com/de/'
            when (host = 'org' or host like '%.org') and starts_with(path, '/') then 'org/'
            end as rule
        from placed p join bounds b using (host)
    )
    select page_id, host, path, rule, case
        when rule in ('example.org/en/1', 'example.org/es/', 'com/de/') then 'block'
        when rule is not null then 'allow'
        when low_bound > 0.5 then 'block' else 'allow' end as verdict
    from ruled
"""

PREFERENCES = """
    with turns as (
        select * from conversations where conv_id is not null and turn is not null
    ), last as (
        select conv_id, max({'turn': turn, 'text': text}) as t from turns where role = 'assistant' group by conv_id
    ), ends as (
        select a.conv_id, a.t.turn as last_turn, a.t.text as last_text, b.t.text as other_text
        from last a join last b on b.conv_id = xor(a.conv_id, 1)
    ), before as (
        select e.conv_id, count(t.turn) as n, coalesce(string_agg(
            '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), ''
            order by turn, role, text), '') as prompt
        from ends e left join turns t on t.conv_id = e.conv_id and t.turn < e.last_turn group by e.conv_id
    ), rendered as (
        select conv_id, last_text is not distinct from other_text as alike, n, prompt,
            '<|assistant|>' || chr(10) || coalesce(last_text, '') || '<|end|>' || chr(10) as one,
            '<|assistant|>' || chr(10) || coalesce(other_text, '') || '<|end|>' || chr(10) as two
        from ends join before using (conv_id)
    )
    select conv_id, cast(n + alike::int as int) as n_prompt_turns,
        case when alike then prompt || one else prompt end as prompt,
        case when alike then '' else one end as chosen, case when alike then '' else two end as rejected,
        case when alike then '' else '14:' || (length(one) - 14) end as chosen_trained,
        case when alike then '' else '14:' || (length(two) - 14) end as rejected_trained
    from rendered
"""

REPEATS = r"""
    with cut as (
        select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents
    ), places as (
        select doc_id, words, unnest(range(1, len(words) + 1)) as place from cut
    ), begun as (
        select doc_id, place, words[place] as word,
            case when place + 12 <= len(words) then array_to_string(words[place : place + 12], ' ') end as thirteen
        from places
    ), judged as (
        select doc_id, place, word,
            thirteen is not null and min(doc_id) over (partition by thirteen) < doc_id as found
        from begun
    ), marked as (
        select doc_id, place, word,
            bool_or(found) over (partition by doc_id order by place rows between 12 preceding and current row) as gone
        from judged
    ), kept as (
        select doc_id, count(*) filter (gone) as n_removed,
            string_agg(word, ' ' order by place) filter (not gone) as text
        from marked group by doc_id
    )
    select c.doc_id, cast(len(c.words) as bigint) as n_words, coalesce(k.n_removed, 0) as n_removed,
        sha256(coalesce(k.text, '')) as kept_sha256
    from cut c left join kept k using (doc_id)
"""

RECORDS = """
    with paid as (
        select page_id, coalesce(html, '') as payload from pages
    ), sized as (
        select page_id, octet_length(encode(payload)) as payload_bytes, sha256(payload) as payload_digest,
            min(page_id) over (partition by payload) as earliest
        from paid
    )
    select page_id, payload_bytes, payload_digest,
        case when payload_bytes >= 100 and earliest < page_id then 'revisit' else 'response' end as record_type,
        case when payload_bytes >= 100 and earliest < page_id then earliest end as refers_to
    from sized
"""

PHRASES = """
    with pieces as (
        select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[.,;:!?\n\x0b\x0c\r]')) as piece
        from documents
    ), worded as (
        select lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') as ws from pieces
    ), runs as (
        select lang, k, unnest(list_transform(range(1, (len(ws) - k + 2)::bigint), lambda i: ws[i:i + k - 1])) as ws
        from worded, (values (1), (2), (3)) sizes(k)
    ), f as (
        select lang, k, array_to_string(ws, ' ') as phrase, any_value(ws) as ws, count(*) as a
        from runs group by lang, k, phrase
    ), totals as (
        select lang, sum(a)::bigint as n from f where k = 1 group by lang
    ), often as (
        select * from f where a >= 10
    ), halves as (
        select lang, phrase, k, a, cut, array_to_string(ws[1:cut], ' ') as before, array_to_string(ws[cut + 1:k], ' ') as behind
        from often, (values (1), (2)) cuts(cut) where cut < k
    ), cuts as (
        select c.lang, c.phrase, c.k, c.a, x.a as l, y.a as r, cut,
            ((1000000::hugeint * c.a * c.a) // (x.a::hugeint * y.a))::bigint as score
        from halves c join often x on c.lang = x.lang and x.k = cut and x.phrase = before
        join often y on c.lang = y.lang and y.k = c.k - cut and y.phrase = behind
    ), worst as (
        select * from cuts qualify row_number() over (partition by lang, phrase order by score, cut) = 1
    ), longer as (
        select lang, part, max(a) as m
        from (select lang, a, unnest([ws[1] || ' ' || ws[2], ws[2] || ' ' || ws[3]]) as part from often where k = 3)
        group by lang, part
    ), kept as (
        select w.* from worst w left join longer t on w.k = 2 and w.lang = t.lang and w.phrase = t.part
        where t.m is null or 100 * t.m < 50 * w.a
    ), ranked as (
        select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from kept
    )
    select r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score
    from ranked r join totals t on r.lang = t.lang where r.rank <= 2000
"""


def _then(cost: str, initial: str, rest: str) -> str:
    """The value of an edit before the rest of a repair; values sort by cost, then by audit."""
    return f"printf('%08d', left({rest}, 8)::int + ({cost})) || '{initial}' || substr({rest}, 9)"


def _at_row() -> str:
    """Values at a row, by the kind of the last turn kept, from those behind it (n0 to n3)."""
    keeps = {0: [("s", 1), ("u", 2)], 1: [("u", 2)], 2: [("a", 3)], 3: [("u", 2)]}
    columns = []
    for kind, after in ((0, 2), (1, 2), (2, 3), (3, 2)):
        extra = "case when fault = 3 then 3 else 0 end"
        options = [_then("4", "D", f"n{kind}")]
        kept = [_then(f"case when initial = '{i}' then {extra} else 90000000 end", "K", f"n{to}") for i, to in keeps[kind]]
        changed = [*kept, _then(f"3 + {extra}", "R", f"n{after}")]
        options += [f"case when fault in (1, 2) then '99999999' else {option} end" for option in changed]
        columns.append(f"least({', '.join(options)}) as b{kind}")
    return ", ".join(columns)


def _inserted(name: str) -> str:
    """The same with turns inserted before."""
    columns = []
    for kind, after in ((0, 2), (1, 2), (2, 3), (3, 2)):
        once = _then("3", "I", f"{name}{after}")
        twice = _then("6", "II", f"{name}{5 - after}")
        columns.append(f"least({name}{kind}, {once}, {twice}) as n{kind}")
    return ", ".join(columns)


REPAIRS = f"""
    with recursive bits(i, c, step) as (
        select range::bigint, range::bigint, 0 from range(256)
        union all
        select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, step + 1 from bits where step < 8
    ), crc as (
        select list(c order by i) as tbl from bits where step = 8
    ), hit as (
        select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
            xor(list_reduce(list_prepend(4294967295::bigint, list_transform(
                string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda x: ascii(x)::bigint)),
                lambda c, b: xor(c >> 8, tbl[(xor(c, b) & 255) + 1])), 4294967295) % 20 as hit
        from conversations, crc
    ), damaged as (
        select conv_id, turn, case when hit = 4 then 'user' else role end as role,
            case hit when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
            unnest(case when hit = 3 then [0, 1] else [0] end) as copy
        from hit where hit <> 0
    ), placed as (
        select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i,
            rtrim(text, ' \t\n\x0b\x0c\r') as said, left(role, 1) as initial
        from damaged
    ), judged as (
        select *, case when said = '' then 1
            when row_number() over (partition by conv_id, role, text order by i) > 1 then 2
            when right(said, 1) not in ('.', '!', '?') then 3 else 0 end as fault,
            initial || lead(initial) over (partition by conv_id order by i) as pair
        from placed
    ), sums as (
        select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps,
            count(*) filter (where fault = 1) as blank, count(*) filter (where fault = 2) as duplicate,
            count(*) filter (where fault = 3) as truncated,
            count(*) filter (where pair is not null and pair not in ('su', 'ua', 'au')) as illegal, count(*) as n_rows
        from judged group by conv_id
    ), walk(conv_id, i, n0, n1, n2, n3) as (
        select conv_id, n_rows + 1, {_inserted("e")}
        from sums, (select '00000000' as e0, '90000000' as e1, '90000000' as e2, '00000000' as e3)
        union all
        select conv_id, i, {_inserted("b")} from (
            select j.conv_id, j.i, {_at_row()}
            from walk w join judged j on w.conv_id is not distinct from j.conv_id and j.i = w.i - 1)
    ), audits as (
        select conv_id, left(n0, 8)::bigint as cost, substr(n0, 9) as audit from walk where i = 1
    ), letters as (
        select conv_id, unnest(range(1, len(audit) + 1)) as p, unnest(string_split(audit, '')) as letter
        from audits where audit <> ''
    ), counted as (
        select *, count(*) filter (where letter <> 'I') over w as i, count(*) filter (where letter <> 'D') over w as element
        from letters window w as (partition by conv_id order by p rows unbounded preceding)
    ), turns as (
        select c.conv_id, c.element, c.letter, case when c.letter = 'I' then '' else j.text end as text, j.role,
            max(case when c.element = 1 and c.letter = 'K' and j.initial = 's' then 1 else 0 end)
                over (partition by c.conv_id) as led
        from counted c left join judged j on c.conv_id is not distinct from j.conv_id and c.i = j.i
        where c.letter <> 'D'
    ), hashed as (
        select conv_id, sha256(string_agg(
            case when letter = 'K' then role when (element - led) % 2 = 1 then 'user' else 'assistant' end || ':' || text,
            chr(10) order by element)) as sha
        from turns group by conv_id
    )
    select o.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
        coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(cost, 0) as cost,
        coalesce(audit, '') as audit, coalesce(sha, sha256('')) as repaired_sha256
    from (select distinct conv_id from conversations) o
    left join sums s on o.conv_id is not distinct from s.conv_id
    left join audits a on o.conv_id is not distinct from a.conv_id
    left join hashed h on o.conv_id is not distinct from h.conv_id
"""

TWINS = {
    "op2_substring_rlz": REPEATS,
    "op6_warc": RECORDS,
    "op8_url_reputation": URLS,
    "op9_preference_chat": PREFERENCES,
    "op12_conversation_repair": REPAIRS,
    "op13_collocations": PHRASES,
}
