"""The catalogue's queries in SQL for DuckDB, the independent check of their results.

DuckDB's patterns know no lookaround, so word boundaries are written as neighbours here.
"""

from __future__ import annotations

from postsieve.functions import vocabulary as V
from postsieve.plans import catalogue as C

# Written apart from the package's own classes, so that a fault there shows: blanks, line ends, word characters.
_BLANK_RANGES = [
    (9, 13), (28, 32), (133, 133), (160, 160), (5760, 5760), (8192, 8202), (8232, 8233), (8239, 8239), (8287, 8287), (12288, 12288),
]
_BLANKS = " || ".join(f"chr({code})" for first, last in _BLANK_RANGES for code in range(first, last + 1))
_BLANK_CLASS = "".join(rf"\x{{{first:x}}}-\x{{{last:x}}}" for first, last in _BLANK_RANGES)
_LINE_END_CLASS = r"\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}"
_WORD = r"\p{L}\p{N}_"
_NOT_WORD = f"[^{_WORD}]"
_EMAIL = rf"^[^@{_BLANK_CLASS}]+@[^@{_BLANK_CLASS}]+\.[^@{_BLANK_CLASS}]+"


# The named HTML references that the given pages may hold; "&amp;" is decoded last.
REFERENCES = [
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"),
    ("&ndash;", "–"), ("&mdash;", "—"), ("&lsquo;", "‘"), ("&rsquo;", "’"), ("&ldquo;", "“"),
    ("&rdquo;", "”"), ("&hellip;", "…"), ("&bull;", "•"), ("&middot;", "·"), ("&copy;", "©"),
    ("&reg;", "®"), ("&trade;", "™"), ("&amp;", "&"),
]


def _strip(e: str) -> str:
    return f"trim({e}, {_BLANKS})"


def _first_line(e: str) -> str:
    return _strip(f"regexp_extract(ltrim({e}, {_BLANKS}), '^[^{_LINE_END_CLASS}]*')")


def _has_term(e: str, terms: list[str]) -> str:
    def alternatives(group: list[str]) -> str:
        return "|".join(t.replace(".", "\\.").replace("+", "\\+") for t in group)

    closed = [t for t in terms if t[-1].isalnum()]
    open_ended = [t for t in terms if not t[-1].isalnum()]
    branches = []
    if closed:
        branches.append(f"(?:^|{_NOT_WORD})(?:{alternatives(closed)})(?:$|{_NOT_WORD})")
    if open_ended:
        branches.append(f"(?:^|{_NOT_WORD})(?:{alternatives(open_ended)})[{_WORD}]")
    return f"regexp_matches({e}, '(?i){'|'.join(branches)}')"


def _level(e: str, include: list[str], veto: list[str]) -> str:
    return f"({_has_term(e, include)} and not {_has_term(e, veto)})"


def _headline(e: str) -> str:
    blank, name = f"[{_BLANK_CLASS}]", f"[{_WORD}''’.-]+"
    return f"regexp_matches({e}, '(?i)^{blank}*meet(?:$|{_NOT_WORD})|^{blank}*{name}{blank}+{name}{blank}*:{blank}')"


def _path_word(e: str, words: list[str]) -> str:
    return f"regexp_matches(lower({e}), '/({'|'.join(words)})s?/')"


def _host(e: str) -> str:
    return f"replace(regexp_extract({e}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), 'www.', '')"


def _decoded(e: str) -> str:
    for reference, char in REFERENCES:
        e = f"replace({e}, '{reference}', chr({ord(char)}))"
    return e


def _age(seconds: str) -> str:
    return f"""case when {seconds} is null then '—' when {seconds} < 60 then 'just now'
        when {seconds} < 3600 then ({seconds} // 60) || ' min ago'
        when {seconds} < 86400 then ({seconds} // 3600) || 'h ago' else ({seconds} // 86400) || 'd ago' end"""


def _seconds_to(now: str, ts: str) -> str:
    return f"((epoch_us(timestamp '{now}') - epoch_us({ts})) // 1000000)"


_NOW = "2024-01-15 12:00:00"
_MAIL = "'user' || o_custkey || '@example.com'"

_CARDS = f"""cards as (select doc_id as ord, lang as company, {_first_line('text')} as title, text as card
    from documents)"""
_BATCH = f"""{_CARDS}, batch as (select company, title, ord from cards where title <> ''
    and not {_headline('title')} and {_level('card', C.CARD_INCLUDE, C.CARD_VETO)})"""
_FIRSTS = f"""{_BATCH}, firsts as (select company, title, min(ord) as ord from batch group by 1, 2),
    past as (select company, title, ord, quality = 1 as notified from cards join labels on doc_id = ord)"""
_NEW = f"""{_FIRSTS}, fresh as (select * from firsts f where not exists
    (select 1 from past p where p.company = f.company and p.title = f.title))"""

_LINKS = rf"""shown as (select page_id, url, regexp_replace(html,
        '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<template\b.*?</template\s*>', '', 'g') as html
        from pages),
    found as (select page_id, url, regexp_extract_all(html, '(?is)<a(?:\s[^>]*)?>.*?</a>') as links from shown),
    anchors as (select page_id, url, unnest(range(len(links))) as ord, unnest(links) as a from found),
    links as (select page_id, url, ord,
        {_decoded(r"regexp_extract(a, '(?i)\shref\s*=\s*.([^\x22]*)\x22', 1)")} as href,
        {_strip(_decoded(r"regexp_replace(regexp_replace(a, '[\t\n\f\r ]+', ' ', 'g'), '</?[A-Za-z][^<>]*>', '', 'g')"))}
            as text
        from anchors)"""

_STATUS = """status as (select user_id, case when arg_max(event_type <> 'error', (ts, event_type = 'error')) then 'active'
    else 'broken' end as status, max(ts) as last_checked from events group by 1)"""


def _digest(rows: str, per_part: int, columns: str) -> str:
    """``rows`` selects recipient, seq, title, company, url, date."""
    return rf"""with rows as ({rows}),
        placed as (select *, row_number() over (partition by recipient order by seq) - 1 as pos,
            count(*) over (partition by recipient) as total from rows),
        lined as (select *, pos // {per_part} as p, title || ' @ ' || company || ' — ' || url as line,
            '<tr><td><b>' || title || '</b><br>' || company || ' &middot; ' || date || '</td><td><a href="'
            || replace(url, '&', '&amp;') || '">Apply</a></td></tr>' as html from placed),
        documents_sent as (select recipient, (p + 1)::bigint as part, ((total + {per_part} - 1) // {per_part})::bigint as parts,
            total, '[Job Alert] ' || total || ' new fresher posting' || case when total > 1 then 's' else '' end as subject,
            string_agg(line, chr(10) order by seq) as body, string_agg(html, chr(10) order by seq) as html_rows
            from lined group by recipient, p, total)
        select {columns} from documents_sent"""


_ALERT_COLUMNS = f"""select {_MAIL} as recipient, o_orderkey as seq, o_orderpriority as title, o_orderstatus as company,
    'https://example.com/?a=1&b=' || o_orderkey as url, strftime(o_orderdate, '%b %-d, %H:%M') as date from orders"""
_DEBT = "(select c_custkey from customer where c_acctbal < 0)"

_DEFAULT_TITLE = """case when p_size < 5 then 'Associate ' when p_size < 10 then 'Associate Director, '
    when p_size < 14 then 'Sr Associate ' when p_size < 18 then 'Sr. Associate ' when p_size < 22 then 'Campus hire 0-1 year '
    when p_size < 26 then 'Internal ' when p_size < 30 then 'New Grad 3+ year ' when p_size < 34 then 'VP, Graduate '
    when p_size < 38 then 'Internships ' when p_size < 42 then 'Meet the trainee ' when p_size < 46 then 'Recent Graduate: '
    else 'junior_' end || p_name"""
_DEFAULT_PLACE = """case p_type when 'PROMO' then 'Navi Mumbai' when 'SMALL' then 'PUNE, IN' when 'LARGE' then 'Indiana'
    when 'ECONOMY' then '' else 'Delhi/Noida' end"""

_CANDIDATES = """with c as (select s_suppkey as ord,
        case when s_acctbal < 0 then '' else 'Source ' || s_nationkey end as name,
        case when s_acctbal > 9000 then 'ftp://x' else 'https://example.com/' || s_suppkey end as url from supplier),
    r as (select *, case when name = '' then 'name required'
        when url not like 'http%' then 'url must start with http' end as refused from c),
    o as (select *, row_number() over (partition by lower(name), refused is null order by ord) as nth from r),
    checked as (select ord, name, url, case when refused is not null then refused
        when nth > 1 or lower(name) in (select 'source ' || n_nationkey from nation where n_regionkey = 0)
        then 'already tracked' end as reason from o)"""


def _endpoint_screen(include: list[str], veto: list[str], places: list[str]) -> str:
    text = "(title || ' ' || location)"
    place = "(case when location = '' then title else location end)"
    return f"not {_headline('title')} and {_level(text, include, veto)} and {_has_term(place, places)}"


_RUN_INCLUDE = [*C.PART_INCLUDE, *C.LINK_INCLUDE]
_RUN = f"""{_LINKS}, answers as (select p_brand as company, p_name as title, p_type as location, 0::bigint as ord,
        'https://t.example.com/Careers/job/' || p_partkey as url from part where p_brand <> 'Brand#20'),
    by_endpoint as (select company, title, url, ord from answers
        where {_endpoint_screen(_RUN_INCLUDE, C.PART_VETO, [*C.PART_PLACES, *C.LINK_INCLUDE])}),
    page_rows as (select 'Brand#' || (length(url) - 15) as company, {_first_line('text')} as title,
        regexp_extract(url, '^[^:]*://[^/?#]*') || href as url, ord::bigint as ord, href, text from links),
    by_page as (select company, title, url, ord from page_rows where title <> '' and not {_headline('title')}
        and not {_path_word('href', V.ARTICLE_PATH_WORDS)} and {_level('text', _RUN_INCLUDE, C.PART_VETO)}
        and {_has_term('text', [*C.PART_PLACES, *C.LINK_INCLUDE])} and company <> 'Brand#20'
        and company not in (select company from by_endpoint)),
    postings as (select * from by_endpoint union all select * from by_page)"""

_FIRST_OF_RUN = "nth as (select *, row_number() over (partition by company, title order by ord, url) as n from postings)"
_RUN_COLUMNS = f"""company, title, url, replace(company || '_' || substr(title, 1, {V.ID_TITLE_CHARS}), ' ', '_') as id,
    'Jan 15, 12:00' as date, false as notified"""

_TERM_DOCS = rf"""t as (select distinct lower(regexp_extract(text, '^(\p{{L}}+ \p{{L}}+)', 1)) as term from benchmark),
    cut as (select doc_id, regexp_extract_all(lower(text), '[{_WORD}]+|[^{_WORD}]') as c from documents),
    near as (select doc_id, unnest(list_zip(c, c[2:], c[3:])) as z from cut),
    hits as (select distinct doc_id from near where z[2] = ' ' and z[1] || ' ' || z[3] in (select term from t where term <> ''))"""

_LATEST_STATE = """with t as (select o_custkey, o_orderdate as tried_at, o_orderpriority = '1-URGENT' as failed,
            case when o_orderstatus = 'F' then o_orderpriority end as title from orders),
        r as (select *, row_number() over (partition by o_custkey order by tried_at desc, failed desc, title desc nulls last) as nth from t),
        c as (select *, case when c_custkey % 5 = 0 then timestamp '1998-01-01' end as seen from customer left join r on o_custkey = c_custkey and nth = 1),
        m as (select *, tried_at is not null and (seen is null or tried_at >= seen) as newer from c)
        select c_custkey, case when not newer then 'unknown' when failed then 'broken' else 'active' end as status,
            case when not newer then c_mktsegment when failed then '' else coalesce(title, '') end as last_job,
            epoch_us(case when newer then tried_at else seen end) as last_checked_us from m"""

_SHAPED = """select p_brand as company, p_brand <> 'Brand#20' as ok, p_size % 3 as kind, p_size, p_partkey,
            case when p_size % 3 = 2 then p_partkey::varchar else p_name end as title, p_type as location,
            case p_size % 3 when 0 then 'https://t.example.com/Careers/job/' when 1 then 'https://other.example.com/n/'
                else 'https://t.example.com/b/' end || p_partkey as url from part"""

ORACLES: dict[str, str] = {
    "scan_sources": "select s_suppkey as id, s_name as name, s_nationkey as nation from supplier",
    "flatten_payload": """select event_id, 0::bigint as ord,
            coalesce(cast(json_extract_string(props, '$.k') as integer), -1) as k from events
        union all select event_id, 1::bigint, -1 from events""",
    "endpoint_postings": f"""with rows as (select p_brand as company, p_name as title,
            case when p_size >= 10 then p_type else '' end as location,
            'https://' || lower(replace(p_brand, '#', '')) || '.example.com/' || lower(p_type) || '/job/' || p_partkey as url,
            0::bigint as ord from part)
        select company, title, url, ord from rows
        where {_endpoint_screen(C.PART_INCLUDE, C.PART_VETO, C.PART_PLACES)}""",
    "shaped_postings": f"""with s as ({_SHAPED}) select company, ok, case when ok then title else '' end as title,
            case when ok then location else '' end as location, case when ok then url end as url, case when ok then 0::bigint end as ord,
            case when ok then ['listed', 'nested', 'bare'][kind + 1] end as shape,
            case when ok and kind <> 1 then p_size::bigint end as size, case when ok and kind = 1 then company end as brand from s""",
    "unread_fields": f"""with s as ({_SHAPED}), f as (select ['listed', 'nested', 'bare'][kind + 1] as shape,
            unnest([['size'], ['team'], ['commitment', 'size']][kind + 1]) as field from s where ok)
        select shape, field, count(*) as n from f group by 1, 2""",
    "merge_latest": _LATEST_STATE,
    "stream_source_state": _LATEST_STATE,
    "extract_links": f"with {_LINKS} select page_id, ord::bigint as ord, href, text from links",
    "page_postings": f"""with {_LINKS}, rows as (select {_host('url')} as company, {_first_line('text')} as title,
            regexp_extract(url, '^[^:]*://[^/?#]*') || href as url, ord::bigint as ord, href, text from links)
        select company, title, url, ord from rows where title <> '' and not {_headline('title')}
            and not {_path_word('href', V.ARTICLE_PATH_WORDS)} and {_level('text', C.LINK_INCLUDE, C.LINK_VETO)}""",
    "cap_per_source": f"with {_LINKS} select page_id, count(*) as n_links from links where ord < 3 group by 1",
    "first_line_title": f"with {_CARDS} select ord, title from cards",
    "site_base": """with p as (select page_id, url, regexp_extract(url, '^([^:]*://[^/?#]*)', 1) as origin,
            string_split(rtrim(regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1), '/'), '/') as segments from pages)
        select page_id, case when len(segments) >= 2 then origin || '/' || segments[-2] end as base from p""",
    "resolve_links": rf"""with {_LINKS}, p as (select page_id, ord, substr(href, 2) as bare, href,
            regexp_extract(url, '^[^:]*:') as scheme, regexp_extract(url, '^[^:]*://[^/?#]*') as origin,
            regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1) as path from links),
        q as (select *, regexp_replace(path, '[^/]*$', '') as folder from p)
        select page_id, ord::bigint as ord, case ord when 1 then origin || folder || bare
            when 2 then origin || regexp_replace(folder, '[^/]+/$', '') || bare when 3 then origin || path || '?q=' || bare
            when 4 then scheme || '//other.example.org/' || bare when 5 then 'mailto:' || bare
            else origin || href end as target from q""",
    "posting_id": f"""with {_CARDS} select ord,
        replace(company || '_' || substr(title, 1, {V.ID_TITLE_CHARS}), ' ', '_') as id from cards""",
    "display_date": "select o_orderkey, strftime(o_orderdate, '%b %-d, %H:%M') as shown from orders",
    "host_of": f"select page_id, {_host('url')} as host from pages",
    "relative_age": f"""with s as (select event_id, {_seconds_to(_NOW, 'ts')} as seconds from events)
        select event_id, {_age('seconds')} as age from s""",
    "status_label": """select event_id, case when event_type = 'error' then 'Broken'
        when event_type in ('view', 'click') then 'Active' else 'Pending' end as label from events""",
    "shorten_text": f"""with {_CARDS} select ord, case when length(title) > {V.SHORT_TITLE_CHARS}
        then substr(title, 1, {V.SHORT_TITLE_CHARS}) || '…' else title end as short from cards""",
    "row_key": "select p_partkey, case when p_size > 25 then p_brand else p_type || '_' || p_name end as key from part",
    "term_match": f"select p_partkey, p_name from part where {_has_term('p_name', C.PART_INCLUDE)}",
    "term_table_match": f"with {_TERM_DOCS} select doc_id from documents where doc_id in (select doc_id from hits)",
    "term_table_veto": f"with {_TERM_DOCS} select doc_id from documents where doc_id not in (select doc_id from hits)",
    "term_veto": f"select p_partkey, p_name from part where not {_has_term('p_name', ['old', 'cold'])}",
    "level_screen": f"select p_partkey, p_name from part where {_level('p_name', C.PART_INCLUDE, ['old', 'cold'])}",
    "place_screen": f"select p_partkey, p_name from part where {_has_term('p_name', ['red', 'blue'])}",
    "headline_screen": f"""with t as (select p_partkey, case when p_size > 35 then p_name || ': x'
            when p_size > 30 then 'Meet ' || p_name when p_size > 25 then p_name || ':x'
            else 'Meeting ' || p_name end as title from part)
        select p_partkey, title from t where not {_headline('title')}""",
    "url_path_screen": f"select page_id, url from pages where not {_path_word('url', C.LINK_PATH_WORDS)}",
    "screen_api_rows": f"""with t as (select p_partkey, p_name as title,
            case when p_size < 10 then '' else p_type end as location from part)
        select p_partkey, title, location from t
        where {_endpoint_screen(C.PART_INCLUDE, C.PART_VETO, C.PART_PLACES)}""",
    "screen_page_rows": f"with {_BATCH} select company, title, ord from batch",
    "default_screens": f"""with t as (select p_partkey, {_DEFAULT_TITLE} as title, {_DEFAULT_PLACE} as location,
            case when p_brand = 'Brand#7' then '/blogs/x' else '/job/' || p_partkey end as href from part)
        select p_partkey, title, location from t where not {_path_word('href', V.ARTICLE_PATH_WORDS)}
            and {_endpoint_screen(V.INCLUDE_TERMS, V.VETO_TERMS, V.PLACE_TERMS)}""",
    "email_check": f"""with tokens as (select doc_id,
            unnest(regexp_split_to_array(text, '[{_BLANK_CLASS}]+')) as token from documents)
        select doc_id, count(*) filter (where regexp_matches(token, '{_EMAIL}')) as n_emails
        from tokens group by 1""",
    "validate_sources": f"{_CANDIDATES} select ord, name, url, reason from checked",
    "add_sources": f"""{_CANDIDATES} select ord as position, 'c' || substr(sha256(lower(name)), 1, 16) as id, name, url,
        false as locked, 'unknown' as status from checked where reason is null""",
    "new_postings": f"with {_NEW} select company, title, ord from fresh",
    "probe_new_postings": f"with {_NEW} select company, title, ord from fresh",
    "endpoint_lookup": """select s_suppkey, n_name as endpoint from supplier
        left join nation on n_nationkey = s_nationkey and n_regionkey = 0""",
    "fallback_rows": """select o_orderkey, o_custkey, o_orderpriority from orders o
        where o_orderpriority = '1-URGENT' or (o_orderpriority = '5-LOW' and not exists
            (select 1 from orders u where u.o_custkey = o.o_custkey and u.o_orderpriority = '1-URGENT'))""",
    "delete_by_key": f"select o_orderkey, o_custkey from orders where o_custkey not in {_DEBT}",
    "select_by_key": f"select o_orderkey, o_custkey from orders where o_custkey in {_DEBT}",
    "merge_source_state": f"""with s as (select o_custkey, case when arg_max(o_orderpriority <> '1-URGENT', o_orderkey)
            then 'active' else 'broken' end as status from orders group by 1),
        f as (select o_custkey, arg_min(o_orderpriority, o_orderkey) as last_job from orders
            where o_orderstatus = 'F' group by 1)
        select c_custkey, coalesce(status, 'unknown') as status,
            case when status is null then c_mktsegment else coalesce(last_job, '') end as last_job,
            case when status is not null then epoch_us(timestamp '{_NOW}') end as last_checked_us
        from customer left join s on s.o_custkey = c_custkey left join f on f.o_custkey = c_custkey""",
    "count_per_source": f"with {_BATCH} select company, count(*) as n_postings from batch group by 1",
    "first_title": f"with {_BATCH} select company, arg_min(title, ord) as last_job from batch group by 1",
    "source_status": f"with {_STATUS} select user_id, status, epoch_us(last_checked) as last_checked_us from status",
    "latest_check": f"""with t as (select max(ts) as top from events), s as (select top,
            {_seconds_to('2024-02-15 00:00:00', 'top')} as seconds from t)
        select epoch_us(top) as latest_us, {_age('seconds')} as age from s""",
    "responding_count": f"""with {_STATUS} select count(*) filter (where status <> 'broken') as responding,
        count(*) as total from status""",
    "source_board": f"""with {_STATUS}, b as (select s_name, status, p_name, s_acctbal,
            {_seconds_to(_NOW, 'last_checked')} as seconds from supplier left join status on user_id = s_suppkey
            left join part on p_partkey = s_suppkey and p_size > 25)
        select s_name as name, upper(substr(s_name, 1, 1)) as initial,
            lower(replace(s_name, '#', '-')) || '.example.com' as host,
            case status when 'broken' then 'Broken' when 'active' then 'Active' else 'Pending' end as status,
            coalesce(p_name, '—') as last_job, {_age('seconds')} as last_checked,
            case when s_acctbal > 5000 then 'CORE' else '' end as core from b""",
    "alert_digest": _digest(
        f"{_ALERT_COLUMNS} where o_orderpriority = '1-URGENT'", 4,
        "recipient, part, parts, total, subject, body, html_rows",
    ),
    "pending_alerts": _digest(
        f"{_ALERT_COLUMNS} where o_orderstatus <> 'F' and o_custkey not in {_DEBT}", 1000,
        "recipient, part, total, subject, body",
    ),
    "mark_notified": f"""select o_orderkey, o_custkey,
        (o_orderstatus = 'F' or o_custkey in {_DEBT}) as notified from orders""",
    "joined_names": """with p as (select s_nationkey, s_suppkey, s_name,
            row_number() over (partition by s_nationkey order by s_suppkey) - 1 as pos,
            count(*) over (partition by s_nationkey) as total from supplier)
        select s_nationkey, (pos // 3 + 1)::bigint as part, ((total + 2) // 3)::bigint as parts, total,
            count(*) as n, string_agg(s_name, ', ' order by s_suppkey) as names
        from p group by s_nationkey, pos // 3, total""",
    "run_summary": f"""with {_FIRSTS}, keys as (select distinct company, title, 1 as seen from past)
        select count(*) as in_batch, count(seen) as already_seen, count(*) - count(seen) as new
        from firsts left join keys using (company, title)""",
    "keep_first": f"with {_CARDS} select company, title, min(ord) as ord from cards group by 1, 2",
    "history_page": """select o_orderkey as seq, o_custkey, o_orderpriority from orders
        order by o_orderkey desc limit 10 offset 20""",
    "page_label": """with n as (select o_custkey, count(*) as total from orders group by 1),
        s as (select *, least(1, (total - 1) // 10) * 10 as start from n)
        select o_custkey, total, (start + 1) || '–' || least(start + 10, total) || ' of ' || total as label from s""",
    "append_history": f"""with {_NEW} select company, title, ord, notified from past
        union all select company, title, ord, null from fresh""",
    "scheduled_run": f"""with {_RUN}, nth as (select *,
            row_number() over (partition by company, title order by ord, url) as n from postings)
        select company, title, url, replace(company || '_' || substr(title, 1, {V.ID_TITLE_CHARS}), ' ', '_') as id,
            'Jan 15, 12:00' as date, false as notified from nth where n = 1""",
    "scheduled_run_state": f"""with {_RUN}, names as (select p_brand as name from part
            union select 'Brand#' || (length(url) - 15) from pages),
        firsts as (select company, arg_min(title, (ord, url)) as last_job from postings group by 1)
        select name, case when name = 'Brand#20' and exists (select 1 from part where p_brand = 'Brand#20')
            then 'broken' else 'active' end as status, coalesce(last_job, '') as last_job,
            epoch_us(timestamp '{_NOW}') as last_checked_us
        from names left join firsts on company = name""",
    "stream_new_postings": f"""with {_NEW} select company, title, '/doc/' || ord as url,
        replace(company || '_' || substr(title, 1, {V.ID_TITLE_CHARS}), ' ', '_') as id from fresh""",
    "stream_dedup": f"with {_CARDS} select distinct company, title from cards",
    "stream_dedup_forgetting": """with o as (select o_custkey::varchar as company, min(o_orderdate) as first_at, max(o_orderdate) as last_at
            from orders group by 1), w as (select max(first_at) - interval 800 day as mark from o)
        select company, 'order' as title, epoch_us(first_at) as at_us from o
        union all select company, 'order', epoch_us(last_at) from o, w where last_at > mark and first_at + interval 800 day <= mark""",
    "link_text": f"""select p_partkey, '/p/' || p_partkey || '?a=1&b=2' as href, case p_size % 8 when 0 then '$' when 1 then '$'
            when 2 then chr(92) when 3 then chr(92) when 4 then chr(233) when 5 then chr(233) when 6 then chr(252)
            else chr(65533) end || ' ' || p_name || chr(9) || p_type as text from part""",
    "remove_history": f"""with {_FIRSTS} select company, title, ord as seq, 'first' as run from past where notified is not true
        union all select company, title, ord, 'second' from cards""",
    "clear_history": f"with {_BATCH} select company, title, ord as seq, 'second' as run from batch",
    "merge_runs": f"""with {_FIRSTS} select company, title, ord as seq, 'first' as run from past where notified is not true
        union all select company, title, ord, 'second' from cards where ord % 3 <> 0
        union all select company, title, ord, 'third' from batch""",
    "merged_page": f"""with {_CARDS} select ord as seq, company, title from cards where ord % 3 <> 0
        order by ord desc limit 10 offset 20""",
    "new_to_merged": f"""with {_FIRSTS}, first_cards as (select company, title, min(ord) as ord from cards group by 1, 2)
        select company, title, ord from first_cards f
        where not exists (select 1 from past p where p.company = f.company and p.title = f.title)
        and not exists (select 1 from batch b where b.ord % 2 = 0 and b.company = f.company and b.title = f.title)""",
    "stream_run": f"with {_RUN}, {_FIRST_OF_RUN} select {_RUN_COLUMNS} from nth where n = 1",
    "run_on_history": f"""with {_RUN}, {_FIRST_OF_RUN} select {_RUN_COLUMNS} from nth where n = 1 and not exists
        (select 1 from part p where p.p_partkey % 2 = 0 and p.p_brand = nth.company and p.p_name = nth.title)""",
    "pending_after_run": f"""with {_FIRSTS} select 'cards' as run, ord as seq, company, title from past where notified is not true""",
    "pending_digest": "select *, 0::bigint as pending_after from (" + _digest(
        f"""with {_FIRSTS} select 'user@example.com' as recipient, ord as seq, title, company, '' as url, '' as date
        from past where notified is not true""", 1000, "recipient, part, parts, total, subject, body") + ")",
    "scheduled_run_digest": _digest(
        f"""with {_RUN}, nth as (select *, row_number() over (partition by company, title order by ord, url) as n from postings)
        select 'user@example.com' as recipient, row_number() over (order by length(company), ord, url) as seq,
            title, company, url, 'Jan 15, 12:00' as date from nth where n = 1""",
        1000, "recipient, part, parts, total, subject, body",
    ),
}
ORACLES["stream_run_state"] = ORACLES["scheduled_run_state"]
ORACLES["stream_run_digest"] = f"select *, 0::bigint as pending_after from ({ORACLES['scheduled_run_digest']})"
