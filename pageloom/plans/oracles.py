"""Plain SQL on the given tables that each named query has to agree with."""

from __future__ import annotations

import json

from ..model import JOB_POSTINGS, ExtractionSpec
from .board import BROKEN_SPEC, WEAK_SPEC

_CARDS = r"""c AS (
  SELECT o_orderkey AS key, lower(regexp_replace(o_orderpriority, '[^A-Za-z0-9]+', '-', 'g')) AS board,
         CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS board_no, o_orderkey // 100 AS block,
         (o_orderkey // 100) * 10 + CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS page_id,
         'Order ' || o_orderkey || ' & ' || o_orderstatus || ' <ops>' AS title, c_name AS company,
         CASE WHEN o_orderkey % 7 <> 0 THEN c_mktsegment END AS location,
         CAST(floor(o_totalprice) AS BIGINT) AS salary_min, CAST(floor(o_totalprice) AS BIGINT) + 1000 AS salary_max,
         CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%m/%d/%Y')
              WHEN 2 THEN strftime(o_orderdate, '%B %-d, %Y') ELSE strftime(o_orderdate, '%-d %b %Y') END AS posted,
         strftime(o_orderdate, '%Y-%m-%d') AS day, '/jobs/' || o_orderkey AS path
  FROM orders JOIN customer ON o_custkey = c_custkey),
k AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY key) - 1 AS row_no,
         count(*) OVER (PARTITION BY page_id) AS n,
         'https://jobs.example.com/' || board || '/page/' || block AS page_url,
         'https://jobs.example.com' || path AS job_url FROM c)"""

_WITH = "WITH " + _CARDS + "\n"

_ITEMS = _WITH + """SELECT page_id, row_no, title, company, location, salary_min, salary_max,
  day || 'T00:00:00' AS posted_at, job_url FROM k"""

# Layout of one board page as a summary shows it.
_OUTLINE = r"""'body' || chr(10) || '  nav' || chr(10) || '    ul .menu' || chr(10) || '      li' || chr(10)
  || '        a href="/": "Home"' || chr(10) || '      li' || chr(10) || '        a href="/about": "About"' || chr(10)
  || '  ol #board .openings' || chr(10) || '    li .opening' || chr(10) || '      h2 .role: "' || title || '"' || chr(10)
  || '      b .employer: "' || company || '"' || chr(10)
  || coalesce('      em .place: "' || location || '"' || chr(10), '')
  || '      small .pay: "' || salary || '"' || chr(10) || '      div .note: "' || meta || '"' || chr(10)
  || '      a .more href="' || path || '": "Details"' || chr(10)
  || CASE WHEN n >= 3 THEN '    (+' || (n - 1) || ' more `li.opening`)' || chr(10) ELSE '' END
  || CASE WHEN block % 10 <> 9 THEN '  a .next href="/' || board || '/page/' || (block + 1) || '": "Next"' || chr(10) ELSE '' END
  || '  footer: "© jobs.example.com"'"""
_SHOWN = f"""s AS (SELECT *, 'from $' || format('{{:,}}', salary_min) || ' to $' || format('{{:,}}', salary_max) AS salary,
    'No. ' || key || ', listed ' || posted AS meta FROM k),
x AS (SELECT *, title || ' ' || company || coalesce(location, '') || salary || meta || 'Details' AS words,
    {_OUTLINE} AS outline FROM s),
pr AS (SELECT page_id, '[title]' || chr(10) || 'Jobs – ' || max(board) || chr(10) || chr(10)
    || '[groups]' || chr(10) || '`li.opening` x' || max(n) || chr(10)
    || '<li .opening> ' || max(words) FILTER (WHERE row_no = 0) || chr(10)
    || '<li .opening> ' || max(words) FILTER (WHERE row_no = 1) || chr(10) || chr(10)
    || '[outline]' || chr(10) || max(outline) FILTER (WHERE row_no = 0) AS prompt, max(block) AS block FROM x GROUP BY page_id)"""


def _text(expr: str) -> str:
    """Entity decoding and whitespace collapsing of text in the given pages."""
    out = expr
    for entity, char in (("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        out = f"replace({out}, '{entity}', '{char}')"
    return out


def _collapsed(expr: str) -> str:
    return rf"trim(regexp_replace({expr}, '\s+', ' ', 'g'))"


_NAV = r"""n AS (SELECT page_id, url, regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)(</nav>|$)', 1), '<a href="[^"]*">[^<]*') AS items FROM pages),
i AS (SELECT page_id, url, unnest(items) AS item, generate_subscripts(items, 1) - 1 AS row_no FROM n)"""

_BLANK = r"[\s\x0b\x1c-\x1f\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_SHELLS = rf"""d AS (SELECT doc_id AS page_id, doc_id % 3 AS kind,
    length(regexp_replace(text, '^{_BLANK}+|{_BLANK}+$', '', 'g')) AS text_chars FROM documents)"""

_FLOOR0 = "min_rows: 0 of 1"


def _null_gate(field: str, percent: str = "'100'") -> str:
    return f"'null_rate {field}: ' || {percent} || '% over 50%'"


_ALL_GATES = f"'{_FLOOR0}; ' || {_null_gate('title')} || '; ' || {_null_gate('company')} || '; ' || {_null_gate('url')}"

_DAMAGE = """g AS (SELECT page_id, max(page_url) AS url, max(board) AS board, max(board_no) AS board_no, max(block) AS block, count(*) AS n_rows,
    count(*) FILTER (WHERE key % 3 <> 0) AS valid_count, count(*) FILTER (WHERE key % 3 = 0) AS n_row_errors,
    avg(CASE WHEN key % 5 = 0 THEN 1.0 ELSE 0.0 END) AS title_nulls, CASE WHEN max(board_no) = 5 THEN 1.0 ELSE 0.0 END AS company_nulls,
    avg(CASE WHEN key % 3 = 0 THEN 1.0 ELSE 0.0 END) AS url_nulls FROM k GROUP BY page_id)"""

_VISIT = f"""p AS (SELECT page_id, max(page_url) AS url, max(block) % 4 AS phase, count(*) AS n FROM k GROUP BY page_id),
r AS (SELECT page_id, url, phase, n, 'run-2-' || page_id AS run_id,
    CASE phase WHEN 0 THEN 'hit' WHEN 3 THEN 'miss' ELSE 'drift_regenerated' END AS cache_status,
    CASE WHEN phase = 0 THEN 'model-a' WHEN page_id % 2 = 0 THEN 'model-2' ELSE 'model-1' END AS model,
    CASE WHEN phase = 0 OR page_id % 2 = 0 THEN n ELSE 0 END AS rows_extracted,
    CASE WHEN phase = 0 OR (page_id % 2 = 0 AND phase <> 2) THEN 'ok' ELSE 'failed' END AS final_status,
    CASE WHEN phase = 0 THEN 1 ELSE 2 END AS attempts,
    CASE WHEN phase = 0 THEN 0 ELSE 2 * (page_id % 100) + 1 END AS tokens_in,
    CASE WHEN phase = 0 THEN 0 ELSE 30 END AS tokens_out,
    CASE WHEN phase = 0 OR (page_id % 2 = 0 AND phase <> 2) THEN ''
         WHEN page_id % 2 = 0 THEN {_null_gate('company')} ELSE {_ALL_GATES} END AS gates FROM p)"""

_PAGES_OF_BOARD = "q AS (SELECT page_id, max(page_url) AS url, max(board) AS board, max(block) AS block, count(*) AS n FROM k GROUP BY page_id)"

_GOAL = '{"name":"job_postings","cardinality":"many","required":["title","company","url"],"min_rows":1}'
_KINDS = {"str": {"type": "string"}, "int": {"type": "integer"}, "url": {"type": "string", "format": "uri", "minLength": 1, "maxLength": 2083},
          "datetime": {"type": "string", "format": "date-time"}}
_ITEM = {f.name: _KINDS[f.kind] if f.required else {"anyOf": [_KINDS[f.kind], {"type": "null"}], "default": None} for f in JOB_POSTINGS.fields}
_TASK = ('{"want":"extraction_spec","detail_pages":false,"target":' + _GOAL + ',"item":' + json.dumps(
    {"type": "object", "properties": _ITEM, "required": ["title", "company", "url"]}, separators=(",", ":")) + "}")


def _spec(spec: ExtractionSpec) -> str:
    return spec.to_json().replace("'", "''")


ORACLES: dict[str, str] = {
    "page_title": f"""SELECT page_id, {_collapsed(_text("regexp_extract(html, '(?s)<title>(.*?)(</title>|$)', 1)"))} AS title FROM pages""",
    "nav_links_abs": f"""WITH {_NAV} SELECT page_id, row_no, {_text("regexp_extract(item, '>([^<]*)$', 1)")} AS label,
      {_text("regexp_extract(item, 'href=\"([^\"]*)\"', 1)")} AS href,
      regexp_extract(url, '^https?://[^/?#]+') || {_text("regexp_extract(item, 'href=\"([^\"]*)\"', 1)")} AS target FROM i""",
    "regex_track_id": r"""SELECT page_id, CAST(nullif(regexp_extract(html, 'track\((\d+)\)', 1), '') AS BIGINT) AS track,
      upper(nullif(regexp_extract(html, '<html lang="(\w+)"', 1), '')) AS lang FROM pages""",
    "ad_text": f"""SELECT page_id, {_collapsed(_text("regexp_extract(html, '(?s)<div class=\"ad\">(.*?)(</div>|$)', 1)"))} AS ad
      FROM pages WHERE contains(html, '<div class="ad">')""",
    "node_census": r"""SELECT tag, count(*) AS n_nodes FROM (SELECT unnest(regexp_extract_all(
      regexp_replace(html, '(?s)<script>.*?</script>|<!--.*?-->', '', 'g'), '<(a|article|b|br|div|footer|h1|li|nav|p|title|ul)(?: [^>]*)?>', 1)) AS tag FROM pages)
      GROUP BY tag""",
    "repeating_groups": f"""WITH {_NAV}, l AS (SELECT page_id, row_no, {_collapsed(_text("regexp_extract(item, '>([^<]*)$', 1)"))} AS label FROM i)
      SELECT page_id, 'li' AS signature, count(*) AS n_members, '<li> ' || max(label) FILTER (WHERE row_no = 0) AS first_exemplar,
      '<li> ' || max(label) FILTER (WHERE row_no = 1) AS second_exemplar FROM l GROUP BY page_id
      HAVING count(*) >= 3 AND max(label) FILTER (WHERE row_no = 0) <> ''""",
    "render_check": f"""WITH {_SHELLS} SELECT page_id, kind = 0 AS empty_mount, text_chars, kind = 0 OR text_chars < 200 AS needs_render FROM d""",
    "transform_values": _WITH + """SELECT key, title AS trim, 'a ' || company || ' b' AS collapse_ws, lower(company) AS lower, upper(board) AS upper,
      salary_min AS int, CAST(salary_min AS DOUBLE) + 0.75 AS float, day || 'T00:00:00' AS iso_date,
      CASE key % 7 WHEN 0 THEN 'https://h.ex/up' WHEN 1 THEN 'https://h.ex/a/x' WHEN 2 THEN 'https://h.ex/a/b?z=2' WHEN 3 THEN 'https://o.ex/p'
        WHEN 4 THEN 'mailto:a@h.ex' WHEN 5 THEN 'https://h.ex/root' ELSE 'https://h.ex/a/b?q=1#f' END AS abs_url,
      CASE key % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 3 THEN true WHEN 4 THEN false END AS bool FROM c""",
    "normalized_urls": """SELECT page_id, url || '%20x' AS value, 'Input should be a valid URL, relative URL without a base' AS relative_error,
      regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages""",
    "international_hosts": """SELECT page_id, regexp_extract(url, '^(https?://)', 1) || CASE page_id % 5 WHEN 0 THEN 'xn--bcher-kva.example' WHEN 1 THEN 'xn--mnchen-3ya.xn--bcher-kva.example'
        WHEN 2 THEN 'xn--wgv71a119e.example' WHEN 3 THEN 'xn--e1afmkfd.example' ELSE 'plain.example' END || regexp_extract(url, '^https?://[^/?#]+(.*)$', 1) AS value FROM pages""",
    "hashed_tokens": """SELECT source, count(*) AS n_tokens, count(*) FILTER (WHERE regexp_matches(token, '[0-9]') AND regexp_matches(lower(token), '[0-9a-f]{4,}')) AS n_hashed
      FROM (SELECT source, unnest(string_split_regex(text, '[^A-Za-z0-9]+')) AS token FROM documents) WHERE token <> '' GROUP BY source""",
    "cards_css": _ITEMS,
    "cards_xpath": _ITEMS,
    "cards_jsonld": _ITEMS,
    "cards_by_spec": _WITH + """SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'css' WHEN 1 THEN 'xpath' ELSE 'jsonld' END AS spec_id, row_no, title,
      CAST(salary_min AS VARCHAR) AS salary_min, 'int' AS kind, 'absent' AS missing_kind FROM k""",
    "jsonld_in_dom_row": _WITH + """SELECT page_id, key AS req, first_value(title) OVER (PARTITION BY page_id ORDER BY key) AS first_title,
      lower(arg_min(location, CASE WHEN location IS NOT NULL THEN key END) OVER (PARTITION BY page_id)) AS first_place FROM k""",
    "jsonld_objects": _WITH + """SELECT page_id, row_no AS seq, 'JobPosting' AS type, title, CAST(salary_min AS VARCHAR) AS min_value,
      CAST(NULL AS VARCHAR) AS not_scalar, true AS is_job FROM k
      UNION ALL SELECT page_id, count(*), NULL, NULL, NULL, NULL, false FROM k WHERE block % 2 = 1 GROUP BY page_id""",
    "jsonld_types": _WITH + f""", {_PAGES_OF_BOARD} SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '<unparsed-ld>,' ELSE '' END || 'JobPosting,Organization' AS types,
      CASE WHEN page_id % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS n_blocks,
      CASE WHEN page_id % 3 = 0 THEN '{{"@type": oops' WHEN block % 2 = 0 THEN '[{{"@context":"' ELSE '{{"@context":"h' END AS last_block FROM q""",
    "board_outline": _WITH + f", {_SHOWN} SELECT page_id, outline FROM x WHERE row_no = 0",
    "board_prompt": _WITH + f", {_SHOWN} SELECT page_id, prompt, least(length(prompt), 200) AS short_chars FROM pr",
    "validate_quality": _WITH + f""", {_DAMAGE} SELECT page_id, n_rows, valid_count, n_row_errors, company_nulls::DOUBLE AS company_nulls, round(url_nulls, 6)::DOUBLE AS url_nulls,
      valid_count >= 15 AS floor_ok, title_nulls <= 0.5 AND company_nulls <= 0.5 AND url_nulls <= 0.5 AS null_ok,
      valid_count >= 15 AND title_nulls <= 0.5 AND company_nulls <= 0.5 AND url_nulls <= 0.5 AS ok,
      concat_ws('; ', CASE WHEN valid_count < 15 THEN 'min_rows: ' || valid_count || ' of 15' END,
        CASE WHEN title_nulls > 0.5 THEN {_null_gate('title', 'CAST(round_even(title_nulls * 100, 0) AS BIGINT)')} END,
        CASE WHEN company_nulls > 0.5 THEN {_null_gate('company')} END,
        CASE WHEN url_nulls > 0.5 THEN {_null_gate('url', 'CAST(round_even(url_nulls * 100, 0) AS BIGINT)')} END) AS gates,
      n_row_errors + CAST(valid_count < 15 AS BIGINT) + CAST(title_nulls > 0.5 AS BIGINT) + CAST(company_nulls > 0.5 AS BIGINT) + CAST(url_nulls > 0.5 AS BIGINT) AS n_errors FROM g""",
    "validation_errors": _WITH + """SELECT page_id, row_no, 'url' AS field, 'url[' || row_no || ']: URL input should be a string or URL' AS message FROM k WHERE key % 3 = 0""",
    "valid_items": _WITH + """SELECT page_id, row_no, CASE WHEN key % 5 = 0 THEN '' ELSE title END AS title, CASE WHEN board_no = 5 THEN '' ELSE company END AS company,
      location, salary_min, salary_max, job_url, day || ' 00:00:00' AS posted_at, day || 'T00:00:00' AS posted_at_iso FROM k WHERE key % 3 <> 0""",
    "rejected_items": _WITH + """SELECT page_id, row_no, CASE WHEN key % 5 = 0 THEN '' ELSE title END AS title, salary_min, CAST(1 AS BIGINT) AS n_errors FROM k WHERE key % 3 = 0""",
    "coerce_values": _WITH + """SELECT key, CASE WHEN key % 11 <> 0 THEN company END AS name, CASE WHEN key % 7 < 4 THEN salary_min END AS amount,
      CASE key % 5 WHEN 0 THEN 'https://jobs.example.com/j?id=' || salary_min WHEN 3 THEN 'http://a.example/' END AS link,
      CASE key % 6 WHEN 0 THEN day || 'T00:00:00' WHEN 1 THEN day || 'T10:20:30Z' WHEN 2 THEN day || 'T10:20:00+02:00' WHEN 4 THEN '2024-05-01T00:00:00Z' END AS seen_iso,
      key % 11 <> 0 AND key % 7 < 4 AND key % 5 IN (0, 3) AND key % 6 IN (0, 1, 2, 4) AS valid,
      concat_ws('; ', CASE WHEN key % 11 = 0 THEN 'name: Input should be a valid string' END,
        CASE WHEN key % 7 >= 4 THEN 'amount: Input should be a valid integer, unable to parse string as an integer' END,
        CASE key % 5 WHEN 1 THEN 'link: URL scheme should be ''http'' or ''https''' WHEN 2 THEN 'link: Input should be a valid URL, relative URL without a base'
          WHEN 4 THEN 'link: Input should be a valid URL, input is empty' END,
        CASE WHEN key % 6 IN (3, 5) THEN 'seen: Input should be a valid datetime or date' END) AS problems FROM c""",
    "template_fingerprint": _WITH + """, f AS (SELECT page_id, page_url, CASE WHEN board_no IN (4, 5) THEN board_no ELSE 0 END AS kind, location IS NULL AS no_place, block % 10 = 9 AS is_last FROM k WHERE row_no = 0)
      SELECT count(*) AS n_pages, CAST(1 AS BIGINT) AS n_hosts, min(page_url) AS sample_url FROM f GROUP BY kind, no_place, is_last""",
    "page_templates": _WITH + """SELECT (SELECT count(*) FROM pages) AS n_given, count(*) AS n_board, CAST(0 AS BIGINT) AS n_mixed,
      count(DISTINCT CAST(location IS NULL AS VARCHAR) || CAST(block % 10 = 9 AS VARCHAR)) AS n_board_templates FROM k WHERE row_no = 0""",
    "drift_status": _WITH + f", {_VISIT} SELECT page_id, url, cache_status FROM r",
    "candidate_choice": _WITH + f""", {_PAGES_OF_BOARD} SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'model-2' ELSE 'model-3' END AS model,
      CASE WHEN page_id % 2 = 0 THEN 2 ELSE 3 END::BIGINT AS attempt, true AS ok, n AS valid_count, CAST(0 AS BIGINT) AS n_errors,
      CASE WHEN page_id % 2 = 0 THEN 2 ELSE 3 END::BIGINT AS attempts,
      CASE WHEN page_id % 2 = 0 THEN 2 * (page_id % 100) + 1 ELSE 3 * (page_id % 100) + 3 END AS tokens_in,
      CASE WHEN page_id % 2 = 0 THEN 30 ELSE 60 END::BIGINT AS tokens_out FROM q""",
    "best_effort_choice": _WITH + f""", {_PAGES_OF_BOARD} SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'model-2' ELSE 'model-1' END AS model,
      CASE WHEN page_id % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS attempt, page_id % 2 = 0 AS ok, CASE WHEN page_id % 2 = 0 THEN n ELSE 0 END AS valid_count,
      CAST(2 AS BIGINT) AS attempts, 2 * (page_id % 100) + 1 AS tokens_in, CAST(30 AS BIGINT) AS tokens_out FROM q""",
    "spec_faults": _WITH + f""", {_PAGES_OF_BOARD} SELECT page_id, attempt, attempt = 5 AS ok, CASE WHEN attempt = 5 THEN n ELSE 0 END AS valid_count,
      CASE attempt WHEN 1 THEN 'unreadable JSON' WHEN 3 THEN 'field ''posted_at''' WHEN 5 THEN NULL ELSE 'field ''title''' END AS fault
      FROM q, (SELECT unnest([1, 2, 3, 4, 5])::BIGINT AS attempt)""",
    "own_specs": _WITH + """SELECT page_id, substr(sha256('{"container_selector": "li.opening:nth-child(n+' || (page_id % 3 + 1)
        || ')", "field_rules": [{"field": "title", "selector": "h2", "selector_type": "css", "transform": "trim"}], "notes": "' || page_url || '"}'), 1, 16) AS spec_id,
      row_no - page_id % 3 AS row_no, title FROM k WHERE row_no >= page_id % 3""",
    "attempt_log": _WITH + f""", {_PAGES_OF_BOARD}, t AS (SELECT unnest([1, 2, 3])::BIGINT AS attempt)
      SELECT page_id, attempt, 'model-' || attempt || ' attempt ' || attempt || ': ' ||
      CASE WHEN attempt = 1 THEN '4 error(s), 0 valid rows' WHEN attempt = 2 AND page_id % 2 = 1 THEN (n + 2) || ' error(s), 0 valid rows' ELSE 'ok' END AS line FROM q, t""",
    "spec_requests": _WITH + f""", {_SHOWN} SELECT page_id, 'miss' AS cache_status, prompt AS page, '{_GOAL}' AS target, sha256('{_TASK}') AS task_sha,
      length('{{"task":{_TASK},"page":' || CAST(to_json({{'text': prompt}}) AS VARCHAR) || '}}') AS chars FROM pr WHERE block % 3 <> 0""",
    "repair_requests": _WITH + f""", {_SHOWN}, {_PAGES_OF_BOARD}, m AS (SELECT page_id, string_agg('"company[' || row_no || ']: Input should be a valid string"', ',' ORDER BY row_no) AS msgs,
        count(*) FILTER (WHERE location IS NULL) / count(*) AS place_nulls FROM k GROUP BY page_id),
      a AS (SELECT page_id, CAST(1 AS BIGINT) AS attempt, '' AS msgs, ['min_rows: 0 of 1', {_null_gate('title')}, {_null_gate('company')}, {_null_gate('url')}] AS gates, [100, 100, 100, 100, 100, 100, 100] AS nulls,
          '{_spec(BROKEN_SPEC)}' AS spec FROM q
        UNION ALL SELECT page_id, 2, msgs, ['min_rows: 0 of 1', {_null_gate('company')}], [100, CAST(round_even(place_nulls * 100, 0) AS BIGINT), 0, 0, 0, 0, 0], '{_spec(WEAK_SPEC)}' FROM m WHERE page_id % 2 = 1)
      SELECT a.page_id, attempt, '{{"rows":[' || msgs || '],"gates":[' || array_to_string(['"' || g || '"' FOR g IN gates], ',') || '],"nulls":['
        || array_to_string(['{{"field":"' || f[1] || '","null":"' || f[2] || '%"}}' FOR f IN list_zip(['company', 'location', 'posted_at', 'salary_max', 'salary_min', 'title', 'url'], nulls)], ',') || ']}}' AS faults,
        CAST(attempt AS VARCHAR) AS tried, sha256(spec) AS spec_sha, prompt AS page FROM a JOIN pr ON pr.page_id = a.page_id""",
    "registry_upsert": """WITH o AS (SELECT o_orderkey AS k, 'https://shop.example.com/o/' || o_orderkey AS url, o_custkey AS cust, o_orderkey % 3 = 0 AND o_orderstatus <> 'P' AS fresh FROM orders)
      SELECT substr(sha256(url || chr(0) || 'job_postings'), 1, 16) AS cache_key, url, CASE WHEN fresh THEN repeat('0', 16) ELSE repeat('f', 16) END AS fingerprint,
      CASE WHEN fresh THEN 'model-b' ELSE 'model-a' END AS model, CASE WHEN k % 5 <> 0 THEN '2024-01-01 00:00:00' ELSE '2024-06-01 12:00:00' END AS created_at,
      CASE WHEN fresh THEN '2024-06-01 12:00:00' ELSE '2024-01-01 00:00:00' END AS last_seen_at, CASE WHEN fresh THEN 'run-2' ELSE 'run-1' END AS run_id,
      cust AS tokens_in, CASE WHEN fresh THEN 2 ELSE 1 END::BIGINT AS tokens_out FROM o WHERE fresh OR k % 5 <> 0""",
    "registry_commits": """WITH o AS (SELECT o_orderkey AS k, 'https://shop.example.com/o/' || o_orderkey AS url, o_custkey AS cust, o_orderkey % 3 = 0 AND o_orderstatus <> 'P' AS fresh, o_orderkey % 5 <> 0 AS old FROM orders)
      SELECT substr(sha256(url || chr(0) || 'job_postings'), 1, 16) AS cache_key, url, CASE WHEN fresh THEN repeat('0', 16) ELSE repeat('f', 16) END AS fingerprint,
      CASE WHEN fresh THEN 'model-b' WHEN old THEN 'model-a' ELSE 'model-c' END AS model, CASE WHEN old OR NOT fresh THEN '2024-01-01 00:00:00' ELSE '2024-06-01 12:00:00' END AS created_at,
      CASE WHEN fresh THEN '2024-06-01 12:00:00' WHEN old THEN '2024-01-01 00:00:00' ELSE '2023-12-31 00:00:00' END AS last_seen_at, CASE WHEN fresh THEN 'run-2' WHEN old THEN 'run-1' ELSE 'run-0' END AS run_id,
      cust AS tokens_in, CASE WHEN fresh THEN 2 ELSE 1 END::BIGINT AS tokens_out FROM o WHERE fresh OR old OR k % 7 = 0""",
    "pagination_walk": _WITH + f""", {_PAGES_OF_BOARD}, z AS (SELECT unnest(range(7)) AS seq)
      SELECT s.url AS seed, seq, 'https://jobs.example.com/' || s.board || '/page/' || (s.block + seq) AS url, h.url IS NULL AS missing_page
      FROM q s CROSS JOIN z LEFT JOIN q h ON h.board = s.board AND h.block = s.block + seq LEFT JOIN q b ON b.board = s.board AND b.block = s.block + seq - 1
      WHERE s.block % 10 = 0 AND (seq = 0 OR b.url IS NOT NULL)""",
    "crawl_items": _WITH + """SELECT 'https://jobs.example.com/' || board || '/page/' || (block - block % 10) AS seed, block % 10 AS seq, row_no,
      row_number() OVER (PARTITION BY board, block // 10 ORDER BY block, key) - 1 AS run_row, title FROM k""",
    "detail_enrich": _WITH + """
      SELECT 'https://jobs.example.com/' || board || '/page/' || (block - block % 10) AS seed, block % 10 AS seq, row_no, title, location,
      CASE WHEN key % 13 <> 0 THEN 'Work for ' || company || ' on request ' || key || '.' END AS description FROM k""",
    "crawl_counters": _WITH + """SELECT 'https://jobs.example.com/' || board || '/page/' || (block // 10 * 10) AS seed, count(DISTINCT page_id) AS pages_crawled,
      least(count(*), 30) AS detail_pages_fetched, 'https://jobs.example.com/' || board || '/page/' || max(block) AS last_page FROM k GROUP BY board, block // 10""",
    "crawl_quality": _WITH + """SELECT 'https://jobs.example.com/' || board || '/page/' || (block // 10 * 10) AS run_id, count(*) AS n_rows, count(*) FILTER (WHERE key % 3 <> 0) AS valid_count,
      count(*) FILTER (WHERE key % 3 = 0) AS n_row_errors, max(board_no) <> 5 AS ok FROM k GROUP BY board, block // 10""",
    "crawl_manifest": _WITH + """, e AS (SELECT DISTINCT board || '-' || (block // 10) AS run_id, 'page' AS kind, block % 10 AS seq, page_url AS url,
        CASE WHEN block % 10 = 0 THEN 'page.html' ELSE 'pages/' || lpad(CAST(block % 10 + 1 AS VARCHAR), 3, '0') || '.html' END AS file FROM k
      UNION ALL SELECT board || '-' || (block // 10), 'detail', key, job_url, 'detail/' || substr(sha256(job_url), 1, 8) || '.html' FROM k)
      SELECT *, count(*) FILTER (WHERE kind = 'page') OVER (PARTITION BY run_id) AS max_pages, count(*) FILTER (WHERE kind = 'detail') OVER (PARTITION BY run_id) AS max_detail FROM e""",
    "url_policy": """WITH h AS (SELECT page_id, url, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/?#]+(.*)$', 1) AS path FROM pages)
      SELECT page_id, url, CASE length(host) % 5 WHEN 0 THEN NOT (starts_with(path, '/en/') OR starts_with(path, '/es/3'))
        WHEN 2 THEN starts_with(path, '/en/1') OR NOT starts_with(path, '/en') ELSE true END AS allowed FROM h""",
    "run_records": _WITH + f""", {_VISIT} SELECT page_id, run_id, cache_status, model, rows_extracted, final_status, attempts::BIGINT AS attempts, tokens_in, tokens_out::BIGINT AS tokens_out,
      CAST(1 AS BIGINT) AS pages_crawled, gates FROM r""",
    "robots_as_of": """WITH h AS (SELECT page_id, url, regexp_extract(url, '^https?://[^/?#]+(.*)$', 1) AS path FROM pages)
      SELECT page_id, url, CASE WHEN page_id % 31 BETWEEN 2 AND 9 THEN NOT starts_with(path, '/en/') WHEN page_id % 31 >= 20 THEN NOT starts_with(path, '/es/')
        ELSE true END AS allowed FROM h""",
    "crawl_runs": _WITH + f""", {_VISIT}, g AS (SELECT p.page_id, p.url, p.phase, p.n, max(board) AS board, max(block) AS block FROM p JOIN k ON k.page_id = p.page_id GROUP BY ALL),
      w AS (SELECT s.page_id AS run, s.phase AS start, h.*, h.block - s.block = row_number() OVER (PARTITION BY s.page_id ORDER BY h.block) - 1 AS linked
        FROM g s JOIN g h ON h.board = s.board AND h.block // 10 = s.block // 10 AND h.block >= s.block WHERE s.block % 10 IN (0, 3, 5)),
      m AS (SELECT run, start, count(*) AS pages_crawled, max_by(url, block) AS last_page, CAST(coalesce(sum(n) FILTER (WHERE start <> 0 OR phase <> 1), 0) AS BIGINT) AS n_rows,
        coalesce(sum(n) FILTER (WHERE phase = 2), 0) AS lost, max(n) FILTER (WHERE page_id = run) AS own FROM w WHERE linked GROUP BY run, start),
      v AS (SELECT *, lost / n_rows > 0.5 AS failed FROM m)
      SELECT run AS page_id, 'run-2-' || run AS run_id, CASE start WHEN 0 THEN 'hit' WHEN 3 THEN 'miss' ELSE 'drift_regenerated' END AS cache_status,
      CASE start WHEN 0 THEN 'model-a' ELSE 'model-2' END AS model, n_rows AS rows_extracted, CASE WHEN failed THEN 'failed' ELSE 'ok' END AS final_status,
      CASE start WHEN 0 THEN 1 ELSE 2 END::BIGINT AS attempts, CASE start WHEN 0 THEN 0 ELSE 30 END::BIGINT AS tokens_in, CASE start WHEN 0 THEN 0 ELSE 3 END::BIGINT AS tokens_out,
      CASE WHEN failed THEN 1 ELSE 0 END::BIGINT AS n_errors, pages_crawled, last_page,
      CASE WHEN failed THEN 'null_rate company: ' || CAST(round_even(lost / n_rows * 100, 0) AS BIGINT) || '% over 50%' ELSE '' END AS gates,
      CASE start WHEN 0 THEN '' ELSE 'model-1 attempt 1: 4 error(s), 0 valid rows; model-2 attempt 2: ' || CASE start WHEN 2 THEN '1 error(s), ' || own || ' valid rows' ELSE 'ok' END END AS tried FROM v""",
    "run_rollup": _WITH + f""", {_VISIT} SELECT cache_status, count(*) AS n_runs, count(*) FILTER (WHERE final_status = 'failed') AS n_failed, CAST(sum(rows_extracted) AS BIGINT) AS rows_extracted,
      count(*) AS pages_crawled, CAST(0 AS BIGINT) AS detail_pages_fetched, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out,
      CASE cache_status WHEN 'hit' THEN 'stored spec fits' WHEN 'miss' THEN 'url without stored spec'
        ELSE 'stored spec replaced' END AS message FROM r GROUP BY cache_status""",
    "run_registry": _WITH + f""", {_VISIT}, w AS (SELECT *, page_id % 2 = 0 AND phase IN (1, 3) AS fresh FROM r)
      SELECT substr(sha256(url || chr(0) || 'job_postings'), 1, 16) AS cache_key, url, CASE WHEN fresh THEN 'model-2' ELSE 'model-a' END AS model,
      CASE WHEN phase = 3 THEN '2024-06-01 12:00:00' ELSE '2024-01-01 00:00:00' END AS created_at,
      CASE WHEN fresh OR phase = 0 THEN '2024-06-01 12:00:00' ELSE '2024-01-01 00:00:00' END AS last_seen_at,
      CASE WHEN fresh THEN run_id ELSE 'run-1' END AS run_id, CASE WHEN fresh THEN tokens_in ELSE 100 END AS tokens_in, CASE WHEN fresh THEN 30 ELSE 10 END::BIGINT AS tokens_out
      FROM w WHERE fresh OR phase <> 3""",
    "refetch_queue": f"""WITH {_SHELLS} SELECT 'run-' || page_id AS run_id, page_id, 'https://app.example.com/d/' || page_id AS url FROM d
      WHERE page_id % 4 = 2 AND (kind = 0 OR text_chars < 200)""",
}
