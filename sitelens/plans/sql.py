"""SQL text for the comparison database: text functions, pages read by patterns, facts of a site."""

from __future__ import annotations

from sitelens.functions import text as T
from sitelens.functions import urls as U
from sitelens.operators import html as H
from sitelens.operators import site as L

STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
TOK = r"list_transform(regexp_extract_all(lower({0}), '[a-z0-9][a-z0-9''’-]*'), lambda w: regexp_replace(w, '[''’]s$', ''))"
CONTENT = f"list_filter({TOK}, lambda w: length(w) > 2 AND w NOT IN ({STOP}))"
SENT = r"""list_filter(list_transform(string_split(regexp_replace(regexp_replace({0}, '\s+', ' ', 'g'), '([.!?])\s+([A-Z0-9"''“])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"""
HOST = r"lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1))"
PATH = r"regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)"
_MULTI = ", ".join(f"'{m}'" for m in U.MULTI_PART)
FNV = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(list_filter(string_split({0}, ''), lambda c: c <> ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def registrable(host: str) -> str:
    bare = f"regexp_replace({host}, '^www\\.', '')"
    last = f"list_slice(string_split({bare}, '.'), -{{}}, -1)"
    return f"CASE WHEN array_to_string({last.format(2)}, '.') IN ({_MULTI}) THEN array_to_string({last.format(3)}, '.') ELSE array_to_string({last.format(2)}, '.') END"


def has_word(text: str, words: str) -> str:
    return f"regexp_matches({text}, {quoted(rf'(?i)\b({words})\b')})"


def flat(text: str) -> str:
    return rf"trim(regexp_replace({text}, '\s+', ' ', 'g'))"


def stripped(html: str) -> str:
    return f"regexp_replace({html}, '<[^>]*>', '', 'g')"


def decoded(text: str) -> str:
    for entity, character in (("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        text = f"replace({text}, '{entity}', '{character}')"
    return text


def escaped(text: str) -> str:
    """Letters outside ASCII by percent escapes."""
    return f"array_to_string(list_transform(string_split({text}, ''), lambda c: CASE WHEN unicode(c) > 127 THEN url_encode(c) ELSE c END), '')"


_BODY = "regexp_replace(regexp_replace(html, '(?is)^.*?<body[^>]*>', ''), '(?is)</body>.*$', '')"
_BODY = f"regexp_replace({_BODY}, '(?s)<!--.*?-->', '', 'g')"
for _tag in sorted(H.DROPPED):
    _BODY = f"regexp_replace({_BODY}, '(?is)<{_tag}[^>]*>.*?</{_tag}>', '', 'g')"
_PARAGRAPHS = f"list_transform((string_split(content, '<p>'))[2:], lambda x: {stripped('regexp_replace(x, ' + quoted('(?is)(</(p|article|body)>|<h[1-6]>).*$') + ', ' + quoted('') + ')')})"
CHALLENGED = "regexp_matches(substr(html, 1, 20000), " + quoted("(?i)" + "|".join(p.removeprefix("(?i)") for _, p in H.CHALLENGES)) + ")"


def counted(html: str, tag: str) -> str:
    return f"len(regexp_extract_all({html}, '(?i)<{tag}[ >]'))::BIGINT"


def shingle_rows(source: str, key: str, words: str, extra: str = "", whole: bool = False) -> str:
    """Rows (key, h) of the hashes that the shingles of each row keep; of all hashes of whole texts if ``whole``."""
    extra = f"{extra}, " if extra else ""
    grams = f"SELECT {extra}{key}, unnest(range(1, len(w) - 3)) AS pos, w FROM (SELECT {extra}{key}, {words} AS w FROM {source}) WHERE len(w) >= 5"
    hashed = f"SELECT {extra}{key}, pos, {FNV.format('array_to_string(list_slice(w, pos, pos + 4), chr(32))')} AS h FROM ({grams})"
    if whole:
        return f"SELECT DISTINCT {extra}{key}, h FROM ({hashed})"
    first = f"SELECT {extra}{key}, h, row_number() OVER (PARTITION BY {key} ORDER BY min(pos)) AS k FROM ({hashed}) GROUP BY {extra}{key}, h"
    kept = f"SELECT {extra}{key}, h, row_number() OVER (PARTITION BY {key} ORDER BY h) AS j FROM ({first}) WHERE k <= 1600"
    return f"SELECT {extra}{key}, h FROM ({kept}) WHERE j <= 400"


SHINGLED, SHINGLED_WHOLE = (shingle_rows("pg", "page_id", CONTENT.format("body"), "audit_id", whole) for whole in (False, True))
_ANCHOR = r"(?is)<a href=\"[^\"]*\"[^>]*>(.*?)</a>".replace('\\"', '"')
PAGES = rf"""WITH raw AS (SELECT page_id::BIGINT AS page_id, url, html, {HOST} AS audit_id, len(list_filter(string_split({PATH}, '/'), lambda p: p <> ''))::INT AS depth, {_BODY} AS content,
 nullif({decoded("trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1))")}, '') AS title, regexp_extract(html, '(?i)<html[^>]* lang="([^"]*)"', 1) AS lang,
 list_filter(list_transform(regexp_extract_all(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), lambda x: {decoded(flat(stripped('x')))}), lambda x: x <> '') AS h1s,
 list_filter(list_transform(regexp_extract_all(html, '(?is)<h[1-6][^>]*>(.*?)</h[1-6]>', 1), lambda x: {decoded(flat(stripped('x')))}), lambda x: x <> '') AS heads FROM pages),
 cooked AS (SELECT *, {decoded(flat(stripped('content')))} AS body, {decoded("array_to_string(list_transform(" + _PARAGRAPHS + ", lambda x: x), chr(2))")} AS paras,
 list_distinct(list_transform(list_filter(regexp_extract_all(html, '(?i)<a href="([^"]*)"', 1), lambda u: u LIKE '/%' AND NOT regexp_matches(u, {quoted(U.ASSET)})),
  lambda u: lower(regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1)) || CASE WHEN u = '/' THEN '/' ELSE {escaped("regexp_replace(u, '/+$', '')")} END)) AS internal,
 list_filter(heads, lambda x: length(trim(x)) >= 6 AND (trim(x) LIKE '%?' OR regexp_matches(trim(x), {quoted(T.STARTERS)}))) AS asked,
 list_filter(list_transform(regexp_extract_all(html, {quoted(_ANCHOR)}, 1), lambda x: {decoded(flat(stripped('x')))}), lambda x: x <> '') AS anchors,
 regexp_matches(html, '(?i)<meta[^>]*name="robots"[^>]*noindex') AS noindex, {counted('html', 'ul')} AS ul, {counted('html', 'ol')} AS ol, {counted('html', 'article')} AS articles, {counted('html', 'nav')} AS navs, {counted('html', 'img')} AS images,
 lower(url || ' ' || coalesce(title, '') || ' ' || array_to_string(heads, ' ')) AS haystack,
 CASE WHEN {PATH} IN ('', '/') THEN regexp_replace(url, '/?$', '/') ELSE regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', '') END AS canonical_url FROM raw),
 parts AS (SELECT *, len({TOK.format('body')})::BIGINT AS word_count, length(body)::DOUBLE / length(html) AS ratio, {SENT.format('body')} AS sentences FROM cooked),
 pg AS (SELECT *, coalesce(list_median(list_transform(sentences, lambda x: len({TOK.format('x')})::DOUBLE)), 0.0::DOUBLE) AS median_sentence,
 coalesce(list_median(list_filter(list_transform(string_split(paras, chr(2)), lambda x: len({TOK.format('x')})::DOUBLE), lambda n: n > 0)), 0.0::DOUBLE) AS median_paragraph,
 len(list_filter(sentences, lambda x: regexp_matches(x, {quoted(T.DEFINITION)})))::BIGINT AS definitions,
 len(list_filter(sentences, lambda x: regexp_matches(x, {quoted(T.STATISTIC)}) AND len({CONTENT.format('x')}) >= 5))::BIGINT AS statistics,
 len(list_filter(sentences, lambda x: len({TOK.format('x')}) BETWEEN 15 AND 45 AND NOT x LIKE '%?' AND NOT regexp_matches(x, {quoted(T.CONNECTIVE)}) AND len({CONTENT.format('x')}) >= 7))::BIGINT AS quotable,
 list_filter(list_transform(string_split(paras, chr(2)), lambda x: {flat('x')}), lambda x: x <> '')[1] AS answer,
 word_count < 120 AND ratio < 0.02 AND (regexp_matches(html, 'id="(root|app|__next)"') OR len(regexp_extract_all(html, '<script[^>]* src=')) > 3) AS csr,
 CASE {" ".join(f"WHEN {has_word('haystack', w)} THEN '{n}'" for n, w in T.INTENTS)} ELSE 'navigational' END AS intent FROM parts),
 shingled AS ({SHINGLED})"""
TOPIC = "(url || ' ' || coalesce(title, ''))"
CLAUSE = r"trim(regexp_replace(h1s[1], '([.;]|\s[—–-]\s).*$', ''))"
HOST_BRAND = "list_transform(list_filter(string_split(regexp_replace(regexp_replace(audit_id, '^www\\.', ''), '\\..*$', ''), '-'), lambda x: x <> ''), lambda x: upper(substr(x, 1, 1)) || substr(x, 2))"
TAIL = "CASE WHEN len(title_parts) >= 2 AND length(title_parts[-1]) <= 40 AND len(string_split_regex(title_parts[-1], '\\s+')) <= 5 THEN title_parts[-1] END"
FORM = "regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]', '', 'g'), '" + L.LEGAL + "', '')"
EDITORIAL, ESSAYS, ABOUT, CONTACT, PEOPLE, COMMERCIAL, GENERIC, NEAR, LEAST_SHINGLES = L.EDITORIAL, L.ESSAYS, L.ABOUT, L.CONTACT, L.PEOPLE, L.COMMERCIAL, L.GENERIC, L.NEAR, L.LEAST_SHINGLES


def count_of(condition: str) -> str:
    return f"count(*) FILTER ({condition})"


def url_has(pattern: str) -> str:
    return f"regexp_matches(url, {quoted(pattern)})"
