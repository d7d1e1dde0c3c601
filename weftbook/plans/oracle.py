"""The same questions in SQL for DuckDB, over the same tables.

Written from the rules, apart from the DataFrame code; only used for checking.
"""

from __future__ import annotations

import re

from ..schemas import TABLES


def _minutes(n: str) -> str:
    return f"(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST({n} AS INT)))"


def _article(key: str) -> str:
    return f"""
  CASE WHEN {key} % 4 = 0 THEN NULL ELSE concat('/img/', {key}, '.png') END AS featured_image,
  CASE WHEN {key} % 11 = 0 THEN NULL ELSE {key} % 5 END AS category_id,
  CASE WHEN {key} % 13 = 0 THEN NULL ELSE {key} % 120 END AS author_id,
  CASE {key} % 7 WHEN 0 THEN 'draft' WHEN 1 THEN 'review' WHEN 2 THEN 'archived' ELSE 'published' END AS status,
  CASE WHEN {key} % 7 < 3 OR {key} % 17 = 0 THEN NULL ELSE {_minutes(f'({key} * 7919) % 100003')} END AS published_at,
  {_minutes(f'{key} % 1000003')} AS created_at,
  {_minutes(f'{key} % 1000003 + 60')} AS updated_at,
  CASE {key} % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('seo ', {key}) END AS seo_title,
  CASE {key} % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('about ', {key}) END AS seo_description,
  CAST(NULL AS VARCHAR) AS canonical_url"""


def _bridge(table: str, key: str, owner: str) -> str:
    return f"""SELECT {key} AS {owner}, {key} % 25 AS tag_id FROM {table}
UNION SELECT {key}, ({key} * 3 + 1) % 25 FROM {table}"""


_REGION = "SELECT r_regionkey AS id, r_name AS name, lower(replace(r_name, ' ', '-')) AS slug FROM region"

VIEWS = {
    "users": "SELECT s_suppkey AS id, s_name AS username, concat('u', s_suppkey, '@example.org') AS email,"
    " s_acctbal >= 0 AS is_active FROM supplier",
    "tags": "SELECT n_nationkey AS id, lower(n_name) AS name, lower(n_name) AS slug FROM nation",
    "news_tags": _bridge("documents", "doc_id", "news_id"),
    "knowledge_tags": _bridge("pages", "page_id", "knowledge_id"),
    "news_categories": _REGION,
    "knowledge_categories": _REGION,
    "tool_categories": _REGION,
    "company_categories": "SELECT n_nationkey AS id, n_name AS name, lower(n_name) AS slug FROM nation",
    "news_articles": "SELECT doc_id AS id, 'Piece ' || doc_id || ' of ' || source || ' in ' || lang || ', the ' || n_chars || ' characters' AS title,"
    " concat('doc-', doc_id) AS slug, 'A text of ' || n_chars || ' characters in the language ' || lang || ', taken from the source '"
    " || source || ' and kept under the number ' || doc_id || '; it is shown with its category, its author and tags, and with the"
    f" day on which it came out' AS summary, text AS content, {_article('doc_id')} FROM documents",
    "knowledge_articles": "SELECT page_id AS id, url AS title, concat('page-', page_id) AS slug,"
    f" concat('Page at ', url) AS summary, html AS content, {_article('page_id')} FROM pages",
    "companies": f"""SELECT c_custkey AS id, c_name AS name, concat('c-', c_custkey) AS slug,
  c_name || ' of the ' || lower(c_mktsegment) || ' trade, listed with all of its open jobs and services; balance '
    || CAST(CAST(trunc(c_acctbal) AS INT) AS VARCHAR) || ' in the directory of makers, traders and service houses'
    || ' of this district and its neighbours' AS description,
  CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE concat('/logo/', c_custkey, '.png') END AS logo,
  CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_nationkey END AS category_id,
  concat('https://c', c_custkey, '.example.org') AS website, concat('c', c_custkey, '@example.org') AS email,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE concat('+00-', c_custkey) END AS phone,
  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS address,
  CASE c_custkey % 6 WHEN 0 THEN 'draft' WHEN 1 THEN 'archived' ELSE 'published' END AS status,
  {_minutes('(c_custkey * 37) % 10007')} AS created_at,
  CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('seo ', c_custkey) END AS seo_title,
  CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('about ', c_custkey) END AS seo_description
FROM customer""",
    "jobs": """SELECT o_orderkey AS id, concat(o_orderpriority, ' ', o_orderkey) AS title,
  concat('job-', o_orderkey) AS slug, o_orderpriority AS description, o_custkey AS company_id,
  concat('zone ', o_orderkey % 9) AS location,
  CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('up to ', o_orderkey % 90) END AS salary_range,
  CASE o_orderkey % 4 WHEN 0 THEN 'Full-time' WHEN 1 THEN 'Part-time' WHEN 2 THEN 'Contract' ELSE 'Internship' END
    AS job_type,
  CASE o_orderstatus WHEN 'O' THEN 'published' WHEN 'F' THEN 'archived' ELSE 'draft' END AS status,
  o_orderdate AS created_at,
  CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('seo ', o_orderkey) END AS seo_title,
  CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('about ', o_orderkey) END AS seo_description
FROM orders""",
    "services": "SELECT s_suppkey AS id, s_name AS name, concat('s-', s_suppkey) AS slug,"
    " concat(s_name, ' service') AS description, s_suppkey AS provider_id,"
    " CASE WHEN s_suppkey % 5 = 0 THEN 'draft' ELSE 'published' END AS status FROM supplier",
    "tools": "SELECT p_partkey AS id, p_name AS name, concat('t-', p_partkey) AS slug,"
    " concat(p_type, ' ', p_brand) AS description,"
    " CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE p_partkey % 5 END AS category_id,"
    " CASE WHEN p_partkey % 6 = 0 THEN 'draft' ELSE 'published' END AS status FROM part",
    "media": f"""SELECT page_id AS id, CASE page_id % 23 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE url END AS filename,
  CASE page_id % 6 WHEN 0 THEN '89504E470D0A1A0A0000000D' WHEN 1 THEN 'FFD8FFE000104A4649460001'
    WHEN 2 THEN '474946383961010001008000' WHEN 3 THEN '524946462400000057454250'
    WHEN 4 THEN '524946462400000057415645' ELSE '3C21444F4354595045206874' END AS header_hex,
  CAST(CASE page_id % 9 WHEN 0 THEN 5242880 WHEN 1 THEN 5242881 ELSE strlen(html) + 12 END AS BIGINT) AS file_size,
  CASE WHEN page_id % 13 = 0 THEN NULL ELSE page_id % 120 END AS uploaded_by_id,
  {_minutes('(page_id * 31) % 5003')} AS created_at
FROM pages""",
    "checked_media": """SELECT *, CASE file_type WHEN 'image/png' THEN '.png' WHEN 'image/jpeg' THEN '.jpg'
    WHEN 'image/gif' THEN '.gif' WHEN 'image/webp' THEN '.webp' END AS extension,
  CASE WHEN coalesce(filename, '') = '' THEN 'No file selected.' WHEN file_size > 5 * 1024 * 1024 THEN 'File size exceeds the 5MB maximum limit.'
    WHEN file_type IS NULL THEN 'Invalid file format.' END AS reject_reason
FROM (SELECT *, CASE WHEN header_hex LIKE '89504E470D0A1A0A%' THEN 'image/png'
    WHEN header_hex LIKE 'FFD8FF%' THEN 'image/jpeg'
    WHEN header_hex LIKE '474946383761%' OR header_hex LIKE '474946383961%' THEN 'image/gif'
    WHEN header_hex LIKE '52494646________57454250' THEN 'image/webp' END AS file_type FROM media)""",
    "contact_messages": """SELECT event_id AS id,
  CASE event_id % 19 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE concat('user-', user_id) END AS name,
  concat('u', user_id, '@example.org') AS email, event_type AS subject, props AS message, ts AS created_at
FROM events""",
    "checked_messages": """SELECT *, false AS is_read,
  CASE WHEN coalesce(name, '') = '' OR coalesce(email, '') = '' OR coalesce(subject, '') = ''
    OR coalesce(message, '') = '' THEN 'Missing required fields' END AS reject_reason
FROM contact_messages""",
    "questions": "SELECT conv_id, turn, text FROM conversations WHERE role = 'user'",
    "styles": """SELECT
  concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT)) AS style_id,
  l_orderkey AS group_id, (l_quantity - 1) / 2 AS smv,
  CASE WHEN l_linenumber = 7 THEN -100.0E0 ELSE l_linenumber * 5.0E0 END AS allowance,
  CASE WHEN l_linenumber = 1 THEN 0.0E0 ELSE 60.0E0 + l_quantity * 2 END AS efficiency,
  CASE WHEN l_linenumber = 1 THEN 0.0E0 ELSE 60.0E0 + l_quantity * 2 END AS line_efficiency,
  l_quantity / 10 AS swatch_weight, CASE WHEN l_linenumber % 2 = 0 THEN 'rectangular' ELSE 'circular' END AS swatch_type,
  CAST(l_linenumber * 5 AS DOUBLE) AS swatch_length, CAST(10 AS DOUBLE) AS swatch_width,
  (l_quantity - 1) / 4 AS seam_length,
  CASE l_linenumber % 3 WHEN 0 THEN '301' WHEN 1 THEN '401' ELSE '504' END AS stitch_class,
  40.0E0 + l_linenumber AS chest, 60.0E0 + l_linenumber AS body_length, 140.0E0 + l_quantity * 3 AS gsm,
  l_discount * 1000 AS wastage, l_discount * 600 AS fabric_wastage, 3.0E0 + l_tax AS yarn, 0.5E0 AS knit,
  l_tax * 10 AS dye, CAST(l_linenumber * 4 AS DOUBLE) AS operators, 12.0E0 AS wage, l_quantity * 10 AS overhead,
  l_quantity * 20 AS target, l_tax * 1000 AS trims, l_discount AS accessories, 0.4E0 AS logistics,
  l_discount * 3000 - 60 AS margin
FROM lineitem""",
    "closed_companies": "SELECT c_custkey AS id FROM customer WHERE c_acctbal < 0",
    "closed_users": "SELECT s_suppkey AS id FROM supplier WHERE s_acctbal < 0",
    "closed_categories": "SELECT r_regionkey AS id FROM region WHERE r_name LIKE 'A%'",
}


def _with(body: str, extra: dict[str, str] | None = None) -> str:
    """Put the views a statement uses in front of it, in order of need."""
    known = {**VIEWS, **(extra or {})}
    order: list[str] = []

    def need(text: str) -> None:
        for name in known:
            if name not in order and known[name] and re.search(rf"\b{name}\b", text):
                need(known[name])
                if name not in order:
                    order.append(name)

    need(body)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{name} AS (\n{known[name]}\n)" for name in order) + "\n" + body


def _fixed(x: str, digits: int) -> str:
    """Decimal text with ties away from zero."""
    scaled = f"({x}) * {float(2 ** (digits + 1))}E0"
    return (
        f"printf('%.{digits}f', CASE WHEN abs({scaled}) < 4503599627370496.0E0 AND abs(fmod({scaled}, 2.0E0)) = 1.0E0"
        f" THEN ({x}) * 1.000000000001E0 WHEN ({x}) = 0 THEN 0.0E0 ELSE ({x}) END)"
    )


def _text(x: str, digits: int, before: str = "", after: str = "") -> str:
    """NULL stays NULL, which printf would not keep."""
    return f"CASE WHEN ({x}) IS NOT NULL THEN '{before}' || {_fixed(x, digits)} || '{after}' END"


def _iso(ts: str) -> str:
    return f"regexp_replace(strftime({ts}, '%Y-%m-%dT%H:%M:%S.%f'), '\\.000000$', '')"


def _cut(x: str) -> str:
    return (
        f"CASE WHEN length({x}) <= 155 THEN {x} ELSE"
        f" regexp_replace(substring({x}, 1, 147), ' [^ ]*$', '') || '...' END"
    )


def _any_like(word: str, *fields: str) -> str:
    return "(" + " OR ".join(f"coalesce({f} ILIKE '%{word}%', false)" for f in fields) + ")"


ORACLE: dict[str, str] = {}


def _add(name: str, body: str, extra: dict[str, str] | None = None) -> None:
    ORACLE[name] = _with(body, extra)


_COLUMNS = {
    "users": "id username email is_active",
    "tags": "id name slug",
    "news_tags": "news_id tag_id",
    "knowledge_tags": "knowledge_id tag_id",
    "news_categories": "id name slug",
    "knowledge_categories": "id name slug",
    "company_categories": "id name slug",
    "tool_categories": "id name slug",
    "news_articles": "id title slug summary content featured_image category_id author_id status published_at created_at"
    " updated_at seo_title seo_description canonical_url",
    "knowledge_articles": "id title slug summary content featured_image category_id author_id status published_at"
    " created_at updated_at seo_title seo_description canonical_url",
    "companies": "id name slug description logo category_id website email phone address status created_at seo_title"
    " seo_description",
    "jobs": "id title slug description company_id location salary_range job_type status created_at seo_title seo_description",
    "services": "id name slug description provider_id status",
    "tools": "id name slug description category_id status",
    "media": "id filename file_size uploaded_by_id created_at",
    "contact_messages": "id name email subject message created_at",
}
_add(
    "scan_catalogue",
    "\nUNION ALL\n".join(
        f"SELECT '{t}' AS table_name, count(*) AS n, "
        + " + ".join(f"count(*) FILTER ({c} IS NULL)" for c in columns.split())
        + f" AS missing FROM {t}"
        for t, columns in _COLUMNS.items()
    ),
)

_add(
    "stored_roundtrip",
    "\nUNION ALL\n".join(
        f"SELECT '{t}' AS table_name, count(*) AS n, "
        + " + ".join(f"count(*) FILTER ({c} IS NULL)" for c in columns.split())
        + f" + {len(TABLES[t].columns) - len(columns.split())} * count(*) AS missing FROM {t}"
        for t, columns in _COLUMNS.items()
    ),
)

_JOB_FEED = f"""SELECT j.id, j.title, j.slug, j.description, j.location, j.salary_range, j.job_type, c.name AS company,
  {_iso('j.created_at')} AS created_at
FROM jobs j LEFT JOIN companies c ON c.id = j.company_id WHERE j.status = 'published'"""
_add(
    "feed_json_export",
    f"""SELECT id, CAST(json_object('id', id, 'title', title, 'slug', slug, 'description', description,
  'location', location, 'salary_range', salary_range, 'job_type', job_type, 'company', company,
  'created_at', created_at) AS VARCHAR) AS record FROM ({_JOB_FEED})""",
)
_add(
    "seed_insert_if_absent",
    """SELECT id, name AS username FROM companies
UNION ALL SELECT id, username FROM users WHERE username NOT IN (SELECT name FROM companies)""",
)
_add(
    "media_intake",
    """SELECT id, filename, '/static/uploads/' || md5(CAST(id AS VARCHAR)) || extension AS filepath, file_type, file_size,
  uploaded_by_id, created_at FROM checked_media WHERE reject_reason IS NULL""",
)

for _kind in ("news", "knowledge"):
    _add(
        f"feed_{_kind}",
        f"""SELECT a.id, a.title, a.slug, a.summary, a.content, a.featured_image, {_iso('a.published_at')} AS published_at,
  c.name AS category, a.seo_title, a.seo_description
FROM {_kind}_articles a LEFT JOIN {_kind}_categories c ON c.id = a.category_id
WHERE a.status = 'published' ORDER BY a.published_at DESC NULLS FIRST, a.id""",
    )
_add("feed_jobs", _JOB_FEED)
_add(
    "feed_companies",
    """SELECT c.id, c.name, c.slug, c.description, c.logo, k.name AS category, c.website, c.email, c.phone, c.address
FROM companies c LEFT JOIN company_categories k ON k.id = c.category_id WHERE c.status = 'published'""",
)
ORACLE["feed_json_files"] = ORACLE["feed_companies"]
_add(
    "feed_services",
    """SELECT s.id, s.name, s.slug, s.description, c.name AS provider
FROM services s LEFT JOIN companies c ON c.id = s.provider_id WHERE s.status = 'published'""",
)
_add(
    "feed_tools",
    """SELECT t.id, t.name, t.slug, t.description, k.name AS category
FROM tools t LEFT JOIN tool_categories k ON k.id = t.category_id WHERE t.status = 'published'""",
)


def _meta(kind: str, table: str, title: str, text: str, ending: str, seo: bool = True) -> str:
    if seo:
        title, text = f"coalesce(nullif(seo_title, ''), {title})", f"coalesce(nullif(seo_description, ''), {text})"
    return (
        f"SELECT '{kind}' AS kind, id, {title} || '{ending}' AS page_title, {text} AS meta_description"
        f" FROM {table} WHERE status = 'published'"
    )


_add(
    "seo_metadata",
    "\nUNION ALL\n".join(
        [
            _meta("news", "news_articles", "title", "summary", " — Example News"),
            _meta("knowledge", "knowledge_articles", "title", "summary", " — Garment Knowledge"),
            _meta("jobs", "jobs", "title", "substring(description, 1, 150)", " — Garment Jobs Anytown"),
            _meta("companies", "companies", "name", "substring(description, 1, 150)", " — Garment Manufacturer"),
            _meta("services", "services", "name", "substring(description, 1, 150)", " — Textile Service", seo=False),
        ]
    ),
)
_add(
    "structured_data",
    "\nUNION ALL\n".join(
        f"""SELECT '{kind}' AS kind, a.id, CAST(json_object('@context', 'https://schema.org', '@type', '{record}',
  'headline', a.title, 'description', a.summary, 'datePublished', coalesce({_iso('a.published_at')}, ''),
  'dateModified', coalesce({_iso('a.updated_at')}, ''),
  'author', json_object('@type', 'Person', 'name', coalesce(u.username, '{fallback}'))) AS VARCHAR) AS record
FROM {kind}_articles a LEFT JOIN users u ON u.id = a.author_id WHERE a.status = 'published'"""
        for kind, record, fallback in (
            ("news", "NewsArticle", "Example Editor"),
            ("knowledge", "TechArticle", "Example Specialist"),
        )
    ),
)
_add(
    "cards",
    f"""SELECT 'news' AS kind, a.id, coalesce(c.name, 'News') AS tag, a.title, '/news/' || a.slug AS link,
  a.summary AS teaser, coalesce(strftime(a.published_at, '%d %b %Y'), '') AS note
FROM news_articles a LEFT JOIN news_categories c ON c.id = a.category_id WHERE a.status = 'published'
UNION ALL SELECT 'knowledge', a.id, coalesce(c.name, 'Guide'), a.title, '/knowledge/' || a.slug, a.summary,
  coalesce(strftime(a.published_at, '%d %b %Y'), '')
FROM knowledge_articles a LEFT JOIN knowledge_categories c ON c.id = a.category_id WHERE a.status = 'published'
UNION ALL SELECT 'jobs', j.id, coalesce(j.job_type, 'None'), j.title, '/jobs/' || j.slug, c.name || ' — ' || j.location,
  'Salary: ' || coalesce(nullif(j.salary_range, ''), 'Negotiable')
FROM jobs j LEFT JOIN companies c ON c.id = j.company_id WHERE j.status = 'published'
UNION ALL SELECT 'companies', c.id, coalesce(k.name, 'Manufacturer'), c.name, '/companies/' || c.slug,
  substring(c.description, 1, 120) || '...', '📍 ' || coalesce(c.address, 'None')
FROM companies c LEFT JOIN company_categories k ON k.id = c.category_id WHERE c.status = 'published'
UNION ALL SELECT 'services', s.id, 'Industrial Service', s.name, '/services/' || s.slug,
  substring(s.description, 1, 150) || '...', 'Provider: ' || c.name
FROM services s LEFT JOIN companies c ON c.id = s.provider_id WHERE s.status = 'published'
UNION ALL SELECT 'tools', t.id, coalesce(k.name, 'Tool'), t.name, '/tools/' || t.slug, t.description, NULL
FROM tools t LEFT JOIN tool_categories k ON k.id = t.category_id WHERE t.status = 'published'""",
)
_add(
    "article_pages",
    "\nUNION ALL\n".join(
        f"""SELECT '{kind}' AS kind, a.id, coalesce(c.name, '{tag}') AS tag, a.title,
  coalesce(u.username, '{author}') AS author, coalesce(strftime(a.published_at, '%d %B %Y'), '') AS published,
  replace(a.content, chr(10), '<br>') AS body
FROM {kind}_articles a LEFT JOIN {kind}_categories c ON c.id = a.category_id LEFT JOIN users u ON u.id = a.author_id
WHERE a.status = 'published'"""
        for kind, tag, author in (
            ("news", "General", "Staff Reporter"),
            ("knowledge", "Garment Guide", "Technical Expert"),
        )
    ),
)
_add(
    "job_pages",
    """SELECT j.id, coalesce(j.job_type, 'None') AS tag, j.title, c.name AS company, '/companies/' || c.slug AS company_link,
  j.location, coalesce(nullif(j.salary_range, ''), 'Negotiable') AS salary, strftime(j.created_at, '%d %B %Y') AS posted,
  replace(j.description, chr(10), '<br>') AS body
FROM jobs j LEFT JOIN companies c ON c.id = j.company_id WHERE j.status = 'published'""",
)
_add(
    "company_pages",
    """SELECT c.id, coalesce(k.name, 'Company') AS tag, c.name, nullif(c.website, '') AS website, nullif(c.email, '') AS email,
  nullif(c.phone, '') AS phone, replace(c.description, chr(10), '<br>') AS body
FROM companies c LEFT JOIN company_categories k ON k.id = c.category_id WHERE c.status = 'published'""",
)
_add(
    "service_pages",
    """SELECT s.id, s.name, c.name AS provider, '/companies/' || c.slug AS provider_link,
  replace(s.description, chr(10), '<br>') AS body
FROM services s LEFT JOIN companies c ON c.id = s.provider_id WHERE s.status = 'published'""",
)
_add(
    "localised_columns",
    """SELECT id, name, description, CAST(NULL AS VARCHAR) AS name_ta, CAST(NULL AS VARCHAR) AS name_ta_en,
  CAST(NULL AS VARCHAR) AS description_ta, CAST(NULL AS VARCHAR) AS description_ta_en, name AS shown FROM tools
UNION ALL SELECT id, name, description, 'ta ' || name, NULL, NULL, NULL, 'ta ' || name FROM services""",
)

_SIX = {
    "news": "news_articles",
    "knowledge": "knowledge_articles",
    "jobs": "jobs",
    "companies": "companies",
    "services": "services",
    "tools": "tools",
}
_add(
    "published_only",
    "\nUNION ALL\n".join(f"SELECT '{k}' AS kind, id, slug FROM {t} WHERE status = 'published'" for k, t in _SIX.items()),
)
_add(
    "slug_points",
    """SELECT kind, c.id, c.slug, c.name FROM companies c, (SELECT unnest(['id', 'slug']) AS kind) k
WHERE c.id IN (SELECT company_id FROM jobs WHERE company_id IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, company_id LIMIT 5)""",
)
_add(
    "slug_lookup",
    """SELECT e.event_id AS request_id, 'c-' || e.user_id AS slug, c.id, c.id IS NOT NULL AS found
FROM events e LEFT JOIN companies c ON c.slug = 'c-' || e.user_id AND c.status = 'published'""",
)
_add(
    "category_feed",
    """SELECT a.id, a.title, a.slug, c.name AS category, a.published_at
FROM news_articles a JOIN news_categories c ON c.id = a.category_id WHERE a.status = 'published' AND c.slug = 'asia'""",
)


def _search(kind: str, word: str) -> str:
    top = "ORDER BY id LIMIT 10"
    if kind in ("news", "knowledge"):
        rows = (
            f"SELECT * FROM {kind}_articles WHERE status = 'published' AND {_any_like(word, 'title', 'summary', 'content')} {top}"
        )
        if kind == "news":
            note = "'Published on ' || coalesce(strftime(x.published_at, '%d-%m-%Y'), '')"
            return f"SELECT 'news' AS section, x.id, x.title, x.slug, x.summary AS text, {note} AS note FROM ({rows}) x"
        return (
            "SELECT 'knowledge' AS section, x.id, x.title, x.slug, x.summary AS text,"
            f" 'Category: ' || coalesce(c.name, 'General') AS note FROM ({rows}) x"
            " LEFT JOIN knowledge_categories c ON c.id = x.category_id"
        )
    if kind == "jobs":
        rows = f"SELECT * FROM jobs WHERE status = 'published' AND {_any_like(word, 'title', 'description', 'location')} {top}"
        return (
            f"SELECT 'jobs' AS section, x.id, x.title, x.slug, {_cut('x.description')} AS text,"
            f" 'Company: ' || c.name || ' | Location: ' || x.location AS note FROM ({rows}) x"
            " LEFT JOIN companies c ON c.id = x.company_id"
        )
    if kind == "companies":
        rows = f"SELECT * FROM companies WHERE status = 'published' AND {_any_like(word, 'name', 'description', 'address')} {top}"
        return (
            f"SELECT 'companies' AS section, x.id, x.name AS title, x.slug, {_cut('x.description')} AS text,"
            f" 'Address: ' || coalesce(x.address, 'None') AS note FROM ({rows}) x"
        )
    rows = f"SELECT * FROM tools WHERE status = 'published' AND {_any_like(word, 'name', 'description')} {top}"
    return (
        "SELECT 'tools' AS section, x.id, x.name AS title, x.slug, x.description AS text,"
        f" CAST(NULL AS VARCHAR) AS note FROM ({rows}) x"
    )


_WORDS = {"news": "the", "knowledge": "the", "jobs": "urge", "companies": "build", "tools": "brand#1"}
for _kind, _word in _WORDS.items():
    _add(f"keyword_search_{_kind}", _search(_kind, _word))
_add("search_all", "\nUNION ALL\n".join(f"SELECT * FROM ({_search(k, 'the')})" for k in _WORDS))
_add(
    "search_totals",
    "SELECT section, CAST(sum(hits) AS BIGINT) AS hits FROM ("
    + "\nUNION ALL\n".join(
        f"SELECT '{k}' AS section, count(*) AS hits FROM ({_search(k, 'the')})"
        f" UNION ALL SELECT 'all', count(*) FROM ({_search(k, 'the')})"
        for k in _WORDS
    )
    + ") GROUP BY section",
)
_INDEXED = [*{**_WORDS, "jobs": "URGE"}.items(), ("news", "th%ing"), ("knowledge", "t_e r"), ("tools", "d#"), ("companies", "ld_ng%"), ("jobs", "gen")]
_add("keyword_search_indexed", "\nUNION ALL\n".join(f"SELECT *, '{w}' AS query FROM ({_search(k, w)})" for k, w in _INDEXED))
_add("contact_required", "SELECT * FROM checked_messages")
_add("media_accept", "SELECT id, file_size, file_type, extension, reject_reason FROM checked_media")

_FOUR = {
    "news": ("news_articles", "news_categories"),
    "knowledge": ("knowledge_articles", "knowledge_categories"),
    "companies": ("companies", "company_categories"),
    "tools": ("tools", "tool_categories"),
}
_add(
    "with_category",
    "\nUNION ALL\n".join(
        f"SELECT '{k}' AS kind, x.id, CAST(x.category_id AS BIGINT) AS category_id, c.name AS category"
        f" FROM {t} x LEFT JOIN {c} c ON c.id = x.category_id"
        for k, (t, c) in _FOUR.items()
    ),
)
_add(
    "with_author",
    """SELECT 'news' AS kind, a.id, coalesce(u.username, 'Staff Reporter') AS author
FROM news_articles a LEFT JOIN users u ON u.id = a.author_id
UNION ALL SELECT 'knowledge', a.id, coalesce(u.username, 'Technical Expert')
FROM knowledge_articles a LEFT JOIN users u ON u.id = a.author_id""",
)
for _name in ("jobs_with_company", "jobs_with_company_spread", "jobs_with_company_colocated"):
    _add(
        _name,
        "SELECT j.id, j.title, j.company_id, c.name AS company, c.slug AS company_slug"
        " FROM jobs j LEFT JOIN companies c ON c.id = j.company_id",
    )
_add(
    "services_with_provider",
    "SELECT s.id, s.name, s.provider_id, c.name AS provider, c.slug AS provider_slug"
    " FROM services s LEFT JOIN companies c ON c.id = s.provider_id",
)


def _related(table: str, group: str, title: str) -> str:
    """Candidates are the four lowest ids of a group: the naive pairing gives the same rows."""
    return f"""SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY related_id) AS INT) AS rank, related_id,
  related_title, related_slug
FROM (SELECT a.id, b.id AS related_id, b.{title} AS related_title, b.slug AS related_slug
  FROM {table} a JOIN (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY id) AS rn
    FROM {table} WHERE status = 'published') b
    ON a.{group} IS NOT DISTINCT FROM b.{group} AND a.id <> b.id AND b.rn <= 4
  WHERE a.status = 'published')
QUALIFY row_number() OVER (PARTITION BY id ORDER BY related_id) <= 3"""


_add("related_news", _related("news_articles", "category_id", "title"))
_add("related_knowledge", _related("knowledge_articles", "category_id", "title"))
_add("related_jobs", _related("jobs", "company_id", "title"))
_add("related_jobs_spread", _related("jobs", "company_id", "title"))
_add("related_tools", _related("tools", "category_id", "name"))
for _name in ("company_profile", "company_profile_colocated"):
    _add(
        _name,
        """SELECT c.id AS company_id, c.name AS company, 'company' AS section, c.id AS item_id, c.name AS title, c.slug,
  CAST(NULL AS VARCHAR) AS detail, coalesce(j.n, 0) AS n_jobs, coalesce(s.n, 0) AS n_services
FROM shown_companies c
LEFT JOIN (SELECT company_id, count(*) AS n FROM jobs WHERE status = 'published' GROUP BY 1) j ON j.company_id = c.id
LEFT JOIN (SELECT provider_id, count(*) AS n FROM services WHERE status = 'published' GROUP BY 1) s ON s.provider_id = c.id
UNION ALL SELECT c.id, c.name, 'jobs', j.id, j.title, j.slug, j.job_type || ' | ' || j.location, NULL, NULL
FROM shown_companies c JOIN jobs j ON j.company_id = c.id WHERE j.status = 'published'
UNION ALL SELECT c.id, c.name, 'services', s.id, s.name, s.slug, substring(s.description, 1, 100), NULL, NULL
FROM shown_companies c JOIN services s ON s.provider_id = c.id WHERE s.status = 'published'""",
        {"shown_companies": "SELECT * FROM companies WHERE status = 'published'"},
    )
_add(
    "articles_with_tags",
    "\nUNION ALL\n".join(
        f"""SELECT '{k}' AS kind, a.id AS article_id, a.title, a.slug, b.tag_id, t.name AS tag
FROM {k}_articles a JOIN {k}_tags b ON b.{k}_id = a.id JOIN tags t ON t.id = b.tag_id WHERE a.status = 'published'"""
        for k in ("news", "knowledge")
    ),
)
_add(
    "tool_page_bundle",
    """SELECT t.id, t.slug, coalesce(string_agg(r.related_slug, '|' ORDER BY r.rank), '') AS related_slugs,
  coalesce(string_agg(r.related_title, '|' ORDER BY r.rank), '') AS related_names,
  (SELECT string_agg(slug, '|' ORDER BY id) FROM (SELECT id, slug FROM knowledge_articles WHERE status = 'published'
    ORDER BY id LIMIT 2)) AS guide_slugs
FROM tools t LEFT JOIN related r ON r.id = t.id WHERE t.status = 'published' GROUP BY t.id, t.slug""",
    {"related": _related("tools", "category_id", "name")},
)

_REVERSE = {
    "news of category": ("news_categories", "news_articles", "category_id"),
    "guides of category": ("knowledge_categories", "knowledge_articles", "category_id"),
    "companies of category": ("company_categories", "companies", "category_id"),
    "tools of category": ("tool_categories", "tools", "category_id"),
    "news of author": ("users", "news_articles", "author_id"),
    "guides of author": ("users", "knowledge_articles", "author_id"),
    "media of user": ("users", "media", "uploaded_by_id"),
    "jobs of company": ("companies", "jobs", "company_id"),
    "services of company": ("companies", "services", "provider_id"),
}
_add(
    "reverse_relations",
    "\nUNION ALL\n".join(
        f"SELECT '{name}' AS relation, CAST(p.id AS BIGINT) AS parent_id, c.id AS child_id"
        f" FROM {parent} p LEFT JOIN {child} c ON c.{key} = p.id"
        for name, (parent, child, key) in _REVERSE.items()
    ),
)
_add(
    "reverse_relations_colocated",
    "\nUNION ALL\n".join(
        f"SELECT '{name}' AS relation, CAST(p.id AS BIGINT) AS parent_id, c.id AS child_id"
        f" FROM companies p LEFT JOIN {child} c ON c.{key} = p.id"
        for name, child, key in (("jobs of company", "jobs", "company_id"), ("services of company", "services", "provider_id"))
    ),
)
_add(
    "reverse_relation_counts",
    "\nUNION ALL\n".join(
        f"SELECT '{name}' AS relation, CAST(p.id AS BIGINT) AS parent_id, count(c.id) AS children,"
        f" min(c.id) AS first_id, max(c.id) AS last_id"
        f" FROM {parent} p LEFT JOIN {child} c ON c.{key} = p.id GROUP BY p.id"
        for name, (parent, child, key) in _REVERSE.items()
    ),
)

_FIVE = {k: t for k, t in _SIX.items() if k != "services"}
_add("dashboard_counts", "\nUNION ALL\n".join(f"SELECT '{k}' AS kind, count(*) AS n FROM {t}" for k, t in _FIVE.items()))
_add(
    "page_counts",
    "\nUNION ALL\n".join(
        f"SELECT '{k}' AS feed, count(*) AS total, CAST(ceil(count(*) / 10.0) AS BIGINT) AS pages"
        f" FROM {_SIX[k]} WHERE status = 'published'"
        for k in ("news", "knowledge", "jobs", "companies")
    ),
)
_add(
    "paged_feed",
    """SELECT id, title, slug, created_at, position, (position - 1) // 10 + 1 AS page_no
FROM (SELECT id, title, slug, created_at, row_number() OVER (ORDER BY created_at DESC NULLS FIRST, id) AS position
  FROM jobs WHERE status = 'published')""",
)
_add(
    "page_of_feed",
    """SELECT id, title, published_at FROM news_articles WHERE status = 'published'
ORDER BY published_at DESC NULLS FIRST, id LIMIT 10 OFFSET 20""",
)
_add(
    "page_of_feed_deep",
    """SELECT id, title, published_at, row_number() OVER (ORDER BY published_at DESC NULLS FIRST, id) AS position
FROM news_articles WHERE status = 'published' QUALIFY position BETWEEN 21 AND 30""",
)
_add(
    "latest_published",
    "\nUNION ALL\n".join(
        f"SELECT * FROM (SELECT '{k}' AS kind, id, title, published_at FROM {k}_articles WHERE status = 'published'"
        " ORDER BY published_at DESC NULLS FIRST, id LIMIT 3)"
        for k in ("news", "knowledge")
    ),
)
_add(
    "latest_jobs",
    "SELECT id, title, created_at FROM jobs WHERE status = 'published' ORDER BY created_at DESC NULLS FIRST, id LIMIT 3",
)
_add(
    "first_n",
    "\nUNION ALL\n".join(
        f"SELECT * FROM (SELECT '{k}' AS kind, id, slug FROM {t} WHERE status = 'published' ORDER BY id LIMIT {n})"
        for k, t, n in (("tools", "tools", 4), ("companies", "companies", 4), ("guides", "knowledge_articles", 2))
    ),
)
for _kind in ("news", "knowledge"):
    _add(
        f"admin_lists_{_kind}",
        f"""SELECT a.id, a.title, coalesce(c.name, 'None') AS category, upper(a.status) AS status,
  coalesce(strftime(a.published_at, '%d-%m-%Y'), 'Not Published') AS published
FROM {_kind}_articles a LEFT JOIN {_kind}_categories c ON c.id = a.category_id""",
    )
_add(
    "admin_lists_jobs",
    "SELECT j.id, j.title, c.name AS company, j.location, j.job_type, upper(j.status) AS status"
    " FROM jobs j LEFT JOIN companies c ON c.id = j.company_id",
)
_add(
    "admin_lists_companies",
    "SELECT c.id, c.name, c.slug, coalesce(k.name, 'None') AS category, upper(c.status) AS status"
    " FROM companies c LEFT JOIN company_categories k ON k.id = c.category_id",
)
_add(
    "admin_lists_media",
    """SELECT id, filename, 'Size: ' || CAST(round_even(file_size / 1024, 1) AS VARCHAR) || ' KB | Type: '
  || upper(split_part(file_type, '/', -1)) AS label FROM checked_media WHERE reject_reason IS NULL""",
)
_INBOX = "FROM checked_messages WHERE reject_reason IS NULL ORDER BY created_at DESC NULLS FIRST, id LIMIT 5"
_add("inbox_latest5", f"SELECT id, strftime(created_at, '%d-%m-%Y %H:%M') AS received, name, email, subject, message {_INBOX}")

_SITEMAP = (
    """SELECT 'https://example.org' || path AS loc, changefreq, priority FROM (VALUES ('/', 'daily', '1.0'),
  ('/news', 'daily', '0.9'), ('/knowledge', 'weekly', '0.8'), ('/jobs', 'daily', '0.8'), ('/companies', 'weekly', '0.7'),
  ('/services', 'weekly', '0.6'), ('/tools', 'monthly', '0.9'), ('/ai-studio', 'monthly', '0.7'))
  AS standing(path, changefreq, priority)\n"""
    + "".join(
        f"UNION ALL SELECT 'https://example.org/{path}/' || slug, '{often}', '{weight}' FROM {table} {where}\n"
        for table, path, where, often, weight in (
            ("news_articles", "news", "WHERE status = 'published'", "weekly", "0.8"),
            ("knowledge_articles", "knowledge", "WHERE status = 'published'", "monthly", "0.7"),
            ("jobs", "jobs", "WHERE status = 'published'", "weekly", "0.7"),
            ("companies", "companies", "WHERE status = 'published'", "weekly", "0.6"),
            ("tools", "tools", "WHERE status = 'published'", "monthly", "0.8"),
            ("news_categories", "news/category", "", "weekly", "0.7"),
            ("knowledge_categories", "knowledge/category", "", "weekly", "0.6"),
            ("tool_categories", "tools/category", "", "weekly", "0.7"),
        )
    )
)
_add("sitemap", _SITEMAP)

for _name in ("sitemap_export", "sitemap_by_change"):
    _add(
        _name,
        "SELECT loc, CAST(NULL AS VARCHAR) AS lastmod, changefreq, priority FROM addresses",
        {"addresses": _SITEMAP},
    )


def _block(table: str, order: str, n: int) -> str:
    return (
        f"(SELECT *, CAST(row_number() OVER (ORDER BY {order}) AS INT) AS rank FROM {table} WHERE status = 'published'"
        f" QUALIFY rank <= {n})"
    )


_LATEST, _RECENT = "published_at DESC NULLS FIRST, id", "created_at DESC NULLS FIRST, id"
_add(
    "homepage",
    f"""SELECT 'news' AS kind, x.id, coalesce(c.name, 'General') AS tag, x.title, '/news/' || x.slug AS link,
  x.summary AS teaser, coalesce(strftime(x.published_at, '%d %B %Y'), '') AS note, x.rank
FROM {_block('news_articles', _LATEST, 3)} x LEFT JOIN news_categories c ON c.id = x.category_id
UNION ALL SELECT 'tools', x.id, coalesce(c.name, 'Tool'), x.name, '/tools/' || x.slug, x.description, NULL, x.rank
FROM {_block('tools', 'id', 4)} x LEFT JOIN tool_categories c ON c.id = x.category_id
UNION ALL SELECT 'jobs', x.id, coalesce(x.job_type, 'None'), x.title, '/jobs/' || x.slug, c.name || ' — ' || x.location,
  'Salary: ' || coalesce(nullif(x.salary_range, ''), 'Negotiable'), x.rank
FROM {_block('jobs', _RECENT, 3)} x LEFT JOIN companies c ON c.id = x.company_id
UNION ALL SELECT 'companies', x.id, NULL, x.name, '/companies/' || x.slug, NULL, NULL, x.rank
FROM {_block('companies', 'id', 4)} x
UNION ALL SELECT 'knowledge', x.id, coalesce(c.name, 'Guide'), x.title, '/knowledge/' || x.slug, x.summary,
  'Published: ' || coalesce(strftime(x.published_at, '%d %b %Y'), ''), x.rank
FROM {_block('knowledge_articles', _LATEST, 3)} x LEFT JOIN knowledge_categories c ON c.id = x.category_id""",
)


def _slug(x: str) -> str:
    """European accents only, as the test texts have them."""
    plain = f"regexp_replace(replace(strip_accents({x}), '/', ' '), '[^\\x00-\\x7F]', '', 'g')"
    words = f"trim(regexp_replace({plain}, '[ \\t\\n\\r\\f\\v\\x1c-\\x1f]+', ' ', 'g'))"
    kept = f"regexp_replace(replace({words}, ' ', '_'), '[^A-Za-z0-9_.-]', '', 'g')"
    return f"lower(trim({kept}, '._'))"


_CREATED = f"""SELECT item_id + 100000000000 AS id, title,
  {_slug("coalesce(nullif(given, ''), replace(lower(title), ' ', '-'))")} AS slug, summary, text AS content,
  CASE WHEN item_id % 4 = 0 THEN NULL ELSE item_id % 5 END AS category_id, item_id % 120 AS author_id,
  coalesce(asked, 'draft') AS status, CASE WHEN asked = 'published' THEN moment END AS published_at,
  moment AS created_at, moment AS updated_at
FROM (SELECT *, 'Entry Ñ' || item_id || ' / of the set' AS title, 'Passage ' || item_id || ' as it was sent in' AS summary,
    CASE item_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('Item ', item_id, '/New') END AS given,
    CASE item_id % 3 WHEN 0 THEN 'published' WHEN 1 THEN NULL ELSE 'review' END AS asked,
    {_minutes('item_id % 1000003')} AS moment FROM benchmark)"""
_EDITED = f"""SELECT a.id, CASE WHEN l.doc_id IS NULL THEN a.title ELSE concat('Final ', l.doc_id) END AS title,
  CASE WHEN l.doc_id IS NULL THEN a.slug WHEN l.toxic = 1 THEN concat('final-', l.doc_id)
    ELSE lower(replace(concat('Doc ', l.doc_id), ' ', '_')) END AS slug,
  CASE WHEN l.doc_id IS NULL THEN a.summary WHEN l.toxic = 1 THEN NULL ELSE 'final' END AS summary,
  CASE WHEN l.doc_id IS NULL THEN a.content ELSE 'final text' END AS content,
  CASE WHEN l.doc_id IS NULL THEN a.category_id END AS category_id, a.author_id,
  CASE WHEN l.doc_id IS NULL THEN a.status WHEN l.toxic = 1 THEN 'archived' ELSE 'published' END AS status,
  CASE WHEN a.published_at IS NOT NULL THEN a.published_at
    WHEN l.quality = 1 THEN {_minutes('200000 + l.doc_id % 1000003')}
    WHEN l.toxic = 0 THEN {_minutes('300000 + l.doc_id % 1000003')} END AS published_at,
  a.created_at,
  CASE WHEN l.doc_id IS NULL THEN a.updated_at ELSE {_minutes('300000 + l.doc_id % 1000003')} END AS updated_at,
  CASE WHEN l.doc_id IS NULL THEN a.featured_image END AS featured_image,
  CASE WHEN l.doc_id IS NULL THEN a.seo_title END AS seo_title
FROM news_articles a LEFT JOIN labels l ON l.doc_id = a.id"""
_ARTICLE_STATE = (
    "id, title, slug, summary, content, category_id, author_id, status, published_at, created_at, updated_at"
)
_add("apply_creates", f"SELECT {_ARTICLE_STATE} FROM news_articles UNION ALL {_CREATED}")
_add("apply_edits", _EDITED)
_CHANGED = (
    f"SELECT {_ARTICLE_STATE} FROM (SELECT {_ARTICLE_STATE} FROM ({_EDITED}) UNION ALL {_CREATED})"
    " WHERE id NOT IN (SELECT vec_id FROM embeddings)"
)
_add("apply_changes", _CHANGED)
_add("stored_changes", _CHANGED)
_add("maintained_counts", f"SELECT status, category_id, count(*) AS n FROM ({_CHANGED}) GROUP BY status, category_id")
_add("apply_deletes", "SELECT id, slug, status FROM news_articles WHERE id NOT IN (SELECT vec_id FROM embeddings)")
_add(
    "delete_outcomes",
    "SELECT DISTINCT e.vec_id AS id, p.page_id IS NOT NULL AS found FROM embeddings e LEFT JOIN pages p ON p.page_id = e.vec_id",
)
for _name in ("cascade_delete", "cascade_delete_spread"):
    _add(
        _name,
        """SELECT 'companies' AS kind, id FROM companies WHERE id NOT IN (SELECT id FROM closed_companies)
UNION ALL SELECT 'jobs', id FROM jobs WHERE company_id NOT IN (SELECT id FROM closed_companies)
UNION ALL SELECT 'services', id FROM services WHERE provider_id NOT IN (SELECT id FROM closed_companies)""",
    )
_add(
    "set_null_on_delete",
    """SELECT id, CASE WHEN category_id NOT IN (SELECT id FROM closed_categories) THEN category_id END AS category_id,
  CASE WHEN author_id NOT IN (SELECT id FROM closed_users) THEN author_id END AS author_id FROM news_articles""",
)


def _report(table: str, rule: str, column: str, key: str, n: str, rest: str) -> str:
    return (
        f"SELECT '{table}' AS table_name, '{rule}' AS rule, '{column}' AS column_name, CAST({key} AS VARCHAR) AS key,"
        f" CAST({n} AS BIGINT) AS n {rest}"
    )


_add(
    "violations_unique",
    "\nUNION ALL\n".join(
        [
            _report("news_articles", "unique", "content", "sha256(content)", "count(*)",
                    "FROM news_articles GROUP BY content HAVING count(*) > 1"),
            _report("styles", "unique", "group_id,stitch_class", "group_id || '/' || stitch_class", "count(*)",
                    "FROM styles GROUP BY group_id, stitch_class HAVING count(*) > 1"),
            _report("tools", "unique", "name", "name", "count(*)", "FROM tools GROUP BY name HAVING count(*) > 1"),
        ]
    ),
)
def _all_rules() -> list[str]:
    parts = []
    for table, columns in _COLUMNS.items():
        rule, held = TABLES[table], set(columns.split())
        for key in rule.unique:
            if held.issuperset(key):
                names, given = ", ".join(key), " AND ".join(f"{c} IS NOT NULL" for c in key)
                text = " || '/' || ".join(f"CAST({c} AS VARCHAR)" for c in key)
                parts.append(_report(table, "unique", ",".join(key), text, "count(*)",
                                     f"FROM {table} WHERE {given} GROUP BY {names} HAVING count(*) > 1"))
        for c, (_, size, required) in rule.columns.items():
            if c not in held:
                continue
            if required:
                parts.append(_report(table, "not null", c, "NULL", "count(*)", f"FROM {table} WHERE {c} IS NULL HAVING count(*) > 0"))
            if size and "id" in held:
                parts.append(_report(table, "length", c, "id", f"length({c})", f"FROM {table} WHERE length({c}) > {size}"))
            if c in rule.foreign_keys:
                parent = rule.foreign_keys[c][0]
                parts.append(_report(table, "foreign key", c, c, "count(*)",
                                     f"FROM {table} WHERE {c} NOT IN (SELECT id FROM {parent}) GROUP BY {c}"))
            if c in rule.domains:
                values = ", ".join(f"'{v}'" for v in rule.domains[c])
                parts.append(_report(table, "domain", c, c, "count(*)", f"FROM {table} WHERE {c} NOT IN ({values}) GROUP BY {c}"))
    return parts


_add("violations_all", "\nUNION ALL\n".join(_all_rules()))


def _rules_on_write():
    for table, rule in TABLES.items():
        held = _COLUMNS[table].split()
        broken = [("not null", c, f"{c} IS NULL" if c in held else "true") for c in rule.required()]
        broken += [("length", c, f"length({c}) > {size}") for c, size in rule.lengths().items() if c in held]
        broken += [("domain", c, f"{c} NOT IN ({', '.join(f'{chr(39)}{v}{chr(39)}' for v in values)})")
                   for c, values in rule.domains.items() if c in held]
        yield f"SELECT '{table}' AS table_name, 'rows' AS rule, CAST(NULL AS VARCHAR) AS column_name, count(*) AS n FROM {table}"
        for name, column, test in broken:
            yield f"SELECT '{table}', '{name}', '{column}', count(*) FROM {table} WHERE {test} HAVING count(*) > 0"


_add("violations_on_write", "\nUNION ALL\n".join(_rules_on_write()))
_add(
    "violations_not_null",
    "\nUNION ALL\n".join(
        _report(table, "not null", c, "NULL", "count(*)", f"FROM {table} WHERE {c} IS NULL HAVING count(*) > 0")
        for table, columns in {
            "contact_messages": ("name", "email", "subject", "message", "created_at"),
            "news_articles": ("title", "category_id", "published_at"),
        }.items()
        for c in columns
    ),
)
_add(
    "violations_foreign_key",
    _report("news_articles", "foreign key", "author_id", "author_id", "count(*)",
            "FROM news_articles WHERE author_id NOT IN (SELECT id FROM users) GROUP BY author_id")
    + "\nUNION ALL\n"
    + _report("jobs", "foreign key", "company_id", "company_id", "count(*)",
              "FROM jobs WHERE company_id NOT IN (SELECT id FROM services) GROUP BY company_id"),
)
_add(
    "violations_length",
    "\nUNION ALL\n".join(
        _report(table, "length", c, "id", f"length({c})", f"FROM {table} WHERE length({c}) > {size}")
        for table, c, size in (
            ("news_articles", "title", 50), ("news_articles", "slug", 6), ("jobs", "title", 15), ("jobs", "location", 5)
        )
    ),
)
_add(
    "violations_domain",
    "\nUNION ALL\n".join(
        _report(table, "domain", c, c, "count(*)", f"FROM {table} WHERE {c} NOT IN {values} GROUP BY {c}")
        for table, c, values in (
            ("news_articles", "status", "('draft', 'published', 'archived')"),
            ("jobs", "status", "('published', 'draft')"),
            ("jobs", "job_type", "('Full-time', 'Part-time')"),
        )
    ),
)
_add(
    "item_slugs",
    f"""SELECT id, {_slug("replace(lower(content), ' ', '-')")} AS made,
  {_slug("coalesce(nullif(seo_title, ''), replace(lower(content), ' ', '-'))")} AS kept FROM news_articles""",
)
_add(
    "browser_numbers",
    f"""SELECT id, k AS number, trunc(k) AS whole, CAST(NULL AS DOUBLE) AS none, {_text('k / 8', 2)} AS eighths,
  {_text('-k / 1000', 1)} AS thousandths
FROM (SELECT event_id AS id, CAST(regexp_extract(props, ': ([0-9.]+)', 1) AS DOUBLE) AS k FROM events)""",
)

_add(
    "intent_routing",
    """SELECT conv_id, turn, CASE WHEN contains(lower(text), 'ther') OR contains(lower(text), 'ing') THEN 'benchmark'
  WHEN contains(lower(text), 'der') THEN 'costing'
  WHEN contains(lower(text), 'ion') OR contains(lower(text), 'ment') THEN 'fabric' ELSE 'fallback' END AS intent
FROM questions WHERE regexp_matches(text, '\\S')""",
)
_add("intent_summary", "SELECT intent, count(*) AS questions FROM routed GROUP BY intent",
     {"routed": ORACLE["intent_routing"].split("\n)\n", 1)[1]})


# ---------------------------------------------------------------- costing


def _zero(x: str, default: str = "0.0E0") -> str:
    return f"(CASE WHEN {x} <> 0 THEN {x} ELSE {default} END)"


def _costing(reason: str, steps: list[tuple[str, str]], source: str = "styles") -> str:
    """Nested selects: first the reason, then one result after the other for accepted rows."""
    sql = f"SELECT *, {reason} AS reject_reason FROM {source}"
    for name, value in steps:
        sql = f"SELECT *, CASE WHEN reject_reason IS NULL THEN {value} END AS {name} FROM ({sql})"
    return sql


def _shown(name: str, sheet: str, numbers: tuple[str, ...], texts: dict[str, str]) -> None:
    cols = [f"round({n}, 6) AS {n}" for n in numbers] + [f"{v} AS {k}" for k, v in texts.items()]
    _add(name, f"SELECT style_id, group_id, reject_reason, {', '.join(cols)} FROM ({sheet})")


_WASTE = "Wastage must be between 0% and 100%."
_sam = _costing(
    "CASE WHEN smv <= 0 THEN 'Please enter a valid SMV value greater than 0.' END",
    [
        ("sam", f"smv * (1 + {_zero('allowance')} / 100)"),
        ("target_per_hour", f"CASE WHEN sam <> 0 THEN (60.0E0 / sam) * ({_zero('efficiency', '100.0E0')} / 100) END"),
    ],
)
_shown(
    "costing_sam",
    _sam,
    ("sam", "target_per_hour"),
    {
        "infinite_target": "sam = 0",
        "sam_text": _text("sam", 3, after=" mins"),
        "target_text": f"CASE WHEN sam = 0 THEN 'Infinity pcs/hr' ELSE {_text('target_per_hour', 1, after=' pcs/hr')} END",
    },
)
_gsm = _costing(
    "CASE WHEN swatch_weight <= 0 THEN 'Please enter a valid weight in grams.'"
    " WHEN swatch_type = 'rectangular' AND (swatch_length <= 0 OR swatch_width <= 0)"
    " THEN 'Please enter valid length and width in cm.' END",
    [
        ("area_cm2", "CASE WHEN swatch_type = 'rectangular' THEN swatch_length * swatch_width ELSE 100.0E0 END"),
        (
            "gsm_value",
            "CASE WHEN swatch_type = 'rectangular' THEN swatch_weight * 10000 / area_cm2 ELSE swatch_weight * 100 END",
        ),
    ],
)
_shown(
    "costing_gsm",
    _gsm,
    ("area_cm2", "gsm_value"),
    {
        "gsm_class": "CASE WHEN gsm_value <= 150 THEN 'Light Weight (e.g. T-shirt, Voile, Chiffon)'"
        " WHEN gsm_value <= 250 THEN 'Medium Weight (e.g. Polo pique, Linen, Oxford)'"
        " WHEN gsm_value > 250 THEN 'Heavy Weight (e.g. Sweatshirt fleece, Denim, Canvas)' END",
        "gsm_text": _text("gsm_value", 1, after=" g/m²"),
        "area_text": _text("area_cm2", 1, after=" cm²"),
    },
)
_thread = _costing(
    f"CASE WHEN seam_length <= 0 THEN 'Please enter a valid positive seam length.'"
    f" WHEN {_zero('wastage')} < 0 OR {_zero('wastage')} > 100 THEN '{_WASTE}' END",
    [
        ("factor", "CASE stitch_class WHEN '401' THEN 4.5E0 WHEN '504' THEN 14.0E0 ELSE 2.5E0 END"),
        ("raw_thread", "seam_length * factor"),
        ("total_thread", f"raw_thread * (1 + {_zero('wastage')} / 100)"),
    ],
)
_shown(
    "costing_thread",
    _thread,
    ("factor", "raw_thread", "total_thread"),
    {
        "factor_text": _text("factor", 1, after="x"),
        "raw_thread_text": _text("raw_thread", 2, after=" m"),
        "thread_text": _text("total_thread", 2, after=" meters"),
    },
)
_WEIGHT_REASON = (
    "CASE WHEN chest <= 0 OR body_length <= 0 OR gsm <= 0"
    " THEN 'Please enter valid positive values for Chest, Body Length and GSM.'"
    f" WHEN {_zero('wastage')} < 0 OR {_zero('wastage')} > 100 THEN '{_WASTE}' END"
)
_WEIGHT_STEPS = [
    ("raw_weight", "((body_length + 4) * (chest + 2) * 2 * gsm) / 10000"),
    ("total_weight", f"raw_weight * (1 + {_zero('wastage')} / 100)"),
    ("dozen_kg", "(total_weight * 12) / 1000"),
]
_shown(
    "costing_fabric_weight",
    _costing(_WEIGHT_REASON, _WEIGHT_STEPS),
    ("raw_weight", "total_weight", "dozen_kg"),
    {
        "raw_weight_text": _text("raw_weight", 1, after=" g"),
        "weight_text": _text("total_weight", 1, after=" grams"),
        "dozen_text": _text("dozen_kg", 2, after=" kg"),
    },
)
_PRICE_REASON = (
    "CASE WHEN yarn < 0 OR knit < 0 OR dye < 0 THEN 'Rates cannot be negative.'"
    f" WHEN {_zero('fabric_wastage')} < 0 OR {_zero('fabric_wastage')} >= 50"
    " THEN 'Fabric wastage must be between 0% and 50% (exclusive).' END"
)
_PRICE_STEPS = [
    ("raw_price", f"{_zero('yarn')} + {_zero('knit')} + {_zero('dye')}"),
    ("fabric_price", f"raw_price / (1 - {_zero('fabric_wastage')} / 100)"),
    ("loss_price", "fabric_price - raw_price"),
]
_shown(
    "costing_fabric_price",
    _costing(_PRICE_REASON, _PRICE_STEPS),
    ("raw_price", "fabric_price", "loss_price"),
    {
        "raw_price_text": _text("raw_price", 2),
        "loss_text": _text("loss_price", 2),
        "fabric_price_text": _text("fabric_price", 2),
    },
)
_CM_REASON = (
    "CASE WHEN trunc(operators) <= 0 OR target <= 0 OR line_efficiency <= 0 THEN"
    " 'Operators count, daily target output, and expected efficiency must be positive numbers.'"
    " WHEN wage < 0 OR overhead < 0 THEN 'Wages and overheads cannot be negative.'"
    " WHEN line_efficiency > 150 THEN 'Efficiency cannot exceed 150%.' END"
)
_CM_STEPS = [
    ("day_cost", "overhead + trunc(operators) * wage"),
    ("expected_output", "target * (line_efficiency / 100)"),
    ("cm_cost", "day_cost / expected_output"),
]
_shown(
    "costing_cm",
    _costing(_CM_REASON, _CM_STEPS),
    ("day_cost", "expected_output", "cm_cost"),
    {
        "day_text": _text("day_cost", 2),
        "output_text": _text("expected_output", 0, after=" pcs"),
        "cm_text": _text("cm_cost", 2),
    },
)


def _fob_reason(fabric: str, cm: str) -> str:
    return (
        f"CASE WHEN {fabric} < 0 OR {cm} < 0 OR trims < 0 OR accessories < 0 OR logistics < 0"
        " THEN 'Cost parameters cannot be negative numbers.'"
        " WHEN margin < -50 OR margin > 200 THEN 'Margin percentage must be between -50% and 200%.' END"
    )


def _fob_steps(fabric: str, cm: str) -> list[tuple[str, str]]:
    return [
        (
            "base_cost",
            f"{_zero(fabric)} + {_zero(cm)} + {_zero('trims')} + {_zero('accessories')} + {_zero('logistics')}",
        ),
        ("fob", f"base_cost * (1 + {_zero('margin')} / 100)"),
        ("profit", "fob - base_cost"),
    ]


_shown(
    "costing_fob",
    _costing(_fob_reason("yarn", "dye"), _fob_steps("yarn", "dye")),
    ("base_cost", "fob", "profit"),
    {
        "base_text": _text("base_cost", 2, before="$"),
        "profit_text": _text("profit", 2, before="$"),
        "fob_text": _text("fob", 2, before="$"),
    },
)
_chain = _costing(
    f"coalesce({_WEIGHT_REASON}, {_PRICE_REASON}, {_CM_REASON}, {_fob_reason('0', '0')})",
    [
        *_WEIGHT_STEPS,
        *_PRICE_STEPS,
        *_CM_STEPS,
        ("fabric", "total_weight / 1000 * fabric_price"),
        *_fob_steps("fabric", "cm_cost"),
    ],
)
_AMOUNTS = ("base_cost", "fob", "profit")
_add(
    "costing_sheet",
    "SELECT group_id, count(*) AS styles, count(reject_reason) AS rejected, "
    + ", ".join(f"CAST(sum(CAST(round({a}, 6) AS DECIMAL(28, 6))) AS DOUBLE) AS {a}_sum" for a in _AMOUNTS)
    + ", "
    + ", ".join(
        f"CAST(sum(CAST(round({a}, 6) AS DECIMAL(28, 6))) AS DOUBLE) / nullif(count({a}), 0) AS {a}_mean"
        for a in _AMOUNTS
    )
    + f" FROM ({_chain}) GROUP BY group_id",
)

# ---------------------------------------------------------------- streaming

_add("contact_intake", "SELECT id, name, email, subject, message, created_at, is_read, reject_reason FROM checked_messages")
_add(
    "contact_intake_without_ids",
    """SELECT CASE user_id % 19 WHEN 0 THEN '' ELSE concat('user-', user_id % 7) END AS name, 'u@example.org' AS email,
  event_type AS subject, event_type AS message, FALSE AS is_read,
  CASE WHEN user_id % 19 = 0 OR coalesce(event_type, '') = '' THEN 'Missing required fields' END AS reject_reason
FROM events""",
)
_add("inbox_stream", f"SELECT id, name, email, subject, message, created_at {_INBOX}")

ORACLE["stored_homepage"], ORACLE["stored_search_all"] = ORACLE["homepage"], ORACLE["search_all"]
_add(
    "category_feed_knowledge",
    """SELECT a.id, a.title, a.slug, c.name AS category, a.published_at
FROM knowledge_articles a JOIN knowledge_categories c ON c.id = a.category_id
WHERE c.slug = 'asia' AND a.status = 'published' ORDER BY a.published_at DESC NULLS FIRST, a.id LIMIT 10 OFFSET 10""",
)
_add(
    "category_feed_tools",
    """SELECT a.id, a.name, a.slug, c.name AS category FROM tools a JOIN tool_categories c ON c.id = a.category_id
WHERE c.slug = 'asia' AND a.status = 'published'""",
)
_ASKED = {
    "asked_news": "SELECT DISTINCT slug FROM (SELECT 'doc-' || doc_id AS slug FROM labels"
    " UNION ALL SELECT CASE toxic WHEN 1 THEN '' ELSE 'Doc ' || doc_id END FROM labels)",
    "asked_knowledge": "SELECT 'page-' || vec_id AS slug FROM embeddings",
    "asked_tools": "SELECT 't-' || c_custkey AS slug FROM customer",
}
_add(
    "feed_record_by_slug",
    "\nUNION ALL\n".join(
        f"SELECT '{kind}' AS kind, s.slug, a.id IS NOT NULL AS found, a.{name} AS title, c.name AS category FROM asked_{kind} s"
        f" LEFT JOIN (SELECT * FROM {table} WHERE status = 'published') a ON a.slug = s.slug"
        f" LEFT JOIN {groups} c ON c.id = a.category_id"
        for kind, table, groups, name in (
            ("news", "news_articles", "news_categories", "title"),
            ("knowledge", "knowledge_articles", "knowledge_categories", "title"),
            ("tools", "tools", "tool_categories", "name"),
        )
    ),
    _ASKED,
)
_LEFT = {
    "companies": ("category_id", "id NOT IN (SELECT id FROM closed_companies)"),
    "jobs": ("company_id", "company_id NOT IN (SELECT id FROM closed_companies)"),
    "services": ("provider_id", "provider_id NOT IN (SELECT id FROM closed_companies)"),
    "news_articles": ("CASE WHEN author_id NOT IN (SELECT id FROM closed_users) THEN author_id END", "id NOT IN (SELECT vec_id FROM embeddings)"),
    "knowledge_articles": ("CASE WHEN category_id NOT IN (SELECT id FROM closed_categories) THEN category_id END", "true"),
    "tools": ("CASE WHEN category_id NOT IN (SELECT id FROM closed_categories) THEN category_id END", "true"),
    "media": ("CASE WHEN uploaded_by_id NOT IN (SELECT id FROM closed_users) THEN uploaded_by_id END", "true"),
    "news_tags": ("news_id", "news_id NOT IN (SELECT vec_id FROM embeddings)"),
    "users": ("id", "id NOT IN (SELECT id FROM closed_users)"),
}
_add(
    "delete_everywhere",
    "\nUNION ALL\n".join(
        f"SELECT '{t}' AS table_name, count(*) AS n, count(*) FILTER (k IS NULL) AS empty, CAST(coalesce(sum(k), 0) AS BIGINT) AS key_sum"
        f" FROM (SELECT {key} AS k FROM {t} WHERE {where})"
        for t, (key, where) in _LEFT.items()
    ),
)
_add(
    "apply_creates_jobs",
    f"""SELECT id, title, slug, company_id, location, status, created_at FROM jobs
UNION ALL SELECT id + 100000000000, title, {_slug("replace(lower(title), ' ', '-')")}, id, 'zone 1',
  CASE WHEN id % 2 = 0 THEN 'draft' ELSE 'published' END, created_at
FROM (SELECT id, 'Cutter / no. ' || id AS title, created_at FROM companies)""",
)
_add(
    "apply_edits_companies",
    f"""SELECT id, CASE WHEN made IS NULL THEN name ELSE made END AS name,
  CASE WHEN made IS NULL THEN slug ELSE {_slug("replace(lower(made), ' ', '-')")} END AS slug,
  CASE WHEN made IS NULL THEN status ELSE 'published' END AS status,
  CASE WHEN made IS NULL THEN category_id ELSE id % 25 END AS category_id, description
FROM (SELECT c.*, s.s_name || ' & Co 2' AS made FROM companies c LEFT JOIN supplier s ON s.s_suppkey = c.id)""",
)
_add(
    "change_outcomes",
    f"""SELECT id, slug, CASE WHEN empty THEN 'missing text'
  WHEN id IN (SELECT id FROM news_articles) OR id_place > 1 THEN 'id taken'
  WHEN slug IN (SELECT slug FROM news_articles) OR slug_place > 1 THEN 'slug taken' ELSE 'accepted' END AS outcome
FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY empty, moment, slug) AS id_place,
    row_number() OVER (PARTITION BY slug ORDER BY empty, moment, id) AS slug_place
  FROM (SELECT *, slug = '' OR summary = '' OR coalesce(content, '') = '' AS empty
    FROM (SELECT id, moment, summary, content, {_slug("coalesce(nullif(given, ''), replace(lower(title), ' ', '-'))")} AS slug
      FROM (SELECT CASE WHEN number % 5 = 0 THEN item_id ELSE number END AS id, {_minutes('item_id % 1000003')} AS moment,
          'Entry Ñ' || item_id || ' / of the set' AS title, text AS content,
          CASE WHEN number % 11 = 0 THEN '' ELSE 'Passage ' || item_id || ' as it was sent in' END AS summary,
          CASE number % 7 WHEN 1 THEN 'doc-3' WHEN 2 THEN 'twice' ELSE
            CASE item_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('Item ', item_id, '/New') END END AS given
        FROM (SELECT *, item_id + 100000000000 AS number FROM benchmark)))))""",
)
