"""DuckDB fragments: the same operators in SQL, to check the Spark plans against."""

from __future__ import annotations

import re

from ..functions import classify as cls
from ..functions import lexicons as lex
from ..functions import stem

SPACE = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
WORD = r"[\p{L}\p{N}_\x{0900}-\x{0D7F}]"
NOT_WORD = r"[^\p{L}\p{N}_\x{0900}-\x{0D7F}]"
#: Inline samples in both scripts; the tables hold no Indic text.
SAMPLES = ["शेती", "हवामान अंदाज आज", "शेअर बाजार", "म्युच्युअल फंड माहिती", "मराठी शेती", "marathi sheti", "demat account price", "how to open demat", "कांदा बाजारभाव", "ladki bahin yojana", "पीक विमा कसे करावे", "शेती vs farming", "फोन किंमत", "official portal login", "wa wo", "नियम काय आहे?"]
AS_OF_TEXT = "2024-01-20 12:00:00"
AS_OF = f"TIMESTAMP '{AS_OF_TEXT}'"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(column: str, items: list[str]) -> str:
    return f"SELECT * FROM (VALUES {', '.join(f'({quoted(x)})' for x in items)}) AS v({column})"


def numbered(column: str, items: list[str]) -> str:
    return f"(VALUES {', '.join(f'({i}::BIGINT, {quoted(x)})' for i, x in enumerate(items))}) AS v(n, {column})"


# --- text kernel --------------------------------------------------------------------------------


def fold(x: str) -> str:
    return f"regexp_replace(regexp_replace(nfc_normalize(lower(regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g'))), '[\\x{{200C}}\\x{{200D}}]', '', 'g'), '{SPACE}+', ' ', 'g')"


def dedup_key(x: str) -> str:
    return f"regexp_replace({fold(x)}, '{NOT_WORD}+', '', 'g')"


def sibling_key(x: str) -> str:
    return f"regexp_replace(translate({fold(x)}, '{lex.DEVANAGARI_LETTERS}', '{lex.LATIN_LETTERS}'), '[^a-z0-9]', '', 'g')"


def topic_key(x: str) -> str:
    key = sibling_key(x)
    # RE2 has no back-references: runs are collapsed letter by letter
    bare = f"regexp_replace({key}, '[aeiouh]', '', 'g')"
    single = f"list_reduce(list_prepend('', string_split({bare}, '')), lambda a, c: CASE WHEN right(a, 1) = c THEN a ELSE a || c END)"
    return f"CASE WHEN length({single}) >= 4 THEN {single} WHEN length({key}) >= 2 THEN {key} ELSE {dedup_key(x)} END"


def _range(script: str) -> str:
    lo, hi = lex.SCRIPT_RANGES[script]
    return f"\\x{{{lo:04X}}}-\\x{{{hi:04X}}}"


def script_count(x: str, script: str) -> str:
    return f"length(regexp_replace(regexp_replace({x}, '{SPACE}|\\p{{P}}', '', 'g'), '[^{_range(script)}]', '', 'g'))"


def script_of(x: str) -> str:
    counts = {s: script_count(x, s) for s in lex.SCRIPT_RANGES}
    total = "(" + " + ".join(counts.values()) + ")"
    return f"CASE WHEN {total} = 0 THEN 'other' " + " ".join(f"WHEN {n} / {total} >= 0.85 THEN '{s}'" for s, n in counts.items()) + " ELSE 'mixed' END"


def boundary(x: str, terms: list[str]) -> str:
    inner = "|".join(re.escape(t).replace("\\ ", " ").replace("\\-", "-") for t in terms)
    return f"regexp_matches({x}, {quoted(f'(?i)(^|{NOT_WORD})(?:{inner})($|{NOT_WORD})')})"


def is_question(x: str, language: str) -> str:
    roman = "|".join(lex.ROMAN_QUESTION_WORDS)
    return f"(ends_with(trim({x}), '?') OR ends_with(trim({x}), '؟') OR {boundary(x, cls.question_terms(language))} OR regexp_matches(lower({x}), '(^|[^a-zA-Z0-9_])(?:{roman})($|[^a-zA-Z0-9_])'))"


def intent(x: str, language: str) -> str:
    markers = cls.spec(language)["markers"]
    return "CASE " + " ".join(f"WHEN {boundary(x, markers[k])} THEN '{k}'" for k in lex.INTENTS if markers.get(k)) + f" WHEN {is_question(x, language)} THEN 'informational' ELSE 'unclear' END"


def any_of(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {quoted(w)})" for w in words) + ")"


def buyer(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {any_of(f'lower({x})', [w.lower() for w in words])} THEN '{k}'" for k, words in lex.BUYER_INTENT.items()) + " END"


def first_match(x: str, rules: list[tuple[str, str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, '(?i){p}') THEN {quoted(t)}" for p, t in rules) + f" ELSE {quoted(default)} END"


def answer_card(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {any_of(fold(x), [w.lower() for w in words])} THEN {quoted(t)}" for t, words in lex.ANSWER_CARDS) + " END"


def tristate(x: str) -> str:
    yes, no = (", ".join(quoted(w) for w in words) for words in (cls.YES, cls.NO))
    return f"CASE WHEN lower(trim({x})) IN ({yes}) THEN true WHEN lower(trim({x})) IN ({no}) THEN false END"


def competition_band() -> str:
    return """CASE WHEN (thin IS NOT NULL)::INT + (weak IS NOT NULL)::INT + (stale IS NOT NULL)::INT < 2 THEN NULL WHEN weak AND thin THEN 'low' WHEN weak THEN 'medium'
      WHEN NOT weak AND NOT thin THEN 'very_high' WHEN NOT weak THEN 'high' WHEN thin AND stale THEN 'medium' WHEN NOT thin AND NOT stale THEN 'high' ELSE 'medium' END"""


def relative_time(at: str, as_of: str) -> str:
    s = f"(floor(epoch({as_of})) - floor(epoch({at})))"
    part = lambda n, unit: f"CAST(CAST(floor({s} / {n}) AS BIGINT) AS VARCHAR) || ' {lex.ELAPSED[unit]}'"
    return f"CASE WHEN {at} IS NULL THEN '{lex.ELAPSED['today']}' WHEN {s} < 0 THEN '{lex.ELAPSED['now']}' WHEN {s} < 600 THEN '{lex.ELAPSED['new']}' WHEN {s} < 3600 THEN {part(60, 'minutes')} WHEN {s} < 86400 THEN {part(3600, 'hours')} WHEN {s} < 172800 THEN '{lex.ELAPSED['yesterday']}' WHEN {s} < 604800 THEN {part(86400, 'days')} ELSE {native_date(at)} END"


def native_date(at: str) -> str:
    digits = lambda x: f"translate(CAST({x} AS VARCHAR), '0123456789', '०१२३४५६७८९')"
    months = "[" + ", ".join(quoted(m) for m in lex.MONTHS) + "]"
    return f"{digits(f'day({at})')} || ' ' || {months}[month({at})] || ' ' || {digits(f'year({at})')}"


def domain(x: str) -> str:
    return f"regexp_replace(lower(regexp_extract({x}, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)', 1)), '^www\\.', '')"


def clean_url(x: str) -> str:
    scheme, host = f"regexp_extract({x}, '^(https?)://', 1)", f"lower(regexp_extract({x}, '^https?://([^/?#]+)', 1))"
    path = f"regexp_extract({x}, '^https?://[^/?#]+([^?#]*)', 1)"
    path = f"regexp_replace(CASE WHEN {path} = '' THEN '/' ELSE {path} END, '/+', '/', 'g')"
    kept = f"list_filter(string_split(regexp_extract({x}, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(utm_[^=]*|fbclid|gclid|ref|mc_cid)(=|$)'))"
    return f"CASE WHEN {scheme} <> '' AND {host} <> '' THEN {scheme} || '://' || {host} || {path} || CASE WHEN len({kept}) > 0 THEN '?' || array_to_string({kept}, '&') ELSE '' END END"


# --- web ------------------------------------------------------------------------------------------

_VISIBLE = "html"
for _tag in ("script", "style", "noscript", "svg"):
    _VISIBLE = f"regexp_replace({_VISIBLE}, '(?is)<{_tag}\\b.*?</{_tag}\\s*>', ' ', 'g')"
_VISIBLE = f"trim(regexp_replace(regexp_replace({_VISIBLE}, '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))"
_EVERY = "".join(_range(s) for s in lex.SCRIPT_RANGES)

PAGE_FACTS = f"""
  SELECT page_id, domain, title, html_lang, ratio, CASE WHEN ratio IS NOT NULL THEN ratio >= 0.4 OR coalesce(contains(html_lang, 'mr'), false) END AS is_marathi FROM (
    SELECT page_id, {domain('url')} AS domain,
      nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')), '') AS title,
      nullif(regexp_extract(html, '(?is)<html[^>]*?\\blang\\s*=\\s*["'']([^"'']*)["'']', 1), '') AS html_lang,
      CASE WHEN length(regexp_replace(visible, '[^{_EVERY}]', '', 'g')) > 0 THEN round(length(regexp_replace(visible, '[^{_range("devanagari")}]', '', 'g')) / length(regexp_replace(visible, '[^{_EVERY}]', '', 'g')), 4) END AS ratio
    FROM (SELECT page_id, url, html, {_VISIBLE} AS visible FROM pages))"""

_JOINED = """CASE WHEN regexp_matches(href, '(?i)^(#|javascript:|mailto:|tel:|data:|whatsapp:)') OR href = '' THEN NULL
      WHEN regexp_matches(href, '(?i)^https?://') THEN href WHEN starts_with(href, '//') THEN regexp_extract(url, '^(https?:)', 1) || href
      WHEN starts_with(href, '/') THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || href
      ELSE (CASE WHEN ends_with(folder, '/') THEN folder ELSE folder || '/' END) || href END"""

PAGE_LINKS = f"""
  SELECT source_url, target_url, source_domain, target_domain, source_domain = target_domain AS is_internal FROM (
    SELECT DISTINCT url AS source_url, target AS target_url, {domain('url')} AS source_domain, {domain('target')} AS target_domain FROM (
      SELECT url, {clean_url('joined')} AS target FROM (
        SELECT url, {_JOINED} AS joined FROM (
          SELECT url, trim(unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*?\\bhref\\s*=\\s*["'']([^"'']*)["'']', 1))) AS href, regexp_extract(url, '^(https?://[^/?#]+(?:/[^?#]*/|/)?)', 1) AS folder FROM pages)))
    WHERE target IS NOT NULL AND target <> url)"""



def with_titles(items: list[str]) -> str:
    """Samples and the titles of all pages, numbered."""
    return f"(SELECT n, text FROM {numbered('text', items)} UNION ALL SELECT 1000 + page_id, title FROM ({PAGE_FACTS})) AS v(n, text)"


def with_urls(items: list[str]) -> str:
    return f"(SELECT n, text FROM {numbered('text', items)} UNION ALL SELECT 1000 + page_id, url FROM pages) AS v(n, text)"


#: XML and robots files made from pages, in SQL that both engines read.
MADE_XML = """CASE page_id % 3 WHEN 0 THEN concat('<sitemapindex><sitemap><loc>', url, '.xml</loc><lastmod>2026-01-0', CAST(page_id % 9 + 1 AS VARCHAR(9)), '</lastmod></sitemap></sitemapindex>')
  WHEN 1 THEN concat('<rss><channel><item><title>T', CAST(page_id AS VARCHAR(20)), ' &amp; more</title><link>', url, '</link><pubDate>Sun, 04 Oct 2026 20:00:0', CAST(page_id % 10 AS VARCHAR(9)), ' +0530</pubDate><description>&lt;b&gt;up&lt;/b&gt; today</description></item></channel></rss>')
  ELSE concat('<urlset><url><loc> ', url, ' </loc><lastmod>2026-01-02</lastmod><news:news><news:title>N', CAST(page_id AS VARCHAR(20)), '</news:title></news:news></url><url><loc>', url, '/b</loc></url></urlset>') END"""
MADE_BROKEN = """CASE WHEN page_id % 7 = 0 THEN '<html>nothing' WHEN page_id % 4 = 0 THEN concat('<sitemapindex><sitemap><loc>', url, '.xml</loc><loc> ', url, '/2.xml </loc> & <broken') ELSE concat('<urlset><loc>', url, '</loc><loc>', url, '/y</loc>') END"""
MADE_ROBOTS = """concat('User-agent: *', CASE WHEN page_id % 2 = 0 THEN chr(13) ELSE '' END, chr(10), 'SITEMAP: /s', CAST(page_id % 5 AS VARCHAR(9)), '.xml', chr(10), '# sitemap: /no.xml', chr(10), CASE WHEN page_id % 3 = 0 THEN 'sitemap: https://cdn.in/all.xml # shared' ELSE 'Sitemap: part/t.xml' END, chr(10), 'Sitemap: /s', CAST(page_id % 5 AS VARCHAR(9)), '.xml')"""
ROBOTS_URL = "concat('https://h', CAST(page_id AS VARCHAR(20)), '.in/robots.txt')"


def robots(files: list[tuple[str, str]]) -> str:
    """Sitemap lines in order, each once, resolved against the file's own URL."""
    table = ", ".join(f"({quoted(u)}, {quoted(x)})" for u, x in files)
    return f"""WITH files AS (SELECT url, replace(replace(body, '\\n', chr(10)), '\\r', chr(13)) AS body FROM (VALUES {table}) AS v(url, body) UNION ALL SELECT {ROBOTS_URL}, {MADE_ROBOTS} FROM pages),
  lines AS (SELECT url, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM (SELECT url, regexp_split_to_array(body, '\\r?\\n') AS lines FROM files)),
  named AS (SELECT url, pos, trim(regexp_extract(line, '(?i)^\\s*sitemap:\\s*([^#]+)', 1)) AS href, regexp_extract(url, '^(https?://[^/?#]+(?:/[^?#]*/|/)?)', 1) AS folder FROM lines),
  found AS (SELECT url, pos, {clean_url('joined')} AS sitemap FROM (SELECT url, pos, {_JOINED} AS joined FROM named))
  SELECT url, row_number() OVER (PARTITION BY url ORDER BY min(pos)) AS n, sitemap FROM found WHERE sitemap IS NOT NULL GROUP BY url, sitemap"""


def sitemaps(files: list[tuple[str, str]]) -> str:
    table = ", ".join(f"({quoted(u)}, {quoted(x)})" for u, x in files)
    element = lambda name: f"nullif(trim(regexp_replace(regexp_extract(block, '(?is)<(?:\\w+:)?{name}\\b[^>]*>(.*?)</(?:\\w+:)?{name}\\s*>', 1), '<!\\[CDATA\\[|\\]\\]>', '', 'g')), '')"
    return f"""SELECT url, kind, loc, lastmod, title FROM (
  SELECT url, kind, coalesce({element('loc')}, {element('link')}, nullif(regexp_extract(block, '(?is)<link\\b[^>]*href\\s*=\\s*["'']([^"'']+)["'']', 1), '')) AS loc,
    coalesce({element('lastmod')}, {element('pubDate')}, {element('updated')}) AS lastmod, {element('title')} AS title FROM (
    SELECT url, CASE WHEN regexp_matches(xml, '(?i)<(\\w+:)?sitemapindex\\b') THEN 'index' WHEN regexp_matches(xml, '(?i)<(\\w+:)?urlset\\b') THEN 'urlset' WHEN regexp_matches(xml, '(?i)<(rss|feed)\\b') THEN 'feed' ELSE 'unknown' END AS kind,
      unnest(regexp_extract_all(xml, '(?is)<(?:\\w+:)?(?:sitemap|url|item|entry)\\b[^>]*>.*?</(?:\\w+:)?(?:sitemap|url|item|entry)\\s*>')) AS block
    FROM (SELECT * FROM (VALUES {table}) AS v(url, xml) UNION ALL SELECT url, {MADE_XML} FROM pages))) WHERE loc IS NOT NULL"""


LD = '<script type="application/ld+json">{"@type": "Article", "datePublished": "2026-01-02"}</script>'
TIME = '<time datetime="2025-03-04T05:06"></time>'
META = '<meta property="article:published_time" content="2024-05-06">'
_FOUND = [
    """nullif(regexp_extract(html, '(?is)<script[^>]*application/ld\\+json[^>]*>.*?"datePublished"\\s*:\\s*"([^"]+)".*?</script>', 1), '')""",
    """nullif(regexp_extract(html, '(?is)<time[^>]*datetime=["'']([^"'']+)["'']', 1), '')""",
    """nullif(regexp_extract(html, '(?is)<meta[^>]*(?:name|property)\\s*=\\s*["'']article:published_time["''][^>]*content\\s*=\\s*["'']([^"'']*)["'']', 1), '')""",
]
DATES = f"coalesce({', '.join(_FOUND)}) AS published, CASE WHEN {_FOUND[0]} IS NOT NULL THEN 'JSON-LD' WHEN {_FOUND[1]} IS NOT NULL THEN 'TIME' WHEN {_FOUND[2]} IS NOT NULL THEN 'META' ELSE 'NONE' END AS source, CASE WHEN {_FOUND[0]} IS NOT NULL THEN 'HIGH' WHEN coalesce({_FOUND[1]}, {_FOUND[2]}) IS NOT NULL THEN 'MEDIUM' ELSE 'NONE' END AS confidence"

HEADLINES = ["Farmer News: शेतकरी कर्जमाफी यादी जाहीर | Lokmat", "कांदा", "only english here", "पाऊस आज - हवामान अंदाज महाराष्ट्र", "शेअर बाजार तेजी today market news update", "", "दोन भाग: एक दोन तीन"]


def headline(x: str) -> str:
    native = "length(regexp_replace(p, '[^ऀ-ॿ]', '', 'g'))"
    good = f"list_filter(list_transform(regexp_split_to_array(coalesce({x}, ''), '\\s*[|:–—;-]\\s*'), lambda p: trim(p)), lambda p: {native} >= 6 AND len(regexp_split_to_array(p, '\\s+')) >= 2)"
    lead = f"regexp_extract(coalesce({x}, ''), '^[A-Za-z0-9\\s,_-]+:\\s*([ऀ-ॿ].*)$', 1)"
    whole = f"CASE WHEN regexp_matches(coalesce({x}, ''), '[ऀ-ॿ]') THEN coalesce(nullif({lead}, ''), {x}) ELSE '' END"
    best = f"coalesce(list_sort(list_transform({good}, lambda p, i: {{'n': -{native}, 'i': i, 'p': p}}))[1].p, {whole})"
    return f"trim(regexp_replace({best}, '\\s+([a-zA-Z0-9_-]{{2,}}\\s+){{2,}}[a-zA-Z0-9_-]{{2,}}.*$', ''))"


_UNESCAPED = "{x}"
for _entity, _char in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")]:
    _UNESCAPED = f"replace({_UNESCAPED}, '{_entity}', {quoted(_char)})"


def unescape(x: str) -> str:
    return _UNESCAPED.replace("{x}", x)


def _meta(name: str) -> str:
    return f'''nullif(regexp_extract(html, '(?is)<meta[^>]*(?:name|property)\\s*=\\s*["'']{name}["''][^>]*content\\s*=\\s*["'']([^"'']*)["'']', 1), '')'''


_TITLE = "nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')), '')"
#: Page heads made from the page table, every fifth with a description, every seventh with social titles.
HEADS = '''SELECT page_id, url, replace(html, '</head>', concat(CASE WHEN page_id % 5 = 0 THEN concat('<meta name="description" content="About &quot;', CAST(page_id AS VARCHAR(20)), '&quot; &amp; more">') ELSE '' END, CASE WHEN page_id % 7 = 0 THEN '<meta property="og:title" content="Shared"><meta property="og:image" content="i.png">' ELSE '' END, '</head>')) AS html FROM pages'''
_OG_TITLE, _DESCRIPTION, _OG_DESCRIPTION = _meta("og:title"), _meta("description"), _meta("og:description")
PAGE_META = f"SELECT page_id, {unescape(f'coalesce({_TITLE}, {_OG_TITLE})')} AS title, {unescape(f'coalesce({_DESCRIPTION}, {_OG_DESCRIPTION})')} AS description FROM heads"
_TAG_TEXT = f"trim(regexp_replace(regexp_replace({unescape('tag')}, '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))"
ANCHORS = f'''SELECT source_url, target_url, arg_min(anchor_text, n) AS anchor_text, (any_value(a) = any_value(b) OR ends_with(any_value(b), '.' || any_value(a)) OR ends_with(any_value(a), '.' || any_value(b))) AS is_internal FROM (
  SELECT url AS source_url, {clean_url('joined')} AS target_url, n, anchor_text, {domain('url')} AS a, {domain(clean_url('joined'))} AS b FROM (
    SELECT url, n, {_TAG_TEXT} AS anchor_text, {_JOINED} AS joined FROM (
      SELECT url, tag, n, trim(regexp_extract(tag, '(?is)\\bhref\\s*=\\s*["'']([^"'']*)["'']', 1)) AS href, regexp_extract(url, '^(https?://[^/?#]+(?:/[^?#]*/|/)?)', 1) AS folder FROM (
        SELECT url, unnest(tags) AS tag, generate_subscripts(tags, 1) AS n FROM (SELECT url, regexp_extract_all(html, '(?is)<a\\b[^>]*?\\bhref\\s*=\\s*["''][^"'']*["''][^>]*>.*?</a\\s*>') AS tags FROM pages))))
  ) WHERE target_url IS NOT NULL AND target_url <> source_url GROUP BY source_url, target_url'''
#: Tags that patterns misread, put at the end of pages and of heads: comments, nested elements, values without quotes or in another order.
ODD_TAGS = """<!-- <a href="https://hidden.in/">no</a> --><svg><svg></svg><title>Not this</title></svg><A class=x title="a > b" href=https://extra.in/p >Extra <b>link</b></A><script>"<a href='https://no.in/'>no</a>"</script><a name=x>none</a></body>"""
ODD_ANCHORS = f"""{ANCHORS} UNION ALL SELECT url, 'https://extra.in/p', 'Extra link', false FROM pages WHERE contains(html, '</body>')"""
#: Every fifth page has a description with its attributes the other way round, a comment before it holds another one.
ODD_HEADS = """SELECT page_id, url, replace(html, '</head>', concat('<!-- <meta name="description" content="no"> -->', CASE WHEN page_id % 5 = 0 THEN concat('<META content="About &quot;', CAST(page_id AS VARCHAR(20)), '&quot; &amp; more" data-x=1 name=Description>') ELSE '' END, CASE WHEN page_id % 7 = 0 THEN '<meta content=Social property=og:description>' ELSE '' END, '</head>')) AS html FROM pages"""
ODD_META = f"""SELECT page_id, {unescape(_TITLE)} AS title, CASE WHEN page_id % 5 = 0 THEN 'About "' || page_id || '" & more' WHEN page_id % 7 = 0 THEN 'Social' END AS description FROM pages"""
VERDICT = f"SELECT page_id, CASE WHEN ratio >= 0.2 THEN 'ratio' WHEN contains(html_lang, 'mr') THEN 'language' WHEN regexp_matches(title, '[ऀ-ॿ]') THEN 'title' END AS reason FROM ({PAGE_FACTS})"

FEEDS = [
    ("https://a.in/rss", "<rss><channel><title>Site</title><item><title>कांदा &amp; बाजार</title><link>https://a.in/1</link><pubDate>Sun, 04 Oct 2026 20:00:00 +0530</pubDate><description><![CDATA[<p>Prices &lt;b&gt;up&lt;/b&gt; today</p>]]></description></item><item><title>No link</title></item><item><title>No date</title><link>https://a.in/2</link></item></channel></rss>"),
    ("https://b.in/atom", '<feed><entry><title>Atom one</title><link href="https://b.in/x"/><updated>2026-10-03T08:30:00Z</updated></entry></feed>'),
    ("https://c.in/news.xml", "<urlset><url><loc>https://c.in/n</loc><lastmod>2026-01-01</lastmod><news:news><news:publication_date>2026-10-02T10:00:00Z</news:publication_date><news:title>News &quot;one&quot;</news:title></news:news></url><url><loc>https://c.in/no-title</loc></url></urlset>"),
]
BROKEN = [("https://a.in/1.xml", "<sitemapindex><sitemap><loc>https://a.in/part1.xml</loc></sitemap><loc> https://a.in/p2.xml </loc> & <broken"), ("https://a.in/2.xml", "<urlset><loc>https://a.in/x</loc><loc>https://a.in/y</loc>"), ("https://a.in/3.xml", "<html>nothing</html>")]


def feed_items(files: list[tuple[str, str]]) -> str:
    table = ", ".join(f"({quoted(u)}, {quoted(x)})" for u, x in files)
    element = lambda name: f"nullif(trim(regexp_replace(regexp_extract(block, '(?is)<(?:\\w+:)?{name}\\b[^>]*>(.*?)</(?:\\w+:)?{name}\\s*>', 1), '<!\\[CDATA\\[|\\]\\]>', '', 'g')), '')"
    date = f"coalesce({', '.join(element(n) for n in ('publication_date', 'pubDate', 'updated', 'lastmod'))})"
    at = f"coalesce(epoch(try_strptime({date}, '%a, %d %b %Y %H:%M:%S %z')), epoch(try_strptime({date}, '%Y-%m-%dT%H:%M:%SZ')), epoch(try_strptime({date}, '%Y-%m-%d')), 0)::BIGINT"
    return f"""SELECT * FROM (SELECT feed, kind, coalesce({element('loc')}, {element('link')}, nullif(regexp_extract(block, '(?is)<link\\b[^>]*href\\s*=\\s*["'']([^"'']+)["'']', 1), '')) AS url, nullif(trim({unescape(element('title'))}), '') AS title, {at} AS at,
  nullif(substring(trim(regexp_replace({unescape(f"coalesce({element('description')}, {element('summary')})")}, '<[^>]+>', '', 'g')), 1, 200), '') AS summary
  FROM (SELECT url AS feed, CASE WHEN regexp_matches(xml, '(?i)<(\\w+:)?urlset\\b') THEN 'news' ELSE 'feed' END AS kind, unnest(regexp_extract_all(xml, '(?is)<(?:\\w+:)?(?:url|item|entry)\\b[^>]*>.*?</(?:\\w+:)?(?:url|item|entry)\\s*>')) AS block FROM (SELECT * FROM (VALUES {table}) AS v(url, xml) UNION ALL SELECT url, {MADE_XML} FROM pages)))
WHERE url IS NOT NULL AND title IS NOT NULL"""


def rescue(files: list[tuple[str, str]]) -> str:
    table = ", ".join(f"({quoted(u)}, {quoted(x)})" for u, x in files)
    return f"""WITH f AS (SELECT url, xml, regexp_extract_all(xml, '(?i)<loc>\\s*(https?://[^\\s<>]+)\\s*</loc>', 1) AS locs FROM (SELECT * FROM (VALUES {table}) AS v(url, xml) UNION ALL SELECT url, {MADE_BROKEN} FROM pages)),
k AS (SELECT *, CASE WHEN len(locs) = 0 THEN 'error' WHEN len(list_filter(list_slice(locs, 1, 5), lambda u: contains(lower(u), '.xml'))) > 0 AND contains(lower(xml), '<sitemap>') THEN 'sitemapindex' ELSE 'urlset' END AS kind FROM f)
SELECT url, kind, unnest(CASE WHEN len(locs) = 0 THEN [NULL] ELSE locs END) AS loc FROM k"""


#: Sitemaps made from pages: whole ones with priorities, broken ones, and another document.
_WHOLE_XML = MADE_XML.replace(", url, ", ", replace(url, '&', '&amp;'), ")
MADE_SITEMAP = f"""CASE WHEN page_id % 11 = 10 THEN '<?xml version="1.0"?><!-- none --><html><loc>http://a.in/</loc></html>' WHEN page_id % 5 = 0 THEN {MADE_BROKEN}
  ELSE replace({_WHOLE_XML}, '</lastmod><news', concat('</lastmod><priority> 0.', CAST(page_id % 10 AS VARCHAR(9)), '</priority><news')) END"""
SITEMAP_URL = "concat(regexp_extract(url, '^(https?://[^/?#]+)', 1), '/', CAST(page_id AS VARCHAR(20)), '.xml')"


def sitemap_scan() -> str:
    """CTEs scan (entries of whole sitemaps, bare <loc> elements of broken ones) and states, over MADE_SITEMAP."""
    element = lambda name: f"nullif(trim(regexp_replace(regexp_extract(block, '(?is)<(?:\\w+:)?{name}\\b[^>]*>(.*?)</(?:\\w+:)?{name}\\s*>', 1), '<!\\[CDATA\\[|\\]\\]>', '', 'g')), '')"
    plain = lambda name: f"replace({element(name)}, '&amp;', '&')"
    return f"""made AS (SELECT {SITEMAP_URL} AS url, {MADE_SITEMAP} AS xml, page_id % 11 = 10 AS other, page_id % 11 <> 10 AND page_id % 5 = 0 AS broken FROM pages),
blocks AS (SELECT url, kind, unnest(CASE WHEN kind = 'unknown' THEN [NULL] ELSE regexp_extract_all(xml, '(?is)<(?:sitemap|url|item)>.*?</(?:sitemap|url|item)>') END) AS block FROM (SELECT url, xml, CASE WHEN other THEN 'unknown' WHEN contains(xml, '<sitemapindex') THEN 'sitemapindex' WHEN contains(xml, '<urlset') THEN 'urlset' ELSE 'feed' END AS kind FROM made WHERE NOT broken)),
whole AS (SELECT url, kind, CASE WHEN kind = 'feed' THEN {plain('link')} ELSE {plain('loc')} END AS loc, coalesce({element('lastmod')}, {element('pubDate')}) AS lastmod, TRY_CAST({element('priority')} AS DOUBLE) AS priority, {plain('title')} AS title, CASE WHEN kind = 'unknown' THEN 'unknown root' END AS error FROM blocks),
locs AS (SELECT url, xml, regexp_extract_all(xml, '(?i)<loc>\\s*(https?://[^\\s<>]+)\\s*</loc>', 1) AS locs FROM made WHERE broken),
bare AS (SELECT *, CASE WHEN len(locs) = 0 THEN 'error' WHEN len(list_filter(list_slice(locs, 1, 5), lambda u: contains(lower(u), '.xml'))) > 0 AND contains(lower(xml), '<sitemap>') THEN 'sitemapindex' ELSE 'urlset' END AS kind FROM locs),
scan AS (SELECT url, kind, loc, lastmod, priority, title, error FROM whole UNION ALL SELECT url, kind, unnest(CASE WHEN len(locs) = 0 THEN [NULL] ELSE locs END), NULL, NULL, NULL, CASE WHEN kind = 'error' THEN 'not well-formed' END FROM bare),
states AS (SELECT url AS sitemap_url, {domain('url')} AS domain, min(kind) AS kind, count(loc) FILTER (kind = 'sitemapindex') AS children, count(loc) FILTER (kind <> 'sitemapindex') AS urls, min(error) AS error FROM scan GROUP BY url)"""


#: A crawl's pages: those of the table, each with a link to the next one, two thirds with another title.
CRAWLED_HTML = "concat(CASE page_id % 3 WHEN 0 THEN '<title>शेती विषयक</title>' WHEN 1 THEN '<title>City News</title>' ELSE '' END, html, coalesce(concat('<a href=\"', next, '\">next</a>'), ''))"
CRAWLED = f"crawled AS (SELECT page_id, url, {CRAWLED_HTML} AS html FROM (SELECT p.*, q.url AS next FROM pages p LEFT JOIN pages q ON q.page_id = p.page_id + 1))"


def site_category(title: str, host: str) -> str:
    text = f"lower(concat_ws(chr(10), {title}, {host}))"
    cases = " ".join("WHEN " + " OR ".join(f"contains({text}, {quoted(w)})" for w in words) + f" THEN {quoted(name)}" for name, words in cls.SITE_CATEGORIES)
    return f"CASE {cases} ELSE {quoted(cls.OTHER_CATEGORY)} END"


def crawl() -> str:
    """CTEs facts, links, scan, states and websites of a crawl over CRAWLED and MADE_SITEMAP."""
    over = lambda text: text.replace("FROM pages", "FROM crawled")
    return f"""{CRAWLED}, f AS ({over(PAGE_FACTS)}), facts AS MATERIALIZED (SELECT f.*, url FROM f JOIN pages USING (page_id)), links AS MATERIALIZED ({over(PAGE_LINKS)}), {sitemap_scan()},
known AS (SELECT domain, arg_min(title, struct_pack(a := length(url), b := url, c := page_id)) FILTER (title IS NOT NULL) AS title, round(avg(ratio), 4) AS ratio, count(*) AS pages_crawled FROM facts WHERE domain <> '' GROUP BY domain),
listed AS (SELECT domain, sum(urls)::BIGINT AS total_sitemap_urls, max(urls + children) AS most, count(error) AS errors FROM states GROUP BY domain),
websites AS (SELECT domain, title, {site_category('title', 'domain')} AS category, ratio, ratio >= 0.35 AS verified, coalesce(pages_crawled, 0) AS pages_crawled, CASE WHEN most > 0 THEN 'found' WHEN errors > 0 THEN 'error' ELSE 'none' END AS sitemap_status, coalesce(total_sitemap_urls, 0) AS total_sitemap_urls FROM known FULL JOIN listed USING (domain))"""


def widened(rounds: int) -> str:
    """CTEs known0, found1 ... of sites found through links, round by round, from the domain of the first page."""
    out = f"""front AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY length(url), url, page_id) AS k FROM facts) WHERE k = 1),
judged AS (SELECT domain, {site_category('title', 'domain')} AS category, CASE WHEN ratio >= 0.2 THEN 'ratio' WHEN contains(html_lang, 'mr') THEN 'language' WHEN regexp_matches(title, '[ऀ-ॿ]') THEN 'title' END AS reason FROM front),
seen0 AS (SELECT DISTINCT domain FROM facts WHERE page_id % 20 = 0), found0 AS (SELECT domain FROM seen0)"""
    for n in range(1, rounds + 1):
        out += f""",
found{n} AS MATERIALIZED (SELECT target_domain AS domain, category, reason, count(*) AS in_refs, {n} AS round FROM links JOIN judged ON target_domain = domain WHERE NOT is_internal AND source_domain IN (SELECT domain FROM found{n - 1}) AND target_domain NOT IN (SELECT domain FROM seen{n - 1}) AND reason IS NOT NULL GROUP BY ALL),
seen{n} AS (SELECT * FROM seen{n - 1} UNION SELECT domain FROM found{n})"""
    return out


#: Rows of an observation table made from suppliers; two thirds of the cells are blank.
OBSERVED_ROWS = "SELECT s_suppkey AS ord, 'Q' || s_suppkey || ' ' AS keyword, CASE s_suppkey % 3 WHEN 0 THEN true END AS thin, CASE s_suppkey % 3 WHEN 1 THEN false END AS weak, CASE s_suppkey % 3 WHEN 2 THEN true END AS stale, CASE s_suppkey % 3 WHEN 0 THEN false END AS own, CASE s_suppkey % 2 WHEN 0 THEN 'seen' END AS notes FROM supplier"

#: Result pages made from suppliers, in SQL that both engines read.
RESULT_HTML = "concat(repeat('<a href=\"https://www.site.in/a\">x</a>', CAST(s_suppkey % 2 AS INT)), CASE WHEN s_suppkey % 3 = 0 THEN '<a href=\"https://www.quora.com/q?x=1\">x</a>' ELSE '' END, CASE WHEN s_suppkey % 5 = 0 THEN '<a href=\"https://b1.in/\"></a><a href=\"https://b2.in/\"></a><a href=\"https://b3.in/\"></a><a href=\"https://b4.in/\"></a><a href=\"https://b5.in/\"></a><a href=\"https://b6.in/\"></a><a href=\"https://b7.in/\"></a><a href=\"https://b8.in/\"></a>' ELSE '' END, CASE WHEN s_suppkey % 7 = 0 THEN 'since 2019' ELSE '' END)"
RESULT_PAGES = f"SELECT 'q' || s_suppkey AS query, {RESULT_HTML} AS html FROM supplier"
CHECKED_HTML = f"concat({RESULT_HTML}, CASE WHEN s_suppkey % 13 = 0 THEN '<p>Please solve the captcha</p>' ELSE '' END)"
OBSERVED = """found AS (SELECT query, html, list_distinct(list_transform(regexp_extract_all(html, '(?is)<a\\b[^>]*?\\bhref\\s*=\\s*["'']([^"'']*)["'']', 1), lambda h: regexp_replace(h, '[?#].*', ''))) AS urls FROM r),
o AS (SELECT query, CASE WHEN len(urls) < 3 THEN true WHEN len(urls) >= 8 THEN false END AS thin, len(list_filter(urls, lambda u: contains(u, 'quora.com'))) > 0 AS weak, CASE WHEN regexp_matches(html, '\\b(19|20)\\d{2}\\b') THEN true END AS stale FROM found)"""

# --- graph -----------------------------------------------------------------------------------------

PARTS = """nodes AS (SELECT 'p' || p_partkey AS domain, p_brand AS category FROM part),
matrix AS MATERIALIZED (SELECT 'p' || l_partkey AS source_domain, 'p' || after AS target_domain, count(*) AS link_count FROM (SELECT l_partkey, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS after FROM lineitem) WHERE after IS NOT NULL GROUP BY ALL),
edges AS MATERIALIZED (SELECT source_domain AS u, target_domain AS v, link_count AS w FROM matrix WHERE source_domain <> target_domain)"""


def pagerank(steps: int, damping: float = 0.85) -> str:
    """Unrolled: rank0 .. rank{steps}."""
    out = ["shares AS MATERIALIZED (SELECT u, v, w / sum(w) OVER (PARTITION BY u) AS share FROM edges)", "rank0 AS MATERIALIZED (SELECT domain, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS pagerank FROM nodes)"]
    for k in range(steps):
        out.append(f"""rank{k + 1} AS MATERIALIZED (SELECT n.domain, {1 - damping} / (SELECT count(*) FROM nodes) + {damping} * coalesce(g.got, 0) + {damping} * (SELECT coalesce(sum(pagerank), 0) FROM rank{k} WHERE domain NOT IN (SELECT u FROM edges)) / (SELECT count(*) FROM nodes) AS pagerank
  FROM nodes n LEFT JOIN (SELECT v, sum(pagerank * share) AS got FROM rank{k} JOIN shares ON domain = u GROUP BY v) g ON n.domain = g.v)""")
    return ",\n".join(out)


def hits(steps: int) -> str:
    out = ["hits0 AS MATERIALIZED (SELECT domain, 1.0::DOUBLE AS hub, 1.0::DOUBLE AS authority FROM nodes)"]
    for k in range(steps):
        out.append(f"""raw{k + 1} AS MATERIALIZED (SELECT n.domain, coalesce(x.got, 0) AS hub, coalesce(y.got, 0) AS authority FROM nodes n
  LEFT JOIN (SELECT u, sum(authority) AS got FROM edges JOIN hits{k} h ON v = h.domain GROUP BY u) x ON n.domain = x.u LEFT JOIN (SELECT v, sum(hub) AS got FROM edges JOIN hits{k} h ON u = h.domain GROUP BY v) y ON n.domain = y.v),
hits{k + 1} AS MATERIALIZED (SELECT domain, hub / coalesce(nullif((SELECT sqrt(sum(hub * hub)) FROM raw{k + 1}), 0), 1) AS hub, authority / coalesce(nullif((SELECT sqrt(sum(authority * authority)) FROM raw{k + 1}), 0), 1) AS authority FROM raw{k + 1})""")
    return ",\n".join(out)


# --- demand -----------------------------------------------------------------------------------------


def _templates(language: str) -> str:
    spec, rows = cls.spec(language), [(0, 0, "head", "head", None, "", "")]
    rows += [(1, i, "alphabet", c, True, "", f" {c}") for i, c in enumerate(lex.CONSONANTS["latin"])]
    rows += [(1, i, "alphabet", c, False, "", f" {c}") for i, c in enumerate(lex.CONSONANTS[spec["consonants"]])]
    rows += [(3, i, "modifier", m, None, "", f" {m}") for i, (m, _) in enumerate(spec["modifiers"])]
    rows += [(4, i, "question", q, None, *q.split("{t}", 1)) for i, q in enumerate(spec["questions"])]
    rows += [(5, i, "commercial", a, None, "", f" {m}") for i, (m, a) in enumerate(lex.COMMERCIAL[language])]
    cell = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else quoted(x)
    return ", ".join("(" + ", ".join(cell(x) for x in r) + ")" for r in rows)


def _seeds() -> str:
    return f"seeds AS (SELECT min(p_partkey) AS seed_ord, p_name AS seed FROM part GROUP BY p_name UNION ALL SELECT -1 - n, text FROM {numbered('text', SAMPLES)})"


def _expansion() -> str:
    return f"""{_seeds()},
templates(stage, ord, kind, tag, for_latin, head, tail) AS (VALUES {_templates('mr')}),
filled AS (SELECT seed_ord, seed, stage, ord, kind, tag, trim(head || seed || tail) AS query FROM (SELECT seed_ord, trim(seed) AS seed, {script_of('trim(seed)')} = 'latin' AS latin FROM seeds WHERE trim(seed) <> '') JOIN templates ON for_latin IS NULL OR for_latin = latin),
firsts AS (SELECT *, row_number() OVER (PARTITION BY seed_ord, {dedup_key('query')} ORDER BY stage, ord) AS r FROM filled),
expansion AS MATERIALIZED (SELECT seed_ord, seed, CAST(row_number() OVER (PARTITION BY seed_ord ORDER BY stage, ord) AS INTEGER) AS q_ord, query, kind, tag FROM firsts WHERE r = 1)"""


EXPANSION = _expansion()


def _fixture() -> str:
    spec = cls.spec("mr")
    mods = "[" + ", ".join(quoted(m) for m, _ in spec["modifiers"]) + "]"
    asks = "[" + ", ".join(quoted(q.replace("{t}", "").strip()) for q in spec["questions"]) + "]"
    tails = ", ".join([f"{mods}[(h % {len(spec['modifiers'])})::INT + 1]", f"{mods}[((h % {len(spec['modifiers'])})::INT + 1) % {len(spec['modifiers'])} + 1]", f"{asks}[(h % {len(spec['questions'])})::INT + 1]", *(quoted(x) for x in ("2026", "pdf", "online", "माहिती", "app", "news", "list"))])
    return f"""hashed AS (SELECT *, ('0x' || substr(sha256('mr:' || query), 1, 16))::UBIGINT AS h FROM expansion),
made AS (SELECT *, list_prepend(query, list_transform([{tails}], lambda t: query || ' ' || t)) AS m FROM hashed),
results AS MATERIALIZED (SELECT seed_ord, seed, q_ord, query, kind, tag, true AS measured,
  CASE WHEN h % 10 = 0 AND len(regexp_split_to_array(query, '\\s+')) > 2 THEN [] ELSE list_slice(list_filter(m, lambda x, i: list_position(m, x) = i), 1, (h % 8)::INT + 3) END AS suggestions FROM made)"""


FIXTURE = _fixture()


def _seen(source: str = "results", name: str = "seen") -> str:
    return f"""{name}_rows AS (SELECT seed_ord, q_ord, generate_subscripts(suggestions, 1) AS pos, unnest(suggestions) AS suggestion FROM {source} WHERE measured),
{name}_keys AS (SELECT *, {dedup_key('suggestion')} AS key FROM {name}_rows),
{name}_firsts AS (SELECT *, row_number() OVER (PARTITION BY seed_ord, key ORDER BY q_ord, pos) AS r FROM {name}_keys),
{name} AS MATERIALIZED (SELECT seed_ord, CAST(row_number() OVER (PARTITION BY seed_ord ORDER BY q_ord, pos) AS INTEGER) AS n, suggestion, key FROM {name}_firsts WHERE r = 1)"""


SEEN = _seen()

RECORDED = """kept AS (SELECT query, min(suggestions) AS suggestions FROM results WHERE (seed_ord + q_ord) % 7 <> 0 GROUP BY query),
recorded AS MATERIALIZED (SELECT e.*, k.query IS NOT NULL AS measured, k.suggestions FROM expansion e LEFT JOIN kept k ON e.query = k.query)"""


def _signals() -> str:
    asks = f"avg(CASE WHEN {is_question('suggestion', 'mr')} THEN 1.0 ELSE 0.0 END)"
    return f"""{_seen('recorded', 'pool')},
heads AS (SELECT seed_ord, seed, measured, suggestions, list_position(list_transform(suggestions, lambda s: {dedup_key('s')}), {dedup_key('seed')}) AS rank FROM recorded WHERE kind = 'head'),
counts AS (SELECT seed_ord, seed, count(*) AS queries_asked, count(*) FILTER (measured) AS queries_measured, count(*) FILTER (measured AND len(suggestions) = 0) AS queries_absent, count(*) FILTER (NOT measured) AS queries_failed,
  count(*) FILTER (kind <> 'head' AND measured AND len(suggestions) > 0) / nullif(count(*) FILTER (kind <> 'head' AND measured), 0) AS breadth FROM recorded GROUP BY seed_ord, seed),
own AS (SELECT seed_ord, {asks} AS own FROM (SELECT seed_ord, unnest(suggestions) AS suggestion FROM heads WHERE measured) GROUP BY seed_ord),
pools AS (SELECT seed_ord, {asks} AS pooled, count(*) AS suggestions_seen, avg(CASE WHEN {buyer('suggestion')} IS NOT NULL THEN 1.0 ELSE 0.0 END) AS buyer,
  count(*) FILTER ({script_of('suggestion')} = 'devanagari') AS n_devanagari, count(*) FILTER ({script_of('suggestion')} = 'latin') AS n_latin, count(*) FILTER ({script_of('suggestion')} = 'mixed') AS n_mixed FROM pool GROUP BY seed_ord),
signals AS MATERIALIZED (SELECT c.*, CASE WHEN h.measured THEN CASE WHEN len(h.suggestions) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS coverage,
  CASE WHEN h.measured AND len(h.suggestions) > 0 THEN CASE WHEN h.rank > 0 THEN 1.0::DOUBLE / h.rank ELSE 0.0::DOUBLE END END AS depth,
  CASE WHEN h.measured THEN CASE WHEN len(h.suggestions) > 0 THEN own ELSE pooled END END AS density,
  coalesce(suggestions_seen, 0) AS suggestions_seen, coalesce(buyer, 0.0::DOUBLE) AS buyer_intent_score,
  CASE WHEN suggestions_seen > 0 THEN (CASE {script_of('c.seed')} WHEN 'devanagari' THEN n_devanagari WHEN 'latin' THEN n_latin WHEN 'mixed' THEN n_mixed ELSE 0 END + n_mixed) / suggestions_seen END AS script_affinity
  FROM counts c LEFT JOIN heads h USING (seed_ord) LEFT JOIN own USING (seed_ord) LEFT JOIN pools USING (seed_ord))"""


SIGNALS = _signals()
SIGNAL_COLUMNS = "seed_ord, seed, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("coverage", "breadth", "depth", "density", "script_affinity", "buyer_intent_score")) + ", suggestions_seen, queries_asked, queries_measured, queries_absent, queries_failed"

_WEIGHTS = {"breadth": 0.50, "coverage": 0.25, "density": 0.15, "depth": 0.10}
_MASS = " + ".join(f"CASE WHEN {a} IS NOT NULL THEN {w}::DOUBLE ELSE 0 END" for a, w in _WEIGHTS.items())
_TOTAL = " + ".join(f"coalesce({a} * {w}::DOUBLE, 0)" for a, w in _WEIGHTS.items())
SCORES = f"""massed AS (SELECT *, {_MASS} AS measured_mass, {intent('seed', 'mr')} AS intent FROM signals),
totals AS (SELECT *, round(CASE WHEN measured_mass > 0 THEN {_TOTAL} END, 6) AS demand FROM massed),
scores AS MATERIALIZED (SELECT *, measured_mass >= 1 - 1e-5 AS demand_complete, CASE WHEN demand IS NULL THEN 'insufficient' WHEN demand >= 0.5 THEN 'strong' WHEN demand >= 0.25 THEN 'moderate' ELSE 'weak' END AS evidence_band,
  CASE WHEN demand IS NULL THEN 'needs-measurement' WHEN intent = 'navigational' THEN 'skip-navigational' WHEN demand >= 0.5 THEN 'high' WHEN demand >= 0.25 THEN 'medium' ELSE 'low' END AS priority_band FROM totals)"""

CLUSTERS = f"""keyed AS (SELECT *, {topic_key('seed')} AS topic_id FROM scores),
grouped AS (SELECT topic_id, arg_min({{'seed': seed, 'intent': intent}}, (-coalesce(demand, -1.0), seed_ord)) AS p, count(*) AS members, avg(coalesce(demand, 0.0)) AS cluster_demand, min(seed_ord) AS first_ord FROM keyed GROUP BY topic_id),
clusters AS MATERIALIZED (SELECT topic_id, p.seed AS primary_title, p.intent AS intent, members, cluster_demand, CAST(row_number() OVER (ORDER BY cluster_demand DESC, first_ord) AS INTEGER) AS publish_order FROM grouped)"""

TOPIC_LINKS = f"""titles AS (SELECT primary_title, intent, list_filter(regexp_split_to_array(lower(primary_title), '\\s+'), lambda w: w <> '') AS words, {topic_key('primary_title')} AS skeleton FROM clusters),
links AS MATERIALIZED (SELECT a.primary_title AS source_topic, b.primary_title AS target_topic FROM titles a JOIN titles b ON a.primary_title <> b.primary_title
  WHERE list_has_any(a.words, b.words) OR (length(a.skeleton) >= 2 AND length(b.skeleton) >= 2 AND a.intent = 'informational' AND b.intent IN ('howto', 'freshness', 'commercial') AND list_has_any(string_split(a.skeleton, ''), string_split(b.skeleton, ''))))"""

COMPETITION = f"""WITH {_seeds()}, obs(ord, keyword, thin, weak, stale) AS (VALUES (0, 'Sheti Marathi', true, true, NULL), (1, 'मराठी शेती', false, true, NULL), (2, 'marathi  sheti', NULL, false, true), (3, 'demat account price', false, false, false), (4, 'शेअर-बाजार', NULL, NULL, true)),
o AS (SELECT *, {dedup_key('keyword')} AS k, {topic_key('keyword')} AS t, {competition_band()} AS band FROM obs),
e AS (SELECT k, arg_max({{'keyword': keyword, 'band': band}}, ord) AS x FROM o GROUP BY k), f AS (SELECT t, arg_min({{'keyword': keyword, 'band': band}}, ord) AS x FROM o GROUP BY t)
SELECT seed_ord, seed, coalesce(e.x, f.x).keyword AS observed_keyword, coalesce(e.x, f.x).band AS competition_band
FROM (SELECT *, {dedup_key('seed')} AS sk, {topic_key('seed')} AS st FROM seeds) s LEFT JOIN e ON sk = e.k LEFT JOIN f ON st = f.t"""

def _cell(c: str) -> str:
    return f"coalesce(printf('%.4f', round({c}, 4)), '')"


CSV_COLUMNS = f"""seed, {_cell('demand')} AS demand, CASE WHEN demand_complete THEN 'True' ELSE 'False' END AS demand_complete, priority_band, intent, {_cell('breadth')} AS breadth, 'True' AS breadth_comparable,
{', '.join(f'{_cell(c)} AS {c}' for c in ('coverage', 'density', 'depth'))}, '' AS competition_band, {', '.join(f'{c}::VARCHAR AS {c}' for c in ('suggestions_seen', 'queries_asked', 'queries_measured', 'queries_absent'))}"""


def _three(c: str) -> str:
    return f"coalesce(printf('%.3f', {c}), '⊥')"


#: The table and the candidates of a report, as lines.
REPORT = f"""SELECT 1 AS part, row_number() OVER (ORDER BY demand DESC NULLS LAST, seed_ord) AS n, '| `' || seed || '` | **' || {_three('demand')} || CASE WHEN demand IS NOT NULL AND NOT demand_complete THEN ' (partial)' ELSE '' END || '** | `' || priority_band || '` | ' || intent || ' | ' || {_three('round(breadth, 6)')} || ' | ' || {_three('round(coverage, 6)')} || ' | ' || {_three('round(density, 6)')} || ' | ' || {_three('round(depth, 6)')} || ' | unmeasured | ' || suggestions_seen || ' |' AS line FROM scores
UNION ALL SELECT 5, row_number() OVER (ORDER BY suggestion), '- ' || suggestion FROM (SELECT DISTINCT suggestion FROM pool WHERE n <= 8 ORDER BY suggestion LIMIT 25)"""

_SHAPES = "CASE intent " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in lex.ARTICLE_SHAPES.items()) + " ELSE '' END"
PLAN = f"""SELECT 1 AS part, publish_order::BIGINT AS n, '| #' || publish_order || ' | **' || primary_title || '** | ' || printf('%.3f', round(cluster_demand, 6)) || ' | `' || intent || '` | ' || {_SHAPES} || ' |' AS line FROM clusters
UNION ALL SELECT 3, row_number() OVER (ORDER BY source_topic, target_topic), '| ' || source_topic || ' | ' || target_topic || ' | **`' || target_topic || '`** |' FROM (SELECT DISTINCT source_topic, target_topic FROM links)
UNION ALL SELECT 5, publish_order, '- `' || primary_title || '`' FROM clusters WHERE primary_title NOT IN (SELECT source_topic FROM links UNION SELECT target_topic FROM links)"""


def expected(x: str) -> str:
    spec = cls.spec("mr")
    rest = 1 + len({m for m, _ in spec["modifiers"]}) + len(spec["questions"])
    return f"(CASE WHEN {script_of(x)} = 'latin' THEN {len(lex.CONSONANTS['latin'])} ELSE {len(lex.CONSONANTS[spec['consonants']])} END + {rest})::BIGINT"


def _votes(x: str) -> dict[str, str]:
    return {"buy": f"{buyer(x)} IS NOT NULL", "how": any_of(f"lower({x})", lex.HOWTO_WORDS), "versus": any_of(f"lower({x})", lex.VERSUS_WORDS), "ask": is_question(x, "mr")}


_OWN = {k: f"(coalesce({k}, 0) + CASE WHEN {v} THEN 2 ELSE 0 END)" for k, v in _votes("seed").items()}
EFFECTIVE = f"""SELECT seed_ord, seed, CASE WHEN intent IN ('transactional', 'commercial') OR {_OWN['buy']} >= 2 THEN 'commercial' WHEN intent = 'comparison' OR {_OWN['versus']} >= 1 THEN 'comparison' WHEN intent = 'howto' OR {_OWN['how']} >= 2 THEN 'howto'
  WHEN intent IN ('informational', 'freshness') OR coalesce(ask, 0) >= 3 THEN 'informational' WHEN {_OWN['buy']} > 0 THEN 'commercial' ELSE 'informational' END AS effective
FROM scores LEFT JOIN (SELECT seed_ord, {', '.join(f'count(*) FILTER ({v}) AS {k}' for k, v in _votes('suggestion').items())} FROM pool GROUP BY seed_ord) USING (seed_ord)"""

# --- search ---------------------------------------------------------------------------------------------

_WORDS = f"regexp_extract_all({fold('text')}, '{WORD}+')"


def bm25(terms: list[str]) -> str:
    names = ", ".join(quoted(t) for t in terms)
    return f"""worded AS MATERIALIZED (SELECT doc_id, {_WORDS} AS words FROM documents),
hits AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(words) AS term FROM worded) WHERE term IN ({names}) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM hits GROUP BY term),
bm25 AS (SELECT doc_id, count(*) AS matched, round(sum(greatest(ln(((SELECT count(*) FROM worded) - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len(words) / (SELECT avg(len(words)) FROM worded)))), 6) AS bm25
  FROM hits JOIN dfs USING (term) JOIN worded USING (doc_id) GROUP BY doc_id)"""


def _terms(terms: list[str]) -> list[str]:
    """The rule for at most 8 terms of a cluster, over lists."""
    native = {t: any("ऀ" <= c <= "ॿ" for c in t) for t in terms}
    return [t for t in sorted(set(terms), key=lambda t: (not native[t], len(t), t))[:8] if len(t) >= 3 or native[t]]


def retrieve(clusters: list[list[str]], where: str, extra: str = "") -> str:
    chosen = [(i, t) for i, terms in enumerate(clusters) for t in _terms(terms)]
    tf = ", ".join(f"len(list_filter(words, lambda w: starts_with(w, {quoted(t)})))" for _, t in chosen)
    n, weights = len(clusters), "+".join(f"greatest(ln(((SELECT count(*) FROM worded) - d{k} + 0.5) / (d{k} + 0.5)), 1e-6) * tf[{k + 1}] * 2.2 / (tf[{k + 1}] + 1.2 * (0.25 + 0.75 * dl / (SELECT avg(dl) FROM worded)))" for k in range(len(chosen)))
    hits = " + ".join("(" + " OR ".join(f"tf[{k + 1}] > 0" for k, (j, _) in enumerate(chosen) if j == i) + ")::INT" for i in range(n) if any(j == i for j, _ in chosen))
    return f"""WITH worded AS MATERIALIZED (SELECT doc_id, {where} AS kept, dl, [{tf}] AS tf FROM (SELECT *, coalesce(len(words), 0) AS dl FROM (SELECT *, {_WORDS} AS words FROM documents))),
dfs AS (SELECT {', '.join(f'count(*) FILTER (tf[{k + 1}] > 0) AS d{k}' for k in range(len(chosen)))} FROM worded),
hit AS MATERIALIZED (SELECT doc_id, {hits} AS clusters_hit, round({weights}, 6) AS bm25 FROM worded, dfs WHERE kept),
one AS (SELECT 1 AS level, * FROM (SELECT * FROM hit WHERE clusters_hit = {n} ORDER BY bm25 DESC, doc_id LIMIT 150)),
two AS (SELECT 2 AS level, * FROM (SELECT * FROM hit WHERE clusters_hit > 0 ORDER BY bm25 DESC, doc_id LIMIT 150) WHERE clusters_hit < {n} AND (SELECT count(*) FROM one) < 5)
SELECT doc_id, CAST(level AS INTEGER) AS level, CAST(clusters_hit AS INTEGER) AS clusters_hit, bm25{extra} FROM (SELECT * FROM one UNION ALL SELECT * FROM two)"""


# --- index ---

def _escaped(x: str) -> str:
    return f"url_decode({x})"


def _stems(x: str) -> str:
    def one(form: str) -> str:
        parts = [f"CASE WHEN regexp_extract({form}, '{stem.pattern(endings)}', 1) <> '' THEN [regexp_extract({form}, '{stem.pattern(endings)}', 1) || e FOR e IN {list(new)}] ELSE [] END" for endings, new in stem.GROUPS]
        return f"list_concat([{form}], {', '.join(parts)})"

    found = f"list_distinct(list_concat({one(x)}, {one(f'translate({x}, {quoted(stem.EYELASH_RA)}, {quoted(stem.RA)})')}))"
    named = f"(list_has_any({found}, {stem.NAMES}) OR regexp_matches({x}, '{'|'.join(stem.NAMES)}'))"
    return f"CASE WHEN length({x}) <= 2 THEN [{x}] WHEN {named} THEN list_concat({found}, {stem.LEMMAS}) ELSE {found} END"


_COMPOUNDS = ", ".join(f"({quoted(c)}, {quoted(p)})" for c, parts in lex.COMPOUNDS.items() for p in parts)
_BILINGUAL = ", ".join(f"({quoted(k)}, {quoted(o)})" for k, others in lex.BILINGUAL.items() for o in others)
#: Pages and sites made from the page table and the samples, in terms that both engines work out alike.
CATEGORIES = ["finance", "News", "agri", "Culture", "gov", "Tech"]
SITES = f"""known AS MATERIALIZED (SELECT page_id, domain, title, url, path, CASE WHEN page_id % 7 <> 0 THEN TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 1 DAY * (abs(page_id) % 60) END AS lastmod, TIMESTAMP '2023-11-30 00:00:00' AS fetched_at, CASE WHEN page_id % 3 <> 0 THEN 0.25 END AS ratio FROM (
  SELECT f.page_id, f.domain, f.title, p.url, regexp_extract(p.url, '^https?://[^/?#]+([^?#]*)', 1) AS path FROM ({PAGE_FACTS}) f JOIN pages p USING (page_id)
  UNION ALL SELECT -1 - n, CASE WHEN n % 2 = 0 THEN 'lokmat.com' ELSE 'agrowon.esakal.com' END, text, 'https://sample.in/' || n, '/' FROM {numbered('text', SAMPLES)})),
sites AS (SELECT DISTINCT domain, {CATEGORIES}[length(domain) % {len(CATEGORIES)} + 1] AS category, CASE WHEN length(domain) % 5 <> 0 THEN length(domain) / 1000 END AS pagerank, CASE WHEN length(domain) % 2 = 0 THEN 0.5 END AS authority, CASE WHEN length(domain) % 3 = 0 THEN 0.75 END AS ratio FROM known)"""


def _vocabulary(name: str, words: str) -> str:
    return f"""{name}_own AS (SELECT word, unnest({_stems('word')}) AS term FROM {words}),
{name} AS MATERIALIZED (SELECT word, term FROM {name}_own
  UNION SELECT word, part FROM {words} JOIN compounds ON word = compound
  UNION SELECT w.word, unnest({_stems('part')}) FROM {words} w JOIN compounds ON w.word = compound
  UNION SELECT word, part FROM {words} JOIN compounds ON contains(word, compound) WHERE word NOT IN (SELECT compound FROM compounds)
  UNION SELECT word, other FROM {name}_own JOIN bilingual ON term = base
  UNION SELECT word, {topic_key('word')} FROM {words} WHERE regexp_matches(word, '[ऀ-ॿ]') AND length({topic_key('word')}) >= 3)"""


INDEX = f"""{SITES},
compounds(compound, part) AS (VALUES {_COMPOUNDS}), bilingual(base, other) AS (VALUES {_BILINGUAL}),
texts AS (SELECT page_id, concat_ws(' ', coalesce(title, ''), regexp_replace({_escaped("coalesce(path, '')")}, '[-_/]+', ' ', 'g'), domain) AS text FROM known WHERE title IS NOT NULL OR path <> '/'),
found_words AS MATERIALIZED (SELECT page_id, word, count(*) AS times FROM (SELECT page_id, unnest(regexp_extract_all({fold(_escaped('text'))}, '{WORD}+')) AS word FROM texts) WHERE length(word) >= 2 GROUP BY ALL),
distinct_words AS MATERIALIZED (SELECT DISTINCT word FROM found_words),
{_vocabulary('vocabulary', 'distinct_words')},
postings AS MATERIALIZED (SELECT term, page_id, sum(times)::BIGINT AS tf FROM found_words JOIN vocabulary USING (word) GROUP BY ALL),
indexed AS MATERIALIZED (SELECT page_id, sum(tf) AS dl, string_agg(term, ' ' ORDER BY term) AS terms FROM postings GROUP BY page_id)"""


#: The index with the words of categories.
SITE_INDEX = INDEX.replace("domain) AS text FROM known WHERE", "domain, category) AS text FROM known JOIN sites USING (domain) WHERE")


def search_index(query: str, category: str | None = None, freshness: str | None = None, sort_by: str = "relevance", limit: int = 25) -> str:
    """A whole search over INDEX; where all filters leave nothing, the last ones are left out, as many as that takes."""
    asked = " ".join(query.lower().split())
    words = [w for w in asked.split() if w not in lex.STOPWORDS]
    filters = [f"coalesce(contains(lower(category), {quoted(category.lower())}), false)"] if category else []
    if freshness:
        filters.append(f"coalesce(lastmod >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL {({'24h': 2, 'week': 7, 'month': 34})[freshness]} DAY, false)")
    count = len(filters)
    flags = "".join(f", {f} AS f{i}" for i, f in enumerate(filters))
    dropped = "CASE " + " ".join(f"WHEN EXISTS (SELECT 1 FROM every WHERE {' AND '.join(['true', *(f'f{i}' for i in range(count - k))])}) THEN {k}" for k in range(count)) + f" ELSE {count} END" if count else "0"
    kept = " AND ".join(["true", *(f"(f{i} OR gone >= {count - i})" for i in range(count))])
    order = {"date": "moment DESC NULLS LAST, ", "pagerank": "pagerank DESC, "}.get(sort_by, "")
    last = {"date": "moment DESC NULLS LAST, ", "pagerank": "round(pagerank, 4) DESC, "}.get(sort_by, "")
    entity = " + ".join(["0.0"] + [f"CASE WHEN {any_of('haystack', present)} THEN {boost} ELSE 0.0 END" for wanted, present, boost in lex.ENTITY_BOOSTS if any(w in asked for w in wanted)])
    fresh = "true" if any(w in asked for w in lex.FRESH_WORDS) else "false"
    n = len(words)
    return f"""WITH {INDEX}, asked(ci, word) AS (VALUES {', '.join(f'({i}, {quoted(w)})' for i, w in enumerate(words))}), asked_words AS (SELECT DISTINCT word FROM asked),
{_vocabulary('meant', 'asked_words')},
clusters AS MATERIALIZED (SELECT ci, term, row_number() OVER (PARTITION BY ci ORDER BY (NOT regexp_matches(term, '[ऀ-ॿ]'))::INT, length(term), term) AS place FROM asked JOIN meant USING (word)),
wanted AS (SELECT ci, term FROM clusters WHERE place <= 8 AND (length(term) >= 3 OR regexp_matches(term, '[ऀ-ॿ]'))),
hits AS MATERIALIZED (SELECT page_id, ci, w.term, sum(tf) AS tf FROM postings p JOIN wanted w ON starts_with(p.term, w.term) GROUP BY ALL),
dfs AS (SELECT ci, term, count(*) AS df FROM hits GROUP BY ALL),
ranked AS MATERIALIZED (SELECT page_id, count(DISTINCT ci) AS clusters_hit, round(sum(greatest(ln(((SELECT count(*) FROM indexed) - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / (SELECT avg(dl) FROM indexed)))), 6) AS bm25 FROM hits JOIN dfs USING (ci, term) JOIN indexed USING (page_id) GROUP BY page_id),
every AS MATERIALIZED (SELECT r.*, k.url, k.title, coalesce(k.path, '') AS path, k.domain, category, lastmod, coalesce(lastmod, fetched_at) AS moment, coalesce(pagerank, 0.01) AS pagerank, coalesce(authority, 0.0) AS authority, coalesce(k.ratio, s.ratio, 0.5) AS ratio{flags} FROM ranked r JOIN known k USING (page_id) JOIN sites s USING (domain)),
fallback AS (SELECT {dropped} AS gone), kept AS MATERIALIZED (SELECT * FROM every, fallback WHERE {kept}),
one AS MATERIALIZED (SELECT * FROM kept WHERE clusters_hit = {n} ORDER BY {order}bm25 DESC, page_id LIMIT 150),
best AS (SELECT 1 AS level, * FROM one UNION ALL SELECT 2, * FROM (SELECT * FROM kept ORDER BY {order}bm25 DESC, page_id LIMIT 150) WHERE {n} > 1 AND clusters_hit < {n} AND (SELECT count(*) FROM one) < 5),
seen AS (SELECT *, lower(concat_ws(' ', coalesce(title, ''), lower({_escaped('path')}), path, terms)) AS haystack, lower(concat_ws(' ', coalesce(title, ''), lower({_escaped('path')}))) AS shown FROM best JOIN indexed USING (page_id)),
judged AS (SELECT *, (SELECT count(DISTINCT ci) FROM clusters WHERE contains(haystack, lower(term))) / {float(n)} AS coverage, {any_of('shown', words)} AS title_hit, {entity} AS entity, coalesce(date_diff('day', moment::DATE, DATE '2024-01-20') BETWEEN 0 AND 5, false) AS recent, 1 / (1 + greatest(bm25, 0)) AS norm FROM seen),
scored AS (SELECT *, round(greatest(0.01, (0.40 * CASE WHEN coverage >= 0.4 THEN coverage ELSE coverage * coverage END + 0.25 * norm + CASE WHEN title_hit THEN 0.2 ELSE 0.0 END + entity) * (0.6 + 0.3 * least(1.0, 10 * pagerank) + 0.1 * least(1.0, ratio))) + CASE WHEN recent AND {fresh} AND coverage >= 0.4 THEN 0.15 ELSE 0.0 END, 4) AS score FROM judged)
SELECT page_id AS doc_id, url, CASE WHEN length({headline('title')}) >= 4 THEN {headline('title')} || ' | ' || {publisher('domain')} ELSE coalesce(nullif(title, ''), {publisher('domain')}) END AS title, category, {snippet()} AS snippet, score, round(coverage, 2) AS coverage, CAST(level AS INTEGER) AS level, {native_date('moment')} AS formatted_date, recent, CAST(gone AS INTEGER) AS dropped
FROM scored ORDER BY {last}score DESC, page_id LIMIT {limit}"""


def about(query: str, **options) -> str:
    """One row about a query: what it is taken for, and how many results it has."""
    named = lambda table: "CASE intent " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in table.items()) + " END"
    return f"""SELECT query, clean_query, intent, {named(lex.INTENT_LABELS)} AS intent_label, {named(lex.SHAPE_LABELS)} AS shape_label, is_question, (SELECT count(*) FROM ({search_index(query, limit=1000, **options)})) AS total_found
  FROM (SELECT query, clean_query, {intent('clean_query', 'mr')} AS intent, {is_question('clean_query', 'mr')} AS is_question FROM (SELECT {quoted(query)} AS query, {fold(quoted(query))} AS clean_query))"""


def discover(limit: int = 30) -> str:
    head = headline("title")
    return f"""WITH {SITES}, shown AS (SELECT page_id, url, domain, coalesce(category, 'बातम्या') AS section, CASE WHEN length({head}) >= 5 THEN {head} ELSE title END AS shown_title, coalesce(lastmod, fetched_at) AS moment, coalesce(pagerank, 0.01) AS score FROM known JOIN sites USING (domain) WHERE {feed_where('general', None)}),
  dated AS (SELECT *, CASE WHEN moment::DATE = DATE '2024-01-20' THEN 1 WHEN moment::DATE = DATE '2024-01-19' THEN 2 WHEN date_trunc('month', moment) = DATE '2024-01-01' THEN 3 ELSE 4 END AS day FROM shown),
  placed AS (SELECT *, row_number() OVER (ORDER BY day, moment DESC NULLS LAST, score DESC, page_id) AS rank FROM dated)
  SELECT rank, page_id, url, shown_title AS title, domain, {publisher('domain')} AS publisher, section AS category, ({publisher('domain')}) || ' — ' || left(shown_title, 95) || {quoted(lex.CARD_TEXT)} AS snippet, {relative_time('moment', AS_OF)} AS relative_time,
    CASE WHEN len(regexp_split_to_array(shown_title, '\\s+')) < 10 THEN {quoted(lex.READING[0])} ELSE {quoted(lex.READING[1])} END AS reading_time, round(score, 4) AS pagerank, {first_match('shown_title', lex.TOPIC_RULES, '#महाराष्ट्र_अपडेट्स')} AS topic_tag, rank = 1 AS is_featured FROM placed WHERE rank <= {limit}"""


def publisher(x: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in lex.DOMAIN_NAMES.items()) + f" ELSE {x} END"


def snippet() -> str:
    ladder = " ".join(f"WHEN category IN ({', '.join(quoted(c) for c in cats)}) OR {any_of('haystack', words)}{' OR ' + any_of('domain', domains) if domains else ''} THEN {quoted(text)}" for cats, domains, words, text in lex.SNIPPETS)
    return f"({publisher('domain')}) || ' — ' || CASE {ladder} ELSE {quoted(lex.SNIPPET_OTHER)} END"


def feed_where(mode: str, topic: str | None) -> str:
    out = [any_of("title", lex.FEED_LETTERS)]
    if mode == "mpsc":
        out.append(f"NOT {any_of('title', lex.EXAM_BLOCKED)}")
    wanted = lex.FEED_TOPICS.get((mode, topic)) or lex.FEED_TOPICS.get((mode, None))
    if wanted:
        out.append("(" + " OR ".join(any_of(c if c == "title" else f"lower({c})", words if c == "title" else [w.lower() for w in words]) for c, words in wanted.items()) + ")")
    return " AND ".join(out)


def related(x: str) -> str:
    groups = " ".join(f"WHEN {any_of(fold(x), words)} THEN [{', '.join(quoted(q) for q in queries)}]" for words, queries in lex.RELATED)
    general = "[" + ", ".join(f"{fold(x)} || {quoted(' ' + e)}" for e in lex.RELATED_ENDINGS) + "]"
    return f"list_slice(list_filter(CASE {groups} ELSE {general} END, lambda q: lower(q) <> {fold(x)}), 1, 5)"


def hybrid(source: str) -> str:
    return f"""SELECT doc_id, coverage, round(norm, 3) AS bm25_norm, round(greatest(0.01, (0.40 * CASE WHEN coverage >= 0.4 THEN coverage ELSE coverage * coverage END + 0.25 * norm + CASE WHEN title_hit THEN 0.2 ELSE 0 END + entity) * (0.6 + 0.3 * least(1.0, 10 * pagerank) + 0.1 * 0.5)) + CASE WHEN recent AND coverage >= 0.4 THEN 0.15 ELSE 0 END, 4) AS score, CASE WHEN coverage >= 0.8 THEN 'exact' ELSE 'relaxed' END AS tier
  FROM (SELECT doc_id, matched / 5 AS coverage, 1 / (1 + greatest(bm25, 0)) AS norm, starts_with(text, 'The') AS title_hit, CASE WHEN contains(text, 'MIT') THEN 0.35 ELSE 0.0 END AS entity, doc_id % 2 = 0 AS recent, length(source) / 100 AS pagerank FROM {source})"""


def suggest(prefix: str, limit: int) -> str:
    picked: list[str] = []
    for native, english, triggers in lex.SUGGESTIONS:
        if any(prefix in t.lower() or prefix.startswith(t.lower()) for t in triggers) or prefix in native.lower() or prefix in english.lower():
            picked += [native, english]
    picked = list(dict.fromkeys(picked))[:limit]
    return " UNION ALL ".join(f"SELECT {i} AS ord, {quoted(p)} AS suggestion" for i, p in enumerate(picked))


_SECTIONS = ", ".join(f"({i}, {quoted(d[0])}, {quoted(c)})" for i, d in enumerate(lex.DIRECTORY) for c in d[3])
_CATS = "[" + ", ".join(quoted(c) for d in lex.DIRECTORY for c in d[3]) + "]"
DIRECTORY = f"""WITH sections(section_ord, section, category) AS (VALUES {_SECTIONS}),
sites AS (SELECT 's' || s_suppkey || '.example' AS domain, {_CATS}[s_suppkey % len({_CATS}) + 1] AS category, CASE WHEN s_suppkey % 5 <> 0 THEN s_name END AS title, round(coalesce(CASE WHEN s_suppkey % 7 <> 0 THEN s_acctbal / 100000 END, 0.0), 4) AS pagerank,
  coalesce(nullif(CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey * 3 END, 0), nullif(s_suppkey % 4, 0), 0) AS total_urls FROM supplier)
SELECT section, row_number() OVER (PARTITION BY section ORDER BY pagerank DESC, total_urls DESC, domain) AS rank, domain, coalesce(title, domain) AS title, pagerank, total_urls FROM sites JOIN sections USING (category)"""


# --- slugs, suggestions, blueprints ---

#: Paths whose last part is the page's title; a dictionary of beginnings of words in them.
SLUG_PATHS = f"""SELECT page_id, domain, path || '/' || regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]+', '-', 'g') || CASE WHEN page_id % 3 = 0 THEN '.html' WHEN page_id % 3 = 1 THEN '-x-2026' ELSE '' END AS path
  FROM (SELECT f.page_id, f.domain, f.title, regexp_extract(p.url, '^https?://[^/?#]+([^?#]*)', 1) AS path FROM ({PAGE_FACTS}) f JOIN pages p USING (page_id))"""
_ENDED = "regexp_replace(string_split(regexp_replace(plain, '(?i)\\.(cms|html|shtml|php|aspx?)$', ''), '/')[-1], '-\\d+$', '')"
_ENDED = f"regexp_replace(regexp_replace({_ENDED}, '-[a-z0-9]{{5,15}}$', ''), '-(ssb|zws|rat|ak|pp|dc|ab)\\d*.*$', '')"


def slug_titles(fallbacks: tuple[str, str, str]) -> str:
    no_words, money, other = (quoted(x) for x in fallbacks)
    return f"""WITH paths AS ({SLUG_PATHS}), plains AS (SELECT page_id, domain, regexp_replace(path, '^/+|/+$', '', 'g') AS plain FROM paths),
  slugs AS MATERIALIZED (SELECT page_id, domain, list_filter(regexp_split_to_array(lower({_ENDED}), '[-_]+'), lambda w: w <> '') AS words FROM plains),
  every AS (SELECT page_id, unnest(words) AS word, generate_subscripts(words, 1) AS n FROM slugs), distinct_words AS (SELECT DISTINCT word FROM every),
  dictionary AS (SELECT DISTINCT left(word, 3 + length(word) % 3) AS slug, upper(left(word, 3 + length(word) % 3)) || '*' AS native FROM distinct_words WHERE length(word) >= 5),
  found AS (SELECT word, arg_max(native, length(slug)) AS native FROM distinct_words JOIN dictionary ON word = slug OR (length(slug) >= 4 AND starts_with(word, slug)) GROUP BY word),
  known AS (SELECT * FROM found UNION ALL SELECT word, word FROM distinct_words WHERE regexp_matches(word, '^\\d+$') AND word NOT IN (SELECT word FROM found)),
  told AS (SELECT page_id, string_agg(native, ' ' ORDER BY n) AS told, count(*) AS n FROM every JOIN known USING (word) GROUP BY page_id)
  SELECT page_id, CASE WHEN len(words) = 0 THEN domain || ' — ' || {no_words} WHEN n >= 2 THEN told || ' | ' || domain WHEN contains(domain, 'arthasakshar') OR contains(domain, 'paisa') THEN domain || ' — ' || {money} ELSE domain || ' — ' || {other} END AS title FROM slugs LEFT JOIN told USING (page_id)"""


def suggest_titles(prefix: str, leads: list[str], limit: int = 8) -> str:
    """Titles of pages with a word that begins with a prefix that no curated phrase has."""
    first = "trim(regexp_replace(regexp_split_to_array(title, '[–—|\\-:»«]')[1], '[''\"‘’“”]', '', 'g'))"
    phrase = f"array_to_string(list_slice(regexp_split_to_array(regexp_replace({first}, '^({'|'.join(leads)})\\s*', ''), '\\s+'), 1, 7), ' ')"
    return f"""WITH f AS ({PAGE_FACTS}), p AS (SELECT page_id, {phrase} AS suggestion FROM f WHERE len(list_filter(regexp_extract_all({fold('title')}, '{WORD}+'), lambda w: starts_with(w, {quoted(prefix)}))) > 0)
  SELECT row_number() OVER (ORDER BY ord) AS rank, suggestion FROM (SELECT suggestion, min(page_id) AS ord FROM p WHERE length(suggestion) >= 5 GROUP BY suggestion ORDER BY ord LIMIT {limit})"""


def _section(i: int) -> str:
    heading = f"CASE (p_partkey + {i}) % 6 WHEN 0 THEN 'Introduction' WHEN 1 THEN '2026 कागदपत्रे' WHEN 2 THEN 'comparison' WHEN 3 THEN 'common mistakes' WHEN 4 THEN 'Verdict' ELSE p_name END"
    return f"""concat('{{"heading":"', {heading}, '","key_points":["', p_name, '"', CASE WHEN p_partkey % 4 = 0 THEN ',"किंमत ₹ and 500 W"' ELSE '' END, '],"queries_answered":["q{i} ","q{i}"," ","', CASE WHEN p_partkey % 5 = 0 THEN 'q1{i}' ELSE 'q{i}' END, '"]}}')"""


def _listed(name: str, modulus: int) -> str:
    return f"""CASE p_partkey % {modulus} WHEN 0 THEN ',"{name}":["a","b"]' WHEN 1 THEN ',"{name}":["a"]' ELSE '' END"""


def _member(name: str, modulus: int, value: str) -> str:
    return f"""CASE p_partkey % {modulus} WHEN 0 THEN ',"{name}":{value}' WHEN 1 THEN ',"{name}":""' ELSE '' END"""


#: Blueprints made from the part table, in terms that both engines work out alike.
BLUEPRINT = "concat(" + ", ".join([
    """'{"title":"', p_name, '","h1":"', p_type, '","meta_description":"', CASE WHEN p_partkey % 7 = 0 THEN 'In conclusion, as we all know' WHEN p_partkey % 7 = 1 THEN 'see gov.in' ELSE '' END, '","outline":['""",
    "concat_ws(',', " + ", ".join(f"CASE WHEN p_partkey % 8 >= {i} THEN {_section(i)} END" for i in range(1, 6)) + ")",
    """'],"faq":['""",
    "concat_ws(',', " + ", ".join(f"""CASE WHEN p_partkey % 5 >= {i} THEN '{{"q":"why {i}?","answer":"so"}}' END""" for i in range(1, 4)) + ")", "']'",
    *[_listed(n, m) for n, m in (("paisa_vasool_criteria", 3), ("verification_checklist", 4), ("prerequisites_and_documents", 3), ("step_sequence", 5), ("rejection_pitfalls", 4), ("comparison_matrix", 3), ("who_should_buy", 4), ("core_pillars", 5))],
    _member("subsidy_eligibility", 3, '"yes"'), _member("product_review_schema", 3, '{"@type":"Product","rating":4}'), _member("howto_schema", 4, '{"steps":["a"]}'), _member("verdict_summary", 5, '"good"'), _member("regulatory_2026_landscape", 3, '"new"'), "'}'",
]) + ")"
_INTENTS = "CASE p_partkey % 4 WHEN 0 THEN 'commercial' WHEN 1 THEN 'howto' WHEN 2 THEN 'comparison' ELSE 'informational' END"
BLUEPRINT_INTENT = _INTENTS


def blueprint_audit(fluff: list[str], generic: list[str], specific: list[tuple[str, str]], headings: dict[str, list[str]], grades: list[tuple[int, str]]) -> str:
    points = lambda *checks: "(" + " + ".join(f"CASE WHEN {c} THEN {p} ELSE 0 END" for c, p in checks) + ")"
    count = lambda name: f"coalesce(json_array_length(j, '$.{name}'), 0)"
    given = lambda path: f"(coalesce(trim(j->>'{path}'), '') NOT IN ('', '[]', '{{}}', 'false', 'null', '0'))"
    headed = lambda kind: f"len(list_filter(heads, lambda h: {any_of('lower(h)', headings[kind])})) > 0"
    rated = "(" + " OR ".join([given("$.product_review_schema.pros"), given("$.product_review_schema.cons"), given("$.product_review_schema.rating")]) + " OR coalesce(j->>'$.product_review_schema.\"@type\"' = 'Product', false))"
    intent = f"""CASE intent WHEN 'commercial' THEN {points((count('paisa_vasool_criteria') + ' >= 2', 7), (count('verification_checklist') + ' >= 2', 6), (given('$.subsidy_eligibility'), 6), (rated, 6))}
      WHEN 'howto' THEN {points((count('prerequisites_and_documents') + ' >= 2 OR ' + headed('documents'), 8), (count('rejection_pitfalls') + ' >= 2 OR ' + headed('mistakes'), 8), (count('step_sequence') + ' >= 2 OR ' + given('$.howto_schema.steps') + ' OR sections >= 3', 9))}
      WHEN 'comparison' THEN {points((given('$.verdict_summary') + ' OR ' + headed('verdict'), 8), (count('comparison_matrix') + ' >= 1 OR ' + headed('comparison'), 9), (count('who_should_buy') + ' >= 1 OR ' + headed('choice'), 8))}
      ELSE {points((count('core_pillars') + ' >= 1 OR sections >= 4', 12), (given('$.regulatory_2026_landscape') + ' OR ' + headed('year') + ' OR faq >= 3', 13))} END"""
    hits = [f"regexp_matches(said, {quoted('(?i)' + p)})" for p, _ in specific]
    found = "list_filter([" + ", ".join(quoted(p) for p in fluff) + "], lambda p: contains(lower(said), p))"
    schema = f"{points(('faq >= 2', 8))} + CASE WHEN intent = 'commercial' AND {given('$.product_review_schema')} THEN 7 WHEN intent = 'howto' AND ({given('$.howto_schema')} OR sections >= 3) THEN 7 WHEN faq >= 3 THEN 7 ELSE 0 END"
    rigor = points(("sections >= 3", 5), (f"len(list_filter(heads, lambda h: lower(trim(h)) IN ({', '.join(quoted(g) for g in generic)}))) = 0", 5), ("regexp_matches(said, '[ऀ-ॿ]')", 5))
    grade = "CASE " + " ".join(f"WHEN overall >= {n} THEN {quoted(t)}" for n, t in grades[:-1]) + f" ELSE {quoted(grades[-1][1])} END"
    return f"""WITH made AS (SELECT p_partkey, {_INTENTS} AS intent, CAST({BLUEPRINT} AS JSON) AS j, p_partkey % 45 AS asked FROM part),
  parts AS (SELECT *, coalesce(j->>'$.outline[*].heading', []) AS heads, coalesce(j->>'$.outline[*].key_points[*]', []) AS points, json_array_length(j, '$.outline') AS sections, json_array_length(j, '$.faq') AS faq,
    len(list_distinct(list_filter(list_transform(coalesce(j->>'$.outline[*].queries_answered[*]', []), lambda q: trim(q)), lambda q: q <> ''))) AS answered FROM made),
  told AS (SELECT *, concat_ws(' ', j->>'$.title', j->>'$.meta_description', j->>'$.h1', array_to_string(heads, ' '), array_to_string(points, ' '), array_to_string(coalesce(j->>'$.faq[*].q', []), ' '), array_to_string(coalesce(j->>'$.faq[*].answer', []), ' ')) AS said FROM parts),
  judged AS (SELECT *, {intent} AS intent_score, CASE WHEN asked = 0 THEN 100 ELSE least(100, round_even(answered / least(asked, 12) * 100, 0)::INT) END AS coverage_pct, {found} AS fluff, {points(*[(h, 5) for h in hits])} AS exact, {schema} AS schema_score, {rigor} AS vernacular_score FROM told),
  scored AS (SELECT *, CASE WHEN asked = 0 THEN 25 ELSE least(25, round_even(coverage_pct / 100 * 25, 0)::INT) END AS grounding_score, CASE WHEN len(fluff) = 0 THEN exact + 5 ELSE greatest(0, exact + 5 - 2 * len(fluff)) END AS specificity_score FROM judged),
  summed AS (SELECT *, least(100, intent_score + grounding_score + specificity_score + schema_score + vernacular_score) AS overall FROM scored)
  SELECT p_partkey, intent_score, grounding_score, specificity_score, schema_score, vernacular_score, overall AS overall_score, {grade} AS grade, coverage_pct, answered AS answered_queries_count, array_to_string(fluff, '|') AS fluff FROM summed"""


def top_json(column: str) -> str:
    """JSON of the ten best of hits12: order by six decimals, then domain; scores to four."""
    return f"""(SELECT '[' || string_agg('{{"domain":"' || domain || '","score":"' || format('{{:.4f}}', s) || '"}}', ',' ORDER BY s DESC, domain) || ']' FROM (SELECT domain, round({column}, 6) AS s FROM hits12 ORDER BY s DESC, domain LIMIT 10))"""
