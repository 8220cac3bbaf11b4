"""DuckDB twins of the registered queries.

For derived pages the SQL selects the expected entities from the base tables and never parses
markup or JSON; for the landed pages it uses its own, simpler regular expressions.
"""

from __future__ import annotations

# Fixed values, written out here so that a wrong one in the library does not pass on both sides: file endings and
# paths that are never followed, social domains, frequent function words.
SKIP_EXTENSIONS = (
    r"(?i)\.(pdf|docx?|xlsx?|zip|rar|7z|jpg|jpeg|png|gif|svg|webp|ico|mp4|mp3|wav|css|js|woff2?|ttf|eot)(\?.*)?$"
)
SKIP_PATHS = r"(?i)/(basket|cart|login|logout|register|personal|compare|favicon|captcha|tel:|mailto:)"
SOCIAL_DOMAINS = {
    "facebook.com": "Facebook", "instagram.com": "Instagram", "twitter.com": "Twitter",
    "x.com": "X", "linkedin.com": "LinkedIn", "youtube.com": "YouTube", "t.me": "Telegram",
    "vk.com": "VK", "tiktok.com": "TikTok", "ok.ru": "OK",
}
STOP_WORDS = {
    "de": ("aber", "als", "auch", "auf", "aus", "bei", "das", "dem", "den", "der", "des", "die", "ein", "eine",
           "einen", "einer", "er", "es", "für", "hat", "ich", "im", "in", "ist", "mit", "nach", "nicht", "sich",
           "sie", "sind", "und", "vom", "von", "war", "was", "wie", "wir", "zu", "zum", "zur"),
    "en": ("a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "has", "have", "he", "her", "his",
           "in", "is", "it", "not", "of", "on", "or", "that", "the", "their", "they", "this", "to", "was", "we",
           "were", "which", "will", "with", "you"),
    "es": ("al", "como", "con", "de", "del", "el", "en", "entre", "es", "esta", "fue", "ha", "la", "las", "lo", "los",
           "más", "no", "o", "para", "pero", "por", "que", "se", "ser", "si", "sin", "sobre", "son", "su", "sus",
           "un", "una", "y"),
    "fr": ("à", "au", "aux", "avec", "ce", "ces", "dans", "de", "des", "du", "elle", "en", "est", "et", "il", "ils",
           "je", "la", "le", "les", "mais", "ne", "nous", "on", "ou", "par", "pas", "plus", "pour", "qui", "que",
           "sa", "se", "ses", "son", "sont", "sur", "un", "une", "vous"),
}

WS = r"[\s\x0b\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def clean(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{WS}+', ' ', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def decode(x: str) -> str:
    for ref, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        x = f"replace({x}, '{ref}', '{char}')"
    return x


def tagless(x: str, sep: str) -> str:
    return f"regexp_replace({x}, '<[^>]*>', '{sep}', 'g')"


def site(u: str) -> str:
    return f"regexp_extract({u}, '^[a-z]+://([^/?#]*)', 1)"


def normal(u: str) -> str:
    cut = f"regexp_replace({u}, '#.*$', '')"
    path = f"regexp_extract({u}, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
    return f"CASE WHEN {path} IN ('', '/') THEN rtrim({cut}, '/') ELSE {cut} END"


DECIMAL = "CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR)"
JUNK = r"<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<![^>]*>"

# --- landed pages -------------------------------------------------------------------------

PAGES = f"""
base AS (SELECT page_id, url, {site('url')} AS site, html,
         regexp_replace(html, '{JUNK}', '', 'gs') AS vis FROM pages),
arts AS (SELECT *, {clean(decode(tagless("regexp_extract(vis, '<article[^>]*>(.*?)</article>', 1, 's')", ' ')))} AS art,
         {clean(decode(tagless("regexp_replace(vis, '<nav>.*?</nav>|<footer>.*?</footer>', ' ', 'gs')", ' ')))} AS rest FROM base),
pg AS (SELECT page_id, url, site, html, vis, CASE WHEN length(art) > 100 THEN art ELSE rest END AS raw_text, length(art) <= 100 AS thin,
       {clean(decode("regexp_extract(vis, '<title>([^<]*)</title>', 1)"))} AS title,
       {clean(decode(tagless("regexp_extract(vis, '<h1>(.*?)</h1>', 1, 's')", '')))} AS h1,
       {clean(decode(tagless('vis', '')))} AS whole FROM arts)"""

# The contact patterns.
EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
PHONE = r"(?:\+?[78][\s\-]?)?(?:\(?\d{3}\)?[\s\-]?)?\d{3}[\s\-]?\d{2}[\s\-]?\d{2}"
DIGITS = "length(regexp_replace({0}, '[^0-9]', '', 'g'))"


def found(pattern: str, x: str) -> str:
    return f"unnest(regexp_extract_all({x}, '{pattern}'))"


CONTACTS = PAGES + f""",
hits AS (SELECT site, url AS page_url, 'email' AS type, lower({found(EMAIL, "regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', '', 'gs')")}) AS value FROM pg
         UNION ALL SELECT site, url, 'phone', {found(PHONE, 'raw_text')} FROM pg),
contacts AS (SELECT DISTINCT site, page_url, type, CASE WHEN type = 'phone' THEN {clean('value')} ELSE value END AS value
             FROM hits WHERE type = 'email' OR {DIGITS.format('value')} BETWEEN 7 AND 12)"""

LINKS = PAGES + f""",
a AS (SELECT site, url, unnest(regexp_extract_all(vis, '<a href="[^"]*">.*?</a>', 0, 's')) AS a,
      generate_subscripts(regexp_extract_all(vis, '<a href="[^"]*">.*?</a>', 0, 's'), 1) AS pos FROM pg),
h AS (SELECT site, url, pos, {decode("regexp_extract(a, 'href=\"([^\"]*)\"', 1)")} AS href,
      {clean(decode(tagless('a', '')))} AS text FROM a),
r AS (SELECT *, {normal("regexp_extract(url, '^[a-z]+://[^/?#]*') || href")} AS to_url FROM h),
links AS (SELECT site, url AS from_url, to_url, arg_min(text, pos) AS text FROM r GROUP BY ALL)"""

HOME = """home AS (SELECT site, url, title, '' AS description, '' AS keywords, h1 FROM pg
  QUALIFY row_number() OVER (PARTITION BY site ORDER BY length(url), url) = 1)"""

# --- shop pages ---------------------------------------------------------------------------

SHOP = f"""
sp AS (SELECT p_partkey AS k, p_size AS s, p_type, p_brand, regexp_extract(p_brand, '[0-9]+')::INT AS b, p_partkey // 200 AS block,
       p_name || ' & ' || p_type AS name, {DECIMAL} AS price FROM part),
shop AS (SELECT *, 'brand' || b || '.example.com' AS site,
         'https://brand' || b || '.example.com/catalog/list?page=' || block AS url,
         'https://brand' || b || '.example.com' AS root FROM sp),
img AS (SELECT *, CASE WHEN k % 2 = 0 THEN root || '/i/' || k || '.jpg' ELSE root || '/i/' || k || '.png' END AS image FROM shop),
template AS (SELECT site, url AS source_url, name, price, CASE WHEN s % 2 = 0 THEN s || '000' ELSE '' END AS old_price,
  CASE WHEN s % 3 <> 0 THEN 'руб.' ELSE '₽' END AS currency, k::VARCHAR AS sku, '' AS brand, '' AS category, '' AS description,
  image AS image_url, root || '/p/' || k AS product_url,
  CASE s % 4 WHEN 0 THEN 'Есть (' || s || ')' WHEN 1 THEN 'по запросу' ELSE '' END AS in_stock, k AS seq, s
  FROM img WHERE b % 2 = 0 QUALIFY row_number() OVER (PARTITION BY url, name ORDER BY k) = 1),
generic AS (SELECT site, url AS source_url, name,
  CASE s % 3 WHEN 0 THEN price || ' USD' WHEN 1 THEN '€ ' || price ELSE price || ' тг.' END AS price,
  CASE s % 3 WHEN 0 THEN s || ' USD' ELSE '' END AS old_price,
  CASE s % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' ELSE '' END AS currency, '' AS sku, '' AS brand, '' AS category, '' AS description,
  CASE s % 3 WHEN 0 THEN image ELSE '' END AS image_url, CASE s % 3 WHEN 0 THEN root || '/p/' || k ELSE '' END AS product_url,
  '' AS in_stock, (CASE s % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 7 END)::BIGINT * 1000000000 + k AS seq, s
  FROM img WHERE b % 2 = 1
  QUALIFY row_number() OVER (PARTITION BY url, name ORDER BY CASE s % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 7 END, k) = 1),
cards AS (SELECT * FROM template UNION ALL SELECT * FROM generic),
unique_cards AS (SELECT * FROM cards QUALIFY row_number() OVER (PARTITION BY site, name ORDER BY source_url, seq) = 1),
shop_pages AS (SELECT DISTINCT site, url, root, b, block FROM shop)"""

API = SHOP + """,
calls AS (SELECT *, site, url AS trigger_url, 'https://api.example.com/v1/' || k AS api_url FROM shop WHERE k % 8 IN (0, 1, 2, 7)),
api_all AS (SELECT site, url AS source_url, name, k AS seq,
  CASE k % 8 WHEN 0 THEN s::VARCHAR WHEN 1 THEN s || ' руб' WHEN 2 THEN price ELSE '' END AS price, '' AS old_price,
  CASE k % 8 WHEN 1 THEN 'RUB' ELSE '' END AS currency, CASE k % 8 WHEN 0 THEN 'A-' || k WHEN 1 THEN k::VARCHAR ELSE '' END AS sku,
  CASE k % 8 WHEN 0 THEN p_brand ELSE '' END AS brand, CASE WHEN k % 8 IN (0, 1) THEN p_type ELSE '' END AS category,
  CASE WHEN k % 80 = 7 THEN repeat('x', 90000) WHEN k % 8 = 7 THEN 'short text' ELSE '' END AS description,
  CASE k % 8 WHEN 1 THEN '/i/' || k ELSE '' END AS image_url, CASE k % 8 WHEN 1 THEN '/p/' || k ELSE '' END AS product_url,
  CASE k % 8 WHEN 0 THEN 'true' ELSE '' END AS in_stock
  FROM calls
  UNION ALL SELECT site, url, p_type, k + 1000000000, '', '', '', '', '', '', '', '', '', '' FROM calls WHERE k % 8 = 1),
api AS (SELECT * FROM api_all QUALIFY row_number() OVER (PARTITION BY source_url, name ORDER BY seq) = 1),
merged AS (SELECT site, source_url, name, 'api' AS origin, price, sku FROM api UNION ALL
  SELECT site, source_url, name, 'card', price, sku FROM cards ANTI JOIN api USING (source_url, name))"""

NEXT = SHOP + """,
nexts AS (SELECT site, url, root || '/catalog/list?page=' || (block + 1) AS next_url, block FROM shop_pages WHERE block % 10 <> 9)"""

SERVICES = """
sv AS (SELECT c_custkey AS k, c_custkey // 20 AS block, c_mktsegment || ' ' || (c_custkey % 5) AS name, c_name FROM customer),
services AS (SELECT 'svc' || (block % 25) || '.example.com' AS site,
  'https://svc' || (block % 25) || '.example.com/s/' || block AS page_url, name,
  CASE k % 4 WHEN 0 THEN trim(repeat(c_name || ' ', 30)) WHEN 1 THEN '' ELSE 'short <' || k || '>' END AS description
  FROM sv WHERE k % 4 <> 3 QUALIFY row_number() OVER (PARTITION BY block, name ORDER BY k) = 1),
unique_services AS (SELECT * FROM services QUALIFY row_number() OVER (PARTITION BY site, name ORDER BY page_url) = 1),
service_pages AS (SELECT DISTINCT 'svc' || (block % 25) || '.example.com' AS site, block FROM sv)"""

COLUMNS = "site, source_url, name, price, old_price, currency, sku, brand, category, description, image_url, product_url, in_stock"

# --- all sites together -----------------------------------------------------------------------

ALL = CONTACTS + ", " + API.lstrip() + ", " + SERVICES.lstrip() + f""",
svc AS (SELECT DISTINCT site, 'https://' || site || '/catalog/s/' || block AS url FROM service_pages),
all_services AS (SELECT site, replace(page_url, '/s/', '/catalog/s/') AS page_url, name, description FROM services),
first_services AS (SELECT * FROM all_services QUALIFY row_number() OVER (PARTITION BY site, name ORDER BY page_url) = 1),
all_products AS (SELECT {COLUMNS} FROM api UNION ALL SELECT {COLUMNS} FROM cards ANTI JOIN api USING (source_url, name)),
first_products AS (SELECT * FROM all_products QUALIFY row_number() OVER (PARTITION BY site, name ORDER BY source_url) = 1),
named AS (SELECT site, url, title, '' AS description, '' AS keywords, h1 FROM pg
  UNION ALL SELECT site, url, 'Goods of brand ' || b || ' - ' || site, 'Goods "' || b || '" block ' || block, '', 'Brand ' || b FROM shop_pages
  UNION ALL SELECT site, url, '', '', '', '' FROM svc),
svc_phones AS (SELECT 'svc' || (block % 25) || '.example.com' AS site, 'https://svc' || (block % 25) || '.example.com/catalog/s/' || block AS page_url,
  'phone' AS type, {found(PHONE, 'c_name')} AS value FROM sv WHERE k % 4 = 0),
all_contacts AS (SELECT * FROM contacts UNION SELECT * FROM svc_phones),
homes AS (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY site ORDER BY length(url), url) = 1),
company AS (SELECT site, unnest(['domain', 'site_title', 'meta_description', 'meta_keywords', 'main_h1']) AS key,
    unnest([site, title, description, keywords, h1]) AS value FROM homes
  UNION ALL SELECT DISTINCT site, type, value FROM all_contacts WHERE type IN ('email', 'phone'))"""

_FIELDS = ("source_url", "name", "price", "old_price", "currency", "sku", "brand", "category", "description", "image_url", "product_url", "in_stock")


def _json(*columns: str, **more: str) -> str:
    pairs = [f"'{c}', {c}" for c in columns] + [f"'{k}', {v}" for k, v in more.items()]
    return f"CAST(json_object({', '.join(pairs)}) AS VARCHAR)"


def _items(shops_only: bool) -> str:
    kept = "WHERE starts_with(site, 'brand')" if shops_only else ""
    return f"""WITH {ALL}, items AS (
      SELECT site, 'company' AS section, {_json('key', 'value')} AS item FROM company
      UNION ALL SELECT site, 'pages', {_json('url', 'title', 'h1', scraped_at='NULL')} FROM named
      UNION ALL SELECT site, 'contacts', {_json('page_url', 'type', 'value')} FROM all_contacts
      UNION ALL SELECT site, 'products', {_json(*_FIELDS)} FROM all_products
      UNION ALL SELECT site, 'services', {_json('page_url', 'name', 'description')} FROM all_services
      UNION ALL SELECT site, 'api_calls', {_json('trigger_url', 'api_url')} FROM calls) SELECT * FROM items {kept}"""


_DOMAINS = ", ".join(f"'{d}'" for d in SOCIAL_DOMAINS)
_NAMES = ", ".join(f"'{n}'" for n in SOCIAL_DOMAINS.values())
ORGS = f"""
org AS (SELECT s_suppkey AS k, s_name, n_name, 'org' || s_suppkey || '.example.org' AS site,
  'https://org' || s_suppkey || '.example.org/about' AS page_url,
  list_extract([{_DOMAINS}], (s_suppkey % 10)::INT + 1) AS dom, list_extract([{_NAMES}], (s_suppkey % 10)::INT + 1) AS net
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
socials AS (SELECT site, page_url, 'social:' || net AS type, 'https://' || dom || '/org' || k AS value FROM org
  UNION ALL SELECT site, page_url, 'social:X', 'https://' || dom || '/org' || k FROM org WHERE net <> 'X' AND contains(dom, 'x.com')),
addresses AS (SELECT site, page_url, 'address' AS type, CASE k % 3 WHEN 0 THEN 'Tag street ' || k || ', town'
  WHEN 1 THEN 'Prop street ' || k ELSE 'Class street ' || k END AS value FROM org),
ld AS (SELECT site, page_url, 'phone' AS type, '+7 (495) 000-' || lpad(k::VARCHAR, 6, '0') AS value FROM org WHERE k % 3 < 2
  UNION ALL SELECT site, page_url, 'phone', '8 800 ' || k FROM org WHERE k % 3 = 1
  UNION ALL SELECT site, page_url, 'email', 'Info@org' || k || '.example.org' FROM org
  UNION ALL SELECT site, page_url, 'address', k || ' Main St, ' || n_name FROM org
  UNION ALL SELECT * FROM socials)"""

JSONLD = f"""
j AS (SELECT p_partkey AS k, p_size, p_brand, p_type, p_name || ' <' || p_partkey || '> & co' AS name, {DECIMAL} AS price,
  'shop' || (p_partkey % 7) || '.example.net' AS site, 'https://shop' || (p_partkey % 7) || '.example.net/item/' || p_partkey AS source_url,
  p_partkey % 6 AS m FROM part)"""

LD_PRODUCTS = """SELECT site, source_url, name, CASE WHEN m IN (1, 2) THEN p_size::VARCHAR ELSE price END AS price,
      '' AS old_price, CASE WHEN m IN (1, 2) THEN 'EUR' ELSE 'USD' END AS currency,
      CASE WHEN m IN (1, 2) THEN k::VARCHAR ELSE 'S-' || k END AS sku, p_brand AS brand, '' AS category,
      trim(p_type || ' ' || repeat('word ', 100)) AS description,
      CASE WHEN m IN (1, 2) THEN '/i/' || k || '.png' ELSE '/i/' || k || '.jpg' END AS image_url, '' AS product_url, '' AS in_stock
      FROM j WHERE m < 4"""

# the given pages and all derived ones; the texts of shop pages are in no report and hold no phones
EVERY = CONTACTS + ", " + API.lstrip() + ", " + SERVICES.lstrip() + ", " + ORGS.lstrip() + ", " + JSONLD.lstrip() + f""",
every_product AS (SELECT {COLUMNS} FROM api UNION ALL SELECT {COLUMNS} FROM cards ANTI JOIN api USING (source_url, name)
  UNION ALL SELECT {COLUMNS} FROM ({LD_PRODUCTS})),
first_products AS (SELECT * FROM every_product QUALIFY row_number() OVER (PARTITION BY site, name ORDER BY source_url) = 1),
boxes AS (SELECT block, k, CASE k % 4 WHEN 0 THEN name || ' ' || repeat(c_name || ' ', 30) || 'second' WHEN 1 THEN name
  WHEN 2 THEN name || ' short <' || k || '>' ELSE 'ab dropped' END AS box FROM sv),
made AS (SELECT p_partkey AS k, p_name || ' ' || repeat(p_type || ' ', 12) || p_partkey ||
  CASE p_partkey % 3 WHEN 0 THEN ' aside really' WHEN 1 THEN ' kept' ELSE '' END AS words FROM part),
derived AS (SELECT 'svc' || (block % 25) || '.example.com' AS site, 'https://svc' || (block % 25) || '.example.com/s/' || block AS url, '' AS title,
    {clean("string_agg(box, ' ' ORDER BY k, box)")} AS raw_text FROM boxes GROUP BY block
  UNION ALL SELECT site, page_url, 'About', 'About ' || value || ' follow us again' FROM addresses
  UNION ALL SELECT site, source_url, '', 'item' FROM j
  UNION ALL SELECT 'made' || (k % 5) || '.example.net', 'https://made' || (k % 5) || '.example.net/d/' || k, '',
    {clean("""CASE WHEN k % 2 = 0 AND length(words) > 100 THEN words ELSE list_extract(['Shop home', 'one two x', 'deep a / b', 'brand'], (k % 4)::INT + 1)
      || ' ' || words || ' nested more end' END""")} FROM made),
found_phones AS (SELECT site, url AS page_url, {found(PHONE, 'raw_text')} AS value FROM derived),
every_contact AS (SELECT * FROM contacts
  UNION SELECT site, page_url, 'phone', {clean('value')} FROM found_phones WHERE {DIGITS.format('value')} BETWEEN 7 AND 12
  UNION SELECT * FROM ld UNION SELECT * FROM addresses),
named AS (SELECT site, url, title, '' AS description, h1, raw_text FROM pg
  UNION ALL SELECT site, url, 'Goods of brand ' || b || ' - ' || site, 'Goods "' || b || '" block ' || block, 'Brand ' || b, '' FROM shop_pages
  UNION ALL SELECT site, url, title, '', '', raw_text FROM derived),
orgs AS (SELECT site, max(s_name || ' Ltd') AS org_name, max(trim(repeat(s_name || ' ', 60))) AS org_description FROM org GROUP BY site),
homes AS (SELECT * FROM named LEFT JOIN orgs USING (site) QUALIFY row_number() OVER (PARTITION BY site ORDER BY length(url), url) = 1)"""

VISITS = "SELECT o_custkey, o_orderkey, o_orderstatus, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders"

SITEMAPS = """
c AS (SELECT c_custkey AS k, c_custkey // 100 AS block, 'svc' || c_nationkey || '.example.com' AS site FROM customer),
f AS (SELECT DISTINCT site, block, '/sitemap-' || block || '.xml' AS path FROM c)"""


def _profile_rows() -> str:
    def listing(key: str, kind: str) -> str:
        return f"SELECT DISTINCT site, '{key}', value FROM contacts WHERE type = '{kind}'"

    plain = {"domain": "site", "site_title": "title", "meta_description": "''", "meta_keywords": "''", "main_h1": "h1"}
    rows = [f"SELECT site, '{k}' AS key, {c} AS value FROM home" for k, c in plain.items()]
    rows += [listing("email", "email"), listing("phone", "phone")]
    return f"SELECT site, key, value FROM ({' UNION ALL '.join(rows)})"


def _chain() -> str:
    return f"""WITH RECURSIVE {NEXT.lstrip()},
      nodes AS (SELECT url FROM nexts UNION SELECT next_url FROM nexts),
      walk AS (SELECT url, url AS chain, 0 AS position FROM nodes WHERE url NOT IN (SELECT next_url FROM nexts)
        UNION ALL SELECT n.next_url, w.chain, w.position + 1 FROM walk w JOIN nexts n ON w.url = n.url)
      SELECT url, chain, position FROM walk"""


def _bfs() -> str:
    # a listing page links its products, the site root and, but for the last of ten, the next page
    return f"""WITH RECURSIVE {NEXT.lstrip()},
      edges AS (SELECT url AS from_url, root || '/p/' || k AS to_url FROM shop WHERE b % 2 = 0 OR s % 3 = 0
        UNION SELECT url, root FROM shop_pages UNION SELECT url, next_url FROM nexts),
      walk AS (SELECT url, 0 AS depth FROM shop_pages WHERE block = 0
        UNION SELECT e.to_url, w.depth + 1 FROM walk w JOIN edges e ON w.url = e.from_url)
      SELECT {site('url')} AS site, url, min(depth) AS depth FROM walk GROUP BY url"""


def _language() -> str:
    scores = ", ".join(
        f"{{'n': len(list_filter(w, lambda x: x IN ({', '.join(repr(x) for x in words)}))), 'i': {-i}, 'lang': '{lang}'}}"
        for i, (lang, words) in enumerate(sorted(STOP_WORDS.items())))
    return f"""WITH t AS (SELECT doc_id, length({strip('text')}) AS n,
        string_split_regex(lower({strip('text')}), '[^\\p{{L}}]+') AS w FROM documents),
      s AS (SELECT doc_id, n, list_max([{scores}]) AS best FROM t),
      d AS (SELECT doc_id, CASE WHEN n >= 20 AND best.n > 0 THEN best.lang ELSE '' END AS detected FROM s)
      SELECT doc_id, detected, detected = 'en' AS translatable FROM d"""


def _markdown() -> str:
    return f"""WITH {EVERY},
      info AS (SELECT *, CASE WHEN title <> '' THEN title WHEN h1 <> '' THEN h1 ELSE url END AS heading FROM named
        WHERE length(raw_text) > 300 AND NOT regexp_matches(url, '(?i)/(catalog|basket|compare|personal|login|favicon|\\?sort=)')),
      words AS (SELECT url, unnest(string_split(raw_text, ' ')) AS w, generate_subscripts(string_split(raw_text, ' '), 1) AS i FROM info),
      runs AS (SELECT *, i - row_number() OVER (PARTITION BY url, w ORDER BY i) AS run, i = max(i) OVER (PARTITION BY url) AS last FROM words),
      kept AS (SELECT * FROM runs QUALIFY last OR NOT regexp_full_match(w, '[\\p{{L}}\\p{{N}}_]{{4,}}')
        OR count(*) FILTER (NOT last) OVER (PARTITION BY url, w, run) < 3),
      shown AS (SELECT url, string_agg(w, ' ' ORDER BY i) AS text FROM kept GROUP BY url),
      vals AS (SELECT DISTINCT site, CASE type WHEN 'email' THEN 1 WHEN 'phone' THEN 2 ELSE 3 END AS section, value FROM every_contact
          WHERE type IN ('email', 'phone', 'address')
        UNION ALL SELECT site, 4, substring(type, 8) || ': ' || min(value) FROM every_contact WHERE starts_with(type, 'social:') GROUP BY site, type),
      kinds AS (SELECT DISTINCT site, section FROM vals),
      l AS (
        SELECT site, 0 AS section, 0 AS ord_no, '' AS ord_text, 0 AS sub, '# ' || coalesce(nullif(title, ''), nullif(org_name, ''), site) || chr(10) AS line FROM homes
        UNION ALL SELECT site, 0, 0, '', 1, '## Общая информация' || chr(10) FROM homes
        UNION ALL SELECT site, 0, 0, '', 2, description || chr(10) FROM homes WHERE description <> ''
        UNION ALL SELECT site, 0, 0, '', 3, chr(10) || org_description || chr(10) FROM homes WHERE org_description <> ''
        UNION ALL SELECT site, 0, 0, '', 4, chr(10) || '**Организация:** ' || org_name || chr(10) FROM homes WHERE org_name <> ''
        UNION ALL SELECT site, 0, 0, '', 5, chr(10) || '## Контакты' || chr(10) FROM homes
        UNION ALL SELECT site, 5, -1, '', 0, chr(10) || '## Товары (' || count(*) || ')' || chr(10) FROM first_products GROUP BY site
        UNION ALL SELECT DISTINCT site, 5, -1, '', 1, '| Название | Цена | Старая цена | Артикул |' FROM first_products
        UNION ALL SELECT DISTINCT site, 5, -1, '', 2, '|---|---|---|---|' FROM first_products
        UNION ALL SELECT site, 5, 0, name, 0, '| ' || name || ' | ' || CASE WHEN price = '' THEN '' ELSE trim(price || ' ' || currency) END || ' | ' ||
          CASE WHEN old_price = '' THEN '' ELSE trim(old_price || ' ' || currency) END || ' | ' || sku || ' |' FROM first_products
        UNION ALL SELECT site, 6, -1, '', 0, chr(10) || '## Услуги (' || count(*) || ')' || chr(10) FROM unique_services GROUP BY site
        UNION ALL SELECT site, 6, 0, name, 0, '### ' || name || chr(10) FROM unique_services
        UNION ALL SELECT site, 6, 0, name, 1, description || chr(10) FROM unique_services WHERE description <> ''
        UNION ALL SELECT site, section, -1, '', 0, list_extract(['**Email:**', chr(10) || '**Телефоны:**', chr(10) || '**Адреса:**',
          chr(10) || '**Соцсети:**'], section) FROM kinds
        UNION ALL SELECT site, section, 0, value, 0, '- ' || value FROM vals
        UNION ALL SELECT DISTINCT site, 7, -1, '', 0, chr(10) || '## Содержимое страниц' || chr(10) FROM info
        UNION ALL SELECT site, 7, length(url), url, 0, chr(10) || '### ' || heading || chr(10) FROM info
        UNION ALL SELECT site, 7, length(url), url, 1, '**URL:** ' || url || chr(10) FROM info
        UNION ALL SELECT site, 7, length(url), url, 2, text FROM info JOIN shown USING (url)
        UNION ALL SELECT site, 7, length(url), url, 3, '' FROM info)
      SELECT * FROM l"""


def _sitemap_urls() -> str:
    return """SELECT site, block, CASE k % 5 WHEN 1 THEN 'https://' || site || '/c/' || k WHEN 2 THEN 'https://' || site || '/c/' || k || '?a=1&b=2'
        WHEN 3 THEN 'https://' || site || '/c/' || k ELSE 'https://' || site END AS url FROM c WHERE k % 5 <> 0 AND block % 4 IN (0, 1)"""


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}

    # A
    q["scan_pages"] = f"SELECT page_id, {site('url')} AS site, url, length(html) AS n_chars FROM pages"
    q["sitemap_urls"] = f"""WITH {SITEMAPS}, u AS ({_sitemap_urls()})
      SELECT site, url, min('/sitemap-' || block || '.xml') AS path FROM u GROUP BY site, url"""
    q["sitemap_children"] = f"""WITH {SITEMAPS} SELECT site, path, 'https://' || site || '/deep/' || block || '.xml' AS child
      FROM f WHERE block % 4 = 2"""
    q["robots_sitemaps"] = """WITH h AS (SELECT 'org' || s_suppkey || '.example.org' AS site FROM supplier)
      SELECT site, 'https://' || site || '/sitemap.xml' AS sitemap FROM h UNION ALL SELECT site, 'http://' || site || ':8080/two.xml' FROM h"""
    body = """CASE k % 8 WHEN 0 THEN '{"name":"' || name || '","price":' || s || ',"sku":"A-' || k || '","brand":"' || p_brand || '","category":"' || p_type || '","in_stock":true}'
      WHEN 1 THEN '{"items":[{"name":" ","title":"' || name || '","cost":"' || s || ' руб","sku":"","article":' || k || ',"category":{"name":"' || p_type || '"},"img":"/i/' || k || '","link":"/p/' || k || '"}]}'
      WHEN 2 THEN repeat('{"a":', (k % 11)::INT) || '{"наименование":"' || name || '","цена":"' || price || '"}' || repeat('}', (k % 11)::INT)
      ELSE '{"label":"' || name || '","about":"' || CASE WHEN k % 80 = 7 THEN repeat('x', 90000) ELSE 'short text' END || '"}' END"""
    q["api_responses"] = f"WITH {API} SELECT site, trigger_url, api_url, {body} AS body, 1704067200 + k AS scraped_at FROM calls"
    q["products_per_response"] = f"""WITH {API}, n AS (SELECT source_url, count(*) AS n FROM api_all GROUP BY ALL)
      SELECT trigger_url, coalesce(max(n), 0) AS products FROM calls LEFT JOIN n ON source_url = trigger_url GROUP BY ALL"""
    q["ignored_nodes"] = f"WITH {JSONLD} SELECT site, count(*) FILTER (m = 5) AS list_types, 0 AS text_addresses FROM j WHERE m <> 4 OR m = 4 GROUP BY site"
    q["write_tables"] = f"""WITH {LINKS} SELECT site, 'page' AS kind, url, title AS value FROM pg
      UNION ALL SELECT site, 'link', from_url, to_url || ' ' || text FROM links"""
    q["site_partition_replace"] = f"""WITH {PAGES} SELECT site, count(*) AS pages,
      count(*) FILTER (ends_with(site, '.org')) AS reloaded FROM pg GROUP BY site"""
    q["json_report"] = _items(shops_only=True)
    q["markdown_report"] = _markdown()
    q["markdown_products"] = f"""WITH {SHOP}, n AS (SELECT site, count(*) AS n FROM unique_cards GROUP BY site)
      SELECT site, -1 AS ord_no, '' AS ord_text, 0 AS sub, chr(10) || '## Товары (' || n || ')' || chr(10) AS line FROM n
      UNION ALL SELECT site, -1, '', 1, '| Название | Цена | Старая цена | Артикул |' FROM n
      UNION ALL SELECT site, -1, '', 2, '|---|---|---|---|' FROM n
      UNION ALL SELECT site, 0, name, 0, '| ' || name || ' | ' || trim(price || ' ' || currency) || ' | ' ||
        CASE WHEN old_price = '' THEN '' ELSE trim(old_price || ' ' || currency) END || ' | ' || sku || ' |' FROM unique_cards"""
    q["read_report"] = _items(shops_only=False)

    # B
    q["clean_text"] = f"SELECT doc_id, {clean('text')} AS text FROM documents"
    q["normalize_url"] = f"SELECT page_id, {normal('url')} AS url FROM pages"
    q["resolve_url"] = f"""WITH {PAGES},
      a AS (SELECT page_id, url, regexp_extract_all(vis, '<a href="([^"]*)">', 1) AS h FROM pg),
      u AS (SELECT page_id, url, unnest(h) AS href, generate_subscripts(h, 1) - 1 AS pos FROM a),
      p AS (SELECT page_id, url, len(h) AS n, regexp_extract(url, '^[a-z]+://[^/?#]*') AS root,
            regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM a)
      SELECT page_id, pos, {decode('href')} AS href, regexp_extract(url, '^[a-z]+://[^/?#]*') || {decode('href')} AS resolved FROM u
      UNION ALL SELECT page_id, n, '../x/./y?z=1', root || regexp_replace(regexp_replace(path, '[^/]*$', ''), '[^/]+/$', '') || 'x/y?z=1' FROM p
      UNION ALL SELECT page_id, n + 1, '?only=query', root || path || '?only=query' FROM p"""
    q["site_of"] = f"SELECT page_id, {site('url')} AS site, {site('url')} = 'thther.example.org' AS same FROM pages"
    tails = "['', '/cartoon', '/a.PDF', '/a.pdf?x=1', '/a.pdfx', '/login/', '/style.css', '/tel:1']"
    skip = f"NOT regexp_matches(t, '{SKIP_EXTENSIONS}') AND NOT regexp_matches(t, '{SKIP_PATHS}')"
    q["is_followable"] = f"""WITH u AS (SELECT page_id, {site('url')} AS site, {normal('url')} AS u, {tails} AS tails FROM pages),
      t AS (SELECT page_id, site, unnest(generate_series(0, 7))::INT AS k, u || unnest(tails) AS t FROM u)
      SELECT page_id, k, {site('t')} = site AND {skip} AS own, {site('t')} = 'thther.example.org' AND {skip} AS other FROM t"""
    q["extract_emails"] = f"SELECT DISTINCT doc_id, lower({found(EMAIL, 'text')}) AS email FROM documents"
    phones = f"""WITH h AS (SELECT doc_id, {found(PHONE, 'text')} AS p FROM documents),
      ph AS (SELECT DISTINCT doc_id, {clean('p')} AS phone FROM h WHERE {DIGITS.format('p')} BETWEEN 7 AND 12)"""
    q["extract_phones"] = f"{phones} SELECT doc_id, phone FROM ph"
    q["plausible_phone"] = f"""{phones} SELECT doc_id, phone,
      NOT regexp_matches(phone, '2016|2017|2026|322774') AS plausible FROM ph"""
    q["price_and_currency"] = f"""WITH p AS (SELECT p_partkey, p_partkey % 10 AS m, {DECIMAL} AS d FROM part)
      SELECT p_partkey, CASE m WHEN 0 THEN d || ' ₽' WHEN 1 THEN '$' || d WHEN 2 THEN d || ' РУБ.' WHEN 3 THEN '€ ' || d WHEN 4 THEN d || 'usd'
        WHEN 5 THEN '£' || d WHEN 6 THEN d || ' грн.' WHEN 7 THEN d || ' KZT' WHEN 8 THEN '¥ ' || d ELSE '' END AS price,
        list_extract(['RUB', 'USD', 'RUB', 'EUR', 'USD', 'GBP', '', '', '', ''], m::INT + 1) AS currency FROM p"""
    q["price_number"] = """WITH p AS (SELECT p_partkey, CAST(p_retailprice * 1000 + p_partkey / 100 AS DECIMAL(18,2)) AS n FROM part)
      SELECT p_partkey, spelling, CASE spelling WHEN 'whole' THEN CAST(trunc(n) AS DECIMAL(18,2)) ELSE n END AS price_num
      FROM p, (SELECT unnest(['english', 'german', 'blanks', 'swiss', 'whole']) AS spelling)"""
    social = [f"SELECT s_suppkey, 'social:{n}' AS type, 'https://{d}/' || s_suppkey AS value FROM supplier" for d, n in SOCIAL_DOMAINS.items()]
    social += ["SELECT s_suppkey, 'social:X', 'https://netflix.com/' || s_suppkey FROM supplier"]
    q["classify_social"] = " UNION ALL ".join(social)
    q["needs_render"] = f"""WITH {PAGES} SELECT site, url, length(whole) < 200 OR
      regexp_matches(html, '(ng-app|data-reactroot|__NEXT_DATA__|__vue|ReactDOM\\.render)') AS needs_render FROM pg"""
    q["clean_page_text"] = """WITH w AS (SELECT doc_id, 'Текст ' || array_to_string(string_split(
        trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')), ' '), '. ') || '.' AS core FROM documents)
      SELECT doc_id, core || CASE WHEN doc_id % 5 = 4 THEN ' конец.' ELSE '' END AS text FROM w"""
    q["strip_site_suffix"] = f"""WITH {PAGES} SELECT url, title AS stripped,
      CASE WHEN length(url) % 7 <> 0 AND title <> '' THEN title WHEN h1 <> '' THEN h1 ELSE url END AS heading FROM pg"""
    q["chunk_text"] = """WITH s AS (SELECT doc_id, text, unnest(generate_series(0, length(text) - 1, 4500)) AS start FROM documents)
      SELECT doc_id, start, substring(text, start + 1, 4500) AS chunk, start < 27000 AS "within" FROM s"""
    q["truncate_with_rest"] = """SELECT doc_id, left(text, 2000) AS head, greatest(length(text) - 2000, 0) AS rest FROM documents"""
    q["decode_entities"] = f"SELECT page_id, {decode('html')} AS decoded FROM pages"

    # C
    q["html_tokens"] = r"""WITH t AS (SELECT url, regexp_extract_all(html, '<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<[^>]*>|[^<]+', 0, 's') AS toks FROM pages),
      u AS (SELECT url, unnest(toks) AS tok, generate_subscripts(toks, 1) - 1 AS pos FROM t),
      n AS (SELECT url, pos, tok, lower(regexp_extract(tok, '^</?([a-zA-Z][^\s/>]*)', 1)) AS tag FROM u)
      SELECT url, pos, CASE WHEN tok[1] <> '<' THEN 'text' WHEN starts_with(tok, '<!--') THEN 'comment' WHEN tag IN ('script', 'style') THEN 'raw'
        WHEN starts_with(tok, '</') THEN 'close' WHEN tag IN ('br', 'meta') THEN 'void' WHEN tag <> '' THEN 'open' ELSE 'decl' END AS kind, tag, tok FROM n"""
    q["repeated_pages"] = f"""WITH {SHOP} SELECT 'page' AS kind, url, 'New Goods of brand ' || b || ' - ' || site AS value FROM shop_pages
      UNION ALL SELECT 'product', source_url, name FROM cards"""
    q["html_elements"] = r"""WITH t AS (SELECT url, regexp_extract_all(html, '<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<[^>]*>|[^<]+', 0, 's') AS toks FROM pages),
      u AS (SELECT url, unnest(toks) AS tok, generate_subscripts(toks, 1) - 1 AS pos FROM t),
      k AS (SELECT url, pos, lower(regexp_extract(tok, '^</?([a-zA-Z][^\s/>]*)', 1)) AS tag, starts_with(tok, '</') AS closing
        FROM u WHERE regexp_matches(tok, '^</?[a-zA-Z]') AND NOT regexp_matches(tok, '^<(script|style)')),
      e AS (SELECT *, tag IN ('area', 'base', 'br', 'col', 'embed', 'hr', 'img', 'input', 'link', 'meta', 'param', 'source', 'track', 'wbr') AS void FROM k),
      g AS (SELECT *, sum(CASE WHEN void THEN 0 WHEN closing THEN -1 ELSE 1 END) OVER (PARTITION BY url, tag ORDER BY pos) + closing::INT AS lvl,
        lead(pos) OVER (PARTITION BY url, tag ORDER BY pos) AS next_same, max(pos) OVER (PARTITION BY url) + 1 AS past FROM e),
      m AS (SELECT *, CASE WHEN NOT closing AND NOT void AND lead(closing) OVER w THEN lead(pos) OVER w END AS close_pos
        FROM g WINDOW w AS (PARTITION BY url, tag, lvl ORDER BY pos)),
      o AS (SELECT * FROM m WHERE NOT closing),
      a AS (SELECT x.url, x.pos, min(y.close_pos) AS around FROM o x JOIN o y ON x.url = y.url AND y.pos < x.pos AND y.close_pos > x.pos
        WHERE x.close_pos IS NULL AND NOT x.void GROUP BY ALL),
      f AS (SELECT o.*, CASE WHEN void THEN o.pos WHEN close_pos IS NOT NULL THEN close_pos
        ELSE least(CASE WHEN tag IN ('p', 'li', 'dt', 'dd', 'option', 'tr', 'td', 'th') THEN next_same - 1 END, around - 1, past) END AS stop
        FROM o LEFT JOIN a USING (url, pos))
      SELECT url, tag, count(*) AS n, count(close_pos) AS n_closed, sum(stop)::BIGINT AS ends FROM f GROUP BY ALL"""
    q["select_elements"] = f"""WITH {SHOP} SELECT url, '/p/' || k AS href FROM shop WHERE b % 2 = 0"""
    q["subtree_text"] = f"""WITH {SHOP} SELECT url, name AS text FROM shop WHERE b % 2 = 0"""
    q["drop_subtrees"] = f"""WITH {PAGES}, t AS (SELECT url, unnest(regexp_extract_all(
        regexp_replace(vis, '<nav>.*?</nav>|<footer>.*?</footer>', '<x>', 'gs'), '(?:^|>)([^<]+)', 1)) AS t FROM pg)
      SELECT url, count(*) AS n, sum(length(t)) AS n_chars FROM t GROUP BY url"""
    q["main_content"] = f"WITH {PAGES} SELECT url, raw_text FROM pg"
    q["head_fields"] = f"""WITH {PAGES}, {SHOP} SELECT site, url, title, '' AS description, '' AS keywords, h1 FROM pg
      UNION ALL SELECT site, url, 'Goods of brand ' || b || ' - ' || site, 'Goods "' || b || '" block ' || block, '', 'Brand ' || b FROM shop_pages"""
    q["class_frequency"] = f"""WITH {SHOP}, cls AS (
        SELECT site, 'catalog-block-view__item' AS class FROM shop WHERE b % 2 = 0
        UNION ALL SELECT site, unnest(['price', CASE WHEN s % 2 = 0 THEN 'discount' END, CASE WHEN s % 2 = 0 THEN 'price' END,
          CASE s % 3 WHEN 0 THEN 'item-title' WHEN 2 THEN 'block_name' END, CASE s % 4 WHEN 0 THEN 'item-stock' WHEN 1 THEN 'sa_block' END])
          FROM shop WHERE b % 2 = 0
        UNION ALL SELECT site, unnest(CASE s % 3 WHEN 0 THEN ['product-card'] WHEN 1 THEN ['goods-item', 'x'] ELSE [] END) FROM shop WHERE b % 2 = 1
        UNION ALL SELECT site, CASE b % 4 WHEN 1 THEN 'pagination' WHEN 2 THEN 'my-paginator' END FROM shop_pages WHERE block % 10 <> 9),
      n AS (SELECT site, class, count(*) AS n FROM cls WHERE class IS NOT NULL GROUP BY ALL)
      SELECT site, class, n FROM n WHERE TRUE QUALIFY row_number() OVER (PARTITION BY site ORDER BY n DESC, class) <= 40 AND n > 2"""
    q["class_frequency_all_tags"] = """WITH c AS (SELECT 'svc' || (c_custkey // 20 % 25) || '.example.com' AS site,
        unnest(CASE c_custkey % 4 WHEN 0 THEN ['our-services'] WHEN 1 THEN ['ADVANTAGES'] WHEN 2 THEN ['блок', 'Услуги'] ELSE ['service'] END) AS class FROM customer)
      SELECT site, class, count(*) AS n FROM c GROUP BY ALL HAVING count(*) > 3"""
    q["price_like_nodes"] = f"""WITH {SHOP}
      SELECT url, 'span' AS tag, 'price_currency' AS classes, 'руб.' AS text FROM shop WHERE b % 2 = 0 AND s % 3 <> 0"""
    q["selector_samples"] = f"""WITH {SHOP} SELECT site, 'name' AS selector, row_number() OVER (PARTITION BY site ORDER BY url, k) AS rank, url,
      CASE WHEN s % 3 = 2 THEN 'b' ELSE 'a' END AS tag, CASE WHEN s % 3 = 2 THEN 'name' ELSE 'dark_link' END AS classes, name AS text
      FROM shop WHERE b % 2 = 0 QUALIFY rank <= 5"""
    words = "trim(p_name || ' ' || repeat(p_type || ' ', 12) || p_partkey || CASE WHEN p_partkey % 3 = 1 THEN ' kept' ELSE '' END)"
    q["main_content_stripped"] = f"""SELECT 'https://made' || p_partkey % 5 || '.example.net/d/' || p_partkey AS url, {words} AS raw_text FROM part"""
    q["card_structure"] = f"""WITH {SHOP}, f AS (SELECT * FROM shop WHERE b % 2 = 0 QUALIFY row_number() OVER (PARTITION BY url ORDER BY k) = 1),
      cur AS (SELECT *, CASE WHEN s % 3 <> 0 THEN ' руб. ' ELSE '' END AS c FROM f)
      SELECT url, 'span' AS tag, 'price_value' AS classes, price AS text FROM f
      UNION ALL SELECT url, 'span', 'price_currency', 'руб.' FROM f WHERE s % 3 <> 0
      UNION ALL SELECT url, 'div', 'price', trim(' ' || price || ' ' || c) FROM cur
      UNION ALL SELECT url, 'div', 'price discount', s || ' 000' FROM f WHERE s % 2 = 0
      UNION ALL SELECT url, 'span', 'price_value', s || ' 000' FROM f WHERE s % 2 = 0
      UNION ALL SELECT url, 'div', 'item-title', name FROM f WHERE s % 3 = 0
      UNION ALL SELECT url, 'a', 'dark_link', name FROM f WHERE s % 3 < 2
      UNION ALL SELECT url, 'div', 'block_name', name FROM f WHERE s % 3 = 2
      UNION ALL SELECT url, 'b', 'name', name FROM f WHERE s % 3 = 2
      UNION ALL SELECT url, 'div', 'item-stock', 'Есть (' || s || ')' FROM f WHERE s % 4 = 0
      UNION ALL SELECT url, 'span', 'value', 'Есть (' || s || ')' FROM f WHERE s % 4 = 0
      UNION ALL SELECT url, 'div', 'sa_block', 'по запросу' FROM f WHERE s % 4 = 1
      UNION ALL SELECT url, 'span', 'value', 'other' FROM f WHERE s % 4 = 3"""

    # D
    q["build_pages"] = f"WITH {PAGES} SELECT site, url, title, '' AS description, '' AS keywords, h1, left(raw_text, 30000) AS raw_text FROM pg"
    q["page_contacts"] = f"WITH {CONTACTS} SELECT * FROM contacts"
    q["page_addresses"] = f"WITH {ORGS} SELECT * FROM addresses"
    q["page_socials"] = f"WITH {ORGS} SELECT * FROM socials"
    q["page_links"] = f"WITH {LINKS} SELECT * FROM links"
    follow = f"{site('to_url')} = site AND NOT regexp_matches(to_url, '{SKIP_EXTENSIONS}') AND NOT regexp_matches(to_url, '{SKIP_PATHS}')"
    q["followable_links"] = f"WITH {LINKS} SELECT site, from_url, to_url FROM links WHERE {follow}"
    q["page_services"] = f"WITH {SERVICES} SELECT * FROM services"
    q["template_cards"] = f"WITH {SHOP} SELECT {COLUMNS} FROM template"
    q["generic_cards"] = f"WITH {SHOP} SELECT {COLUMNS} FROM generic"
    q["jsonld_blocks"] = f"WITH {JSONLD} SELECT site, count(*) AS blocks FROM j GROUP BY site"
    q["json_nodes"] = f"""WITH {JSONLD}, n AS (
        SELECT unnest(CASE m WHEN 0 THEN ['0:Product', '1:', '1:'] WHEN 1 THEN ['1:Product', '2:', '3:']
          WHEN 2 THEN ['0:', '2:WebPage', '3:Product', '4:', '5:'] WHEN 3 THEN ['0:IndividualProduct', '1:', '1:']
          WHEN 4 THEN ['0:Product'] ELSE ['0:', '1:', '1:'] END) AS x FROM j)
      SELECT split_part(x, ':', 1)::INT AS depth, split_part(x, ':', 2) AS type, count(*) AS n FROM n GROUP BY ALL"""
    q["jsonld_products"] = f"WITH {JSONLD} {LD_PRODUCTS}"
    q["jsonld_org"] = f"""WITH {ORGS} SELECT site, 'org_name' AS key, s_name || ' Ltd' AS value FROM org
      UNION ALL SELECT site, 'org_description', trim(repeat(s_name || ' ', 60)) FROM org"""
    q["jsonld_contacts"] = f"WITH {ORGS} SELECT * FROM ld"
    q["api_products"] = f"WITH {API} SELECT {COLUMNS} FROM api_all"
    q["next_page"] = f"WITH {NEXT} SELECT site, url, next_url FROM nexts"

    # E
    q["first_wins"] = f"WITH v AS ({VISITS}) SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1"
    q["last_wins"] = f"WITH v AS ({VISITS}) SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"
    q["merge_products"] = f"WITH {API} SELECT * FROM merged"
    q["distinct_texts"] = f"""WITH {PAGES}, {SHOP}, {SERVICES}, {ORGS}
      SELECT title AS text FROM pg WHERE title <> '' UNION SELECT h1 FROM pg WHERE h1 <> '' UNION SELECT raw_text FROM pg WHERE raw_text <> ''
      UNION SELECT name FROM cards UNION SELECT name FROM services
      UNION SELECT description FROM services WHERE description <> '' UNION SELECT s_name || ' Ltd' FROM org
      UNION SELECT trim(repeat(s_name || ' ', 60)) FROM org"""
    q["translate_tables"] = f"""WITH {SHOP}, {ORGS}, t AS (SELECT *, '~' || regexp_extract(name, '& (.*)$', 1) AS dst FROM cards),
      p AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY source_url, dst ORDER BY name) = 1)
      SELECT 'product' AS kind, source_url AS owner, dst AS name, price AS value FROM p
      UNION ALL SELECT 'company', site, 'org_name', '~' || s_name || ' Ltd' FROM org
      UNION ALL SELECT 'company', site, 'org_description', trim(repeat(s_name || ' ', 60)) FROM org"""
    q["detect_language"] = _language()
    q["apply_dictionary"] = """WITH en AS (SELECT DISTINCT text FROM documents WHERE lang = 'en')
      SELECT doc_id, CASE WHEN text IN (SELECT text FROM en) THEN '~' || md5(text) ELSE text END AS text, source AS label FROM documents"""
    q["home_page"] = f"WITH {PAGES}, {HOME} SELECT * FROM home"
    q["site_profile"] = f"WITH {CONTACTS}, {HOME} {_profile_rows()}"
    q["social_links"] = f"WITH {ORGS} SELECT site, substring(type, 8) AS network, min(value) AS value FROM socials GROUP BY ALL"
    q["report_counts"] = f"""WITH {API}, n AS (SELECT site, 'pages' AS w, url AS x FROM shop_pages UNION ALL
        SELECT DISTINCT site, 'products', name FROM merged UNION ALL SELECT site, 'api', api_url FROM calls)
      SELECT site, count(*) FILTER (w = 'pages') AS pages, count(*) FILTER (w = 'products') AS products, 0 AS services,
        count(*) FILTER (w = 'api') AS api_responses FROM n GROUP BY site"""
    q["approximate_report_counts"] = q["report_counts"]
    q["distinct_addresses"] = f"""WITH {ORGS} SELECT site, value FROM addresses UNION SELECT site, value FROM ld WHERE type = 'address'"""
    q["product_listing"] = f"""WITH {SHOP} SELECT site, name, '  • ' || name || '  | ' || rtrim(price || ' ' || currency) ||
        CASE WHEN old_price <> '' AND old_price <> price THEN '  (было ' || old_price || ')' ELSE '' END AS line, product_url
      FROM unique_cards"""
    q["service_listing"] = f"""WITH {SERVICES} SELECT site, name, left(description, 110) AS description,
      greatest(length(description) - 110, 0) AS more FROM unique_services"""
    info = "length(raw_text) > 300 AND NOT regexp_matches(url, '(?i)/(catalog|basket|compare|personal|login|favicon|{0})')"
    q["info_pages"] = f"""WITH {PAGES} SELECT 'console' AS mode, site, url, length(url) AS url_length FROM pg WHERE {info.format(chr(92) + '?')}
      UNION ALL SELECT 'markdown', site, url, length(url) FROM pg WHERE {info.format(chr(92) + '?sort=')}"""
    q["page_preview"] = f"""WITH {PAGES} SELECT site, url, coalesce(nullif(title, ''), nullif(h1, ''), url) AS heading,
      left(raw_text, 2000) AS head, greatest(length(raw_text) - 2000, 0) AS rest FROM pg WHERE {info.format(chr(92) + '?')}"""
    q["contacts_by_type"] = f"""{phones} SELECT DISTINCT source AS site, 'phone' AS type, phone AS value FROM ph JOIN documents USING (doc_id)
      UNION SELECT source, 'email', lower({found(EMAIL, 'text')}) FROM documents"""
    q["top_products"] = f"""WITH {ALL} SELECT site, row_number() OVER (PARTITION BY site ORDER BY source_url, name) AS rank, name, price,
      left(description, 110) AS description, greatest(length(description) - 110, 0) AS more FROM first_products QUALIFY rank <= 60"""
    q["top_services"] = f"""WITH {ALL} SELECT site, row_number() OVER (PARTITION BY site ORDER BY page_url, name) AS rank, name,
      left(description, 110) AS description, greatest(length(description) - 110, 0) AS more FROM first_services QUALIFY rank <= 40"""
    q["report_totals"] = f"""WITH {ALL}, n AS (SELECT site, count(*) AS pages FROM named GROUP BY site), c AS (SELECT site, count(*) AS contacts FROM all_contacts GROUP BY site)
      SELECT site, pages, coalesce(contacts, 0) AS contacts FROM n LEFT JOIN c USING (site)"""
    q["profile_phones"] = f"""WITH {CONTACTS} SELECT DISTINCT site, value AS phone FROM contacts WHERE type = 'phone'
      AND NOT regexp_matches(value, '2016|2017|2026|322774')"""

    # F
    q["frontier_round"] = f"""WITH {LINKS}, c AS (SELECT site, to_url AS url, min({{'d': length(from_url), 'f': from_url}}) AS o FROM links
        WHERE {follow} AND to_url NOT IN (SELECT {normal('url')} FROM pages) GROUP BY ALL)
      SELECT site, url, 'link' AS kind, row_number() OVER (PARTITION BY site ORDER BY o, url) AS rank FROM c QUALIFY rank <= 20"""
    q["frontier_candidates"] = f"""WITH {SITEMAPS}, {NEXT}, u AS ({_sitemap_urls()})
      SELECT DISTINCT site, root AS url, 'seed' AS kind FROM shop_pages
      UNION SELECT site, url, 'sitemap' FROM u
      UNION SELECT site, root || '/p/' || k, 'link' FROM shop WHERE b % 2 = 0 OR s % 3 = 0
      UNION SELECT site, root, 'link' FROM shop_pages UNION SELECT site, next_url, 'link' FROM nexts
      UNION SELECT site, next_url, 'pagination' FROM nexts"""
    q["bfs_depth"] = _bfs()
    q["pagination_chain"] = _chain()
    q["crawl_summary"] = f"SELECT {site('url')} AS site, count(*) AS pages FROM pages GROUP BY ALL"

    # G
    q["stream_api_responses"] = q["api_responses"]
    q["stream_api_products"] = f"WITH {API} SELECT source_url, name, price, sku FROM api"
    q["stream_contacts"] = q["page_contacts"]
    q["stream_page_upsert"] = f"""WITH {PAGES} SELECT site, url, CASE WHEN page_id % 2 = 0 THEN 'New ' ELSE '' END || title AS title, h1,
      CASE WHEN thin AND page_id % 2 = 0 THEN 'New ' ELSE '' END || raw_text AS raw_text FROM pg"""
    q["site_links"] = f"""WITH {LINKS}, {HOME} SELECT site, (SELECT count(*) FROM pg WHERE pg.site = home.site) AS pages, url AS home_url,
      title AS home_title, (SELECT count(DISTINCT to_url) FROM links WHERE links.site = home.site) AS out_links FROM home"""
    return q
