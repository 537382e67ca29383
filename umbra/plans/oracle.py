"""The queries again, as SQL for DuckDB: independent statements of the same rules.

Its regular expressions have no look-around, so a shape is looked for from every position: the character there may start
it, the one before may not belong to it, and what follows is part of the pattern and cut off again. Of overlapping hits the
first stays. Fixture queries compare with rows derived by hand from the rules.
"""

from __future__ import annotations

W = r"\p{L}\p{N}_"
LINES = """
u AS (SELECT doc_id, unnest(range(len(parts)))::INT AS seq, unnest(parts) AS text FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))"""
PAGES = r"""
u AS (SELECT doc_id, unnest(range(len(parts)))::INT AS seq, unnest(parts) AS text FROM (SELECT page_id AS doc_id, string_split(coalesce(regexp_replace(regexp_replace(
  regexp_replace(html, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '<[^>]*>', ' ', 'g'), ''), chr(10)) AS parts FROM pages))"""
TURNS = """
u AS (SELECT conv_id AS doc_id, turn::INT AS seq, coalesce(text, '') AS text, role FROM conversations)"""


def hits(name: str, start: str, before: str, core: str, after: str, wide: int = 300) -> str:
    """Common table ``name`` of (doc_id, seq, text, s, e, value) with 0-based offsets."""
    return f"""
{name}_at AS (SELECT doc_id, seq, text, unnest(generate_series(1, length(text))) AS i FROM u WHERE regexp_matches(text, '{core}')),
{name}_all AS (SELECT doc_id, seq, text, (i - 1)::INT AS s, regexp_extract(substr(text, i, {wide}), '^({core})(?:{after}|$)', 1) AS value FROM {name}_at
  WHERE regexp_matches(substr(text, i, 1), '^{start}') AND (i = 1 OR NOT regexp_matches(substr(text, i - 1, 1), '{before}'))),
{name} AS (SELECT a.doc_id, a.seq, a.text, a.s, (a.s + length(a.value))::INT AS e, a.value FROM {name}_all a WHERE a.value <> '' AND NOT EXISTS (
  SELECT 1 FROM {name}_all b WHERE b.doc_id = a.doc_id AND b.seq = a.seq AND b.value <> '' AND b.s < a.s AND b.s + length(b.value) > a.s))"""


def word(words: str) -> str:
    return f"(?i)(^|[^{W}])({words})($|[^{W}])"


EMAIL = hits("email", r"[A-Za-z0-9.!#$%&''*+/=?^_`{|}~-]", rf"[{W}.+-]", r"[A-Za-z0-9.!#$%&''*+/=?^_`{|}~-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", rf"[^{W}.-]")
IP_RAW = hits("ip_raw", "[0-9]", rf"[{W}.]", r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}", rf"[^{W}.]")
IP = IP_RAW + r""",
ip AS (SELECT * FROM ip_raw WHERE len(list_filter(string_split(value, '.'), lambda o: o::INT > 255 OR (length(o) > 1 AND o[1] = '0'))) = 0)"""
CARD_RAW = hits("card_raw", "[0-9]", "[0-9]", "(?:[0-9][ -]?){12,18}[0-9]", "[^0-9]")
LUHN = """list_sum(list_transform(range(length(digits)), lambda k: CASE WHEN k % 2 = 0 THEN digits[length(digits) - k]::INT
  ELSE (2 * digits[length(digits) - k]::INT) // 10 + (2 * digits[length(digits) - k]::INT) % 10 END)) % 10 = 0"""
NEAR = "substr(text, greatest(s - 45, 0) + 1, s - greatest(s - 45, 0))"
AROUND = "substr(text, greatest(s - 45, 0) + 1, e + 45 - greatest(s - 45, 0))"
CARD = CARD_RAW + rf""",
card AS (SELECT doc_id, seq, text, s, e, value FROM (SELECT *, regexp_replace(value, '[^0-9]', '', 'g') AS digits FROM card_raw) WHERE {LUHN}
  AND NOT (regexp_matches({NEAR}, '{word("order|invoice|account|ticket|transaction|reference|ref|identifier|number|no|code|page|revenue|receipt|cheque|check")}')
  AND NOT regexp_matches({AROUND}, '{word("card|credit +card|debit +card|vis[ae]|mastercard|amex|maestro|rupay|cvv|cvc|expiry|expiration")}')))"""
PHONE_RAW = hits("phone_raw", r"[+(0-9]", f"[{W}]", r"(?:\+\s*[0-9]{1,3}[\s.\-]?)?(?:\([0-9]{1,4}\)[\s.\-]?)?[0-9](?:[\s.\-]?[0-9]){6,14}", "[^0-9]")
PHONE = PHONE_RAW + rf""",
phone AS (SELECT doc_id, seq, text, s, e, value FROM (SELECT *, regexp_replace(value, '[^0-9]', '', 'g') AS digits,
  regexp_matches({NEAR}, '{word("phone|mobile|telephone|tel|contact|call|fax")}') AS told,
  regexp_matches({NEAR}, '{word("order|invoice|account|ticket|transaction|reference|ref|identifier|number|code|page|revenue")}') AS other FROM phone_raw)
  WHERE length(digits) BETWEEN 7 AND 15 AND NOT regexp_matches(trim(value), '^[0-9]{{1,4}}[/.-][0-9]{{1,2}}[/.-][0-9]{{1,4}}$')
  AND (starts_with(trim(value), '+') OR told OR (NOT other AND (regexp_matches(digits, '^[6-9][0-9]{{9}}$') OR regexp_matches(digits, '^0[6-9][0-9]{{9}}$')))))"""
#: All spans of the four types that the tables hold; of overlapping ones the type of higher priority stays.
FOUND = """
found_all AS (
  SELECT doc_id, seq, 'EMAIL' AS type, 96 AS p, s, e, value, 'regex-email' AS detector FROM email
  UNION ALL SELECT doc_id, seq, 'IP', 95, s, e, value, 'ipv4-validation' FROM ip
  UNION ALL SELECT doc_id, seq, 'CREDIT_CARD', 98, s, e, value, 'luhn' FROM card
  UNION ALL SELECT doc_id, seq, 'PHONE', 90, s, e, value, 'context-phone' FROM phone),
found AS (SELECT * FROM found_all a WHERE NOT EXISTS (
  SELECT 1 FROM found_all b WHERE b.doc_id = a.doc_id AND b.seq = a.seq AND b.p > a.p AND b.s < a.e AND a.s < b.e))"""


def structured(units: str) -> str:
    return "WITH " + ",".join([units, EMAIL, IP, CARD, PHONE, FOUND])


def spans(name: str, tables: str) -> str:
    return f"WITH {LINES}, {tables} SELECT doc_id, seq, s AS start, e AS \"end\", value FROM {name}"


def rows(columns: str, *values: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join(values)}) AS t({columns})"


DOCS = structured(LINES)
KEY = "CASE WHEN type IN ('PHONE', 'CREDIT_CARD') THEN regexp_replace(value, '[^0-9]', '', 'g') ELSE replace(lower(trim(regexp_replace(value, '\\s+', ' ', 'g'))), 'ß', 'ss') END"
SERIALS = f"""
k AS (SELECT *, {KEY} AS key FROM found),
o AS (SELECT doc_id, type, key, min(seq::BIGINT * 1000000000 - s) AS first FROM k GROUP BY ALL),
n AS (SELECT doc_id, type, key, (row_number() OVER (PARTITION BY doc_id, type ORDER BY first, key) - 1)::INT AS serial FROM o)"""


def shape(v: str, kind: str) -> str:
    """letters, digits and characters of a value after what kind it is."""
    return f"""CASE WHEN contains({v}, '@') THEN 'email-shaped{kind}' WHEN NOT regexp_matches({v}, '\\p{{L}}') THEN 'numeric{kind}' ELSE NULL END"""


def sizes(v: str) -> str:
    return f"', ' || length(regexp_replace({v}, '\\P{{L}}', '', 'g')) || ' letters, ' || length(regexp_replace({v}, '[^0-9]', '', 'g')) || ' digits, ' || length({v}) || ' chars'"


def classes(v: str) -> str:
    tokens = f"list_filter(list_transform(regexp_split_to_array(trim({v}), '\\s+'), lambda t: trim(t, '.,;:()[]''’\"')), lambda t: t <> '')"
    named = f"list_transform({tokens}, lambda t: CASE WHEN length(t) > 1 AND regexp_matches(t, '\\p{{L}}') AND upper(t) = t THEN 'CAPS' WHEN regexp_matches(t, '^[A-Za-z]\\.$') THEN 'initial' WHEN regexp_matches(t, '^\\p{{Lu}}') THEN 'Capitalized' ELSE 'lower' END)"
    return f"len({tokens}) || ' token(s) [' || coalesce(nullif(array_to_string({named}, '/'), ''), 'none') || ']'"


RATIOS = """round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p IS NULL OR r IS NULL THEN NULL WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 9) AS f1,
  round("TP"::DOUBLE / nullif("TP" + "FP" + "FN", 0), 9) AS accuracy"""
#: By hand from the fixture: which truth and which prediction match.
COUNTS = """
c AS (SELECT * FROM (VALUES ('PERSON', 1::BIGINT, 2::BIGINT, 1::BIGINT), ('EMAIL', 1, 0, 0), ('PHONE', 1, 1, 1), ('ORG', 2, 3, 1), ('ADDRESS', 0, 0, 0), ('SSN', 0, 0, 0), ('CREDIT_CARD', 0, 0, 0),
  ('DOB', 0, 0, 0), ('IP', 1, 1, 1)) AS t(type, ground_truth, detected, "TP")),
d AS (SELECT *, detected - "TP" AS "FP", ground_truth - "TP" AS "FN" FROM c)"""
PR = '"TP"::DOUBLE / nullif("TP" + "FP", 0) AS p, "TP"::DOUBLE / nullif("TP" + "FN", 0) AS r'

#: What a form holds, by the rule that makes it: spans of values and of what they are part of.
FORMS = """
c AS (SELECT c_custkey::BIGINT AS k, ['Tarun', 'Kiran', 'Oren', 'Lena', 'Pavel', 'Yusra', 'Imke'][c_custkey % 7 + 1] AS first,
  ['Velmora', 'Oslin', 'Verlin', 'Dravik', 'Sundal', 'Quarrel', 'Tamsin', 'Hollin', 'Wenders', 'Birkel', 'Marlow'][(c_custkey // 7) % 11 + 1] AS last,
  ['Bramble', 'Osprey', 'Larkspur', 'Tarn', 'Fenwick'][c_custkey % 5 + 1] || ' Power Limited' AS firm FROM customer),
e AS (
  SELECT k AS doc_id, 1 AS seq, 'PERSON' AS type, 0 AS s, first || ' ' || last AS value, 'table-name' AS detector, NULL AS identity FROM c
  UNION ALL SELECT k, 2, 'PERSON', 11, upper(first || ' ' || last), 'document-person', first || ' ' || last FROM c
  UNION ALL SELECT k, 3, 'PERSON', 10, first, 'document-cross-unit', first || ' ' || last FROM c
  UNION ALL SELECT k, 4, 'PERSON', 0, last, 'document-cross-unit', first || ' ' || last FROM c
  UNION ALL SELECT k, 5, 'ORG', 16, firm, 'legal-suffix', NULL FROM c
  UNION ALL SELECT k, 6, 'ADDRESS', 19, 'Plot No. ' || (k % 90 + 10) || ', Alder Road, Norvale ' || (k % 90000 + 410000), 'address-context', NULL FROM c
  UNION ALL SELECT k, 7, 'SSN', 4, (k % 500 + 100) || '-' || lpad((k % 99 + 1)::VARCHAR, 2, '0') || '-' || lpad((k % 9999 + 1)::VARCHAR, 4, '0'), 'regex-ssn', NULL FROM c
  UNION ALL SELECT k, 9, 'DOB', 0, lpad((k % 28 + 1)::VARCHAR, 2, '0') || '/' || lpad((k % 12 + 1)::VARCHAR, 2, '0') || '/' || (k % 60 + 1940), 'context-dob', NULL FROM c
  UNION ALL SELECT k, 10, 'EMAIL', 5, lower(first) || '.' || k || '@mail.example', 'regex-email', NULL FROM c
  UNION ALL SELECT k, 11, 'IP', 5, '2001:db8::' || printf('%x', k + 4096), 'ipv6-validation', NULL FROM c
  UNION ALL SELECT k, 12, 'PHONE', 7, '+1 303 555 ' || lpad((k % 10000)::VARCHAR, 4, '0'), 'context-phone', NULL FROM c
  UNION ALL SELECT k, 13, 'CREDIT_CARD', 5, '4111 1111 1111 1111', 'luhn', NULL FROM c)"""
#: Items of orders by place: how many in the truth, how many predicted, how many of both match.
ITEMS = """
i AS (SELECT year(o_orderdate)::BIGINT AS doc_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'PERSON' WHEN '2-HIGH' THEN 'EMAIL' WHEN '3-MEDIUM' THEN 'PHONE' WHEN '4-NOT SPECIFIED' THEN 'ORG' ELSE 'ADDRESS' END AS type,
  count(*) FILTER (WHERE o_orderstatus <> 'O') AS t, count(*) FILTER (WHERE o_totalprice > 100000) AS p FROM orders GROUP BY 1, 2, o_custkey % 7, month(o_orderdate))"""
NINE = "(VALUES ('PERSON'), ('EMAIL'), ('PHONE'), ('ORG'), ('ADDRESS'), ('SSN'), ('CREDIT_CARD'), ('DOB'), ('IP')) AS k(type)"
SWEEP = (
    hits("sweep_email", rf"[{W}.+-]", rf"[{W}.+-]", rf"[{W}.+-]+@[{W}-]+(?:\.[{W}-]+)+", "")
    + ","
    + hits("sweep_phone", r"[+0-9]", rf"[{W}+]", r"\+?[0-9][0-9\s()+-]{6,}[0-9]", f"[^{W}]")
    + """,
swept AS (SELECT doc_id, seq, 'EMAIL' AS type, s, e, trim(value) AS value FROM sweep_email
  UNION ALL SELECT doc_id, seq, 'PHONE', s, e, trim(value) FROM sweep_phone WHERE length(regexp_replace(value, '[^0-9]', '', 'g')) >= 3)"""
)
UNIT = "'body:p' || lpad(seq::VARCHAR, greatest(4, length(seq::VARCHAR))::INT, '0')"

ORACLE: dict[str, str] = {
    "form_local_entities": f"""WITH {FORMS} SELECT doc_id, seq, type, s AS start, (s + length(value))::INT AS "end", value AS text, detector FROM e WHERE NOT starts_with(detector, 'document-')""",
    "form_entities": f"""WITH {FORMS} SELECT doc_id, seq, type, s AS start, (s + length(value))::INT AS "end", value AS text, detector, identity FROM e""",
    "form_redacted": f"""WITH {FORMS}, l AS (SELECT unnest(range(16))::INT AS seq, unnest(['Contact person', 'Aarav Mehta', 'as told by Aarav Mehta today', 'signed by Aarav Mehta', 'Aarav Mehta for all',
      'Goods came from Asteron Technologies Pvt. Ltd. in time', 'Registered office: 101 Example Avenue, New Delhi, Delhi 110001', 'SSN 900-00-1234', 'Date of Birth', '23/05/1997', 'mail aarav.mehta@example.com only',
      'host 2001:db8::1 is up', 'Phone: +1 202 555 0001', 'card 4242 4242 4242 4242', '', 'nothing here']) AS text) SELECT k AS doc_id, seq, text FROM c, l""",
    "form_summary": f"""WITH {FORMS} SELECT (16 * (SELECT count(*) FROM c))::BIGINT AS paragraph_like_units_checked, count(*) AS prediction_count, count(DISTINCT (type, value)) AS distinct_predicted_values,
      0::BIGINT AS residual_original_value_count, true AS passed FROM e""",
    "form_scores": f"""WITH {FORMS}, n AS (SELECT type, count(*) AS found FROM e GROUP BY type),
      d AS (SELECT k.type, CASE WHEN k.type = 'CREDIT_CARD' THEN 0 ELSE found END AS ground_truth, found AS detected, CASE WHEN k.type = 'CREDIT_CARD' THEN 0 ELSE found END AS "TP",
        CASE WHEN k.type = 'CREDIT_CARD' THEN found ELSE 0 END AS "FP", 0::BIGINT AS "FN" FROM {NINE} JOIN n USING (type)),
      r AS (SELECT *, {PR} FROM d) SELECT type, ground_truth, detected, "TP", "FP", "FN", {RATIOS} FROM r""",
    "order_scores": f"""WITH {ITEMS}, n AS (SELECT type, sum(t)::BIGINT AS t, sum(p)::BIGINT AS p, sum(least(t, p))::BIGINT AS m FROM i GROUP BY type),
      d AS (SELECT k.type, coalesce(t, 0) AS ground_truth, coalesce(p, 0) AS detected, coalesce(m, 0) AS "TP", coalesce(p - m, 0) AS "FP", coalesce(t - m, 0) AS "FN" FROM {NINE} LEFT JOIN n USING (type)),
      r AS (SELECT *, {PR} FROM d) SELECT type, ground_truth, detected, "TP", "FP", "FN", {RATIOS} FROM r""",
    "order_unmatched": f"""WITH {ITEMS} SELECT 'truth' AS side, doc_id, type, sum(t - least(t, p))::BIGINT AS n FROM i GROUP BY ALL HAVING sum(t - least(t, p)) > 0
      UNION ALL SELECT 'prediction', doc_id, type, sum(p - least(t, p))::BIGINT FROM i GROUP BY ALL HAVING sum(p - least(t, p)) > 0""",
    "document_audit_gaps": f"""{DOCS}, {SWEEP} SELECT doc_id, {UNIT} AS unit_id, type, s AS start, e AS "end", {shape('value', '')} || {sizes('value')} AS shape FROM swept a WHERE NOT EXISTS (
      SELECT 1 FROM found b WHERE b.doc_id = a.doc_id AND b.seq = a.seq AND b.type = a.type AND b.s < a.e AND a.s < b.e)""",
    "document_merge": f"""{DOCS} SELECT doc_id, {UNIT} AS unit_id, value AS text, s AS start, e AS "end", NULL::VARCHAR AS problem FROM found WHERE type = 'EMAIL'""",
    "units_scan": f"WITH {LINES} SELECT doc_id, 'body:p' || lpad(seq::VARCHAR, greatest(4, length(seq::VARCHAR))::INT, '0') AS unit_id, seq, length(text)::BIGINT AS n_chars FROM u",
    "units_stats": f"""WITH {LINES} SELECT doc_id, count(*) AS units, sum(length(text))::BIGINT AS chars, 'body:p0000' AS first_id,
      'body:p' || lpad(max(seq)::VARCHAR, greatest(4, length(max(seq)::VARCHAR))::INT, '0') AS last_id FROM u GROUP BY doc_id""",
    "full_text": "SELECT doc_id, md5(coalesce(text, '')) AS text_md5 FROM documents",
    "neighbor_context": f"""WITH {LINES}, l AS (SELECT doc_id, seq, lag(text, 2) OVER w AS a, lag(text, 1) OVER w AS b FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY seq))
      SELECT doc_id, seq, md5(right(concat_ws(chr(10), nullif(a, ''), nullif(b, '')), 800)) AS context_md5 FROM l""",
    "email_spans": spans("email", EMAIL),
    "email_domains": f"WITH {LINES}, {EMAIL} SELECT lower(split_part(value, '@', -1)) AS domain, count(*) AS n FROM email GROUP BY 1",
    "ipv4_spans": spans("ip", IP),
    "card_candidates": spans("card_raw", CARD_RAW),
    "card_spans": spans("card", CARD),
    "phone_spans": spans("phone", PHONE),
    "structured_entities": f'{DOCS} SELECT doc_id, seq, type, s AS start, e AS "end", value AS text, detector FROM found',
    "entity_counts_by_type": f"{DOCS} SELECT type, count(*) AS n, count(DISTINCT doc_id) AS docs FROM found GROUP BY type",
    "rollup_source_type": f"{DOCS} SELECT lang, type, count(*) AS n FROM found JOIN documents USING (doc_id) GROUP BY ROLLUP (lang, type)",
    "pii_density": f"""{DOCS}, n AS (SELECT doc_id, count(*) AS n FROM found GROUP BY 1)
      SELECT lang, count(*) AS docs, sum(coalesce(n, 0))::BIGINT AS entities, sum(length(text))::BIGINT AS chars, round(sum(coalesce(n, 0)) * 1e6 / sum(length(text)), 6) AS per_mb
      FROM documents LEFT JOIN n USING (doc_id) GROUP BY lang""",
    "labels_vs_pii": f"""{DOCS}, n AS (SELECT doc_id, count(*) AS n FROM found GROUP BY 1)
      SELECT quality, toxic, count(*) AS docs, count(n) AS docs_with_pii, sum(coalesce(n, 0))::BIGINT AS entities FROM labels LEFT JOIN n USING (doc_id) GROUP BY ALL""",
    "pages_text_pii": f"""{structured(PAGES)} SELECT t.type, count(found.type) AS n, count(DISTINCT found.doc_id) AS pages
      FROM (VALUES ('CREDIT_CARD'), ('EMAIL'), ('IP'), ('PHONE')) AS t(type) LEFT JOIN found ON found.type = t.type GROUP BY t.type""",
    "conversations_pii": f"""{structured(TURNS)}, n AS (SELECT doc_id, seq, count(*) AS n FROM found GROUP BY ALL)
      SELECT role, count(*) AS turns, sum(coalesce(n, 0))::BIGINT AS entities FROM u LEFT JOIN n USING (doc_id, seq) GROUP BY role""",
    "mapping_serials": f"{DOCS}, {SERIALS} SELECT doc_id, type, key, serial FROM n",
    "replacement_values": f"""{DOCS}, {SERIALS}, v AS (SELECT ['aarav', 'maya', 'rohan', 'priya', 'kabir', 'neha', 'vikram', 'sneha', 'arjun', 'meera', 'rahul', 'ananya', 'yash', 'kavya', 'aditya', 'isha'] AS f,
      ['mehta', 'carter', 'shah', 'morgan', 'kapoor', 'reed', 'nair', 'bennett', 'joshi', 'rivera', 'malhotra', 'foster', 'iyer', 'brooks', 'desai', 'hayes'] AS l)
      SELECT doc_id, k.seq, type, s AS start, value AS text, CASE type WHEN 'IP' THEN '203.0.113.' || (10 + serial % 200)
      ELSE f[serial % 16 + 1] || '.' || l[(serial + serial // 16) % 16 + 1] || '@example.com' END AS replacement
      FROM k JOIN n USING (doc_id, type, key), v WHERE type IN ('EMAIL', 'IP')""",
    "redacted_documents": f"""{DOCS}, m AS (SELECT doc_id, seq, list({{'s': s, 'e': e, 't': type}} ORDER BY s) AS x FROM found GROUP BY ALL),
      r AS (SELECT u.doc_id, u.seq, CASE WHEN x IS NULL THEN text ELSE array_to_string(list_transform(range(1, len(x) + 1), lambda i:
        substr(text, (CASE WHEN i = 1 THEN 0 ELSE x[i - 1].e END) + 1, x[i].s - (CASE WHEN i = 1 THEN 0 ELSE x[i - 1].e END)) || '[' || x[i].t || ']'), '') || substr(text, x[len(x)].e + 1) END AS out
        FROM u LEFT JOIN m USING (doc_id, seq)) SELECT doc_id, seq, md5(out) AS text_md5 FROM r""",
    "residual_check": f"""{DOCS} SELECT count(DISTINCT (doc_id, type, replace(lower(trim(regexp_replace(value, '\\s+', ' ', 'g'))), 'ß', 'ss'))) AS originals, 0::BIGINT AS residual FROM found""",
    "value_shapes": f"{DOCS} SELECT type, coalesce({shape('value', ' value')}, {classes('value')}) || {sizes('value')} AS shape, count(*) AS n FROM found GROUP BY ALL",
    "luhn_numbers": f"""WITH {LINES}, {CARD_RAW}, d AS (SELECT regexp_replace(value, '[^0-9]', '', 'g') AS digits FROM card_raw)
      SELECT length(digits)::INT AS length, {LUHN} AS valid, count(*) AS n FROM d GROUP BY ALL""",
    "truth_chunks": f"""WITH RECURSIVE {LINES}, b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS k FROM u WHERE regexp_matches(text, '\\S')),
      f AS (SELECT doc_id, k, 0 AS chunk, length(text) + 40 AS size FROM b WHERE k = 1
        UNION ALL SELECT b.doc_id, b.k, CASE WHEN f.size >= 24000 THEN f.chunk + 1 ELSE f.chunk END, CASE WHEN f.size >= 24000 THEN 0 ELSE f.size END + length(b.text) + 40
        FROM f JOIN b ON b.doc_id = f.doc_id AND b.k = f.k + 1)
      SELECT doc_id, chunk::INT AS chunk, count(*) AS units, sum(length(text))::BIGINT AS chars, 'body:p' || lpad(min(seq)::VARCHAR, greatest(4, length(min(seq)::VARCHAR))::INT, '0') AS first_id,
        'body:p' || lpad(max(seq)::VARCHAR, greatest(4, length(max(seq)::VARCHAR))::INT, '0') AS last_id FROM f JOIN b USING (doc_id, k) GROUP BY ALL""",
    "scalar_shapes": f"""SELECT c_custkey, coalesce({shape('c_name', ' value')}, {classes('c_name')}) || {sizes('c_name')} AS shape,
      coalesce({shape('c_name', ' value')}, len(list_filter(regexp_split_to_array(trim(c_name), '\\s+'), lambda t: trim(t, '.,;:()[]') <> '')) || ' token(s)') || {sizes('c_name')} AS residual,
      coalesce({shape('c_name', '')}, len(regexp_split_to_array(trim(c_name), '\\s+')) || ' token(s)') || {sizes('c_name')} AS audit,
      coalesce(nullif(lower(trim(regexp_replace(c_name, '[^A-Za-z0-9]+', '.', 'g'), '.')), ''), 'user') AS slug FROM customer""",
    "url_endpoints": r"""SELECT CASE WHEN regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) || '://'
      || split_part(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*:/{0,3}([^/?#]*)', 1), '@', -1) ELSE '(unparseable)' END AS endpoint, count(*) AS n FROM pages GROUP BY 1""",
    # ---- fixtures: rows derived by hand
    "demo_scores": """SELECT type, n AS ground_truth, n AS detected, n AS "TP", 0::BIGINT AS "FP", 0::BIGINT AS "FN" FROM (VALUES ('PERSON', 6::BIGINT), ('EMAIL', 3), ('PHONE', 4), ('ORG', 5), ('ADDRESS', 3), ('SSN', 1),
      ('CREDIT_CARD', 1), ('DOB', 1), ('IP', 2)) AS t(type, n)""",
    "ssn_spans": rows('doc_id, seq, start, "end", value', "(0::BIGINT, 0::INT, 4::INT, 13::INT, '123456789')", "(2, 0, 3, 14, '219-09-9999')", "(4, 0, 16, 27, '219 09 9999')"),
    "dob_spans": rows(
        'doc_id, seq, start, "end", value', "(0::BIGINT, 0::INT, 15::INT, 25::INT, '14/08/1998')", "(1, 0, 15, 25, '1998-08-14')", "(2, 0, 15, 27, 'Aug 14, 1998')", "(3, 0, 15, 31, '14th August 1998')",
        "(4, 0, 39, 49, '14/08/1998')", "(7, 0, 4, 14, '05.06.1977')", "(8, 0, 0, 10, '15/07/1980')",
    ),
    "ipv6_spans": rows('doc_id, seq, start, "end", value', "(0::BIGINT, 0::INT, 3::INT, 14::INT, '2001:db8::1')", "(1, 0, 0, 3, '::1')", "(2, 0, 0, 15, '1:2:3:4:5:6:7:8')", "(6, 0, 0, 9, 'ab::cd:ef')"),
    "address_spans": rows(
        "doc_id, text, detector", "(0::BIGINT, '14C, Fern Park, Norvale, Norvale 110001', 'address-context')", "(1, '123 Example Street, +91 9812345670', 'address-context')",
        "(2, 'Norvale - 411 038', 'address-context')", "(3, 'One Harbour Centre', 'address-context')", "(7, 'Plot No. 12, Alder Road, Norvale 411038', 'address-context')",
    ),
    "org_spans": rows(
        "doc_id, text, detector", "(0::BIGINT, 'BRAMBLE FAMILY TRUST', 'business-suffix-caps')", "(0, 'OSPREY FAMILY TRUST', 'business-suffix-caps')", "(3, 'QXE Limited', 'legal-suffix')",
        "(3, 'The Larkspur Bank Limited', 'legal-suffix')", "(4, 'Hollin Copper', 'organization-list')", "(4, 'Wend Power Limited', 'legal-suffix')", "(4, 'Tarn Steel', 'organization-list')",
    ),
    "person_spans": rows(
        "doc_id, text, detector", "(0::BIGINT, 'Maya Verlin', 'name-heuristic')", "(1, 'Tarun N. Velmora', 'context-name')", "(1, 'Kiran Subra Oslin', 'context-name')", "(2, 'Kiran Oslin', 'transfer-name')",
        "(2, 'DM Feld', 'transfer-name')", "(2, 'Ganesh BO', 'transfer-name')", "(3, 'Ravi Kumar', 'title-name')",
    ),
    "local_entities": rows(
        "doc_id, seq, type, text, detector", "(1::BIGINT, 1::INT, 'DOB', '14/08/1998', 'context-dob')", "(2, 1, 'PERSON', 'Maya Verlin', 'table-name')", "(3, 0, 'ORG', 'BRAMBLE FAMILY TRUST', 'business-suffix-caps')",
        "(3, 0, 'ORG', 'OSPREY FAMILY TRUST', 'business-suffix-caps')", "(4, 0, 'PERSON', 'Tarun Velmora', 'title-name')", "(4, 3, 'EMAIL', 'velmora@mail.example', 'regex-email')",
    ),
    "seed_values": rows("doc_id, type, value", "(2::BIGINT, 'PERSON', 'Maya Verlin')", "(3, 'ORG', 'BRAMBLE FAMILY TRUST')", "(3, 'ORG', 'OSPREY FAMILY TRUST')", "(4, 'PERSON', 'Tarun Velmora')"),
    "propagated_entities": rows("doc_id, seq, type, text, detector", "(2::BIGINT, 2::INT, 'PERSON', 'MAYA VERLIN', 'document-person')"),
    "cross_unit_entities": rows(
        "doc_id, seq, type, text, identity", "(3::BIGINT, 1::INT, 'ORG', 'BRAMBLE', 'BRAMBLE FAMILY TRUST')", "(3, 2, 'ORG', 'FAMILY TRUST', 'BRAMBLE FAMILY TRUST')",
        "(3, 3, 'ORG', 'OSPREY', 'OSPREY FAMILY TRUST')", "(3, 4, 'ORG', 'FAMILY TRUST', 'OSPREY FAMILY TRUST')", "(4, 1, 'PERSON', 'Tarun', 'Tarun Velmora')", "(4, 2, 'PERSON', 'Velmora', 'Tarun Velmora')",
    ),
    "evaluate_by_type": f'WITH {COUNTS}, e AS (SELECT *, {PR} FROM d) SELECT type, ground_truth, detected, "TP", "FP", "FN", {RATIOS} FROM e',
    "evaluate_totals": f"""WITH {COUNTS}, s AS (SELECT sum(ground_truth)::BIGINT AS ground_truth, sum(detected)::BIGINT AS detected, sum("TP")::BIGINT AS "TP", sum("FP")::BIGINT AS "FP", sum("FN")::BIGINT AS "FN" FROM d),
      e AS (SELECT *, {PR} FROM s) SELECT ground_truth, detected, "TP", "FP", "FN", {RATIOS} FROM e""",
    "unmatched_truth": rows("id, type", "(1::BIGINT, 'EMAIL')", "(4, 'ORG')"),
    "unmatched_predictions": rows("id, type", "(1::BIGINT, 'PERSON')", "(3, 'ORG')", "(5, 'ORG')"),
    "audit_gaps": rows('unit_id, type, start, "end", shape', "('u1', 'EMAIL', 29::INT, 44::INT, 'email-shaped, 13 letters, 0 digits, 15 chars')", "('u2', 'PHONE', 24, 35, 'numeric, 0 letters, 10 digits, 11 chars')"),
    "audit_predictions": rows(
        "unit_id, type, reason, shape", "('u1', 'EMAIL', 'no annotation overlaps this span', 'email-shaped, 13 letters, 0 digits, 15 chars')",
        "('u3', 'ORG', 'no annotation overlaps this span', '1 token(s), 6 letters, 0 digits, 6 chars')", "('u3', 'PERSON', 'span not found in source unit', '2 token(s), 8 letters, 0 digits, 9 chars')",
    ),
    "audit_misses": rows('unit_id, type, start, "end"', "('u1', 'EMAIL', 9::INT, 25::INT)", "('u3', 'PERSON', 0, 11)", "('u3', 'PERSON', 3, 9)", "('u9', 'PERSON', 0, 1)"),
    "audit_summary": rows(
        "annotations, email_gaps, email_units, phone_gaps, phone_units, unmatched_predictions, missed_annotations",
        "('EMAIL=1 PERSON=3 PHONE=1', 1::BIGINT, 'u1', 1::BIGINT, 'u2', 3::BIGINT, 4::BIGINT)",
    ),
    "truth_validate": rows("unit_id, type, start, problem", "('u1', 'EMAIL', 9::INT, NULL)", "('u2', 'PHONE', 5, NULL)", "('u3', 'PERSON', 0, NULL)", "('u3', 'PERSON', 3, 'text differs')", "('u9', 'PERSON', 0, 'unknown unit')"),
    "truth_merge": rows('unit_id, type, text, start, "end"', "('u1', 'EMAIL', 'ann@mail.example', 9::INT, 25::INT)", "('u3', 'PERSON', 'Maya Verlin', 0, 11)", "('u3', 'PERSON', 'Maya Verlin', 13, 24)", "('u3', 'PERSON', 'Maya Verlin Oslin', 29, 46)"),
    "truth_rejects": rows("id, reason", "(4::BIGINT, 'bad type')", "(5, 'unknown unit')", "(6, 'not found')", "(8, 'not found')"),
    "redacted_fixture": rows(
        "doc_id, seq, text", "(1::BIGINT, 0::INT, 'Date of Birth')", "(1, 1, '23/05/1997')", "(2, 0, 'Contact person')", "(2, 1, 'Aarav Mehta')", "(2, 2, 'as told by Aarav Mehta today')",
        "(3, 0, 'The promoters are Northstar Foods Limited and Asteron Technologies Pvt. Ltd..')", "(3, 1, 'Northstar Foods Limited')", "(3, 2, 'Northstar Foods Limited')",
        "(3, 3, 'Asteron Technologies Pvt. Ltd.')", "(3, 4, 'Asteron Technologies Pvt. Ltd.')", "(4, 0, 'Mr. Aarav Mehta, Director')", "(4, 1, 'signed by Aarav Mehta')", "(4, 2, 'Aarav Mehta for all')",
        "(4, 3, 'tarun aarav.mehta@example.com')",
    ),
    "verification_summary": rows(
        "paragraph_like_units_checked, prediction_count, distinct_predicted_values, residual_original_value_count, hyperlinks_checked, stale_hyperlinks, field_codes_checked, stale_field_codes, passed",
        "(14::BIGINT, 13::BIGINT, 12::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, true)",
    ),
    "docx_redaction": rows(
        "unit_id, seq, text", "('word/document.xml:p0000', 0::INT, 'Contact person')", "('word/document.xml:p0001', 1, 'Aarav Mehta')", "('word/document.xml:p0002', 2, '')",
        "('word/document.xml:p0003', 3, 'link')", "('word/header1.xml:p0000', 4, 'head aarav.mehta@example.com')", "('word/footer1.xml:p0000', 5, 'foot')",
    ),
    "docx_units": rows(
        "part, unit_id, seq, text", "('word/document.xml', 'word/document.xml:p0000', 0::INT, 'Contact person')", "('word/document.xml', 'word/document.xml:p0001', 1, 'Maya Verlin')",
        "('word/document.xml', 'word/document.xml:p0002', 2, '')", "('word/document.xml', 'word/document.xml:p0003', 3, 'link')", "('word/header1.xml', 'word/header1.xml:p0000', 4, 'head ann@mail.example')",
        "('word/footer1.xml', 'word/footer1.xml:p0000', 5, 'foot')",
    ),
}
