"""Masks, pseudonyms, redaction, encryption and verdicts."""

from pyspark.sql import functions as F

from sparkelt.functions import redaction
from sparkelt.functions.privacy import (
    decrypt, encrypt, mask_card, mask_email, mask_phone, mask_table, pseudonymize, pseudonymize_scoped)
from sparkelt.functions.validation import (
    FORBIDDEN_WORDS, IPV4, METADATA_HOSTS, SCHEMES, classify_endpoint, classify_sql)
from sparkelt.operators.lakehouse import to_silver
from sparkelt.operators.relational import join_frames

from .registry import query, table

# Contacts made from every customer; some nations have unusual addresses.
# The expressions read the same in both SQL dialects.
EMAIL = """CASE c_nationkey WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'no address'
    WHEN 3 THEN concat('@', lower(c_mktsegment), '.com') WHEN 4 THEN concat('a@b@', c_custkey, '.com')
    WHEN 5 THEN concat('x@', c_custkey, '.org')
    ELSE concat(lower(replace(c_name, '#', '.')), '@', lower(c_mktsegment), '.com') END"""
PHONE = """CASE c_nationkey WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '123' WHEN 3 THEN concat('ext ', c_custkey)
    WHEN 4 THEN concat('+', c_nationkey, ' (555) ', c_custkey, ' home')
    ELSE concat('+1-555-', lpad(concat(c_custkey % 1000), 3, '0'), '-', lpad(concat(c_custkey % 10000), 4, '0')) END"""
CARD = "concat('4000-', lpad(concat(c_custkey), 12, '0'))"
CONTACTS = f"(SELECT c_custkey, {EMAIL} AS email, {PHONE} AS phone, {CARD} AS card, c_acctbal, c_mktsegment FROM customer)"
SALT = "check-salt"


def contacts(spark, sf):
    return table(spark, sf, "customer").selectExpr(
        "c_custkey", f"{EMAIL} AS email", f"{PHONE} AS phone", f"{CARD} AS card", "c_acctbal", "c_mktsegment")


def email_sql(column, kept="'***'"):
    local = f"split_part({column}, '@', 1)"
    return f"""CASE WHEN contains({column}, '@') THEN
        (CASE WHEN length({local}) <= 1 THEN '*' ELSE {local}[1] || {kept} END) || '@' || split_part({column}, '@', 2)
        ELSE {column} END"""


def digits(column):
    return f"regexp_replace({column}, '[^0-9]', '', 'g')"


def phone_sql(column):
    return f"""CASE WHEN length({digits(column)}) < 4 THEN '****' ELSE '***-***-' || right({digits(column)}, 4) END"""


def pseudo_sql(value, salt=SALT):
    return f"'pseudo_' || substr(sha256('{salt}:' || {value}), 1, 12)"


@query("mask_email", f"SELECT c_custkey, {email_sql('email')} AS email FROM {CONTACTS}")
def email(spark, sf):
    return contacts(spark, sf).select("c_custkey", mask_email(F.col("email")).alias("email"))


@query("mask_phone", f"SELECT c_custkey, {phone_sql('phone')} AS phone FROM {CONTACTS}")
def phone(spark, sf):
    return contacts(spark, sf).select("c_custkey", mask_phone(F.col("phone")).alias("phone"))


@query("mask_card", f"SELECT c_custkey, '****-****-****-' || right({digits('card')}, 4) AS card FROM {CONTACTS}")
def card(spark, sf):
    return contacts(spark, sf).select("c_custkey", mask_card(F.col("card")).alias("card"))


@query("mask_documented_style", f"""
    SELECT c_custkey, {email_sql('email', "'***' || right(split_part(email, '@', 1), 1)")} AS email,
           CASE WHEN length({digits('phone')}) < 4 THEN '****'
                WHEN regexp_extract(phone, '^\\s*(\\+[0-9]{{1,3}})[^0-9]', 1) <> ''
                THEN regexp_extract(phone, '^\\s*(\\+[0-9]{{1,3}})[^0-9]', 1) || '-***-***-' || right({digits('phone')}, 4)
                ELSE '***-***-' || right({digits('phone')}, 4) END AS phone
    FROM {CONTACTS}""")
def documented_style(spark, sf):
    return contacts(spark, sf).select(
        "c_custkey", mask_email(F.col("email"), "ends").alias("email"), mask_phone(F.col("phone"), "prefix").alias("phone"))


@query("pseudonymize", f"SELECT c_custkey, {pseudo_sql('c_custkey')} AS pseudonym, {pseudo_sql('c_name')} AS name FROM customer")
def pseudonyms(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", pseudonymize(F.col("c_custkey"), SALT).alias("pseudonym"), pseudonymize(F.col("c_name"), SALT).alias("name"))


@query("pseudonymize_join", f"""
    SELECT {pseudo_sql('o_custkey')} AS who, o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey""")
def pseudonym_join(spark, sf):
    placed = table(spark, sf, "orders").select(pseudonymize(F.col("o_custkey"), SALT).alias("who"), "o_orderkey")
    buyers = table(spark, sf, "customer").select(pseudonymize(F.col("c_custkey"), SALT).alias("who"), "c_mktsegment")
    return join_frames(placed, buyers, "who")


MASTER = "check-master"
# HMAC-SHA256 with the padded key as text: 64 letters, each xor-ed with a pad byte.
LETTERS = "ghijklmnopqrstuv"


def _padded(pad):
    return "".join(chr(ord(c) ^ pad) for c in LETTERS).replace("'", "''")


def scoped_hmac_sql(message, scope):
    key = f"translate(sha256('{MASTER}:' || {scope}), '0123456789abcdef', '{LETTERS}')"
    inner, outer = [f"encode(translate({key}, '{LETTERS}', '{_padded(p)}'))" for p in (0x36, 0x5C)]
    return f"sha256({outer} || from_hex(sha256({inner} || encode({message}))))"


@query("pseudonymize_keyed", f"""
    SELECT c_custkey, 'pseudo_' || substr({scoped_hmac_sql("CAST(c_custkey AS VARCHAR)", 'c_mktsegment')}, 1, 64) AS pseudonym
    FROM customer""")
def keyed(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", pseudonymize_scoped(F.col("c_custkey"), MASTER, F.col("c_mktsegment")).alias("pseudonym"))


@query("mask_table", f"""
    SELECT {pseudo_sql('c_custkey')} AS c_custkey, {email_sql('email')} AS email, {phone_sql('phone')} AS phone,
           card, c_acctbal, c_mktsegment FROM {CONTACTS}""")
def whole_table(spark, sf):
    return mask_table(contacts(spark, sf), email=["email", "missing"], phone=["phone"],
                      pseudonymous=["c_custkey"], salt=SALT)


@query("silver_detect_loose", f"""
    SELECT c_custkey AS customer_id, {email_sql('email')} AS WorkEmail, {phone_sql('phone')} AS contact_no, card FROM {CONTACTS}""")
def detect_loose(spark, sf):
    return to_silver(contacts(spark, sf).selectExpr(
        "c_custkey AS customer_id", "email AS WorkEmail", "phone AS contact_no", "card"))


@query("silver_detect_strict", f"""
    SELECT {pseudo_sql('c_custkey')} AS customer_id, {email_sql('email')} AS email, phone AS contact_no,
           {pseudo_sql('card')} AS ssn FROM {CONTACTS}""")
def detect_strict(spark, sf):
    return to_silver(contacts(spark, sf).selectExpr(
        "c_custkey AS customer_id", "email", "phone AS contact_no", "card AS ssn"), strict=True, salt=SALT)


@query("encrypt_roundtrip", "SELECT c_custkey, c_name, TRUE AS hidden FROM customer")
def encryption(spark, sf):
    key = b"0123456789abcdef"
    sealed = table(spark, sf, "customer").select("c_custkey", "c_name", encrypt(F.col("c_name"), key).alias("sealed"))
    return sealed.select("c_custkey", decrypt(F.col("sealed"), key).alias("c_name"),
                         (~F.col("sealed").contains(F.col("c_name"))).alias("hidden"))


# -- redaction --------------------------------------------------------------
# All documents, and per customer a log line with one secret of every kind.

def log_line(sha):
    name = sha.format("c_name")
    return f"""concat('Connected to postgresql://admin:', substr({name}, 1, 8), '!@10.0.0.5:5432/finance using key AKIA',
        upper(substr({name}, 1, 16)), ' and aws_secret_access_key = "', substr({name}, 1, 40), '". Password: ', c_custkey,
        '; AZURE_STORAGE_KEY=', {name}, '== Auth header: Bearer ', {name}, '. token: Bearer ', {name},
        ' mirror mysql://u:p@ss', c_custkey, '@host/x')"""


TEXTS = f"""(SELECT 'doc' AS kind, doc_id AS id, text FROM documents
             UNION ALL SELECT 'log', c_custkey, {log_line('sha256({})')} FROM customer)"""


def texts(spark, sf):
    # A customer takes a few bytes in a file and makes a long text full of secrets. Tasks cut by bytes would give
    # all lines to one of them, so the short rows are dealt out by number before the lines are made.
    documents = table(spark, sf, "documents").selectExpr("'doc' AS kind", "doc_id AS id", "text")
    customers = table(spark, sf, "customer").select("c_custkey", "c_name")
    dealt = customers.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "c_custkey")
    logs = dealt.selectExpr("'log' AS kind", "c_custkey AS id", f"{log_line('sha2({}, 256)')} AS text")
    return documents.unionByName(logs)


def replace_sql(column, rule):
    pattern, replacement = rule
    pattern = pattern.replace("'", "''")
    for group in "123":
        replacement = replacement.replace(f"${group}", f"\\{group}")
    return f"regexp_replace({column}, '{pattern}', '{replacement}', 'g')"


def fold_sql(*rules):
    text = "text"
    for rule in rules:
        text = replace_sql(text, rule)
    return text


def redaction_query(name, *rules, **options):
    options = options or {"rules": rules}

    @query(name, f"SELECT kind, id, {fold_sql(*rules)} AS text FROM {TEXTS}")
    def run(spark, sf):
        return redaction.redact_table(texts(spark, sf), "text", **options)


redaction_query("redact_uri_password", redaction.URI_PASSWORD)
redaction_query("redact_aws_secret", redaction.AWS_SECRET)
redaction_query("redact_generic", redaction.ASSIGNMENT)
redaction_query("redact_aws_key", redaction.AWS_KEY_ID)
redaction_query("redact_bearer", redaction.BEARER)
redaction_query("redact_azure", redaction.AZURE_KEY)
redaction_query("redact_all", *redaction.PLAIN, strict=False)
redaction_query("redact_all_strict", *redaction.STRICT, strict=True)


# -- verdicts ---------------------------------------------------------------
# All page addresses, and one made from every event.

EVENT_URL = """CASE event_type
    WHEN 'view' THEN concat('http://', (event_id * 7 + user_id) % 256, '.', event_id % 256, '.', user_id, '.1:8080/x?y=1')
    WHEN 'error' THEN concat('https://user:pw@169.254.', user_id, '.', event_id % 256, '/latest')
    WHEN 'signup' THEN concat('s3a://172.', event_id % 40, '.0.', user_id, '/bucket')
    WHEN 'click' THEN CASE event_id % 5
        WHEN 0 THEN concat('HTTP://Metadata.Google.Internal:80/', event_id) WHEN 1 THEN concat('ftp://host/', event_id)
        WHEN 2 THEN concat('http://[fe80::', user_id, ']/') WHEN 3 THEN concat('http://[2001:db8::', user_id, ']:9/')
        ELSE concat('jdbc:postgresql://10.0.0.1/', event_id) END
    ELSE CASE event_id % 6
        WHEN 0 THEN '' WHEN 1 THEN concat('http://127.0.0.', user_id) WHEN 2 THEN concat('http://localhost:', event_id)
        WHEN 3 THEN concat('http://192.168.', user_id, '.9/') WHEN 4 THEN 'no scheme' ELSE 'http://[::1]:8000/' END
    END"""
URLS = f"""(SELECT 'page' AS kind, page_id AS id, url FROM pages
            UNION ALL SELECT 'event', event_id, {EVENT_URL} FROM events)"""


def urls(spark, sf):
    pages = table(spark, sf, "pages").selectExpr("'page' AS kind", "page_id AS id", "url")
    return pages.unionByName(table(spark, sf, "events").selectExpr(
        "'event' AS kind", "event_id AS id", f"{EVENT_URL} AS url"))


def endpoint_sql(strict):
    listed = ", ".join(f"'{h}'" for h in METADATA_HOSTS)
    schemes = ", ".join(f"'{s}'" for s in SCHEMES)
    extra = """
        WHEN v4 AND a = 127 THEN 'blocked_loopback'
        WHEN v4 AND (a = 10 OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168)) THEN 'blocked_private'""" if strict else ""
    return f"""
        WITH authority AS (SELECT *, regexp_extract(url, '^\\s*[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1) AS auth,
            lower(regexp_extract(url, '^\\s*([A-Za-z][A-Za-z0-9+.\\-]*):', 1)) AS scheme FROM {URLS}),
        bare AS (SELECT *, regexp_replace(auth, '^.*@', '') AS h FROM authority),
        hosts AS (SELECT *, lower(CASE WHEN starts_with(h, '[') THEN regexp_extract(h, '^\\[([^\\]]*)\\]', 1)
            ELSE regexp_extract(h, '^([^:]*)', 1) END) AS host FROM bare),
        parsed AS (SELECT *, regexp_matches(host, '{IPV4}') AS v4, contains(host, ':') AS v6,
            TRY_CAST(regexp_extract(host, '{IPV4}', 1) AS INTEGER) AS a, TRY_CAST(regexp_extract(host, '{IPV4}', 2) AS INTEGER) AS b,
            COALESCE(TRY_CAST('0x' || nullif(regexp_extract(host, '^([0-9a-f]*):', 1), '') AS INTEGER), 0) AS g FROM hosts)
        SELECT kind, id, url, CASE WHEN url = '' THEN 'allowed' WHEN scheme NOT IN ({schemes}) THEN 'blocked_scheme'
            WHEN host = '' THEN 'allowed' WHEN host IN ({listed}) THEN 'blocked_metadata'
            WHEN (v4 AND a = 169 AND b = 254) OR (v6 AND g BETWEEN 65152 AND 65215) THEN 'blocked_link_local'
            WHEN (v4 AND a >= 224) OR (v6 AND (g >= 65280 OR NOT (g BETWEEN 8192 AND 16383 OR g BETWEEN 64512 AND 65023
                OR g >= 65152))) THEN 'blocked_reserved'{extra} ELSE 'allowed' END AS verdict
        FROM parsed"""


@query("classify_endpoint", endpoint_sql(strict=False))
def endpoints(spark, sf):
    return classify_endpoint(urls(spark, sf), "url")


@query("classify_endpoint_strict", endpoint_sql(strict=True))
def endpoints_strict(spark, sf):
    return classify_endpoint(urls(spark, sf), "url", allow_localhost=False, block_private=True)


# A query log with one text per event.
EVENT_SQL = """CASE event_type
    WHEN 'view' THEN concat('SELECT * FROM t WHERE id = ', event_id, CASE WHEN event_id % 2 = 0 THEN '; ' ELSE '' END)
    WHEN 'click' THEN concat('-- note', chr(10), ' with x as (select ', user_id, ') select * from x /* drop */')
    WHEN 'error' THEN CASE event_id % 8
        WHEN 0 THEN concat('DROP TABLE t', event_id) WHEN 1 THEN concat('select 1; DELETE FROM t WHERE id=', event_id)
        WHEN 2 THEN '-- only a comment' WHEN 3 THEN '' WHEN 4 THEN concat('EXPLAIN SELECT ', event_id)
        WHEN 5 THEN concat('SELECT ''please drop ', event_id, '''') WHEN 6 THEN concat('values (', event_id, ')')
        ELSE concat('with d as (select 1) insert into t select ', event_id, ' -- create') END
    WHEN 'signup' THEN concat('Select grantee, dropped From t Where updated_at > ', event_id)
    ELSE concat('SELECT load_extension(', event_id, '), execute FROM t; ;')
    END"""


@query("classify_sql", f"""
    WITH log AS (SELECT event_id, {EVENT_SQL} AS query FROM events),
    bare AS (SELECT *, regexp_replace(regexp_replace(query, '--[^\\n]*', '', 'g'), '(?s)/\\*.*?\\*/', '', 'g') AS b FROM log),
    split AS (SELECT *, list_filter(list_transform(string_split(b, ';'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')),
        lambda s: s <> '') AS parts FROM bare),
    words AS (SELECT *, upper(parts[1]) AS q, regexp_extract_all(upper(parts[1]),
        '\\b({"|".join(FORBIDDEN_WORDS)})\\b', 1) AS found FROM split)
    SELECT event_id, query, CASE WHEN len(parts) = 0 THEN 'empty' WHEN len(parts) > 1 THEN 'multiple_statements'
        WHEN NOT regexp_matches(q, '^(SELECT|WITH|EXPLAIN)') THEN 'not_read_only'
        WHEN len(found) > 0 THEN 'forbidden:' || list_filter({list(FORBIDDEN_WORDS)}, lambda w: list_contains(found, w))[1]
        ELSE 'ok' END AS verdict
    FROM words""")
def sql_log(spark, sf):
    log = table(spark, sf, "events").selectExpr("event_id", f"{EVENT_SQL} AS query")
    return classify_sql(log, "query")
