"""Queries over texts: preparation, detectors, risk, counts and top lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgrid.functions import fixed, patterns, text
from veilgrid.functions.patterns import java
from veilgrid.operators import detect, report, risk
from veilgrid.plans.registry import SYNTH_SQL, case, first_matches, lit, names, query, rx, spread, synth, table
from veilgrid.plans.scan import scan_documents

DOCS = "SELECT doc_id AS id, text FROM documents"
_TRIM = lambda c: f"regexp_replace({c}, {rx('^{s}+|{s}+$')}, '', 'g')"
_STRIP = lambda c, p: f"regexp_replace({c}, {rx(p)}, '', 'g')"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))


# ---- preparation

_SPLIT = f"string_split(regexp_replace(text, {rx('[.!?]+({s}|$)')}, chr(1) || '\\1', 'g'), chr(1))"
_SENTENCES = f"SELECT id, list_filter({_SPLIT}, lambda x: {_TRIM('x')} <> '') AS ss FROM ({DOCS})"


@query("t1_text_chunks", f"""
WITH s AS ({_SENTENCES}), e AS (SELECT id, unnest(ss) AS sent FROM s),
w AS (SELECT id, sent, regexp_split_to_array(sent, {rx('{s}+')}) AS ws FROM e),
c AS (SELECT id, {_TRIM('sent')} AS c FROM w UNION ALL
      SELECT id, unnest(list_filter(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]), lambda p: length(p) > 5)) FROM w)
SELECT id, count(*) AS n_chunks, sum(length(c)) AS chars, count(DISTINCT c) AS n_distinct FROM c GROUP BY id""")
def t1_text_chunks(spark, sf_dir):
    # a text has chunks if it has more than white space and ends of sentences
    rows = _docs(spark, sf_dir).where(F.col("text").rlike(java(r"[^{s}.!?]")))
    counts = lambda c: F.struct(
        F.size(c).cast("long").alias("n_chunks"), F.aggregate(c, F.lit(0).cast("long"), lambda n, x: n + F.length(x)).alias("chars"), F.size(F.array_distinct(c)).cast("long").alias("n_distinct")
    )
    return rows.select("id", text.let(text.text_chunks(F.col("text")), counts).alias("c")).select("id", "c.*")


@query("t2_model_chunks", f"""
WITH p AS (SELECT id, text, list_filter(list_transform(string_split(regexp_replace(text, {rx('([.;,' + chr(92) + 'n]){s}+')}, '\\1' || chr(1), 'g'), chr(1)), lambda x: {_TRIM('x')}), lambda x: length(x) BETWEEN 2 AND 180) AS l FROM ({DOCS})),
q AS (SELECT id, CASE WHEN len(l) > 0 THEN l WHEN length({_TRIM('text')}) >= 2 THEN [substr({_TRIM('text')}, 1, 180)] ELSE [] END[1:40] AS l FROM p)
SELECT id, len(l) AS n, array_to_string(l, '|') AS chunks FROM q""")
def t2_model_chunks(spark, sf_dir):
    c = text.model_chunks(F.col("text"))
    return _docs(spark, sf_dir).select("id", F.size(c).cast("long").alias("n"), F.array_join(c, "|").alias("chunks"))


@query("t3_surrounding", f"""
WITH m AS (SELECT id, text, regexp_extract(text, '[a-z]{{7}}', 0) AS v FROM ({DOCS})), a AS (SELECT *, CASE WHEN v = '' THEN 0 ELSE instr(text, v) END AS k FROM m)
SELECT id, v AS value, CASE WHEN k > 0 THEN {_TRIM('substr(text, greatest(k - 60, 1), k + length(v) + 60 - greatest(k - 60, 1))')} ELSE '' END AS context FROM a WHERE v <> ''""")
def t3_surrounding(spark, sf_dir):
    rows = _docs(spark, sf_dir).withColumn("value", F.regexp_extract("text", "[a-z]{7}", 0)).where("value <> ''")
    return rows.select("id", "value", text.surrounding(F.col("value"), F.col("text")).alias("context"))


@query("t4_find_matches", f"SELECT id, unnest(l) AS value, unnest(range(len(l))) AS pos FROM (SELECT id, regexp_extract_all(text, '[0-9]+', 0) AS l FROM ({DOCS}))")
def t4_find_matches(spark, sf_dir):
    return _docs(spark, sf_dir).select("id", F.posexplode(text.matches(F.col("text"), "[0-9]+")).alias("pos", "value")).select("id", "value", F.col("pos").cast("long").alias("pos"))


_WORDS = f"list_filter(regexp_split_to_array(text, {rx('{s}+')}), lambda w: w <> '')"
_TOKENS = f"flatten(list_transform({_WORDS}, lambda w: list_concat([w], list_transform(string_split(w, ''), lambda c: '#' || c))))"
_CONVS = "SELECT conv_id * 1000 + turn AS id, text FROM conversations"


def _convs(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")


@query("t5_model_tokens", f"SELECT id, len(t) AS n, md5(array_to_string(t, ' ')) AS digest FROM (SELECT id, {_TOKENS} AS t FROM ({_CONVS}))")
def t5_model_tokens(spark, sf_dir):
    t = text.model_tokens(F.col("text"))
    return _convs(spark, sf_dir).select("id", F.size(t).cast("long").alias("n"), F.md5(F.array_join(t, " ")).alias("digest"))


_VOCAB = f"SELECT token, n, row_number() OVER (ORDER BY n DESC, token) + 1 AS id FROM (SELECT token, count(*) AS n FROM (SELECT unnest({_TOKENS}) AS token FROM ({_CONVS})) GROUP BY token) QUALIFY id <= 2001"


def _vocabulary(spark, sf_dir):
    return text.build_vocabulary(_convs(spark, sf_dir).select(F.explode(text.model_tokens(F.col("text"))).alias("token")), most=2000)


@query("t6_vocabulary", f"SELECT token, n, CAST(id AS INTEGER) AS id FROM ({_VOCAB})")
def t6_vocabulary(spark, sf_dir):
    return _vocabulary(spark, sf_dir)


@query("t7_encode", f"""
WITH v AS ({_VOCAB}), t AS (SELECT id, {_TOKENS}[1:64] AS t FROM ({_CONVS})), e AS (SELECT id, unnest(t) AS token, unnest(range(len(t))) AS i FROM t),
j AS (SELECT e.id, i, coalesce(v.id, 1) AS k FROM e LEFT JOIN v USING (token)), g AS (SELECT id, list(k ORDER BY i) AS l FROM j GROUP BY id)
SELECT t.id, array_to_string(list_concat(coalesce(l, []), list_transform(range(64 - len(coalesce(l, []))), lambda x: 0)), ',') AS ids FROM t LEFT JOIN g USING (id)""")
def t7_encode(spark, sf_dir):
    rows = _convs(spark, sf_dir).withColumn("tokens", text.model_tokens(F.col("text")))
    return text.encode(rows, "tokens", _vocabulary(spark, sf_dir)).select("id", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query("t8_action_tokens", f"SELECT id, array_to_string(list_filter(regexp_split_to_array(lower({_TRIM('text')}), {rx('{s}+')}), lambda w: w <> ''), ' ') AS tokens FROM ({SYNTH_SQL})")
def t8_action_tokens(spark, sf_dir):
    return synth(spark, sf_dir).select("id", F.array_join(text.action_tokens(F.col("text")), " ").alias("tokens"))


@query("t9_cloud_cut", f"SELECT id, length(c) AS n, md5(c) AS digest FROM (SELECT id, CASE WHEN length(text) > 9000 THEN substr(text, 1, 9000) || chr(10) || '[CONTEXT_TRUNCATED]' ELSE text END AS c FROM ({DOCS}))")
def t9_cloud_cut(spark, sf_dir):
    c = text.for_cloud(F.col("text"))
    return _docs(spark, sf_dir).select("id", F.length(c).cast("long").alias("n"), F.md5(c).alias("digest"))


@query("s4_text_cleanup", f"SELECT id, length(c) AS n, md5(c) AS digest FROM (SELECT id, {_TRIM(f'''regexp_replace(regexp_replace(text, {rx('(?:' + chr(92) + 'n{s}*){3,}')}, chr(10) || chr(10), 'g'), '[ \\t]{{2,}}', ' ', 'g')''')} AS c FROM ({DOCS}))")
def s4_text_cleanup(spark, sf_dir):
    c = text.cleanup(F.col("text"))
    return _docs(spark, sf_dir).select("id", F.length(c).cast("long").alias("n"), F.md5(c).alias("digest"))


# ---- detectors

def _found(df: DataFrame, kind: str, mode: str = "lib", hints=None, **options) -> DataFrame:
    return detect.detect(df, "text", ("id",), mode, hints, categories=(kind,), **options).select("id", "value", "confidence")


def _email_sql(source: str, mode: str, more: str = "") -> str:
    domain = "lower(split_part(v, '@', 2))"
    roles = "(?i)^(?:" + "|".join(fixed.ROLE_SENDERS[mode]) + ")@"
    return (
        f"SELECT id, v AS value, CASE WHEN {domain} IN ({names(fixed.TRUSTED_DOMAINS)}) THEN 0.7 ELSE 0.9 END::DOUBLE AS confidence{more} FROM ("
        + first_matches(source, (patterns.EMAIL,), f"{domain} NOT IN ({names(fixed.EXCLUDED_DOMAINS[mode])}) AND NOT regexp_matches(v, {lit(roles)})") + ")"
    )


_PHONE_KEY = _STRIP("v", r"[{s}()+.\-]")
_PHONE_OK = rf"length({_PHONE_KEY}) BETWEEN 7 AND 15 AND NOT regexp_full_match({_PHONE_KEY}, '\d{{7,8}}') AND length(regexp_replace(v, '[^0-9]', '', 'g')) >= 7"


def _phone_sql(source: str, mode: str, more: str = "") -> str:
    return f"SELECT id, v AS value, 0.85::DOUBLE AS confidence{more} FROM ({first_matches(source, patterns.PHONE[:4] if mode == 'rt' else patterns.PHONE, _PHONE_OK, _PHONE_KEY)})"


_CARD_KEY = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_CARD_KEY}) + 1), lambda k: CASE WHEN (length({_CARD_KEY}) - k) % 2 = 1 THEN CASE WHEN CAST(substr({_CARD_KEY}, k, 1) AS INT) > 4 THEN CAST(substr({_CARD_KEY}, k, 1) AS INT) * 2 - 9 ELSE CAST(substr({_CARD_KEY}, k, 1) AS INT) * 2 END ELSE CAST(substr({_CARD_KEY}, k, 1) AS INT) END)) % 10 = 0"


def _card_sql(source: str, more: str = "", tried: tuple[str, ...] = patterns.CARD) -> str:
    return f"SELECT id, v AS value, 0.95::DOUBLE AS confidence{more} FROM ({first_matches(source, tried, f'length({_CARD_KEY}) BETWEEN 13 AND 19 AND {_LUHN}', _CARD_KEY)})"


def _grades(v: str, grades: tuple, last: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({v}, {rx(p)}) THEN {c}" for p, c in grades) + f" ELSE {last} END"


for _mode in ("lib", "rt"):
    for _name, _src, _sql in (("documents", _docs, DOCS), ("customers", synth, SYNTH_SQL)):
        def _email(spark, sf_dir, m=_mode, s=_src):
            return _found(s(spark, sf_dir), "EMAIL", m)

        def _phone(spark, sf_dir, m=_mode, s=_src):
            return _found(s(spark, sf_dir), "PHONE", m)

        query(f"d1_email_{_mode}_{_name}", _email_sql(_sql, _mode))(_email)
        query(f"d2_phone_{_mode}_{_name}", _phone_sql(_sql, _mode))(_phone)
for _name, _src, _sql in (("documents", _docs, DOCS), ("customers", synth, SYNTH_SQL)):
    def _card(spark, sf_dir, s=_src):
        return _found(s(spark, sf_dir), "CREDIT_CARD")

    query(f"d3_credit_card_{_name}", _card_sql(_sql))(_card)


def _union_first(*parts: str) -> str:
    """First of equal values over several lists in order; each part selects id, value, confidence, p, i."""
    every = " UNION ALL ".join(f"SELECT id, value, confidence, {k} AS k, p, i FROM ({x})" for k, x in enumerate(parts))
    return f"SELECT id, value, round(confidence, 3)::DOUBLE AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY id, value ORDER BY k, p, i) AS rn FROM ({every})) WHERE rn = 1"


def _all(source: str, pats: tuple[str, ...], confidence: str, valid: str = "confidence IS NOT NULL") -> str:
    lists = " UNION ALL ".join(f"SELECT id, {k} AS p, regexp_extract_all(text, {rx(x)}, 0) AS l FROM ({source})" for k, x in enumerate(pats))
    return f"SELECT id, v AS value, {confidence} AS confidence, p, i FROM (SELECT id, p, unnest(l) AS v, unnest(range(len(l))) AS i FROM ({lists})) WHERE ({confidence}) IS NOT NULL"


_KEY = _grades("v", (*patterns.KEY_GRADES, patterns.KEY_LONG))


@query("d4_api_key_lib", _union_first(
    f"SELECT id, v AS value, {_KEY} AS confidence, 0 AS p, 0 AS i FROM (SELECT id, regexp_extract(text, {rx(patterns.KEY_ASSIGNED)}, 1) AS v FROM ({SYNTH_SQL})) WHERE v <> '' AND {_KEY} > 0.5", _all(SYNTH_SQL, (patterns.KEY_PREFIXED,), _KEY)))
def d4_api_key_lib(spark, sf_dir):
    return _found(synth(spark, sf_dir), "API_KEY")


@query("d4_api_key_rt", _union_first(_all(SYNTH_SQL, patterns.KEY_RT, _grades("v", patterns.KEY_GRADES, "0.7"))))
def d4_api_key_rt(spark, sf_dir):
    return _found(synth(spark, sf_dir), "API_KEY", "rt")


_SESSION_OK = "CASE WHEN regexp_matches(v, '(?i)^(?:sess|sid|token|jwt)[_-]?[A-Za-z0-9_\\-]{20,}$') THEN 0.85 END"
# the header of every token in this relation is the same and whole
_JWT_SQL = _all(SYNTH_SQL, (patterns.JWT,), "CASE WHEN starts_with(v, 'eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9.') THEN 0.97 ELSE 0.7 END")


@query("d5_auth_token_lib", _union_first(_JWT_SQL, _all(SYNTH_SQL, (patterns.BEARER,), "0.95"), _all(SYNTH_SQL, (patterns.SESSION,), _SESSION_OK)))
def d5_auth_token_lib(spark, sf_dir):
    return _found(synth(spark, sf_dir), "AUTH_TOKEN")


@query("d5_auth_token_rt", _union_first(_JWT_SQL, _all(SYNTH_SQL, (patterns.BEARER,), "0.95"), _all(SYNTH_SQL, (patterns.SESSION,), "0.85")))
def d5_auth_token_rt(spark, sf_dir):
    return _found(synth(spark, sf_dir), "AUTH_TOKEN", "rt")


_GOV = _grades(_STRIP("v", "[{s}-]"), patterns.GOV_GRADES)


@query("d6_government_id_lib", _union_first(_all(SYNTH_SQL, patterns.GOV, _GOV)))
def d6_government_id_lib(spark, sf_dir):
    return _found(synth(spark, sf_dir), "GOVERNMENT_ID")


@query("d6_government_id_rt", _union_first(_all(SYNTH_SQL, patterns.GOV_RT, _GOV)))
def d6_government_id_rt(spark, sf_dir):
    return _found(synth(spark, sf_dir), "GOVERNMENT_ID", "rt")


@query("d7_medical_id_lib", _union_first(_all(SYNTH_SQL, patterns.MEDICAL, _grades(_STRIP("v", "[{s}-]"), patterns.MEDICAL_GRADES))))
def d7_medical_id_lib(spark, sf_dir):
    return _found(synth(spark, sf_dir), "MEDICAL_ID")


@query("d7_medical_id_rt", _union_first(_all(SYNTH_SQL, patterns.MEDICAL[:1], _grades("v", patterns.MEDICAL_GRADES[:1], "0.75"))))
def d7_medical_id_rt(spark, sf_dir):
    return _found(synth(spark, sf_dir), "MEDICAL_ID", "rt")


# a page for each customer: fields and type follow from the key
_HINT_COLUMNS = {
    "has_email": "id % 2 = 0", "has_phone": "id % 3 = 0", "has_password": "id % 7 = 0", "has_financial": "id % 2 = 1", "has_medical": "id % 2 = 0", "has_government": "id % 4 = 0", "has_birth": "id % 3 = 1", "has_user": "id % 2 = 1",
}


def _hinted(spark, sf_dir):
    kind = F.when(F.col("id") % 5 == 0, "login").otherwise("unknown").alias("page_type")
    return synth(spark, sf_dir).withColumn("hints", F.struct(*[F.expr(x).alias(n) for n, x in _HINT_COLUMNS.items()], kind))


@query("d8_bank_account", _union_first(_all(f"{SYNTH_SQL} WHERE c_custkey % 2 = 1", patterns.BANK[:2], "0.82"), _all(f"{SYNTH_SQL} WHERE c_custkey % 2 = 1", patterns.BANK[2:], "0.8")))
def d8_bank_account(spark, sf_dir):
    return _found(_hinted(spark, sf_dir), "BANK_ACCOUNT", "lib", F.col("hints"))


def _has(pattern: str, v: str) -> str:
    return f"regexp_matches({v}, {rx(pattern)})"


def _address_sql(v: str, mode: str, street: str = patterns.STREET) -> str:
    more = "" if mode == "rt" else f" WHEN {_has(patterns.PO_BOX, v)} THEN 0.82 WHEN {_has(patterns.ZIP, v)} AND length({v}) BETWEEN 11 AND 199 THEN 0.55"
    return f"CASE WHEN {_has(street, v)} AND {_has(patterns.ZIP, v)} THEN 0.88 WHEN {_has(street, v)} THEN 0.75{more} END"


def _address_parts(source: str, mode: str, street: str = patterns.STREET) -> tuple[str, ...]:
    """SQL of the addresses among a text's parts, and unless at runtime of texts that are one as a whole."""
    grade = lambda v: _address_sql(v, mode, street)
    parts = f"SELECT id, unnest(l) AS v, unnest(range(len(l))) AS i FROM (SELECT id, list_transform(regexp_split_to_array(text, '[;|\\n]'), lambda x: {_TRIM('x')}) AS l FROM ({source}))"
    found = f"SELECT id, v AS value, {grade('v')} AS confidence, 0 AS p, i FROM ({parts}) WHERE length(v) BETWEEN 6 AND 199 AND ({grade('v')}) IS NOT NULL"
    if mode == "rt":
        return (found,)
    return found, f"SELECT id, text AS value, {grade('text')} AS confidence, 1 AS p, 0 AS i FROM ({source}) WHERE ({grade('text')}) IS NOT NULL AND id NOT IN (SELECT id FROM ({found}))"


def _addresses(source: str, mode: str) -> str:
    return _union_first(*_address_parts(source, mode))


@query("d9_address_lib", _addresses(SYNTH_SQL, "lib"))
def d9_address_lib(spark, sf_dir):
    return _found(synth(spark, sf_dir), "ADDRESS")


@query("d9_address_rt_documents", _addresses(DOCS, "rt"))
def d9_address_rt_documents(spark, sf_dir):
    return _found(_docs(spark, sf_dir), "ADDRESS", "rt")


_AMOUNT = r"TRY_CAST(regexp_extract(regexp_replace(text, '[^0-9.]', '', 'g'), '^\d*\.?\d*', 0) AS DOUBLE)"
_MONEY = " OR ".join(f"regexp_matches(text, {rx(p)})" for p in patterns.CURRENCY)
_FIN = f"CASE WHEN {_AMOUNT} > 100000 THEN 0.65 WHEN {_AMOUNT} > 10000 THEN 0.55 ELSE 0.45 END"


@query("d10_financial", f"SELECT id, {_TRIM('text')} AS value, round(CASE WHEN id % 2 = 1 THEN least({_FIN} + 0.15, 0.85) ELSE {_FIN} END, 3)::DOUBLE AS confidence FROM ({SYNTH_SQL}) WHERE ({_MONEY}) AND {_AMOUNT} > 0")
def d10_financial(spark, sf_dir):
    return _found(_hinted(spark, sf_dir), "FINANCIAL_DATA", "lib", F.col("hints"))


_AGE = f"(2024 - TRY_CAST(regexp_extract(text, {rx(patterns.YEAR)}, 1) AS INT))"
_BORN = f"least(CASE WHEN id % 3 = 1 THEN 0.85 ELSE 0.4 END + CASE WHEN {_AGE} BETWEEN 18 AND 80 THEN 0.15 WHEN {_AGE} BETWEEN 13 AND 100 THEN 0.1 ELSE 0.0 END, 0.9)"


@query("d11_birth_date", f"SELECT id, {_TRIM('text')} AS value, round({_BORN}, 3)::DOUBLE AS confidence FROM ({SYNTH_SQL}) WHERE ({' OR '.join(f'regexp_matches(text, {rx(p)})' for p in patterns.DATE)}) AND {_BORN} > 0.4")
def d11_birth_date(spark, sf_dir):
    return _found(_hinted(spark, sf_dir), "DATE_OF_BIRTH", "lib", F.col("hints"), as_of_year=2024)


@query("d12_username", f"SELECT id, text AS value, least(CASE WHEN id % 2 = 1 THEN 0.75 ELSE 0.35 END + CASE WHEN id % 5 = 0 THEN 0.15 ELSE 0.0 END, 0.85)::DOUBLE AS confidence FROM ({SYNTH_SQL}) WHERE length(text) BETWEEN 3 AND 30 AND regexp_matches(text, {rx(patterns.USERNAME)})")
def d12_username(spark, sf_dir):
    return _found(_hinted(spark, sf_dir), "USERNAME", "lib", F.col("hints"))


@query("d13_password", f"SELECT id, text AS value, 0.95::DOUBLE AS confidence FROM ({SYNTH_SQL}) WHERE id % 7 = 0 AND length(text) BETWEEN 4 AND 128")
def d13_password(spark, sf_dir):
    return _found(_hinted(spark, sf_dir), "PASSWORD", "lib", F.col("hints"))


_SAID = {k: f"regexp_matches(text, {rx(p)})" for k, p in patterns.TEXT_HINTS.items()}


@query("d15_text_hints", f"SELECT id, {', '.join(f'{x} AS {k}' for k, x in _SAID.items() if k != 'email')}, ({_SAID['email']} OR {_SAID['password']}) AS email FROM ({SYNTH_SQL})")
def d15_text_hints(spark, sf_dir):
    h = detect.text_hints(F.col("text"))
    return synth(spark, sf_dir).select("id", *[h[f"has_{k}"].alias(k) for k in ("password", "financial", "medical", "government", "phone", "birth", "email")])


@query("d15_sample_entities")
def d15_sample_entities(spark, sf_dir):
    return synth(spark, sf_dir).select("id", F.explode(detect.sample_entities(F.col("text"))).alias("e")).select("id", "e.type", "e.value", F.round("e.confidence", 3).alias("confidence"))


@query("d17_enabled_categories", f"SELECT id, 'EMAIL' AS type, value FROM ({_email_sql(SYNTH_SQL, 'lib')}) UNION ALL SELECT id, 'CREDIT_CARD', value FROM ({_card_sql(SYNTH_SQL)})")
def d17_enabled_categories(spark, sf_dir):
    return detect.detect(synth(spark, sf_dir), "text", ("id",), categories=("EMAIL", "CREDIT_CARD")).select("id", "type", "value")


def _ordered(kinds: dict[str, tuple[str, ...]]) -> str:
    """SQL of ``(id, pos, type, value, confidence, risk)``: first of equal type and value, numbered in the order of detectors, their lists, patterns and places."""
    every = " UNION ALL ".join(f"SELECT id, '{kind}' AS type, value, confidence::DOUBLE AS confidence, {k} AS k, {j} AS j, p, i FROM ({x})" for k, (kind, parts) in enumerate(kinds.items()) for j, x in enumerate(parts))
    first = f"SELECT * FROM ({every}) QUALIFY row_number() OVER (PARTITION BY id, type, value ORDER BY k, j, p, i) = 1"
    return f"SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY k, j, p, i) - 1 AS INTEGER) AS pos, type, value, round(confidence, 3)::DOUBLE AS confidence, {case('type', fixed.BASE_RISK, 'LOW')} AS risk FROM ({first})"


def _one(source: str, grade: str, valid: str) -> str:
    """SQL of a finding that is the whole text."""
    return f"SELECT id, {_TRIM('text')} AS value, {grade} AS confidence, 0 AS p, 0 AS i FROM ({source}) WHERE {valid}"


def _detectors(source: str, mode: str) -> dict[str, tuple[str, ...]]:
    """SQL of each detector of a mode in order, without a page; its tokens must have the header that ``_JWT_SQL`` knows."""
    at, bare = ", p, i", _STRIP("v", "[{s}-]")
    jwt, bearer = _all(source, (patterns.JWT,), "CASE WHEN starts_with(v, 'eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9.') THEN 0.97 ELSE 0.7 END"), _all(source, (patterns.BEARER,), "0.95")
    if mode == "rt":
        trimmed = f"SELECT id, {_TRIM('text')} AS text FROM ({source})"
        return {
            "EMAIL": (_email_sql(source, "rt", at),), "PHONE": (_phone_sql(source, "rt", at),), "CREDIT_CARD": (_card_sql(source, at),), "GOVERNMENT_ID": (_all(source, patterns.GOV_RT, _GOV),),
            "API_KEY": (_all(source, patterns.KEY_RT, _grades("v", patterns.KEY_GRADES, "0.7")),), "AUTH_TOKEN": (jwt, bearer, _all(source, (patterns.SESSION,), "0.85")),
            "MEDICAL_ID": (_all(source, patterns.MEDICAL[:1], _grades("v", patterns.MEDICAL_GRADES[:1], "0.75")),), "ADDRESS": _address_parts(source, "rt"), "FINANCIAL_DATA": (_one(trimmed, _FIN, f"({_MONEY}) AND {_AMOUNT} > 0"),),
        }
    every_card = _card_sql(source, at, (*patterns.CARD, patterns.CARD_15))
    cards = f"SELECT id, string_agg(regexp_replace(value, '[^0-9]', '', 'g'), ' ') AS cards FROM ({every_card}) GROUP BY id"
    phone = f"SELECT f.* FROM ({_phone_sql(source, 'lib', at)}) f LEFT JOIN ({cards}) c ON f.id = c.id WHERE NOT contains(coalesce(cards, ''), regexp_replace(value, '[^0-9]', '', 'g'))"
    assigned = f"SELECT id, v AS value, {_KEY} AS confidence, 0 AS p, 0 AS i FROM (SELECT id, regexp_extract(text, {rx(patterns.KEY_ASSIGNED)}, 1) AS v FROM ({source})) WHERE v <> '' AND {_KEY} > 0.5"
    born = f"CASE WHEN {_AGE} BETWEEN 18 AND 80 THEN 0.55 WHEN {_AGE} BETWEEN 13 AND 100 THEN 0.5 END"
    return {
        "EMAIL": (_email_sql(source, "lib", at),), "PHONE": (phone,), "CREDIT_CARD": (every_card,), "API_KEY": (assigned, _all(source, (patterns.KEY_PREFIXED,), _KEY)),
        "AUTH_TOKEN": (jwt, bearer, _all(source, (patterns.SESSION,), _SESSION_OK)), "GOVERNMENT_ID": (_all(source, patterns.GOV, _GOV),), "MEDICAL_ID": (_all(source, patterns.MEDICAL, _grades(bare, patterns.MEDICAL_GRADES)),),
        "ADDRESS": _address_parts(source, "strict", patterns.STREET_WORD), "FINANCIAL_DATA": (_one(source, _FIN, f"({_MONEY}) AND {_AMOUNT} > 0"),),
        "DATE_OF_BIRTH": (_one(source, born, f"({' OR '.join(f'regexp_matches(text, {rx(p)})' for p in patterns.DATE)}) AND ({born}) IS NOT NULL"),),
        "USERNAME": (_one(source, "0.35", f"length(text) BETWEEN 3 AND 30 AND regexp_matches(text, {rx(patterns.USERNAME)})"),),
    }


_EVERY = "id", "pos", "type", "value", "confidence", "risk"
for _mode in ("rt", "strict"):
    for _name, _src, _sql in (("", _docs, DOCS), ("_customers", synth, SYNTH_SQL)):
        def _detected(spark, sf_dir, m=_mode, s=_src):
            return detect.detect(s(spark, sf_dir), "text", ("id",), m).select(*_EVERY)

        query(f"o1_all_detectors_{_mode}{_name}", _ordered(_detectors(_sql, _mode)))(_detected)


# ---- findings in documents by three detectors, with their risk

_THREE = ("EMAIL", "PHONE", "CREDIT_CARD")
_CTX = lambda v: f"CASE WHEN instr(text, {v}) > 0 THEN {_TRIM(f'substr(text, greatest(instr(text, {v}) - 60, 1), instr(text, {v}) + length({v}) + 60 - greatest(instr(text, {v}) - 60, 1))')} ELSE '' END"
_FOUND = f"""SELECT f.id, type, det, value, confidence, {_CTX('value')} AS context FROM (
SELECT id, 'EMAIL' AS type, 1 AS det, value, confidence FROM ({_email_sql(DOCS, 'rt')}) UNION ALL
SELECT id, 'PHONE', 2, value, confidence FROM ({_phone_sql(DOCS, 'rt')}) UNION ALL
SELECT id, 'CREDIT_CARD', 3, value, confidence FROM ({_card_sql(DOCS)})) f JOIN ({DOCS}) d ON f.id = d.id"""


def semantic_sql(t: str, mode: str = "rt") -> str:
    hits = lambda terms: "(" + " + ".join(f"CAST(contains(lower({t}), {lit(x)}) AS INT)" for x in terms) + ")"
    high = hits(fixed.RT_HIGH_TERMS if mode == "rt" else fixed.HIGH_TERMS)
    low = "0" if mode == "rt" else hits(fixed.LOW_TERMS)
    return f"CASE WHEN {high} = 0 AND {low} = 0 THEN 0.5 ELSE greatest(0.0, least(1.0, 0.5 + tanh(({high} - {low}) / 3.0) * 0.5)) END"


_OVERALL = f"0.30 * {case('type', fixed.SENSITIVITY, 0.5)} + 0.25 * confidence + 0.20 * 0.4 + 0.15 * 0.3 + 0.10 * ({semantic_sql('context')})"
LEVEL_SQL = lambda x: f"CASE WHEN {x} >= 0.8 THEN 'CRITICAL' WHEN {x} >= 0.6 THEN 'HIGH' WHEN {x} >= 0.35 THEN 'MEDIUM' ELSE 'LOW' END"
_SCORED = f"SELECT id, type, det, value, confidence, {case('type', fixed.SENSITIVITY, 0.5)} AS sensitivity, round({_OVERALL}, 9)::DOUBLE AS overall, {LEVEL_SQL(f'round({_OVERALL}, 12)')} AS level FROM ({_FOUND})"


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), categories=_THREE)


FLAGSHIP_SQL = f"SELECT type, level, count(*) AS n, count(DISTINCT id) AS n_docs, count(DISTINCT value) AS n_values FROM ({_SCORED}) GROUP BY type, level"


@query("flagship_risk_by_type", FLAGSHIP_SQL)
def flagship(spark, sf_dir):
    """Findings in all documents, scored, counted by type and level."""
    s = scored_documents(spark, sf_dir)
    return s.groupBy("type", "level").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"), F.count_distinct("value").alias("n_values"))


@query("r7_scores", f"SELECT id AS doc_id, type, value, overall, level FROM ({_SCORED})")
def r7_scores(spark, sf_dir):
    return scored_documents(spark, sf_dir).select("doc_id", "type", "value", F.round("overall", 9).alias("overall"), "level")


@query("r6_semantic", f"SELECT id, round({semantic_sql('text', 'lib')}, 9)::DOUBLE AS lib, round({semantic_sql('text', 'rt')}, 9)::DOUBLE AS rt FROM ({SYNTH_SQL})")
def r6_semantic(spark, sf_dir):
    return synth(spark, sf_dir).select("id", F.round(risk.semantic(F.col("text"), "lib"), 9).alias("lib"), F.round(risk.semantic(F.col("text"), "rt"), 9).alias("rt"))


_PAGE_KINDS = tuple(fixed.PAGE_SENSITIVITY) + ("elsewhere",)
_KIND_OF = lambda seq, expr: f"[{names(seq)}][CAST(({expr}) % {len(seq)} AS INT) + 1]"
_GRID = f"SELECT event_id AS id, {_KIND_OF(fixed.CATEGORIES, 'event_id')} AS type, {_KIND_OF(_PAGE_KINDS, 'event_id * 7')} AS page_type, (event_id % 23) / 20.0 - 0.05 AS confidence, ['my password here', 'public forum', 'nothing', 'credit card and pin'][CAST(event_id % 4 AS INT) + 1] AS context FROM events"


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entity for each event, its parts following from the id."""
    pick = lambda seq, e: F.element_at(F.array(*[F.lit(x) for x in seq]), (e % len(seq)).cast("int") + 1)
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        i.alias("id"), (i % 50).alias("page_id"), pick(fixed.CATEGORIES, i).alias("type"), pick(_PAGE_KINDS, i * 7).alias("page_type"), ((i % 23) / 20.0 - 0.05).alias("confidence"),
        pick(("my password here", "public forum", "nothing", "credit card and pin"), i).alias("context"),
    )


_GRID_OVERALL = f"0.30 * {case('type', fixed.SENSITIVITY, 0.5)} + 0.25 * greatest(0.0, least(1.0, confidence)) + 0.20 * 0.4 + 0.15 * {case('page_type', fixed.PAGE_SENSITIVITY, 0.3)} + 0.10 * ({semantic_sql('context', 'lib')})"
_GRID_SCORED = f"SELECT id, id % 50 AS page_id, type, {case('type', fixed.SENSITIVITY, 0.5)} AS sensitivity, confidence, greatest(0.0, least(1.0, {_GRID_OVERALL}))::DOUBLE AS overall FROM ({_GRID})"
GRID_LEVELS = f"SELECT *, {LEVEL_SQL('round(overall, 12)')} AS level FROM ({_GRID_SCORED})"


def scored_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = risk.score(grid(spark, sf_dir), F.col("page_type"))
    return s.withColumn("level", risk.level_of(F.round("overall", 12)))


@query("r1_r2_r5_r8_grid", f"SELECT id, type, round(overall, 9)::DOUBLE AS overall, level FROM ({GRID_LEVELS})")
def r1_r2_r5_r8_grid(spark, sf_dir):
    return scored_grid(spark, sf_dir).select("id", "type", F.round("overall", 9).alias("overall"), "level")


_W9 = {"entity_sensitivity": 0.5, "dom_context": 0.4}
_W = risk.weights(**_W9)


@query("r9_weights", f"SELECT id, round(greatest(0.0, least(1.0, {_W['entity_sensitivity']!r} * {case('type', fixed.SENSITIVITY, 0.5)} + {_W['model_confidence']!r} * greatest(0.0, least(1.0, confidence)) + {_W['dom_context']!r} * 0.4 + {_W['page_context']!r} * {case('page_type', fixed.PAGE_SENSITIVITY, 0.3)} + {_W['semantic_context']!r} * ({semantic_sql('context', 'lib')}))), 9)::DOUBLE AS overall FROM ({_GRID})")
def r9_weights(spark, sf_dir):
    return risk.score(grid(spark, sf_dir), F.col("page_type"), by=_W).select("id", F.round("overall", 9).alias("overall"))


@query("r10_page_risk_mean", f"SELECT page_id, round(m, 6)::DOUBLE AS mean_risk, {LEVEL_SQL('round(m, 9)')} AS overall_risk FROM (SELECT page_id, sum(overall * sensitivity) / sum(sensitivity) AS m FROM ({GRID_LEVELS}) GROUP BY page_id)")
def r10_page_risk_mean(spark, sf_dir):
    r = risk.page_risk_mean(scored_grid(spark, sf_dir), ("page_id",))
    return r.select("page_id", F.round("mean_risk", 6).alias("mean_risk"), "overall_risk")


ORD = lambda c: "list_position(['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'], " + c + ")"


@query("r11_page_risk_max", f"SELECT page_id, ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][max({ORD('level')})] AS overall_risk FROM ({GRID_LEVELS}) GROUP BY page_id")
def r11_page_risk_max(spark, sf_dir):
    return risk.page_risk_max(scored_grid(spark, sf_dir), ("page_id",))


@query("r13_semantic_fallback", f"SELECT id, round({semantic_sql('''CASE WHEN id % 2 = 0 THEN 'secret' ELSE substr(text, 1, 500) END''', 'lib')}, 9)::DOUBLE AS semantic FROM ({DOCS})")
def r13_semantic_fallback(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("id", F.when(F.col("id") % 2 == 0, "secret").otherwise("").alias("context"), "text", F.lit("EMAIL").alias("type"), F.lit(0.9).alias("confidence"))
    return risk.score(rows, F.lit("unknown"), fallback=F.col("text")).select("id", F.round("semantic_context", 9).alias("semantic"))


# ---- counts, windows, limits

@query("a1_counts_by_type", f"WITH c AS (SELECT unnest([{names(fixed.CATEGORIES)}]) AS type) SELECT type, count(value) AS n FROM c LEFT JOIN ({_SCORED}) USING (type) GROUP BY type")
def a1_counts_by_type(spark, sf_dir):
    return report.counts_by(scored_documents(spark, sf_dir), "type", fixed.CATEGORIES)


@query("a2_counts_by_level", f"WITH c AS (SELECT unnest([{names(fixed.LEVELS)}]) AS level) SELECT level, count(value) AS n FROM c LEFT JOIN ({_SCORED}) USING (level) GROUP BY level")
def a2_counts_by_level(spark, sf_dir):
    return report.counts_by(scored_documents(spark, sf_dir), "level", fixed.LEVELS)


@query("a4_safe_to_transmit", f"SELECT d.doc_id, coalesce(max({ORD('level')}), 1) < 3 AS is_safe FROM documents d LEFT JOIN ({_SCORED}) s ON s.id = d.doc_id GROUP BY d.doc_id")
def a4_safe_to_transmit(spark, sf_dir):
    return report.safe_to_transmit(table(spark, sf_dir, "documents"), scored_documents(spark, sf_dir), ("doc_id",))


@query("a5_sources", "SELECT page_id, array_to_string(list_sort(list(DISTINCT s)), ',') AS sources, count(DISTINCT s) AS n_sources FROM (SELECT event_id % 50 AS page_id, ['REGEX', 'OCR', 'ML'][CAST(event_id // 50 % 3 AS INT) + 1] AS s FROM events) GROUP BY page_id")
def a5_sources(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("event_id") % 50).alias("page_id"), F.element_at(F.array(*[F.lit(x) for x in ("REGEX", "OCR", "ML")]), (F.floor(F.col("event_id") / 50) % 3).cast("int") + 1).alias("source"))
    r = report.sources_of(e, ("page_id",))
    return r.select("page_id", F.array_join("sources", ",").alias("sources"), "n_sources")


def _popup(*kinds: str) -> str:
    return f"count(*) FILTER (WHERE type IN ({names(kinds)}))"


@query("a9_popup_groups", f"SELECT page_id, {_popup('EMAIL')} AS emails, {_popup('PHONE')} AS phones, {_popup('PASSWORD', 'API_KEY')} AS passwords, {_popup('AUTH_TOKEN')} AS tokens, {_popup('NAME', 'ADDRESS', 'USERNAME', 'CREDIT_CARD', 'BANK_ACCOUNT', 'GOVERNMENT_ID', 'MEDICAL_ID', 'DATE_OF_BIRTH', 'FINANCIAL_DATA', 'OTHER')} AS others FROM ({GRID_LEVELS}) GROUP BY page_id")
def a9_popup_groups(spark, sf_dir):
    return report.popup_groups(scored_grid(spark, sf_dir), ("page_id",))


@query("a10_safety", f"SELECT id AS doc_id, CASE WHEN n > 5 OR r = 4 THEN 'danger' WHEN n > 2 OR r = 3 THEN 'warning' ELSE 'safe' END AS status FROM (SELECT id, count(*) AS n, max({ORD('level')}) AS r FROM ({_SCORED}) GROUP BY id)")
def a10_safety(spark, sf_dir):
    s = scored_documents(spark, sf_dir)
    n = s.groupBy("doc_id").agg(F.count("*").alias("n")).join(risk.page_risk_max(s, ("doc_id",)), "doc_id")
    return n.select("doc_id", report.safety(F.col("n"), F.col("overall_risk")).alias("status"))


@query("a11_shares", f"SELECT type, n, round(n * 100.0 / sum(n) OVER (), 6)::DOUBLE AS pct, CASE WHEN n * 100.0 / sum(n) OVER () < 30 THEN 'safe' WHEN n * 100.0 / sum(n) OVER () < 60 THEN 'warning' ELSE 'danger' END AS bar FROM (SELECT type, count(*) AS n FROM ({_SCORED}) GROUP BY type)")
def a11_shares(spark, sf_dir):
    return report.shares(report.counts_by(scored_documents(spark, sf_dir), "type", fixed.CATEGORIES))


@query("a12_gauge", f"SELECT page_id, count(*) AS n, count(*) FILTER (WHERE level = 'CRITICAL') AS critical, count(*) FILTER (WHERE level = 'HIGH') AS high, count(*) FILTER (WHERE level = 'MEDIUM') AS medium, round(greatest(0.0, least(1.0, (count(*) - 1) / 30.0)), 9)::DOUBLE AS ratio FROM ({GRID_LEVELS} ) GROUP BY page_id")
def a12_gauge(spark, sf_dir):
    return report.gauge(scored_grid(spark, sf_dir), ("page_id",))


@query("a13_scan_counter", "SELECT event_type, count(*) AS scans FROM events GROUP BY event_type")
def a13_scan_counter(spark, sf_dir):
    from veilgrid.streaming.changes import scan_counts

    return scan_counts(table(spark, sf_dir, "events"))


@query("w1_first_wins", f"SELECT page_id, type, context, id FROM (SELECT page_id, type, context, id, row_number() OVER (PARTITION BY page_id, type, context ORDER BY id) AS rn FROM (SELECT *, id % 50 AS page_id FROM ({_GRID}))) WHERE rn = 1")
def w1_first_wins(spark, sf_dir):
    rows = grid(spark, sf_dir).withColumn("value", F.col("context"))
    return detect.first_of_page(rows, ("page_id",), ("id",)).select("page_id", "type", "context", "id")


@query("w2_numbered_tokens", f"SELECT page_id, id, {case('type', fixed.TOKEN_LABEL, '~')} AS t0, type, CASE WHEN t0 = '~' THEN type ELSE t0 END || '_' || CASE WHEN length(CAST(n AS VARCHAR)) < 3 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS token FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY id) - 1 AS n FROM (SELECT *, id % 50 AS page_id FROM ({_GRID})))".replace(" AS t0, type,", " AS t0,"))
def w2_numbered_tokens(spark, sf_dir):
    from veilgrid.operators.redact import numbered_tokens

    rows = numbered_tokens(grid(spark, sf_dir), "page_id", ("id",))
    t0 = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in fixed.TOKEN_LABEL.items() for x in p]), F.col("type")), F.lit("~"))
    return rows.select("page_id", "id", t0.alias("t0"), "token")


@query("l1_top_30", f"SELECT id, level, confidence FROM ({GRID_LEVELS}) ORDER BY {ORD('level')} DESC, id LIMIT 30")
def l1_top_30(spark, sf_dir):
    return report.top_entities(scored_grid(spark, sf_dir), 30, ties=("id",)).select("id", "level", "confidence")


@query("l2_top_40", f"SELECT id, level, confidence FROM ({GRID_LEVELS}) ORDER BY {ORD('level')} DESC, confidence DESC, id LIMIT 40")
def l2_top_40(spark, sf_dir):
    return report.top_entities(scored_grid(spark, sf_dir), 40, True, ("id",)).select("id", "level", "confidence")


@query("l3_top_by_page", f"SELECT page_id, id, level, rank FROM (SELECT page_id, id, level, row_number() OVER (PARTITION BY page_id ORDER BY {ORD('level')} DESC, id) AS rank FROM ({GRID_LEVELS})) WHERE rank <= 12")
def l3_top_by_page(spark, sf_dir):
    return report.top_by_page(scored_grid(spark, sf_dir), ("page_id",), 12, ("id",)).select("page_id", "id", "level", F.col("rank").cast("long").alias("rank"))


_REPORTED = f"SELECT f.*, {_CTX('value')} AS context FROM ({_ordered(_detectors(DOCS, 'rt'))}) f JOIN ({DOCS}) d ON f.id = d.id"
_COUNTED = (*fixed.CATEGORIES, "OTHER")
_COUNTS_SQL = "'{' || " + " || ',' || ".join(f"""'"{c}":' || count(*) FILTER (type = '{c}')""" for c in _COUNTED) + " || '}'"
_WORST = "max(CASE level WHEN 'CRITICAL' THEN 3 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 1 ELSE 0 END)"


@query("privacy_report", f"""
WITH f AS (SELECT id, type, {LEVEL_SQL(f'round({_OVERALL}, 12)')} AS level FROM ({_REPORTED}))
SELECT id AS doc_id, count(*) AS entities, {_COUNTS_SQL} AS counts, ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][{_WORST} + 1] AS overall_risk, count(*) FILTER (level IN ('HIGH', 'CRITICAL')) AS redactions, {_WORST} < 2 AS is_safe
FROM f GROUP BY id""")
def privacy_report(spark, sf_dir):
    from veilgrid.plans.scan import scan_texts, tied

    scan = scan_texts(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), mode="rt")
    return tied(scan.report.select("doc_id", "entities", F.to_json("counts").alias("counts"), "overall_risk", "redactions", "is_safe"), scan)
