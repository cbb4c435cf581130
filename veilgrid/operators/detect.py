"""Detectors of personal data as column expressions.

``entities(text, ...)`` is one array of all findings in the order of the detectors; ``detect`` explodes it to rows.
Modes: ``lib`` and ``rt`` follow the two rule sets of the survey; ``strict`` is ``lib`` without its known false alarms:
cards of 15 digits count, phone numbers inside cards don't, streets need a whole word, passwords come from fields alone.

A page gives context as a struct of booleans (``page_hints``): has_email, has_phone, has_password, has_financial,
has_medical, has_government, has_birth, has_user, and its page_type.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilgrid.functions import fixed, patterns
from veilgrid.functions.names import own_prefix
from veilgrid.functions.patterns import java
from veilgrid.functions.text import let, luhn, matches, strip, surrounding, trim

FOUND = "array<struct<type:string,value:string,confidence:double>>"


def _none() -> Column:
    return F.array().cast(FOUND)


def _entry(kind: str, value: Column, confidence: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), value.alias("value"), confidence.cast("double").alias("confidence"))


def _entries(kind: str, values: Column, grade: Callable[[Column], Column]) -> Column:
    """Graded values; those without a grade are dropped."""
    return F.filter(F.transform(values, lambda v: _entry(kind, v, grade(v))), lambda e: e["confidence"].isNotNull())


def _first_of(values: Column, key: Callable[[Column], Column]) -> Column:
    """Values whose key hasn't come before, in their order; sorted once, so many matches in one text stay cheap."""
    marked = F.sort_array(F.transform(values, lambda v, i: F.struct(key(v).alias("k"), i.alias("i"), v.alias("v"))))
    first = let(marked, lambda m: F.filter(m, lambda e, j: (j == 0) | ~F.get(m, j - 1)["k"].eqNullSafe(e["k"])))
    ordered = F.sort_array(F.transform(first, lambda e: F.struct(e["i"].alias("i"), e["v"].alias("v"))))
    return F.transform(ordered, lambda e: e["v"])


def _graded(value: Column, grades: tuple, last: Column | None = None) -> Column:
    out = None
    for pattern, confidence in grades:
        test = value.rlike(java(pattern))
        out = F.when(test, confidence) if out is None else out.when(test, confidence)
    return out if last is None else out.otherwise(last)


def _hint(hints: Column | None, name: str) -> Column:
    return F.lit(False) if hints is None else F.coalesce(hints[name], F.lit(False))


def _raised(confidence: Column, when: Column, by: float, cap: float) -> Column:
    return F.when(when & confidence.isNotNull(), F.least(confidence + by, F.lit(cap))).otherwise(confidence)


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def phone_key(value: Column) -> Column:
    return strip(value, r"[{s}()+.\-]")


def valid_phone(value: Column) -> Column:
    """7 to 15 digits once separators are gone, but not 7 or 8 digits alone."""
    bare = phone_key(value)
    return F.length(bare).between(7, 15) & ~bare.rlike(r"^\d{7,8}$") & (F.length(digits_of(bare)) >= 7)


def valid_card(value: Column) -> Column:
    bare = strip(value, r"[{s}-]")
    return bare.rlike(r"^\d{13,19}$") & luhn(bare)


class Seen:
    """Cheap tests of a text that let most texts skip most patterns.

    As columns of their own (``columns``, each with the prefix given) they are evaluated once for all detectors, otherwise where they are used.
    They are single columns, not a struct: a struct of which only fields are read is inlined into every use.
    """

    # The tests by name, with the one that must hold first.
    TESTS = {
        "at": (None, "@"), "digit": (None, "[0-9]"), "digits3": ("digit", "[0-9]{3}"), "digits4": ("digits3", "[0-9]{4}"), "digits6": ("digits4", "[0-9]{6}"),
        "run16": (None, "[A-Za-z0-9_-]{16}"), "key": ("run16", "(?i)key"), "eyj": (None, "eyJ"), "bearer": (None, "(?i)bearer"), "session": ("run16", "(?i)sess|sid|token|jwt"),
    }

    def __init__(self, text: Column, prefix: str | None = None):
        self._text, self._prefix = text, prefix

    def __getattr__(self, name: str) -> Column:
        if self._prefix is not None:
            return F.col(self._prefix + name)
        needs, pattern = self.TESTS[name]
        return self._text.rlike(pattern) if needs is None else getattr(self, needs) & self._text.rlike(pattern)

    @classmethod
    def columns(cls, text: Column, prefix: str) -> dict[str, Column]:
        own = cls(text)
        return {prefix + n: getattr(own, n) for n in cls.TESTS}


def email_entities(text: Column, mode: str = "lib", hints: Column | None = None, seen: Seen | None = None) -> Column:
    rules = "rt" if mode == "rt" else "lib"
    role = "(?i)^(?:" + "|".join(fixed.ROLE_SENDERS[rules]) + ")@"
    domain = lambda v: F.lower(F.split_part(v, F.lit("@"), F.lit(2)))
    raised = F.when(_hint(hints, "has_email"), 0.08).otherwise(0.0)
    grade = lambda v: F.when(
        ~domain(v).isin(*fixed.EXCLUDED_DOMAINS[rules]) & ~v.rlike(role),
        F.least(F.when(domain(v).isin(*fixed.TRUSTED_DOMAINS), F.lit(0.9) - 0.2).otherwise(0.9) + raised, F.lit(1.0)),
    )
    return F.when((seen or Seen(text)).at, _entries("EMAIL", matches(text, patterns.EMAIL), grade)).otherwise(_none())


def phone_entities(text: Column, mode: str = "lib", hints: Column | None = None, seen: Seen | None = None) -> Column:
    found = F.flatten(F.array(*[matches(text, p) for p in (patterns.PHONE[:4] if mode == "rt" else patterns.PHONE)]))
    kept = _first_of(F.filter(found, valid_phone), phone_key)
    if mode == "strict":
        cards = F.array_join(F.transform(F.flatten(F.array(*[F.filter(matches(text, p), valid_card) for p in (*patterns.CARD, patterns.CARD_15)])), digits_of), " ")
        kept = let(F.struct(kept.alias("v"), cards.alias("cards")), lambda x: F.filter(x["v"], lambda v: ~F.contains(x["cards"], digits_of(v))))
    confidence = F.when(_hint(hints, "has_phone"), F.lit(0.85) + 0.1).otherwise(0.85)
    return F.when((seen or Seen(text)).digits3, F.transform(kept, lambda v: _entry("PHONE", v, confidence))).otherwise(_none())


def card_entities(text: Column, mode: str = "lib", hints: Column | None = None, seen: Seen | None = None) -> Column:
    tried = (*patterns.CARD, patterns.CARD_15) if mode == "strict" else patterns.CARD
    found = F.flatten(F.array(*[matches(text, p) for p in tried]))
    kept = _first_of(F.filter(found, valid_card), digits_of)
    return F.when((seen or Seen(text)).digits4, F.transform(kept, lambda v: _entry("CREDIT_CARD", v, F.lit(0.95)))).otherwise(_none())


def key_entities(text: Column, mode: str = "lib", hints: Column | None = None, seen: Seen | None = None) -> Column:
    has = (seen or Seen(text)).run16
    if mode == "rt":
        found = F.flatten(F.array(*[matches(text, p) for p in patterns.KEY_RT]))
        return F.when(has, _entries("API_KEY", found, lambda v: _graded(v, patterns.KEY_GRADES, F.lit(0.7)))).otherwise(_none())
    grade = lambda v: _graded(v, (*patterns.KEY_GRADES, patterns.KEY_LONG))
    first = F.regexp_extract(text, java(patterns.KEY_ASSIGNED), 1)
    assigned = F.filter(F.array(_entry("API_KEY", first, grade(first))), lambda e: (e["value"] != "") & (e["confidence"] > 0.5))
    assigned = F.when((seen or Seen(text)).key, assigned).otherwise(_none())
    return F.when(has, F.concat(assigned, _entries("API_KEY", matches(text, patterns.KEY_PREFIXED), grade))).otherwise(_none())


def _jwt_header(value: Column) -> Column:
    return F.try_to_binary(F.split_part(value, F.lit("."), F.lit(1)), F.lit("base64")).cast("string")


def token_entities(text: Column, mode: str = "lib", hints: Column | None = None, seen: Seen | None = None) -> Column:
    header = lambda v: F.coalesce(_jwt_header(v), F.lit(""))
    valid = lambda v: F.try_parse_json(header(v)).isNotNull()
    whole = lambda v: F.coalesce(F.get_json_object(header(v), "$.alg"), F.lit("")).isin("", "null") | F.coalesce(F.get_json_object(header(v), "$.typ"), F.lit("")).isin("", "null")
    session = r"(?i)^(?:sess|sid|token|jwt)[_-]?[A-Za-z0-9_\-]{20,}$"
    lacking = F.lit(0.7) if mode == "rt" else F.lit(None).cast("double")
    jwt = _entries("AUTH_TOKEN", matches(text, patterns.JWT), lambda v: F.when(~valid(v), 0.7).when(whole(v), lacking).otherwise(0.97))
    bearer = _entries("AUTH_TOKEN", matches(text, patterns.BEARER), lambda v: F.lit(0.95))
    other = _entries("AUTH_TOKEN", matches(text, patterns.SESSION), lambda v: F.lit(0.85) if mode == "rt" else F.when(v.rlike(session), 0.85))
    own = seen or Seen(text)
    return F.concat(*[F.when(test, part).otherwise(_none()) for test, part in ((own.eyj, jwt), (own.bearer, bearer), (own.session, other))])


def government_entities(text: Column, mode: str = "lib", hints: Column | None = None, seen: Seen | None = None) -> Column:
    found = F.flatten(F.array(*[matches(text, p) for p in (patterns.GOV_RT if mode == "rt" else patterns.GOV)]))
    grade = lambda v: _raised(_graded(strip(v, r"[{s}-]"), patterns.GOV_GRADES), _hint(hints, "has_government"), 0.1, 0.98)
    return F.when((seen or Seen(text)).digits4, _entries("GOVERNMENT_ID", found, grade)).otherwise(_none())


def medical_entities(text: Column, mode: str = "lib", hints: Column | None = None, seen: Seen | None = None) -> Column:
    found = F.flatten(F.array(*[matches(text, p) for p in (patterns.MEDICAL[:1] if mode == "rt" else patterns.MEDICAL)]))
    own = (lambda v: _graded(v, patterns.MEDICAL_GRADES[:1], F.lit(0.75))) if mode == "rt" else (lambda v: _graded(strip(v, r"[{s}-]"), patterns.MEDICAL_GRADES))
    return F.when((seen or Seen(text)).digits6, _entries("MEDICAL_ID", found, lambda v: _raised(own(v), _hint(hints, "has_medical"), 0.1, 0.95))).otherwise(_none())


def bank_entities(text: Column, mode: str = "lib", hints: Column | None = None, seen: Seen | None = None) -> Column:
    """Only on pages with a financial field."""
    if hints is None:
        return _none()
    labelled = F.flatten(F.array(*[matches(text, p) for p in patterns.BANK[:2]]))
    bare = matches(text, patterns.BANK[2])
    grade = F.lit(0.82) if mode == "rt" else F.lit(0.8)
    every = F.concat(F.transform(labelled, lambda v: _entry("BANK_ACCOUNT", v, F.lit(0.82))), F.transform(bare, lambda v: _entry("BANK_ACCOUNT", v, grade)))
    first = _first_of(every, lambda e: e["value"])
    return F.when(_hint(hints, "has_financial") & (seen or Seen(text)).digits6, first).otherwise(_none())


def _address(value: Column, mode: str) -> Column:
    street = value.rlike(java(patterns.STREET_WORD if mode == "strict" else patterns.STREET))
    code = value.rlike(java(patterns.ZIP))
    graded = F.when(street & code, 0.88).when(street, 0.75)
    if mode == "rt":
        return graded
    return graded.when(value.rlike(java(patterns.PO_BOX)), 0.82).when(code & F.length(value).between(11, 199), 0.55)


def address_entities(text: Column, mode: str = "lib", hints: Column | None = None, seen: Seen | None = None) -> Column:
    parts = F.filter(F.transform(F.split(text, r"[;|\n]"), trim), lambda p: F.length(p).between(6, 199))
    found = _entries("ADDRESS", parts, lambda p: _address(p, mode))
    has = (seen or Seen(text)).digit
    if mode == "rt":
        return F.when(has, found).otherwise(_none())
    whole = F.filter(F.array(_entry("ADDRESS", text, _address(text, mode))), lambda e: e["confidence"].isNotNull())
    return F.when(has, let(found, lambda f: F.when(F.size(f) > 0, f).otherwise(whole))).otherwise(_none())


def financial_entities(text: Column, mode: str = "lib", hints: Column | None = None, seen: Seen | None = None) -> Column:
    begins = text.rlike(java("^{s}*[$€£¥0-9]"))  # few texts do; the others aren't trimmed
    value = trim(text) if mode == "rt" else text
    money = value.rlike(java(patterns.CURRENCY[0])) | value.rlike(java(patterns.CURRENCY[1]))
    # the number before a second point, as a lenient parser reads it
    amount = F.regexp_extract(F.regexp_replace(text, "[^0-9.]", ""), r"^\d*\.?\d*", 0).try_cast("double")
    grade = F.when(money & (amount > 0), F.when(amount > 100000, 0.65).when(amount > 10000, 0.55).otherwise(0.45))
    if mode != "rt":
        grade = _raised(grade, _hint(hints, "has_financial"), 0.15, 0.85)
    found = F.filter(F.array(_entry("FINANCIAL_DATA", trim(text), grade)), lambda e: e["confidence"].isNotNull())
    return F.when(begins, found).otherwise(_none())


def birth_entities(text: Column, mode: str = "lib", hints: Column | None = None, seen: Seen | None = None, as_of_year: int = 2024) -> Column:
    """A text with a date; the year of reference is a parameter, so that results don't change with the calendar."""
    if mode == "rt":
        return _none()
    dated = F.lit(False)
    for p in patterns.DATE:
        dated = dated | text.rlike(java(p))
    age = F.lit(as_of_year) - F.regexp_extract(text, java(patterns.YEAR), 1).try_cast("int")
    more = F.coalesce(F.when(age.between(18, 80), 0.15).when(age.between(13, 100), 0.1), F.lit(0.0))
    grade = F.least(F.when(_hint(hints, "has_birth"), 0.85).otherwise(0.4) + more, F.lit(0.9))
    found = F.filter(F.array(_entry("DATE_OF_BIRTH", trim(text), F.when(dated & (grade > 0.4), grade))), lambda e: e["confidence"].isNotNull())
    return F.when((seen or Seen(text)).digits4, found).otherwise(_none())


def user_entities(text: Column, mode: str = "lib", hints: Column | None = None, seen: Seen | None = None) -> Column:
    if mode == "rt":
        return _none()
    form = F.lit(False) if hints is None else F.coalesce(hints["page_type"].isin("login", "registration"), F.lit(False))
    grade = F.least(F.when(_hint(hints, "has_user"), 0.75).otherwise(0.35) + F.when(form, 0.15).otherwise(0.0), F.lit(0.85))
    ok = F.length(text).between(3, 30) & text.rlike(patterns.USERNAME)
    return F.when(ok, F.array(_entry("USERNAME", trim(text), grade))).otherwise(_none())


def password_entities(text: Column, mode: str = "lib", hints: Column | None = None, seen: Seen | None = None) -> Column:
    """Any text of 4 to 128 characters on a page with a password field; nothing in strict mode."""
    if hints is None or mode == "strict":
        return _none()
    return F.when(_hint(hints, "has_password") & F.length(text).between(4, 128), F.array(_entry("PASSWORD", text, F.lit(0.95)))).otherwise(_none())


# The order of the detectors by mode.
ORDER = {
    "lib": ("PASSWORD", "EMAIL", "PHONE", "CREDIT_CARD", "API_KEY", "AUTH_TOKEN", "GOVERNMENT_ID", "MEDICAL_ID", "BANK_ACCOUNT", "ADDRESS", "FINANCIAL_DATA", "DATE_OF_BIRTH", "USERNAME"),
    "rt": ("PASSWORD", "EMAIL", "PHONE", "CREDIT_CARD", "GOVERNMENT_ID", "API_KEY", "AUTH_TOKEN", "MEDICAL_ID", "BANK_ACCOUNT", "ADDRESS", "FINANCIAL_DATA"),
}
DETECTORS: dict[str, Callable[..., Column]] = {
    "PASSWORD": password_entities, "EMAIL": email_entities, "PHONE": phone_entities, "CREDIT_CARD": card_entities, "API_KEY": key_entities, "AUTH_TOKEN": token_entities,
    "GOVERNMENT_ID": government_entities, "MEDICAL_ID": medical_entities, "BANK_ACCOUNT": bank_entities, "ADDRESS": address_entities, "FINANCIAL_DATA": financial_entities,
    "DATE_OF_BIRTH": birth_entities, "USERNAME": user_entities,
}


def _said(text: Column) -> Column:
    """Whether a text has more than white space; trimming a long text to see costs a pass over it."""
    return F.coalesce(text.rlike(java("{S}")), F.lit(False))


def entities(text: Column, mode: str = "lib", hints: Column | None = None, categories: tuple[str, ...] = fixed.CATEGORIES, as_of_year: int = 2024, seen: Seen | None = None) -> Column:
    """All findings in a text; detectors of categories that aren't asked for aren't in the plan.

    seen: the tests of the text, if they are columns already.
    """
    parts, seen = [], seen or Seen(text)
    for kind in ORDER["rt" if mode == "rt" else "lib"]:
        if kind in categories:
            more = {"as_of_year": as_of_year} if kind == "DATE_OF_BIRTH" else {}
            parts.append(DETECTORS[kind](text, mode, hints, seen, **more))
    every = F.concat(*parts) if parts else _none()
    return F.when(_said(text), every).otherwise(_none())


def base_risk(kind: Column) -> Column:
    out = F.lit("LOW")
    for level in dict.fromkeys(fixed.BASE_RISK.values()):
        out = F.when(kind.isin(*[c for c, r in fixed.BASE_RISK.items() if r == level]), level).otherwise(out)
    return out


def level_order(level: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in fixed.LEVELS]), level).cast("int") - 1


def detect(df: DataFrame, text_col: str = "text", keys: tuple[str, ...] = ("doc_id",), mode: str = "lib", hints: Column | None = None, distinct: bool = True, context: Column | None = None, **options) -> DataFrame:
    """A row for each finding: the keys, ``pos`` (its place among the text's findings), type, value, confidence, risk, source, context.

    distinct keeps the first of equal type and value of a text.  context is the text in which surroundings are
    looked up, the text itself by default.
    """
    own = own_prefix(df)
    said, at, e = own + "context", own + "pos", own + "entity"
    text = F.col(text_col)
    one = df.withColumn(said, context if context is not None else text).withColumns(Seen.columns(text, own))
    every = entities(text, mode, hints, seen=Seen(text, own), **options)
    if distinct:
        every = _first_of(every, lambda x: F.struct(x["type"], x["value"]))
    rows = one.select(*keys, said, F.posexplode(every).alias(at, e))
    found = F.col(e)
    return rows.select(
        *keys, F.col(at).alias("pos"), found["type"].alias("type"), found["value"].alias("value"), F.round(found["confidence"], 3).alias("confidence"), base_risk(found["type"]).alias("risk"),
        F.lit("REGEX").alias("source"), surrounding(found["value"], F.coalesce(F.col(said), F.lit(""))).alias("context"),
    )


def page_hints(fields: Column, page_type: Column) -> Column:
    """Booleans of a page from its form fields (an array of structs)."""
    label = lambda f: F.lower(F.concat_ws(" ", *[F.when(f[c] != "", f[c]) for c in ("name", "placeholder", "label", "autocomplete", "type")]))
    words = lambda f: F.lower(F.concat_ws(" ", *[F.when(f[c] != "", f[c]) for c in ("name", "placeholder", "label", "autocomplete")]))
    everything = F.array_join(F.transform(fields, label), " ")
    any_in = lambda text, names: _any([F.contains(text, F.lit(n)) for n in names])
    exact = lambda f, c, n: F.contains(F.coalesce(f[c], F.lit("")), F.lit(n))
    return F.struct(
        F.exists(fields, lambda f: (f["type"] == "email") | exact(f, "name", "email") | exact(f, "placeholder", "email")).alias("has_email"),
        F.exists(fields, lambda f: (f["type"] == "tel") | exact(f, "name", "phone") | exact(f, "placeholder", "phone")).alias("has_phone"),
        F.exists(fields, lambda f: F.coalesce(f["is_password"], F.lit(False))).alias("has_password"),
        any_in(everything, fixed.FIELD_HINTS["password"]).alias("names_password"),
        any_in(everything, fixed.FIELD_HINTS["financial"]).alias("has_financial"),
        any_in(everything, fixed.FIELD_HINTS["medical"]).alias("has_medical"),
        any_in(everything, fixed.FIELD_HINTS["government"]).alias("has_government"),
        F.exists(fields, lambda f: any_in(words(f), fixed.BIRTH_WORDS)).alias("has_birth"),
        F.exists(fields, lambda f: any_in(words(f), fixed.USER_WORDS)).alias("has_user"),
        page_type.alias("page_type"),
    )


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def text_hints(text: Column) -> Column:
    """The same booleans guessed from words of the text itself, for samples without a page."""
    said = {k: text.rlike(java(p)) for k, p in patterns.TEXT_HINTS.items()}
    return F.struct(
        (said["email"] | said["password"]).alias("has_email"), said["phone"].alias("has_phone"), said["password"].alias("has_password"), said["financial"].alias("has_financial"),
        said["medical"].alias("has_medical"), said["government"].alias("has_government"), said["birth"].alias("has_birth"),
    )


# What a hint adds to a finding of a sample, and its cap.
SAMPLE_RAISES = {
    "EMAIL": ("has_email", 0.08, 1.0), "PHONE": ("has_phone", 0.1, 1.0), "CREDIT_CARD": ("has_financial", 0.05, 1.0), "GOVERNMENT_ID": ("has_government", 0.1, 0.98),
    "MEDICAL_ID": ("has_medical", 0.1, 0.95), "BANK_ACCOUNT": ("has_financial", 0.05, 0.9), "FINANCIAL_DATA": ("has_financial", 0.15, 0.85), "DATE_OF_BIRTH": ("has_birth", 0.35, 0.9),
}


def sample_entities(text: Column, with_hints: bool = True) -> Column:
    """Findings in a short labelled sample: the runtime's detectors with ungated bank accounts and dates, then hints."""
    bank = F.transform(F.flatten(F.array(*[matches(text, p) for p in patterns.BANK[:2]])), lambda v: _entry("BANK_ACCOUNT", v, F.lit(0.82)))
    dated = F.lit(False)
    for p in patterns.DATE[:3]:
        dated = dated | trim(text).rlike(java(p))
    date = F.when(dated, F.array(_entry("DATE_OF_BIRTH", trim(text), F.lit(0.5)))).otherwise(_none())
    found = F.concat(
        email_entities(text, "rt"), phone_entities(text, "rt"), card_entities(text, "rt"), government_entities(text, "rt"), key_entities(text, "rt"), token_entities(text, "rt"),
        medical_entities(text, "rt"), bank, address_entities(text, "rt"), financial_entities(text, "rt"), date,
    )
    found = _first_of(found, lambda e: F.struct(e["type"], e["value"]))
    if not with_hints:
        return F.when(trim(text) != "", found).otherwise(_none())
    hints = text_hints(text)

    def raised(e: Column) -> Column:
        c = e["confidence"]
        for kind, (name, by, cap) in SAMPLE_RAISES.items():
            c = F.when((e["type"] == kind) & hints[name], F.least(e["confidence"] + by, F.lit(cap))).otherwise(c)
        return F.struct(e["type"].alias("type"), e["value"].alias("value"), c.alias("confidence"))

    password = F.when(hints["has_password"] & F.length(text).between(4, 128), F.array(_entry("PASSWORD", trim(text), F.lit(0.95)))).otherwise(_none())
    named = (text.rlike(java(patterns.USER_TEXT)) | hints["has_password"]) & F.length(text).between(3, 30) & trim(text).rlike(patterns.USERNAME)
    user = F.when(named, F.array(_entry("USERNAME", trim(text), F.lit(0.65)))).otherwise(_none())
    return F.when(trim(text) != "", F.concat(F.transform(found, raised), password, user)).otherwise(_none())


def _lookup(key: Column, table: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for value in dict.fromkeys(table.values()):
        out = F.when(key.isin(*[k for k, v in table.items() if v == value]), value).otherwise(out)
    return out


def field_category(field: Column) -> Column:
    """Category and confidence of a form field (a struct), null if it isn't sensitive; the first rule that holds decides."""
    low = lambda c: F.lower(F.coalesce(field[c], F.lit("")))
    words = F.concat(low("name"), F.lit(" "), low("placeholder"), F.lit(" "), low("label"))
    auto = low("autocomplete")
    hit = lambda kind, confidence: F.struct(F.lit(kind).alias("category"), F.lit(confidence).alias("confidence"))
    kind_of = lambda name: _lookup(name, fixed.AUTOCOMPLETE)
    some = lambda kind, confidence: F.struct(kind.alias("category"), F.lit(confidence).alias("confidence"))
    known = _any([F.startswith(auto, F.lit(p)) for p in fixed.AUTOCOMPLETE_PREFIXES])
    begun = F.get(F.filter(F.array(*[F.lit(n) for n in fixed.AUTOCOMPLETE]), lambda n: F.startswith(auto, n)), F.lit(0))  # the first name that it begins with
    out = F.when(F.coalesce(field["is_password"], F.lit(False)) | (field["type"] == "password"), hit("PASSWORD", 0.99))
    out = out.when(kind_of(auto).isNotNull(), some(kind_of(auto), 0.95)).when(known & begun.isNotNull(), some(kind_of(begun), 0.9))
    for pattern, type_, kind, confidence in patterns.FIELD_RULES:
        test = words.rlike(java(pattern))
        out = out.when(test | (field["type"] == type_) if type_ else test, hit(kind, confidence))
    return out


def first_of_page(found: DataFrame, keys: tuple[str, ...] = ("page_id",), order: tuple[str, ...] = ("chunk_pos", "pos")) -> DataFrame:
    """The first finding of each type and value of a page in the order of chunks, detectors and places."""
    rank = F.row_number().over(Window.partitionBy(*keys, "type", "value").orderBy(*order))
    return found.withColumn("__rank", rank).where("__rank = 1").drop("__rank")
